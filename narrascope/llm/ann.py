"""Approximate nearest neighbours by inner product over robust-pruned directed graphs.

Vectors are dealt into shards of about ``SHARD`` by their hash.  In each shard a graph is built in batches that grow with
it: a greedy search from the medoid proposes a point's neighbours, and pruning keeps a neighbour only if no kept one is nearer
to it by the factor ``ALPHA``, so edges stay diverse and some are long; edges are added both ways.  A query runs a beam
search in each shard, opening ``WIDE`` points of the beam at a time; what the shards find is ranked by the exact inner
product in double precision.  Searches of many points advance together as numpy arrays, in single precision.

Queries go to the shards in passes of at most ``PASS_BYTES``, which are broadcast, so an index is read once for each pass
and never moves; where there are fewer shards than cores, each is read by several tasks that share its queries.

Inner products become distances by one more component, the root of the largest squared norm less a vector's own.
Equal vectors are one point of the graph, and its smallest ids stand for it in results.

Defined cases: null and empty vectors, zero vectors, those with a null or non-finite component, and those of
another length than most take no part, as queries and as candidates; ties go to the smaller id; rows that repeat id and
vector count once; an id with several vectors is a candidate by each and, as a query, asks for each.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrascope.llm.rows import bound_batches
from narrascope.llm.skew import hot_join
from narrascope.session import Scratch

#: Points of a shard, and bytes of its index, at most.
SHARD = 100_000
INDEX_BYTES = 64 << 20
#: Bytes of the queries of one pass.
PASS_BYTES = 32 << 20
DEGREE = 32
BUILD_BEAM = 64
ALPHA = 1.2
BEAM = 320
WIDE = 4
BATCH = 256


def _beam_search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the beam at the end of each query's search, in no order; where it isn't full the distance is infinite.

    ``x`` and ``graph`` have a last row that stands for no point.  Distances are squared and lack the query's own square.
    """
    n, count = len(x) - 1, len(q)
    wide = min(WIDE, beam)
    stamp = np.arange(1, wide * graph.shape[1] + 1, dtype=np.uint8)[None]
    seen = np.zeros((count, n + 1), np.uint8)  # 255: seen
    seen[:, n] = 255
    seen[:, start] = 255
    ids = np.full((count, beam), n, np.int32)
    dist = np.full((count, beam), np.inf, np.float32)
    open_ = np.zeros((count, beam), bool)
    ids[:, 0], dist[:, 0], open_[:, 0] = start, norms[start] - 2 * q @ x[start], True
    active = np.arange(count)
    while len(active):
        row, rows = np.arange(len(active))[:, None], active[:, None]
        held, at_most, unopened = ids[active], dist[active], open_[active]
        key = np.where(unopened, at_most, np.inf)
        nearest = np.argpartition(key, wide - 1, axis=1)[:, :wide]
        node = np.where(np.isfinite(key[row, nearest]), held[row, nearest], n)
        unopened[row, nearest] = False
        near = graph[node].reshape(len(active), -1)
        fresh = seen[rows, near] != 255
        # of a point that several opened ones name, only one mention survives the stamping
        seen[rows, near] = np.where(fresh, stamp, 255)
        fresh &= seen[rows, near] == stamp
        seen[rows, near] = 255
        i, j = np.nonzero(fresh)
        point = near[i, j]
        far = np.full(near.shape, np.inf, np.float32)
        far[i, j] = norms[point] - 2 * np.einsum("ij,ij->i", x[point], q[active[i]])
        far = np.concatenate([at_most, far], axis=1)
        best = np.argpartition(far, beam - 1, axis=1)[:, :beam]
        dist[active] = far[row, best]
        ids[active] = np.concatenate([held, near], axis=1)[row, best]
        left = np.concatenate([unopened, fresh], axis=1)[row, best]
        open_[active] = left
        active = active[left.any(axis=1)]
    return ids, dist


def _prune(x: np.ndarray, found: np.ndarray, far: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning of candidate lists with squared distances (infinite for none) to at most ``degree`` neighbours; the last row's number fills up."""
    order = np.argsort(far, axis=1, kind="stable")
    found, far = np.take_along_axis(found, order, 1), np.take_along_axis(far, order, 1)
    c = x[found]
    square = (c * c).sum(axis=2)
    between = (square[:, :, None] + square[:, None, :] - 2 * np.matmul(c, c.transpose(0, 2, 1))) * (ALPHA * ALPHA)
    out = np.full((len(found), degree), len(x) - 1, np.int32)
    alive, used = np.isfinite(far), np.zeros(len(found), np.int64)
    for k in range(found.shape[1]):
        on = alive[:, k] & (used < degree)
        out[on, used[on]] = found[on, k]
        used[on] += 1
        alive[on] &= between[on, k] > far[on]
    return out


def build(x: np.ndarray, seed: int = 3) -> tuple[np.ndarray, int]:
    """(neighbours of each point, filled up with the point count; start point) of a graph over the rows of ``x``."""
    x = x.astype(np.float32)
    n = len(x)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    wide = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
    norms = (wide * wide).sum(axis=1)
    graph = np.full((n + 1, DEGREE), n, np.int32)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    lo = 1
    while lo < n:
        p = order[lo : lo + min(lo, 2 * BATCH)]
        lo += len(p)
        ids, far = _beam_search(wide, norms, graph, start, wide[p], BUILD_BEAM)
        graph[p] = new = _prune(wide, ids, far + norms[p][:, None], DEGREE)
        to, source = new[new < n], np.repeat(p, (new < n).sum(axis=1))
        by = np.argsort(to, kind="stable")
        to, source = to[by], source[by]
        heads, first, count = np.unique(to, return_index=True, return_counts=True)
        have = (graph[heads] < n).sum(axis=1)
        room = have + count <= DEGREE
        fits = np.repeat(room, count)
        nth = np.arange(len(to)) - np.repeat(first, count)
        graph[to[fits], (np.repeat(have, count) + nth)[fits]] = source[fits]
        full = np.flatnonzero(~room)
        for k in range(0, len(full), BATCH):
            some = full[k : k + BATCH]
            h, c = heads[some], count[some]
            more = np.full((len(some), int(c.max())), n, np.int32)
            at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            more[np.repeat(np.arange(len(some)), c), at] = source[np.repeat(first[some], c) + at]
            every = np.concatenate([graph[h], more], axis=1)
            far = norms[every] + norms[h][:, None] - 2 * np.einsum("ijk,ik->ij", wide[every], wide[h])
            graph[h] = _prune(wide, every, np.where(every == n, np.inf, far), DEGREE)
    return graph, start


def _pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def search_block(index: dict, q: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, inner products) of the ``want`` best points found for each query in one shard; -1 fills up."""
    x, graph = index["x"], index["graph"]
    n = len(x)
    square = (x.astype(float) ** 2).sum(axis=1)
    wide = np.concatenate([np.column_stack([x, np.sqrt(np.maximum(0, float(index["bound"]) - square))]), np.zeros((1, x.shape[1] + 1))]).astype(np.float32)
    norms = (wide * wide).sum(axis=1)
    out_at, out_score = [], []
    for lo in range(0, len(q), BATCH):
        part = q[lo : lo + BATCH]
        ids, far = _beam_search(wide, norms, graph, int(index["start"]), np.column_stack([part, np.zeros(len(part))]).astype(np.float32), max(BEAM, want))
        keep = np.argpartition(far, min(2 * want, far.shape[1]) - 1, axis=1)[:, : 2 * want]
        ids, far = np.take_along_axis(ids, keep, 1), np.take_along_axis(far, keep, 1)
        score = np.einsum("ijk,ik->ij", x[np.minimum(ids, n - 1)].astype(float), part.astype(float))
        score[~np.isfinite(far)] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, :want]
        score = np.take_along_axis(score, best, 1)
        out_at.append(np.where(np.isfinite(score), np.take_along_axis(ids, best, 1), -1))
        out_score.append(score)
    return np.concatenate(out_at), np.concatenate(out_score)


def _matrix(col, d: int, kind) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(kind)


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found for each row for which the condition ``is_query`` holds."""
    spark = vectors.sparkSession
    work = Scratch(spark, "ann")
    bound_batches(spark)
    v = F.col(f"`{vector_col}`")
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    kind = np.float32 if single else np.float64
    usable = v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(usable & F.col(f"`{id_col}`").isNotNull())
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<float>" if single else "array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = work.save(rows.groupBy("v", "id").agg(F.max("asks").alias("asks")), "rows")
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    d = lengths["d"] if lengths else 1
    rows = rows.where(F.size("v") == d)
    points = work.save(rows.groupBy("v").agg(F.min("id").alias("point"), F.count_if("asks").alias("n")), "points")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    stats = points.agg(F.count("*").alias("n"), F.max(square).alias("m"), F.sum("n").alias("asking"), F.count_if(F.col("n") > 0).alias("asked")).first()
    most = max(1, min(shard, INDEX_BYTES // (4 * (d + 1 + DEGREE))))
    shards, bound = max(1, -(-stats["n"] // most)), float(stats["m"] or 0.0)

    def index(table: pa.Table) -> pa.Table:
        table = table.sort_by("point")
        x = _matrix(table["v"], d, kind)
        extra = np.sqrt(np.maximum(0, bound - (x.astype(float) ** 2).sum(axis=1)))
        graph, start = build(np.column_stack([x, extra]))
        return pa.table({"shard": table["shard"][:1], "index": pa.array([_pack(x=x, ids=table["point"].to_numpy(), graph=graph, start=start, bound=bound)], pa.binary())})

    placed = points.select("point", "v", F.pmod(F.xxhash64("point", "v"), F.lit(shards)).cast("int").alias("shard"))
    graphs = work.save(placed.groupBy("shard").applyInArrow(index, "shard int, index binary"), "graphs")
    copies = max(1, -(-spark.sparkContext.defaultParallelism // shards))
    if copies > 1:
        graphs = graphs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).repartitionByRange(shards * copies, "shard", "copy")
    else:
        graphs = graphs.withColumn("copy", F.lit(0))

    passes = max(1, -(-(stats["asked"] or 0) * (d + 1) * 8 // PASS_BYTES))
    asked = work.save(points.where("n > 0").select("point", "v", F.pmod(F.xxhash64("point", "v", F.lit(1)), F.lit(passes)).cast("int").alias("pass")), "asked")
    hits = None
    for turn in range(passes):
        block = asked.where(F.col("pass") == turn).select("point", "v").toArrow()
        shared = spark.sparkContext.broadcast((block["point"].to_numpy(), _matrix(block["v"], d, kind)))

        def search(batches, shared=shared):
            asked_ids, q = shared.value
            for batch in batches:
                for r in range(batch.num_rows):
                    found = dict(np.load(io.BytesIO(batch.column(0)[r].as_buffer())))
                    mine = slice(batch.column(1)[r].as_py(), None, copies)
                    for lo in range(0, len(q[mine]), 8 * BATCH):
                        at, score = search_block(found, q[mine][lo : lo + 8 * BATCH], k + 1)
                        ok = at >= 0
                        columns = [pa.array(np.repeat(asked_ids[mine][lo : lo + 8 * BATCH], ok.sum(axis=1))), pa.array(found["ids"][at[ok]]), pa.array(score[ok])]
                        yield pa.RecordBatch.from_arrays(columns, ["asked", "point", "score"])

        part = work.save(graphs.select("index", "copy").mapInArrow(search, "asked long, point long, score double"), f"hits-{turn}")
        hits = part if hits is None else hits.unionAll(part)
        shared.unpersist()
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "point")
    hits = work.save(hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"), "hits")
    small = Window.partitionBy("v").orderBy("id")
    members = rows.select("id", "v").withColumn("r", F.row_number().over(small)).where(F.col("r") <= k + 1)
    members = members.join(points.select("v", "point"), "v").select(F.col("id").alias("vec_id"), "point")
    near = hits.join(members, "point").select("asked", "vec_id", "score")
    first = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r")
    near = near.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    near = work.save(near.join(points.select(F.col("point").alias("asked"), "n"), "asked"), "near")
    asking = stats["asking"] or 0
    queries = hot_join(rows.where("asks").select(F.col("id").alias("query_id"), "v"), points.where("n > 0").select("v", F.col("point").alias("asked"), "n"), ["v"], "n", asking, ["query_id"])
    out = hot_join(queries.select("query_id", "asked"), near, ["asked"], "n", asking, ["query_id"])
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
