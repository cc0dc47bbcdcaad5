"""Products of vector blocks on a grid of tasks.

Queries and candidates are packed into blocks.  A cell of the grid holds a group of query blocks and sees a group of candidate
blocks one after the other; with about as many groups as a group has blocks, a block is copied once for each group of
the other side, the square root of the number of blocks, and not once for each of its partners.  What a cell makes of its
products is a fold: it adds candidate blocks to its query blocks and hands on one result for each query.

Where a cell has to see all candidates, blocks are not copied at all: they are written once, and each cell reads that table
from one end to the other.

A block knows its middle and its radius on the unit sphere, so a fold that needs similarities above a bound passes over
candidate blocks that the triangle inequality keeps below it.  Blocks of large tables follow the nearest of some drawn
pivots, so that vectors in clusters make narrow blocks.
"""

from __future__ import annotations

import io
import math
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from narrascope.session import Scratch, share_code

#: Vectors in one block, and query blocks in one cell, at most.
BLOCK = 1024
HELD = 64
#: Vectors that are drawn as pivots, and the number of vectors from which on they are.
PIVOTS = 64
MANY = 1 << 15
#: Cells of a grid whose cells see all candidates, bytes of their similarities at a time, bytes of candidates that stay out of files,
#: and bytes of blocks that a cell's reader takes at a time.
CELLS = 48
ROWS = 1 << 26
SPOOL = 1 << 28
PAGE = 1 << 24


@dataclass
class Block:
    """Ids, vectors and labels of some rows, and what a pass before has found for each of them."""

    ids: np.ndarray
    x: np.ndarray
    labels: np.ndarray
    extra: dict[str, np.ndarray]

    def __post_init__(self):
        with np.errstate(invalid="ignore", divide="ignore"):
            self.unit = self.x / np.linalg.norm(self.x, axis=1, keepdims=True)
            middle = np.nansum(self.unit, axis=0)
            self.middle = middle / np.linalg.norm(middle)
        away = self.unit @ self.middle
        self.radius = math.acos(min(1.0, max(-1.0, float(np.nanmin(away))))) if np.isfinite(away).any() else math.pi

    @cached_property
    def defined(self) -> np.ndarray:
        """Rows that have a direction."""
        return np.isfinite(self.unit).all(axis=1)

    @cached_property
    def single(self) -> np.ndarray:
        """Directions in single precision, zeros where there is none."""
        return np.where(self.defined[:, None], self.unit, 0.0).astype(np.float32)

    @cached_property
    def names(self) -> np.ndarray:
        return np.unique(self.labels)

    def nearest(self, other: Block) -> float:
        """No cosine between the two blocks is larger."""
        apart = math.acos(min(1.0, max(-1.0, float(self.middle @ other.middle)))) - self.radius - other.radius
        return 1.0 if not apart > 0 else math.cos(apart) + 1e-7  # angles near 0 are exact to 1e-8 only


#: ``cosine``, ``inner``, or a function of two arrays of vectors that gives their similarities, row by column.
Measure = str | Callable[[np.ndarray, np.ndarray], np.ndarray]


def product(a: Block, b: Block, measure: Measure) -> np.ndarray:
    """Similarities of all rows of both; NaN where one isn't defined."""
    if callable(measure):
        return np.asarray(measure(a.x, b.x), float)
    return a.unit @ b.unit.T if measure == "cosine" else a.x @ b.x.T


#: Products of matrices are that exact; what decides is computed row by row, alike for equal vectors wherever they stand.
NEAR = 1e-12


def coarse(a: Block, b: Block) -> tuple[np.ndarray, float]:
    """Cosines in single precision and twice their largest error, by the rounding of a sum of that many products; 0 where not defined."""
    return a.single @ b.single.T, (a.x.shape[1] + 4) * 2.0**-22


def exact(a: Block, i: np.ndarray, b: Block, j: np.ndarray, measure: str = "cosine") -> np.ndarray:
    """Similarities of single pairs, which don't depend on the blocks around them."""
    return (a.unit[i] * b.unit[j]).sum(axis=1) if measure == "cosine" else (a.x[i] * b.x[j]).sum(axis=1)


class Fold:
    """What a cell makes of products: ``start`` with its query blocks, ``add`` candidate blocks, then hand on ``rows``.

    ``schema`` names the columns of the rows.
    """

    schema = ""

    def start(self, held: list[Block]) -> None:
        self.held = held

    def add(self, block: Block) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def rows(self) -> Iterator[pa.RecordBatch]:
        yield from ()

    def batch(self, *columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [f.split()[0] for f in self.schema.split(", ")])


def _groups(rows: DataFrame, n: int, most: int, by_label: bool) -> tuple[DataFrame, int]:
    """With the block ``b`` of each of ``n`` rows: of the nearest pivot or the label, and by the hash of the id where these have many rows."""
    block = min(most, max(64, -(-n // 8)))
    if by_label:
        return _dealt(rows.withColumn("pivot", F.pmod(F.xxhash64("label"), F.lit(PIVOTS)).cast("int")), block)
    if n <= MANY:
        parts = max(1, -(-n // block))
        return rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")), parts
    drawn = np.array([r[0] for r in rows.where("v is not null").orderBy(F.xxhash64("id")).select("v").limit(min(PIVOTS, -(-n // block))).collect()], float)
    with np.errstate(invalid="ignore", divide="ignore"):
        pivots = np.nan_to_num(drawn / np.linalg.norm(drawn, axis=1, keepdims=True))

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float)
        return pd.Series(np.argmax(np.nan_to_num(x) @ pivots.T, axis=1).astype(np.int32))

    return _dealt(Scratch(rows.sparkSession, "grid").save(rows.withColumn("pivot", nearest("v")), "rows"), block)


def _dealt(rows: DataFrame, block: int) -> tuple[DataFrame, int]:
    """With the block ``b`` of each row of a ``pivot``."""
    sizes = {r.pivot: r["count"] for r in rows.groupBy("pivot").count().collect()}  # PIVOTS rows at most
    first, total = {}, 0
    for pivot in sorted(sizes):
        first[pivot] = (total, -(-sizes[pivot] // block))
        total += first[pivot][1]
    if not sizes:
        return rows.withColumn("b", F.lit(0)), 1
    at = F.create_map(*[F.lit(x) for pivot in first for x in (pivot, first[pivot][0])])
    parts = F.create_map(*[F.lit(x) for pivot in first for x in (pivot, first[pivot][1])])
    return rows.withColumn("b", at[F.col("pivot")] + F.pmod(F.xxhash64("id"), parts[F.col("pivot")]).cast("int")), total


def packed(df: DataFrame, id_col: str, vector: str, label: str | Column | None, n: int, most: int, extra: list[str] = [], by_label: bool = False) -> tuple[DataFrame, int]:  # noqa: B006
    """(b, data) of the blocks of ``n`` rows, and their number.  Vectors of single precision stay so until they are multiplied."""
    named = F.lit(0) if label is None else F.col(label) if isinstance(label, str) else label
    kind = df.select(vector).schema[0].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"), named.cast("long").alias("label"), *extra)
    rows, n = _groups(rows.where("v is not null and id is not null"), n, most, by_label)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        parts = {"ids": pdf["id"].to_numpy(), "x": np.stack(pdf["v"].to_numpy()).astype(np.float32 if single else float), "labels": pdf["label"].to_numpy()}
        for name in extra:
            own = pdf[name].tolist()
            parts |= {f"{name}_n": np.array([len(v) for v in own]), name: np.concatenate([np.asarray(v) for v in own])}
        out = io.BytesIO()
        np.savez(out, **parts)
        return pd.DataFrame({"b": [pdf["b"].iloc[0]], "data": [out.getvalue()]})

    return rows.groupBy("b").applyInPandas(pack, "b int, data binary"), n


def _unpack(data: bytes) -> Block:
    found = dict(np.load(io.BytesIO(data)))
    return Block(found.pop("ids"), found.pop("x").astype(float), found.pop("labels"), found)


def grid(queries: DataFrame, candidates: DataFrame, fold: Callable[[], Fold], id_col: str = "vec_id", vector: str = "embedding", label: str | Column | None = None, block: int = BLOCK, extra: list[str] = [], asked: int | None = None, by_label: bool = False, whole: bool = False) -> DataFrame:  # noqa: B006
    """The rows of a fold in every cell; a query has a row, or several, of each group of candidate blocks.

    Rows with null ids or vectors are left out; labels are whole numbers; ``extra`` are array columns of the queries,
    and ``asked`` is their number if it is known.  With ``by_label`` the rows of a label share blocks.  With ``whole`` a cell
    sees all candidates, block by block, so that a query has all its rows from one cell; its fold starts before it has its
    query blocks, which come among the candidates.
    """
    spark = queries.sparkSession
    share_code(spark)
    asked = queries.count() if asked is None else asked
    left, n_left = packed(queries, id_col, vector, label, asked, block, extra, by_label)
    if whole:
        blocks = left.select("b", F.lit(True).alias("asks"), F.lit(True).alias("seen"), "data")
        if candidates is not queries:
            right, _ = packed(candidates, id_col, vector, label, candidates.count(), block, [], by_label)
            blocks = blocks.withColumn("seen", F.lit(False)).unionAll(right.select("b", F.lit(False), F.lit(True), "data"))
        return _streamed(blocks, n_left, fold)
    right, n_right = packed(candidates, id_col, vector, label, asked if candidates is queries else candidates.count(), block, [], by_label)
    held = min(HELD, math.ceil(math.sqrt(n_left)))
    down, across = -(-n_left // held), min(n_right, math.ceil(math.sqrt(n_right)))
    row, column = F.floor(F.col("b") / held).cast("int"), F.pmod("b", F.lit(across))
    own = F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda k: row * across + k)
    others = F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda k: k * across + column)
    cells = left.select(F.explode(own).alias("cell"), F.lit(0).alias("side"), "b", "data")
    other = right.select(F.explode(others).alias("cell"), F.lit(1).alias("side"), "b", "data")
    ordered = cells.unionAll(other).repartition(down * across, "cell").sortWithinPartitions("cell", "side", "b").select("cell", "side", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), batch.column(2)[r].as_py()) for batch in batches for r in range(batch.num_rows))
        for _, group in groupby(rows, lambda r: r[0]):
            f, mine, started = fold(), [], False
            for _, side, data in group:
                if side == 0:
                    mine.append(_unpack(data))
                    continue
                if not started:
                    f.start(mine)
                    started = True
                if mine:
                    yield from f.add(_unpack(data))
            if started and mine:
                yield from f.rows()

    return ordered.mapInArrow(run, fold().schema)


def _streamed(blocks: DataFrame, n: int, fold: Callable[[], Fold]) -> DataFrame:
    """The rows of a fold in cells that see all blocks: of ``(b, asks, seen, data)``, with ``n`` blocks that ask.

    The blocks are written once.  A cell is a task that reads them one after the other and lets go of those that are not its
    own queries; nothing is copied, exchanged or sorted for it.
    """
    spark = blocks.sparkSession
    held = min(HELD, -(-n // CELLS))
    down = -(-n // held)
    written = Scratch(spark, "cells").save(blocks, "blocks", **{"parquet.block.size": PAGE})
    # the side of one partition is streamed, once for each partition of the other, which is a single number
    pairs = written.coalesce(1).hint("shuffle_replicate_nl").crossJoin(spark.range(0, down, 1, down))
    own = F.col("asks") & (F.floor(F.col("b") / held) == F.col("id"))
    rows = pairs.select(own.alias("own"), "seen", "data").where("own or seen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, mine, any_seen = fold(), [], False
        f.start(mine)
        for batch in batches:
            for r in range(batch.num_rows):
                block = _unpack(batch.column(2)[r].as_py())
                if batch.column(0)[r].as_py():
                    mine.append(block)
                if batch.column(1)[r].as_py():
                    any_seen = True
                    yield from f.add(block)
        if mine and any_seen:
            yield from f.rows()

    return rows.mapInArrow(run, fold().schema)


class Best(Fold):
    """``(q, c, sim, ql, cl)`` of at least ``least``, and of those the ``top`` best of each query, ties to the smaller id."""

    schema = "q long, c long, sim double, ql long, cl long"

    def __init__(self, top: int | None, least: float | None, measure: Measure, exclude_self: bool):
        self.top, self.least, self.measure, self.exclude_self = top, least, measure, exclude_self
        self.made = self.skipped = 0

    def start(self, held: list[Block]) -> None:
        self.held = held
        self.cut = [np.full(len(a.ids), -np.inf if self.least is None else self.least) for a in held]
        self.kept: list[list[tuple[np.ndarray, ...]]] = [[] for _ in held]
        self.waiting = [0] * len(held)

    def add(self, block: Block) -> Iterator[pa.RecordBatch]:
        for k, a in enumerate(self.held):
            if self.measure == "cosine" and a.nearest(block) < self.cut[k].min():
                self.skipped += 1
                continue
            self.made += 1
            i, j = self._near(k, a, block)
            s = product(a, block, self.measure)[i, j] if callable(self.measure) else exact(a, i, block, j, self.measure)
            if self.least is not None:
                i, j, s = i[s >= self.least], j[s >= self.least], s[s >= self.least]
            found = (i, block.ids[j], s, block.labels[j])
            if self.top is None:
                yield self._rows(a, found)
            elif len(i):
                self.kept[k].append(found)
                self.waiting[k] += len(i)
                if self.waiting[k] > 4 * self.top * len(a.ids):
                    self._settle(k)

    def _near(self, k: int, a: Block, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may be among the best, by products that are made for all."""
        if self.measure == "cosine":
            s, margin = coarse(a, block)
            bad = np.zeros(0, bool) if a.defined.all() and block.defined.all() else ~(a.defined[:, None] & block.defined)
        else:
            s = product(a, block, self.measure)
            bad = np.isnan(s)
            margin = 2 * NEAR * max(1.0, float(np.abs(s[~bad]).max(initial=0.0)))
        if self.exclude_self and np.isin(a.ids, block.ids).any():
            bad = (bad if bad.size else False) | (a.ids[:, None] == block.ids)
        if bad.any():
            s = np.where(bad, s.dtype.type(-np.inf), s)
        cut = self.cut[k] - margin
        some = np.isinf(cut) if self.least is None else self._loose(k)
        if self.top is not None and self.top < s.shape[1] and some.any():
            cut[some] = np.maximum(cut[some], -np.partition(-s[some], self.top - 1, axis=1)[:, self.top - 1] - 2 * margin)
        # a bound is rounded down to the precision of the products
        i, j = np.nonzero(s >= np.nextafter(cut.astype(s.dtype), s.dtype.type(-np.inf))[:, None])
        if bad.any():
            i, j = i[~bad[i, j]], j[~bad[i, j]]
        return i, j

    def _loose(self, k: int) -> np.ndarray:
        """Queries whose bound is still the least that is asked for."""
        return self.cut[k] <= self.least

    def _settle(self, k: int) -> None:
        """Keep each query's best and raise its bound to the last of them."""
        if not self.kept[k]:
            return
        i, c, s, l = (np.concatenate(x) for x in zip(*self.kept[k]))
        order = np.lexsort((c, -s, i))
        i, c, s, l = i[order], c[order], s[order], l[order]
        start = np.searchsorted(i, np.arange(len(self.held[k].ids)))
        place = np.arange(len(i)) - start[i]
        full = place == self.top - 1
        self.cut[k][i[full]] = np.maximum(self.cut[k][i[full]], s[full])
        keep = place < self.top
        self.kept[k], self.waiting[k] = [(i[keep], c[keep], s[keep], l[keep])], int(keep.sum())

    def _rows(self, a: Block, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        i, c, s, l = found
        return self.batch(a.ids[i], c, s, a.labels[i], l)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for k, a in enumerate(self.held):
            self._settle(k)
            for found in self.kept[k]:
                yield self._rows(a, found)


class LabelSums(Fold):
    """``(q, ql, cl, total, n)``: the sum of each query's cosine distances to the candidates of each label, but itself."""

    schema = "q long, ql long, cl long, total double, n long"

    def start(self, held: list[Block]) -> None:
        self.held = held
        self.sums: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [{} for _ in held]

    def add(self, block: Block) -> Iterator[pa.RecordBatch]:
        names, group = np.unique(block.labels, return_inverse=True)
        member = np.eye(len(names))[group]
        for a, sums in zip(self.held, self.sums):
            far = 1 - product(a, block, "cosine")
            ok = ~np.isnan(far) & (a.ids[:, None] != block.ids)
            total, n = np.where(ok, far, 0.0) @ member, ok.astype(float) @ member
            for g, name in enumerate(names.tolist()):
                before = sums.get(name, (0.0, 0.0))
                sums[name] = (before[0] + total[:, g], before[1] + n[:, g])
        yield from ()

    def rows(self) -> Iterator[pa.RecordBatch]:
        for a, sums in zip(self.held, self.sums):
            for name, (total, n) in sums.items():
                some = np.flatnonzero(n)
                yield self.batch(a.ids[some], a.labels[some], np.full(len(some), name, np.int64), total[some], n[some].astype(np.int64))


class BestPairs(Fold):
    """``(q, c, sim)``: the ``top`` best pairs of a cell with q < c, ties to the smaller ids."""

    schema = "q long, c long, sim double"

    def __init__(self, top: int):
        self.top, self.cut = top, -np.inf
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def add(self, block: Block) -> Iterator[pa.RecordBatch]:
        for a in self.held:
            if a.ids.min() >= block.ids.max() or a.nearest(block) < self.cut:
                continue
            s, margin = coarse(a, block)
            ok = a.defined[:, None] & block.defined & (a.ids[:, None] < block.ids) if a.ids.max() >= block.ids.min() or not (a.defined.all() and block.defined.all()) else None
            if ok is not None:
                s = np.where(ok, s, np.float32(-np.inf))
            cut = self.cut
            if np.isinf(cut) and self.top < s.size:
                cut = float(-np.partition(-s, self.top - 1, axis=None)[self.top - 1]) - margin
            i, j = np.nonzero(s >= np.nextafter(np.float32(cut - margin), np.float32(-np.inf)))
            if ok is not None:
                i, j = i[ok[i, j]], j[ok[i, j]]
            for at in range(0, len(i), SPOOL >> 13):
                self._merge(a, i[at : at + (SPOOL >> 13)], block, j[at : at + (SPOOL >> 13)])
        yield from ()

    def _merge(self, a: Block, i: np.ndarray, block: Block, j: np.ndarray) -> None:
        q, c, s = (np.concatenate(x) for x in zip(self.found, (a.ids[i], block.ids[j], exact(a, i, block, j))))
        order = np.lexsort((c, q, -s))[: self.top]
        self.found = q[order], c[order], s[order]
        if len(order) == self.top:
            self.cut = float(self.found[2][-1])

    def rows(self) -> Iterator[pa.RecordBatch]:
        yield self.batch(*self.found)


class BestOfLabel(Fold):
    """``(q, c, sim)``: each query's best candidate of its own label, with ``earlier`` of those with a smaller id only."""

    schema = "q long, c long, sim double"

    def __init__(self, exclude_self: bool, earlier: bool = False):
        self.exclude_self, self.earlier = exclude_self, earlier

    def start(self, held: list[Block]) -> None:
        self.held = held
        self.best = [(np.full(len(a.ids), -np.inf), np.full(len(a.ids), -1, np.int64)) for a in held]

    def add(self, block: Block) -> Iterator[pa.RecordBatch]:
        for a, (sims, cs) in zip(self.held, self.best):
            if not np.isin(a.names, block.names).any() or (self.earlier and a.ids.max() <= block.ids.min()):
                continue
            ok = a.labels[:, None] == block.labels
            if not (a.defined.all() and block.defined.all()):
                ok &= a.defined[:, None] & block.defined
            if self.earlier:
                ok &= block.ids < a.ids[:, None]
            elif self.exclude_self and np.isin(a.ids, block.ids).any():
                ok &= a.ids[:, None] != block.ids
            if ok.mean() > 0.05:
                s, margin = coarse(a, block)
                s = np.where(ok, s, np.float32(-np.inf))
                ok &= s >= np.nextafter((np.maximum(s.max(axis=1), sims) - 2 * margin).astype(np.float32), np.float32(-np.inf))[:, None]
            i, j = np.nonzero(ok)
            s, c = exact(a, i, block, j), block.ids[j]
            order = np.lexsort((c, -s, i))
            i, c, s = i[order], c[order], s[order]
            head = np.diff(i, prepend=-1) > 0
            i, c, s = i[head], c[head], s[head]
            better = (s > sims[i]) | ((s == sims[i]) & (c < cs[i]))
            sims[i[better]], cs[i[better]] = s[better], c[better]
        yield from ()

    def rows(self) -> Iterator[pa.RecordBatch]:
        for a, (sims, cs) in zip(self.held, self.best):
            some = np.flatnonzero(sims > -np.inf)
            yield self.batch(a.ids[some], cs[some], sims[some])


class RankMetrics(Fold):
    """``(q, r, ap, ndcg, within, first_hit, hits)``: what the ranks of a query's candidates of its own label come to.

    ``within`` counts those among the first r, ``hits`` those among the first k for each of ``ks``.  For cells that see all candidates:
    these wait in a file if they are many, in single precision where that is exact, and of the queries as many are ranked at a time as ``ROWS`` bytes of similarities allow.
    The similarities of a query are sorted with their relevance as last bit; what is as near as products are exact is put in
    order by exact ones.
    """

    schema = "q long, r long, ap double, ndcg double, within long, first_hit long, hits array<long>"

    def __init__(self, ks: tuple[int, ...], exclude_self: bool):
        self.ks, self.exclude_self = ks, exclude_self

    def start(self, held: list[Block]) -> None:
        self.held = held
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL)
        self.ids, self.labels, self.starts, self.kept = [], [], [0], []

    def add(self, block: Block) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            single = block.x.astype(np.float32)
        x = single if np.array_equal(single, block.x) else block.x
        self.kept.append((self.file.tell(), x.dtype, np.linalg.norm(block.x, axis=1, keepdims=True)))
        self.file.write(x.tobytes())
        self.ids.append(block.ids)
        self.labels.append(block.labels)
        self.starts.append(self.starts[-1] + len(block.ids))
        yield from ()

    def _unit(self, b: int, width: int) -> np.ndarray:
        at, kind, norms = self.kept[b]
        self.file.seek(at)
        x = np.frombuffer(self.file.read(len(norms) * width * kind.itemsize), kind).reshape(-1, width).astype(float)
        with np.errstate(invalid="ignore", divide="ignore"):
            return x / norms

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.ids, self.labels, self.starts = np.concatenate(self.ids), np.concatenate(self.labels), np.array(self.starts)
        discount = 1 / np.log2(np.arange(2.0, len(self.ids) + 2))
        ideal = np.cumsum(discount)
        step = max(1, ROWS // (8 * len(self.ids)))
        room = np.empty((step, len(self.ids)))
        with self.file:
            for a in self.held:
                for at in range(0, len(a.ids), step):
                    to = min(len(a.ids), at + step)
                    yield from self._ranked(a, at, to, room[: to - at], discount, ideal)

    def _ranked(self, a: Block, at: int, to: int, far: np.ndarray, discount: np.ndarray, ideal: np.ndarray) -> Iterator[pa.RecordBatch]:
        for b in range(len(self.starts) - 1):
            np.matmul(-a.unit[at:to], self._unit(b, a.x.shape[1]).T, out=far[:, self.starts[b] : self.starts[b + 1]])
        out = []
        for i, row in zip(range(at, to), far):
            if np.isnan(row.sum()):
                row[np.isnan(row)] = np.inf
            if self.exclude_self:
                row[self.ids == a.ids[i]] = np.inf
            rel = (self.labels == a.labels[i]) & (row < np.inf)
            if not rel.any():
                continue
            bits = row.view(np.int64)
            bits &= -2
            bits |= rel
            own = np.sort(row)
            flags = (own.view(np.int64) & 1).astype(bool)
            pos = self._settled(a, i, row, rel, own, flags)
            r, gain = len(pos), discount[pos].sum()
            ap = (np.arange(1.0, r + 1) / (pos + 1)).sum() / r
            out.append((a.ids[i], r, ap, gain / ideal[r - 1], np.searchsorted(pos, r), pos[0] + 1, np.searchsorted(pos, self.ks).tolist()))
        if out:
            *columns, hits = zip(*out)
            yield self.batch(*[np.array(c) for c in columns], pa.array(hits, pa.list_(pa.int64())))

    def _settled(self, a: Block, i: int, row: np.ndarray, rel: np.ndarray, own: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """The places of relevant candidates, with those right that are as near to others as products are exact."""
        pos = np.flatnonzero(flags)
        before, after = np.maximum(pos - 1, 0), np.minimum(pos + 1, len(own) - 1)
        mixed = pos[(~flags[before] & (own[pos] - own[before] <= 2 * NEAR)) | (~flags[after] & (own[after] - own[pos] <= 2 * NEAR))]
        if not len(mixed):
            return pos
        own = np.minimum(own, 4.0)  # of those without a cosine
        # runs of neighbours, from the first to behind the last
        breaks = np.flatnonzero(np.diff(own) > 2 * NEAR) + 1 if len(mixed) > 8 else None
        runs, upto = [], 0
        for m in mixed.tolist():
            if m < upto:
                continue
            if breaks is None:
                lo = hi = m
                while lo > 0 and own[lo] - own[lo - 1] <= 2 * NEAR:
                    lo -= 1
                while hi + 1 < len(own) and own[hi + 1] - own[hi] <= 2 * NEAR:
                    hi += 1
                hi += 1
            else:
                k = np.searchsorted(breaks, m, "right")
                lo, hi = breaks[k - 1] if k else 0, breaks[k] if k < len(breaks) else len(own)
            runs.append((int(lo), int(hi)))
            upto = hi
        order = np.argsort(row, kind="stable") if len(runs) > 8 else None
        members = [np.flatnonzero((row >= own[lo]) & (row <= own[hi - 1])) if order is None else order[lo:hi] for lo, hi in runs]
        sims = self._exact(a, i, np.concatenate(members))
        for (lo, hi), near in zip(runs, members):
            own_sims, sims = sims[: len(near)], sims[len(near) :]
            flags[lo:hi] = rel[near[np.lexsort((self.ids[near], -own_sims))]]
        return np.flatnonzero(flags)

    def _exact(self, a: Block, i: int, who: np.ndarray) -> np.ndarray:
        """Similarities of query ``i`` to single candidates."""
        out, block = np.empty(len(who)), np.searchsorted(self.starts, who, "right") - 1
        order = np.argsort(block, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(block[order])) + 1, len(who))
        for lo, hi in zip(np.append(0, ends[:-1]), ends):
            b, some = block[order[lo]], order[lo:hi]
            out[some] = (a.unit[i] * self._unit(b, a.x.shape[1])[who[some] - self.starts[b]]).sum(axis=1)
        return out


class Relevant(Fold):
    """``(q, cs, sims)``: each query's candidates of its own label."""

    schema = "q long, cs array<long>, sims array<double>"

    def __init__(self, exclude_self: bool):
        self.exclude_self = exclude_self

    def start(self, held: list[Block]) -> None:
        self.held, self.found = held, [[] for _ in held]

    def add(self, block: Block) -> Iterator[pa.RecordBatch]:
        for a, found in zip(self.held, self.found):
            ok = (a.labels[:, None] == block.labels) & a.defined[:, None] & block.defined
            if self.exclude_self:
                ok &= a.ids[:, None] != block.ids
            i, j = np.nonzero(ok)
            if len(i):
                found.append((i, block.ids[j], exact(a, i, block, j)))
        yield from ()

    def rows(self) -> Iterator[pa.RecordBatch]:
        for a, found in zip(self.held, self.found):
            if not found:
                continue
            i, c, s = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((c, -s, i))
            i, c, s = i[order], c[order], s[order]
            who, at = np.unique(i, return_index=True)
            ends = pa.array(np.append(at, len(i)).astype(np.int32))
            yield self.batch(a.ids[who], pa.ListArray.from_arrays(ends, pa.array(c)), pa.ListArray.from_arrays(ends, pa.array(s)))


class Above(Fold):
    """``(q, above)``: for each of a query's ``cs`` and ``sims`` how many candidates of the cell rank above it."""

    schema = "q long, above array<long>"

    def __init__(self, exclude_self: bool):
        self.exclude_self = exclude_self

    def start(self, held: list[Block]) -> None:
        self.held = held
        self.counts = [np.zeros(len(a.extra["cs"]), np.int64) for a in held]

    def add(self, block: Block) -> Iterator[pa.RecordBatch]:
        for a, counts in zip(self.held, self.counts):
            if not len(counts) or a.nearest(block) < a.extra["sims"].min():
                continue
            if (a.extra["cs_n"] == 1).all():
                self._count_one(a, block, counts)
                continue
            s = product(a, block, "cosine")
            bad = np.isnan(s)
            if self.exclude_self:
                bad |= a.ids[:, None] == block.ids
            far = np.where(bad, np.inf, -s)
            order = np.argsort(far, axis=1, kind="stable")
            ends = np.cumsum(a.extra["cs_n"])
            for i, (lo, hi) in enumerate(zip(ends - a.extra["cs_n"], ends)):
                own, ids = far[i][order[i]], block.ids[order[i]]
                least, c = -a.extra["sims"][lo:hi], a.extra["cs"][lo:hi]
                left, right = np.searchsorted(own, least - NEAR, "left"), np.searchsorted(own, least + NEAR, "right")
                counts[lo:hi] += left
                for t in np.flatnonzero((right > left) & ~((right == left + 1) & (ids[np.minimum(left, len(ids) - 1)] == c))):
                    near = order[i][left[t] : right[t]]
                    sims = exact(a, np.full(len(near), i), block, near)
                    counts[lo + t] += ((sims > -least[t]) | ((sims == -least[t]) & (block.ids[near] < c[t]))).sum()
        yield from ()

    def _count_one(self, a: Block, block: Block, counts: np.ndarray) -> None:
        """Of queries with one candidate each: comparisons do for those that are clearly above it or below."""
        least, c = a.extra["sims"], a.extra["cs"]
        s, margin = coarse(a, block)
        if not block.defined.all():
            s[:, ~block.defined] = -np.inf
        if self.exclude_self and np.isin(a.ids, block.ids).any():
            s[a.ids[:, None] == block.ids] = -np.inf
        low, high = (least - margin).astype(np.float32)[:, None], (least + margin).astype(np.float32)[:, None]
        above = np.count_nonzero(s > high, axis=1)
        counts += above
        close = np.flatnonzero(np.count_nonzero(s >= low, axis=1) > above)
        i, j = np.nonzero((s[close] >= low[close]) & (s[close] <= high[close]))
        i = close[i]
        sims = exact(a, i, block, j)
        counts += np.bincount(i[(sims > least[i]) | ((sims == least[i]) & (block.ids[j] < c[i]))], minlength=len(counts))

    def rows(self) -> Iterator[pa.RecordBatch]:
        for a, counts in zip(self.held, self.counts):
            ends = pa.array(np.append(0, np.cumsum(a.extra["cs_n"])).astype(np.int32))
            yield self.batch(a.ids, pa.ListArray.from_arrays(ends, pa.array(counts)))


class LogSumExp(Fold):
    """``(q, top, total, own)``: the largest logit of each query, the sum of all exponentials over it, and the logit of the
    candidate with the query's own id."""

    schema = "q long, top double, total double, own double"

    def __init__(self, temperature: float, own_weight: float):
        self.temperature, self.own_weight = temperature, own_weight

    def start(self, held: list[Block]) -> None:
        self.held = held
        self.state = [(np.full(len(a.ids), -np.inf), np.zeros(len(a.ids)), np.full(len(a.ids), np.nan)) for a in held]

    def add(self, block: Block) -> Iterator[pa.RecordBatch]:
        for k, a in enumerate(self.held):
            top, total, own = self.state[k]
            z = product(a, block, "cosine") / self.temperature
            i, j = np.nonzero(a.ids[:, None] == block.ids)
            z[i, j] += self.own_weight
            own[i] = z[i, j]
            z = np.where(np.isnan(z), -np.inf, z)
            new = np.maximum(top, z.max(axis=1))
            with np.errstate(invalid="ignore"):
                total = np.where(np.isinf(top), 0.0, total * np.exp(top - new)) + np.where(np.isinf(new)[:, None], 0.0, np.exp(z - new[:, None])).sum(axis=1)
            self.state[k] = (new, total, own)
        yield from ()

    def rows(self) -> Iterator[pa.RecordBatch]:
        for a, (top, total, own) in zip(self.held, self.state):
            yield self.batch(a.ids, top, total, pa.array(own, from_pandas=True))
