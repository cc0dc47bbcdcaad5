"""N-gram Jaccard join by token-combination prefixes.

The items are the documents' sets of distinct word shingles.  All shingles stand in one global order, rare
ones first, frequent ones last.  A document's prefix is as long as the number of shingles that a partner may lack,
plus one, so two linked documents share an entry of the shorter prefix (by the order), which the other holds too.
If that prefix has rare shingles only, they are single signatures.  Otherwise it is extended into the frequent ones, which
are dealt into classes by hash: of a class all but the first shingle count, and the prefix ends when those and the rare ones are as many
as before.  A partner lacks too few of them to spoil all, so two linked documents share a rare shingle or two shingles of
one class, and pairs within classes are their signatures.  There are as many classes as an eighth of a set's size, in powers of two, so a
class has few shingles of a prefix and a document some three pairs for ten shingles; a document signs for each power that its partners' sizes may have.

Documents that share a signature are first compared with the smallest of them.  Only documents that are then
still in different components are compared with each other, so groups of copies stay linear.  Few share a rare
shingle; these pairs are joined, those whose set sketches show that they can't link are set aside, and all others are
compared on their whole texts.  Documents that share pairs of frequent shingles, or a single one with more than ``MANY`` others, are chained to
clusters.  A cluster is dealt into blocks of bounded size; each pair of blocks is one task, which looks up who shares a signature with
whom, skips what is joined already, and hands on only links that join parts.

The sketch of counts has a fixed size, so its noise grows with the corpus.  A pass over all documents therefore counts
exactly how many prefixes each single signature stands in.  Crowded ones become frequent, which moves the prefixes of the documents
that hold them on to other shingles, as crowded among copies as the first.  So of documents with many crowded ones all rare
shingles are counted, and crowded ones become frequent, too.

A signature, or a set, that a large part of the documents shares meets its smallest document by a broadcast (``hot_join``).

Defined cases: a null or empty text has an empty set and links with nothing; null ids are kept, unlinked, with a
null component; rows that repeat an id are one node; equal sets are linked without comparison.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm import blocksum
from narrascope.llm.rows import bound_batches
from narrascope.llm.skew import hot_join
from narrascope.llm.textbatch import U, mix, raw, shingle_sets
from narrascope.operators.clusters import connected_components
from narrascope.session import Scratch

SKETCH_BITS = 20
FINE_BITS = 22
#: Rare shingles that stand in this many prefixes are made frequent; shared by more than ``MANY`` documents they chain clusters.
CROWDED = 8
MANY = 64
#: The part of a prefix, one in so many, that is crowded where all shingles of a document are counted.
COPIED = 4
#: Bins of a set's sketch, the summed sizes beyond which the share of equal bins is looked at, and the probability with
#: which that test may fail a pair at the threshold.
BINS = 256
LARGE = 4096
RISK = 1e-9
#: Ids that may be broadcast (8 MB), and documents of one block of a cluster.
FEW = 1_000_000
PART = 1024
#: A shingle is frequent if it is counted this often above its cell's expected noise.
FREQUENT = 64
FREQUENT_LEVEL = 250
#: Shingles of a set for each class of frequent ones.
CLASS = 8


def units(n: int, threshold: int) -> int:
    """One more than the number of n entries that a linked set can lack."""
    return n + (-threshold * n) // 100 + 1


class Signer:
    """Signatures of a set under fixed frequency levels.

    ``coarse`` has a level for each cell of the sketch, ``fine`` the frequent level for each cell
    that holds a shingle known to stand in many prefixes.
    """

    def __init__(self, coarse: np.ndarray, fine: np.ndarray, threshold: int):
        self.coarse, self.fine, self.threshold = coarse, fine, threshold

    def level(self, u: np.ndarray) -> np.ndarray:
        return np.maximum(self.coarse[u >> U(64 - SKETCH_BITS)], self.fine[u >> U(64 - FINE_BITS)])

    def singles(self, u: np.ndarray) -> np.ndarray:
        """The rare entries of the prefix."""
        level = self.level(u)
        order = np.argsort(level, kind="stable")
        return u[order[: min(units(len(u), self.threshold), int(np.count_nonzero(level < FREQUENT_LEVEL)))]]

    def rare(self, u: np.ndarray) -> np.ndarray:
        """All rare entries."""
        return u[self.level(u) < FREQUENT_LEVEL]

    def __call__(self, u: np.ndarray) -> list[tuple[np.ndarray, bool]]:
        """Signatures, and whether they are made of frequent entries."""
        n = len(u)
        if n * 100 < self.threshold * (n + 1):  # too small to link with any other set
            return []
        single = self.singles(u)
        need = units(n, self.threshold) - len(single)
        if need <= 0:
            return [(single, False)]
        frequent = u[self.level(u) == FREQUENT_LEVEL]  # in the global order, which is that of their hashes
        low, high = -(-n * self.threshold // 100), n * 100 // self.threshold
        own = [self.combined(frequent, need, tier) for tier in range(low.bit_length() - 1, high.bit_length())]
        return [(single, False), (np.unique(np.concatenate(own)), True)]

    def combined(self, frequent: np.ndarray, need: int, tier: int) -> np.ndarray:
        """Pairs of one class within the prefix of ``need`` more entries; for sizes near 2^tier.

        Where sets are so small that they may link by one shared entry, entries stand alone.
        """
        classes = class_count(tier, self.threshold)
        if not classes:
            return frequent[:need]
        group = (mix(frequent ^ U(0x9E6C63D0876A9A35)) >> U(32)) % U(classes)
        by = np.argsort(group, kind="stable")
        new = np.ones(len(by), bool)
        new[1:] = group[by][1:] != group[by][:-1]
        counts = np.zeros(len(by), np.int64)
        counts[by] = ~new  # all but a class's first
        end = int(np.searchsorted(np.cumsum(counts), need)) + 1
        by = by[by < end]
        group, entries = group[by], frequent[by]
        out = []
        for apart in range(1, len(by)):
            same = group[apart:] == group[:-apart]
            if not same.any():
                break
            out.append(mix(entries[:-apart][same] ^ mix(entries[apart:][same] + U(0x632BE59BD9B4E019))))
        return np.concatenate(out) if out else np.zeros(0, U)


@functools.cache
def class_count(tier: int, threshold: int) -> int:
    """Classes for sets of at least threshold percent of 2^tier entries, so that even the whole set of the least size has enough
    entries beyond the first of each class; 0 if two of one class can't be asked for."""
    least = (threshold * threshold << tier) // 10_000  # entries that two linked sets have in common, at least
    return max(0, min(max(1, (1 << tier) // CLASS), least - 1))


def _levels(counts: np.ndarray) -> np.ndarray:
    """Levels in the global order from counts: rare ones by rising count, then frequent ones."""
    mean = float(counts.mean())
    most = mean + 6 * np.sqrt(mean) + FREQUENT
    top = FREQUENT_LEVEL - 1
    return np.where(counts < most, np.minimum(top, counts * (top / most)), FREQUENT_LEVEL).astype(np.uint8)


def _crowded_cells(crowded: DataFrame) -> np.ndarray:
    """The frequent level in all cells that hold a crowded single signature."""

    def mark(batches):
        cells = np.zeros(1 << FINE_BITS, np.uint32)
        for batch in batches:
            np.add.at(cells, (batch.column(0).to_numpy().view(U) >> U(64 - FINE_BITS)).astype(np.int64), np.uint32(1))
        numbers, held = blocksum.to_rows(cells)
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(held, pa.binary())], ["block", "cells"])

    total = blocksum.summed(crowded.select("sig").coalesce(8).mapInArrow(mark, blocksum.SCHEMA), 1 << FINE_BITS, np.uint32)
    return np.where(total > 0, FREQUENT_LEVEL, 0).astype(np.uint8)


def _overlaps(k: int, threshold: int):
    def compare(batches):
        for batch in batches:
            left, right = shingle_sets(batch.column(2), k), shingle_sets(batch.column(3), k)
            keep = pa.array([_linked(x, y, threshold) for (_, x), (_, y) in zip(left, right)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return compare


def sketch(u: np.ndarray) -> np.ndarray:
    """A byte for each of ``BINS`` hash ranges: a mark of the least entry in it, 0 without one."""
    edges = np.arange(BINS, dtype=U) << U(64 - BINS.bit_length() + 1)
    at = np.searchsorted(u, edges)
    if not len(u):
        return np.zeros(BINS, np.uint8)
    full = np.diff(np.append(at, len(u))) > 0
    return np.where(full, mix(u[np.minimum(at, len(u) - 1)]) >> U(56) | U(1), U(0)).astype(np.uint8)


def may_link(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, threshold: int) -> np.ndarray:
    """Whether sets with these sketches and sizes, row by row, can link.

    A bin differs only if an entry of just one of the sets lies in it, and linked sets have at most
    (100 - t) / (100 + t) of their summed sizes of those.  Beyond ``LARGE`` entries this says little; there, a bin is equal
    with the probability of the similarity, and a pair is set aside if so few bins are equal as a pair at the threshold
    has with a probability of ``RISK`` or less.
    """
    differ = (x != y).sum(axis=1)
    both = nx + ny
    ok = (differ * (100 + threshold) <= both * (100 - threshold)) & (nx * threshold <= ny * 100) & (ny * threshold <= nx * 100)
    used = ((x > 0) | (y > 0)).sum(axis=1)
    return ok & ((both <= LARGE) | ((used - differ) * BINS > _unlikely(threshold) * used))


@functools.cache
def _unlikely(threshold: int) -> int:
    """The largest number of equal bins that a pair at the threshold doesn't exceed with a probability of ``RISK`` or less; -1 if there is none."""
    p, total, k = threshold / 100, 0.0, -1
    while k + 1 < BINS and (total := total + math.comb(BINS, k + 1) * p ** (k + 1) * (1 - p) ** (BINS - k - 1)) <= RISK:
        k += 1
    return k


def _alike(threshold: int):
    def compare(batches):
        for batch in batches:
            x, y = (_bins(batch.column(k)).reshape(-1, BINS) for k in (2, 4))
            keep = pa.array(may_link(x, batch.column(3).to_numpy(), y, batch.column(5).to_numpy(), threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return compare


def _bins(col: pa.Array) -> np.ndarray:
    data, off = raw(col)
    return data[off[0] : off[-1]]


class Parts:
    """Union-find over rows."""

    def __init__(self, labels: np.ndarray):
        _, self.up = np.unique(labels, return_inverse=True)
        first = np.full(self.up.max(initial=0) + 1, len(labels))
        np.minimum.at(first, self.up, np.arange(len(labels)))
        self.up = first[self.up]

    def roots(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if (nxt == self.up).all():
                return nxt
            self.up = nxt

    def _root(self, i: int) -> int:
        while self.up[i] != i:
            i = self.up[i]
        return i

    def differ(self, i: int, j: int) -> bool:
        return self._root(i) != self._root(j)

    def join(self, i: int, j: int) -> None:
        i, j = self._root(i), self._root(j)
        self.up[max(i, j)] = min(i, j)


def _entries(k: int):
    """Each row's id, block, part and so on with its sorted set in place of its text."""

    def run(batches):
        for batch in batches:
            held = [u.tobytes() for _, u in shingle_sets(batch.column(batch.num_columns - 1), k)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held, pa.binary())], [*batch.schema.names[:-1], "entries"])

    return run


def _dense_links(shared, threshold: int):
    """Links that join the parts of one block pair of a cluster; within a part none is looked for."""

    def run(table: pa.Table) -> pa.Table:
        ids, part = table["id"].to_numpy(), table["part"].to_numpy()
        sets = [np.frombuffer(e.as_buffer(), U) for e in table["entries"]]
        n = np.array([len(u) for u in sets])
        bins = np.stack([sketch(u) for u in sets])
        signer = Signer(*shared.value, threshold)
        signed = [np.concatenate([s for s, _ in signer(u)] or [np.zeros(0, U)]) for u in sets]
        # who holds each signature, and which signatures each row has, by number
        first = np.append(0, np.cumsum([len(s) for s in signed]))
        _, number, count = np.unique(np.concatenate(signed), return_inverse=True, return_counts=True)
        holder = np.repeat(np.arange(len(sets)), np.diff(first))[np.argsort(number, kind="stable")]
        bounds = np.append(0, np.cumsum(count))
        parts, out = Parts(part), []
        for i in range(len(sets) - 1):
            own = number[first[i] : first[i + 1]]
            own = own[count[own] > 1]
            near = np.zeros(len(sets), bool)
            at = np.repeat(bounds[own] - np.append(0, np.cumsum(count[own])[:-1]), count[own]) + np.arange(count[own].sum())
            near[holder[at]] = True
            near[: i + 1] = False
            root = parts.roots()
            j = np.flatnonzero(near & (root != root[i]))
            j = j[may_link(bins[np.full(len(j), i)], np.full(len(j), n[i]), bins[j], n[j], threshold)]
            for y in j.tolist():
                if parts.differ(i, y) and _linked(sets[i], sets[y], threshold):
                    parts.join(i, y)
                    out.append((ids[i], ids[y]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= threshold * (len(x) + len(y) - both)


def _of_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the groups (a written table with the sizes ``c``) with the groups' columns; hot groups are split."""
    total = groups.agg(F.sum("c")).first()[0] or 0
    return hot_join(rows, groups, keys, "c", total, ["id"])


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``texts`` joined to those of ``ids`` by id; ids are broadcast if they are few."""
    return texts.join(F.broadcast(ids) if ids.count() <= FEW else ids, "id")


def verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, k: int, threshold: int, work: Scratch, name: str) -> DataFrame:
    """Those of the pairs (a, b) whose texts' sets link, as a written table.  ``texts`` is (id, text)."""
    x = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    y = sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    alike = pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "na", "sb", "nb").mapInArrow(_alike(threshold), "a long, b long")
    alike = work.save(alike.distinct(), f"{name}-alike")
    ids = work.save(alike.select(F.col("a").alias("id")).unionAll(alike.select("b")).distinct(), f"{name}-ids")
    some = work.save(_texts_of(texts, ids), f"{name}-texts")
    left = alike.join(some.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(some.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    out = work.save(both.select("a", "b", "ta", "tb").mapInArrow(_overlaps(k, threshold), "a long, b long").distinct(), name)
    work.drop(f"{name}-texts")
    work.release()
    return out


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, threshold: int = 85) -> DataFrame:
    """One row per document: its id, ``n_shingles``, ``component_id`` and ``n_links`` found while linking.

    ``threshold`` is a percentage: sets link if 100 * intersection >= threshold * union.  ``n_links`` counts the
    compared links that hold the document's component together, not all links inside it.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "ngram")
    bound_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def statistics(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["id", "n", "h1", "h2", "sketch", "block", "cells"]
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            h = np.zeros((2, batch.num_rows), U)
            sketches = []
            for i, u in shingle_sets(batch.column(1), k):
                n[i] = len(u)
                h[0, i], h[1, i] = u.sum(dtype=U), mix(u + U(5)).sum(dtype=U)
                sketches.append(sketch(u).tobytes())
                np.add.at(counts, (u >> U(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
            none = pa.nulls(batch.num_rows)
            columns = [batch.column(0), pa.array(n), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, none.cast(pa.int32()), none.cast(pa.binary())], names)
        numbers, cells = blocksum.to_rows(counts)
        if len(numbers):
            none = pa.nulls(len(numbers))
            yield pa.RecordBatch.from_arrays([*[none.cast(pa.int64())] * 4, none.cast(pa.binary()), pa.array(numbers), pa.array(cells, pa.binary())], names)

    found = work.save(texts.mapInArrow(statistics, "id long, n long, h1 long, h2 long, sketch binary, block int, cells binary"), "statistics")
    stats = found.where("block is null").select("id", "n", "h1", "h2", "sketch")
    coarse = _levels(blocksum.summed(found.where("block is not null"), 1 << SKETCH_BITS, np.uint32))
    fine = np.zeros(1 << FINE_BITS, np.uint8)

    named_texts = texts.where("id is not null")

    def rows(some: DataFrame, kind: str):
        """(sig, id, paired) of each text's signatures, its single ones (``singles``) or all its rare entries (``rare``)."""
        shared = spark.sparkContext.broadcast((coarse, fine))  # 5 MB, whatever the input

        def sign(batches):
            signer = Signer(*shared.value, threshold)
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                held: list = []
                size = 0
                for i, u in shingle_sets(batch.column(1), k):
                    for s, paired in signer(u) if kind == "all" else ((getattr(signer, kind)(u), False),):
                        if len(s):
                            held.append((ids[i], s, paired))
                            size += len(s)
                    if size > 1 << 18:
                        yield _signed(held)
                        held, size = [], 0
                if held:
                    yield _signed(held)

        return some.mapInArrow(sign, "sig long, id long, paired boolean")

    def holding(new: np.ndarray) -> DataFrame:
        """The texts of whose prefixes one shingle in ``COPIED`` or more lies in the new frequent cells."""
        shared = spark.sparkContext.broadcast((coarse, fine, new))

        def keep(batches):
            old, cells = Signer(*shared.value[:2], threshold), shared.value[2]
            for batch in batches:
                prefixes = [old.singles(u) for _, u in shingle_sets(batch.column(1), k)]
                hit = [len(x) > 0 and COPIED * np.count_nonzero(cells[x >> U(64 - FINE_BITS)]) >= len(x) for x in prefixes]
                yield batch.filter(pa.array(hit, pa.bool_()))

        return named_texts.mapInArrow(keep, "id long, text string")

    def crowded(some: DataFrame, kind: str) -> np.ndarray:
        found = rows(some, kind).groupBy("sig").agg(F.count("*").alias("c")).where(F.col("c") >= CROWDED)
        return _crowded_cells(work.save(found, f"crowded-{kind}"))

    new = crowded(named_texts, "singles")
    some = work.save(holding(new), "crowding")
    fine = np.maximum(fine, new)
    fine = np.maximum(fine, crowded(some, "rare"))
    work.release()
    work.drop("crowding")
    signed = work.save(rows(named_texts, "all"), "signed")
    shared_by = signed.groupBy("sig").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("c")).where("lo <> hi")
    groups = _of_groups(signed, work.save(shared_by.select("sig", "c"), "shared"), ["sig"])
    whole = stats.where("n > 0 and id is not null")
    first = whole.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1")
    same = _of_groups(whole.select("id", "n", "h1", "h2"), work.save(first, "first"), ["h1", "h2", "n"])
    same = work.save(same.where("id <> rep").select("id", "rep").distinct(), "same")
    groups = groups.join(same, "id", "left").select("sig", F.coalesce("rep", "id").alias("id"), "paired")
    groups = work.save(groups.distinct(), "groups")
    work.drop("signed")

    least = groups.groupBy("sig").agg(F.min("id").alias("b"), F.max("id").alias("hi"), F.count("*").alias("c")).where("b <> hi")
    least = work.save(least.select("sig", "b", "c", (F.col("c") > MANY).alias("many")), "least")
    sharing = work.save(_of_groups(groups, least, ["sig"]), "sharing")
    work.drop("groups")
    starred = sharing.where("id <> b")
    stars = verified(starred.select(F.col("id").alias("a"), "b").distinct(), stats, texts, k, threshold, work, "stars")
    parts = connected_components(stars, "a", "b")

    part_of = parts.withColumnRenamed("node", "id").withColumnRenamed("component", "part")
    named = sharing.where("not paired and not many").join(part_of, "id", "left").select("sig", "id", F.coalesce("part", "id").alias("part"))
    named = work.save(named, "named")
    mixed = named.groupBy("sig").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("sig")
    rest = named.join(mixed, "sig").join(whole.groupBy("id").agg(F.min("n").alias("low"), F.max("n").alias("high")), "id")
    x, y = rest.alias("x"), rest.alias("y")
    near = (F.col("x.low") * threshold <= F.col("y.high") * 100) & (F.col("y.low") * threshold <= F.col("x.high") * 100)
    cross = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.part") < F.col("y.part")) & near)
    cross = cross.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    cross = verified(cross, stats, texts, k, threshold, work, "cross")

    # clusters of documents that shared pairs or crowded shingles chain together, where they still have several parts
    chained = starred.where("paired or many").select("id", "b").distinct()
    clusters = connected_components(chained, "id", "b").select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    clusters = clusters.join(part_of, "id", "left").select("id", "cluster", F.coalesce("part", "id").alias("part"))
    clusters = work.save(clusters, "clusters")
    split = clusters.groupBy("cluster").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("size")).where("p <> q")
    split = split.select("cluster", F.ceil(F.col("size") / PART).cast("int").alias("blocks"))
    members = work.save(clusters.join(split, "cluster"), "members")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    held = _texts_of(texts, members).withColumn("own", own).select("id", "cluster", "part", "blocks", "own", "text")
    held = work.save(held.mapInArrow(_entries(k), "id long, cluster long, part long, blocks int, own int, entries binary"), "entries")
    placed = held.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("cluster", F.least("own", "k").alias("x"), F.greatest("own", "k").alias("y"), "id", "part", "entries")
    shared = spark.sparkContext.broadcast((coarse, fine))
    dense = placed.groupBy("cluster", "x", "y").applyInArrow(_dense_links(shared, threshold), "a long, b long")
    dense = work.save(dense.distinct(), "dense")
    work.release()

    links = stars.unionAll(cross).unionAll(dense)
    edges = links.unionAll(same.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    parts = connected_components(edges, "a", "b")
    degree = links.select(F.col("a").alias("id")).unionAll(links.select("b")).groupBy("id").agg(F.count("*").alias("links"))
    out = stats.join(parts.withColumnRenamed("node", "id"), "id", "left").join(degree, "id", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


def _signed(held: list) -> pa.RecordBatch:
    sizes = [len(s) for _, s, _ in held]
    sig = np.concatenate([s for _, s, _ in held]).view(np.int64)
    ids, paired = np.array([i for i, _, _ in held], np.int64), np.array([d for _, _, d in held], bool)
    return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(paired, sizes))], ["sig", "id", "paired"])
