"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's word windows: every ``window`` consecutive words of an item, or the whole item if it
is shorter.  Patterns of one length are searched together.  A table holds, for each block of two words, how far the
search may move on when the block stands at the end of the place it looks at; most blocks of a text are in no
pattern and let it skip nearly a window.  Where the table says 0, the patterns whose last block has the same hash are
compared with the text, first word by word as hashes and then as the words' bytes.  Texts are cut into lanes of
``LANE`` start positions whose searches advance together as numpy arrays.  Windows are places in the items' words, kept
in flat arrays, so the tables take about ten times the bytes of the benchmark's text; a worker makes them once.

Defined cases: null and empty texts have no words and no hits; items without words, with null text or a null id have
no windows; items that repeat an id count once; a document word inside any occurrence is hit once; documents without an id and
those that repeat one are rows of their own; an empty benchmark hits nothing; columns named like new ones are replaced.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrascope.llm.rows import map_texts
from narrascope.llm.textbatch import _PLACE, ALNUM, LOWER, U, blocks, eights, mix, same_spans, span_hashes, word_spans
from narrascope.session import Scratch

LANE = 512
#: Bits of a shift table: at least, at most, and beyond those that number the blocks of words.
TABLE_BITS = (14, 24, 2)
#: Bytes of benchmark text that one search table is made of; more items are searched in several rounds.
ROUND_BYTES = 16 << 20


class Patterns:
    """Wu-Manber tables for patterns of one length: windows of ``words`` (hashes) that begin at ``first``."""

    def __init__(self, words: np.ndarray, first: np.ndarray, m: int):
        self.words, self.first, self.m, self.b = words, first, m, min(2, m)
        most = m - self.b + 1
        least, top, more = TABLE_BITS
        self.bits = min(top, max(least, int(len(first)).bit_length() + more))
        self.shift = np.full(1 << self.bits, min(255, most), np.uint8)
        for j in range(most):
            np.minimum.at(self.shift, self._cell(self._block(words[first + j], words[first + (j + self.b - 1)])), np.uint8(min(255, most - 1 - j)))
        self.suffixes = self._block(words[first + (m - self.b)], words[first + (m - 1)])
        self.order = np.argsort(self.suffixes).astype(np.int32)
        self.suffixes = self.suffixes[self.order]

    @staticmethod
    def _block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return mix(x * _PLACE[40] + y * _PLACE[41])

    def _cell(self, key: np.ndarray) -> np.ndarray:
        return (key >> U(64 - self.bits)).astype(np.int64)

    def search(self, h: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of all places in the texts where all words' hashes agree."""
        m, b = self.m, self.b
        stop = np.maximum(per[1:] - m + 1, per[:-1])
        lanes = -(-(stop - per[:-1]) // LANE)
        total = int(lanes.sum())
        none = np.zeros(0, np.int64)
        if not total:
            return none, none
        nth = np.arange(total) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(per[:-1], lanes) + nth * LANE
        end = np.minimum(at + LANE, np.repeat(stop, lanes))
        places, keys = [none], [np.zeros(0, U)]
        while len(at):
            key = self._block(h[at + (m - b)], h[at + (m - 1)])
            move = self.shift[self._cell(key)].astype(np.int64)
            hit = move == 0
            if hit.any():
                places.append(at[hit])
                keys.append(key[hit])
                move[hit] = 1
            at = at + move
            on = at < end
            if not on.all():
                at, end = at[on], end[on]
        place, key = np.concatenate(places), np.concatenate(keys)
        lo, n = np.searchsorted(self.suffixes, key), np.searchsorted(self.suffixes, key, side="right")
        n = n - lo
        found_at, found = [none], [none]
        for k in _parts(n, 1 << 18):
            p, q = np.repeat(place[k], n[k]), self.order[_ranges(lo[k], n[k])].astype(np.int64)
            for j in range(m):
                same = h[p + j] == self.words[self.first[q] + j]
                p, q = p[same], q[same]
            found_at.append(p)
            found.append(q)
        return np.concatenate(found_at), np.concatenate(found)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start..start+count, one range after the other."""
    to = np.cumsum(count)
    return np.repeat(start - (to - count), count) + np.arange(to[-1] if len(to) else 0)


def _parts(count: np.ndarray, most: int):
    """Slices over which ``count`` sums to about ``most``, or that hold one entry."""
    total = np.cumsum(count)
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most)))
        yield slice(lo, hi)
        lo = hi


class Searcher:
    """All windows of a set of (item id, text) as flat arrays: word hashes, places of distinct windows, and the items that have each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = [(text or "").encode() for _, text in items]
        low = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        starts, ends, per = word_spans(low, np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64), ALNUM)
        del texts
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        named = np.array([number[name] for name, _ in items], np.int32)
        self.ahead = eights(low)
        words = span_hashes(low, starts, ends, self.ahead)
        self.starts, self.sizes = starts.astype(np.int32), (ends - starts).astype(np.int32)
        del starts, ends
        length = np.minimum(np.diff(per), window)
        self.tables = []
        for m in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == m)
            count = np.diff(per)[own] - m + 1
            at, item = _ranges(per[:-1][own], count).astype(np.int32), np.repeat(named[own], count)
            g = np.zeros(len(at), U)
            for j in range(m):
                g = mix(g * _PLACE[42] + words[at + j])
            order = np.argsort(g, kind="stable").astype(np.int32)
            g, at, item = g[order], at[order], item[order]
            new = np.ones(len(at), bool)
            again = np.flatnonzero(g[1:] == g[:-1]) + 1
            new[again] = ~self._same(self.ahead, self.starts, self.sizes, at[again - 1].astype(np.int64), at[again].astype(np.int64), m)
            del g, order
            head = np.flatnonzero(new)
            self.tables.append((Patterns(words, at[head], m), np.append(head, len(at)), item))

    def _same(self, ahead: np.ndarray, starts: np.ndarray, sizes: np.ndarray, p: np.ndarray, q: np.ndarray, m: int) -> np.ndarray:
        """Whether m words from p on (of the given bytes) are the words of the items from q on, byte by byte."""
        same = np.ones(len(p), bool)
        for j in range(m):
            live = np.flatnonzero(same)
            x, y = p[live] + j, q[live] + j
            ok = sizes[x] == self.sizes[y]
            ok[ok] = same_spans(ahead, starts[x[ok]].astype(np.int64), self.ahead, self.starts[y[ok]].astype(np.int64), self.sizes[y[ok]].astype(np.int64))
            same[live] = ok
        return same

    def find(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are hit, and the (text, item number) pairs found, in order."""
        ahead = eights(low)
        h = span_hashes(low, starts, ends, ahead)
        change = np.zeros(len(starts) + 1, np.int64)
        pairs = [np.zeros(0, np.int64)]
        for table, bounds, item in self.tables:
            place, which = table.search(h, per)
            same = self._same(ahead, starts, ends - starts, place, table.first[which].astype(np.int64), table.m)
            place, which = place[same], which[same]
            np.add.at(change, place, 1)
            np.add.at(change, place + table.m, -1)
            texts = np.searchsorted(per, place, side="right") - 1
            seen = np.unique(texts * len(table.first) + which)
            texts, which = seen // len(table.first), seen % len(table.first)
            count = bounds[which + 1] - bounds[which]
            pairs.append(np.unique(np.repeat(texts, count) * len(self.names) + item[_ranges(bounds[which], count)]))
        found = np.unique(np.concatenate(pairs))
        return np.cumsum(change[:-1]) > 0, found // max(1, len(self.names)), found % max(1, len(self.names))


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", _SPAN), T.StructField("hit_items", T.ArrayType(T.StringType()))]
_ARROW_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of each document with ``n_words``, ``hit_spans`` (word numbers, end excluded) and ``hit_items``.

    The benchmark is read in rounds of at most ``ROUND_BYTES`` bytes of text, so what is sent to the executors is
    bounded.  Of several rounds each is a job of its own, which writes what it finds, so a worker holds the tables of one
    round at a time; the documents are written once, numbered, and meet their findings in the end.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(item_text).alias("text")).where("name is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = max(1, -(-size // ROUND_BYTES))
    names = keep if keep is not None else docs.columns
    carried = [c for c in names if c not in ("n_words", "hit_spans", "hit_items")]

    def searched(df: DataFrame, col: str, cols: list[str], k: int) -> DataFrame:
        part = items if rounds == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(rounds)) == k)
        shared = spark.sparkContext.broadcast([(r.name, r.text) for r in part.select("name", "text").toLocalIterator()])
        return map_texts(df, col, cols, _FIELDS, _search(shared, window, uuid.uuid4().hex))

    if rounds == 1:
        return searched(docs, text_col, carried, 0).select(*carried, "n_words", "hit_spans", F.array_sort("hit_items").alias("hit_items"))
    work = Scratch(spark, "rounds")
    row = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.lit(0)
    base = work.save(docs.select(F.monotonically_increasing_id().alias("at"), row.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text")), "documents")
    found = []
    for k in range(rounds):
        part = searched(base.select("at", "text"), "text", ["at"], k)
        found.append(work.save(part if k == 0 else part.where(F.size("hit_spans") > 0), f"found-{k}"))
    counts = found[0].select("at", "n_words")
    hits = reduce(DataFrame.unionAll, [f.where(F.size("hit_spans") > 0).select("at", "hit_spans", "hit_items") for f in found])
    # a list for each round at most
    hits = hits.groupBy("at").agg(F.flatten(F.collect_list("hit_spans")).alias("spans"), F.flatten(F.collect_list("hit_items")).alias("items"))
    out = base.select("at", "row").join(counts, "at").join(hits, "at", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in carried], "n_words", none(_united(F.col("spans")), _SPAN).alias("hit_spans"),
        none(F.array_sort(F.array_distinct("items")), "array<string>").alias("hit_items"),
    )


def n_hit() -> F.Column:
    """Hit words of a row of ``decontaminate``."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))


def _united(spans):
    """Overlapping and touching spans as one."""
    empty = F.array().cast(_SPAN)

    def add(done, s):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, add)


#: The searcher that this worker has made last, by its name.
_made: dict[str, Searcher] = {}


def _search(shared, window: int, name: str):
    def run(col: pa.Array) -> list[pa.Array]:
        if name not in _made:
            _made.clear()
            _made[name] = Searcher(shared.value, window)
        searcher = _made[name]
        counts = np.zeros(len(col), np.int64)
        n_spans = np.zeros(len(col) + 1, np.int64)
        n_items = np.zeros(len(col) + 1, np.int64)
        at, to, names = [], [], []
        for lo, hi, data, bounds in blocks(col):
            low = LOWER[data]
            starts, ends, per = word_spans(low, bounds, ALNUM)
            counts[lo:hi] = np.diff(per)
            hit, texts, items = searcher.find(low, starts, ends, per)
            if not len(items):
                continue
            first, last = hit.copy(), hit.copy()
            first[1:] &= ~hit[:-1]
            last[:-1] &= ~hit[1:]
            head = per[:-1][per[:-1] < len(hit)]
            first[head] = hit[head]
            tail = per[1:][per[1:] > 0] - 1
            last[tail] = hit[tail]
            first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
            text = np.searchsorted(per, first, side="right") - 1
            np.add.at(n_spans, lo + text + 1, 1)
            at.append(first - per[text])
            to.append(last - per[text])
            np.add.at(n_items, lo + texts + 1, 1)
            names += [searcher.names[k] for k in items.tolist()]
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32)) for x in (at, to)], fields=list(_ARROW_SPAN))
        spans = pa.ListArray.from_arrays(pa.array(np.cumsum(n_spans), pa.int32()), flat)
        return [pa.array(counts), spans, pa.ListArray.from_arrays(pa.array(np.cumsum(n_items), pa.int32()), pa.array(names, pa.string()))]

    return run
