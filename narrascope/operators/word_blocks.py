"""Nearest rows by shared words, without a row for any pair.

Candidates are laid out as an inverted index of hashed words, in blocks of at most ``BLOCK_BYTES``, each of which is sent
to all tasks in a round of its own.  A task runs its queries through the index, adds up what each candidate shares
with a query in one array, and hands on the best one only.  So frequent words cost no shuffle and no candidate rows, and a
query leaves a row for each round.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.session import Scratch, share_code

#: Bytes of one block of candidates: 16 for each of their words.
BLOCK_BYTES = 64 << 20


class Index:
    """The candidates' words in order, and with each the candidates that hold it, by place in the order of their ids."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, words: np.ndarray, weights: np.ndarray | None, extra: np.ndarray):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        holder = np.repeat(place, sizes)
        self.ids, self.sizes, self.extra = ids[order], sizes[order], extra[order]
        by = np.argsort(words, kind="stable")
        words, self.holder = words[by], holder[by]
        self.weights = None if weights is None else weights[by]
        head = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
        self.words, self.bounds = words[head], np.append(head, len(words))

    def shared(self, words: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """How many words each candidate shares with a query's distinct words, and the sum of the products of their weights."""
        at = np.searchsorted(self.words, words)
        known = at < len(self.words)
        known[known] = self.words[at[known]] == words[known]
        at = at[known]
        lo, n = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        rows = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        held = self.holder[rows]
        count = np.bincount(held, minlength=len(self.ids))
        if weights is None:
            return count, count.astype(float)
        return count, np.bincount(held, np.repeat(weights[known], n) * self.weights[rows], len(self.ids))


def _index(rows: list) -> Index:
    weighted = bool(rows) and rows[0].weights is not None
    flat = lambda name, kind: np.concatenate([np.asarray(r[name], kind) for r in rows]) if rows else np.zeros(0, kind)
    return Index(
        np.array([r.id for r in rows], np.int64), np.array([len(r.words) for r in rows], np.int64), flat("words", np.int64), flat("weights", float) if weighted else None,
        np.array([r.extra for r in rows], float),
    )


def best_by_words(queries: DataFrame, candidates: DataFrame, measure: str = "jaccard", digits: int | None = None, exclude_self: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(q, c, score)``: of the candidates that share a word with a query the one of the highest score, ties to the smaller id.

    Both have ``id`` (long) and ``words`` (distinct, of any type); candidates may have ``extra``, which is added to their
    scores.  ``jaccard`` is the share of common words; ``dot`` adds up the products of ``weights``, which stand beside the words.
    With ``digits`` scores are compared rounded.  Rows with null ids or words take no part.
    """
    spark = queries.sparkSession
    share_code(spark)
    work = Scratch(spark, "words")
    hashed = F.transform("words", lambda w: F.xxhash64(w)).alias("words")
    weights = lambda df: (F.col("weights").cast("array<double>") if measure == "dot" else F.lit(None).cast("array<double>")).alias("weights")
    extra = (F.col("extra").cast("double") if "extra" in candidates.columns else F.lit(0.0)).alias("extra")
    known = "id is not null and words is not null"
    left = work.save(queries.where(known).select(F.col("id").cast("long").alias("id"), hashed, weights(queries)), "queries")
    right = work.save(candidates.where(known).select(F.col("id").cast("long").alias("id"), hashed, weights(candidates), extra, F.size("words").alias("n")), "candidates")
    size = right.agg(F.sum(16 * F.col("n") + 64)).first()[0] or 0
    rounds = max(1, -(-size // block_bytes))

    def run(shared):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(shared.value)
            for batch in batches:
                words, values = batch.column(1), batch.column(2)
                out = []
                for k, q in enumerate(batch.column(0).to_pylist()):
                    own = words[k].values.to_numpy()
                    count, total = index.shared(own, values[k].values.to_numpy(zero_copy_only=False) if measure == "dot" else None)
                    score = (total if measure == "dot" else count / np.maximum(1, len(own) + index.sizes - count)) + index.extra
                    score[count == 0] = -np.inf
                    if exclude_self:
                        score[index.ids == q] = -np.inf
                    if len(score):
                        best = int(np.argmax(score if digits is None else np.round(score, digits)))
                        if score[best] > -np.inf:
                            out.append((q, int(index.ids[best]), float(score[best])))
                ids, found, scores = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.float64())], ["q", "c", "score"])

        return search

    parts = []
    for k in range(rounds):
        block = right if rounds == 1 else right.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == k)
        shared = spark.sparkContext.broadcast(list(block.select("id", "words", "weights", "extra").toLocalIterator()))  # about block_bytes
        parts.append(work.save(left.mapInArrow(run(shared), "q long, c long, score double"), f"best-{k}"))
        shared.destroy()
    if rounds == 1:
        return parts[0]
    compared = F.col("score") if digits is None else F.round("score", digits)
    best = reduce(DataFrame.unionAll, parts).groupBy("q").agg(F.max_by(F.struct("c", "score"), F.struct(compared, -F.col("c"))).alias("b"))
    return best.select("q", "b.c", "b.score")
