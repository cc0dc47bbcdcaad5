"""Quality classifier from supervised subword embeddings.

A document is the average of learned vectors of its hashed features: its words, pairs of adjacent words (all pairs of
equal words share one bucket), and the character n-grams of its words, each word between boundary marks, lower-cased.
Each of these three kinds has the same weight.  A softmax layer turns the average into class probabilities.  Vectors
and layer are trained together by stochastic gradient descent in numpy, on at most ``SAMPLE`` labelled documents with
at most ``SAMPLE_BYTES`` bytes of text, drawn by the hash of their ids.  As the score of an average is the average of
its features' scores, a trained model is applied as one number for each bucket: scoring reads a text once and looks its
features up.  These numbers have a fixed point and are summed as integers, so a text's score depends on nothing but
the text and the model.

Defined cases: null and empty texts, and those of white space, have no features and get the score of the layer's bias
alone; rows without a label of 0 or 1 or without an id are not learned from; rows that repeat an id are rows of their
own; a labelled text that doesn't fit in what is left of ``SAMPLE_BYTES`` is not learned from; without any labelled row
the model is untrained and every score is near 0.5, that of a text without features 0.5; an empty table gives an empty
result; a column named like a new one is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrascope.llm.rows import map_texts
from narrascope.llm.textbatch import LOWER, SPACED, U, blocks, codepoints, mix, span_hashes, word_spans
from narrascope.session import Scratch

#: Labelled documents that the model is fitted on, at most, and bytes of their texts.
SAMPLE = 3000
SAMPLE_BYTES = 32 << 20
BITS = 18
GRAMS = (3, 4)
#: The bucket of a word that repeats the one before it: texts of repeated words have no n-grams in common with others.
_AGAIN = U(1)
DIM = 12
EPOCHS = 6
RATE = 0.4
THRESHOLD = 0.3
#: Binary places of a bucket's number behind the point.
PLACES = 26


def _grams(chars: np.ndarray, marks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, buckets) of the runs of n characters that have no mark but at their ends."""
    m = len(chars) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(marks)])
    at = np.flatnonzero(before[n - 1 : n - 1 + m] == before[1 : 1 + m])
    h = np.full(len(at), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for j in range(n):
        h = (h + chars[at + j]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    return at, (h >> np.uint32(32 - BITS)).astype(np.int64)


def features(low: np.ndarray, bounds: np.ndarray):
    """Words, word pairs and character n-grams, each as a list of ``(buckets, first, last)``, the latter bounding each text's buckets."""
    starts, ends, per = word_spans(low, bounds, SPACED)
    h = mix(span_hashes(low, starts, ends) + U(9))
    yield [((h >> U(64 - BITS)).astype(np.int64), per[:-1], per[1:])]
    pairs = np.where(h[1:] == h[:-1], _AGAIN, mix(h[1:] + h[:-1] * U(3)) >> U(64 - BITS)).astype(np.int64)
    first = np.minimum(per[:-1], len(pairs))
    yield [(pairs, first, np.maximum(per[1:] - 1, first))]
    # the words' characters with a mark before each word and one at the end
    c, at = codepoints(low)
    inside = SPACED[low[at]]
    c, at = c[inside], at[inside]
    place = np.append(np.searchsorted(at, starts), len(c)) + np.arange(len(starts) + 1)
    chars, marks = np.zeros(len(c) + len(place), np.uint32), np.zeros(len(c) + len(place), bool)
    marks[place] = True
    chars[~marks] = c
    grams = []
    for n in GRAMS:
        start, buckets = _grams(chars, marks, n)
        cut = np.searchsorted(start, place[per])
        grams.append((buckets, cut[:-1], cut[1:]))
    yield grams


@dataclass
class Model:
    """One number for each bucket, in units of 2^-``PLACES``, and the bias; positive values speak for label 1."""

    table: np.ndarray
    bias: float

    def scores(self, col: pa.Array) -> np.ndarray:
        out = np.zeros(len(col))
        for lo, hi, data, bounds in blocks(col):
            mean, kinds = np.zeros(hi - lo), np.zeros(hi - lo)
            for kind in features(LOWER[data], bounds):
                total, count = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                for buckets, a, b in kind:
                    sums = np.concatenate([[0], np.cumsum(self.table[buckets])])
                    total += sums[b] - sums[a]
                    count += b - a
                mean += total / np.maximum(count, 1)
                kinds += count > 0
            mean /= np.maximum(kinds, 1)
            out[lo:hi] = [1 / (1 + math.exp(-m / (1 << PLACES) - self.bias)) for m in mean.tolist()]
        return out


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """Train on labelled texts; the same rows in the same order give the same model."""
    rng = np.random.default_rng(7)
    e = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM))
    w = rng.normal(0, 0.1, (2, DIM))
    bias = np.zeros(2)
    docs = []
    for x, y in zip(texts, labels):
        low = LOWER[np.frombuffer((x or "").encode(), np.uint8)]
        kinds = [np.concatenate([f[a[0] : b[0]] for f, a, b in kind]) for kind in features(low, np.array([0, len(low)]))]
        kinds = [f for f in kinds if len(f)]
        ids, at = np.unique(np.concatenate([*kinds, np.zeros(0, np.int64)]), return_inverse=True)
        share = np.bincount(at, np.concatenate([*(np.full(len(f), 1 / len(f) / len(kinds)) for f in kinds), np.zeros(0)]), len(ids))
        docs.append((ids.astype(np.int32), share.astype(np.float32), int(y)))
    steps, done = max(1, EPOCHS * len(docs)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(docs)):
            ids, share, y = docs[k]
            rate = RATE * (1 - done / steps)
            done += 1
            rows = e[ids]
            z = share @ rows
            p = w @ z + bias
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ w
            w -= rate * np.outer(p, z)
            bias -= rate * 0.1 * p
            # features that stand in few places of a text still move: their share is scaled up to the text's size
            e[ids] = rows - (rate * len(ids) / 8) * np.outer(share, back)
    way = w[1] - w[0]
    table = np.clip(e @ way, -100, 100)  # far beyond what decides a score
    return Model(np.rint(table * (1 << PLACES)).astype(np.int64), float(np.clip(bias[1] - bias[0], -100, 100)))


def held_out(id_col: str) -> F.Column:
    """Whether a row is kept from learning; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES
) -> Model:
    """Fit on at most ``sample`` rows and ``sample_bytes`` bytes that are not held out, taken in the order of their ids' hash."""
    work = Scratch(docs.sparkSession, "quality")
    drawn = (
        labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
        .orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # of a text only its hash and size come to the driver before the rows are chosen
    found = work.save(texts.join(F.broadcast(drawn), "id"), "labelled").withColumns({"o": F.xxhash64("id"), "h": F.sha2("text", 256)})
    sizes = found.select("o", "id", "y", "h", F.octet_length("text").alias("n")).orderBy("o", "id", "y", "h").limit(sample).collect()
    chosen, left = [], sample_bytes
    for r in sizes:
        if r.n <= left:
            chosen.append(r)
            left -= r.n
    wanted = {}
    for r in found.where(F.col("h").isin([r.h for r in chosen])).select("h", "text").distinct().collect() if chosen else []:
        wanted[r.h] = r.text
    work.drop("labelled")
    return fit([wanted[r.h] for r in chosen], [r.y for r in chosen])


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``score`` (0 to 1) and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))

    def run(col):
        s = Model(*shared.value).scores(col)
        return [pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]

    return map_texts(docs, text_col, keep, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], run)
