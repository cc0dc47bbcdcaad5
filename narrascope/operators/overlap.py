"""Lexical overlap of anchor and candidate texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.functions import similarity, text
from narrascope.operators.word_blocks import best_by_words
from narrascope.session import bound_batches

METRICS = ("jaccard", "anchor_overlap", "candidate_overlap", "2gram_jaccard", "3gram_jaccard", "rouge_1_f1", "rouge_2_f1", "pos_overlap")


def to_pairs(triplets: DataFrame, keys: list[str]) -> DataFrame:
    """Two rows of each triplet ``(anchor_text, closer, farther)``: pair ``pos`` and pair ``neg``."""
    rows = F.inline(F.array(F.struct(F.lit("pos").alias("pair"), F.col("closer").alias("candidate")), F.struct(F.lit("neg").alias("pair"), F.col("farther").alias("candidate"))))
    return triplets.select(*keys, F.col("anchor_text").alias("anchor"), rows)


#: Of the n-grams of two texts for n of 1 to 3: the different ones of each, of both, all of each, and those shared as multisets.
COUNTS = [f"{what}{n}" for n in (1, 2, 3) for what in ("a", "b", "ab", "all_a", "all_b", "common")]


def gram_counts(a: list[str], b: list[str]) -> list[int]:
    """``COUNTS`` of two lists of tokens."""
    out = []
    for n in (1, 2, 3):
        x, y = (Counter(t if n == 1 else zip(*(t[k:] for k in range(n)))) for t in (a, b))
        both = x.keys() & y.keys()
        out += [len(x), len(y), len(both), x.total(), y.total(), sum(min(x[g], y[g]) for g in both)]
    return out


def counted(a: Column, b: Column) -> Column:
    """``COUNTS`` of the tokens of each row's two texts, which never leave their row."""

    @F.arrow_udf("struct<" + ",".join(f"{c}:long" for c in COUNTS) + ">")
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in parts:
            rows = [gram_counts(x.as_py().split(), y.as_py().split()) for x, y in zip(left, right)]
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(COUNTS), COUNTS)

    return run(F.array_join(a, " "), F.array_join(b, " "))


def rouge(pairs: DataFrame, keys: list[str], sizes: tuple[int, ...] = (1, 2), a: str = "a_tokens", b: str = "b_tokens") -> DataFrame:
    """``keys`` and ``rouge_<n>_f1`` for each n: F1 of n-grams counted as a multiset, 0 if nothing is shared.

    Pairs with equal keys count as one.  They are dealt by their keys once, with the n-grams of all sizes; counting and summing
    up then needs no further exchange.
    """

    def side(column: str, number: int, n: int):
        return F.transform(text.ngrams(F.col(column), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"), F.lit(number).alias("side")))

    both = F.concat(*[side(c, number, n) for n in sizes for number, c in enumerate((a, b))])
    grams = pairs.repartition(*keys).select(*keys, F.explode(both).alias("x"))
    counts = grams.groupBy(*keys, "x.n", "x.g").agg(F.count_if(F.col("x.side") == 0).alias("ca"), F.count_if(F.col("x.side") == 1).alias("cb"))

    def f1(n: int):
        own = F.col("n") == n
        return F.coalesce(F.try_divide(2.0 * F.sum(F.when(own, F.least("ca", "cb"))), F.sum(F.when(own, F.col("ca") + F.col("cb")))), F.lit(0.0)).alias(f"rouge_{n}_f1")

    return counts.groupBy(*keys).agg(*[f1(n) for n in sizes])


def pair_metrics(pairs: DataFrame, keys: list[str], lemmas: Callable[[Column], Column] | None = None, unique: bool | None = None) -> DataFrame:
    """``keys`` and the eight overlap metrics of (anchor, candidate) pairs.

    The n-grams of a pair are counted in its row.  Only if keys repeat, ROUGE counts the pairs with equal keys as one, and their
    n-grams are exchanged; ``unique`` tells whether they don't, else this is looked up.  ``lemmas`` is a tagger's hook: the
    content lemmas of a text as an array; ``pos_overlap`` is their Jaccard similarity, and 0 where no tagger is plugged in.
    """
    spark = pairs.sparkSession
    bound_batches(spark)
    if unique is None:
        unique = unrepeated(pairs, keys)
    pos = F.lit(0.0) if lemmas is None else similarity.set_jaccard(F.array_distinct(lemmas(F.col("anchor"))), F.array_distinct(lemmas(F.col("candidate"))))
    tokens = pairs.select(*keys, text.ascii_words(F.col("anchor")).alias("a_tokens"), text.ascii_words(F.col("candidate")).alias("b_tokens"), pos.alias("pos_overlap"))
    n = lambda c: F.col(f"c.{c}")
    made = [
        similarity.share(n("ab1"), n("a1") + n("b1") - n("ab1")).alias("jaccard"), similarity.share(n("ab1"), n("a1")).alias("anchor_overlap"), similarity.share(n("ab1"), n("b1")).alias("candidate_overlap"),
        *[similarity.share(n(f"ab{k}"), n(f"a{k}") + n(f"b{k}") - n(f"ab{k}")).alias(f"{k}gram_jaccard") for k in (2, 3)],
        *[similarity.share(2 * n(f"common{k}"), n(f"all_a{k}") + n(f"all_b{k}")).alias(f"rouge_{k}_f1") for k in (1, 2)],
    ]
    found = tokens.select(*keys, "pos_overlap", counted(F.col("a_tokens"), F.col("b_tokens")).alias("c")).select(*keys, *made, "pos_overlap")
    if unique:
        return found
    merged = found.drop("rouge_1_f1", "rouge_2_f1").join(rouge(tokens, keys), keys, "left")
    return merged.select(*keys, *METRICS[:5], *[F.coalesce(f"rouge_{k}_f1", F.lit(0.0)).alias(f"rouge_{k}_f1") for k in (1, 2)], "pos_overlap")


def unrepeated(rows: DataFrame, keys: list[str]) -> bool:
    """No two rows agree in their keys, and none of these is null."""
    known = F.lit(True)
    for c in keys:
        known &= F.col(c).isNotNull()
    return rows.groupBy(*keys).count().where((F.col("count") > 1) | ~known).isEmpty()


def melted(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each metric."""
    return metrics.unpivot(keys, list(METRICS), "metric", "value")


def hard_negatives(anchors: DataFrame, hypotheses: DataFrame, on: str, bonus: float = 0.05) -> DataFrame:
    """The hypothesis of each anchor with the highest word Jaccard among those with the same value of ``on``.

    ``anchors`` has (anchor_id, anchor, on), ``hypotheses`` (pos, hypothesis, label, on).  Contradictions, in any case,
    get a bonus, empty hypotheses are skipped, and of equals the first by ``pos``, a whole number, wins.  Words of different
    values of ``on`` are different words, so texts meet in blocks (``word_blocks``) and no pair leaves them; of hypotheses
    that share no word only the first contradiction and the first of a value of ``on`` can win, and these two stand in for all.
    """
    words = lambda c: F.transform(F.array_distinct(text.ascii_words(F.col(c))), lambda w: F.struct(F.col(on), w))
    kept = hypotheses.where(F.coalesce("hypothesis", F.lit("")) != "")
    extra = F.when(F.lower("label") == "contradiction", bonus).otherwise(0.0)
    near = best_by_words(anchors.select(F.col("anchor_id").alias("id"), words("anchor").alias("words")), kept.select(F.col("pos").alias("id"), words("hypothesis").alias("words"), extra.alias("extra")))
    firsts = kept.groupBy(on, extra.alias("score")).agg(F.min("pos").alias("pos"))
    scored = near.select(F.col("q").alias("anchor_id"), F.col("c").alias("pos"), "score").unionByName(anchors.select("anchor_id", on).join(firsts, on).select("anchor_id", "pos", "score"))
    best = scored.groupBy("anchor_id").agg(F.max_by(F.struct("pos", "score"), F.struct(F.col("score"), -F.col("pos"))).alias("b"))
    found = best.select("anchor_id", "b.*").join(kept.select("pos", "hypothesis", "label"), "pos")
    return found.select("anchor_id", "pos", "hypothesis", "label", "score")
