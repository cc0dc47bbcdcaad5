"""Labelled triplets: normalising, flipping, filtering and reshaping.

A triplet has ``anchor_text``, ``text_a``, ``text_b`` and the label ``text_a_is_closer``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.functions.text import file_stem

from narrascope.functions.text import strip as stripped
from narrascope.operators.corpus import bucket

TEXTS = ("anchor_text", "text_a", "text_b")
LABEL = "text_a_is_closer"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The frame itself; an error at analysis time if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def texts_only(df: DataFrame) -> DataFrame:
    return require_columns(df, *TEXTS).select(*TEXTS)


def as_training(df: DataFrame) -> DataFrame:
    """Renamed to ``sent0, sent1, hard_neg`` in the given order; rows without an anchor are dropped."""
    kept = df.where(F.coalesce(F.col("anchor_text"), F.lit("")) != "")
    return kept.select(F.col("anchor_text").alias("sent0"), F.col("text_a").alias("sent1"), F.col("text_b").alias("hard_neg"))


def normalised(df: DataFrame, closer_is_a: Column) -> DataFrame:
    """``(sent0, sent1, hard_neg)``: the anchor, the closer text, the farther one; rows without an anchor are dropped."""
    kept = df.where(F.coalesce(F.col("anchor_text"), F.lit("")) != "")
    a, b = F.col("text_a"), F.col("text_b")
    return kept.select(F.col("anchor_text").alias("sent0"), F.when(closer_is_a, a).otherwise(b).alias("sent1"), F.when(closer_is_a, b).otherwise(a).alias("hard_neg"))


def label_says_a(label: Column) -> Column:
    """True only for the exact text ``True``, as Python spells it; missing and other labels say B."""
    return F.coalesce(label.cast("string") == "True", F.lit(False))


def flipped(df: DataFrame, key: Column, seed: int = 42) -> DataFrame:
    """Half of the rows, drawn by the hash of a key, with both texts swapped and the label turned over."""
    flip = bucket(key, 2, seed) == 1
    a, b, label = F.col("text_a"), F.col("text_b"), F.col(LABEL)
    return df.withColumns({"text_a": F.when(flip, b).otherwise(a), "text_b": F.when(flip, a).otherwise(b), LABEL: F.when(flip, ~label).otherwise(label)})


def expand5(df: DataFrame) -> DataFrame:
    """Five triplets of each augmented one: the texts, and prototypes in place of one, two or all of them.

    Fixed values: which of anchor, a and b are prototypes in each variant.
    """
    variants = [("t", "t", "t"), ("p", "p", "p"), ("p", "t", "t"), ("t", "p", "t"), ("t", "t", "p")]
    names = ("anchor", "text_a", "text_b")

    def col(name: str, kind: str) -> Column:
        return F.col(f"{name}_prototype") if kind == "p" else F.col("anchor_text" if name == "anchor" else name)

    rows = F.array(*[F.struct(F.lit(k).alias("variant"), *[col(n, x).alias("anchor_text" if n == "anchor" else n) for n, x in zip(names, v)]) for k, v in enumerate(variants)])
    return df.select(*[c for c in df.columns if c not in (*TEXTS, "anchor_prototype", "text_a_prototype", "text_b_prototype")], F.inline(rows))


def distinct_texts(df: DataFrame, strip: bool = True) -> DataFrame:
    """All different texts of the three columns."""
    one = F.explode(F.array(*TEXTS))
    out = df.select(one.alias("text")).where(F.col("text").isNotNull())
    return out.select(stripped(F.col("text")).alias("text")).distinct() if strip else out.distinct()


def choices_to_triplets(df: DataFrame, kinds: tuple[str, ...] = ("random", "noun")) -> DataFrame:
    """One row for each distractor of a multiple-choice example of the wanted kinds; examples that don't fit together are skipped."""
    fits = (F.size("choices") == F.size("types")) & (F.col("answer") >= 0) & (F.col("answer") < F.size("choices"))
    each = df.where(fits).select("ex_id", "source", F.get("choices", F.col("answer")).alias("text_a"), "answer", F.posexplode(F.arrays_zip("choices", "types")).alias("b_index", "other"))
    each = each.where((F.col("b_index") != F.col("answer")) & F.col("other.types").isin(*kinds))
    return each.select(
        F.col("source").alias("anchor_text"), "text_a", F.col("other.choices").alias("text_b"),
        F.lit(True).alias(LABEL), F.col("other.types").alias("type"), "ex_id", "b_index",
    )


def missing_anchors(df: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose anchor isn't among the finished ones; rows without an anchor stay."""
    return df.join(done.select("anchor_text").distinct(), "anchor_text", "left_anti")


def triplet_tokens(s0: Column, s1: Column, hard: Column) -> Column:
    """The three texts of a training row side by side, nulls as a single space."""
    return F.array(*[F.coalesce(c, F.lit(" ")) for c in (s0, s1, hard)])


def submission(rows: DataFrame, predicted: str, label: str = "text_a_is_closer", helpers: tuple[str, ...] = ()) -> DataFrame:
    """The columns as they were read, with the prediction in place of the label and without helper columns; null predictions speak for B."""
    gone = {predicted, *helpers} - {label}
    order = [c for c in rows.columns if c not in gone] + ([] if label in rows.columns else [label])
    return rows.withColumn(label, F.coalesce(F.col(predicted).cast("boolean"), F.lit(False))).select(*order)


#: Splits in the order in which they are looked for.
SPLITS = ("sample", "train", "dev", "test")


def source_tags(path: Column) -> tuple[Column, Column]:
    """(split, track) from a file's stem: a split at its beginning, between underscores or at its end; the rule for track b overrides that for a."""
    name = F.lower(file_stem(path))
    split = F.coalesce(*[F.when(name.startswith(s) | name.contains(f"_{s}_") | name.endswith(f"_{s}"), s) for s in SPLITS], F.lit("unknown"))
    is_track = lambda x: name.contains(f"track_{x}") | name.contains(f"track-{x}") | name.endswith(x)
    return split, F.when(is_track("b"), "track_b").when(is_track("a"), "track_a").otherwise("unknown")
