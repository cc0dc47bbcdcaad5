"""Corpora: vocabularies, tf-idf, sequences, clusters, dedup, splits and draws."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope.operators.ordering import numbered, numbered_within
from narrascope.session import Scratch, share_code


def vocabulary(tokens: DataFrame, token: str, least: int = 1, specials: tuple[str, ...] = ()) -> DataFrame:
    """``(token, count, token_id)``: special tokens first, then tokens by falling count, ties by the token.
    """
    counts = tokens.groupBy(F.col(token).alias("token")).agg(F.count("*").alias("count")).where(F.col("count") >= least)
    out = numbered(counts, [F.desc("count"), "token"], "place").select("token", "count", (F.col("place") - 1 + len(specials)).cast("long").alias("token_id"))
    if not specials:
        return out
    fixed = tokens.sparkSession.createDataFrame([(t, 0, k) for k, t in enumerate(specials)], "token string, count long, token_id long")
    return fixed.unionByName(out)


def tf_idf(tokens: DataFrame, doc: str, token: str) -> DataFrame:
    """``(doc, token, weight)``: counts times ln((1 + N) / (1 + df)) + 1, scaled to length 1 for each document."""
    tf = tokens.groupBy(doc, token).agg(F.count("*").alias("tf"))
    df = tf.groupBy(token).agg(F.count("*").alias("df"))
    n = tokens.select(doc).distinct().agg(F.count("*").alias("n"))
    raw = tf.join(df, token).crossJoin(F.broadcast(n)).select(doc, token, (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    size = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return raw.join(size, doc).select(doc, token, (F.col("w") / F.col("size")).alias("weight"))


#: Bytes of word vectors that are sent to all tasks; more are joined.
MATRIX_BYTES = 64 << 20


def mean_vectors(tokens: DataFrame, vectors: DataFrame, doc: str, token: str, dim: int) -> DataFrame:
    """Mean vector of each document's known tokens; zeros without any.

    Words are counted once; documents gather the numbers of those that are known. Their sums are products with the matrix of vectors, if that is at
    most ``MATRIX_BYTES``, else sums over joined vectors.
    """
    counts = tokens.groupBy(doc, token).agg(F.count("*").alias("c"))
    held = Scratch(tokens.sparkSession, "means").save(vectors.select(F.col("word").alias(token), F.col("vec").cast("array<double>").alias("vec"), F.monotonically_increasing_id().alias("at")), "vectors")
    if held.count() * dim * 8 <= MATRIX_BYTES:
        known = counts.join(held.select(token, "at"), token, "left")
        rows = _matrix_means(known.groupBy(doc).agg(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "c"))).alias("w")), held, doc, dim)  # one text's words
    else:
        # a sum for each component, so that no row is made for every component of every word
        sums = counts.join(held, token, "left").groupBy(doc).agg(F.sum(F.when(F.col("at").isNotNull(), F.col("c"))).alias("__n"), *[F.sum(F.col("c") * F.get("vec", F.lit(i))).alias(f"__{i}") for i in range(dim)])
        rows = sums.select(doc, F.when(F.col("__n").isNotNull(), F.array(*[F.col(f"__{i}") / F.col("__n") for i in range(dim)])).alias("vec"))
    # tokens without a document have no vector, either
    return rows.select(doc, F.coalesce(F.when(F.col(doc).isNotNull(), F.col("vec")), F.array_repeat(F.lit(0.0), dim)).alias("vec"))


def _matrix_means(words: DataFrame, held: DataFrame, doc: str, dim: int) -> DataFrame:
    spark = words.sparkSession
    share_code(spark)
    found = held.select("at", "vec").toPandas().sort_values("at")
    matrix = np.stack(found["vec"].to_numpy()).astype(float) if len(found) else np.zeros((0, dim))
    shared = spark.sparkContext.broadcast((found["at"].to_numpy(np.int64), matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, matrix = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            flat = lists.flatten()
            places = np.searchsorted(at, flat.field("at").to_numpy())
            c = flat.field("c").to_numpy()
            first = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            out = np.empty((batch.num_rows, dim))
            for k in range(batch.num_rows):
                own = slice(first[k], first[k + 1])
                out[k] = c[own] @ matrix[places[own]] / max(1, c[own].sum())
            bounds = pa.array(np.arange(0, batch.num_rows + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(bounds, pa.array(out.ravel()))], [doc, "vec"])

    return words.mapInArrow(run, f"`{doc}` {words.schema[doc].dataType.simpleString()}, vec array<double>")


def best_match(pairs: DataFrame) -> DataFrame:
    """``(a_doc, b_doc, precision, recall, f1)`` from ``(a_doc, a_pos, b_doc, b_pos, sim)``: the best partner of every sentence on either side, averaged."""
    a = pairs.groupBy("a_doc", "b_doc", "a_pos").agg(F.max("sim").alias("m")).groupBy("a_doc", "b_doc").agg(F.avg("m").alias("precision"))
    b = pairs.groupBy("a_doc", "b_doc", "b_pos").agg(F.max("sim").alias("m")).groupBy("a_doc", "b_doc").agg(F.avg("m").alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return a.join(b, ["a_doc", "b_doc"]).withColumn("f1", f1)


def ordered_text(df: DataFrame, by: list[str], order: str, value: str, joiner: str, out: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(*by).agg(F.array_join(F.transform(rows, lambda s: s[value]), joiner).alias(out))


def runs(df: DataFrame, by: list[str], order: str, key: str) -> DataFrame:
    """Rows with ``run``: the number, from 1, of the stretch of equal keys that they stand in."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return df.withColumn("__change", change).withColumn("run", F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__change")


def adjacent_pairs(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Each member with the next one, the last with the one before; a single member with itself."""
    w = Window.partitionBy(by).orderBy(order)
    return df.select(by, F.col(value).alias("a"), F.coalesce(F.lead(value).over(w), F.lag(value).over(w), F.col(value)).alias("b"))


def cluster_pairs(df: DataFrame, by: str, value: str) -> DataFrame:
    """All unordered pairs of a cluster's members; the result is their number by definition, so clusters must be small."""
    a, b = df.select(by, F.col(value).alias("a")), df.select(by, F.col(value).alias("b"))
    return a.join(b, by).where(F.col("a") < F.col("b"))


def keep_first(items: DataFrame, pairs: DataFrame, most: float = 0.6) -> DataFrame:
    """Items whose similarity to every better one (by ``rank``) of their group is at most ``most``.

    ``pairs`` is (group, a, b, sim) with a ranked before b; every better item counts, kept or not.
    """
    worst = pairs.groupBy("group", F.col("b").alias("item")).agg(F.max("sim").alias("sim"))
    return items.join(worst, ["group", "item"], "left").where(F.coalesce("sim", F.lit(0.0)) <= most).drop("sim")


def inverse_cdf(weights: DataFrame, by: str, item: str, weight: str, draws: DataFrame) -> DataFrame:
    """For every draw ``(by, draw, u)`` with u in 0..1 the first item whose cumulated share reaches u."""
    w = Window.partitionBy(by).orderBy(item)
    sums = weights.select(by, item, F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum(weight).over(Window.partitionBy(by)).alias("total"))
    hit = draws.join(sums, by).where(F.col("upto") / F.col("total") >= F.col("u"))
    return hit.groupBy(by, "draw", "u").agg(F.min_by(item, "upto").alias(item))


def bucket(key: Column, n: int, seed: int = 42) -> Column:
    """A number below n by the hash of a key: the first 32 bits of an MD5, which every engine has."""
    digest = F.md5(F.encode(F.concat_ws(":", key.cast("string"), F.lit(str(seed))), "UTF-8"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(n)


def split_column(key: Column, train: int = 80, dev: int = 10, forced_test: Column | None = None, seed: int = 42) -> Column:
    """train, dev or test by the hash of a key; rows of ``forced_test`` are test."""
    b = bucket(key, 100, seed)
    split = F.when(b < train, "train").when(b < train + dev, "dev").otherwise("test")
    return split if forced_test is None else F.when(forced_test, "test").otherwise(split)


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """With ``fold``: the rows of each label in hash order are dealt round."""
    placed = numbered_within(df.withColumn("__hash", bucket(F.col(key), 1 << 30, seed)), [label], ["__hash", key], "__r")
    return placed.withColumn("fold", F.pmod(F.col("__r") - 1, F.lit(k)).cast("long")).drop("__hash", "__r")


def quota(df: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def negative_pairs(stories: DataFrame, key: str, text: str, seed: int = 42) -> DataFrame:
    """Each story's text with that of the next one in hash order: two different stories as a negative pair.

    Only keys are numbered; texts are met last, so none is sorted.
    """
    placed = numbered(stories.select(key, bucket(F.col(key), 1 << 30, seed).alias("__hash")), ["__hash", key], "__n")
    near = placed.select(F.col(key).alias("a_id"), "__n").join(placed.select(F.col(key).alias("b_id"), (F.col("__n") - 1).alias("__n")), "__n")
    side = lambda x: stories.select(F.col(key).alias(f"{x}_id"), F.col(text).alias(f"text_{x}"))
    return near.join(side("a"), "a_id").join(side("b"), "b_id").select("a_id", "text_a", "b_id", "text_b", F.lit(-1).alias("label"))


def interleaved(a: DataFrame, b: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Both frames with ``at`` in 0..1: each one's rows, in hash order, spread evenly, so any stretch holds them in proportion."""
    parts = []
    for side, df in enumerate((a, b)):
        placed = numbered(df.withColumn("__hash", bucket(F.col(key), 1 << 30, seed)), ["__hash", key], "__r")
        at = (F.col("__r") - 0.5) / F.lit(float(max(1, df.count())))
        parts.append(placed.withColumn("side", F.lit(side)).withColumn("at", at).drop("__hash", "__r"))
    return parts[0].unionByName(parts[1])


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't finished yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def upsert_maps(rows: DataFrame, more: DataFrame, key: str, column: str) -> DataFrame:
    """The map column with the other frame's entries put in; those win."""
    extra = more.select(key, F.col(column).alias("__more"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    old, new = F.coalesce(F.col(column), none), F.coalesce(F.col("__more"), none)
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
    return rows.join(extra, key, "left").withColumn(column, merged).drop("__more")
