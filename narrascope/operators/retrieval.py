"""Retrieval metrics over scored pairs ``(q, c, sim)`` with a relevance column ``rel``.

Candidates are ranked by similarity, ties by the smaller candidate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(pairs: DataFrame) -> DataFrame:
    """With the candidate's ``rank`` from 1, the relevant ones seen so far (``hits``) and the query's number of them (``r``)."""
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "c")
    rel = F.col("rel").cast("int")
    return pairs.select(
        "q", "c", "sim", rel.alias("rel"), F.row_number().over(order).alias("rank"),
        F.sum(rel).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("hits"), F.sum(rel).over(Window.partitionBy("q")).alias("r"),
    )


def per_query(rows: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row for each query with a relevant candidate: ap, ndcg, r_precision, first_hit and p_at_k."""
    rel = F.col("rel")
    gain = rel / F.log2(F.col("rank") + F.lit(1.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.first("r").cast("int")), F.lit(0.0), lambda s, k: s + 1 / F.log2(k + F.lit(1.0)))
    out = rows.where("r > 0").groupBy("q").agg(
        (F.sum(F.when(rel == 1, F.col("hits") / F.col("rank")).otherwise(0.0)) / F.first("r")).alias("ap"),
        (F.sum(gain) / ideal).alias("ndcg"),
        (F.sum(F.when(F.col("rank") <= F.col("r"), rel).otherwise(0)) / F.first("r")).alias("r_precision"),
        F.min(F.when(rel == 1, F.col("rank"))).alias("first_hit"), F.first("r").alias("r"),
        *[(F.sum(F.when(F.col("rank") <= k, rel).otherwise(0)) / F.lit(float(k))).alias(f"p_at_{k}") for k in ks],
    )
    return out


def per_query_ranks(rows: DataFrame, ks: tuple[int, ...] = (1, 5, 10), strict: bool = False) -> DataFrame:
    """The same from ``(q, ranks)``, the ascending ranks of each query's relevant candidates (``vectors.relevant_ranks``).

    Queries without one are left out; with ``strict`` they are an error, as mean average precision isn't defined for them.
    """
    r, ranks = F.size("ranks"), F.col("ranks")
    if strict:
        ranks = F.when(F.coalesce(r, F.lit(0)) > 0, ranks).otherwise(F.raise_error(F.concat(F.lit("no relevant candidate for query "), F.col("q").cast("string"))))
        rows = rows.withColumn("ranks", ranks)
    else:
        rows = rows.where(r > 0)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    gain = total(F.transform("ranks", lambda x: 1 / F.log2(x + F.lit(1.0))))
    ideal = total(F.transform(F.sequence(F.lit(1), r), lambda k: 1 / F.log2(k + F.lit(1.0))))
    upto = lambda k: F.size(F.filter("ranks", lambda x: x <= k))
    return rows.select(
        "q", (total(F.transform("ranks", lambda x, i: (i + 1) / x)) / r).alias("ap"), (gain / ideal).alias("ndcg"), (upto(r) / r).alias("r_precision"),
        F.get("ranks", F.lit(0)).cast("int").alias("first_hit"), r.cast("long").alias("r"), *[(upto(F.lit(k)) / F.lit(float(k))).alias(f"p_at_{k}") for k in ks],
    )


def members_only(rows: DataFrame, members: DataFrame, query: str = "q", member: str = "id") -> DataFrame:
    """The rows of queries that are members, as of a test set; candidates stay as they are."""
    return rows.join(members.select(F.col(member).alias(query)).distinct(), query, "left_semi")


def mean_metrics(queries: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Means over queries: map, ndcg, r_precision, hits_at_1 and p_at_k."""
    return queries.agg(
        F.avg("ap").alias("map"), F.avg("ndcg").alias("ndcg"), F.avg("r_precision").alias("r_precision"),
        F.avg((F.col("first_hit") == 1).cast("double")).alias("hits_at_1"), *[F.avg(f"p_at_{k}").alias(f"p_at_{k}") for k in ks], F.count("*").alias("n"),
    )


def precision_at_own_size(rows: DataFrame) -> DataFrame:
    """``(k, p_at_n, n)``: precision at k over the queries with exactly k relevant candidates."""
    per = rows.where("r > 0").groupBy("q", F.col("r").alias("k")).agg((F.sum(F.when(F.col("rank") <= F.col("r"), F.col("rel")).otherwise(0)) / F.col("r")).alias("p"))
    return per.groupBy("k").agg(F.avg("p").alias("p_at_n"), F.count("*").alias("n"))


def recall_and_median_rank(rows: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Share of queries (percent) with a relevant candidate among the first k, and the median rank: floor of the median of ranks from 0, plus 1."""
    return recall_of_first(rows.groupBy("q").agg(F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first")), ks)


def recall_of_first(rows: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """The same from each query's rank of its ``first`` relevant candidate; null ranks are left out."""
    first = rows.where("first is not null").select((F.col("first") - 1).alias("f"))
    return first.agg(
        *[(100 * F.avg((F.col("f") < k).cast("double"))).alias(f"recall_at_{k}") for k in ks],
        (F.floor(F.percentile("f", F.lit(0.5))) + 1).cast("long").alias("median_rank"), F.count("*").alias("n"),
    )


def nearest_label(pairs: DataFrame, zero_self: bool = False) -> DataFrame:
    """``(q, c, sim, rel)`` of each query's nearest candidate; with ``zero_self`` the query itself stands in with similarity 0."""
    if zero_self:
        own = pairs.select("q").distinct().select("q", F.col("q").alias("c"), F.lit(0.0).alias("sim"), F.lit(True).alias("rel"))
        pairs = pairs.select("q", "c", "sim", F.col("rel").cast("boolean").alias("rel")).unionByName(own)
    best = F.max_by(F.struct("c", "sim", "rel"), F.struct(F.col("sim"), -F.col("c")))
    return pairs.groupBy("q").agg(best.alias("b")).select("q", "b.c", "b.sim", "b.rel")


def silhouette(distances: DataFrame) -> DataFrame:
    """Mean silhouette from ``(q, c, dist, q_label, c_label)`` pairs without self pairs; a singleton cluster's member counts 0."""
    return mean_silhouette(distances.groupBy("q", "q_label", "c_label").agg(F.avg("dist").alias("m")))


def mean_silhouette(mean: DataFrame) -> DataFrame:
    """The same from each query's mean distance ``m`` to each label."""
    per = mean.groupBy("q").agg(F.max(F.when(F.col("q_label") == F.col("c_label"), F.col("m"))).alias("a"), F.min(F.when(F.col("q_label") != F.col("c_label"), F.col("m"))).alias("b"))
    s = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.agg(F.avg(s).alias("silhouette"), F.count("*").alias("n"))
