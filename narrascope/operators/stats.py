"""Descriptive statistics, label tables, correlations and classification reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope.operators.ordering import running_sum
from narrascope.session import Scratch


def exact_quantiles(df: DataFrame, by: list[str], value: Column, names: dict[str, float]) -> DataFrame:
    """``by`` and the named quantiles of each group, by linear interpolation between order statistics; nulls are left out.

    Distinct values are counted and their counts summed up in order by ``running_sum``, so no task holds a group.
    """
    counts = df.select(*by, value.alias("__x")).where("__x is not null").groupBy(*by, "__x").agg(F.count("*").alias("__c"))
    upto = running_sum(counts, [*by, "__x"], F.col("__c"), "__upto")
    ends = upto.groupBy(*by).agg(F.min(F.col("__upto") - F.col("__c")).alias("__base"), F.max("__upto").alias("__end"))
    keyed = ends.withColumnsRenamed({c: f"__by_{c}" for c in by})
    rows = upto.join(keyed, F.expr(" and ".join(f"`{c}` <=> `__by_{c}`" for c in by))) if by else upto.join(F.broadcast(ends))
    first, last = F.col("__upto") - F.col("__c") - F.col("__base"), F.col("__upto") - F.col("__base") - 1  # places of the value, from 0
    aggs = []
    for name, q in names.items():
        place = (F.col("__end") - F.col("__base") - 1) * F.lit(float(q))
        low, high = (F.max(F.when((first <= at) & (at <= last), F.col("__x"))) for at in (F.floor(place), F.ceil(place)))
        part = F.max(place - F.floor(place))
        aggs.append((low + (high - low) * part).alias(name))
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def _with_quantiles(df: DataFrame, by: list[str], x: Column, aggs: list[Column], names: dict[str, float]) -> DataFrame:
    """Aggregates of ``__v`` and quantiles; the values are written once, since both read them."""
    df, x = Scratch(df.sparkSession, "stats").save(df.select(*by, x.alias("__v")), "values"), F.col("__v")
    rest = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    found = exact_quantiles(df, by, x, names)
    if not by:
        return rest.join(F.broadcast(found))
    found = found.withColumnsRenamed({c: f"__by_{c}" for c in by})
    return rest.join(found, F.expr(" and ".join(f"`{c}` <=> `__by_{c}`" for c in by)), "left").drop(*[f"__by_{c}" for c in by])


def summary(df: DataFrame, by: list[str], value: str, extremes: bool = False) -> DataFrame:
    """mean, median, population std, p10, p90 and n of each group; quantiles interpolate linearly."""
    x = F.col(value).cast("double")
    v = F.col("__v")
    more = [F.min(v).alias("min"), F.max(v).alias("max")] if extremes else []
    aggs = [F.avg(v).alias("mean"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("std"), *more, F.count(v).alias("n")]
    out = _with_quantiles(df, by, x, aggs, {"median": 0.5, "p10": 0.1, "p90": 0.9})
    return out.select(*by, "mean", "median", "std", "p10", "p90", *(["min", "max"] if extremes else []), "n")


def quantiles(df: DataFrame, value: str, shares: tuple[float, ...]) -> DataFrame:
    """mean, min, max, population std and the quantiles ``q<percent>`` of a column."""
    x = F.col(value).cast("double")
    names = {f"q{round(100 * s)}": s for s in shares}
    v = F.col("__v")
    aggs = [F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std")]
    return _with_quantiles(df, [], x, aggs, names).select("mean", "min", "max", "std", *names)


def label_shares(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Rows of each group and label, and their share of the group."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("count"))
    return counts.withColumn("ratio", F.col("count") / F.sum("count").over(Window.partitionBy(*by)))


def label_pivot(df: DataFrame, by: list[str], label: str, labels: list[str]) -> DataFrame:
    """One row for each group with ``count::x`` and ``ratio::x`` of each label."""
    aggs = [F.count("*").alias("total")]
    aggs += [F.count_if(F.col(label) == x).alias(f"count::{x}") for x in labels]
    aggs += [(F.count_if(F.col(label) == x) / F.count("*")).alias(f"ratio::{x}") for x in labels]
    return df.groupBy(*by).agg(*aggs)


def first_mode(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones that which comes first."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("count"), F.min(order).alias("first"))
    return counts.groupBy(*by).agg(F.max_by(F.struct(value, "count"), F.struct("count", -F.col("first"))).alias("b")).select(*by, f"b.{value}", "b.count")


def histogram(df: DataFrame, value: str) -> DataFrame:
    """``(value, count)`` for all whole numbers from 0 to the maximum, those without rows included."""
    counts = df.groupBy(F.col(value).cast("long").alias("value")).agg(F.count("*").alias("count"))
    bins = df.agg(F.max(value).cast("long").alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("value"))
    return bins.join(counts, "value", "left").select("value", F.coalesce("count", F.lit(0)).alias("count"))


def group_sizes(df: DataFrame, by: list[str]) -> DataFrame:
    """``(size, clusters, mean)``: how many groups have each size, and the mean size of all."""
    c = df.groupBy(*by).agg(F.count("*").alias("size"))
    return c.groupBy("size").agg(F.count("*").alias("clusters")).join(F.broadcast(c.agg(F.avg("size").alias("mean"))))


def average_rank(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Ranks by value; equal values share the mean of their ranks."""
    sizes = df.groupBy(*by, value).agg(F.count("*").alias("__c"))
    upto = running_sum(sizes, [*by, value], F.col("__c"), "__upto")
    if by:
        upto = upto.join(upto.groupBy(*by).agg(F.min(F.col("__upto") - F.col("__c")).alias("__base")), by)
    else:
        upto = upto.withColumn("__base", F.lit(0))
    ranks = upto.select(*by, value, (F.col("__upto") - F.col("__base") - F.col("__c") + (F.col("__c") + 1) / 2).alias(out))
    return df.join(ranks, [*by, value])


def correlations(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman of each group and its size; a correlation that isn't defined is 0.

    Ranks come from running sums over distinct values, spread over tasks however large a group is.
    """
    both = average_rank(average_rank(df, by, x, "__rx"), by, y, "__ry")
    corr = lambda a, b: F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))
    aggs = [corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("pearson"), corr(F.col("__rx"), F.col("__ry")).alias("spearman"), F.count("*").alias("n")]
    return both.groupBy(*by).agg(*aggs) if by else both.agg(*aggs)


def correlation_suite(df: DataFrame, dataset: str, x: str, y: str) -> DataFrame:
    """Each dataset's correlations, those over all rows (``all``), their mean and their mean weighted by size."""
    each = correlations(df, [dataset], x, y).withColumnRenamed(dataset, "dataset")
    pooled = correlations(df, [], x, y).select(F.lit("all").alias("dataset"), "pearson", "spearman", "n")
    weighted = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    mean = each.agg(F.lit("mean").alias("dataset"), F.avg("pearson").alias("pearson"), F.avg("spearman").alias("spearman"), F.sum("n").alias("n"))
    wmean = each.agg(F.lit("wmean").alias("dataset"), weighted("pearson").alias("pearson"), weighted("spearman").alias("spearman"), F.sum("n").alias("n"))
    return each.select(F.col("dataset").cast("string").alias("dataset"), "pearson", "spearman", "n").unionByName(pooled).unionByName(mean).unionByName(wmean)


def classification_report(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, then ``macro`` and ``weighted``; undefined ratios are 0."""
    true = df.groupBy(F.col(gold).alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col(gold) == F.col(predicted)).alias("tp"))
    said = df.groupBy(F.col(predicted).alias("label")).agg(F.count("*").alias("said"))
    rows = true.join(said, "label", "full_outer").na.fill(0, ["support", "tp", "said"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = rows.select(F.col("label").cast("string").alias("label"), ratio(F.col("tp"), F.col("said")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"), "support")
    macro = rows.agg(F.lit("macro").alias("label"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    weighted = rows.agg(F.lit("weighted").alias("label"), *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def binary_f1(gold: Column, predicted: Column) -> Column:
    """F1 of the positive class in percent."""
    tp = F.count_if((gold == 1) & (predicted == 1))
    return 100 * F.coalesce(F.try_divide(2 * tp, F.count_if(gold == 1) + F.count_if(predicted == 1)), F.lit(0.0))


def squared_error(gold: Column, predicted: Column) -> Column:
    return F.avg((gold.cast("double") - predicted) * (gold.cast("double") - predicted))
