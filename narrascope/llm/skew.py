"""Joins of rows with one row for each group, where a few groups may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is hot if it has more than this share of all rows and more than ``LEAST``; so at most 1 / ``SHARE`` groups are hot.
SHARE = 1e-4
LEAST = 256
SALTS = 4096


def hot_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``groups`` (but ``size``), which has one row for each key and its number of rows.

    Hot groups, of which there are 10,000 at most, are broadcast.  Their rows take no part in the second join, to which they
    go under a salt by the hash of ``spread``; the rows of all other groups meet their group there.  ``groups`` is read
    twice and should be a written table.  Keys aren't null.
    """
    limit = max(LEAST, int(total * SHARE))
    values = [c for c in groups.columns if c not in keys and c != size]
    hot = groups.where(F.col(size) > limit).select(*keys, F.struct(*values).alias("__hot"))
    cold = groups.where(F.col(size) <= limit).select(*keys, F.lit(0).alias("__salt"), F.struct(*values).alias("__cold"))
    salt = F.when(F.col("__hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*spread), F.lit(SALTS))).cast("int")
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt)
    joined = marked.join(cold, [*keys, "__salt"], "left").withColumn("__found", F.coalesce("__hot", "__cold"))
    if how == "inner":
        joined = joined.where("__found is not null")
    return joined.select(*rows.columns, *[F.col("__found")[c].alias(c) for c in values])
