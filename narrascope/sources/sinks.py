"""Writers through Spark's commit protocol: what a call replaces is replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def csv(df: DataFrame, path: str) -> None:
    """CSV with a header; spaces around texts are kept, and empty texts are quoted, unlike nulls.

    Of a table of one column Spark writes no row for a null.
    """
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").option("header", True).option("escape", '"').options(**spaces).csv(path)


def csv_with_mark(df: DataFrame, path: str) -> None:
    """CSV with a byte order mark in front of the header, as some spreadsheets want it; one file."""
    cells = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns]
    head = df.sparkSession.createDataFrame([("﻿" + ",".join(df.columns),)], "value string")
    head.unionAll(df.select(F.concat_ws(",", *cells).alias("value"))).coalesce(1).write.mode("overwrite").text(path)


def fixed_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """CSV with a fixed number of decimals."""
    kinds = dict(df.dtypes)
    cells = [F.format_string(f"%.{digits}f", F.col(f"`{c}`").cast("double")).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns]
    csv(df.select(*cells), path)


def vectors(df: DataFrame, path: str) -> None:
    """Vectors with their ids as Parquet."""
    df.write.mode("overwrite").parquet(path)


def by_language(df: DataFrame, path: str, column: str = "lang", files: int = 16) -> None:
    """One folder for each language, of at most ``files`` files, so that a common language isn't one task's."""
    df.repartition(column, F.pmod(F.xxhash64(*df.columns), F.lit(files))).write.mode("overwrite").partitionBy(column).json(path)


def resumable(df: DataFrame, path: str, key: str, chunks: int) -> int:
    """Append rows in chunks by the hash of their key, leaving out keys that are there already; returns the chunks written.

    A call after a failure goes on with what is missing.
    """
    spark, done = df.sparkSession, 0
    for k in range(chunks):
        part = df.where(F.pmod(F.xxhash64(key), F.lit(chunks)) == k)
        try:
            have = spark.read.schema(df.schema).parquet(path).select(key)
            have.limit(1).collect()
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            have = None
        todo = part if have is None else part.join(have.distinct(), key, "left_anti").select(*df.columns)
        todo.write.mode("append").parquet(path)
        done += 1
    return done


def metrics(df: DataFrame, path: str) -> None:
    """``key = value`` lines of one row."""
    rows = F.explode(F.array(*[F.concat(F.lit(f"{c} = "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None"))) for c in df.columns]))
    df.select(rows.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def score_table(df: DataFrame, tasks: list[str], task: str = "task", score: str = "score") -> DataFrame:
    """One row of scores in percent with two decimals and their average; a missing task is 0.00 and counts."""
    cols = [F.coalesce(F.max(F.when(F.col(task) == t, 100 * F.col(score))), F.lit(0.0)) for t in tasks]
    mean = sum(cols[1:], cols[0]) / len(cols)
    return df.agg(*[F.format_string("%.2f", c).alias(t) for c, t in zip(cols, tasks)], F.format_string("%.2f", mean).alias("avg"))
