"""Sharding by extendible hashing.

A row's hash bits are those of its id followed by those of its text.  The directory starts as one bucket without
bits; a bucket over the byte limit splits on the next bit, and only such buckets do, until every shard fits.  Sizes
are summed once for cells of many bits, so all splits that those bits decide are made on the small table of cells;
only rows of cells that are still too large are summed again by more bits.

Defined cases: null texts count 0 bytes and are told from empty ones; a single row over the limit is a shard of its
own; rows equal in id and text can't be told apart and stay in one shard; null ids hash as a text of their own; further columns
are left out of the table of shards, whatever their names, and written by ``write_shards``, where a column named ``shard`` gives way to the shard's.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.session import Scratch

LIMIT = 1 << 20
BITS = 120


def _half(x):
    return F.lpad(F.conv(F.substring(F.md5(F.encode(x, "UTF-8")), 1, 15), 16, 2), 60, "0")


def hash_bits(id_col: str, text_col: str) -> F.Column:
    """A text of 120 binary digits."""
    name = F.concat(F.lit("="), F.col(f"`{id_col}`").cast("string"))
    text = F.concat(F.lit("="), F.col(f"`{text_col}`").cast("string"))
    return F.concat(_half(F.coalesce(name, F.lit(""))), _half(F.coalesce(text, F.lit(""))))


def _split(cells: DataFrame, lo: int, hi: int, limit: int, work: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(cell, shard, bytes, rows) of cells in buckets that fit with lo..hi bits, and the cells of buckets that don't."""
    done, rest = None, cells
    for d in range(lo, hi + 1):
        shard = F.substring("cell", 1, d)
        sizes = rest.groupBy(shard.alias("shard")).agg(F.sum("b").alias("bytes"), F.sum("r").alias("rows"), F.min("low").alias("first"), F.max("high").alias("last"))
        fits = (F.col("bytes") <= limit) | (F.col("rows") == 1) | (F.col("first") == F.col("last"))
        level = work.save(rest.withColumn("shard", shard).join(sizes.withColumn("fits", fits).drop("first", "last"), "shard"), f"{name}-{d}")
        part = level.where("fits").select("cell", "shard", "bytes", "rows")
        done = part if done is None else done.unionAll(part)
        rest = level.where("not fits").select("cell", "b", "r", "low", "high")
        if rest.isEmpty():
            return done, rest
    return done, rest


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Each row's id with ``n_bytes``, ``shard`` (its hash prefix), ``depth``, ``shard_bytes`` and ``shard_rows``."""
    work = Scratch(docs.sparkSession, "shards")
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("long")
    rows = work.save(docs.select(F.col(f"`{id_col}`").alias("id"), size.alias("n"), hash_bits(id_col, text_col).alias("bits")), "rows")
    total = rows.agg(F.sum("n")).first()[0] or 0
    lo, hi = 0, min(BITS, max(4, math.ceil(math.log2(max(1, total / limit))) + 4))
    out, rest = None, rows
    step = 0
    while True:
        cell = F.substring("bits", 1, hi)
        cells = rest.groupBy(cell.alias("cell")).agg(F.sum("n").alias("b"), F.count("*").alias("r"), F.min("bits").alias("low"), F.max("bits").alias("high"))
        done, over = _split(work.save(cells, f"cells-{step}"), lo, hi, limit, work, f"split-{step}")
        part = rest.withColumn("cell", cell).join(done, "cell").select("id", "n", "shard", "bytes", "rows")
        out = part if out is None else out.unionAll(part)
        if hi == BITS or over.isEmpty():
            break
        rest = work.save(rest.withColumn("cell", cell).join(over.select("cell"), "cell", "left_semi").drop("cell"), f"rest-{step}")
        lo, hi, step = hi + 1, min(BITS, hi + 8), step + 1
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_bytes"), "shard", F.length("shard").cast("long").alias("depth"),
        F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"),
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> None:
    """Write all columns of ``docs`` as one Parquet folder for each shard; shards fit in a task by their limit."""
    bits = hash_bits(id_col, text_col)
    found = shard_rows(docs, id_col, text_col, limit).select("shard").distinct()
    depths = [r[0] for r in found.select(F.length("shard").alias("d")).distinct().collect()]
    keyed = docs.withColumn("__bits", bits)
    parts = [keyed.withColumn("shard", F.substring("__bits", 1, d)).join(found.where(F.length("shard") == d), "shard") for d in sorted(depths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.drop("__bits").repartition("shard").write.partitionBy("shard").parquet(path)
