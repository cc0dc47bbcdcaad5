"""Exact dedup by two passes over a Bloom filter.

The texts are read once, into a narrow table of one row for each document: its digest, its length and the columns to
keep.  The first pass over that table puts the digests into a Bloom filter whose cells count to two; tasks send
each digest on at most twice, packed by the filter's block.  The second pass asks the filter: a digest with a cell
below two stands alone for certain, so its row is done, and only the rest, possibly repeated, is shuffled by digest.
Groups are aggregated before their exchange, and rows of hot groups meet theirs by broadcast.

The filter has ``CELLS`` cells for each row, in blocks of 16 KB.  At most ``SLICE`` blocks (64 MB, some 33 million rows)
are broadcast at a time; a larger table is asked slice by slice, each slice by the rows whose digests fall into it.

Texts are equal when their digests (SHA-256) are, after white space is deleted.  Of equal texts that with the most code
points in the original stays, then the smallest id.

Defined cases: null and blank texts are empty ones, and equal; null ids come after all others, and ``keep_id`` is null
where such a row stays; of rows that tie in length and id one stays; kept columns named like one that is made are
replaced by it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm.rows import bound_batches
from narrascope.llm.skew import hot_join
from narrascope.llm.textbatch import mix
from narrascope.session import Scratch

#: Cells of two bits for each row, and those that a digest marks; some 2 in 100 single digests look repeated.
CELLS = 8
MARKS = 4
#: Cells of one block, and the blocks that are broadcast at a time.
WIDTH = 1 << 16
SLICE = 4096
MADE = ("keep_id", "group_size", "kept", "text_sha256")

U = np.uint64


def block_of(h: np.ndarray, n_blocks: int) -> np.ndarray:
    """The filter's block of each digest, by its upper half."""
    return ((h >> U(32)) * U(n_blocks) >> U(32)).astype(np.int32)


def cells_of(h: np.ndarray) -> np.ndarray:
    """The cells of each digest in its block, one row for each; two of them may be the same one."""
    more = mix(h ^ U(0x5851F42D4C957F2D))
    return np.stack([(more >> U(16 * k)) & U(WIDTH - 1) for k in range(MARKS)], axis=1).astype(np.int64)


def count_cells(h: np.ndarray) -> np.ndarray:
    """One block from its digests: cells that hold how many marked them, two at most."""
    cells = np.sort(cells_of(h), axis=1)
    first = np.ones(cells.shape, bool)
    first[:, 1:] = cells[:, 1:] != cells[:, :-1]  # a digest counts once in a cell
    return np.minimum(np.bincount(cells[first], minlength=WIDTH), 2).astype(np.uint8)


def pack(cells: np.ndarray) -> bytes:
    """Four cells in a byte."""
    quads = cells.reshape(-1, 4)
    return (quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6).tobytes()


def repeated(packed: np.ndarray, rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether all cells of each digest hold two; ``packed`` has one block in a row, ``rows`` says which is each digest's."""
    cells = cells_of(h)
    held = packed[rows[:, None], cells >> 2] >> ((cells & 3) << 1).astype(np.uint8) & 3
    return (held == 2).all(axis=1)


def _twice(h: np.ndarray) -> np.ndarray:
    """The digests in order, each two times at most."""
    h = np.sort(h)
    third = np.zeros(len(h), bool)
    third[2:] = h[2:] == h[:-2]
    return h[~third]


def _filter(digests: DataFrame, n_blocks: int) -> DataFrame:
    """``(block, cells)`` of the digests in column ``h``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _twice(batch.column(0).to_numpy(zero_copy_only=False).view(U))
            block = block_of(h, n_blocks)
            cut = np.flatnonzero(np.diff(block, prepend=-1))
            parts = [x.tobytes() for x in np.split(h, cut[1:])] if len(h) else []
            yield pa.RecordBatch.from_arrays([pa.array(block[cut], pa.int32()), pa.array(parts, pa.binary())], ["block", "digests"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                cells = count_cells(_twice(np.frombuffer(part.as_buffer(), U)))
                found[k] = np.minimum(found[k] + cells, 2) if k in found else cells
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([pack(x) for x in found.values()], pa.binary())], ["block", "cells"])

    # one digest's cells in one block add up however its copies are spread: two tasks that saw it mark each cell twice
    dealt = digests.select("h").mapInArrow(deal, "block int, digests binary")
    return dealt.repartition("block").mapInArrow(build, "block int, cells binary")


def _asker(shared: Broadcast, low: int, n_blocks: int):
    @F.pandas_udf("boolean")
    def ask(h: pd.Series) -> pd.Series:
        h = h.to_numpy().view(U)
        return pd.Series(repeated(shared.value, block_of(h, n_blocks) - low, h))

    return ask


def flag_repeated(rows: DataFrame, work: Scratch, name: str) -> DataFrame:
    """A written table of ``rows`` with ``suspect``: false only where no other row has this digest, in column ``h`` (long).

    ``rows`` is read several times and should be a written table.
    """
    bound_batches(rows.sparkSession)
    n_blocks = max(1, -(-rows.count() * CELLS // WIDTH))
    upper, digest = F.shiftrightunsigned("h", 32), F.col("h")
    block = F.shiftright(upper * n_blocks, 32)
    out = None
    for low in range(0, n_blocks, SLICE):
        part = rows if n_blocks <= SLICE else rows.where((block >= low) & (block < low + SLICE))
        size = min(SLICE, n_blocks - low)
        table = np.zeros((size, WIDTH // 4), np.uint8)
        for k, cells in _filter(part, n_blocks).toLocalIterator():  # SLICE blocks at most
            table[k - low] = np.frombuffer(cells, np.uint8)
        shared = rows.sparkSession.sparkContext.broadcast(table)

        done = work.save(part.withColumn("suspect", _asker(shared, low, n_blocks)(digest)), f"{name}-{low}")
        shared.destroy()
        out = done if out is None else out.unionAll(done)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) of every row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    work = Scratch(docs.sparkSession, "exact")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    sha = F.sha2(F.encode(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""), "UTF-8"), 256)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in MADE]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(0)
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.length(text).alias("n"), F.unhex(sha).alias("sha"), row.alias("row"))
    narrow = narrow.withColumn("h", F.xxhash64("sha")).withColumn("at", F.monotonically_increasing_id())
    flagged = flag_repeated(work.save(narrow, "narrow"), work, "flagged")
    alone = flagged.where("not suspect").select("row", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    suspects = flagged.where("suspect")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), "id", "at"))
    groups = suspects.groupBy("sha").agg(best.alias("best"), F.count("*").alias("size"))
    groups = work.save(groups.select("sha", F.col("best.id").alias("keep_id"), F.col("best.at").alias("keep_at"), F.col("size").alias("group_size"), "size"), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    met = hot_join(suspects.select("row", "sha", "at"), groups, ["sha"], "size", total, ["at"])
    met = met.select("row", "sha", "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"))
    return alone.unionAll(met).select(
        *[F.col("row").getField(c).alias(c) for c in keep], "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )
