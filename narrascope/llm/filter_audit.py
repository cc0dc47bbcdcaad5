"""How document filters interact: what each removes, alone and after others, in every order.

A document is the set of filters that it fails, a mask of one bit a filter.  Each part's masks are counted into a row
of all documents, one of good and one of toxic ones, so a corpus of any size becomes a small integer matrix, three
rows of 32 a part.  What happens to a mask in an order at a step doesn't depend on the corpus: it is a fixed matrix of
32 by 600 (120 orders of five filters, five steps) for each outcome, and products of the two give every count of
every order at once.  Counts are summed inside tasks before they are shuffled; products are made part by part.

Defined cases: null texts are empty ones; null parts are the empty string; a document whose id is null has no smaller
one, so it is never a later copy, nor labelled; rows that repeat id and text are not later copies of each other, and
each counts; of labels that repeat an id one that says 1 is enough; null labels say nothing; further columns, whatever
their names, are left out; without documents there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.llm.exact_dedup import flag_repeated
from narrascope.llm.rows import bound_batches
from narrascope.llm.skew import hot_join
from narrascope.session import Scratch

#: The filters' letters; a filter's place is its bit.
FILTERS = "ABCDE"
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "shapley")
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


@lru_cache
def outcome_matrices(names: str = FILTERS) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The (order, step) of each column, and for each outcome the matrix of masks by columns."""
    k = len(names)
    masks = np.arange(1 << k)
    steps: list[tuple[str, int]] = []
    columns: dict[str, list[np.ndarray]] = {name: [] for name in OUTCOMES}
    total = np.zeros((1 << k, k), np.int64)
    for order in permutations(range(k)):
        before = 0
        for step, f in enumerate(order, 1):
            gone, fails = (masks & before) > 0, (masks >> f & 1) > 0
            for name, hit in (("kept", ~gone & ~fails), ("removed", ~gone & fails), ("redundant", gone & fails), ("unique_fails", masks == 1 << f)):
                columns[name].append(hit)
            total[:, f] += ~gone & fails
            steps.append(("".join(names[i] for i in order), step))
            before |= 1 << f
    columns["shapley"] = [total[:, names.index(order[step - 1])] for order, step in steps]
    return steps, {name: np.stack(cols, axis=1).astype(np.int64) for name, cols in columns.items()}


def interactions(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """Every order's and step's outcomes from ``(part, mask, n, good, toxic)``; rows of a part and mask are added up."""
    bound_batches(counts.sparkSession)
    cells = counts.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    # at most one struct for each mask
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, by = outcome_matrices(names)
        orders, places = pa.array([s[0] for s in steps]), pa.array([s[1] for s in steps], pa.int32())
        for batch in batches:
            for part, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stacked = np.zeros((3, 1 << len(names)), np.int64)
                for c in held:
                    stacked[:, c["mask"]] = c["n"], c["good"], c["toxic"]
                got = {name: stacked @ m for name, m in by.items()}
                columns = [got["kept"][0], got["removed"][0], got["redundant"][0], got["unique_fails"][0], got["removed"][1], got["removed"][2], got["shapley"][0]]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(steps), pa.string()), orders, places, *map(pa.array, columns)], [f.split()[0] for f in SCHEMA.split(", ")])

    return parts.mapInArrow(run, SCHEMA)


def text_failures(text: Column) -> list[Column]:
    """Of filters A to D: under 200 words, few distinct words, many capitals, odd characters."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * capitals > 3 * F.length(text), text.rlike(r"[#$%&*|]")]


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(id, part, mask)`` of every document under the filters A to D and E, a text that a smaller id has, too."""
    work = Scratch(docs.sparkSession, "audit")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_failures(text))), F.lit(0))
    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), part.alias("part"), mask.alias("mask"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("sha"))
    flagged = flag_repeated(work.save(narrow.withColumn("h", F.xxhash64("sha")), "narrow"), work, "flagged")
    suspects = flagged.where("suspect").select("id", "part", "mask", "sha", F.monotonically_increasing_id().alias("at"))
    groups = work.save(suspects.groupBy("sha").agg(F.min("id").alias("least"), F.count("*").alias("size")), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    later = F.when(F.col("id") > F.col("least"), 1 << FILTERS.index("E")).otherwise(0)
    met = hot_join(suspects, groups, ["sha"], "size", total, ["at"]).select("id", "part", (F.col("mask") + later).alias("mask"))
    return work.save(flagged.where("not suspect").select("id", "part", "mask").unionAll(met), "masks")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per part, order of the five filters and step: counts of documents kept, removed, redundant and failing no other
    filter, good and toxic ones removed, and the filter's removals over all orders."""
    masks = failures(docs, id_col, text_col, part_col)
    said = lambda c: F.max((F.col(c) == 1).cast("long")).alias(c)
    known = labels.groupBy(F.col(f"`{id_col}`").alias("id")).agg(said("quality"), said("toxic")).where("quality = 1 or toxic = 1")
    none = F.lit(0).cast("long")
    counts = masks.groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", none.alias("good"), none.alias("toxic"))
    # null ids meet nothing; nulls among labels count as 0
    marked = masks.join(known, "id").groupBy("part", "mask").agg(F.sum(F.coalesce("quality", none)).alias("good"), F.sum(F.coalesce("toxic", none)).alias("toxic"))
    return interactions(counts.unionByName(marked.select("part", "mask", none.alias("n"), "good", "toxic")))
