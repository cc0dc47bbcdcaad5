"""Line dedup over a suffix array of line ids, with DataFrame functions only.

The corpus is the sequence of all documents' lines in the order of ids.  A run of consecutive lines of one document
is removed if it has at least ``min_words`` words and the same lines stand earlier in the corpus, so the first copy
of every repeated run stays.  This holds for runs of any length.  It is enough to look at two kinds of runs: the
shortest with enough words that begins at a line, and the shortest that ends at one; every longer repeated run is
made up of such runs, which repeat with it.

Suffixes, that is line positions, are sorted by prefix doubling: ranks of the first 2^k lines of two suffixes, 2^k
lines apart, give those of the first 2^(k+1).  Ranks come from a range-partitioned sort of the distinct pairs, so no
task sees all.  A suffix whose prefix is unique drops out.  Doubling ends at the longest run looked for: beyond it
the order of suffixes decides nothing.  A run of m lines with 2^k <= m < 2^(k+1) belongs to the interval of suffixes
whose common prefix has at least m lines; its ranks at 2^k lines, at its head and its tail, name that interval.  All
members of an interval but the first are later copies.

Lines are told apart by two 64-bit hashes with different seeds, and texts of one id by one, so that lines of a given
pair are taken for equal with a probability of about 2^-128.  A line that a large part of the corpus repeats, such as
the empty one, meets its rank by a broadcast (``hot_join``).

Defined cases: null texts stay null and have no lines; an empty text is one empty line; null ids come first in the
order; rows that repeat both id and text are one document and get the same result; lines without words count as
parts of a run; a document whose lines are all later copies becomes an empty text.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrascope.llm.skew import hot_join
from narrascope.session import Scratch

MIN_WORDS = 50
_KEY = ["id", "th", "line"]


def _ranked(classes: DataFrame, keys: list[str], work: Scratch, name: str, rank: str = "rank") -> DataFrame:
    """The distinct keys with order-preserving ranks: a range-partitioned sort numbers them."""
    written = work.save(classes, f"{name}-classes")
    n = max(1, int(written.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = written.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return work.save(sorted_.withColumn(rank, F.monotonically_increasing_id()), f"{name}-ranks")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Later copies ``(id, th, line, n_lines)``: ``th`` is the text's xxhash64, ``line`` counts from 0."""
    work = Scratch(docs.sparkSession, "lines")
    text = F.col(f"`{text_col}`")
    words = F.size(F.filter(F.split("s", "[ \t\x0b\f\r]+"), lambda x: x != ""))
    lines = docs.where(text.isNotNull()).select(
        F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("line", "s")
    )
    named = lines.select("id", "th", "line", F.xxhash64("s").alias("h"), F.xxhash64(F.lit(7), "s").alias("g"), words.alias("w"))
    often = lines.select(F.xxhash64("s").alias("h"), F.xxhash64(F.lit(7), "s").alias("g")).groupBy("h", "g").agg(F.count("*").alias("c")).where("c > 1")
    ranks = _ranked(often, ["h", "g"], work, "0")
    first = _with_rank(named, ranks, ["h", "g"]).select(*_KEY, "rank", "w").distinct()
    first = work.save(first, "positions-0")

    # contiguous stretches of repeated lines; e and c are the words before a line and up to its end
    order = Window.partitionBy("id", "th").orderBy("line")
    flat = first.select(*_KEY, "w", (F.col("line") - F.row_number().over(order)).alias("part"))
    so_far = Window.partitionBy("id", "th", "part").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    flat = flat.withColumn("c", F.sum("w").over(so_far)).withColumn("e", F.col("c") - F.col("w"))
    ahead = Window.partitionBy("id", "th", "part").orderBy("e").rangeBetween(0, min_words - 1)
    behind = Window.partitionBy("id", "th", "part").orderBy("c").rangeBetween(1 - min_words, 0)
    flat = flat.select(
        *_KEY, "c", "e", F.max("line").over(ahead).alias("to"), F.max("c").over(ahead).alias("c_to"),
        F.min("line").over(behind).alias("from"), F.min("e").over(behind).alias("e_from"),
    )
    forward = flat.where(F.col("c_to") - F.col("e") >= min_words).select("id", "th", "line", (F.col("to") - F.col("line") + 1).alias("m"))
    backward = flat.where(F.col("c") - F.col("e_from") >= min_words).select("id", "th", F.col("from").alias("line"), (F.col("line") - F.col("from") + 1).alias("m"))
    # floor(log2(m)) without rounding trouble: the number of binary digits less one
    runs = forward.unionAll(backward).distinct().withColumn("level", F.length(F.bin("m")) - 1)
    runs = work.save(runs, "runs")
    longest = runs.agg(F.max("m")).first()[0]

    levels = first.select(F.lit(0).alias("level"), *_KEY, "rank")
    cur = first.select(*_KEY, "rank")
    for k in range(int(math.log2(longest)) if longest else 0):
        step = 1 << k
        tail = cur.select("id", "th", (F.col("line") - step).alias("line"), F.col("rank").alias("rank2"))
        pair = _matched(cur, tail, _KEY).select(*_KEY, "rank", "rank2")
        pair = work.save(pair, f"pairs-{k}")
        often = pair.groupBy("rank", "rank2").agg(F.count("*").alias("c")).where("c > 1")
        ranks = _ranked(often, ["rank", "rank2"], work, str(k + 1), "next")
        cur = work.save(_with_rank(pair, ranks, ["rank", "rank2"]).select(*_KEY, F.col("next").alias("rank")), f"positions-{k + 1}")
        levels = levels.unionAll(cur.select(F.lit(k + 1).alias("level"), *_KEY, "rank"))

    head = _matched(runs, levels, ["level", *_KEY]).withColumn("at", F.expr("line + m - shiftleft(1, level)"))
    tail = levels.select("level", "id", "th", F.col("line").alias("at"), F.col("rank").alias("rank2"))
    placed = work.save(_matched(head, tail, ["level", "id", "th", "at"]).select(*_KEY, "m", "rank", "rank2"), "placed")
    at = F.struct("id", "th", "line")
    firsts = placed.groupBy("m", "rank", "rank2").agg(F.min(at).alias("first"), F.count("*").alias("c")).where("c > 1")
    later = _with_rank(placed, work.save(firsts, "firsts"), ["m", "rank", "rank2"]).where(~at.eqNullSafe(F.col("first")))
    return later.select(*_KEY, F.col("m").alias("n_lines"))


def _with_rank(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the groups (a written table with the sizes ``c``) with the groups' columns."""
    total = groups.agg(F.sum("c")).first()[0] or 0
    return hot_join(rows, groups, keys, "c", total, ["th", "line"])


def _matched(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys of which the id may be null; the keys are kept once."""
    other = y.withColumnsRenamed({c: f"other_{c}" for c in keys})
    on = None
    for c in keys:
        same = F.col(c).eqNullSafe(F.col(f"other_{c}")) if c == "id" else F.col(c) == F.col(f"other_{c}")
        on = same if on is None else on & same
    return x.join(other, on).drop(*[f"other_{c}" for c in keys])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns, the text without later copies of repeated runs, and the columns ``n_lines`` and ``n_removed``.

    Columns of these names are replaced.
    """
    runs = repeated_runs(docs, id_col, text_col, min_words)
    gone = runs.select("id", "th", F.explode(F.sequence(F.col("line"), (F.col("line") + F.col("n_lines") - 1).cast("int"))).alias("line")).distinct()
    gone = gone.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_list("line").alias("__gone"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text = F.col(f"`{text_col}`")
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    out = rows.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__th")), "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    clean = F.when(F.col("__gone").isNull() | text.isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    total = F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    return out.select(
        *[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in names], total.alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
