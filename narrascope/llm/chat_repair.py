"""Repair of damaged conversations by error-correcting Earley parsing.

A conversation's roles have to read ``(s?(ua)+)?``: an optional system row, then pairs of user and assistant.  ``RULES`` is
that language as a left-recursive grammar; its errors are weighted productions of their own: a row may be deleted
anywhere, given another role, or a row may be inserted.  The parser goes from row to row.  Each item of its chart, a
nonterminal completed from the conversation's start, retains its least (cost, audit); the audit is one letter for each
edit in order.  Letters and rows fix the cost, so of two equally dear audits of one item neither begins with the
other, and what is least now stays least whatever follows.  The completed chart's least item yields the repair.

Rows that are equal in conversation, turn, role and text are counted first, and a first place for each role and text of a
conversation tells duplicates; hot ones of both are aggregated before their exchange.  Then all rows are
range-partitioned in the order of conversations and turns, so a conversation of any length is spread over tasks.  A task
parses its run of a conversation, from the start or, where the conversation may have begun in an earlier task, from
each nonterminal it may have reached; runs are put together in order, at most one a conversation and task.  Only the
hash of a repaired text has to see the text in order: of conversations that several tasks share it is taken row by row
in one more pass, which holds no more than one batch of rows and the audit.

Defined cases: rows are taken by turn, nulls first, then role and text; null roles and texts are one space, as ``damage``
leaves them; ids and turns are whole numbers; null ids are one conversation; a role counts by its first character, an empty one by none; conversations whose
rows are all gone have zeros, an empty audit and the hash of an empty string; further columns, whatever their names,
are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from narrascope.llm.rows import bound_batches
from narrascope.llm.skew import hot_join
from narrascope.session import Scratch

#: Left-recursive productions: a nonterminal, the nonterminal that it begins with and the role that follows.
RULES = (("told", "open", "s"), ("asked", "open", "u"), ("asked", "told", "u"), ("asked", "answered", "u"), ("answered", "asked", "a"))
#: Where a conversation starts (with nothing), and the nonterminals of which a whole one may consist.
START, WHOLE = "open", ("open", "answered")
STATES = ("open", "told", "asked", "answered")
ROLES = {"u": "user", "a": "assistant"}
#: What edits cost; a truncated row that stays costs more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Bytes of a run's texts that a task holds for its hash.
HELD = 8 << 20

Item = tuple[int, str]


def _inserted(column: dict[str, Item]) -> dict[str, Item]:
    """The column with the items that insertions complete."""
    while True:
        better = {}
        for to, begin, role in RULES:
            if begin in column and role in ROLES:
                new = (column[begin][0] + INSERT, column[begin][1] + "I")
                if new < min(column.get(to, new + ("",)), better.get(to, new + ("",))):
                    better[to] = new
        if not better:
            return column
        column = column | better


def parse(tokens: list[tuple[str, bool, bool]], begin: str = START) -> dict[str, Item]:
    """The last column of the chart: the least (cost, audit) of every nonterminal over all tokens.

    A token is a role's initial, whether the row must go, and whether it is truncated.  ``begin`` is the nonterminal
    that is complete before the first token.
    """
    column = _inserted({begin: (0, "")})
    for initial, gone, cut in tokens:
        scanned = {k: (cost + DELETE, audit + "D") for k, (cost, audit) in column.items()}
        if not gone:
            more = TRUNCATED if cut else 0
            for to, start, role in RULES:
                if start not in column or (role != initial and role not in ROLES):
                    continue
                cost, audit = column[start]
                new = (cost + KEEP + more, audit + "K") if role == initial else (cost + REROLE + more, audit + "R")
                if to not in scanned or new < scanned[to]:
                    scanned[to] = new
        column = _inserted(scanned)
    return column


@lru_cache(1 << 16)
def _parse_codes(codes: bytes, begin: str) -> dict[str, Item]:
    """``parse`` of packed tokens; conversations of one shape are parsed once in a worker."""
    return parse([_token(c) for c in codes], begin)


def _code(initial: str, gone: bool, cut: bool) -> int:
    return ("sua".find(initial) + 1 if initial else 0) << 2 | gone << 1 | cut


def _token(code: int) -> tuple[str, bool, bool]:
    return ("?sua"[code >> 2], bool(code & 2), bool(code & 1))


#: Rows that are parsed at a time; longer runs are halved, and their halves put together.
STRETCH = 256

#: From each nonterminal that may stand before some rows, the items after them.
Table = dict[str, dict[str, Item]]


def joined(left: Table, right: Table) -> Table:
    """The items over the rows of ``left`` and then those of ``right``."""
    out: Table = {}
    for begin, column in left.items():
        whole = out.setdefault(begin, {})
        for middle, (cost, audit) in column.items():
            for end, (more, edits) in right[middle].items():
                new = (cost + more, audit + edits)
                if end not in whole or new < whole[end]:
                    whole[end] = new
    return out


def parse_run(codes: bytes, begins: tuple[str, ...]) -> Table:
    """The items after a run of rows of any length."""
    if len(codes) <= STRETCH:
        return {b: _parse_codes(codes, b) for b in begins}
    half = len(codes) // 2
    left = parse_run(codes[:half], begins)
    return joined(left, parse_run(codes[half:], tuple({end for column in left.values() for end in column})))


def whole(table: Table) -> Item:
    """The least item of a whole conversation."""
    return min(table[START][end] for end in WHOLE if end in table[START])


class Repaired:
    """Applies an audit to rows in order and hashes the repaired ``role:text`` lines."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START
        self.hash, self.empty = hashlib.sha256(), True

    def _put(self, role: str, text: str) -> None:
        self.hash.update((("" if self.empty else "\n") + role + ":" + text).encode())
        self.empty = False

    def _expected(self) -> str:
        self.state = "answered" if self.state == "asked" else "asked"
        return ROLES["a" if self.state == "answered" else "u"]

    def _insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._put(self._expected(), "")

    def row(self, role: str, text: str) -> None:
        self._insertions()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = {"s": "told", "u": "asked", "a": "answered"}[role[0]]
            self._put(role, text)
        elif edit == "R":
            self._put(self._expected(), text)

    def digest(self) -> str:
        self._insertions()
        return self.hash.hexdigest()


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, times)``: rows that a checksum of conversation and turn chooses are dropped (``times`` is
    0), emptied, robbed of their full stops, repeated (2) or given to the user; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("times"),
    )


_COUNTS = ["rows", "turns", "blank", "duplicate", "truncated", "illegal"]
_ENDS = ["first", "last", "low", "high"]


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_TEXT, _LONG = T.StringType(), T.LongType()
_RUN = _schema(
    key=_TEXT, conv_id=_LONG, part=T.IntegerType(), edge=T.BooleanType(), **dict.fromkeys(_COUNTS, _LONG), first=_TEXT, last=_TEXT, low=_LONG, high=_LONG,
    cost=_LONG, audit=_TEXT, sha=_TEXT, reached=T.ArrayType(_schema(begin=_TEXT, end=_TEXT, cost=_LONG, audit=_TEXT)),
)
_HASHED = _schema(key=_TEXT, sha=_TEXT)
_ALTERNATING = ("su", "ua", "au")


class _Run:
    """What a task gathers of one conversation, row by row."""

    def __init__(self, key: str, conv_id: int | None, part: int, begins: tuple[str, ...], most: int):
        self.key, self.conv_id, self.part, self.begins, self.edge = key, conv_id, part, begins, len(begins) > 1
        self.codes, self.held, self.size, self.most = bytearray(), [], 0, most
        self.rows = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, times: int, blank: bool, later: bool, cut: bool) -> None:
        initial = role[:1]
        self.first = initial if self.first is None else self.first
        self.illegal += (self.rows > 0 and self.last + initial not in _ALTERNATING) + (times - 1) * (initial * 2 not in _ALTERNATING)
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.blank += times if blank else 0
        self.duplicate += 0 if blank else times - (not later)
        self.truncated += cut and not blank and not later
        gone = blank or later
        self.codes.append(_code(initial, gone, cut and not gone))
        self.codes.extend(bytes([_code(initial, True, False)]) * (times - 1))
        self.rows += times
        self.size += (len(text) + 64) * times
        if self.held is not None:
            self.held.extend([(role, text)] * times if self.size <= self.most else ())
        if self.size > self.most:
            self.held = None

    def row(self) -> dict:
        table = parse_run(bytes(self.codes), self.begins)
        cost, audit = whole(table)
        sha = None
        if self.held is not None:
            repaired = Repaired(audit)
            for role, text in self.held:
                repaired.row(role, text)
            sha = repaired.digest()
        reached = [{"begin": b, "end": e, "cost": c, "audit": a} for b, column in table.items() for e, (c, a) in column.items()] if self.edge else []
        return {n: getattr(self, n) for n in ("key", "conv_id", "part", "edge", *_COUNTS, *_ENDS)} | {"cost": cost, "audit": audit, "sha": sha, "reached": reached}


def _batches(rows: Iterator[dict], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    kind = to_arrow_schema(schema)
    while some := list(islice(rows, 1000)):
        yield pa.RecordBatch.from_pylist(some, kind)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _runs(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """One row for each conversation in a sorted partition; its first and last run may be parts of longer ones."""

    def found():
        run = None
        for key, conv_id, part, *row in _rows(batches):
            if run is None or run.key != key:
                if run is not None:
                    yield run.row()
                run = _Run(key, conv_id, part, STATES if run is None else (START,), held)
            if row[3]:
                run.add(*row)
        if run is not None:
            run.edge = True
            yield run.row()

    return _batches(found(), _RUN)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its runs in order."""
    names = _RUN.names

    def table(run: dict) -> Table:
        out: Table = {}
        for x in run["reached"]:
            out.setdefault(x["begin"], {})[x["end"]] = (x["cost"], x["audit"])
        return out

    def fold(runs: list[dict]) -> dict:
        full = [r for r in runs if r["rows"]]
        if len(full) < 2:
            return (full or runs)[0]
        out = full[0] | {n: sum(r[n] for r in full) for n in _COUNTS} | {"sha": None}
        last, high = full[0]["last"], full[0]["high"]
        for r in full[1:]:
            out["illegal"] += last + r["first"] not in _ALTERNATING
            out["turns"] -= high is not None and r["low"] == high
            out["low"] = r["low"] if out["low"] is None else out["low"]
            last, high = r["last"], high if r["high"] is None else r["high"]
        tables = [table(r) for r in full]
        while len(tables) > 1:  # neighbours first, so audits are copied a logarithmic number of times
            tables = [joined(*tables[k : k + 2]) if k + 1 < len(tables) else tables[k] for k in range(0, len(tables), 2)]
        out["cost"], out["audit"] = whole(tables[0])
        return out | {"high": high}

    def found():
        for _, runs in groupby((dict(zip(names, r)) for r in _rows(batches)), itemgetter("key")):
            yield fold(list(runs)) | {"reached": []}  # one for each task at most

    return _batches(found(), _RUN)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation from its audit, which comes first, and its rows in order."""

    def found():
        for key, rows in groupby(_rows(batches), itemgetter(0)):
            repaired = Repaired(next(rows)[1])
            for _, _, role, text, times in rows:
                for _ in range(times):
                    repaired.row(role, text)
            yield {"key": key, "sha": repaired.digest()}

    return _batches(found(), _HASHED)


def repair(rows: DataFrame, held: int = HELD) -> DataFrame:
    """Each conversation's faults and its least repair, from ``(conv_id, turn, role, text)`` and, if there, ``times``: how often
    the row stands there, 0 if it only names its conversation.

    A task hashes the repaired texts that it holds in ``held`` bytes; longer ones are hashed row by row in a pass of their own.
    """
    spark = rows.sparkSession
    work = Scratch(spark, "repair")
    bound_batches(spark)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    times = F.col("times") if "times" in rows.columns else F.lit(1)
    named = rows.select(key.alias("key"), F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role"), space("text"), times.cast("long").alias("times"))
    counted = named.groupBy("key", "conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    said = F.unhex(F.sha2(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), "UTF-8"), 256))
    counted = work.save(counted.withColumn("said", said), "rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = counted.where("times > 0").groupBy("key", "said").agg(F.min(place).alias("first"), F.count("*").alias("size"))
    placed = hot_join(counted, work.save(firsts, "firsts"), ["key", "said"], "size", counted.count(), ["turn"], "left")
    end = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+$", ""), -1, 1)
    faults = placed.select(
        "key", "conv_id", "turn", "role", "text", "times", (end == "").alias("blank"),
        F.coalesce(~F.col("turn").eqNullSafe(F.col("first.turn")), F.lit(False)).alias("later"), (~end.isin(*".!?")).alias("cut"),
    )
    faults = work.save(faults, "faults")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = faults.repartitionByRange(n, "key", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("key", "turn", "role", "text")
    spread = spread.select("key", "conv_id", F.spark_partition_id().alias("part"), "turn", "role", "text", "times", "blank", "later", "cut")
    runs = work.save(spread.mapInArrow(lambda batches: _runs(batches, held), _RUN), "runs")
    edges = runs.where("edge").repartition("key").sortWithinPartitions("key", "part").mapInArrow(_folded, _RUN)
    found = work.save(runs.where("not edge").unionAll(edges).drop("reached"), "found")
    left = found.where("sha is null").select("key", "audit")
    if not left.isEmpty():
        here = faults.join(left.select("key"), "key", "left_semi").where("times > 0")
        both = left.select("key", F.lit(0).alias("at"), "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("times", "long"))])
        both = both.unionByName(here.select("key", F.lit(1).alias("at"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "times"))
        ordered = both.repartition("key").sortWithinPartitions("key", "at", "turn", "role", "text").select("key", "audit", "role", "text", "times")
        late = work.save(ordered.mapInArrow(_hashed, _HASHED), "hashed").withColumnRenamed("sha", "late")
        found = found.join(late, "key", "left").withColumn("sha", F.coalesce("sha", "late"))
    gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(0).cast("long")
    return found.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))
