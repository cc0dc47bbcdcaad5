"""Chat formatting from reply trees.

Messages name the message they reply to.  Iterative self-joins double the pointers: after k joins every message
knows its 2^k-th ancestor and the score of the messages up to it, so trees of any depth take a logarithmic number
of joins.  The leaves of a tree are ranked by the mean score of their root-to-leaf path; the chosen leaves' paths are
enumerated by the same pointers, and each path is formatted as one conversation.

The template marks each turn as ``<s>[ROLE]role[/ROLE]`` + the text (of other roles than the assistant between
``[INST] `` and `` [/INST]``) + ``</s>``.  Inside roles and texts a backslash is doubled and every control string gets a
backslash after its first character, so none is left, and any backslash can be undone with the character after it.

Defined cases: null texts and roles are empty ones; a message whose parent is missing is a root; messages on a cycle
of replies belong to no path; null tree ids are one tree; equal scores are ranked by the smaller leaf; null and NaN
scores are 0; messages without a node take no part; of messages that repeat a node of a tree the least one by
parent, role, text and score stands for all; further columns are left out, whatever their names.

``paths``, ``format_paths`` and ``read_back`` have one row for each conversation, with all of its text.  ``path_turns``,
``format_pieces`` and ``digests`` do the same for conversations of any length: the turns of a path go through a task in
order, the formatted text is written in pieces of about ``PIECE`` characters, and what is read back is hashed piece by
piece, so no task holds a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from narrascope.llm.rows import bound_batches
from narrascope.session import Scratch

# Workers are reused for many tasks: what Arrow frees goes back to the system at once.
pa.set_memory_pool(pa.system_memory_pool())

#: Code points after which a formatted conversation is continued in another piece; turns stay whole.
PIECE = 1 << 15
#: Rows of a batch that are Python objects at a time.
ROWS = 256

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_CONTROL = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](?:\[INST\] (.*?) \[/INST\]|(.*?))</s>", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the code point spans of the assistant's texts in it: the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = f"<s>[ROLE]{escape(role)}[/ROLE]"
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        else:
            body = f"[INST] {body} [/INST]"
        out.append(f"{head}{body}</s>")
        at += len(out[-1])
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2] if m[2] is not None else m[3])) for m in _TURN.finditer(formatted)]


def path_turns(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``(key, tree, leaf, rank, at, role, text)``: a row for each turn of the best ``branches`` paths of every tree.

    ``messages`` has tree, node, parent, role, text and score.  ``key`` and ``leaf`` tell paths apart, ``at`` orders turns
    from the root on.
    """
    work = Scratch(messages.sparkSession, "chat")
    bound_batches(messages.sparkSession)
    key = F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("")).alias("key")
    score = F.nanvl(F.coalesce(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("score")
    rows = messages.where("node is not null").select(key, "tree", "node", F.struct("parent", "role", "text", score).alias("message"))
    rows = rows.groupBy("key", "node").agg(F.first("tree").alias("tree"), F.min("message").alias("message"))
    nodes = work.save(rows.select("key", "tree", "node", "message.*"), "nodes")
    # a parent that is missing is met as a root's by the first join, and as a turn by the last one
    cur = nodes.select("key", "node", F.col("parent").alias("up"), "score", F.lit(1).cast("long").alias("n"))
    leaves = nodes.select("key", "tree", "node").join(nodes.select("key", F.col("parent").alias("node")), ["key", "node"], "left_anti")
    most, jumps = nodes.count(), []
    done, open_ = cur.where("up is null"), cur.where("up is not null")
    while (1 << len(jumps)) <= 2 * most and not open_.isEmpty():
        jumps.append(open_.select("key", "node", "up"))
        # only messages that haven't reached their root take part
        above = open_.unionAll(done).select("key", F.col("node").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"), F.col("n").alias("steps"))
        nxt = open_.join(above, ["key", "up"], "left").select(
            "key", "node", F.col("next").alias("up"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"), (F.col("n") + F.coalesce("steps", F.lit(0))).alias("n")
        )
        cur = work.save(nxt, f"up-{len(jumps)}")
        done, open_ = done.unionAll(cur.where("up is null")), cur.where("up is not null")
    order = Window.partitionBy("key").orderBy(F.desc("mean"), "node")
    chosen = leaves.join(done, ["key", "node"]).select("key", "tree", "node", (F.col("score") / F.col("n")).alias("mean"))
    chosen = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    at = chosen.select("key", "tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("back"))
    for k, jump in reversed(list(enumerate(jumps))):
        # the longest jumps come first, so most turns are found by the last joins and pass through few; each row and the
        # one that it finds go on from one join, so nothing is read twice and no round is written
        here, there = F.struct("node", "back"), F.struct(F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        both = at.join(jump, ["key", "node"], "left").withColumn("both", F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there)))
        at = both.select("key", "tree", "leaf", "rank", F.explode("both").alias("step")).select("key", "tree", "leaf", "rank", "step.node", "step.back")
    text = nodes.select("key", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return at.join(text, ["key", "node"]).select("key", "tree", "leaf", "rank", (-F.col("back")).alias("at"), "role", "text")


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``(tree, leaf, rank, turns)`` of the best ``branches`` paths of every tree; turns are (role, text) from the root on.

    ``messages`` has tree, node, parent, role, text and score.
    """
    turn = F.struct("at", "role", "text")
    whole = path_turns(messages, branches).groupBy("key", "tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return whole.select("tree", "leaf", "rank", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_paths(found: DataFrame) -> DataFrame:
    """The columns of ``paths`` but the turns, with ``formatted`` and ``loss_spans``."""
    names = [c for c in found.columns if c != "turns"]
    types = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in names)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns.as_py()]) for turns in batch.column(len(names))]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in made], span)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x for x, _ in made], pa.string()), spans], [*names, "formatted", "loss_spans"])

    return found.select(*names, "turns").mapInArrow(run, f"{types}, formatted string, loss_spans array<struct<start:int,end:int>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """All columns with ``turns`` and ``loss_text``, both read from the formatted text and its spans."""
    names = formatted.columns
    types = ", ".join(f"`{c}` {formatted.schema[c].dataType.simpleString()}" for c in names)
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(names.index("formatted")).to_pylist()
            spans = batch.column(names.index("loss_spans")).to_pylist()
            turns = [[{"role": r, "text": t} for r, t in parse_turns(x)] for x in texts]
            loss = ["".join(unescape(x[s["start"] : s["end"]]) for s in ss) for x, ss in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(turns, turn), pa.array(loss, pa.string())], [*names, "turns", "loss_text"])

    return formatted.mapInArrow(run, f"{types}, turns array<struct<role:string,text:string>>, loss_text string")


_PATH = ["key", "tree", "leaf", "rank"]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns))


def _batches(rows: Iterator[tuple], size: int, kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows, the code points of whose last column are ``size`` in a batch, or little more."""
    some, held = [], 0
    for row in rows:
        some.append(dict(zip(kind.names, row)))
        held += 64 + len(row[-1])
        if held >= size:
            yield pa.RecordBatch.from_pylist(some, kind)
            some, held = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, kind)


def format_pieces(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """The formatted conversations of ``path_turns`` as written rows ``(key, tree, leaf, rank, piece, last, start, loss_spans, formatted)``.

    The pieces of a conversation, numbered from 0, make up its formatted text; ``start`` is where a piece begins in it and
    ``loss_spans`` are those of its turns, both counted in the code points of the whole text.
    """
    work = Scratch(turns.sparkSession, "chat-pieces")
    bound_batches(turns.sparkSession)
    span = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "end")]))
    more = [("piece", T.IntegerType()), ("last", T.BooleanType()), ("start", T.LongType()), ("loss_spans", span), ("formatted", T.StringType())]
    schema = T.StructType([*[turns.schema[c] for c in _PATH], *[T.StructField(*x) for x in more]])
    kind = to_arrow_schema(schema)

    def found(batches):
        path, number, start, at, spans, texts = None, 0, 0, 0, [], []
        for *row, role, text in _rows(batches):
            if path is None or row != path:
                if path is not None:
                    yield (*path, number, True, start, spans, "".join(texts))
                path, number, start, at, spans, texts = row, 0, 0, 0, [], []
            elif at - start >= piece:
                yield (*path, number, False, start, spans, "".join(texts))
                number, start, spans, texts = number + 1, at, [], []
            formatted, inside = format_turns([(role, text)])
            spans.extend({"start": at + a, "end": at + b} for a, b in inside)
            texts.append(formatted)
            at += len(formatted)
        if path is not None:
            yield (*path, number, True, start, spans, "".join(texts))

    ordered = turns.repartition("key", "leaf").sortWithinPartitions("key", "leaf", "at").select(*_PATH, "role", "text")
    return work.save(ordered.mapInArrow(lambda batches: _batches(found(batches), 1 << 20, kind), schema), "formatted")


def digests(pieces: DataFrame) -> DataFrame:
    """What is read back from ``format_pieces``: ``(tree, leaf, rank, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``.

    The hashes are of role, line feed, text and line feed of every turn, and of all text under the loss mask.  Only
    conversations of several pieces are shuffled.
    """
    bound_batches(pieces.sparkSession)
    names = [("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("formatted_chars", T.LongType()), ("loss_sha256", T.StringType())]
    schema = T.StructType([*[pieces.schema[c] for c in _PATH[1:]], *[T.StructField(*x) for x in names]])
    kind = to_arrow_schema(schema)

    def found(batches):
        for *path, number, last, start, spans, formatted in _rows(batches):
            if number == 0:
                n, loss_chars, chars, said, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for role, text in parse_turns(formatted):
                said.update(f"{role}\n{text}\n".encode())
                n += 1
            for s in spans:
                text = unescape(formatted[s["start"] - start : s["end"] - start])
                loss.update(text.encode())
                loss_chars += len(text)
            chars += len(formatted)
            if last:
                yield (*path[1:], n, said.hexdigest(), loss_chars, chars, loss.hexdigest())

    def read(rows):
        return rows.mapInArrow(lambda batches: _batches(found(batches), 1 << 20, kind), schema)

    several = pieces.where("piece > 0 or not last")
    out = read(pieces.where("piece = 0 and last"))
    if not several.isEmpty():
        out = out.unionAll(read(several.repartition("key", "leaf").sortWithinPartitions("key", "leaf", "piece")))
    return out


def threads(conversations: DataFrame) -> DataFrame:
    """Reply trees of (conv_id, turn, role, text) rows: every row replies to the one before it by turn, role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "node", F.expr("if(node > 1, node - 1, null)").alias("parent"), "role", "text", F.lit(1.0).alias("score"))
