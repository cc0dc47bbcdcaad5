"""Reading of model answers: JSON objects in free text, and decisions in several spellings."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

#: Keys that may name the closer text, the aspects and the reason, the default reason, and the aspects with their short names.
CLOSER = ("closer", "chosen_story", "answer", "choice", "winner")
GIVEN = ("aspects", "similarity_aspects")
WHY = ("why", "reason", "explanation")
NO_REASON = "Decision based on narrative aspects."
ASPECTS = {"abstract_theme": "theme", "course_of_action": "action", "outcomes": "outcome"}


def strip_fences(c) -> Column:
    """Without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)^\s*```[A-Za-z]*\s*", ""), r"\s*```\s*$", ""))


def _object(text: str | None) -> str | None:
    """The first balanced ``{...}`` by the depth of braces, those in strings included."""
    depth, begin = 0, -1
    for m in _BRACE.finditer(text or ""):
        if m[0] == "{":
            begin = m.start() if begin < 0 else begin
            depth += 1
        elif begin >= 0:
            depth -= 1
            if depth == 0:
                return text[begin : m.end()]
    return None


_BRACE = re.compile("[{}]")


def _parsed(text: str | None) -> dict | None:
    """The first object of an answer, its keys in the text's order; of repeated keys the last counts."""
    found = _object(text)
    try:
        value = json.loads(found) if found else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


@F.arrow_udf(T.StringType())
def _first_object(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in parts:
        yield pa.array(map(_object, column.to_pylist()), pa.string())


@F.arrow_udf(T.BooleanType())
def _readable(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in parts:
        yield pa.array([_parsed(t) is not None for t in column.to_pylist()], pa.bool_())


def first_object(c) -> Column:
    """The first balanced ``{...}`` by the depth of braces, those in strings included; null without one."""
    return _first_object(strip_fences(c))


def _letter(value) -> str | None:
    """A or B if the value is a text that holds just one of the two letters in either case."""
    held = {x for x in "AB" if isinstance(value, str) and x in value.upper()}
    return held.pop() if len(held) == 1 else None


def _closer(answer: dict) -> str:
    named = (_letter(answer.get(k)) for k in CLOSER)
    inner = [x for x in (next(filter(None, map(_letter, v.values())), None) for v in answer.values() if isinstance(v, dict)) if x]
    lone = set(_LONE.findall(json.dumps(answer, ensure_ascii=False)))
    return next(filter(None, named), None) or (inner[-1] if inner else None) or (lone.pop() if len(lone) == 1 else "A")


_LONE = re.compile(r"\b[AB]\b")


def _read(text: str | None) -> dict:
    answer = _parsed(text) or {}
    given = next((answer[k] for k in GIVEN if answer.get(k)), None)
    names = {str(x).lower() for x in given} if isinstance(given, list) else set()
    flags = {k: bool(given.get(k)) if isinstance(given, dict) else not names.isdisjoint((k, short)) for k, short in ASPECTS.items()}
    why = next((answer[k] for k in WHY if answer.get(k)), NO_REASON)
    return {"closer": _closer(answer), "aspects": flags, "why": why if isinstance(why, str) else str(why)}


_ASPECTS_TYPE = pa.struct([(k, pa.bool_()) for k in ASPECTS])
_DECISION = pa.struct([("closer", pa.string()), ("aspects", _ASPECTS_TYPE), ("why", pa.string())])


@F.arrow_udf(from_arrow_type(_DECISION))
def _decision(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in parts:
        yield pa.array(map(_read, column.to_pylist()), _DECISION)


def decision(c) -> Column:
    """``(closer, aspects, why)`` of an answer, whatever its spelling.

    ``closer`` comes from the first of the keys ``CLOSER`` whose text holds just one of the letters; then from the last
    nested object that has such a text, of which the first in the answer's order counts; then from a lone word A or B in the
    JSON text; else it is A.  Aspects are an object of values that count as true or not, or a list of names, long or short.
    The reason is the first that isn't empty; one that isn't a text is written as Python writes it.  Of repeated keys the
    last counts, NaN and Infinity are numbers, and an answer without an object that can be read is an empty object.
    """
    return _decision(strip_fences(c))


def repaired(c, repair: Callable[[Column], Column]) -> Column:
    """The answer, or what ``repair`` makes of it where it holds no object that can be read; ``repair`` is a model's hook."""
    return F.when(_readable(strip_fences(c)), c).otherwise(repair(c))


def weighted_decision(theme: Column, action: Column, outcome: Column) -> Column:
    """Whether the aspects' weighted sum speaks for A: theme .35, actions .45, outcome .20."""
    return (theme.cast("int") * 0.35 + action.cast("int") * 0.45 + outcome.cast("int") * 0.20).cast("double")


def majority_decision(theme: Column, action: Column, outcome: Column) -> Column:
    return (theme.cast("int") + action.cast("int") + outcome.cast("int")) >= 2


def normal_label(c: Column, kind: str) -> Column:
    """A label as text: truth values as true/false, whole numbers without a fraction, else lower-cased and stripped; empty is ``missing``."""
    if kind == "boolean":
        out = F.when(c, "true").otherwise("false")
        return F.when(c.isNull(), "missing").otherwise(out)
    if kind in ("double", "float"):
        whole = F.when(F.isnan(c), "nan").when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))
        return F.when(c.isNull(), "missing").otherwise(whole)
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isNull() | (text == ""), "missing").otherwise(text)


def discovered_label(columns: list[str], candidates: tuple[str, ...] = ("text_a_is_closer", "label", "gold_label", "y", "target")) -> str | None:
    """The first candidate that is a column."""
    return next((c for c in candidates if c in columns), None)


def entity_ids(claims: Column, prop: str) -> Column:
    """Entity ids of a property in a graph snapshot's claims, those without a value left out."""
    kind = f"struct<{prop}:array<struct<mainsnak:struct<snaktype:string,datavalue:struct<value:struct<id:string>>>>>>"
    snaks = F.from_json(claims, kind)[prop]
    kept = F.filter(snaks, lambda s: (s["mainsnak"]["snaktype"] != "novalue") & s["mainsnak"]["datavalue"]["value"]["id"].isNotNull())
    return F.transform(F.coalesce(kept, F.array().cast(f"array<struct<mainsnak:struct<snaktype:string,datavalue:struct<value:struct<id:string>>>>>")), lambda s: s["mainsnak"]["datavalue"]["value"]["id"])


def has_type(claims: Column, types: tuple[str, ...], prop: str = "P31") -> Column:
    """Whether an entity is an instance of one of several types: the union of one pattern for each."""
    return F.arrays_overlap(entity_ids(claims, prop), F.array(*map(F.lit, types)))
