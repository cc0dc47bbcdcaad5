"""Extension points for models: encoders, pair scorers and language model steps as Arrow functions.

A model is a plain function on lists of texts; it is loaded once for each Python worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.session import share_code

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = 32) -> Encoder:
    """A deterministic stand-in for a model: signed counts of hashed words."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                out[i, h % dim] += 1 if h >> 60 & 1 else -1
        return out

    return encode


def encode(load: Callable[[], Encoder], c: Column, batch: int = 64, normalise: bool = True) -> Column:
    """Vectors of texts; nulls and empty texts are encoded as a single space."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in parts:
            filled = [t if t else " " for t in texts.fillna(" ")]
            rows = [model(filled[k : k + batch]) for k in range(0, len(filled), batch)]
            x = np.concatenate(rows) if rows else np.zeros((0, 1))
            if normalise:
                size = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(size == 0, 1, size)
            yield pd.Series(list(x))

    return run(c)


def encode_distinct(rows: DataFrame, columns: list[str], load: Callable[[], Encoder], **options) -> DataFrame:
    """A lookup ``(text, embedding)``: every different text of the columns is encoded once."""
    share_code(rows.sparkSession)
    texts = rows.select(F.explode(F.array(*columns)).alias("text")).where("text is not null").distinct()
    return texts.select("text", encode(load, F.col("text"), **options).alias("embedding"))


def with_vectors(rows: DataFrame, text: str, load: Callable[[], Encoder], vector: str = "embedding", **options) -> DataFrame:
    """``rows`` with a vector in place of the text; every different text is encoded once, and null texts have none.

    Texts are exchanged once, on their way to the encoder; rows meet their vectors by the SHA-256 of the texts.
    """
    digest = F.unhex(F.sha2(F.col("text"), 256)).alias("__digest")
    lookup = encode_distinct(rows, [text], load, **options).select(digest, F.col("embedding").alias(vector))
    named = rows.withColumn("__digest", F.unhex(F.sha2(F.col(text), 256))).drop(text)
    return named.join(lookup, "__digest", "left").drop("__digest")


def score_pairs(load: Callable[[], Callable[[list[str], list[str]], list[float]]], a: Column, b: Column) -> Column:
    """Scores of text pairs by a cross-encoder."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for x, y in parts:
            yield pd.Series(model(x.fillna("").tolist(), y.fillna("").tolist()), dtype=float)

    return run(a, b)


def complete(load: Callable[[], Callable[[str, int], str]], prompt: Column, tokens: int = 256, growth: float = 1.8, tries: int = 4) -> Column:
    """Answers of a language model; an empty answer is asked for again with a larger token budget, then is null."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for prompts in parts:
            out = []
            for p in prompts:
                budget, answer = tokens, ""
                for _ in range(tries):
                    answer = model(p, int(budget)) if p is not None else ""
                    if answer:
                        break
                    budget *= growth
                out.append(answer or None)
            yield pd.Series(out, dtype=object)

    return run(prompt)


def subword_counts(load: Callable[[], Callable[[str], int]], c: Column) -> Column:
    """Numbers of subword tokens by a tokenizer."""

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = load()
        for texts in parts:
            yield texts.fillna("").map(count).astype("int64")

    return run(c)


#: A text's single entities (start, end, label), and its coreference clusters: a label and the mentions' (start, end).
Annotated = tuple[list[tuple[int, int, str]], list[tuple[str, list[tuple[int, int]]]]]
Annotator = Callable[[list[str]], list[Annotated]]

ANNOTATED = (
    "struct<entities:array<struct<start:int,end:int,label:string,text:string>>,"
    "mentions:array<struct<cluster:int,label:string,start:int,end:int,token:int,text:string>>>"
)
_ENTITY = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("text", pa.string())])
_MENTION = pa.struct([("cluster", pa.int32()), ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("token", pa.int32()), ("text", pa.string())])
_SPANS = pa.struct([("entities", pa.list_(_ENTITY)), ("mentions", pa.list_(_MENTION))])


def annotate(load: Callable[[], Annotator], c: Column, batch: int = 64) -> Column:
    """Entities and coreference mentions of texts as arrays of spans; a mention's ``token`` is the number of words before it.

    Null texts have no spans; spans outside the text or without a character are left out.
    """

    def spans(text: str, found: Annotated) -> dict:
        inside = lambda a, b: 0 <= a < b <= len(text)
        words = [m.start() for m in re.finditer(r"\S+", text)]
        entities = [{"start": a, "end": b, "label": label, "text": text[a:b]} for a, b, label in found[0] if inside(a, b)]
        mentions = [
            {"cluster": k, "label": label, "start": a, "end": b, "token": int(np.searchsorted(words, a)), "text": text[a:b]}
            for k, (label, own) in enumerate(found[1]) for a, b in own if inside(a, b)
        ]
        return {"entities": entities, "mentions": mentions}

    @F.arrow_udf(ANNOTATED)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for column in parts:
            # spans of a few texts at a time are Python objects
            out = [pa.array([], _SPANS)]
            for k in range(0, len(column), batch):
                some = [t or "" for t in column.slice(k, batch).to_pylist()]
                out.append(pa.array(list(map(spans, some, model(some))), _SPANS))
            yield pa.concat_arrays(out)

    return run(c)


def capital_annotator(least: int = 3) -> Annotator:
    """A deterministic stand-in for a tagger: runs of capitalised words are entities, labelled by the first letter; capitalised
    words that stand at least ``least`` times, and the pronoun-like words after them, are clusters."""
    labels = ("LOC", "ORG", "MISC", "PER")

    def annotate(texts: list[str]) -> list[Annotated]:
        out = []
        for t in texts:
            label = lambda w: labels[ord(w[0]) % 4]
            entities = [(m.start(), m.end(), label(m[0])) for m in re.finditer(r"[A-Z]\w+(?: [A-Z]\w+)*", t)]
            where: dict[str, list[tuple[int, int]]] = {}
            for m in re.finditer(r"[A-Z]\w+", t):
                where.setdefault(m[0], []).append((m.start(), m.end()))
            out.append((entities, [(label(w), spans) for w, spans in where.items() if len(spans) >= least]))
        return out

    return annotate
