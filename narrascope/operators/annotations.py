"""Annotated spans of texts: exploding them, keeping those that no other span touches, and replacing them.

Annotators are hooks (``hooks.annotate``); what follows works on rows of spans.  Offsets count characters from 0, ends are
excluded.  Spans of one document meet in one task, sorted, and are never compared in pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrascope.functions.text import pseudonym, replace_spans
from narrascope.operators.stories import mention_replacements
from narrascope.session import Scratch, bound_batches

#: What stands for entities of each kind.
KINDS = {"LOC": "Location", "ORG": "Organization", "MISC": "Entity"}


def entity_rows(docs: DataFrame, by: list[str], found: str = "found") -> DataFrame:
    """``(by, start, end, label, text)`` of the single entities of ``hooks.annotate``."""
    return docs.select(*by, F.explode(f"{found}.entities").alias("e")).select(*by, "e.*")


def mention_rows(docs: DataFrame, by: list[str], found: str = "found") -> DataFrame:
    """``(by, cluster, label, start, end, token, text)`` of the mentions of coreference clusters."""
    return docs.select(*by, F.explode(f"{found}.mentions").alias("m")).select(*by, "m.*")


def untouched(spans: DataFrame, others: DataFrame, by: list[str]) -> DataFrame:
    """The rows of ``spans`` that share no character with a row of ``others`` in the same group.

    Others stand at their start and spans at their end in one order, so the farthest end of the others before a span
    tells.  An empty span is touched where it lies inside another.  Rows with null bounds or a null group are left out.
    """
    known = F.col("start").isNotNull() & F.col("end").isNotNull()
    for c in by:
        known &= F.col(c).isNotNull()
    row = F.struct(*spans.columns)
    mine = spans.where(known).select(*by, F.col("end").alias("__at"), F.lit(0).alias("__kind"), row.alias("__row"), F.lit(None).cast("long").alias("__reach"))
    theirs = others.where(known).select(*by, F.col("start").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(mine.schema["__row"].dataType).alias("__row"), F.col("end").cast("long").alias("__reach"))
    before = Window.partitionBy(*by).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = mine.unionByName(theirs).withColumn("__far", F.max("__reach").over(before))
    free = F.coalesce(F.col("__far") <= F.col("__row.start"), F.lit(True))
    return swept.where((F.col("__kind") == 0) & free).select("__row.*")


def entity_replacements(entities: DataFrame, by: list[str], persons: tuple[str, ...] = ()) -> DataFrame:
    """``replacement`` of each single entity: one for each label and text of a document, the first of a label first.

    Places, organizations and other entities get their kind and a letter, persons a name of ``persons``; from the 27th on, or
    after the last name, and for other labels, texts stay as they are.
    """
    firsts = entities.groupBy(*by, "label", "text").agg(F.min("start").alias("__first"))
    order = Window.partitionBy(*by, "label").orderBy("__first", "text")
    numbered = firsts.withColumn("__n", F.row_number().over(order) - 1)
    kind = F.coalesce(*[F.when(F.col("label") == k, pseudonym(name, F.col("__n"))) for k, name in KINDS.items()])
    kind = F.when(F.col("__n") < 26, kind)
    if persons:
        kind = F.coalesce(kind, F.when(F.col("label") == "PER", F.get(F.array(*[F.lit(p) for p in persons]), F.col("__n"))))
    names = numbered.select(*by, "label", "text", F.coalesce(kind, F.col("text")).alias("replacement"))
    return entities.join(names, [*by, "label", "text"])


def cluster_names(mentions: DataFrame, by: list[str], persons: tuple[str, ...] = ()) -> DataFrame:
    """``name`` of each mention's cluster: by its label and number, null for a label without names."""
    kind = F.coalesce(*[F.when(F.col("label") == k, pseudonym(name, F.col("cluster"))) for k, name in KINDS.items()])
    if persons:
        kind = F.coalesce(kind, F.when(F.col("label") == "PER", F.get(F.array(*[F.lit(p) for p in persons]), F.pmod(F.col("cluster"), F.lit(len(persons))))))
    return mentions.withColumn("name", kind)


def anonymised(docs: DataFrame, by: str = "doc_id", text: str = "text", found: str = "found", persons: tuple[str, ...] = ()) -> DataFrame:
    """``(by, text)`` with the mentions of clusters and the entities outside them replaced.

    Mentions come first: an entity that touches one is left out.  Of spans that overlap, the first counts.  Document ids are
    unique and not null; documents without spans keep their text.  What the annotator found is written once.
    """
    bound_batches(docs.sparkSession)
    docs = Scratch(docs.sparkSession, "spans").save(docs.select(by, text, found), "found")
    mentions = mention_rows(docs, [by], found)
    singles = untouched(entity_rows(docs, [by], found), mentions, [by])
    named = mention_replacements(cluster_names(mentions, [by], persons), [by, "cluster"])
    span = lambda df: df.select(by, F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("replacement").alias("text")).alias("s"))
    spans = span(named).unionAll(span(entity_replacements(singles, [by], persons)))
    gathered = spans.groupBy(by).agg(F.collect_list("s").alias("__spans"))  # one text's spans
    out = docs.select(by, text).join(gathered, by, "left")
    return out.select(by, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(replace_spans(F.col(text), F.col("__spans"))).alias(text))
