"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of letters, digits and underscore in any script; ASCII words with an optional contraction.
WORD = r"[\p{L}\p{N}_]+"
ASCII_WORD = r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"
#: Joins the tokens of an n-gram; no token holds it.
JOINER = "\u0001"
#: White space that ``strip`` removes, as Python's does for the common cases.
BLANK = r"[\s\u00a0\u2000-\u200a\u202f\u3000]"


def strip(c) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def words(c) -> Column:
    """Lower-cased words; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def ascii_words(c) -> Column:
    """Lower-cased ASCII words that keep contractions; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(ASCII_WORD), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens; none if there are fewer or n is not positive."""
    if n <= 0:
        return F.array().cast("array<string>")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), JOINER))
    return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<string>"))


def word_count(c) -> Column:
    """Parts between white space."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""))


def sentence_count(c) -> Column:
    """Parts that end in a full stop, question or exclamation mark before white space; at least 1 for a text that isn't blank."""
    flat = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(flat == "", 0).otherwise(F.size(F.filter(F.split(flat, r"(?<=[.!?])\s+"), lambda x: x != "")))


def flatten_lines(c) -> Column:
    """Line breaks as spaces, stripped."""
    return strip(F.regexp_replace(c, "[\r\n]+", " "))


def cache_key(c) -> Column:
    """SHA-1 of the stripped text."""
    return F.sha1(F.encode(strip(c), "UTF-8"))


def with_prefix(instruction: str, c) -> Column:
    return F.concat(F.lit(instruction), c)


def prompt(template: str, *cols) -> Column:
    return F.format_string(template, *cols)


def first_long_section(*sections, least: int = 100) -> Column:
    """The first section of more than ``least`` characters."""
    return F.coalesce(*[F.when(F.length(s) > least, s) for s in sections])


#: Names of the sections that summarise a story, the best first, by language.
SUMMARY_SECTIONS = {
    "de": ("Plot", "Handlung", "Zusammenfassung", "Synopsis", "Inhalt", "Handlungsübersicht", "Zusammenfassung der Handlung"),
    "en": ("Plot", "Summary", "Synopsis", "Plot summary", "Plot Summary", "Story", "Storyline", "Content"),
    "fr": ("Synopsis", "Résumé de l'œuvre", "Résumé", "Le roman", "Synopsis détaillé", "Histoire"),
    "es": ("Trama", "Sinopsis", "Argumento", "Argument"),
    "it": ("Trama", "Contenuto", "Tema"),
}


def summary_section(sections, lang, least: int = 100) -> Column:
    """``(name, text)`` of the first section in the language's order with more than ``least`` characters; ``sections`` is a map."""
    names = F.coalesce(*[F.when(lang == k, F.array(*[F.lit(n) for n in names])) for k, names in SUMMARY_SECTIONS.items()])
    long = F.filter(names, lambda n: F.length(F.try_element_at(sections, n)) > least)
    first = F.get(long, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first.alias("name"), F.try_element_at(sections, first).alias("text")))


def mask_entities(c, entities) -> Column:
    """Every occurrence of each entity's ``text`` replaced by its ``tag``, in the order of the array."""
    return F.aggregate(entities, c, lambda done, e: F.replace(done, e["text"], e["tag"]))


def replace_spans(c, spans, replacement="text") -> Column:
    """Non-overlapping spans (start, end, text) replaced from left to right; a span that overlaps an earlier one is left alone.

    Offsets count characters from 0; the end is excluded.  A span with a null replacement keeps its text.
    """
    ordered = F.array_sort(spans)
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def put(state, s):
        head = F.substring(c, state["at"] + 1, s["start"] - state["at"])
        made = F.struct(F.concat(state["done"], head, s[replacement]).alias("done"), s["end"].cast("int").alias("at"))
        kept = F.struct(F.concat(state["done"], F.substring(c, state["at"] + 1, F.greatest(s["end"] - state["at"], F.lit(0)))).alias("done"), s["end"].cast("int").alias("at"))
        return F.when(s[replacement].isNull(), kept).when(s["start"] >= state["at"], made).otherwise(state)

    return F.aggregate(ordered, start, put, lambda state: F.concat(state["done"], F.substring(c, state["at"] + 1, F.length(c))))


def pseudonym(kind: str, number) -> Column:
    """``kind`` and a capital letter by the number."""
    return F.concat(F.lit(f"{kind} "), F.char(F.lit(65) + F.pmod(number, F.lit(26))))


def join_events(events) -> Column:
    return F.array_join(events, " | ")


def split_events(c) -> Column:
    return F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def intro_and_body(c) -> Column:
    """(intro, body) at the first blank line; a text without one is all intro."""
    parts = F.split(c, "\n\n", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("intro"), F.get(parts, F.lit(1)).alias("body"))


def truncate(tokens: Column, n: int) -> Column:
    return F.slice(tokens, 1, n)


def file_stem(path) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
