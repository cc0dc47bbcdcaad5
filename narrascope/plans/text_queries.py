"""Queries over texts: triplet reshaping, overlap, length and label statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrascope.functions import html, parsing, similarity, text
from narrascope.operators import corpus, overlap, stats, triplets
from narrascope.plans.views import TT, Catalogue, ascii_tokens, bucket, coverage, grams, jaccard, table, text_triplets, word_tokens
from narrascope.session import share_code

query = Catalogue()


def r6(c):
    return F.round(c, 6)


def text_pairs(spark, d):
    """(doc_id, item_id, anchor, candidate): every document with one benchmark text."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    n = F.lit(items.count())
    return docs.join(items.withColumnRenamed("text", "candidate"), F.col("doc_id") % n == F.col("item_id")).select("doc_id", "item_id", F.col("text").alias("anchor"), "candidate")


_TP = "m AS (SELECT count(*) AS m FROM benchmark), tp AS (SELECT doc_id, item_id, d.text AS anchor, b.text AS candidate FROM documents d JOIN m ON true JOIN benchmark b ON b.item_id = d.doc_id % m.m)"
_TOK = f"tok AS (SELECT doc_id, {ascii_tokens('anchor')} AS a, {ascii_tokens('candidate')} AS b FROM tp)"


@query("triplet_select", f"WITH {TT} SELECT anchor_text, text_a, text_b FROM tt")
def _(spark, d):
    return triplets.texts_only(text_triplets(spark, d))


@query("triplet_training_names", f"WITH {TT} SELECT anchor_text AS sent0, text_a AS sent1, text_b AS hard_neg FROM tt WHERE coalesce(anchor_text, '') <> ''")
def _(spark, d):
    return triplets.as_training(text_triplets(spark, d))


@query("triplet_normalize", f"WITH {TT} SELECT anchor_text AS sent0, CASE WHEN gold THEN text_a ELSE text_b END AS sent1, CASE WHEN gold THEN text_b ELSE text_a END AS hard_neg FROM tt WHERE coalesce(anchor_text, '') <> ''")
def _(spark, d):
    return triplets.normalised(text_triplets(spark, d), F.col("text_a_is_closer"))


@query("triplet_normalize_strict_string", f"WITH {TT}, l AS (SELECT *, CASE i % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'true' WHEN 2 THEN 'False' END AS s FROM tt) SELECT i, CASE WHEN s = 'True' THEN text_a ELSE text_b END AS closer, CASE WHEN s = 'True' THEN text_b ELSE text_a END AS farther FROM l")
def _(spark, d):
    label = F.when(F.col("i") % 4 == 0, "True").when(F.col("i") % 4 == 1, "true").when(F.col("i") % 4 == 2, "False")
    says = triplets.label_says_a(label)
    a, b = F.col("text_a"), F.col("text_b")
    return text_triplets(spark, d).select("i", F.when(says, a).otherwise(b).alias("closer"), F.when(says, b).otherwise(a).alias("farther"))


@query("random_flip", f"WITH {TT}, f AS (SELECT *, {bucket('i', 2)} = 1 AS flip FROM tt) SELECT i, CASE WHEN flip THEN text_b ELSE text_a END AS text_a, CASE WHEN flip THEN text_a ELSE text_b END AS text_b, gold <> flip AS text_a_is_closer FROM f")
def _(spark, d):
    return triplets.flipped(text_triplets(spark, d), F.col("i")).select("i", "text_a", "text_b", "text_a_is_closer")


@query("triplet_expand5", f"""WITH {TT}, p AS (SELECT i, anchor_text AS t0, text_a AS t1, text_b AS t2, substr(anchor_text, 1, 20) AS p0, substr(text_a, 1, 20) AS p1, substr(text_b, 1, 20) AS p2 FROM tt)
SELECT i, 0 AS variant, t0 AS anchor_text, t1 AS text_a, t2 AS text_b FROM p UNION ALL SELECT i, 1, p0, p1, p2 FROM p UNION ALL SELECT i, 2, p0, t1, t2 FROM p UNION ALL SELECT i, 3, t0, p1, t2 FROM p UNION ALL SELECT i, 4, t0, t1, p2 FROM p""")
def _(spark, d):
    rows = text_triplets(spark, d).select("i", *triplets.TEXTS, *[F.substring(c, 1, 20).alias(f"{'anchor' if c == 'anchor_text' else c}_prototype") for c in triplets.TEXTS])
    return triplets.expand5(rows)


@query("triplet_distinct_texts", f"WITH {TT} SELECT DISTINCT t AS text FROM (SELECT anchor_text AS t FROM tt UNION ALL SELECT text_a FROM tt UNION ALL SELECT text_b FROM tt) WHERE t IS NOT NULL")
def _(spark, d):
    return triplets.distinct_texts(text_triplets(spark, d), strip=False)


@query("corpus_distinct_count", f"WITH {TT} SELECT count(DISTINCT t) AS n_texts, count(*) AS n_rows FROM (SELECT anchor_text AS t FROM tt UNION ALL SELECT text_a FROM tt UNION ALL SELECT text_b FROM tt)")
def _(spark, d):
    one = text_triplets(spark, d).select(F.explode(F.array(*triplets.TEXTS)).alias("t"))
    return one.agg(F.countDistinct("t").alias("n_texts"), F.count("*").alias("n_rows"))


def choices(spark, d):
    """Multiple-choice examples from conversations: the first turn and all others, every third as a noun."""
    c = table(spark, d, "conversations")
    per = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    rest = F.slice(F.col("t"), F.lit(2), F.size("t"))
    kind = F.transform(rest, lambda x: F.when(x["turn"] % 3 == 0, "noun").when(x["turn"] % 3 == 1, "random").otherwise("verb"))
    return per.select(F.col("conv_id").alias("ex_id"), F.get("t", F.lit(0))["text"].alias("source"), F.transform(rest, lambda x: x["text"]).alias("choices"), (F.col("conv_id") % 4).cast("int").alias("answer"), kind.alias("types"))


_MC = """t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS p, count(*) OVER (PARTITION BY conv_id) - 1 AS n FROM conversations),
each AS (SELECT s.conv_id AS ex_id, s.text AS anchor_text, a.text AS text_a, o.text AS text_b, CASE o.turn % 3 WHEN 0 THEN 'noun' WHEN 1 THEN 'random' ELSE 'verb' END AS type, CAST(o.p - 1 AS INT) AS b_index
  FROM t s JOIN t a ON a.conv_id = s.conv_id AND a.p = s.conv_id % 4 + 1 JOIN t o ON o.conv_id = s.conv_id AND o.p >= 1 AND o.p <> a.p WHERE s.p = 0)"""


@query("mc_flatten", f"WITH {_MC} SELECT ex_id, anchor_text, text_a, text_b, true AS text_a_is_closer, type, b_index FROM each WHERE type IN ('noun', 'random')")
def _(spark, d):
    return triplets.choices_to_triplets(choices(spark, d))


@query("noun_filter", f"WITH {_MC} SELECT ex_id, b_index FROM each WHERE type = 'noun'")
def _(spark, d):
    return triplets.choices_to_triplets(choices(spark, d)).where("type = 'noun'").select("ex_id", "b_index")


@query("mc_skipped", "WITH c AS (SELECT conv_id, count(*) - 1 AS n FROM conversations GROUP BY conv_id) SELECT count(*) AS n, count(*) FILTER (conv_id % 4 < n) AS kept, count(*) FILTER (conv_id % 4 >= n) AS skipped FROM c")
def _(spark, d):
    ok = (F.col("answer") >= 0) & (F.col("answer") < F.size("choices"))
    return choices(spark, d).agg(F.count("*").alias("n"), F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped"))


@query("missing_anchor_antijoin", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("anchor_text"), "source")
    done = table(spark, d, "labels").select(F.col("doc_id").alias("anchor_text"))
    return triplets.missing_anchors(docs, done).select(F.col("anchor_text").alias("doc_id"), "source")


@query("jaccard_word", f"WITH {_TP}, tok AS (SELECT doc_id, {word_tokens('anchor')} AS a, {word_tokens('candidate')} AS b FROM tp) SELECT doc_id, round({jaccard('a', 'b')}, 6) AS jaccard, CAST(len(a) AS BIGINT) AS n_words FROM tok")
def _(spark, d):
    a, b = text.words(F.col("anchor")), text.words(F.col("candidate"))
    return text_pairs(spark, d).select("doc_id", r6(similarity.jaccard(a, b)).alias("jaccard"), F.size(a).cast("long").alias("n_words"))


@query("jaccard_ascii", f"WITH {_TP}, {_TOK} SELECT doc_id, round({jaccard('a', 'b')}, 6) AS jaccard FROM tok")
def _(spark, d):
    return text_pairs(spark, d).select("doc_id", r6(similarity.jaccard(text.ascii_words(F.col("anchor")), text.ascii_words(F.col("candidate")))).alias("jaccard"))


@query("coverage", f"WITH {_TP}, {_TOK} SELECT doc_id, round({coverage('a', 'b')}, 6) AS anchor_overlap, round({coverage('b', 'a')}, 6) AS candidate_overlap FROM tok")
def _(spark, d):
    a, b = text.ascii_words(F.col("anchor")), text.ascii_words(F.col("candidate"))
    return text_pairs(spark, d).select("doc_id", r6(similarity.coverage(a, b)).alias("anchor_overlap"), r6(similarity.coverage(b, a)).alias("candidate_overlap"))


@query("ngram_jaccard", f"WITH {_TP}, {_TOK}, g AS (SELECT doc_id, {grams('a', 2)} AS a2, {grams('b', 2)} AS b2, {grams('a', 3)} AS a3, {grams('b', 3)} AS b3 FROM tok) SELECT doc_id, round({jaccard('a2', 'b2')}, 6) AS jaccard2, round({jaccard('a3', 'b3')}, 6) AS jaccard3 FROM g")
def _(spark, d):
    a, b = text.ascii_words(F.col("anchor")), text.ascii_words(F.col("candidate"))
    tokens = text_pairs(spark, d).select("doc_id", a.alias("a"), b.alias("b"))
    sets = tokens.select("doc_id", *[F.array_distinct(text.ngrams(F.col(c), n)).alias(f"{c}{n}") for c in "ab" for n in (2, 3)])
    return sets.select("doc_id", *[r6(similarity.set_jaccard(F.col(f"a{n}"), F.col(f"b{n}"))).alias(f"jaccard{n}") for n in (2, 3)])


def _rouge_sql(n: int, source: str, keys: str) -> str:
    return f"""r{n}g AS (SELECT {keys}, g, sum(ca) AS ca, sum(cb) AS cb FROM (
    SELECT {keys}, unnest({grams('a', n)}) AS g, 1 AS ca, 0 AS cb FROM {source} UNION ALL SELECT {keys}, unnest({grams('b', n)}), 0, 1 FROM {source}) GROUP BY {keys}, g),
  r{n} AS (SELECT {keys}, 2.0 * sum(least(ca, cb)) / sum(ca + cb) AS f FROM r{n}g GROUP BY {keys})"""


@query("rouge_f1", f"WITH {_TP}, {_TOK}, {_rouge_sql(1, 'tok', 'doc_id')}, {_rouge_sql(2, 'tok', 'doc_id')} SELECT doc_id, round(coalesce(r1.f, 0), 6) AS rouge_1_f1, round(coalesce(r2.f, 0), 6) AS rouge_2_f1 FROM tok LEFT JOIN r1 USING (doc_id) LEFT JOIN r2 USING (doc_id)")
def _(spark, d):
    out = overlap.pair_metrics(text_pairs(spark, d), ["doc_id"])
    return out.select("doc_id", r6("rouge_1_f1").alias("rouge_1_f1"), r6("rouge_2_f1").alias("rouge_2_f1"))


_METRICS = f"""{TT}, pr AS (SELECT i, 'pos' AS pair, anchor_text AS x, CASE WHEN gold THEN text_a ELSE text_b END AS y FROM tt UNION ALL SELECT i, 'neg', anchor_text, CASE WHEN gold THEN text_b ELSE text_a END FROM tt),
tok AS (SELECT i, pair, {ascii_tokens('x')} AS a, {ascii_tokens('y')} AS b FROM pr), {_rouge_sql(1, 'tok', 'i, pair')}, {_rouge_sql(2, 'tok', 'i, pair')},
g AS (SELECT i, pair, a, b, {grams('a', 2)} AS a2, {grams('b', 2)} AS b2, {grams('a', 3)} AS a3, {grams('b', 3)} AS b3 FROM tok),
met AS (SELECT i, pair, {jaccard('a', 'b')} AS jaccard, {coverage('a', 'b')} AS anchor_overlap, {coverage('b', 'a')} AS candidate_overlap, {jaccard('a2', 'b2')} AS "2gram_jaccard",
  {jaccard('a3', 'b3')} AS "3gram_jaccard", coalesce(r1.f, 0) AS rouge_1_f1, coalesce(r2.f, 0) AS rouge_2_f1, 0.0 AS pos_overlap FROM g LEFT JOIN r1 USING (i, pair) LEFT JOIN r2 USING (i, pair))"""


def triplet_metrics(spark, d):
    t = text_triplets(spark, d)
    gold, a, b = F.col("text_a_is_closer"), F.col("text_a"), F.col("text_b")
    rows = t.select("i", "anchor_text", F.when(gold, a).otherwise(b).alias("closer"), F.when(gold, b).otherwise(a).alias("farther"))
    return overlap.pair_metrics(overlap.to_pairs(rows, ["i"]), ["i", "pair"], unique=overlap.unrepeated(t, ["i"]))


@query("overlap_pair_metrics", f"WITH {_METRICS} SELECT i, pair, " + ", ".join(f'round(CAST("{m}" AS DOUBLE), 6) AS "{m}"' for m in overlap.METRICS) + " FROM met")
def _(spark, d):
    return triplet_metrics(spark, d).select("i", "pair", *[r6(F.col(f"`{m}`")).alias(m) for m in overlap.METRICS])


@query("overlap_summary", f"WITH {_METRICS}, l AS (" + " UNION ALL ".join(f"SELECT pair, '{m}' AS metric, CAST(\"{m}\" AS DOUBLE) AS v FROM met" for m in overlap.METRICS) + ") SELECT pair, metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90, count(*) AS n FROM l GROUP BY pair, metric")
def _(spark, d):
    out = stats.summary(overlap.melted(triplet_metrics(spark, d), ["i", "pair"]), ["pair", "metric"], "value")
    return out.select("pair", "metric", *[r6(c).alias(c) for c in ("mean", "median", "std", "p10", "p90")], "n")


@query("overlap_column_means", f"WITH {_METRICS} SELECT pair, round(avg(jaccard), 6) AS jaccard, round(avg(rouge_1_f1), 6) AS rouge_1_f1 FROM met GROUP BY pair")
def _(spark, d):
    return triplet_metrics(spark, d).groupBy("pair").agg(r6(F.avg("jaccard")).alias("jaccard"), r6(F.avg("rouge_1_f1")).alias("rouge_1_f1"))


_SENT = "CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE 1 + len(regexp_extract_all(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[.!?]\\s+')) END"
_WC = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"


@query("sentence_word_counts", f"SELECT doc_id, CAST({_SENT} AS BIGINT) AS sentences, CAST({_WC} AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS chars FROM documents")
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.sentence_count(t).cast("long").alias("sentences"), text.word_count(t).cast("long").alias("words"), F.length(t).cast("long").alias("chars"))


@query("length_stats", f"WITH l AS (SELECT lang, CAST({_SENT} AS DOUBLE) AS s, CAST({_WC} AS DOUBLE) AS w, CAST(len({word_tokens('text')}) AS DOUBLE) AS t FROM documents), u AS (SELECT lang, 'sentences' AS metric, s AS v FROM l UNION ALL SELECT lang, 'words', w FROM l UNION ALL SELECT lang, 'tokens', t FROM l) SELECT lang, metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90, min(v) AS min, max(v) AS max, count(*) AS n FROM u GROUP BY lang, metric")
def _(spark, d):
    t = F.col("text")
    wide = table(spark, d, "documents").select("lang", text.sentence_count(t).alias("sentences"), text.word_count(t).alias("words"), F.size(text.words(t)).alias("tokens"))
    out = stats.summary(wide.unpivot(["lang"], ["sentences", "words", "tokens"], "metric", "value"), ["lang", "metric"], "value", extremes=True)
    return out.select("lang", "metric", *[r6(c).alias(c) for c in ("mean", "median", "std", "p10", "p90")], "min", "max", "n")


@query("char_length_quantiles", "SELECT round(avg(length(text)), 6) AS mean, CAST(min(length(text)) AS DOUBLE) AS min, CAST(max(length(text)) AS DOUBLE) AS max, round(stddev_pop(length(text)), 6) AS std, " + ", ".join(f"round(quantile_cont(length(text), {q}), 6) AS q{round(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9, 0.95)) + " FROM documents")
def _(spark, d):
    out = stats.quantiles(table(spark, d, "documents").select(F.length("text").alias("n")), "n", (0.25, 0.5, 0.75, 0.9, 0.95))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("token_length_percentiles", f"SELECT CAST(max(n) AS DOUBLE) AS max, " + ", ".join(f"round(quantile_cont(n, {q}), 6) AS q{round(q * 100)}" for q in (0.5, 0.75, 0.9, 0.95, 0.99)) + f" FROM (SELECT len({ascii_tokens('text')}) AS n FROM documents)")
def _(spark, d):
    out = stats.quantiles(table(spark, d, "documents").select(F.size(text.ascii_words(F.col("text"))).alias("n")), "n", (0.5, 0.75, 0.9, 0.95, 0.99))
    return out.select("max", *[r6(f"q{q}").alias(f"q{q}") for q in (50, 75, 90, 95, 99)])


@query("label_stats_pivot", "SELECT lang, count(*) AS total, " + ", ".join(f"count(*) FILTER (quality = {k}) AS \"count::{k}\", round(CAST(count(*) FILTER (quality = {k}) AS DOUBLE) / count(*), 6) AS \"ratio::{k}\"" for k in (0, 1)) + " FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def _(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", F.col("quality").cast("string").alias("q"))
    out = stats.label_pivot(rows, ["lang"], "q", ["0", "1"])
    return out.select("lang", "total", *[(r6(F.col(f"`{c}`")) if c.startswith("ratio") else F.col(f"`{c}`")).alias(c) for c in out.columns[2:]])


@query("label_shares", "SELECT lang, quality, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS ratio FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality")
def _(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return stats.label_shares(rows, ["lang"], "quality").select("lang", "quality", "count", r6("ratio").alias("ratio"))


@query("label_normalize", "SELECT doc_id, CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS as_boolean, CAST(quality AS VARCHAR) AS as_number, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'missing' END AS as_text FROM labels")
def _(spark, d):
    rows = table(spark, d, "labels")
    return rows.select(
        "doc_id", parsing.normal_label(F.col("quality") == 1, "boolean").alias("as_boolean"), parsing.normal_label(F.col("quality").cast("double"), "double").alias("as_number"),
        parsing.normal_label(F.when(F.col("toxic") == 1, " TOXIC ").otherwise("  "), "string").alias("as_text"),
    )


@query("label_mode", "SELECT lang, source, count FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY count DESC, first) AS k FROM (SELECT lang, source, count(*) AS count, min(doc_id) AS first FROM documents GROUP BY lang, source)) WHERE k = 1")
def _(spark, d):
    return stats.first_mode(table(spark, d, "documents"), ["lang"], "source", "doc_id")


@query("length_histogram", f"WITH c AS (SELECT {_WC} AS v, count(*) AS n FROM documents GROUP BY 1) SELECT CAST(r.v AS BIGINT) AS value, coalesce(n, 0) AS count FROM (SELECT unnest(range(0, (SELECT max(v) FROM c) + 1)) AS v) r LEFT JOIN c ON c.v = r.v")
def _(spark, d):
    return stats.histogram(table(spark, d, "documents").select(text.word_count(F.col("text")).alias("v")), "v")


@query("text_cleaning", "SELECT page_id, trim(regexp_replace(url, '[\\r\\n]+', ' ', 'g')) AS flat, lower(replace(regexp_extract(url, '([^/]+)$', 1), '?', '_')) AS tail, 'query: ' || url AS prompted FROM pages")
def _(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", text.flatten_lines(url).alias("flat"), F.lower(F.replace(F.regexp_extract(url, "([^/]+)$", 1), F.lit("?"), F.lit("_"))).alias("tail"), text.with_prefix("query: ", url).alias("prompted"))


@query("cache_keys", "SELECT doc_id, sha1(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS key FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.cache_key(F.col("text")).alias("key"))


@query("entity_mask", "SELECT doc_id, replace(replace(replace(text, 'the', 'PER'), 'and', 'LOC'), 'PER', 'ORG') AS masked FROM documents")
def _(spark, d):
    pairs = [("the", "PER"), ("and", "LOC"), ("PER", "ORG")]
    entities = F.array(*[F.struct(F.lit(a).alias("text"), F.lit(b).alias("tag")) for a, b in pairs])
    return table(spark, d, "documents").select("doc_id", text.mask_entities(F.col("text"), entities).alias("masked"))


@query("span_replacement", "SELECT doc_id, '[A]' || substr(text, 5, 6) || '[C]' || substr(text, 16) AS masked FROM documents")
def _(spark, d):
    spans = [(0, 4, "[A]"), (2, 8, "[B]"), (10, 15, "[C]")]
    arr = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("text")) for a, b, t in spans])
    return table(spark, d, "documents").select("doc_id", text.replace_spans(F.col("text"), arr).alias("masked"))


@query("pseudonyms", "SELECT doc_id, 'Location ' || chr(CAST(65 + doc_id % 26 AS INT)) AS name FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.pseudonym("Location", F.col("doc_id")).alias("name"))


@query("intro_body", "SELECT doc_id, string_split(replace(text, '. ', chr(10) || chr(10)), chr(10) || chr(10))[1] AS intro FROM documents")
def _(spark, d):
    parts = text.intro_and_body(F.replace(F.col("text"), F.lit(". "), F.lit("\n\n")))
    return table(spark, d, "documents").select("doc_id", parts["intro"].alias("intro"))


@query("sections", "SELECT doc_id, CASE WHEN n_chars % 2 = 0 AND length(text) > 1000 THEN text WHEN length(source) > 100 THEN source END AS section FROM documents")
def _(spark, d):
    first = F.when(F.col("n_chars") % 2 == 0, F.when(F.length("text") > 1000, F.col("text")))
    return table(spark, d, "documents").select("doc_id", text.first_long_section(first, F.col("source")).alias("section"))


@query("events_joined", "SELECT conv_id, string_agg(role, ' | ' ORDER BY turn) AS joined, count(*) AS n FROM conversations GROUP BY conv_id")
def _(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]).alias("e"))
    joined = text.join_events(F.col("e"))
    return rows.select("conv_id", joined.alias("joined"), F.size(text.split_events(joined)).cast("long").alias("n"))


_BLANK = r"[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}]"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


#: The articles of the pages hold a heading and paragraphs, some without an end.
_BARE = "regexp_replace(string_split(x, '</p>')[1], '<[^>]*>', '', 'g')"
for _name, _sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", "\u00a0"), ("amp", "&")):
    _BARE = f"replace({_BARE}, '&{_name};', '{_sign}')"


@query("html_to_plain", f"""
WITH articles AS (SELECT page_id, string_split(string_split(html, '<article>')[2], '</article>')[1] AS a FROM pages),
lines AS (SELECT page_id, list_transform(string_split(a, '<p>')[2:], lambda x: {_stripped(_BARE)} || chr(10)) AS l FROM articles)
SELECT page_id, {_stripped("array_to_string(l, '')")} AS plain FROM lines""")
def _(spark, d):
    share_code(spark)
    article = F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1)
    return table(spark, d, "pages").select("page_id", html.html_to_plain(article).alias("plain"))


@query("summary_section", "SELECT doc_id, CASE WHEN lang IN ('en', 'de') AND length(text) > 100 THEN 'Plot' WHEN lang IN ('de', 'fr') AND length(source) > 100 THEN 'Synopsis' END AS name FROM documents")
def _(spark, d):
    sections = F.create_map(F.lit("Synopsis"), "source", F.lit("Plot"), "text")
    return table(spark, d, "documents").select("doc_id", text.summary_section(sections, F.col("lang"))["name"].alias("name"))


@query("content_overlap", f"WITH {_TP}, t AS (SELECT doc_id, {ascii_tokens('anchor')} AS a, {ascii_tokens('candidate')} AS b FROM tp), l AS (SELECT doc_id, list_transform(list_filter(a, lambda x: length(x) > 3), lambda x: rtrim(x, 's')) AS a, list_transform(list_filter(b, lambda x: length(x) > 3), lambda x: rtrim(x, 's')) AS b FROM t) SELECT doc_id, round({jaccard('a', 'b')}, 6) AS pos_overlap FROM l")
def _(spark, d):
    # a stand-in for a tagger: longer words without a final s
    lemmas = lambda c: F.transform(F.filter(text.ascii_words(c), lambda x: F.length(x) > 3), lambda x: F.rtrim(x, F.lit("s")))
    return overlap.pair_metrics(text_pairs(spark, d), ["doc_id"], lemmas).select("doc_id", r6("pos_overlap").alias("pos_overlap"))


@query("hard_negative", f"""WITH c AS (SELECT d.doc_id AS anchor_id, b.item_id AS pos, {ascii_tokens('d.text')} AS a, {ascii_tokens('b.text')} AS h, b.text AS hypothesis, CASE WHEN b.item_id % 3 = 0 THEN 'Contradiction' ELSE 'neutral' END AS label
  FROM documents d, benchmark b WHERE coalesce(b.text, '') <> ''),
s AS (SELECT *, {jaccard('a', 'h')} + CASE WHEN label = 'Contradiction' THEN 0.05 ELSE 0 END AS score FROM c)
SELECT anchor_id, pos, hypothesis, label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, pos) AS k FROM s) WHERE k = 1""")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("anchor_id"), F.col("text").alias("anchor"), F.lit(0).alias("part"))
    label = F.when(F.col("item_id") % 3 == 0, "Contradiction").otherwise("neutral")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("pos"), F.col("text").alias("hypothesis"), label.alias("label"), F.lit(0).alias("part"))
    out = overlap.hard_negatives(docs, items, "part")
    return out.select("anchor_id", "pos", "hypothesis", "label", r6("score").alias("score"))


@query("negative_pairs", f"SELECT a_id, b_id, -1 AS label FROM (SELECT doc_id AS a_id, lead(doc_id) OVER (ORDER BY {bucket('doc_id', 1 << 30)}, doc_id) AS b_id FROM documents) WHERE b_id IS NOT NULL")
def _(spark, d):
    return corpus.negative_pairs(table(spark, d, "documents"), "doc_id", "text").select("a_id", "b_id", "label")
