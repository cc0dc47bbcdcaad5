"""Queries over corpora: vocabularies, tf-idf, sequences, clusters, splits, reports, decisions and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrascope.functions import parsing, similarity, text
from narrascope.operators import clusters, corpus, stats, stories, vectors
from narrascope.operators.ordering import numbered
from narrascope.operators.word_blocks import best_by_words
from narrascope.plans.views import Catalogue, ascii_tokens, bucket, table, word_tokens
from narrascope.session import share_code

query = Catalogue()


def r6(c):
    return F.round(c, 6)


def item_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.posexplode(text.words(F.col("text"))).alias("pos", "word"))


def doc_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(text.ascii_words(F.col("text"))).alias("word"))


_IT = f"it AS (SELECT item_id, unnest({word_tokens('text')}) AS word FROM benchmark)"
_DT = f"dt AS (SELECT doc_id, unnest({ascii_tokens('text')}) AS word FROM documents)"


@query("vocab_counts", f"WITH {_DT}, c AS (SELECT word AS token, count(*) AS count FROM dt GROUP BY word HAVING count(*) >= 3) SELECT token, count, CAST(row_number() OVER (ORDER BY count DESC, token) + 3 AS BIGINT) AS token_id FROM c UNION ALL SELECT * FROM (VALUES ('<s>', 0::BIGINT, 0::BIGINT), ('</s>', 0, 1), ('<p>', 0, 2), ('<unk>', 0, 3))")
def _(spark, d):
    return corpus.vocabulary(doc_tokens(spark, d), "word", 3, ("<s>", "</s>", "<p>", "<unk>"))


_TFIDF = f"""{_IT}, tf AS (SELECT item_id, word, count(*) AS tf FROM it GROUP BY item_id, word), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
raw AS (SELECT item_id, word, tf * (ln((1 + (SELECT count(DISTINCT item_id) FROM it)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (word)),
tfidf AS (SELECT item_id, word, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM raw)"""


@query("tfidf_weights", f"WITH {_TFIDF} SELECT item_id, word, round(weight, 6) AS weight FROM tfidf")
def _(spark, d):
    return corpus.tf_idf(item_tokens(spark, d), "item_id", "word").select("item_id", "word", r6("weight").alias("weight"))


@query("tfidf_p1", f"WITH {_TFIDF}, s AS (SELECT a.item_id AS q, b.item_id AS c, sum(a.weight * b.weight) AS sim FROM tfidf a JOIN tfidf b ON a.word = b.word AND a.item_id <> b.item_id GROUP BY 1, 2) SELECT q, c, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, c) AS k FROM s) WHERE k = 1")
def _(spark, d):
    w = corpus.tf_idf(item_tokens(spark, d), "item_id", "word")
    rows = w.groupBy(F.col("item_id").alias("id")).agg(F.collect_list(F.struct("word", "weight")).alias("w")).select("id", F.col("w.word").alias("words"), F.col("w.weight").alias("weights"))
    best = best_by_words(rows, rows, "dot", digits=9, exclude_self=True)
    return best.select("q", "c", r6("score").alias("sim"))


def word_vectors(spark, d):
    """All vectors of the vectors table, each for one word: the most common words in turn."""
    v = corpus.vocabulary(doc_tokens(spark, d), "word")
    return v.join(table(spark, d, "embeddings"), F.col("token_id") == F.col("vec_id")).select(F.col("token").alias("word"), F.col("embedding").alias("vec"))


_WV = f"{_DT}, v AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS k FROM dt GROUP BY word), wv AS (SELECT word, CAST(embedding AS DOUBLE[]) AS vec FROM v JOIN embeddings ON vec_id = k)"


@query("vocabulary_semi_join", f"WITH {_WV} SELECT doc_id, count(*) AS known FROM dt WHERE word IN (SELECT word FROM wv) GROUP BY doc_id")
def _(spark, d):
    known = doc_tokens(spark, d).join(word_vectors(spark, d).select("word"), "word", "left_semi")
    return known.groupBy("doc_id").agg(F.count("*").alias("known"))


@query("mean_vector", f"WITH {_WV}, m AS (SELECT doc_id, k, avg(x) AS m FROM (SELECT doc_id, unnest(range(1, 65)) AS k, unnest(vec) AS x FROM dt JOIN wv USING (word)) GROUP BY doc_id, k), g AS (SELECT doc_id, list(m ORDER BY k) AS vec FROM m GROUP BY doc_id) SELECT d.doc_id, round(coalesce(g.vec[1], 0), 6) AS first, round(coalesce(g.vec[64], 0), 6) AS last, round(coalesce(list_sum(g.vec), 0), 6) AS total FROM (SELECT DISTINCT doc_id FROM dt) d LEFT JOIN g USING (doc_id)")
def _(spark, d):
    rows = corpus.mean_vectors(doc_tokens(spark, d), word_vectors(spark, d), "doc_id", "word", 64)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return rows.select("doc_id", r6(F.get("vec", F.lit(0))).alias("first"), r6(F.get("vec", F.lit(63))).alias("last"), r6(total).alias("total"))


_BM = """s AS (SELECT vec_id // 10 AS doc, vec_id % 10 AS pos, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.doc AS a_doc, a.pos AS a_pos, b.doc AS b_doc, b.pos AS b_pos, list_cosine_similarity(a.v, b.v) AS sim FROM s a JOIN s b ON b.doc = a.doc + 1),
pa AS (SELECT a_doc, b_doc, avg(m) AS precision FROM (SELECT a_doc, b_doc, a_pos, max(sim) AS m FROM p GROUP BY ALL) GROUP BY ALL),
pb AS (SELECT a_doc, b_doc, avg(m) AS recall FROM (SELECT a_doc, b_doc, b_pos, max(sim) AS m FROM p GROUP BY ALL) GROUP BY ALL)"""


@query("bestmatch_prf", f"WITH {_BM} SELECT a_doc, b_doc, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM pa JOIN pb USING (a_doc, b_doc)")
def _(spark, d):
    # documents of ten sentences each, every one against the next
    part = lambda side, shift: table(spark, d, "embeddings").select((F.floor(F.col("vec_id") / 10) - shift).alias("k"), (F.col("vec_id") % 10).alias(f"{side}_pos"), F.col("embedding").alias(f"{side}_v"))
    both = part("a", 0).join(part("b", 1), "k")
    pairs = both.select(F.col("k").alias("a_doc"), "a_pos", (F.col("k") + 1).alias("b_doc"), "b_pos", similarity.cosine(F.col("a_v"), F.col("b_v")).alias("sim"))
    return corpus.best_match(pairs).select("a_doc", "b_doc", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("ordered_concat", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS joined FROM conversations GROUP BY conv_id")
def _(spark, d):
    return corpus.ordered_text(table(spark, d, "conversations"), ["conv_id"], "turn", "text", "\n", "joined")


@query("consecutive_runs", "WITH c AS (SELECT *, CASE WHEN lag(k) OVER w = k THEN 0 ELSE 1 END AS ch FROM (SELECT conv_id, turn, turn // 2 % 2 AS k FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, CAST(sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM c")
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", (F.floor(F.col("turn") / 2) % 2).alias("k"))
    return corpus.runs(rows, ["conv_id"], "turn", "k").select("conv_id", "turn", F.col("run").cast("long").alias("run"))


@query("name_runs", "WITH c AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS ch FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT conv_id, role, turn, length(text) AS n, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c) SELECT conv_id, CAST(run AS BIGINT) AS run, any_value(role) AS role, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY conv_id, run")
def _(spark, d):
    rows = corpus.runs(table(spark, d, "conversations"), ["conv_id"], "turn", "role")
    return rows.groupBy("conv_id", F.col("run").cast("long").alias("run")).agg(F.first("role").alias("role"), F.sum(F.length("text")).alias("n"))


@query("adjacent_pairs", "SELECT conv_id, turn AS a, coalesce(lead(turn) OVER w, lag(turn) OVER w, turn) AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(spark, d):
    return corpus.adjacent_pairs(table(spark, d, "conversations"), "conv_id", "turn", "turn")


@query("cluster_pairs", "SELECT a.conv_id, a.turn AS a, b.turn AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn")
def _(spark, d):
    return corpus.cluster_pairs(table(spark, d, "conversations"), "conv_id", "turn")


@query("recent_mentions", "SELECT conv_id, turn, coalesce(lag(p) OVER w + 8 >= p, false) AS recent FROM (SELECT conv_id, turn, turn * 5 + conv_id % 5 * (turn % 2) AS p FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY p)")
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * 5 + F.col("conv_id") % 5 * (F.col("turn") % 2)).alias("p"))
    return stories.recent_mentions(rows, ["conv_id"], "p").select("conv_id", "turn", "recent")


@query("keep_first_dedup", "WITH p AS (SELECT a.label AS g, b.vec_id AS item, max(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1, 2) SELECT e.label AS \"group\", e.vec_id AS item FROM embeddings e LEFT JOIN p ON p.item = e.vec_id WHERE coalesce(sim, 0) <= 0.3")
def _(spark, d):
    e = table(spark, d, "embeddings")
    items = e.select(F.col("label").alias("group"), F.col("vec_id").alias("item"))
    # of each item the best of all that stand before it in its group is enough
    best = vectors.best_of_label(e, e, "label", earlier=True).join(items, F.col("q") == F.col("item"))
    return corpus.keep_first(items, best.select("group", F.col("c").alias("a"), F.col("q").alias("b"), "sim"), 0.3)


@query("inverse_cdf_draw", "WITH w AS (SELECT lang AS g, source AS item, sum(n_chars) AS w FROM documents GROUP BY 1, 2), c AS (SELECT g, item, CAST(sum(w) OVER (PARTITION BY g ORDER BY item) AS DOUBLE) / sum(w) OVER (PARTITION BY g) AS f FROM w), d AS (SELECT g, draw, (draw * 2 + 1) / 40.0 AS u FROM (SELECT DISTINCT lang AS g FROM documents), range(0, 20) r(draw)) SELECT d.g, d.draw, min_by(item, f) AS item FROM d JOIN c ON c.g = d.g AND c.f >= d.u GROUP BY d.g, d.draw")
def _(spark, d):
    docs = table(spark, d, "documents")
    weights = docs.groupBy(F.col("lang").alias("g"), F.col("source").alias("item")).agg(F.sum("n_chars").cast("double").alias("w"))
    draws = docs.select(F.col("lang").alias("g")).distinct().crossJoin(spark.range(20).withColumnRenamed("id", "draw")).withColumn("u", (F.col("draw") * 2 + 1) / F.lit(40.0))
    return corpus.inverse_cdf(weights, "g", "item", "w", draws).select("g", "draw", "item")


@query("split_80_10_10", f"WITH b AS (SELECT doc_id, {bucket('doc_id', 100)} AS b FROM documents) SELECT CASE WHEN doc_id % 50 = 0 THEN 'test' WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'dev' ELSE 'test' END AS split, count(*) AS n FROM b GROUP BY 1")
def _(spark, d):
    forced = F.col("doc_id") % 50 == 0
    rows = table(spark, d, "documents").select("doc_id", corpus.split_column(F.col("doc_id"), forced_test=forced).alias("split"))
    return rows.groupBy("split").agg(F.count("*").alias("n"))


@query("interleaved", f"WITH p AS (SELECT doc_id, CAST(quality = 1 AS INT) AS side, row_number() OVER (PARTITION BY quality = 1 ORDER BY {bucket('doc_id', 1 << 30)}, doc_id) AS k, count(*) OVER (PARTITION BY quality = 1) AS n FROM labels) SELECT doc_id, side, round((k - 0.5) / n, 9) AS at FROM p")
def _(spark, d):
    rows = table(spark, d, "labels").select("doc_id", "quality")
    out = corpus.interleaved(rows.where("quality <> 1").drop("quality"), rows.where("quality = 1").drop("quality"), "doc_id")
    return out.select("doc_id", "side", F.round("at", 9).alias("at"))


@query("stratified_folds", f"SELECT quality, fold, count(*) AS n FROM (SELECT quality, (row_number() OVER (PARTITION BY quality ORDER BY {bucket('doc_id', 1 << 30)}, doc_id) - 1) % 5 AS fold FROM labels) GROUP BY 1, 2")
def _(spark, d):
    return corpus.stratified_folds(table(spark, d, "labels"), "quality", "doc_id", 5).groupBy("quality", "fold").agg(F.count("*").alias("n"))


@query("quota_sample", "SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 7")
def _(spark, d):
    return corpus.quota(table(spark, d, "documents"), "lang", [F.desc("n_chars"), "doc_id"], 7).select("lang", "doc_id", "n_chars")


@query("resume_antijoin", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, d):
    return corpus.resume(table(spark, d, "documents"), table(spark, d, "labels").where("quality = 1"), "doc_id").select("doc_id")


@query("map_upsert", "SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'good' ELSE d.lang END AS lang_value, CAST(1 + CAST(l.doc_id IS NOT NULL AND l.quality = 0 AS INT) AS BIGINT) AS entries FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.create_map(F.lit("lang"), "lang").alias("m"))
    more = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, F.create_map(F.lit("lang"), F.lit("good"))).otherwise(F.create_map(F.lit("other"), F.lit("x"))).alias("m"))
    out = corpus.upsert_maps(rows, more, "doc_id", "m")
    return out.select("doc_id", F.element_at("m", F.lit("lang")).alias("lang_value"), F.size("m").cast("long").alias("entries"))


_CC = """e AS (SELECT conv_id AS a, turn * 17 + conv_id // 3 AS b FROM conversations),
z AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(a, b) AS (SELECT a, b FROM z UNION SELECT r.a, z.b FROM reach r JOIN z ON r.b = z.a)"""


@query("connected_components", f"WITH RECURSIVE {_CC} SELECT a AS node, least(a, min(b)) AS component FROM reach WHERE a IN (SELECT a FROM z WHERE a <> b) GROUP BY a")
def _(spark, d):
    edges = table(spark, d, "conversations").select(F.col("conv_id").alias("a"), (F.col("turn") * 17 + F.floor(F.col("conv_id") / 3)).alias("b"))
    return clusters.connected_components(edges, "a", "b")


@query("cluster_sizes", "WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT n AS size, count(*) AS clusters, round((SELECT avg(n) FROM c), 6) AS mean FROM c GROUP BY n")
def _(spark, d):
    return stats.group_sizes(table(spark, d, "conversations"), ["conv_id"]).select("size", "clusters", r6("mean").alias("mean"))


@query("metadata_profile", "SELECT count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de' OR lang = 'fr') AS de_or_fr, count(*) FILTER (lang NOT IN ('en', 'de', 'fr')) AS neither, count(*) FILTER (text LIKE '%the%' AND n_chars > 1000) AS long_the FROM documents")
def _(spark, d):
    lang = F.col("lang")
    return table(spark, d, "documents").agg(
        F.count_if(lang == "en").alias("en"), F.count_if(lang.isin("de", "fr")).alias("de_or_fr"), F.count_if(~lang.isin("en", "de", "fr")).alias("neither"),
        F.count_if(F.col("text").contains("the") & (F.col("n_chars") > 1000)).alias("long_the"),
    )


@query("language_counts", "SELECT lang, count(*) AS before, count(DISTINCT text) AS after FROM documents GROUP BY lang")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("before"), F.countDistinct("text").alias("after"))


@query("classification_report", """WITH x AS (SELECT quality AS g, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS p FROM labels),
k AS (SELECT label, count(*) FILTER (g = label AND p = label) AS tp, count(*) FILTER (g = label) AS support, count(*) FILTER (p = label) AS said FROM x, (VALUES (0), (1)) v(label) GROUP BY label),
c AS (SELECT CAST(label AS VARCHAR) AS label, tp / said AS precision, tp / support AS recall, 2 * tp / (said + support) AS f1, support FROM k)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM (SELECT * FROM c
 UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), sum(support) FROM c UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM c)""")
def _(spark, d):
    rows = table(spark, d, "labels").select(F.col("quality").alias("g"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("p"))
    return stats.classification_report(rows, "g", "p").select("label", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("f1_mse", "WITH x AS (SELECT quality AS g, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS p FROM labels) SELECT round(200.0 * count(*) FILTER (g = 1 AND p = 1) / (count(*) FILTER (g = 1) + count(*) FILTER (p = 1)), 6) AS f1, round(avg((g - p) * (g - p)), 6) AS mse FROM x")
def _(spark, d):
    rows = table(spark, d, "labels").select(F.col("quality").alias("g"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("p"))
    return rows.agg(r6(stats.binary_f1(F.col("g"), F.col("p"))).alias("f1"), r6(stats.squared_error(F.col("g"), F.col("p"))).alias("mse"))


@query("score_table_average", "WITH s AS (SELECT label, avg(CAST(vec_id % 7 AS DOUBLE)) AS v FROM embeddings WHERE label < 8 GROUP BY label) SELECT round(avg(coalesce(v, 0)), 6) AS average, count(*) AS tasks FROM (SELECT DISTINCT label FROM embeddings) LEFT JOIN s USING (label)")
def _(spark, d):
    e = table(spark, d, "embeddings")
    s = e.where("label < 8").groupBy("label").agg(F.avg((F.col("vec_id") % 7).cast("double")).alias("v"))
    return e.select("label").distinct().join(s, "label", "left").agg(r6(F.avg(F.coalesce("v", F.lit(0.0)))).alias("average"), F.count("*").alias("tasks"))


@query("cloze_choice", "SELECT vec_id, CASE WHEN s1 < s2 THEN 1 ELSE 0 END AS chosen, CASE WHEN s1 < s2 THEN 2 ELSE 1 END AS exported FROM (SELECT a.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s1, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS s2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2)")
def _(spark, d):
    from narrascope.functions.similarity import cosine

    e = table(spark, d, "embeddings")
    rows = e.select("vec_id", F.col("embedding").alias("x"))
    for k, name in ((1, "y"), (2, "z")):
        rows = rows.join(e.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(name)), "vec_id")
    later = cosine(F.col("x"), F.col("y")) < cosine(F.col("x"), F.col("z"))
    return rows.select("vec_id", F.when(later, 1).otherwise(0).alias("chosen"), F.when(later, 2).otherwise(1).alias("exported"))


@query("aspect_vote", "SELECT vec_id, round(CAST(0.35 * t + 0.45 * a + 0.20 * o AS DOUBLE), 6) AS weighted, t + a + o >= 2 AS majority FROM (SELECT vec_id, vec_id % 2 AS t, vec_id // 2 % 2 AS a, vec_id // 4 % 2 AS o FROM embeddings)")
def _(spark, d):
    flag = lambda k: F.floor(F.col("vec_id") / k) % 2 == 1
    args = (flag(1), flag(2), flag(4))
    return table(spark, d, "embeddings").select("vec_id", r6(parsing.weighted_decision(*args)).alias("weighted"), parsing.majority_decision(*args).alias("majority"))


#: Answers of models, and (closer, abstract_theme, course_of_action, outcomes, why) by the rules that they follow.
ANSWERS = [
    ('```json\n{"closer": "B", "aspects": {"abstract_theme": true, "outcomes": false}, "why": "because"}\n```', "B", True, False, False, "because"),
    ("nothing to read", "A", False, False, False, parsing.NO_REASON),
    ('so: {"answer": "text b", "aspects": ["abstract_theme", "outcomes"], "reason": "plot"} end', "B", True, False, True, "plot"),
    ("The closer is B.", "A", False, False, False, parsing.NO_REASON),
    ('{"winner": "A", "why": ""}', "A", False, False, False, parsing.NO_REASON),
    ('{"result": {"x": "none", "y": "story_b"}}', "B", False, False, False, parsing.NO_REASON),
    ('{"one": {"x": "b"}, "two": {"x": "a", "y": "b"}, "three": {"x": "or"}}', "A", False, False, False, parsing.NO_REASON),
    ('{"closer": "AB", "choice": " b "}', "B", False, False, False, parsing.NO_REASON),
    ('{"verdict": ["the", "B"], "similarity_aspects": ["Theme", "action", 3]}', "B", True, True, False, parsing.NO_REASON),
    ('{"closer": true, "aspects": {}, "similarity_aspects": {"outcomes": "no", "course_of_action": 0}, "explanation": 5}', "A", False, False, True, "5"),
    ('{"A": 1, "B": 2}', "A", False, False, False, parsing.NO_REASON),
    ('{"chosen_story": "Story B", "closer": null}', "B", False, False, False, parsing.NO_REASON),
    ('{"closer": "B", broken', "A", False, False, False, parsing.NO_REASON),
    ('{"r": {"z": "B", "a": "A"}}', "B", False, False, False, parsing.NO_REASON),
    ('{"closer": "A", "closer": "B"}', "B", False, False, False, parsing.NO_REASON),
    ('{"x": NaN, "closer": "B"}', "B", False, False, False, parsing.NO_REASON),
    ('{"why": ["one", 2], "winner": "b"}', "B", False, False, False, "[''one'', 2]"),
]
_ANSWERS = ", ".join(f"({k}, '{c}', {t}, {a}, {o}, '{w}')" for k, (_, c, t, a, o, w) in enumerate(ANSWERS))


@query("decision_normalize", f"SELECT vec_id, closer, abstract_theme, course_of_action, outcomes, why FROM embeddings JOIN (VALUES {_ANSWERS}) v(k, closer, abstract_theme, course_of_action, outcomes, why) ON k = vec_id % {len(ANSWERS)}")
def _(spark, d):
    share_code(spark)
    raw = F.get(F.array(*[F.lit(a[0]) for a in ANSWERS]), (F.col("vec_id") % len(ANSWERS)).cast("int"))
    got = parsing.decision(raw)
    return table(spark, d, "embeddings").select("vec_id", got.alias("d")).select("vec_id", "d.closer", "d.aspects.abstract_theme", "d.aspects.course_of_action", "d.aspects.outcomes", "d.why")


_LETTER = "CASE WHEN contains(upper({0}), 'A') AND NOT contains(upper({0}), 'B') THEN 'A' WHEN contains(upper({0}), 'B') AND NOT contains(upper({0}), 'A') THEN 'B' END"
_WORD = r"regexp_matches(t, '(^|[^\p{{L}}\p{{M}}\p{{N}}_]){0}($|[^\p{{L}}\p{{M}}\p{{N}}_])')"


@query("decision_records", f"""
WITH said AS (SELECT doc_id, text, {_LETTER.format("source")} AS s, {_LETTER.format("lang")} AS l, regexp_replace(text, '[\x00-\x1F]', 'n', 'g') AS t FROM documents),
lone AS (SELECT *, {_WORD.format("A")} AS a, {_WORD.format("B")} AS b FROM said)
SELECT doc_id, coalesce(s, l, CASE WHEN a AND NOT b THEN 'A' WHEN b AND NOT a THEN 'B' END, 'A') AS closer,
  CASE WHEN text = '' THEN '{parsing.NO_REASON}' ELSE text END AS why FROM lone""")
def _(spark, d):
    # answers made of whole documents: their source and language in this order, and the text as the reason
    share_code(spark)
    answer = F.to_json(F.struct(F.struct(F.col("source").alias("z"), F.col("lang").alias("a")).alias("r"), F.col("text").alias("why")))
    docs = table(spark, d, "documents").select("doc_id", parsing.decision(F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).alias("d"))
    return docs.select("doc_id", "d.closer", "d.why")


@query("json_props", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events")
def _(spark, d):
    props = F.col("props")
    return table(spark, d, "events").select("event_id", F.get_json_object(props, "$.k").alias("k"), F.get_json_object(props, "$").isNotNull().alias("valid"))


@query("json_claims", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [] WHEN doc_id % 3 = 1 THEN ['Q' || doc_id] ELSE ['Q' || doc_id, 'Q7'] END AS ids FROM documents")
def _(spark, d):
    snak = lambda kind, x: F.format_string('{"mainsnak":{"snaktype":"%s","datavalue":{"value":{"id":"%s"}}}}', F.lit(kind), x)
    own = F.concat(F.lit("Q"), F.col("doc_id").cast("string"))
    parts = F.when(F.col("doc_id") % 3 == 0, snak("novalue", own)).when(F.col("doc_id") % 3 == 1, snak("value", own)).otherwise(F.concat_ws(",", snak("value", own), snak("value", F.lit("Q7"))))
    claims = F.concat(F.lit('{"P136":['), parts, F.lit("]}"))
    return table(spark, d, "documents").select("doc_id", parsing.entity_ids(claims, "P136").alias("ids"))


@query("genre_overlap", "SELECT a.doc_id, CAST(len(list_intersect(a.g, b.g)) AS BIGINT) AS shared, len(list_intersect(a.g, b.g)) = 1 AND NOT list_contains(a.g, 'g0') AS kept FROM (SELECT doc_id, ['g' || doc_id % 4, 'g' || doc_id % 6] AS g FROM documents) a JOIN (SELECT doc_id - 1 AS doc_id, ['g' || doc_id % 4, 'g' || doc_id % 6] AS g FROM documents) b USING (doc_id)")
def _(spark, d):
    g = F.array(*[F.concat(F.lit("g"), (F.col("doc_id") % k).cast("string")) for k in (4, 6)])
    docs = table(spark, d, "documents")
    a, b = docs.select("doc_id", g.alias("a")), docs.select((F.col("doc_id") - 1).alias("doc_id"), g.alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return a.join(b, "doc_id").select("doc_id", shared.cast("long").alias("shared"), ((shared == 1) & ~F.array_contains("a", "g0")).alias("kept"))


@query("set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) UNION ALL SELECT 'intersect', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'concat', count(*) FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels)")
def _(spark, d):
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    named = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b).distinct(), "concat": b.unionAll(b)}
    out = None
    for name, df in named.items():
        row = df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
        out = row if out is None else out.unionAll(row)
    return out


@query("longest_and_shortest", "SELECT lang, max_by(doc_id, {'a': length(text), 'b': -doc_id}) AS longest, min_by(doc_id, {'a': length(text), 'b': doc_id}) AS shortest FROM documents GROUP BY lang")
def _(spark, d):
    n = F.length("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.max_by("doc_id", F.struct(n, -F.col("doc_id"))).alias("longest"), F.min_by("doc_id", F.struct(n, F.col("doc_id"))).alias("shortest"))


@query("length_sorted_batches", "SELECT doc_id, (row_number() OVER (ORDER BY length(text), doc_id) - 1) // 64 AS batch FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    return numbered(docs, ["n", "doc_id"], "place").select("doc_id", F.floor((F.col("place") - 1) / 64).alias("batch"))


@query("lineitem_tied_spearman", "WITH r AS (SELECT l_returnflag AS flag, avg(x) OVER (PARTITION BY l_returnflag, l_quantity) AS rx, avg(y) OVER (PARTITION BY l_returnflag, l_discount) AS ry FROM (SELECT l_returnflag, l_quantity, l_discount, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_discount) AS y FROM lineitem)) SELECT flag, round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM r GROUP BY flag")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity", "l_discount")
    return stats.correlations(rows, ["flag"], "l_quantity", "l_discount").select("flag", r6("spearman").alias("spearman"), "n")
