"""Queries over stories, samples and the task catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from narrascope.operators import stories
from narrascope.plans import tasks
from narrascope.plans.vector_queries import first_ranks, sts
from narrascope.plans.vector_queries import query as vector_query
from narrascope.plans.views import PAIRS, Catalogue, bucket, table

query = Catalogue()


def story_table(spark, d):
    """Stories from blocks of ten documents: the n-th document of each language is a summary of the block's n-th story."""
    order = Window.partitionBy("k", "lang").orderBy("doc_id")
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 10).alias("k"), "lang", "text", "doc_id").withColumn("n", F.row_number().over(order))
    rows = docs.groupBy("k", "n").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "text")))).alias("summaries_translated"))
    name = F.concat(F.lit("Q"), F.lpad(F.col("k").cast("string"), 6, "0"), F.lit("-"), F.col("n").cast("string"))
    return rows.select(name.alias("wikidata_id"), "summaries_translated", F.array((1900 + F.col("k") % 5).cast("int"), (1950 + F.col("k") % 3).cast("int")).alias("years"))


_ST = "s AS (SELECT *, 'Q' || lpad(CAST(k AS VARCHAR), 6, '0') || '-' || n AS wikidata_id FROM (SELECT doc_id // 10 AS k, lang, text AS summary, row_number() OVER (PARTITION BY doc_id // 10, lang ORDER BY doc_id) AS n FROM documents))"


@query("story_summaries", f"WITH {_ST}, c AS (SELECT *, count(*) OVER (PARTITION BY wikidata_id) AS m FROM s) SELECT wikidata_id, lang, summary FROM c WHERE m >= 2")
def _(spark, d):
    return stories.summary_rows(stories.constructed(story_table(spark, d))).select("wikidata_id", "lang", "summary")


@query("story_labels", f"WITH {_ST}, c AS (SELECT wikidata_id, count(*) AS n FROM s GROUP BY wikidata_id HAVING count(*) >= 2) SELECT count(*) AS stories, CAST(sum(n) AS BIGINT) AS summaries, CAST(0 AS BIGINT) AS low, count(*) - 1 AS high FROM c")
def _(spark, d):
    rows = stories.summary_rows(story_table(spark, d))
    return rows.agg(F.countDistinct("label").alias("stories"), F.count("*").alias("summaries"), F.min("label").alias("low"), F.max("label").alias("high"))


@query("story_years", f"WITH {_ST}, k AS (SELECT DISTINCT wikidata_id, k FROM s) SELECT wikidata_id, k % 5 = 2 AS of_year, k % 5 <> 2 AS not_of_year FROM k")
def _(spark, d):
    y = F.col("years")
    return story_table(spark, d).select("wikidata_id", stories.from_year(y, 1902).alias("of_year"), stories.from_year(y, 1902, True).alias("not_of_year"))


@query("long_summaries", f"WITH {_ST} SELECT wikidata_id, count(*) FILTER (len(regexp_extract_all(summary, '[.]')) >= 5) AS n FROM s GROUP BY wikidata_id")
def _(spark, d):
    counts = F.transform_values("summaries_translated", lambda _, t: F.size(F.regexp_extract_all(t, F.lit("[.]"), F.lit(0))))
    return story_table(spark, d).select("wikidata_id", F.size(stories.long_summaries(F.col("summaries_translated"), counts, 5)).cast("long").alias("n"))


@query("sitelink_filter", f"WITH {_ST} SELECT wikidata_id FROM s WHERE lang IN ('en', 'de') GROUP BY wikidata_id HAVING count(*) = 2")
def _(spark, d):
    return story_table(spark, d).where(stories.has_links(F.map_keys("summaries_translated"), "en", "de")).select("wikidata_id")


@query("shared_genre", "SELECT doc_id, (doc_id % 4 = doc_id % 6 OR FALSE) AND doc_id % 4 <> 0 AS kept FROM documents")
def _(spark, d):
    g = lambda k: F.array(F.concat(F.lit("g"), (F.col("doc_id") % k).cast("string")))
    return table(spark, d, "documents").select("doc_id", stories.one_shared_genre(g(4), g(6), ("g0",)).alias("kept"))


@query("sentence_lines", r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
x AS (SELECT doc_id, i, len(list_filter(string_split(regexp_replace(p, '([.!?])[ \t\v\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda y: y <> '')) AS n FROM p)
SELECT doc_id || '_' || i AS tag, CAST(n AS BIGINT) AS sentences FROM x WHERE n > 0""")
def _(spark, d):
    return stories.sentence_lines(table(spark, d, "documents"), "doc_id", "text").groupBy("tag").agg(F.count("*").alias("sentences"))


@query("rebuilt_text", "SELECT conv_id, string_agg(p, chr(10) ORDER BY b) AS text FROM (SELECT conv_id, turn // 2 AS b, string_agg(text, ' ' ORDER BY turn) AS p FROM conversations GROUP BY 1, 2) GROUP BY conv_id")
def _(spark, d):
    tag = F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.floor(F.col("turn") / 2).cast("string"))
    lines = table(spark, d, "conversations").select(tag.alias("tag"), F.col("turn").cast("int").alias("s"), F.col("text").alias("sentence"))
    return stories.rebuilt_text(lines).select(F.col("key").cast("long").alias("conv_id"), "text")


@query("translation_order", "SELECT DISTINCT lang, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 WHEN 'it' THEN 4 WHEN 'es' THEN 5 ELSE 6 END AS place FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("lang", stories.translation_order(F.col("lang")).cast("int").alias("place")).distinct()


@query("book_movie_counts", "SELECT count(*) FILTER (lang = 'en') AS books, count(*) FILTER (n_chars > 1000) AS movies, count(*) FILTER (lang = 'en' AND n_chars > 1000) AS both, count(*) FILTER (lang <> 'en' AND n_chars <= 1000) AS neither, count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS has_isbn, count(*) FILTER (source LIKE '%a%') AS has_gutenberg FROM documents")
def _(spark, d):
    flags = {"has_isbn": F.col("doc_id") % 3 == 0, "has_gutenberg": F.col("source").contains("a")}
    return stories.metadata_counts(table(spark, d, "documents"), F.col("lang") == "en", F.col("n_chars") > 1000, **flags)


_NAMES = """r AS (SELECT CAST(turn // 2 % 3 AS VARCHAR) AS name, CASE WHEN turn % 2 = 0 THEN 'f' ELSE 'm' END AS sex, conv_id * 1000 + turn AS o, CAST(length(role) AS DOUBLE) AS percent FROM conversations),
n AS (SELECT *, CASE WHEN lag(name) OVER (ORDER BY o) = name THEN 0 ELSE 1 END AS ch FROM r), g AS (SELECT *, sum(ch) OVER (ORDER BY o) AS run FROM n),
s AS (SELECT run, sex, row_number() OVER (PARTITION BY run ORDER BY count(*) DESC, min(o)) AS w FROM g GROUP BY run, sex)"""


@query("name_table", f"WITH {_NAMES} SELECT any_value(g.name) AS name, any_value(s.sex) AS sex, sum(percent) AS percent FROM g JOIN s ON s.run = g.run AND s.w = 1 GROUP BY g.run")
def _(spark, d):
    turn = F.col("turn")
    rows = table(spark, d, "conversations").select(
        (F.floor(turn / 2) % 3).cast("string").alias("name"), F.when(turn % 2 == 0, "f").otherwise("m").alias("sex"), (F.col("conv_id") * 1000 + turn).alias("o"), F.length("role").cast("double").alias("percent")
    )
    return stories.name_table(rows, "o")


_MENTIONS = """m AS (SELECT conv_id, turn, turn * 6 AS token, CASE turn % 4 WHEN 0 THEN 'Anna' WHEN 1 THEN 'she' WHEN 2 THEN 'Anna' || chr(39) || 's' ELSE 'Her' END AS t, CASE WHEN conv_id % 3 > 0 THEN 'N' || conv_id END AS name FROM conversations)"""


@query("mention_replacements", f"WITH {_MENTIONS} SELECT conv_id, turn, CASE WHEN coalesce(lag(token) OVER w + 8 >= token, false) AND lower(t) IN ('she', 'her') THEN t WHEN turn % 4 >= 2 AND name IS NOT NULL THEN name || chr(39) || 's' ELSE name END AS replacement FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY token)")
def _(spark, d):
    turn = F.col("turn")
    said = F.when(turn % 4 == 0, "Anna").when(turn % 4 == 1, "she").when(turn % 4 == 2, "Anna's").otherwise("Her")
    name = F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("N"), F.col("conv_id").cast("string")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", (turn * 6).alias("token"), said.alias("text"), name.alias("name"))
    return stories.mention_replacements(rows, ["conv_id"]).select("conv_id", "turn", "replacement")


@query("genre_counts", "SELECT genre, count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS genre FROM documents UNION ALL SELECT lang FROM documents WHERE doc_id % 7 <> 0) GROUP BY genre")
def _(spark, d):
    genres = F.when(F.col("doc_id") % 7 != 0, F.array("source", "lang"))
    return stories.genre_counts(table(spark, d, "documents").select(genres.alias("g")), "g")


@query("span_gender", "WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'f' ELSE 'm' END AS sex FROM conversations WHERE turn % 4 <> 3), c AS (SELECT conv_id, sex, count(*) AS n, min(turn) AS f FROM t GROUP BY 1, 2) SELECT conv_id, sex FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f) AS k FROM c) WHERE k = 1")
def _(spark, d):
    turn = F.col("turn")
    tokens = table(spark, d, "conversations").select("conv_id", "turn", F.when(turn % 4 == 3, "Nobody").when(turn % 3 == 0, " ANNA").otherwise("bob ").alias("token"))
    names = spark.createDataFrame([("Anna", "f"), ("Bob", "m")], "name string, sex string")
    return stories.gender_of_span(tokens, names, ["conv_id"], "token", "turn")


@query("longest_mention", "SELECT conv_id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, text) AS k FROM conversations) WHERE k = 1")
def _(spark, d):
    return stories.longest_mention(table(spark, d, "conversations"), ["conv_id"], "text")


@query("contrastive_candidates", "SELECT vec_id, CAST(30 AS BIGINT) AS n, CAST(0 AS BIGINT) AS own_batch FROM embeddings")
def _(spark, d):
    rows = stories.contrastive_candidates(table(spark, d, "embeddings").select("vec_id"), "vec_id", 50, 30)
    return rows.groupBy("vec_id").agg(F.count("*").alias("n"), F.count_if(F.floor(F.col("other") / 50) == F.floor(F.col("vec_id") / 50)).alias("own_batch"))


@query("scaled_negatives", f"WITH p AS (SELECT x.vec_id AS a, y.vec_id AS b, x.label = y.label AS same FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1), n AS (SELECT count(*) FILTER (same) AS pos, count(*) FILTER (NOT same) AS neg FROM p) SELECT CASE WHEN same THEN 1 ELSE -1 END AS label, count(*) AS n FROM p, n WHERE same OR {bucket("a || '|' || b", 1000000)} / 1e6 < 2.0 * pos / greatest(neg, 1) GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "embeddings")
    near = e.alias("x").join(e.alias("y"), F.col("y.vec_id") == F.col("x.vec_id") + 1).select(F.col("x.vec_id").alias("a_id"), F.col("y.vec_id").alias("b_id"), (F.col("x.label") == F.col("y.label")).alias("same"))
    return stories.labelled_pairs(near.where("same"), near.where("not same"), 2.0).groupBy("label").agg(F.count("*").alias("n"))


@query("quota_clusters", f"WITH c AS (SELECT conv_id AS cluster, count(*) AS size, conv_id % 3 = 0 AS in_test FROM conversations GROUP BY conv_id), w AS (SELECT *, CASE size WHEN 2 THEN 5 WHEN 3 THEN 5 WHEN 4 THEN 3 WHEN 5 THEN 1 END AS want, row_number() OVER (PARTITION BY size, in_test ORDER BY {bucket('cluster', 1 << 30)}, cluster) AS k FROM c) SELECT cluster, size, in_test FROM w WHERE k <= CASE WHEN in_test THEN round(want * 0.8) ELSE want - round(want * 0.8) END")
def _(spark, d):
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("cluster")).agg(F.count("*").alias("size")).withColumn("in_test", F.col("cluster") % 3 == 0)
    return stories.quota_sample(c, {2: 5, 3: 5, 4: 3, 5: 1})


@query("sample_with_replacement", f"WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY {bucket('doc_id', 1 << 30)}, doc_id) - 1 AS at, count(*) OVER () AS n FROM labels), d AS (SELECT range AS draw FROM range(0, 100)) SELECT doc_id, draw FROM d JOIN p ON p.at = {bucket('draw', 1, 43).replace('% 1)', '% n)')}")
def _(spark, d):
    return stories.with_replacement(table(spark, d, "labels").select("doc_id"), "doc_id", 100)


@query("masked_tokens", f"""WITH t AS (SELECT item_id, string_split(text, ' ') AS t FROM benchmark),
u AS (SELECT item_id, unnest(t) AS w, unnest(range(0, len(t))) AS i FROM t),
b AS (SELECT item_id, i, w, {bucket("item_id || '|' || i || '|a'", 100)} AS a, {bucket("item_id || '|' || i || '|b'", 100)} AS b, {bucket("item_id || '|' || i", 30000)} AS o FROM u)
SELECT item_id, list({{'token': CASE WHEN a >= 15 THEN w WHEN b < 80 THEN '<mask>' WHEN b < 90 THEN 'tok' || o ELSE w END, 'label': CASE WHEN a < 15 THEN w END}} ORDER BY i) AS tokens FROM b GROUP BY item_id""")
def _(spark, d):
    tokens = F.split("text", " ")
    return table(spark, d, "benchmark").select("item_id", stories.masked_tokens(tokens, F.col("item_id")).alias("tokens"))


@query("random_baselines", f"SELECT doc_id, {bucket('doc_id', 2)} = 1 AS label, list_transform(range(0, 8), lambda i: {bucket("doc_id || '|' || i", 1 << 30)} / 1073741824) AS vec FROM labels")
def _(spark, d):
    return table(spark, d, "labels").select("doc_id", stories.random_baseline(F.col("doc_id")).alias("label"), stories.random_vector(F.col("doc_id"), 8).alias("vec"))


@query("task_suite_sts", vector_query.sql["sts_all_mean_wmean"])
def _(spark, d):
    out = tasks.evaluate("STS12", sts(spark, d).withColumnRenamed("sim", "predicted"))
    return out.select("dataset", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"), "n")


@query("task_mrpc", "WITH x AS (SELECT quality AS g, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS p FROM labels) SELECT round(100 * avg(CAST(g = p AS DOUBLE)), 2) AS acc, round(200.0 * count(*) FILTER (g = 1 AND p = 1) / (count(*) FILTER (g = 1) + count(*) FILTER (p = 1)), 2) AS f1, count(*) AS n FROM x")
def _(spark, d):
    rows = table(spark, d, "labels").select(F.col("quality").alias("gold"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("predicted"))
    return tasks.evaluate("MRPC", rows)


@query("task_caption_ranks", f"WITH {PAIRS}, f AS (SELECT q, min(CASE WHEN rel = 1 THEN rank END) - 1 AS f FROM ranked GROUP BY q) SELECT round(100 * avg(CAST(f < 5 AS DOUBLE)), 6) AS recall_at_5, CAST(floor(quantile_cont(f, 0.5)) + 1 AS BIGINT) AS median_rank FROM f WHERE f IS NOT NULL")
def _(spark, d):
    out = tasks.evaluate("ImageCaptionRetrieval", first_ranks(spark, d))
    return out.select(F.round("recall_at_5", 6).alias("recall_at_5"), "median_rank")
