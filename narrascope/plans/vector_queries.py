"""Queries over vectors: triplets, similarity joins, retrieval metrics, correlations, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrascope.functions import similarity
from narrascope.operators import losses, retrieval, stats, vectors
from narrascope.plans.views import PAIRS, VT, Catalogue, table, vec_triplets

query = Catalogue()


def scored(spark, d):
    """Vector triplets with their similarities: the ids are looked up three times."""
    lookup = table(spark, d, "embeddings").select(F.col("vec_id").alias("text"), "embedding")
    rows = vectors.lookup_embeddings(vec_triplets(spark, d), lookup, {"i": "vi", "a": "va", "b": "vb"})
    return vectors.triplet_similarities(rows, F.col("vi"), F.col("va"), F.col("vb"))


def nearest(spark, d):
    """Each vector's nearest other one (q, c, sim, ql, cl)."""
    e = table(spark, d, "embeddings")
    return vectors.pair_scores(e, e, top=1, label="label")


def per_query(spark, d, ks=(1, 5, 10)):
    """Metrics of each vector as a query for those of its label."""
    e = table(spark, d, "embeddings")
    return vectors.rank_metrics(e, e, ks)


def first_ranks(spark, d):
    """Each vector's rank of the first other one of its label (q, first)."""
    e = table(spark, d, "embeddings")
    return vectors.relevant_ranks(e, e, first=True).select("q", F.get("ranks", F.lit(0)).alias("first"))


def r6(c):
    return F.round(c, 6)


@query("triplet_accuracy", f"WITH {VT} SELECT round(avg(CAST((sim_a > sim_b) = gold AS DOUBLE)), 6) AS accuracy, round(avg(CASE WHEN gold THEN sim_a - sim_b ELSE sim_b - sim_a END), 6) AS margin, round(avg(CASE WHEN gold THEN sim_a ELSE sim_b END), 6) AS pos_sim, round(avg(CASE WHEN gold THEN sim_b ELSE sim_a END), 6) AS neg_sim, count(*) AS n FROM vs")
def _(spark, d):
    out = vectors.triplet_accuracy(scored(spark, d))
    return out.select(*[r6(c).alias(c) for c in ("accuracy", "margin", "pos_sim", "neg_sim")], "n")


@query("triplet_predictions", f"WITH {VT} SELECT i, a, b, gold, round(sim_a, 6) AS sim_a, round(sim_b, 6) AS sim_b, sim_a > sim_b AS predicted FROM vs")
def _(spark, d):
    return scored(spark, d).select("i", "a", "b", "gold", r6("sim_a").alias("sim_a"), r6("sim_b").alias("sim_b"), "predicted")


@query("cosine_pairs", "SELECT a.vec_id AS q, b.vec_id AS c, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS sim, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    e = table(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("q"), F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("q"), F.col("vec_id").alias("c"), F.col("embedding").alias("y"))
    sim = similarity.cosine(F.col("x"), F.col("y"))
    return a.join(b, "q").select("q", "c", r6(sim).alias("sim"), r6(1 - sim).alias("distance"))


@query("self_similarity_topk", f"WITH {PAIRS} SELECT q, c, round(sim, 6) AS sim, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.search(e, e, 5, -2.0).select("q", "c", r6("sim").alias("sim"), "rank")


@query("search_threshold", f"WITH {PAIRS} SELECT q, c, round(sim, 6) AS sim, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 3 AND sim >= 0.3")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.search(e, e, 3, 0.3).select("q", "c", r6("sim").alias("sim"), "rank")


@query("inner_product_search", "SELECT q, c, round(sim, 6) AS sim, CAST(rank AS INT) AS rank FROM (SELECT a.vec_id AS q, b.vec_id AS c, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 10 = 0) WHERE rank <= 2")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.search(e.where("vec_id % 10 = 0"), e, 2, -1e9, measure="inner", exclude_self=False).select("q", "c", r6("sim").alias("sim"), "rank")


@query("p_at_1", f"WITH {PAIRS} SELECT round(avg(CAST(rel AS DOUBLE)), 6) AS p_at_1, count(*) AS n FROM ranked WHERE rank = 1")
def _(spark, d):
    return nearest(spark, d).agg(r6(F.avg((F.col("ql") == F.col("cl")).cast("double"))).alias("p_at_1"), F.count("*").alias("n"))


@query("p_at_1_zero_self", f"WITH {PAIRS} SELECT round(avg(CAST(CASE WHEN sim > 0 THEN rel ELSE 1 END AS DOUBLE)), 6) AS p_at_1, count(*) AS n FROM ranked WHERE rank = 1")
def _(spark, d):
    # the query itself stands in with similarity 0, and is of its own label
    right = (F.col("sim") <= 0) | (F.col("ql") == F.col("cl"))
    return nearest(spark, d).agg(r6(F.avg(right.cast("double"))).alias("p_at_1"), F.count("*").alias("n"))


_PER = f"""WITH {PAIRS},
per AS (
  SELECT q, any_value(r) AS r, sum(CASE WHEN rel = 1 THEN CAST(hits AS DOUBLE) / rank ELSE 0 END) / any_value(r) AS ap,
    sum(rel / log2(rank + 1)) / list_sum(list_transform(range(1, any_value(r)::BIGINT + 1), lambda k: 1 / log2(k + 1))) AS ndcg,
    CAST(sum(CASE WHEN rank <= r THEN rel ELSE 0 END) AS DOUBLE) / any_value(r) AS rp, min(CASE WHEN rel = 1 THEN rank END) AS f,
    sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) / 5.0 AS p5, sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) / 10.0 AS p10
  FROM ranked WHERE r > 0 GROUP BY q)"""


@query("map_score", _PER + " SELECT round(avg(ap), 6) AS map, count(*) AS n FROM per")
def _(spark, d):
    return retrieval.mean_metrics(per_query(spark, d)).select(r6("map").alias("map"), "n")


@query("ndcg", _PER + " SELECT q, round(ndcg, 6) AS ndcg FROM per")
def _(spark, d):
    return per_query(spark, d).select("q", r6("ndcg").alias("ndcg"))


@query("r_precision", _PER + " SELECT q, round(rp, 6) AS r_precision, CAST(f AS INT) AS first_hit FROM per")
def _(spark, d):
    return per_query(spark, d).select("q", r6("r_precision").alias("r_precision"), "first_hit")


@query("p_at_k_n", _PER + " SELECT CAST(r AS BIGINT) AS k, round(avg(rp), 6) AS p_at_n, count(*) AS n FROM per GROUP BY r")
def _(spark, d):
    per = per_query(spark, d).groupBy(F.col("r").alias("k")).agg(F.avg("r_precision").alias("p_at_n"), F.count("*").alias("n"))
    return per.select("k", r6("p_at_n").alias("p_at_n"), "n")


@query("retrieval_summary", _PER + " SELECT round(avg(ap), 6) AS map, round(avg(ndcg), 6) AS ndcg, round(avg(rp), 6) AS r_precision, round(avg(CAST(f = 1 AS DOUBLE)), 6) AS hits_at_1, round(avg(p5), 6) AS p_at_5, round(avg(p10), 6) AS p_at_10, count(*) AS n FROM per")
def _(spark, d):
    out = retrieval.mean_metrics(per_query(spark, d, (5, 10)), (5, 10))
    return out.select(*[r6(c).alias(c) for c in ("map", "ndcg", "r_precision", "hits_at_1", "p_at_5", "p_at_10")], "n")


@query("recall_at_k_medr", f"WITH {PAIRS}, f AS (SELECT q, min(CASE WHEN rel = 1 THEN rank END) - 1 AS f FROM ranked GROUP BY q) SELECT round(100 * avg(CAST(f < 1 AS DOUBLE)), 6) AS recall_at_1, round(100 * avg(CAST(f < 5 AS DOUBLE)), 6) AS recall_at_5, round(100 * avg(CAST(f < 10 AS DOUBLE)), 6) AS recall_at_10, CAST(floor(quantile_cont(f, 0.5)) + 1 AS BIGINT) AS median_rank, count(*) AS n FROM f WHERE f IS NOT NULL")
def _(spark, d):
    out = retrieval.recall_of_first(first_ranks(spark, d))
    return out.select(*[r6(c).alias(c) for c in ("recall_at_1", "recall_at_5", "recall_at_10")], "median_rank", "n")


@query("chunked_recall", f"WITH {PAIRS}, chunked AS (SELECT q // 100 AS chunk, q, c, sim, rel, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS rank FROM pairs WHERE q // 100 = c // 100), f AS (SELECT chunk, q, min(CASE WHEN rel = 1 THEN rank END) - 1 AS f FROM chunked GROUP BY chunk, q), per AS (SELECT chunk, 100 * avg(CAST(f < 5 AS DOUBLE)) AS r5, floor(quantile_cont(f, 0.5)) + 1 AS m FROM f WHERE f IS NOT NULL GROUP BY chunk) SELECT round(avg(r5), 6) AS recall_at_5, round(avg(m), 6) AS median_rank, count(*) AS chunks FROM per")
def _(spark, d):
    # pairs are made inside chunks of a hundred only
    side = lambda x: table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("chunk"), F.col("vec_id").alias(x), F.col("label").alias(f"{x}l"), F.col("embedding").alias(f"{x}v"))
    near = side("q").join(side("c"), "chunk").where("q <> c").select("q", "c", similarity.cosine(F.col("qv"), F.col("cv")).alias("sim"), (F.col("ql") == F.col("cl")).alias("rel"))
    first = retrieval.ranked(near).groupBy("q").agg((F.min(F.when(F.col("rel") == 1, F.col("rank"))) - 1).alias("f")).where("f is not null")
    per = first.groupBy(F.floor(F.col("q") / 100).alias("chunk")).agg((100 * F.avg((F.col("f") < 5).cast("double"))).alias("r5"), (F.floor(F.percentile("f", F.lit(0.5))) + 1).alias("m"))
    return per.agg(r6(F.avg("r5")).alias("recall_at_5"), r6(F.avg("m")).alias("median_rank"), F.count("*").alias("chunks"))


@query("distractor_eval", f"WITH {PAIRS}, few AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS k FROM pairs WHERE q % 5 = 0) SELECT round(avg(CAST(rel = 1 AND c % 5 = 0 AS DOUBLE)), 6) AS hits_at_1, count(*) AS n FROM few WHERE k = 1")
def _(spark, d):
    e = table(spark, d, "embeddings")
    top = vectors.pair_scores(e.where("vec_id % 5 = 0"), e, top=1)
    # distractors' labels are moved out of the queries' range
    label = F.when(F.col("vec_id") % 5 == 0, F.col("label")).otherwise(F.col("label") + 1000)
    hit = top.join(e.select(F.col("vec_id").alias("q"), F.col("label").alias("ql")), "q").join(e.select(F.col("vec_id").alias("c"), label.alias("cl")), "c")
    return hit.agg(r6(F.avg((F.col("ql") == F.col("cl")).cast("double"))).alias("hits_at_1"), F.count("*").alias("n"))


@query("aligned_retrieval", "WITH h AS (SELECT count(*) // 2 AS h FROM embeddings), p AS (SELECT a.vec_id AS q, b.vec_id - h AS c, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a, embeddings b, h WHERE a.vec_id < h AND b.vec_id >= h), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS k FROM p) SELECT q, CAST(k AS INT) AS rank FROM r WHERE q = c")
def _(spark, d):
    e = table(spark, d, "embeddings")
    half = e.count() // 2
    left, right = e.where(F.col("vec_id") < half), e.where(F.col("vec_id") >= half).withColumn("vec_id", F.col("vec_id") - half)
    ranks = vectors.relevant_ranks(left, right, F.col("vec_id"), first=True, exclude_self=False)
    return ranks.select("q", F.get("ranks", F.lit(0)).cast("int").alias("rank"))


@query("caption_best_of_five", "WITH x AS (SELECT *, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id // 5 AS image, b.vec_id AS c, list_cosine_similarity(a.v, b.v) AS sim, a.vec_id // 5 = b.vec_id // 5 AS own FROM x a, x b WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 > 0), r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY sim DESC, c) AS k FROM p), f AS (SELECT image, min(k) - 1 AS f FROM r WHERE own GROUP BY image) SELECT round(100 * avg(CAST(f < 1 AS DOUBLE)), 6) AS recall_at_1, round(100 * avg(CAST(f < 10 AS DOUBLE)), 6) AS recall_at_10, CAST(floor(quantile_cont(f, 0.5)) + 1 AS BIGINT) AS median_rank, count(*) AS n FROM f")
def _(spark, d):
    # of five vectors in a row the first is an image, the others are its captions; the best placed one counts
    e = table(spark, d, "embeddings")
    image = F.floor(F.col("vec_id") / 5)
    ranks = vectors.relevant_ranks(e.where("vec_id % 5 = 0"), e.where("vec_id % 5 > 0"), image, first=True, exclude_self=False)
    out = retrieval.recall_of_first(ranks.select(F.get("ranks", F.lit(0)).alias("first")))
    return out.select(r6("recall_at_1").alias("recall_at_1"), r6("recall_at_10").alias("recall_at_10"), "median_rank", "n")


@query("silhouette", f"WITH {PAIRS}, m AS (SELECT q, ql, cl, avg(1 - sim) AS m FROM pairs GROUP BY q, ql, cl), s AS (SELECT q, max(CASE WHEN ql = cl THEN m END) AS a, min(CASE WHEN ql <> cl THEN m END) AS b FROM m GROUP BY q) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n FROM s")
def _(spark, d):
    sums = vectors.label_distances(table(spark, d, "embeddings"), "label")
    mean = sums.select("q", F.col("ql").alias("q_label"), F.col("cl").alias("c_label"), (F.col("total") / F.col("n")).alias("m"))
    return retrieval.mean_silhouette(mean).select(r6("silhouette").alias("silhouette"), "n")


@query("sim_delta_top3", f"WITH {VT}, d AS (SELECT i, a, b, sim_a - sim_b AS delta FROM vs) (SELECT 'high' AS side, i, a, b, round(delta, 6) AS delta FROM d ORDER BY d.delta DESC, i LIMIT 3) UNION ALL (SELECT 'low', i, a, b, round(delta, 6) FROM d ORDER BY d.delta, i LIMIT 3)")
def _(spark, d):
    rows = scored(spark, d).select("i", "a", "b", (F.col("sim_a") - F.col("sim_b")).alias("delta"))
    side = lambda name, order: rows.orderBy(order, "i").limit(3).select(F.lit(name).alias("side"), "i", "a", "b", r6("delta").alias("delta"))
    return side("high", F.desc("delta")).unionByName(side("low", F.col("delta")))


@query("top20_pairs", f"WITH {PAIRS} SELECT q, c, round(sim, 6) AS sim FROM (SELECT q, c, sim FROM pairs WHERE q < c ORDER BY sim DESC, q, c LIMIT 20)")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.best_pairs(e, 20).select("q", "c", r6("sim").alias("sim"))


_STS = """sts AS (SELECT a.label AS dataset, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim,
    CAST(a.label = b.label AS INT) + (a.vec_id % 5) / 10.0 AS gold
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""
_RANKED = """, rk AS (SELECT *, avg(x) OVER (PARTITION BY dataset, sim) AS rs, avg(y) OVER (PARTITION BY dataset, gold) AS rg
  FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY sim) AS x, row_number() OVER (PARTITION BY dataset ORDER BY gold) AS y FROM sts))"""


def sts(spark, d):
    e = table(spark, d, "embeddings")
    a, b = e.select("vec_id", F.col("label").alias("dataset"), F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("other"), F.col("embedding").alias("y"))
    gold = (F.col("dataset") == F.col("other")).cast("int") + (F.col("vec_id") % 5) / F.lit(10.0)
    return a.join(b, "vec_id").select("dataset", similarity.cosine_or_zero(F.col("x"), F.col("y")).alias("sim"), gold.alias("gold"))


@query("pearson", f"WITH {_STS} SELECT dataset, round(coalesce(corr(sim, gold), 0), 6) AS pearson, count(*) AS n FROM sts GROUP BY dataset")
def _(spark, d):
    return stats.correlations(sts(spark, d), ["dataset"], "sim", "gold").select("dataset", r6("pearson").alias("pearson"), "n")


@query("spearman", f"WITH {_STS} {_RANKED} SELECT dataset, round(coalesce(corr(rs, rg), 0), 6) AS spearman, count(*) AS n FROM rk GROUP BY dataset")
def _(spark, d):
    return stats.correlations(sts(spark, d), ["dataset"], "sim", "gold").select("dataset", r6("spearman").alias("spearman"), "n")


@query("sts_all_mean_wmean", f"""WITH {_STS} {_RANKED},
each AS (SELECT CAST(dataset AS VARCHAR) AS dataset, corr(sim, gold) AS pearson, corr(rs, rg) AS spearman, count(*) AS n FROM rk GROUP BY dataset),
al AS (SELECT 'all' AS dataset, corr(sim, gold) AS pearson, corr(rs, rg) AS spearman, count(*) AS n FROM (
  SELECT *, avg(x) OVER (PARTITION BY sim) AS rs, avg(y) OVER (PARTITION BY gold) AS rg FROM (SELECT sim, gold, row_number() OVER (ORDER BY sim) AS x, row_number() OVER (ORDER BY gold) AS y FROM sts)))
SELECT dataset, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, CAST(n AS BIGINT) AS n FROM (
  SELECT * FROM each UNION ALL SELECT * FROM al UNION ALL SELECT 'mean', avg(pearson), avg(spearman), sum(n) FROM each
  UNION ALL SELECT 'wmean', sum(pearson * n) / sum(n), sum(spearman * n) / sum(n), sum(n) FROM each)""")
def _(spark, d):
    return stats.correlation_suite(sts(spark, d), "dataset", "sim", "gold").select("dataset", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"), "n")


@query("pair_features", f"WITH {VT} SELECT i, list_transform(list_concat(list_transform(range(1, 65), lambda k: abs(vi[k] - va[k])), list_transform(range(1, 65), lambda k: vi[k] * va[k])), lambda x: round(x, 6) + 0.0) AS features, CAST(256 AS BIGINT) AS wide FROM vt")
def _(spark, d):
    rows = scored(spark, d)
    f = similarity.pair_features(F.col("vi"), F.col("va"))
    return rows.select("i", F.transform(f, lambda x: F.round(x, 6)).alias("features"), F.size(similarity.inference_features(F.col("vi"), F.col("va"))).cast("long").alias("wide"))


@query("normalised_dot", f"WITH {VT} SELECT i, round(list_inner_product(va, vb) / sqrt(list_inner_product(va, va)) / sqrt(list_inner_product(vb, vb)), 6) AS sim FROM vt")
def _(spark, d):
    return scored(spark, d).select("i", r6(similarity.dot(similarity.unit(F.col("va")), similarity.unit(F.col("vb")))).alias("sim"))


_IN_BATCH = f"""WITH {VT}, logits AS (
  SELECT x.i AS anchor, CASE WHEN x.i = y.i THEN 'pos' ELSE 'other' END AS kind, list_cosine_similarity(x.vi, CASE WHEN y.gold THEN y.va ELSE y.vb END) AS sim FROM vt x, vt y
  UNION ALL SELECT x.i, CASE WHEN x.i = y.i THEN 'hard' ELSE 'other' END, list_cosine_similarity(x.vi, CASE WHEN y.gold THEN y.vb ELSE y.va END) FROM vt x, vt y)"""


@query("infonce_loss", _IN_BATCH + " SELECT anchor, round(ln(sum(exp(sim / 0.05 + CASE WHEN kind = 'hard' THEN 0.01 ELSE 0 END))) - max(CASE WHEN kind = 'pos' THEN sim / 0.05 END), 5) AS loss FROM logits GROUP BY anchor")
def _(spark, d):
    rows = scored(spark, d)
    anchors = rows.select(F.col("i").alias("vec_id"), F.col("vi").alias("embedding"))
    good = rows.select(F.col("i").alias("vec_id"), F.when(F.col("gold"), F.col("va")).otherwise(F.col("vb")).alias("embedding"))
    bad = rows.select(F.col("i").alias("vec_id"), F.when(F.col("gold"), F.col("vb")).otherwise(F.col("va")).alias("embedding"))
    return losses.in_batch_loss(anchors, good, bad, 0.05, 0.01).select("anchor", F.round("loss", 5).alias("loss"))


@query("hinge_loss", f"WITH {VT} SELECT round(sum(greatest(0, 0.2 - CASE WHEN gold THEN sim_a - sim_b ELSE sim_b - sim_a END)), 6) AS hinge, round(avg(1 - CASE WHEN gold THEN sim_a ELSE sim_b END + greatest(0, CASE WHEN gold THEN sim_b ELSE sim_a END)), 6) AS cosine_embedding, round(avg(CASE WHEN gold THEN power(sim_a - 1, 2) ELSE 0.5 * power(sim_a, 2) END), 6) AS scaled_squares FROM vs")
def _(spark, d):
    rows = scored(spark, d)
    pos, neg = F.when(F.col("gold"), F.col("sim_a")).otherwise(F.col("sim_b")), F.when(F.col("gold"), F.col("sim_b")).otherwise(F.col("sim_a"))
    return rows.agg(
        r6(F.sum(losses.hinge(pos, neg))).alias("hinge"), r6(F.avg(losses.cosine_embedding(pos, F.lit(1)) + losses.cosine_embedding(neg, F.lit(-1)))).alias("cosine_embedding"),
        r6(losses.scaled_squares(F.col("sim_a"), F.col("gold").cast("int"), F.lit(0.5))).alias("scaled_squares"),
    )


@query("soft_label5", "SELECT vec_id, list_transform(range(1, 6), lambda k: round(CASE WHEN k = floor(s) THEN floor(s) - s + 1 WHEN k = floor(s) + 1 THEN s - floor(s) ELSE 0 END, 6)) AS shares, round(s, 6) AS expected FROM (SELECT vec_id, 1 + CAST(vec_id % 41 AS DOUBLE) / 10 AS s FROM embeddings)")
def _(spark, d):
    s = table(spark, d, "embeddings").select("vec_id", (1 + (F.col("vec_id") % 41).cast("double") / 10).alias("s"))
    shares = similarity.soft_label(F.col("s"))
    return s.select("vec_id", F.transform(shares, lambda x: F.round(x, 6)).alias("shares"), r6(similarity.expected_score(shares)).alias("expected"))


@query("mean_pooling", "SELECT label, list_transform(list(m ORDER BY k), lambda x: round(x, 6)) AS pooled FROM (SELECT label, k, avg(x) AS m FROM (SELECT label, unnest(range(1, 65)) AS k, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY label, k) GROUP BY label")
def _(spark, d):
    parts = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: F.round(s["m"], 6)).alias("pooled"))


@query("incremental_index", "SELECT count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS total, min(vec_id) AS low, max(vec_id) AS high FROM embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.add_to_index(e.where("vec_id % 3 = 0"), e.where("vec_id % 3 <> 0 or vec_id % 2 = 0")).agg(F.count("*").alias("n"), F.sum("vec_id").alias("total"), F.min("vec_id").alias("low"), F.max("vec_id").alias("high"))


@query("probe_accuracy")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("fold", F.col("vec_id") % 2)
    return losses.probe_accuracy(e, "label", "embedding", "fold", (0.01, 0.1))
