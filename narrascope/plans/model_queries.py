"""Queries that train, annotate or project: regression by rounds, checkpoints, spans and principal components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.functions import hooks, similarity
from narrascope.operators import annotations, losses, projection, regression
from narrascope.plans.views import Catalogue, table
from narrascope.session import Scratch, bound_batches, scratch_root
from narrascope.sources.checkpoints import Checkpoints

query = Catalogue()

PERSONS = ("Ada", "Ben", "Cleo", "Dan", "Eve")


def graded_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring vectors with their pair features and a score from 1 to 5 that follows their cosine and labels."""
    e = table(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("other"), F.col("embedding").alias("next"))
    both = e.join(other, "vec_id")
    near = similarity.cosine_or_zero(F.col("embedding"), F.col("next"))
    score = F.greatest(F.lit(1.0), F.least(F.lit(5.0), 3 + 2 * near + F.when(F.col("label") == F.col("other"), 1.0).otherwise(-0.5)))
    return both.select("vec_id", similarity.pair_features(F.col("embedding"), F.col("next")).alias("features"), score.alias("score"), similarity.soft_label(score).alias("shares"))


def _split(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return pairs.where("vec_id % 5 < 3"), pairs.where("vec_id % 5 = 3"), pairs.where("vec_id % 5 = 4")


def _scores(test: DataFrame, model: regression.Regressor) -> DataFrame:
    return regression.predict(test, model).select("vec_id", F.round("score", 6).alias("score"), F.round("expected", 6).alias("expected"))


#: Steps between two checks, and steps in all, of the registered queries.
EACH, MOST = 8, 32


@query("relatedness_scores")
def _(spark, d):
    train, dev, test = _split(graded_pairs(spark, d))
    return _scores(test, regression.fit(train, dev, each=EACH, most=MOST))


@query("relatedness_resumed")
def _(spark, d):
    # a run that ends after its first checks and goes on from the last of them
    train, dev, test = _split(graded_pairs(spark, d))
    path = f"{scratch_root(spark)}/narrascope/run-{uuid.uuid4().hex}"
    for most in (MOST // 2, MOST):
        model = regression.fit(train, dev, each=EACH, most=most, checkpoints=Checkpoints(spark, path))
    return _scores(test, model)


@query("pca_2d")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return projection.project(e, projection.components(e)).select("vec_id", "label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("pca_variance")
def _(spark, d):
    e = table(spark, d, "embeddings")
    n, mean, products = projection.moments(e)
    rows = [(k, float(mean[k]), float(products[k, k] / n)) for k in range(len(mean))]
    return spark.createDataFrame(rows, "k int, mean double, variance double").select("k", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


query.sql["pca_variance"] = """
WITH x AS (SELECT unnest(range(0, len(embedding))) AS k, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings WHERE len(list_filter(embedding, lambda e: e IS NULL)) = 0)
SELECT CAST(k AS INT) AS k, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance FROM x GROUP BY k"""


def annotated(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the spans of a rule-based annotator."""
    bound_batches(spark)
    return table(spark, d, "documents").select("doc_id", "text", hooks.annotate(hooks.capital_annotator, F.col("text")).alias("found"))


@query("single_entities")
def _(spark, d):
    docs = Scratch(spark, "spans").save(annotated(spark, d).drop("text"), "found")  # both sides read it
    return annotations.untouched(annotations.entity_rows(docs, ["doc_id"]), annotations.mention_rows(docs, ["doc_id"]), ["doc_id"])


@query("anonymised_texts")
def _(spark, d):
    out = annotations.anonymised(annotated(spark, d), persons=PERSONS)
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


@query("masked_loss", """
WITH t AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS z, CASE WHEN vec_id % 7 = 0 THEN vec_id % 64 END AS y FROM embeddings)
SELECT label, round(sum(ln(list_sum(list_transform(z, lambda x: exp(x)))) - z[y + 1]), 6) AS total, count(*) AS n FROM t WHERE y IS NOT NULL GROUP BY label""")
def _(spark, d):
    # vectors stand for the scores of a vocabulary of 64 words; every seventh token is masked
    e = table(spark, d, "embeddings").select("label", F.array("embedding").alias("logits"), F.array(F.when(F.col("vec_id") % 7 == 0, (F.col("vec_id") % 64).cast("int"))).alias("labels"))
    loss = e.select("label", losses.masked_cross_entropy(F.col("logits"), F.col("labels")).alias("l")).where("l.n > 0")
    return loss.groupBy("label").agg(F.round(F.sum("l.total"), 6).alias("total"), F.sum("l.n").alias("n"))
