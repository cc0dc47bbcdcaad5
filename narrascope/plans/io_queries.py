"""Queries through readers, writers, model hooks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrascope.functions import hooks
from narrascope.operators import triplets, vectors
from narrascope.plans.views import TT, Catalogue, encoded_triplets, table, text_triplets
from narrascope.session import Scratch
from narrascope.sources import readers, sinks
from narrascope.streaming import incremental

query = Catalogue()


@query("jsonl_round_trip", f"WITH {TT} SELECT anchor_text, text_a, text_b, gold AS text_a_is_closer FROM tt")
def _(spark, d):
    path = Scratch(spark, "io").path + "/triplets"
    sinks.jsonl(text_triplets(spark, d).select(*triplets.TEXTS, "text_a_is_closer"), path)
    return readers.jsonl(spark, path, readers.TRIPLET)


@query("csv_round_trip", "SELECT doc_id, text, source FROM documents")
def _(spark, d):
    path = Scratch(spark, "io").path + "/csv"
    sinks.csv(table(spark, d, "documents").select("doc_id", "text", "source"), path)
    return readers.csv(spark, path, "doc_id long, text string, source string", quoted_empty=True)


@query("numbered_lines", "SELECT count(*) AS n, CAST(sum(turn) AS BIGINT) AS total FROM conversations")
def _(spark, d):
    path = Scratch(spark, "io").path + "/lines"
    rows = table(spark, d, "conversations").select(F.col("turn").cast("string").alias("value"))
    rows.repartition(6, F.xxhash64("value", F.spark_partition_id())).write.text(path)
    found = readers.lines(spark, path)
    # every number of a file, from 0 on, is there once; files are zipped with themselves
    top = found.groupBy("path").agg((F.max("number") + 1).alias("n"), F.countDistinct("number").alias("known"))
    both = readers.zipped(found.withColumn("number", F.struct("path", "number")), found.withColumn("number", F.struct("path", "number")))
    total = both.where("a = b").agg(F.sum(F.col("a").cast("long")).alias("total"))
    return top.where("n = known").agg(F.sum("n").cast("long").alias("n")).join(F.broadcast(total))


@query("language_folders", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _(spark, d):
    path = Scratch(spark, "io").path + "/languages"
    sinks.by_language(table(spark, d, "documents").select("doc_id", "lang"), path)
    return spark.read.schema("doc_id long, lang string").json(path).groupBy("lang").agg(F.count("*").alias("n"))


@query("encoded_triplets")
def _(spark, d):
    found = encoded_triplets(spark, d, hooks.hashing_encoder)
    scored = vectors.triplet_similarities(found, F.col("x"), F.col("y"), F.col("z"))
    return vectors.triplet_accuracy(scored)


@query("stream_augment", "SELECT doc_id, lang || ': ' || source AS made FROM documents")
def _(spark, d):
    base = Scratch(spark, "stream").path
    table(spark, d, "documents").select("doc_id", "lang", "source").repartition(2).write.json(f"{base}/in")
    stream = incremental.json_stream(spark, f"{base}/in", "doc_id long, lang string, source string")
    incremental.augment(stream, lambda b: b.select("doc_id", F.concat("lang", F.lit(": "), "source").alias("made")), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema("doc_id long, made string").json(f"{base}/out/*")


@query("stream_index", "SELECT count(*) AS n, count(DISTINCT vec_id) AS ids FROM embeddings")
def _(spark, d):
    base = Scratch(spark, "stream").path
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    e.where("vec_id % 2 = 0").write.parquet(f"{base}/index")
    e.where("vec_id % 3 <> 1").write.parquet(f"{base}/in")
    e.where("vec_id % 2 = 1").write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{base}/in")
    incremental.maintain_index(stream, f"{base}/index", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/index").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"))
