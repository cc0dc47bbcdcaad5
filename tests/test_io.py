"""Readers, writers, streams, and all queries against their SQL."""

import os

import pytest
from pyspark.sql import functions as F

from narrascope.plans import catalogue
from narrascope.sources import readers, sinks
from narrascope.streaming import incremental

SF = "/root/testdata/sf0.001"


def put(path, content, encoding="utf-8"):
    path.write_text(content, encoding=encoding)
    return str(path)


def test_strict_and_lenient_json(spark, tmp_path):
    good = put(tmp_path / "a.jsonl", '{"text": "x"}\n\n{"text": null}\n')
    assert [r.text for r in readers.jsonl(spark, good, readers.TEXT).collect()] == ["x", None]
    bad = put(tmp_path / "b.jsonl", '{"text": "x"}\n{oops\n')
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ|malformed"):
        readers.jsonl(spark, bad, readers.TEXT).collect()
    assert readers.jsonl(spark, bad, readers.TEXT, strict=False).count() == 1
    assert [r.value for r in readers.bad_lines(spark, bad, readers.TEXT).collect()] == ["{oops"]
    values = put(tmp_path / "c.jsonl", '{"a": 1}\n[1, 2]\n\n"s"\n')
    assert [r.value for r in readers.jsonl_values(spark, values).collect()] == ['{"a": 1}', '{"_value": [1, 2]}', '{"_value": "s"}']


def test_csv_records_are_stripped(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'a,b\n" x ","say ""hi"""\n , \n"two\nlines",\n')
    assert [tuple(r) for r in readers.csv_records(spark, path).collect()] == [("x", 'say "hi"'), ("two\nlines", "")]
    with pytest.raises(ValueError):
        readers.by_extension(spark, "x.json")
    assert readers.by_extension(spark, put(tmp_path / "t.tsv", "a\tb\n1\t2\n")).columns == ["a", "b"]


def test_csv_gives_back_all_texts(spark, tmp_path):
    marks = ['"', "\n", "\r", "\r\n", "\\", ",", " ", "\t", "\0", "\x01", "\x1f", "\x85", "\u2028", "\ufeff", "\xa0", "𝄞", "#", "x"]
    texts = [None, "", "null", "\\N", *marks, *(a + b for a in marks for b in marks), *(f"a{a}{b}z" for a in marks for b in marks)]
    rows = [(k, t, "web") for k, t in enumerate(texts)] + [(k, "t", t) for k, t in enumerate(texts)] + [(None, None, None), (None, "", "")]
    schema = "doc_id long, text string, source string"
    spark.createDataFrame(rows, schema).withColumn("lang", F.lit("en")).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    back = catalogue.QUERIES["csv_round_trip"](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, rows))
    assert back.count() == len(rows) and sorted(repr(r.source) for r in back.select("source").collect()) == sorted(repr(r[2]) for r in rows)
    sinks.csv(spark.createDataFrame([], schema), str(tmp_path / "none"))
    assert readers.csv(spark, str(tmp_path / "none"), quoted_empty=True).columns == ["doc_id", "text", "source"]
    other = put(tmp_path / "other.csv", 'a,b\r\n"",x\r\n')
    assert [tuple(r) for r in readers.csv(spark, other).collect()] == [(None, "x")]


def test_lines_are_numbered_and_zipped(spark, tmp_path):
    a = put(tmp_path / "in.txt", "".join(f"left {k}\tright {k}\n" for k in range(300)))
    b = put(tmp_path / "gs.txt", "".join("\n" if k % 3 else f"{k}\n" for k in range(300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        rows = readers.sts_pairs(spark, a, b).orderBy("number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.sent1, r.sent2, r.gold) for r in rows] == [(f"left {k}", f"right {k}", float(k)) for k in range(0, 300, 3)]


def test_task_formats(spark, tmp_path):
    q = put(tmp_path / "q.txt", "NUM:count How many ?\nHUM:ind Who ?\n")
    assert {tuple(r) for r in readers.questions(spark, q).collect()} == {("How many ?", 5), ("Who ?", 3)}
    s = put(tmp_path / "s.txt", "good one\t1\nbad\t0\n")
    assert {tuple(r) for r in readers.labelled_last(spark, s).collect()} == {("good one", 1), ("bad", 0)}
    assert [tuple(r) for r in readers.labelled_first(spark, put(tmp_path / "f.txt", "3 mid\n")).collect()] == [("mid", 3)]
    pos, neg = put(tmp_path / "p", "caf\xe9\n", "latin-1"), put(tmp_path / "n", "no\n")
    assert {tuple(r) for r in readers.two_classes(spark, pos, neg).collect()} == {("café", 1), ("no", 0)}
    p = put(tmp_path / "probe.txt", "tr\tB\tx y\ntr\tA\tz\nte\tB\tw\nva\tQ\tv\n")
    assert {(r.split, r.label_id) for r in readers.probing(spark, p).collect()} == {("train", 1), ("train", 0), ("test", 1), ("dev", None)}
    three = [put(tmp_path / f"x{k}", f"{k}a\n{k}b\n") for k in range(3)]
    assert [tuple(r) for r in readers.aligned(spark, *three).orderBy("number").collect()] == [(0, "0a", "1a", "2a"), (1, "0b", "1b", "2b")]
    cols = readers.tab_columns(spark, put(tmp_path / "m.tsv", "h\tx\n1\t2\t3\n"), {"a": 2, "b": 0}, header=True).collect()
    assert [(r.a, r.b) for r in cols] == [("3", "1")]


def test_ragged_clusters_keep_the_last_line_of_an_id(spark, tmp_path):
    path = put(tmp_path / "c.tsv", "1\tm0\tt0\tx0\n2\tm9\tt9\tx9\n1\tm1\tt1\tx1\tm2\tt2\tx2\n")
    assert sorted((r.cluster_id, r.movie_id) for r in readers.clusters_tsv(spark, path).collect()) == [(1, "m1"), (1, "m2"), (2, "m9")]


def test_entities_vectors_and_captions(spark, tmp_path):
    for k in (1, 2):
        put(tmp_path / f"Q{k}.json", f'{{\n"title": "t{k}"}}')
    only = spark.createDataFrame([("Q2",)], "id string")
    assert [(r.id, r.title) for r in readers.entities(spark, str(tmp_path / "*.json"), "title string", only).collect()] == [("Q2", "t2")]
    v = put(tmp_path / "v.txt", "a 1 2\nb 3 4.5\n")
    assert [(r.word, r.vec) for r in readers.word_vectors(spark, v, spark.createDataFrame([("b",)], "word string")).collect()] == [("b", [3.0, 4.5])]
    caps = spark.createDataFrame([(1, list("abcdef")), (2, ["x"])], "image_id int, captions array<string>")
    assert readers.first_captions(caps).count() == 5


def test_ids_are_named_both_ways(spark, tmp_path):
    (tmp_path / "genres.json").write_text('{"Q1": "novel",\n "Q2": "film"}')
    names = readers.named_ids(spark, str(tmp_path / "genres.json"))
    rows = spark.createDataFrame([("Q2",), ("Q9",)], "id string")
    assert sorted(tuple(r) for r in rows.join(names, "id", "left").collect()) == [("Q2", "film"), ("Q9", None)]
    assert [r.id for r in names.where("name = 'novel'").collect()] == ["Q1"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'é "q"', 0.5), (2, None, 1 / 3)], "k long, s string, x double")
    sinks.csv_with_mark(df, str(tmp_path / "m"))
    raw = b"".join(open(tmp_path / "m" / f, "rb").read() for f in sorted(os.listdir(tmp_path / "m")) if f.startswith("part"))
    assert raw.startswith("﻿k,s,x\n".encode()) and '"é ""q"""'.encode() in raw
    sinks.fixed_csv(df, str(tmp_path / "f"))
    assert {r.x for r in spark.read.option("header", True).csv(str(tmp_path / "f")).collect()} == {"0.500000", "0.333333"}
    sinks.metrics(df.where("k = 1").select("k", "x"), str(tmp_path / "t"))
    assert {r.value for r in spark.read.text(str(tmp_path / "t")).collect()} == {"k = 1", "x = 0.5"}
    table = sinks.score_table(spark.createDataFrame([("a", 0.5)], "task string, score double"), ["a", "b"]).first()
    assert tuple(table) == ("50.00", "0.00", "25.00")
    sinks.vectors(df, str(tmp_path / "v"))
    sinks.by_language(df.withColumn("lang", F.lit("en")), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == spark.read.json(str(tmp_path / "l")).count() == 2


def test_writing_goes_on_after_a_failure(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.range(50).withColumnRenamed("id", "k")
    df.where("k < 20").write.parquet(path)
    sinks.resumable(df, path, "k", 3)
    sinks.resumable(df, path, "k", 3)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == list(range(50))


def test_streams_keep_the_first_of_equal_texts(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), (" a ", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:20:00")], "t string, s string")
    df.select("t", F.to_timestamp("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t string, ts timestamp").parquet(str(tmp_path / "in"))
    q = incremental.once_per_text(stream, "t", "ts").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.t.strip() for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    events = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(f"{SF}/events.parquet".replace("events.parquet", "event[s].parquet"))
    assert incremental.event_windows(events).isStreaming


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_queries_agree_with_their_sql(spark, name):
    import duckdb

    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.SQL:
        assert len(got) > 0
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(catalogue.SQL[name]).df()

    def rows(df):
        def value(v):
            if hasattr(v, "tolist"):
                v = v.tolist()
            if isinstance(v, float):
                return None if v != v else float(f"{v:.9g}") + 0.0
            return v if isinstance(v, (list, str)) or v == v else None

        return sorted((repr(tuple(value(v) for v in r)) for r in df[sorted(df.columns)].itertuples(index=False)))

    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
