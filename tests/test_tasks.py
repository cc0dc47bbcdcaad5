"""Task folders, datasets with splits, and the smaller functions against hand-made cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrascope.functions import similarity
from narrascope.operators import losses, overlap, retrieval, triplets
from narrascope.operators.word_blocks import best_by_words
from narrascope.plans import task_readers, tasks
from narrascope.sources import readers, sinks

PROBE = "tr\tA\tx\ntr\tB\ty z\nva\tA\tw\nte\tB\tv\n"


def fill(folder, task):
    """The files of a task with a few rows."""
    put = lambda name, text, encoding="utf-8": (folder / name).write_bytes(text.encode(encoding))
    if task in tasks.STS_YEARS:
        for k, name in enumerate(tasks.STS_YEARS[task]):
            put(f"STS.input.{name}.txt", "a b\tc\nd\te\nf\tg\n")
            put(f"STS.gs.{name}.txt", f"{k}.5\n\n2\n")
        return {"test": 2 * len(tasks.STS_YEARS[task])}
    if task in task_readers.OPINIONS:
        put(task_readers.OPINIONS[task][0], "caf\xe9\nfine\n", "latin-1")
        put(task_readers.OPINIONS[task][1], "bad\n", "latin-1")
        return {"all": 3}
    if task in ("SST2", "SST5"):
        for name in task_readers.SENTIMENT.values():
            put(name, "good\t1\nbad\t0\n" if task == "SST2" else "4 good\n0 bad\n")
        return dict.fromkeys(("train", "dev", "test"), 2)
    if task == "STSBenchmark":
        for name in task_readers.BENCHMARK.values():
            put(name, 'g\tf\ty\t1\t3.5\tone "a\ttwo\ng\tf\ty\t2\t0\tx\ty\n')
        return dict.fromkeys(("train", "dev", "test"), 2)
    if task.startswith("SICK"):
        for name in task_readers.SICK.values():
            put(name, "id\ta\tb\tscore\tjudgement\n1\tx\ty\t4.5\tENTAILMENT\n2\tx\tz\t1\tNEUTRAL\n3\tx\tw\t1\tCONTRADICTION\n")
        return dict.fromkeys(("train", "dev", "test"), 3)
    if task == "MRPC":
        for name in task_readers.MRPC.values():
            put(name, "Quality\t#1\t#2\tA\tB\n1\t7\t8\tone\ttwo\n0\t7\t9\tone\tthree\n")
        return {"train": 2, "test": 2}
    if task == "SNLI":
        for split in ("train", "dev", "test"):
            for k in ("s1", "s2", "labels"):
                put(f"{k}.{split}", f"{k} 1\n{k} 2\n")
        return dict.fromkeys(("train", "dev", "test"), 2)
    if task == "TREC":
        for name in task_readers.TREC.values():
            put(name, "NUM:count How many caf\xe9s ?\nHUM:ind Who ?\n", "latin-1")
        return {"train": 2, "test": 2}
    put(task_readers.PROBING[task], PROBE)
    return {"train": 2, "dev": 1, "test": 1}


@pytest.mark.parametrize("task", ["STS12", "STS16", "MR", "SUBJ", "SST2", "SST5", "STSBenchmark", "SICKRelatedness", "SICKEntailment", "MRPC", "SNLI", "TREC", "Length", "CoordinationInversion"])
def test_tasks_are_read_from_their_folders(spark, tmp_path, task):
    want = fill(tmp_path, task)
    rows = task_readers.load(spark, task, f"file://{tmp_path}/").collect()
    assert {s: sum(r.split == s for r in rows) for s in want} == want and len(rows) == sum(want.values())
    assert not any(v is None for r in rows for v in r)
    if task == "STS12":
        assert {(r.dataset, r.sent1, r.gold) for r in rows if r.dataset == "MSRvid"} == {("MSRvid", "a b", 1.5), ("MSRvid", "f", 2.0)}
    if task == "SICKEntailment":
        assert sorted(r.gold for r in rows if r.split == "dev") == [0, 1, 2]
    if task == "TREC":
        assert {(r.text, r.label) for r in rows} == {("How many cafés ?", 5), ("Who ?", 3)}


def test_every_task_has_a_reader_and_captions_come_as_tables(spark, tmp_path):
    named = {*tasks.STS_YEARS, *task_readers.OPINIONS, *task_readers.PROBING, "SST2", "SST5", "STSBenchmark", "SICKRelatedness", "SICKEntailment", "MRPC", "SNLI", "TREC", "ImageCaptionRetrieval"}
    assert named == set(tasks.KINDS)
    for name in task_readers.CAPTIONS.values():
        spark.range(2).write.parquet(str(tmp_path / name))
    assert task_readers.load(spark, "ImageCaptionRetrieval", str(tmp_path)).groupBy("split").count().count() == 3
    with pytest.raises(ValueError):
        task_readers.load(spark, "None", str(tmp_path))
    (tmp_path / "sentiment-train").write_text("good\t0\n")
    with pytest.raises(ValueError, match="labels reach 0, not 1"):
        task_readers.load(spark, "SST2", str(tmp_path))


def test_downloaded_folders_have_splits(spark, tmp_path):
    for split, n in (("train", 3), ("validation", 2), ("test", 1)):
        for k in range(n):
            spark.range(1).withColumn("k", F.lit(k)).coalesce(1).write.parquet(str(tmp_path / "hub" / f"{split}-0000{k}-of-0000{n}.parquet"))
    got = {r.split: r["count"] for r in readers.hub_folder(spark, str(tmp_path / "hub")).groupBy("split").count().collect()}
    assert got == {"train": 3, "dev": 2, "test": 1}
    (tmp_path / "csv" / "test").mkdir(parents=True)
    (tmp_path / "csv" / "train.csv").write_text("a,b\n1,x\n")
    (tmp_path / "csv" / "test" / "part.csv").write_text('a,b\n2,"y\nz"\n')
    (tmp_path / "csv" / "notes.csv").write_text("a,b\n3,w\n")
    assert {(r.a, r.split) for r in readers.hub_folder(spark, str(tmp_path / "csv"), "a int, b string").collect()} == {(1, "train"), (2, "test"), (3, None)}
    with pytest.raises(ValueError):
        (tmp_path / "none").mkdir()
        readers.hub_folder(spark, str(tmp_path / "none"))
    files = {"dev": str(tmp_path / "csv" / "train.csv"), "test": str(tmp_path / "csv" / "notes.csv")}
    assert {(r.n, r.split) for r in readers.split_files(spark, files, "n int, t string").collect()} == {(1, "dev"), (3, "test")}


def test_arrays_first_vectors_and_appending(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"text": "x"},\n {"text": null}]')
    assert [r.text for r in readers.json_array(spark, str(tmp_path / "a.json"), "text string").collect()] == ["x", None]
    (tmp_path / "v.txt").write_text("".join(f"w{k} {k} 1\n" for k in range(9)))
    got = readers.word_vectors(spark, str(tmp_path / "v.txt"), first=3, specials=("w7",)).collect()
    assert sorted((r.word, r.vec[0]) for r in got) == [("w0", 0.0), ("w1", 1.0), ("w2", 2.0), ("w7", 7.0)]
    for _ in range(2):
        sinks.jsonl(spark.range(2), str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    sinks.jsonl(spark.range(2), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_training_texts_submissions_and_members(spark):
    df = spark.createDataFrame([("a", None, "c", True, None, 1), ("d", "e", "f", None, True, 2)], "x string, y string, z string, text_a_is_closer boolean, p boolean, h int")
    assert [r.t for r in df.select(triplets.triplet_tokens(F.col("x"), F.col("y"), F.col("z")).alias("t")).collect()] == [["a", " ", "c"], ["d", "e", "f"]]
    out = triplets.submission(df, "p", helpers=("h",))
    assert out.columns == ["x", "y", "z", "text_a_is_closer"] and [r.text_a_is_closer for r in out.collect()] == [False, True]
    assert triplets.submission(df.drop("text_a_is_closer"), "p").columns == ["x", "y", "z", "h", "text_a_is_closer"]
    pairs = spark.createDataFrame([(1, 2), (3, 4), (1, 5)], "q int, c int")
    assert {(r.q, r.c) for r in retrieval.members_only(pairs, spark.createDataFrame([(1,), (1,)], "id int")).collect()} == {(1, 2), (1, 5)}


def test_quantiles_are_clamped_and_tokens_pooled(spark):
    rows = spark.createDataFrame([(float(k),) for k in range(5)], "x double")
    assert [rows.agg(similarity.clamp_quantile("x", q).alias("v")).first().v for q in (-1, 0.5, 2)] == [0.0, 2.0, 4.0]
    layers = F.array(*[F.array(*[F.array(*[F.lit(float(10 * a + 3 * b + c)) for c in (0, 1)]) for b in range(3)]) for a in range(2)])
    mask = F.array(F.lit(1), F.lit(1), F.lit(0))
    pool = lambda mode, **more: spark.range(1).select(similarity.pooled(layers, mask, mode, 2, **more).alias("v")).first().v
    assert pool("cls") == pool("cls_before_pooler") == [10.0, 11.0]
    assert pool("last") == [13.0, 14.0]
    dense = similarity.dense_tanh([[0.1, 0.0], [0.0, -0.1]], [0.0, 0.5])
    assert pool("cls", dense=dense) == pytest.approx([math.tanh(1.0), math.tanh(-0.6)])
    assert pool("cls_before_pooler", dense=dense) == [10.0, 11.0]
    assert pool("avg") == [11.5, 12.5]


def test_masked_losses(spark):
    df = spark.createDataFrame([([[1.0, 2.0, 700.0], [0.0, 0.0, 0.0]], [2, None]), ([[0.0, 1.0, 2.0]], [0]), ([], [])], "z array<array<double>>, y array<int>")
    got = [tuple(r.l) for r in df.select(losses.masked_cross_entropy(F.col("z"), F.col("y")).alias("l")).collect()]
    assert got == [(pytest.approx(0.0), 1), (pytest.approx(math.log(1 + math.e + math.e**2)), 1), (0.0, 0)]
    masked = F.struct(F.lit(6.0).alias("total"), F.lit(3).alias("n"))
    assert spark.range(1).select(losses.with_masked_loss(F.lit(1.0), masked, 0.1).alias("v")).first().v == pytest.approx(1.2)


def test_probes_tell_separable_classes(spark):
    rnd = np.random.default_rng(0)
    rows = [(i % 2, (rnd.normal(size=3) + (4 if i % 2 else -4)).tolist(), i % 5 % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "label int, vec array<double>, fold int")
    assert {(r.reg, r.dev) for r in losses.probe_accuracy(df, "label", "vec", "fold", (0.0, 0.1)).collect()} == {(0.0, 100.0), (0.1, 100.0)}


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_nearest_rows_by_words(spark, block_bytes):
    import random

    rnd = random.Random(2)
    sets = {i: sorted({f"w{int(rnd.paretovariate(0.6))}" for _ in range(rnd.randrange(0, 9))}) for i in range(60)}
    extra = {i: 0.05 * (i % 3 == 0) for i in sets}
    df = spark.createDataFrame([(i, w, extra[i]) for i, w in sets.items()] + [(None, ["w1"], 0.0), (99, None, 0.0)], "id long, words array<string>, extra double")
    got = {r.q: (r.c, round(r.score, 9)) for r in best_by_words(df.drop("extra"), df, exclude_self=True, block_bytes=block_bytes).collect()}
    want = {}
    for q, a in sets.items():
        scored = [(-round(len({*a} & {*b}) / len({*a} | {*b}) + extra[c], 9), c) for c, b in sets.items() if c != q and {*a} & {*b}]
        if scored:
            want[q] = (min(scored)[1], -min(scored)[0])
    assert got == want
    assert best_by_words(df.drop("extra"), df.limit(0)).count() == 0
    hyps = spark.createDataFrame([(1, "x y", "neutral", 0), (2, "", "contradiction", 0), (3, "q", "Contradiction", 0), (4, "x y", "neutral", 1)], "pos long, hypothesis string, label string, part int")
    anchors = spark.createDataFrame([(7, "x y z", 0), (8, "none", 0), (9, "x", 1)], "anchor_id long, anchor string, part int")
    assert {(r.anchor_id, r.pos) for r in overlap.hard_negatives(anchors, hyps, "part").collect()} == {(7, 1), (8, 3), (9, 4)}


def test_lookups_measures_and_types_of_the_callers_own(spark):
    from narrascope.functions import parsing
    from narrascope.operators import vectors

    table = spark.createDataFrame([("a", [9.0], 1), ("a", [1.0], 2), ("b", [3.0], 1)], "text string, embedding array<double>, n int")
    rows = spark.createDataFrame([("a",), ("c",)], "k string")
    assert {r.k: r.v for r in vectors.lookup_embeddings(rows, table, {"k": "v"}, order="n").collect()} == {"a": [1.0], "c": None}
    df = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(6)], "vec_id long, embedding array<double>")
    near = vectors.search(df, df, 1, -100.0, measure=lambda x, y: -np.abs(x[:, None, 0] - y[None, :, 0] + 2))
    assert {r.q: r.c for r in near.collect()} == {0: 2, 1: 3, 2: 4, 3: 5, 4: 5, 5: 4}
    claim = lambda *ids: '{"P31":[' + ",".join(f'{{"mainsnak":{{"snaktype":"value","datavalue":{{"value":{{"id":"{i}"}}}}}}}}' for i in ids) + "]}"
    got = spark.createDataFrame([(claim("Q1", "Q2"),), (claim("Q3"),), ("{}",)], "c string").select(parsing.has_type(F.col("c"), ("Q2", "Q7")).alias("t")).collect()
    assert [r.t for r in got] == [True, False, False]
