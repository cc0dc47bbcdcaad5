"""Regression by rounds, checkpoints, principal components and annotated spans against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrascope.functions import hooks
from narrascope.operators import annotations, projection, regression
from narrascope.plans import catalogue, model_queries
from narrascope.sources.checkpoints import Checkpoints

SF = "/root/testdata/sf0.001"


def graded(spark, n=400, width=6, seed=1):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, width))
    score = np.clip(3 + x @ np.linspace(-1, 1, width), 1, 5)
    low = np.floor(score)
    shares = [[float(lo - s + 1 if k == lo else s - lo if k == lo + 1 else 0.0) for k in range(1, 6)] for lo, s in zip(low, score)]
    rows = [(i, x[i].tolist(), shares[i], float(score[i])) for i in range(n)]
    return x, np.array(shares), score, spark.createDataFrame(rows, "i int, features array<double>, shares array<double>, score double")


def plain_run(x, y, steps, rate):
    """Full-batch Adam on the mean squared error of a softmax's shares."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros((x.shape[1], y.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = 2 * (p - y) / y.size
        grad = x.T @ (p * (g - (g * p).sum(1, keepdims=True)))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    p = np.exp(x @ w - (x @ w).max(1, keepdims=True))
    return p / p.sum(1, keepdims=True) @ np.arange(1, 6)


def test_the_regressor_equals_a_plain_loop_under_any_partitioning(spark):
    x, y, score, df = graded(spark)
    models = [regression.fit(df.repartition(k), df, each=6, most=6) for k in (1, 7)]
    assert np.array_equal(models[0].weights, models[1].weights)
    got = {r.i: r.expected for r in regression.predict(df, models[0]).collect()}
    # the rate of the plain loop is per scaled feature, so features are scaled alike
    want = plain_run(x / models[0].largest, y, 6, 0.05)
    assert np.allclose([got[i] for i in range(len(x))], want, atol=2e-3)
    assert models[0].best > 0.8


def test_rounds_read_packed_rows(spark):
    x, y, score, df = graded(spark, 60)
    packed = regression._packed(df.select("features", F.col("shares").cast("array<double>").alias("shares")).coalesce(1), 4.0).collect()
    assert sum(len(r.x) for r in packed) == 60 * (x.shape[1] + 1) * 2 and sum(len(r.y) for r in packed) == 60 * 5 * 8


def test_texts_reach_the_annotator_in_small_batches(spark):
    name, df = "spark.sql.execution.arrow.maxBytesPerBatch", spark.createDataFrame([(1, "Ann met Bob")], "doc_id int, text string")
    before = spark.conf.get(name)
    spark.conf.set(name, str(64 << 20))
    annotations.anonymised(df.withColumn("found", hooks.annotate(hooks.capital_annotator, F.col("text"))))
    bound = int(spark.conf.get(name))
    spark.conf.set(name, before)
    assert bound <= 8 << 20


def test_training_stops_early_and_takes_odd_rows(spark):
    x, y, score, df = graded(spark, 60)
    flat = df.withColumn("score", F.lit(2.0))  # no correlation is ever better than 0 but the first
    assert regression.fit(df, flat, each=1, most=50, patience=1).step == 3
    odd = df.unionByName(spark.createDataFrame([(100, None, [1.0, 0.0, 0.0, 0.0, 0.0], 1.0), (101, [float("nan")] * 6, None, 2.0)], df.schema))
    assert np.array_equal(regression.fit(odd, df, each=2, most=2).weights, regression.fit(df, df, each=2, most=2).weights)
    assert {r.i for r in regression.predict(odd, regression.fit(df, df, each=1, most=1)).where("expected is null").collect()} == {100}
    assert regression.fit(df.limit(0), df).weights.shape == (1, 1)


def test_a_run_that_ends_anywhere_goes_on(spark, tmp_path, monkeypatch):
    x, y, score, df = graded(spark, 80)
    whole = regression.fit(df, df, each=2, most=8)
    path = f"file://{tmp_path}/run"
    commits, put = [], Checkpoints._put

    def failing(self, name, record):
        commits.append(name)
        if len(commits) in (1, 4, 6):  # before a record is in place: the data stands there without one
            raise OSError("lost")
        put(self, name, record)

    monkeypatch.setattr(Checkpoints, "_put", failing)
    for _ in range(8):
        try:
            model = regression.fit(df, df, each=2, most=8, checkpoints=Checkpoints(spark, path))
            break
        except OSError:
            continue
    assert len(commits) >= 7 and np.array_equal(model.weights, whole.weights) and model.best == whole.best
    found = Checkpoints(spark, path)
    assert found.last()[0] == 8 and found.best()[1] == pytest.approx(whole.best)
    assert len(list((tmp_path / "run" / "data").iterdir())) <= 3


def test_the_best_checkpoint_stays(spark, tmp_path):
    store = Checkpoints(spark, f"file://{tmp_path}/c", keep=1)
    assert store.best() is None and store.last() is None
    said = [store.commit(spark.range(k), k, m) for k, m in ((1, 0.5), (2, 0.7), (3, 0.7), (4, 0.1))]
    assert said == [True, True, False, False]
    assert (store.best()[0], store.best()[2].count()) == (2, 2) and (store.last()[0], store.last()[2].count()) == (4, 4)


def test_components_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(projection, "FAN_IN", 2)
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = np.array([r.embedding for r in e.orderBy("vec_id").collect()], float)
    odd = spark.createDataFrame([(-1, None, 0), (-2, [None] * 64, 0), (-3, [float("nan")] * 64, 0)], e.schema)
    n, mean, products = projection.moments(e.unionByName(odd).repartition(9))
    assert n == len(x) and np.allclose(mean, x.mean(0)) and np.allclose(products, (x - x.mean(0)).T @ (x - x.mean(0)))
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    axes = np.array([v * np.sign(v[np.abs(v).argmax()]) for v in vt[:2]])
    got = {r.vec_id: (r.x, r.y) for r in catalogue.QUERIES["pca_2d"](spark, SF).collect()}
    assert np.allclose([got[i] for i in range(len(x))], (x - x.mean(0)) @ axes.T, atol=1e-5)
    assert projection.moments(e.limit(0))[0] == 0


def test_spans_that_nothing_touches(spark):
    rnd = random.Random(4)
    spans = [(rnd.randrange(5), a, a + rnd.randrange(0, 6), k) for k in range(300) for a in [rnd.randrange(200)]]
    others = [(rnd.randrange(6), a, a + rnd.randrange(1, 9), -k) for k in range(60) for a in [rnd.randrange(200)]]
    schema = "doc int, start int, end int, k int"
    got = annotations.untouched(spark.createDataFrame(spans + [(None, 1, 2, 999), (1, None, 2, 998)], schema), spark.createDataFrame(others, schema), ["doc"])
    want = [s for s in spans if not any(o[0] == s[0] and o[1] < s[2] and s[1] < o[2] for o in others)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def plain_anonymised(text, persons):
    """The rule on one text, span by span."""
    entities, clusters = hooks.capital_annotator()([text])[0]
    kinds = {"LOC": "Location", "ORG": "Organization", "MISC": "Entity"}
    words = [m.start() for m in re.finditer(r"\S+", text)]
    spans = []
    for k, (label, own) in enumerate(clusters):
        name = f"{kinds[label]} {chr(65 + k % 26)}" if label in kinds else persons[k % len(persons)]
        last = None
        for a, b in own:
            token, said = sum(w < a for w in words), text[a:b]
            low = said.lower()
            near = last is not None and last + 8 >= token
            own_words = ("my", "our", "your", "his", "her", "its", "their", "whose")
            spoken = ("I", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", *own_words)
            spans.append((a, b, said if near and low in spoken else name + "'s" if said.endswith("'s") or low in own_words else name))
            last = token
    touched = [(a, b) for _, own in clusters for a, b in own]
    numbers = {}
    for a, b, label in sorted(e for e in entities if not any(x < e[1] and e[0] < y for x, y in touched)):
        own = numbers.setdefault(label, {})
        n = own.setdefault(text[a:b], len(own))
        new = f"{kinds[label]} {chr(65 + n)}" if label in kinds and n < 26 else persons[n] if label == "PER" and n < len(persons) else text[a:b]
        spans.append((a, b, new))
    out, at = [], 0
    for a, b, new in sorted(spans):
        if a >= at:
            out += [text[at:a], new]
            at = b
    return "".join(out) + text[at:]


def test_texts_are_anonymised_span_by_span(spark):
    texts = ["Ann met Bob. Ann saw His house. Bob and Ann Lee went. Ann!", "no names", "", None, "Her Her Her x Her y Éva Éva", "Zoë Zoë Zoë Zoë"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("found", hooks.annotate(hooks.capital_annotator, F.col("text")))
    got = {r.doc_id: r.text for r in annotations.anonymised(df, persons=model_queries.PERSONS).collect()}
    for k, t in enumerate(texts):
        assert got[k] == (None if t is None else plain_anonymised(t, model_queries.PERSONS)), k
