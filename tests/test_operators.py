"""Cases and properties of the operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from narrascope.operators import clusters, corpus, losses, ordering, overlap, retrieval, stats, triplets, vectors


def triplet_rows(spark):
    rows = [("x", "a", "b", True), ("x", "a", "b", False), (None, "a", "b", True), ("", "a", "b", True), ("y", "a", "b", None)]
    return spark.createDataFrame(rows, "anchor_text string, text_a string, text_b string, text_a_is_closer boolean")


def test_normalising_drops_rows_without_an_anchor(spark):
    out = triplets.normalised(triplet_rows(spark), F.coalesce("text_a_is_closer", F.lit(False))).collect()
    assert [tuple(r) for r in out] == [("x", "a", "b"), ("x", "b", "a"), ("y", "b", "a")]
    with pytest.raises(ValueError):
        triplets.texts_only(spark.range(1))


def test_only_the_exact_text_says_a(spark):
    df = spark.createDataFrame([("True",), ("true",), ("False",), (None,)], "l string")
    assert [r.a for r in df.select(triplets.label_says_a(F.col("l")).alias("a")).collect()] == [True, False, False, False]


def test_flipping_twice_is_nothing(spark):
    df = triplet_rows(spark).withColumn("k", F.monotonically_increasing_id())
    twice = triplets.flipped(triplets.flipped(df, F.col("k")), F.col("k"))
    assert sorted(map(str, twice.collect())) == sorted(map(str, df.collect()))


def test_five_variants_of_each(spark):
    df = spark.createDataFrame([("A", "B", "C", "pa", "pb", "pc", 7)], "anchor_text string, text_a string, text_b string, anchor_prototype string, text_a_prototype string, text_b_prototype string, i int")
    out = [tuple(r) for r in triplets.expand5(df).orderBy("variant").collect()]
    assert out == [(7, 0, "A", "B", "C"), (7, 1, "pa", "pb", "pc"), (7, 2, "pa", "B", "C"), (7, 3, "A", "pb", "C"), (7, 4, "A", "B", "pc")]


def test_long_conversations_keep_all_their_choices(spark, tmp_path):
    from narrascope.plans import catalogue

    rows = [(8, t, f"text {t}") for t in range(3000)] + [(9, 0, "alone")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    flat = catalogue.QUERIES["mc_flatten"](spark, str(tmp_path)).collect()
    assert sorted(r.b_index for r in flat) == [t - 1 for t in range(2, 3000) if t % 3 != 2]
    assert all((r.anchor_text, r.text_a, r.text_b) == ("text 0", "text 1", f"text {r.b_index + 1}") for r in flat)
    nouns = catalogue.QUERIES["noun_filter"](spark, str(tmp_path)).collect()
    assert sorted(r.b_index for r in nouns) == [t - 1 for t in range(3, 3000, 3)]
    assert catalogue.QUERIES["mc_skipped"](spark, str(tmp_path)).first().asDict() == {"n": 2, "kept": 1, "skipped": 1}


def test_choices_that_do_not_fit_are_skipped(spark):
    rows = [(1, "s", ["a", "b", "c"], 0, ["x", "noun", "random"]), (2, "s", ["a"], 3, ["noun"]), (3, "s", ["a", "b"], 0, ["noun"])]
    df = spark.createDataFrame(rows, "ex_id int, source string, choices array<string>, answer int, types array<string>")
    assert [(r.text_a, r.text_b, r.b_index) for r in triplets.choices_to_triplets(df).orderBy("b_index").collect()] == [("a", "b", 1), ("a", "c", 2)]


def test_rows_without_an_anchor_are_missing(spark):
    out = triplets.missing_anchors(triplet_rows(spark), spark.createDataFrame([("x",), (None,)], "anchor_text string")).select("anchor_text").collect()
    assert sorted(str(r[0]) for r in out) == ["", "None", "y"]


def test_source_tags(spark):
    cases = {"/d/dev_track_a.jsonl": ("dev", "track_a"), "/d/track_a_and_track_b_train.csv": ("train", "track_b"), "x": ("unknown", "unknown"), "Sample_a.json": ("sample", "track_a"),
             "my_test_b.x.csv": ("test", "unknown"), "testing-track-a": ("test", "track_a"), "retrain.csv": ("unknown", "unknown"), "b": ("unknown", "track_b"), "data": ("unknown", "track_a")}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    split, track = triplets.source_tags(F.col("p"))
    assert [tuple(r) for r in df.select(split, track).collect()] == list(cases.values())


def test_rouge_counts_multisets(spark):
    pairs = spark.createDataFrame([(1, "a a b", "a b b"), (2, "", ""), (3, "x", "x"), (4, "a", "")], "k int, anchor string, candidate string")
    out = {r.k: r for r in overlap.pair_metrics(pairs, ["k"]).collect()}
    assert out[1].rouge_1_f1 == pytest.approx(2 / 3) and out[1].jaccard == 1.0
    assert out[1].rouge_2_f1 == pytest.approx(0.5)
    assert out[2].rouge_1_f1 == 0.0 and out[3].rouge_1_f1 == 1.0 and out[3].rouge_2_f1 == 0.0 and out[4].anchor_overlap == 0.0


def test_pairs_are_counted_in_their_rows(spark):
    rows = [(1, "a b a b c d", "a b c a b"), (2, None, "x"), (3, "Don't don't x", "x don't X"), (4, "a", "a")]
    schema = "k int, anchor string, candidate string"
    once = spark.createDataFrame(rows, schema)
    out = overlap.pair_metrics(once, ["k"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = {r.k: r for r in overlap.pair_metrics(once, ["k"], unique=False).collect()}
    assert {r.k: r for r in out.collect()} == want and want[1].rouge_2_f1 == pytest.approx(6 / 9) and want[3].rouge_1_f1 == pytest.approx(4 / 6)
    # pairs of one key count as one for ROUGE, as in SQL
    twice = overlap.pair_metrics(spark.createDataFrame([*rows, (4, "b", "c")], schema), ["k"]).where("k = 4").collect()
    assert [r.rouge_1_f1 for r in twice] == [0.5, 0.5] and sorted(r.jaccard for r in twice) == [0.0, 1.0]


def test_first_of_equal_hard_negatives(spark):
    anchors = spark.createDataFrame([(1, "a b", 7), (2, "a b", 8)], "anchor_id int, anchor string, k int")
    rows = [(0, "", "neutral", 7), (1, "a", "neutral", 7), (2, "b", "neutral", 7), (0, "a", "neutral", 8), (1, "b", "CONTRADICTION", 8)]
    out = overlap.hard_negatives(anchors, spark.createDataFrame(rows, "pos int, hypothesis string, label string, k int"), "k")
    assert {r.anchor_id: (r.pos, round(r.score, 3)) for r in out.collect()} == {1: (1, 0.5), 2: (1, 0.55)}


def test_negatives_without_a_shared_word(spark):
    anchors = spark.createDataFrame([(1, "a b", 7), (2, "x", 7), (3, "", 7), (4, "q", 9)], "anchor_id int, anchor string, k int")
    rows = [(0, "c", "neutral", 7), (1, " ", "neutral", 7), (2, "x y", "contradiction", 7), (3, "d", "contradiction", 7), (4, "a c d e f g h i j k l m n o p q r s t u v w", "neutral", 7), (0, None, "neutral", 9)]
    out = overlap.hard_negatives(anchors, spark.createDataFrame(rows, "pos int, hypothesis string, label string, k int"), "k")
    assert {r.anchor_id: (r.pos, round(r.score, 3)) for r in out.collect()} == {1: (2, 0.05), 2: (2, 0.55), 3: (2, 0.05)}


def test_content_lemmas_come_from_a_hook(spark):
    pairs = spark.createDataFrame([(1, "run runs", "runs walk"), (2, None, "")], "k int, anchor string, candidate string")
    lemmas = lambda c: F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda x: x != ""), lambda x: F.rtrim(x, F.lit("s")))
    assert {r.k: r.pos_overlap for r in overlap.pair_metrics(pairs, ["k"], lemmas).collect()} == {1: 0.5, 2: 0.0}


def scored(spark, rows):
    return spark.createDataFrame(rows, "q long, c long, sim double, rel boolean")


def test_metrics_of_a_perfect_ranking_are_one(spark):
    rows = [(q, 10 * q + k, 1 - k / 10, k < 3) for q in range(4) for k in range(8)]
    out = retrieval.mean_metrics(retrieval.per_query(retrieval.ranked(scored(spark, rows)), (1,)), (1,)).first()
    assert (out.map, out.ndcg, out.r_precision, out.hits_at_1, out.p_at_1) == (1.0, 1.0, 1.0, 1.0, 1.0)


def test_metrics_by_hand(spark):
    rows = [(1, 1, 0.9, False), (1, 2, 0.8, True), (1, 3, 0.7, False), (1, 4, 0.6, True), (2, 1, 0.5, False)]
    r = retrieval.ranked(scored(spark, rows))
    (p,) = retrieval.per_query(r, (2,)).collect()
    assert p.ap == pytest.approx((1 / 2 + 2 / 4) / 2) and p.r_precision == 0.5 and p.first_hit == 2 and p.p_at_2 == 0.5
    assert p.ndcg == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3)))
    assert [tuple(x) for x in retrieval.precision_at_own_size(r).collect()] == [(2, 0.5, 1)]
    assert retrieval.recall_and_median_rank(r, (1, 5)).first().median_rank == 2


def test_self_wins_if_all_others_are_negative(spark):
    rows = [(1, 2, -0.5, False), (1, 3, -0.1, False)]
    assert retrieval.nearest_label(scored(spark, rows)).first().c == 3
    (r,) = retrieval.nearest_label(scored(spark, rows), zero_self=True).collect()
    assert (r.c, r.rel) == (1, True)


def test_ties_speak_for_b(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [2.0, 0.0], False), ([0.0, 0.0], [1.0, 0.0], [0.0, 1.0], True)], "x array<double>, y array<double>, z array<double>, gold boolean")
    out = vectors.triplet_similarities(df, F.col("x"), F.col("y"), F.col("z"))
    assert [r.predicted for r in out.collect()] == [False, False]
    assert vectors.triplet_accuracy(out).first().accuracy == 0.5


def test_block_products_agree_with_plain_ones(spark):
    rnd = random.Random(1)
    x = {i: [rnd.uniform(-1, 1) for _ in range(5)] for i in range(40)}
    x[40] = [0.0] * 5
    df = spark.createDataFrame(list(x.items()), "vec_id long, embedding array<double>")
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    cos = {(a, b): dot(x[a], x[b]) / math.sqrt(dot(x[a], x[a]) * dot(x[b], x[b])) for a in range(40) for b in range(40) if a != b}
    got = {(r.q, r.c): r.sim for r in vectors.pair_scores(df, df, block=7).collect()}
    assert got.keys() == cos.keys() and all(abs(got[k] - cos[k]) < 1e-9 for k in cos)
    top = vectors.search(df, df, 3, 0.2, block=7).collect()
    for q in range(40):
        want = sorted((-s, c) for (a, c), s in cos.items() if a == q and s >= 0.2)[:3]
        assert [r.c for r in sorted((r for r in top if r.q == q), key=lambda r: r["rank"])] == [c for _, c in want]


def test_summaries(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    out = {r.g: r for r in stats.summary(df, ["g"], "v", True).collect()}
    assert (out["a"].mean, out["a"].median, out["a"].std, round(out["a"].p10, 9), out["a"].max, out["a"].n) == (2.0, 2.0, 1.0, 1.2, 3.0, 2)
    assert out["b"].std == 0.0
    assert stats.summary(df.limit(0), [], "v").first().n == 0


def test_quantiles_are_those_of_numpy(spark):
    import numpy as np

    rnd = random.Random(8)
    rows = [(g, rnd.choice([None, float(rnd.randrange(9)), rnd.random()])) for g in ["a"] * 50 + ["b"] * 7 + [None] * 30 + ["c"]] + [("d", None)]
    out = {r.g: r for r in stats.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], F.col("v"), {"x": 0.1, "y": 0.5, "z": 1.0}).collect()}
    for g in {g for g, v in rows if v is not None}:
        mine = [v for h, v in rows if h == g and v is not None]
        assert [out[g].x, out[g].y, out[g].z] == pytest.approx(np.quantile(mine, [0.1, 0.5, 1.0]).tolist())
    assert "d" not in out
    empty = stats.quantiles(spark.createDataFrame([], "v double"), "v", (0.5,)).first()
    assert empty.q50 is None and empty.mean is None


def test_spearman_ignores_monotone_maps_and_constants(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(6), rnd.random()) for _ in range(60)]
    df = spark.createDataFrame([(float(a), b, math.exp(a), 1.0) for a, b in rows], "x double, y double, z double, k double")
    a, b = (stats.correlations(df, [], c, "y").first().spearman for c in ("x", "z"))
    assert a == pytest.approx(b)
    assert tuple(stats.correlations(df, [], "k", "y").first()) == (0.0, 0.0, 60)


def test_the_first_mode_wins(spark):
    df = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "a", 3), ("g", "b", 4)], "g string, v string, o int")
    assert [tuple(r) for r in stats.first_mode(df, ["g"], "v", "o").collect()] == [("g", "b", 2)]


def test_histograms_have_all_bins(spark):
    df = spark.createDataFrame([(0,), (3,), (3,)], "v int")
    assert sorted(tuple(r) for r in stats.histogram(df, "v").collect()) == [(0, 1), (1, 0), (2, 0), (3, 2)]
    assert stats.histogram(df.limit(0), "v").count() == 0


def test_components_are_those_of_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(7, None)]
    up = list(range(500))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    out = {r.node: r.component for r in clusters.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert out == {x: root(x) for e in edges if e[1] is not None and e[0] != e[1] for x in e}
    assert clusters.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_runs_and_neighbours(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate("aabba")] + [(2, 0, None), (2, 1, None), (3, 0, "z")], "g int, o int, v string")
    assert [r.run for r in corpus.runs(df, ["g"], "o", "v").orderBy("g", "o").collect()] == [1, 1, 2, 2, 3, 1, 1, 1]
    pairs = corpus.adjacent_pairs(df.where("g <> 2"), "g", "o", "o").orderBy("g", "a").collect()
    assert [(r.a, r.b) for r in pairs] == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 3), (0, 0)]


def test_better_items_count_whether_kept_or_not(spark):
    items = spark.createDataFrame([("g", k) for k in range(3)], "group string, item int")
    pairs = spark.createDataFrame([("g", 0, 1, 0.9), ("g", 1, 2, 0.7), ("g", 0, 2, 0.1)], "group string, a int, b int, sim double")
    assert [r.item for r in corpus.keep_first(items, pairs).collect()] == [0]


def test_splits_are_disjoint_and_stable(spark):
    df = spark.range(2000).withColumn("s", corpus.split_column(F.col("id"), forced_test=F.col("id") < 5))
    counts = {r.s: r["count"] for r in df.groupBy("s").count().collect()}
    assert sum(counts.values()) == 2000 and 0.75 < counts["train"] / 2000 < 0.85
    assert df.where("id < 5").select("s").distinct().first().s == "test"
    folds = corpus.stratified_folds(spark.range(100).withColumn("l", F.col("id") % 2), "l", "id", 5).groupBy("l", "fold").count().collect()
    assert {r["count"] for r in folds} == {10}


def test_draws_take_the_first_item_that_reaches(spark):
    w = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 3.0)], "g string, item string, w double")
    d = spark.createDataFrame([("g", 0, 0.25), ("g", 1, 0.26), ("g", 2, 1.0)], "g string, draw int, u double")
    assert {r.draw: r.item for r in corpus.inverse_cdf(w, "g", "item", "w", d).collect()} == {0: "a", 1: "b", 2: "b"}


def test_documents_without_known_words_are_zero(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x")], "d int, w string")
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 0.0])], "word string, vec array<double>")
    assert {r.d: r.vec for r in corpus.mean_vectors(t, v, "d", "w", 2).collect()} == {1: [2.0, 1.0], 2: [0.0, 0.0]}


def test_vocabulary_order(spark):
    t = spark.createDataFrame([(w,) for w in "b b a a c d d d".split()], "w string")
    assert sorted(tuple(r) for r in corpus.vocabulary(t, "w", 2, ("<s>",)).collect()) == [("<s>", 0, 0), ("a", 2, 2), ("b", 2, 3), ("d", 3, 1)]


def test_losses(spark):
    pairs = spark.createDataFrame([(1, 1, 1.0, "pos"), (1, 2, 0.0, "other"), (1, 1, 0.5, "hard")], "anchor int, other int, sim double, kind string")
    got = losses.info_nce(pairs, 1.0, 0.1).first().loss
    assert got == pytest.approx(math.log(math.e + 1 + math.exp(0.6)) - 1)
    r = spark.range(1).select(losses.hinge(F.lit(0.9), F.lit(0.1)).alias("a"), losses.cosine_embedding(F.lit(-0.3), F.lit(-1)).alias("b"), losses.cosine_embedding(F.lit(0.4), F.lit(1)).alias("c")).first()
    assert (r.a, r.b, r.c) == (0.0, 0.0, 0.6)


def test_places_in_an_order_and_in_groups(spark):
    rnd = random.Random(8)
    rows = [(rnd.randrange(3), rnd.random()) for _ in range(200)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    assert [r.v for r in ordering.numbered(df, [F.desc("v")], "n").orderBy("n").collect()] == sorted((v for _, v in rows), reverse=True)
    for g in range(3):
        got = ordering.numbered_within(df, ["g"], ["v"], "n").where(F.col("g") == g).orderBy("n").collect()
        assert [(r.n, r.v) for r in got] == list(enumerate(sorted(v for h, v in rows if h == g), 1))
    assert ordering.numbered(df.limit(0), ["v"], "n").count() == 0


def test_nested_folds_learn_what_can_be_learned(spark):
    rnd = random.Random(6)
    rows = [(k % 3, ("x", "y")[k % 2], [k % 2 + rnd.gauss(0, 0.1), rnd.gauss(0, 1)]) for k in range(60)]
    df = spark.createDataFrame(rows, "fold int, name string, v array<double>")
    out = losses.nested_probe(df, "name", "v", "fold", (0.0, 5.0)).collect()
    assert [r.fold for r in out] == [0, 1, 2] and all(r.accuracy >= 95 for r in out)
    (r, *_) = losses.nested_probe(df.where("fold < 2"), "name", "v", "fold", (0.03,), hidden=3).collect()
    assert r.accuracy >= 90


def test_encoded_triplets_are_those_of_a_plain_loop(spark):
    import duckdb
    import numpy as np

    from narrascope.functions import hooks
    from narrascope.plans import catalogue
    from narrascope.plans.views import TT

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rows = con.execute(f"WITH {TT} SELECT anchor_text, text_a, text_b, gold FROM tt").fetchall()
    model = hooks.hashing_encoder()

    def cosine(a, b):
        x, y = model([a or " ", b or " "])
        n = np.linalg.norm(x) * np.linalg.norm(y)
        return None if n == 0 or a is None or b is None else float(x @ y) / n

    sims = [(cosine(x, a), cosine(x, b), gold) for x, a, b, gold in rows]
    right = [((sa is not None and sb is not None and sa > sb + 1e-12) == gold) for sa, sb, gold in sims]
    got = catalogue.QUERIES["encoded_triplets"](spark, sf).first()
    assert got.n == len(rows) and got.accuracy == pytest.approx(sum(right) / len(right), abs=0.02)


def test_encoded_triplets_join_vectors_and_not_texts(spark):
    from narrascope.functions import hooks
    from narrascope.plans import catalogue

    plan = catalogue.QUERIES["encoded_triplets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "embedding" in plan
    rows = [(1, "a b"), (2, "c"), (3, None), (4, ""), (5, "a b"), (5, "c"), (None, "c")]
    df = spark.createDataFrame(rows, "id int, t string")
    out = hooks.with_vectors(df, "t", lambda: hooks.hashing_encoder(8), "v")
    assert out.columns == ["id", "v"]
    want = {t: r.embedding for t, r in ((r.text, r) for r in hooks.encode_distinct(df, ["t"], lambda: hooks.hashing_encoder(8)).collect())}
    assert sorted(((r.id, r.v) for r in out.collect()), key=str) == sorted(((i, want.get(t)) for i, t in rows), key=str)


def test_blocks_on_a_grid_equal_all_pairs(spark, monkeypatch):
    import numpy as np

    from narrascope.operators import blocks, losses, vectors

    monkeypatch.setattr(blocks, "HELD", 2)
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(150, 4))
    x[20:30], x[40] = x[0], 0.0  # ties and a zero vector
    label = rnd.integers(0, 12, 150)
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(150)] + [(200, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    sim = lambda i, j: float(x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j])) if i != 40 and j != 40 else float("nan")
    order = {i: sorted((j for j in range(150) if j not in (i, 40)), key=lambda j: (-round(sim(i, j), 9), j)) for i in range(150) if i != 40}
    for first in (False, True):
        got = {r.q: r.ranks for r in vectors.relevant_ranks(df, df, first=first, block=16).collect()}
        for i in order:
            want = [k + 1 for k, j in enumerate(order[i]) if label[j] == label[i]]
            assert (got[i] or []) == (want[:1] if first else want), i
        assert got[40] is None and got[200] is None
    best = {}
    for r in vectors.pair_scores(df, df, top=3, least=0.2, block=16).collect():
        best.setdefault(r.q, []).append(r.c)
    assert {q: sorted(c) for q, c in best.items()} == {i: sorted(j for j in order[i][:3] if sim(i, j) >= 0.2) for i in order if sim(i, order[i][0]) >= 0.2}
    few = df.where("vec_id < 60 and vec_id <> 40")
    loss = {r.anchor: r.loss for r in losses.in_batch_loss(few, few.withColumn("embedding", F.reverse("embedding")), few, 0.5, 0.1).collect()}
    for i in loss:
        z = [float(x[i] @ x[j][::-1] / np.linalg.norm(x[i]) / np.linalg.norm(x[j])) / 0.5 for j in range(60) if j != 40]
        h = [sim(i, j) / 0.5 + (0.1 if i == j else 0) for j in range(60) if j != 40]
        own = float(x[i] @ x[i][::-1] / np.linalg.norm(x[i]) ** 2) / 0.5
        assert abs(loss[i] - (np.log(np.exp(z + h).sum()) - own)) < 1e-9


def test_words_of_mean_vectors_are_counted_once(spark, monkeypatch):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "x"), (2, "x"), (3, None), (None, "a")], "d int, w string")
    v = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 3.0])], "word string, vec array<double>")
    for most in (corpus.MATRIX_BYTES, 0):
        monkeypatch.setattr(corpus, "MATRIX_BYTES", most)
        out = corpus.mean_vectors(t, v, "d", "w", 2)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
        assert {r.d: r.vec for r in out.collect()} == {1: [2.0, 1.0], 2: [0.0, 0.0], 3: [0.0, 0.0], None: [0.0, 0.0]}


def tied_vectors(spark):
    import numpy as np

    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(300, 4))
    x[20:60], x[60:70], x[40] = x[0], 2 * x[1], 0.0  # ties, of one label and of several, and a zero vector
    label = rnd.integers(0, 5, 300)
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(300)] + [(400, None, 1), (401, [1.0, 0.0, 0.0, 0.0], 77), (402, [0.0, 1.0, 0.0, 0.0], None)]
    return x, label, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_metrics_of_ranks_leave_their_cells_as_one_row_a_query(spark, monkeypatch):
    import numpy as np

    from narrascope.operators import blocks

    x, label, df = tied_vectors(spark)
    want = {r.q: r for r in retrieval.per_query_ranks(vectors.relevant_ranks(df, df, block=32), (1, 5)).collect()}
    got = vectors.rank_metrics(df, df, (1, 5), block=32).collect()
    assert len(got) == len(want) == 299
    for r in got:
        for c in ("ap", "ndcg", "r_precision", "first_hit", "r", "p_at_1", "p_at_5"):
            assert abs(r[c] - want[r.q][c]) < 1e-12, (r, want[r.q])
    # candidates in a file, few queries at a time
    monkeypatch.setattr(blocks, "SPOOL", 1 << 10)
    monkeypatch.setattr(blocks, "ROWS", 1 << 13)
    fold = blocks.RankMetrics((1, 5), True)
    made = [blocks.Block(np.arange(k, k + 50), x[k : k + 50], label[k : k + 50], {}) for k in range(0, 300, 50)]
    fold.start(made[:2])
    for b in made:
        list(fold.add(b))
    rows = [r for batch in fold.rows() for r in batch.to_pylist()]
    assert {r["q"] for r in rows} == set(range(100)) - {40}
    assert all(r["r"] == (label == label[r["q"]]).sum() - 1 - (label[40] == label[r["q"]]) for r in rows)
    near = {r.q: r for r in vectors.rank_metrics(df.where("vec_id < 300"), df.where("vec_id < 300"), (1, 5), block=32).collect()}
    for r in rows:
        assert abs(r["ap"] - near[r["q"]].ap) < 1e-12 and r["hits"] == [near[r["q"]].p_at_1, 5 * near[r["q"]].p_at_5]


def test_candidates_that_all_cells_see_are_written_once_and_not_exchanged(spark, monkeypatch):
    from narrascope.operators import blocks

    x, label, df = tied_vectors(spark)
    single = df.withColumn("embedding", F.col("embedding").cast("array<float>"))
    want = {r.q: r for r in retrieval.per_query_ranks(vectors.relevant_ranks(single, single, block=32), (1, 5)).collect()}
    monkeypatch.setattr(blocks, "SPOOL", 1 << 10)
    for candidates in (single, single.select("*")):
        out = vectors.rank_metrics(single, candidates, (1, 5), block=32)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        got = out.collect()
        assert len(got) == len(want) == 299
        for r in got:
            assert all(abs(r[c] - want[r.q][c]) < 1e-12 for c in ("ap", "ndcg", "r_precision", "first_hit", "r", "p_at_1", "p_at_5"))
    assert vectors.rank_metrics(single, single.where("vec_id < 0")).count() == vectors.rank_metrics(single.where("vec_id < 0"), single).count() == 0
    # vectors of single precision are packed so
    size = {d: blocks.packed(d.where("vec_id < 300"), "vec_id", "embedding", "label", 300, 1024)[0].agg(F.sum(F.length("data"))).first()[0] for d in (df, single)}
    assert size[df] - size[single] == 300 * 4 * 4


@pytest.mark.parametrize("name", ["p_at_k_n", "r_precision", "map_score", "retrieval_summary"])
def test_queries_on_ranks_read_written_blocks(spark, name):
    from narrascope.plans import catalogue

    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan


def test_blocks_of_a_label_and_best_pairs(spark):
    import numpy as np

    from narrascope.operators import blocks

    x, label, df = tied_vectors(spark)
    with np.errstate(invalid="ignore"):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = (u[:, None] * u).sum(axis=2).tolist()
    for earlier in (False, True):
        got = {r.q: r.c for r in vectors.best_of_label(df, df, earlier=earlier, block=16).collect()}
        some = {i: [j for j in range(300) if label[j] == label[i] and j != i and j != 40 and (j < i or not earlier)] for i in range(300) if i != 40}
        assert got == {i: min(c, key=lambda j: (-sim[i][j], j)) for i, c in some.items() if c}
    order = sorted((-sim[i][j], i, j) for i in range(300) for j in range(i + 1, 300) if 40 not in (i, j))
    for top in (20, 1000):
        got = vectors.best_pairs(df.where("vec_id < 300"), top, block=32).collect()
        assert [(r.q, r.c) for r in got] == [(i, j) for _, i, j in order[:top]]
    # what a cell hands on doesn't grow with its vectors
    made = [blocks.Block(np.arange(k, k + 50), x[k : k + 50], label[k : k + 50], {}) for k in range(100, 300, 50)]
    fold = blocks.BestPairs(7)
    fold.start(made)
    for b in made:
        list(fold.add(b))
    assert sum(batch.num_rows for batch in fold.rows()) == 7


def test_narrow_blocks_are_passed_over(spark, monkeypatch):
    import numpy as np

    from narrascope.operators import blocks, vectors

    monkeypatch.setattr(blocks, "MANY", 1)
    rnd = np.random.default_rng(6)
    middle = rnd.normal(size=(12, 16))
    x = np.repeat(middle, 30, axis=0) + 0.02 * rnd.normal(size=(360, 16))
    made = [blocks.Block(np.arange(30 * k, 30 * k + 30), x[30 * k : 30 * k + 30], np.zeros(30, int), {}) for k in range(12)]
    fold = blocks.Best(5, 0.9, "cosine", True)
    fold.start(made)
    for b in made:
        list(fold.add(b))
    assert fold.skipped >= 100 and fold.made <= 44
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(360)], "vec_id long, embedding array<double>")
    s = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(s @ s.T >= 0.9)) if i != j}
    assert {(r.q, r.c) for r in vectors.pair_scores(df, df, least=0.9, block=32).collect()} == want


def test_a_query_without_a_relevant_candidate_is_an_error_on_request(spark):
    from narrascope.operators import retrieval

    rows = spark.createDataFrame([(1, [1, 3]), (2, None)], "q long, ranks array<long>")
    (r,) = retrieval.per_query_ranks(rows, (2,)).collect()
    assert (r.q, r.ap, r.r_precision, r.first_hit, r.p_at_2) == (1, (1 + 2 / 3) / 2, 0.5, 1, 0.5)
    with pytest.raises(Exception, match="no relevant candidate for query 2"):
        retrieval.per_query_ranks(rows, strict=True).collect()
