"""Archives, chat formatting, graph search and the pipeline."""

import gzip
import hashlib
import io
import math


import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from narrascope.llm import ann, blocksum, chat, skew, warc
from narrascope.session import Scratch


def pages(spark):
    rows = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, "http://a/\r\n3", None), (4, None, ""), (5, "http://a/5", "größe WARC/1.1\r\n\r\n x"), (7, "http://a/7", "<p>same</p>"), (None, "http://a/n", "no id")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))


def test_archives_are_read_back_as_they_were_written(spark):
    out = {r.page_id: r for r in warc.archive(pages(spark)).collect()}
    texts = {r.page_id: (r.html or "").encode() for r in pages(spark).collect()}
    assert set(out) == set(texts)
    for k, r in out.items():
        assert r.payload_bytes == len(texts[k])
        assert r.payload_digest == warc.base32_sha1(texts[k])
    assert {k: (r.record_type, r.refers_to) for k, r in out.items()} == {
        1: ("revisit", 7), 2: ("revisit", 7), 7: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("response", None),
    }
    assert warc.archive(pages(spark).limit(0)).count() == 0


def test_small_payloads_are_all_responses(spark):
    out = warc.archive(pages(spark), at_least=5).collect()
    assert {r.page_id for r in out if r.record_type == "revisit"} == {1, 2}


def test_predicates_are_decided_on_headers_and_payloads_are_checked(spark):
    warc.register(spark)
    path = Scratch(spark, "test").path + "/w"
    warc.revisits(pages(spark)).repartition(3).write.format("warc").mode("append").option("path", path).option("filebytes", 100).save()
    rows = spark.read.format("warc").option("path", path).load().where("record_type = 'response' and page_id = 5").collect()
    assert [(r.page_id, bytes(r.payload).decode()) for r in rows] == [(5, "größe WARC/1.1\r\n\r\n x")]
    assert spark.read.format("warc").option("path", path).option("payload", "false").load().where("page_id in (1, 5)").count() == 2
    body = b"payload"
    good = warc.record(1, "u", body, warc.base32_sha1(body), None)
    bad = warc.record(2, "u", b"other", warc.base32_sha1(body), None)
    got = list(warc.read_records(io.BytesIO(good + bad), [("X-Page-ID", {"1"})], True, True))
    assert [(r[0], r[7]) for r in got] == [(1, body)]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good + bad), [], True, True))


def test_folders_without_a_manifest_and_single_files_are_read(spark, tmp_path):
    warc.register(spark)
    body = b"x" * 3_000_000
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    foreign = b"WARC/1.0\r\nwarc-type: response\r\nWARC-TARGET-URI: http://q\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(http + body) + http + body + b"\r\n\r\n"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.warc").write_bytes(info + foreign)
    (tmp_path / "2.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(warc.record(4, "u", b"own", warc.base32_sha1(b"own"), None)))
    (tmp_path / "notes.txt").write_text("no archive")
    rows = spark.read.format("warc").option("path", str(tmp_path)).load().collect()
    assert sorted((r.record_type, r.target_uri, r.payload_bytes, None if r.payload is None else bytes(r.payload)) for r in rows if r.record_type == "response") == [("response", "http://q", 3_000_000, body), ("response", "u", 3, b"own")]
    assert sum(r.record_type == "warcinfo" for r in rows) == 2
    one = spark.read.format("warc").option("path", str(tmp_path / "2.warc.gz")).load().where("record_type = 'response'")
    assert [r.page_id for r in one.collect()] == [4]


def test_repeated_pages_and_very_long_payloads(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 2)
    rows = [(1, "a", "same")] * 2 + [(k, "b", "same") for k in range(2, 9)] + [(9, "c", "y" * 5_000_000), (9, "c", "y" * 5_000_000)]
    out = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to or 0, r.payload_bytes) for r in out) == sorted(
        [(1, "revisit", 8, 4)] * 2 + [(k, "revisit", 8, 4) for k in range(2, 8)] + [(8, "response", 0, 4)] + [(9, "response", 0, 5_000_000)] * 2
    )


def test_hot_groups_are_joined_like_all_others(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 3)
    rows = spark.createDataFrame([(k % 7 if k < 20 else 1, k) for k in range(60)], "g int, k int")
    groups = rows.where("g <> 6").groupBy("g").agg(F.max("k").alias("top"), F.count("*").alias("n"))
    want = sorted(map(tuple, rows.join(groups.drop("n"), "g", "left").select("g", "k", "top").collect()), key=str)
    assert sorted(map(tuple, skew.hot_join(rows, groups, ["g"], "n", 60, ["k"], "left").collect()), key=str) == want
    assert sorted(map(tuple, skew.hot_join(rows, groups, ["g"], "n", 60, ["k"]).collect()), key=str) == [w for w in want if w[2] is not None]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "[/ROLE]", ""]), st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "/s>", " ", "x", "\n", "é"])).map("".join)), max_size=6))
def test_formatting_can_be_undone(turns):
    formatted, spans = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert all(m not in chat.escape(t) for _, t in turns for m in chat.CONTROL)


def test_best_paths_of_reply_trees(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", -1.0), ("t", 3, 1, "assistant", "good", 2.0), ("t", 4, 3, "user", None, 1.0), ("t", 5, 2, "user", "x", 5.0),
            ("t", 6, 99, None, "orphan", 0.5), ("c", 1, 2, "user", "loop", 0.0), ("c", 2, 1, "user", "loop", 0.0), (None, 1, None, "user", "null tree", None)]
    m = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = chat.paths(m, branches=3).collect()
    assert {(r.tree, r["rank"]): (r.leaf, [(t.role, t.text) for t in r.turns]) for r in out} == {
        ("t", 1): (5, [("user", "q"), ("assistant", "bad"), ("user", "x")]), ("t", 2): (4, [("user", "q"), ("assistant", "good"), ("user", "")]),
        ("t", 3): (6, [("", "orphan")]), (None, 1): (1, [("user", "null tree")]),
    }
    back = chat.read_back(chat.format_paths(chat.paths(m))).collect()
    assert len(back) == 2
    assert chat.paths(m.limit(0)).count() == 0


def test_repeated_messages_and_odd_scores(spark):
    rows = [(1, 1, None, "user", "b", 0.0, "x"), (1, 1, None, "user", "a", float("nan"), "y"), (1, 1, None, "user", "a", float("nan"), "y"), (1, 2, 1, "assistant", "one", float("nan"), "z"),
            (1, 3, 1, "assistant", "two", None, "z"), (1, 4, 1, "assistant", "three", 0.5, "z"), (1, None, 1, "user", "no node", 9.0, "z")]
    m = spark.createDataFrame(rows, "tree int, node int, parent int, role string, text string, score double, key string")
    out = chat.paths(m, branches=5).collect()
    assert [(r["rank"], r.leaf, [t.text for t in r.turns]) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 4, ["a", "three"]), (2, 2, ["a", "one"]), (3, 3, ["a", "two"])]


def test_the_registered_vectors_are_found(spark):
    from narrascope.llm import queries

    sf = "/root/testdata/sf0.1"
    out = queries.op6_nearest(spark, sf).collect()
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(e["embedding"].to_numpy()).astype(float), e["vec_id"].to_numpy()
    got = {}
    for r in out:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        near = x @ x[q]
        near[q] = -np.inf
        hits += len(got[ids[q]] & set(ids[np.argsort(-near, kind="stable")[:20]].tolist()))
    assert len(got) == (ids % 20 == 0).sum() and hits / (20 * len(got)) >= 0.97


def test_pipeline_of_odd_rows_and_of_nothing(spark, tmp_path):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    long = " ".join(f"w{k}" for k in range(80))
    odd = [(None, "no id at all", "en", "s", 3), (900, None, None, None, None), (901, "", "en", "s", 0), (902, " \n ", "en", "s", 3), (903, long, "en", "s", 9), (903, long, "en", "s", 9), (903, "another text of this id", "en", "s", 9)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({c: F.lit(c) for c in ("score", "n_lines", "n_words", "hit_items", "n_tokens", "id", "row", "text_sha256")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    for name, stage in p.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType, name
        assert out.where("score <> 'score' or n_words <> 'n_words' or id <> 'id' or row <> 'row'").count() == 0, name
    kept = {r.doc_id for r in p.run(spark, str(tmp_path)).collect()}
    assert None in kept and {900, 901, 902} <= kept
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert p.run(spark, f"{tmp_path}/none").count() == 0


def test_long_chains_are_enumerated(spark):
    rows = [(1, k, "user", f"text {k}") for k in range(500)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    (r,) = chat.paths(chat.threads(c)).collect()
    assert [t.text for t in r.turns] == [f"text {k}" for k in range(500)]


def test_long_conversations_are_formatted_and_read_back_in_pieces(spark):
    said = [[("user" if k % 2 == 0 else "assistant", f"</s>[INST] text {k} of {c}, größe \\ \U0001d11e" * (k % 3)) for k in range(n)] for c, n in enumerate((1, 2, 300))]
    rows = [(c if c else None, k, *t) for c, turns in enumerate(said) for k, t in enumerate(turns)]
    messages = chat.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    pieces = chat.format_pieces(chat.path_turns(messages), 500)
    parts = {}
    for r in sorted(pieces.collect(), key=lambda r: r.piece):
        parts.setdefault(r.tree, []).append(r)
    digests = {r.tree: r for r in chat.digests(pieces).collect()}
    for c, turns in enumerate(said):
        got, r = parts[c if c else None], digests[c if c else None]
        formatted, spans = chat.format_turns(turns)
        assert "".join(p.formatted for p in got) == formatted and [tuple(s) for p in got for s in p.loss_spans] == spans
        assert [p.last for p in got] == [False] * (len(got) - 1) + [True] and all(len(p.formatted) < 1000 for p in got)
        assert (len(got) > 30) == (c == 2)
        loss = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in turns)
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(turns), len(loss), len(formatted))
        assert (r.turns_sha256, r.loss_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (whole, loss))
    assert chat.digests(chat.format_pieces(chat.path_turns(messages.limit(0)))).count() == 0


def test_paths_below_missing_parents_and_other_types_of_parents(spark):
    rows = [("t", k, 99 if k == 0 else k - 1, "user", f"m{k}", 1.0) for k in range(11)] + [("t", 20, 3, "user", "branch", 50.0), ("u", 5, None, "user", "root", 0.0), ("u", 6, 5, "user", "leaf", 0.0)]
    m = spark.createDataFrame(rows, "tree string, node long, parent int, role string, text string, score double")
    found = {(r.tree, r["rank"]): (r.leaf, [t.text for t in r.turns]) for r in chat.paths(m, branches=2).collect()}
    assert found == {("t", 1): (20, ["m0", "m1", "m2", "m3", "branch"]), ("t", 2): (10, [f"m{k}" for k in range(11)]), ("u", 1): (6, ["root", "leaf"])}


def test_chat_formatting_runs_one_python_worker_for_a_task(spark, monkeypatch):
    from narrascope.llm import queries

    saved = []
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, **more: (saved.append(name), save(self, df, name, **more))[1])
    plan = queries.op4_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "collect_list" not in plan and "ExistingRDD" not in plan
    assert saved == ["nodes", *[f"up-{k}" for k in range(1, len(saved) - 1)], "formatted"] and len(saved) <= 7  # written files are few


def test_search_finds_the_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[:300] = x[0]  # one common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [float("nan")] * 16), (2080, [float("inf")] * 16), (2100, [None] * 16), (2120, [1.0] * 3), (None, x[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    out = ann.nearest(df, F.col("vec_id") % 20 == 0, 10, shard=400).collect()
    exact = x.astype(float) @ x.astype(float).T
    found, n = 0, 0
    for q in range(0, 1500, 20):
        got = sorted((r["rank"], r.vec_id, r.score) for r in out if r.query_id == q)
        assert [g[0] for g in got] == list(range(1, 11))
        for _, v, s in got:
            assert v != q and abs(s - exact[q, v]) < 1e-9
        want = [int(v) for v in np.lexsort((np.arange(1500), -np.round(exact[q], 12))) if v != q][:10]
        found += len(set(want) & {g[1] for g in got})
        n += 10
    assert found / n >= 0.95
    assert {r.query_id for r in out} == set(range(0, 1500, 20))
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_copies_of_a_query_and_queries_in_passes(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 2)
    monkeypatch.setattr(ann, "PASS_BYTES", 200)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4)).round(1)
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + rows[:10], "vec_id long, embedding array<double>")
    out = ann.nearest(df, F.col("vec_id") % 2 == 0, 5, shard=25).collect()
    for q in range(0, 60, 2):
        exact = np.array([math.fsum(a * b for a, b in zip(x[q], y)) for y in x]).round(9)
        want = [int(v) for v in np.lexsort((np.arange(60), -exact)) if v != q][:5]
        assert [r.vec_id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_sums_of_many_tasks(spark):
    rows = [(k % 3, np.arange(4, dtype=np.int64).tobytes()) for k in range(400)]
    df = spark.createDataFrame(rows, "block int, cells binary").repartition(300)
    got = blocksum.summed(df, 3 * blocksum.CELLS, np.int64).reshape(3, -1)
    assert got[:, :4].tolist() == [[0, n, 2 * n, 3 * n] for n in (134, 133, 133)] and not got[:, 4:].any()


def test_few_candidates_are_all_returned(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    out = ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in out] == [(4, 6.0), (3, 5.0), (2, 4.0), (1, 3.0)]


def test_pipeline_stages_do_what_brute_force_does(spark):
    from tests.llm.test_text_operators import cleaned, contamination, links

    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(p.STAGES)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    clean = {r.doc_id: r.text for r in stages["line dedup"](spark, docs, sf).collect()}
    want = cleaned(rows)
    assert clean == {i: t for i, (t, n) in want.items() if n == 0 or n < len(dict(rows)[i].split("\n"))}
    near = {r.doc_id for r in stages["n-gram Jaccard join"](spark, docs, sf).collect()}
    assert near == {i for i, (_, c) in links(rows, 5, 80).items() if c == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r.doc_id for r in stages["benchmark decontamination"](spark, docs, sf).collect()}
    assert left == {i for i, (_, n, _) in contamination(rows, items).items() if n == 0}
    for name, stage in p.STAGES[:4]:
        assert stage(spark, docs, sf).columns == docs.columns, name
    out = p.run(spark, sf).collect()
    assert 0 < len(out) < len(rows)
    assert {r.doc_id for r in out} <= set(dict(rows))
    assert all(len(r.decoded_sha256) == len(hashlib.sha256().hexdigest()) for r in out)
