"""Brute-force comparisons and edge cases of the operators on texts."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from narrascope.llm import bpe, decontaminate, hmm, line_dedup, ngram_join, quality, sharding, skew
from narrascope.llm.textbatch import LOWER, eights, same_spans, shingle_sets, span_hashes

SF = "/root/testdata/sf0.001"
WORDS = "the of and cat dog sun moon tree ÉTÉ größe x1 y2 zz. Run, sky sea".split()


def thue_morse(n: int) -> list[str]:
    """The word of n letters a and b and its complement, which sums of byte values by place can't tell apart."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return [word, word.translate(str.maketrans("ab", "ba"))]


def sample(seed: int, n: int = 120) -> list[tuple]:
    """Random texts, near copies, exact copies, nulls, empties, blanks and one long text."""
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choices(WORDS + [f"w{rnd.randrange(4000)}" for _ in range(300)], k=rnd.randrange(1, 90))) for _ in range(n)]
    base = [f"b{i}" for i in range(60)]
    for _ in range(30):
        copy = list(base)
        for _ in range(rnd.randrange(0, 3)):
            copy[rnd.randrange(60)] = f"e{rnd.randrange(5)}"
        texts.append(" ".join(copy))
    texts += [texts[0]] * 5 + [None, "", "   ", "one", "Two words", "two WORDS", *thue_morse(1024), *(f"{w} is the same" for w in thue_morse(4096)), " ".join(f"v{i}" for i in range(6000))]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "n", "sig") for i, t in rows], "doc_id long, text string, n_words string, sig string")


def links(rows, k=4, threshold=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_words_that_differ_have_other_hashes():
    words = [w for n in (8, 16, 64, 256, 1024, 4096) for w in thue_morse(n)] + ["a", "a\0", "aaaaaaaa", "aaaaaaaaa", "größe", "x" * 257, "x" * 256]
    flat = [w.encode() for w in words * 2]
    ends = np.cumsum([len(w) for w in flat])
    h = span_hashes(np.frombuffer(b"".join(flat), np.uint8), ends - [len(w) for w in flat], ends).reshape(2, -1)
    assert (h[0] == h[1]).all() and len(set(h[0].tolist())) == len(words)
    x, at = eights(np.frombuffer(b"".join(flat), np.uint8)), ends - [len(w) for w in flat]
    size = np.array([len(w) for w in words])
    assert same_spans(x, at[: len(words)], x, at[len(words) :], size).all()
    for a, b in zip(range(0, 12, 2), range(1, 12, 2)):
        assert not same_spans(x, at[[a]], x, at[[b]], size[[a]])[0]


def test_shingle_sets_are_those_of_plain_python():
    rows = sample(1)
    got = {i: len(u) for i, u in shingle_sets(pa.array([t for _, t in rows], pa.string()), 4)}
    assert got == {i: n for i, (n, _) in links(rows).items()}


def near_copies(seed: int, n: int = 70) -> list[tuple]:
    """Texts of common passages with changes of every size, so that most of their shingles are frequent, and a very long word."""
    rnd = random.Random(seed)
    passages = [[f"p{k}x{i}" for i in range(40)] for k in range(4)]
    texts = []
    for _ in range(n):
        words = [w for p in rnd.sample(passages, rnd.randrange(1, 4)) for w in p]
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5, 9])):
            words[rnd.randrange(len(words))] = f"c{rnd.randrange(9)}"
        texts.append(" ".join(words))
    return list(enumerate([*texts, "y" * 300_000 + " a b c d", "y" * 300_000 + " a b c d e"]))


@pytest.mark.parametrize(("crowded", "few", "many"), [(8, 1_000_000, 64), (2, 0, 64), (1000, 1_000_000, 2)])
@pytest.mark.parametrize(("rows", "k", "threshold"), [(sample(2), 4, 85), (near_copies(4), 5, 80)])
def test_ngram_join_finds_the_components_of_brute_force(spark, monkeypatch, crowded, few, many, rows, k, threshold):
    monkeypatch.setattr(ngram_join, "CROWDED", crowded)
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "MANY", many)
    monkeypatch.setattr(ngram_join, "PART", 16)
    out = ngram_join.ngram_jaccard_join(frame(spark, rows), k=k, threshold=threshold).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == links(rows, k, threshold)


@pytest.mark.parametrize("threshold", [85, 80, 50, 30])
def test_linked_sets_share_a_signature(threshold):
    rng = np.random.default_rng(threshold)
    coarse, seen = np.zeros(1 << ngram_join.SKETCH_BITS, np.uint8), 0
    for _ in range(500):
        n = int(rng.choice([2, 3, 4, 5, 6, 8, 12, 20, 50, 120, 400, 1500]))
        lose, more = rng.integers(0, max(1, n * (100 - threshold) // 100) + 1, 2)
        x = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        y = np.unique(np.concatenate([x[lose:], rng.integers(0, 1 << 63, more).astype(np.uint64)]))
        x = np.unique(x)
        both = len(np.intersect1d(x, y))
        if np.array_equal(x, y) or not both or 100 * both < threshold * (len(x) + len(y) - both):
            continue
        fine = np.zeros(1 << ngram_join.FINE_BITS, np.uint8)
        every = np.union1d(x, y)
        rare = rng.random(len(every)) < rng.choice([0, 0.05, 0.5, 1])
        fine[every >> np.uint64(64 - ngram_join.FINE_BITS)] = np.where(rare, rng.integers(0, 250, len(every)), ngram_join.FREQUENT_LEVEL)
        signer = ngram_join.Signer(coarse, fine, threshold)
        one, two = (np.concatenate([s for s, _ in signer(u)]) for u in (x, y))
        assert len(np.intersect1d(one, two))
        seen += 1
    assert seen > 100


def test_ngram_join_keeps_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, None)], "doc_id long, text string")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(df).collect()), key=str)
    assert out == [(1, 2, 1), (1, 2, 1), (2, 0, 2), (None, 2, None)]
    assert ngram_join.ngram_jaccard_join(df.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [85, 80])
def test_may_link_never_sets_linked_pairs_aside(threshold):
    rng = np.random.default_rng(0)
    for n in (7, 40, 300, 3000, 20000):
        for _ in range(20):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            lose = int(len(x) * (100 - threshold) / (100 + threshold))
            y = np.unique(np.concatenate([x[lose:], rng.integers(0, 1 << 63, lose).astype(np.uint64)]))
            s, t = ngram_join.sketch(x)[None], ngram_join.sketch(y)[None]
            if ngram_join._linked(x, y, threshold):
                assert ngram_join.may_link(s, np.array([len(x)]), t, np.array([len(y)]), threshold)[0]


def contamination(rows, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    wins = {}
    for name, t in items:
        w = low(t)
        for k in range(max(min(1, len(w)), len(w) - window + 1)):
            wins.setdefault(tuple(w[k : k + window]), set()).add(str(name))
    out = {}
    for i, t in rows:
        w, hit, names = low(t), set(), set()
        for win, who in wins.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    names |= who
        out[i] = (len(w), len(hit), sorted(names))
    return out


@pytest.mark.parametrize("round_bytes", [1 << 20, 300])
def test_decontamination_is_that_of_brute_force(spark, monkeypatch, round_bytes):
    monkeypatch.setattr(decontaminate, "ROUND_BYTES", round_bytes)
    rows = sample(3, 60)
    rnd = random.Random(5)
    items = [(0, "cat DOG"), (0, "sun"), (1, None), (2, ""), (3, "never there at all")]
    for k in range(8):
        w = (rows[rnd.randrange(60)][1] or "").split()
        items.append((10 + k, " ".join(w[3:20]) + " tail end of it"))
    got = decontaminate.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), keep=["doc_id", "sig"])
    out = {r.doc_id: (r.n_words, r.n_hit, r.hit_items) for r in got.withColumn("n_hit", decontaminate.n_hit()).collect()}
    assert out == contamination(rows, items)
    assert got.columns == ["doc_id", "sig", "n_words", "hit_spans", "hit_items"]


def test_rounds_are_jobs_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ROUND_BYTES", 60)
    docs = spark.createDataFrame([(None, "sun moon tree one two"), (None, "sun moon tree"), (3, "tree cat"), (3, "tree cat dog"), (4, None)], "doc_id long, text string").withColumn("at", F.lit("clash")).withColumn("row", F.lit(1))
    items = spark.createDataFrame([(k, w) for k, w in enumerate(["sun moon tree", "one two", "cat dog", "tree", "sun", "no such words at all", "tree", "filler words here", "and here as well"])], "item_id long, text string")
    got = decontaminate.decontaminate(docs, items)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and got.columns == ["doc_id", "text", "at", "row", "n_words", "hit_spans", "hit_items"]
    rows = sorted(((r.doc_id or 0, r.n_words, [tuple(s) for s in r.hit_spans], r.hit_items, r["at"], r["row"]) for r in got.collect()), key=str)
    assert rows == [
        (0, 3, [(0, 3)], ["0", "3", "4", "6"], "clash", 1), (0, 5, [(0, 5)], ["0", "1", "3", "4", "6"], "clash", 1),
        (3, 2, [(0, 1)], ["3", "6"], "clash", 1), (3, 3, [(0, 3)], ["2", "3", "6"], "clash", 1), (4, 0, [], [], "clash", 1),
    ]


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = frame(spark, sample(3, 5))
    assert decontaminate.decontaminate(rows, none).where(F.size("hit_spans") > 0).count() == 0
    assert decontaminate.decontaminate(rows.limit(0), none).count() == 0


def test_bpe_is_that_of_the_library_and_decodes_to_the_text(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(7)
    marks = ["'", "s", "re", "ll", "d", "a", "Z", "é", "1", "²", " ", "  ", "\n", "\t", " ", "!", "漢", "😀", "́", "\r\n", "'ve", "<|endoftext|>", "R"]
    texts = ["".join(rnd.choices(marks, k=rnd.randrange(40))) for _ in range(1500)] + [None, "", " ", "'" * 70, "x" * 3000, "ab " * 2000, *thue_morse(1024), *thue_morse(4096), " ".join(thue_morse(1024))]
    texts += texts[:40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    encoded = bpe.encode(df, path)
    rows = bpe.decode(encoded, path).collect()
    for r in rows:
        want = own.encode_ordinary(r.text or "")
        assert r.ids == want
        assert bytes(r.decoded).decode() == (r.text or "")
        at = 0
        for token, offset in zip(r.ids, r.offsets):
            assert offset == at
            at += len(own.decode_single_token_bytes(token))
    trip = {r.doc_id: r for r in bpe.round_trip(df, path, keep=["doc_id"]).collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert trip[i].n_tokens == len(ids)
        assert trip[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert trip[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), path).count() == 0


def test_hidden_markov_likelihoods_are_those_of_the_plain_recursion():
    rng = np.random.default_rng(1)
    size, k = 30, hmm.STATES
    emit = rng.dirichlet(np.ones(size), k).T
    model = hmm.Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), emit)
    lengths = [1, 2, 255, 256, 257, 700, 3, 1300]
    per = np.concatenate([[0], np.cumsum(lengths)])
    obs = rng.integers(0, size, per[-1])
    got = hmm.log_likelihoods(model, obs, per)
    for i, (a, b) in enumerate(zip(per[:-1], per[1:])):
        v, log = model.start * emit[obs[a]], 0.0
        for t in range(a + 1, b):
            c = v.sum()
            v, log = (v / c) @ model.move * emit[obs[t]], log + math.log(c)
        assert got[i] == pytest.approx(log + math.log(v.sum()), rel=1e-9)


def test_baum_welch_does_not_lower_the_likelihood():
    rng = np.random.default_rng(2)
    per = np.arange(0, 2001, 50)
    obs = np.concatenate([np.repeat(rng.integers(0, 20), 50) if rng.random() < 0.5 else rng.integers(0, 20, 50) for _ in range(40)])
    unigram = np.bincount(obs, minlength=20) / len(obs)
    model = hmm.Hmm.initial(unigram)
    before = hmm.log_likelihoods(model, obs, per).sum()
    for _ in range(5):
        model = model.refit(hmm.expectations(model, obs, per), unigram)
    assert hmm.log_likelihoods(model, obs, per).sum() > before + 1


@pytest.mark.parametrize("head", [16000, 20, 0])
def test_base_scores_are_those_of_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(hmm, "HEAD", head)
    rows = sample(9, 60) + [(None, "a null id"), (3, "a repeated id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int")
    out = hmm.score(df).collect()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    count = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_words_outside_the_head_have_emissions_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 0)
    rnd = random.Random(3)
    pools = [[f"{p}{i:02d}" for i in range(40)] for p in "ab"]
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = [(i, " ".join(rnd.sample(pools[i % 2], 40) * 3)) for i in range(400) if i not in held]
    mixed = [w for pair in zip(*pools) for w in pair][:40]
    rows += [(held[0], " ".join(pools[0])), (held[1], " ".join(pools[1])), (held[2], " ".join(mixed))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    score = {r.doc_id: r.score for r in hmm.score(df).where("held_out").collect()}
    assert min(score[held[0]], score[held[1]]) > score[held[2]] + 1


def test_shares_of_the_words_of_a_shape_sum_to_one(spark):
    rng = np.random.default_rng(6)
    c = rng.integers(1, 50, 30)
    n = rng.dirichlet(np.ones(hmm.STATES), 30) * c[:, None]
    q = hmm.packed(n)
    assert np.allclose(hmm.unpacked(q), n / c[:, None], atol=0.01)
    shapes = np.arange(30) % 3
    table = spark.createDataFrame([(i, int(s), int(x), int(y)) for i, (s, x, y) in enumerate(zip(shapes, c, q))], "key long, shape int, c long, q long")
    emit = np.zeros((hmm.SHAPES, hmm.STATES))
    np.add.at(emit, shapes, n)
    shares = hmm.Shares.of(emit, table)
    got = shares(np.append(shapes, [0, 1, 2]), np.append(c, [0] * 3), np.append(q, [0] * 3))
    for s in range(3):
        assert np.allclose(got[:30][shapes == s].sum(axis=0) + got[30 + s], 1, atol=1e-4)


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    rows = sample(19, 80)
    one = {r.doc_id: r.score for r in hmm.score(frame(spark, rows).coalesce(1)).collect()}
    assert {r.doc_id: r.score for r in hmm.score(frame(spark, rows * 1).coalesce(1)).collect()} == one
    twice = hmm.score(frame(spark, rows[::-1]).repartition(5)).collect()
    assert {r.doc_id: r.score for r in twice} == pytest.approx(one, rel=1e-3)


def test_scores_of_an_empty_table_and_of_held_out_rows_only(spark):
    df = spark.createDataFrame([(i, "some words here") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    rows = hmm.score(df).collect()
    assert rows and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in rows)
    assert hmm.score(df.limit(0)).count() == 0


def cleaned(rows, least=50):
    lines = {i: None if t is None else t.split("\n") for i, t in rows}
    count = lambda s: len([x for x in re.split(r"[ \t\x0b\f\r]+", s) if x])
    first, runs = {}, []
    for i in sorted(lines):
        ls = lines[i] or []
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                if sum(map(count, ls[a:b])) >= least:
                    run = tuple(ls[a:b])
                    first.setdefault(run, (i, a))
                    runs.append((i, a, b, run))
    gone = {i: set() for i in lines}
    for i, a, b, run in runs:
        if first[run] != (i, a):
            gone[i] |= set(range(a, b))
    return {i: (None if ls is None else "\n".join(x for k, x in enumerate(ls) if k not in gone[i]), len(gone[i])) for i, ls in lines.items()}


@pytest.mark.parametrize("least", [256, 3])
def test_line_dedup_removes_what_brute_force_removes(spark, monkeypatch, least):
    monkeypatch.setattr(skew, "LEAST", least)
    rnd = random.Random(11)
    pool = [" ".join(rnd.choices(WORDS, k=rnd.choice([0, 3, 8, 20, 55]))) for _ in range(14)]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randrange(0, 14)))) for i in range(25)]
    rows += [(100, "\n".join(pool)), (101, "\n".join(pool)), (102, "\n".join(pool[2:9] + ["own"] + pool[5:])), (103, None), (104, ""), (105, (pool[0] + "\n") * 40), (106, "long " * 30000 + "\n" + pool[3]), (107, "long " * 30000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, line string")
    out = line_dedup.dedup_lines(df)
    assert {r.doc_id: (r.text, r.n_removed) for r in out.collect()} == cleaned(rows)
    assert out.columns == ["doc_id", "text", "line", "n_lines", "n_removed"]
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_line_dedup_of_nulls_repeats_and_nothing(spark):
    long = " ".join(["word"] * 60)
    df = spark.createDataFrame([(None, long), (None, long), (1, long), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(df).collect()), key=str)
    assert got == sorted([(None, long, 0), (None, long, 0), (1, "", 1), (2, None, 0)], key=str)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_shards_fit_and_split_only_where_they_must(spark):
    rows = sample(13, 200) + [(500, "z" * 5000), (501, None), (None, "q"), (None, "q")]
    out = sharding.shard_rows(frame(spark, rows), limit=2000).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    for shard, rs in by.items():
        size = sum(r.n_bytes for r in rs)
        assert size == rs[0].shard_bytes and len(rs) == rs[0].shard_rows
        assert size <= 2000 or len(rs) == 1
        # its parent was over the limit
        parent = [r for s, x in by.items() if s.startswith(shard[:-1]) for r in x]
        assert not shard or sum(r.n_bytes for r in parent) > 2000
    names = sorted(by)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    assert sharding.shard_rows(frame(spark, rows).limit(0)).count() == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    df = frame(spark, [(i, f"text {i} " * 20) for i in range(100)])
    sharding.write_shards(df, str(tmp_path / "s"), limit=3000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 100
    assert set(back.columns) == {*df.columns, "shard"}


def test_quality_is_learned_from_labelled_rows_that_are_not_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out("doc_id")).select("score", "quality", "predicted").collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9


def naive_score(model, text):
    """The mean of the numbers of a text's features, one feature at a time."""
    one = lambda t: list(quality.features(LOWER[np.frombuffer(t.encode(), np.uint8)], np.array([0, len(t.encode())])))
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = []
    for w in words:
        marked = [0, *map(ord, w), 0]
        for n in quality.GRAMS:
            for k in range(len(marked) - n + 1):
                h = n * 0x9E3779B1 & 0xFFFFFFFF
                for c in marked[k : k + n]:
                    h = (h + c) * 0x85EBCA6B & 0xFFFFFFFF
                    h ^= h >> 13
                grams.append(h >> 32 - quality.BITS)
    kinds = [[one(w)[0][0][0][0] for w in words], [one(f"{a} {b}")[1][0][0][0] for a, b in zip(words, words[1:])], grams]
    means = [sum(int(model.table[k]) for k in kind) / len(kind) for kind in kinds if kind]
    return 1 / (1 + math.exp(-sum(means) / max(1, len(means)) / (1 << quality.PLACES) - model.bias))


def test_quality_scores_are_those_of_a_naive_mean_in_any_order(spark):
    rows = sample(17, 200) + [(900, "ab"), (901, "größe ÉTÉ a 漢字"), (902, "a"), (903, "w " * 40000)]
    model = quality.fit([t for _, t in rows], [i % 2 for i, _ in rows])
    got = {r.doc_id: r.score for r in quality.score(frame(spark, rows).repartition(5), model).collect()}
    back = {r.doc_id: r.score for r in quality.score(frame(spark, rows[::-1] * 2).coalesce(1), model).collect()}
    assert got == back and got == pytest.approx({i: naive_score(model, t) for i, t in rows}, rel=1e-12)
    assert quality.score(frame(spark, rows).limit(0), model).count() == 0


def test_the_labelled_sample_is_bounded_and_takes_repeated_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, labels: seen.append((texts, labels)))
    free = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"text {i}") for i in free] + [(free[0], "x" * 5000), (free[1], None), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(free[2], 7), (None, 1)], "doc_id long, quality int")
    quality.train(docs, labels)
    quality.train(docs, labels, sample=5)
    quality.train(docs, labels, sample_bytes=100)
    quality.train(docs.limit(0), labels)
    assert sorted(seen[0][0]) == sorted([*(f"text {i}" for i in free), "x" * 5000, ""])
    assert all(y == int(t.split()[1]) % 2 for t, y in zip(*seen[0]) if t.startswith("text"))
    assert len(seen[1][0]) == 5 and sum(map(len, seen[2][0])) <= 100 and seen[3] == ([], [])


def test_quality_of_odd_texts_and_without_labels(spark):
    model = quality.fit(["good words here", "bad bad bad bad"] * 20, [1, 0] * 20)
    df = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "bad bad bad", 3), (4, "good words", 3)], "doc_id long, text string, score int")
    rows = {r.doc_id: r for r in quality.score(df, model).collect()}
    assert rows[1].score == rows[2].score
    assert rows[None].score < rows[4].score
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    none = quality.train(df.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int"))
    assert {round(r.score, 9) for r in quality.score(df, none).collect() if r.doc_id in (1, 2)} == {0.5}


def test_the_model_beats_its_base_on_held_out_texts(spark):
    out = hmm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    r = out.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r.s - r.b > 0.1 * r.n
