"""Exact dedup, the filter audit and the repair of conversations against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrascope.llm import chat_repair, exact_dedup, filter_audit, queries, skew
from narrascope.session import Scratch

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


# exact dedup


def groups(rows):
    """What the contract says of (doc_id, text) rows, ids unique or null once."""
    by = {}
    for i, t in rows:
        by.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for t, found in by.items():
        keep = min(found)[3]
        out += [(x[3], keep, len(found), x == min(found), hashlib.sha256(t.encode()).hexdigest()) for x in found]
    return sorted(out, key=repr)


def decided(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


def test_copies_are_found_and_clashing_columns_stay_apart(spark):
    texts = ["a b", "ab", "a  b", "A b", None, "", " \t\n", " ", "größe 𝄞", "gr öße 𝄞", "x" * 3_000_000, "x " * 3_000_000, "one", "two"]
    rows = [*enumerate(texts), (None, "a    b")]
    df = spark.createDataFrame([(i, t, "k", "h", "s") for i, t in rows], "doc_id long, text string, kept string, h string, sha string")
    out = exact_dedup.exact_dedup(df)
    assert set(out.columns) == {"doc_id", "text", "h", "sha", "keep_id", "group_size", "kept", "text_sha256"}
    assert decided(out) == groups(rows)
    assert {(r.h, r.sha) for r in out.collect()} == {("h", "s")}
    assert decided(exact_dedup.exact_dedup(df, keep=["doc_id"])) == groups(rows)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_of_rows_that_tie_one_stays(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    out = exact_dedup.exact_dedup(df).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in out) == [(0, 0, 2, False), (0, 0, 2, True), (1, 1, 3, False), (1, 1, 3, False), (1, 1, 3, True)]


def test_large_groups_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SLICE", 1)
    monkeypatch.setattr(skew, "LEAST", 50)
    rows = [(i, "hot" if i % 3 == 0 else f"text {i // 2}" if i % 7 == 0 else f"own {i}") for i in range(24_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert decided(exact_dedup.exact_dedup(df, keep=["doc_id"])) == groups(rows)


def test_only_possibly_repeated_rows_are_suspects(spark):
    work = Scratch(spark, "test")
    df = work.save(spark.range(40_000).select(F.xxhash64(F.when(F.col("id") < 4000, F.col("id") % 2000).otherwise(F.col("id"))).alias("h"), "id"), "rows")
    got = exact_dedup.flag_repeated(df, work, "flagged").select("id", "suspect").toPandas()
    assert len(got) == 40_000 and got[got.id < 4000].suspect.all()
    assert got[got.id >= 4000].suspect.mean() < 0.05


def test_cells_count_to_two():
    h = np.random.default_rng(0).integers(0, 1 << 63, 5000, np.uint64)
    once, twice = exact_dedup.count_cells(h), exact_dedup.count_cells(np.concatenate([h, h]))
    packed = np.frombuffer(exact_dedup.pack(twice), np.uint8)[None]
    assert exact_dedup.repeated(packed, np.zeros(5000, np.int64), h).all()
    packed = np.frombuffer(exact_dedup.pack(once), np.uint8)[None]
    assert exact_dedup.repeated(packed, np.zeros(5000, np.int64), h).mean() < 0.05
    assert twice.max() == 2 and set(np.unique(once[exact_dedup.cells_of(h)])) <= {1, 2}


# filter audit


def audited(docs, labels):
    """Every filter is run in every order, document by document."""
    lows, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            lows[t or ""] = min(lows.get(t or "", i), i)
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()

    def fails(f, i, t):
        words = [w for w in SPACE.split(t) if w]
        if f == "A":
            return len(words) < 200
        if f == "B":
            return 100 * len(set(words)) < 50 * len(words)
        if f == "C":
            return 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)
        if f == "D":
            return bool(re.search("[#$%&*|]", t))
        return i is not None and i > lows.get(t, i)

    rows = [(i, t or "", p or "", {f for f in "ABCDE" if fails(f, i, t or "")}) for i, t, p in docs]
    removed = {}
    for order in permutations("ABCDE"):
        for _, _, p, failed in rows:
            first = next((f for f in order if f in failed), None)
            removed[p, first] = removed.get((p, first), 0) + 1
    out = []
    for p, order in product({r[2] for r in rows}, permutations("ABCDE")):
        left = [r for r in rows if r[2] == p]
        for step, f in enumerate(order, 1):
            gone = [r for r in left if f in r[3]]
            left = [r for r in left if f not in r[3]]
            redundant = sum(r[2] == p and f in r[3] and any(g in r[3] for g in order[: step - 1]) for r in rows)
            alone = sum(r[2] == p and r[3] == {f} for r in rows)
            out.append((p, "".join(order), step, len(left), len(gone), redundant, alone, sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone), removed.get((p, f), 0)))
    return sorted(out)


def test_the_audit_equals_filters_run_in_every_order(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 2)
    rnd = random.Random(3)
    texts = [" ".join(rnd.choices([f"w{k}" for k in range(rnd.choice([30, 4000]))] + ["UPPER"] * rnd.randrange(3) + ["a|b"] * rnd.randrange(2), k=rnd.randrange(150, 260))) for _ in range(60)]
    texts += texts[:20] + [None, "", " ", "same"] * 3 + ["v " * 400_000]
    docs = [(i, t, rnd.choice(["en", "de", None, "", "part"])) for i, t in enumerate(texts)] + [(None, texts[0], "en"), (5, texts[5], "en"), (5, texts[5], "en")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, len(texts), 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (10**9, 1, 1)]
    df = spark.createDataFrame([(*d, 7, "m") for d in docs], "doc_id long, text string, lang string, mask int, part string")
    marks = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, lang string")
    assert sorted(map(tuple, filter_audit.audit(df, marks).collect())) == audited(docs, labels)
    none = filter_audit.audit(df, marks.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()
    assert tuple(none) == (0, 0, 600 * 4)
    assert filter_audit.audit(df.limit(0), marks).count() == 0


def test_outcome_matrices_have_their_shape_and_balance():
    steps, by = filter_audit.outcome_matrices()
    assert len(steps) == len(set(steps)) == 600 and all(m.shape == (32, 600) and m.dtype == np.int64 for m in by.values())
    first = [k for k, (_, step) in enumerate(steps) if step == 1]
    assert (by["kept"] + by["removed"])[:, first].min() == 1 and not by["redundant"][:, first].any()
    assert sum(by["removed"][:, 5 * k : 5 * k + 5].sum(axis=1) for k in range(120))[1:].tolist() == [120] * 31


# repair


WHOLE = re.compile(r"(s?(ua)+)?")


def cheapest(tokens):
    """The least (cost, audit) of all edits with at most as many insertions as rows, and two."""
    best = None

    def go(k, roles, cost, audit, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if k == len(tokens) and WHOLE.fullmatch(roles):
            best = min(best or (cost, audit), (cost, audit))
        if inserted < 2:
            for r in "ua":
                go(k, roles + r, cost + 5, audit + "I", inserted + 1)
        if k == len(tokens):
            return
        initial, gone, cut = tokens[k]
        go(k + 1, roles, cost + 2, audit + "D", inserted)
        if not gone:
            go(k + 1, roles + initial, cost + 5 * cut, audit + "K", inserted)
            for r in "ua":
                go(k + 1, roles + r, cost + 1 + 5 * cut, audit + "R", inserted)

    go(0, "", 2 * len(tokens), "D" * len(tokens), 2)
    go(0, "", 0, "", 0)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_the_parser_finds_the_cheapest_edits(seed, monkeypatch):
    monkeypatch.setattr(chat_repair, "STRETCH", 2)
    rnd = random.Random(seed)
    for _ in range(60):
        tokens = [(rnd.choice("suaua?"), rnd.random() < 0.2, rnd.random() < 0.2) for _ in range(rnd.randrange(0, 7))]
        codes = bytes(chat_repair._code(i, g, c) for i, g, c in tokens)
        want = cheapest(tokens)
        column = chat_repair.parse(tokens)
        assert min(column[s] for s in chat_repair.WHOLE if s in column) == want
        assert chat_repair.whole(chat_repair.parse_run(codes, chat_repair.STATES)) == want


def repaired(rows, shuffled=True):
    """The contract in plain Python, with the parser tested above; rows are (conv_id, turn, role, text) without damage."""
    kept = {}
    for conv, turn, role, text in rows:
        kept.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(name.encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, tokens, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            body = text.rstrip("\t\n\x0b\x0c\r ")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            tokens.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(tokens, tokens[1:]))
        column = chat_repair.parse(tokens)
        cost, audit = min(column[s] for s in chat_repair.WHOLE if s in column)
        lines, k, state = [], 0, ""
        for e in audit:
            want = "assistant" if state == "u" else "user"
            if e == "I":
                lines.append(want + ":")
                state = want[0]
                continue
            _, role, text = own[k]
            k += 1
            if e != "D":
                role = role if e == "K" else want
                lines.append(f"{role}:{text}")
                state = role[0]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    rnd = random.Random(8)
    word = lambda: rnd.choice(["Yes.", "No!", "why?", "cut", "a b c.", " ", "", None, "ünï."])
    role = lambda: rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
    rows = [(c, t, role(), word()) for c in range(60) for t in range(rnd.randrange(1, 9)) if rnd.random() < 0.9]
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"line {t}.") for t in range(1500)]  # most of all rows
    rows += [(101, None, "user", "no turn."), (101, None, "assistant", "no turn."), (101, 5, "user", "last."), (None, 3, "user", "no id."), (None, 4, "assistant", "x" * 300_000)]
    rows += [(102, 1, "user", "same.")] * 700 + [(102, 2, "assistant", "same.")] * 3
    return rows


@pytest.mark.parametrize("held", [chat_repair.HELD, 100])
def test_conversations_spread_over_tasks_equal_the_plain_rule(spark, monkeypatch, held):
    monkeypatch.setattr(skew, "LEAST", 5)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = conversations()
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, cut int").repartition(5)
        out = chat_repair.repair(chat_repair.damage(df), held)
        assert sorted(map(tuple, out.collect()), key=repr) == repaired(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_conversations_without_rows_and_empty_tables(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    out = chat_repair.repair(chat_repair.damage(df)).collect()
    assert [tuple(r) for r in out] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert chat_repair.repair(df.limit(0)).count() == 0
    plain = chat_repair.repair(df).first()
    assert (plain.cost, plain.audit) == (2, "D")


@pytest.mark.parametrize("name", ["op11_chat_repair", "op12_filter_audit", "op13_exact_dedup"])
def test_queries_agree_with_their_sql(spark, name):
    import duckdb

    got = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    assert want.columns == got.columns
    assert sorted(want.fetchall(), key=repr) == sorted(map(tuple, got.collect()), key=repr)
