"""Hand-computed cases and properties of the scalar functions."""

import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrascope.functions import hooks, html, parsing, similarity, text
from narrascope.session import share_code


def one(spark, **cols):
    """The row of constant columns."""
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_tokenizers_differ_in_contractions_and_scripts(spark):
    r = one(spark, a=text.ascii_words(F.lit("Don't x² größe café_1")), w=text.words(F.lit("Don't x² größe café_1")), n=text.words(F.lit(None).cast("string")))
    assert r.a == ["don't", "x", "gr", "e", "caf", "1"]
    assert r.w == ["don", "t", "x²", "größe", "café_1"]
    assert r.n == []


def test_ngrams_of_short_lists_are_none(spark):
    t = F.array(*[F.lit(x) for x in "abc"])
    r = one(spark, two=text.ngrams(t, 2), four=text.ngrams(t, 4), zero=text.ngrams(t, 0))
    assert r.two == ["a\u0001b", "b\u0001c"] and r.four == [] and r.zero == []


@pytest.mark.parametrize(("s", "sentences", "words"), [("One. Two! Three?", 3, 3), ("", 0, 0), ("  \n ", 0, 0), ("no end", 1, 2), ("a.b c.", 1, 2), (None, 0, 0), ("Hi.  \n There", 2, 2)])
def test_counts(spark, s, sentences, words):
    c = F.lit(s).cast("string")
    r = one(spark, s=text.sentence_count(c), w=text.word_count(c))
    assert (r.s, r.w) == (sentences, words)


def test_strip_takes_all_white_space(spark):
    r = one(spark, s=text.strip(F.lit("\t\n a b  ")), k=text.cache_key(F.lit(" é\n")), f=text.flatten_lines(F.lit("a\r\nb\n")))
    assert r.s == "a b" and r.f == "a b"
    assert r.k == hashlib.sha1("é".encode()).hexdigest()


def test_spans_are_replaced_from_left_to_right(spark):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("text")) for a, b, t in [(6, 9, "Z"), (0, 3, "X"), (2, 7, "Y")]])
    r = one(spark, s=text.replace_spans(F.lit("0123456789"), spans), m=text.mask_entities(F.lit("Ann and Anna"), F.array(F.struct(F.lit("Ann").alias("text"), F.lit("PER").alias("tag")))))
    kept = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).cast("string").alias("text")) for a, b, t in [(1, 3, None), (5, 6, "-")]])
    assert one(spark, s=text.replace_spans(F.lit("0123456789"), kept)).s == "01234-6789"
    assert r.s == "X345Z9" and r.m == "PER and PERa"


#: Markup and its text by the rules of a lenient parser's tree.
PAGES = [
    ("<h2 class=x>Head</h2><div>no</div><p>One &amp; <b>two</b></p><H3>Sub</H3><dl>list</dl>", "# Head\nOne & two\n## Sub\nlist"),
    ("<h2><span>Plot</span></h2><p>x</p>", "x"),
    ("<h2>Plot<span>[edit]</span></h2>", "# Plot"),
    ("<h2>Plot<!-- c -->more</h2>", "# Plot"),
    ("<dl>t<dd>x</dd></dl>", "tx"),
    ("<dd>a<dd>b</dd></dd>", "ab"),
    ("<p>one<p>two</p>", "one\ntwo"),
    ("<p><b>one<p>two", "one\ntwo"),
    ("<p>one<h2>H</h2>lost<p>two", "one\n# H\ntwo"),
    ("<div><p>inside</p></div><p>outside</p>", "outside"),
    ("<!DOCTYPE html><html><head><title>t</title></head><body><p>a</body></html>", "a"),
    ("<p>a<br>b<img src='x>y'>c</p>d", "abc"),
    ("<p>a<div>b</div>c</p>d<p>e</p>", "a\ne"),
    ("<p>x<script>if (a < b) '</p>'</script>y</p>", "xif (a < b) '</p>'y"),
    ("<p>&lt;tag&gt; &eacute;&#233;&nbsp;</p>", "<tag> éé"),
    ("<table><tr><td><p>cell</td></tr></table></p><p>end</p>", "end"),
    ("<p>a</span></div>b</p>", "ab"),
    ("<h2>\n</h2><p> </p><p>z</p>", "# \n\nz"),
    ("<p/>t<p>u", "u"),
    ("no markup", ""),
    ("", ""),
    ("<p>" + "<i>" * 3000 + "deep", "deep"),
    ("<p", ""),
]


def test_markup_becomes_text_by_its_tree(spark):
    share_code(spark)
    df = spark.createDataFrame([(k, m) for k, (m, _) in enumerate(PAGES)] + [(-1, None)], "k int, m string")
    got = {r.k: r.t for r in df.select("k", html.html_to_plain(F.col("m")).alias("t")).collect()}
    assert got.pop(-1) is None
    for k, (m, want) in enumerate(PAGES):
        assert got[k] == want, m[:60]


def test_other_text_functions(spark):
    r = one(
        spark, p=text.pseudonym("Location", F.lit(27)), e=text.split_events(F.lit(" a | | b")), i=text.intro_and_body(F.lit("x\n\ny\n\nz")), j=text.intro_and_body(F.lit("x")),
        s=text.first_long_section(F.lit("short"), F.lit("l" * 101)), f=text.file_stem(F.lit("/a/b.c.json")), t=text.truncate(F.array(F.lit("a"), F.lit("b")), 1), q=text.prompt("%s-%s", F.lit("a"), F.lit(1)),
    )
    assert r.p == "Location B" and r.e == ["a", "b"] and tuple(r.i) == ("x", "y\n\nz") and tuple(r.j) == ("x", None)
    assert r.s == "l" * 101 and r.f == "b.c" and r.t == ["a"] and r.q == "a-1"


def test_overlap_of_empty_sets_is_zero(spark):
    none, some = F.array().cast("array<string>"), F.array(F.lit("a"), F.lit("b"), F.lit("a"))
    r = one(spark, a=similarity.jaccard(none, none), b=similarity.jaccard(some, none), c=similarity.coverage(none, some), d=similarity.jaccard(some, some), e=similarity.coverage(some, F.array(F.lit("a"))))
    assert (r.a, r.b, r.c, r.d, r.e) == (0.0, 0.0, 0.0, 1.0, 0.5)


def test_cosine_without_a_direction(spark):
    zero, x = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    nan = F.array(F.lit(float("nan")), F.lit(1.0))
    r = one(spark, a=similarity.cosine(zero, x), b=similarity.cosine_or_zero(zero, x), c=similarity.cosine_or_zero(nan, x), u=similarity.unit(x), f=similarity.pair_features(x, zero))
    assert r.a is None and r.b == 0.0 and r.c == pytest.approx(0.8) and r.u == [0.6, 0.8] and r.f == [3.0, 4.0, 0.0, 0.0]


def test_pooling(spark):
    v = F.array(F.array(F.lit(1.0), F.lit(5.0)), F.array(F.lit(3.0), F.lit(1.0)))
    r = one(spark, m=similarity.masked_mean(v, F.array(F.lit(1), F.lit(0)), 2), x=similarity.max_pool(v, 2), n=similarity.masked_mean(v, F.array(F.lit(0), F.lit(0)), 2))
    assert r.m == [1.0, 5.0] and r.x == [3.0, 5.0] and r.n == [None, None]


def test_pooling_modes(spark):
    layer = lambda *rows: F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])
    layers, mask = F.array(layer((0, 0), (2, 2)), layer((4, 0), (0, 4)), layer((1, 3), (3, 1))), F.array(F.lit(1), F.lit(1))
    r = one(spark, **{m: similarity.pooled(layers, mask, m, 2) for m in ("cls", "avg", "avg_top2", "avg_first_last")})
    assert (r.cls, r.avg, r.avg_top2, r.avg_first_last) == ([1.0, 3.0], [2.0, 2.0], [2.0, 2.0], [1.5, 1.5])


@pytest.mark.parametrize("score", [1.0, 2.3, 4.99, 5.0])
def test_soft_labels_expect_the_score(spark, score):
    s = similarity.soft_label(F.lit(score))
    r = one(spark, s=s, e=similarity.expected_score(s))
    assert sum(r.s) == pytest.approx(1) and r.e == pytest.approx(score)


def plain_decision(raw):
    """The rules of an answer in plain Python; what can't be read is an empty object."""
    t = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", (raw or "").strip(), flags=re.I).strip())
    start, depth, d = t.find("{"), 0, {}
    for i in range(max(start, 0), len(t)):
        depth += (t[i] == "{") - (t[i] == "}")
        if start >= 0 and depth == 0:
            try:
                d = json.loads(t[start : i + 1])
            except (ValueError, RecursionError):
                pass
            break
    one = lambda s: "A" if "A" in s.upper() and "B" not in s.upper() else "B" if "B" in s.upper() and "A" not in s.upper() else None
    found = [one(d[k]) for k in parsing.CLOSER if isinstance(d.get(k), str)]
    inner = [[x for x in map(one, (y for y in v.values() if isinstance(y, str))) if x] for v in d.values() if isinstance(v, dict)]
    text = json.dumps(d, ensure_ascii=False)
    lone = [x for x in "AB" if re.search(rf"\b{x}\b", text)]
    closer = next((x for x in found if x), None) or next((x[0] for x in reversed(inner) if x), None) or (lone[0] if len(lone) == 1 else "A")
    given = d.get("aspects") or d.get("similarity_aspects")
    if isinstance(given, dict):
        flags = [bool(given.get(k)) for k in parsing.ASPECTS]
    else:
        names = {str(x).lower() for x in given} if isinstance(given, list) else set()
        flags = [bool({k, short} & names) for k, short in parsing.ASPECTS.items()]
    return closer, flags, str(next((d[k] for k in parsing.WHY if d.get(k)), parsing.NO_REASON))


def test_decisions(spark):
    rnd = random.Random(3)
    values = ["A", "b", "Story A", "text B", "AB", "none", "", 5, 0, None, True, {"x": "B"}, {"x": 1, "y": "a", "z": "b"}, {}, ["B"], "see A."]
    keys = [*parsing.CLOSER, "other", "more", "why", "reason", "explanation"]
    aspects = [{}, [], ["theme", "Outcomes"], {"abstract_theme": "no", "outcomes": 0}, {"course_of_action": True}, "theme", ["action", 3, None]]
    raws = ['{"r": {"z": "B", "a": "A"}}', '{"closer": "A", "closer": "B"}', '{"x": NaN, "closer": "B"}', '{"x": -Infinity}', "} {" + '"a": {}}', "[" * 5000, "{" * 5000 + "}" * 5000, '{"x": "\\nA"}', None, "", "{}", "The answer is: B", '{"closer": "B"', 'x {"output":{"label":"Text A"}} y', '```json\n{"closer":"b","why":"x"}\n```', "```\n{}\n```"]
    for _ in range(400):
        d = {k: rnd.choice(values) for k in rnd.sample(keys, rnd.randrange(5))}
        d |= {k: rnd.choice(aspects) for k in rnd.sample(parsing.GIVEN, rnd.randrange(3))}
        raws.append(rnd.choice(["", "so: ", "```json\n"]) + json.dumps(d))
    share_code(spark)
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k int, raw string")
    for r in df.select("k", "raw", parsing.decision(F.col("raw")).alias("d")).collect():
        closer, flags, why = plain_decision(r.raw)
        assert (r.d.closer, list(r.d.aspects)) == (closer, flags), r.raw
        assert r.d.why == why, r.raw


def test_unreadable_answers_are_repaired(spark):
    fix = lambda c: F.lit('{"closer": "B"}')
    r = one(spark, a=parsing.decision(parsing.repaired(F.lit("{oops}"), fix)), b=parsing.decision(parsing.repaired(F.lit('{"closer": "A"}'), fix)), c=parsing.decision(parsing.repaired(F.lit(None).cast("string"), fix)))
    assert (r.a.closer, r.b.closer, r.c.closer) == ("B", "A", "B")


def test_first_object_counts_braces(spark):
    r = one(spark, a=parsing.first_object(F.lit('say {"a":{"b":1}} and {"c":2}')), b=parsing.first_object(F.lit("none {")), c=parsing.first_object(F.lit("no")))
    assert r.a == '{"a":{"b":1}}' and r.b is None and r.c is None


def test_labels_as_text(spark):
    kinds = [(True, "boolean", "true"), (None, "boolean", "missing"), (2.0, "double", "2"), (2.5, "double", "2.5"), (float("nan"), "double", "nan"), (" Yes ", "string", "yes"), ("  ", "string", "missing")]
    for value, kind, want in kinds:
        assert one(spark, x=parsing.normal_label(F.lit(value).cast(kind), kind)).x == want
    assert parsing.discovered_label(["x", "gold", "label"]) == "label"
    names = ["text_a_is_closer", "label", "gold_label", "y", "target"]
    assert [parsing.discovered_label(names[k:]) for k in range(6)] == [*names, None]


def test_hooks_encode_each_text_once(spark):
    df = spark.createDataFrame([("a b", "c"), ("a b", None), ("", "c")], "x string, y string")
    rows = hooks.encode_distinct(df, ["x", "y"], lambda: hooks.hashing_encoder(8)).collect()
    assert {r.text for r in rows} == {"a b", "c", ""}
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-9 or not any(r.embedding) for r in rows)
    out = df.select(hooks.score_pairs(lambda: lambda a, b: [float(len(x) - len(y)) for x, y in zip(a, b)], F.col("x"), F.col("y")).alias("s"), hooks.subword_counts(lambda: len, F.col("y")).alias("n")).toPandas()
    assert out["s"].tolist() == [2.0, 3.0, -1.0] and out["n"].tolist() == [1, 0, 1]


def test_a_larger_budget_is_tried_for_empty_answers(spark):
    df = spark.createDataFrame([("p",), (None,)], "p string")
    out = df.select(hooks.complete(lambda: lambda p, n: "ok" if n > 500 else "", F.col("p"), tokens=200).alias("a"), hooks.complete(lambda: lambda p, n: "", F.col("p")).alias("b")).collect()
    assert [r.a for r in out] == ["ok", None] and [r.b for r in out] == [None, None]
