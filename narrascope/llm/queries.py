"""The registered queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.llm import ann, bpe, chat, chat_repair, hmm, quality, warc
from narrascope.llm.decontaminate import decontaminate, n_hit
from narrascope.llm.exact_dedup import exact_dedup
from narrascope.llm.filter_audit import audit
from narrascope.llm.line_dedup import dedup_lines
from narrascope.llm.ngram_join import ngram_jaccard_join
from narrascope.llm.sharding import shard_rows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"),
    )


def vocabulary() -> str:
    """The vocabulary file of the registered BPE query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary(), keep=["doc_id"])


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(0, 2, 1, 1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id = 0, 'user', 'assistant')").alias("role"), F.lit(odd).alias("text"))
    back = chat.digests(chat.format_pieces(chat.path_turns(chat.threads(rows.unionByName(extra)))))
    return back.select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(_table(spark, sf_dir, "documents"))


def op8_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = dedup_lines(_table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op11_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(chat_repair.damage(_table(spark, sf_dir, "conversations")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), keep=["doc_id"])


SQL: dict[str, str] = {}

SQL["op1_ngram_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
entry AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM entry a JOIN entry b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared WHERE 100 * k >= 85 * (na + nb - k)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS c FROM both_ways GROUP BY a)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low.m, d.doc_id)) AS component_id
FROM sized d LEFT JOIN low ON low.a = d.doc_id
"""

SQL["op2_warc"] = r"""
WITH hashed AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(encode(coalesce(html, ''))) AS h FROM pages),
digits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right('000' || bin(CAST(strpos('0123456789abcdef', h[i:i]) - 1 AS BIGINT)), 4)), '') AS b FROM hashed),
named AS (
  SELECT page_id, n, h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * CAST(b[5 * i + 1] AS INT) + 8 * CAST(b[5 * i + 2] AS INT) + 4 * CAST(b[5 * i + 3] AS INT) + 2 * CAST(b[5 * i + 4] AS INT) + CAST(b[5 * i + 5] AS INT), 1)), '') AS d
  FROM digits),
tops AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM named)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM tops
"""

SQL["op3_decontaminate"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM wins),
positions AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
places AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM positions, lengths WHERE i + m - 1 <= len(w)),
found AS (SELECT p.doc_id, p.i, p.m, wins.item_id FROM places p JOIN wins ON p.g = wins.g AND p.m = wins.m),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

SQL["op9_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS s, unnest(range(0, len(string_split(text, chr(10))))) AS i
  FROM documents WHERE text IS NOT NULL),
counted AS (
  SELECT doc_id, i, s, len(list_filter(regexp_split_to_array(s, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM lines),
summed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM counted),
framed AS (
  SELECT *, max(i) OVER a AS i_to, max(c) OVER a AS c_to, min(i) OVER b AS i_from, min(c - w) OVER b AS e_from
  FROM (SELECT *, c - w AS e FROM summed)
  WINDOW a AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
         b AS (PARTITION BY doc_id ORDER BY c RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
runs AS (
  SELECT doc_id, i AS i1, i_to AS i2 FROM framed WHERE c_to - e >= 50
  UNION SELECT doc_id, i_from, i FROM framed WHERE c - e_from >= 50),
content AS (
  SELECT r.doc_id, r.i1, r.i2, array_to_string(string_split(d.text, chr(10))[r.i1 + 1:r.i2 + 1], chr(10)) AS g
  FROM runs r JOIN documents d ON d.doc_id = r.doc_id),
later AS (
  SELECT doc_id, i1, i2 FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i1) AS k FROM content) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i1, i2 + 1)) AS i FROM later),
kept AS (
  SELECT l.doc_id, string_agg(l.s, chr(10) ORDER BY l.i) AS t, count(*) AS n
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i WHERE g.i IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
  CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(k.n, 0) END AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE length(coalesce(k.t, '')) END AS n_chars_kept,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(k.t, '')) END AS text_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

SQL["op4_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, role AS r, text AS t, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, x.turn, x.role, '</s>[INST] ok [/INST]', x.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(turn, role)),
long AS (
  SELECT *, length(role) + length(role) - length(replace(role, '\', '')) + length(text) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(role, '</?s>|\[/?(INST|ROLE)\]')) + len(regexp_extract_all(text, '</?s>|\[/?(INST|ROLE)\]'))
    + 20 + CASE WHEN role = 'assistant' THEN 0 ELSE 15 END AS n
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM long GROUP BY conv_id
"""

SQL["op7_sharding"] = r"""
WITH hashed AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n,
    (md5(coalesce('=' || CAST(doc_id AS VARCHAR), ''))[1:15] || md5(coalesce('=' || text, ''))[1:15]) AS h FROM documents),
digits AS (
  SELECT doc_id, n, array_to_string(list_transform(range(1, 31), lambda i: right('000' || bin(CAST(strpos('0123456789abcdef', h[i:i]) - 1 AS BIGINT)), 4)), '') AS bits
  FROM hashed),
deep AS (SELECT doc_id, n, bits, d, bits[1:d] AS shard FROM (SELECT *, unnest(range(0, 121)) AS d FROM digits)),
sized AS (SELECT shard, sum(n) AS bytes, count(*) AS r, min(bits) AS lo, max(bits) AS hi FROM deep GROUP BY shard),
fit AS (SELECT shard, bytes, r FROM sized WHERE bytes <= 1048576 OR r = 1 OR lo = hi),
found AS (SELECT d.doc_id, d.n, d.shard, d.d, fit.bytes, fit.r, row_number() OVER (PARTITION BY d.doc_id ORDER BY d.d) AS k FROM deep d JOIN fit ON fit.shard = d.shard)
SELECT doc_id, n AS n_bytes, shard, CAST(d AS BIGINT) AS depth, CAST(bytes AS BIGINT) AS shard_bytes, r AS shard_rows FROM found WHERE k = 1
"""

def _op11_sql() -> str:
    """The chart as a recursive table: one row for each conversation and row, one item for each nonterminal.

    An item is its cost in eight digits followed by the audit, which compare as one text, and the repaired lines.
    """

    def edited(item: str, cost: str, letter: str, line: str) -> str:
        return f"{{'v': lpad(CAST(least(99999999, CAST({item}.v[1:8] AS BIGINT) + {cost}) AS VARCHAR), 8, '0') || {item}.v[9:] || {letter}, 't': {item}.t || {line}}}"

    def deleted(item: str) -> str:
        return edited(item, "2", "'D'", "''")

    def taken(item: str, initial: str, role: str) -> str:
        other = "50000000" if initial == "s" else "1 + more"
        return edited(item, f"CASE WHEN gone THEN 50000000 WHEN i = '{initial}' THEN more ELSE {other} END", f"CASE WHEN i = '{initial}' THEN 'K' ELSE 'R' END",
                      f"chr(10) || CASE WHEN i = '{initial}' THEN role ELSE '{role}' END || ':' || text")

    def inserted(item: str, role: str) -> str:
        return edited(item, "5", "'I'", f"'\n{role}:'")

    never = "{'v': '99999999', 't': ''}"
    return rf"""
WITH RECURSIVE bits(n, c, k) AS (
  SELECT n, n, 0 FROM (SELECT unnest(range(0, 256)) AS n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
lookup AS (SELECT list(c ORDER BY n) AS tab FROM bits WHERE k = 8),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
summed AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 20 AS kind
  FROM named, lookup),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(0, CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM summed)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS again,
    right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS last, left(role, 1) AS i
  FROM ordered),
faults AS (
  SELECT *, last = '' AS blank, last <> '' AND again > 1 AS dup, last <> '' AND again = 1 AND last NOT IN ('.', '!', '?') AS cut,
    last = '' OR again > 1 AS gone, CASE WHEN last NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS more,
    lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS j
  FROM placed),
ids AS (SELECT DISTINCT conv_id FROM conversations),
counts AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (k > 1 AND j || i NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n
  FROM faults GROUP BY conv_id),
chart(conv_id, k, p, told, q, answered) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {{'v': '00000000', 't': ''}}, {never}, {{'v': '00000005I', 't': '\nuser:'}},
    {{'v': '00000010II', 't': '\nuser:\nassistant:'}} FROM ids
  UNION ALL
  SELECT conv_id, k, p, told, q, least(answered, {inserted("q", "assistant")}) FROM (
    SELECT conv_id, k, p, told, least(q, {inserted("p", "user")}, {inserted("told", "user")}, {inserted("answered", "user")}) AS q, answered FROM (
      SELECT c.conv_id, f.k, {deleted("c.p")} AS p, least({deleted("c.told")}, {taken("c.p", "s", "")}) AS told,
        least({deleted("c.q")}, {taken("c.p", "u", "user")}, {taken("c.told", "u", "user")}, {taken("c.answered", "u", "user")}) AS q,
        least({deleted("c.answered")}, {taken("c.q", "a", "assistant")}) AS answered
      FROM chart c JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.k = c.k + 1))),
ends AS (
  SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, least(chart.p, chart.answered) AS best
  FROM ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id
    JOIN chart ON chart.conv_id IS NOT DISTINCT FROM ids.conv_id AND chart.k = coalesce(n, 0))
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, CAST(best.v[1:8] AS BIGINT) AS cost, best.v[9:] AS audit, sha256(best.t[2:]) AS repaired_sha256 FROM ends
"""


SQL["op11_chat_repair"] = _op11_sql()

SQL["op12_filter_audit"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lows AS (SELECT t, min(doc_id) AS low FROM texts GROUP BY t),
known AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
masks AS (
  SELECT d.part, coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 3 * length(d.t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > l.low THEN 16 ELSE 0 END AS mask
  FROM texts d JOIN lows l ON l.t = d.t LEFT JOIN known k ON k.doc_id = d.doc_id),
counted AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(f, bit)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before
  FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)),
found AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & own) = 0), 0) AS kept,
    coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & own) > 0), 0) AS removed,
    coalesce(sum(n) FILTER ((mask & before) > 0 AND (mask & own) > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER ((mask & before) = 0 AND (mask & own) > 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER ((mask & before) = 0 AND (mask & own) > 0), 0) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM found
"""

SQL["op13_exact_dedup"] = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
placed AS (
  SELECT *, row_number() OVER own AS place, first(doc_id) OVER own AS keep_id, count(*) OVER (PARTITION BY t) AS size
  FROM texts WINDOW own AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, size AS group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM placed
"""

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_warc": op2_warc,
    "op3_decontaminate": op3_decontaminate,
    "op5_byte_bpe": op5_byte_bpe,
    "op4_chat_format": op4_chat_format,
    "op6_nearest": op6_nearest,
    "op7_sharding": op7_sharding,
    "op8_hmm_score": op8_hmm_score,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality": op10_quality,
    "op11_chat_repair": op11_chat_repair,
    "op12_filter_audit": op12_filter_audit,
    "op13_exact_dedup": op13_exact_dedup,
}
