"""One thin query per training-data operator: production parameters, whole tables, full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_transducer, chat_format, conversation_repair, cotraining, hamming_search, line_dedup, packing, quality_rules, secret_scan, simhash_dedup, source_divergence, source_mix, toxicity
from .common import table


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.components(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_report(table(spark, sf_dir, "documents"))


def op5_pack_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming_search.sign_code(F.col("embedding")).alias("code"))
    return hamming_search.search(rows.where("id % 20 = 0"), rows).drop("radius")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -1L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    return chat_format.digests(chat_format.format_conversations(rows.unionByName(probe)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.delete_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op12_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_transducer.digests(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.damage(rows), rows)


QUERIES = {
    "op1_cotraining": op1_cotraining,
    "op2_secret_ownership": op2_secret_ownership,
    "op3_simhash_components": op3_simhash_components,
    "op4_source_mix": op4_source_mix,
    "op5_pack_histogram": op5_pack_histogram,
    "op6_hamming_topk": op6_hamming_topk,
    "op7_chat_format": op7_chat_format,
    "op8_quality_rules": op8_quality_rules,
    "op9_toxicity_fm": op9_toxicity_fm,
    "op10_line_dedup": op10_line_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_bpe_transducer": op12_bpe_transducer,
    "op13_conversation_repair": op13_conversation_repair,
}


_KEYWORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = f"""(?:{_KEYWORD})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = ((_ASSIGN, "assign"), ("AKIA[A-Z0-9]{12,}", "access"), ("[0-9a-f]{32,}", "hex"), ("[A-Za-z0-9+/_=-]{20,}", "token"))
_FOUND = " UNION ALL ".join(f"SELECT doc_id, source, lang, {k} AS kind, '{name}' AS name, regexp_extract_all(t, '{p}', 0) AS m, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}')" for k, (p, name) in enumerate(_KINDS))

_SIGNS = "list_transform(embedding, lambda x: x > 0)"


# The cheapest repair so far, as one string that orders as it should: cost, edits, an end mark, the rows with a line end before each.
def _step(x: str, w: object, letter: str, piece: str = "''") -> str:
    return f"lpad((substr({x}, 1, 9)::BIGINT + {w})::VARCHAR, 9, '0') || substr({x}, 10, strpos({x}, chr(1)) - 10) || '{letter}' || substr({x}, strpos({x}, chr(1))) || {piece}"


_IN_USER, _IN_ASSISTANT = (f"chr(10) || '{r}:'" for r in ("user", "assistant"))


def _keep(x: str) -> str:
    return f"CASE WHEN may THEN {_step(x, 'late', 'K', 'chr(10) || role || chr(58) || text')} END"


def _give(x: str, role: str) -> str:
    return f"CASE WHEN may THEN {_step(x, '(late + 1)', 'R', f'chr(10) || {chr(39)}{role}:{chr(39)} || text')} END"


def _gone(x: str) -> str:
    return _step(x, 2, "D")


ORACLE: dict[str, str] = {
    "op6_hamming_topk": f"""WITH c AS (SELECT vec_id AS id, {_SIGNS} AS s FROM embeddings WHERE len(embedding) > 0),
 d AS (SELECT q.id AS query_id, r.id AS neighbour_id, len(list_filter(list_transform(generate_series(1, len(q.s)), lambda i: q.s[i] IS DISTINCT FROM r.s[i]), lambda x: x)) AS distance FROM c q, c r WHERE q.id % 20 = 0 AND q.id <> r.id),
 n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d) SELECT query_id, rank, neighbour_id, distance FROM n WHERE rank <= 10""",
    "op2_secret_ownership": f"""WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents), raw AS ({_FOUND}),
 sp AS (SELECT *, unnest(generate_series(1, len(m))) AS i FROM raw),
 pos AS (SELECT doc_id, source, lang, kind, name, m[i] AS v, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS s FROM sp),
 c AS (SELECT *, s + length(v) AS e, CASE WHEN kind = 0 THEN regexp_extract(v, '{_ASSIGN}', 1) ELSE v END AS val FROM pos),
 b AS (SELECT * FROM c WHERE kind < 3 AND (kind <> 0 OR length(val) >= 8)),
 l AS (SELECT * FROM c WHERE kind = 3 AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = c.doc_id AND b.s < c.e AND c.s < b.e)),
 a AS (SELECT * FROM b UNION ALL SELECT * FROM l),
 st AS (SELECT val, count(DISTINCT source) AS n_owners, count(DISTINCT source || '/' || lang) AS n_repos FROM a GROUP BY val),
 j AS (SELECT a.*, n_owners, n_repos, name || ':' || s || ':' || e AS txt FROM a JOIN st USING (val))
 SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(txt, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(txt, ',' ORDER BY s, kind) FILTER (kind < 3 OR n_owners <= 1), '') AS spans,
  count(*) FILTER (n_owners < 3) AS n_live, count(*) FILTER (n_owners >= 3) AS n_example, coalesce(max(n_repos), 0) AS most_repos FROM d LEFT JOIN j USING (doc_id) GROUP BY d.doc_id""",
    "op7_chat_format": r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256, coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256, sum(20 + 2 * length(r || x) - length(translate(r || x, '^<[', '')))::BIGINT AS formatted_chars FROM c GROUP BY conv_id""",
    "op11_source_divergence": r"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
 w AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
 v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
 t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
 p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + v.v) AS p FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v) AS q FROM kept JOIN v USING (lang)),
 s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
 pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
 terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
 SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200""",
    "op13_conversation_repair": rf"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
 src AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
 hit AS (SELECT src.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM src, tab),
 hurt AS (SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
 ord AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS i, substr(role, 1, 1) AS ini, rtrim(text, E'\x20\t\n\x0B\f\r') AS body FROM hurt),
 dup AS (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS seen, lag(ini) OVER (PARTITION BY k ORDER BY i) AS prev FROM ord),
 seq AS (SELECT *, body = '' AS blank, body <> '' AND seen AS copied, body <> '' AND NOT seen AND right(body, 1) NOT IN ('.', '!', '?') AS cut, body <> '' AND NOT seen AS may, CASE WHEN body <> '' AND NOT seen AND right(body, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS late FROM dup),
 facts AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (copied) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (i > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM seq GROUP BY k),
 dp AS (SELECT k, 0::BIGINT AS i, '000000000' || chr(1) AS x0, NULL::VARCHAR AS xs, NULL::VARCHAR AS xu, NULL::VARCHAR AS xa FROM facts
  UNION ALL SELECT k, i, {_gone('x0')}, least({_gone('xs')}, CASE WHEN ini = 's' THEN {_keep('x0')} END),
   least({_gone('yu')}, {', '.join(f"CASE WHEN ini = 'u' THEN {_keep(x)} END, {_give(x, 'user')}" for x in ('x0', 'xs', 'ya'))}),
   least({_gone('ya')}, CASE WHEN ini = 'a' THEN {_keep('yu')} END, {_give('yu', 'assistant')})
   FROM (SELECT *, least(xa, {_step('yu', 5, 'I', _IN_ASSISTANT)}) AS ya FROM (SELECT dp.*  EXCLUDE (i), seq.i, seq.ini, seq.role, seq.text, seq.may, seq.late, least(xu, {_step('x0', 5, 'I', _IN_USER)}, {_step('xs', 5, 'I', _IN_USER)}, {_step('xa', 5, 'I', _IN_USER)}) AS yu FROM dp JOIN seq ON seq.k = dp.k AND seq.i = dp.i + 1))),
 best AS (SELECT k, least(x0, xa, {_step(f"({_step('xs', 5, 'I', _IN_USER)})", 5, 'I', _IN_ASSISTANT)}, {_step('xu', 5, 'I', _IN_ASSISTANT)}) AS x FROM dp JOIN facts USING (k) WHERE dp.i = facts.n)
 SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(substr(x, 1, 9)::BIGINT, 0) AS cost,
  coalesce(substr(x, 10, strpos(x, chr(1)) - 10), '') AS audit, sha256(coalesce(substr(x, strpos(x, chr(1)) + 2), '')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts ON facts.k = coalesce(o.conv_id::VARCHAR, ' ') LEFT JOIN best ON best.k = facts.k""",
}
