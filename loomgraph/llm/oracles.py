"""DuckDB SQL of those operator queries that SQL can express."""

from __future__ import annotations

from .quality import RULES, STOP_WORDS
from .urls import BLOCKED_HOSTS
from .urls import RULES as URL_RULES

SPLIT = "'[\\x20\\x09-\\x0D]+'"
WORDS = f"list_filter(string_split_regex(coalesce(text, ''), {SPLIT}), lambda w: w <> '')"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(list_slice(ws, s, s + 19), ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM d)),
late AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM late),
kept AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d) w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""


def _limits() -> str:
    value = {"mean_word_chars": "word_chars / n_words", "symbol_ratio": "n_symbols / n_words", "stop_ratio": "n_stop / n_words", "dup_line_ratio": "n_dup_lines / n_lines"}
    parts = [f"{value[r.measure]} >= {r.low}" for r in RULES if r.low is not None] + [f"{value[r.measure]} <= {r.high}" for r in RULES if r.high is not None]
    return " AND ".join(parts)


QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, s, hash(list_slice(ws, s, s + 7)) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS s FROM d)),
twice AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
cover AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
  len(list_filter(ws, lambda w: length(w) <= 8 AND list_contains({STOP_WORDS!r}, lower(regexp_replace(w, '[.,;:!?]+$', ''))))) AS n_stop FROM d LEFT JOIN cover ON cover.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  CASE WHEN n_words < 20 OR 100 * n_repeat_words > 30 * n_words THEN FALSE ELSE {_limits()} END AS kept FROM m"""

_ESCAPED = "replace(replace(coalesce({}, ''), chr(92), chr(92) || 'b'), '<', chr(92) || 'l')"
CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, r, chr(92) || '### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
t AS (SELECT *, 20 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) AS size, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS upto FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR n = total) AS BIGINT) AS formatted_chars FROM p GROUP BY conv_id"""


def _url() -> str:
    def fits(rule: str) -> str:
        host, path = rule.split("/", 1)
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"

    by_length = sorted(URL_RULES, key=lambda r: (-len(r), r))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r in by_length) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in URL_RULES.items()) + " ELSE CASE WHEN " + " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in BLOCKED_HOSTS) + " THEN 'block' ELSE 'allow' END END"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host, path = "regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)", "regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1)"
    return f"WITH p AS (SELECT page_id, {lower.format(host)} AS host, {path} AS path FROM pages), r AS (SELECT *, {rule} AS rule FROM p) SELECT page_id, host, path, rule, {verdict} AS verdict FROM r"


NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, {WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL),
n AS (SELECT min(doc_id) AS id, coalesce(text, '') AS text, any_value(ws) AS ws FROM d GROUP BY coalesce(text, '')),
s AS (SELECT id, g, 1 + ln(count(*)) AS x FROM (SELECT id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM n WHERE len(ws) > 0)) GROUP BY id, g),
z AS (SELECT id, sum(x) AS total FROM s GROUP BY id),
o AS (SELECT a.id AS a, b.id AS b, any_value(za.total) AS ta, any_value(zb.total) AS tb, sum(a.x) AS sa, sum(b.x) AS sb FROM s a JOIN s b ON a.g = b.g AND a.id < b.id JOIN z za ON za.id = a.id JOIN z zb ON zb.id = b.id
  GROUP BY a.id, b.id HAVING sum(least(a.x / za.total, b.x / zb.total)) >= 0.8 - 1e-9),
v AS (SELECT o.*, p.x AS x, q.x AS y, sum(p.x) OVER w AS cx, sum(q.x) OVER w AS cy FROM o JOIN s p ON p.id = o.a JOIN s q ON q.id = o.b AND q.g = p.g WINDOW w AS (PARTITION BY o.a, o.b ORDER BY q.x / p.x)),
e AS (SELECT a, b FROM v GROUP BY a, b HAVING sum(1 / ((ta - sa + cx) / x + (tb - cy) / y)) >= 0.8 - 1e-9),
both AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(id, c) AS (SELECT id, id FROM n UNION SELECT both.b, reach.c FROM reach JOIN both ON both.a = reach.id),
k AS (SELECT id, min(c) AS class_id FROM reach GROUP BY id)
SELECT d.doc_id, k.class_id, d.doc_id = k.class_id AS kept FROM d JOIN n ON n.text = coalesce(d.text, '') JOIN k ON k.id = n.id""".replace("both", "links")

def _crc32(number: str) -> str:
    """CRC-32 of a number's decimal digits, bit by bit."""
    byte = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))"
    codes = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: {byte}), 4294967295)"


TRIE = f"""
WITH conv AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, {_crc32("conv_id")} % 4 AS h, conv_id - conv_id % 20 AS head FROM (SELECT DISTINCT conv_id FROM conv)),
r AS (SELECT i.conv_id, 0 AS own, c.pos, role, text FROM ids i JOIN conv c ON c.conv_id = i.head AND c.pos <= h UNION ALL SELECT conv_id, 1, pos, role, text FROM ids JOIN conv USING (conv_id) WHERE pos > h),
t AS (SELECT conv_id, row_number() OVER w AS d, text, string_agg(md5(role) || md5(text), '') OVER w AS k FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)),
m AS (SELECT conv_id, d, k, len({WORDS}) AS words FROM t UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM m GROUP BY d, k),
kids AS (SELECT d - 1 AS d, left(k, len(k) - 64) AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (d, k)),
below AS (SELECT a.d, a.k, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved_tokens FROM x JOIN m a ON a.conv_id = x.conv_id AND a.d <= x.d GROUP BY a.d, a.k),
ends AS (SELECT d, k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max(d) AS d, arg_max(k, d) AS k FROM m GROUP BY conv_id) GROUP BY d, k)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM x JOIN below USING (d, k) LEFT JOIN ends USING (d, k) LEFT JOIN n p ON p.d = x.d - 1 AND p.k = left(x.k, len(x.k) - 64)"""


def _leaf(text: str) -> str:
    part = "coalesce(CAST(octet_length(encode({0})) AS VARCHAR) || ':' || {0}, '-')"
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(part.format(f) for f in fields) + ")"


MERKLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source AS s, {_leaf("text")} AS leaf, {_leaf(f"CASE WHEN {_crc32('doc_id')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS got FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf, got) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM d),
up(s, v, i, n, h) AS (SELECT s, 0, i, n, leaf FROM l UNION ALL SELECT s, v + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY s, v, i // 3, n),
runs AS (SELECT s, v, i // 3 AS p, array_agg(h ORDER BY i) AS hs FROM up WHERE n > 1 GROUP BY s, v, i // 3),
sub AS (SELECT s, h, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top(v, i, n, h) AS (SELECT 0, i, n, h FROM sub UNION ALL SELECT v + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY v, i // 3, n),
over AS (SELECT v, i // 3 AS p, array_agg(h ORDER BY i) AS hs FROM top WHERE n > 1 GROUP BY v, i // 3),
a(s, k, v, i, n, f, proof) AS (SELECT s, i, 0, i, n, got, '' FROM l UNION ALL SELECT a.s, k, a.v + 1, i // 3, (n + 2) // 3,
  sha256(array_to_string(hs[1:i % 3] || [f] || hs[i % 3 + 2:], '')), proof || array_to_string(hs[1:i % 3] || hs[i % 3 + 2:], '') FROM a JOIN runs r ON r.s IS NOT DISTINCT FROM a.s AND r.v = a.v AND r.p = a.i // 3 WHERE a.n > 1),
b(s, k, v, i, n, f, proof) AS (SELECT a.s, k, 0, sub.i, sub.n, f, proof FROM a JOIN sub ON sub.s IS NOT DISTINCT FROM a.s WHERE a.n = 1 UNION ALL SELECT b.s, k, b.v + 1, i // 3, (n + 2) // 3,
  sha256(array_to_string(hs[1:i % 3] || [f] || hs[i % 3 + 2:], '')), proof || array_to_string(hs[1:i % 3] || hs[i % 3 + 2:], '') FROM b JOIN over o ON o.v = b.v AND o.p = b.i // 3 WHERE b.n > 1)
SELECT doc_id, leaf, sub.h AS subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
FROM l JOIN b ON b.s IS NOT DISTINCT FROM l.s AND b.k = l.i AND b.n = 1 JOIN sub ON sub.s IS NOT DISTINCT FROM l.s, (SELECT h AS root FROM top WHERE n = 1)"""

ORACLES = {
    "op11_prefix_trie": TRIE,
    "op13_merkle_manifest": MERKLE,
    "op2_substring_dedup": SUBSTRINGS,
    "op3_quality_rules": QUALITY,
    "op6_chat_formatting": CHAT,
    "op7_url_filter": _url(),
    "op10_minhash_near_dedup": NEAR,
}
