"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .chat import CLOSE, CONTROLS, ESCAPE, OPEN
from .queries import HOST_RULES, PERCENT, SHARD_BYTES, WINDOW, filter_lines

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sharding() -> str:
    return f"""
WITH k AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS b, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
small AS (SELECT * FROM k WHERE b <= {SHARD_BYTES}),
levels AS (SELECT doc_id, b, h, d, h >> (60 - d)::BIGINT AS p FROM small, range(0, 61) AS r(d)),
sums AS (SELECT d, p, sum(b)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_rows FROM levels GROUP BY d, p HAVING sum(b) <= {SHARD_BYTES}),
own AS (SELECT doc_id, b, d, p, shard_bytes, shard_rows FROM levels JOIN sums USING (d, p) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d) = 1)
SELECT doc_id, b AS n_bytes, d || '-' || p AS shard, d::INTEGER AS depth, shard_bytes, shard_rows, false AS oversized FROM own
"""


def _join() -> str:
    words = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {words} AS w FROM documents),
t AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' ')) END) AS t FROM w),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM t GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {PERCENT} * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(y) FROM reach r WHERE r.x = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""


def _escaped(text: str, breaks: bool = False) -> str:
    text = f"replace({text}, '{ESCAPE}', '{ESCAPE}0')"
    for c in CONTROLS:
        text = f"replace({text}, '{c}', '{c[0]}{ESCAPE}1{c[1:]}')"
    return f"replace({text}, chr(10), '{ESCAPE}2')" if breaks else text


def _chat() -> str:
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(OPEN) + 1 + len(CLOSE)} + length({_escaped('role', True)}) + length({_escaped('text')}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def _contamination() -> str:
    words = lambda t: "regexp_extract_all(" + LOWER.format(f"coalesce({t}, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents),
b AS (SELECT item_id, {words('text')} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, list_aggregate(w[i:i + least(len(w), {WINDOW}) - 1], 'string_agg', ' ') AS t FROM b, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
runs AS (SELECT doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS t FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(i)),
found AS (SELECT doc_id, item_id, i, n FROM runs JOIN windows USING (n, t)),
hit AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _urls() -> str:
    import re

    from .url_rules import filter_rule

    nested = sorted(HOST_RULES, key=lambda r: -len(r[0]))
    fits = lambda r: r"regexp_matches(host || path, '^([^/]*\.)?" + re.escape(r[0]) + "')"
    rule = " ".join(f"WHEN {fits(r)} THEN '{r[0]}'" for r in nested)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r[1]}'" for r in nested)
    lines = [filter_rule(line) for line in filter_lines()]
    rows = ", ".join(f"({i}, '{r.name}', '{r.verdict}', '{r.expression}')" for i, r in enumerate(lines))
    # Constant alternations first: only the few URLs that fit any are held against each line.
    some = " OR ".join("regexp_matches(url, '" + "|".join(f"(?i:{r.expression.removeprefix('(?i)')})" for r in lines[i : i + 100]) + "')" for i in range(0, len(lines), 100))
    return f"""
WITH r AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, url, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
l(i, name, verdict, expression) AS (VALUES {rows}),
near AS (SELECT DISTINCT url FROM u WHERE instr(url, '://') > 0 AND ({some})),
p AS (SELECT url, first(name ORDER BY verdict, i) AS pattern, first(verdict ORDER BY verdict, i) AS says FROM near JOIN l ON regexp_matches(url, expression) GROUP BY url)
SELECT page_id, host, path, CASE {rule} END AS rule, pattern, CASE {verdict} ELSE coalesce(says, 'allow') END AS verdict FROM u LEFT JOIN p USING (url)
"""


ORACLE = {"op1_sharding": _sharding(), "op3_jaccard_join": _join(), "op5_chat_formatting": _chat(), "op6_decontamination": _contamination(), "op9_url_filters": _urls()}
