"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import linkgraph

WORDS = r"[^\x20\x09-\x0D]+"

_LETTERS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_TOKENS_2 = _LETTERS + r"|[^0-9A-Za-z\x{80}-\x{10FFFF}\x20\x09-\x0D]+"

OP7 = f"""
WITH once AS (
  SELECT doc_id, source, lang,
         coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS w1,
         coalesce(len(regexp_extract_all(text, '{_TOKENS_2}')), 0)::BIGINT AS w2,
         coalesce(len(regexp_extract_all(text, '{_LETTERS}')), 0)::BIGINT AS clean
  FROM documents),
l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
seen AS (SELECT once.*, toxic, quality FROM once JOIN l USING (doc_id)),
events AS (
  SELECT source, lang, 'words-1' AS tokenizer, 1 AS d, w1 AS t, 1 AS i, 0 AS x, 0 AS r FROM once
  UNION ALL SELECT source, lang, 'words-2', 1, w2, 1, 0, 0 FROM once
  UNION ALL SELECT source, lang, 'words-1', -1, -w1, 0, 1, 0 FROM seen WHERE toxic = 1
  UNION ALL SELECT source, lang, 'words-2', -1, -w2, 0, 1, 0 FROM seen WHERE toxic = 1
  UNION ALL SELECT source, lang, 'words-2', 0, clean - w2, 0, 0, 1 FROM seen WHERE quality = 0 AND toxic = 0)
SELECT source, lang, tokenizer, sum(d)::BIGINT AS n_docs, sum(t)::BIGINT AS n_tokens, sum(i)::BIGINT AS n_inserts,
       sum(x)::BIGINT AS n_deletes, sum(r)::BIGINT AS n_revisions
FROM events GROUP BY source, lang, tokenizer HAVING sum(d) <> 0 OR sum(t) <> 0
"""

OP8 = f"""
WITH w AS (SELECT doc_id, text, coalesce(regexp_extract_all(text, '{WORDS}'), []) AS ws FROM documents),
pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
key AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM win),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM key) WHERE n >= 2),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
echo AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM pos) WHERE word = p GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w WHERE text IS NOT NULL),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM ln WHERE regexp_matches(l, '{WORDS}') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0)::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_lines, coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]')))::BIGINT AS n_alpha, coalesce(echo.n, 0)::BIGINT AS n_echo
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN echo USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
         + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
         + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 16 ELSE 0 END
         + CASE WHEN 100 * n_alpha < 40 * n_words THEN 32 ELSE 0 END + CASE WHEN 100 * n_echo > 30 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed_rules
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_rules & 3) <> 0 AS base_failed, failed_rules = 0 AS kept, failed_rules FROM b
"""


OP10 = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{linkgraph.UPPER}', '{linkgraph.LOWER}'), '{WORDS}'), []) AS ws FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT r, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
sets AS (SELECT r, n, md5(string_agg(k, chr(10) ORDER BY k)) AS h FROM s JOIN n USING (r) GROUP BY r, n),
rep AS (SELECT h, min(r) AS r FROM sets GROUP BY h),
rs AS (SELECT s.r, s.k FROM s JOIN rep USING (r)),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM rs a JOIN rs b ON a.k = b.k AND a.r < b.r GROUP BY a.r, b.r),
link AS (SELECT x, y FROM shared JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
both_ AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(a, b) AS (SELECT r, r FROM rep UNION SELECT reach.a, both_.y FROM reach JOIN both_ ON both_.x = reach.b),
node AS (SELECT sets.r, rep.r AS rep FROM sets JOIN rep USING (h)),
least AS (SELECT reach.a AS rep, min(w.doc_id) AS least FROM reach JOIN node ON node.rep = reach.b JOIN w ON w.r = node.r GROUP BY reach.a),
copies AS (SELECT rep, count(*) AS c FROM node GROUP BY rep),
others AS (SELECT x AS rep, sum(c) AS c FROM both_ JOIN copies ON copies.rep = y GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least.least, w.doc_id) AS component_id, (coalesce(copies.c, 1) - 1 + coalesce(others.c, 0))::BIGINT AS n_links
FROM w LEFT JOIN n USING (r) LEFT JOIN node USING (r) LEFT JOIN least ON least.rep = node.rep LEFT JOIN copies ON copies.rep = node.rep LEFT JOIN others ON others.rep = node.rep
"""


def op6() -> str:
    """The propagation unrolled, a table of ranks for each round."""
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{}}{i}" for i, (h, p, _) in enumerate(sorted(linkgraph.RULES, key=lambda r: -len(r[0] + r[1])))
    )
    ordered = sorted(linkgraph.RULES, key=lambda r: -len(r[0] + r[1]))
    names = "[" + ", ".join(f"'{h}{p}'" for h, p, _ in ordered) + "]"
    says = "[" + ", ".join(f"'{v}'" for *_, v in ordered) + "]"
    link = r"""(?i)(?:href|src)\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)"""
    d = linkgraph.DAMPING
    rounds = "".join(
        f""",
r{k + 1} AS (SELECT host, sum(t) AS t, sum(x) AS x FROM (
  SELECT host, {1 - d} * t0 AS t, {1 - d} * d0 AS x FROM seed
  UNION ALL SELECT dst, {d} * t * n / (sum(n) OVER (PARTITION BY src)), 0 FROM e JOIN r{k} ON host = src
  UNION ALL SELECT src, 0, {d} * x * n / (sum(n) OVER (PARTITION BY dst)) FROM e JOIN r{k} ON host = dst) GROUP BY host)"""
        for k in range(linkgraph.ROUNDS)
    )
    return f"""
WITH u AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{linkgraph.UPPER}', '{linkgraph.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT *, CASE {fits.format(*[""] * len(ordered))} END AS k FROM h),
p AS (SELECT page_id, html, host, path, {names}[k + 1] AS rule, {says}[k + 1] AS ruled FROM j),
seed AS (SELECT host, CASE WHEN count(*) FILTER (ruled = 'allow') > {linkgraph.SEED_SHARE} * count(*) THEN 1.0 ELSE 0.0 END::DOUBLE AS t0,
         CASE WHEN count(*) FILTER (ruled = 'block') > {linkgraph.SEED_SHARE} * count(*) THEN 1.0 ELSE 0.0 END::DOUBLE AS d0 FROM p WHERE host <> '' GROUP BY host),
l AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda x: translate(x, '{linkgraph.UPPER}', '{linkgraph.LOWER}')))) AS dst FROM p),
e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst AND src <> '' GROUP BY src, dst),
r0 AS (SELECT host, {1 - d} * t0 AS t, {1 - d} * d0 AS x FROM seed){rounds}
SELECT p.page_id, p.host, p.path, p.rule,
       coalesce(p.ruled, CASE WHEN r.x > {linkgraph.RATIO} * r.t AND r.x > {linkgraph.FLOOR * (1 - d)} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN r{linkgraph.ROUNDS} r ON r.host = p.host
"""


ORACLE_SQL: dict[str, str] = {"op6_link_graph": op6(), "op7_token_rollup": OP7, "op8_rule_ledger": OP8, "op10_ngram_jaccard": OP10}
