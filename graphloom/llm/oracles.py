"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from graphloom.llm import chat, license_scans, mixing, url_filters

_HEX = "('0x' || substr(md5({0}), {1}, 4))::INTEGER"


def _op1() -> str:
    a, b, z = _HEX.format("host", 1), _HEX.format("host", 5), _HEX.format("zone", 1)
    day = "TIMESTAMP '2024-01-01' + to_days(({0})::INTEGER)"
    host = f"regexp_replace(lower(regexp_extract(coalesce(url, ''), '{url_filters.HOST}', 1)), '\\.$', '')"
    return f"""WITH c AS (SELECT page_id, url, {host} AS host, TIMESTAMP '2024-01-01' + to_seconds(((page_id * 7919) % (90 * 86400))::INTEGER) AS fetched FROM pages),
h AS (SELECT host, {a} AS a, {b} AS b FROM (SELECT DISTINCT host FROM c WHERE host <> '')),
z AS (SELECT zone, {z} AS a FROM (SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.') AS zone FROM h)),
e AS (SELECT 'spam' AS list, host AS domain, true AS act, {day.format('a % 40')} AS fetched FROM h WHERE a % 3 <> 0
 UNION ALL SELECT 'spam', host, false, {day.format('a % 40 + b % 30 + 1')} FROM h WHERE a % 3 <> 0
 UNION ALL SELECT 'spam', host, true, {day.format('a % 40 + b % 30 + 21')} FROM h WHERE a % 3 = 1
 UNION ALL SELECT 'trusted', host, true, {day.format('b % 60')} FROM h WHERE b % 4 = 0
 UNION ALL SELECT 'adult', zone, true, {day.format('a % 50')} FROM z WHERE a % 2 = 0
 UNION ALL SELECT 'adult', zone, false, {day.format('a % 50 + 25')} FROM z WHERE a % 2 = 0),
f AS (SELECT page_id, url, c.fetched, (SELECT e.act FROM e WHERE e.list = l.list AND e.domain = l.domain AND e.fetched <= c.fetched ORDER BY e.fetched DESC, e.act DESC LIMIT 1) AS act, l.list, l.domain
 FROM c JOIN (SELECT DISTINCT list, domain FROM e) l ON c.host = l.domain OR ends_with(c.host, '.' || l.domain)),
g AS (SELECT page_id, url, fetched, count(*) AS hits, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, arg_max(domain, length(domain) * 2 + (list = 'trusted')::INTEGER) AS matched, arg_max(list, length(domain) * 2 + (list = 'trusted')::INTEGER) AS best FROM f WHERE act GROUP BY 1, 2, 3)
SELECT c.page_id, c.url, c.host, strftime(c.fetched, '%Y-%m-%d %H:%M:%S') AS fetched_at, coalesce(g.hits, 0) AS hits, coalesce(g.lists, '') AS lists, coalesce(g.matched, '') AS matched,
 CASE WHEN g.hits IS NULL THEN 'pass' WHEN best = 'trusted' THEN 'allow' ELSE 'block' END AS verdict FROM c LEFT JOIN g ON g.page_id = c.page_id AND g.url IS NOT DISTINCT FROM c.url AND g.fetched = c.fetched"""


def _op2() -> str:
    idf, other, rows = license_scans.model()
    line = license_scans.LINE
    known = ", ".join(f"('{w}', {t}, '{n}', {v!r}::DOUBLE)" for w, t, n, v in rows)
    weight = ", ".join(f"('{w}', {v!r}::DOUBLE)" for w, v in sorted(idf.items()))
    n = license_scans.AROUND
    near = f"CASE WHEN length(x) <= {n} THEN x ELSE regexp_extract(x, '(?i)(.{{0,60}}({line[4:]}).{{0,{n - 60}}})', 1) END"
    return f"""WITH k(word, template, license, w) AS (VALUES {known}), i(word, idf) AS (VALUES {weight}),
f AS (SELECT DISTINCT dir || '/' || name AS path, dir, name, text FROM (SELECT text, coalesce(source, 'none') || '/' || doc_id // 1000 || CASE WHEN doc_id % 100 = 0 THEN '' ELSE '/' || (doc_id % 1000) // 50 END AS dir, CASE WHEN doc_id % 25 = 0 THEN 'LICENSE.' || doc_id ELSE 'file' || doc_id || '.txt' END AS name FROM documents)),
l AS (SELECT path, {near} AS line FROM (SELECT path, unnest(string_split(text, chr(10))) AS x FROM f) WHERE regexp_matches(x, '{line}')),
t AS (SELECT line, word, count(*) AS tf FROM (SELECT line, unnest(regexp_extract_all(lower(line), '{license_scans.WORD}')) AS word FROM (SELECT DISTINCT line FROM l)) GROUP BY 1, 2),
v AS (SELECT line, word, tf * coalesce(idf, {other!r}) AS v FROM t LEFT JOIN i USING (word)), s AS (SELECT line, sqrt(sum(v * v)) AS size FROM v GROUP BY 1),
c AS (SELECT line, license, round(dot / size, 6) AS score FROM (SELECT line, template, license, sum(v * w) AS dot FROM v JOIN k USING (word) GROUP BY 1, 2, 3) JOIN s USING (line) WHERE round(dot / size, 6) >= {license_scans.LEAST}),
o AS (SELECT path, license, score FROM (SELECT path, license, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, license) AS r FROM l JOIN c USING (line)) WHERE r = 1),
p AS (SELECT DISTINCT path, dir, name FROM f), w AS (SELECT dir, min(path) AS from_path, arg_min(license, path) AS license FROM p JOIN o USING (path) WHERE starts_with(name, 'LICENSE') GROUP BY 1),
d AS (SELECT path, from_path, w.license, row_number() OVER (PARTITION BY path ORDER BY length(w.dir) DESC) AS r FROM p JOIN w ON p.dir = w.dir OR starts_with(p.dir, w.dir || '/'))
SELECT p.path, coalesce(o.license, d.license, '') AS license, coalesce(o.score, 0.0)::DOUBLE AS score, CASE WHEN o.license IS NOT NULL THEN 'own' WHEN d.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how, CASE WHEN o.license IS NULL THEN d.from_path END AS from_path
FROM p LEFT JOIN o USING (path) LEFT JOIN d ON d.path = p.path AND d.r = 1"""


_OP4 = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM k UNION SELECT b, a FROM k), r(id, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, w.doc_id) AS component_id, coalesce(s.first, w.doc_id) AS class_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id AS doc_id, min(root) AS root FROM r GROUP BY 1) m USING (doc_id)
LEFT JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS first FROM (SELECT doc_id, list_sort(list(g)) AS s FROM g GROUP BY 1)) s USING (doc_id)"""


def _op5() -> str:
    w = ", ".join(map(str, mixing.WEIGHTS))
    sched = ", ".join(str(list(map(float, s))) for s in mixing.SCHEDULES)
    half = "(CASE WHEN abs({1} - {0}) < 1e-12 THEN ({2}) / greatest({0}, 1e-12) ELSE 2 * ({2}) / greatest({0} + sqrt(greatest(0.0, {0} * {0} + 4 * ({1} - {0}) * ({2}))), 1e-12) END)"
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '') || '|11'), 1, 15))::BIGINT AS ticket FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ordinal FROM s),
x AS (SELECT *, ([{w}])[(ordinal % {len(mixing.WEIGHTS)} + 1)::INTEGER]::DOUBLE AS weight, {mixing.PASSES} * source_size::DOUBLE AS most FROM o),
y AS (SELECT *, greatest(0.0, {mixing.SHARE} * (SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER q AS r FROM x WINDOW q AS (ORDER BY most / weight, ordinal)),
t AS (SELECT source, source_size, ordinal, least(most, (SELECT arg_min(level, r) FROM y WHERE level * weight <= most) * weight) AS target FROM y),
u AS (SELECT d.*, t.source_size, t.target, t.ordinal, coalesce(sum(size) OVER (PARTITION BY t.ordinal ORDER BY ticket, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
v AS (SELECT *, (round(target)::BIGINT // greatest(source_size, 1)) AS whole FROM u), z AS (SELECT *, whole * size + greatest(0, least(size, round(target)::BIGINT - whole * source_size - ahead)) AS taken, ([{sched}])[(ordinal % {len(mixing.SCHEDULES)} + 1)::INTEGER] AS c FROM v),
f AS (SELECT *, c[1] AS a0, c[2] AS b0, c[3] AS c0, ahead / greatest(target, 1.0) * ((c[1] + c[2]) / 4 + (c[2] + c[3]) / 4) AS need FROM z)
SELECT doc_id, source, size, source_size, target, taken::BIGINT AS taken, CASE WHEN taken > 0 THEN round(least(1.0, CASE WHEN need <= (a0 + b0) / 4 THEN {half.format('a0', 'b0', 'need')} ELSE 0.5 + {half.format('b0', 'c0', 'need - (a0 + b0) / 4')} END), 6) END AS position FROM f"""


def _op10() -> str:
    said = "\\### Assistant: </turn> ok"

    def esc(x: str, table) -> str:
        for a, b in table:
            lit = lambda s: "chr(10)" if s == "\n" else "'" + s + "'"
            x = f"replace({x}, {lit(a)}, '{b}')"
        return x

    return f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{said}'), (-7, 1, 'assistant', '{said}')),
t AS MATERIALIZED (SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n, row_number() OVER q - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS k, {len(chat.OPEN) + len(chat.MID) + len(chat.CLOSE)} + length({esc('role', chat._ROLE)}) + length({esc('text', chat._TEXT)}) AS len FROM c WINDOW q AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) - n AS before, sum(n) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM t),
s AS (SELECT conv_id, any_value(k) AS k, max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) AS sys, max(CASE WHEN i = 0 AND role = 'system' THEN n ELSE 0 END) AS sn, max(CASE WHEN i = 0 THEN len ELSE 0 END) AS sl FROM p GROUP BY 1),
r(conv_id, i, a, w) AS (SELECT conv_id, sys, sys, 1 FROM s UNION ALL SELECT r.conv_id, r.i + 1, CASE WHEN new THEN r.i + 1 ELSE r.a END, CASE WHEN new THEN r.w + 1 ELSE r.w END FROM (SELECT r.*, p.upto - q.before + CASE WHEN r.w = 1 THEN 0 ELSE {chat.HISTORY} END > greatest(1, {chat.BUDGET} - s.sn) AS new FROM r JOIN s ON s.conv_id = r.conv_id JOIN p ON p.conv_id = r.conv_id AND p.i = r.i + 1 JOIN p q ON q.conv_id = r.conv_id AND q.i = r.a) r),
w AS (SELECT conv_id, w, any_value(a) AS a, max(i) + 1 AS b FROM r GROUP BY 1, 2), l AS (SELECT w.conv_id, w.w, sum(p.len) FILTER (p.i >= CASE WHEN w.w = 1 THEN 0 ELSE w.a END AND p.i < w.b) + coalesce(sum(p.len) FILTER (w.w > 1 AND p.i >= s.sys AND p.i < w.a AND q.before - p.before <= {chat.HISTORY}), 0) + CASE WHEN w.w > 1 AND any_value(s.sys) = 1 THEN any_value(s.sl) ELSE 0 END AS len FROM w JOIN s ON s.conv_id = w.conv_id JOIN p ON p.conv_id = w.conv_id LEFT JOIN p q ON q.conv_id = w.conv_id AND q.i = w.a GROUP BY 1, 2)
SELECT p.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, any_value(f.chars)::BIGINT AS formatted_chars, any_value(f.windows)::INTEGER AS n_windows
FROM p JOIN (SELECT conv_id, sum(len) AS chars, count(*) AS windows FROM l GROUP BY 1) f ON f.conv_id = p.conv_id GROUP BY 1"""


ORACLES: dict[str, str] = {"op1_url_filters": _op1(), "op2_license_scans": _op2(), "op4_ngram_jaccard": _OP4, "op5_mixing": _op5(), "op10_chat_formatting": _op10()}
