"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .decontaminate import SHINGLE
from .decontaminate import THRESHOLD as CONTAINED
from .host_reputation import LIMIT, SECOND_LEVEL, STRONGEST, WEAKEST, Z
from .licences import STEPS, TEMPLATES, necessary_bigrams, necessary_words, size_bounds, template_bigrams, window_sizes
from .licences import THRESHOLD as DICE
from .revisits import DAY, NOT_REPLACED, TRACKING
from .secret_links import ACCESS, ANY, ASSIGN, ASSIGN_VALUE, BLANK_LINE, ENDPOINT, HEX, IDENTIFIER, KINDS, NEEDS, REACH, ROLE

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_low = lambda c: f"translate({c}, '{UPPER}', '{LOWER}')"
_quoted = lambda s: s.replace("'", "''")

OP1 = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM split),
keyed AS (SELECT doc_id, i, line, {_low(f"trim(line, {_BLANK})")} AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, f.k IS NOT NULL AS gone FROM keyed LEFT JOIN frequent f ON f.k = keyed.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""

_HOST = f"regexp_replace(regexp_replace(regexp_replace({_low('regexp_extract(rest, ' + chr(39) + '^([^/?]*)' + chr(39) + ', 1)')}, '^.*@', ''), ':(80|443)?$', ''), '^www[0-9]*[.]', '')"
_NAMED = "('" + "','".join(NOT_REPLACED) + "')"
OP2 = f"""
WITH every AS (SELECT page_id, url, coalesce(html, '') AS html, unnest(range(7)) AS kind FROM pages),
chosen AS (SELECT *, kind IN (0, 5, 6) AS again, page_id % 5 AS m, CASE WHEN kind = 2 THEN 'x' WHEN kind = 3 THEN 'b' WHEN kind = 4 THEN 'c' WHEN kind = 6 AND page_id % 7 <> 1 THEN CASE WHEN page_id % 6 = 0 THEN 'c' WHEN page_id % 2 = 0 THEN 'b' ELSE 'a' END ELSE 'a' END AS ver,
  page_id * 3600 + CASE kind WHEN 0 THEN -100 WHEN 2 THEN 600 WHEN 3 THEN 1200 WHEN 4 THEN 1200 WHEN 5 THEN 1200 WHEN 6 THEN {DAY // 2} ELSE 0 END AS t
  FROM every WHERE CASE kind WHEN 0 THEN page_id % 5 = 0 WHEN 2 THEN page_id % 4 = 0 WHEN 3 THEN page_id % 2 = 0 WHEN 4 THEN page_id % 6 = 0 WHEN 5 THEN page_id % 3 = 0 ELSE true END),
caps AS (SELECT page_id * 8 + kind AS record_id, again, NOT again AND kind <> 2 AS whole, t, NOT (again AND page_id % 11 = 0) AS told, m, md5(html || ver) AS body, page_id, ver,
  regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest,
  list_filter([{{'k': 'date', 'v': CAST(t AS VARCHAR)}}, {{'k': 'content-length', 'v': CASE WHEN again THEN '0' ELSE CAST(1000 + page_id % 100 AS VARCHAR) END}}, {{'k': 'cache-control', 'v': CASE WHEN again THEN 'max-age=60' ELSE 'max-age=3600' END}},
   {{'k': 'expires', 'v': CASE WHEN again THEN CAST(t + 60 AS VARCHAR) END}}, {{'k': 'connection', 'v': CASE WHEN again AND page_id % 2 = 1 THEN 'close' END}}, {{'k': 'content-type', 'v': CASE WHEN NOT again THEN 'text/html' END}},
   {{'k': 'x-version', 'v': CASE WHEN NOT again THEN ver END}}, {{'k': 'server', 'v': CASE WHEN NOT again AND kind <> 3 THEN 's' || (page_id % 3) END}}], lambda x: x.v IS NOT NULL) AS hs FROM chosen),
urls AS (SELECT * EXCLUDE rest, CASE WHEN told AND m IN (0, 1, 3) THEN substr(body, 1, 12) END AS tag, CASE WHEN told AND m IN (2, 3) THEN 'day ' || (page_id // 24) || ver END AS lm, CASE WHEN told AND m = 4 THEN body END AS dg,
  {_HOST} || regexp_replace(regexp_extract(rest, '^[^/?]*(/[^?]*)', 1), '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS u
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^{TRACKING}(=|$)'))) AS q FROM caps)),
best AS (SELECT r.record_id, arg_max(f.record_id, f.t * 1000000000 + f.record_id) AS refers_to FROM urls r JOIN urls f ON f.u = r.u AND f.whole AND f.t < r.t WHERE r.again GROUP BY r.record_id),
found AS (SELECT r.record_id, r.u, r.tag, r.lm, r.dg, r.hs, f.record_id AS refers_to, f.t AS refers_at, f.tag AS ftag, f.lm AS flm, f.dg AS fdg, f.hs AS fhs FROM urls r LEFT JOIN best b ON b.record_id = r.record_id LEFT JOIN urls f ON f.record_id = b.refers_to WHERE r.again),
judged AS (SELECT *, CASE WHEN tag IS NOT NULL AND ftag IS NOT NULL THEN 'etag' WHEN lm IS NOT NULL AND flm IS NOT NULL THEN 'last-modified' WHEN dg IS NOT NULL AND fdg IS NOT NULL THEN 'digest' END AS how FROM found),
told AS (SELECT *, CASE WHEN refers_to IS NULL THEN 'no-earlier-response' WHEN how IS NULL THEN 'no-validator' WHEN (how = 'etag' AND tag = ftag) OR (how = 'last-modified' AND lm = flm) OR (how = 'digest' AND dg = fdg) THEN 'resolved' ELSE 'validator-mismatch' END AS outcome FROM judged),
fresh AS (SELECT *, list_filter(hs, lambda x: x.k NOT IN {_NAMED}) AS new FROM told),
merged AS (SELECT *, CASE WHEN outcome = 'resolved' THEN list_concat(list_filter(fhs, lambda x: NOT list_contains(list_transform(new, lambda y: y.k), x.k)), new) ELSE hs END AS out FROM fresh)
SELECT record_id, u AS canonical_url, refers_to, refers_at, outcome, CASE WHEN outcome = 'resolved' THEN how END AS matched_by, array_to_string(list_sort(list_transform(out, lambda x: x.k || ': ' || x.v)), '; ') AS headers FROM merged
"""

_T = [(i, name, t, template_bigrams(t)) for i, (name, t) in enumerate((n, t) for n, ts in TEMPLATES.items() for t in ts)]
_values = lambda rows: ", ".join(f"({', '.join(repr(x) if isinstance(x, str) else str(x) for x in r)})" for r in rows)
OP4 = f"""
WITH tmpl(tid, licence, n, lo, hi) AS (VALUES {_values([(i, name, sum(b.values()), *size_bounds(sum(b.values()), DICE)) for i, name, _, b in _T])}),
tgram(tid, g, c) AS (VALUES {_values([(i, g, c) for i, _, _, b in _T for g, c in b.items()])}),
sizes(tid, m) AS (VALUES {_values([(i, m) for i, _, t, _ in _T for m in window_sizes(t, DICE)])}),
need(word) AS (VALUES {_values(sorted({(w,) for _, _, _, b in _T for w in necessary_words(b, DICE)}))}),
must(tid, x) AS (VALUES {_values([(i, g) for i, _, _, b in _T for g in necessary_bigrams(b, DICE)])}),
low AS (SELECT doc_id, {_low('text')} AS low FROM documents WHERE text IS NOT NULL),
worded AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(low, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM (SELECT DISTINCT doc_id, low FROM low JOIN need ON contains(low, word))),
grammed AS (SELECT doc_id, len(w) AS k, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM worded WHERE len(w) > 1),
likely AS (SELECT DISTINCT doc_id, tid FROM (SELECT doc_id, unnest(g) AS x FROM grammed) JOIN must USING (x)),
sized AS (SELECT DISTINCT doc_id, k, g, least(m, k) AS m FROM grammed JOIN likely USING (doc_id) JOIN sizes USING (tid)),
units AS (SELECT DISTINCT doc_id, m, pos, list_slice(g, pos + 1, pos + m - 1) AS g FROM (SELECT doc_id, m, g, unnest(list_append(range(0, k - m + 1, greatest(1, m // {STEPS})), k - m)) AS pos FROM sized)),
grams AS (SELECT doc_id, m, pos, x, count(*) AS c FROM (SELECT doc_id, m, pos, unnest(g) AS x FROM units) GROUP BY ALL),
scored AS (SELECT grams.doc_id, grams.m, pos, t.tid, licence, 2.0 * sum(least(grams.c, tgram.c)) / (grams.m - 1 + t.n) AS dice FROM grams JOIN tgram ON tgram.g = grams.x JOIN tmpl t ON t.tid = tgram.tid AND grams.m - 1 BETWEEN t.lo AND t.hi
  JOIN likely l ON l.doc_id = grams.doc_id AND l.tid = t.tid GROUP BY grams.doc_id, grams.m, pos, t.tid, licence, t.n),
best AS (SELECT * FROM scored WHERE dice >= {DICE} QUALIFY row_number() OVER (PARTITION BY doc_id, m, pos ORDER BY dice DESC, tid) = 1)
SELECT doc_id, licence, pos AS first_word, m AS n_words, round(dice, 6) AS best_dice FROM best QUALIFY row_number() OVER (PARTITION BY doc_id, licence ORDER BY dice DESC, pos, m) = 1
"""

_SUFFIX = f"CASE WHEN len(p) >= 3 AND strlen(p[-1]) = 2 AND p[-2] IN {SECOND_LEVEL} THEN p[-2] || '.' || p[-1] ELSE p[-1] END"


def _strength(table: str) -> str:
    """The prior strength of one level, by moments."""
    return f"""(SELECT greatest({WEAKEST}, least({STRONGEST}, coalesce(CASE WHEN b > 0 THEN w / b - 1 ELSE {STRONGEST} END, {STRONGEST}))) FROM (SELECT mu * (1 - mu) AS w, (ss - total * mu * mu - (g - 1) * mu * (1 - mu)) / nullif(total - nn / total - (g - 1), 0) AS b
 FROM (SELECT sum(bad) / sum(n) AS mu, count(*) AS g, sum(n) AS total, sum((bad / n) * bad) AS ss, sum(CAST(n AS DOUBLE) * n) AS nn FROM {table} WHERE n > 0)))"""


_RULE = """CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1' WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
 WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/' WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END"""
OP6 = f"""
WITH lab AS (SELECT doc_id AS page_id, count(*) AS n, count(*) FILTER (quality = 0 OR toxic = 1) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, {_low("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM cut),
hosts AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM hp LEFT JOIN lab USING (page_id) GROUP BY host),
parts AS (SELECT *, string_split(host, '.') AS p FROM hosts),
suf AS (SELECT host, n, bad, p, {_SUFFIX} AS suffix FROM parts),
named AS (SELECT host, n, bad, suffix, CASE WHEN len(p) > len(string_split(suffix, '.')) THEN p[len(p) - len(string_split(suffix, '.'))] || '.' || suffix ELSE host END AS domain FROM suf),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
top AS (SELECT (sum(bad) + 1.0) / (sum(n) + 2.0) AS p0, {_strength("suffixes")} AS ks, {_strength("domains")} AS kd, {_strength("named")} AS kh FROM suffixes),
s AS (SELECT suffix, kd, kh, (bad + ks * p0) / (n + ks) AS ps FROM suffixes, top),
dd AS (SELECT domain, kh, (bad + kd * ps) / (n + kd) AS pd FROM domains JOIN s USING (suffix)),
h AS (SELECT host, bad + kh * pd AS a, n - bad + kh * (1 - pd) AS b FROM named JOIN dd USING (domain)),
bounds AS (SELECT host, a / (a + b) - {Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM h)
SELECT page_id, host, path, rule, round(bound, 6) AS bound, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT *, {_RULE} AS rule FROM hp JOIN bounds USING (host))
"""


def _shingles(table: str, key: str) -> str:
    w = f"list_filter(string_split_regex({_low('text')}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) AS s FROM (SELECT {key}, {w} AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= {SHINGLE}"


OP10 = f"""
WITH i AS ({_shingles('benchmark', 'item_id')}), d AS ({_shingles('documents', 'doc_id')}), size AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n) AS n_shingles, round(count(*) / any_value(n), 6) AS containment FROM d JOIN i USING (s) JOIN size USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= {CONTAINED} * any_value(n) - 1e-9
"""



def _found(name: str, pattern: str) -> str:
    """CTE of a pattern's matches with their places in code points."""
    p = f"'{_quoted(pattern)}'"
    return f"""{name} AS (SELECT rid, m, CAST(sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY i) - length(m) AS INTEGER) AS s, CAST(sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS INTEGER) AS e
 FROM (SELECT rid, i, gaps[i] AS g, ms[i] AS m FROM (SELECT rid, gaps, ms, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rid, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS ms FROM t WHERE regexp_matches(text, {p})))))"""


_whole = lambda p: f"regexp_matches(m, '^(?:{_quoted(p)})$')"
_named = lambda values: "CASE kind " + " ".join(f"WHEN {i} THEN '{values[k]}'" for i, k in enumerate(KINDS)) + " END"
_line = "string_agg(CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END || ':' || s || ':' || e, ',' ORDER BY s, kind, e)"
OP11 = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{_found("f0", ASSIGN)}, {_found("f1", ACCESS)}, {_found("f2", HEX)}, {_found("fw", ANY)}, {_found("breaks", BLANK_LINE)},
base AS (SELECT rid, s, e, 0 AS kind FROM f0 WHERE {_whole(ASSIGN_VALUE)} UNION ALL SELECT rid, s, e, 1 FROM f1 UNION ALL SELECT rid, s, e, 2 FROM f2),
weak AS (SELECT * FROM (SELECT rid, s, e, CASE WHEN {_whole(ENDPOINT)} THEN 4 WHEN {_whole(IDENTIFIER)} THEN 3 WHEN NOT ({_whole(ASSIGN)} OR {_whole(ACCESS)} OR {_whole(HEX)}) AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') THEN 5 END AS kind FROM fw) WHERE kind IS NOT NULL),
parts AS (SELECT p.*, {_named(ROLE)} AS role, (SELECT count(*) FROM breaks b WHERE b.rid = p.rid AND b.s <= p.s) AS scope FROM (SELECT * FROM base UNION SELECT * FROM weak) p),
needs(kind, need) AS (VALUES {", ".join(f"({KINDS.index(k)}, '{n}')" for k, ns in NEEDS.items() for n in ns)}),
met AS (SELECT a.rid, a.s, a.e, a.kind, (SELECT count(*) FROM parts b WHERE b.rid = a.rid AND b.scope = a.scope AND b.role = n.need AND b.s <= a.e + {REACH} AND b.e >= a.s - {REACH} AND (b.e <= a.s OR b.s >= a.e)) AS near FROM parts a JOIN needs n ON n.kind = a.kind),
links AS (SELECT rid, s, e, kind FROM met GROUP BY ALL HAVING min(near) > 0),
b AS (SELECT rid, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, {_line} AS line FROM base GROUP BY rid),
a AS (SELECT rid, {_line} AS line FROM (SELECT * FROM base UNION ALL SELECT rid, s, e, kind FROM links) GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b.line, '')) AS base_sha256, coalesce(a.line, '') AS spans FROM t LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)
"""

_LINES = "'[^\\n]*\\n|[^\\n]+'"
OP12 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (SELECT *, regexp_extract_all(text, {_LINES}) AS us, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS hs FROM t),
drawn AS (SELECT *, len(us) AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 100 THEN 'plain' WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM units),
cut AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS lo, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS hi FROM drawn),
parts AS (SELECT *, array_to_string(us[:lo], '') AS p, array_to_string(us[lo + 1:hi], '') AS m, array_to_string(us[hi + 1:], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts
"""

_WORDS = f"regexp_extract_all({_low('text')}, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')"
OP13 = f"""
WITH d AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents), i AS (SELECT item_id, unnest({_WORDS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL), sizes AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id), total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM sizes),
ms AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // len AS m FROM sizes, total), ws AS (SELECT term, CAST(floor(1000 * ln((2.0 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
qf AS (SELECT item_id, term, count(*) AS q FROM i GROUP BY ALL),
scored AS (SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM qf JOIN ws USING (term) JOIN tf USING (term) JOIN ms USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 20
"""

ORACLES: dict[str, str] = {"op1_line_dedup": OP1, "op2_warc_revisits": OP2, "op4_licences": OP4, "op6_url_filter": OP6, "op10_decontaminate": OP10, "op11_secret_links": OP11, "op12_fill_in_middle": OP12, "op13_impact_search": OP13}
