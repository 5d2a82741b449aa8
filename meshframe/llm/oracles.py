"""SQL that gives the rows of operators that SQL can express, by plain definitions."""

_SPACE = r"[\x20\x09-\x0D]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, between: str = _SPACE, lower: bool = False) -> str:
    t = f"coalesce({text}, '')"
    t = f"translate({t}, '{_UPPER}', '{_LOWER}')" if lower else t
    return f"list_filter(string_split_regex({t}, '{between}'), lambda x: x <> '')"


OP2 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words("text", lower=True)} w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+3], ' ') END g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w)-2, 2))) i FROM d WHERE len(w) > 0) t),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100*k >= 85*(p.n+q.n-k)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) n_shingles, CAST((SELECT min(b) FROM r WHERE r.a = d.doc_id) AS BIGINT) component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id"""

OP7 = f"""WITH d AS (SELECT doc_id, {_words("text", _BETWEEN, True)} w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) item, {_words("text", _BETWEEN, True)} w FROM benchmark),
k AS (SELECT DISTINCT item, w[i:i+9] w, len(w[i:i+9]) n FROM (SELECT item, w, unnest(range(1, greatest(len(w)-8, 2))) i FROM b WHERE len(w) > 0) t),
s AS (SELECT doc_id, w, n, unnest(range(1, len(w)-n+2)) i FROM d, (SELECT DISTINCT n FROM k) z WHERE len(w) >= n),
h AS (SELECT s.doc_id, s.i, s.n, k.item FROM s JOIN k ON k.n = s.n AND k.w = s.w[s.i:s.i+s.n-1]),
p AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i+n)) p FROM h) t GROUP BY doc_id),
e AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT doc_id, item FROM h) t GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id"""

OP9 = f"""WITH d AS (SELECT doc_id, {_words("text")} w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w)-11)) i FROM d WHERE len(w) >= 13) t),
m AS (SELECT g, min(doc_id) m FROM g GROUP BY g),
r AS (SELECT DISTINCT doc_id, p FROM (SELECT g.doc_id, unnest(range(i, i+13)) p FROM g JOIN m ON m.g = g.g WHERE m < g.doc_id) t),
x AS (SELECT doc_id, unnest(w) word, unnest(range(1, len(w)+1)) p FROM d),
y AS (SELECT x.doc_id, count(r.p) n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE r.p IS NULL) kept FROM x LEFT JOIN r ON r.doc_id = x.doc_id AND r.p = x.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_removed, 0) AS BIGINT) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN y ON y.doc_id = d.doc_id"""


def _moments(level: str, name: str) -> str:
    return f"""{name}s AS (SELECT 1/least(greatest(coalesce(CASE WHEN sum((n-1)*p0*(1-p0)) > 0 THEN (sum(n*(bad/n-p0)*(bad/n-p0))-sum(p0*(1-p0)))/sum((n-1)*p0*(1-p0)) END, 0.01), 0.001), 0.5)-1 s FROM {level}),
{name} AS (SELECT {level}.*, p0*s+bad a, (1-p0)*s+n-bad b FROM {level}, {name}s)"""


def _rules() -> tuple[str, str]:
    from .url_filter import RULES

    name, verdict = "NULL", "NULL"
    for h, p, v in sorted(RULES, key=lambda r: (len(r[0] + r[1]), r)):
        fits = f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
        name, verdict = f"CASE WHEN {fits} THEN '{h + p}' ELSE {name} END", f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    return name, verdict


def op10() -> str:
    from .url_filter import CELLS, LONG_SUFFIXES, SURE

    name, verdict = _rules()
    long = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)
    return f"""WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://')+3) ELSE '' END r FROM pages),
v AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path FROM u),
o AS (SELECT host, CAST(max(bad) AS DOUBLE) bad FROM (SELECT DISTINCT page_id, host FROM v) q JOIN (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) bad FROM labels GROUP BY doc_id) l ON l.doc_id = q.page_id GROUP BY q.page_id, host),
h0 AS (SELECT host, sum(bad) bad, CAST(count(*) AS DOUBLE) n, string_split(host, '.') l FROM o GROUP BY host),
h1 AS (SELECT host, bad, n, l, array_to_string(l[greatest(len(l)-1, 1):], '.') IN ({long}) lng FROM h0),
h AS (SELECT host, bad, n, array_to_string(l[greatest(len(l)-CASE WHEN lng THEN 2 ELSE 1 END, 1):], '.') dom, CASE WHEN lng THEN array_to_string(l[greatest(len(l)-1, 1):], '.') ELSE l[len(l)] END suf FROM h1),
d AS (SELECT dom, suf, sum(bad) bad, sum(n) n FROM h GROUP BY dom, suf), s AS (SELECT suf, sum(bad) bad, sum(n) n FROM d GROUP BY suf),
w AS (SELECT (sum(bad)+0.5)/(sum(n)+1) p0, sum(bad)+0.5 wa, sum(n)-sum(bad)+0.5 wb FROM s), s1 AS (SELECT s.*, p0 FROM s, w), {_moments("s1", "s2")},
d1 AS (SELECT d.*, a/(a+b) p0 FROM d JOIN s2 ON s2.suf = d.suf), {_moments("d1", "d2")},
e1 AS (SELECT h.*, a/(a+b) p0 FROM h JOIN d2 ON d2.dom = h.dom AND d2.suf = h.suf), {_moments("e1", "e2")},
x0 AS (SELECT DISTINCT host, string_split(host, '.') l FROM v WHERE host <> '' AND host NOT IN (SELECT host FROM h0)),
x1 AS (SELECT host, l, array_to_string(l[greatest(len(l)-1, 1):], '.') IN ({long}) lng FROM x0),
x2 AS (SELECT host, array_to_string(l[greatest(len(l)-CASE WHEN lng THEN 2 ELSE 1 END, 1):], '.') dom, CASE WHEN lng THEN array_to_string(l[greatest(len(l)-1, 1):], '.') ELSE l[len(l)] END suf FROM x1),
x AS (SELECT host, coalesce(d2.a, s2.a, wa) a, coalesce(d2.b, s2.b, wb) b FROM x2 LEFT JOIN d2 ON d2.dom = x2.dom AND d2.suf = x2.suf LEFT JOIN s2 ON s2.suf = x2.suf CROSS JOIN w),
r AS (SELECT list_transform(range({CELLS}), lambda k: k + 0.5) mid),
t0 AS (SELECT host, a, b, ln(a/b) u0, sqrt(1/a+1/b) s, -a*ln(1+b/a)-b*ln(1+a/b) top FROM (SELECT host, a, b FROM e2 UNION ALL SELECT host, a, b FROM x)),
t1 AS (SELECT *, (greatest(-u0, 0)+9*s+30/greatest(a, 1)+CASE WHEN a < 1 THEN 30/a ELSE 0 END)/{CELLS} dl, (greatest(u0, 0)+9*s+30/greatest(b, 1)+CASE WHEN b < 1 THEN 30/b ELSE 0 END)/{CELLS} dh FROM t0),
t2 AS (SELECT host, dl*list_sum(list_transform(mid, lambda k: exp(-a*(dl*k+ln(1+exp(-dl*k)))-b*ln(1+exp(-dl*k))-top))) l, dh*list_sum(list_transform(mid, lambda k: exp(-a*ln(1+exp(-dh*k))-b*(dh*k+ln(1+exp(-dh*k)))-top))) h FROM t1, r),
t AS (SELECT host, h/(l+h) p FROM t2)
SELECT page_id, host, path, {name} AS rule, coalesce({verdict}, CASE WHEN p > {SURE} THEN 'block' ELSE 'allow' END) verdict FROM (SELECT v.*, p FROM v LEFT JOIN t ON t.host = v.host) z"""

#: CRC-32 of a text of ASCII characters: a table by bytes, then a step per character.
_CRC_TABLE = "SELECT list(v ORDER BY x) crc FROM (SELECT x, list_reduce(list_prepend(x, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) v FROM range(256) r(x)) t"


def _crc(text: str) -> str:
    step = "lambda a, b: xor(a >> 8, crc[CAST(xor(a, b) & 255 AS BIGINT) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), {step}), 4294967295)"


OP11 = f"""WITH k AS ({_CRC_TABLE}),
t AS (SELECT conv_id, coalesce(role, '') r, coalesce(text, '') x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) p FROM conversations WHERE conv_id IS NOT NULL),
u AS (SELECT conv_id, dense_rank() OVER (ORDER BY r, x) id, strlen(x) b, p FROM t),
c AS (SELECT conv_id, list(id ORDER BY p) ids, list(b ORDER BY p) bs FROM u GROUP BY conv_id),
h AS (SELECT conv_id, ids, bs, conv_id - conv_id % 5 f, CAST({_crc("CAST(conv_id AS VARCHAR)")} % 9 AS BIGINT) h FROM c, k),
q AS (SELECT h.conv_id, list_concat(coalesce(c.ids[1:h], []), h.ids[h+1:]) ids, list_concat(coalesce(c.bs[1:h], []), h.bs[h+1:]) bs FROM h LEFT JOIN c ON c.conv_id = h.f),
m AS (SELECT conv_id, ids[1:d] s, d, coalesce(bs[d], 0) b, len(ids) = d e FROM (SELECT conv_id, ids, bs, unnest(range(len(ids)+1)) d FROM q) z),
n AS (SELECT s, d, min(conv_id) conv_id, count(*) n, (count(*)-1)*max(b) v, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE e) ends FROM m GROUP BY s, d),
g AS (SELECT s[1:d-1] s, d-1 d, count(*) n FROM n WHERE d > 0 GROUP BY ALL),
y AS (SELECT s[1:i] s, i d, sum(v) v, sum(l) l FROM (SELECT n.s, n.d, n.v, CASE WHEN g.n IS NULL THEN 1 ELSE 0 END l, unnest(range(n.d+1)) i FROM n LEFT JOIN g ON g.s = n.s AND g.d = n.d) z GROUP BY ALL)
SELECT n.conv_id, n.d depth, o.conv_id parent_conv_id, n.n n_convs, coalesce(g.n, 0) n_children, CAST(y.l AS BIGINT) n_leaves, CAST(y.v AS BIGINT) saved_tokens, sha256(coalesce(n.ends, '')) ends_sha256
FROM n JOIN y ON y.s = n.s AND y.d = n.d LEFT JOIN g ON g.s = n.s AND g.d = n.d LEFT JOIN n o ON o.d = n.d - 1 AND o.s = n.s[1:n.d-1] AND n.d > 0"""

OP12 = (
    OP2.replace("w[i:i+3]", "w[i:i+2]").replace("len(w) < 4", "len(w) < 3").replace("len(w)-2, 2", "len(w)-1, 2")
    .replace("SELECT d.doc_id, CAST(coalesce(n.n", "SELECT *, doc_id = component_id kept FROM (SELECT d.doc_id, CAST(coalesce(n.n")
    + ") z"
)

OP13 = f"""WITH d AS (SELECT doc_id, coalesce(source, '') part, coalesce(text, '') t, {_words("text")} w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) g, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) x FROM labels GROUP BY doc_id),
f AS (SELECT part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100*len(list_distinct(w)) < 65*len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100*length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5*length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END b, coalesce(g, 0) g, coalesce(x, 0) x FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, b, count(*) n, sum(g) g, sum(x) x FROM f GROUP BY part, b),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) v),
o AS (SELECT a.v || b.v || c.v || d.v || e.v o FROM a, a b, a c, a d, a e WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
s AS (SELECT o, s, o[s] y, 1 << (ascii(o[s]) - 65) y1, list_sum(list_transform(string_split(o[:s], ''), lambda z: 1 << (ascii(z) - 65))) y2 FROM (SELECT o, unnest(range(1, 6)) s FROM o) z),
r AS (SELECT part, o, s, y, CAST(sum(n) FILTER (WHERE b & CAST(y2 AS BIGINT) = 0) AS BIGINT) kept, CAST(sum(n) FILTER (WHERE b & CAST(y2 AS BIGINT) = y1) AS BIGINT) removed,
  CAST(sum(n) FILTER (WHERE b & y1 > 0 AND b & CAST(y2 AS BIGINT) > y1 AND b & (CAST(y2 AS BIGINT) - y1) > 0) AS BIGINT) redundant, CAST(sum(n) FILTER (WHERE b = y1) AS BIGINT) unique_fails,
  CAST(sum(c.g) FILTER (WHERE b & CAST(y2 AS BIGINT) = y1) AS BIGINT) good_lost, CAST(sum(c.x) FILTER (WHERE b & CAST(y2 AS BIGINT) = y1) AS BIGINT) toxic_lost FROM c, s GROUP BY ALL)
SELECT part, o filter_order, CAST(s AS INTEGER) step, coalesce(kept, 0) kept, coalesce(removed, 0) removed, coalesce(redundant, 0) redundant, coalesce(unique_fails, 0) unique_fails,
  coalesce(good_lost, 0) good_lost, coalesce(toxic_lost, 0) toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, y) AS BIGINT) shapley FROM r"""
