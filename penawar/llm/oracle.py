"""DuckDB SQL of the registered queries that SQL can express on whole tables."""

from __future__ import annotations

from penawar.llm import licenses, secrets, url_filter, warc

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(col: str) -> str:
    return f"regexp_extract_all({_LOWER.format(col)}, '{_ALNUM}')"


OP9 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_words('text')} AS w FROM documents),
i AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS t
        FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS t FROM spots),
occ AS (SELECT dw.rid, win.item_id, dw.p, dw.n FROM dw JOIN win ON dw.n = win.n AND dw.t = win.t),
hit AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM occ) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid)
"""


def _op10() -> str:
    ph = ", ".join(f"('{label}', string_split('{p}', ' '))" for label, p in licenses.PHRASES)
    tm = ", ".join(f"('{label}', list_distinct(string_split('{t}', ' ')), {licenses.block_words(t)})" for label, t in licenses.TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_words('text')} AS w FROM documents),
ph(label, t) AS (VALUES {ph}), tm(label, t, block) AS (VALUES {tm}),
base AS (SELECT rid, label, p - 1 AS p FROM
         (SELECT rid, w, label, t, unnest(range(1, len(w) - len(t) + 2)) AS p FROM d, ph WHERE len(w) >= len(t))
         WHERE w[p:p + len(t) - 1] = t),
spots AS (SELECT rid, w, label, t, block, unnest(list_filter(range(1, len(w) + 1), lambda p: list_contains(t, w[p]))) AS p
          FROM d, tm WHERE len(list_intersect(t, w)) >= ceil({licenses.THRESHOLD} * len(t) - 1e-9)),
sim AS (SELECT rid, label, len(list_intersect(t, w[p:p + block - 1])) AS n, len(t) AS m FROM spots),
good AS (SELECT rid, label, n / m AS score FROM sim WHERE n >= ceil({licenses.THRESHOLD} * m - 1e-9)),
b AS (SELECT rid, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word FROM base GROUP BY rid),
bl AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT rid, label FROM base) GROUP BY rid),
al AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM
       (SELECT rid, label FROM base UNION SELECT rid, label FROM good) GROUP BY rid),
sc AS (SELECT rid, max(score) AS score FROM (SELECT rid, 1.0::DOUBLE AS score FROM base UNION ALL SELECT rid, score FROM good) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN bl USING (rid) LEFT JOIN al USING (rid) LEFT JOIN sc USING (rid)
"""


def _op1() -> str:
    """Spans from the matches and the pieces between them, a rule at a time."""
    parts = []
    for order, r in enumerate(secrets.RULES):
        pat = r.pattern.replace("'", "''")
        parts.append(f"""SELECT rid, '{r.kind}' AS kind, {order} AS o, regexp_extract_all(t, '{pat}', 0) AS m,
       regexp_extract_all(t, '{pat}', {r.group}) AS g, string_split_regex(t, '{pat}') AS s, {r.least} AS least FROM d""")
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0),
spans AS (SELECT rid, kind, o, length(array_to_string(s[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS a, length(m[i]) AS n
          FROM each WHERE length(g[i]) >= least),
named AS (SELECT rid, kind, o, a, kind || ':' || CAST(a AS VARCHAR) || ':' || CAST(a + n AS VARCHAR) AS name FROM spans),
agg AS (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
               count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(name, ',' ORDER BY a, o) FILTER (WHERE kind IN ({base})) AS b,
               string_agg(name, ',' ORDER BY a, o) AS spans, count(*) AS n_spans FROM named GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans
FROM d LEFT JOIN agg USING (rid)
"""


def _op2() -> str:
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in url_filter.RULES)
    return f"""
WITH p AS (SELECT page_id, row_number() OVER () AS rid, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rid, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(v, r, name, start) AS (VALUES {rules}),
fit AS (SELECT rid, r, v, row_number() OVER (PARTITION BY rid ORDER BY length(r) DESC) AS k FROM h, rules
        WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)),
j AS (SELECT h.*, fit.r, fit.v FROM h LEFT JOIN fit ON fit.rid = h.rid AND k = 1),
listed AS (SELECT DISTINCT host FROM j WHERE v = 'block')
SELECT page_id, host, path, r AS rule, coalesce(v, CASE WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END) AS verdict,
       host IN (SELECT host FROM listed) AS listed
FROM j
"""


def _op3() -> str:
    chunk = "CAST('0x' || substr(sha, {0}, 5) AS INTEGER)"
    letters = " || ".join(f"substr('{warc.BASE32}', (({chunk.format(i)} >> {b}) & 31) + 1, 1)" for i in range(1, 41, 5) for b in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, {letters} AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f ON f.html = p.html
"""


OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^ 	-
]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM both_have JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
two_way AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM two_way UNION SELECT r.a, t.b FROM reach r JOIN two_way t ON t.a = r.b),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""

OP11 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, p, sha256(array_to_string(w[p:p + 49], ' ')) AS s
        FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
low AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
gone AS (SELECT DISTINCT rid, q FROM (SELECT rid, unnest(range(p, p + 50)) AS q FROM win JOIN low ON low.s = win.s AND doc_id > least)),
each AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (SELECT e.rid, string_agg(e.w[e.q], ' ' ORDER BY e.q) AS t, count(*) AS n
         FROM each e LEFT JOIN gone g ON g.rid = e.rid AND g.q = e.q WHERE g.q IS NULL GROUP BY e.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
OP12 = """
WITH v AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
                  [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, a.label = b.label AS same, b.id, CAST(list_sum([a.x[i] * b.x[i] FOR i IN range(1, len(a.x) + 1)]) AS BIGINT) AS score
      FROM v a JOIN v b ON a.id <> b.id OR a.label <> b.label WHERE a.id % 50 = 0),
pos AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT pos.anchor_id, pos.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id,
       pos.score AS positive_score, n.score AS negative_score
FROM pos JOIN s n ON n.anchor_id = pos.anchor_id AND NOT n.same AND 50 * pos.score <= 100 * n.score AND 100 * n.score <= 95 * pos.score
WINDOW w AS (PARTITION BY pos.anchor_id, pos.id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 3
"""


def _op13() -> str:
    """The cheapest edits row by row from the front: four states per conversation, then the audit is walked."""
    insert = "[{0}[1], {0}[2], list_min([{0}[3]] || [{{'c': {0}[x].c + 3, 'a': {0}[x].a || 'I'}} for x in [1, 2, 4]]), {0}[4]]"
    then = "[{0}[1], {0}[2], {0}[3], list_min([{0}[4], {{'c': {0}[3].c + 3, 'a': {0}[3].a || 'I'}}])]"
    none = "{'c': 1000000000, 'a': ''}"

    def move(q: int, cost: str, letter: str, when: str = "true") -> str:
        return f"CASE WHEN {when} THEN {{'c': s[{q}].c + {cost}, 'a': s[{q}].a || '{letter}'}} ELSE {none} END"

    def options(q: int, sources: list[int], role: str) -> str:
        moves = [move(q, "4", "D")]
        for x in sources:
            moves.append(move(x, "cut", "K", f"NOT gone AND initial = '{role}'"))
            if role != "s":
                moves.append(move(x, "3 + cut", "R", "NOT gone"))
        return f"list_min([{', '.join(moves)}])"

    step = f"[{options(1, [], '')}, {options(2, [1], 's')}, {options(3, [1, 2, 4], 'u')}, {options(4, [3], 'a')}]"
    return f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) ORDER BY n) AS t
                       FROM range(256) r(n)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS k FROM conversations),
dealt AS (SELECT conv_id, turn, role, text, xor(list_reduce([ord(x) FOR x IN k], lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS d
          FROM keyed, crc),
bad AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
               CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(CASE d WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM dealt),
ids AS (SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
r0 AS (SELECT cid, turn, role, text, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text, copy) AS i
       FROM bad JOIN ids ON ids.conv_id IS NOT DISTINCT FROM bad.conv_id),
r1 AS (SELECT *, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS body, row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 AS again,
              lag(substr(role, 1, 1)) OVER (PARTITION BY cid ORDER BY i) || substr(role, 1, 1) AS pair FROM r0),
r AS (SELECT *, body = '' AS blank, body <> '' AND again AS dup, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS open,
             substr(role, 1, 1) AS initial, body = '' OR again AS gone FROM r1),
tally AS (SELECT cid, count_if(blank) AS blank, count_if(dup) AS duplicate, count_if(open) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal,
                 coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, max(i) AS n FROM r GROUP BY cid),
dp(cid, i, s) AS (
  SELECT cid, 0::BIGINT, [{{'c': 0, 'a': ''}}, {none}, {{'c': 3, 'a': 'I'}}, {{'c': 6, 'a': 'II'}}] FROM tally
  UNION ALL
  SELECT cid, i, {then.format('u')} FROM (SELECT cid, i, {insert.format('v')} AS u FROM (SELECT cid, i, {then.format('z')} AS v FROM (
    SELECT dp.cid, r.i, {step} AS z FROM dp JOIN (SELECT *, CASE WHEN open THEN 3 ELSE 0 END AS cut FROM r) r ON r.cid = dp.cid AND r.i = dp.i + 1)))),
best AS (SELECT dp.cid, list_min([s[1], s[4]]) AS b FROM dp JOIN tally t ON t.cid = dp.cid AND t.n = dp.i),
walk(cid, p, i, q, lines) AS (
  SELECT cid, 0::BIGINT, 0::BIGINT, 0, []::VARCHAR[] FROM best
  UNION ALL
  SELECT cid, p + 1, CASE WHEN x = 'I' THEN i ELSE i + 1 END,
         CASE WHEN x = 'D' THEN q WHEN x = 'K' AND initial = 's' THEN 1 WHEN q = 2 THEN 3 ELSE 2 END,
         CASE WHEN x = 'D' THEN lines WHEN x = 'I' THEN lines || [name || ':'] WHEN x = 'R' THEN lines || [name || ':' || text] ELSE lines || [role || ':' || text] END
  FROM (SELECT w.*, substr(b.b.a, w.p + 1, 1) AS x, CASE WHEN q = 2 THEN 'assistant' ELSE 'user' END AS name, r.role, r.text, r.initial
        FROM walk w JOIN best b ON b.cid = w.cid AND w.p < length(b.b.a) LEFT JOIN r ON r.cid = w.cid AND r.i = w.i + 1)),
done AS (SELECT w.cid, w.lines FROM walk w JOIN best b ON b.cid = w.cid AND w.p = length(b.b.a))
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.b.c, 0) AS BIGINT) AS cost,
       coalesce(best.b.a, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN tally USING (cid) LEFT JOIN best USING (cid) LEFT JOIN done USING (cid)
"""


SQL = {"op1_secret_scan": _op1(), "op2_url_filter": _op2(), "op3_warc": _op3(), "op8_jaccard_join": OP8,
       "op9_decontaminate": OP9, "op10_license_scan": _op10(),
       "op11_substring_dedup": OP11, "op12_hard_negatives": OP12, "op13_conversation_repair": _op13()}
