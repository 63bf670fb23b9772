"""DuckDB SQL that gives the rows of the registered queries."""

from helixloom.llm.license_scan import CLAIM, NOT_WORD, NOTICES, RESERVED, SPELLINGS
from helixloom.llm.line_dedup import DEPTH, FIELD, MIN_DOCS, SIMILARITY

SEED = 7
ENTROPY = 0.999

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ITEM_WORDS = "regexp_extract_all(" + ASCII_LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, m, array_to_string(w[fst:fst + m - 1], ' ') AS pattern
      FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS fst FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
found AS (SELECT r, fst, m, item FROM (
            SELECT r, m, fst, array_to_string(w[fst:fst + m - 1], ' ') AS pattern
            FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS fst FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m))
          JOIN p USING (m, pattern)),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(fst, fst + m)) AS k FROM found) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

EXACT_DEDUP = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS nth,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM g
"""


def _dice(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8) AS BIGINT)"


MIXING = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce('=' || source, 'null') AS s, CAST(len({WORDS}) AS BIGINT) AS tokens FROM documents),
t AS (SELECT s, CAST(sum(tokens) AS BIGINT) AS n, count(*) AS docs FROM d GROUP BY s),
p AS (SELECT list(n / total ORDER BY s) AS p FROM t, (SELECT sum(n)::DOUBLE AS total FROM t) WHERE n > 0),
bisect AS (
  SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT i + 1, CASE WHEN flat THEN mid ELSE low END, CASE WHEN flat THEN high ELSE mid END
  FROM (SELECT i, low, high, mid, -list_sum(list_transform(q, lambda x: x / z * ln(x / z))) >= {ENTROPY} * ln(len(q)) AS flat
        FROM (SELECT *, list_sum(q) AS z FROM (SELECT i, low, high, (low + high) / 2 AS mid, list_transform(p, lambda x: pow(x, (low + high) / 2)) AS q FROM bisect, p WHERE i < 60)))),
e AS (SELECT CASE WHEN -list_sum(list_transform(p, lambda x: x * ln(x))) >= {ENTROPY} * ln(len(p)) THEN 1.0 ELSE low END AS e
      FROM bisect, p WHERE i = 60),
w AS (SELECT s, n, docs, pow(n / sum(n) OVER (), e) / sum(pow(n / tn, e)) OVER () AS w FROM t, e, (SELECT sum(n)::DOUBLE AS tn FROM t) WHERE n > 0),
k AS (SELECT s, n, docs, w, greatest(n, CAST(floor(round(w * max(n / w) OVER (), 3)) AS BIGINT)) AS quota FROM w),
q AS (SELECT s, w, CAST(floor(quota / n) AS BIGINT) AS epochs, quota % n AS rest, CAST(ceil(sqrt(docs)) AS BIGINT) AS blocks FROM k
      UNION ALL SELECT s, 0.0, 1, 0, CAST(ceil(sqrt(docs)) AS BIGINT) FROM t WHERE n = 0),
b AS (SELECT d.*, w, epochs, rest, {_dice(str(SEED), 'doc_id')} % blocks AS block FROM d JOIN q USING (s)),
starts AS (SELECT s, block, held, sum(held) OVER (PARTITION BY s ORDER BY {_dice(str(SEED), 's', 'epochs', 'block')}, block) - held AS begins
           FROM (SELECT s, epochs, block, sum(tokens) AS held FROM b WHERE rest > 0 GROUP BY ALL)),
part AS (SELECT b.*, begins + held <= rest AS fits, begins + sum(tokens) OVER (PARTITION BY s, block ORDER BY {_dice(str(SEED), 'epochs', 'doc_id')}, CAST(doc_id AS VARCHAR)) AS ends
         FROM b JOIN starts USING (s, block) WHERE begins < rest),
used AS (SELECT doc_id, source, unnest(range(epochs)) AS epoch, block, tokens, w FROM b
         UNION ALL SELECT doc_id, source, epochs, block, tokens, w FROM part WHERE fits OR ends <= rest)
SELECT doc_id, source, epoch, block, {_dice(str(SEED), 'epoch', 'doc_id')} AS place, tokens, round(w, 6) AS weight FROM used
"""


SUBSTRING_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
win AS (SELECT r, doc_id, fst, md5(array_to_string(w[fst:fst + 49], ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS fst FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS source FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT r, list(DISTINCT k) AS gone FROM (SELECT r, unnest(range(fst, fst + 50)) AS k FROM win JOIN f USING (h) WHERE source < doc_id) GROUP BY r),
word AS (SELECT r, string_agg(w, ' ' ORDER BY k) AS kept FROM (SELECT r, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS k FROM d) x
         WHERE NOT EXISTS (SELECT 1 FROM (SELECT r, unnest(gone) AS k FROM gone) g WHERE g.r = x.r AND g.k = x.k) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN word USING (r)
"""


def _spelled(line: str) -> str:
    out = f"concat(' ', trim({line}), ' ')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"trim({out})"


_LINES = (f"list_transform(string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{CLAIM}', '\\1', 'g'), '{NOT_WORD}', ' ', 'g'), chr(10)), "
          f"lambda line: {_spelled('line')})")
_TOLD = f"list_filter(lines, lambda x: x <> '' AND x <> '{RESERVED}')"
_WHOLE = f"CASE WHEN len({_TOLD}) > 0 THEN array_to_string({_TOLD}, ' ') WHEN list_contains(lines, '{RESERVED}') THEN '{RESERVED}' ELSE '' END"

_CATALOG = ", ".join("({}, {})".format(*("'" + v.replace("'", "''") + "'" for v in row)) for row in NOTICES)

LICENSE_SCAN = f"""
WITH known AS (SELECT sha256(c) AS digest, min(license) AS license
               FROM (SELECT license, {_WHOLE} AS c FROM (SELECT license, {_LINES} AS lines FROM (VALUES {_CATALOG}) v(license, text))) WHERE c <> '' GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {_LINES} AS lines FROM documents),
u AS (SELECT r, true AS entire, {_WHOLE} AS c FROM d UNION ALL SELECT r, false, unnest(lines) FROM d),
f AS (SELECT r, min(license) FILTER (entire) AS license, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(*) FILTER (NOT entire) AS n_lines
      FROM (SELECT r, entire, sha256(c) AS digest FROM u WHERE c <> '') JOIN known USING (digest) GROUP BY r)
SELECT doc_id, license, coalesce(licenses, '') AS licenses, coalesce(n_lines, 0) AS n_lines FROM d LEFT JOIN f USING (r)
"""

LINE_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS k FROM d),
m AS (SELECT r, k, list_transform(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda t: t <> ''), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{FIELD}' ELSE t END) AS w FROM l),
o AS (SELECT r, k, w, len(w) AS n, w[1:{DEPTH}] AS lead FROM m WHERE len(w) > 0),
c AS (SELECT n, lead, w, count(DISTINCT r) AS docs FROM o GROUP BY ALL),
tok AS (SELECT n, lead, w, docs, unnest(w) AS t, unnest(range(1, n + 1)) AS p FROM c),
sup AS (SELECT n, lead, p, t, sum(docs) AS held FROM tok GROUP BY ALL),
tpl AS (SELECT n, lead, w, avg(CASE WHEN held >= {MIN_DOCS} AND t <> '{FIELD}' THEN 1.0 ELSE 0.0 END) AS alike, bool_or(held < {MIN_DOCS} AND t <> '{FIELD}') AS general,
               list(CASE WHEN held >= {MIN_DOCS} THEN t ELSE '{FIELD}' END ORDER BY p) AS template
        FROM tok JOIN sup USING (n, lead, p, t) GROUP BY n, lead, w),
g AS (SELECT n, lead, w, template FROM tpl WHERE general AND alike >= {SIMILARITY}),
often AS (SELECT n, lead, template FROM o JOIN g USING (n, lead, w) GROUP BY n, lead, template HAVING count(DISTINCT r) >= {MIN_DOCS}),
dropped AS (SELECT w FROM c WHERE docs >= {MIN_DOCS} UNION SELECT w FROM g JOIN often USING (n, lead, template)),
gone AS (SELECT r, list(k) AS gone FROM o JOIN dropped USING (w) GROUP BY r)
SELECT doc_id, len(lines) AS n_lines, coalesce(len(gone), 0) AS n_dropped,
       sha256(array_to_string(list_filter(lines, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), chr(10))) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""

HARD_NEGATIVES = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, x.r, x.vec_id, a.label = x.label AS same, CAST(list_dot_product(a.q, x.q) AS BIGINT) AS score
      FROM e a JOIN e x ON a.r <> x.r WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor, anchor_id, r AS pr, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, r) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor, pr ORDER BY s.score DESC, s.vec_id, s.r)
QUALIFY row_number() OVER w <= 3
"""

# CRC-32 byte by byte: the table follows from its polynomial.
_RUNS = r"regexp_extract_all(" + ASCII_LOWER.format("coalesce(text, '')") + r", '[a-z\x{00C0}-\x{00FF}]{7,}')"

SPELLING_VARIANTS = f"""
WITH RECURSIVE step AS (SELECT CAST(i AS UBIGINT) AS c, i, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, i, k + 1 FROM step WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
run AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest({_RUNS}) AS w FROM documents),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(h) // 2 + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS UBIGINT))),
                          lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS h
           FROM (SELECT w, hex(encode(d || ':' || w)) AS h FROM run), tab),
word AS (SELECT w, count(*) AS n FROM (
           SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS w FROM hashed)
         WHERE length(w) >= 7 GROUP BY w HAVING count(*) >= 2),
cut AS MATERIALIZED (SELECT w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) AS v FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM word)),
near AS (SELECT DISTINCT * FROM (
           SELECT a.w, b.w AS o, b.n FROM cut a JOIN cut b ON a.v = b.v AND a.i = b.i AND a.w <> b.w
           UNION ALL SELECT c.w, x.w, x.n FROM cut c JOIN word x ON c.v = x.w
           UNION ALL SELECT x.w, c.w, c.n FROM cut c JOIN word x ON c.v = x.w)),
best AS (SELECT w, count(*) AS n_near, min(struct_pack(n := -n, w := encode(o))) AS b FROM near GROUP BY w),
form AS (SELECT word.w, word.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= 10 * word.n THEN decode(b.w) END AS form, CASE WHEN -b.n >= 10 * word.n THEN -b.n END AS form_n
         FROM word LEFT JOIN best USING (w)),
chain AS (SELECT w AS word, w AS root, form AS next FROM form UNION ALL SELECT word, f.w, f.form FROM chain JOIN form f ON chain.next = f.w)
SELECT f.w AS word, form, root, n, n_near, form_n FROM form f JOIN chain ON chain.word = f.w AND chain.next IS NULL
"""
