"""DuckDB SQL for the operators of this subpackage that SQL can express."""

SUFFIX_DEDUP = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
-- pieces of 1000 starts each, so that cutting a window is cheap
p AS (SELECT doc_id, c, substr(h, 2000 * c + 1, 2098) AS h, least(1000, n - 49 - 1000 * c) AS k
      FROM (SELECT *, unnest(range(0, (n - 50) // 1000 + 1)) AS c FROM b WHERE n >= 50)),
w AS (SELECT doc_id, 1000 * c + j AS i, substr(h, 2 * j + 1, 100) AS s FROM (SELECT *, unnest(range(0, k)) AS j FROM p)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
hit AS (SELECT w.doc_id, w.i FROM w JOIN f USING (s) WHERE f.m < w.doc_id),
g AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
span AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY doc_id, run),
gap AS (
  SELECT s.doc_id, coalesce(lag(z) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS x, a AS y FROM span s
  UNION ALL SELECT b.doc_id, coalesce(max(z), 0), any_value(b.n) FROM b LEFT JOIN span s ON s.doc_id = b.doc_id GROUP BY b.doc_id),
kept AS (SELECT gap.doc_id, string_agg(substr(b.h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS h FROM gap JOIN b ON b.doc_id = gap.doc_id GROUP BY gap.doc_id),
sums AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT b.doc_id, CAST(b.n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(kept.h)) AS kept_sha256
FROM b JOIN kept ON kept.doc_id = b.doc_id LEFT JOIN sums ON sums.doc_id = b.doc_id
"""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 13], ' ') AS s FROM (SELECT *, unnest(range(0, len(ws) - 12)) AS i FROM d WHERE len(ws) >= 13)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM (SELECT w.doc_id, w.i FROM w JOIN f USING (s) WHERE f.m < w.doc_id)),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS k FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t FROM word ANTI JOIN hit USING (doc_id, k) GROUP BY doc_id),
sums AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(sums.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN sums ON sums.doc_id = d.doc_id
"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
g AS (SELECT DISTINCT item, size, array_to_string(ws[i + 1 : i + size], ' ') AS s
      FROM (SELECT *, least(13, len(ws)) AS size, unnest(range(0, greatest(len(ws) - 12, 1))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM g),
w AS (SELECT doc_id, size, i, array_to_string(ws[i + 1 : i + size], ' ') AS s
      FROM (SELECT *, unnest(range(0, len(ws) - size + 1)) AS i FROM d JOIN sizes ON len(ws) >= size)),
hit AS (SELECT w.doc_id, w.i, w.size, g.item FROM w JOIN g ON g.size = w.size AND g.s = w.s),
word AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS l FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(word.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(item.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(item.l, '')) AS items_sha256, coalesce(word.n, 0) > 0 AND 20 * coalesce(word.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN word ON word.doc_id = d.doc_id LEFT JOIN item ON item.doc_id = d.doc_id
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, 2 * source_size AS cap, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
-- the level at which open sources stop, if exactly the sources before in the order of cap / weight are full
l AS (SELECT *, (1.5 * (SELECT sum(source_size) FROM s)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n),
-- filling is fair at the smallest level that leaves a source open
t AS (SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), weight * (SELECT arg_min(level, cap / weight) FROM l WHERE level * weight < cap)), CAST(cap AS DOUBLE)) AS target FROM l),
r AS (
  SELECT d.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) >= t.source_size AS whole,
    CAST(round(t.target) AS BIGINT) - CASE WHEN round(t.target) >= t.source_size THEN t.source_size ELSE 0 END AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN whole THEN size ELSE 0 END + greatest(0, least(size, budget - before)) AS BIGINT) AS taken FROM r
"""

_BASE32 = "list_transform(range(0, 8), lambda j: CAST('0x' || substr(h, CAST(5 * j + 1 AS INT), 5) AS INT))"

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform({_BASE32}, lambda v: array_to_string(list_transform([15, 10, 5, 0],
    lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> k) & 31) + 1 AS INT), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""

COLLOCATIONS = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d),
total AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, m, array_to_string(ws[i + 1 : i + m], ' ') AS phrase
      FROM (SELECT *, unnest(range(0, len(ws) - m + 1)) AS i FROM (SELECT *, unnest(range(1, 6)) AS m FROM p) WHERE len(ws) >= m)),
f AS (SELECT lang, phrase, any_value(m) AS m, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
sub AS (SELECT DISTINCT lang, a, array_to_string(ws[i + 1 : i + k], ' ') AS phrase
        FROM (SELECT *, unnest(range(0, m - k + 1)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM c WHERE m > 2))),
longer AS (SELECT lang, phrase, max(a) AS a FROM sub GROUP BY lang, phrase),
cut AS (SELECT *, array_to_string(ws[1 : k], ' ') AS head, array_to_string(ws[k + 1 : m], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
scored AS (
  SELECT cut.lang, cut.phrase, k, a, h.f AS l, r.f AS r, n, (1000 * a * n) // (h.f * r.f) AS score
  FROM cut JOIN f AS h ON h.lang = cut.lang AND h.phrase = head JOIN f AS r ON r.lang = cut.lang AND r.phrase = rest JOIN total ON total.lang = cut.lang),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT s.* FROM least s LEFT JOIN longer ON longer.lang = s.lang AND longer.phrase = s.phrase WHERE longer.a IS NULL OR 100 * longer.a < 100 * s.a),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept QUALIFY rank <= 2000),
side AS (SELECT lang, array_to_string(ws[2 : m], ' ') AS lefts, array_to_string(ws[1 : m - 1], ' ') AS rights FROM c WHERE m > 2)
SELECT best.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
  CAST(score AS BIGINT) AS score,
  (SELECT count(*) FROM side WHERE side.lang = best.lang AND lefts = phrase) AS left_words,
  (SELECT count(*) FROM side WHERE side.lang = best.lang AND rights = phrase) AS right_words
FROM best
"""
