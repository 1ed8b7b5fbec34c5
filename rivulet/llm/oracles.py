"""SQL that returns the rows of this subpackage's queries, for those that SQL can express."""

from rivulet.llm.oracles_more import MERKLE, SEARCH, WARC

BLANKS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
TRIM = "chr(32) || chr(9) || chr(11) || chr(12) || chr(13)"

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{BLANKS}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM d, unnest(range(1, len(w) - 6)) r(i) WHERE len(w) >= 8),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, CAST(count(DISTINCT i + o) AS BIGINT) AS n FROM rep, range(0, 8) r(o) GROUP BY doc_id),
ln AS (SELECT doc_id, host, lower(trim(regexp_replace(l, '{BLANKS}', ' ', 'g'))) AS l FROM d, unnest(string_split(t, chr(10))) u(l)),
held AS (SELECT doc_id, host, l, sum(length(l) - length(translate(l, ' ', '')) + 1) AS n FROM ln WHERE l <> '' GROUP BY ALL),
often AS (SELECT host, l FROM held GROUP BY ALL HAVING count(*) > 20),
loss AS (SELECT doc_id, sum(n) AS total, coalesce(sum(CASE WHEN o.l IS NOT NULL THEN n END), 0) AS gone FROM held LEFT JOIN often o ON o.host IS NOT DISTINCT FROM held.host AND o.l = held.l GROUP BY doc_id),
r AS (SELECT m.*, coalesce(cov.n, 0) AS n_repeat_words, coalesce(gone, 0) AS gone, coalesce(total, 0) AS total FROM m LEFT JOIN cov USING (doc_id) LEFT JOIN loss USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  CAST(gone AS BIGINT) AS n_removed_words, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (gone > 0 AND (total - gone < 20 OR total - gone < 0.2 * total)) AS kept FROM r
"""

# The same with a limit that follows the host: more than 4 documents and more than 4 per cent of the host's.
OFTEN = "SELECT host, l FROM held GROUP BY ALL HAVING count(*) > 20"
SHARED = """SELECT c.host, l FROM (SELECT host, l, count(*) AS n FROM held GROUP BY ALL) c JOIN (SELECT host, count(*) AS size FROM (SELECT DISTINCT host, doc_id FROM d) GROUP BY host) z ON z.host IS NOT DISTINCT FROM c.host
  WHERE n > 4 AND 100 * n > 4 * size"""
LINE_SHARE = QUALITY_RULES.replace(OFTEN, SHARED)
REMAINING = f"""
WITH v AS ({LINE_SHARE}), d AS (SELECT doc_id, source AS host, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
ln AS (SELECT doc_id, host, i, ls[i] AS x, lower(trim(regexp_replace(ls[i], '{BLANKS}', ' ', 'g'))) AS l FROM d, unnest(range(1, len(ls) + 1)) r(i)),
held AS (SELECT DISTINCT doc_id, host, l FROM ln WHERE l <> ''),
often AS ({SHARED}),
rest AS (SELECT doc_id, string_agg(CASE WHEN o.l IS NULL THEN x END, chr(10) ORDER BY i) AS t FROM ln LEFT JOIN often o ON o.host IS NOT DISTINCT FROM ln.host AND o.l = ln.l GROUP BY doc_id)
SELECT doc_id, n_removed_words, kept, CASE WHEN text IS NOT NULL THEN md5(coalesce(t, '')) END AS remaining_md5 FROM v JOIN d USING (doc_id) JOIN rest USING (doc_id)
"""

MINHASH = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 2, 2))) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.v)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM (SELECT v AS doc_id, min(c) AS component_id FROM reach GROUP BY v) LEFT JOIN n USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS v, vec_id AS c FROM e UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.v)
SELECT v AS vec_id, (SELECT count(*) FROM links l WHERE l.a = v) AS n_links, min(c) AS component_id, v = min(c) AS kept FROM reach GROUP BY v
"""

LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, p, trim(ls[p], {TRIM}) || chr(10) || trim(ls[p + 1], {TRIM}) || chr(10) || trim(ls[p + 2], {TRIM}) AS k FROM d, unnest(range(1, len(ls) - 1)) r(p) WHERE len(ls) >= 3),
later AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS rn FROM w WHERE replace(k, chr(10), '') <> '') WHERE rn > 1),
cov AS (SELECT DISTINCT doc_id, p + o AS i FROM later, range(0, 3) r(o)),
ln AS (SELECT d.doc_id, i, ls[i] AS l, cov.i IS NOT NULL AS gone FROM d CROSS JOIN unnest(range(1, len(ls) + 1)) r(i) LEFT JOIN cov USING (doc_id, i)),
g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS head FROM ln),
a AS (SELECT doc_id, count(*) AS n, sum(CAST(gone AS INTEGER)) AS removed, sum(CAST(head AS INTEGER)) AS spans, string_agg(CASE WHEN NOT gone THEN l END, chr(10) ORDER BY i) AS kept FROM g GROUP BY doc_id)
SELECT doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE n END AS INTEGER) AS n_lines, CAST(removed AS INTEGER) AS n_removed, CAST(spans AS INTEGER) AS n_spans, CASE WHEN text IS NOT NULL THEN md5(coalesce(kept, '')) END AS kept_md5 FROM d JOIN a USING (doc_id)
"""

MIXING = rf"""
WITH z AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS BIGINT) AS size, md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM z GROUP BY source),
s1 AS (SELECT *, 3 * ss AS cap, sum(ss) OVER () AS total, coalesce(sum(3 * ss) OVER o, 0) AS full_words, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS left_weight FROM s0
  WINDOW o AS (ORDER BY 3 * ss / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT arg_min((total - full_words) / left_weight, cap / w) AS level FROM s1 WHERE (total - full_words) / left_weight * w <= cap),
t AS (SELECT source, ss, CAST(total AS BIGINT) AS total, coalesce(least(CAST(cap AS DOUBLE), level * w), 0.0) AS target FROM s1 CROSS JOIN lv),
seat AS (SELECT source, j, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, source NULLS LAST, j) AS rk, total // 16 AS seats FROM t, unnest(range(0, CAST(3 * ss // 16 + 40 AS BIGINT))) r(j) WHERE target > 0),
q AS (SELECT t.*, least((SELECT count(*) FROM seat s WHERE s.source IS NOT DISTINCT FROM t.source AND rk <= seats), 3 * ss // 16) AS quota FROM t),
x AS (SELECT z.*, q.ss, q.target, q.quota, CAST('0x' || left(h, 8) AS BIGINT) % greatest(1, CAST(ceil(ss / 2000000) AS BIGINT)) AS shard FROM z JOIN q ON q.source IS NOT DISTINCT FROM z.source),
sh AS (SELECT source, shard, any_value(quota) AS quota, sum(size) AS words FROM x GROUP BY ALL),
sq AS (SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY words / (2 * j + 1) DESC, shard, j) AS rk, quota FROM sh, unnest(range(0, CAST(3 * words // 16 + 40 AS BIGINT))) r(j) WHERE words > 0),
dl AS (SELECT sh.source, sh.shard, words, 16 * least((SELECT count(*) FROM sq WHERE sq.source IS NOT DISTINCT FROM sh.source AND sq.shard = sh.shard AND rk <= sq.quota), 3 * words // 16) AS take FROM sh),
y AS (SELECT x.*, words, take, CASE WHEN words > 0 THEN take // words ELSE 0 END AS rounds, coalesce(sum(size) OVER (PARTITION BY x.source, x.shard ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM x JOIN dl ON dl.source IS NOT DISTINCT FROM x.source AND dl.shard = x.shard)
SELECT doc_id, size, ss AS source_size, target, CAST(rounds * size + greatest(0, least(size, take - rounds * words - before)) AS BIGINT) AS taken FROM y
"""

ORACLE_SQL = {"op1_quality_rules": LINE_SHARE, "op1_line_limit": QUALITY_RULES, "op1_line_share": LINE_SHARE, "op1_remaining_text": REMAINING, "op2_minhash_near_dedup": MINHASH, "op3_embedding_near_dedup": EMBEDDINGS, "op5_line_dedup": LINE_DEDUP, "op9_source_mixing": MIXING, "op11_warc_packages": WARC, "op12_ranked_search": SEARCH, "op13_merkle_manifest": MERKLE}
