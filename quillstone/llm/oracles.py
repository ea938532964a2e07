"""DuckDB SQL for the queries that SQL can express over whole tables."""

OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS no
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE no % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         3.0::DOUBLE * source_size AS most, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM sources),
filled AS (
  SELECT *, most / w AS ratio,
         (total - coalesce(sum(most) OVER (ORDER BY most / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY most / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
water AS (SELECT level FROM filled WHERE level <= ratio ORDER BY ratio, no LIMIT 1),
aimed AS (
  SELECT source, source_size, no, least(most, coalesce((SELECT level FROM water), 'infinity'::DOUBLE) * w) AS target
  FROM filled),
placed AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.no,
         CAST(sum(d.size) OVER (PARTITION BY s.no ORDER BY d.ord, d.doc_id, d.size
                                ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS before,
         CASE WHEN s.source_size = 0 THEN 0 ELSE CAST(floor(s.target / s.source_size) AS BIGINT) END AS passes
  FROM sized d JOIN aimed s ON d.source IS NOT DISTINCT FROM s.source),
took AS (
  SELECT *, passes * size + greatest(0, least(size, CAST(round(target - passes * source_size) AS BIGINT) - before)) AS taken,
         least(1.0::DOUBLE, (before + size / 2::DOUBLE) / target) AS u
  FROM placed)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN round(CASE no % 3
         WHEN 1 THEN u
         WHEN 0 THEN CASE WHEN u <= 0.625 THEN 2 * u / (1.5 + sqrt(2.25 - 2 * u))
                          ELSE 0.5 + 2 * (u - 0.625) / (1.0 + sqrt(1.0 - 2 * (u - 0.625))) END
         ELSE CASE WHEN u <= 0.375 THEN 2 * u / (0.5 + sqrt(0.25 + 2 * u))
                   ELSE 0.5 + 2 * (u - 0.375) / (1.0 + sqrt(1.0 + 2 * (u - 0.375))) END END, 6) END AS first_position
FROM took
"""

OP3 = r"""
WITH d AS (
  SELECT doc_id, hash(doc_id, text) AS k, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
ds AS (
  SELECT DISTINCT doc_id, k, len(w) - 4 AS total, p, array_to_string(w[p + 1 : p + 5], ' ') AS s
  FROM (SELECT *, unnest(range(len(w) - 4)) AS p FROM d WHERE len(w) >= 5)),
i AS (
  SELECT item_id, row_number() OVER () AS item_row, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
items AS (
  SELECT item_id, item_row, len(w) - 4 AS m, array_to_string(w[p + 1 : p + 5], ' ') AS s
  FROM (SELECT *, unnest(range(len(w) - 4)) AS p FROM i WHERE len(w) >= 5)),
counted AS (SELECT item_id, item_row, m, s, count(*) AS c FROM items GROUP BY ALL),
anchors AS (
  SELECT ds.doc_id, ds.k, ds.total, ds.p, counted.item_id, counted.item_row, counted.m
  FROM ds JOIN counted USING (s)),
windows AS (
  SELECT DISTINCT doc_id, k, item_id, item_row, m, least(m, total) AS n, greatest(0, least(p, total - m)) AS start FROM anchors),
common AS (
  SELECT v.doc_id, v.k, v.item_id, v.item_row, v.start, v.m, v.n, counted.s, least(count(*), any_value(counted.c)) AS shared
  FROM windows v
  JOIN ds ON ds.k = v.k AND ds.doc_id IS NOT DISTINCT FROM v.doc_id AND ds.p >= v.start AND ds.p < v.start + v.n
  JOIN counted ON counted.item_row = v.item_row AND counted.s = ds.s
  GROUP BY ALL),
scored AS (
  SELECT doc_id, k, item_id, item_row, start, CAST(sum(shared) AS DOUBLE) / (m + n - sum(shared)) AS similarity
  FROM common GROUP BY doc_id, k, item_id, item_row, start, m, n)
SELECT doc_id, item_id, round(max(similarity), 6) AS similarity, CAST(arg_min(start, (-round(similarity, 6), start)) AS INTEGER) AS start_word
FROM scored WHERE similarity >= 0.8 GROUP BY doc_id, k, item_id, item_row
"""

OP4 = """
WITH usable AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP8 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, rid, unnest(ls) AS content, generate_subscripts(ls, 1) AS place FROM d),
l AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY place) AS line,
         lead(content) OVER (PARTITION BY rid ORDER BY place) AS following
  FROM e WHERE NOT regexp_full_match(content, '[\x20\x09-\x0D]*')),
s AS (
  SELECT rid, line FROM (
    SELECT *, row_number() OVER (PARTITION BY content, following ORDER BY doc_id, rid, line) AS nth
    FROM l WHERE following IS NOT NULL) WHERE nth > 1),
single AS (
  SELECT rid, line FROM (
    SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, rid, line) AS nth
    FROM l WHERE len(regexp_extract_all(content, '[^\x20\x09-\x0D]+')) > 50) WHERE nth > 1),
gone AS (
  SELECT rid, line + k AS line FROM s, (VALUES (0), (1)) t(k)
  UNION SELECT rid, line FROM single),
runs AS (
  SELECT rid, count(*) AS n_removed, count(*) FILTER (WHERE line - before > 1 OR before IS NULL) AS n_runs
  FROM (SELECT *, lag(line) OVER (PARTITION BY rid ORDER BY line) AS before FROM gone) GROUP BY rid),
kept AS (
  SELECT e.rid, string_agg(e.content, chr(10) ORDER BY e.place) AS kept
  FROM e LEFT JOIN l ON l.rid = e.rid AND l.place = e.place
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.rid = l.rid AND g.line = l.line) GROUP BY e.rid)
SELECT d.doc_id, CAST(len(d.ls) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed,
       CAST(coalesce(n_runs, 0) AS INTEGER) AS n_runs, md5(coalesce(kept, '')) AS kept_md5
FROM d LEFT JOIN runs USING (rid) LEFT JOIN kept USING (rid)
"""

OP11 = """
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST)
"""

SQL: dict[str, str] = {"op2_source_mix": OP2, "op3_decontamination": OP3, "op4_va_topk": OP4, "op8_line_runs": OP8, "op11_exact_dedup": OP11}
