"""SQL for the operators that SQL can express."""

from __future__ import annotations

from dwell.llm.quality import LINE_SHARE, MIN_WORDS, REPEATED_LENGTHS, REPEATED_SHARE, TOP_SHARE

WORD = r"[^\x20\x09-\x0D]+"

OP4 = """
WITH v AS (SELECT vec_id, list_transform(range(1, 65), lambda i: coalesce(embedding[i] > 0, false)) AS bits
           FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, b.vec_id,
         list_sum(list_transform(range(1, 65), lambda i: (q.bits[i] <> b.bits[i])::INT))::INT AS distance
  FROM v q, v b WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INT AS rank, vec_id, distance FROM ranked WHERE rank <= 10
"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest
           FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""

OP8 = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
ordered AS (SELECT *, row_number() OVER (ORDER BY 3.0 * n / w, source NULLS LAST) AS i FROM s),
open AS (
  SELECT *, (SELECT sum(n) FROM s) - coalesce(sum(3 * n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r,
         sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM ordered),
cut AS (SELECT min(i) AS k FROM open WHERE w * r <= 3 * n * ws),
t AS (
  SELECT source, n, CASE WHEN i < coalesce((SELECT k FROM cut), 1e18) THEN (3 * n)::DOUBLE
                         ELSE (w * (SELECT r FROM open, cut WHERE i = k))::DOUBLE / (SELECT ws FROM open, cut WHERE i = k)::DOUBLE
                    END AS target
  FROM open),
p AS (SELECT *, floor(target + 0.5)::BIGINT // greatest(n, 1) AS copies, floor(target + 0.5)::BIGINT % greatest(n, 1) AS rest FROM t),
run AS (
  SELECT d.*, n AS source_size, target, copies, rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""


def _op9() -> str:
    lengths = sorted({3, *TOP_SHARE, *REPEATED_LENGTHS})
    grams, found, joins = [], [], []
    for n in lengths:
        words = ", ".join(f"w{j}" for j in range(n))
        leads = ", ".join(["w AS w0"] + [f"lead(w, {j}) OVER o AS w{j}" for j in range(1, n)])
        grams.append(f"""
g{n} AS (
  SELECT id, i, c, count(*) OVER (PARTITION BY id, {words}) AS times,
         row_number() OVER (PARTITION BY id, {words} ORDER BY i) AS turn
  FROM (SELECT id, i, {leads}, sum(length(w)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS c
        FROM word WINDOW o AS (PARTITION BY id ORDER BY i))
  WHERE w{n - 1} IS NOT NULL)""")
        if n in TOP_SHARE:
            found.append(f"t{n} AS (SELECT id, max(times * c) AS most FROM g{n} WHERE times > 1 GROUP BY id)")
            joins.append((f"t{n}", f"coalesce(t{n}.most, 0) > {TOP_SHARE[n]}::DOUBLE * word_chars"))
        if n in REPEATED_LENGTHS:
            found.append(f"""
r{n} AS (
  SELECT x.id, sum(length(w)) AS inside
  FROM (SELECT DISTINCT id, unnest(range(i, i + {n})) AS i FROM g{n} WHERE turn > 1) x JOIN word ON word.id = x.id AND word.i = x.i
  GROUP BY x.id)""")
            joins.append((f"r{n}", f"coalesce(r{n}.inside, 0) > {REPEATED_SHARE}::DOUBLE * word_chars"))
    bad = " OR ".join(rule for _, rule in joins)
    left = " ".join(f"LEFT JOIN {name} ON {name}.id = d.id" for name, _ in joins)
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT id, regexp_extract_all(text, '{WORD}') AS ws FROM d),
word AS (SELECT id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM words),
base AS (SELECT id, count(*) AS n_words, sum(length(w)) AS word_chars FROM word GROUP BY id),
line AS (SELECT id, unnest(string_split(text, chr(10))) AS l FROM d),
lines AS (
  SELECT id, sum(n - 1) AS n_dup, sum((n - 1) * length(regexp_replace(l, '[\\x20\\x09-\\x0D]', '', 'g'))) AS dup_chars
  FROM (SELECT id, l, count(*) AS n FROM line WHERE regexp_matches(l, '{WORD}') GROUP BY id, l) GROUP BY id),
{",".join(grams)},
{", ".join(found)},
again AS (SELECT id, count(*) AS n FROM (SELECT DISTINCT id, unnest(range(i, i + 3)) AS i FROM g3 WHERE times > 1) GROUP BY id),
m AS (
  SELECT d.id, doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words,
         coalesce(dup_chars, 0) AS dup_chars
  FROM d LEFT JOIN base ON base.id = d.id LEFT JOIN lines ON lines.id = d.id LEFT JOIN again ON again.id = d.id),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (dup_chars > {LINE_SHARE}::DOUBLE * word_chars OR {bad}) AS kept
FROM v d {left}
"""


def _op11(parts: int = 4, width: int = 16, entries: int = 256, rounds: int = 4) -> str:
    """Plain rounds without bounds; the part width is that of the given table."""
    distance = " + ".join(f"(p.x[{i}] - c.x[{i}]) * (p.x[{i}] - c.x[{i}])" for i in range(1, width + 1))
    total = "sum(p.x[{0}])::BIGINT"
    # Integer division that goes down for negative sums too.
    floor_mean = f"({total} - ({total} % count(*) + count(*)) % count(*)) // count(*)"
    mean = ", ".join(floor_mean.format(i) for i in range(1, width + 1))
    ctes = []
    for r in range(rounds + 1):
        ctes.append(f"""
a{r} AS MATERIALIZED (
  SELECT p.id, p.part, min(({distance}) * {entries} + c.entry) AS m FROM p JOIN c{r} c USING (part) GROUP BY p.id, p.part)""")
        if r < rounds:
            ctes.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(n.x, c.x) AS x
  FROM c{r} c LEFT JOIN (
    SELECT a.part, a.m % {entries} AS entry, [{mean}] AS x
    FROM a{r} a JOIN p ON p.id = a.id AND p.part = a.part GROUP BY a.part, a.m % {entries}) n ON n.part = c.part AND n.entry = c.entry)""")
    return f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS id, * FROM k),
p AS MATERIALIZED (SELECT id, part, v[{width} * part + 1:{width} * part + {width}] AS x FROM r, range({parts}) t(part)),
c0 AS MATERIALIZED (SELECT part, id - 1 AS entry, x FROM p WHERE id <= {entries}),
{",".join(ctes)},
e AS (
  SELECT id, string_agg(lower(printf('%02x', (m % {entries})::INT)), '' ORDER BY part) AS code, sum(m // {entries})::BIGINT AS error
  FROM a{rounds} GROUP BY id),
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS sha FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256
FROM e JOIN r USING (id), s
"""


def all_sql() -> dict[str, str]:
    return {"op11_codes": _op11(), "op4_hamming": OP4, "op5_warc": OP5, "op8_mixture": OP8, "op9_quality": _op9()}
