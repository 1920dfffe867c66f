"""SQL for DuckDB of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '')"

SUBSTRING = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS f FROM documents),
w AS (SELECT doc_id, i, array_to_string(f[i:i + 12], ' ') AS s FROM (SELECT doc_id, f, unnest(range(1, len(f) - 11)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM w JOIN m USING (s) WHERE low < doc_id),
k AS (SELECT p.doc_id, p.k, p.word FROM (SELECT doc_id, unnest(f) AS word, unnest(range(1, len(f) + 1)) AS k FROM d) p ANTI JOIN g ON g.doc_id = p.doc_id AND g.k = p.k)
SELECT d.doc_id, CAST(len(f) AS BIGINT) AS n_words, CAST(len(f) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM k GROUP BY doc_id) x ON x.doc_id = d.doc_id
"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS f FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(f[i:i + 4], ' ') AS s FROM (SELECT doc_id, f, unnest(range(1, greatest(len(f) - 4, 1) + 1)) AS i FROM d WHERE len(f) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r(id, other) AS (SELECT a, b FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT id, min(other) AS other FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id, d.doc_id <= coalesce(other, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id
"""


def quality(limits: dict[int, float], line_limit: float) -> str:
    def grams(n: int) -> str:
        return f"""w{n} AS (SELECT doc_id, i, array_to_string(f[i:i + {n - 1}], ' ') AS s FROM (SELECT doc_id, f, unnest(range(1, len(f) - {n - 2})) AS i FROM d)),
c{n} AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM w{n}) WHERE c > 1),
g{n} AS (SELECT c.doc_id, count(*) AS n, CAST(sum(length(f[k])) AS BIGINT) AS chars FROM c{n} c JOIN d ON d.doc_id = c.doc_id GROUP BY c.doc_id)"""

    every = sorted({5, *limits})
    verdict = " AND ".join(f"coalesce(g{n}.chars, 0) <= {limits[n]} * word_chars" for n in limits)
    most = "greatest(" + ", ".join(f"coalesce(g{n}.chars, 0)" for n in limits) + ", 0)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS f FROM documents), {", ".join(map(grams, every))},
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \t\n\v\f\r]')),
ld AS (SELECT doc_id, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM l WHERE c > 1 GROUP BY doc_id),
b AS (SELECT d.doc_id, text, len(f) AS n_words, CAST(length(array_to_string(f, '')) AS BIGINT) AS word_chars FROM d),
x AS (SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(ld.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(g5.n, 0) AS BIGINT) AS n_repeat_words, n_words < 10 OR 100 * coalesce(g5.n, 0) > 20 * n_words AS base_failed,
  CAST({most} AS BIGINT) AS dup_ngram_chars, CAST(coalesce(ld.chars, 0) AS BIGINT) AS dup_line_chars, {verdict} AND coalesce(ld.chars, 0) <= {line_limit} * length(text) AS good
  FROM b {" ".join(f"LEFT JOIN g{n} ON g{n}.doc_id = b.doc_id" for n in every)} LEFT JOIN ld ON ld.doc_id = b.doc_id)
SELECT * EXCLUDE (good), good AND NOT base_failed AS kept FROM x
"""
