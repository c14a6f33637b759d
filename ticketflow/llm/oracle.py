"""DuckDB SQL of the queries that SQL can express (the others are tested
against brute force in tests/llm)."""

from __future__ import annotations

from ticketflow.llm.mixing import BUCKETS, MAX_EPOCHS, SEED, WEIGHTS
from ticketflow.llm.quality import SYMBOLS, RepeatRules
from ticketflow.llm.spelling import DROP_ONE_IN, MIN_COUNT, MIN_LENGTH
from ticketflow.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

WORD = r"[^\x20\x09-\x0D]+"
_R = RepeatRules()
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TOPK = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 10
"""

NEAR_DUP = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(
    CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS shingle
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_CONTROL = r"\\|<\||</?s>|</?unk>|</?pad>|<</?SYS>>|\[/?INST\]"
CHAT = f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|turn|>') + length('<|end|>') + 1 + length(role) + length(text)
                + 7 * (length(role) - length(replace(role, chr(10), '')))
                + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}'))) AS BIGINT)
         AS formatted_chars
FROM m GROUP BY conv_id
"""

_SYMBOLS = "[" + SYMBOLS.replace("$", r"\$").replace("&", "&").replace("|", r"\|") + "]"
QUALITY = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents),
b AS (
  SELECT r, doc_id, w, len(w) AS n, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(text, '{_SYMBOLS}')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM d),
tri AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM b)),
tri2 AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
n3 AS (SELECT r, count(DISTINCT i + k) AS n FROM tri2, range(0, 3) t(k) GROUP BY r),
ten AS (SELECT r, i, array_to_string(w[i:i + {_R.min_repeat - 1}], ' ') AS g
        FROM (SELECT r, w, unnest(range(1, len(w) - {_R.min_repeat - 2})) AS i FROM b)),
ten2 AS (SELECT r, i FROM ten QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM ten2, range(0, {_R.min_repeat}) t(k) GROUP BY r),
-- a repeat longer than both limits needs as many covered words; only such texts are looked at
lim AS (SELECT b.r, w, greatest({_R.max_longest}, CAST(floor({_R.longest_share} * b.n) AS BIGINT)) + 1 AS l
        FROM b JOIN cov ON cov.r = b.r
        WHERE cov.n >= greatest({_R.max_longest}, floor({_R.longest_share} * b.n)) + 1 AND cov.n <= {_R.max_covered} * b.n),
lng AS (SELECT r FROM (SELECT r, l, w, unnest(range(1, len(w) - l + 2)) AS i FROM lim)
        GROUP BY r, sha256(array_to_string(w[i:i + l - 1], ' ')) HAVING count(*) > 1),
m AS (
  SELECT b.*, coalesce(n3.n, 0) AS n_repeat, coalesce(cov.n, 0) AS covered,
         b.r IN (SELECT r FROM lng) AS long_repeat,
         b.n < 50 OR 100 * coalesce(n3.n, 0) > 50 * b.n AS failed
  FROM b LEFT JOIN n3 ON n3.r = b.r LEFT JOIN cov ON cov.r = b.r)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
       CAST(n_repeat AS BIGINT) AS n_repeat_words, CAST(covered AS BIGINT) AS covered_words, failed AS base_failed,
       NOT failed AND NOT (covered > {_R.max_covered} * n) AND NOT long_repeat AS kept
FROM m
"""

_WEIGHT = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
MIXING = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents),
e AS (SELECT doc_id, source, size, CAST('0x' || substr(h, 1, 8) AS BIGINT) >> 20 AS bucket,
             CAST('0x' || substr(h, 9, 8) AS BIGINT) AS coin FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM e GROUP BY source),
r AS (SELECT *, {MAX_EPOCHS} * source_size AS cap,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {_WEIGHT} END AS w FROM s),
f AS (
  SELECT *, row_number() OVER o AS k,
         CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM r WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, source)),
water AS (SELECT arg_min(level, k) AS level FROM f WHERE CAST(cap AS DOUBLE) >= level * w),
t AS (SELECT source, source_size, least((SELECT level FROM water) * w, CAST(cap AS DOUBLE)) AS target FROM r),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
g AS (SELECT *, target - CAST(whole * source_size AS DOUBLE) AS rest FROM u),
c AS (SELECT source, bucket, CAST(sum(size) AS BIGINT) AS words FROM e GROUP BY source, bucket),
a AS (SELECT *, CAST(sum(words) OVER (PARTITION BY source ORDER BY bucket) - words AS BIGINT) AS "from" FROM c),
x AS (SELECT a.source, min(bucket) AS cross_at,
             arg_min((rest - "from") / words, bucket) AS share
      FROM a JOIN g ON a.source IS NOT DISTINCT FROM g.source WHERE words > 0 AND "from" + words > rest GROUP BY a.source)
SELECT e.doc_id, e.size, g.source_size, g.target,
       e.size * (g.whole + CASE WHEN e.bucket < coalesce(x.cross_at, {BUCKETS})
                                  OR (e.bucket = x.cross_at AND e.coin / 4294967296.0 < x.share) THEN 1 ELSE 0 END) AS taken
FROM e JOIN g ON e.source IS NOT DISTINCT FROM g.source LEFT JOIN x ON e.source IS NOT DISTINCT FROM x.source
"""

# crc32 bit by bit: the code points are ASCII or U+00C0 to U+00FF (two bytes)
_BYTES = """flatten(list_transform(string_split(key, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
  ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END))"""
_BITS = f"flatten(list_transform({_BYTES}, lambda b: list_transform(range(0, 8), lambda i: (b >> i) & 1)))"
SPELLING = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
keyed AS (SELECT run, id || ':' || run AS key, count(*) AS n FROM runs GROUP BY ALL),
checked AS (
  SELECT run, n, xor(4294967295, list_reduce([4294967295::BIGINT] || {_BITS},
    lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1)))) AS h
  FROM keyed),
words AS (
  SELECT CASE WHEN h % {DROP_ONE_IN} = 0 THEN left(run, CAST(h % length(run) AS BIGINT))
              || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM checked),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= {MIN_LENGTH}
      GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
less AS (SELECT word, p, left(word, p) || substr(word, p + 2) AS rest
         FROM (SELECT word, unnest(range(0, length(word))) AS p FROM v)),
near AS (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT less.word, v.word FROM less JOIN v ON less.rest = v.word
  UNION SELECT v.word, less.word FROM less JOIN v ON less.rest = v.word),
best AS (
  SELECT a AS word, b AS form, v.n AS form_n, count(*) OVER (PARTITION BY a) AS n_near
  FROM near JOIN v ON v.word = near.b QUALIFY row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) = 1),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form,
         CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n
  FROM v LEFT JOIN best ON best.word = v.word),
chain AS (
  SELECT word, word AS here, 0 AS step FROM f
  UNION ALL SELECT chain.word, f.form, step + 1 FROM chain JOIN f ON f.word = chain.here WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(here, step) AS root FROM chain GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN root ON root.word = f.word
"""


def _vector_codes() -> str:
    """Rounds of assignment and replacement, one after another; equal vector lengths."""
    steps = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v FROM (
    SELECT vec_id, label,
           list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))""",
             f"""x AS MATERIALIZED (
  SELECT r, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS x FROM v, range(0, {PARTS}) t(p))""",
             f"b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS y FROM x WHERE r <= {ENTRIES})"]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, p, any_value(x) AS x, min(e + {ENTRIES} * CAST(list_sum(list_transform(list_zip(x, y),
         lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)) AS best
  FROM x JOIN b{k} USING (p) GROUP BY r, p)""")
        if k < ROUNDS:
            steps.append(f"""m{k} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS y FROM (
    SELECT p, best % {ENTRIES} AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n
    FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY ALL) GROUP BY p, e)""")
            steps.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e)""")
    return "WITH " + ",\n".join(steps) + f""",
c AS (SELECT r, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY p) AS code,
             CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN c ON c.r = v.r, h
"""


SQL: dict[str, str] = {
    "op4_topk": TOPK,
    "op5_near_dup": NEAR_DUP,
    "op7_chat_format": CHAT,
    "op9_quality_rules": QUALITY,
    "op10_mixing": MIXING,
    "op12_spelling": SPELLING,
    "op13_vector_codes": _vector_codes(),
}
