"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .chat import CONTROL, END, ESC, START, TURNS_PER_CHUNK  # noqa: F401
from .fim import FIM_PERCENT, SEED as FIM_SEED, SPM_PERCENT
from .importance import BUCKETS, MIN_WORDS, PERCENT, SEED as DRAW_SEED, UNIT
from .licences import COPYRIGHT_LINE, EQUIVALENT, KNOWN, OTHER, RESERVED, TITLE, WRAPPED
from .mixing import BLOCKS, MAX_PASSES, SHARE, WEIGHTS
from .queries import PROBE, PROBE_ID, SHARDS
from .sharding import SLOTS, fill_table
from .topk import SCALE

_W = r"[^\x20\x09-\x0D]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _escaped(column: str) -> str:
    out = f"replace({column}, chr(16), chr(16) || '0')"
    for s in CONTROL:
        digit = "1" if s[0] == "<" else "2"
        out = f"replace({out}, {_text(s)}, chr(16) || {_text(digit + s[1:])})"
    return out


OP3 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', {_text(PROBE)}
  UNION ALL SELECT {PROBE_ID}, 1, 'assistant', {_text(PROBE)}
),
sized AS (
  SELECT *, {len(START)} + length(replace({_escaped("role")}, chr(10), chr(16) || '3')) + 1
    + length({_escaped("text")}) + {len(END)} AS chars
  FROM turns
),
placed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
    ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples,
  coalesce(sum(upto) FILTER (role = 'assistant'), 0)::BIGINT AS example_chars
FROM placed GROUP BY conv_id
"""

# The draw: blocks of sources in the order of a digest, the last one cut at a document.
_WEIGHT = "CASE " + " ".join(
    f"WHEN (rn - 1) % {len(WEIGHTS)} = {i} THEN {w}" for i, w in enumerate(WEIGHTS)
) + " END"
OP6 = f"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_W}')) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM documents
),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM sizes GROUP BY source
),
capped AS (
  SELECT *, {_WEIGHT} AS w, {MAX_PASSES} * source_size AS cap FROM sources
),
leveled AS (
  SELECT *, sum(source_size) OVER () AS total,
    ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER o AS rk
  FROM capped WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST)
),
targets AS (
  SELECT *, least(cap::DOUBLE, coalesce((SELECT min_by(level, rk) FROM leveled WHERE level * w <= cap) * w, cap::DOUBLE)) AS target,
    greatest(1, ceil({BLOCKS} * source_size / greatest(total, 1)::DOUBLE))::BIGINT AS nb
  FROM leveled
),
docs AS (
  SELECT s.*, t.source_size, t.target, s.k % t.nb AS block
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
),
blocks AS (
  SELECT source, block, sum(size) AS block_size, max(source_size) AS source_size, max(target) AS target
  FROM docs GROUP BY source, block
),
ordered AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS full_passes,
    sum(block_size) OVER (PARTITION BY source
      ORDER BY md5(concat_ws('/', source, block::VARCHAR)), block) AS upto
  FROM blocks
),
rested AS (SELECT *, target - full_passes * source_size AS rest, upto - block_size AS since FROM ordered),
by_key AS (
  SELECT d.source, d.block, d.k, sum(d.size) AS size, max(r.since) AS since, max(r.rest) AS rest
  FROM docs d JOIN rested r ON d.source IS NOT DISTINCT FROM r.source AND d.block = r.block
  WHERE r.since < r.rest AND r.rest < r.upto GROUP BY ALL
),
middles AS (
  SELECT *, since + sum(size) OVER (PARTITION BY source, block ORDER BY k) - size / 2 AS middle FROM by_key
),
cuts AS (
  SELECT source, block, coalesce(max(k) FILTER (middle <= rest), -1) AS cut FROM middles GROUP BY source, block
)
SELECT d.doc_id, d.size, d.source_size, d.target,
  d.size * (r.full_passes + CASE WHEN r.rest > 0 AND r.upto <= r.rest THEN 1
    WHEN r.rest > 0 AND c.cut IS NOT NULL AND d.k <= c.cut THEN 1 ELSE 0 END) AS taken
FROM docs d
JOIN rested r ON d.source IS NOT DISTINCT FROM r.source AND d.block = r.block
LEFT JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source AND d.block = c.block
"""


def _canonical(column: str) -> str:
    out = f"regexp_replace(lower(coalesce({column}, '')), {_text(TITLE)}, '')"
    out = f"regexp_replace({out}, {_text(WRAPPED)}, '\\1\\2' || chr(1) || 'copyright\\3', 'g')"
    out = f"regexp_replace({out}, '{COPYRIGHT_LINE}', '\\1', 'g')"
    out = f"regexp_replace({out}, '{RESERVED}', ' ', 'g')"
    out = f"' ' || regexp_replace({out}, '{OTHER}', '  ', 'g') || ' '"
    for spelling, same in EQUIVALENT:
        a, b = (f" {x.replace(' ', '  ')} " for x in (spelling, same))
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(replace({out}, '  ', ' '))"


OP7 = f"""
WITH named(licence, text) AS (VALUES {", ".join(f"({_text(n)}, {_text(t)})" for n, t in KNOWN)}),
canon AS (SELECT licence, {_canonical("text")} AS c FROM named),
known AS (SELECT sha256(c) AS digest, min(licence) AS licence FROM canon WHERE c <> '' GROUP BY 1),
lines AS (
  SELECT DISTINCT doc_id, k.licence
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) l
  JOIN known k ON k.digest = sha256({_canonical("line")})
),
by_line AS (SELECT doc_id, string_agg(licence, ' ' ORDER BY licence) AS line_licences FROM lines GROUP BY doc_id),
whole AS (SELECT doc_id, sha256({_canonical("text")}) AS digest FROM documents)
SELECT w.doc_id, w.digest, k.licence, b.line_licences
FROM whole w LEFT JOIN known k ON k.digest = w.digest
LEFT JOIN by_line b ON b.doc_id IS NOT DISTINCT FROM w.doc_id
"""

OP8 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{_W}') AS words
  FROM documents
),
windows AS (
  SELECT r, i, words[i : i + 2] AS win
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM docs WHERE len(words) >= 3)
),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1),
repeated AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r
),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
),
measured AS (
  SELECT docs.r, doc_id, source, len(words)::BIGINT AS n_words,
    coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
    coalesce(repeated.n, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN lines USING (r) LEFT JOIN repeated USING (r)
),
failed AS (
  SELECT *, [n_words < 50, 100 * n_repeat_words > 50 * n_words,
    10 * n_symbols > word_chars, 20 * n_dup_lines > n_words] AS f FROM measured
),
counts AS (
  SELECT source, rule, count(*) AS n, count(*) FILTER (bad) AS x
  FROM (SELECT source, unnest([1, 2, 3, 4]) AS rule, unnest(f) AS bad FROM failed) GROUP BY source, rule
),
prior AS (
  SELECT rule, m, CASE WHEN e > 0 THEN least(1000, greatest(1, m * (1 - m) / e - 1)) ELSE 1000 END AS k
  FROM (
    SELECT rule, avg(x / n) AS m, var_pop(x / n) - avg(x / n) * (1 - avg(x / n)) * avg(1 / n) AS e
    FROM counts GROUP BY rule
  )
),
bad AS (
  SELECT DISTINCT source FROM counts JOIN prior USING (rule) WHERE (x + m * k) / (n + k) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  f[1] OR f[2] AS base_failed,
  NOT (f[1] OR f[2]) AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM failed.source) AS kept
FROM failed
"""

_TABLE = ", ".join(map(str, fill_table(SHARDS)))
OP10 = f"""
SELECT doc_id, slot, 'shard-' || lpad((([{_TABLE}])[slot + 1])::VARCHAR, 2, '0') AS shard
FROM (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot
  FROM documents
)
"""

# CRC-32 byte by byte, with its table built from the polynomial; each different word once.
OP11 = rf"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents
),
texts AS (
  SELECT r, text FROM docs UNION ALL SELECT NULL, text FROM benchmark
),
words AS (
  SELECT r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts
),
counted AS (SELECT r, w, count(*) AS c FROM words GROUP BY r, w),
different AS (
  SELECT w, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT w FROM counted), tab
),
buckets AS (
  SELECT bucket, coalesce(sum(c) FILTER (r IS NULL), 0) AS t, coalesce(sum(c) FILTER (r IS NOT NULL), 0) AS s
  FROM counted JOIN different USING (w) GROUP BY bucket
),
gains AS (
  SELECT bucket, floor({UNIT} * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE
    / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM buckets
),
weights AS (
  SELECT r, sum(c)::BIGINT AS n, floor(sum(c * gain)::DOUBLE / sum(c)::DOUBLE)::BIGINT AS weight
  FROM counted JOIN different USING (w) JOIN gains USING (bucket) WHERE r IS NOT NULL GROUP BY r
),
scored AS (
  SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-{UNIT} * ln(-ln((('0x' || substr(sha256('{DRAW_SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
      + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)
),
placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank, {PERCENT} * count(*) OVER () // 100 AS take
  FROM scored WHERE n_features >= {MIN_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= take THEN rank END AS rank
FROM scored LEFT JOIN placed USING (r)
"""

OP12 = f"""
WITH good AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""

OP13 = f"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
    list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(sha256('{FIM_SEED}:' || coalesce(doc_id::VARCHAR, '')), i, 8))::BIGINT) AS h
  FROM documents
),
placed AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR h[3] % 100 >= {FIM_PERCENT} THEN 'plain' WHEN h[4] % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
),
parts AS (
  SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1, n - b) AS s FROM placed
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

ORACLES = {
    "op3_chat": OP3,
    "op6_mix": OP6,
    "op7_licences": OP7,
    "op8_host_rules": OP8,
    "op10_shards": OP10,
    "op11_importance": OP11,
    "op12_topk": OP12,
    "op13_fim": OP13,
}
