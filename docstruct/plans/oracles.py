"""Plain SQL for the registered queries, straight from the tables, without any blocks."""

from __future__ import annotations

from ..operators.report import IMAGE_ERROR, NO_DATA, NO_FILE, NO_LICENCE, NO_VEHICLE, UPLOAD_ERROR
from ..schemas import FORM
from . import derived
from .prompts import FORM_TEMPLATE

# Lines as pairs: what the pair of a line reads, in both modes. Lines alike in all these
# columns share their block ids and are one pair.
_LINES = """
raw AS (
  SELECT *, CAST(l_orderkey AS VARCHAR) AS doc_id,
         l_partkey * 8 + l_linenumber AS seq,
         concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT),
                   l_returnflag, l_linestatus) AS k,
         CASE WHEN l_partkey % 10 = 3 THEN 're' ELSE '' END || l_returnflag || l_linestatus
           AS flags
  FROM (SELECT {distinct} l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
               l_returnflag, l_linestatus FROM lineitem)),
lines AS (
  SELECT *, seq AS page_seq, 'Line ' || l_linenumber AS key,
         CAST((l_orderkey * 7 + l_partkey) % 10000 AS DOUBLE) / 100 AS key_confidence,
         CAST((l_suppkey * 13 + l_linenumber) % 10000 AS DOUBLE) / 100 AS v_conf,
         CAST((l_suppkey * 17 + l_linenumber) % 10000 AS DOUBLE) / 100 AS w_conf,
         flags || CASE WHEN l_linestatus = 'O' THEN ' X' ELSE '' END AS v_form,
         flags AS v_id,
         CASE WHEN l_orderkey % 97 = 0 THEN '' ELSE ' P' || l_partkey END AS last_word
  FROM raw)
"""
LINES = _LINES.format(distinct="DISTINCT")
ALL_LINES = _LINES.format(distinct="")

FORM_KV = f"""
{LINES},
rejected AS (
  SELECT doc_id FROM lines
  WHERE l_orderkey % 50 IN (7, 9)
     OR (l_orderkey % 97 = 0 AND l_quantity > 6)
     OR (l_orderkey % 89 = 5 AND l_linenumber = 1)),
kv AS (
  SELECT doc_id, page_seq, key,
         CASE WHEN l_quantity <= 6 THEN '' ELSE v_form || last_word END AS value,
         key_confidence,
         CASE WHEN l_quantity <= 6 THEN 0.0 ELSE v_conf END AS value_confidence
  FROM lines ANTI JOIN rejected USING (doc_id))
"""


def _pct(col: str) -> str:
    return f"CAST(CAST({col} AS DECIMAL(18,2)) AS VARCHAR) || '%'"


_KV_SELECT = f"""
SELECT doc_id, page_seq, key, value, key_confidence, value_confidence,
       {_pct('key_confidence')} AS key_pct, {_pct('value_confidence')} AS value_pct
"""

_FORM_KV = f"WITH {FORM_KV} {_KV_SELECT} FROM kv"

_PAYLOAD = f"""
{FORM_KV},
ordered AS (
  SELECT *, min(page_seq) OVER (PARTITION BY doc_id, key) AS first_page_seq FROM kv),
payloads AS (
  SELECT doc_id, '[' || string_agg(
           '{{"key":"' || key || '","value":"' || value || '","key_confidence":'
           || CAST(key_confidence AS VARCHAR) || ',"value_confidence":'
           || CAST(value_confidence AS VARCHAR) || '}}', ','
           ORDER BY first_page_seq, page_seq, key, value, key_confidence, value_confidence
         ) || ']' AS payload
  FROM ordered GROUP BY ALL)
"""

IMAGES = """
ev AS (
  SELECT *, CAST(user_id AS VARCHAR) || '-' || CAST(event_id // {n} AS VARCHAR) AS image_id,
         CAST(props->>'$.k' AS INTEGER) AS k,
         (least(round(value * 100), 5000.0) + 5000) / 100 AS label_conf
  FROM events),
labels AS (
  SELECT image_id, event_id, event_type AS name, label_conf AS confidence,
         CASE WHEN event_id % 4 <> 0 THEN 'Cat' || (event_id % 3) || '{sep}Any' ELSE '' END
           AS categories,
         row_number() OVER (PARTITION BY image_id ORDER BY label_conf DESC, event_id) AS rank
  FROM ev WHERE label_conf >= 70),
colors AS (
  SELECT image_id, event_id,
         coalesce(CASE WHEN event_id % 3 <> 0 THEN 'Color' || (event_id % 11) END,
                  CASE WHEN event_id % 6 <> 0 THEN 'css' || (event_id % 17) END,
                  'Unknown') AS color,
         CASE WHEN event_id % 4 <> 0 THEN '#' || event_id ELSE '' END AS hex,
         CASE WHEN event_id % 5 <> 0 THEN CAST(event_id * 29 % 10000 AS DOUBLE) / 100
              ELSE 0.0 END AS confidence
  FROM ev WHERE event_type = 'signup'),
texts AS (
  SELECT image_id, event_id, 'T' || event_id AS detected_text,
         CASE WHEN event_id % 2 = 0 THEN 'LINE' ELSE 'WORD' END AS type,
         CAST(event_id * 37 % 10000 AS DOUBLE) / 100 AS confidence
  FROM ev
  WHERE event_type IN ('click', 'view')
    AND CAST(event_id * 37 % 10000 AS DOUBLE) / 100 > 80
    AND event_id % 13 <> 0
    AND (CAST(k AS DOUBLE) / 1000) * (CAST(k AS DOUBLE) / 100) > 0.001),
faces AS (
  SELECT image_id, event_id, CAST(event_id * 53 % 10000 AS DOUBLE) / 100 AS confidence,
         row_number() OVER (PARTITION BY image_id ORDER BY event_id) AS person,
         'Age: ' || CASE WHEN event_id % 7 <> 0 THEN k || '-' || (k + 10) ELSE 'N/A-N/A' END
         || ', Gender: '
         || CASE WHEN event_id % 5 = 0 THEN 'N/A' WHEN event_id % 2 = 0 THEN 'Male'
                 ELSE 'Female' END
         || ', Emotions: '
         || CASE WHEN event_id % 9 = 0 THEN '' ELSE
              ['CALM', 'HAPPY', 'SAD', 'ANGRY', 'FEAR'][event_id % 5 + 1] || ', '
              || ['CALM', 'HAPPY', 'SAD', 'ANGRY', 'FEAR'][(event_id + 1) % 5 + 1] || ', '
              || ['CALM', 'HAPPY', 'SAD', 'ANGRY', 'FEAR'][(event_id + 2) % 5 + 1] END AS value
  FROM ev WHERE event_type = 'purchase')
"""


def _images(n: int = derived.EVENTS_PER_IMAGE, sep: str = ", ") -> str:
    return IMAGES.format(n=n, sep=sep)


_REPORT = f"""
WITH {_images()}
SELECT image_id, 1 AS category_ord,
       row_number() OVER (PARTITION BY image_id ORDER BY event_id) - 1 AS pos,
       'Color' AS "Category", color AS "Key", hex AS "Value", {_pct('confidence')} AS "Confidence"
FROM colors
UNION ALL
SELECT image_id, 2, rank - 1, 'Label', name, categories, {_pct('confidence')}
FROM labels WHERE rank <= 50
UNION ALL
SELECT image_id, 3, row_number() OVER (PARTITION BY image_id ORDER BY event_id) - 1,
       'Text', detected_text, type, {_pct('confidence')}
FROM texts WHERE type = 'LINE'
UNION ALL
SELECT image_id, 4, person - 1, 'Face', 'Person ' || person, value, {_pct('confidence')}
FROM faces
"""

ANSWERS = f"""
j AS (SELECT *, {derived.ANSWER_JSON} AS json FROM customer),
a AS (
  SELECT *, CAST(c_custkey AS VARCHAR) AS doc_id,
         CASE WHEN c_custkey % 71 <> 0 THEN {derived.ANSWER_TEXT} END AS answer
  FROM j),
cleaned AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    answer, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+\\z', '', 'g'),
    '^```json', ''), '^```', ''), '```\\z', ''),
    '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+\\z', '', 'g') AS text
  FROM a),
judged AS (
  SELECT *, text IS NOT NULL AND json_valid(text) AS valid_json,
         CASE WHEN text IS NULL THEN 'call_error'
              WHEN NOT json_valid(text) THEN 'parse_error'
              WHEN text NOT LIKE '{{%' THEN 'not_an_object' END AS reason
  FROM cleaned),
objects AS (SELECT * FROM judged WHERE reason IS NULL),
broken AS (
  SELECT doc_id, 'header.application_date' AS path, 'pattern' AS rule,
         CAST(NULL AS DOUBLE) AS number, '1/2/2024' AS value
  FROM objects WHERE c_custkey % 61 = 0
  UNION ALL SELECT doc_id, 'agency_info.email', 'email', NULL, 'no mail'
  FROM objects WHERE c_custkey % 59 = 0
  UNION ALL SELECT doc_id, 'transaction_info.status', 'enum', NULL, c_mktsegment
  FROM objects WHERE c_mktsegment = 'FURNITURE'
  UNION ALL SELECT doc_id, 'policy_term', 'required', NULL, NULL
  FROM objects WHERE c_custkey % 23 = 0
  UNION ALL SELECT doc_id, 'policy_term.deposit', 'range', c_acctbal, NULL
  FROM objects WHERE c_custkey % 23 <> 0 AND c_acctbal < 0
  UNION ALL SELECT doc_id, 'named_insureds', 'min_items', NULL, '[]'
  FROM objects WHERE c_custkey % 29 = 0
  UNION ALL SELECT doc_id, 'named_insureds[1].name', 'type', NULL, 'null'
  FROM objects WHERE c_custkey % 29 <> 0 AND c_custkey % 31 = 0
  UNION ALL SELECT doc_id, 'named_insureds[1].name', 'required', NULL, NULL
  FROM objects WHERE c_custkey % 29 <> 0 AND c_custkey % 31 <> 0 AND c_custkey % 37 = 0
  UNION ALL SELECT doc_id, 'named_insureds[1].fein_or_ssn', 'pattern', NULL, 'x12-3456789'
  FROM objects
  WHERE c_custkey % 29 <> 0 AND c_custkey % 31 <> 0 AND c_custkey % 37 <> 0
    AND c_custkey % 41 = 0
  UNION ALL SELECT doc_id, 'premises_information[2].state', 'pattern', NULL, 'ca'
  FROM objects WHERE c_custkey % 53 = 0
  UNION ALL SELECT doc_id, 'premises_information[2].zip', 'pattern', NULL, '1234'
  FROM objects WHERE c_custkey % 47 = 0
  UNION ALL SELECT doc_id, 'general_information.subsidiary_details.percent_owned', 'range',
         CAST(c_custkey % 103 AS DOUBLE), NULL
  FROM objects WHERE c_custkey % 103 > 100
  UNION ALL SELECT doc_id, 'loss_history.years_checked', 'range',
         CAST(c_custkey % 12 AS DOUBLE), NULL
  FROM objects WHERE c_custkey % 12 IN (0, 11)
  UNION ALL SELECT doc_id, 'loss_history.no_losses', 'type', NULL, 'X'
  FROM objects WHERE c_custkey % 67 = 0
  UNION ALL SELECT doc_id, 'extra_note', 'extra', NULL, NULL
  FROM objects WHERE c_custkey % 43 = 0),
verdict AS (
  SELECT doc_id, count(*) AS violations FROM broken GROUP BY doc_id),
final AS (
  SELECT judged.*, coalesce(violations, 0) AS violations,
         coalesce(reason, CASE WHEN violations > 0 THEN 'validation_error' END) AS outcome
  FROM judged LEFT JOIN verdict USING (doc_id))
"""

LICENCES = """
licences AS (
  SELECT 'C' || c_custkey || '-0' AS case_id, CAST(c_custkey AS VARCHAR) AS doc_id, c_name,
         CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'Name' END AS key,
         CAST(c_custkey % 10000 AS DOUBLE) / 100 AS key_confidence,
         CAST(c_custkey * 3 % 10000 AS DOUBLE) / 100 AS value_confidence
  FROM customer),
licence_payloads AS (
  SELECT *, '[{"key":"' || key || '","value":"' || c_name || '","key_confidence":'
    || CAST(key_confidence AS VARCHAR) || ',"value_confidence":'
    || CAST(value_confidence AS VARCHAR) || '}]' AS payload
  FROM licences)
"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_HEAD, _, _TAIL = FORM_TEMPLATE.replace("{schema}", FORM.json_schema()).partition("{data}")

_PAGE_ROWS = """
SELECT 'O' || o_orderkey AS doc_id, 'j' AS job_id, 0::BIGINT AS page_seq, 'SUCCEEDED' AS job_status
FROM orders WHERE o_orderkey % 10 NOT IN (3, 6, 7)
"""

_SEGMENTS = """
SELECT c_mktsegment AS segment, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS length FROM customer GROUP BY c_mktsegment
"""

_PAGE_REJECTS = """
SELECT CASE WHEN o_orderkey % 10 = 6 THEN 'O' || o_orderkey END AS doc_id,
       'landing' AS stage, 'torn_line' AS reason,
       CASE WHEN o_orderkey % 10 = 3 THEN '{"doc' ELSE
         '{"doc_id":"O' || o_orderkey
         || '","job_id":"j","page_seq":"first","job_status":"SUCCEEDED"}' END AS detail
FROM orders WHERE o_orderkey % 10 IN (3, 6)
"""

_ALL_FEEDS = "split_part(image_id, '-', 1)::BIGINT % 5 <> 1 AND split_part(image_id, '-', 1)::BIGINT % 3 <> 1 AND split_part(image_id, '-', 1)::BIGINT % 7 <> 1"

ORACLES: dict[str, str] = {
    "job_choice": """
WITH p AS (
  SELECT CAST(o_custkey AS VARCHAR) AS doc_id, 'job-' || o_custkey || '-' || (o_orderkey % 5) AS job_id,
         o_orderkey % 5 AS attempt, o_orderkey AS seq,
         CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'P' THEN 'FAILED' ELSE 'IN_PROGRESS' END AS job_status
  FROM orders),
s AS (SELECT doc_id, job_id, attempt, arg_max(job_status, seq) AS job_status FROM p GROUP BY ALL)
SELECT doc_id, arg_max(job_id, attempt) FILTER (job_status = 'SUCCEEDED') AS chosen,
       arg_max(job_id, attempt) AS latest, arg_max(job_status, attempt) AS job_status
FROM s GROUP BY doc_id
""",
    "form_status": f"""
WITH {LINES},
rejected AS (
  SELECT DISTINCT doc_id FROM lines
  WHERE (l_orderkey % 97 = 0 AND l_quantity > 6) OR (l_orderkey % 89 = 5 AND l_linenumber = 1)),
s AS (
  SELECT o_orderkey AS n, CAST(o_orderkey AS VARCHAR) AS doc_id,
    CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 13 = 0 THEN 'upload_error'
         WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) THEN 'waiting'
         WHEN o_orderkey % 50 = 7 THEN 'failed' WHEN o_orderkey % 50 = 9 THEN 'running'
         WHEN rejected.doc_id IS NOT NULL THEN 'rejected' ELSE 'done' END AS state
  FROM orders LEFT JOIN rejected ON rejected.doc_id = CAST(o_orderkey AS VARCHAR))
SELECT doc_id, state,
  CASE WHEN state = 'missing' THEN 'Message' WHEN state IN ('upload_error', 'failed') THEN 'Error' END AS kind,
  CASE state WHEN 'missing' THEN '{NO_FILE}' WHEN 'upload_error' THEN '{UPLOAD_ERROR}timeout'
    WHEN 'failed' THEN CASE WHEN n % 100 = 7 THEN 'bad scan' ELSE 'Unknown error' END END AS text
FROM s
""",
    "call_rejects": """
SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 'structure' AS stage, 'call_error' AS reason,
       CASE WHEN c_custkey % 73 = 0 THEN 'TimeoutError: ' || c_custkey ELSE '{"error":"busy"}' END AS detail
FROM customer WHERE c_custkey % 73 = 0 OR c_custkey % 71 = 0
""",
    "email_check": f"""
SELECT c_custkey, CASE WHEN c_custkey % 97 = 5 THEN c_custkey % 2 = 0
  ELSE [{", ".join(str(ok).upper() for _, ok in derived.ADDRESSES)}][c_custkey % {len(derived.ADDRESSES)} + 1] END AS valid
FROM customer
""",
    "landed_pages": _PAGE_ROWS,
    "landed_page_rejects": _PAGE_REJECTS,
    "page_stream": _PAGE_ROWS,
    "page_stream_rejects": _PAGE_REJECTS,
    "licence_lines": f"""
WITH {LICENCES}
SELECT doc_id, key AS "Key", c_name AS "Value", {_pct('key_confidence')} AS "Key Confidence",
       {_pct('value_confidence')} AS "Value Confidence"
FROM licences WHERE key <> ''
""",
    "image_feed_lines": f"SELECT * FROM ({_REPORT}) WHERE {_ALL_FEEDS}",
    "case_outcomes": f"""
WITH {_images()}
SELECT 'C' || c_custkey || '-0' AS case_id,
       CASE WHEN c_custkey || '-0' NOT IN (SELECT image_id FROM ev) THEN 'unstructured'
            WHEN c_custkey % 10 = 0 THEN 'call_error' ELSE 'record' END AS outcome
FROM customer
""",
    "record_files": f"""
WITH {ANSWERS}
SELECT doc_id, CAST(c_custkey % 12 AS BIGINT) AS years_checked, TRUE AS unsigned FROM final WHERE outcome IS NULL
""",
    "kv_files": f"""
WITH {LICENCES}
SELECT doc_id, key AS "Key", c_name AS "Value", {_pct('key_confidence')} AS "Key Confidence",
       {_pct('value_confidence')} AS "Value Confidence"
FROM licences WHERE key <> ''
""",
    "landed_files": _SEGMENTS,
    "landed_files_stream": f"{_SEGMENTS} UNION ALL {_SEGMENTS}",
    "jobs_stream": """
WITH j AS (
  SELECT o_custkey AS n, count(DISTINCT o_orderkey) AS pages, count(*) AS words FROM orders GROUP BY o_custkey)
SELECT CAST(n AS VARCHAR) AS doc_id, 'job-' || n AS job_id,
       CASE WHEN open THEN 'timeout' ELSE 'page' END AS kind,
       CASE WHEN open THEN 1 ELSE pages END AS pages,
       CASE WHEN open THEN words || ' pages' END AS held,
       CASE WHEN open THEN 0 ELSE words END AS words
FROM (SELECT *, n % 10 <> 3 AND (n % 10 = 6 OR n % 7 = 2) AS open FROM j)
""",
    "feeds_stream": f"""
WITH report AS ({_REPORT}), {_images()},
u AS (SELECT DISTINCT image_id, user_id FROM ev)
SELECT image_id, count(*) AS rows, CAST(NULL AS VARCHAR) AS missing FROM report WHERE {_ALL_FEEDS} GROUP BY image_id
UNION ALL
SELECT image_id, 0, concat_ws(', ', CASE WHEN user_id % 5 = 1 THEN 'labels' END,
  CASE WHEN user_id % 3 = 1 THEN 'text' END, CASE WHEN user_id % 7 = 1 THEN 'faces' END)
FROM u WHERE NOT ({_ALL_FEEDS}) AND NOT (user_id % 5 = 1 AND user_id % 3 = 1 AND user_id % 7 = 1)
""",
    "model_enrich_log": """
SELECT CAST(c_custkey AS VARCHAR) AS doc_id, sha256(prompt) AS prompt_sha,
  CASE WHEN prompt NOT LIKE '%7' THEN CASE WHEN length(prompt) % 2 = 1 THEN 'run 2' ELSE 'run 1' END END AS answer,
  CASE WHEN prompt LIKE '%7' THEN 'ValueError: never' END AS error
FROM (SELECT *, 'ask ' || c_mktsegment || ' ' || c_nationkey AS prompt FROM customer)
""",
    "form_kv": _FORM_KV,
    "form_kv_stream": _FORM_KV,
    "form_kv_grouped": f"""
WITH {FORM_KV}, ordered AS (
  SELECT *, min(page_seq) OVER (PARTITION BY doc_id, key) AS first_page_seq FROM kv)
SELECT doc_id, key, first_page_seq, count(*) AS n,
       string_agg(value || '|' || CAST(key_confidence AS VARCHAR) || '|'
                  || CAST(value_confidence AS VARCHAR), ';'
                  ORDER BY page_seq, value, key_confidence, value_confidence) AS entries
FROM ordered GROUP BY doc_id, key, first_page_seq
""",
    "form_rejects": f"""
WITH {LINES}
SELECT DISTINCT doc_id, 'job' AS stage, 'job_failed' AS reason,
       CASE WHEN l_orderkey % 100 = 7 THEN 'bad scan' ELSE 'Unknown error' END AS detail
FROM lines WHERE l_orderkey % 50 = 7
UNION ALL
SELECT DISTINCT doc_id, 'blocks', 'missing_entity_types', NULL
FROM lines WHERE l_orderkey % 89 = 5 AND l_linenumber = 1 AND l_orderkey % 50 NOT IN (7, 9)
UNION ALL
SELECT DISTINCT doc_id, 'pairing', 'dangling_child', NULL
FROM lines WHERE l_orderkey % 97 = 0 AND l_quantity > 6 AND l_orderkey % 50 NOT IN (7, 9)
""",
    "form_block_text": f"""
WITH {LINES}
SELECT doc_id, 'K' || k AS block_id, key AS text FROM lines
UNION ALL SELECT doc_id, 'V' || k, v_form || last_word FROM lines
UNION ALL SELECT doc_id, 'W' || k, 'S' || l_suppkey FROM lines WHERE l_suppkey % 5 <> 0
UNION ALL SELECT doc_id, 'U' || k, '' FROM lines
WHERE l_orderkey % 89 = 5 AND l_linenumber = 1
""",
    "form_dangling": f"""
WITH {ALL_LINES}, lost AS (
  SELECT doc_id, 'VALUE' AS rel_type FROM lines WHERE l_quantity > 3 AND l_quantity <= 6
  UNION ALL SELECT doc_id, 'VALUE' FROM lines WHERE l_quantity > 3 AND l_suppkey % 5 = 0
  UNION ALL SELECT doc_id, 'CHILD' FROM lines WHERE l_orderkey % 97 = 0)
SELECT doc_id, rel_type, count(*) AS n FROM lost GROUP BY ALL
""",
    "form_payloads": f"WITH {_PAYLOAD} SELECT doc_id, payload FROM payloads",
    "id_kv": f"""
WITH {LINES}, kv AS (
  SELECT doc_id, page_seq, key, key_confidence,
         concat_ws(' ',
           CASE WHEN l_quantity > 6 THEN v_id || last_word END,
           CASE WHEN l_quantity > 3 AND l_suppkey % 5 <> 0 THEN 'S' || l_suppkey END) AS value,
         CASE WHEN l_quantity > 3 AND l_suppkey % 5 <> 0 THEN w_conf
              WHEN l_quantity > 6 THEN v_conf ELSE 0.0 END AS value_confidence
  FROM lines)
{_KV_SELECT} FROM kv
""",
    "id_report": f"""
WITH {LICENCES}
SELECT doc_id, key AS "Key", c_name AS "Value", {_pct('key_confidence')} AS "Key Confidence",
       {_pct('value_confidence')} AS "Value Confidence"
FROM licences WHERE key <> ''
""",
    "id_status": f"""
SELECT 'C' || c_custkey || '-0' AS case_id, 'Message' AS kind,
       CASE WHEN c_custkey % 2 = 1 THEN '{NO_LICENCE}' ELSE '{NO_DATA}' END AS text
FROM customer WHERE c_custkey % 2 = 1 OR c_custkey % 10 = 0
""",
    "block_edges": f"""
WITH {ALL_LINES}, e AS (
  SELECT doc_id, 'VALUE' AS rel_type, 2 AS n, 0 AS r, 1 AS c FROM lines WHERE l_quantity > 3
  UNION ALL SELECT doc_id, 'CHILD', 2, CASE WHEN l_quantity > 3 THEN 2 ELSE 0 END, 1 FROM lines
  UNION ALL SELECT doc_id, 'CHILD', 3, 0, 3 FROM lines
  UNION ALL SELECT doc_id, 'CHILD', 1, 0, 0 FROM lines WHERE l_suppkey % 5 <> 0)
SELECT doc_id, rel_type, CAST(sum(n) AS BIGINT) AS n, CAST(sum(r) AS BIGINT) AS rel_pos_sum,
       CAST(sum(c) AS BIGINT) AS child_pos_sum
FROM e GROUP BY doc_id, rel_type
""",
    "block_kinds": f"""
WITH {ALL_LINES}, b AS (
  SELECT doc_id, 'key' AS kind, 1 AS n FROM lines
  UNION ALL SELECT doc_id, 'id_value', 1 + CAST(l_suppkey % 5 <> 0 AS INTEGER) FROM lines
  UNION ALL SELECT doc_id, 'form_value', 1 + CAST(l_suppkey % 5 <> 0 AS INTEGER)
    + CAST(l_orderkey % 89 = 5 AND l_linenumber = 1 AS INTEGER) FROM lines)
SELECT doc_id, kind, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY ALL
""",
    "block_dedupe": f"""
WITH {LINES}
SELECT DISTINCT doc_id, 'LINE' AS block_id, 'Line' AS token FROM lines
UNION ALL SELECT doc_id, 'K' || k, NULL FROM lines
UNION ALL SELECT doc_id, 'V' || k, NULL FROM lines
UNION ALL SELECT doc_id, 'W' || k, NULL FROM lines WHERE l_suppkey % 5 <> 0
UNION ALL SELECT doc_id, 'U' || k, NULL FROM lines
  WHERE l_orderkey % 89 = 5 AND l_linenumber = 1
UNION ALL SELECT doc_id, 'N' || k, CAST(l_linenumber AS VARCHAR) FROM lines
UNION ALL SELECT doc_id, 'A' || k, flags FROM lines
UNION ALL SELECT doc_id, 'S' || k, CASE WHEN l_linestatus = 'O' THEN 'X' END FROM lines
UNION ALL SELECT doc_id, 'B' || k, 'P' || l_partkey FROM lines
UNION ALL SELECT doc_id, 'C' || k, 'S' || l_suppkey FROM lines
""",
    "job_gate": """
WITH s AS (
  SELECT CAST(o_custkey AS VARCHAR) AS doc_id,
         arg_max(CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'P' THEN 'FAILED'
                 ELSE 'IN_PROGRESS' END, o_orderkey) AS job_status,
         max(o_orderkey) AS latest
  FROM orders GROUP BY o_custkey)
SELECT s.doc_id, 'job-' || s.doc_id AS job_id, job_status,
       CASE WHEN job_status = 'FAILED' THEN 'job_failed' END AS reason,
       CASE WHEN job_status = 'FAILED' THEN
         CASE WHEN latest % 3 = 0 THEN o_orderpriority ELSE 'Unknown error' END END AS detail
FROM s JOIN orders ON o_orderkey = latest
""",
    "image_labels_topk": f"""
WITH {_images(sep=',')}
SELECT image_id, rank - 1 AS pos, name, confidence, categories FROM labels WHERE rank <= 50
""",
    "image_labels_ranked": f"""
WITH {_images()} SELECT image_id, rank, confidence FROM labels WHERE rank <= 50
""",
    "image_text_foreground": f"""
WITH {_images()} SELECT image_id, detected_text, type, confidence FROM texts
""",
    "image_colors": f"WITH {_images()} SELECT image_id, color, hex, confidence FROM colors",
    "image_faces": f"""
WITH {_images()}
SELECT image_id, 'Person ' || person AS key, value, confidence,
       {_pct('confidence')} AS confidence_pct
FROM faces
""",
    "image_report": _REPORT,
    "image_report_stream": _REPORT,
    "image_status": f"""
WITH {_images(512)}, cases AS (SELECT DISTINCT image_id, user_id FROM ev),
shown AS (
  SELECT image_id FROM labels UNION SELECT image_id FROM colors
  UNION SELECT image_id FROM texts WHERE type = 'LINE' UNION SELECT image_id FROM faces)
SELECT 'C' || image_id AS case_id,
       CASE WHEN user_id % 7 <> 2 AND user_id % 10 = 3 THEN 'Error' ELSE 'Message' END AS kind,
       CASE WHEN user_id % 7 = 2 THEN '{NO_VEHICLE}'
            WHEN user_id % 10 = 3 THEN '{IMAGE_ERROR}timeout' ELSE '{NO_DATA}' END AS text
FROM cases
WHERE user_id % 7 = 2 OR user_id % 10 = 3 OR image_id NOT IN (SELECT image_id FROM shown)
""",
    "case_pairs": f"""
WITH {_images()}, {LICENCES}, vehicles AS (
  SELECT DISTINCT ev.image_id,
         (SELECT count(*) FROM labels l WHERE l.image_id = ev.image_id AND rank <= 50) AS labels
  FROM ev)
SELECT case_id, image_id, labels, doc_id, payload
FROM vehicles JOIN licence_payloads ON case_id = 'C' || image_id
""",
    "fence_clean": f"WITH {ANSWERS} SELECT doc_id, text FROM cleaned",
    "json_verdict": f"WITH {ANSWERS} SELECT doc_id, valid_json, reason FROM judged",
    "record_violations": f"WITH {ANSWERS} SELECT * FROM broken",
    "record_verdict": f"WITH {ANSWERS} SELECT doc_id, outcome AS reason, violations FROM final",
    "record_canonical": f"""
WITH {ANSWERS}
SELECT doc_id, '13/45/2024' AS application_date,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'QUOTE' WHEN 'HOUSEHOLD' THEN 'RENEW'
            WHEN 'MACHINERY' THEN 'CHANGE' ELSE 'CANCEL' END AS status,
       c_acctbal AS deposit,
       CASE WHEN c_custkey % 5 = 0 THEN '12-3456789 junk' ELSE '123-45-6789' END AS tax_id,
       lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS zip, c_custkey % 90 AS employees,
       CAST(c_custkey % 103 AS DOUBLE) AS percent_owned, c_custkey % 12 AS years_checked,
       TRUE AS no_losses, TRUE AS unsigned,
       '{{"no_losses":true,"years_checked":' || (c_custkey % 12)
       || ',"total_losses_amount":null,"losses":null}}' AS history_json
FROM final WHERE outcome IS NULL
""",
    "record_rejects": f"""
WITH {ANSWERS}
SELECT doc_id, 'structure' AS stage, outcome AS reason FROM final WHERE outcome IS NOT NULL
""",
    "parse_faults": f"""
WITH {ANSWERS}
SELECT doc_id, CAST(CASE WHEN oops THEN 3 ELSE 1 END AS BIGINT) AS line,
       CAST(CASE WHEN oops THEN 6 WHEN chatty THEN length(json) + 2
                 WHEN c_custkey % 43 = 0 THEN length(text) - 1
                 ELSE length(text) + 1 END AS BIGINT) AS col,
       CASE WHEN oops THEN 'Expecting value' WHEN chatty THEN 'Extra data'
            WHEN c_custkey % 43 = 0 THEN 'Unterminated string starting at'
            ELSE 'Expecting ' || chr(39) || ',' || chr(39) || ' delimiter' END AS msg,
       CAST(CASE WHEN oops THEN 5 ELSE 1 END AS BIGINT) AS shown,
       CASE WHEN oops THEN '"b": oops,' ELSE text END AS fault
FROM (SELECT *, c_custkey % 7 = 3 AS chatty, c_custkey % 14 = 4 AS oops FROM judged)
WHERE reason = 'parse_error'
""",
    "document_records": f"""
WITH {FORM_KV}, {ANSWERS}
SELECT DISTINCT kv.doc_id, final.doc_id IS NOT NULL AS structured
FROM kv LEFT JOIN final ON kv.doc_id = final.doc_id AND final.outcome IS NULL
""",
    "flatten_paths": """
WITH e AS (SELECT *, CAST(event_id AS VARCHAR) AS doc_id FROM events)
SELECT doc_id, 'event.id' AS path, doc_id AS value, 'int' AS value_type FROM e
UNION ALL SELECT doc_id, 'event.props.k', props->>'$.k', 'int' FROM e
UNION ALL SELECT doc_id, 'event.flags[1][1]', event_type, 'str' FROM e
UNION ALL SELECT doc_id, 'event.flags[1][2]', CAST(user_id AS VARCHAR), 'int' FROM e
UNION ALL SELECT doc_id, 'note', NULL, 'null' FROM e
UNION ALL SELECT doc_id, 'even', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, 'bool'
  FROM e
UNION ALL SELECT doc_id, 'a.b', event_type, 'str' FROM e
UNION ALL SELECT doc_id, 'list[1].half', doc_id || '.5', 'float' FROM e
UNION ALL SELECT doc_id, 'list[2]', 'x', 'str' FROM e
UNION ALL SELECT doc_id, 'deep.a.b[1][1].c.d[1]', CAST(user_id AS VARCHAR), 'int' FROM e
UNION ALL SELECT doc_id, 'deep.a.b[1][1].c.d[2]', '1.5', 'float' FROM e
UNION ALL SELECT doc_id, 'deep.a.b[1][1].c.d[3]', NULL, 'null' FROM e
""",
    "prompt_rows": f"""
WITH {_PAYLOAD}, prompts AS (
  SELECT *, {_literal(_HEAD)} || payload || {_literal(_TAIL)} AS prompt FROM payloads)
SELECT doc_id, length(prompt) AS chars, sha256(prompt) AS prompt_sha
FROM prompts
""",
    "model_enrich_stub": f"""
WITH {LICENCES}, prompts AS (
  SELECT doc_id, 'schema {{}} data ' || payload || ' end' AS prompt FROM licence_payloads)
SELECT doc_id, sha256(prompt) AS prompt_sha,
       CASE WHEN prompt NOT LIKE '%00"%' THEN length(prompt) || '/4096' END AS answer,
       CASE WHEN prompt LIKE '%00"%' THEN 'RuntimeError: busy' END AS error
FROM prompts
""",
    "model_enrich_resume": """
SELECT CAST(c_custkey AS VARCHAR) AS doc_id, sha256(prompt) AS prompt_sha,
       CASE WHEN c_nationkey % 5 IN (2, 3) THEN 'saved' ELSE 'new ' || length(prompt) END AS answer,
       CAST(NULL AS VARCHAR) AS error
FROM (SELECT *, 'ask ' || c_mktsegment || ' ' || c_nationkey AS prompt FROM customer)
""",
    "page_rows": _PAGE_ROWS,
    "page_landings": """
SELECT 'O' || o_orderkey AS doc_id, 'j' AS job_id, page_seq, 'SUCCEEDED' AS job_status
FROM orders, (VALUES (0::BIGINT), (1::BIGINT)) AS landings(page_seq)
WHERE o_orderkey % 10 NOT IN (3, 6, 7)
""",
    "form_dates": """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 10 NOT IN (3, 6) THEN CAST(o_orderdate AS DATE) END AS date
FROM orders
""",
    "page_rejects": _PAGE_REJECTS,
    "feed_rejects": """
WITH missing AS (
  SELECT 'I' || c_custkey AS doc_id, concat_ws(', ',
           CASE WHEN c_custkey % 5 = 1 THEN 'labels' END,
           CASE WHEN c_custkey % 3 = 1 THEN 'text' END,
           CASE WHEN c_custkey % 7 = 1 THEN 'faces' END) AS detail
  FROM customer WHERE NOT (c_custkey % 5 = 1 AND c_custkey % 3 = 1 AND c_custkey % 7 = 1))
SELECT doc_id, 'feeds' AS stage, 'missing_feed' AS reason, detail FROM missing WHERE detail <> ''
""",
    "image_feeds": """
SELECT 'I' || c_custkey AS image_id FROM customer
WHERE c_custkey % 5 <> 1 AND c_custkey % 3 <> 1 AND c_custkey % 7 <> 1
""",
    "landing_keys": """
SELECT '/in/u' || user_id || '/doc_' || event_id || '.pdf' AS path,
       'uploads/' || strftime(ts, '%Y%m%d%H%M%S') || '_doc_' || event_id || '.pdf' AS landing_key
FROM events
""",
}
