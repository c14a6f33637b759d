"""DuckDB building blocks for the oracle SQL (independent of the Spark code).

The fixed data (phrases, rules, words, lexicon, templates) is rendered as
``VALUES`` lists; the logic is written again in SQL.  DuckDB notes: regex
replace-all needs the ``'g'`` flag, RE2's ``\\s`` lacks U+000B, decimal
literals must be cast to DOUBLE.
"""

from __future__ import annotations

from ticketflow import config as C
from ticketflow.operators.templates import read_template_files
from ticketflow.sources import fixture_data as D

WS = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\p{Z}]"
NWS = r"[^\t\n\x0b\f\r \x1c-\x1f\x{85}\p{Z}]"


def q(v) -> str:
    """SQL literal."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int,)):
        return str(v)
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return "'" + str(v).replace("'", "''") + "'"


def values(rows, cols) -> str:
    body = ",\n    ".join("(" + ", ".join(q(x) for x in r) + ")" for r in rows)
    return f"(VALUES\n    {body}) AS v({', '.join(cols)})"


def phrases_cte() -> str:
    return "phrases AS (SELECT * FROM " + values(
        D.phrase_rows(), ["phrase_id", "concept_id", "text", "intent", "urgency", "language"]) + ")"


def rules_cte() -> str:
    return "rules AS (SELECT * FROM " + values(
        C.keyword_rules(), ["rule_order", "level", "keyword", "language"]) + ")"


def words_cte() -> str:
    rows = [(i, lang, w) for i, (lang, ws) in enumerate(D.FUNCTION_WORDS.items()) for w in ws]
    return "fwords AS (SELECT * FROM " + values(rows, ["lang_pos", "language", "word"]) + ")"


def lexicon_cte() -> str:
    return "lexicon AS (SELECT * FROM " + values(D.INTENT_LEXICON, ["label", "token", "weight"]) + ")"


def labels_cte(labels=None) -> str:
    labels = labels or C.INTENT_CATEGORIES
    return "intent_labels AS (SELECT * FROM " + values(
        [(i, x) for i, x in enumerate(labels)], ["label_pos", "label"]) + ")"


def templates_cte() -> str:
    return "templates AS (SELECT * FROM " + values(
        read_template_files(), ["language", "intent", "variant", "subject", "body"]) + ")"


def tickets_cte() -> str:
    n = len(D.phrase_rows())
    return f"""tickets AS (
  SELECT 'T-' || CAST(e.event_id AS VARCHAR) AS ticket_id, e.event_id, e.ts, p.text, e.value AS handling_ms,
         CASE WHEN e.user_id % 10 = 0 THEN NULL WHEN e.user_id % 10 = 1 THEN '' ELSE c.c_name END
           AS customer_name,
         p.intent AS true_intent, p.urgency AS true_urgency, p.language AS true_language
  FROM events e JOIN phrases p ON e.event_id % {n} = p.phrase_id
  LEFT JOIN customer c ON e.user_id = c.c_custkey)"""


def log_cte() -> str:
    return """clog AS (
  SELECT event_id AS id, ts,
         left(sha256(CAST(event_id AS VARCHAR) || '|' || event_type), 16) AS text_hash,
         ['en','es','fr','de','pt'][(user_id % 5) + 1] AS language,
         event_type AS primary_intent,
         CAST(json_extract_string(props, '$.k') AS INTEGER) / 100 AS confidence,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 90 THEN 'critical'
              WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 60 THEN 'high'
              WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 30 THEN 'medium'
              ELSE 'low' END AS urgency,
         CAST(json_extract_string(props, '$.k') AS INTEGER) >= 80 AS was_escalated,
         CAST(json_extract_string(props, '$.k') AS INTEGER) / 100 < CAST(0.7 AS DOUBLE) AS needs_review,
         value AS processing_time_ms
  FROM events)"""


def escalations_cte() -> str:
    return """escal AS (
  SELECT id, ts + INTERVAL 90 SECOND AS ts,
         CASE WHEN id % 7 = 0 THEN id + 1000000000 ELSE id END AS classification_id,
         'urgency ' || urgency AS reason,
         id % 3 = 0 AS resolved,
         CASE WHEN id % 3 = 0 THEN 'closed by agent' END AS resolution_notes
  FROM clog WHERE was_escalated)"""


def predictions_cte() -> str:
    return """preds AS (
  SELECT event_id AS id, event_type AS y_true,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 75 THEN
           CASE event_type WHEN 'click' THEN 'error' WHEN 'error' THEN 'purchase'
                WHEN 'purchase' THEN 'signup' WHEN 'signup' THEN 'view' ELSE 'click' END
         ELSE event_type END AS y_pred,
         ['en','es','fr','de','pt'][(user_id % 5) + 1] AS language,
         CAST(json_extract_string(props, '$.k') AS INTEGER) / 100 AS confidence
  FROM events)"""


def clean_expr(col: str, max_length: int = C.MAX_LENGTH) -> str:
    """DuckDB cleaning (no NFKC in DuckDB; the fixture texts are NFKC-stable)."""
    x = f"regexp_replace({col}, 'https?://{NWS}+|www\\.{NWS}+', '[URL]', 'g')"
    x = f"regexp_replace({x}, '{NWS}+@{NWS}+\\.{NWS}+', '[EMAIL]', 'g')"
    x = f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"
    x = f"substring({x}, 1, {max_length})"
    return f"CASE WHEN {col} IS NULL OR regexp_matches({col}, '^{WS}*$') THEN '' ELSE {x} END"


def tokens_expr(col: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({col}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
