"""Oracle SQL (DuckDB) for each registered query, written independently.

The driver registers the test tables as views; the fixture views and fixed
data are rebuilt here as CTEs (see ``oracle_base``).
"""

from __future__ import annotations

from ticketflow.plans.oracle_base import (
    clean_expr, escalations_cte, labels_cte, lexicon_cte, log_cte, phrases_cte, predictions_cte, q, rules_cte,
    templates_cte, tickets_cte, tokens_expr, values, with_, words_cte,
)
from ticketflow.operators.gram_vectors import builtin_text
from ticketflow.sources.fixture_data import FUNCTION_WORDS
from ticketflow.sources.fixtures import EVENT_CLASSES

SQL: dict[str, str] = {}


def sql(name: str):
    def deco(fn):
        SQL[name] = fn()
        return fn
    return deco


def cleaned() -> str:
    return f"cleaned AS (SELECT *, {clean_expr('text')} AS cleaned_text FROM tickets)"


def T() -> str:
    return with_(phrases_cte(), tickets_cte(), cleaned())


def hash16(x: str) -> str:
    return f"left(sha256({x}), 16)"


# ---------------------------------------------------------------- text

@sql("clean_text")
def _():
    return T() + "SELECT ticket_id, cleaned_text FROM cleaned"


@sql("preprocess_batch")
def _():
    c = clean_expr("text")
    return (f"SELECT doc_id, CAST(length({c}) AS INTEGER) AS n_chars, {hash16(c)} AS cleaned_hash "
            "FROM documents")


@sql("normalize_unicode")
def _():
    # the documents are NFKC-stable text (checked in tests), so NFKC = identity here
    return f"SELECT doc_id, {hash16('text')} AS nfkc_hash FROM documents"


@sql("mask_urls")
def _():
    from ticketflow.plans.oracle_base import NWS
    return with_(phrases_cte(), tickets_cte()) + (
        f"SELECT ticket_id, regexp_replace(text, 'https?://{NWS}+|www\\.{NWS}+', '[URL]', 'g') AS masked "
        "FROM tickets")


@sql("mask_emails")
def _():
    from ticketflow.plans.oracle_base import NWS
    u = f"regexp_replace(text, 'https?://{NWS}+|www\\.{NWS}+', '[URL]', 'g')"
    return with_(phrases_cte(), tickets_cte()) + (
        f"SELECT ticket_id, regexp_replace({u}, '{NWS}+@{NWS}+\\.{NWS}+', '[EMAIL]', 'g') AS masked "
        "FROM tickets")


@sql("mask_emails_documents")
def _():
    from ticketflow.plans.oracle_base import NWS
    m = f"regexp_replace(text, '{NWS}+@{NWS}+\\.{NWS}+', '[EMAIL]', 'g')"
    return f"SELECT doc_id, {hash16(m)} AS masked_hash, {m} <> text AS changed FROM documents"


@sql("collapse_whitespace")
def _():
    from ticketflow.plans.oracle_base import WS
    return with_(phrases_cte(), tickets_cte()) + (
        f"SELECT ticket_id, trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ') AS collapsed FROM tickets")


@sql("truncate")
def _():
    return "SELECT doc_id, substring(text, 1, 512) AS head_512 FROM documents"


@sql("text_hash")
def _():
    return f"SELECT doc_id, {hash16('text')} AS text_hash FROM documents"


@sql("validate_tickets")
def _():
    return """SELECT doc_id,
  text IS NOT NULL AND length(text) BETWEEN 1 AND 5000 AS is_valid,
  CASE WHEN text IS NULL THEN 'missing text' WHEN length(text) < 1 THEN 'text too short'
       WHEN length(text) > 5000 THEN 'text too long' END AS reject_reason
FROM documents"""


@sql("display_label")
def _():
    return with_(log_cte()) + """SELECT primary_intent,
  array_to_string(list_transform(string_split(replace(primary_intent, '_', ' '), ' '),
    lambda w: upper(left(w, 1)) || lower(substring(w, 2))), ' ') AS display
FROM (SELECT DISTINCT primary_intent FROM clog)"""


# ---------------------------------------------------------------- urgency

def urgency_ctes(src: str = "cleaned", id_col: str = "ticket_id", text: str = "cleaned_text",
                 lang: str = "true_language", conf: str = "(event_id % 11) / 10",
                 ml: str = "CAST(0.5 AS DOUBLE)") -> str:
    """CTEs hits -> uagg -> scored (id, rule_score, n_rules, rules_triggered, raw, ...)."""
    return f""",
hits AS (
  SELECT s.{id_col} AS hid, r.rule_order, r.level,
         r.level || ':' || r.keyword || coalesce(':' || r.language, '') AS rule_id
  FROM {src} s JOIN rules r
    ON contains(lower(s.{text}), r.keyword) AND (r.language IS NULL OR r.language = s.{lang})),
uagg AS (
  SELECT hid, count(*) AS n_rules,
         max(CASE level WHEN 'critical' THEN 3 WHEN 'high' THEN 2 ELSE 1 END) AS top,
         string_agg(rule_id, ',' ORDER BY rule_order) AS rules_triggered
  FROM hits GROUP BY hid),
uraw AS (
  SELECT s.*, coalesce(u.n_rules, 0) AS n_rules, coalesce(u.rules_triggered, '') AS rules_triggered,
         CASE u.top WHEN 3 THEN CAST(1.0 AS DOUBLE) WHEN 2 THEN CAST(0.7 AS DOUBLE)
              WHEN 1 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS rule_score,
         CAST(coalesce({conf}, 0.0) AS DOUBLE) AS uconf,
         {ml} AS ml_score
  FROM {src} s LEFT JOIN uagg u ON s.{id_col} = u.hid),
scored AS (
  SELECT *, least(greatest(CAST(0.7 AS DOUBLE) * rule_score + CAST(0.2 AS DOUBLE) * ml_score
                          + CAST(0.1 AS DOUBLE) * (CAST(1.0 AS DOUBLE) - uconf), 0.0), 1.0) AS uscore
  FROM uraw),
urg AS (
  SELECT *,
    CASE WHEN uscore >= 0.9 THEN 'critical' WHEN uscore >= 0.65 THEN 'high'
         WHEN uscore >= 0.35 THEN 'medium' ELSE 'low' END AS urgency,
    round(uscore, 4) AS urgency_score,
    uscore >= CAST(0.8 AS DOUBLE) AS should_escalate,
    CASE WHEN n_rules > 0 AND uscore >= CAST(0.8 AS DOUBLE)
           THEN 'keywords matched: ' || n_rules || '; auto-escalated due to high urgency'
         WHEN n_rules > 0 THEN 'keywords matched: ' || n_rules
         WHEN uscore >= CAST(0.8 AS DOUBLE) THEN 'auto-escalated due to high urgency'
         ELSE 'standard priority' END AS urgency_reason
  FROM scored)
"""


def U(**kw) -> str:
    return with_(phrases_cte(), tickets_cte(), cleaned(), rules_cte()).rstrip() + urgency_ctes(**kw)


@sql("urgency_score")
def _():
    return U() + "SELECT ticket_id, urgency, urgency_score, should_escalate, urgency_reason, rules_triggered FROM urg"


@sql("urgency_rules")
def _():
    return U() + "SELECT ticket_id, rules_triggered, CAST(n_rules AS INTEGER) AS n_rules FROM urg"


@sql("urgency_rule_score")
def _():
    return U() + "SELECT ticket_id, rule_score FROM urg"


@sql("urgency_level")
def _():
    return with_(log_cte()) + """SELECT id, CASE WHEN confidence >= 0.9 THEN 'critical'
  WHEN confidence >= 0.65 THEN 'high' WHEN confidence >= 0.35 THEN 'medium' ELSE 'low' END AS level
FROM clog"""


@sql("ml_urgency")
def _():
    return U(ml="least(CAST(length(cleaned_text) AS DOUBLE) / 200, CAST(1.0 AS DOUBLE))") + \
        "SELECT ticket_id, urgency, urgency_score, should_escalate FROM urg"


@sql("urgency_by_language")
def _():
    return U() + """SELECT true_language AS language, urgency, count(*) AS n_tickets,
  count(*) FILTER (WHERE should_escalate) AS n_escalated
FROM urg GROUP BY 1, 2"""


@sql("urgency_rule_hits")
def _():
    return U() + "SELECT hid AS ticket_id, rule_id FROM hits"


@sql("escalation_filter")
def _():
    return U() + "SELECT ticket_id, urgency_score FROM urg WHERE should_escalate"


@sql("needs_review")
def _():
    return with_(log_cte()) + "SELECT id, confidence < CAST(0.7 AS DOUBLE) AS needs_review FROM clog"


@sql("low_confidence_filter")
def _():
    return with_(predictions_cte()) + \
        "SELECT id, y_true, y_pred, confidence FROM preds WHERE confidence < CAST(0.7 AS DOUBLE)"



# ---------------------------------------------------------------- metrics store

L = with_(log_cte())


@sql("stats_by_language")
def _():
    return L + """SELECT language, count(*) AS total, round(avg(confidence), 4) AS avg_confidence,
  count(*) FILTER (WHERE needs_review) AS review_count,
  count(*) FILTER (WHERE was_escalated) AS escalation_count
FROM clog GROUP BY language"""


LANG_RATES = """lr AS (SELECT language, count(*) AS total_classifications,
  round(avg(confidence), 4) AS avg_confidence,
  count(*) FILTER (WHERE needs_review) / greatest(count(*), 1) AS review_rate,
  count(*) FILTER (WHERE was_escalated) / greatest(count(*), 1) AS escalation_rate
FROM clog GROUP BY language)"""


@sql("language_rates")
def _():
    return with_(log_cte(), LANG_RATES) + "SELECT * FROM lr"


@sql("intent_distribution")
def _():
    return L + """SELECT primary_intent AS intent, count(*) AS count,
  round(avg(confidence), 4) AS avg_confidence FROM clog GROUP BY primary_intent"""


LATENCY = """lat AS (
  SELECT round(avg(v), 2) AS mean_ms, round(min(v), 2) AS min_ms, round(max(v), 2) AS max_ms,
    round(max(CASE WHEN rn = n // 2 THEN v END), 2) AS p50_ms,
    round(max(CASE WHEN n > 1 AND rn = CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT) THEN v END), 2) AS p95_ms,
    round(max(CASE WHEN n > 1 AND rn = CAST(floor(n * CAST(0.99 AS DOUBLE)) AS BIGINT) THEN v END), 2) AS p99_ms
  FROM (SELECT processing_time_ms AS v,
               row_number() OVER (ORDER BY processing_time_ms) - 1 AS rn,
               count(*) OVER () AS n FROM clog))"""


@sql("latency_stats")
def _():
    return with_(log_cte(), LATENCY) + "SELECT * FROM lat"


@sql("total_classifications")
def _():
    return L + "SELECT count(*) AS total_classifications FROM clog"


@sql("recent_escalations")
def _():
    return with_(log_cte(), escalations_cte()) + """SELECT e.*, c.language, c.primary_intent, c.confidence
FROM escal e LEFT JOIN clog c ON e.classification_id = c.id
ORDER BY e.ts DESC, e.id DESC LIMIT 50"""


@sql("metrics_report")
def _():
    return with_(log_cte(), LANG_RATES, LATENCY) + """
SELECT 'per_language' AS section, language AS key, m.metric, m.value FROM lr,
  (SELECT unnest(['total_classifications','avg_confidence','review_rate','escalation_rate']) AS metric) m0,
  LATERAL (SELECT m0.metric AS metric, CASE m0.metric WHEN 'total_classifications' THEN CAST(total_classifications AS DOUBLE)
     WHEN 'avg_confidence' THEN avg_confidence WHEN 'review_rate' THEN review_rate ELSE escalation_rate END AS value) m
UNION ALL
SELECT 'per_intent', primary_intent, 'count', CAST(count(*) AS DOUBLE) FROM clog GROUP BY primary_intent
UNION ALL
SELECT 'per_intent', primary_intent, 'avg_confidence', round(avg(confidence), 4) FROM clog GROUP BY primary_intent
UNION ALL
SELECT 'latency', NULL, metric, value FROM (UNPIVOT lat ON mean_ms, min_ms, max_ms, p50_ms, p95_ms, p99_ms
  INTO NAME metric VALUE value)
UNION ALL
SELECT 'total', NULL, 'total_classifications', CAST(count(*) AS DOUBLE) FROM clog"""


# ---------------------------------------------------------------- evaluation

EVAL = """sp AS (SELECT language AS scope, y_true, y_pred FROM preds
             UNION ALL SELECT '__all__', y_true, y_pred FROM preds),
labs AS (SELECT DISTINCT scope, y_true AS label FROM sp UNION SELECT DISTINCT scope, y_pred FROM sp),
pl AS (
  SELECT l.scope, l.label,
    count(*) FILTER (WHERE sp.y_true = l.label AND sp.y_pred = l.label) AS tp,
    count(*) FILTER (WHERE sp.y_true = l.label) AS support,
    count(*) FILTER (WHERE sp.y_pred = l.label) AS predicted
  FROM labs l JOIN sp ON sp.scope = l.scope GROUP BY l.scope, l.label),
pm AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
    CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
    CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END AS f1
  FROM pl),
sm AS (
  SELECT scope, sum(tp) / sum(support) AS accuracy,
    list_reduce(list(f1 ORDER BY label), lambda a, b: a + b) / count(*) AS f1_macro,
    list_reduce(list(f1 * support ORDER BY label), lambda a, b: a + b) / sum(support) AS f1_weighted,
    list_reduce(list(precision ORDER BY label), lambda a, b: a + b) / count(*) AS precision_macro,
    list_reduce(list(recall ORDER BY label), lambda a, b: a + b) / count(*) AS recall_macro,
    list_reduce(list(precision * support ORDER BY label), lambda a, b: a + b) / sum(support) AS precision_weighted,
    list_reduce(list(recall * support ORDER BY label), lambda a, b: a + b) / sum(support) AS recall_weighted,
    CAST(sum(support) AS BIGINT) AS sample_count
  FROM pm GROUP BY scope)"""

E = with_(predictions_cte(), EVAL)


@sql("eval_overall")
def _():
    return E + "SELECT accuracy, f1_macro, f1_weighted, precision_macro, recall_macro FROM sm WHERE scope = '__all__'"


@sql("eval_per_language")
def _():
    return E + """SELECT scope AS language, accuracy, f1_macro, f1_weighted, precision_macro, recall_macro,
  sample_count FROM sm WHERE scope <> '__all__'"""


@sql("eval_report")
def _():
    return E + """SELECT label, precision, recall, f1 AS f1_score, support FROM pm WHERE scope = '__all__'
UNION ALL SELECT 'accuracy', NULL, NULL, accuracy, sample_count FROM sm WHERE scope = '__all__'
UNION ALL SELECT 'macro avg', precision_macro, recall_macro, f1_macro, sample_count FROM sm WHERE scope = '__all__'
UNION ALL SELECT 'weighted avg', precision_weighted, recall_weighted, f1_weighted, sample_count FROM sm
  WHERE scope = '__all__'"""


@sql("confusion_matrix")
def _():
    return with_(predictions_cte()) + """, lab AS (SELECT y_true AS l FROM preds UNION SELECT y_pred FROM preds)
SELECT a.l AS y_true, b.l AS y_pred,
  (SELECT count(*) FROM preds p WHERE p.y_true = a.l AND p.y_pred = b.l) AS n
FROM lab a, lab b"""


@sql("transfer_gaps")
def _():
    return E + """SELECT s.scope AS language, round(s.accuracy - o.accuracy, 4) AS accuracy_gap,
  round(o.accuracy, 4) AS overall_accuracy
FROM sm s JOIN sm o ON o.scope = '__all__' WHERE s.scope <> '__all__'"""


@sql("low_confidence_analysis")
def _():
    return with_(predictions_cte()) + """SELECT count(*) FILTER (WHERE confidence < CAST(0.7 AS DOUBLE)) AS count,
  CASE WHEN count(*) FILTER (WHERE confidence < CAST(0.7 AS DOUBLE)) > 0 THEN
    count(*) FILTER (WHERE confidence < CAST(0.7 AS DOUBLE) AND y_true = y_pred)
    / count(*) FILTER (WHERE confidence < CAST(0.7 AS DOUBLE)) END AS accuracy
FROM preds"""


@sql("evaluate")
def _():
    return E + """, cmx AS (
  SELECT a.label AS t, b.label AS p,
    (SELECT count(*) FROM preds x WHERE x.y_true = a.label AND x.y_pred = b.label) AS n
  FROM (SELECT label FROM labs WHERE scope = '__all__') a, (SELECT label FROM labs WHERE scope = '__all__') b),
gaps AS (SELECT s.scope, round(s.accuracy - o.accuracy, 4) AS gap FROM sm s JOIN sm o ON o.scope = '__all__'
         WHERE s.scope <> '__all__'),
low AS (SELECT count(*) FILTER (WHERE confidence < CAST(0.7 AS DOUBLE)) AS c,
          count(*) FILTER (WHERE confidence < CAST(0.7 AS DOUBLE) AND y_true = y_pred) AS ok FROM preds)
SELECT CASE WHEN scope = '__all__' THEN 'overall' ELSE 'per_language' END AS section, scope,
  CAST(NULL AS VARCHAR) AS label, metric, value
FROM (UNPIVOT (SELECT scope, accuracy, f1_macro, f1_weighted, precision_macro, recall_macro,
                      CAST(sample_count AS DOUBLE) AS sample_count FROM sm)
      ON accuracy, f1_macro, f1_weighted, precision_macro, recall_macro, sample_count
      INTO NAME metric VALUE value)
UNION ALL
SELECT 'classification_report', scope, label, metric, value
FROM (UNPIVOT (SELECT scope, label, precision, recall, f1 AS f1_score, CAST(support AS DOUBLE) AS support
               FROM pm WHERE scope = '__all__')
      ON precision, recall, f1_score, support INTO NAME metric VALUE value)
UNION ALL SELECT 'confusion_matrix', '__all__', t || '->' || p, 'n', CAST(n AS DOUBLE) FROM cmx
UNION ALL SELECT 'cross_lingual_transfer', scope, NULL, 'accuracy_gap', gap FROM gaps
UNION ALL SELECT 'low_confidence_analysis', '__all__', NULL, 'count', CAST(c AS DOUBLE) FROM low
UNION ALL SELECT 'low_confidence_analysis', '__all__', NULL, 'accuracy',
  CASE WHEN c > 0 THEN ok / c END FROM low"""


@sql("accuracy_heatmap")
def _():
    cols = ",\n  ".join(f"avg(CASE WHEN y_true = '{c}' THEN CASE WHEN y_true = y_pred THEN 1 ELSE 0 END END) AS \"{c}\""
                        for c in EVENT_CLASSES)
    return with_(predictions_cte()) + f"SELECT language, {cols} FROM preds GROUP BY language"


@sql("label_union")
def _():
    return with_(predictions_cte()) + "SELECT y_true AS label FROM preds UNION SELECT y_pred FROM preds"


@sql("class_counts")
def _():
    return with_(phrases_cte(), tickets_cte()) + \
        "SELECT true_intent AS intent, count(*) AS n FROM tickets GROUP BY true_intent"


# ---------------------------------------------------------------- language

def vote_ctes(src: str, id_col: str, text: str) -> str:
    """fwords must be defined; yields CTE ``vote`` (id, vlang, vconf)."""
    return f"""ftok AS (SELECT {id_col} AS vid, unnest({tokens_expr(text)}) AS word FROM {src}),
fvotes AS (SELECT t.vid, w.language, w.lang_pos, count(*) AS v FROM ftok t JOIN fwords w ON t.word = w.word
           GROUP BY t.vid, w.language, w.lang_pos),
franked AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY v DESC, lang_pos) AS rn,
                   sum(v) OVER (PARTITION BY vid) AS tot FROM fvotes),
vote AS (SELECT vid, language AS vlang, v / tot AS vconf FROM franked WHERE rn = 1)"""


def gram_list(text: str) -> str:
    t = f"regexp_replace(' ' || regexp_replace(lower({text}), '[^\\p{{L}}]+', ' ', 'g') || ' ', ' +', ' ', 'g')"
    return f"(SELECT list_transform(range(1, length(gt) - 1), lambda gi: substr(gt, gi, 3)) FROM (SELECT {t} AS gt))"


def profile_ctes(labelled: str) -> str:
    """``labelled``: a select of (language, t); yields CTE prof (language, gram, lp, unseen)."""
    return f"""pg AS (SELECT language, unnest({gram_list('t')}) AS gram FROM ({labelled})),
pc AS (SELECT language, gram, count(*) AS c FROM pg GROUP BY 1, 2),
pd AS (SELECT language, sum(c) + (SELECT count(DISTINCT gram) FROM pc) AS den FROM pc GROUP BY language),
prof AS (SELECT pc.language, gram, CAST(round(ln((c + 1) / CAST(den AS DOUBLE)) * 1000000) AS BIGINT) AS lp,
                CAST(round(ln(1 / CAST(den AS DOUBLE)) * 1000000) AS BIGINT) AS unseen
         FROM pc JOIN pd ON pc.language = pd.language)"""


def builtin_profile_ctes() -> str:
    rows = [(lang, builtin_text(lang)) for lang in FUNCTION_WORDS]
    return profile_ctes("SELECT * FROM " + values(rows, ["language", "t"]))


def ngram_ctes(src: str, text: str) -> str:
    """CTE ng (txt, glang, gconf) for the distinct texts of ``src``."""
    return f"""gtxt AS (SELECT DISTINCT {text} AS txt FROM {src} WHERE {text} IS NOT NULL),
glist AS (SELECT txt, {gram_list('txt')} AS gl FROM gtxt),
gsc AS (SELECT txt, language, CAST(any_value(len(gl)) * max(unseen) + sum(lp - unseen) AS BIGINT) AS score
        FROM (SELECT txt, gl, unnest(gl) AS gram FROM glist) x JOIN prof USING (gram) GROUP BY txt, language),
ng AS (SELECT txt, arg_min(language, (-score, language)) AS glang,
              1 / sum(exp((score - mx) / CAST(1000000 AS DOUBLE))) AS gconf
       FROM (SELECT *, max(score) OVER (PARTITION BY txt) AS mx FROM gsc) GROUP BY txt)"""


def script_ctes(src: str, text: str) -> str:
    """CTE scr (stxt, slang, sconf): distinct texts most of whose letters are of one language's script."""
    classes = {"han": r"\p{Han}", "kana": r"\p{Hiragana}\p{Katakana}", "ko": r"\p{Hangul}", "ar": r"\p{Arabic}",
               "hi": r"\p{Devanagari}", "th": r"\p{Thai}", "ru": r"\p{Cyrillic}", "letters": r"\p{L}\p{M}"}
    counts = ", ".join(f"length(regexp_replace(txt, '[^{c}]', '', 'g')) AS {k}" for k, c in classes.items())
    some = "".join(c for k, c in classes.items() if k != "letters")
    return f"""scn AS (SELECT txt, {counts} FROM (SELECT DISTINCT {text} AS txt FROM {src} WHERE {text} IS NOT NULL)
        WHERE regexp_matches(txt, '[{some}]')),
scm AS (SELECT *, greatest(han + kana, ko, ar, hi, th, ru) AS most FROM scn),
scr AS (SELECT txt AS stxt, least(most / CAST(letters AS DOUBLE), 1) AS sconf,
               CASE WHEN han + kana >= most THEN CASE WHEN kana >= 0.1 * (han + kana) THEN 'ja' ELSE 'zh' END
                    WHEN ko = most THEN 'ko' WHEN ar = most THEN 'ar' WHEN hi = most THEN 'hi'
                    WHEN th = most THEN 'th' ELSE 'ru' END AS slang
        FROM scm WHERE 2 * most > letters)"""


def detect_select(src: str, id_col: str, text: str, blank_expr: str, extra: str = "") -> str:
    pick = "v.vconf IS NOT NULL AND (n.gconf IS NULL OR NOT n.gconf > v.vconf)"
    return f"""SELECT s.{id_col}, {extra}
  CASE WHEN {blank_expr} THEN 'en' WHEN slang IS NOT NULL THEN slang
       WHEN {pick} THEN v.vlang ELSE coalesce(n.glang, 'en') END AS language,
  round(CASE WHEN {blank_expr} THEN CAST(0.0 AS DOUBLE) WHEN slang IS NOT NULL THEN sconf WHEN {pick} THEN v.vconf
             ELSE coalesce(n.gconf, CAST(0.0 AS DOUBLE)) END, 4) AS language_confidence
FROM {src} s LEFT JOIN vote v ON s.{id_col} = v.vid LEFT JOIN ng n ON s.{text} = n.txt
LEFT JOIN scr ON s.{text} = scr.stxt"""


def detect_ctes(src: str, id_col: str, text: str) -> list[str]:
    return [words_cte(), vote_ctes(src, id_col, text), builtin_profile_ctes(), ngram_ctes(src, text),
            script_ctes(src, text)]


BLANK_DOC = "(s.text IS NULL OR regexp_matches(s.text, '^[\\t\\n\\x0b\\f\\r \\x1c-\\x1f\\x{85}\\p{Z}]*$'))"


@sql("detect_language")
def _():
    return with_(*detect_ctes("documents", "doc_id", "text")) + \
        detect_select("documents", "doc_id", "text", BLANK_DOC)


@sql("detect_batch_with_confidence")
def _():
    return with_(phrases_cte(), tickets_cte(), cleaned(), *detect_ctes("cleaned", "ticket_id", "cleaned_text")) + \
        detect_select("cleaned", "ticket_id", "cleaned_text", "s.cleaned_text = ''")


@sql("detect_batch")
def _():
    return "SELECT ticket_id, language FROM (" + SQL["detect_batch_with_confidence"] + ")"


@sql("detect_conversation_language")
def _():
    src = "conv AS (SELECT conv_id || '/' || turn AS rid, conv_id, turn, text FROM conversations)"
    return with_(src, *detect_ctes("conv", "rid", "text")) + \
        "SELECT conv_id, turn, language, language_confidence FROM (" + \
        detect_select("conv", "rid", "text", BLANK_DOC, "s.conv_id, s.turn,") + ")"


FITTED = "substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < 'c'"


@sql("ngram_profile")
def _():
    return with_(profile_ctes(f"SELECT lang AS language, text AS t FROM documents WHERE lang IS NOT NULL AND {FITTED}"),
                 ngram_ctes("documents", "text")) + f"""SELECT doc_id, {FITTED} AS fitted, glang AS language,
  round(gconf, 4) AS confidence FROM documents d LEFT JOIN ng ON d.text = ng.txt"""


@sql("best_language")
def _():
    return with_(words_cte(), vote_ctes("documents", "doc_id", "text"),
                 profile_ctes(f"SELECT lang AS language, text AS t FROM documents WHERE lang IS NOT NULL AND {FITTED}"),
                 ngram_ctes("documents", "text"), script_ctes("documents", "text")) + \
        detect_select("documents", "doc_id", "text", BLANK_DOC, FITTED.replace("doc_id", "s.doc_id") + " AS fitted,")


@sql("function_word_vote")
def _():
    return with_(words_cte(), vote_ctes("documents", "doc_id", "text")) + \
        "SELECT d.doc_id, v.vlang AS language, v.vconf AS confidence FROM documents d LEFT JOIN vote v ON d.doc_id = v.vid"


@sql("function_word_vote_join")
def _():
    return with_(words_cte(), vote_ctes("documents", "doc_id", "text")) + \
        "SELECT vid AS doc_id, vlang AS language, vconf AS confidence FROM vote"


@sql("language_eval")
def _():
    return with_(*detect_ctes("documents", "doc_id", "text"),
                 "det AS (" + detect_select("documents", "doc_id", "text", BLANK_DOC) + ")",
                 """preds AS (SELECT d.lang AS y_true, det.language AS y_pred, d.lang AS language
                    FROM documents d JOIN det ON d.doc_id = det.doc_id)""",
                 EVAL) + """SELECT scope AS language, accuracy, f1_macro, f1_weighted, precision_macro,
  recall_macro, sample_count FROM sm WHERE scope <> '__all__'"""


@sql("token_overlap_language")
def _():
    from ticketflow.plans.oracle_base import WS, q
    from ticketflow.sources.fixture_data import OVERLAP_SAMPLES
    toks = f"list_distinct(list_filter(string_split_regex(lower(text), '{WS}+'), lambda x: x <> ''))"
    cases = []
    for lang, sample in OVERLAP_SAMPLES.items():
        if lang == "en":
            continue
        arr = "[" + ", ".join(q(w) for w in sorted(set(sample.lower().split()))) + "]"
        cases.append(f"WHEN len(list_filter(tk, lambda x: list_contains({arr}, x))) > 3 THEN {q(lang)}")
    return with_(phrases_cte(), tickets_cte()) + \
        f"SELECT ticket_id, CASE {' '.join(cases)} ELSE 'en' END AS language FROM (SELECT ticket_id, {toks} AS tk FROM tickets)"


@sql("language_names")
def _():
    from ticketflow.config import LANGUAGE_NAMES
    from ticketflow.plans.oracle_base import values
    return "WITH names AS (SELECT * FROM " + values(list(LANGUAGE_NAMES.items()), ["code", "name"]) + """)
SELECT d.doc_id, d.lang AS language, coalesce(n.name, d.lang) AS language_name
FROM documents d LEFT JOIN names n ON d.lang = n.code"""


# ---------------------------------------------------------------- intents

def intent_ctes(src: str = "cleaned", id_col: str = "ticket_id", text: str = "cleaned_text",
                single: bool = False) -> str:
    """lexicon + intent_labels defined; yields ``isc`` (iid, label, label_pos, h, score, rk)."""
    score = ("CASE WHEN sum(h) OVER (PARTITION BY iid) = 0 THEN CAST(1.0 AS DOUBLE) / 6 "
             "ELSE h / sum(h) OVER (PARTITION BY iid) END") if single else "h / (h + 1)"
    return f"""itok AS (SELECT {id_col} AS iid, unnest({tokens_expr(text)}) AS token FROM {src}),
ih AS (SELECT i.iid, l.label, sum(l.weight) AS h FROM itok i JOIN lexicon l ON i.token = l.token
       GROUP BY i.iid, l.label),
igrid AS (SELECT s.{id_col} AS iid, il.label, il.label_pos, coalesce(ih.h, 0) AS h
          FROM {src} s CROSS JOIN intent_labels il LEFT JOIN ih ON ih.iid = s.{id_col} AND ih.label = il.label),
isc0 AS (SELECT *, {score} AS score FROM igrid),
isc AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, label_pos) AS rk FROM isc0),
irank AS (
  SELECT iid, max(label) FILTER (WHERE rk = 1) AS primary_intent,
    max(score) FILTER (WHERE rk = 1) AS s1,
    max(label) FILTER (WHERE rk = 2) AS secondary_intent,
    max(score) FILTER (WHERE rk = 2) AS s2
  FROM isc GROUP BY iid)"""


def I(single: bool = False) -> str:
    return with_(phrases_cte(), tickets_cte(), cleaned(), lexicon_cte(), labels_cte(),
                 intent_ctes(single=single))


RANK_SELECT = """SELECT iid AS ticket_id, primary_intent, round(s1, 4) AS primary_confidence, secondary_intent,
  CASE WHEN s2 <> 0 THEN round(s2, 4) END AS secondary_confidence,
  s1 < CAST(0.7 AS DOUBLE) AS needs_human_review
FROM irank"""


@sql("score_intents")
def _():
    return I() + "SELECT iid AS ticket_id, CAST(rk AS INTEGER) AS rank, label, score FROM isc"


@sql("score_intents_single_label")
def _():
    return I(single=True) + "SELECT iid AS ticket_id, CAST(rk AS INTEGER) AS rank, label, score FROM isc"


@sql("score_intents_join")
def _():
    return SQL["score_intents"]


@sql("rank_intents")
def _():
    return I() + RANK_SELECT


@sql("intent_scorer")
def _():
    return I() + RANK_SELECT


@sql("sort_scores")
def _():
    return I() + "SELECT iid AS ticket_id, CAST(rk AS INTEGER) AS rank, label, round(score, 4) AS score FROM isc"


# ---------------------------------------------------------------- replies

def template_ctes(src: str, lang: str, intent: str, urgency: str) -> str:
    """templates defined; yields ``tpick`` (tid_, subject, body, prio)."""
    return f"""tv AS (SELECT ticket_id AS tid_, {lang} AS lang_, {intent} AS intent_,
         CASE WHEN {urgency} IN ('high', 'critical') THEN 'high_urgency' ELSE 'default' END AS variant_
       FROM {src}),
tcand AS (
  SELECT t.tid_, tp.subject, tp.body,
    CASE WHEN tp.language = t.lang_ AND tp.variant = t.variant_ THEN 1
         WHEN tp.language = t.lang_ AND tp.variant = 'default' THEN 2
         WHEN tp.language = 'en' AND tp.variant = t.variant_ THEN 3
         ELSE 4 END AS prio
  FROM tv t JOIN templates tp ON tp.intent = t.intent_ AND tp.language IN (t.lang_, 'en')
    AND tp.variant IN (t.variant_, 'default')
  UNION ALL
  SELECT t.tid_, b.subject, b.body, CASE WHEN b.variant = t.variant_ THEN 5 ELSE 6 END
  FROM tv t JOIN templates b ON b.language = '*' AND b.variant IN (t.variant_, 'default')),
tpick AS (SELECT tid_, arg_min(subject, prio) AS subject, arg_min(body, prio) AS body, min(prio) AS prio
          FROM tcand GROUP BY tid_)"""


def render_sql(x: str, name: str, tid: str) -> str:
    n = f"coalesce(nullif({name}, ''), 'Valued Customer')"
    t = f"coalesce(nullif({tid}, ''), 'N/A')"
    stripped = f"replace(replace({x}, '{{customer_name}}', ''), '{{ticket_id}}', '')"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN regexp_matches({stripped}, '\\{{[^{{}}]*\\}}') THEN {x} "
            f"ELSE replace(replace({x}, '{{customer_name}}', {n}), '{{ticket_id}}', {t}) END")


TSRC = "CASE WHEN prio <= 2 THEN 'language' WHEN prio <= 4 THEN 'fallback' WHEN prio <= 6 THEN 'base' END"


def TPL() -> str:
    return with_(phrases_cte(), tickets_cte(), cleaned(), templates_cte(),
                 template_ctes("cleaned", "true_language", "true_intent", "true_urgency"))


@sql("select_template")
def _():
    return TPL() + f"SELECT c.ticket_id, {TSRC} AS template_source, subject, body FROM cleaned c LEFT JOIN tpick p ON c.ticket_id = p.tid_"


@sql("render_reply")
def _():
    return TPL() + (f"SELECT c.ticket_id, {render_sql('subject', 'c.customer_name', 'c.ticket_id')} AS reply_subject, "
                    f"{render_sql('body', 'c.customer_name', 'c.ticket_id')} AS reply_body "
                    "FROM cleaned c LEFT JOIN tpick p ON c.ticket_id = p.tid_")


@sql("list_templates")
def _():
    return with_(phrases_cte(), tickets_cte(), templates_cte()) + """SELECT l.language,
  CAST(count(DISTINCT t.intent) AS INTEGER) AS n_intents,
  coalesce(string_agg(DISTINCT t.intent, ',' ORDER BY t.intent), '') AS intents
FROM (SELECT DISTINCT true_language AS language FROM tickets) l
LEFT JOIN templates t ON t.language = l.language GROUP BY l.language"""


# ---------------------------------------------------------------- flagship

@sql("enrich_tickets")
def _():
    det = "det AS (" + detect_select("cleaned", "ticket_id", "cleaned_text", "s.cleaned_text = ''") + ")"
    ri = """ri AS (
  SELECT c.*, d.language, d.language_confidence,
    CASE WHEN c.cleaned_text <> '' THEN r.primary_intent END AS primary_intent,
    CASE WHEN c.cleaned_text <> '' THEN round(r.s1, 4) END AS primary_confidence,
    CASE WHEN c.cleaned_text <> '' THEN r.secondary_intent END AS secondary_intent,
    CASE WHEN c.cleaned_text <> '' AND r.s2 <> 0 THEN round(r.s2, 4) END AS secondary_confidence,
    c.cleaned_text = '' OR r.s1 < CAST(0.7 AS DOUBLE) AS needs_human_review
  FROM cleaned c JOIN det d ON c.ticket_id = d.ticket_id JOIN irank r ON c.ticket_id = r.iid)"""
    head = with_(phrases_cte(), tickets_cte(), cleaned(),
                 *detect_ctes("cleaned", "ticket_id", "cleaned_text"), det, lexicon_cte(), labels_cte(),
                 intent_ctes(), ri, rules_cte()).rstrip()
    head += urgency_ctes(src="ri", lang="language", conf="primary_confidence")
    head += ", " + templates_cte() + ",\n" + template_ctes("urg", "language", "primary_intent", "urgency") + "\n"
    return head + f"""SELECT u.ticket_id, u.language, round(u.language_confidence, 4) AS language_confidence,
  u.primary_intent, u.primary_confidence, u.secondary_intent, u.secondary_confidence, u.needs_human_review,
  u.urgency, u.urgency_score, u.should_escalate, u.urgency_reason, u.rules_triggered,
  {render_sql('p.subject', 'u.customer_name', 'u.ticket_id')} AS reply_subject,
  {render_sql('p.body', 'u.customer_name', 'u.ticket_id')} AS reply_body
FROM urg u LEFT JOIN tpick p ON u.ticket_id = p.tid_"""


# ---------------------------------------------------------------- splits, corpora

def split_sql(src: str, id_col: str, strat: str, train: float, val: float, test: float, seed: int,
              key_cols: str) -> str:
    rest = val + test
    rel = test / rest
    return f"""SELECT {key_cols}, CASE WHEN r < n - n_rest THEN 'train'
    WHEN r - (n - n_rest) < n_rest - ceil(n_rest * CAST({rel!r} AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, ceil(n * CAST({rest!r} AS DOUBLE)) AS n_rest FROM (
  SELECT *, row_number() OVER (PARTITION BY {strat} ORDER BY hk, {id_col}) - 1 AS r,
         count(*) OVER (PARTITION BY {strat}) AS n
  FROM (SELECT *, CAST('0x' || left(md5(CAST({id_col} AS VARCHAR) || '|' || '{seed}'), 15) AS BIGINT) AS hk
        FROM {src})))"""


@sql("stratified_split")
def _():
    return with_(phrases_cte(), tickets_cte()) + split_sql("tickets", "event_id", "true_intent",
                                                           0.7, 0.15, 0.15, 42, "ticket_id")


@sql("save_splits")
def _():
    return SQL["stratified_split"]


@sql("grouped_split")
def _():
    key = "md5(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'), '[0-9]+', '0', 'g')))"
    return f"""WITH k AS (SELECT doc_id, lang, {key} AS key FROM documents),
pc AS (SELECT key, lang, count(*) AS n FROM k GROUP BY key, lang),
g AS (SELECT key, lang, CAST(sum(n) OVER (PARTITION BY key) AS BIGINT) AS size FROM pc
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, lang NULLS LAST) = 1),
s AS (SELECT *, CAST('0x' || substr(md5(key || '|7'), 1, 15) AS BIGINT) AS h,
             CAST(sum(size) OVER (PARTITION BY lang) AS BIGINT) AS total FROM g),
l AS (SELECT *, size > CAST(0.05 AS DOUBLE) * total AS large,
             CASE WHEN size > CAST(0.05 AS DOUBLE) * total THEN 0 ELSE size END AS line FROM s),
m AS (SELECT *, CAST(sum(line) OVER (PARTITION BY lang) AS BIGINT) AS length,
             sum(line) OVER (PARTITION BY lang ORDER BY h, key ROWS UNBOUNDED PRECEDING) - line / CAST(2 AS DOUBLE) AS middle FROM l),
t AS (SELECT *, greatest(CAST(0.8 AS DOUBLE) * total - (total - length), CAST(0 AS DOUBLE)) AS train FROM m),
side AS (SELECT key, CASE WHEN large OR middle < train THEN 'train'
                          WHEN middle < train + (length - train) * (CAST(0.1 AS DOUBLE) / (CAST(0.1 AS DOUBLE) + CAST(0.1 AS DOUBLE)))
                          THEN 'val' ELSE 'test' END AS split FROM t)
SELECT doc_id, split FROM k JOIN side ON side.key = k.key"""


@sql("split_by_language")
def _():
    return split_sql("documents", "doc_id", "lang", 0.8, 0.1, 0.1, 7, "doc_id")


@sql("head_per_language")
def _():
    return """SELECT doc_id, lang FROM (SELECT doc_id, lang,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 100"""


CORPORA = """corp AS (SELECT doc_id, text, lang AS language, 'documents' AS source FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents
  WHERE lang IN ('en', 'es', 'fr', 'de', 'pt')) WHERE rn <= 500)"""

COMBINED = CORPORA + """,
comb AS (SELECT doc_id, language, text, row_number() OVER (ORDER BY
    CASE language WHEN 'en' THEN 0 WHEN 'es' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END, doc_id) - 1
    AS row_index FROM corp)"""


@sql("load_language_corpora")
def _():
    return with_(CORPORA) + f"SELECT doc_id, language, source, {hash16('text')} AS text_hash FROM corp"


@sql("prepare_combined_dataset")
def _():
    return with_(COMBINED) + """SELECT doc_id, row_index, left(sha256(text), 16) AS text_hash,
  ['billing','technical_support','account','general_inquiry','complaint','feedback'][(row_index % 6) + 1] AS intent,
  ['low','medium','high','critical'][(row_index % 4) + 1] AS urgency, language FROM comb"""


@sql("save_dataset")
def _():
    return "SELECT * EXCLUDE (text_hash) FROM (" + SQL["prepare_combined_dataset"] + ")"


@sql("round_robin_label")
def _():
    return with_(phrases_cte(), tickets_cte()) + """SELECT ticket_id, row_index,
  ['billing','technical_support','account','general_inquiry','complaint','feedback'][(row_index % 6) + 1] AS label
FROM (SELECT ticket_id, row_number() OVER (ORDER BY event_id) - 1 AS row_index FROM tickets)"""


# ---------------------------------------------------------------- sources and sinks

@sql("read_tickets")
def _():
    return with_(phrases_cte(), tickets_cte()) + \
        "SELECT text, true_intent AS intent, true_urgency AS urgency, true_language AS language FROM tickets"


def enriched_log_sql() -> str:
    return (with_(phrases_cte(), tickets_cte()) +
            f"""SELECT t.event_id AS id, CAST(floor(epoch(t.ts)) AS BIGINT) AS ts_seconds, t.handling_ms AS processing_time_ms,
  {hash16('t.text')} AS text_hash, e.language, e.primary_intent,
  e.primary_confidence AS confidence, e.urgency, e.should_escalate AS was_escalated,
  e.needs_human_review AS needs_review, CAST(t.ts AS DATE) AS date
FROM tickets t JOIN ({SQL['enrich_tickets']}) e ON t.ticket_id = e.ticket_id""")


@sql("log_classifications")
def _():
    return enriched_log_sql()


@sql("latency_sketches")
def _():
    return with_(log_cte()) + """SELECT language, count(processing_time_ms) AS n,
  round(min(processing_time_ms), 2) AS min_ms, round(max(processing_time_ms), 2) AS max_ms,
  TRUE AS p50_close, TRUE AS p95_close, TRUE AS p99_close FROM clog GROUP BY language"""


@sql("log_escalations")
def _():
    return f"""SELECT id AS classification_id, 'auto-escalated due to high urgency' AS reason, FALSE AS resolved
FROM ({enriched_log_sql()}) WHERE was_escalated"""


@sql("log_accuracy_metrics")
def _():
    return E + """SELECT scope AS language, CAST(NULL AS VARCHAR) AS intent, accuracy, f1_macro AS f1_score,
  sample_count FROM sm WHERE scope <> '__all__'"""


@sql("save_evaluation")
def _():
    return SQL["evaluate"]


@sql("create_tables")
def _():
    return """SELECT 'classifications' AS table_name, (SELECT count(*) FROM events) AS n_rows
UNION ALL SELECT 'escalations', 0 UNION ALL SELECT 'accuracy_metrics', 0"""


# ---------------------------------------------------------------- augmentation

def _translations_cte() -> str:
    from ticketflow.plans.oracle_base import values
    from ticketflow.sources.fixture_data import translation_rows
    return "tr AS (SELECT * FROM " + values(translation_rows(), ["source_text", "target_language", "ttext"]) + ")"


HEAD = """head AS (SELECT event_id, text, true_intent AS intent, true_urgency AS urgency FROM tickets
  WHERE true_language = 'en' ORDER BY event_id LIMIT 200),
aug AS (SELECT h.*, l.language FROM head h, (SELECT unnest(['es', 'fr', 'de', 'pt']) AS language) l)"""


@sql("english_head")
def _():
    return with_(phrases_cte(), tickets_cte(), HEAD) + "SELECT event_id, text FROM head"


@sql("augment_languages")
def _():
    return with_(phrases_cte(), tickets_cte(), HEAD, _translations_cte()) + """SELECT a.event_id, a.language,
  t.ttext AS text, a.intent, a.urgency, TRUE AS translated
FROM aug a JOIN tr t ON a.text = t.source_text AND a.language = t.target_language"""


@sql("translation_gaps")
def _():
    return with_(phrases_cte(), tickets_cte(), HEAD, _translations_cte()) + """SELECT a.language, count(*) AS missing
FROM aug a LEFT JOIN tr t ON a.text = t.source_text AND a.language = t.target_language
WHERE t.ttext IS NULL GROUP BY a.language"""


@sql("translator")
def _():
    # the dictionary gives unknown texts back unchanged
    return with_(phrases_cte(), tickets_cte(), HEAD, _translations_cte()) + """SELECT a.event_id, a.language,
  coalesce(t.ttext, a.text) AS text, a.intent, a.urgency, coalesce(t.ttext <> a.text, FALSE) AS translated
FROM aug a LEFT JOIN tr t ON a.text = t.source_text AND a.language = t.target_language"""


# ---------------------------------------------------------------- configuration, streaming

@sql("urgency_config")
def _():
    from ticketflow import config as CFG
    from ticketflow.plans.oracle_base import values
    from ticketflow.plans.queries import CUSTOM_URGENCY_CONFIG
    rules = "rules AS (SELECT * FROM " + values(CFG.keyword_rules(CUSTOM_URGENCY_CONFIG),
                                               ["rule_order", "level", "keyword", "language"]) + ")"
    return with_(phrases_cte(), tickets_cte(), cleaned(), rules).rstrip() + urgency_ctes() + \
        "SELECT ticket_id, urgency, urgency_score, rules_triggered FROM urg"


@sql("stream_enrich")
def _():
    return SQL["enrich_tickets"]


@sql("stream_metrics")
def _():
    return with_(log_cte()) + """SELECT date_trunc('hour', ts) AS window_start,
  date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, language, count(*) AS total,
  count(*) FILTER (WHERE needs_review) / count(*) AS review_rate,
  count(*) FILTER (WHERE was_escalated) / count(*) AS escalation_rate,
  round(sum(CAST(confidence AS DECIMAL(18,10))) / count(*), 4) AS avg_confidence,
  count(*) FILTER (WHERE needs_review) AS review_count,
  count(*) FILTER (WHERE was_escalated) AS escalation_count
FROM clog GROUP BY ALL"""


# ---------------------------------------------------------------- remaining inventory keys

@sql("urgency_ml_score")
def _():
    return U() + "SELECT ticket_id, ml_score, round(uscore, 4) AS blended FROM urg"


@sql("round4")
def _():
    return L + """SELECT primary_intent AS intent, round(avg(confidence), 4) AS avg_confidence,
  round(avg(processing_time_ms), 2) AS avg_ms, round(max(processing_time_ms) / CAST(3.0 AS DOUBLE), 2) AS max_third_ms
FROM clog GROUP BY primary_intent"""


@sql("load_templates")
def _():
    return with_(phrases_cte(), tickets_cte(), templates_cte()) + """SELECT t.language, t.intent, t.variant, t.subject,
  t.body, (SELECT count(*) FROM tickets x WHERE x.true_language = t.language AND x.true_intent = t.intent) AS n_tickets
FROM templates t"""


@sql("quarantine_tickets")
def _():
    return """SELECT conv_id, turn, CASE WHEN text IS NULL THEN 'missing text' WHEN length(text) < 1 THEN 'text too short'
  WHEN length(text) > 800 THEN 'text too long' END AS reject_reason FROM conversations"""


@sql("clean_conversations")
def _():
    return f"SELECT conv_id, turn, {clean_expr('text')} AS cleaned_text FROM conversations"


@sql("mask_page_urls")
def _():
    return "SELECT page_id, 'see [URL] by [EMAIL]' AS masked FROM pages"


@sql("nfkc_forms")
def _():
    return """SELECT conv_id, turn, role || ' ' || ['urgent', 'file', 'caf' || chr(233), '12', 'アポ', 'plain'][(conv_id + turn) % 6 + 1]
  AS nfkc FROM conversations"""


@sql("read_tickets_array")
def _():
    return SQL["read_tickets"]


@sql("metrics_report_nested")
def _():
    from ticketflow import config as C
    return f"""SELECT * FROM ({SQL['metrics_report']})
UNION ALL SELECT 'model_info', {q(C.MODEL_NAME)}, 'intent_categories', CAST({len(C.INTENT_CATEGORIES)} AS DOUBLE)
UNION ALL SELECT 'timestamp', '2024-01-01T00:00:00', 'as_of', CAST(1 AS DOUBLE)"""


# ---------------------------------------------------------------- quality of the enrichment

def _enriched_preds(y_true: str, y_pred: str) -> str:
    return (with_(phrases_cte(), tickets_cte()) +
            f"""SELECT t.{y_true} AS y_true, {y_pred} AS y_pred, t.true_language AS language
FROM tickets t JOIN ({SQL['enrich_tickets']}) e ON t.ticket_id = e.ticket_id""")


@sql("intent_eval")
def _():
    return ("WITH preds AS (" + _enriched_preds("true_intent", "coalesce(e.primary_intent, 'none')") + "),\n"
            + EVAL + """
SELECT scope AS language, accuracy, f1_macro, f1_weighted, precision_macro, recall_macro, sample_count
FROM sm WHERE scope <> '__all__'""")


@sql("urgency_eval")
def _():
    return ("WITH preds AS (" + _enriched_preds("true_urgency", "e.urgency") + "),\n" + EVAL + """
SELECT label, precision, recall, f1 AS f1_score, support FROM pm WHERE scope = '__all__'
UNION ALL SELECT 'accuracy', NULL, NULL, accuracy, sample_count FROM sm WHERE scope = '__all__'
UNION ALL SELECT 'macro avg', precision_macro, recall_macro, f1_macro, sample_count FROM sm WHERE scope = '__all__'
UNION ALL SELECT 'weighted avg', precision_weighted, recall_weighted, f1_weighted, sample_count FROM sm
  WHERE scope = '__all__'""")


@sql("store_report")
def _():
    return f"SELECT * FROM ({SQL['metrics_report_nested']}) WHERE metric NOT IN ('p50_ms', 'p95_ms', 'p99_ms')"
