"""Flagship: per-ticket enrichment as one Spark plan.

clean -> detect language -> score and rank intents -> urgency (with the
rounded primary confidence) -> select template -> render reply.

Row-level stages are column expressions (those with lambdas or ``reflect`` are
evaluated outside codegen); the template stage adds two broadcast joins against
a dimension bounded by the template files; the language decision is one Arrow
evaluation.  Intents come from the lexicon, from a learned ``IntentModel`` or
from a user's model (``intent_model``).  Nothing is collected; a batch of one ticket is a
one-row DataFrame.  A blank cleaned text gets the fallback language, null
intent fields and the review flag (the lexical scorer has nothing to score).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.config import Settings
from ticketflow.functions.text import clean_text
from ticketflow.operators.intents import model_intent_scores, rank_intents, score_intents
from ticketflow.operators.language import detect_language
from ticketflow.operators.learned_intents import IntentModel
from ticketflow.operators.templates import read_template_files, render_reply, select_template
from ticketflow.operators.urgency import score_urgency

INTENT_COLS = ["primary_intent", "primary_confidence", "secondary_intent", "secondary_confidence",
               "all_scores"]

OUTPUT_COLS = [
    "language", "language_confidence", "primary_intent", "primary_confidence",
    "secondary_intent", "secondary_confidence", "needs_human_review", "urgency",
    "urgency_score", "should_escalate", "urgency_reason", "rules_triggered",
    "response_suggestion", "template_source",
]


def enrich_tickets(df: DataFrame, text_col: str = "text", id_col: str = "ticket_id",
                   name_col: str | None = "customer_name", templates: DataFrame | None = None,
                   profile: DataFrame | None = None, settings: Settings = Settings(),
                   lexicon: list | None = None, rules: list | None = None, ml_score=None,
                   intent_model=None, keep_cols: list[str] | None = None) -> DataFrame:
    templates = templates if templates is not None else read_template_files()
    keep = list(keep_cols) if keep_cols is not None else [c for c in df.columns]
    x = df.withColumn("cleaned_text", clean_text(text_col, settings.max_length))
    x = x.withColumn("_low", F.lower(F.col("cleaned_text")))
    x = detect_language(x, "cleaned_text", profile, settings.fallback_language, lowered_col="_low")
    if isinstance(intent_model, IntentModel):
        x = intent_model.score(x, "cleaned_text", "intent_scores", lexicon)
    elif intent_model is None:
        x = score_intents(x, "cleaned_text", "intent_scores", lexicon, settings.intent_categories,
                          lowered_col="_low")
    else:
        # all columns pass through the model's mapInPandas: no join back
        x = model_intent_scores(x, intent_model, id_col, "cleaned_text", settings.intent_categories,
                                keep_columns=True)
    x = rank_intents(x, "intent_scores", settings.confidence_threshold)
    blank = F.col("cleaned_text") == ""
    for c in INTENT_COLS:
        x = x.withColumn(c, F.when(~blank, F.col(c)))
    x = x.withColumn("needs_human_review", blank | F.col("needs_human_review"))
    x = score_urgency(x, "cleaned_text", "language", "primary_confidence", ml_score, rules,
                      settings.escalation_threshold)
    x = select_template(x, templates, "primary_intent", "language", "urgency", settings.fallback_language)
    name = F.col(name_col) if name_col else F.lit(None).cast("string")
    x = x.withColumn("response_suggestion", render_reply("template", name, F.col(id_col)))
    x = x.withColumn("language_confidence", F.round("language_confidence", 4))
    out = [c for c in keep if c not in OUTPUT_COLS and c != "cleaned_text"]
    return x.select(*out, "cleaned_text", *OUTPUT_COLS)


def enrich_flat(enriched: DataFrame, id_col: str = "ticket_id") -> DataFrame:
    """Flat projection of the enrichment (arrays joined, reply split)."""
    return enriched.select(
        id_col, "language", "language_confidence", "primary_intent", "primary_confidence",
        "secondary_intent", "secondary_confidence", "needs_human_review", "urgency",
        "urgency_score", "should_escalate", "urgency_reason",
        F.array_join("rules_triggered", ",").alias("rules_triggered"),
        F.col("response_suggestion.subject").alias("reply_subject"),
        F.col("response_suggestion.body").alias("reply_body"),
    )
