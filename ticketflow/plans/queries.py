"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (mostly through the fixture views) so
its work grows with the data.  Output columns are aliased to match the
oracle SQL in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketflow.functions import text as TX
from ticketflow.operators import urgency as UO
from ticketflow.sources import fixture_data as D
from ticketflow.sources import fixtures as FX
from ticketflow.sources.tables import read_table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _ticket_conf():
    # deterministic confidence in {0.0, 0.1, ..., 1.0}: exercises both edges
    return (F.col("event_id") % 11) / F.lit(10)


def cleaned_tickets(spark, sf, with_customer: bool = False) -> DataFrame:
    return FX.tickets(spark, sf, with_customer).withColumn("cleaned_text", TX.clean_text("text"))


# ---------------------------------------------------------------- 2.2 / 2.8 text

@register("clean_text")
def q_clean_text(spark, sf):
    return cleaned_tickets(spark, sf).select("ticket_id", "cleaned_text")


@register("preprocess_batch")
def q_preprocess_batch(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    return TX.preprocess_batch(docs, "text", "cleaned_text").select(
        "doc_id", F.length("cleaned_text").alias("n_chars"), TX.text_hash("cleaned_text").alias("cleaned_hash"))


@register("normalize_unicode")
def q_normalize_unicode(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    return docs.select("doc_id", TX.text_hash(TX.normalize_unicode("text")).alias("nfkc_hash"))


@register("mask_urls")
def q_mask_urls(spark, sf):
    t = FX.tickets(spark, sf)
    return t.select("ticket_id", TX.mask_urls("text").alias("masked"))


@register("mask_emails")
def q_mask_emails(spark, sf):
    t = FX.tickets(spark, sf)
    return t.select("ticket_id", TX.mask_emails(TX.mask_urls("text")).alias("masked"))


@register("mask_emails_documents")
def q_mask_emails_documents(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    m = TX.mask_emails("text")
    return docs.select("doc_id", TX.text_hash(m).alias("masked_hash"),
                       (m != F.col("text")).alias("changed"))


@register("collapse_whitespace")
def q_collapse_whitespace(spark, sf):
    t = FX.tickets(spark, sf)
    return t.select("ticket_id", TX.collapse_whitespace("text").alias("collapsed"))


@register("truncate")
def q_truncate(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    return docs.select("doc_id", TX.truncate("text", 512).alias("head_512"))


@register("text_hash")
def q_text_hash(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    return docs.select("doc_id", TX.text_hash("text").alias("text_hash"))


@register("validate_tickets")
def q_validate_tickets(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    return TX.validate_tickets(docs).select("doc_id", "is_valid", "reject_reason")


@register("quarantine_tickets")
def q_quarantine_tickets(spark, sf):
    """Accepted and rejected conversations, written apart and read back."""
    path = _scratch(spark, "validated")
    rows = read_table(spark, sf, "conversations", "conv_id", "turn", "text")
    accepted, rejected = TX.split_valid(rows, max_chars=800)
    accepted.write.parquet(f"{path}/accepted")
    rejected.write.parquet(f"{path}/quarantine")
    return spark.read.parquet(f"{path}/accepted").select("conv_id", "turn", F.lit(None).cast("string").alias("reject_reason")).unionByName(
        spark.read.parquet(f"{path}/quarantine").select("conv_id", "turn", "reject_reason"))


@register("clean_conversations")
def q_clean_conversations(spark, sf):
    """Cleaning of the given conversation texts."""
    rows = read_table(spark, sf, "conversations", "conv_id", "turn", "text")
    return TX.preprocess_batch(rows, "text", "cleaned_text").select("conv_id", "turn", "cleaned_text")


@register("mask_page_urls")
def q_mask_page_urls(spark, sf):
    """Masks on the given page addresses: every one of them is an address."""
    pages = read_table(spark, sf, "pages", "page_id", "url")
    line = F.concat_ws(" ", F.lit("see"), "url", F.concat(F.lit("by user"), F.col("page_id").cast("string"), F.lit("@mail.example")))
    return pages.select("page_id", TX.mask_emails(TX.mask_urls(line)).alias("masked"))


@register("detect_conversation_language")
def q_detect_conversation_language(spark, sf):
    from ticketflow.operators.language import detect_batch_with_confidence
    rows = read_table(spark, sf, "conversations", "conv_id", "turn", "text")
    return detect_batch_with_confidence(rows, "text").select(
        "conv_id", "turn", "language", F.round("language_confidence", 4).alias("language_confidence"))


@register("nfkc_forms")
def q_nfkc_forms(spark, sf):
    """NFKC of full-width, ligature and combining forms put into the conversations."""
    rows = read_table(spark, sf, "conversations", "conv_id", "turn", "role")
    forms = ["ｕｒｇｅｎｔ", "ﬁle", "cafe\u0301", "①②", "ｱﾎﾟ", "plain"]
    form = F.element_at(F.array(*map(F.lit, forms)), ((F.col("conv_id") + F.col("turn")) % len(forms) + 1).cast("int"))
    return rows.select("conv_id", "turn", TX.normalize_unicode(F.concat_ws(" ", "role", form)).alias("nfkc"))


@register("display_label")
def q_display_label(spark, sf):
    log = FX.classification_log(spark, sf)
    return log.select("primary_intent").distinct().select(
        "primary_intent", TX.display_label("primary_intent").alias("display"))


# ---------------------------------------------------------------- urgency

def scored_tickets(spark, sf) -> DataFrame:
    t = cleaned_tickets(spark, sf).withColumn("conf", _ticket_conf())
    return UO.score_urgency(t, "cleaned_text", "true_language", "conf")


@register("urgency_score")
def q_urgency_score(spark, sf):
    s = scored_tickets(spark, sf)
    return s.select("ticket_id", "urgency", "urgency_score", "should_escalate", "urgency_reason",
                    F.array_join("rules_triggered", ",").alias("rules_triggered"))


@register("urgency_rules")
def q_urgency_rules(spark, sf):
    from ticketflow.functions import urgency as U
    t = cleaned_tickets(spark, sf)
    trig = U.urgency_rules("cleaned_text", "true_language")
    return t.select("ticket_id", F.array_join(trig, ",").alias("rules_triggered"),
                    F.size(trig).alias("n_rules"))


@register("urgency_rule_score")
def q_urgency_rule_score(spark, sf):
    from ticketflow.functions import urgency as U
    t = cleaned_tickets(spark, sf)
    return t.select("ticket_id", U.urgency_rule_score(
        U.urgency_rules("cleaned_text", "true_language")).alias("rule_score"))


@register("urgency_level")
def q_urgency_level(spark, sf):
    from ticketflow.functions import urgency as U
    log = FX.classification_log(spark, sf)
    return log.select("id", U.urgency_level("confidence").alias("level"))


@register("ml_urgency")
def q_ml_urgency(spark, sf):
    # a caller's ML signal plugged in as a column expression
    t = cleaned_tickets(spark, sf).withColumn("conf", _ticket_conf())
    ml = F.least(F.length("cleaned_text").cast("double") / F.lit(200), F.lit(1.0))
    s = UO.score_urgency(t, "cleaned_text", "true_language", "conf", ml_score=ml)
    return s.select("ticket_id", "urgency", "urgency_score", "should_escalate")


@register("urgency_by_language")
def q_urgency_by_language(spark, sf):
    s = scored_tickets(spark, sf)
    return UO.urgency_level_counts(s, "true_language").withColumnRenamed("true_language", "language")


@register("urgency_rule_hits")
def q_urgency_rule_hits(spark, sf):
    t = cleaned_tickets(spark, sf)
    return UO.urgency_rule_hits(t, FX.keyword_rules(spark), "ticket_id", "cleaned_text",
                                "true_language").select("ticket_id", "rule_id")


@register("escalation_filter")
def q_escalation_filter(spark, sf):
    s = scored_tickets(spark, sf)
    return s.filter(F.col("should_escalate")).select("ticket_id", "urgency_score")


@register("needs_review")
def q_needs_review(spark, sf):
    from ticketflow.operators.intents import needs_review
    log = FX.classification_log(spark, sf)
    return log.select("id", needs_review("confidence").alias("needs_review"))


@register("low_confidence_filter")
def q_low_confidence_filter(spark, sf):
    from ticketflow.operators.evaluation import low_confidence_filter
    return low_confidence_filter(FX.predictions(spark, sf)).select("id", "y_true", "y_pred", "confidence")


# ---------------------------------------------------------------- 2.4 metrics store

def _log(spark, sf):
    return FX.classification_log(spark, sf)


@register("stats_by_language")
def q_stats_by_language(spark, sf):
    from ticketflow.operators import metrics as M
    return M.stats_by_language(_log(spark, sf))


@register("language_rates")
def q_language_rates(spark, sf):
    from ticketflow.operators import metrics as M
    return M.language_rates(M.stats_by_language(_log(spark, sf)))


@register("intent_distribution")
def q_intent_distribution(spark, sf):
    from ticketflow.operators import metrics as M
    return M.intent_distribution(_log(spark, sf))


@register("latency_stats")
def q_latency_stats(spark, sf):
    from ticketflow.operators import metrics as M
    return M.latency_stats(_log(spark, sf))


@register("total_classifications")
def q_total_classifications(spark, sf):
    from ticketflow.operators import metrics as M
    return M.total_classifications(_log(spark, sf))


@register("recent_escalations")
def q_recent_escalations(spark, sf):
    from ticketflow.operators import metrics as M
    return M.recent_escalations(FX.escalations(spark, sf), _log(spark, sf), 50)


@register("metrics_report")
def q_metrics_report(spark, sf):
    from ticketflow.operators import metrics as M
    return M.metrics_report_long(_log(spark, sf))


@register("metrics_report_nested")
def q_metrics_report_nested(spark, sf):
    """The nested report (one row) taken apart again."""
    from ticketflow.operators import metrics as M
    return _report_rows(M.metrics_report(_log(spark, sf), as_of="2024-01-01T00:00:00"))


def _report_rows(r):
    none = F.lit(None).cast("string")
    one = lambda section, key, metric, value: F.struct(
        F.lit(section).alias("section"), key.alias("key"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))
    return r.select(F.explode(F.concat(
        F.flatten(F.transform("per_language", lambda x: F.array(*[
            one("per_language", x["language"], m, x[m])
            for m in ("total_classifications", "avg_confidence", "review_rate", "escalation_rate")]))),
        F.flatten(F.transform("per_intent", lambda x: F.array(*[
            one("per_intent", x["intent"], m, x[m]) for m in ("count", "avg_confidence")]))),
        F.array(*[one("latency", none, m, F.col(f"latency.{m}"))
                  for m in ("mean_ms", "min_ms", "max_ms", "p50_ms", "p95_ms", "p99_ms")]),
        F.array(one("total", none, "total_classifications", F.col("total_classifications")),
                one("model_info", F.col("model_info.model_name"), "intent_categories", F.size("model_info.intent_categories")),
                one("timestamp", F.col("timestamp"), "as_of", F.lit(1))))).alias("x")).select("x.*")


# ---------------------------------------------------------------- 2.4 evaluation

def _preds(spark, sf):
    return FX.predictions(spark, sf)


@register("eval_overall")
def q_eval_overall(spark, sf):
    from ticketflow.operators import evaluation as EV
    return EV.eval_overall(_preds(spark, sf))


@register("eval_report")
def q_eval_report(spark, sf):
    from ticketflow.operators import evaluation as EV
    return EV.eval_report(_preds(spark, sf))


@register("confusion_matrix")
def q_confusion_matrix(spark, sf):
    from ticketflow.operators import evaluation as EV
    return EV.confusion_matrix(_preds(spark, sf))


@register("eval_per_language")
def q_eval_per_language(spark, sf):
    from ticketflow.operators import evaluation as EV
    return EV.eval_per_language(_preds(spark, sf))


@register("transfer_gaps")
def q_transfer_gaps(spark, sf):
    from ticketflow.operators import evaluation as EV
    return EV.transfer_gaps(_preds(spark, sf))


@register("low_confidence_analysis")
def q_low_confidence_analysis(spark, sf):
    from ticketflow.operators import evaluation as EV
    return EV.low_confidence_analysis(_preds(spark, sf))


@register("evaluate")
def q_evaluate(spark, sf):
    from ticketflow.operators import evaluation as EV
    return EV.evaluate(_preds(spark, sf))


@register("accuracy_heatmap")
def q_accuracy_heatmap(spark, sf):
    from ticketflow.operators import evaluation as EV
    return EV.accuracy_heatmap(_preds(spark, sf), FX.EVENT_CLASSES)


@register("label_union")
def q_label_union(spark, sf):
    p = _preds(spark, sf)
    return p.select(F.col("y_true").alias("label")).union(p.select("y_pred")).distinct()


@register("class_counts")
def q_class_counts(spark, sf):
    t = FX.tickets(spark, sf)
    return t.groupBy(F.col("true_intent").alias("intent")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- 2.9 language

def _docs(spark, sf):
    return read_table(spark, sf, "documents", "doc_id", "text", "lang")


@register("detect_language")
def q_detect_language(spark, sf):
    from ticketflow.operators.language import detect_language
    d = detect_language(_docs(spark, sf), "text")
    return d.select("doc_id", "language", F.round("language_confidence", 4).alias("language_confidence"))


@register("detect_batch")
def q_detect_batch(spark, sf):
    from ticketflow.operators.language import detect_batch
    return detect_batch(cleaned_tickets(spark, sf), "cleaned_text").select("ticket_id", "language")


@register("detect_batch_with_confidence")
def q_detect_batch_with_confidence(spark, sf):
    from ticketflow.operators.language import detect_batch_with_confidence
    d = detect_batch_with_confidence(cleaned_tickets(spark, sf), "cleaned_text")
    return d.select("ticket_id", "language", F.round("language_confidence", 4).alias("language_confidence"))


@register("function_word_vote")
def q_function_word_vote(spark, sf):
    from ticketflow.operators.language import add_function_word_vote
    v = add_function_word_vote(_docs(spark, sf), "text", "vote")
    return v.select("doc_id", F.col("vote.language").alias("language"),
                    F.col("vote.confidence").alias("confidence"))


@register("function_word_vote_join")
def q_function_word_vote_join(spark, sf):
    from ticketflow.operators.language import function_word_vote_join
    words = FX.function_words(spark)
    v = function_word_vote_join(_docs(spark, sf), words.withColumn(
        "lang_pos", F.array_position(F.array(*[F.lit(x) for x in D.FUNCTION_WORDS]), F.col("language"))),
        "doc_id", "text")
    return v.select("doc_id", F.col("vote.language").alias("language"),
                    F.col("vote.confidence").alias("confidence"))


@register("language_eval")
def q_language_eval(spark, sf):
    """detect_language evaluated against the documents' labelled language."""
    from ticketflow.operators.evaluation import eval_per_language
    from ticketflow.operators.language import detect_language
    d = detect_language(_docs(spark, sf), "text")
    preds = d.select(F.col("lang").alias("y_true"), F.col("language").alias("y_pred"),
                     F.col("lang").alias("language"))
    return eval_per_language(preds)


def _fit_split(spark, sf):
    """Documents and the trigram profile of those that a hash of the id sets apart for fitting."""
    from ticketflow.operators.language import fit_ngram_profile
    digit = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1)
    docs = _docs(spark, sf).withColumn("fitted", digit < "c")
    return docs, fit_ngram_profile(docs.where("fitted"), "text", "lang")


@register("ngram_profile")
def q_ngram_profile(spark, sf):
    from ticketflow.operators.language import score_ngram_profile
    docs, prof = _fit_split(spark, sf)
    s = score_ngram_profile(docs, prof, "doc_id", "text")
    return docs.join(s, "doc_id", "left").select("doc_id", "fitted", F.col("ngram.language").alias("language"),
                                                 F.round("ngram.confidence", 4).alias("confidence"))


@register("best_language")
def q_best_language(spark, sf):
    """Ensemble of both backends (vote first, fitted trigram profile second)."""
    from ticketflow.operators.language import detect_language
    docs, prof = _fit_split(spark, sf)
    d = detect_language(docs, "text", profile=prof)
    return d.select("doc_id", "fitted", "language", F.round("language_confidence", 4).alias("language_confidence"))


@register("token_overlap_language")
def q_token_overlap_language(spark, sf):
    from ticketflow.operators.language import token_overlap_language
    t = FX.tickets(spark, sf)
    return t.select("ticket_id", token_overlap_language("text").alias("language"))


@register("language_names")
def q_language_names(spark, sf):
    from ticketflow.operators.language import language_names
    d = _docs(spark, sf).select("doc_id", F.col("lang").alias("language"))
    return language_names(d, "language").select("doc_id", "language", "language_name")


# ---------------------------------------------------------------- 2.5/2.9 intents

def ranked_tickets(spark, sf) -> DataFrame:
    from ticketflow.operators.intents import rank_intents, score_intents
    return rank_intents(score_intents(cleaned_tickets(spark, sf), "cleaned_text"))


_RANK_COLS = ["ticket_id", "primary_intent", "primary_confidence", "secondary_intent",
              "secondary_confidence", "needs_human_review"]


@register("score_intents")
def q_score_intents(spark, sf):
    from ticketflow.operators.intents import score_intents, sort_scores
    s = score_intents(cleaned_tickets(spark, sf), "cleaned_text")
    return sort_scores(s, "ticket_id")


@register("score_intents_single_label")
def q_score_intents_single_label(spark, sf):
    from ticketflow.operators.intents import score_intents, sort_scores
    s = score_intents(cleaned_tickets(spark, sf), "cleaned_text", multi_label=False)
    return sort_scores(s, "ticket_id")


@register("score_intents_join")
def q_score_intents_join(spark, sf):
    from ticketflow.operators.intents import score_intents_join, sort_scores
    s = score_intents_join(cleaned_tickets(spark, sf), FX.intent_lexicon(spark), "ticket_id", "cleaned_text")
    return sort_scores(s, "ticket_id")


@register("rank_intents")
def q_rank_intents(spark, sf):
    return ranked_tickets(spark, sf).select(*_RANK_COLS)


@register("sort_scores")
def q_sort_scores(spark, sf):
    from ticketflow.operators.intents import sort_scores
    r = ranked_tickets(spark, sf)
    return sort_scores(r, "ticket_id", "all_scores")


@register("intent_scorer")
def q_intent_scorer(spark, sf):
    """The plug-in path (mapInPandas + model factory) with a lexicon model."""
    from ticketflow.operators.intents import lexicon_model_factory, model_intent_scores, rank_intents
    c = cleaned_tickets(spark, sf)
    s = model_intent_scores(c, lexicon_model_factory(), "ticket_id", "cleaned_text")
    return rank_intents(s).select(*_RANK_COLS)


# ---------------------------------------------------------------- replies

def _ticket_variants(spark, sf):
    # true labels drive selection so the check isolates the template logic
    return cleaned_tickets(spark, sf, with_customer=True).select(
        "ticket_id", "customer_name", F.col("true_language").alias("language"),
        F.col("true_intent").alias("primary_intent"), F.col("true_urgency").alias("urgency"))


@register("select_template")
def q_select_template(spark, sf):
    from ticketflow.operators.templates import load_templates, select_template
    s = select_template(_ticket_variants(spark, sf), load_templates(spark))
    return s.select("ticket_id", "template_source", F.col("template.subject").alias("subject"),
                    F.col("template.body").alias("body"))


@register("render_reply")
def q_render_reply(spark, sf):
    from ticketflow.operators.templates import load_templates, render_reply, select_template
    s = select_template(_ticket_variants(spark, sf), load_templates(spark))
    r = s.withColumn("reply", render_reply("template", "customer_name", "ticket_id"))
    return r.select("ticket_id", F.col("reply.subject").alias("reply_subject"),
                    F.col("reply.body").alias("reply_body"))


@register("list_templates")
def q_list_templates(spark, sf):
    """Template coverage for the languages seen in the tickets."""
    from ticketflow.operators.templates import list_templates, load_templates
    langs = FX.tickets(spark, sf).select(F.col("true_language").alias("language")).distinct()
    lt = list_templates(load_templates(spark))
    j = langs.join(F.broadcast(lt), "language", "left")
    return j.select("language", F.coalesce(F.size("intents"), F.lit(0)).alias("n_intents"),
                    F.coalesce(F.array_join("intents", ","), F.lit("")).alias("intents"))


# ---------------------------------------------------------------- flagship

@register("enrich_tickets")
def q_enrich_tickets(spark, sf):
    from ticketflow.plans.enrich import enrich_flat, enrich_tickets
    return enrich_flat(enrich_tickets(FX.tickets(spark, sf, with_customer=True)))


# ---------------------------------------------------------------- 2.5 splits, corpora

@register("stratified_split")
def q_stratified_split(spark, sf):
    from ticketflow.operators.splits import stratified_split
    t = FX.tickets(spark, sf).select("ticket_id", "event_id", "true_intent")
    return stratified_split(t, "event_id", stratify_col="true_intent").select("ticket_id", "split")


@register("grouped_split")
def q_grouped_split(spark, sf):
    """Documents split by whole groups of equal or near-equal texts, stratified by language."""
    from ticketflow.operators.splits import grouped_split, near_text_key
    return grouped_split(_docs(spark, sf), near_text_key(F.col("text")), 0.8, 0.1, 0.1, "lang", 7).select("doc_id", "split")


@register("split_by_language")
def q_split_by_language(spark, sf):
    from ticketflow.operators.splits import stratified_split
    d = _docs(spark, sf).select("doc_id", "lang")
    return stratified_split(d, "doc_id", 0.8, 0.1, 0.1, stratify_col="lang", random_state=7) \
        .select("doc_id", "split")


@register("head_per_language")
def q_head_per_language(spark, sf):
    from ticketflow.operators.splits import head_per_group
    return head_per_group(_docs(spark, sf).select("doc_id", "lang"), "lang", ["doc_id"], 100)


@register("load_language_corpora")
def q_load_language_corpora(spark, sf):
    from ticketflow.sources.corpora import load_language_corpora
    c = load_language_corpora(_docs(spark, sf))
    return c.select("doc_id", "language", "source", TX.text_hash("text").alias("text_hash"))


@register("prepare_combined_dataset")
def q_prepare_combined_dataset(spark, sf):
    from ticketflow.sources.corpora import prepare_combined_dataset
    return prepare_combined_dataset(_docs(spark, sf)).select(
        "doc_id", "row_index", TX.text_hash("text").alias("text_hash"), "intent", "urgency", "language")


@register("round_robin_label")
def q_round_robin_label(spark, sf):
    from ticketflow.config import INTENT_CATEGORIES
    from ticketflow.sources.corpora import round_robin_label
    t = FX.tickets(spark, sf).select("ticket_id", "event_id")
    return round_robin_label(t, "event_id", INTENT_CATEGORIES, "label").select("ticket_id", "row_index", "label")


# ---------------------------------------------------------------- 2.1 sources and sinks

def _scratch(spark, name):
    from ticketflow.session import scratch_dir
    return scratch_dir(spark, name)


@register("read_tickets")
def q_read_tickets(spark, sf):
    from ticketflow.sources.tickets import read_tickets
    path = _scratch(spark, "tickets-json")
    FX.tickets(spark, sf).select(
        "text", F.col("true_intent").alias("intent"), F.col("true_urgency").alias("urgency"),
        F.col("true_language").alias("language")).write.json(path)
    return read_tickets(spark, path, multi_line=False)


@register("read_tickets_array")
def q_read_tickets_array(spark, sf):
    """The JSON array form: one document per file."""
    from ticketflow.sources.tickets import read_tickets
    path = _scratch(spark, "tickets-array")
    rows = FX.tickets(spark, sf).select("text", F.col("true_intent").alias("intent"), F.col("true_urgency").alias("urgency"),
                                        F.col("true_language").alias("language"), F.col("event_id"))
    # one array per file of up to 2,000 tickets
    rows.groupBy(F.floor(F.col("event_id") / 2000).alias("part")).agg(
        F.to_json(F.collect_list(F.struct("text", "intent", "urgency", "language"))).alias("value")) \
        .repartition("part").write.partitionBy("part").text(path)
    return read_tickets(spark, path, multi_line=True).select("text", "intent", "urgency", "language")


@register("save_dataset")
def q_save_dataset(spark, sf):
    from ticketflow.sources.corpora import prepare_combined_dataset
    from ticketflow.sources.sinks import save_dataset
    ds = prepare_combined_dataset(_docs(spark, sf))
    path = save_dataset(ds, _scratch(spark, "data"), "combined_dataset")
    return spark.read.parquet(path).select("doc_id", "row_index", "intent", "urgency", "language")


@register("save_splits")
def q_save_splits(spark, sf):
    from ticketflow.operators.splits import stratified_split
    from ticketflow.sources.sinks import save_splits
    t = FX.tickets(spark, sf).select("ticket_id", "event_id", "true_intent")
    out = _scratch(spark, "splits")
    save_splits(stratified_split(t, "event_id", stratify_col="true_intent"), out)
    return spark.read.parquet(out).select("ticket_id", "split")


def _enriched_log(spark, sf):
    from ticketflow.plans.enrich import enrich_tickets
    from ticketflow.sources.sinks import classification_rows
    e = enrich_tickets(FX.tickets(spark, sf, with_customer=True))
    return classification_rows(e, id_col="event_id", text_col="text", ts_col="ts", processing_time_col="handling_ms")


@register("log_classifications")
def q_log_classifications(spark, sf):
    from ticketflow.sources.sinks import create_tables, log_classifications, read_store, save_dataset
    base = _scratch(spark, "store")
    create_tables(spark, base)
    # enriched once, logged twice
    rows = spark.read.parquet(save_dataset(_enriched_log(spark, sf), _scratch(spark, "nightly"), "classifications"))
    for _ in range(2):      # the second write replaces the first
        log_classifications(rows, base, batch_id="nightly")
    return read_store(spark, base, "classifications").select(
        "id", F.unix_timestamp("ts").alias("ts_seconds"), "processing_time_ms", "text_hash", "language", "primary_intent", "confidence", "urgency", "was_escalated",
        "needs_review", "date")


def _store_with_rerun(spark, sf):
    """A store of two batches, the second of which was first logged with the rows of the first one too."""
    from ticketflow.sources.sinks import log_classifications
    base = _scratch(spark, "store")
    log = _log(spark, sf).withColumn("date", F.to_date("ts"))
    early = F.dayofyear("ts") % 2 == 0
    log_classifications(log.where(early), base, batch_id="even days")
    log_classifications(log, base, batch_id="odd days")
    log_classifications(log.where(~early), base, batch_id="odd days")    # fewer dates than before
    return base


@register("store_report")
def q_store_report(spark, sf):
    """The report from rollups after a batch was replaced (percentiles: see latency_sketches)."""
    from ticketflow.operators import rollups as R
    from ticketflow.sources.sinks import read_rollup
    base = _store_with_rerun(spark, sf)
    r = R.report(read_rollup(spark, base, "rollups"), read_rollup(spark, base, "latencies"), as_of="2024-01-01T00:00:00")
    return _report_rows(r).where(~F.col("metric").isin("p50_ms", "p95_ms", "p99_ms"))


@register("latency_sketches")
def q_latency_sketches(spark, sf):
    """Merged sketches per language against the exact ranks in the log: within 1 % (bound: 0.35 %)."""
    from ticketflow.operators import rollups as R
    from ticketflow.sources.sinks import read_rollup, read_store
    base = _store_with_rerun(spark, sf)
    found = R.latency_quantiles(read_rollup(spark, base, "latencies"), "language")
    log = read_store(spark, base, "classifications").select(F.col("language").alias("_language"), F.col("processing_time_ms").alias("ms"))
    # one row per language on the other side
    both = log.join(found, F.col("_language").eqNullSafe(F.col("language")))
    counts = both.groupBy("language", "n", "min_ms", "max_ms").agg(
        *(F.count_if(F.col("ms") < F.col(f"{q}_ms")).alias(f"{q}_below") for q in R.QUANTILES),
        *(F.count_if(F.col("ms") <= F.col(f"{q}_ms")).alias(f"{q}_upto") for q in R.QUANTILES))
    close = lambda q, p: ((F.col(f"{q}_below") <= (p + 0.01) * F.col("n") + 1)
                          & (F.col(f"{q}_upto") >= (p - 0.01) * F.col("n") - 1))
    return counts.select("language", "n", "min_ms", "max_ms", *(close(q, p).alias(f"{q}_close") for q, p in R.QUANTILES.items()))


@register("log_escalations")
def q_log_escalations(spark, sf):
    from ticketflow.sources.sinks import create_tables, escalation_rows, log_escalations, read_store
    base = _scratch(spark, "store")
    create_tables(spark, base)
    log_escalations(escalation_rows(_enriched_log(spark, sf)), base)
    return read_store(spark, base, "escalations").select("classification_id", "reason", "resolved")


@register("log_accuracy_metrics")
def q_log_accuracy_metrics(spark, sf):
    from ticketflow.operators.evaluation import eval_per_language
    from ticketflow.sources.sinks import accuracy_rows, create_tables, log_accuracy_metrics, read_store
    base = _scratch(spark, "store")
    create_tables(spark, base)
    log_accuracy_metrics(accuracy_rows(eval_per_language(_preds(spark, sf))), base)
    return read_store(spark, base, "accuracy_metrics").select(
        "language", "intent", "accuracy", "f1_score", "sample_count")


@register("save_evaluation")
def q_save_evaluation(spark, sf):
    from ticketflow.operators.evaluation import evaluate
    from ticketflow.sources.sinks import read_evaluations, save_evaluation
    path = _scratch(spark, "evaluations")
    save_evaluation(evaluate(_preds(spark, sf)), path)
    return read_evaluations(spark, path).drop("run_ts")


@register("create_tables")
def q_create_tables(spark, sf):
    from ticketflow.sources.sinks import STORE, create_tables, log_classifications, read_store
    base = _scratch(spark, "store")
    create_tables(spark, base)
    create_tables(spark, base)  # idempotent
    log_classifications(_log(spark, sf).withColumn("date", F.to_date("ts")), base)
    parts = [read_store(spark, base, n).select(F.lit(n).alias("table_name")) for n in STORE]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    names = spark.createDataFrame([(n,) for n in STORE], "table_name string")
    counts = u.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_rows"))
    return names.join(counts, "table_name", "left").select(
        "table_name", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


# ---------------------------------------------------------------- 2.3 augmentation

def _english_tickets(spark, sf):
    return FX.tickets(spark, sf).select(
        "event_id", "text", F.col("true_intent").alias("intent"), F.col("true_urgency").alias("urgency"),
        F.col("true_language").alias("language"))


@register("translation_gaps")
def q_translation_gaps(spark, sf):
    """Head rows that have no translation, per target language."""
    from ticketflow.operators.augment import translation_gaps
    return translation_gaps(_english_tickets(spark, sf), FX.translations(spark), "event_id", 200)


@register("english_head")
def q_english_head(spark, sf):
    from ticketflow.operators.augment import english_head
    return english_head(_english_tickets(spark, sf), 200, "event_id").select("event_id", "text")


@register("augment_languages")
def q_augment_languages(spark, sf):
    from ticketflow.operators.augment import augment_languages
    a = augment_languages(_english_tickets(spark, sf), FX.translations(spark), "event_id", 200)
    return a.select("event_id", "language", "text", "intent", "urgency", "translated")


@register("translator")
def q_translator(spark, sf):
    from ticketflow.operators.augment import augment_with_model, dictionary_translator_factory
    from ticketflow.sources import fixture_data as D
    f = dictionary_translator_factory(D.translation_rows())
    a = augment_with_model(_english_tickets(spark, sf), f, "event_id", 200)
    return a.select("event_id", "language", "text", "intent", "urgency", "translated")


# ---------------------------------------------------------------- 2.11 configuration

CUSTOM_URGENCY_CONFIG = {"critical": ["outage", "down", "urgent"], "high": ["refund", "error"]}


@register("urgency_config")
def q_urgency_config(spark, sf):
    from ticketflow.config import keyword_rules
    t = cleaned_tickets(spark, sf).withColumn("conf", _ticket_conf())
    s = UO.score_urgency(t, "cleaned_text", "true_language", "conf",
                         rules=keyword_rules(CUSTOM_URGENCY_CONFIG))
    return s.select("ticket_id", "urgency", "urgency_score",
                    F.array_join("rules_triggered", ",").alias("rules_triggered"))


def _phrase_augmented(spark, sf):
    from ticketflow.operators.phrases import augment_with_phrases
    pairs = spark.createDataFrame(D.phrase_pairs(), "source_text string, target_language string, text string")
    return augment_with_phrases(_english_tickets(spark, sf), pairs, "event_id")


@register("augment_phrases")
def q_augment_phrases(spark, sf):
    """The English head translated by phrases; texts with too many unknown words stay under their language."""
    return _phrase_augmented(spark, sf).select("event_id", "target_language", "language", "text", "translated", "n_gaps")


@register("phrase_gaps")
def q_phrase_gaps(spark, sf):
    from ticketflow.operators.phrases import phrase_gaps
    return phrase_gaps(_phrase_augmented(spark, sf))


@register("intent_model_eval")
def q_intent_model_eval(spark, sf):
    """Learned intent scorer on texts that neither its regression nor its calibration saw,
    beside the lexicon on the same texts: accuracy and calibration error per language."""
    from ticketflow.operators import learned_intents as L
    from ticketflow.operators.intents import score_intents
    from ticketflow.session import materialize
    t = FX.tickets(spark, sf).select("ticket_id", "text", F.col("true_intent").alias("intent"), F.col("true_language").alias("language"))
    model = L.fit_intents(t)
    unseen = materialize(t.where(L.fold(F.col("text")).isin(list(L.HELD_OUT))))
    learned = L.calibration_by(model.score(unseen, "text"), "intent", "language")
    lexical = L.calibration_by(score_intents(unseen, "text"), "intent", "language").select(
        F.col("language").alias("_l"), F.col("accuracy").alias("lexicon_accuracy"),
        F.col("calibration_error").alias("lexicon_calibration_error"))
    digits = lambda c: F.round(c, 4).alias(c)
    return learned.join(lexical, F.col("language").eqNullSafe(F.col("_l"))).select(
        "language", "n", *map(digits, ("accuracy", "mean_confidence", "calibration_error", "lexicon_accuracy",
                                       "lexicon_calibration_error")))


# ---------------------------------------------------------------- 2.10 streaming

@register("stream_enrich")
def q_stream_enrich(spark, sf):
    from ticketflow.streaming.enrich import read_enriched, stream_enrich
    src, sink, ck = _scratch(spark, "stream-src"), _scratch(spark, "stream-out"), _scratch(spark, "stream-ck")
    t = FX.tickets(spark, sf, with_customer=True)
    t.repartition(4).write.parquet(src)
    stream_enrich(spark, src, t.schema, sink, ck, max_files_per_trigger=2)
    return read_enriched(spark, sink)


@register("stream_metrics")
def q_stream_metrics(spark, sf):
    """Windowed metrics of the log, read as a stream of files that overlap in event time
    (a file read later holds rows behind the watermark)."""
    from ticketflow.streaming.metrics import latest_windows, stream_metrics
    src, sink, ck = _scratch(spark, "metrics-src"), _scratch(spark, "metrics-out"), _scratch(spark, "metrics-ck")
    log = _log(spark, sf)
    log.repartition(2, "id").write.parquet(src)
    stream_metrics(spark, src, log.schema, sink, ck, max_files_per_trigger=1)
    return latest_windows(spark, sink).select(
        "window_start", "window_end", "language", "total", "avg_confidence", "review_count", "escalation_count",
        "review_rate", "escalation_rate")


# ---------------------------------------------------------------- remaining inventory keys

@register("urgency_ml_score")
def q_urgency_ml_score(spark, sf):
    """Default ML signal (constant 0.5) and the blended score it yields."""
    from ticketflow.functions import urgency as U
    t = cleaned_tickets(spark, sf).withColumn("conf", _ticket_conf())
    ml = U.urgency_ml_score("cleaned_text")
    rule = U.urgency_rule_score(U.urgency_rules("cleaned_text", "true_language"))
    return t.select("ticket_id", ml.alias("ml_score"),
                    F.round(U.combined_score(rule, ml, F.col("conf")), 4).alias("blended"))


@register("round4")
def q_round4(spark, sf):
    """Display rounding (4 dp confidences, 2 dp latencies) per intent."""
    log = _log(spark, sf)
    return log.groupBy(F.col("primary_intent").alias("intent")).agg(
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.round(F.avg("processing_time_ms"), 2).alias("avg_ms"),
        F.round(F.max("processing_time_ms") / F.lit(3.0), 2).alias("max_third_ms"))


@register("load_templates")
def q_load_templates(spark, sf):
    """Every template row, with the number of tickets of its language and intent."""
    from ticketflow.operators.templates import load_templates
    seen = FX.tickets(spark, sf).groupBy(F.col("true_language").alias("language"), F.col("true_intent").alias("intent")).agg(
        F.count(F.lit(1)).alias("n"))
    return load_templates(spark).join(seen, ["language", "intent"], "left").select(
        "language", "intent", "variant", "subject", "body", F.coalesce("n", F.lit(0)).alias("n_tickets"))


# ---------------------------------------------------------------- quality of the enrichment

def _enriched_vs_labels(spark, sf):
    from ticketflow.plans.enrich import enrich_tickets
    return enrich_tickets(FX.tickets(spark, sf, with_customer=True))


@register("intent_eval")
def q_intent_eval(spark, sf):
    """Per-language intent accuracy / F1 of the enrichment vs the ticket labels."""
    from ticketflow.operators.evaluation import eval_per_language
    e = _enriched_vs_labels(spark, sf)
    preds = e.select(F.col("true_intent").alias("y_true"),
                     F.coalesce("primary_intent", F.lit("none")).alias("y_pred"),
                     F.col("true_language").alias("language"))
    return eval_per_language(preds)


@register("urgency_eval")
def q_urgency_eval(spark, sf):
    """Per-level urgency precision / recall / F1 of the enrichment vs the labels."""
    from ticketflow.operators.evaluation import eval_report
    e = _enriched_vs_labels(spark, sf)
    preds = e.select(F.col("true_urgency").alias("y_true"), F.col("urgency").alias("y_pred"),
                     F.col("true_language").alias("language"))
    return eval_report(preds)
