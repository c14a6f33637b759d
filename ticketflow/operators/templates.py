"""Reply templates: load, select with fallback, render.

Templates are configuration files (``<lang>/<intent>.yaml`` plus
``base.yaml``), parsed on the driver into a small dimension table.  Its size
is bounded by the number of files, which is why it may be broadcast.

Selection per ticket, variant = ``high_urgency`` for high/critical urgency
else ``default``:
(lang, intent, variant) -> (lang, intent, default) -> (en, intent, variant)
-> (en, intent, default) -> base variant -> base default.
The first two steps are pre-resolved inside the dimension, so a ticket needs
two broadcast equi-joins plus a literal for the base.  Subject and body
always come from the same template row (joined as one struct).

Rendering replaces ``{customer_name}`` and ``{ticket_id}`` (defaults
"Valued Customer" and "N/A", also for empty strings).  A field holding any
other ``{slot}`` is returned unrendered.  Fields are compiled once, in the
dimension, to ``printf`` formats (``%`` escaped), so values are inserted
verbatim.
"""

from __future__ import annotations

import os
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketflow import config as C

DEFAULT_TEMPLATE_DIR = os.path.join(os.path.dirname(os.path.dirname(__file__)), "resources", "templates")
BASE = "*"
TEMPLATE_SCHEMA = "language string, intent string, variant string, subject string, body string"
SLOT_NAMES = ["customer_name", "ticket_id"]


def read_template_files(template_dir: str = DEFAULT_TEMPLATE_DIR) -> list[tuple]:
    """(language, intent, variant, subject, body); base rows use language = intent = '*'.

    One pass over ``base.yaml`` and ``*/*.yaml``.  A file maps variants to
    letters, under its own name or at the top; anything that is not a letter
    is passed over, and a missing directory gives no rows.
    """
    root = Path(template_dir)
    found = [(BASE, BASE, "fallback", root / "base.yaml")] if (root / "base.yaml").is_file() else []
    found += [(f.parent.name, f.stem, f.stem, f) for f in sorted(root.glob("*/*.yaml"))]
    rows = []
    for language, intent, name, file in found:
        content = yaml.safe_load(file.read_text(encoding="utf-8")) or {}
        letters = content.get(name, {} if language == BASE else content) or {}
        rows += [(language, intent, variant, letter.get("subject"), letter.get("body"))
                 for variant, letter in letters.items() if isinstance(letter, dict)]
    return rows


def load_templates(spark: SparkSession, template_dir: str = DEFAULT_TEMPLATE_DIR) -> DataFrame:
    return spark.createDataFrame(read_template_files(template_dir), TEMPLATE_SCHEMA)


def list_templates(templates: DataFrame) -> DataFrame:
    """Intents per language (sorted), base rows excluded."""
    return templates.filter(F.col("language") != BASE).groupBy("language").agg(
        F.array_sort(F.collect_set("intent")).alias("intents"))


def _compile(field: Column) -> Column:
    """printf format for a template field, or null when it holds an unknown slot."""
    stripped = field
    for s in SLOT_NAMES:
        stripped = F.replace(stripped, F.lit("{" + s + "}"), F.lit(""))
    unknown = stripped.rlike(r"\{[^{}]*\}")
    fmt = F.replace(field, F.lit("%"), F.lit("%%"))
    for i, s in enumerate(SLOT_NAMES, start=1):
        fmt = F.replace(fmt, F.lit("{" + s + "}"), F.lit(f"%{i}$s"))
    return F.when(unknown, F.lit(None).cast("string")).otherwise(fmt)


def _tmpl_struct(prefix: str = "") -> Column:
    s, b = F.col(prefix + "subject"), F.col(prefix + "body")
    return F.struct(s.alias("subject"), b.alias("body"),
                    _compile(s).alias("subject_fmt"), _compile(b).alias("body_fmt"))


def resolve_template_rows(rows: list[tuple]) -> list[tuple]:
    """(language, intent, variant, subject, body) with the variant -> default
    step applied, for both variants.  Runs on the parsed template files (a
    configuration-sized list), so no join is needed for it."""
    table: dict = {}
    for lang, intent, variant, subject, body in rows:
        if lang == BASE:
            continue
        table.setdefault((lang, intent), {})[variant] = (subject, body)
    out = []
    for (lang, intent), variants in sorted(table.items()):
        for v in (C.DEFAULT_VARIANT, C.HIGH_URGENCY_VARIANT):
            t = variants.get(v)
            if not t or (t[0] is None and t[1] is None):
                t = variants.get(C.DEFAULT_VARIANT)
            if t and (t[0] is not None or t[1] is not None):
                out.append((lang, intent, v, t[0], t[1]))
    return out


def template_rows(templates) -> list[tuple]:
    """Rows of a template set given as parsed rows or as the small DataFrame."""
    if isinstance(templates, DataFrame):
        return [tuple(r) for r in templates.collect()]
    return [tuple(r) for r in templates]


def resolved_templates(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(language, intent, variant, tmpl) with variant -> default already applied."""
    df = spark.createDataFrame(resolve_template_rows(rows), TEMPLATE_SCHEMA)
    return df.select("language", "intent", "variant", _tmpl_struct().alias("tmpl"))


def variant_for(urgency) -> Column:
    u = F.col(urgency) if isinstance(urgency, str) else urgency
    return F.when(u.isin("high", "critical"), F.lit(C.HIGH_URGENCY_VARIANT)).otherwise(F.lit(C.DEFAULT_VARIANT))


def select_template(df: DataFrame, templates: DataFrame, intent_col: str = "primary_intent",
                    language_col: str = "language", urgency_col: str = "urgency",
                    fallback_language: str = "en") -> DataFrame:
    """Adds ``template`` struct(subject, body, subject_fmt, body_fmt) and
    ``template_source`` (language / fallback / base); null when nothing fits.

    ``templates`` is the parsed template rows (``read_template_files``) or
    the small DataFrame from ``load_templates``; either way it is bounded by
    the template files.
    """
    rows = template_rows(templates)
    res = resolved_templates(df.sparkSession, rows)
    own = F.broadcast(res.select(
        F.col("language").alias("_l1"), F.col("intent").alias("_i1"),
        F.col("variant").alias("_v1"), F.col("tmpl").alias("_t1")))
    en = F.broadcast(res.filter(F.col("language") == fallback_language).select(
        F.col("intent").alias("_i2"), F.col("variant").alias("_v2"), F.col("tmpl").alias("_t2")))
    base_rows = {r[2]: {"subject": r[3], "body": r[4]} for r in rows if r[0] == BASE}
    base_default = base_rows.get(C.DEFAULT_VARIANT)

    def base_lit(row):
        if row is None:
            return F.lit(None)
        sub = F.lit(row["subject"]).cast("string")
        body = F.lit(row["body"]).cast("string")
        return F.struct(sub.alias("subject"), body.alias("body"),
                        _compile(sub).alias("subject_fmt"), _compile(body).alias("body_fmt"))

    base_for = F.when(F.col("_v") == C.HIGH_URGENCY_VARIANT,
                      base_lit(base_rows.get(C.HIGH_URGENCY_VARIANT, base_default))) \
        .otherwise(base_lit(base_default))
    x = df.withColumn("_v", variant_for(urgency_col))
    x = x.join(own, (F.col(language_col) == F.col("_l1")) & (F.col(intent_col) == F.col("_i1"))
               & (F.col("_v") == F.col("_v1")), "left")
    x = x.join(en, (F.col(intent_col) == F.col("_i2")) & (F.col("_v") == F.col("_v2")), "left")
    src = F.when(F.col("_t1").isNotNull(), F.lit("language")) \
        .when(F.col("_t2").isNotNull(), F.lit("fallback")) \
        .when(base_for.isNotNull(), F.lit("base"))
    return x.withColumn("template", F.coalesce("_t1", "_t2", base_for)) \
        .withColumn("template_source", src) \
        .drop("_v", "_l1", "_i1", "_v1", "_t1", "_i2", "_v2", "_t2")


def render_reply(template, customer_name, ticket_id) -> Column:
    """struct(subject, body) rendered from a selected template; null if none."""
    t = F.col(template) if isinstance(template, str) else template
    name = F.coalesce(F.nullif(_c(customer_name), F.lit("")), F.lit(C.DEFAULT_CUSTOMER_NAME))
    tid = F.coalesce(F.nullif(_c(ticket_id), F.lit("")), F.lit(C.DEFAULT_TICKET_ID))

    def render(field):
        fmt = t[field + "_fmt"]
        return F.when(fmt.isNull(), t[field]).otherwise(F.printf(fmt, name, tid))

    return F.when(t.isNull(), F.lit(None)).otherwise(
        F.struct(render("subject").alias("subject"), render("body").alias("body")))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x
