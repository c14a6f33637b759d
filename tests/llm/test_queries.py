"""Registered queries against their SQL, and the pipeline stage by stage."""

import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_table_operators import plain_groups
from ticketflow.llm.oracle import SQL
from ticketflow.llm.pieces import ChunkTable, default_model
from ticketflow.llm.quality import quality_rules
from ticketflow.llm.queries import REGISTRY
from ticketflow.llm.secret_scan import RandomRules, default_ranks, find_spans, vocabulary
from tools.check_oracle import TABLES, digest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_all_are_registered():
    names = entry.queries()
    assert set(REGISTRY) | {"pipeline"} <= set(names)
    assert [n.split("_")[0] for n in REGISTRY] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    df = REGISTRY[name](spark, SF)
    con.execute(f"CREATE OR REPLACE VIEW oracle_query AS {SQL[name]}")
    cur = con.execute("SELECT * FROM oracle_query")
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[1] == digest(columns, cur.fetchall())[1]


def test_pipeline_stages(spark, tmp_path):
    # this table holds no secret of its own
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", F.when(
        F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" password=b7db7aa4a5fcc78305"))).otherwise(F.col("text")))
    before = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, before, SF).write.parquet(out)
        after = spark.read.parquet(out)
        if name != "encode":
            assert after.columns == corpus_pipeline.COLUMNS
        kept[name] = [r.asDict() for r in after.collect()]
        before = after
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in quality_rules(docs).where("quality.kept").collect()}
    assert {r["doc_id"] for r in kept["quality"]} == good and len(kept["quality"]) == len(good)

    rows = [(r["doc_id"], r["text"]) for r in kept["quality"]]
    first = {d for d, _, _, keep in plain_groups(rows, corpus_pipeline.SIMILAR_PERCENT) if keep}
    assert {r["doc_id"] for r in kept["near_dedup"]} == first and len(kept["near_dedup"]) == len(first)

    encoding = vocabulary(default_ranks())
    spans = {d: find_spans(given[d], RandomRules(), encoding) for d in first}
    assert any(spans.values()) and {r["doc_id"] for r in kept["secrets"]} == first
    for r in kept["secrets"]:
        assert (r["text"] == given[r["doc_id"]]) == (not spans[r["doc_id"]])
        assert not any(given[r["doc_id"]][s:e] in r["text"] for s, k, e in spans[r["doc_id"]] if k < 3)
        assert r["n_chars"] == len(r["text"])

    copies = {}
    for r in kept["mix"]:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert set(copies) <= first and max(copies.values()) <= 3
    words = {r["doc_id"]: len(r["text"].split()) for r in kept["secrets"]}
    assert abs(sum(words[d] * c for d, c in copies.items()) - sum(words.values())) <= 0.35 * sum(words.values())

    model = ChunkTable(default_model()).model
    texts = {r["doc_id"]: r["text"] for r in kept["mix"]}
    assert len(kept["encode"]) == len(kept["mix"])
    for r in kept["encode"]:
        assert list(r["ids"]) == model.encode(texts[r["doc_id"]]) + [model.eos_id()] and r["n_tokens"] == len(r["ids"])


def test_one_row_stays_of_repeated_and_null_ids(spark):
    text = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text), (3, other), (3, text + " x"), (None, "a b c d e f g"), (None, "a b c d e f g"),
            (4, None), (4, None), (5, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()), key=str)
    assert len(got) == len(set(got))
    assert {(1, text), (4, None), (5, None), (None, None), (None, "a b c d e f g")} <= set(got) and (2, text) not in got


def test_operators_ship_themselves(tmp_path):
    """A session started in another folder, without the repository on the workers' path."""
    code = f"""
import sys
sys.path.insert(0, {str(entry.__file__.rsplit('/', 1)[0])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
for name in ("op3_sentencepiece", "op8_secret_scan", "op11_token_counts", "op13_vector_codes"):
    assert e.queries()[name](spark, {SF!r}).count() > 0
print("done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("done"), out.stderr[-2000:]


def test_pipeline_runs_and_takes_an_empty_table(spark, tmp_path):
    empty = str(tmp_path / "empty")
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
