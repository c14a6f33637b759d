"""JSON array files in several byte ranges against the multi-line reader."""

import json
import random

import pytest

from ticketflow.sources.json_array import array_pieces
from ticketflow.sources.tickets import TICKET_DDL, malformed_tickets, read_tickets

HARD = ["plain", "a } brace", 'quote " and \\ slash', '\\"}', "}{][,", "line\nbreak", "ünï 日本 🙂", "", "\\\\", '"}, {"text": "x"', "tab\t", "[", "]"]


def whole(spark, path, schema=TICKET_DDL):
    return spark.read.schema(schema).option("multiLine", True).json(path)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0",
            "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("indent, ascii_only", [(None, True), (2, False)])
def test_one_file_in_many_ranges_equals_the_multi_line_reader(spark, tmp_path, small_ranges, indent, ascii_only):
    rnd = random.Random(7)
    rows = [{"text": " ".join(rnd.choice(HARD) for _ in range(rnd.randint(0, 12))), "intent": rnd.choice(HARD),
             "urgency": rnd.choice([None, "low"]), "language": "en"} for _ in range(400)]
    path = str(tmp_path / "tickets.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, indent=indent, ensure_ascii=ascii_only)
    got = read_tickets(spark, path)
    assert array_pieces(spark, path).select("block").distinct().count() > 20
    assert sorted(str(r.asDict()) for r in got.collect()) == sorted(str(r) for r in rows)
    assert same(got, whole(spark, path)) and malformed_tickets(spark, path).count() == 0


def test_nested_fields_and_several_files(spark, tmp_path, small_ranges):
    schema = "text string, meta struct<a:int,b:array<struct<c:string>>>"
    rnd = random.Random(8)
    for k in range(3):
        rows = [{"text": rnd.choice(HARD), "meta": {"a": i, "b": [{"c": rnd.choice(HARD)} for _ in range(rnd.randint(0, 3))]}}
                for i in range(60)]
        (tmp_path / f"{k}.json").write_text("\n " + json.dumps(rows) + "\n\n")
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "nothing.json").write_text("")
    got = read_tickets(spark, str(tmp_path), schema=schema)
    assert got.count() == 180 and same(got, whole(spark, str(tmp_path), schema))


def test_malformed_records_are_kept_apart(spark, tmp_path):
    path = tmp_path / "bad.json"
    path.write_text('[{"text": "a"}, {"text": oops}, {"text": "b", }, {"text": "c"}, 17, {"text": "d"}]')
    assert sorted(r.text for r in read_tickets(spark, str(path)).collect()) == ["a", "c"]
    assert [r.malformed for r in malformed_tickets(spark, str(path)).orderBy("malformed").collect()] == [
        '17, {"text": "d"}', '{"text": "b", }', '{"text": oops}']


def test_a_record_larger_than_a_range(spark, tmp_path, small_ranges):
    rows = [{"text": "}" * 5000 + '"' * 9, "intent": "x", "urgency": None, "language": None}, {"text": "y" * 3000}, {"text": "z"}]
    path = tmp_path / "large.json"
    path.write_text(json.dumps(rows))
    assert same(read_tickets(spark, str(path)), whole(spark, str(path)))


def test_one_object_instead_of_an_array(spark, tmp_path):
    path = tmp_path / "one.json"
    path.write_text(json.dumps({"text": "}", "intent": "x"}))
    assert same(read_tickets(spark, str(path)), whole(spark, str(path)))
