"""Labelled-ticket reader (JSON array file or JSON lines), explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketflow.sources.json_array import read_json_array

TICKET_DDL = "text string, intent string, urgency string, language string"


def read_tickets(spark: SparkSession, path: str, multi_line: bool = True,
                 schema: str = TICKET_DDL) -> DataFrame:
    """``multi_line=True`` reads files holding one JSON array each (the sample
    format), a large one by many tasks; ``False`` reads JSON lines (the
    distributed format).  Malformed records of an array are left out; see
    ``malformed_tickets``."""
    if not multi_line:
        return spark.read.schema(schema).json(path)
    return read_json_array(spark, path, schema).where("malformed is null").drop("malformed")


def malformed_tickets(spark: SparkSession, path: str, schema: str = TICKET_DDL) -> DataFrame:
    """(malformed): the text of the records of array files that cannot be read."""
    return read_json_array(spark, path, schema).where("malformed is not null").select("malformed")
