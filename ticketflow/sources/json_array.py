"""One large JSON array file, read by many tasks.

Spark's JSON reader takes a file that holds one array as one document in one
task.  Here the file is read as text with ``}`` as the line end, which Spark
splits by byte ranges on any file system, and the pieces are put together
again with a scan that knows strings:

1. Per piece: does it change whether we are inside a string (an odd number of
   quotes that no backslash precedes), and how deep its brackets go, for both
   cases of its beginning.  Backslashes occur in strings only, and a piece
   begins after a ``}``, so neither needs the text before it.
2. Per byte range: the sums of those for both cases of its beginning, one row
   per range; running sums over these few rows say how every range begins.
3. A piece at whose end the depth is back at the array's level ends a record.
   Most records are one piece and are parsed where they are; those with a
   ``}`` in a string, with nested objects or across ranges are grouped by the
   place of their first piece and joined in order.

Every record is parsed on its own, so a malformed one does not take the file
with it; its text is kept in the column ``malformed``.  A record with an open
quote or bracket also takes the records after it until quotes and brackets
are even again: all of them are one malformed row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "}"
STRING = r'"(?:[^"\\]|\\.)*+"'                  # a whole string
REST = r'^(?:[^"\\]|\\.)*+"'                    # the rest of a string that began before
OPEN = r'"(?:[^"\\]|\\.)*+$'                    # a string that goes on after the piece
QUOTES = r'(?s)(?<!\\)(?:\\\\)*+"'              # a quote after an even number of backslashes


def _depth(text):
    """Opened minus closed brackets outside of strings."""
    bare = F.regexp_replace(F.regexp_replace(text, "(?s)" + STRING, ""), "(?s)" + OPEN, "")
    count = lambda chars: F.length(bare) - F.length(F.translate(bare, chars, ""))
    return count("[{") - count("]}")


def array_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value, odd, from_outside, from_inside): pieces and what they change,
    each with its line end (the last one of a file may not have it)."""
    raw = spark.read.option("lineSep", END).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value"))
    odd = F.regexp_count("value", F.lit(QUOTES)) % 2
    began_inside = F.when(F.regexp_count("value", F.lit("(?s)" + REST)) > 0, _depth(F.regexp_replace("value", "(?s)" + REST, "")))
    return raw.select(
        "file", "block", "at", "value", odd.alias("odd"),
        # the line end itself closes a bracket where the piece ends outside of a string
        (_depth(F.col("value")) - F.when(odd == 0, 1).otherwise(0)).alias("from_outside"),
        (F.coalesce(began_inside, F.lit(0)) - F.when(odd == 1, 1).otherwise(0)).alias("from_inside"))


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record): the text of every element of the arrays at ``path``."""
    pieces = array_pieces(spark, path)
    in_block = Window.partitionBy("file", "block").orderBy("at")
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    flip = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2      # inside, if the range began outside
    pieces = pieces.withColumn("flip", flip).withColumn(
        "if_out", F.when(F.col("flip") == 0, F.col("from_outside")).otherwise(F.col("from_inside"))).withColumn(
        "if_in", F.when(F.col("flip") == 0, F.col("from_inside")).otherwise(F.col("from_outside")))
    # one row per byte range, then running sums over these rows
    blocks = pieces.groupBy("file", "block").agg(
        (F.sum("odd") % 2).alias("odd"), F.sum("if_out").alias("if_out"), F.sum("if_in").alias("if_in"),
        F.min_by(F.regexp_extract("value", r"^[\s\x{FEFF}]*(\S)", 1), "at").alias("first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    blocks = blocks.withColumn("delta", F.when(F.col("inside") == 1, F.col("if_in")).otherwise(F.col("if_out")))
    whole = Window.partitionBy("file").orderBy("block")
    blocks = blocks.select("file", "block", "inside", F.coalesce(F.sum("delta").over(earlier), F.lit(0)).alias("depth"),
                           F.when(F.first("first").over(whole) == "[", F.lit(1)).otherwise(F.lit(0)).alias("level"),
                           F.lag("block").over(whole).isNull().alias("first_block"),
                           F.lead("block").over(whole).isNull().alias("last_block"))
    p = pieces.join(blocks, ["file", "block"])
    inside = F.col("inside") == 1
    p = p.withColumn("depth", F.col("depth") + F.sum(F.when(inside, F.col("if_in")).otherwise(F.col("if_out"))).over(in_block))
    outside_after = (F.col("inside") + F.col("flip") + F.col("odd")) % 2 == 0
    # an array does not end with the line end, so its last piece does not have it
    last = F.col("last_block") & (F.lead("at").over(in_block).isNull())
    p = p.withColumn("closed", ~last | ((F.col("level") == 0) & outside_after & (F.col("depth") >= 0)))
    p = p.withColumn("ends", (F.col("closed") & outside_after & (F.col("depth") <= F.col("level"))).cast("int"))
    p = p.withColumn("n", F.coalesce(F.sum("ends").over(before), F.lit(0))).withColumn(
        "value", F.when(F.col("closed"), F.concat("value", F.lit(END))).otherwise(F.col("value")))
    # what a range's first record began with: the last range before it in which a record ended
    ended = p.groupBy("file", "block").agg(F.sum("ends").alias("total"))
    carry = ended.select("file", "block", F.last(F.when(F.col("total") > 0, F.struct("block", "total")), ignorenulls=True)
                         .over(earlier).alias("carry"))
    p = p.join(carry, ["file", "block"])
    p = p.withColumn("start", F.when(F.col("n") > 0, F.struct(F.col("block"), F.col("n").alias("total"))).otherwise(
        F.coalesce("carry", F.struct(F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("total")))))
    begins = (F.lag("ends").over(in_block) == 1) | (F.col("first_block") & F.lag("at").over(in_block).isNull())
    single = (F.col("ends") == 1) & begins
    p = p.withColumn("single", F.coalesce(single, F.lit(False)))
    joined = p.where(~F.col("single")).groupBy("file", "start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "").alias("value"))
    texts = p.where("single").select("file", "value").unionByName(joined.select("file", "value"))
    # the array's own brackets and the commas between records
    record = F.regexp_replace(F.regexp_replace("value", r"^[\s,\[\x{FEFF}]+", ""), r"\s+$", "")
    return texts.select("file", record.alias("record")).where(~F.col("record").rlike(r"^[\s\]]*$"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The fields of ``schema`` and ``malformed``, the text of a record that is not a JSON object (else null)."""
    fields = T.StructType.fromDDL(schema)
    full = T.StructType([*fields.fields, T.StructField("malformed", T.StringType())])
    parsed = F.from_json("record", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"})
    return array_records(spark, path).select(parsed.alias("r")).select("r.*")
