"""Relevance judgments ("qrels"): text lines ``qid 0 doc_id rel [task_id]``.

Lines split on any run of whitespace; a line needs at least four fields; the
fifth (task) is optional and defaults to "0"; extra fields are ignored. Only
rel > 0 makes a judgment, but every well-formed line sets the query's task,
and for a query seen twice the later line wins. Spark has no file order, so a
``line_no`` column travels with each line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
DEFAULT_TASK = "0"
MIN_FIELDS = 4
BLANKS = r"(?U)[\s\x1c-\x1f]+"     # all that separates fields: Unicode white space and the four separators


def read_qrels_text(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) from a judgment file or folder of files; a missing path raises.

    ``line_no`` sorts like the lines: by file, by the block of the file that a
    task reads, and by the place in the block.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(place.alias("line_no"), "value")


def _fields(value: str = "value"):
    return F.split(F.trim(F.regexp_replace(F.col(value), BLANKS, " ")), " ")


def tokenize(lines: DataFrame) -> DataFrame:
    """(line_no, value, parts, n_fields); blank lines have 0 fields."""
    parts = _fields()
    return lines.select("line_no", "value", parts.alias("parts")).withColumn(
        "n_fields", F.when(F.col("parts")[0] == "", F.lit(0)).otherwise(F.size("parts")))


def parse_qrels(lines: DataFrame) -> DataFrame:
    """Well-formed lines: (line_no, qid, doc_id, rel, task_id). A non-integer rel raises (ANSI cast)."""
    t = tokenize(lines).where(F.col("n_fields") >= MIN_FIELDS)
    return t.select(
        "line_no",
        F.col("parts")[0].alias("qid"),
        F.col("parts")[2].alias("doc_id"),
        F.col("parts")[3].cast("int").alias("rel"),
        F.coalesce(F.get(F.col("parts"), 4), F.lit(DEFAULT_TASK)).alias("task_id"),
    )


def qrels_rejects(lines: DataFrame) -> DataFrame:
    """Malformed lines (fewer than four fields), kept aside instead of printed."""
    return tokenize(lines).where(F.col("n_fields") < MIN_FIELDS).select("line_no", "value", "n_fields")


def positive_judgments(parsed: DataFrame) -> DataFrame:
    """(qid, doc_id) with rel > 0, duplicates collapsed (set semantics)."""
    return parsed.where(F.col("rel") > 0).select("qid", "doc_id").distinct()


def task_map(parsed: DataFrame) -> DataFrame:
    """(qid, task_id): the task of the last line of each query (partial max_by)."""
    return parsed.groupBy("qid").agg(F.max_by("task_id", "line_no").alias("task_id"))


def qrel_sets(parsed: DataFrame) -> DataFrame:
    """(qid, doc_ids sorted, n_docs) for queries with at least one positive judgment."""
    return (positive_judgments(parsed).groupBy("qid")
            .agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"), F.count(F.lit(1)).alias("n_docs")))


def generate_identity_qrels(records: DataFrame, id_col: str = "id", split_col: str | None = None,
                            task_id: int = 0) -> DataFrame:
    """Identity judgments ``id 0 id 1 task`` for every record (doc = query, rel 1)."""
    i = F.col(id_col).cast("string")
    value = F.concat_ws(" ", i, F.lit("0"), i, F.lit("1"), F.lit(str(task_id))).alias("value")
    cols = [F.col(split_col).alias("split")] if split_col else []
    return records.select(*cols, F.col(id_col).alias("id"), value)


def write_qrels(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One text file set per split (partition column ``split``).

    With a ``line_no`` the lines of a task keep that order in their file: lines
    of one query must arrive in one partition for "the last line wins" to hold.
    """
    if "line_no" in lines.columns:
        lines = lines.sortWithinPartitions("split", "line_no")
    lines.select("split", "value").write.mode(mode).partitionBy("split").text(path)
