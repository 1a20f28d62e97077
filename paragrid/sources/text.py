"""Text tables as paragraphs, sentences and segments; markdown tables as glossaries; pattern lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paragrid.functions.text import sentences


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, idx, text of each line; the order key idx begins at 0."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("idx", "text"))


def sentence_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(sentences(F.col(text))).alias("idx", "text"))


def paragraph_records(spark: SparkSession, path: str) -> DataFrame:
    """Paragraph records, one JSON array per file, with the declared schema; doc is the file's path."""
    from paragrid.sources.schemas import PARAGRAPH

    return spark.read.schema(PARAGRAPH).option("multiLine", True).json(path).withColumn("doc", F.input_file_name())


def markdown_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, line, cells of each row of the markdown tables in a folder, without delimiter rows; \\| is a literal bar."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    rows = lines.where(F.col("value").rlike(r"^\s*\|")).where(~F.col("value").rlike(r"^\s*\|[\s:|-]+\|?\s*$"))
    body = F.regexp_replace(F.trim("value"), r"^\||(?<!\\)\|$", "")
    return rows.select("file", (F.col("line") + 1).alias("line"), F.transform(F.split(body, r"(?<!\\)\|"), lambda c: F.trim(F.regexp_replace(c, r"\\\|", "|"))).alias("cells"))


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """file, line, term, rendering, notes: the table rows with two cells or more."""
    rows = markdown_rows(spark, path).where(F.size("cells") >= 2)
    return rows.select("file", "line", F.col("cells")[0].alias("term"), F.col("cells")[1].alias("rendering"), F.try_element_at("cells", F.lit(3)).alias("notes"))


def table_faults(spark: SparkSession, path: str) -> DataFrame:
    """file, table, line, fault of markdown tables: no delimiter row, a lone row, or a width that differs from the header's."""
    from pyspark.sql import Window

    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    at = Window.partitionBy("file").orderBy("line")
    marked = lines.withColumn("bar", F.col("value").rlike(r"^\s*\|"))
    grouped = marked.withColumn("table", F.sum(F.when(F.col("bar") & ~F.coalesce(F.lag("bar").over(at), F.lit(False)), 1).otherwise(0)).over(at)).where("bar")
    body = F.regexp_replace(F.trim("value"), r"^\||(?<!\\)\|$", "")
    in_table = Window.partitionBy("file", "table").orderBy("line")
    rows = grouped.select("file", "table", (F.col("line") + 1).alias("line"), F.size(F.split(body, r"(?<!\\)\|")).alias("width"), F.col("value").rlike(r"^\s*\|[\s:|-]+\|?\s*$").alias("delimiter"), F.row_number().over(in_table).alias("at"), F.count("*").over(Window.partitionBy("file", "table")).alias("rows"), F.first(F.size(F.split(body, r"(?<!\\)\|"))).over(in_table).alias("head"))
    fault = F.when(F.col("rows") == 1, "lone row").when((F.col("at") == 2) & ~F.col("delimiter"), "no delimiter").when(F.col("width") != F.col("head"), "width")
    return rows.select("file", "table", "line", fault.alias("fault")).where("fault is not null")


def pattern_list(spark: SparkSession, path: str) -> DataFrame:
    """pattern of each line that is neither blank nor a comment."""
    return spark.read.text(path).select(F.trim("value").alias("pattern")).where(~F.col("pattern").rlike("^(#|$)"))
