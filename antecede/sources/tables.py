"""Readers and writers of event tables, record files, worksheets and graph documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from antecede.operators.urlset import url_cache

CORRUPT = "_corrupt"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An event table; ``year=`` and ``month=`` folders become prunable columns."""
    return spark.read.parquet(path)


def write_filtered(events: DataFrame, path: str) -> None:
    """Overwrite a Zstandard Parquet copy that keeps every column."""
    events.write.option("compression", "zstd").mode("overwrite").parquet(path)


def write_ordered(events: DataFrame, path: str, files: int | None = None) -> None:
    """Write in (day, id) order: ranges across files, sorted within each, so readers of a day
    skip the other files by their statistics."""
    order = ["day", "GlobalEventID"]
    spread = events.repartitionByRange(files, *order) if files else events.repartitionByRange(*order)
    spread.sortWithinPartitions(*order).write.option("compression", "zstd").mode("overwrite").parquet(path)


def read_records(spark: SparkSession, path: str, schema: StructType, key: str) -> tuple[DataFrame, DataFrame]:
    """JSON-lines records, and (line, rule) for lines that break the format: not an object of
    the schema, a non-finite number, an empty id, or an id used twice."""
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowNonNumericNumbers": "false"}
    rows = lines.select("value", F.from_json("value", full, options).alias("r")).select("value", "r.*")
    broken = F.col(CORRUPT).isNotNull() | ~F.trim("value").startswith("{")
    empty = ~broken & (F.coalesce(F.col(key).cast("string"), F.lit("")) == "")
    twice = rows.filter(~broken & ~empty).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(
        F.col(key).cast("string").alias("line"), F.lit("duplicate-id").alias("rule"))
    rules = F.when(broken, "invalid-json").when(empty, "empty-id")
    problems = rows.select(F.col("value").alias("line"), rules.alias("rule")).filter("rule IS NOT NULL")
    return rows.filter(~broken & ~empty).drop("value", CORRUPT), problems.unionByName(twice)


def write_records(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_worksheet(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).mode("overwrite").csv(path)


def read_worksheet(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Distinct codes of a text file: the first word of each line, comments left out."""
    word = F.split(F.trim("value"), r"[\s,]+")[0]
    return spark.read.text(path).filter((F.trim("value") != "") & ~F.trim("value").startswith("#")).select(
        F.upper(word).alias("code")).distinct()


def in_codes(events: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    return events.join(codes.withColumnRenamed("code", column), column, "left_semi")


def read_url_cache(spark: SparkSession, path: str) -> DataFrame:
    """(url, alive, status, reason) from a JSON object of URLs to results or, in old files, to
    bare booleans. Entries of any other shape are left out."""
    entry = "alive BOOLEAN, status INT, reason STRING"
    whole = spark.read.text(path, wholetext=True)
    pairs = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("url", "v"))
    parsed = pairs.select(
        "url", F.when(F.col("v").isin("true", "false"), F.col("v") == "true").alias("legacy"),
        F.from_json(F.when(F.col("v").startswith("{"), F.col("v")), entry).alias("e")).select("url", "legacy", "e.*")
    return url_cache(parsed)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and one-row version of a compiled graph document."""
    document = spark.read.json(path, multiLine=True)
    version = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("version"))
    return document.select(F.inline("nodes")), document.select(F.inline("edges")), version


def export_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return rows.select(F.to_json(F.struct("*")).alias("record"))
