"""Readers: all lazy, all by Spark's own readers, so any file system will do."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def xml_files(spark: SparkSession, folder: str, glob: str = "*.dita", revision: str | None = None) -> DataFrame:
    """(path relative to folder, raw, n_bytes[, revision]); bytes that are no UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    top = folder.rstrip("/").split("://")[-1].lstrip("/") + "/"
    path = F.element_at(F.split("path", f"\\Q{top}\\E", 2), -1)
    raw = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.make_valid_utf8(F.col("content").cast("string")))
    out = files.select(path.alias("path"), raw.alias("raw"), F.col("length").alias("n_bytes"))
    return out.withColumn("revision", F.lit(revision)) if revision else out


def jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """One object a line; blank lines are passed over."""
    return spark.read.schema(schema).json(path)


def documents_with_rows(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows of JSON documents that are a list, or an object with the list under ``rows``."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    bare = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.rows"))
    return whole.select("file", F.inline(F.from_json(bare, f"array<struct<{schema}>>")))


def block_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, fr) from blocks headed ``### <id>``; the last block of an id counts."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.concat(F.lit("\n"), "value").alias("v"))
    parts = whole.select("file", F.posexplode(F.split("v", r"\n### ")).alias("pos", "block")).filter("pos > 0")
    rows = parts.select(
        "file", "pos", X.strip(F.regexp_extract("block", r"\A([^\n]*)", 1)).alias("id"), X.strip(F.regexp_replace("block", r"\A[^\n]*\n?", "")).alias("fr")
    )
    return rows.groupBy("id").agg(F.max_by("fr", F.struct("file", "pos")).alias("fr"))


def shards(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Rows of all files of a pattern, with the file and the split that its name begins with."""
    rows = spark.read.schema(schema).json(glob).withColumn("file", F.col("_metadata.file_path"))
    return rows.withColumn("split", X.split_label(F.col("file")))


def first_existing(variable: str, *paths: str, environment: Mapping[str, str] | None = None) -> str | None:
    """The path that a variable names, or else the first that exists on the driver."""
    named = (os.environ if environment is None else environment).get(variable)
    return next((p for p in (named, *paths) if p and os.path.exists(p)), None)
