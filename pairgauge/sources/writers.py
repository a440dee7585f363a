"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a single document may hold.
DOCUMENT_ROWS = 100_000


def _sorted(c: Column, kind: T.DataType) -> Column:
    """A value whose structs have their fields in order of name, at any depth."""
    if isinstance(kind, T.StructType):
        fields = [_sorted(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
        return F.transform(c, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return F.map_from_entries(F.array_sort(F.map_entries(c), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)))
    return c


def sort_keys(df: DataFrame) -> DataFrame:
    """Columns, struct fields and map keys in order of name, so that equal rows are equal JSON."""
    return df.select(*[_sorted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)])


def write_jsonl(df: DataFrame, path: str, sort: bool = False, mode: str = "overwrite") -> None:
    """One object a line, nulls kept out."""
    (sort_keys(df) if sort else df).write.mode(mode).json(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a log of JSON lines; each append is committed as a whole."""
    write_jsonl(df, path, mode="append")


def append_stream(df: DataFrame, path: str, checkpoint: str, **trigger):
    """Add a stream's rows to a log of JSON lines, each once."""
    return df.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def write_json_document(df: DataFrame, path: str, most: int = DOCUMENT_ROWS) -> None:
    """A small result as one document: {"rows": [...]}. More than ``most`` rows are an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows do not make one document")
    one = df.select(F.struct(*df.columns).alias("r")).agg(F.collect_list("r").alias("rows"))
    one.select(F.to_json(F.struct("rows")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    df.write.mode("overwrite").partitionBy(shard).json(path)


def write_files(files: DataFrame, folder: str, content: str = "raw") -> None:
    """Each row's text as the file ``folder/path``, written under another name and then moved, so that a
    task that is run again leaves whole files. ``folder`` is on a file system that pyarrow knows."""

    def run(rows) -> None:
        from pyarrow import fs

        where, top = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for path, text in rows:
            name = f"{top.rstrip('/')}/{path}"
            where.create_dir(name.rpartition("/")[0], recursive=True)
            with where.open_output_stream(f"{name}.part") as out:
                out.write((text or "").encode())
            where.move(f"{name}.part", name)

    files.select("path", content).foreachPartition(run)


def transform_files(files: DataFrame, change: Column, folder: str) -> None:
    """Files (path, raw) to files of the same paths with their text changed."""
    write_files(files.select("path", change.alias("raw")), folder)


def content_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, n_bytes, sha256) of the files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
