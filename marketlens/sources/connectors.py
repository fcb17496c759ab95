"""Raw, Parquet, JSON and text sources, and sinks."""

from __future__ import annotations

import csv
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def raw_schema(columns: list[str]) -> T.StructType:
    """Every column a nullable string, so that casts can be audited."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def read_raw(spark: SparkSession, path: str, columns: list[str], multi_line: bool = False) -> DataFrame:
    """A CSV with header, quotes doubled by quotes, that fails on malformed rows."""
    options = {"header": True, "mode": "FAILFAST", "quote": '"', "escape": '"', "encoding": "UTF-8", "multiLine": multi_line}
    return spark.read.options(**options).schema(raw_schema(columns)).csv(path)


def write_frame(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_one_json(df: DataFrame, path: str) -> None:
    """A small table as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Nested columns as JSON text, dates in ISO form, decimals as floats."""
    from marketlens.functions.scalar import csv_safe

    df.select(*csv_safe(df)).write.mode("overwrite").option("header", True).csv(path)


def write_small_csv(df: DataFrame, path: str, most: int = 100_000) -> int:
    """A report table as one file on the driver that spreadsheet programs open (UTF-8 with its mark); its rows. More than
    ``most`` rows are an error: those belong to ``write_csv``."""
    from marketlens.functions.scalar import csv_safe, native

    rows = df.select(*csv_safe(df)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        out.writerows([native(v) for v in r] for r in rows)
    return len(rows)


def read_json(spark: SparkSession, path: str, schema: str, order: list[str] | None = None) -> DataFrame:
    """JSON lines as the columns of ``schema``, in the order given; fields beyond it are not read."""
    rows = spark.read.schema(schema).json(path)
    return rows.orderBy(*order) if order else rows


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of text files."""
    return spark.read.text(path)


def report(values: dict) -> str:
    """Sorted keys, non-ASCII kept, decimals as numbers, dates in ISO form, no numbers that JSON lacks."""
    from marketlens.functions.scalar import native

    return json.dumps(native(values), ensure_ascii=False, sort_keys=True, indent=2, default=str)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a written dataset has its success marker, on any file system."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def size_bytes(spark: SparkSession, path: str) -> int:
    """The length of all files below a path, on any file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def compare_files(local: DataFrame, stored: DataFrame) -> DataFrame:
    """(name, verdict) of two ``checksums``: same, differs, missing (not stored yet) or extra, by the files' names."""
    name = F.element_at(F.split("path", "/"), -1)
    a, b = local.select(name.alias("name"), F.col("sha256").alias("a")), stored.select(name.alias("name"), F.col("sha256").alias("b"))
    verdict = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") == F.col("b"), "same").otherwise("differs")
    return a.join(b, "name", "full_outer").select("name", verdict.alias("verdict"))


def load_checked(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copy the files below ``source`` that ``target`` lacks, compare checksums after, and return them. A file of the same
    name and other content is never overwritten: it is an error."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(target)
    there = to.getFileSystem(conf)
    there.mkdirs(to)
    old = checksums(spark, target) if there.getContentSummary(to).getFileCount() else spark.createDataFrame([], "path string, length long, sha256 string")
    plan = compare_files(checksums(spark, source), old)
    if wrong := [r["name"] for r in plan.where("verdict = 'differs'").collect()]:  # a raw load is a few files
        raise ValueError(f"{target} holds other content for {', '.join(sorted(wrong))}")
    missing = {r["name"] for r in plan.where("verdict = 'missing'").collect()}
    for r in checksums(spark, source).select("path").collect():
        if (name := r["path"].rsplit("/", 1)[-1]) in missing:
            src = jvm.org.apache.hadoop.fs.Path(r["path"])
            jvm.org.apache.hadoop.fs.FileUtil.copy(src.getFileSystem(conf), src, there, jvm.org.apache.hadoop.fs.Path(f"{target}/{name}"), False, conf)
    if not compare_files(checksums(spark, source), checksums(spark, target)).where("verdict in ('differs', 'missing')").isEmpty():
        raise ValueError(f"{target} does not hold what was copied")
    return checksums(spark, target)


def round_trip(df: DataFrame, path: str, column: str = "value") -> DataFrame:
    """Upper-cased non-blank lines, written and read again; ValueError unless both counts agree and are not zero."""
    clean = df.select(F.upper(F.trim(column)).alias(column)).where(F.col(column) != "").repartition(4)
    write_frame(clean, path)
    back = df.sparkSession.read.parquet(path)
    n, m = clean.count(), back.count()
    if n != m or not n:
        raise ValueError(f"wrote {n} rows, read {m}")
    return back
