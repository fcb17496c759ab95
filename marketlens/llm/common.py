"""What the operators share: shared-folder tables, word rules, and column picking."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and \x09 to \x0D.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
SPACE_PATTERN = "[\\x20\\x09-\\x0D]+"
WHITE = " \u0009\u000a\u000b\u000c\u000d"
#: Lower-cases A-Z and turns every white-space byte into a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where a local session names none (tests), a temporary one is set; on a
    cluster that is an error, as executors would not see it."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="marketlens-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here, so a lost executor costs no recomputation.
    ``batch``: the most rows that Python workers get at once meanwhile, where rows are whole texts."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH)
    try:
        if batch:
            spark.conf.set(BATCH, str(min(batch, int(before)) if int(before) > 0 else batch))
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of whole texts that a Python worker gets at once.
TEXTS = 1000


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote and nobody reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = shared_dir(spark).split(":")[-1].strip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.search(f"(^|/){re.escape(root)}/[^/]+-[0-9a-f]{{32}}$", folder):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def crc_of_id_py(doc_id: int | None) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode())


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8."""
    return [] if not text else text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def small_batches(batches: Iterable[pa.RecordBatch], column: str, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices in which ``column`` takes about ``size`` bytes: bounds what a Python worker unpacks."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(1, batch.column(column).nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def gathered_batches(batches: Iterable[pa.RecordBatch], column: str, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches joined until ``column`` takes about ``size`` bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column(column).nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, name, k = {c.lower() for c in df.columns}, stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name
