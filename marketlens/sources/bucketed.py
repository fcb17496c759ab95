"""A stored table in buckets of a key: what changed is written anew, and readers see one version or the next."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that a task writes, about.
TASK_ROWS = 1_000_000


@dataclass(frozen=True)
class Version:
    """A state of the table: its number, the number of buckets, the folder that holds each bucket's files (named by the number
    of the version that wrote it and a random part), and the columns."""

    number: int
    buckets: int
    held: dict[int, str]
    schema: StructType

    def text(self) -> str:
        return json.dumps({"number": self.number, "buckets": self.buckets, "held": {str(b): v for b, v in sorted(self.held.items())}, "schema": self.schema.jsonValue()})

    @classmethod
    def parsed(cls, text: str) -> Version:
        at = json.loads(text)
        return cls(at["number"], at["buckets"], {int(b): v for b, v in at["held"].items()}, StructType.fromJson(at["schema"]))


@dataclass(frozen=True)
class BucketTable:
    """Rows under ``path`` in ``buckets`` buckets by a hash of the column ``key``.

    A version is a manifest, ``manifests/<number>.json``, that names the folder of every bucket's files; files that a manifest
    names are never changed. A writer renames its manifest into place last: a reader has the state before or after, and of two
    writers that began from the same version the second gets an error and its files stay unnamed. The manifest grows with
    the number of buckets, not with the rows. A table keeps the number of buckets that it began with.
    """

    spark: SparkSession
    path: str
    key: str
    buckets: int = 64

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The numbers of all versions, ascending."""
        folder, files = self._at("manifests")
        if not files.exists(folder):
            return []
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version | None:
        """The version of that number, or the newest; None where nothing is stored."""
        if number is None and not (known := self.numbers()):
            return None
        path, files = self._at(f"manifests/{known[-1] if number is None else number}.json")
        stream = files.open(path)
        try:
            return Version.parsed(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def bucket_of(self, buckets: int, key: str | None = None) -> Column:
        """A row's bucket: the first 32 bits of its key's MD5 modulo the number of buckets; rows without a key are in bucket 0."""
        head = F.conv(F.substring(F.md5(F.col(key or self.key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
        return F.coalesce(F.pmod(head, F.lit(buckets)), F.lit(0)).cast("int")

    def read(self, version: Version | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The rows of a version (the newest by default), of some buckets where given; None where nothing is stored."""
        version = version or self.version()
        if version is None:
            return None
        held = [(b, v) for b, v in sorted(version.held.items()) if only is None or b in set(only)]
        paths = [f"{self.path.rstrip('/')}/data/{v}/bucket={b}" for b, v in held]
        reader = self.spark.read.schema(version.schema).option("recursiveFileLookup", True)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], version.schema)

    def replace(self, rows: DataFrame, touched: list[int] | None, base: Version | None) -> Version:
        """Store ``rows`` as the whole content of the ``touched`` buckets (None: of all), leaving the others' files alone, and
        name the new version. ``base`` is the version that the rows were made from. Rows of other buckets are an error; a
        touched bucket without rows ends up empty. A bucket is written by as many tasks as its rows ask for."""
        number, buckets = (base.number + 1 if base else 1), base.buckets if base else self.buckets
        if base is None and touched is not None:
            raise ValueError("the first version writes all buckets")
        if base is not None and touched is not None:
            if dict(rows.dtypes) != {f.name: f.dataType.simpleString() for f in base.schema.fields}:
                raise ValueError("other columns need all buckets written")
            rows = rows.select(*[F.col(f"`{c}`") for c in base.schema.names])
        name = f"{number}-{uuid.uuid4().hex[:12]}"
        target = f"{self.path.rstrip('/')}/data/{name}"
        placed = rows.withColumn("bucket", self.bucket_of(buckets))
        written = placed.repartition("bucket", F.pmod(F.xxhash64(self.key), F.lit(self._spread(base)))).write.mode("errorifexists")
        written.option("maxRecordsPerFile", TASK_ROWS).partitionBy("bucket").parquet(target)
        folder, files = self._at(f"data/{name}")
        got = {int(f.getPath().getName().split("=")[1]) for f in files.listStatus(folder) if f.isDirectory() and f.getPath().getName().startswith("bucket=")}
        if touched is not None and (stray := got - set(touched)):
            raise ValueError(f"rows of buckets that are not written: {sorted(stray)[:5]}")
        kept = {b: v for b, v in base.held.items() if b not in set(touched)} if base and touched is not None else {}
        made = Version(number, buckets, kept | dict.fromkeys(got, name), rows.schema)
        self._name(made)
        return made

    def _spread(self, base: Version | None) -> int:
        """Tasks a bucket, by the rows that the last version's files hold; more than one only where buckets are large."""
        if base is None or not base.held:
            return 1
        return max(1, -(-self.read(base).count() // (len(base.held) * TASK_ROWS)))  # counts come from the files' footers

    def _name(self, made: Version) -> None:
        """Write the manifest beside its place and rename it into it; an error where another writer was first."""
        temporary, files = self._at(f"manifests/.{made.number}.{self.spark.sparkContext.applicationId}.tmp")
        place, _ = self._at(f"manifests/{made.number}.json")
        stream = files.create(temporary, True)
        try:
            stream.write(made.text().encode())
        finally:
            stream.close()
        try:
            first = not files.exists(place) and files.rename(temporary, place)
        except CapturedException:
            first = False
        if not first:
            files.delete(temporary, False)
            raise ValueError(f"another writer has made version {made.number}")

    def vacuum(self, keep: int = 1) -> list[int]:
        """Delete manifests older than the last ``keep``, and bucket folders of versions up to the newest that no manifest left
        names, those of writers that came too late among them; the numbers of the deleted versions."""
        if keep < 1:
            raise ValueError("at least one version stays")
        known = self.numbers()
        old, left = known[:-keep], known[-keep:]
        named = {(name, b) for n in left for b, name in self.version(n).held.items()}
        for n in old:
            path, files = self._at(f"manifests/{n}.json")
            files.delete(path, False)
        root, files = self._at("data")
        for folder in files.listStatus(root) if left else ():
            name = folder.getPath().getName()
            if int(name.split("-")[0]) > left[-1]:
                continue  # of a writer at work
            if not any(held == name for held, _ in named):
                files.delete(folder.getPath(), True)
                continue
            for f in files.listStatus(folder.getPath()):
                part = f.getPath().getName()
                if part.startswith("bucket=") and (name, int(part.split("=")[1])) not in named:
                    files.delete(f.getPath(), True)
        return old
