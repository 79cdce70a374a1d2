"""Sinks: append once, publish by a pointer, provenance, manifests, freezes."""

from __future__ import annotations

import threading
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_creating = threading.Lock()  # local file systems test and create in two steps


class Log:
    """A numbered log of commits in path/log: entry n is one file that only one writer can create; what no entry names does not exist for readers."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.jvm = spark, path, spark.sparkContext._jvm
        self.dir = self.jvm.org.apache.hadoop.fs.Path(f"{path}/log")
        self.fs = self.dir.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def entries(self) -> dict[int, str]:
        """What the commits say, by number, without gaps; an entry that is still being written is not there yet."""
        if not self.fs.exists(self.dir):
            return {}
        names = sorted(int(f.getPath().getName()) for f in self.fs.listStatus(self.dir) if f.getPath().getName().isdigit())
        out = {}
        for n in names:
            text = self._read(n)
            if n != len(out) or not text.endswith("\n"):
                break
            out[n] = text[:-1]
        return out

    def _read(self, n: int) -> str:
        stream = self.fs.open(self.jvm.org.apache.hadoop.fs.Path(self.dir, f"{n:020d}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, n: int, text: str) -> bool:
        """Entry n, unless there is one: file systems refuse to create a file that exists."""
        try:
            with _creating:
                stream = self.fs.create(self.jvm.org.apache.hadoop.fs.Path(self.dir, f"{n:020d}"), False)
                try:
                    stream.write(bytearray(f"{text}\n".encode()))
                finally:
                    stream.close()
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception):
                return False
            raise


def append_snapshot(df: DataFrame, path: str, key: list[str]) -> int:
    """Append rows whose keys are new, in one commit; a key that is stored already, or twice in df, is an error and nothing is committed. Returns the rows stored.

    The rows are written to a folder of their own first. Then the commit takes
    the next number; if another writer has taken it, its rows are looked
    through as well and the next number is tried. So of two writers of one
    key one fails, and readers see all of a commit or nothing.
    """
    spark, log, own = df.sparkSession, Log(df.sparkSession, path), uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{own}")
    rows = spark.read.schema(df.schema).parquet(f"{path}/data/{own}")
    where = ", ".join(key)
    if not rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        raise ValueError(f"the snapshot repeats {where}")
    checked: set[str] = set()
    while True:
        entries = log.entries()
        if new := [x for x in entries.values() if x not in checked]:
            stored = spark.read.schema(df.schema).parquet(*[f"{path}/data/{x}" for x in new])
            on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
            if not rows.alias("a").join(stored.alias("b"), reduce(Column.__and__, on), "left_semi").isEmpty():
                raise ValueError(f"a snapshot with the same {where} exists")
            checked.update(new)
        if log.create(len(entries), own):
            return read_snapshots(spark, path).count()


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All committed rows."""
    return spark.read.parquet(*[f"{path}/data/{x}" for x in Log(spark, path).entries().values()])


def publish_current(df: DataFrame, path: str, passed: bool) -> str | None:
    """Write a new version beside the others and commit it as the current one; if the gate failed, the last good one stays. Returns the current version, None if there is none."""
    spark, log = df.sparkSession, Log(df.sparkSession, path)
    if not passed:
        return current_version(spark, path)
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/versions/{version}")
    while not log.create(len(log.entries()), version):
        pass  # another writer took the number; the next one is later than its version
    return version


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version of the last commit."""
    entries = Log(spark, path).entries()
    return entries[len(entries) - 1] if entries else None


def read_current(spark: SparkSession, path: str) -> DataFrame:
    version = current_version(spark, path)
    if version is None:
        raise ValueError("nothing has been published")
    return spark.read.parquet(f"{path}/versions/{version}")


def write_provenance(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("errorifexists").json(path)


def manifest(df: DataFrame, key: str, content: str) -> DataFrame:
    """Key and SHA-256 of each content."""
    return df.select(F.col(key).alias("name"), F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("sha256"))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and SHA-256 of files, read by Spark's binary source."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def verify_manifest(now: DataFrame, frozen: DataFrame) -> DataFrame:
    """Names that were added, removed or changed."""
    both = now.select("name", F.col("sha256").alias("now")).join(frozen.select("name", F.col("sha256").alias("frozen")), "name", "full")
    kind = F.when(F.col("frozen").isNull(), "ADDED").when(F.col("now").isNull(), "REMOVED").when(F.col("now") != F.col("frozen"), "CHANGED")
    return both.select("name", kind.alias("change")).where("change is not null")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that stands for all rows of df in any order: their number and the sum of their hashes."""
    h = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])), 1, 12), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("hash_sum"))  # a long overflows at about 65,000 rows


def check_freeze(df: DataFrame, frozen: DataFrame) -> DataFrame:
    """The fingerprint with whether it is still the frozen one."""
    now, old = fingerprint(df), frozen.select(F.col("n").alias("_n"), F.col("hash_sum").alias("_h"))
    return now.crossJoin(F.broadcast(old)).select("n", "hash_sum", ((F.col("n") == F.col("_n")) & (F.col("hash_sum") == F.col("_h"))).alias("unchanged"))
