"""Stage tables that are found again by content.

A stage has a folder with tables named by fingerprint and a manifest that is
put in its place last, whole. The fingerprint covers the rows of the inputs in
any order, their schemas, the parameters and the stage's version: equal content
is read, changed content is built anew, and what a lost job left half-written
has no manifest entry and is ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> str:
    """Digest of schema and rows, whatever their order; repeated rows count as often as they are there."""
    # columns in a fixed text form, so that nested types have one too
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}) if df.columns else F.lit("")
    halves = [F.xxhash64(row, F.lit(i)) for i in (1, 2)]
    exact = [F.sum(h.cast("decimal(20,0)")).cast("string") for h in halves]
    n, a, b = df.agg(F.count("*"), *exact).first()
    return hashlib.sha256(json.dumps([df.schema.jsonValue(), n, a, b]).encode()).hexdigest()


class _Files:
    """The few file operations of a manifest, through Hadoop so that any store will do."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Written beside and moved into place."""
        beside = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(beside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(name):
            self.fs.delete(self.path(name), False)
        if not self.fs.rename(self.path(beside), self.path(name)):
            raise OSError(f"{name} could not be put in place")


def manifest(spark: SparkSession, folder: str) -> dict[str, dict]:
    """Entries by stage name; a torn manifest counts as none."""
    try:
        found = json.loads(_Files(spark, folder).read("manifest.json") or "{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def stage(folder: str, name: str, inputs: Sequence[DataFrame], make: Callable[[], DataFrame], params: dict | None = None, version: int = 1) -> DataFrame:
    """``make()`` as a table of ``folder``, or the table that equal inputs, parameters and version have given before.

    The stage keeps one table; the one before it is deleted once the new one
    is in the manifest. One job at a time may build a stage.
    """
    spark = inputs[0].sparkSession if inputs else SparkSession.getActiveSession()
    files = _Files(spark, folder)
    key = hashlib.sha256(json.dumps([name, version, params or {}, [fingerprint(df) for df in inputs]], sort_keys=True).encode()).hexdigest()[:32]
    entry = manifest(spark, folder).get(name)
    if entry and entry.get("key") == key and files.exists(f"{entry['path']}/_SUCCESS"):
        return spark.read.schema(_schema(entry["schema"])).parquet(f"{files.folder}/{entry['path']}")
    path = f"{name}-{key}-{uuid.uuid4().hex[:8]}"
    made = make()
    made.write.option("compression", "zstd").parquet(f"{files.folder}/{path}")
    entries = manifest(spark, folder)
    old = entries.get(name)
    entries[name] = {"key": key, "path": path, "schema": made.schema.jsonValue(), "params": params or {}, "version": version}
    files.replace("manifest.json", json.dumps(entries, sort_keys=True))
    if old and old.get("path"):
        files.fs.delete(files.path(old["path"]), True)
    return spark.read.schema(made.schema).parquet(f"{files.folder}/{path}")


def _schema(value: dict):
    from pyspark.sql.types import StructType

    return StructType.fromJson(value)


def csv_once(spark: SparkSession, folder: str, name: str, path: str, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """A CSV file with a header, read by text once and kept as Parquet with its inferred types; columns are picked on reading.

    The lines of the file are the input: a changed file is read anew.
    """
    lines = spark.read.text(path)
    kept = stage(folder, name, [lines], lambda: spark.read.options(header=True, inferSchema=True, **options).csv(path), {"csv": options})
    return kept.select(*columns) if columns else kept
