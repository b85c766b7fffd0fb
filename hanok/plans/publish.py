"""Versioned publishing: stage everything, check the staged tables, then move one pointer."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanok.operators import guards


class Folder:
    """The few file operations publishing needs, on whatever file system the root is."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self.path("").getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        p = self.path(name)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write beside the target, then rename over it."""
        temporary, target = self.path(f".{name}.tmp"), self.path(name)
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(context.makeQualified(temporary), context.makeQualified(target), options)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def remove(self, name: str) -> None:
        self._fs.delete(self.path(name), True)


POINTER = "current.json"


def fingerprint(df: DataFrame, table: str, by: str | None = None) -> DataFrame:
    """Row count and an order-free content mark of a table, per ``by``: hash sum and hash parity.

    Sums of row hashes combine on the map side, so no list of hashes is ever built.
    """
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    group = F.col(by).cast("string") if by else F.lit("all")
    return df.groupBy(group.alias("part")).agg(
        F.count("*").alias("rows"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor(row).alias("hash_xor")
    ).select(F.lit(table).alias("table"), "part", "rows", "hash_sum", "hash_xor")


def publish_tables(df: DataFrame, path: str, by: str, order: tuple[str, ...], max_records: int = 2_000_000) -> None:
    """Partitioned, sorted files of bounded size. Range partitioning on (by, order) also splits a region that holds
    most of the rows."""
    df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).write.mode("overwrite").option(
        "maxRecordsPerFile", max_records
    ).partitionBy(by).parquet(path)


def publish_snapshot(
    spark: SparkSession,
    root: str,
    version: str,
    tables: Mapping[str, tuple[DataFrame, str, tuple[str, ...]]],
    checks: Callable[[dict[str, DataFrame]], list[DataFrame]] = lambda staged: [],
) -> dict:
    """All or nothing. ``tables`` maps a name to (rows, partition column, sort columns).

    Tables are written to a new version folder and read back; checks and the manifest run on what was written. Only
    then the pointer moves; the version before stays, older ones go. On any error the pointer is untouched.
    """
    folder = Folder(spark, root)
    pointer = json.loads(folder.read(POINTER) or "{}")
    if version in (pointer.get("current"), pointer.get("previous")):
        raise ValueError(f"version {version} exists already")
    base = f"{folder.root}/versions/{version}"
    staged: dict[str, DataFrame] = {}
    manifest = None
    try:
        for name, (rows, by, order) in tables.items():
            publish_tables(rows, f"{base}/{name}", by, order)
            staged[name] = spark.read.parquet(f"{base}/{name}")
            marks = fingerprint(staged[name], name, by)
            manifest = marks if manifest is None else manifest.unionByName(marks)
        found = checks(staged)
        if found:
            guards.enforce(*found)
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest")  # one row per table and region
    except Exception:
        folder.remove(f"versions/{version}")
        raise
    moved = {"current": version, "previous": pointer.get("current"), "partitions": {n: t[1] for n, t in tables.items()}}
    folder.replace(POINTER, json.dumps(moved, ensure_ascii=False))
    for old in folder.names("versions"):
        if old not in (moved["current"], moved["previous"]):
            folder.remove(f"versions/{old}")
    return moved


def load_snapshot(spark: SparkSession, root: str, which: str = "current", verify: bool = True) -> dict[str, DataFrame]:
    """Tables of the current or previous version; changed, missing or extra rows stop the load."""
    pointer = json.loads(Folder(spark, root).read(POINTER) or "{}")
    version = pointer.get(which)
    if not version:
        raise guards.GuardError(f"no {which} snapshot")
    base = f"{root.rstrip('/')}/versions/{version}"
    tables = {name: spark.read.parquet(f"{base}/{name}") for name in pointer["partitions"]}
    if verify:
        stored = spark.read.parquet(f"{base}/manifest")
        seen = _stack([fingerprint(df, name, pointer["partitions"][name]) for name, df in tables.items()])
        key = ["table", "part"]
        a = stored.select(*key, F.struct("rows", "hash_sum", "hash_xor").alias("_a"))
        b = seen.select(*key, F.struct("rows", "hash_sum", "hash_xor").alias("_b"))
        joined = a.join(b, key, "full_outer")
        guards.enforce(guards.violations(joined, "snapshot_changed", ~F.col("_a").eqNullSafe(F.col("_b")), F.concat_ws("/", *key)))
    return tables


def _stack(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
