"""Part files as a Spark data source: a sink that commits all parts at once, and a source that reads and checks them.

A store is a folder with part files named after their content, the declared order of each part's complexes, and a manifest that
lists both with their hashes. ``write`` packs documents into parts within the tasks; nothing of a run can be seen until its
commit has moved the files and then replaced the manifest, and an abort leaves nothing behind. The manifest before stays
readable as ``previous``; files that neither of the two lists are removed.

``read`` has one partition per part, opens only parts of the wanted regions, and checks hash, frame, count, region and
declared order as it reads. What is wrong with a part is a row of its own, so a broken store is reported whole.

Files are reached through pyarrow's file systems: local and mounted folders, HDFS and object stores alike.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)

from hanok.functions.fixed_values import PART_MAX_BYTES, PART_PREFIX, PART_SUFFIX
from hanok.operators import guards
from hanok.session import scratch_scope, settled

FORMAT, MANIFEST, PREVIOUS = "hanok_parts", "manifest.json", "manifest.previous.json"
FRAME = len(PART_PREFIX.encode()) + len(PART_SUFFIX.encode()) + 2
SCHEMA = "file string, region string, ord bigint, id string, json string, problem string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Store:
    """The files below one folder."""

    def __init__(self, path: str):
        if path.startswith("file:"):
            path = "/" + path[len("file:") :].lstrip("/")
        self.fs, self.root = fs.FileSystem.from_uri(path)

    def at(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def read(self, name: str) -> bytes | None:
        if self.fs.get_file_info(self.at(name)).type != fs.FileType.File:
            return None
        with self.fs.open_input_stream(self.at(name)) as stream:
            return stream.read()

    def write(self, name: str, data: bytes) -> None:
        self.fs.create_dir(self.at(name).rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(self.at(name)) as stream:
            stream.write(data)

    def move(self, name: str, to: str) -> None:
        self.fs.create_dir(self.at(to).rsplit("/", 1)[0], recursive=True)
        self.fs.move(self.at(name), self.at(to))

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(self.at(folder), allow_not_found=True))
        return [f"{folder}/{f.base_name}" for f in found if f.type == fs.FileType.File]

    def manifest(self, which: str = "current") -> dict | None:
        data = self.read(MANIFEST if which == "current" else PREVIOUS)
        return None if data is None else json.loads(data)


@dataclass
class Written(WriterCommitMessage):
    """The parts of one task, as the manifest lists them."""

    folder: str
    parts: list[dict]


class PartWriter(DataSourceArrowWriter):
    def __init__(self, path: str, version: str, max_bytes: int):
        self.path, self.version, self.max_bytes = path, version, max_bytes
        self.run = f"_run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = Store(self.path), f"{self.run}/{uuid.uuid4().hex}"  # each attempt has its own
        parts: list[dict] = []
        region, pieces, order, size = None, [], [], FRAME

        def close() -> None:
            text = f"{PART_PREFIX}[{','.join(pieces)}]{PART_SUFFIX}".encode()
            listed = json.dumps(order, ensure_ascii=False, separators=(",", ":")).encode()
            sha, order_sha = hashlib.sha256(text).hexdigest(), hashlib.sha256(listed).hexdigest()
            part = {"file": f"regions/region-{sha[:12]}.js", "sha256": sha, "region": region, "count": len(pieces), "bytes": len(text), "first": order[0][0]}
            parts.append(part | {"order": f"orders/order-{order_sha[:12]}.json", "order_sha256": order_sha})
            store.write(f"{folder}/{parts[-1]['file']}", text)
            store.write(f"{folder}/{parts[-1]['order']}", listed)

        for batch in iterator:
            for row in batch.select(["region", "ord", "id", "json"]).to_pylist():
                grown = len(row["json"].encode()) + 1
                if FRAME + grown > self.max_bytes:
                    raise ValueError(f"complex {row['id']} alone exceeds a part: {FRAME + grown} of {self.max_bytes} bytes")
                if pieces and (row["region"] != region or size + grown > self.max_bytes):
                    close()
                    pieces, order, size = [], [], FRAME
                region = row["region"]
                pieces.append(row["json"])
                order.append([row["ord"], row["id"]])
                size += grown
        if pieces:
            close()
        return Written(folder, parts)

    def commit(self, messages: list[Written | None]) -> None:
        store = Store(self.path)
        done = [m for m in messages if m is not None]
        for message in done:
            for part in message.parts:
                for name in (part["file"], part["order"]):
                    store.move(f"{message.folder}/{name}", name)
        parts = sorted((p for m in done for p in m.parts), key=lambda p: (p["region"], p["first"]))
        before = store.read(MANIFEST)
        manifest = {"format": FORMAT, "version": self.version, "count": sum(p["count"] for p in parts), "parts": parts}
        store.write(f"{self.run}/{MANIFEST}", json.dumps(manifest, ensure_ascii=False).encode())
        if before is not None:
            store.write(f"{self.run}/{PREVIOUS}", before)
            store.move(f"{self.run}/{PREVIOUS}", PREVIOUS)
        store.move(f"{self.run}/{MANIFEST}", MANIFEST)  # from here on the new parts are what is read
        kept = parts + (json.loads(before)["parts"] if before else [])
        listed = {p[k] for p in kept for k in ("file", "order")}
        for name in [*store.names("regions"), *store.names("orders")]:
            if name not in listed:
                store.fs.delete_file(store.at(name))
        self._clear(store)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(Store(self.path))

    def _clear(self, store: Store) -> None:
        if store.fs.get_file_info(store.at(self.run)).type == fs.FileType.Directory:
            store.fs.delete_dir(store.at(self.run))


def checked(store: Store, part: dict) -> tuple[str | None, list[tuple[int, str, str]]]:
    """(what is wrong, [(ord, id, json)]) of one part."""
    data, listed = store.read(part["file"]), store.read(part["order"])
    if data is None or listed is None:
        return "missing", []
    if hashlib.sha256(data).hexdigest() != part["sha256"] or hashlib.sha256(listed).hexdigest() != part["order_sha256"]:
        return "hash", []
    text = data.decode()
    if not text.startswith(PART_PREFIX + "[") or not text.endswith("]" + PART_SUFFIX):
        return "frame", []
    at, last, found, decoder = len(PART_PREFIX) + 1, len(text) - len(PART_SUFFIX) - 1, [], json.JSONDecoder()
    try:
        while at < last:
            row, end = decoder.raw_decode(text, at)
            found.append((row, text[at:end]))
            at = end + 1
    except ValueError:
        return "frame", []
    if any(not isinstance(row, dict) for row, _ in found):
        return "frame", []
    order = json.loads(listed)
    if len(found) != part["count"]:
        return "count", []
    if any(row.get("region") != part["region"] for row, _ in found):
        return "region", []
    if [str(row.get("id")) for row, _ in found] != [str(i) for _, i in order]:
        return "order", []
    return None, [(ord_, str(i), piece) for (ord_, i), (_, piece) in zip(order, found, strict=True)]


class PartReader(DataSourceReader):
    def __init__(self, path: str, which: str, regions: list[str] | None):
        self.path, self.which, self.regions = path, which, regions

    def partitions(self) -> Sequence[InputPartition]:
        manifest = Store(self.path).manifest(self.which)
        if manifest is None:
            raise ValueError(f"no {self.which} manifest in {self.path}")
        return [InputPartition(p) for p in manifest["parts"] if self.regions is None or p["region"] in self.regions]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        part = partition.value
        problem, rows = checked(Store(self.path), part)
        if problem:
            yield part["file"], part["region"], None, None, None, problem
        for ord_, id_, piece in rows:
            yield part["file"], part["region"], ord_, id_, piece, None


class PushingReader(PartReader):
    """Takes equality and membership filters on the region."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("region",):
                wanted = [f.value]
            elif isinstance(f, In) and f.attribute == ("region",):
                wanted = list(f.value)
            else:
                yield f
                continue
            self.regions = wanted if self.regions is None else [r for r in self.regions if r in wanted]


class PartSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PartReader:
        regions = json.loads(self.options["regions"]) if "regions" in self.options else None
        kind = PushingReader if self.options.get("pushdown") == "true" else PartReader
        return kind(self.options["path"], self.options.get("which", "current"), regions)

    def writer(self, schema, overwrite: bool) -> PartWriter:
        return PartWriter(self.options["path"], self.options["version"], int(self.options.get("max_bytes", PART_MAX_BYTES)))


def write_store(documents: DataFrame, path: str, version: str, max_bytes: int = PART_MAX_BYTES) -> None:
    """All of ``documents(region, ord, id, json)`` as the store's next version, or nothing. A document that does not fit a part
    stops the write."""
    documents.sparkSession.dataSource.register(PartSource)
    ordered = documents.select("region", F.col("ord").cast("bigint").alias("ord"), F.col("id").cast("string").alias("id"), "json")
    with scratch_scope(documents.sparkSession):  # built once: the ranges are sampled from what was written
        ordered = settled(ordered, "documents").repartitionByRange("region", "ord").sortWithinPartitions("region", "ord")
        ordered.write.format(FORMAT).mode("append").option("version", version).option("max_bytes", max_bytes).save(path)


def read_store(spark: SparkSession, path: str, which: str = "current", regions: Sequence[str] | None = None) -> DataFrame:
    """(file, region, ord, id, json, problem). Only parts of ``regions`` are opened; where the session lets filters reach Python
    sources, equality filters on the region do the same."""
    spark.dataSource.register(PartSource)
    options = {"which": which, "pushdown": spark.conf.get(PUSHDOWN, "false")}
    if regions is not None:
        options["regions"] = json.dumps(list(regions), ensure_ascii=False)
    return spark.read.format(FORMAT).options(**options).load(path)


def load_store(spark: SparkSession, path: str, row_schema: str, which: str = "current", regions: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with ``file`` and ``ord``, what is wrong): each part by itself, then the count of the whole, ids and places in the
    declared order that occur twice."""
    with scratch_scope(spark) as made:  # opened once: the checks and the rows start from what was read
        found = settled(read_store(spark, path, which, regions), "parts-read")
        made.clear()
    good = found.filter("problem is null")
    manifest = Store(path).manifest(which)
    total = sum(p["count"] for p in manifest["parts"] if regions is None or p["region"] in regions)
    listed = spark.createDataFrame([(p["file"],) for p in manifest["parts"]], "file string")
    problems = guards.all_of(
        guards.violations(found.filter("problem is not null"), "part", F.lit(True), "file", F.col("problem")),
        guards.violations(good.agg(F.count("*").alias("n")), "complex_count", F.col("n") != total, F.lit("all"), F.col("n")),
        guards.duplicated(listed, ["file"], "part_listed_twice"),
        guards.duplicated(good, ["id"], "complex_id_twice"),
        guards.duplicated(good, ["ord"], "complex_order"),
    )
    return good.select("file", "ord", F.from_json("json", row_schema).alias("r")).select("file", "ord", "r.*"), problems
