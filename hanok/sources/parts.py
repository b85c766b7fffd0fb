"""Published parts: rows of complexes wrapped in a script line, listed with hash and count in a manifest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanok.functions.fixed_values import PART_MAX_BYTES, PART_PREFIX, PART_SUFFIX
from hanok.operators import guards
from hanok.session import scratch_scope, settled


def part_files(spark: SparkSession, path: str) -> DataFrame:
    """Part files as bytes with their SHA-256; ``file`` is the folder that names the part."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    return raw.select(
        F.regexp_extract("path", r"file=([^/]+)/[^/]+$", 1).alias("file"), "length",
        F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"),
    )


def parse_parts(files: DataFrame, row_schema: str) -> DataFrame:
    """Rows of each part; ``rows`` is null where the frame around them or the JSON is not as expected."""
    framed = F.startswith("text", F.lit(PART_PREFIX)) & F.endswith("text", F.lit(PART_SUFFIX))
    body = F.substr("text", F.lit(len(PART_PREFIX) + 1), F.length("text") - F.lit(len(PART_PREFIX) + len(PART_SUFFIX)))
    return files.withColumn("rows", F.when(framed, F.from_json(body, f"array<{row_schema}>")))


def load_parts(spark: SparkSession, path: str, manifest: DataFrame, total: int, row_schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of all parts and everything that is wrong with them.

    ``manifest(file, sha256, region, count)``. Checked: listed once, present, hash, frame, count, a single region per
    part, total count, unique ids.
    """
    parsed = parse_parts(part_files(spark, path), row_schema).drop("text")
    told = parsed.select("file", F.col("sha256").alias("_sha"), F.size("rows").alias("_n"), F.array_distinct(F.transform("rows", lambda r: r["region"])).alias("_regions"), "rows")
    with scratch_scope(spark) as made:  # opened and parsed once: the checks and the rows start from what was read
        found = settled(told.select("file", "_sha", "_n", "_regions", F.posexplode_outer("rows").alias("_at", "r")), "parts-read")
        made.clear()
    files = found.filter("_at is null or _at = 0").select("file", "_sha", "_n", "_regions")
    joined = manifest.join(files, "file", "left")
    other = F.exists("_regions", lambda r: ~r.eqNullSafe(F.col("region")))
    detail = (
        F.when(F.col("_sha").isNull(), "missing").when(F.col("_sha") != F.col("sha256"), "hash")
        .when(F.col("_regions").isNull(), "frame").when(F.col("_n") != F.col("count"), "count").when(other, "region")
    )
    bad = guards.violations(joined.withColumn("_d", detail), "part", F.col("_d").isNotNull(), "file", F.col("_d"))
    # the listing is small beside the parts, which stay where they are
    rows = found.filter("_at is not null").join(F.broadcast(manifest.select("file")), "file").select("file", "r.*")
    counted = rows.agg(F.count("*").alias("n"))
    problems = guards.all_of(
        guards.duplicated(manifest, ["file"], "part_listed_twice"),
        bad,
        guards.violations(counted, "complex_count", F.col("n") != total, F.lit("all"), F.col("n")),
        guards.duplicated(rows, ["id"], "complex_id_twice"),
    )
    return rows, problems


def pack_parts(documents: DataFrame, max_bytes: int = PART_MAX_BYTES) -> DataFrame:
    """Documents ``(region, ord, json)`` packed into part texts of at most ``max_bytes``: one region per part.

    The documents are range-partitioned by (region, ord); each task walks through its sorted share and holds no more
    than the part it is filling. Parts come out as ``(file, region, sha256, count, bytes, text)``.
    """
    frame = len(PART_PREFIX.encode()) + len(PART_SUFFIX.encode()) + 2

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, pieces, size = None, [], frame

        def part():
            text = PART_PREFIX + "[" + ",".join(pieces) + "]" + PART_SUFFIX
            data = text.encode()
            digest = hashlib.sha256(data).hexdigest()
            row = {"file": f"region-{digest[:12]}", "region": region, "sha256": digest, "count": len(pieces), "bytes": len(data), "text": text[:-1]}
            return pa.RecordBatch.from_pylist([row], columns)

        for batch in batches:
            regions, texts = batch.column("region"), batch.column("json")
            for i in range(batch.num_rows):  # one document at a time is a Python text
                r, piece = regions[i].as_py(), texts[i].as_py()
                grown = len(piece.encode()) + 1
                if frame + grown > max_bytes:
                    raise ValueError(f"a complex of {r} alone exceeds a part: {frame + grown} of {max_bytes} bytes")
                if pieces and (r != region or size + grown > max_bytes):
                    yield part()
                    pieces, size = [], frame
                region = r
                pieces.append(piece)
                size += grown
        if pieces:
            yield part()

    schema = "file string, region string, sha256 string, count bigint, bytes bigint, text string"
    columns = pa.schema([(name, pa.int64() if kind == "bigint" else pa.string()) for name, kind in (c.split(" ") for c in schema.split(", "))])
    # built once: the ranges are sampled from what was written
    ordered = settled(documents, "documents").repartitionByRange("region", "ord").sortWithinPartitions("region", "ord")
    return ordered.select("region", "json").mapInArrow(pack, schema)


def escape_script(json_text):
    """JSON that cannot end a script element."""
    c = F.col(json_text) if isinstance(json_text, str) else json_text
    for ch, code in (("<", "\\u003c"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        c = F.replace(c, F.lit(ch), F.lit(code))
    return c


def oversized(sizes: DataFrame, max_bytes: int = PART_MAX_BYTES) -> DataFrame:
    """Complexes whose own document would not fit a part: known from sizes, before any document is built."""
    return guards.violations(sizes, "complex_too_large", F.col("bytes") + 200 > max_bytes, "complex_id", F.col("bytes"))


def write_parts(parts: DataFrame, path: str) -> None:
    """One file per part in a folder named after it (the writer's line end is the last character of the frame)."""
    parts.select("file", "text").write.mode("overwrite").partitionBy("file").text(path)
