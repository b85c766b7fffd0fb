"""WARC archives written and read by Spark, with boundary-chain verification.

**Writing.** A record's end, two line ends, is the line separator of Spark's own text writer, so each task writes one archive
file through the commit protocol of any file system. Of pages with equal payloads of at least ``REVISIT`` bytes the one with
the largest id is written whole, the others as ``revisit`` records without payload that name it and its digest.

**Reading.** Files are read in splits, cut at the magic that opens a record; a payload may hold the magic too, so these
pieces are only candidates.

1. Of each candidate a task keeps its offset and the successor's offset, by its Content-Length.
2. Within a split, pointers are jumped to the first offset beyond the split. The candidates that such a pointer or the file's
   start hits are few; among them pointers are doubled by joins from the file's start, in rounds logarithmic in the number of
   splits of a file. A file's chain enters a split once at most, and from its entry a task marks the split's records.
3. A file all of whose candidates are reached has whole records for pieces. Of any other file the pieces from a reached
   record to the next are put together again; magic inside a payload is never reached, whatever record it feigns.

No task holds more than the offsets of one split, or one record. Nothing but counts reaches the driver.

Defined cases: a null text is an empty payload; ids, addresses and digests travel in headers; an
address that a header can't carry is percent-encoded there and exact in a header of its own, a null one has none; a null id loses against any id and repeats
of the largest id are all written whole; repeated rows are records of their own; extra columns play no part; an empty table is
an archive without records. A file that doesn't begin with a record has none, and a cut or overlong last record is not one. A
record must fit in 2^31 bytes, the most that one Spark value holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from hanok.llm.tables import staged
from hanok.session import scratch_path

#: Fixed by the format.
MAGIC, LINE, BLANK = "WARC/1.0\r\n", "\r\n", "\r\n\r\n"
EXACT = "X-Target-Base64"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Least payload that is written once only.
REVISIT = 1000
DATE = "2000-01-01T00:00:00Z"


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(LINE))).otherwise("")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def revisits(pages: DataFrame, least: int = REVISIT) -> DataFrame:
    """(_wa_id, _wa_sha, _wa_to): the rows, by id and digest, whose payload another row with a larger id carries."""
    rows = pages.select("page_id", F.coalesce(F.col("html"), F.lit("")).alias("html")).filter(F.octet_length("html") >= least)
    rows = staged(rows.select(F.col("page_id").alias("_wa_id"), F.sha1(F.col("html")).alias("_wa_sha")), "warc-digests")
    kept = rows.groupBy("_wa_sha").agg(F.max("_wa_id").alias("_wa_to"), F.count("*").alias("_wa_n")).filter("_wa_n > 1").drop("_wa_n")
    return rows.join(kept, "_wa_sha").filter(~F.col("_wa_id").eqNullSafe(F.col("_wa_to"))).select("_wa_id", "_wa_sha", "_wa_to").distinct()


def records(pages: DataFrame, least: int = REVISIT, date: str = DATE) -> DataFrame:
    """(record): one WARC record per row of ``pages(page_id, url, html)``, without its closing line ends."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload).alias("sha"))
    again = staged(revisits(pages, least), "warc-revisits")
    rows = rows.join(again, rows["page_id"].eqNullSafe(again["_wa_id"]) & (rows["sha"] == again["_wa_sha"]), "left")
    short, plain = F.col("_wa_to").isNotNull(), F.col("url").rlike(r"^[\x21-\x7E]+$")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.octet_length("html").cast("string"), F.lit(BLANK))
    block = F.when(short, http).otherwise(F.concat(http, F.col("html")))
    head = [
        F.lit(MAGIC),
        _header("WARC-Type", F.when(short, "revisit").otherwise("response")),
        _header("WARC-Record-ID", _record_id(F.col("page_id"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.when(plain, F.col("url")).otherwise(F.url_encode("url"))),
        _header(EXACT, F.when(~plain, F.base64(F.encode("url", "UTF-8")))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha"))),
        _header("WARC-Profile", F.when(short, PROFILE)),
        _header("WARC-Refers-To", F.when(short, _record_id(F.col("_wa_to")))),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length("block").cast("string")),
        F.lit(LINE),
        F.col("block"),
    ]
    return rows.withColumn("block", block).select(F.concat(*head).alias("record"))


def write(pages: DataFrame, path: str, least: int = REVISIT) -> None:
    """An archive folder of one file per task."""
    records(pages, least).write.option("lineSep", BLANK).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, seq, piece): what lies between the magics of each file, in the order of seq within a split."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("piece"))


def _offsets(found: DataFrame) -> DataFrame:
    """(file, split, seq, bytes, need, base, end): of each piece its size and that of the whole record it declares (null:
    none), of its split the offset of the first piece and that after the last."""
    head = F.substring_index("piece", BLANK, 1)
    size = F.octet_length("piece").cast("bigint")
    length = F.expr("try_cast(regexp_extract(_head, '(?i)(?:^|\\\\n)Content-Length:[ \\\\t]*([0-9]+)[ \\\\t]*(?:\\\\r|$)', 1) AS bigint)")
    need = F.when(F.octet_length("_head") < F.col("bytes"), F.octet_length("_head") + 2 * len(BLANK) + length)
    rows = found.select("file", "split", "seq", size.alias("bytes"), head.alias("_head")).select("file", "split", "seq", "bytes", need.alias("need"))
    rows = staged(rows, "warc-candidates")
    sizes = rows.groupBy("file", "split").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("size"))
    before = sizes.alias("x").join(sizes.alias("y"), F.expr("x.file = y.file AND y.split < x.split"), "left")  # a file's splits are few
    bases = before.groupBy("x.file", "x.split", "x.size").agg(F.coalesce(F.sum("y.size"), F.lit(0)).alias("base"))
    return rows.join(bases.select("file", "split", "base", (F.col("base") + F.col("size")).alias("end")), ["file", "split"])


def _chain(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(order, offset, successor, place of the successor or -1) of a split's candidates by offset; -1: no record there."""
    order = np.argsort(table["seq"].to_numpy(), kind="stable")
    size = table["bytes"].to_numpy()[order] + len(MAGIC)
    need = table["need"].fill_null(-1).to_numpy()[order]
    starts = np.cumsum(size) - size + table["base"][0].as_py()
    offset = starts - len(MAGIC)  # where the magic stands; the first piece of a file has none
    after = np.where((need < 0) | (offset < 0), -1, starts + need)
    place = np.searchsorted(offset, after)
    hit = offset[np.minimum(place, len(offset) - 1)] == after
    return order, offset, after, np.where(hit, place, -1)


def _exits(table: pa.Table) -> pa.Table:
    """(file, split, off, exit): where the chain from each candidate leaves its split; null: it breaks in it."""
    _, offset, after, place = _chain(table)
    last = np.where(place >= 0, place, np.arange(len(place)))
    while (last != last[last]).any():
        last = last[last]
    real, out = offset >= 0, after[last]
    keys = {k: table[k].take(pa.array(np.flatnonzero(real))) for k in ("file", "split")}
    return pa.table({**keys, "off": offset[real], "exit": pa.array(out[real], mask=out[real] < table["end"][0].as_py() - len(MAGIC))})


def _marks(table: pa.Table) -> pa.Table:
    """(file, split, seq, off, head, owner, stop): whether a record begins at a candidate; the last record of the split that
    begins no later, and where that ends."""
    order, offset, after, place = _chain(table)
    entry, size = table["entry"][0].as_py(), table["size"][0].as_py()
    beyond = table["end"][0].as_py() - len(MAGIC)
    head = np.zeros(len(order), bool)
    at = int(np.searchsorted(offset, entry)) if entry is not None else -1
    while at >= 0:
        head[at] = place[at] >= 0 or beyond <= after[at] <= size  # else it is cut, overlong, or no record
        at = int(place[at])
    own = np.maximum.accumulate(np.where(head, np.arange(len(head)), -1))
    none = own < 0
    marks = {"seq": table["seq"].take(pa.array(order)), "off": offset, "head": head, "owner": pa.array(offset[own], mask=none), "stop": pa.array(after[own], mask=none)}
    return pa.table({"file": table["file"], "split": table["split"], **marks})


MARKS = "file string, split bigint, seq bigint, off bigint, head boolean, owner bigint, stop bigint"


def candidates(found: DataFrame) -> DataFrame:
    """The marks of all pieces of ``found(file, split, seq, piece)``, of which :func:`_marks` tells the columns."""
    rows = staged(_offsets(found), "warc-offsets")
    exits = staged(rows.groupBy("file", "split").applyInArrow(_exits, "file string, split bigint, off bigint, exit bigint"), "warc-exits")
    targets = exits.select("file", F.col("exit").alias("off")).filter("off is not null").distinct()
    first = exits.select("file").distinct().withColumn("off", F.lit(0).cast(LongType()))
    nodes = exits.join(targets.unionByName(first).distinct(), ["file", "off"], "left_semi")
    nodes = staged(nodes, "warc-nodes")
    jump = nodes.filter("exit is not null").select("file", "off", F.col("exit").alias("to"))
    jump = staged(jump.join(nodes.select("file", F.col("off").alias("to")), ["file", "to"], "left_semi").select("file", "off", "to"), "warc-jumps")
    reached = nodes.filter("off = 0").select("file", "off")
    while not jump.isEmpty():  # all that lie 2^k pointers on, for k = 0, 1, ...
        further = reached.join(jump, ["file", "off"]).select("file", F.col("to").alias("off"))
        reached = staged(reached.unionByName(further).distinct(), "warc-reached")
        second = jump.select("file", F.col("off").alias("to"), F.col("to").alias("_next"))
        jump = staged(jump.join(second, ["file", "to"]).select("file", "off", F.col("_next").alias("to")), "warc-jumps")
    entries = nodes.join(reached, ["file", "off"], "left_semi").groupBy("file", "split").agg(F.min("off").alias("entry"))
    whole = rows.groupBy("file").agg((F.max("end") - len(MAGIC)).alias("size"))
    marked = rows.join(entries, ["file", "split"], "left").join(whole, "file")
    return marked.groupBy("file", "split").applyInArrow(_marks, MARKS)


def _joined(parts: DataFrame, marks: DataFrame) -> DataFrame:
    """(piece): the records of files in which not every magic begins one; ``parts`` as staged for ``marks``."""
    last = marks.groupBy("file", "split").agg(F.max(F.struct("owner", "stop")).alias("last")).filter("last.owner is not null")
    open_ = marks.select("file", "split").distinct().alias("x").join(last.alias("y"), F.expr("x.file = y.file AND y.split < x.split"))
    carried = open_.groupBy("x.file", "x.split").agg(F.max("y.last").alias("_from"))
    owned = marks.join(carried, ["file", "split"], "left")
    owned = owned.select("file", "split", "seq", "off", F.coalesce("owner", "_from.owner").alias("owner"), F.coalesce("stop", "_from.stop").alias("stop"))
    rows = parts.join(owned.filter("off < stop"), ["file", "split", "seq"])
    whole = rows.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("off", "piece"))).alias("list"))
    return whole.select(F.array_join("list.piece", MAGIC).alias("piece"))


def records_of(spark: SparkSession, path: str) -> DataFrame:
    """(piece): the archive's records from the first header line on, with the closing line ends."""
    found = pieces(spark, path)
    marks = candidates(found).filter("off >= 0")
    files = staged(marks.groupBy("file").agg(F.bool_and("head").alias("plain"), F.bool_or("head").alias("some")), "warc-files")
    whole = found.join(files.filter("plain"), "file", "left_semi").filter(F.octet_length("piece") > 0).select("piece")
    mixed = files.filter("some and not plain")
    if mixed.isEmpty():
        return whole
    # one scan of these files, kept: the numbers of their pieces must not change between marking and joining
    parts = staged(found.join(mixed, "file", "left_semi"), "warc-pieces")
    return whole.unionByName(_joined(parts, staged(candidates(parts), "warc-marks")))


def _field(name: str, head: str = "head") -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?i)(?:^|\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, intact), one row per record.

    Size and digest are those of the full payload: of a response they are taken from its bytes, of a revisit, whose payload is
    null, from its headers. intact: a response's bytes have the digest that its header states.
    """
    rows = records_of(spark, path).select(F.substring_index("piece", BLANK, 1).alias("head"), F.col("piece").cast("binary").alias("bytes"))
    rest = F.substring("bytes", F.octet_length("head") + len(BLANK) + 1, F.octet_length("bytes") - F.octet_length("head") - 2 * len(BLANK))
    rows = rows.select("head", rest.alias("block")).withColumn("http", F.substring_index(F.col("block").cast("string"), BLANK, 1))
    body = F.substring("block", F.octet_length("http") + len(BLANK) + 1, F.octet_length("block"))
    number = lambda name: F.regexp_extract(_field(name), r"<urn:page:(-?[0-9]+)>", 1).try_cast("bigint")
    response = F.col("record_type") == "response"
    rows = rows.withColumn("record_type", _field("WARC-Type")).select("*", F.when(response, body).alias("payload"))
    stated = F.regexp_extract(_field("WARC-Payload-Digest"), "sha1:([0-9a-f]{40})", 1)
    exact = F.decode(F.unbase64(_field(EXACT)), "UTF-8")
    digest = F.when(response, F.sha1("payload")).otherwise(stated)
    return rows.select(
        number("WARC-Record-ID").alias("page_id"),
        F.coalesce(exact, F.when(F.col("head").contains(f"{EXACT}:"), "").otherwise(_field("WARC-Target-URI"))).alias("url"),
        "record_type",
        number("WARC-Refers-To").alias("refers_to"),
        F.when(response, F.octet_length("payload")).otherwise(_field("Content-Length", "http").try_cast("int")).cast("bigint").alias("payload_bytes"),
        digest.alias("payload_digest"),
        "payload",
        (digest == stated).alias("intact"),
    )
