"""Streaming operators, run to completion over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hanok.functions.months import ym_of_date
from hanok.registry import query
from hanok.session import scratch_path
from hanok.streaming import cancellations as cn
from hanok.streaming import trades as tr


def _stream(star, name):
    return star.spark.readStream.schema(star.table(name).schema).parquet(f"{star.folder}/{name}.parquet*")


@query("streamed_months", "T1 D5", """SELECT strftime(l_shipdate, '%Y-%m') AS ym, count(*) AS n, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS total FROM lineitem GROUP BY 1""")
def streamed_months(star):
    path, arrived = scratch_path(star.spark, "stream-months"), scratch_path(star.spark, "stream-responses")
    # the stored table already holds rows of an earlier run for every month; the responses of the new run replace them
    old = star.table("orders").select(F.col("o_custkey").alias("complex_id"), F.floor("o_totalprice").cast("bigint").alias("price"), F.lit("1").alias("run"), F.lit("").alias("response"), ym_of_date("o_orderdate").alias("ym"))
    old.repartition("ym").write.partitionBy("ym").parquet(path)
    # six responses, two to a batch: every month is spread over all batches
    star.table("lineitem").repartition(6, "l_orderkey").write.parquet(arrived)
    stream = star.spark.readStream.schema(star.table("lineitem").schema).option("maxFilesPerTrigger", 2).parquet(arrived)

    def prepare(batch):
        return batch.select(
            F.col("l_suppkey").alias("complex_id"), F.floor("l_extendedprice").cast("bigint").alias("price"),
            F.lit("2").alias("run"), "response", ym_of_date("l_shipdate").alias("ym"),
        )

    named = stream.select("*", F.col("_metadata.file_name").alias("response"))
    tr.replace_months(named, path, scratch_path(star.spark, "cp"), prepare).awaitTermination()
    stored = star.spark.read.schema("complex_id bigint, price bigint, run string, response string, ym string").parquet(path)
    return stored.groupBy("ym").agg(F.count("*").alias("n"), F.sum("price").alias("total"))


@query("streamed_coverage", "T2 G3", """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def streamed_coverage(star):
    path = scratch_path(star.spark, "stream-coverage")
    counts = tr.coverage_counts(_stream(star, "events"), "ts", "event_type", delay="60 days")
    tr.write_updates(counts, path, scratch_path(star.spark, "cp")).awaitTermination()
    written = tr.latest(star.spark.read.option("basePath", path).parquet(path), ["window_start", "event_type"])
    return written.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", F.col("rows").alias("n"))


@query("streamed_cancellations", "T3", """SELECT l_suppkey AS complex_id, strftime(l_shipdate, '%Y-%m-%d') AS date, count(*) FILTER (l_returnflag <> 'R') AS disclosed, count(*) FILTER (l_returnflag = 'R') AS cancelled,
  greatest(0, count(*) FILTER (l_returnflag <> 'R') - count(*) FILTER (l_returnflag = 'R')) AS active FROM lineitem GROUP BY 1, 2""")
def streamed_cancellations(star):
    path = scratch_path(star.spark, "stream-cancel")
    rows = _stream(star, "lineitem").select(F.col("l_suppkey").alias("complex_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), (F.col("l_returnflag") == "R").alias("cancelled"))
    key = ["complex_id", "date"]
    tr.write_updates(tr.active_trades(rows, key), path, scratch_path(star.spark, "cp")).awaitTermination()
    return tr.latest(star.spark.read.option("basePath", path).parquet(path), key)


@query("paired_cancellations", "T3", """SELECT l_suppkey AS complex_id, count(*) FILTER (l_returnflag <> 'R') AS disclosed, count(*) FILTER (l_returnflag = 'R') AS cancelled,
  greatest(0, count(*) FILTER (l_returnflag <> 'R') - count(*) FILTER (l_returnflag = 'R')) AS active FROM lineitem GROUP BY 1""")
def paired_cancellations(star):
    """Kept as state that timers end; the delay spans the whole table, as its rows arrive in no order of time."""
    path = scratch_path(star.spark, "stream-paired")
    rows = _stream(star, "lineitem").select(F.col("l_suppkey").alias("complex_id"), "l_shipdate", (F.col("l_returnflag") == "R").alias("cancelled"))
    changes = cn.paired(rows, ["complex_id"], "l_shipdate", delay="9000 days")
    cn.write_changes(changes, path, scratch_path(star.spark, "cp")).awaitTermination()
    return cn.totals(star.spark.read.option("basePath", path).parquet(path), ["complex_id"])
