import datetime

import pytest
from pyspark.sql import functions as F

from hanok.streaming import cancellations as cn

SCHEMA = "trade string, at timestamp, cancelled boolean"


@pytest.fixture
def feed(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(rows):
        """One more file, read by a query that starts again from its checkpoint."""
        day = datetime.datetime(2025, 1, 1)
        made = [(t, day + datetime.timedelta(days=d), c) for t, d, c in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = cn.write_changes(cn.paired(stream, ["trade"], "at", delay="10 days"), out, str(tmp_path / "cp"))
        query.awaitTermination()
        state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        found = cn.totals(spark.read.option("basePath", out).parquet(out), ["trade"]).collect()
        return {r.trade: (r.disclosed, r.cancelled, r.active) for r in found}, state

    return run


def test_cancellations_meet_their_trades_and_state_ends(feed, spark):
    got, _ = feed([("a", 0, False), ("b", 0, True), ("c", 0, False), ("c", 0, False), ("d", 0, False), ("d", 0, True)])
    assert got == {"a": (1, 0, 1), "b": (0, 1, 0), "c": (2, 0, 2), "d": (1, 1, 0)}
    got, _ = feed([("a", 3, True), ("b", 4, False), ("c", 4, True)])  # cancel after, cancel before, one of two copies
    assert got == {"a": (1, 1, 0), "b": (1, 1, 0), "c": (2, 1, 1), "d": (1, 1, 0)}
    got, _ = feed([("z", 60, False)])  # time goes on past the delay
    got, _ = feed([("c", 5, True), ("y", 61, False)])  # too late for c
    assert got["c"] == (2, 1, 1) and got["z"] == (1, 0, 1) and got["y"] == (1, 0, 1)
    got, state = feed([("c", 62, False)])  # forgotten, and goes on from where it was
    assert got["c"] == (3, 1, 2)
    assert state and state[-1] <= 12  # z, y and c with their timers; nothing of the first days


def test_settings_of_the_session_stay(spark, feed):
    before = spark.conf.get(cn.PROVIDER, None)
    feed([("a", 0, False)])
    assert spark.conf.get(cn.PROVIDER, None) == before
    assert F is not None
