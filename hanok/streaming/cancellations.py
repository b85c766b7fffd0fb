"""Late cancellations with state that ends: each trade key remembers only what may still find its counterpart.

A cancellation takes back one copy of its trade, whichever of the two arrives first. Of a key only rows without a counterpart are
kept, with their event time; a timer drops them when the watermark has passed that time by the delay, as rows so late are not
accepted any more. The state therefore holds no more than the unpaired rows of the last ``delay``. What comes out are changes of the
counts, so a key that was forgotten and comes again goes on from where it was; :func:`totals` adds them up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = ("disclosed", "cancelled", "active")


class Pairing(StatefulProcessor):
    """Pairs a key's trades with its cancellations; ``keep_ms`` is how long an unpaired row may wait."""

    def __init__(self, key: Sequence[str], keep_ms: int):
        self.key, self.keep_ms = list(key), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, cancelled boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = [(int(t), bool(c)) for t, c in self.waiting.get()] if self.waiting.exists() else []
        change = dict.fromkeys(CHANGES, 0)
        first = min((t for t, _ in waiting), default=None)
        for batch in rows:
            for at, cancelled in zip(batch["at_ms"].tolist(), batch["takes_back"].tolist(), strict=True):
                change["cancelled" if cancelled else "disclosed"] += 1
                if waiting and waiting[0][1] != cancelled:  # all that wait are of one kind
                    waiting.pop(0)
                    change["active"] -= bool(cancelled)  # the trade that waited counted until now
                else:
                    waiting.append((int(at), bool(cancelled)))
                    change["active"] += not cancelled
        self._keep(waiting, first)
        yield pd.DataFrame([[*key, *change.values()]], columns=[*self.key, *CHANGES])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = expiredTimerInfo.getExpiryTimeInMs() - self.keep_ms
        if self.waiting.exists():
            self._keep([(int(t), bool(c)) for t, c in self.waiting.get() if t > past], past)
        yield pd.DataFrame([], columns=[*self.key, *CHANGES])

    def _keep(self, waiting: list[tuple[int, bool]], first: int | None) -> None:
        """The new state, with a timer for its earliest row if that is not ``first``, which has one."""
        if not waiting:
            self.waiting.clear()
            return
        self.waiting.put(waiting)
        if (earliest := min(t for t, _ in waiting)) != first:
            self.handle.registerTimer(earliest + self.keep_ms)

    def close(self) -> None:
        pass


def _milliseconds(delay: str) -> int:
    amount, unit = delay.split()
    return int(amount) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def paired(stream: DataFrame, key: Sequence[str], time: str, cancelled: str = "cancelled", delay: str = "30 days") -> DataFrame:
    """Changes (key, disclosed, cancelled, active) of each batch; rows later than ``delay`` are not accepted."""
    timed = stream.select(*key, F.col(time).cast("timestamp").alias("event_time"), F.col(cancelled).alias("takes_back")).withWatermark("event_time", delay)
    timed = timed.withColumn("at_ms", F.unix_millis("event_time"))
    out = T.StructType([stream.schema[k] for k in key] + [T.StructField(c, T.LongType()) for c in CHANGES])
    return timed.groupBy(*key).transformWithStateInPandas(Pairing(key, _milliseconds(delay)), out, "Append", "EventTime")


def write_changes(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's changes in a folder of its own, written again if the batch is. Timers need the state store on RocksDB, which is
    chosen for this query only."""
    conf = changes.sparkSession.conf

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:08d}")

    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return changes.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)


def totals(written: DataFrame, key: Sequence[str]) -> DataFrame:
    """The present counts of every key."""
    return written.groupBy(*key).agg(*(F.sum(c).alias(c) for c in CHANGES))
