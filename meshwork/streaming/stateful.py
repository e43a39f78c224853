"""Streams that keep state: blockers that nobody resolves in time, joins of two streams, counts that are kept up.

Each has a form for batches with the same result, and goes on from its checkpoint after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.causal import CORRELATED, correlations_of, edges_of
from ..sources.scratch import remove

OVERDUE = "user_id long, event_id long, ts_ms long, deadline_ms long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Overdue(StatefulProcessor):
    """Of one user: open blockers and resolutions seen, and a timer at each blocker's deadline.

    Rows may come in any order, as far as the watermark lets them in: a resolution is kept for `within` after its time, since
    a blocker that it resolves may come later. A timer decides for its blockers, which are told once and forgotten.
    """

    def __init__(self, within_ms: int):
        self.within_ms = within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blockers = handle.getMapState("blockers", "event_id long", "ts_ms long")
        self.resolutions = handle.getMapState("resolutions", "ts_ms long", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for event_id, ts, is_blocker in zip(part["event_id"], part["ts_ms"], part["is_blocker"], strict=True):
                if is_blocker:
                    self.blockers.updateValue((int(event_id),), (int(ts),))
                else:
                    self.resolutions.updateValue((int(ts),), (1,))
                # at a resolution's end it is forgotten, at a blocker's it is decided
                self.handle.registerTimer(int(ts) + self.within_ms)
        yield pd.DataFrame({"user_id": [], "event_id": [], "ts_ms": [], "deadline_ms": []}).astype("int64")

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        solved = sorted(k[0] for k, _ in self.resolutions.iterator())
        for (event_id,), (ts,) in list(self.blockers.iterator()):
            if ts + self.within_ms <= now:
                if not any(ts <= r <= ts + self.within_ms for r in solved):
                    out.append((key[0], event_id, ts, ts + self.within_ms))
                self.blockers.removeKey((event_id,))
        # blockers that may still come are younger than the watermark, so these resolve none of them
        for r in solved:
            if r + self.within_ms <= now and not any(ts <= r for _, (ts,) in self.blockers.iterator()):
                self.resolutions.removeKey((r,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "ts_ms", "deadline_ms"]).astype("int64")

    def close(self) -> None:
        pass


def marked(events: DataFrame, blocker: str, resolution: str) -> DataFrame:
    """(user_id, event_id, ts, ts_ms, is_blocker) of the events of the two types."""
    own = events.where(F.col("event_type").isin(blocker, resolution) & F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    return own.select("user_id", "event_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), (F.col("event_type") == blocker).alias("is_blocker"))


def overdue(events: DataFrame, within_ms: int, late: str = "10 minutes", blocker: str = "error", resolution: str = "purchase") -> DataFrame:
    """(user_id, event_id, ts_ms, deadline_ms): blockers that no resolution of the same user follows within within_ms, ends
    included. A stream tells each once, when the watermark has passed its deadline; a batch tells all.

    Events without user or time take no part; rows of one event_id are one event in a stream and should be in a batch.
    """
    own = marked(events, blocker, resolution)
    if events.isStreaming:
        events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        return own.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(Overdue(within_ms), OVERDUE, "Append", "EventTime")
    open_ = own.where("is_blocker").select("user_id", "event_id", "ts_ms", (F.col("ts_ms") + within_ms).alias("deadline_ms"))
    # one row for each user and time is enough to solve with
    solved = own.where("not is_blocker").select(F.col("user_id").alias("u"), F.col("ts_ms").alias("r")).distinct()
    return open_.join(solved, (F.col("user_id") == F.col("u")) & F.col("r").between(F.col("ts_ms"), F.col("deadline_ms")), "left_anti")


def with_resolutions(blockers: DataFrame, resolutions: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(blocker_id, user_id, blocked, resolution_id, resolved): every blocker with each resolution of its user within the time, or
    with nulls. Both have (id, user_id, ts). For two streams it is an outer join bounded by both watermarks: rows are kept as
    long as a partner may come, and a blocker without one comes out when that time has passed."""
    left = blockers.select(F.col("id").alias("blocker_id"), "user_id", F.col("ts").alias("blocked"))
    right = resolutions.select(F.col("id").alias("resolution_id"), F.col("user_id").alias("u"), F.col("ts").alias("resolved"))
    left, right = left.withWatermark("blocked", late), right.withWatermark("resolved", late)
    met = F.expr(f"user_id = u AND resolved >= blocked AND resolved <= blocked + INTERVAL {within}")
    return left.join(right, met, "left_outer").drop("u")


class KeptCounts:
    """Co-occurrence counts of pairs (changed, affected), kept up batch by batch in versions of a folder.

    A batch's version holds the totals up to it. It is written once: a batch that comes again, after a restart, finds its
    version complete and changes nothing, and what a crash left incomplete is written anew.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """The complete ones, in order."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("v=")]
        return sorted(int(p.getName()[2:]) for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def counts(self, upto: int | None = None) -> DataFrame:
        """(changed, affected, observations) after the last batch, or after the last one up to a number."""
        known = [v for v in self.versions() if upto is None or v <= upto]
        schema = "changed string, affected string, observations long"
        return self.spark.read.schema(schema).parquet(f"{self.path}/v={known[-1]}") if known else self.spark.createDataFrame([], schema)

    def merge(self, pairs: DataFrame, batch: int) -> None:
        """Adds the pairs of a batch, unless it or a later one has been added. The version before stays for readers."""
        known = self.versions()
        if known and known[-1] >= batch:
            return
        new = pairs.where("changed is not null and affected is not null").groupBy("changed", "affected").agg(F.count("*").alias("observations"))
        total = self.counts().unionByName(new).groupBy("changed", "affected").agg(F.sum("observations").alias("observations"))
        total.write.mode("overwrite").parquet(f"{self.path}/v={batch}")
        for old in known[:-1]:
            remove(self.spark, f"{self.path}/v={old}")

    def start(self, pairs: DataFrame, checkpoint: str) -> StreamingQuery:
        """Merges all that a stream of pairs has now; a later call goes on from the checkpoint."""
        return pairs.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def edges(self, least: float = CORRELATED) -> DataFrame:
        """The CAUSES edges that learn_edges() makes of all pairs seen so far."""
        return edges_of(correlations_of(self.counts(), least))
