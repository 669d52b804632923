"""Runs of pages as a stream of frames: the latest request wins, a cancelled run ends, late frames are dropped.

Every request for a page has a token greater than those before it, and so has a
cancellation; the frames of a run carry its token.  A frame counts while no greater
token has been seen for its page.  What is kept for a page between batches is one
row, and it expires when a page has been silent for ``ttl``: a frame that is older
than that is taken for a new run's.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Kinds of frames that end a run; after them its further frames are dropped too.
ENDS = ("done", "error", "cancel")
STATE = "token long, frames long, stage string, result string, result_token long, error string, ended boolean"
OUT = "page long, token long, frames long, dropped long, stage string, result string, error string, version long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Run:
    """One page: what its frames, in order, have made of it."""

    def __init__(self, state: tuple | None):
        self.token, self.frames, self.stage, self.result, self.result_token, self.error, self.ended = state or (-1, 0, "idle", None, -1, None, False)

    def state(self) -> tuple:
        return self.token, self.frames, self.stage, self.result, self.result_token, self.error, self.ended

    def take(self, token: int, kind: str, payload: str | None) -> bool:
        """Whether the frame counts.  A failed or cancelled run leaves the last result in place."""
        if token < self.token or token == self.token and self.ended:
            return False
        if token > self.token:
            self.token, self.frames, self.stage, self.error, self.ended = token, 0, "idle", None, False
        self.frames += 1
        self.stage, self.ended = ("idle" if kind == "cancel" else kind), kind in ENDS
        if kind == "done":
            self.result, self.result_token = payload, token
        if kind == "error":
            self.error = payload
        return True


class LatestRun(StatefulProcessor):
    """A row for each page that a batch has frames of."""

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", STATE, self.ttl)
        self.version = handle.getValueState("version", "n long", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        run = Run(tuple(self.state.get()) if self.state.exists() else None)
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        frames, dropped = pd.concat(list(rows)), 0  # a page's frames of one batch
        frames = frames.sort_values(["at", "seq"], kind="stable")
        for token, kind, payload in zip(frames["token"].tolist(), frames["kind"].tolist(), frames["payload"].tolist(), strict=True):
            dropped += not run.take(int(token), kind, payload)
        self.state.update(run.state())
        self.version.update((version,))
        yield pd.DataFrame([(key[0], run.token, run.frames, dropped, run.stage, run.result, run.error, version)], columns=["page", "token", "frames", "dropped", "stage", "result", "error", "version"])

    def close(self) -> None:
        pass


def latest_runs(frames: DataFrame, ttl: int | None = None) -> DataFrame:
    """A stream of (page, token, frames, dropped, stage, result, error, version) from frames (page, token, kind, payload, at, seq).

    ``dropped`` counts a batch's frames that came too late; ``version`` rises with every batch that has frames
    of the page.  Frames without page, token or kind are no frames.  ``ttl`` in milliseconds.
    """
    known = frames.filter("page is not null and token is not null and kind is not null").select(F.col("page").cast("long").alias("page"), F.col("token").cast("long").alias("token"), "kind", "payload", "at", "seq")
    return known.groupBy("page").transformWithStateInPandas(LatestRun(ttl), OUT, "Append", "None" if ttl is None else "ProcessingTime")


def write_latest(spark: SparkSession, frames: DataFrame, out: str, checkpoint: str, ttl: int | None = None) -> None:
    """Follows ``frames`` to what is there now and appends what changed to ``out``; a restart goes on where it stopped."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)  # values of several names need it
    try:
        latest_runs(frames, ttl).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)


def now(changes: DataFrame) -> DataFrame:
    """The last row of each page, and all the frames it has dropped."""
    last = F.max_by(F.struct("token", "frames", "stage", "result", "error"), "version")
    return changes.groupBy("page").agg(last.alias("r"), F.sum("dropped").alias("dropped")).select("page", "r.*", "dropped")
