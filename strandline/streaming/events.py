"""Structured Streaming forms of the windowed counts and of the keyed accumulation of readings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window and event type; rows later than the watermark are left out."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = stream.withWatermark("ts", late).groupBy(window.alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("started"), "event_type", "n", "total")


def session_counts(stream: DataFrame, late: str = "10 minutes", gap: str = "12 hours") -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


def running_moments(stream: DataFrame) -> DataFrame:
    """Count, mean and population deviation of each user's values so far; the state is three numbers a key."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, s, ss = state.get if state.exists else (0, 0.0, 0.0)
        for f in frames:
            v = f["value"].dropna()
            n, s, ss = n + len(v), s + float(v.sum()), ss + float((v * v).sum())
        state.update((n, s, ss))
        mean = s / n if n else 0.0
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "mean": [mean], "sd": [max(ss / n - mean * mean, 0.0) ** 0.5 if n else 0.0]})

    return stream.groupBy("user_id").applyInPandasWithState(
        update, "user_id long, n long, mean double, sd double", "n long, s double, ss double", "update", GroupStateTimeout.NoTimeout
    )


class _Pool(StatefulProcessor):
    """Readings of a site so far in a list; a timer gives the pooled site once no sample has come for a while."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.readings = handle.getListState("readings", "sample int, kmer string, reads array<array<float>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        self.readings.appendList([(int(r.sample), r.kmer, [list(map(float, x)) for x in r.reads]) for f in frames for r in f.itertuples(index=False)])
        set_before = list(self.handle.listTimers())
        latest = max(int(f["ts"].max().timestamp() * 1000) for f in frames)
        due = max([latest, timerValues.getCurrentWatermarkInMs()]) + self.quiet_ms
        for timer in set_before:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max([due, *set_before]))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = sorted(self.readings.get(), key=lambda x: x[0])
        self.readings.clear()
        reads = [[float(v) for v in r] for _, _, part in held for r in part]
        yield pd.DataFrame({"transcript_id": [key[0]], "transcript_position": [key[1]], "kmer": [held[0][1]], "reads": [reads], "n_reads": [len(reads)]})

    def close(self) -> None:
        pass


def pooled_sites(stream: DataFrame, late: str = "10 minutes", quiet: str = "1 hour") -> DataFrame:
    """One row a site with the readings of all samples in the order of their numbers, once no sample has come for ``quiet``.

    ``stream`` has ts, sample, transcript_id, transcript_position, kmer and reads (lists of nine numbers, as many as the
    sample holds). The state of a site is a list, so a sample is appended without reading what is there.
    """
    quiet_ms = int(pd.Timedelta(quiet).total_seconds() * 1000)
    keyed = stream.withWatermark("ts", late).groupBy("transcript_id", "transcript_position")
    schema = "transcript_id string, transcript_position int, kmer string, reads array<array<float>>, n_reads long"
    return keyed.transformWithStateInPandas(_Pool(quiet_ms), schema, "Append", "EventTime")
