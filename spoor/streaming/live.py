"""Recordings that are still landing: streaming forms of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor import schemas
from spoor.operators.audit import UNTIMED


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """The replay operators hold map state and timers, which Spark keeps in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def land(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of one table as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Evidence files as they land."""
    return land(spark, path, schemas.EVIDENCE, files_per_trigger)


def land_end(rows: DataFrame, path: str, delay_ns: int) -> None:
    """Marks the end of a finished recording in its landing folder: one row that lies further behind the last one than
    any watermark delay up to ``delay_ns``. The watermark then passes all rows of the recording, and none of the mark.
    """
    last = rows.agg(F.max("ns").alias("ns")).first()["ns"]
    if last is not None:
        mark = rows.limit(1).withColumns({"ns": F.lit(last + delay_ns + 2_000_000_000), "seq": F.lit(0).cast("bigint")})
        mark.select(rows.columns).coalesce(1).write.mode("append").parquet(path)


def with_event_time(events: DataFrame, starts: DataFrame, delay: str) -> DataFrame:
    """Adds event_time = run start + clock offset, with a watermark.

    ``starts``: (run_id, unix_timestamp, start_ns), one row per run.
    """
    micros = F.col("unix_timestamp") * 1000000 + F.expr("(ns - start_ns) div 1000")
    return (events.join(starts, "run_id")
            .withColumn("event_time", F.timestamp_micros(micros))
            .drop("unix_timestamp", "start_ns").withWatermark("event_time", delay))


def time_profile(timed: DataFrame) -> DataFrame:
    """Events, instructions and memory-API calls per second; a second is final once the watermark passes it."""
    rows = timed.filter(~F.col("kind").isin(*UNTIMED))
    return rows.groupBy("run_id", F.window("event_time", "1 second")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("kind") == 4).alias("instructions"),
        F.count_if(F.col("kind") == 15).alias("memory_api")).select(
        "run_id", F.col("window.start").alias("second"), "events", "instructions", "memory_api")


def drop_duplicates(timed: DataFrame) -> DataFrame:
    """One row per sequence number of a run among those that arrive within the watermark."""
    return timed.dropDuplicatesWithinWatermark(["run_id", "seq"])


_MATCHED = T.StructType([
    T.StructField("run_id", T.LongType()), T.StructField("tid", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("kind", T.IntegerType()), T.StructField("call_id", T.LongType()),
    T.StructField("depth", T.LongType()), T.StructField("matched", T.BooleanType())])


_CHUNK = 1 << 16     # rows replayed, and returned, at a time


def _stack_processor(syscalls: bool):
    """Stateful processor class; built inside a function so that it travels by value to the workers."""
    import numpy as np
    from pyspark.sql.streaming import StatefulProcessor

    columns = ["seq", "kind", "call_id", "address"]

    class Replay(StatefulProcessor):
        """Holds rows until the watermark passes them, then replays them in sequence order.

        Waiting rows are kept as packed chunks under their first moment, so that a batch writes its own rows and a timer
        reads what it releases. (Appending to a list state reads the whole list again for every row.)
        """

        def init(self, handle):
            self.handle = handle
            self.waiting = handle.getMapState("waiting", "first bigint, chunk bigint", "data binary")
            self.chunks = handle.getValueState("chunks", "n bigint")
            self.frames = handle.getValueState("frames", "data binary")

        def keep(self, rows, number):
            first = int(rows[:, 0].min())
            self.waiting.updateValue((first, number), (rows.tobytes(),))
            self.handle.registerTimer(first + 1)

        def numbers(self, count):
            start = self.chunks.get()[0] if self.chunks.exists() else 0
            self.chunks.update((start + count,))
            return range(start, start + count)

        def handleInputRows(self, key, rows, timerValues):
            new = []
            for batch in rows:
                if len(batch):
                    stamps = batch["event_time"].astype("datetime64[us]").astype("int64") // 1000
                    new.append(np.column_stack([stamps, *(batch[c].astype("int64") for c in columns)]))
            for chunk, number in zip(new, self.numbers(len(new))):
                self.keep(chunk, number)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd
            limit = timerValues.getCurrentWatermarkInMs()
            due = [k for k in self.waiting.keys() if k[0] < limit]
            if not due:
                return
            rows = np.concatenate([np.frombuffer(self.waiting.getValue(k)[0], np.int64).reshape(-1, 5) for k in due])
            for k in due:
                self.waiting.removeKey(k)
            ready, rest = rows[rows[:, 0] < limit], rows[rows[:, 0] >= limit]
            rest = rest[np.argsort(rest[:, 0], kind="stable")]
            pieces = [rest[a:a + _CHUNK] for a in range(0, len(rest), _CHUNK)]
            for chunk, number in zip(pieces, self.numbers(len(pieces))):
                self.keep(chunk, number)
            ready = ready[np.argsort(ready[:, 1], kind="stable")]
            frames, heights = [], {}
            if self.frames.exists():
                for call_id, address in np.frombuffer(self.frames.get()[0], np.int64).reshape(-1, 2).tolist():
                    self.push(frames, heights, call_id, address)
            for a in range(0, len(ready), _CHUNK):
                out = [self.step(frames, heights, *row) for row in ready[a:a + _CHUNK, 1:].tolist()]
                result = pd.DataFrame(out, columns=["seq", "kind", "call_id", "depth", "matched"])
                result.insert(0, "run_id", key[0])
                result.insert(1, "tid", key[1])
                yield result.astype({"kind": "int32"})
            self.frames.update((np.array(frames, np.int64).tobytes(),))

        def push(self, frames, heights, call_id, address):
            if not syscalls:          # the heights at which an address was pushed; those that are no more are popped when met
                heights.setdefault(address, []).append(len(frames))
            frames.append((call_id, address))

        def top(self, frames, heights, address):
            if syscalls:
                return len(frames) - 1
            places = heights.get(address)
            while places:
                if places[-1] < len(frames) and frames[places[-1]][1] == address:
                    return places[-1]
                places.pop()
            return -1

        def step(self, frames, heights, seq, kind, call_id, address):
            if kind == 7 or kind == 1:                      # call, or system-call enter
                self.push(frames, heights, call_id, address)
                return seq, kind, call_id, len(frames) - 1, True
            if kind == 13:                                  # context change: open system calls are lost
                lost = len(frames)
                frames.clear()
                heights.clear()
                return seq, kind, 0, lost, False
            at = self.top(frames, heights, address)
            if at < 0:
                return seq, kind, 0, len(frames), False
            found = frames[at][0]
            del frames[at:]
            return seq, kind, found, at, True

        def close(self):
            pass

    return Replay()


def correlate_calls(timed: DataFrame) -> DataFrame:
    """Streaming call/return matching per thread: (run_id, tid, seq, kind 7/8, call_id, address, event_time)."""
    return _replay(timed, False)


def correlate_syscalls(timed: DataFrame) -> DataFrame:
    """Streaming system-call pairing: kind 1 enters, 0 exits, 13 context changes; call_id numbers enters."""
    return _replay(timed, True)


def _replay(timed: DataFrame, syscalls: bool) -> DataFrame:
    keep_state_in_rocksdb(timed.sparkSession)
    rows = timed.select("run_id", "tid", "seq", F.col("kind").cast("int").alias("kind"), "call_id", "address", "event_time")
    return rows.groupBy("run_id", "tid").transformWithStateInPandas(
        statefulProcessor=_stack_processor(syscalls), outputStructType=_MATCHED, outputMode="Append",
        timeMode="EventTime")
