"""Labels on arrival: a sample's label is final once no later tag can reach it, and leaves then."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds between two looks at the waiting samples of a bucket.
LOOK = 30


def labels_before(times: np.ndarray, tags: np.ndarray, near: int, buffer: int) -> np.ndarray:
    """``labels.before_only`` of ``times`` by the ascending ``tags``: 1 up to ``near`` before a tag, -1 within ``buffer``, else 0."""
    edged = np.concatenate([[-np.inf], tags, [np.inf]])
    after = edged[np.searchsorted(tags, times, "left") + 1] - times
    before = times - edged[np.searchsorted(tags, times, "right")]
    return np.where(after <= near, 1, np.where((before <= buffer) | (after <= buffer), -1, 0))


class Arrivals(StatefulProcessor):
    """Waiting samples and the tags that may reach them, of one participant's bucket of time (in microseconds).

    One timer is set at a time: for the first waiting sample, or for the bucket's end, when its tags can go.
    """

    def __init__(self, near: int, buffer: int):
        self.near, self.buffer = near * 1_000_000, buffer * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", "us long, x double")
        self.tags = handle.getMapState("tags", "us long", "seen boolean")
        self.due = handle.getValueState("due", "ms long")

    def wake(self, ms: int) -> None:
        """Sets the timer to ``ms`` where none is set or a later one."""
        old = self.due.get()[0] if self.due.exists() else None
        if old is None or ms < old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def end(self, key) -> int:  # noqa: ANN001
        return (key[-1] + 1) * self.buffer

    def ripe(self, us: int, timer_values) -> int:  # noqa: ANN001
        """When the watermark has passed ``us``, in milliseconds; not before the next look."""
        return max(-(-us // 1000), timer_values.getCurrentWatermarkInMs() + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N803
        first = self.end(key)
        for some in rows:
            tag = some["is_tag"].to_numpy(bool)
            for us in some["us"][tag]:
                self.tags.updateValue((int(us),), (True,))
            if not tag.all():
                own = some[~tag]
                self.samples.appendList([(int(us), None if x != x else float(x)) for us, x in zip(own["us"], own["x"], strict=True)])
                first = min(first, int(own["us"].min()) + self.buffer)
        self.wake(self.ripe(first, timerValues))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N803
        self.due.clear()
        now = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.samples.get())
        times = np.array([r[0] for r in waiting], np.int64)
        final = times + self.buffer <= now * 1000
        if final.any():
            tags = np.sort(np.array([k[0] for k in self.tags.keys()], float))
            y = labels_before(times[final].astype(float), tags, self.near, self.buffer)
            yield pd.DataFrame({"who": [key[0]] * int(final.sum()), "us": times[final], "x": [r[1] for r, f in zip(waiting, final, strict=True) if f], "y": y.astype("int32")})
            self.samples.clear()
            if not final.all():
                self.samples.put([tuple(r) for r, f in zip(waiting, final, strict=True) if not f])
        if not final.all():
            self.wake(max(self.ripe(int(times[~final].min()) + self.buffer, timerValues), now + LOOK * 1000))
        elif now * 1000 < self.end(key):
            self.wake(self.ripe(self.end(key), timerValues))
        else:
            self.tags.clear()

    def close(self) -> None:
        pass


def labelled_stream(samples: DataFrame, tags: DataFrame, near: int, buffer: int, late: int | None = None) -> DataFrame:
    """Streams of samples (pid, ts, x) and tags (pid, tag_ts) to (pid, ts, x, y), in append mode.

    A sample leaves when the watermark, ``late`` seconds (``buffer`` if nothing is said) behind the slower of the two streams, is
    ``buffer`` seconds past it.  Rows later than the watermark are left out, as are rows without a time; up to it, their order does not
    matter.  Repeated samples are rows of their own, repeated tags are one, null participants one like others.  State is kept by
    participant and ``buffer`` seconds of time, so a participant is many keys' work; each tag goes to the two or three keys that it
    reaches, whose state ends with their last sample.  State is in RocksDB, to which the session is set.
    """
    spark = samples.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    delay = f"{buffer if late is None else late} seconds"
    us = F.unix_micros("ts")
    who = F.to_json(F.struct("pid")).alias("who")  # never null: groups of stateful processors take null keys for others
    at = lambda c: F.floor(c / (buffer * 1_000_000))
    s = samples.filter("ts is not null").withWatermark("ts", delay).select(who, "ts", us.alias("us"), "x", F.lit(False).alias("is_tag"), at(us).alias("bucket"))
    t = tags.select("pid", F.col("tag_ts").alias("ts")).filter("ts is not null").withWatermark("ts", delay)
    reach = F.sequence(at(us - buffer * 1_000_000), at(us + buffer * 1_000_000))
    t = t.select(who, "ts", us.alias("us"), F.lit(None).cast("double").alias("x"), F.lit(True).alias("is_tag"), F.explode(reach).alias("bucket"))
    out = StructType().add("who", "string").add("us", "long").add("x", "double").add("y", IntegerType())
    found = s.union(t).groupBy("who", "bucket").transformWithStateInPandas(Arrivals(near, buffer), out, "Append", "EventTime")
    pid = F.from_json("who", samples.select("pid").schema)["pid"].alias("pid")
    return found.select(pid, F.timestamp_micros("us").alias("ts"), "x", "y")
