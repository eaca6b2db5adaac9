"""Keyed state in event time: a key's rows are held until the watermark passes them, then taken in the order of ``t, seq``.

What comes out does not depend on how a stream is cut into micro-batches or files, as long as no row is later than the delay. State lies in
RocksDB, as typed values, lists and maps; what a key remembers goes by a timer once nothing later can need it.
"""

from __future__ import annotations

import uuid
from collections import Counter, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillrisk.operators.stories import Stories
from quillrisk.session import shared_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
AT = "_at"
HOUR = 3_600_000_000


class InOrder(StatefulProcessor):
    """Rows of a key in order. Subclasses say what a key remembers (``open``, ``forget``) and what rows give (``take``).

    ``fields``: the columns that are held, ``t`` in microseconds and ``seq`` among them; ``keep``: microseconds after a key's last row at which it is forgotten.
    """

    def __init__(self, fields: str, keep: int) -> None:
        self.fields, self.keep = fields, keep
        self.names = [f.split(" ")[0] for f in fields.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held, self.timer = handle.getListState("held", self.fields), handle.getValueState("timer", "due long, last long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None: ...

    def forget(self) -> None: ...

    def take(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame: ...

    def _wait(self, due: int, last: int) -> None:
        """One timer a key: at the first time that matters, in whole milliseconds after it."""
        old = self.timer.get()[0] if self.timer.exists() else None
        if old != due:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)
        self.timer.update((due, last))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            self.held.appendList(list(zip(*([v.tolist() if isinstance(v, np.ndarray) else v for v in part[c].tolist()] for c in self.names))))
            least = int(part["t"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            due, last = self.timer.get() if self.timer.exists() else (None, None)
            ms = first // 1000 + 1
            # A timer for forgetting gives way; the rows set it again.
            self._wait(ms if due is None else min(due, ms), last if last is not None else -1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, last = timerValues.getCurrentWatermarkInMs() * 1000, self.timer.get()[1]
        self.timer.clear()
        rows = pd.DataFrame(list(self.held.get()), columns=self.names)
        ready = rows[rows["t"] <= now].sort_values(["t", "seq"], kind="stable")
        rest = rows[rows["t"] > now]
        if len(ready):
            if len(rest):
                self.held.put(list(rest.itertuples(index=False, name=None)))
            else:
                self.held.clear()
            if last >= 0 and int(ready["t"].iloc[0]) > last + self.keep:
                self.forget()
            last = int(ready["t"].iloc[-1])
            yield self.take(key, ready.reset_index(drop=True))
        if len(rest):
            self._wait(int(rest["t"].min()) // 1000 + 1, last)
        elif last >= 0:
            if now > last + self.keep:
                self.forget()
            else:
                self._wait((last + self.keep) // 1000 + 1, last)


def in_order(rows: DataFrame, key: str, processor: InOrder, out: str, delay: str) -> DataFrame:
    """``processor`` over a stream. A row without ``seq`` only moves the watermark on; rows later than ``delay`` are dropped, and so are rows without ``t`` or
    not after 1970, where every watermark begins."""
    timed = rows.withColumn(AT, F.timestamp_micros("t")).withWatermark(AT, delay)
    timed = timed.where(F.col("seq").isNotNull() | F.col(AT).isNull())  # names the time, so that it is tested after the watermark
    return timed.groupBy(key).transformWithStateInPandas(processor, T._parse_datatype_string(out), "Append", "EventTime")


class Triggers(InOrder):
    """Remembers when and at what level a key fired."""

    def __init__(self, key: str, span: int) -> None:
        super().__init__("t long, seq long, impact int", span)
        self.key, self.span = key, span

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.fired = handle.getValueState("fired", "at long, level int")

    def forget(self) -> None:
        self.fired.clear()

    def take(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at, level = self.fired.get() if self.fired.exists() else (None, 0)
        out = []
        for t, impact in zip(rows["t"].tolist(), rows["impact"].tolist()):
            cold = at is not None and t - at < self.span
            out.append("fired" if not cold else "escalation" if impact > level else "cooldown")
            if out[-1] != "cooldown":
                at, level = t, impact
        self.fired.update((at, level))
        return pd.DataFrame({self.key: key[0], "seq": rows["seq"], "decision": out})


def triggers(signals: DataFrame, key: str, hours: float = 24.0, delay: str = "0 seconds") -> DataFrame:
    """``(key, seq, decision)``: a signal fires a key that has not fired for ``hours``; within them only a higher impact does (an escalation).

    ``signals``: the key, ``t`` in microseconds, ``seq`` (unique) and ``impact``. A null key is a key; rows without ``t`` are dropped as late.
    """
    span = int(hours * HOUR)
    return in_order(signals.select(key, "t", "seq", F.col("impact").cast("int").alias("impact")), key, Triggers(key, span), f"{key} string, seq long, decision string", delay)


class Scores(InOrder):
    """Remembers mentions of the last window and two fading sums."""

    def __init__(self, key: str, window: int, half_life: int) -> None:
        super().__init__("t long, seq long, outlet string, sentiment double, relevance double", max(window, 64 * half_life))
        self.key, self.window, self.half_life = key, window, half_life

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.recent, self.sums = handle.getListState("recent", "t long, outlet string"), handle.getValueState("sums", "num double, den double, last long")

    def forget(self) -> None:
        self.recent.clear()
        self.sums.clear()

    def take(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        mentions = deque(tuple(r) for r in self.recent.get())
        places = Counter(outlet for _, outlet in mentions)
        num, den, last = self.sums.get() if self.sums.exists() else (0.0, 0.0, None)
        newer, out = deque(t for t, _ in mentions), []
        for t, outlet, s, w in zip(rows["t"].tolist(), rows["outlet"].tolist(), rows["sentiment"].tolist(), rows["relevance"].tolist()):
            while mentions and mentions[0][0] < t - self.window:
                gone = mentions.popleft()[1]
                places[gone] -= 1
                if not places[gone]:
                    del places[gone]
            while newer and newer[0] <= t - self.window:
                newer.popleft()
            fade = 1.0 if last is None else 2.0 ** (-(t - last) / self.half_life)
            num, den, last = num * fade + w * s, den * fade + w, t
            mentions.append((t, outlet))
            newer.append(t)
            places[outlet] += 1
            out.append((len(newer), len(places), num / den if den else 0.0))
        self.recent.put(list(mentions))
        self.sums.update((num, den, last))
        recent, outlets, level = zip(*out)
        return pd.DataFrame({self.key: key[0], "seq": rows["seq"], "recent": recent, "outlets": outlets, "level": level})


def scores(rows: DataFrame, key: str, window: int = 6 * HOUR, half_life: int = 24 * HOUR, delay: str = "0 seconds") -> DataFrame:
    """``(key, seq, recent, outlets, level)`` for every row: mentions in ``(t - window, t]`` and distinct outlets in ``[t - window, t]`` so far, and the mean
    sentiment whose weights halve every ``half_life``.

    ``rows``: the key, ``t`` in microseconds, ``seq`` (unique), ``outlet``, ``sentiment``, ``relevance``. A key that is silent for 64 half-lives is
    forgotten: what it said before weighs less than a double can tell.
    """
    held = rows.select(key, "t", "seq", F.col("outlet").cast("string").alias("outlet"), "sentiment", "relevance")
    return in_order(held, key, Scores(key, window, half_life), f"{key} string, seq long, recent long, outlets long, level double", delay)


class OpenStories(InOrder):
    """Remembers the open stories, an entry each; only those that changed are written again."""

    def __init__(self, threshold: float, window: int, retention: int) -> None:
        super().__init__("t long, seq long, vector array<double>", max(window, retention))
        self.rule = (threshold, window, retention)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.stories = handle.getMapState("stories", "name string", "centre array<double>, last long, size long, born long")
        self.born = handle.getValueState("born", "n long")

    def forget(self) -> None:
        self.stories.clear()
        self.born.clear()

    def take(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        known = sorted(((v[3], k[0], v) for k, v in self.stories.iterator()), key=lambda x: x[0]) if self.stories.exists() else []
        born = self.born.get()[0] if self.born.exists() else 0
        live = Stories(*self.rule)
        if known:
            live.centre = np.array([v[0] for *_, v in known])
            live.last, live.size = (np.array([v[i] for *_, v in known], np.int64) for i in (1, 2))
            live.name = [n for _, n, _ in known]
        out = live.batch(rows)
        order, touched = {n: b for b, n, _ in known}, set(out["story"])
        for name in live.name:
            if name not in order:
                order[name], born = born, born + 1
        left = set(live.name)
        for name in set(order) - left:
            if self.stories.containsKey((name,)):
                self.stories.removeKey((name,))
        n = len(live.name)
        for name, centre, last, size in zip(live.name, live.centre[:n].tolist(), live.last[:n].tolist(), live.size[:n].tolist()):
            if name in touched:
                self.stories.updateValue((name,), (centre, last, size, order[name]))
        self.born.update((born,))
        return out


def stream_stories(rows: DataFrame, block: str, threshold: float = 0.8, window_hours: float = 48, retention_hours: float = 72, delay: str = "0 seconds") -> DataFrame:
    """``cluster_stories`` over a stream; null vectors are left out, a null block is a block."""
    held = rows.where(F.col("vector").isNotNull() | F.col("seq").isNull())
    held = held.select(F.col(block).cast("string").alias("block"), "t", F.col("seq").cast("long").alias("seq"), F.col("vector").cast("array<double>").alias("vector"))
    return in_order(held, "block", OpenStories(threshold, int(window_hours * HOUR), int(retention_hours * HOUR)), "seq long, story string, similarity double, new boolean, novelty double", delay)


class Inbox:
    """A folder that files come into and one stream over it, with its checkpoint and results beside it. Every ``run`` restarts from the checkpoint."""

    def __init__(self, spark: SparkSession, schema: T.StructType, make: Callable[[DataFrame], DataFrame], name: str) -> None:
        self.spark, self.schema, self.make = spark, T.StructType([T.StructField(f.name, f.dataType) for f in schema]), make
        self.base = f"{shared_dir(spark)}/quillrisk/inbox-{name}-{uuid.uuid4().hex}"
        self.kind: T.StructType | None = None

    def put(self, rows: DataFrame) -> None:
        rows.select(*self.schema.names).write.mode("append").parquet(f"{self.base}/in")

    def run(self, files: int = 4) -> None:
        """Take what has come since the last run, some files at a time."""
        before = self.spark.conf.get(PROVIDER)
        self.spark.conf.set(PROVIDER, ROCKS)  # what a query starts with is its own
        try:
            stream = self.make(self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files).parquet(f"{self.base}/in"))
            self.kind = stream.schema
            writer = stream.writeStream.format("parquet").option("path", f"{self.base}/out").option("checkpointLocation", f"{self.base}/checkpoint")
            writer.trigger(availableNow=True).start().awaitTermination()
        finally:
            self.spark.conf.set(PROVIDER, before)

    def close(self, t: int) -> None:
        """No row is older than ``t`` any more: a row of time alone moves the watermark there, and all that is held comes out."""
        self.put(self.spark.createDataFrame([tuple(t if f.name == "t" else None for f in self.schema)], self.schema))
        self.run()

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.kind).parquet(f"{self.base}/out")


def replay(rows: DataFrame, make: Callable[[DataFrame], DataFrame], name: str, days: int = 400, parts: int = 3, disorder: int = 12 * HOUR) -> DataFrame:
    """A table as a stream: ``parts`` lots of files in the order of time, but for rows that come up to ``disorder`` microseconds late; the stream restarts after
    every lot. ``make`` has to wait that long. Rows of a lot lie in files at random. ``days``: what the end of the stream lies after the last row."""
    spark = rows.sparkSession
    lo, hi = rows.agg(F.min("t"), F.max("t")).first()
    inbox = Inbox(spark, rows.schema, make, name)
    if lo is None:
        inbox.put(rows)
        inbox.run()
        return inbox.rows()
    comes = F.col("t") + F.pmod(F.xxhash64("seq"), F.lit(disorder + 1))
    lot = F.least(F.lit(parts - 1), F.floor((comes - lo) * parts / F.lit(hi - lo + disorder + 1)))
    for k in range(parts):
        inbox.put(rows.where(lot == k).repartition(2, F.xxhash64("seq")))
        inbox.run(1)
    inbox.close(hi + days * 24 * HOUR)
    return inbox.rows()
