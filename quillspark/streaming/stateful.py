"""Streams on ``transformWithState``: folds and windows that start from a snapshot, counters, unanswered events, deliveries.

A stream can begin where a batch job ended: its state is made from the batch result (``initial``), so a log is folded once
as a table and then followed. The state store must be RocksDB (``use_rocksdb``). Events of a micro-batch are taken in order of
(ts, event_id) within a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quillspark.streaming.keyed import DAY, DELAY, SETTLED, step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state in RocksDB, as ``transformWithState`` needs it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of a micro-batch in order; none, without columns, for a key that only the initial state has."""
    some = [b for b in batches if len(b) and "at_us" in b]
    return pd.concat(some).sort_values(["at_us", "event_id"], kind="stable") if some else pd.DataFrame()


def _known(rows: pd.DataFrame, *columns: str):
    """Rows of Python values, absent ones as None."""
    return () if not len(rows) else zip(*(rows[c].astype(object).where(rows[c].notna(), None).tolist() for c in columns))


def _kinds(df: DataFrame, *columns: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"{c} {kinds[c]}" for c in columns)


class _Fold(StatefulProcessor):
    """Current state of a key's parts, in a map that forgets parts which nothing has touched for a while."""

    def __init__(self, part_kind: str, idle_ms: int, names: list[str]):
        self.part_kind, self.idle_ms, self.names = part_kind, idle_ms, names

    def init(self, handle) -> None:
        self.parts = handle.getMapState("parts", f"part {self.part_kind}", "status string, duration_ms int, audio_key string, total int, done int", self.idle_ms or None)

    def _emit(self, key, part, held) -> tuple:
        status, duration, audio, total, done = held
        return (key, part, status or "queued", duration, audio, total, done if not total or done is None else min(total, done))

    def handleInputRows(self, key, rows, timers):
        out = {}
        for part, s, d, a, t, n in _known(_ordered(rows), "part", "status", "duration_ms", "audio_key", "total", "done"):
            status, duration, audio, total, done = self.parts.getValue((part,)) if self.parts.containsKey((part,)) else (None, None, None, 0, None)
            if s == "segment_ready":
                status = status if status in SETTLED else "partial_ready"
            elif s is not None:
                status, duration, audio = s, duration if d is None else int(d), audio if a is None else a
            total = int(t) if t is not None and t > 0 else total
            held = (status, duration, audio, total, done if n is None else int(n))
            self.parts.updateValue((part,), held)
            out[part] = self._emit(key[0], part, held)
        yield pd.DataFrame(list(out.values()), columns=self.names)

    def handleInitialState(self, key, initial, timers) -> None:
        for part, *held in _known(initial, "part", "status", "duration_ms", "audio_key", "total", "done"):
            status, duration, audio, total, done = held
            self.parts.updateValue((part,), (status, None if duration is None else int(duration), audio, int(total or 0), None if done is None else int(done)))

    def close(self) -> None:
        pass


def folded_stream(log: DataFrame, key: str, part: str, initial: DataFrame | None = None, idle_days: float = 30) -> DataFrame:
    """ST2 and ST3 for the parts of a key over a stream (ts, event_id, status, duration_ms, audio_key, total, done): a row for each part that a micro-batch touches.

    ``initial``: (key, part, status, duration_ms, audio_key, total, done) of what came before the stream, as the batch rules give it.
    State of a part goes ``idle_days`` after it was last written, by the clock. A part's ``done`` is at most its total where one is known.
    """
    names = [key, "part", "status", "duration_ms", "audio_key", "total", "done"]
    rows = log.select(F.col(key), F.col(part).alias("part"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "status", "duration_ms", "audio_key", "total", "done")
    kind = dict(rows.dtypes)["part"]
    out = f"{_kinds(log, key)}, part {kind}, status string, duration_ms int, audio_key string, total int, done int"
    held = None if initial is None else initial.select(F.col(key), F.col(part).alias("part"), *names[2:]).groupBy(key)
    return rows.groupBy(key).transformWithStateInPandas(_Fold(kind, int(idle_days * DAY * 1000), names), out, "Update", "ProcessingTime", held)


class _Windows(StatefulProcessor):
    """The open window of a key; a timer drops it when the watermark passes its end."""

    def __init__(self, span: int, names: list[str]):
        self.span, self.names = span, names

    def init(self, handle) -> None:
        self.handle, self.window = handle, handle.getValueState("window", "opened long, count long")

    def _hold(self, opened: int, count: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        self.window.update((opened, count))
        self.handle.registerTimer((opened + self.span) // 1000 + 1)

    def handleInputRows(self, key, rows, timers):
        opened, count = self.window.get() or (-1, 0)
        out = []
        for i, at, free in _known(_ordered(rows), "event_id", "at_us", "free"):
            if free:  # passes without a mark
                out.append((key[0], i, 0, True))
                continue
            opened, count, new = step(opened, count, at, self.span)
            out.append((key[0], i, count, new))
        if opened >= 0:
            self._hold(opened, count)
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key, timers, expired):
        self.window.clear()
        yield pd.DataFrame([], columns=self.names)

    def handleInitialState(self, key, initial, timers) -> None:
        self._hold(int(initial["opened"].iloc[0]), int(initial["count"].iloc[0]))

    def close(self) -> None:
        pass


def open_windows(labelled: DataFrame, key: str) -> DataFrame:
    """(key, opened, count): each key's last window after a batch of ``keyed.anchored``, to start ``windows_stream`` from."""
    last = F.max(F.struct("window_start", "in_window")).alias("last")
    return labelled.groupBy(key).agg(last).select(key, F.unix_micros("last.window_start").alias("opened"), F.col("last.in_window").cast("long").alias("count"))


def windows_stream(events: DataFrame, key: str, span_seconds: float, initial: DataFrame | None = None, forced: Column | None = None, delay: str = DELAY) -> DataFrame:
    """ST4 to ST6 over a stream (ts, event_id): key, event_id, in_window and opens. ``forced`` events open nothing and count nowhere: in_window is 0, and opens is true as they pass a throttle.

    ``initial``: the windows that were open before, by ``open_windows``.
    """
    names = [key, "event_id", "in_window", "opens"]
    free = F.coalesce(forced, F.lit(False)) if forced is not None else F.lit(False)
    rows = events.withWatermark("ts", delay).select(F.col(key), "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), free.alias("free"))
    held = None if initial is None else initial.groupBy(key)
    out = f"{_kinds(events, key, 'event_id')}, in_window long, opens boolean"
    return rows.groupBy(key).transformWithStateInPandas(_Windows(round(span_seconds * 1_000_000), names), out, "Append", "EventTime", held)


class _Counters(StatefulProcessor):
    """How each part of a key ended, in a map, and the two counters that follow from it."""

    def __init__(self, part_kind: str, names: list[str]):
        self.part_kind, self.names = part_kind, names

    def init(self, handle) -> None:
        self.ends, self.counts = handle.getMapState("ends", f"part {self.part_kind}", "status string"), handle.getValueState("counts", "voiced long, failed long")

    def handleInputRows(self, key, rows, timers):
        voiced, failed = self.counts.get() or (0, 0)
        for part, s in _known(_ordered(rows), "part", "status"):
            held = self.ends.getValue((part,))[0] if self.ends.containsKey((part,)) else None
            if s == "voiced" and held != "voiced":
                voiced, failed = voiced + 1, failed - (held == "failed")
            elif not (s == "failed" and held is None):
                continue
            else:
                failed += 1
            self.ends.updateValue((part,), (s,))
        self.counts.update((voiced, failed))
        yield pd.DataFrame([(key[0], voiced, failed)], columns=self.names)  # also for a key that only the initial state has

    def handleInitialState(self, key, initial, timers) -> None:
        voiced = failed = 0
        for part, s in _known(initial, "part", "status"):
            self.ends.updateValue((part,), (s,))
            voiced, failed = voiced + (s == "voiced"), failed + (s == "failed")
        self.counts.update((voiced, failed))

    def close(self) -> None:
        pass


def counters_stream(log: DataFrame, key: str, part: str, initial: DataFrame | None = None) -> DataFrame:
    """ST7 over a stream: (key, voiced, failed), the counters themselves, for each key that a micro-batch touches. ``initial``: (key, part, status) of parts that ended before."""
    rows = log.select(F.col(key), F.col(part).alias("part"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "status")
    held = None if initial is None else initial.select(F.col(key), F.col(part).alias("part"), "status").groupBy(key)
    return rows.groupBy(key).transformWithStateInPandas(_Counters(dict(rows.dtypes)["part"], [key, "voiced", "failed"]), f"{_kinds(log, key)}, voiced long, failed long", "Update", "None", held)


def once_within(events: DataFrame, id_: str, delay: str = DELAY) -> DataFrame:
    """ST8, the plain rule: of the events of one id only the first within ``delay`` of event time; a later one goes again. State is bounded by the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([id_])


def unanswered(first: DataFrame, answers: DataFrame, key: list[str], minutes: int) -> DataFrame:
    """Events of ``first`` that no event of ``answers`` with the same key follows within ``minutes``: an outer join, of tables or of streams.

    Both have ts and event_id; streams have a watermark on ts, set before their rows are picked, so that any event moves it. An event
    comes out when both watermarks have passed its time and the bound; state is bounded by that.
    ST9: discovering events, answered by any later event or live job of the book. JN6: processing or annotated segments, answered by a live job.
    """
    a = first.alias("a")
    b = answers.select(*key, F.col("ts").alias("answered_at"), F.col("event_id").alias("answered_by")).alias("b")
    later = (F.col("b.answered_at") > F.col("a.ts")) | ((F.col("b.answered_at") == F.col("a.ts")) & (F.col("b.answered_by") > F.col("a.event_id")))
    bound = (F.col("b.answered_at") >= F.col("a.ts")) & (F.col("b.answered_at") <= F.col("a.ts") + F.expr(f"INTERVAL {minutes} MINUTES"))
    same = bound & later
    for k in key:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, same, "leftOuter").where("b.answered_at IS NULL").select("a.*")


def _picked(watermarked: DataFrame, condition: Column) -> DataFrame:
    """Rows of a stream that meet a condition; it reads the event time, or else it would be moved below the watermark, which the other rows then didn't move."""
    return watermarked.where(F.when(F.col("ts").isNotNull(), condition))


def stuck_stream(log: DataFrame, jobs: DataFrame, minutes: int = 60, key: str = "book_id", delay: str = DELAY) -> DataFrame:
    """ST9: discovering events that neither a later event of the log nor one of ``jobs`` (of the same key, with a live state) follows in time."""
    log, jobs = log.withWatermark("ts", delay), jobs.withWatermark("ts", delay)
    signs = log.select(key, "ts", "event_id").unionByName(_picked(jobs, F.col("state").isin("active", "waiting")).select(key, "ts", "event_id"))
    return unanswered(_picked(log, F.col("status") == "discovering"), signs, [key], minutes)


def orphan_stream(segments: DataFrame, jobs: DataFrame, minutes: int = 5, delay: str = DELAY) -> DataFrame:
    """JN6 on streams: segment events in processing or annotated that no live job event of the segment follows in time."""
    live = _picked(jobs.withWatermark("ts", delay), F.col("state").isin("active", "waiting"))
    return unanswered(_picked(segments.withWatermark("ts", delay), F.col("status").isin("processing", "annotated")), live, ["chapter_id", "segment_index"], minutes)


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """SS5 and ST1: ``events`` (book_id, type, ...) for each listener of ``subscriptions`` (listener, book_id, types): of the book, and of the types (all, where null)."""
    met = events.join(subscriptions.select("listener", "book_id", "types"), "book_id")
    return met.where(F.col("types").isNull() | F.array_contains("types", F.col("type"))).drop("types")


def delivered(events: DataFrame, subscriptions: str, folder: str, checkpoint: str, schema: str = "listener string, book_id long, types array<string>"):
    """SS5 and ST1 on a stream; returns the started query. Each micro-batch reads the subscriptions as they are then and writes its deliveries to a folder of its own, which a repeated batch writes again."""

    def send(batch: DataFrame, number: int) -> None:
        now = batch.sparkSession.read.schema(schema).parquet(subscriptions)
        fan_out(batch, now).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
