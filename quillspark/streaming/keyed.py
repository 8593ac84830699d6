"""Keyed event streams: anchored windows, throttles, caches, folds, de-duplication.

The sequential rules (ST4 to ST6) are one helper. As a batch job a key's events lie sorted in one partition and pass
by in Arrow batches, the state of the current key carried along; keys of too many events for one task are worked in
ranges (``hot_keys``). The other batch rules are group extremes, which combine before the shuffle.

As streams all rules run on keyed state, by one helper: a micro-batch's events of a key are folded in order of time.
Every stream has a watermark on its event time, an hour by default: later events are left out, and state that has been
idle for as long as its rule allows is dropped when the watermark passes it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.streaming.hot_keys import anchored_by_doubling

DELAY = "1 hour"
#: Events of a key that one task folds in order; a key of more is worked in ranges.
HOT_ROWS = 2_000_000
DAY = 86_400.0


def step(opened: int, count: int, at: int, span: int) -> tuple[int, int, bool]:
    """(start of the window, events in it, whether this event opened it): a window opens at the first event at or after the last one's end."""
    if opened < 0 or at >= opened + span:
        return at, 1, True
    return opened, count + 1, False


def anchored(events: DataFrame, key: str, span_seconds: float, ts: str = "ts", tie: str = "event_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``events`` with ``window_start``, ``in_window`` (1, 2, ...) and ``opens``, windows anchored at each key's own events.

    ST4: over a limit where in_window > limit. ST5: passes where opens. ST6: a miss where opens, else a hit. Events without a
    key or time are left out. Keys of more than ``hot_rows`` events are worked in ranges (``hot_keys``); the result is the same.
    """
    span = round(span_seconds * 1_000_000)
    every = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    hot = every.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(key)
    most = every.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    rows = every if most <= hot_rows else every.join(hot, key, "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, opened, count = None, -1, 0
        for pdf in batches:
            starts, counts, opens = [], [], []
            for k, at in zip(pdf[key].tolist(), pdf["_at"].tolist()):
                if k != current:
                    current, opened, count = k, -1, 0
                opened, count, new = step(opened, count, at, span)
                starts.append(opened)
                counts.append(count)
                opens.append(new)
            yield pdf.assign(_start=starts, in_window=counts, opens=opens)

    schema = rows.schema
    for name, kind in (("_start", "long"), ("in_window", "long"), ("opens", "boolean")):
        schema = schema.add(name, kind)
    # by an expression of the key: a join's partitions, which adaptive execution may split, would stand in for those of the key itself
    out = rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, "_at", tie).mapInPandas(run, schema)
    if most > hot_rows:
        parts = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // hot_rows))
        out = out.unionByName(anchored_by_doubling(every.join(hot, key, "left_semi"), key, span, tie, parts))
    return out.withColumn("window_start", F.timestamp_micros("_start")).drop("_at", "_start")


def throttled(events: DataFrame, key: str, span_seconds: float, forced: Column, ts: str = "ts", tie: str = "event_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """ST5: events that pass a throttle: the first of a key, and each that comes a span after the last that passed; forced ones always, without a mark."""
    free = F.coalesce(forced, F.lit(False))
    passed = anchored(events.where(~free), key, span_seconds, ts, tie, hot_rows).where("opens").drop("window_start", "in_window", "opens")
    return passed.unionByName(events.where(free))


def _stateful(events: DataFrame, key: str, columns: list[str], fold: Callable, kind: str, out: str, state: str, ts: str, tie: str, delay: str, timed_out: Callable | None = None) -> DataFrame:
    """``fold(key, state or None, rows in order) -> (rows to emit, state or None, seconds since the epoch at which it times out)`` on keyed state.

    ``timed_out(key, state)`` gives what a state that has timed out emits; it is dropped then.
    """
    names = [f.split(" ")[0] for f in out.split(", ")]

    def run(group: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            emitted = timed_out(group[0], held.get) if timed_out else []
            held.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["_at", tie], kind="stable")
            emitted, new, until = fold(group[0], held.get if held.exists else None, rows)
            if new is None:
                if held.exists:
                    held.remove()
            else:
                held.update(new)
                held.setTimeoutTimestamp(max(int(until * 1000), held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(emitted, columns=names)

    rows = events.withWatermark(ts, delay).withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).select(key, tie, ts, "_at", *columns)
    return rows.groupBy(key).applyInPandasWithState(run, out, state, kind, "EventTimeTimeout")


def _types(events: DataFrame, *columns: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    return ", ".join(f"{c} {kinds[c]}" for c in columns)


def anchored_stream(events: DataFrame, key: str, span_seconds: float, ts: str = "ts", tie: str = "event_id", delay: str = DELAY) -> DataFrame:
    """ST4 to ST6 over a stream; emits key, tie, in_window and opens. A window's state goes when the watermark passes its end."""
    span = round(span_seconds * 1_000_000)

    def fold(k, state, rows):
        opened, count = state or (-1, 0)
        out = []
        for at, i in zip(rows["_at"].tolist(), rows[tie].tolist()):
            opened, count, new = step(opened, count, at, span)
            out.append((k, i, count, new))
        return out, (opened, count), (opened + span) / 1e6

    return _stateful(events, key, [], fold, "append", f"{_types(events, key, tie)}, in_window long, opens boolean", "opened long, count long", ts, tie, delay)


def _when(*order: str) -> Column:
    return F.struct(*order)


#: Statuses that ``segment_ready`` never changes. Fixed values.
SETTLED = ("ready", "partial_ready", "failed")


def current_status(log: DataFrame, key: str = "book_id") -> DataFrame:
    """ST2: key, the status set last (``segment_ready`` after it makes it partial_ready unless it is settled), and the latest duration and audio key that were given."""
    sets = F.col("status") != "segment_ready"
    at = _when("ts", "event_id")
    latest = lambda c, on: F.max_by(F.when(on, F.col(c)), F.when(on, at)).alias(c)
    last = log.groupBy(key).agg(
        F.max_by(F.when(sets, F.col("status")), F.when(sets, at)).alias("set"), F.max(F.when(sets, at)).alias("at"), F.max(F.when(~sets, at)).alias("ready"),
        latest("duration_ms", sets & F.col("duration_ms").isNotNull()), latest("audio_key", sets & F.col("audio_key").isNotNull()))
    base = F.coalesce("set", F.lit("queued"))
    lifted = ~base.isin(*SETTLED) & F.col("ready").isNotNull() & (F.col("at").isNull() | (F.col("ready") > F.col("at")))
    return last.select(key, F.when(lifted, "partial_ready").otherwise(base).alias("status"), "duration_ms", "audio_key")


def progress(log: DataFrame, key: str = "book_id") -> DataFrame:
    """ST3: the latest total above zero (else zero), and the latest done, at most the total where one is known."""
    at = _when("ts", "event_id")
    p = log.groupBy(key).agg(F.max_by(F.when(F.col("total") > 0, F.col("total")), F.when(F.col("total") > 0, at)).alias("total"), F.max_by("done", at).alias("done"))
    total = F.coalesce("total", F.lit(0))
    return p.select(key, total.alias("total"), F.when(total > 0, F.least(total, "done")).otherwise(F.col("done")).alias("done"))


def current_stream(log: DataFrame, key: str = "book_id", idle_days: float = 30, delay: str = DELAY) -> DataFrame:
    """ST2 and ST3 over a stream of events (ts, event_id, status, duration_ms, audio_key, total, done): a row for each key that a micro-batch touches (update mode).

    The clamp of ``done`` is against the total known when it came. State goes after ``idle_days`` without events.
    """

    def fold(k, state, rows):
        status, duration, audio, total, done = state or (None, None, None, 0, None)
        for s, d, a, t, n in zip(*(rows[c].astype(object).where(rows[c].notna(), None).tolist() for c in ("status", "duration_ms", "audio_key", "total", "done"))):
            if s == "segment_ready":
                status = status if status in SETTLED else "partial_ready"
            elif s is not None:
                status, duration, audio = s, duration if d is None else int(d), a or audio
            total = int(t) if t is not None and t > 0 else total
            if n is not None:
                done = min(total, int(n)) if total > 0 else int(n)
        state = (status, duration, audio, total, done)
        return [(k, status or "queued", duration, audio, total, done)], state, rows["_at"].max() / 1e6 + idle_days * DAY

    out = f"{_types(log, key)}, status string, duration_ms int, audio_key string, total int, done int"
    return _stateful(log, key, ["status", "duration_ms", "audio_key", "total", "done"], fold, "update", out, "status string, duration_ms int, audio_key string, total int, done int", "ts", "event_id", delay)


def once_only(log: DataFrame, key: str, part: str) -> DataFrame:
    """ST7: per key, parts ended voiced and failed; a part counts once, and a later voiced one moves it from failed."""
    ended = log.groupBy(key, part).agg(F.bool_or(F.col("status") == "voiced").alias("v"), F.bool_or(F.col("status") == "failed").alias("f"))
    return ended.groupBy(key).agg(F.count_if("v").alias("voiced"), F.count_if(~F.col("v") & F.col("f")).alias("failed"))


def accepted_submissions(log: DataFrame, key: str, submits: Column, ends: Column) -> DataFrame:
    """ST8: submissions while none of that key is live; a terminal event opens the key again."""
    by = Window.partitionBy(key).orderBy("ts", "event_id")
    rows = log.withColumn("_end", F.when(ends, True).when(submits, False)).where("_end IS NOT NULL")
    return rows.withColumn("_last", F.lag("_end").over(by)).where(~F.col("_end") & F.coalesce("_last", F.lit(True))).drop("_end", "_last")


def once_only_stream(log: DataFrame, key: str, part: str, idle_days: float = 30, delay: str = DELAY) -> DataFrame:
    """ST7 over a stream: (key, part, voiced, failed) changes of the counters: 1 or -1 where an event flips its part. Their sums are the counters."""
    names = log.withColumn("_pair", F.struct(key, part))

    def fold(k, state, rows):
        held, out = (state or ("",))[0], []
        for s in rows["status"].tolist():
            if s == "voiced" and held != "voiced":
                out.append((k[key], k[part], 1, -1 if held == "failed" else 0))
                held = "voiced"
            elif s == "failed" and held == "":
                out.append((k[key], k[part], 0, 1))
                held = "failed"
        return out, (held,), rows["_at"].max() / 1e6 + idle_days * DAY

    return _stateful(names, "_pair", ["status"], fold, "append", f"{_types(log, key, part)}, voiced int, failed int", "held string", "ts", "event_id", delay)


def accepted_stream(log: DataFrame, key: str, submits: Column, ends: Column, idle_days: float = 30, delay: str = DELAY) -> DataFrame:
    """ST8 over a stream: (key, event_id) of the submissions that come while none of their key is live."""
    rows = log.withColumn("_end", F.when(ends, True).when(submits, False)).where("_end IS NOT NULL")

    def fold(k, state, rows):
        live, out = bool(state and state[0]), []
        for end, i in zip(rows["_end"].tolist(), rows["event_id"].tolist()):
            if not end and not live:
                out.append((k, i))
            live = not end
        return out, (live,) if live else None, rows["_at"].max() / 1e6 + idle_days * DAY

    return _stateful(rows, key, ["_end"], fold, "append", _types(log, key, "event_id"), "live boolean", "ts", "event_id", delay)


def stuck(log: DataFrame, live: DataFrame, as_of: Column, minutes: int = 60, key: str = "book_id") -> DataFrame:
    """ST9: keys whose latest status is discovering since more than ``minutes``, without a live job."""
    at = _when("ts", "event_id")
    last = log.groupBy(key).agg(F.max_by("status", at).alias("status"), F.max("ts").alias("since"))
    return last.where((F.col("status") == "discovering") & (F.col("since") < as_of - F.make_interval(mins=F.lit(minutes)))).join(live, key, "left_anti")


def stuck_stream(log: DataFrame, live: Column, minutes: int = 60, key: str = "book_id", delay: str = DELAY) -> DataFrame:
    """ST9 over a stream: (key, since) of a key that the watermark finds discovering for ``minutes`` since its last event, if that isn't ``live`` (shows a live job)."""
    rows = log.withColumn("_live", F.coalesce(live, F.lit(False)))

    def fold(k, state, rows):
        last = rows.iloc[-1]
        if last["status"] != "discovering" or last["_live"]:
            return [], None, 0
        return [], (int(last["_at"]),), last["_at"] / 1e6 + minutes * 60

    return _stateful(rows, key, ["status", "_live"], fold, "append", f"{_types(log, key)}, since timestamp", "since long", "ts", "event_id", delay, lambda k, state: [(k, pd.Timestamp(state[0], unit="us"))])


def subscribed(events: DataFrame, book_id, kinds: list[str]) -> DataFrame:
    """ST1: one book's events of some types; works on streams too."""
    return events.where((F.col("book_id") == book_id) & F.col("status").isin(kinds))


def parsed_events(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """SS5: the events in a column of JSON texts; texts that aren't JSON are left out. Works on streams too."""
    return lines.select(F.from_json(value, schema).alias("e"), F.try_parse_json(value).alias("v")).where("v IS NOT NULL").select("e.*")


def event_source(spark, folder: str, schema: str) -> DataFrame:
    """SS5: a stream of JSON events from files, a line each."""
    return parsed_events(spark.readStream.schema("value string").text(folder), schema)
