"""Stateful operators: each as a batch fold or window, and where it runs on streams, as a query with state.

The stream forms add what an unbounded input needs: watermarks, timers, bounded state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WINDOW_SEC, LIMIT = 300, 30
TTL_SEC, RING = 1800, 10
CAP, RESERVE, DEFAULT_COST = 3.0, 0.60, 0.10
#: A row that waits for the watermark.
WAITING = np.dtype([("ts_ms", np.int64), ("row_id", np.int64), ("failed", np.bool_)])


def rate_limit(requests: DataFrame, key: str, ts: str, request_id: str, limit: int = LIMIT, window_sec: int = WINDOW_SEC) -> DataFrame:
    """(request_id, admitted, retry_after): a fixed window for each key, anchored at its first request.

    A request at ``window_sec`` or later opens a new window; beyond ``limit`` in a window it is rejected and
    does not extend it; a limit of zero or less admits all. The anchors depend on the data, so requests of
    one key are folded in order: they are sorted by the shuffle, and folded a batch at a time.
    """
    if limit <= 0:
        return requests.select(F.col(request_id).alias("request_id"), F.lit(True).alias("admitted"), F.lit(0.0).alias("retry_after"))
    rows = requests.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(request_id).alias("request_id"))
    width = window_sec * 1_000_000

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, start, n = object(), 0, 0
        for rows in batches:
            ok, wait = [], []
            for k, t in zip(rows["k"], rows["t"]):
                if k != last or t - start >= width:
                    last, start, n = k, t, 0
                admitted = n < limit
                n += admitted
                ok.append(admitted)
                wait.append(0.0 if admitted else max(0, width - (t - start)) / 1e6)
            yield pd.DataFrame({"request_id": rows["request_id"], "admitted": ok, "retry_after": wait})

    kind = rows.schema["request_id"].dataType.simpleString()
    return rows.repartition("k").sortWithinPartitions("k", "t", "request_id").mapInPandas(fold, f"request_id {kind}, admitted boolean, retry_after double")


class RateLimiter(StatefulProcessor):
    """The stream form: the state of a key is its window's start and count; it expires when no request came for a window's length."""

    def __init__(self, limit: int = LIMIT, window_sec: int = WINDOW_SEC):
        self.limit, self.window_ms = limit, window_sec * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "start long, n int", self.window_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, n = self.state.get() if self.state.exists() else (None, 0)
        batch = pd.concat(list(rows)).sort_values(["ts_ms", "request_id"])
        out = []
        for t, r in zip(batch["ts_ms"], batch["request_id"]):
            if start is None or t - start >= self.window_ms:
                start, n = int(t), 0
            admitted = n < self.limit
            n += admitted
            out.append((key[0], r, bool(admitted)))
        self.state.update((start, n))
        yield pd.DataFrame(out, columns=["key", "request_id", "admitted"])

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, limit: int = LIMIT, window_sec: int = WINDOW_SEC) -> DataFrame:
    """requests(key, request_id, ts_ms) as a stream: (key, request_id, admitted)."""
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    return requests.groupBy("key").transformWithStateInPandas(
        RateLimiter(limit, window_sec), f"key {kinds['key']}, request_id {kinds['request_id']}, admitted boolean", "Append", "ProcessingTime"
    )


def last_turns(turns: DataFrame, key: str, order: str, n: int = RING) -> DataFrame:
    """The last n turns of each conversation; the window keeps n rows a group while it is computed."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return turns.withColumn("from_end", place).where(F.col("from_end") <= n)


def sessions(events: DataFrame, key: str, ts: str, idle: str = "30 minutes") -> DataFrame:
    """(key, start, last, n): runs of a key's events with gaps of at most ``idle`` (an event exactly that late still belongs)."""
    by = Window.partitionBy(key).orderBy(ts)
    gap = F.col(ts) > F.lag(ts).over(by) + F.expr(f"INTERVAL {idle}")
    rows = events.select(key, ts, F.coalesce(gap, F.lit(True)).cast("int").alias("new"))
    rows = rows.withColumn("session", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n")).drop("session")


def sessions_stream(events: DataFrame, key: str, ts: str, idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The stream form: session windows behind a watermark."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, idle).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("last")).drop("w")


def last_write(records: DataFrame, key: str, order: str, cap: int = 200) -> DataFrame:
    """The latest record of each key, newest first, ``cap`` of them at most: a fold by aggregation, without a sort of all records."""
    kept = records.groupBy(key).agg(F.max_by(F.struct(*records.columns), order).alias("r")).select("r.*")
    return kept.orderBy(F.col(order).desc()).limit(cap)


def daily_budget(charges: DataFrame, ts: str, order: str, cost: Column, cap: float = CAP, reserve: float = RESERVE) -> DataFrame:
    """Adds ``before`` (spent earlier that UTC day), ``over_cap`` and ``over_admin``: every request is charged, the check comes first."""
    by = Window.partitionBy("day").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = charges.withColumn("day", F.to_date(ts)).withColumn("cost", cost)
    rows = rows.withColumn("before", F.coalesce(F.sum("cost").over(by), F.lit(0.0)))
    return rows.withColumn("over_cap", F.col("before") >= cap).withColumn("over_admin", F.col("before") >= cap - reserve)


def admitted_budget(charges: DataFrame, ts: str, order: str, request_id: str, cost: Column, cap: float = CAP) -> DataFrame:
    """(request_id, admitted): only admitted requests are charged, so each answer depends on those before: a fold over each day in order."""
    rows = charges.select(F.to_date(ts).cast("string").alias("day"), F.col(order).alias("o"), F.col(request_id).alias("request_id"), cost.cast("double").alias("cost"))

    def fold(batches):
        day, spent = None, 0.0
        for rows in batches:
            out = []
            for d, c in zip(rows["day"], rows["cost"]):
                if d != day:
                    day, spent = d, 0.0
                ok = spent < cap
                spent += c if ok else 0.0
                out.append(ok)
            yield pd.DataFrame({"request_id": rows["request_id"], "admitted": out})

    return rows.repartition("day").sortWithinPartitions("day", "o").mapInPandas(fold, f"request_id {rows.schema['request_id'].dataType.simpleString()}, admitted boolean")


def spend_cutoff(calls: DataFrame, order: str, usd: str, cap: float, group: list[str] = ()) -> DataFrame:
    """Calls up to and including the one whose running sum first exceeds the cap."""
    by = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("spent_before", F.coalesce(F.sum(usd).over(by), F.lit(0.0))).where(F.col("spent_before") <= cap)


def debounced(deltas: DataFrame, key: str, ts: str, delta: str, every: str = "5 minutes") -> DataFrame:
    """(key, slot, delta): deltas of a key flushed together once a slot; on a stream the sums are emitted behind a watermark."""
    rows = deltas.withWatermark(ts, every) if deltas.isStreaming else deltas
    return rows.groupBy(key, F.window(ts, every).alias("w")).agg(F.sum(delta).alias("delta")).select(key, F.col("w.start").alias("slot"), "delta")


def peak_overlap(intervals: DataFrame, start: str, end: str, group: list[str]) -> DataFrame:
    """(group, peak): the most intervals open at once; an end frees its place before a start at the same time takes one."""
    edges = intervals.select(*group, F.col(start).alias("t"), F.lit(1).alias("d")).unionByName(intervals.select(*group, F.col(end).alias("t"), F.lit(-1).alias("d")))
    by = Window.partitionBy(*group).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    return edges.withColumn("open", F.sum("d").over(by)).groupBy(*group).agg(F.max("open").alias("peak"))


def sse_frames(answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, seq, event, data): a sources frame, one token frame for each word with its white space, a done frame."""
    tokens = F.regexp_extract_all(text_col, F.lit(r"\s*\S+\s*"), F.lit(0))
    frame = lambda event, data: F.struct(F.lit(event).alias("event"), data.alias("data"))
    frames = F.concat(
        F.array(frame("sources", F.to_json(F.struct(F.col(id_col).cast("string").alias("id"))))),
        F.transform(tokens, lambda t: frame("token", t)),
        F.array(frame("done", F.lit("{}"))),
    )
    return answers.select(F.col(id_col).alias("id"), F.posexplode(frames).alias("seq", "f")).select("id", "seq", "f.event", "f.data")


def two_phase(retrieved: DataFrame, verified: DataFrame, id_col: str = "query_id") -> DataFrame:
    """(id, phase, seq, payload): for each query its sources first, then its verified answer; a query whose gate refused has both at once, the answer from the gate.

    ``retrieved``: id, sources, refused, refusal; ``verified``: id, answer. Only verified text is ever sent.
    """
    first = retrieved.select(id_col, F.lit("sources_ready").alias("phase"), F.lit(0).alias("seq"), F.to_json("sources").alias("payload"))
    rows = retrieved.join(verified.select(id_col, "answer"), id_col, "left")
    last = rows.select(id_col, F.lit("done").alias("phase"), F.lit(1).alias("seq"), F.when(F.col("refused"), F.col("refusal")).otherwise(F.col("answer")).alias("payload"))
    return first.unionByName(last)


#: Seconds without a frame before a sign of life is sent, and without a read before a stream is closed (fixed values).
HEARTBEAT, IDLE = 15, 45


def heartbeats(frames: DataFrame, key: str, ts: str, interval: int = HEARTBEAT) -> DataFrame:
    """(key, ts, kind): the frames of each stream, and a ``ping`` after every ``interval`` seconds of a gap between two of them."""
    after = F.lead(ts).over(Window.partitionBy(key).orderBy(ts))
    gap = (F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6
    pings = frames.withColumn("_n", F.coalesce(F.floor((gap - 1e-6) / interval), F.lit(0)).cast("int")).where("_n > 0")
    pings = pings.select(key, F.explode(F.sequence(F.lit(1), "_n")).alias("_k"), F.col(ts).alias("_t")).select(key, F.expr(f"_t + make_interval(0, 0, 0, 0, 0, 0, _k * {interval})").alias(ts), F.lit("ping").alias("kind"))
    return frames.select(key, ts, F.lit("frame").alias("kind")).unionByName(pings)


def idle_cut(reads: DataFrame, key: str, ts: str, timeout: int = IDLE) -> DataFrame:
    """Reads of each stream up to the first gap of more than ``timeout`` seconds: there the stream is closed."""
    by = Window.partitionBy(key).orderBy(ts)
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(by).cast("timestamp"))) / 1e6
    late = F.coalesce((seconds > timeout).cast("int"), F.lit(0))
    return reads.withColumn("_late", late).withColumn("_cut", F.max("_late").over(by.rowsBetween(Window.unboundedPreceding, 0))).where("_cut = 0").drop("_late", "_cut")


def admitted_streams(opened: DataFrame, key: list[str], start: str, end: str, order: str, most: int = 6) -> DataFrame:
    """Adds ``admitted``: a stream is refused while ``most`` admitted ones of its gate (``key``) are open. A gate works one after another: its rows are one fold."""

    def run(rows):
        import heapq

        rows = rows.sort_values([start, order])
        open_, out = [], []
        for s, e in zip(rows[start], rows[end]):
            while open_ and open_[0] <= s:
                heapq.heappop(open_)
            out.append(len(open_) < most)
            if out[-1]:
                heapq.heappush(open_, e)
        return rows.assign(admitted=out)

    return opened.groupBy(*key).applyInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in opened.schema), "admitted boolean"]))


class PendingFailures(StatefulProcessor):
    """Failures and successes of a key in the order of their times, however they arrive.

    Rows wait in the key's state, an entry for each batch, until the watermark has passed them. There is one timer for the
    first row of what came or was left at once; it takes all that are due, in order. A success that finds no pending failure
    counts; otherwise it clears one. What a key holds is the rows that are not due yet and one counter.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.pending = handle.getValueState("pending", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            if len(batch):
                self._hold(np.rec.fromarrays([batch[c].to_numpy() for c in WAITING.names], dtype=WAITING))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [np.frombuffer(x[0], WAITING) for x in self.waiting.get()]
        if not rows:
            return iter(())
        rows = np.concatenate(rows)
        past = rows["ts_ms"] <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self.waiting.clear()
        if not past.all():
            self._hold(rows[~past])
        due = np.sort(rows[past], order=["ts_ms", "row_id"])
        n = self.pending.get()[0] if self.pending.exists() else 0
        # the counter never falls below zero: the free walk over its running minimum
        walk = np.concatenate([[n], n + np.cumsum(np.where(due["failed"], 1, -1))])
        counter = walk - np.minimum(0, np.minimum.accumulate(walk))
        self.pending.update((int(counter[-1]),))
        return iter([pd.DataFrame({"key": [key[0]] * len(due), "row_id": due["row_id"], "success": ~due["failed"] & (counter[:-1] == 0)})] if len(due) else [])

    def _hold(self, rows: np.ndarray) -> None:
        self.waiting.appendValue((rows.tobytes(),))
        self.handle.registerTimer(int(rows["ts_ms"].min()))

    def close(self) -> None:
        pass


def pending_failures_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """events(key, row_id, ts, failed) as a stream: (key, row_id, success), as ``governance.pending_successes`` has them for the
    rows in the order of (ts, row_id), for rows that are at most ``late`` behind. Rows come out when the watermark has passed them."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    rows = events.withColumn("ts_ms", F.unix_millis("ts")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(PendingFailures(), f"key {kinds['key']}, row_id long, success boolean", "Append", "EventTime")


class Heartbeats(StatefulProcessor):
    """Frames of a stream passed on, a ping whenever none was sent for the interval, and its end when none came for the timeout.

    Both are timers on the clock of the machine. A frame after the end opens the stream anew.
    """

    def __init__(self, interval_ms: int, idle_ms: int):
        self.interval_ms, self.idle_ms = interval_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "read_ms long, sent_ms long, seq long")

    def _restart(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        seq = self.state.get()[2] if self.state.exists() else 0
        data = pd.concat(list(rows)).sort_values("frame_id")
        self._restart()
        self.handle.registerTimer(now + self.interval_ms)
        self.state.update((now, now, seq + len(data)))
        yield pd.DataFrame({"key": key[0], "seq": range(seq, seq + len(data)), "kind": "frame", "frame_id": data["frame_id"].to_numpy(), "at_ms": now})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        read, _, seq = self.state.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        kind = "closed" if at - read >= self.idle_ms else "ping"
        if kind == "closed":
            self.state.clear()
        else:
            self.state.update((read, at, seq + 1))
            self.handle.registerTimer(min(at + self.interval_ms, read + self.idle_ms))
        yield pd.DataFrame({"key": [key[0]], "seq": [seq], "kind": [kind], "frame_id": [None], "at_ms": [at]})

    def close(self) -> None:
        pass


def heartbeats_stream(frames: DataFrame, interval_sec: float = HEARTBEAT, idle_sec: float = IDLE) -> DataFrame:
    """frames(key, frame_id) as a stream: (key, seq, kind, frame_id, at_ms), kind ``frame``, ``ping`` or ``closed``, numbered in each stream."""
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    return frames.groupBy("key").transformWithStateInPandas(
        Heartbeats(int(interval_sec * 1000), int(idle_sec * 1000)), f"key {kinds['key']}, seq long, kind string, frame_id long, at_ms long", "Append", "ProcessingTime"
    )
