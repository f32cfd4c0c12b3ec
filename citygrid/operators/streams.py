"""The timing rules as Structured Streaming: keyed state, event-time timers, corrections.

Events may come out of order, inside a batch and between batches, by as much as the
watermark allows; later ones are dropped. A key's state is what all events before the
watermark led to (one typed row) and the events since. What comes is folded in at once
and told; if an event comes late, the events after it are told again. So the last row
told of an event is what the batch twin says of it, and nothing waits for the watermark.
When the watermark has passed a key's last event by the rule's time to live, a timer
clears its state, so state is bounded by what is recent.

A rule folds a key's events of a batch at once, with arrays where it can.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from citygrid.operators import OPERATORS, planned, telemetry
from citygrid.streams import drained

GAP_MS, TTL_MS, DAY_MS = 7_200_000, telemetry.TTL_MS, 86_400_000


@dataclass(frozen=True)
class Rule:
    """``fold(held, events)`` -> held after the events, and for each of them the rows it gives (tuples).

    ``events`` is a frame of one key's events in order of (ms, event_id), ``held`` the typed
    state: a tuple, None where there is none yet.
    """

    key: str
    carried: str  # columns of an event besides ms and event_id, as a schema
    held: str
    told: str
    fold: Callable[[tuple | None, pd.DataFrame], tuple[tuple | None, list[list[tuple]]]]
    keep_ms: int  # how long after a key's last event its state counts
    ahead_ms: int = 0  # what an event tells may change with the next one, if that comes within so long


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")] if schema else []


class Keyed(StatefulProcessor):
    def __init__(self, rule: Rule):
        self.rule, self.columns = rule, ["ms", "event_id", *names(rule.carried)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.rule.held)
        self.tail = handle.getListState("tail", "ms long, event_id long" + (f", {self.rule.carried}" if self.rule.carried else ""))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[self.columns].assign(_new=True)
        known = pd.DataFrame(list(self.tail.get()) if self.tail.exists() else [], columns=self.columns).assign(_new=False)
        events = pd.concat([known, new] if len(known) else [new]).sort_values(["ms", "event_id"], kind="stable").reset_index(drop=True)
        held = self.held.get() if self.held.exists() else None
        old = int((events["ms"] < timerValues.getCurrentWatermarkInMs() - self.rule.ahead_ms).sum())  # nothing comes before these any more
        _, outs = self.rule.fold(held, events)
        held, _ = self.rule.fold(held, events.iloc[:old])
        if held is not None:
            self.held.update(held)
        rest = list(events.iloc[old:][self.columns].itertuples(index=False, name=None))
        self.tail.put([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rest]) if rest else self.tail.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(events["ms"].iloc[-1]) + self.rule.keep_ms)
        first = int(events["_new"].to_numpy().argmax())
        first = max(0, first - 1) if self.rule.ahead_ms else first
        told = names(self.rule.told)
        yield pd.DataFrame({self.rule.key: key[0], "ms": events["ms"].iloc[first:].to_numpy(), "event_id": events["event_id"].iloc[first:].to_numpy(), "told": [[dict(zip(told, r)) for r in rows] for rows in outs[first:]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.tail.clear()
        return iter(())

    def close(self) -> None:
        pass


def keyed(events: DataFrame, rule: Rule, watermark: str) -> DataFrame:
    """-> key, ms, event_id, told: for each event the rows that it gives now. Of rows that tell of one
    event the one of the latest batch counts."""
    kind = {f.name: f.dataType.simpleString() for f in events.schema}[rule.key]
    timed = events.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", watermark)
    struct = "array<struct<" + ", ".join(c.replace(" ", ":", 1) for c in rule.told.split(", ")) + ">>"
    return timed.groupBy(rule.key).transformWithStateInPandas(Keyed(rule), f"{rule.key} {kind}, ms long, event_id long, told {struct}", "Update", "EventTime")


def final(rows: DataFrame, key: str) -> DataFrame:
    """Drained rows of ``keyed`` -> what was told last of each event: key, ms, event_id, told columns."""
    last = rows.groupBy(key, "ms", "event_id").agg(F.max_by("told", "_batch").alias("told"))
    return last.select(key, "ms", "event_id", F.explode("told").alias("t")).select(F.col(key), F.col("ms").alias("at_ms"), F.col("event_id").alias("by_event"), "t.*")


def fold_jobs(held: tuple | None, events: pd.DataFrame) -> tuple[tuple | None, list[list[tuple]]]:
    """Held: newest job's number, its id and progress while it is open. A newer job cancels the open one;
    what comes of older ones, or after a job's end, is ignored."""
    out = []
    newest, job, progress = held or (None, None, None)
    for e in events.itertuples(index=False):
        rows = []
        if newest is None or e.job_no > newest:
            if job is not None:
                rows.append((job, "cancelled", progress, 0))
            newest, job = int(e.job_no), e.job_id
        elif e.job_no < newest or job is None:
            out.append(rows)
            continue
        rows.append((e.job_id, e.status, float(e.progress), 1))
        job, progress = (None, None) if e.status in ("done", "failed") else (e.job_id, float(e.progress))
        out.append(rows)
    return (None if newest is None else (newest, job, progress)), out


def fold_fetches(held: tuple | None, events: pd.DataFrame) -> tuple[tuple | None, list[list[tuple]]]:
    """Held: when was fetched last."""
    ms = events["ms"].to_numpy()
    out: list[list[tuple]] = [[] for _ in ms]
    found, last = telemetry.fetches(ms, (held or (None,))[0])
    for at in found:
        out[at] = [(int(ms[at]),)]
    return (None if last is None else (last,)), out


def fold_starts(held: tuple | None, events: pd.DataFrame, gap: int = GAP_MS) -> tuple[tuple | None, list[list[tuple]]]:
    """Held: the last start. The k-th request starts at k gaps after the latest of all times so far less their gaps."""
    asked = (events["event_type"] != "error").to_numpy()
    ms = events["ms"].to_numpy(np.int64)[asked]
    steps = np.arange(len(ms)) * gap
    start = np.maximum.accumulate(np.maximum(ms - steps, held[0] + gap if held else np.iinfo(np.int64).min)) + steps if len(ms) else ms
    out, given = [], iter(start.tolist())
    for a in asked:
        out.append([(next(given),)] if a else [])
    return ((int(start[-1]),) if len(start) else held), out


def fold_entries(held: tuple | None, events: pd.DataFrame, gap: int = GAP_MS) -> tuple[tuple | None, list[list[tuple]]]:
    """Held: the open entry's first event (ms, event_id), path, edits and last ms. An entry goes on while the
    path stays and gaps are short; each event tells its entry as it is then."""
    if not len(events):
        return held, []
    ms, ids, path = (events[c].to_numpy() for c in ("ms", "event_id", "event_type"))
    before_ms, before_path = np.r_[held[4] if held else ms[0], ms[:-1]], np.r_[np.array([held[2] if held else None], object), path[:-1]]
    starts = (path != before_path) | (ms - before_ms > gap)
    since = np.maximum.accumulate(np.where(starts, np.arange(len(ms)), -1))  # -1: the held entry goes on
    first = [(int(ms[k]), int(ids[k]), 1 - k) if k >= 0 else (held[0], held[1], held[3] + 1) for k in since.tolist()]
    rows = [(m, i, str(p), k + n, int(t)) for k, ((m, i, n), p, t) in enumerate(zip(first, path, ms))]
    return rows[-1], [[r] for r in rows]


def fold_bursts(held: tuple | None, events: pd.DataFrame, gap: int = GAP_MS) -> tuple[tuple | None, list[list[tuple]]]:
    """Held: nothing but that there were events. An event is a burst's last if none follows within the gap."""
    ms = events["ms"].to_numpy(np.int64)
    last = np.r_[np.diff(ms) >= gap, True] if len(ms) else []
    return ((int(ms[-1]),) if len(ms) else held), [[(int(t),)] if e else [] for t, e in zip(ms, last)]


JOBS = Rule("session_id", "job_no long, job_id string, status string, progress double", "newest long, open string, progress double", "job_id string, status string, progress double, own int", fold_jobs, 30 * DAY_MS)
FETCHES = Rule("user_id", "", "last long", "ms long", fold_fetches, TTL_MS)
BURSTS = Rule("user_id", "", "last long", "ms long", fold_bursts, 2 * GAP_MS, GAP_MS)
STARTS = Rule("user_id", "event_type string", "start long", "start_ms long", fold_starts, 30 * DAY_MS)
ENTRIES = Rule("user_id", "event_type string", "first_ms long, first_event long, path string, n long, last_ms long", "first_ms long, first_event long, path string, n long, last_ms long", fold_entries, GAP_MS)


def windows(spans: DataFrame, size: str, slide: str | None, watermark: str) -> DataFrame:
    """Counts, totals and long tasks of each name and window of ``size``; spans later than the watermark are dropped."""
    timed = spans.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", watermark)
    us = F.floor(F.col("duration_ms") * 1000)
    out = timed.groupBy("name", F.window("at", size, slide)).agg(
        F.count("*").alias("n"), F.sum(us).alias("total_us"), F.percentile(us, 0.95).alias("p95"), F.count_if(F.col("duration_ms") >= 50).alias("long_tasks"),
        F.coalesce(F.max(F.when(F.col("duration_ms") >= 50, F.col("duration_ms"))), F.lit(0.0)).alias("longest_ms"),
    )
    return out.select("name", F.unix_millis("window.start").alias("start_ms"), "n", "total_us", "p95", "long_tasks", "longest_ms")


def _newest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*by)).alias("last")).select(*keys, "last.*")


LATE = "1 day"  # in the given tables events come in the order of their numbers, not of their times


@planned("job_status_stream", "stream:jobs jobs", OPERATORS["job_status"].oracle)
def job_status_stream(live: DataFrame, jobs: DataFrame | None = None, late: str = LATE) -> DataFrame:
    """Status of each job: what the last event that told of it says; a cancellation comes before what its event says itself."""
    rows = final(drained(keyed(live, JOBS, late), "update"), "session_id")
    return _newest(rows, ["session_id", "job_id"], ["at_ms", "by_event", "own"]).select("session_id", "job_id", "status", "progress")


@planned("dedupe_ttl_stream", "stream:clicks clicks", OPERATORS["dedupe_ttl"].oracle)
def dedupe_ttl_stream(live: DataFrame, clicks: DataFrame | None = None, late: str = LATE) -> DataFrame:
    """Lookups that no fetch of the last ``TTL_MS`` serves."""
    return final(drained(keyed(live, FETCHES, late), "update"), "user_id").select("user_id", F.col("by_event").alias("event_id"), "ms")


@planned("request_pacing_stream", "stream:clicks clicks", OPERATORS["request_pacing"].oracle)
def request_pacing_stream(live: DataFrame, clicks: DataFrame | None = None, late: str = LATE) -> DataFrame:
    """When each request starts: on arrival, or one gap after the one before; errors are cancelled requests."""
    return final(drained(keyed(live, STARTS, late), "update"), "user_id").select("user_id", F.col("by_event").alias("event_id"), "start_ms")


@planned("coalesce_history_stream", "stream:clicks clicks", OPERATORS["coalesce_history"].oracle)
def coalesce_history_stream(live: DataFrame, clicks: DataFrame | None = None, late: str = LATE) -> DataFrame:
    """Edits as history entries, numbered by their first events; the newest 100 of a user."""
    rows = final(drained(keyed(live, ENTRIES, late), "update"), "user_id")
    whole = rows.groupBy("user_id", "first_ms", "first_event").agg(F.max(F.struct("n", "last_ms", "path")).alias("e"))
    order = [F.col("first_ms"), F.col("first_event")]
    numbered = whole.withColumn("entry", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)).cast("long")).withColumn("newest", F.count("*").over(Window.partitionBy("user_id")))
    return numbered.filter("entry > newest - 100").select("user_id", "entry", "e.path", "e.n", "e.last_ms")


@planned("debounce_stream", "stream:clicks clicks", OPERATORS["debounce"].oracle)
def debounce_stream(live: DataFrame, clicks: DataFrame | None = None, late: str = LATE) -> DataFrame:
    """The last event of each burst without a gap of ``GAP_MS``; one that is still open counts as it is."""
    return final(drained(keyed(live, BURSTS, late), "update"), "user_id").select("user_id", F.col("by_event").alias("event_id"), "ms")


_HOURS = OPERATORS["telemetry_windows"].oracle
@planned("telemetry_windows_stream", "stream:spans spans", f"SELECT name, start_ms, n, total_us, long_tasks, longest_ms FROM ({_HOURS}) w WHERE kind = 'tumbling'")
def telemetry_windows_stream(live: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Tumbling hours in update mode: the last row of a window is the window."""
    rows = drained(windows(live, "1 hour", None, "30 days"), "update")
    return _newest(rows, ["name", "start_ms"], ["_batch"]).select("name", "start_ms", "n", "total_us", "long_tasks", "longest_ms")
