"""Event feeds: throttle, debounce, echo suppression, metrics; batch forms and stateful streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from pathledger.streaming.ordered import ordered

THROTTLE_MS = 50
DEBOUNCE_MS = 300
ECHO_TTL_MS = 300_000
STALE_SECONDS = 300
POLL_SECONDS = 30

# Watcher kinds that count, everything else is dropped.
KINDS = {"Create": "Added", "Modify": "Modified", "Remove": "Removed"}


def map_kinds(events: DataFrame, kind: str = "kind") -> DataFrame:
    pairs = [F.lit(x) for kv in KINDS.items() for x in kv]
    return events.withColumn("change", F.create_map(*pairs)[F.col(kind)]).filter("change is not null")


def throttle(events: DataFrame, keys: list[str], ts: str, order: str, gap: int) -> DataFrame:
    """Forward an event if none of its key was forwarded within `gap`; suppressed ones don't extend the timer.

    Greedy and sequential, so a sorted stream of each partition with one number of state: a hot key needs no
    group in memory. ts is a number in the unit of gap.
    """

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for pdf in it:
            keep = []
            for *key, t in zip(*(pdf[k] for k in keys), pdf[ts]):
                if key != now:
                    now, last = key, None
                hit = last is None or t - last >= gap
                last = t if hit else last
                keep.append(hit)
            yield pdf[keep]

    return events.repartition(*keys).sortWithinPartitions(*keys, ts, order).mapInPandas(fold, events.schema)


def debounce(events: DataFrame, keys: list[str], ts: str, gap: int) -> DataFrame:
    """Bursts of events closer than `gap`: start, end, size. One commit follows each."""
    w = W.partitionBy(*keys).orderBy(ts)
    starts = events.withColumn("new", (F.coalesce(F.col(ts) - F.lag(ts).over(w), F.lit(gap)) >= gap).cast("int"))
    numbered = starts.withColumn("burst", F.sum("new").over(w))
    return numbered.groupBy(*keys, "burst").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))


def debounce_stream(events: DataFrame, keys: list[str], ts: str, gap: str = "300 milliseconds", late: str = "1 minute") -> DataFrame:
    """The same as a stream: the session window closes when the watermark passes it."""
    return events.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap)).agg(F.count("*").alias("n"))


def suppress_echo(events: DataFrame, marks: DataFrame, ttl_ms: int = ECHO_TTL_MS) -> DataFrame:
    """Events without those that a mark explains: same path, mtime and content, younger than the TTL. A mark works once.

    events: event_id, path, mtime, pcid, ts_ms. marks: path, mtime, pcid, recorded_ms. The mark that an event meets is
    the last one of its path recorded before it or at the same time (of marks at one time the greatest). The first event that
    matches its mark consumes it; others leave it as it is.
    """
    stamp = F.struct("recorded_ms", "mtime", "pcid")
    tagged = events.select("path", F.col("ts_ms").alias("at"), F.lit(None).cast(marks.select(stamp.alias("m")).schema["m"].dataType).alias("m"), F.struct(*events.columns).alias("e"))
    one = marks.groupBy("path", F.col("recorded_ms").alias("at")).agg(F.max(stamp).alias("m")).withColumn("e", F.lit(None).cast(tagged.schema["e"].dataType))
    w = W.partitionBy("path").orderBy("at", F.col("e").isNotNull(), "e.event_id")
    met = tagged.unionByName(one).withColumn("m", F.last("m", ignorenulls=True).over(w)).filter("e is not null")
    hit = (F.col("e.mtime") == F.col("m.mtime")) & (F.col("e.pcid") == F.col("m.pcid")) & (F.col("at") - F.col("m.recorded_ms") < ttl_ms)
    hit = F.coalesce(hit, F.lit(False))
    nth = F.row_number().over(W.partitionBy("path", "m", hit).orderBy("at", "e.event_id"))
    return met.withColumns({"hit": hit, "nth": nth}).filter("not hit or nth > 1").select("e.*")


def user_changes(events: DataFrame, index: DataFrame, control: str = ".pathledger") -> DataFrame:
    """Without the control folder, temporary files and folder modifications; a removal or changed stat always counts."""
    p = F.col("path")
    cheap = events.filter(~(p.eqNullSafe(control) | p.startswith(control + "/")) & ~F.substring_index("path", "/", -1).rlike(r"^\..+\.ft-tmp$"))
    cheap = cheap.filter(~(F.col("is_dir") & (F.col("kind") == "Modified")))
    i = index.select(F.col("path"), F.col("size").alias("i_size"), F.col("mtime").alias("i_mtime"))
    same = F.col("i_size").eqNullSafe(F.col("size")) & F.col("i_mtime").eqNullSafe(F.col("mtime"))
    return cheap.join(i, "path", "left").filter((F.col("kind") == "Removed") | F.col("i_size").isNull() | ~same).drop("i_size", "i_mtime")


def sync_metrics(events: DataFrame, space: str, kind: str, ts: str) -> DataFrame:
    """Counters and last-seen times per space; the same expression runs on a stream."""
    n = lambda k: F.count_if(F.col(kind) == k)
    last = lambda k: F.max(F.when(F.col(kind) == k, F.col(ts)))
    kinds = ["commit", "pull", "conflict", "feed_error", "stale_alert", "quarantine"]
    return events.groupBy(space).agg(*(n(k).alias(f"{k}s") for k in kinds), last("commit").alias("last_commit"), last("pull").alias("last_pull"))


def space_metrics(events: DataFrame, started_at: int) -> DataFrame:
    """All twelve fields of a space's metrics from its events (space_id, kind, n, ts, cause).

    kind: commit, pull (counts if n files were applied), reconcile (n conflicts), head_seen, feed_error, stale_alert,
    quarantine (with its cause) or recovered. A space is quarantined while nothing recovered since.
    """
    kind, ts = F.col("kind"), F.col("ts")
    n = lambda *k: F.count_if(kind.isin(*k))
    last = lambda *k: F.max(F.when(kind.isin(*k), ts))
    out = events.groupBy("space_id").agg(
        n("commit").alias("commits"), F.count_if((kind == "reconcile") | ((kind == "pull") & (F.col("n") > 0))).alias("pulls_applied"),
        F.coalesce(F.sum(F.when(kind == "reconcile", F.col("n"))), F.lit(0)).alias("conflicts"), n("feed_error").alias("feed_errors"), n("stale_alert").alias("stale_alerts"),
        F.lit(started_at).cast("bigint").alias("started_at"), last("head_seen", "pull", "reconcile").alias("last_head_seen"), last("commit").alias("last_commit"),
        n("quarantine").alias("quarantines"), last("quarantine").alias("last_quarantine"), last("recovered").alias("_up"),
        F.max_by(F.when(kind == "quarantine", F.col("cause")), F.when(kind == "quarantine", ts)).alias("last_quarantine_error"),
    )
    down = F.col("last_quarantine").isNotNull() & (F.col("_up").isNull() | (F.col("_up") < F.col("last_quarantine")))
    return out.withColumn("quarantined", down).drop("_up")


def head_feed(revisions: DataFrame) -> DataFrame:
    """Head per space over an append-only stream of revisions: run in update mode."""
    return revisions.groupBy("space_id").agg(F.max("seq").alias("head_seq"), F.max_by("revision_id", "seq").alias("head_revision"))


def backoff(attempts: DataFrame, first: int = 5, most: int = 300, healthy: int = 60) -> DataFrame:
    """Delay before each retry: doubles up to `most`, starts anew after a run of `healthy` seconds.

    attempts: key, n, ran_seconds. Streaks are numbered, the delay is a power of two: no fold is needed.
    """
    w = W.partitionBy("key").orderBy("n")
    streak = attempts.withColumn("streak", F.sum((F.col("ran_seconds") >= healthy).cast("int")).over(w))
    at = F.row_number().over(W.partitionBy("key", "streak").orderBy("n")) - 1
    return streak.withColumn("delay", F.least(F.lit(first) * F.pow(F.lit(2), F.least(at, F.lit(20))), F.lit(most)).cast("bigint")).drop("streak")


def stale_alerts(seen: DataFrame, space: str, ts: str, limit: int = STALE_SECONDS, now: int | None = None) -> DataFrame:
    """One alert for each silence longer than the limit, at the moment it is due; the last silence lasts until `now`. ts
    in seconds."""
    w = W.partitionBy(space).orderBy(ts)
    return seen.withColumn("next", F.coalesce(F.lead(ts).over(w), F.lit(now))).filter(F.col("next") - F.col(ts) > limit).select(space, (F.col(ts) + limit).alias("alert_at"))


def changed_counters(samples: DataFrame, space: str, order: str, counters: list[str]) -> DataFrame:
    """Watchdog lines: only samples that differ from the one before."""
    w = W.partitionBy(space).orderBy(order)
    now = F.struct(*counters)
    return samples.withColumn("_prev", F.lag(now).over(w)).filter(~F.col("_prev").eqNullSafe(now)).drop("_prev")


def poll_ticks(runs: DataFrame, space: str, order: str, took: str, every: int = POLL_SECONDS) -> DataFrame:
    """When each poll starts: on multiples of `every`; ticks that fall into a run are skipped, not made up for."""
    w = W.partitionBy(space).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    steps = F.greatest(F.ceil(F.col(took) / every), F.lit(1)) * every
    return runs.withColumn("starts_at", F.coalesce(F.sum(steps).over(w), F.lit(0)).cast("bigint"))


def polled(writer, every: int = POLL_SECONDS):
    """A stream's writer on the same schedule: Spark skips missed ticks as well."""
    return writer.trigger(processingTime=f"{every} seconds")


def commit_retries(attempts: DataFrame, first: int = 10, most: int = 300) -> DataFrame:
    """key, n, delay: what follows each commit attempt (key, n, outcome: ok, fault or permanent).

    Consecutive faults double the delay up to `most`, a success starts anew (delay null). A permanent fault ends the
    series: it has no delay, and no later attempt of the key comes out.
    """
    w = W.partitionBy("key").orderBy("n")
    before = F.coalesce(F.sum((F.col("outcome") == "permanent").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    run = F.sum((F.col("outcome") == "ok").cast("int")).over(w)
    at = F.row_number().over(W.partitionBy("key", "run").orderBy("n")) - F.when(F.col("run") > 0, 2).otherwise(1)
    alive = attempts.withColumns({"before": before, "run": run}).filter("before = 0")
    delay = F.least(F.lit(first) * F.pow(F.lit(2), F.least(at, F.lit(20))), F.lit(most)).cast("bigint")
    return alive.select("key", "n", F.when(F.col("outcome") == "fault", delay).alias("delay"))


def changed_counters_stream(samples: DataFrame, space: str, ts: str, order: str, counters: list[str], late: str) -> DataFrame:
    """changed_counters() as a stream ordered by (ts in ms, order): a state of the last counters per space."""

    def fold(last, rows):
        out = []
        for r in rows:
            now = repr(tuple(r[c] for c in counters))
            if last is None or now != last[0]:
                out.append(r)
            last = (now,)
        return last, out

    return ordered(samples, [space], ts, late, fold, "v string", samples.schema, [order])


def cas_stream(attempts: DataFrame, ts: str, late: str) -> DataFrame:
    """revlog.cas_replay() as a stream. attempts: space_id, attempt_no, expected and a time in ms, by which and by attempt_no
    they are ordered -> space_id, attempt_no, accepted, seq. The state of a space is its head."""

    def fold(head, rows):
        now, out = head[0] if head else -1, []
        for r in rows:
            e = r["expected"]
            hit = now == -1 if e is None else now == int(e) and now >= 0
            now += hit
            out.append({"space_id": r["space_id"], "attempt_no": r["attempt_no"], "accepted": bool(hit), "seq": now if hit else None})
        return (now,), out

    kind = attempts.schema["space_id"].dataType
    schema = StructType([StructField("space_id", kind), StructField("attempt_no", LongType()), StructField("accepted", BooleanType()), StructField("seq", LongType())])
    return ordered(attempts, ["space_id"], ts, late, fold, "seq long", schema, ["attempt_no"])


class StaleProcessor(StatefulProcessor):
    """stale_alerts() as a stream: a timer on each space's last sign of life, which the next one takes back."""

    def __init__(self, space: str, ts: str, limit: int):
        self.space, self.ts, self.limit = space, ts, limit * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        last, alerts = self.last.get()[0] if self.last.exists() else None, []
        for pdf in rows:
            for t in sorted(int(x.timestamp() * 1000) for x in pdf[self.ts]):
                if last is not None and t <= last:
                    continue
                if last is not None:
                    self.handle.deleteTimer(last + self.limit)
                    if t - last > self.limit and not (timerValues.getCurrentWatermarkInMs() >= last + self.limit):
                        alerts.append(last + self.limit)
                last = t
        if last is not None:
            self.last.update((last,))
            self.handle.registerTimer(last + self.limit)
        yield self.out(key, alerts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        yield self.out(key, [expiredTimerInfo.getExpiryTimeInMs()])

    def out(self, key, alerts: list[int]) -> pd.DataFrame:
        return pd.DataFrame({self.space: pd.Series([key[0]] * len(alerts), dtype=object if isinstance(key[0], str) else None), "alert_ms": pd.Series(alerts, dtype="int64")})

    def close(self) -> None:
        pass


def stale_alerts_stream(seen: DataFrame, space: str, ts: str, limit: int = STALE_SECONDS, late: str = "0 seconds") -> DataFrame:
    """Alerts (space, alert_ms) once the watermark passes the last sign of life by the limit. ts is a timestamp."""
    kind = seen.schema[space].dataType.simpleString()
    return seen.withWatermark(ts, late).groupBy(space).transformWithStateInPandas(StaleProcessor(space, ts, limit), f"{space} {kind}, alert_ms bigint", "append", "eventTime")


def throttle_stream(events: DataFrame, keys: list[str], ts: str, order: str, gap: int, late: str) -> DataFrame:
    """throttle() as a stream; ts and gap in ms. The state of a key is the time of the last event forwarded."""

    def fold(last, rows):
        now, out = last[0] if last else None, []
        for r in rows:
            if now is None or r[ts] - now >= gap:
                now = int(r[ts])
                out.append(r)
        return (now,), out

    return ordered(events, keys, ts, late, fold, "t long", events.schema, [order])


def suppress_echo_stream(events: DataFrame, late: str, order: list[str] | None = None, ttl_ms: int = ECHO_TTL_MS) -> DataFrame:
    """suppress_echo() as a stream of marks and events of a path (mark: true for a mark; path, mtime, pcid, ts_ms).

    At one time marks come before events, of marks the greatest (mtime, pcid) counts, and events stand in `order`. A mark works
    once or until its TTL is over.
    """

    def fold(mark, rows):
        out = []
        marks = [r for r in rows if r["mark"]]
        if marks:
            last = max(marks, key=lambda r: (r["mtime"], r["pcid"]))
            mark = (int(last["mtime"]), last["pcid"], int(last["ts_ms"]))
        for r in rows:
            if r["mark"]:
                continue
            if mark and r["ts_ms"] - mark[2] >= ttl_ms:
                mark = None
            if mark and mark[0] == r["mtime"] and mark[1] == r["pcid"]:
                mark = None
            else:
                out.append(r)
        return mark, out

    return ordered(events, ["path"], "ts_ms", late, fold, "mtime long, pcid string, recorded_ms long", events.schema, order or [])


class QuietProcessor(StatefulProcessor):
    """A burst ends when nothing has come for `gap` ms of processing time: each event takes the timer back and sets it anew."""

    def __init__(self, keys: list[str], ts: str, gap: int):
        self.keys, self.ts, self.gap = keys, ts, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "first_ms long, last_ms long, n long, due long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        first, last, n, due = self.burst.get() if self.burst.exists() else (None, None, 0, None)
        for pdf in rows:
            if len(pdf):
                low, high = int(pdf[self.ts].min()), int(pdf[self.ts].max())
                first, last, n = low if first is None else min(first, low), high if last is None else max(last, high), n + len(pdf)
        if due is not None:
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.gap
        self.handle.registerTimer(due)
        self.burst.update((first, last, n, due))
        yield self.out(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        first, last, n, _ = self.burst.get()
        self.burst.clear()
        yield self.out(key, [(first, last, n)])

    def out(self, key, bursts: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *b) for b in bursts], columns=[*self.keys, "first_ms", "last_ms", "n"])

    def close(self) -> None:
        pass


def quiet_bursts_stream(events: DataFrame, keys: list[str], ts: str, gap: int = DEBOUNCE_MS) -> DataFrame:
    """keys, first_ms, last_ms, n: one commit for each burst, `gap` ms after its last event came, whether or not another follows.

    Unlike debounce_stream() it waits by the clock and not for a later event. Run it with a processing-time trigger.
    """
    schema = StructType([*(events.schema[k] for k in keys), *(StructField(c, LongType()) for c in ("first_ms", "last_ms", "n"))])
    return events.groupBy(*keys).transformWithStateInPandas(QuietProcessor(keys, ts, gap), schema, "append", "processingTime")


def seconds(ts: str) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))
