"""What a running job may do, kept as state in the stream: cap on external calls, circuit breaker, progress, and stalls.

Events of a job (``SCHEMA``), in order of time, then seq:

* ``request``  a picture asks for an external call.  A ``cached`` answer is given at once, costs nothing and proves the provider sound.
* ``answer``   a call came back, ``ok`` or not.
* ``image``    a picture is done; ``total`` is the job's size.

Each gets one row: a request's ``decision`` is ``cached``, ``circuit_open`` (three failures and never a good answer), ``job_limit`` or ``call``; the
other kinds are ``recorded``.  Running counts stand beside it.  A job that is not done and has had no event for ``stall`` gets one row ``stalled``, by a
timer on event time that each event moves on.

``guarded`` keeps one small value for each job in the state store, whose checkpoint makes a restart go on where it was; events older than the
watermark are late and dropped, and a job that pauses for ``stall`` and ``keep`` starts anew.  ``decided`` says the same by windows for a finished log
without such pauses."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming import StatefulProcessor

SCHEMA = "job_id long, seq long, at timestamp, kind string, cached boolean, ok boolean, total long"
OUT = "job_id long, seq long, at timestamp, kind string, decision string, used long, failures long, done long, percent double"
STATE = "used long, failures long, verified boolean, done long, total long, last long, told boolean"
FAILURES = 3
UTC = dt.timezone.utc


def millis(at: dt.datetime) -> int:
    return round(at.timestamp() * 1000)


class Guard(StatefulProcessor):
    """One job's state: counts, and when it was last heard of."""

    def __init__(self, limit: int, stall_ms: int, keep_ms: int):
        self.limit, self.stall, self.keep = limit, stall_ms, keep_ms

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = (0, 0, False, 0, None, None, False)
        used, failures, verified, done, total, last, told = self.state.get() if self.state.exists() else new
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):  # what one micro-batch has of one job
            if last is not None and millis(r.at) > last + self.stall + self.keep:  # its timer may not have come yet
                used, failures, verified, done, total, last, told = new
            decision = "recorded"
            if r.kind == "request":
                if r.cached:
                    decision, verified = "cached", True
                elif not verified and failures >= FAILURES:
                    decision = "circuit_open"
                elif used >= self.limit:
                    decision = "job_limit"
                else:
                    decision, used = "call", used + 1
            elif r.kind == "answer":
                verified, failures = verified or bool(r.ok), failures + (not r.ok)
            elif r.kind == "image":
                done, total = done + 1, r.total if r.total is not None else total
            last, told = max(last or 0, millis(r.at)), False
            yield Row(job_id=key[0], seq=r.seq, at=r.at, kind=r.kind, decision=decision, used=used, failures=failures, done=done, percent=self.percent(done, total))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        finished = total is not None and done >= total
        self.handle.registerTimer(last + (self.keep if finished else self.stall))
        self.state.update((used, failures, verified, done, total, last, told))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        used, failures, verified, done, total, last, told = self.state.get()
        if told or (total is not None and done >= total):
            self.state.clear()
            return
        self.handle.registerTimer(last + self.stall + self.keep)
        self.state.update((used, failures, verified, done, total, last, True))
        yield Row(job_id=key[0], seq=None, at=dt.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000), kind="timer", decision="stalled", used=used, failures=failures, done=done, percent=self.percent(done, total))

    def close(self) -> None:
        pass

    @staticmethod
    def percent(done: int, total: int | None) -> float | None:
        return round(min(100.0, 100.0 * done / total), 2) if total else None


def with_store(spark: SparkSession) -> None:
    """State with timers needs the embedded store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def guarded(events: DataFrame, limit: int, late: str = "10 minutes", stall: dt.timedelta = dt.timedelta(minutes=5), keep: dt.timedelta = dt.timedelta(days=1)) -> DataFrame:
    """Decisions on a stream of events."""
    with_store(events.sparkSession)
    ms = lambda x: int(x.total_seconds() * 1000)
    return (
        events.withWatermark("at", late)
        .groupBy("job_id")
        .transformWithState(statefulProcessor=Guard(limit, ms(stall), ms(keep)), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
    )


def decided(events: DataFrame, limit: int) -> DataFrame:
    """The decisions on a finished log, each event's from those before it.  Jobs are bounded by the size of a batch."""
    order = Window.partitionBy("job_id").orderBy("at", "seq")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    request, answer = F.col("kind") == "request", F.col("kind") == "answer"
    cached = F.coalesce("cached", F.lit(False))
    ok = F.coalesce("ok", F.lit(False))
    count = lambda c, w: F.coalesce(F.sum(c.cast("long")).over(w), F.lit(0))
    seen = events.select(
        "*", (count((request & cached) | (answer & ok), before) > 0).alias("verified"), count(answer & ~ok, before).alias("failed_before"), count(answer & ~ok, upto).alias("failures"),
        count(F.col("kind") == "image", upto).alias("done"), F.last(F.when(F.col("kind") == "image", F.col("total")), True).over(upto).alias("size"),
    )
    open_ = ~F.col("verified") & (F.col("failed_before") >= FAILURES)
    seen = seen.withColumn("asks", request & ~cached & ~open_)
    seen = seen.withColumn("asked", count(F.col("asks"), upto))
    decision: Column = F.when(request & cached, "cached").when(request & open_, "circuit_open").when(request & (F.col("asked") > limit), "job_limit").when(request, "call").otherwise("recorded")
    percent = F.when(F.col("size") > 0, F.round(F.least(F.lit(100.0), 100.0 * F.col("done") / F.col("size")), 2))
    return seen.select("job_id", "seq", "at", "kind", decision.alias("decision"), F.least("asked", F.lit(limit)).cast("long").alias("used"), "failures", "done", percent.alias("percent"))
