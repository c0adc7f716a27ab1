"""Running state of jobs in a stream: the same decisions as on the finished log, over restarts, late rows and stalls."""

import datetime as dt
import random

import pytest

from parcelmill.streaming import guard

START = dt.datetime(2024, 5, 1)


def events(seed=1, jobs=5, n=160):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        job = rng.randrange(jobs)
        kind = rng.choice(["request", "request", "answer", "image"])
        cached = kind == "request" and job != 3 and rng.random() < 0.05
        ok = None if kind != "answer" else rng.random() < (0.0 if job in (1, 3) else 0.5)
        rows.append((job, seq, START + dt.timedelta(seconds=seq // 2), kind, cached if rng.random() < 0.9 or cached else None, ok, 6 if kind == "image" else None))
    return rows


class Stream:
    """A folder of events that is read to its end, again and again, from one checkpoint."""

    def __init__(self, spark, folder, limit=8, **more):
        self.spark, self.folder, self.limit, self.more = spark, folder, limit, more
        (folder / "in").mkdir()

    def feed(self, rows):
        self.spark.createDataFrame(rows, guard.SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        got = []
        stream = self.spark.readStream.schema(guard.SCHEMA).parquet(f"{self.folder}/in")
        out = guard.guarded(stream, self.limit, **self.more)
        query = out.writeStream.foreachBatch(lambda df, n: got.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return got


def test_restarts_decide_as_the_whole_log(spark, tmp_path):
    rows = events()
    stream = Stream(spark, tmp_path)
    got = []
    for k in range(0, len(rows), 60):  # each is a new query that goes on from the checkpoint
        got += stream.feed(rows[k : k + 60])
    want = sorted(map(tuple, guard.decided(spark.createDataFrame(rows, guard.SCHEMA), 8).collect()), key=lambda r: r[1])
    assert sorted(got, key=lambda r: r[1]) == want
    assert {"call", "cached", "circuit_open", "job_limit", "recorded"} == {r[4] for r in want}
    assert max(r[8] for r in want if r[8] is not None) == 100.0


def test_late_rows_and_stalls(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    request = lambda job, seq, s: (job, seq, at(s), "request", False, None, None)
    image = lambda job, seq, s, total: (job, seq, at(s), "image", None, None, total)
    stream = Stream(spark, tmp_path, limit=2, late="60 seconds", stall=dt.timedelta(seconds=120), keep=dt.timedelta(seconds=600))
    first = stream.feed([request(1, 1, 0), image(2, 2, 0, 1), image(3, 3, 100, 5), request(9, 4, 200)])
    decisions = [(r[0], r[4]) for r in first]
    assert sorted(decisions) == [(1, "call"), (1, "stalled"), (2, "recorded"), (3, "recorded"), (9, "call")]  # 2 is done
    second = stream.feed([request(1, 5, 30), request(3, 6, 150), request(9, 7, 300)])
    # The row of second 30 is behind the watermark (140) and dropped; job 3 within it and taken.
    assert sorted((r[0], r[1], r[4]) for r in second if r[4] != "stalled") == [(3, 6, "call"), (9, 7, "call")]
    third = stream.feed([request(1, 8, 400), request(9, 9, 401), request(9, 10, 5000)])
    by = {r[1]: (r[4], r[5]) for r in third if r[1]}
    assert by == {8: ("call", 2), 9: ("job_limit", 2), 10: ("call", 1)}  # job 1 was told of, but its state stayed; 9 paused for too long
    assert {r[0] for r in third if r[4] == "stalled"} >= {3}
    fourth = stream.feed([request(1, 11, 9000)])
    assert (1, 11, "call", 1) in {(r[0], r[1], r[4], r[5]) for r in fourth}  # its state went after ``keep``


@pytest.mark.parametrize("limit", [0, 1, 100])
def test_windows_against_a_plain_walk(spark, limit):
    rows = events(seed=4)
    state, want = {}, {}
    for job, seq, at, kind, cached, ok, total in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        s = state.setdefault(job, {"used": 0, "bad": 0, "good": False})
        decision = "recorded"
        if kind == "request":
            decision = "cached" if cached else "circuit_open" if not s["good"] and s["bad"] >= 3 else "job_limit" if s["used"] >= limit else "call"
            s["used"] += decision == "call"
            s["good"] |= decision == "cached"
        elif kind == "answer":
            s["good"] |= bool(ok)
            s["bad"] += not ok
        want[seq] = (decision, s["used"], s["bad"])
    got = {r.seq: (r.decision, r.used, r.failures) for r in guard.decided(spark.createDataFrame(rows, guard.SCHEMA), limit).collect()}
    assert got == want
