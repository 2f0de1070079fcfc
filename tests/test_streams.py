"""Streams that start again from their checkpoints: late and doubled events, branches with timers, snapshots with bounded state."""

import datetime as dt
import os
import random

import pytest

from fernweave.streaming import branches, incremental

T0 = dt.datetime(2024, 1, 1)
minute = lambda m: T0 + dt.timedelta(minutes=m)


class Feed:
    """A folder of files, a stream over it, and what came out, batch by batch."""

    def __init__(self, spark, tmp_path, schema, plan):
        self.spark, self.schema, self.plan = spark, schema, plan
        self.folder, self.out, self.check = (str(tmp_path / x) for x in ("in", "out", "check"))
        self.n = 0

    def send(self, rows):
        self.n += 1
        path = f"{self.folder}/part{self.n}"
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(path)

    def run(self):
        stream = incremental.file_stream(self.spark, f"{self.folder}/*", self.schema, files_per_batch=1)
        incremental.run_once(self.plan(stream), lambda b, i: b.write.mode("overwrite").parquet(f"{self.out}/batch={i}"), self.check)

    def rows(self):
        return self.spark.read.parquet(self.out).drop("batch").collect() if os.path.isdir(self.out) else []


def test_late_and_doubled_events(spark, tmp_path):
    feed = Feed(spark, tmp_path, "event_id long, ts timestamp, event_type string", lambda s: incremental.counts_once(s, window="10 minutes", late="10 minutes"))
    feed.send([(1, minute(1), "a"), (2, minute(5), "a"), (1, minute(1), "a"), (3, minute(12), "b")])
    feed.run()
    feed.send([(2, minute(5), "a"), (4, minute(3), "a"), (5, minute(40), "a")])
    feed.run()
    # By now the watermark is at 30 minutes: what belongs before is too late.
    feed.send([(6, minute(2), "a"), (7, minute(41), "a"), (5, minute(40), "a")])
    feed.send([(8, minute(90), "end")])
    feed.run()
    got = {(r.window.start, r.event_type): r.n for r in feed.rows()}
    assert got == {(minute(0), "a"): 3, (minute(10), "b"): 1, (minute(40), "a"): 2}


def play(events):
    """Decisions of whole histories, one branch after the other."""
    states, out = {}, []
    for event_id, branch, ts, kind, commit in sorted(events, key=lambda e: (e[2], e[0])):
        states[branch], decision = branches.step(states.get(branch, branches.Branch()), kind, commit)
        out.append((event_id, decision, states[branch].status, states[branch].job))
    return sorted(out)


def test_branches_over_restarts(spark, tmp_path):
    rng = random.Random(1)
    events = [(i, rng.randrange(6), minute(i), rng.choice(branches.KINDS), rng.choice([None, "c1", "c2"])) for i in range(240)]
    feed = Feed(spark, tmp_path, branches.EVENTS, lambda s: branches.decisions(s, timeout="100 days"))
    for at in range(0, 240, 60):
        part = events[at : at + 60]
        feed.send(rng.sample(part, 60) + part[:5] + events[max(0, at - 3) : at])
        if at != 60:
            feed.run()
    assert sorted((r.event_id, r.decision, r.status, r.job) for r in feed.rows()) == play(events)


def test_a_lost_job_fails_and_its_job_is_used_again(spark, tmp_path):
    feed = Feed(spark, tmp_path, branches.EVENTS, lambda s: branches.decisions(s, timeout="30 minutes", late="0 minutes"))
    feed.send([(1, 7, minute(0), "request", "c1"), (2, 8, minute(0), "request", "c1"), (3, 8, minute(5), "finish", None)])
    feed.run()
    feed.send([(4, 9, minute(60), "commit", "c1")])
    feed.run()
    feed.send([(5, 7, minute(61), "finish", None), (6, 7, minute(62), "request", None), (7, 8, minute(63), "request", "c1"), (8, 8, minute(64), "commit", "c2"), (9, 8, minute(65), "request", None)])
    feed.run()
    got = sorted(((r.branch_id, r.ts, r.decision, r.status, r.job) for r in feed.rows()), key=lambda r: (r[0], r[1]))
    assert got == [
        (7, minute(0), "new_job", "INDEXING", 1),
        (7, minute(30), "timed_out", "FAILED", 1),
        (7, minute(61), "ignored", "FAILED", 1),
        (7, minute(62), "reuse_job", "INDEXING", 1),
        (8, minute(0), "new_job", "INDEXING", 1),
        (8, minute(5), "indexed", "INDEXED", 1),
        (8, minute(63), "reject", "INDEXED", 1),
        (8, minute(64), "outdated", "OUTDATED", 1),
        (8, minute(65), "new_job", "INDEXING", 2),
        (9, minute(60), "noted", "NEW", 0),
    ]


SNAPSHOT = "snapshot long, n_files long, relative_path string, content_hash string"


def test_snapshots_keep_no_more_than_they_need(spark, tmp_path):
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    handle = incremental.snapshot_handler(state, out)
    rows = lambda n, *files, of=None: spark.createDataFrame([(n, of or len(files), f, f"{n}{f}" if f != "same" else "h") for f in files], SNAPSHOT)
    changes = lambda n: {(r.relative_path, r.change) for r in spark.read.parquet(f"{out}/snapshot={n}").collect()}
    kept = lambda: sorted(p for p in os.listdir(state) if not p.startswith(".") and (p.startswith("whole") or any(x.startswith("snapshot") for x in os.listdir(f"{state}/{p}"))))
    handle(rows(1, "a", "same"), 0)
    assert kept() == ["whole=1-0"] and changes(1) == {("a", "added"), ("same", "added")}
    handle(rows(2, "a", of=2), 1)
    handle(rows(3, "b"), 2)
    assert kept() == ["batch=1", "batch=2", "whole=1-0"] and not os.path.isdir(f"{out}/snapshot=3")
    handle(rows(2, "same", of=2), 3)
    assert kept() == ["whole=3-3"]
    assert changes(2) == {("a", "modified"), ("same", "unchanged")} and changes(3) == {("a", "deleted"), ("same", "deleted"), ("b", "added")}
    # The last batch again, as after a failure, and then a row that comes too late.
    handle(rows(2, "same", of=2), 3)
    assert kept() == ["whole=3-3"] and changes(3) == {("a", "deleted"), ("same", "deleted"), ("b", "added")}
    with pytest.raises(ValueError, match="older than 3"):
        handle(rows(2, "z", of=9), 4)
    handle(spark.createDataFrame([], SNAPSHOT), 5)


def test_a_branch_costs_one_read_and_one_write_of_state():
    from types import SimpleNamespace

    from pyspark.sql import Row

    calls, held = [], {}

    class State:
        def get(self):
            calls.append("get")
            return held.get("branch")

        def exists(self):
            calls.append("exists")
            return "branch" in held

        def update(self, value):
            calls.append("update")
            held["branch"] = value

    timers = SimpleNamespace(registerTimer=lambda at: calls.append("register"), deleteTimer=lambda at: calls.append("delete"))
    processor = branches.BranchProcessor(60_000)
    processor.init(SimpleNamespace(getValueState=lambda *a: State(), **vars(timers)))
    event = lambda i, kind, commit=None: Row(event_id=i, branch_id=7, ts=minute(i).replace(tzinfo=dt.UTC), kind=kind, commit=commit)
    first = list(processor.handleInputRows((7,), iter([event(2, "finish"), event(1, "request", "c1")]), None))
    assert [(r.event_id, r.decision, r.status, r.job, r.commit) for r in first] == [(1, "new_job", "INDEXING", 1, "c1"), (2, "indexed", "INDEXED", 1, "c1")]
    assert calls == ["get", "update"]
    second = list(processor.handleInputRows((7,), iter([event(3, "commit", "c2"), event(4, "request")]), None))
    assert [r.decision for r in second] == ["outdated", "new_job"] and calls == ["get", "update"] + ["get", "register", "update"]
