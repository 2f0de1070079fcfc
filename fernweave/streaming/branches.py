"""The life of a branch as a stream: requests, commits and what becomes of jobs, with the state of each branch and its timer."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fernweave.streaming.incremental import once

#: Columns of the events: each is a request for indexing, a commit that is registered, or a job's end.
EVENTS = "event_id bigint, branch_id bigint, ts timestamp, kind string, commit string"
KINDS = ("request", "commit", "finish", "fail")
DECISIONS = "branch_id bigint, event_id bigint, ts timestamp, decision string, status string, job bigint, commit string"
_DECISION = Row(*(c.split()[0] for c in DECISIONS.split(", ")))
_STATE = "status string, indexed string, head string, wanted string, job bigint, due bigint"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Branch:
    status: str = "NEW"
    #: The commit that is indexed, the newest that is registered, and the one that the job works on.
    indexed: str | None = None
    head: str | None = None
    wanted: str | None = None
    job: int = 0
    #: When the running job counts as lost, in milliseconds; 0 without one.
    due: int = 0


def step(b: Branch, kind: str, commit: str | None) -> tuple[Branch, str]:
    """The branch after an event, and what is decided.

    A request is rejected while a job runs and where the wanted commit is indexed; an indexed or outdated branch gets a new
    job, a failed one its last job again. A new commit makes an indexed branch outdated. A job's end counts while it runs.
    """
    if kind == "request":
        wanted = commit if commit is not None else b.head
        if b.status == "INDEXING":
            return b, "reject"
        if b.status == "INDEXED" and (commit is None or commit == b.indexed):
            return b, "reject"
        decision = "reindex" if b.status == "INDEXED" else "reuse_job" if b.status == "FAILED" and b.job else "new_job"
        return replace(b, status="INDEXING", wanted=wanted, job=b.job + (decision != "reuse_job")), decision
    if kind == "commit":
        stale = b.status == "INDEXED" and commit != b.indexed
        return replace(b, head=commit, status="OUTDATED" if stale else b.status), "outdated" if stale else "noted"
    if kind in ("finish", "fail") and b.status == "INDEXING":
        if kind == "fail":
            return replace(b, status="FAILED", due=0), "failed"
        return replace(b, status="INDEXED", indexed=b.wanted, due=0), "indexed"
    return b, "ignored"


class BranchProcessor(StatefulProcessor):
    """step() for each event of a branch, in order of time within a batch. A job that has not ended in time fails."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("branch", _STATE)

    def _load(self) -> Branch:
        held = self.state.get()
        return Branch() if held is None else Branch(*held)

    def _save(self, b: Branch) -> None:
        self.state.update((b.status, b.indexed, b.head, b.wanted, b.job, b.due))

    def _arm(self, before: Branch, after: Branch) -> None:
        if before.due and before.due != after.due:
            self.handle.deleteTimer(before.due)
        if after.due and before.due != after.due:
            self.handle.registerTimer(after.due)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        loaded = b = self._load()
        for e in sorted(rows, key=lambda e: (e.ts, e.event_id)):
            after, decision = step(b, e.kind, e.commit)
            if after.status == "INDEXING" != b.status:
                after = replace(after, due=int(e.ts.timestamp() * 1000) + self.timeout_ms)
            yield _DECISION(key[0], e.event_id, e.ts, decision, after.status, after.job, after.wanted)
            b = after
        self._arm(loaded, b)
        self._save(b)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        b, at = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        if b.status == "INDEXING" and b.due == at:
            after, _ = step(b, "fail", None)
            self._save(after)
            yield _DECISION(key[0], None, dt.datetime.fromtimestamp(at / 1000, dt.UTC), "timed_out", after.status, after.job, after.wanted)

    def close(self) -> None:
        pass


def decisions(events: DataFrame, timeout: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """DECISIONS for a stream of EVENTS: one row an event, and one (without event_id) for each job that is lost.

    Events sent again within the watermark count once. The session keeps state in RocksDB, which this API asks for; a
    branch's state is one small row, whatever its history. Events are taken in order of time within a batch; a stream
    that starts again from its checkpoint goes on from the states it left.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    each = once(events, late=late)
    timeout_ms = int(pd.Timedelta(timeout).total_seconds() * 1000)
    return each.groupBy("branch_id").transformWithState(statefulProcessor=BranchProcessor(timeout_ms), outputStructType=DECISIONS, outputMode="Append", timeMode="EventTime")
