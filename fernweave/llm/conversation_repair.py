"""Conversation structure repair: the cheapest edits to legal turns, by dynamic programming over ranks instead of strings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernweave.llm.common import discard, stash

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: Where a kept turn with this initial leads from a state; what isn't there is no legal order.
_KEPT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
#: Where a made turn leads: after each state one of the roles user and assistant is legal.
_MADE = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
#: Inserts that end a conversation from each state.
_ENDING = ("", "II", "I", "")
_REROLE, _DELETE, _INSERT, _TRUNCATED = 3, 4, 3, 3
_GOOD, _BLANK, _DUPLICATE, _CUT = range(4)
_LEGAL = {"su", "ua", "au"}

#: A front holds (cost, rank) for each state that can be reached, else None. rank is the place of the state's audit
#: string among those of its layer.
Front = tuple[tuple[int, int] | None, ...]


@lru_cache(maxsize=1 << 16)
def advance(front: Front, initial: str, fault: int) -> tuple[Front, int, tuple[tuple[int, str] | None, ...]]:
    """The front after one more turn, with its least cost taken off and given beside it; for each state its parent and code.

    A code is a run of inserts and the turn's own edit. Two inserts lead wherever more of them do. No code begins another
    and all have one layer, so strings of a layer compare as (rank of the parent, code): ranks alone choose among ties.
    """
    best: dict[int, tuple[int, int, str, int]] = {}
    must, more = fault in (_BLANK, _DUPLICATE), _TRUNCATED * (fault == _CUT)
    for state, reached in enumerate(front):
        if reached is None:
            continue
        at, (cost, rank) = state, reached
        for run in range(3):
            edits = [("D", at, _DELETE)]
            if not must:
                edits.append(("R", _MADE[at], _REROLE + more))
                if (at, initial) in _KEPT:
                    edits.append(("K", _KEPT[at, initial], more))
            for edit, to, price in edits:
                new = (cost + _INSERT * run + price, rank, "I" * run + edit, state)
                if to not in best or new < best[to]:
                    best[to] = new
            at = _MADE[at]
    order = {to: i for i, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
    least = min(x[0] for x in best.values())
    return tuple((best[s][0] - least, order[s]) if s in best else None for s in range(4)), least, tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))


def _only(state: int) -> Front:
    return tuple((0, 0) if s == state else None for s in range(4))


def run_turns(turns: list[tuple[str, int, int]], state: int, back: list | None = None) -> tuple[Front, int]:
    """The front after turns (initial, fault, deleted copies), from a state, and the cost to add to it; back gets each layer's parents."""
    front, total = _only(state), 0
    for initial, fault, copies in turns:
        front, least, parents = advance(front, initial, fault)
        total += least + _DELETE * copies
        if back is not None:
            back.append(parents)
    return front, total


def codes(turns: list[tuple[str, int, int]], start: int, end: int) -> list[str]:
    """The code of each turn on the best way from start to end."""
    run_turns(turns, start, back := [])
    out = []
    for parents in reversed(back):
        end, code = parents[end]
        out.append(code)
    return out[::-1]


def finish(costs: list[tuple[int, int] | None]) -> int:
    """The state in which the cheapest legal conversation ends, ties by rank."""
    return min((x[0] + _INSERT * len(_ENDING[s]), x[1], s) for s, x in enumerate(costs) if x is not None)[2]


#: A segment's matrix: for each start and end state the cost and, among the ends of that start, the rank. Flat; -1 is no way.
def matrix(turns: list[tuple[str, int, int]]) -> list[int]:
    out = []
    for state in range(4):
        front, total = run_turns(turns, state)
        for x in front:
            out += (-1, -1) if x is None else (x[0] + total, x[1])
    return out


def _ways(m: list[int], start: int) -> list[tuple[int, int] | None]:
    return [None if m[i] < 0 else (int(m[i]), int(m[i + 1])) for i in range(8 * start, 8 * start + 8, 2)]


def _join(reached: list[tuple[int, int] | None], m: list[int]) -> tuple[list[tuple[int, int] | None], list[int | None]]:
    """Costs and ranks after one more segment, and for each end state the state where that segment began."""
    best: dict[int, tuple[int, int, int, int]] = {}
    for state, own in enumerate(reached):
        if own is None:
            continue
        for end, way in enumerate(_ways(m, state)):
            if way is not None:
                new = (own[0] + way[0], own[1], way[1], state)
                if end not in best or new < best[end]:
                    best[end] = new
    order = {s: i for i, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
    return [(best[s][0], order[s]) if s in best else None for s in range(4)], [best[s][3] if s in best else None for s in range(4)]


def compose(matrices: list[list[int]]) -> list[int]:
    """The matrix of segments one after the other."""
    out = []
    for state in range(4):
        reached = list(_only(state))
        for m in matrices:
            reached, _ = _join(reached, m)
        for x in reached:
            out += (-1, -1) if x is None else x
    return out


def between(matrices: list[list[int]], start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) of each segment on the best way from start to end."""
    reached, back = list(_only(start)), []
    for m in matrices:
        reached, parents = _join(reached, m)
        back.append(parents)
    out = []
    for parents in reversed(back):
        out.append((parents[end], end))
        end = parents[end]
    return out[::-1]


_SEGMENT = "conv {0}, part int, k bigint, seg bigint, whole boolean, m array<bigint>, first string, last string, turn_first {1}, turn_last {1}, turn_least {1}, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, roles array<string>, texts array<string>, faults array<int>, copies array<bigint>"


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _segment(rows: list[tuple]) -> tuple:
    """Of rows (turn, role, text, fault, copies): first and last initial, first, last and least turn, distinct turns, counts, lists."""
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    count = lambda fault: sum(1 + r[4] * (fault == _BLANK) for r in rows if r[3] == fault)
    copies = sum(r[4] for r in rows if r[3] != _BLANK)
    illegal = sum(r[4] for r in rows) + sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))
    return initials[0], initials[-1], turns[0] if turns else None, turns[-1] if turns else None, turns[0] if turns else None, len(set(turns)), count(_BLANK), count(_DUPLICATE) + copies, count(_CUT), illegal, *([r[i] for r in rows] for i in (1, 2, 3, 4))


def _cut(size: int, chars: int):
    """Sorted rows (conv, turn, role, text, fault, copies) to segments; a conversation inside one partition and segment is whole."""
    names = _names(_SEGMENT)
    arrow: dict[str, pa.DataType] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, k, conv, rows, held, waiting, first_run, out = TaskContext.get().partitionId(), 0, 0, None, [], 0, 0, True, []
        fixed = {"part": pa.int32(), "k": pa.int64(), "seg": pa.int64(), "whole": pa.bool_(), "m": pa.list_(pa.int64()), "first": pa.string(), "last": pa.string(), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "faults": pa.list_(pa.int32()), "copies": pa.list_(pa.int64())}

        def close(whole: bool) -> None:
            nonlocal serial, k, rows, held
            kept = _segment(rows)
            m = None if whole else matrix([(r[1][:1], r[3], r[4]) for r in rows])
            out.append((conv, part, k, (part << 32) + serial, whole, m, *kept))
            serial, k, rows, held = serial + 1, k + 1, [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, arrow.get(n, fixed.get(n, pa.int64()))) for n, c in zip(names, columns, strict=True)], names)

        for table in batches:
            for name in ("turn_first", "turn_last", "turn_least"):
                arrow[name] = table.schema.field(1).type
            arrow["conv"] = table.schema.field(0).type
            for own, *row in zip(*(c.to_pylist() for c in table.columns), strict=True):
                if rows and own != conv:
                    close(not first_run and not k)
                    first_run, k = False, 0
                elif len(rows) >= size or held >= chars:
                    close(False)
                conv = own
                rows.append(tuple(row))
                held += len(row[2])
                waiting += len(row[2])
                if out and (waiting >= 4 * chars or len(out) >= 1000):
                    waiting = 0
                    yield batch()
        if rows:
            close(False)
        if out:
            yield batch()

    return run


_FANIN = 256


def _composed(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("ord")
    return pd.DataFrame({"ck": [group["ck"].iloc[0]], "ord": [group["ord"].iloc[0] // _FANIN], "m": [compose(list(group["m"]))]})


def _top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"ck": b["ck"], "ord": b["ord"], "start": _START, "end": [finish(_ways(m, _START)) for m in b["m"]], "final": True})


def _spread(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("ord")
    ways = between(list(group["m"]), group["start"].iloc[0], group["end"].iloc[0])
    final = [False] * (len(group) - 1) + [bool(group["final"].iloc[0])]
    return pd.DataFrame({"ck": group["ck"], "ord": group["ord"], "start": [w[0] for w in ways], "end": [w[1] for w in ways], "final": final})


_CHOSEN = "ck string, ord bigint, start int, end int, final boolean"


def _chosen(pieces: DataFrame) -> DataFrame:
    """(seg, ord, start, end, final) of segments (ck, part, k, seg, m): from which state to which the best way leads through each.

    Matrices are composed up a tree of bounded fan-in, then the choice is carried down; no conversation is in one task.
    """
    counts = pieces.groupBy("ck", "part").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("ck").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = stash(pieces.join(counts.select("ck", "part", before.alias("before")), ["ck", "part"]).select("ck", (F.col("before") + F.col("k")).alias("ord"), "seg", "m"), "pieces")
    levels = [placed.select("ck", "ord", "m")]
    while (levels[-1].agg(F.max("ord")).first()[0] or 0) > 0:
        up = F.floor(F.col("ord") / _FANIN)
        levels.append(stash(levels[-1].withColumn("up", up).groupBy("ck", "up").applyInPandas(_composed, "ck string, ord bigint, m array<bigint>"), "level"))
    chosen = levels[-1].mapInPandas(_top, _CHOSEN)
    for level in reversed(levels[:-1]):
        above = chosen.select("ck", F.col("ord").alias("up"), "start", "end", "final")
        chosen = level.withColumn("up", F.floor(F.col("ord") / _FANIN)).join(above, ["ck", "up"]).groupBy("ck", "up").applyInPandas(_spread, _CHOSEN)
    out = stash(placed.select("ck", "ord", "seg").join(chosen, ["ck", "ord"]).select("seg", "ord", "start", "end", "final"), "chosen")
    discard(placed, *levels[1:])
    return out


def _solved(segment: dict) -> tuple[list[str], int, int]:
    """The codes of a segment's turns, where they lead, and their cost with the inserts that end the conversation there."""
    turns = [(role[:1], fault, copies) for role, fault, copies in zip(segment["roles"], segment["faults"], segment["copies"], strict=True)]
    start, end, final = segment["start"], segment["end"], segment["final"]
    front, total = run_turns(turns, start)
    if end is None:
        end = finish(front)
    return codes(turns, start, end), end, total + front[end][0] + (_INSERT * len(_ENDING[end]) if final else 0)


def _edited(segment: dict, made: list[str], end: int) -> Iterator[tuple[str, str | None, str]]:
    """(edit, role, text) in order; deleted turns have their old role."""
    state = segment["start"]
    for role, text, copies, code in zip(segment["roles"], segment["texts"], segment["copies"], made, strict=True):
        for _ in code[:-1]:
            state = _MADE[state]
            yield "I", _ROLE[state], ""
        edit = code[-1]
        if edit == "K":
            state = _KEPT[state, role[:1]]
        elif edit == "R":
            state = _MADE[state]
        yield edit, _ROLE[state] if edit == "R" else role, text
        for _ in range(copies):
            yield "D", role, text
    for _ in _ENDING[end] if segment["final"] else "":
        state = _MADE[state]
        yield "I", _ROLE[state], ""


def _dicts(batch: pa.RecordBatch) -> Iterator[dict]:
    for at in range(0, batch.num_rows, 64):
        yield from batch.slice(at, 64).to_pylist()


_SOLVED = (*_names(_SEGMENT), "start", "end", "final")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for segment in _dicts(batch):
            made, end, _ = _solved(segment)
            rows = list(_edited(segment, made, end))
            n = len(rows)
            same = [pa.array([segment["conv"]] * n, batch.schema.field(0).type), pa.array([segment["seg"]] * n, pa.int64()), pa.array(range(n), pa.int32())]
            yield pa.RecordBatch.from_arrays([*same, *(pa.array([r[i] for r in rows], pa.string()) for i in range(3))], ["conv_id", "segment", "at", "edit", "role", "text"])


_REPORT = "conv {0}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation, from its segments in order. In memory: one segment, and the audit so far."""
    names, out, now = _names(_REPORT), [], None

    def done() -> tuple:
        gaps = 0 if now["least"] is None else now["most"] - now["least"] + 1 - now["turns"]
        return now["conv"], gaps, *now["counts"], now["cost"], "".join(now["audit"]), now["hash"].hexdigest()

    def table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for segment in _dicts(batch):
            if segment["k"] == 0:
                if now is not None:
                    out.append(done())
                now = {"conv": segment["conv"], "least": None, "most": None, "turns": 0, "counts": [0, 0, 0, 0], "cost": 0, "audit": [], "hash": hashlib.sha256(), "last": None, "any": False}
            made, end, cost = _solved(segment)
            now["counts"] = [a + segment[c] for a, c in zip(now["counts"], ("blank", "duplicate", "truncated", "illegal"), strict=True)]
            if now["last"] is not None and now["last"] + segment["first"] not in _LEGAL:
                now["counts"][3] += 1
            now["last"], now["cost"] = segment["last"], now["cost"] + cost
            if segment["turn_first"] is not None:
                now["turns"] += segment["turns"] - (now["most"] == segment["turn_first"])
                now["least"] = segment["turn_first"] if now["least"] is None else now["least"]
                now["most"] = segment["turn_last"]
            audit, texts = [], []
            for edit, role, text in _edited(segment, made, end):
                audit.append(edit)
                if edit != "D":
                    texts.append(f"{role}:{text}")
            now["audit"].append("".join(audit))
            if texts:
                now["hash"].update((("\n" if now["any"] else "") + "\n".join(texts)).encode("utf-8", "surrogatepass"))
                now["any"] = True
        if len(out) >= 1000:
            yield table(out, kind)
            out = []
    if now is not None:
        out.append(done())
    if out:
        yield table(out, kind)


def repair_conversations(conversations: DataFrame, segment_rows: int = 1024, segment_chars: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """The repaired turns and a report of each conversation, of a table (conv_id, turn, role, text).

    Turns: (conv_id, segment, at, edit, role, text), in the order of segment and at; edit is K, R, D or I for a kept turn,
    one whose role is changed, a deleted one (with its old role) and an inserted empty one. Report: (conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conv_id of the table.

    Rows of a conversation are taken by turn (nulls first), then role and text. Each has at most one fault: blank,
    duplicate (role and text seen earlier), truncated (does not end in `.`, `!` or `?`). The edits are the cheapest that
    give role initials `(s?(ua)+)?`, and of those the least in ASCII order. A conversation is cut into segments; each
    becomes a 4 x 4 matrix of costs and ranks, these are composed in a tree, and each segment then follows its own parent
    pointers. So neither rows nor strings of a long conversation meet in one task; only its report is made by one, which
    streams over the segments, for a digest of a text has to read it in order.

    Equal rows of one turn are counted before they are shuffled. A null role or text is one space; a null conv_id is a
    conversation of its own; other columns are not read; an empty table gives empty results.
    """
    conv_type, turn_type = (conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", space("role").alias("role"), space("text").alias("text"))
    # Equal rows of a turn meet as a count; the others of one role and text only as a digest.
    own = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("who", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    distinct = own = stash(own, "turns")
    seen = own.groupBy(F.col("conv").alias("c"), F.col("who").alias("w")).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("times")).where("times > 1")
    own = own.join(seen, F.col("conv").eqNullSafe(F.col("c")) & (F.col("who") == F.col("w")), "left")
    marks = F.when(~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), _BLANK).when(F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn")), _DUPLICATE).when(~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z")), _CUT).otherwise(_GOOD)
    own = own.select("conv", "turn", "role", "text", marks.alias("fault"), (F.col("n") - 1).alias("copies"))
    ranged = own.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 128)).sortWithinPartitions("conv", "turn", "role", "text")
    segments = stash(ranged.mapInArrow(_cut(segment_rows, segment_chars), _SEGMENT.format(conv_type, turn_type)), "segments")
    discard(distinct)
    ck = F.coalesce(F.concat(F.lit("v"), F.col("conv").cast("string")), F.lit("n"))
    chosen = _chosen(segments.where("not whole").select(ck.alias("ck"), "part", "k", "seg", "m"))
    columns = [c for c in _names(_SEGMENT) if c != "k"]
    whole = segments.where("whole").select(*columns, F.lit(0).cast("bigint").alias("k"), F.lit(_START).alias("start"), F.lit(None).cast("int").alias("end"), F.lit(True).alias("final")).select(*_SOLVED)
    pieces = segments.where("not whole").drop("k").join(chosen.withColumnRenamed("ord", "k"), "seg").select(*_SOLVED)
    turns = whole.unionByName(pieces).mapInArrow(_turns, f"conv_id {conv_type}, segment bigint, at int, edit string, role string, text string")
    ordered = pieces.repartition("conv").sortWithinPartitions("conv", "k")
    report = whole.mapInArrow(_reports, _REPORT.format(conv_type)).unionByName(ordered.mapInArrow(_reports, _REPORT.format(conv_type)))
    every = conversations.select(F.col("conv_id").alias("conv")).distinct()
    return turns, with_unchanged(every, report)


def with_unchanged(conversations: DataFrame, report: DataFrame) -> DataFrame:
    """report with a row of zeros for each conversation (conv) that it has none of."""
    zero = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = conversations.join(report.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")), "left")
    return found.select(
        F.col("conv").alias("conv_id"),
        *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in zero),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
