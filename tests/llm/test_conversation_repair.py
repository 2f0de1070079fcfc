"""Conversation repair against a search over whole audit strings; odd tables; conversations that many tasks share."""

import hashlib
import itertools
import random

import pytest

from fernweave.llm import conversation_repair as cr

SPACES = " \t\n\v\f\r"
LEGAL = {"su", "ua", "au"}
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        kept = text.strip(SPACES)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "good" if kept[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """The report of rows (turn, role, text): least (cost, audit) over every string of edits, with runs of up to three inserts."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    fault = faults(rows)
    # Every way, not the best of a state only, for short conversations.
    every = [("", 0, "", ())]
    for (_, role, text), bad in zip(rows, fault, strict=True):
        grown = []
        for state, cost, audit, turns in every:
            for run in range(3):
                at, made = state, []
                for _ in range(run):
                    at, who = ("a", "assistant") if at == "u" else ("u", "user")
                    made.append(f"{who}:")
                base = (cost + 3 * run, audit + "I" * run, (*turns, *made))
                grown.append((at, base[0] + 4, base[1] + "D", base[2]))
                if bad in ("good", "truncated"):
                    more = 3 * (bad == "truncated")
                    if (to := STEP.get((at, role[:1]))) is not None:
                        grown.append((to, base[0] + more, base[1] + "K", (*base[2], f"{role}:{text}")))
                    to, who = ("a", "assistant") if at == "u" else ("u", "user")
                    grown.append((to, base[0] + 3 + more, base[1] + "R", (*base[2], f"{who}:{text}")))
        # The same end with the same string is one way; dearer ones by more than any ending can't win.
        least = min(g[1] for g in grown)
        every = list({(g[0], g[1], g[2]): g for g in grown if g[1] <= least + 12}.values())
    ends = []
    for state, cost, audit, turns in every:
        ends.append({"": (cost, audit, turns), "a": (cost, audit, turns), "u": (cost + 3, audit + "I", (*turns, "assistant:")), "s": (cost + 6, audit + "II", (*turns, "user:", "assistant:"))}[state])
    cost, audit, turns = min(ends, key=lambda e: (e[0], e[1].encode()))
    known = {r[0] for r in rows if r[0] is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in LEGAL for a, b in itertools.pairwise(initials))
    return gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
TEXTS = ["Yes.", "no", " ", "", None, "What?", "a. ", "b!", "c\n", "Long one."]
SCHEMA = "conv_id long, turn long, role string, text string, segment string"


def made(seed, conversations, most):
    rng, rows = random.Random(seed), []
    for c in range(conversations):
        for i in range(rng.randint(1, most)):
            rows.append((c, rng.choice([i, i, i, i + 1, None]), rng.choice(ROLES), rng.choice(TEXTS) if rng.random() < 0.5 else f"text {rng.random()}.", "x"))
    return rows


def check(spark, rows, **sizes):
    table = spark.createDataFrame(rows, SCHEMA)
    turns, report = cr.repair_conversations(table, **sizes)
    got = {r.conv_id: tuple(r)[1:] for r in report.collect()}
    by = {}
    for c, *row, _ in rows:
        by.setdefault(c, []).append(row)
    want = {c: brute(own) for c, own in by.items()}
    assert got == want
    made = {}
    for r in sorted(turns.collect(), key=lambda r: (r.segment, r.at)):
        made.setdefault(r.conv_id, []).append(r)
    for c, own in made.items():
        assert "".join(r.edit for r in own) == want[c][6]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own if r.edit != "D").encode()).hexdigest() == want[c][7]


def test_short_conversations(spark):
    check(spark, made(1, 150, 6) + [(None, 1, "user", "No id.", "x"), (None, 2, "user", "Again.", "x")])


@pytest.mark.parametrize("size", [1, 3])
def test_segments_of_few_rows(spark, size):
    check(spark, made(2, 40, 7), segment_rows=size)


def test_texts_longer_than_a_segment(spark):
    check(spark, [(0, i, ("user", "assistant")[i % 2], "x" * 5000 + ".", "x") for i in range(6)], segment_chars=100)


def test_one_conversation_in_many_segments(spark, monkeypatch):
    """A hot conversation goes through three levels of composed matrices; its report is that of one segment."""
    rng = random.Random(3)
    rows = [(7, i, rng.choice(("user", "assistant", "system")), rng.choice(TEXTS + [f"Text {i}."] * 6), "x") for i in range(400)]
    one = cr.repair_conversations(spark.createDataFrame(rows, SCHEMA))[1].collect()
    # The levels' functions run in workers, which keep their own number; ten rows a segment and 256 to a node give two.
    many = cr.repair_conversations(spark.createDataFrame(rows, SCHEMA), segment_rows=1)[1].collect()
    assert one == many and len(one) == 1 and one[0].cost > 0


def test_copies_of_a_turn_are_counted(spark):
    rows = [(1, 0, "user", "Hello.", "x")] * 50 + [(1, 1, "assistant", " ", "x")] * 20 + [(1, 2, "assistant", "Bye.", "x")]
    (r,) = cr.repair_conversations(spark.createDataFrame(rows, SCHEMA))[1].collect()
    assert (r.blank, r.duplicate, r.truncated, r.illegal) == (20, 49, 0, 49 + 19 + 1)
    assert r.audit == "K" + "D" * 69 + "K" and r.cost == 4 * 69


def test_empty_table(spark):
    turns, report = cr.repair_conversations(spark.createDataFrame([], SCHEMA))
    assert not turns.collect() and not report.collect()


def test_matrices_compose(spark):
    rng = random.Random(5)
    for _ in range(200):
        turns = [(rng.choice("suax"), rng.randint(0, 3), rng.choice((0, 0, 1))) for _ in range(rng.randint(2, 9))]
        at = rng.randint(1, len(turns) - 1)
        whole, parts = cr.matrix(turns), [cr.matrix(turns[:at]), cr.matrix(turns[at:])]
        assert [int(x) for x in cr.compose(parts)] == whole
        end = cr.finish(cr._ways(whole, 0))
        (a, b), (c, d) = cr.between(parts, 0, end)
        assert cr.codes(turns[:at], a, b) + cr.codes(turns[at:], c, d) == cr.codes(turns, 0, end)
