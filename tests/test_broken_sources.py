"""Broken sources: no text makes a parser fail, one bad line loses only itself, and problems have exact places."""

import random
import re

import pytest

from fernweave.sources import parsing

PYTHON = b'''import os
from a.b import c as d

@cache
async def load(user_id: int, *args, limit=10, **kw) -> str:
    """Doc."""
    if user_id:
        return client.users.get(user_id)
    return [x for x in args]


class Box(Base, metaclass=M):
    SIZE: int = 3

    def __init__(self, n):
        self.n = n
        self.f = lambda q: q + 1
'''
SCRIPT = b'''import def0, { a as b, type C } from "./m";
export { x, y };
@dec("z") export default abstract class Card<T> extends Base<T> implements I, J {
  private static readonly n: number = 3;
  constructor(private id: string, ...rest: any[]) { super(id); }
  get size(): number { return this.items[0].size; }
  load = async (q: Query = {}) => { await fetch(`/x/${q}`); };
}
enum Color { Red = "r", Green }
type Id = string | number;
const { p, q } = require("z"), f = x => x * 2, g = function* (a) { yield a; };
function h(a, b = 1) { for (const k of a) { if (k) { h(k); } } }
namespace N { let v: Map<string, T> = new Map(); }
'''


@pytest.mark.parametrize(("language", "source"), [("python", PYTHON), ("javascript", SCRIPT), ("typescript", SCRIPT)])
def test_no_prefix_and_no_gap_makes_a_parser_fail(language, source):
    r = random.Random(1)
    cut = [source[:i] for i in range(len(source) + 1)] + [source[i:] for i in range(0, len(source), 3)]
    cut += [bytes(b for b in source if r.random() > share) for share in (0.02, 0.1, 0.3) for _ in range(100)]
    cut += [bytes(r.choice(b"(){}[]<>=:;,.@*'\"`/\n ax\\") for _ in range(r.randrange(60))) for _ in range(300)]
    cut += [b"function", b"function h", b"class", b"@", b"import {", b"export {", b"(", b"=>", b"const", b"const {", b"enum", b"type X =", b"a.", b"`", b"/*", b"'", b"\xff", b"\x00", b"def", b"x = (", b"if x:", b"'''"]
    for text in cut:
        nodes, problems = parsing.parse(language, text)
        assert not [p for p in problems if p[0] == "parser_error"], (text, problems)
        assert all(0 <= n["start"] <= n["end"] <= len(text) for n in nodes) and all(0 <= p[2] <= p[3] <= len(text) for p in problems)
        assert all(n["parent"] is None or n["parent"] < i for i, n in enumerate(nodes))


def names(language, source, kind="function"):
    nodes, problems = parsing.parse(language, source)
    return [n.get("name") for n in nodes if n["type"] == kind], problems


def test_one_bad_line_loses_only_itself():
    source = b"def one():\n    a = 1\n    b = = 2\n    return a\n\ndef two():\n    pass\n\nx = )\n\nclass C:\n    def m(self):\n        return (1\n\ndef three():\n    return 3\n"
    found, problems = names("python", source)
    assert found == ["one", "two", "m", "three"] or found == ["one", "two", "three"]
    spans = [source[a:b] for _, _, a, b in problems]
    assert spans[0] == b"    b = = 2" and spans[1] == b"x = )" and len(spans) == 3
    assert {n.get("name") for n in parsing.parse("python", source)[0]} >= {"a", "one", "C", "three"}


def test_unclosed_brackets_inside_a_block_end_with_it():
    source = b"function one() { call(a, [b; }\nfunction two() { return {x: 1; }\nconst n = 3;\n"
    found, problems = names("javascript", source)
    assert found[:1] == ["one"]
    kinds = [(k, source[a:b], a) for k, _, a, b in problems]
    brace = source.index(b"}")
    assert kinds[:2] == [("missing_node", b"", brace), ("missing_node", b"", brace)]
    good = b"function one() { call(a, [b; }\nfunction two() { return 2; }\n"
    assert names("typescript", good)[0] == ["one", "two"]


def test_unmatched_closers_are_errors_where_they_stand():
    source = b"a();\n)\nb();\n}\nfunction f() {}\n"
    found, problems = names("javascript", source)
    assert found == ["f"] and [(k, a, source[a:b]) for k, _, a, b in problems] == [("syntax_error", 5, b")"), ("syntax_error", 12, b"}")]


def test_diagnostics_rows(spark):
    files = [("a.py", b"def f(:\n    pass\ny = = 1\nz = 2\n"), ("b.js", b"function g() { h(1; }\n)\n"), ("c.ts", b"let ok = 1;\n"), ("d.md", b"x")]
    table = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "file_path string, content binary")
    got = [(r.file_path, r.kind, r.node_type, r.start_byte, r.end_byte, r.excerpt) for r in parsing.diagnostics(table).orderBy("file_path", "start_byte").collect()]
    assert [g[:3] for g in got] == [("a.py", "syntax_error", "ERROR"), ("a.py", "syntax_error", "ERROR"), ("b.js", "missing_node", "MISSING"), ("b.js", "syntax_error", "ERROR")]
    assert got[2][3] == got[2][4] == 20 and got[3][3:5] == (22, 23)
    status = {r.file_path: r.status for r in parsing.parse_results(table, parsing.diagnostics(table)).collect()}
    assert status == {"a.py": "partial", "b.js": "partial", "c.ts": "success", "d.md": "unsupported"}
    assert {r.name for r in parsing.parse_files(table).collect()} >= {"z", "g", "ok"}


def test_a_file_that_breaks_its_parser_is_its_own_problem(monkeypatch):
    def broken(source):
        raise KeyError("x")

    monkeypatch.setitem(parsing._PARSERS, "python", broken)
    assert parsing.parse("python", b"abc") == ([], [("parser_error", "KeyError: 'x'", 0, 3)])


def test_a_file_of_nothing_but_problems_ends():
    nodes, problems = parsing.parse("python", b"= )\n" * 3000)
    assert not nodes and 0 < len(problems) <= 102
    assert re.match("invalid|unmatched", problems[0][1])
