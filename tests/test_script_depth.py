"""JavaScript and TypeScript beyond declarations: patterns, computed names, types in expressions, chains and templates."""

import time

import pytest

from fernweave.sources import parsing


def nodes(source: bytes, language: str = "typescript"):
    found, problems = parsing.parse(language, source)
    assert not problems, problems
    return found


def named(source: bytes, *types: str):
    return [(n["name"], n.get("subject")) for n in nodes(source) if n["type"] in types]


@pytest.mark.parametrize(
    ("pattern", "bindings"),
    [
        (b"{ a, b: c, ...rest }", "a,c,rest"),
        (b"{ a = 1, b: { c: [d, , e = f()] } = {} }", "a,d,e"),
        (b"[x, , [y], ...z]", "x,y,z"),
        (b"{ [key()]: v, 'w': u }", "v,u"),
        (b"{}", ""),
    ],
)
def test_a_pattern_is_one_variable_and_names_what_it_binds(pattern, bindings):
    source = b"const " + pattern + b" = load(1), after = 2;"
    first, *rest = nodes(source)
    assert (first["name"], first["kind"], first["initial_value"], first["metadata"]["bindings"]) == (pattern.decode(), "constant", "load(1)", bindings)
    after = next(n for n in rest if n.get("name") == "after")
    assert source[after["start"] : after["end"]] == b"after = 2"


def test_parameters_by_pattern_and_what_is_said_of_them():
    found = nodes(b"const Card = ({ title, count = zero() }: Props, size?: number, ...more: any[]): JSX.Element => draw(title);")
    card = found[0]
    assert (card["type"], card["name"], card["return_type"]) == ("function", "Card", "JSX.Element")
    got = {n["name"]: (n["data_type"], n["modifiers"], n["metadata"]) for n in found if n.get("kind") == "parameter"}
    assert got == {"{ title, count = zero() }": ("Props", [], {"bindings": "title,count"}), "size": ("number", ["optional"], {"optional": "true"}), "more": ("any[]", ["rest"], {"rest": "true"})}
    held = next(n for n in nodes(b"class A { constructor(private readonly r: R<T>) {} }") if n.get("kind") == "parameter")
    assert (held["visibility"], held["modifiers"], held["data_type"]) == ("private", ["private", "readonly"], "R<T>")


def test_require_is_a_variable_that_holds_an_import():
    found = nodes(b'const { join, sep: s } = require("path"), all = require("./all").part;')
    assert [(n["type"], n.get("name")) for n in found if n["type"] == "variable"] == [("variable", "{ join, sep: s }"), ("variable", "all")]
    first, second = (n for n in found if n["type"] == "import")
    assert (first["module_path"], first["imported_names"], first["alias"]) == ("path", ["join", "sep"], {"sep": "s"}) and second["module_path"] == "./all" and second["alias"] == {"*": "all"}
    assert not [n for n in found if n["type"] == "call"]


def test_members_with_computed_names_blocks_and_index_signatures():
    found = nodes(b"class K {\n  [Symbol.iterator]() { return next(); }\n  static [k + 1]: number = one();\n  [key: string]: any;\n  static { boot(); }\n  get(id) { return super.get(id); }\n}")
    assert [(n["name"], n["kind"]) for n in found if n["type"] in ("function", "variable") and n.get("kind") != "parameter"] == [("[Symbol.iterator]", "method"), ("[k + 1]", "field"), ("get", "method")]
    field = next(n for n in found if n.get("name") == "[k + 1]")
    assert field["is_static"] and (field["data_type"], field["initial_value"]) == ("number", "one()")
    assert [(n["name"], n.get("subject")) for n in found if n["type"] == "call"] == [("next", None), ("one", None), ("boot", None), ("get", "super")]


def test_literals_have_methods_not_calls():
    source = b"export default { data: { run(p) { go(p); }, async *each() {}, get size(): number { return 1; }, 'q r'() {}, [c()]() {} }, k: v => w(v), call(x), other: n };"
    found = nodes(source)
    assert [(n["name"], n["is_generator"], n["is_async"]) for n in found if n["type"] == "function" and n["kind"] == "method"] == [("run", False, False), ("each", True, True), ("size", False, False), ("q r", False, False), ("[c()]", False, False)]
    assert [n["name"] for n in found if n["type"] == "call"] == ["go", "w", "call"]


@pytest.mark.parametrize(
    ("source", "calls"),
    [
        (b"handlers[type](value)", [("type", "handlers")]),
        (b"api.get<User>(id).then(f)", [("get", "api"), ("then", "api.get<User>(id)")]),
        (b"new a.B<C>(x).run()", [("B", "a"), ("run", "new a.B<C>(x)")]),
        (b"new Foo;", [("Foo", None)]),
        (b"a?.(1); b?.[2](3); c!.d(4)", [("a", None), ("2", "b"), ("d", "c!")]),
        (b"(p || q).m(); 's'.trim(); [1].map(g)", [("m", "(p || q)"), ("trim", "'s'"), ("map", "[1]")]),
        (b"tag`x${y()}z`; `a${one(`b${two({ q: 1 })}`)}c`.at(0)", [("tag", None), ("y", None), ("one", None), ("two", None), ("at", "`a${one(`b${two({ q: 1 })}`)}c`")]),
        (b"if (i < n && m > (o)) { p(); }", [("p", None)]),
        (b"super(x); import('m')", [("super", None), ("import", None)]),
    ],
)
def test_calls_and_their_subjects(source, calls):
    assert sorted(named(source, "call"), key=str) == sorted(calls, key=str)


def test_types_inside_expressions():
    source = b"f(x as Foo | Bar.Baz<Q>, y satisfies Row[], z as unknown as (a: A) => B); new Map<Key, Value>(); let w!: T = <const>1 as const;"
    assert [n for n, _ in named(source, "type_reference")] == ["Foo", "Bar", "Q", "Row", "A", "B", "Key", "Value", "T"]


def test_accesses_of_members_and_indexes():
    found = nodes(b"this.repo.find(id); a[b].c = d;")
    assert [(n["name"], n["metadata"]["subject"]) for n in found if n["type"] == "attribute_access"] == [("repo", "this"), ("find", "this.repo"), ("b", "a"), ("c", "a[b]")]


def test_loops_declare_what_they_count():
    found = nodes(b"for (let i = 0, n = size(); i < n; i++) { step(i); }\nfor (const [k, v] of pairs()) use(k);\nfor await (const z of gen()) { end(z); }\n")
    assert [n["name"] for n in found if n["type"] == "variable"] == ["i", "n"]
    assert [n["name"] for n in found if n["type"] == "call"] == ["size", "step", "pairs", "use", "gen", "end"]


def test_python_accesses_of_callees():
    found, _ = parsing.parse("python", b"client.users.get(1)\n")
    assert [(n["type"], n["name"]) for n in found] == [("call", "get"), ("attribute_access", "get"), ("attribute_access", "users")]


def test_time_grows_with_the_source():
    """Comparisons, templates and brackets in numbers take no look at all that follows each."""

    def seconds(n: int) -> float:
        source = b"function f() {\n" + b"  if (a < b) { g[i](x as T, `q${h({ k: 1 })}`); }\n  const { p, q: [r] } = new M<K>(p);\n" * n + b"}\n"
        start = time.perf_counter()
        nodes(source)
        return time.perf_counter() - start

    seconds(50)
    assert seconds(4_000) < 40 * max(seconds(500), 0.01)
