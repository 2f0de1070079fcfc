"""Queries from source code to graphs. The tables hold no code, so each row of `part` plants a small project's files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.operators import chunking, project_graph, snapshot
from fernweave.plans.queries import query, table
from fernweave.session import shared_folder, written
from fernweave.sources import captures, languages, parsing, points, scip

#: What a part k of size z plants. In the SQL a text is the same pieces joined by ||.
_PY = ["import m", "{k7}", "\n\n@seen\nclass C", "{k}", "(B", "{k3}", "):\n    def __init__(self, a):\n        self.a = a\n\n    @cached\n    def run", "{k5}", "(self, x: int = ", "{z}", ") -> str:\n        return f", "{b}", "(x)\n\ndef f", "{k}", "():\n    pass\n"]
_BAD_PY = ["bad", "{k}", " = = 1\nok", "{k}", " = 2\n"]
_JS = ["export class K", "{k}", " extends B", "{k3}", " {\n  size = ", "{z}", ";\n  async load(q) { return get", "{k7}", "(q); }\n}\nconst g", "{k}", " = (a, b = 1) => a;\n"]
_BAD_JS = ["function h", "{k}", "() { put([1; }\n"]
_VALUES = {"{k}": "k", "{k3}": "k % 3", "{k5}": "k % 5", "{k7}": "k % 7", "{z}": "z", "{b}": "k + 1"}


def _text(pieces: list[str]) -> Column:
    return F.concat(*(F.expr(f"CAST({_VALUES[p]} AS STRING)") if p in _VALUES else F.lit(p) for p in pieces))


def _sql(pieces: list[str]) -> str:
    return " || ".join(f"({_VALUES[p]})" if p in _VALUES else "'" + p.replace("\n", "' || chr(10) || '") + "'" for p in pieces)


_ROWS = "SELECT p_partkey AS k, p_size AS z FROM part"
_PLANTED = f"""SELECT k, z, 'p' || k || '.py' AS path, {_sql(_PY)} || CASE WHEN k % 4 = 0 THEN {_sql(_BAD_PY)} ELSE '' END AS t FROM ({_ROWS})
  UNION ALL SELECT k, z, 'p' || k || CASE WHEN k % 2 = 0 THEN '.ts' ELSE '.js' END, {_sql(_JS)} || CASE WHEN k % 4 = 0 THEN {_sql(_BAD_JS)} ELSE '' END FROM ({_ROWS})"""


def _planted(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    bad = lambda pieces: F.when(F.col("k") % 4 == 0, _text(pieces)).otherwise("")
    name = lambda ending: F.concat(F.lit("p"), F.col("k").cast("string"), ending)
    python = rows.select(name(F.lit(".py")).alias("file_path"), F.concat(_text(_PY), bad(_BAD_PY)).cast("binary").alias("content"))
    script = rows.select(name(F.when(F.col("k") % 2 == 0, ".ts").otherwise(".js")).alias("file_path"), F.concat(_text(_JS), bad(_BAD_JS)).cast("binary").alias("content"))
    return python.unionByName(script)


def _at(text: str, more: str = "0") -> str:
    return f"strpos(t, {text}) - 1 + {more}"


def _expected(rows: list[tuple[str, str, str, str, str, str]]) -> str:
    """SQL lists of (node_type, kind, name, start, end) structs where a condition holds."""
    return " || ".join(f"CASE WHEN {when} THEN [{{'node_type': '{type_}', 'kind': {kind}, 'name': {name}, 'start_byte': ({start})::BIGINT, 'end_byte': ({end})::BIGINT}}] ELSE [] END" for type_, kind, name, start, end, when in rows)


_PY_NODES = _expected(
    [
        ("container", "'file'", "path", "0", "strlen(t)", "true"),
        ("import", "NULL", "NULL", "0", _at("chr(10)"), "true"),
        ("type-definition", "'class'", "'C' || k", _at("'class C'"), _at("'(x)'", "3"), "true"),
        ("function", "'constructor'", "'__init__'", _at("'def __init__'"), _at("'self.a = a'", "10"), "true"),
        ("function", "'method'", "'run' || (k % 5)", _at("'def run'"), _at("'(x)'", "3"), "true"),
        ("call", "NULL", "'f' || (k + 1)", _at("'return f'", "7"), _at("'(x)'", "3"), "true"),
        ("function", "'function'", "'f' || k", _at("'def f'"), _at("'pass'", "4"), "true"),
        ("variable", "'variable'", "'ok' || k", _at("'ok' || k"), _at("'ok' || k", "strlen('ok' || k) + 4"), "k % 4 = 0"),
    ]
)
_JS_NODES = _expected(
    [
        ("container", "'file'", "path", "0", "strlen(t)", "true"),
        ("type-definition", "'class'", "'K' || k", "0", _at("'}' || chr(10) || 'const'", "1"), "true"),
        ("variable", "'field'", "'size'", _at("'size'"), _at("';' || chr(10) || '  async'"), "true"),
        ("function", "'method'", "'load'", _at("'async load'"), _at("'}' || chr(10) || '}'", "1"), "true"),
        ("call", "NULL", "'get' || (k % 7)", _at("'get'"), _at("'(q); }'", "3"), "true"),
        ("function", "'function'", "'g' || k", _at("'const g'"), _at("'=> a;'", "4"), "true"),
        ("function", "'function'", "'h' || k", _at("'function h'"), "strlen(t) - 1", "k % 4 = 0"),
        ("call", "NULL", "'put'", _at("'put'"), "strlen(t) - 3", "k % 4 = 0"),
    ]
)


def _nodes(spark, sf_dir, endings: tuple[str, ...]) -> DataFrame:
    files = _planted(spark, sf_dir).where(F.substring_index("file_path", ".", -1).isin(*endings))
    return parsing.parse_files(files).where("node_type in ('container', 'import', 'type-definition', 'function', 'call') or kind in ('variable', 'field')").select("file_path", "node_type", "kind", "name", "start_byte", "end_byte")


@query(f"SELECT path AS file_path, n.* FROM (SELECT path, unnest({_PY_NODES}) AS n FROM ({_PLANTED}) WHERE path LIKE '%.py')")
def parsed_python(spark, sf_dir):
    return _nodes(spark, sf_dir, ("py",))


@query(f"SELECT path AS file_path, n.* FROM (SELECT path, unnest({_JS_NODES}) AS n FROM ({_PLANTED}) WHERE path NOT LIKE '%.py')")
def parsed_script(spark, sf_dir):
    return _nodes(spark, sf_dir, ("js", "ts"))


#: Destructuring, computed members, types inside expressions, index calls, code inside templates.
_DEEP = ["const { a", "{k}", ", b: [c = get", "{k7}", "(), ...d] } = load<Row", "{k3}", ">(x);\nclass K", "{k}", " { [Symbol.iterator]() { return by[", "{k5}", "](this); } }\nlet v = `n${show", "{z}", "(w as Kind", "{k3}", ")}`;\nconst o = { run", "{k}", "(p?: T) { new a.Box(p); } };\n"]
_DEEP_NODES = [
    ("'variable'", "'{ a' || k || ', b: [c = get' || (k % 7) || '(), ...d] }'", "'a' || k || ',c,d'", "NULL"),
    ("'call'", "'get' || (k % 7)", "NULL", "NULL"),
    ("'call'", "'load'", "NULL", "NULL"),
    ("'type_reference'", "'Row' || (k % 3)", "NULL", "NULL"),
    ("'type-definition'", "'K' || k", "NULL", "NULL"),
    ("'attribute_access'", "'iterator'", "NULL", "NULL"),
    ("'function'", "'[Symbol.iterator]'", "NULL", "NULL"),
    ("'call'", "(k % 5)", "NULL", "'by'"),
    ("'attribute_access'", "(k % 5)", "NULL", "NULL"),
    ("'variable'", "'v'", "NULL", "NULL"),
    ("'call'", "'show' || z", "NULL", "NULL"),
    ("'type_reference'", "'Kind' || (k % 3)", "NULL", "NULL"),
    ("'variable'", "'o'", "NULL", "NULL"),
    ("'function'", "'run' || k", "NULL", "NULL"),
    ("'variable'", "'p'", "NULL", "NULL"),
    ("'type_reference'", "'T'", "NULL", "NULL"),
    ("'call'", "'Box'", "NULL", "'a'"),
    ("'attribute_access'", "'Box'", "NULL", "NULL"),
]
_DEEP_SQL = ", ".join(f"{{'node_type': {t}, 'name': ({n})::VARCHAR, 'bindings': {b}, 'subject': {s}}}" for t, n, b, s in _DEEP_NODES)


@query(f"SELECT 'd' || k || '.ts' AS file_path, n.* FROM (SELECT k, unnest([{_DEEP_SQL}]) AS n FROM ({_ROWS}))")
def parsed_script_patterns(spark, sf_dir):
    """What a TypeScript file says by patterns, computed names and types in expressions."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    files = rows.select(F.concat(F.lit("d"), F.col("k").cast("string"), F.lit(".ts")).alias("file_path"), _text(_DEEP).cast("binary").alias("content"))
    return parsing.parse_files(files).where("kind is null or kind <> 'file'").select("file_path", "node_type", "name", F.col("metadata")["bindings"].alias("bindings"), "subject")


@query(f"""SELECT path AS file_path, p.* FROM (SELECT path, unnest(CASE WHEN path LIKE '%.py' THEN [{{'kind': 'syntax_error', 'node_type': 'ERROR', 'start_byte': ({_at("'bad'")})::BIGINT, 'end_byte': (strpos(t, '= = 1') + 4)::BIGINT}}]
    ELSE list_transform([1, 2], lambda x: {{'kind': 'missing_node', 'node_type': 'MISSING', 'start_byte': (strlen(t) - 2)::BIGINT, 'end_byte': (strlen(t) - 2)::BIGINT}}) END) AS p FROM ({_PLANTED}) WHERE k % 4 = 0)""")
def parse_problems(spark, sf_dir):
    return parsing.diagnostics(_planted(spark, sf_dir)).select("file_path", "kind", "node_type", "start_byte", "end_byte")


@query(f"""SELECT path AS file_path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' THEN 'typescript' ELSE 'javascript' END AS language, CASE WHEN k % 4 = 0 THEN 'partial' ELSE 'success' END AS status,
  strlen(t)::BIGINT AS source_size_bytes, CASE WHEN k % 4 <> 0 THEN 0 WHEN path LIKE '%.py' THEN 1 ELSE 2 END::BIGINT AS n_problems FROM ({_PLANTED})""")
def parse_status(spark, sf_dir):
    files = _planted(spark, sf_dir)
    return parsing.parse_results(files, parsing.diagnostics(files)).select("file_path", "language", "status", "source_size_bytes", "n_problems")


@query(f"""SELECT path AS file_path, n.* FROM (SELECT path, unnest([
    {{'capture': 'import', 'name': NULL, 'owner': NULL, 'notes': NULL}},
    {{'capture': 'class', 'name': 'C' || k, 'owner': NULL, 'notes': 'base_types=B' || (k % 3) || ';decorators=seen'}},
    {{'capture': 'constructor', 'name': '__init__', 'owner': 'C' || k, 'notes': NULL}},
    {{'capture': 'method', 'name': 'run' || (k % 5), 'owner': 'C' || k, 'notes': 'decorators=cached;return_type=str'}},
    {{'capture': 'call', 'name': NULL, 'owner': 'run' || (k % 5), 'notes': NULL}},
    {{'capture': 'function', 'name': 'f' || k, 'owner': NULL, 'notes': NULL}}]
    || list_transform([['self', '__init__'], ['a', '__init__'], ['self', 'run' || (k % 5)], ['x', 'run' || (k % 5)]], lambda x: {{'capture': 'parameter', 'name': x[1], 'owner': x[2], 'notes': NULL}})
    || [{{'capture': 'attribute_access', 'name': 'a', 'owner': '__init__', 'notes': NULL}}]) AS n FROM ({_PLANTED}) WHERE path LIKE '%.py')""")
def captured_nodes(spark, sf_dir):
    files = _planted(spark, sf_dir)
    found = captures.convert(captures.python_trees(files), files, captures.PYTHON)
    owners = found.select("file_path", F.col("ordinal").alias("parent"), F.col("name").alias("owner"))
    notes = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return found.join(owners, ["file_path", "parent"], "left").select("file_path", "capture", "name", "owner", notes.alias("notes"))


def _varint(n: Column) -> Column:
    """A number below 16384 as a protobuf varint."""
    byte = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))
    return F.when(n < 128, byte(n)).otherwise(F.concat(byte(n % 128 + 128), byte(F.floor(n / 128))))


def _field(number: int, value: Column) -> Column:
    """A protobuf field of bytes, or of text."""
    value = value.cast("binary")
    return F.concat(F.unhex(F.lit(f"{number << 3 | 2:02X}")), _varint(F.octet_length(value)), value)


def _occurrence(line: int, first: int, length: Column, symbol: Column, defines: bool) -> Column:
    span = F.concat(_varint(F.lit(line)), _varint(F.lit(first)), _varint(F.lit(first) + length))
    return _field(2, F.concat(_field(1, span), _field(2, symbol), F.unhex(F.lit(f"18{int(defines):02X}"))))


def _index(spark, sf_dir) -> DataFrame:
    """An index of symbols for the planted Python files: one document a file, three occurrences and one relationship each."""
    k = F.col("k")
    text = lambda c: c.cast("string")
    symbol = lambda name: F.concat(F.lit("scip-python python pkg 1.0 `m`/"), name)
    f, before, cls = F.concat(F.lit("f"), text(k)), F.concat(F.lit("f"), text(k + 1)), F.concat(F.lit("C"), text(k))
    info = _field(3, F.concat(_field(1, symbol(F.concat(cls, F.lit("#")))), _field(4, F.concat(_field(1, symbol(F.concat(F.lit("B"), text(k % 3), F.lit("#")))), F.unhex(F.lit("1801"))))))
    document = F.concat(
        _field(1, F.concat(F.when(k % 2 == 0, "./").otherwise(""), F.lit("p"), text(k), F.lit(".py"))),
        _occurrence(3, 6, F.length(cls), symbol(F.concat(cls, F.lit("#"))), True),
        _occurrence(9, 15, F.length(before), symbol(F.concat(before, F.lit("()."))), False),
        _occurrence(11, 4, F.length(f), symbol(F.concat(f, F.lit("()."))), True),
        info,
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).select(_field(2, document).alias("content"))


_SYMBOL = "'scip-python python pkg 1.0 `m`/'"


@query(f"""SELECT CASE WHEN k % 2 = 0 THEN './' ELSE '' END || 'p' || k || '.py' AS document_path, o.* FROM (SELECT k, unnest([
    {{'ordinal': 0, 'place': '3:6:' || (6 + length('C' || k)), 'symbol': {_SYMBOL} || 'C' || k || '#', 'is_definition': true}},
    {{'ordinal': 1, 'place': '9:15:' || (15 + length('f' || (k + 1))), 'symbol': {_SYMBOL} || 'f' || (k + 1) || '().', 'is_definition': false}},
    {{'ordinal': 2, 'place': '11:4:' || (4 + length('f' || k)), 'symbol': {_SYMBOL} || 'f' || k || '().', 'is_definition': true}}]) AS o FROM ({_ROWS}))""")
def scip_occurrences(spark, sf_dir):
    found = scip.read_occurrences(_index(spark, sf_dir))
    return found.select("document_path", "ordinal", F.array_join(F.col("scip_range").cast("array<string>"), ":").alias("place"), "symbol", "is_definition")


@query(f"SELECT {_SYMBOL} || 'C' || k || '#' AS child_symbol, {_SYMBOL} || 'B' || (k % 3) || '#' AS parent_symbol FROM ({_ROWS})")
def scip_inheritance(spark, sf_dir):
    return scip.read_inheritance(_index(spark, sf_dir))


@query(f"SELECT symbol, symbol NOT LIKE '%B_#' AND symbol <> {_SYMBOL} || 'f' || (SELECT max(p_partkey) + 1 FROM part) || '().' AS is_defined FROM (SELECT {_SYMBOL} || unnest(['C' || k || '#', 'f' || (k + 1) || '().', 'f' || k || '().', 'B' || (k % 3) || '#']) AS symbol FROM ({_ROWS})) GROUP BY 1")
def symbols_defined(spark, sf_dir):
    index = _index(spark, sf_dir)
    occurrences = scip.read_occurrences(index)
    return project_graph.is_defined(scip.referenced_symbols(occurrences, scip.read_inheritance(index)), occurrences)


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN './' ELSE '' END || 'p' || p_partkey || '.py' AS document_path FROM part")
def scip_documents(spark, sf_dir):
    return project_graph.document_paths(scip.read_occurrences(_index(spark, sf_dir)))


@query("""SELECT 'p' || p_partkey || '.py' AS src_file, 'call' AS src_type, 'p' || (p_partkey + 1) || '.py' AS dst_file, 'function' AS dst_type, 'f' || (p_partkey + 1) AS name, 'REFERENCE_TO' AS type FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)""")
def graph_from_sources(spark, sf_dir):
    """Files and an index to edges: parsed, located, contained, resolved. Windows paths and a leading ./ meet."""
    files = _planted(spark, sf_dir).where(F.endswith("file_path", F.lit(".py")))
    nodes, edges = project_graph.build(files, _index(spark, sf_dir))
    end = lambda side: nodes.select(F.col("id").alias(side), F.col("file_path").alias(f"{side}_file"), F.col("node_type").alias(f"{side}_type"), F.col("name").alias(f"{side}_name"))
    return edges.join(end("src"), "src").join(end("dst"), "dst").select("src_file", "src_type", "dst_file", "dst_type", F.col("dst_name").alias("name"), "type")


@query(f"SELECT path AS file_path, t AS content, true AS fits FROM ({_PLANTED})")
def chunked_sources(spark, sf_dir):
    """Chunks along the nodes of each planted file, refused where they would not cover it; joined again, they are the file."""
    files = written(_planted(spark, sf_dir), "planted")
    language, parser = languages.DEFAULT.language(F.col("file_path")), languages.DEFAULT.parser_name(F.col("file_path"))
    named = files.select("file_path", language.alias("language"), parser.alias("parser_name"), "content")
    problems, nodes = written(parsing.diagnostics(files), "problems"), written(parsing.parse_files(files), "nodes")
    chunks = chunking.chunk_parsed(named, parsing.parse_results(files, problems), nodes, chunking.ChunkOptions(max_size=60))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "")
    return chunks.groupBy("file_path").agg(parts.alias("content"), (F.max("size") <= 60).alias("fits"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'docker' WHEN 1 THEN 'tests' WHEN 2 THEN 'typescript' WHEN 3 THEN 'python' WHEN 4 THEN 'javascript' END AS language, CASE page_id % 6 WHEN 0 THEN 'docker' WHEN 1 THEN 'tests' WHEN 2 THEN 'tsx' WHEN 3 THEN 'python' WHEN 4 THEN 'javascript' END AS parser FROM pages""")
def languages_by_pattern(spark, sf_dir):
    registry = languages.Registry((languages.Language("docker", ("dockerfile*",)), languages.Language("tests", ("*_test.[pt][ys]",)), *languages.DEFAULT.languages))
    place = F.col("page_id") % 6
    name = F.when(place == 0, "a/Dockerfile.").when(place == 1, "b_").when(place == 4, "c\\d.").otherwise("e")
    ending = F.when(place == 0, "dev").when(place == 1, "_test.ts").when(place == 2, ".TSX").when(place == 3, ".Py").when(place == 4, ".mjs").otherwise(".java")
    path = F.concat(name, F.col("page_id").cast("string"), ending)
    return table(spark, sf_dir, "pages").select("page_id", registry.language(path).alias("language"), registry.parser_name(path).alias("parser"))


@query(f"""SELECT count(*) FILTER (path IS NOT NULL) AS processed, count(*) FILTER (k % 4 = 0) AS partial, (SELECT count(*) FROM pages) AS skipped FROM ({_PLANTED})""")
def parse_counters(spark, sf_dir):
    """The planted files, and beside them pages, which no parser takes."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_path"), F.col("html").cast("binary").alias("content"))
    files = _planted(spark, sf_dir).unionByName(pages)
    return parsing.counters(parsing.parse_results(files, parsing.diagnostics(files)))


@query(f"SELECT path AS file_path, k % 4 = 0 AS has_errors, k % 4 <> 0 AS is_clean FROM ({_PLANTED})")
def parse_flags(spark, sf_dir):
    files = _planted(spark, sf_dir)
    return parsing.with_flags(parsing.parse_results(files, parsing.diagnostics(files))).select("file_path", "has_errors", "is_clean")


@query("""SELECT event_id, kind, kind IN ('class', 'function', 'method', 'parameter') AS definition, kind = 'class' AS type_definition, kind = 'parameter' AS variable_like, kind IN ('function', 'method') AS function_like, kind = 'import' AS dependency, kind = 'call' AS reference
  FROM (SELECT event_id, CASE user_id % 7 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' WHEN 3 THEN 'parameter' WHEN 4 THEN 'import' WHEN 5 THEN 'call' ELSE 'other' END AS kind FROM events)""")
def capture_categories(spark, sf_dir):
    names = ("class", "function", "method", "parameter", "import", "call", "other")
    kind = F.element_at(F.array(*map(F.lit, names)), (F.col("user_id") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", kind.alias("kind"))
    return rows.select("event_id", "kind", *(captures.is_of(F.col("kind"), c).alias(c) for c in captures.CATEGORIES if c != "metadata"))


@query("""SELECT p_partkey, array_to_string(list_filter(string_split(p_type, ' '), lambda x: x IN ('STEEL', 'SMALL', 'BRUSHED', 'steel', 'small')), ',') AS found FROM part""")
def modifier_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").alias("modifiers"))
    return parsing.modifiers_among(rows, ("STEEL", "SMALL", "BRUSHED", "steel", "small")).select("p_partkey", F.array_join("found", ",").alias("found"))


@query("""SELECT source AS folder, string_agg(source || '/' || doc_id || '=' || sha256(text), ';' ORDER BY source || '/' || doc_id) AS hashes FROM documents WHERE doc_id % 5 <> 0 GROUP BY source""")
def current_hash_maps(spark, sf_dir):
    """Hashes of what stays, by folder; every fifth document is deleted."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents")
    old = docs.select(path.alias("relative_path"), F.lit("x").alias("content_hash"))
    new = docs.where("doc_id % 5 <> 0").select(path.alias("relative_path"), F.sha2("text", 256).alias("content_hash"))
    found = snapshot.current_hashes(snapshot.diff(old, new))
    pairs = F.transform(F.map_entries("hashes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("folder", F.array_join(pairs, ";").alias("hashes"))


@query("""SELECT vec_id::VARCHAR AS point_id, label, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM embeddings""")
def vector_table(spark, sf_dir):
    """Every vector into a new table of points, a third of them again in a newer version, the last step twice."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("point_id"), F.col("embedding").cast("array<float>").alias("vector"), F.lit(1).cast("long").alias("version"), "label", "vec_id")
    folder = f"{shared_folder(spark)}/fernweave/points-{uuid.uuid4().hex}"
    points.ensure_table(spark, folder, vectors.select(F.size("vector")).first()[0], 16)
    points.upsert(folder, vectors)
    for _ in range(2):
        points.upsert(folder, vectors.where("vec_id % 3 = 0").withColumn("version", F.lit(2).cast("long")))
    return points.read_points(spark, folder, vectors.schema).select("point_id", "label", "version")
