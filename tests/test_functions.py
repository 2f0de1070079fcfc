import uuid

import pytest
from pyspark.sql import functions as F

from fernweave.functions import hashing, paths, symbols, text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("name", ["", "node-1", "héllo", "x" * 99])
def test_uuid5(spark, name):
    assert one(spark, name, hashing.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


@pytest.mark.parametrize(("path", "want"), [("a.py", "python"), ("a/B.PYI", "python"), ("x.tsx", "typescript"), ("x.mjs", "javascript"), ("README.md", None), ("Dockerfile", None), (".py", None), ("a.b/c", None), ("Main.java", None)])
def test_language(spark, path, want):
    assert one(spark, path, paths.language) == want


@pytest.mark.parametrize(("path", "want"), [("a\\b//./c.py", "a/b/c.py"), ("/a", None), ("C:\\a", None), ("a/../b", None), ("  ", None), (" a ", "a")])
def test_normalize(spark, path, want):
    assert one(spark, path, paths.normalize) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://github.com/o/r", "o/r"), ("https://www.github.com/o/r.git/", "o/r"), ("https://github.com/o/r%2Ex", "o/r.x"), ("http://github.com/o/r", None), ("https://github.com:443/o/r", None), ("https://u@github.com/o/r", None), ("https://github.com/o/r?x=1", None), ("https://github.com/o", None), ("https://github.com/o/r/x", None), ("https://gitlab.com/o/r", None), ("https://github.com/o/..", None), ("https://github.com/o/a b", None)],
)
def test_github_url(spark, url, want):
    g = one(spark, url, paths.github_url)
    assert (g and f"{g.owner}/{g.repository}") == want


@pytest.mark.parametrize(
    ("lines", "path", "want"),
    [(["*.log"], "a/b.log", True), (["*.log", "!keep.log"], "keep.log", False), (["/only"], "a/only", False), (["gen/"], "x/gen/a.py", True), (["gen/"], "gen", False), (["a/**/z"], "a/b/c/z", True), (["a/**"], "a/b", True), (["# c", "", "b[0-9].py"], "b7.py", True), (["a/*"], "a/", False), (["\\!x"], "!x", True)],
)
def test_ignored(spark, lines, path, want):
    assert one(spark, path, lambda c: paths.ignored(c, lines)) is want


@pytest.mark.parametrize(
    ("symbol", "ok", "kind", "name"),
    [("scip-python python pkg 1.0 `a.b`/C#m().", True, "method", "m"), ("s m p v `x``y`.", True, "term", "x`y"), ("s . . . a/b#[T]", True, "type_parameter", "T"), ("s m p v f().(x)", True, "parameter", "x"), ("local 3", True, "local", "3"), ("s m p", False, None, None), ("s m p v ", False, None, None), ("s m p v a//", False, None, None), ("s m p v x!", True, "macro", "x"), ("s m two  words v k:", True, "meta", "k")],
)
def test_symbols(spark, symbol, ok, kind, name):
    row = symbols.parse_symbols(spark.createDataFrame([(symbol,)], "symbol string")).first()
    assert row.is_well_formed is ok
    if ok:
        assert (row.kind, row.display_name) == (kind, name)
    if "two" in symbol:
        assert row.package == "two words"


def test_word_size_counts_unicode_space(spark):
    assert one(spark, "one  two\nthree\tfour", text.word_size) == 4
    assert one(spark, "a\u00a0b", text.word_size) == 2


def test_decode_replaces(spark):
    for raw in (b"ok", b"\xff", b"a\xc3", b"\xe2\x82x"):
        assert one(spark, raw, text.decode, "binary") == raw.decode("utf-8", "replace")


def test_identifier_terms(spark):
    got = spark.sql("SELECT array('getUserName', 'user_id2', 'x', 'HTTPServer', '42') n").select(text.identifier_terms(F.col("n"))).first()[0]
    assert got == sorted({"user name", "user", "name", "user id2", "id2", "httpserver"})


def test_a_cluster_must_name_its_shared_folder(spark):
    from types import SimpleNamespace

    from fernweave.session import shared_folder

    conf = SimpleNamespace(get=lambda key, default: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(cluster)
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


@pytest.mark.parametrize(
    ("doc", "name", "want"),
    [
        ('  """Retrieve the ordered customer records quickly."""  ', "get", True),
        ('"""Get user by id from the get_user table of it."""', "get_user", True),
        ("get_user get_user get_user by id or name", "get_user", False),
        ("'''short'''", "f", False),
        (None, "f", False),
        ("Ελληνικά και κείμενο εδώ με λέξεις", None, True),
    ],
)
def test_useful_docstring(spark, doc, name, want):
    rows = spark.createDataFrame([(doc, name)], "doc string, name string")
    assert rows.select(text.useful_docstring(F.col("doc"), F.col("name"))).first()[0] is want
