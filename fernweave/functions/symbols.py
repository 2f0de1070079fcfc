"""SCIP symbols: `scheme manager package version descriptors`, or `local id`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kind that each descriptor suffix names.
SUFFIX_KINDS = {"/": "namespace", "#": "type", ".": "term", ":": "meta", "!": "macro", "()": "method", "[]": "type_parameter", "(": "parameter"}

_NAME = r"(?:`(?:[^`]|``)*`|[A-Za-z0-9_+$-]+)"
_DESCRIPTOR = rf"\[{_NAME}\]|\({_NAME}\)|{_NAME}(?:[/#:!]|\([A-Za-z0-9_+$-]*\)\.|\.)"


def is_local(symbol: Column) -> Column:
    return symbol.startswith("local ")


def qualify(symbol: Column, document_path: Column) -> Column:
    """A local symbol means its document only: symbol@path."""
    return F.when(is_local(symbol), F.concat(symbol, F.lit("@"), document_path)).otherwise(symbol)


def is_definition(roles: Column) -> Column:
    return roles.bitwiseAND(1) != 0


def is_module_range(scip_range: Column) -> Column:
    return (scip_range == F.array(*[F.lit(0)] * 3)) | (scip_range == F.array(*[F.lit(0)] * 4))


def parse_symbols(symbols: DataFrame, column: str = "symbol") -> DataFrame:
    """symbol, scheme, manager, package, version, descriptors (name, suffix), is_local, is_well_formed, kind,
    display_name, package_coordinate. Never fails: what breaks the grammar is not well formed.

    A doubled space in a field is a space, `.` an empty field; names in backquotes may hold anything.
    """
    s = F.col(column)
    # A lone space ends a field; a doubled one is part of it.
    field = r"((?:[^ ]|  )*)"
    head = rf"^{field} {field} {field} {field} (.*)$"
    local = is_local(s)
    fields = [F.replace(F.regexp_extract(s, rf"(?s){head}", i), F.lit("  "), F.lit(" ")) for i in range(1, 5)]
    shaped = F.rlike(s, F.lit(rf"(?s){head}")) & ~local
    rest = F.regexp_extract(s, rf"(?s){head}", 5)
    parts = F.regexp_extract_all(rest, F.lit(_DESCRIPTOR), F.lit(0))
    rows = symbols.select(s.alias("symbol"), local.alias("is_local"), shaped.alias("shaped"), *(f.alias(n) for f, n in zip(fields, ("scheme", "manager", "package", "version"), strict=True)), rest.alias("rest"), parts.alias("parts"))

    def descriptor(d: Column) -> Column:
        tail = F.when(d.startswith("["), "[]").when(d.startswith("("), "(").when(F.rlike(d, F.lit(r"\([^()]*\)\.$")) & ~F.rlike(d, F.lit(r"^`[^`]*\([^()]*\)\.`")), "()").otherwise(F.substr(d, F.length(d), F.lit(1)))
        raw = F.regexp_extract(d, rf"^[\[(]?({_NAME})", 1)
        name = F.when(raw.startswith("`"), F.replace(F.substr(raw, F.lit(2), F.length(raw) - 2), F.lit("``"), F.lit("`"))).otherwise(raw)
        return F.struct(name.alias("name"), tail.alias("suffix"))

    whole = F.array_join("parts", "") == F.col("rest")
    empty = lambda c: F.when(F.col("shaped") & (F.col(c) != "."), F.col(c)).otherwise("")
    rows = rows.select(
        "symbol",
        F.when(F.col("is_local"), "local").otherwise(F.when(F.col("shaped"), F.col("scheme")).otherwise("")).alias("scheme"),
        *(empty(c).alias(c) for c in ("manager", "package", "version")),
        F.when(F.col("shaped"), F.transform("parts", descriptor)).otherwise(F.array().cast("array<struct<name:string,suffix:string>>")).alias("descriptors"),
        "is_local",
        (F.col("is_local") | (F.col("shaped") & whole & (F.size("parts") > 0))).alias("is_well_formed"),
    )
    last = F.try_element_at("descriptors", F.lit(-1))
    kind = F.lit(None).cast("string")
    for suffix, name in SUFFIX_KINDS.items():
        kind = F.when(last["suffix"] == suffix, name).otherwise(kind)
    return rows.withColumns({"kind": F.when(F.col("is_local"), "local").otherwise(kind), "display_name": F.when(F.col("is_local"), F.regexp_replace("symbol", "^local ", "")).otherwise(last["name"]), "package_coordinate": F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("manager", "package", "version")))})
