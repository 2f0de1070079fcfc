"""Texts about code: sizes, identifiers, signatures, docstrings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a definition.
STOPWORDS = (
    "dep", "col", "is", "in", "one", "all", "by", "at", "to", "or", "an", "if", "as", "do", "so", "my", "me", "we", "be",
    "on", "no", "self", "this", "none", "true", "false", "any", "str", "int", "dict", "list", "bool", "float", "val",
    "var", "def", "get", "set",
)


def byte_size(text: Column) -> Column:
    return F.octet_length(text)


def word_size(text: Column) -> Column:
    """Runs of anything but white space, of any script."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def decode(content: Column) -> Column:
    """UTF-8 with a replacement character for malformed bytes."""
    return F.make_valid_utf8(content.cast("string"))


def name_words(name: Column) -> Column:
    """camelCase and snake_case to lower-cased words that say something."""
    spaced = F.replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" "))
    return F.filter(F.split(F.lower(spaced), r"\s+"), lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS) & ~F.rlike(w, F.lit("^[0-9]+$")))


def identifier_terms(names: Column) -> Column:
    """Sorted distinct terms of an array of names: each name's words, and its whole phrase where it has several."""
    each = F.transform(names, lambda n: _terms(name_words(n)))
    return F.array_sort(F.array_distinct(F.flatten(each)))


def _terms(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.concat(F.array(F.array_join(words, " ")), words)).otherwise(words)


def _or(text: Column, default: str) -> Column:
    """text, or default where it is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def _after(lead: str, text: Column) -> Column:
    """text behind lead; nothing where it is null or empty."""
    return F.coalesce(F.concat(F.lit(lead), F.nullif(text, F.lit(""))), F.lit(""))


def function_signature(name: Column, params: Column, return_type: Column, is_async: Column) -> Column:
    """params: array of struct(name, type, value). A missing type is Any, a missing value no default."""
    shown = F.transform(params, lambda p: F.concat(p["name"], F.lit(": "), _or(p["type"], "Any"), _after(" = ", p["value"])))
    lead = F.when(F.coalesce(is_async, F.lit(False)), "async def ").otherwise("def ")
    return F.concat(lead, _or(name, "unnamed_function"), F.lit("("), F.coalesce(F.array_join(shown, ", "), F.lit("")), F.lit(")"), _after(" -> ", return_type))


def class_signature(name: Column, base_types: Column) -> Column:
    bases = F.when(F.size(base_types) > 0, F.concat(F.lit("("), F.array_join(base_types, ", "), F.lit(")"))).otherwise("")
    return F.concat(F.lit("class "), _or(name, "unnamed_class"), bases)


def node_signature(node_type: Column, name: Column, params: Column, return_type: Column, is_async: Column, base_types: Column) -> Column:
    other = F.concat(F.lit("construct "), _or(name, "unnamed"))
    return F.when(node_type == "function", function_signature(name, params, return_type, is_async)).when(node_type == "type-definition", class_signature(name, base_types)).otherwise(other)


def embed_text(signature: Column, summary: Column) -> Column:
    return F.concat(signature, F.lit("\n\n"), F.trim(summary))


def _without(text: Column, ends: str) -> Column:
    return F.regexp_replace(text, f"(?U)^{ends}+|{ends}+$", "")


def bare_docstring(docstring: Column) -> Column:
    """A docstring without the white space and the quotes around it."""
    out = docstring
    for ends in (r"\s", '"', "'", r"\s"):
        out = _without(out, ends)
    return out


def useful_docstring(docstring: Column, name: Column) -> Column:
    """At least 25 characters without its quotes, and three words that neither the name nor the stopwords have.

    Words are runs of letters, digits and underscores, so a name in snake or camel case is one.
    """
    bare = bare_docstring(docstring)
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))
    fresh = F.array_except(F.array_except(F.array_distinct(words(bare)), F.coalesce(words(name), F.array().cast("array<string>"))), F.array(*map(F.lit, STOPWORDS)))
    return F.coalesce((F.length(bare) >= 25) & (F.size(fresh) >= 3), F.lit(False))


def excerpt(content: Column, start: Column, end: Column, longest: int = 120, around: int = 40) -> Column:
    """The first bytes of a span, or what is around an empty one; line breaks escaped, null if there is nothing."""
    empty = end <= start
    a = F.when(empty, F.greatest(start - around, F.lit(0))).otherwise(start)
    b = F.when(empty, F.least(end + around, F.octet_length(content).cast("bigint"))).otherwise(F.least(end, start + longest))
    shown = F.replace(F.replace(decode(F.substr(content, (a + 1).cast("int"), (b - a).cast("int"))), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    return F.when(shown != "", shown)


def source_or_note(source: Column, name: Column) -> Column:
    """A node's source, or a note that it has none."""
    return F.coalesce(F.nullif(source, F.lit("")), F.concat(F.lit("# [Source code unavailable for "), name, F.lit("]")))


def embedding_input(embed_text_: Column, summary: Column, signature: Column) -> Column:
    """The first of them that is not empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (embed_text_, summary, signature)))
