"""SCIP index files: protobuf bytes to occurrences, definition sites and inheritance edges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.functions import symbols
from fernweave.schemas import INHERITANCE, OCCURRENCES

#: Field numbers of the public index format.
INDEX_DOCUMENTS, INDEX_EXTERNAL = 2, 3
DOCUMENT_PATH, DOCUMENT_OCCURRENCES, DOCUMENT_SYMBOLS = 1, 2, 3
OCCURRENCE_RANGE, OCCURRENCE_SYMBOL, OCCURRENCE_ROLES, OCCURRENCE_ENCLOSING = 1, 2, 3, 7
SYMBOL_NAME, SYMBOL_RELATIONSHIPS = 1, 4
RELATION_SYMBOL, RELATION_IMPLEMENTS = 1, 3


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at += 1
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: integers for varints, bytes for what has a length."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _ints(values: list[int | bytes]) -> list[int]:
    """Repeated int32, packed or not."""
    out = []
    for v in values:
        if isinstance(v, int):
            out.append(v)
            continue
        at = 0
        while at < len(v):
            n, at = _varint(v, at)
            out.append(n)
    return out


def _message(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, value in fields(data):
        out.setdefault(number, []).append(value)
    return out


def _text(values: list) -> str:
    return values[-1].decode("utf-8", "replace") if values else ""


def read_occurrences(index_files: DataFrame) -> DataFrame:
    """index_files (content) to occurrences; those without a symbol are dropped, local symbols belong to their document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for content in batch["content"]:
                for number, document in fields(bytes(content)):
                    if number != INDEX_DOCUMENTS:
                        continue
                    d = _message(document)
                    path = _text(d.get(DOCUMENT_PATH, []))
                    for ordinal, raw in enumerate(d.get(DOCUMENT_OCCURRENCES, [])):
                        o = _message(raw)
                        symbol = _text(o.get(OCCURRENCE_SYMBOL, []))
                        if symbol:
                            role = (o.get(OCCURRENCE_ROLES) or [0])[-1]
                            rows.append((path, ordinal, _ints(o.get(OCCURRENCE_RANGE, [])), f"{symbol}@{path}" if symbol.startswith("local ") else symbol, bool(role & 1), _ints(o.get(OCCURRENCE_ENCLOSING, [])) or None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OCCURRENCES.split(", ")])

    return index_files.select("content").mapInPandas(run, OCCURRENCES)


def read_inheritance(index_files: DataFrame) -> DataFrame:
    """child_symbol, parent_symbol from implementation relationships of documents and external symbols."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for content in batch["content"]:
                infos = []
                for number, value in fields(bytes(content)):
                    infos += _message(value).get(DOCUMENT_SYMBOLS, []) if number == INDEX_DOCUMENTS else [value] if number == INDEX_EXTERNAL else []
                for info in map(_message, infos):
                    for relation in map(_message, info.get(SYMBOL_RELATIONSHIPS, [])):
                        parent = _text(relation.get(RELATION_SYMBOL, []))
                        if parent and (relation.get(RELATION_IMPLEMENTS) or [0])[-1]:
                            rows.append((_text(info.get(SYMBOL_NAME, [])), parent))
            yield pd.DataFrame(rows, columns=["child_symbol", "parent_symbol"])

    return index_files.select("content").mapInPandas(run, INHERITANCE)


def definition_sites(occurrences: DataFrame) -> DataFrame:
    return occurrences.where("is_definition").select("symbol", "document_path", "scip_range", "enclosing_range")


def module_symbols(occurrences: DataFrame) -> DataFrame:
    """document_path, symbol: the first definition at a document's very start."""
    own = occurrences.where(F.col("is_definition") & symbols.is_module_range(F.col("scip_range")))
    return own.groupBy("document_path").agg(F.min_by("symbol", "ordinal").alias("symbol"))


def referenced_symbols(occurrences: DataFrame, inheritance: DataFrame) -> DataFrame:
    return occurrences.select("symbol").union(inheritance.select("parent_symbol")).distinct()
