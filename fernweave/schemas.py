"""Schemas of the engine's tables, as DDL."""

from __future__ import annotations

SPAN = "start_byte bigint, end_byte bigint"
FILES = "repository_root string, relative_path string, language string, size_bytes bigint, content_hash string, content binary"
FILE_CHANGES = "relative_path string, previous_hash string, current_hash string, change string"
UAST_NODES = (
    "file_path string, id string, parent_id string, ordinal int, depth int, node_type string, kind string, name string, "
    f"{SPAN}, start_row int, start_column int, end_row int, end_column int, docstring string, visibility string, "
    "modifiers array<string>, decorators array<string>, base_types array<string>, enum_values array<string>, "
    "return_type string, data_type string, initial_value string, is_async boolean, is_generator boolean, is_static boolean, "
    "is_abstract boolean, is_override boolean, module_path string, imported_names array<string>, alias map<string,string>, "
    "subject string, params array<struct<name:string,type:string,value:string>>, metadata map<string,string>"
)
DIAGNOSTICS = f"file_path string, kind string, severity string, message string, node_type string, {SPAN}, excerpt string"
OCCURRENCES = "document_path string, ordinal int, scip_range array<int>, symbol string, is_definition boolean, enclosing_range array<int>"
INHERITANCE = "child_symbol string, parent_symbol string"
EDGES = "src string, dst string, type string"
CHUNKS = f"file_path string, chunk_index int, language string, parser_name string, {SPAN}, size bigint, content string, symbol_name string, symbol_kind string"
INDEX_DOCUMENTS = f"document_id string, repository_id string, revision string, file_path string, content_hash string, chunk_index int, text string, language string, parser_name string, source_change string, {SPAN}, size bigint, size_unit string, symbol_name string, symbol_kind string"
INDEX_DELETES = "repository_id string, revision string, file_path string, reason string"
VECTORS = "point_id string, node_id string, vector array<float>, workspace_id bigint, branch_id bigint, name string, kind string, file_path string, signature string, summary string, docstring string, identifiers array<string>, formatted_embed_text string"

#: Node types that stand for a definition, a reference, a dependency.
DEFINITIONS = ("type-definition", "function", "variable")
REFERENCES = ("call", "attribute_access", "type_reference")
DEPENDENCIES = ("import", "export")
