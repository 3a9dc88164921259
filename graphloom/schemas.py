"""Types of the node and edge tables. Null means unknown, never the empty string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = {
    "file": "id string, path string, name string, extension string, language string, size_bytes long, line_count long, source_hash string, is_test boolean, is_config boolean, is_vendored boolean, layer string",
    "folder": "id string, path string, name string, depth int",
    "function": "id string, name string, qualified_name string, file_path string, line_start long, line_end long, signature string, docstring string, is_method boolean, is_async boolean, is_exported boolean, decorators array<string>, param_names array<string>, return_type string, source_hash string, is_dead boolean, dead_code_tier string, is_entry_point boolean, is_test boolean, is_module_caller boolean, is_covered boolean, entry_score double, layer string, role string, http_method string, route_path string, runtime_observed boolean, runtime_calls long, runtime_for_hash string",
    "class": "id string, name string, qualified_name string, file_path string, line_start long, line_end long, base_names array<string>, docstring string, source_hash string, is_type_referenced boolean, community_id string",
    "variable": "id string, name string, function_id string, file_path string, line_number long, inferred_type string, is_parameter boolean, is_return boolean",
    "import": "id string, file_path string, module_path string, resolved_path string, imported_names array<string>, aliases map<string,string>, is_wildcard boolean, line_number long",
    "pathway": "id string, name string, display_name string, entry_function string, step_count int, importance double, confidence double, context_doc string, context_hash string",
    "community": "id string, label string, cohesion double, member_count long",
    "process": "id string, entry_function_id string, step_count int",
    "duplicate_symbol": "id string, name string, severity string, reason string, file_paths array<string>, canonical_path string, superseded_paths array<string>",
    "doc_warning": "id string, doc_path string, line_number long, symbol_text string, warning_type string, severity string",
}
_PAIR = "src string, dst string"
EDGES = {
    "contains": _PAIR, "in_folder": _PAIR, "defines": _PAIR, "defines_class": _PAIR, "has_method": _PAIR, "member_of": _PAIR, "class_in": _PAIR,
    "imports": f"{_PAIR}, symbols array<string>, is_wildcard boolean, line long, confidence double",
    "calls": f"{_PAIR}, line long, lines array<long>, args array<string>, confidence double, reason string",
    "flows_into": f"{_PAIR}, via_argument string, line long, confidence double",
    "extends": f"{_PAIR}, confidence double",
    "implements": f"{_PAIR}, confidence double",
    "step_in_pathway": f"{_PAIR}, step_order int, role string",
    "var_in_pathway": f"{_PAIR}, thread string, step int",
    "step_in_process": f"{_PAIR}, step_order int",
    "coupled_with": f"{_PAIR}, change_count long, strength double",
    "makes_http_call": f"{_PAIR}, http_method string, url_pattern string, confidence double, reason string",
}
#: Edge kind to the kinds of its ends.
ENDS = {
    "contains": ("folder", "file"), "in_folder": ("file", "folder"), "defines": ("file", "function"), "defines_class": ("file", "class"), "has_method": ("class", "function"),
    "member_of": ("function", "community"), "class_in": ("class", "community"), "imports": ("file", "file"), "calls": ("function", "function"), "flows_into": ("variable", "variable"),
    "extends": ("class", "class"), "implements": ("class", "class"), "step_in_pathway": ("function", "pathway"), "var_in_pathway": ("variable", "pathway"),
    "step_in_process": ("function", "process"), "coupled_with": ("file", "file"), "makes_http_call": ("function", "function"),
}
#: Where a column that a table lacks gets a value other than null.
DEFAULTS: dict[str, object] = {"is_dead": False, "is_covered": False, "runtime_observed": False, "runtime_calls": 0, "is_type_referenced": False}


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the table's columns: casts, and adds what an older version lacks."""
    wanted = (NODES | EDGES)[table]
    out: list[Column] = []
    for field in df.sparkSession.createDataFrame([], wanted).schema:
        have = F.col(field.name) if field.name in df.columns else F.lit(DEFAULTS.get(field.name))
        out.append(have.cast(field.dataType).alias(field.name))
    return df.select(*out)
