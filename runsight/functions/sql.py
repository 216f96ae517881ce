"""The column functions by name in the user's SQL: temporary functions whose bodies are SQL themselves.

The optimizer puts a body in place of its call, so a query in SQL text has the plan that the DataFrame operators have, without Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from runsight.functions.columns import OUTSIDE_NAME

_SECTION = "MAP<STRING, VARIANT>"
_ITEM = "STRUCT<ID: BIGINT, Name: STRING, `Update`: STRING, Value: STRING>"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(value: str) -> str:
    return f"lower(regexp_replace({value}, '{OUTSIDE_NAME}', '_'))"


def _integers(section: str, prefix: str, depth: int) -> str:
    """SQL for the `"name":value` texts of a section's integers, and of those in its objects."""
    entry = f"e{depth}"
    name = f"concat({prefix}, {_name(entry + '.key')})"
    number = f"CASE WHEN schema_of_variant({entry}.value) = 'BIGINT' THEN array(concat('\"', {name}, '\":', to_json({entry}.value))) END"
    parts = [number, "CAST(array() AS ARRAY<STRING>)"]
    if depth > 1:
        inner = f"try_variant_get({entry}.value, '$', '{_SECTION.lower()}')"
        parts.insert(0, _integers(inner, f"concat({name}, '__')", depth - 1))
    return f"flatten(transform(map_entries({section}), {entry} -> coalesce({', '.join(parts)})))"


def _object(pairs: str) -> str:
    return f"concat('{{', coalesce(array_join({pairs}, ','), ''), '}}')"


def _latest(items: str, field: str) -> str:
    value = f"i.{field}"
    number = f"CASE WHEN {value} RLIKE '^\\\\s*[+-]?[0-9]+\\\\s*$' THEN try_cast({value} AS BIGINT) END"
    ranked = f"""sort_array(filter(transform({items}, (i, place) -> struct(i.ID AS id, place AS place, {_name('i.Name')} AS name, {number} AS value)),
        i -> array_contains(transform(names, n -> {_name('n')}), i.name)))"""
    pairs = f"""transform({ranked}, i -> concat('"', i.name, '_id":', CAST(i.id AS STRING),
        coalesce(concat(',"', i.name, '":', CAST(i.value AS STRING)), '')))"""
    return _object(f"CASE WHEN NOT exists({items}, i -> i.ID IS NULL) THEN {pairs} END")


def sql_functions(section: str = "Task Metrics", items: tuple[str, str] = ("Task Info", "Accumulables"), depth: int = 3) -> dict[str, tuple[str, str, str]]:
    """Name to (parameters, type, body) of each function."""
    parsed = f"from_json(record, {_text(f'`{section}` {_SECTION}')})['{section}']"
    listed = f"from_json(record, {_text(f'`{items[0]}` STRUCT<`{items[1]}`: ARRAY<{_ITEM}>>')})['{items[0]}']['{items[1]}']"
    return {
        "canonical_name": ("name STRING", "STRING", _name("name")),
        "epoch_ms_text": ("ms BIGINT", "STRING", "date_format(timestamp_millis(ms), 'yyyy-MM-dd HH:mm:ss')"),
        "percent_of": ("part DOUBLE, whole DOUBLE", "DOUBLE", "try_divide(part * 100, whole)"),
        "flatten_metrics": ("record STRING", "STRING", _object(_integers(parsed, "''", depth))),
        "latest_values": ("record STRING, names ARRAY<STRING>", "STRING", _latest(listed, "Value")),
        "latest_updates": ("record STRING, names ARRAY<STRING>", "STRING", _latest(listed, "`Update`")),
    }


def register_sql_functions(spark: SparkSession, prefix: str = "", **options) -> list[str]:
    """Create the functions for this session under their names with `prefix`; returns the names.

    `flatten_metrics(record)` and `latest_values(record, names)` give the flat JSON object that `flatten_int_json` and `latest_by_id` give:
    `from_json` takes the wanted fields out of it.
    """
    made = []
    for name, (parameters, kind, body) in sql_functions(**options).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
        made.append(prefix + name)
    return made
