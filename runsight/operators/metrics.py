"""Metrics of a task record as typed structs, extracted without leaving the JVM.

Both extractors build a flat JSON object of integers and parse it once with the wanted fields. The parser keeps
the last of several equal names, which is the wanted rule for metrics and for accumulables sorted by ID.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from runsight.functions import canonical_name, canonical_text
from runsight.operators.metric_keys import ACCUMULABLE_KEYS, TASK_METRIC_KEYS

_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_SECTION = "map<string,variant>"
_ITEMS = "array<struct<ID:bigint,Name:string,Update:string,Value:string>>"


def metric_struct(keys: Iterable[str]) -> StructType:
    return StructType([StructField(key, LongType(), True) for key in keys])


def accumulable_struct(keys: Iterable[str]) -> StructType:
    fields = []
    for key in map(canonical_text, keys):
        fields.append(StructField(key, LongType(), True))
        fields.append(StructField(f"{key}_id", IntegerType(), True))
    return StructType(fields)


def _integer_pairs(section: Column, prefix: Column | None, depth: int) -> Column:
    """`"name":value` texts for the integers of a map of variants and of the objects in it."""

    def of_entry(entry: Column) -> Column:
        name = canonical_name(entry["key"])
        name = name if prefix is None else F.concat(prefix, name)
        number = F.when(
            F.schema_of_variant(entry["value"]) == "BIGINT",
            F.array(F.concat(F.lit('"'), name, F.lit('":'), F.to_json(entry["value"]))),
        )
        if depth <= 1:
            return F.coalesce(number, F.array().cast("array<string>"))
        inner = F.try_variant_get(entry["value"], "$", _SECTION)
        nested = _integer_pairs(inner, F.concat(name, F.lit("__")), depth - 1)
        return F.coalesce(nested, number, F.array().cast("array<string>"))

    return F.flatten(F.transform(F.map_entries(section), of_entry))


def _as_object(pairs: Column) -> Column:
    return F.concat(F.lit("{"), F.coalesce(F.array_join(pairs, ","), F.lit("")), F.lit("}"))


def flatten_ints(section: Column, depth: int = 3) -> Column:
    """A map of variants as one flat JSON object: integers only, nested names joined with `__`."""
    return _as_object(_integer_pairs(section, None, depth))


def flatten_int_json(record: Column | str, section: str = "Task Metrics", depth: int = 3) -> Column:
    """`flatten_ints` of one section of a JSON text; `{}` for a missing section or bad JSON."""
    parsed = F.from_json(record, f"`{section}` {_SECTION}")
    return flatten_ints(parsed[section], depth)


def latest_values(items: Column, keys: Sequence[str] = ACCUMULABLE_KEYS, field: str = "Value") -> Column:
    """Named items as one flat JSON object: per wanted name its latest id and its latest integer value.

    "Latest" is the highest ID, then the last position. An item without an ID makes the whole result empty.
    """
    if field not in ("Value", "Update"):
        raise ValueError("field must be 'Value' or 'Update'")
    wanted = [canonical_text(key) for key in keys]

    def integer(text: Column) -> Column:
        # A failing try_cast costs far more than the pattern test in front of it.
        return F.when(text.rlike(_INTEGER), text.try_cast("bigint"))

    ranked = F.sort_array(
        F.filter(
            F.transform(
                items,
                lambda item, position: F.struct(
                    item["ID"].alias("id"),
                    position.alias("position"),
                    canonical_name(item["Name"]).alias("name"),
                    integer(item[field]).alias("value"),
                ),
            ),
            lambda item: item["name"].isin(wanted),
        )
    )
    pairs = F.transform(
        ranked,
        lambda item: F.concat(
            F.lit('"'),
            item["name"],
            F.lit('_id":'),
            item["id"].cast("string"),
            F.coalesce(F.concat(F.lit(',"'), item["name"], F.lit('":'), item["value"].cast("string")), F.lit("")),
        ),
    )
    return _as_object(F.when(~F.exists(items, lambda item: item["ID"].isNull()), pairs))


def latest_by_id(
    record: Column | str,
    keys: Sequence[str] = ACCUMULABLE_KEYS,
    section: Sequence[str] = ("Task Info", "Accumulables"),
    field: str = "Value",
) -> Column:
    """`latest_values` of an item list inside a JSON text; `{}` for a missing list or bad JSON."""
    outer, inner = section
    parsed = F.from_json(record, f"`{outer}` struct<`{inner}`: {_ITEMS}>")
    return latest_values(parsed[outer][inner], keys, field)


def with_metrics(
    df: DataFrame,
    keys: Sequence[str] = TASK_METRIC_KEYS,
    record_col: str = "logMessage",
    out: str = "task_metrics",
    keep_json: bool = False,
) -> DataFrame:
    """Add the struct of task metrics, from the raw record."""
    return _with_struct(df, flatten_int_json(record_col), metric_struct(keys), out, keep_json)


def with_accumulables(
    df: DataFrame,
    keys: Sequence[str] = ACCUMULABLE_KEYS,
    record_col: str = "logMessage",
    out: str = "task_accumulables",
    where: Column | str | None = None,
    field: str = "Value",
    keep_json: bool = False,
) -> DataFrame:
    """Add the struct of accumulables, from the raw record; `where` filters rows first."""
    if where is not None:
        df = df.filter(where)
    return _with_struct(df, latest_by_id(record_col, keys, field=field), accumulable_struct(keys), out, keep_json)


def _with_struct(df: DataFrame, text: Column, schema: StructType, out: str, keep_json: bool) -> DataFrame:
    json_col = f"{out}_json"
    df = df.withColumn(json_col, text).withColumn(out, F.from_json(json_col, schema))
    return df if keep_json else df.drop(json_col)


def discover_keys(df: DataFrame, record_col: str = "logMessage") -> DataFrame:
    """Every metric name found in the records: columns `kind` (metric, accumulable), `name`, `records`."""
    metric_names = F.transform(
        F.json_object_keys(flatten_int_json(record_col)),
        lambda name: F.struct(F.lit("metric").alias("kind"), name.alias("name")),
    )
    items = F.from_json(record_col, f"`Task Info` struct<Accumulables: {_ITEMS}>")["Task Info"]["Accumulables"]
    item_names = F.transform(
        F.array_distinct(F.transform(items, lambda item: canonical_name(item["Name"]))),
        lambda name: F.struct(F.lit("accumulable").alias("kind"), name.alias("name")),
    )
    # Cheap necessary test before the parse: both sections' names begin so. A text with escapes may spell them differently.
    df = df.filter(F.col(record_col).contains('"Task ') | F.col(record_col).contains("\\u"))
    empty = F.array().cast("array<struct<kind:string,name:string>>")
    found = F.concat(F.coalesce(metric_names, empty), F.coalesce(item_names, empty))
    return (
        df.select(F.explode(found).alias("found"))
        .select("found.kind", "found.name")
        .groupBy("kind", "name")
        .agg(F.count(F.lit(1)).alias("records"))
    )
