"""Message text to typed rows.

Every decoder reads fields as text first and casts afterwards, so that a message that cannot be
parsed and a value that cannot be converted are told apart. Decoders add ``_error``: NULL for a good
row, otherwise the reason.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN_PATH = re.compile(r"^\$(\.[A-Za-z_][A-Za-z_0-9]*)+$")
MALFORMED = "malformed message"


def _schema(ddl: str | T.StructType) -> T.StructType:
    return ddl if isinstance(ddl, T.StructType) else T.StructType.fromDDL(ddl)


def cast_fields(
    rows: DataFrame,
    schema: str | T.StructType,
    strict: bool = True,
    text: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Convert text fields. ``strict``: a bad value marks the row; otherwise it becomes NULL.

    A fraction given for a whole-number column is cut, as lenient loading does (``40.66`` to 40).
    """
    text = text or {}
    fields = _schema(schema).fields
    converted, bad = {}, []
    for field in fields:
        raw = text.get(field.name, F.col(field.name))
        if isinstance(field.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)) and not strict:
            value = raw.try_cast("decimal(38,10)").try_cast(field.dataType)
        else:
            value = raw.try_cast(field.dataType)
        converted[field.name] = value
        if strict:
            bad.append(F.when(raw.isNotNull() & value.isNull(), F.lit(field.name)))
    reason = F.col("_error")
    if bad:
        names = F.concat_ws(", ", *bad)
        reason = F.coalesce(reason, F.when(F.length(names) > 0, F.concat(F.lit("bad value: "), names)))
    others = [c for c in rows.columns if c not in converted and c != "_error"]
    return rows.select(*others, *[c.alias(n) for n, c in converted.items()], reason.alias("_error"))


def _parse_once(rows: DataFrame, parsed: Column) -> DataFrame:
    """Add ``_doc``. Parsing is the costly step; from a generator it runs once per message, while a
    later filter on ``_error`` would be pushed below a projection and parse again for each test."""
    return rows.select("*", F.explode(F.array(parsed)).alias("_doc"))


def _text_struct(paths: Mapping[str, str]) -> T.StructType:
    """All-text schema that holds every plain dotted path once."""
    tree: dict = {}
    for path in paths.values():
        node = tree
        for part in path[2:].split("."):
            node = node.setdefault(part, {})

    def build(node: dict) -> T.DataType:
        if not node:
            return T.StringType()
        return T.StructType([T.StructField(k, build(v)) for k, v in node.items()])

    return build(tree)


def decode_json(
    messages: DataFrame,
    schema: str | T.StructType,
    value: str = "value",
    paths: Mapping[str, str] | None = None,
    root: str | None = None,
    outer_array: bool = False,
    strict: bool = True,
) -> DataFrame:
    """JSON messages to rows; the other columns of ``messages`` stay.

    ``paths`` gives the JSON path of a column (default ``$.<column>``), ``root`` a prefix under which
    the object sits, ``outer_array`` splits ``[{...}, {...}]`` into one row each.
    """
    fields = [f.name for f in _schema(schema).fields]
    where = {name: (paths or {}).get(name, f"$.{name}") for name in fields}
    plain = {n: p for n, p in where.items() if _PLAIN_PATH.match(p)}
    raw = F.col(value)
    source = F.get_json_object(raw, root) if root else raw
    whole = messages.withColumn("_json", source)
    if outer_array:
        # Elements stay JSON text, so one bad element does not spoil its neighbours.
        items = F.from_json("_json", T.ArrayType(T.StringType()))
        # An empty array has no rows; text that is no array has one, which is in error.
        one_null = F.array(F.lit(None).cast("string"))
        whole = whole.withColumn("_json", F.explode(F.coalesce(items, one_null)))
    parsed = F.from_json("_json", _parse_schema(plain), {"columnNameOfCorruptRecord": "_bad"})
    whole = _parse_once(whole, parsed)
    text = {}
    for name, path in where.items():
        if name in plain:
            column = F.col("_doc")
            for part in path[2:].split("."):
                column = column[part]
        else:
            column = F.get_json_object("_json", path)
        text[name] = column
    broken = F.col("_json").isNull() | F.col("_doc").isNull() | F.col("_doc._bad").isNotNull()
    marked = whole.withColumn("_error", F.when(broken, F.lit(MALFORMED)))
    return cast_fields(marked, schema, strict, text).drop("_json", "_doc")


def decode_variant(
    messages: DataFrame,
    schema: str | T.StructType,
    value: str = "value",
    paths: Mapping[str, str] | None = None,
    strict: bool = True,
) -> DataFrame:
    """JSON messages of unknown or changing layout to rows, parsed once into a ``VARIANT``.

    ``paths`` as in ``decode_json``; array elements (``$.a[0].b``) may stand in them. A message that is no
    JSON is malformed; a value that does not fit its type is an error, or null when not ``strict``.
    """
    parsed = _parse_once(messages, F.try_parse_json(value))
    columns, bad = [], []
    for field in _schema(schema).fields:
        path = (paths or {}).get(field.name, f"$.{field.name}")
        got = F.try_variant_get("_doc", path, field.dataType.simpleString())
        columns.append(got.alias(field.name))
        raw = F.try_variant_get("_doc", path, "variant")
        bad.append(F.when(raw.isNotNull() & ~F.is_variant_null(raw) & got.isNull(), F.lit(field.name)))
    names = F.concat_ws(", ", *bad)
    wrong = F.when(F.length(names) > 0, F.concat(F.lit("bad value: "), names)) if strict else F.lit(None).cast("string")
    error = F.when(F.col("_doc").isNull(), F.lit(MALFORMED)).otherwise(wrong)
    return parsed.select(*messages.columns, *columns, error.alias("_error"))


def variant_schema(messages: DataFrame, value: str = "value") -> str:
    """The types found in all messages that are JSON, merged, as DDL; found in one pass."""
    return messages.agg(F.schema_of_variant_agg(F.try_parse_json(value)).alias("found")).first()["found"]


def _parse_schema(plain: Mapping[str, str]) -> T.StructType:
    struct = _text_struct(plain) if plain else T.StructType([])
    return T.StructType([*struct.fields, T.StructField("_bad", T.StringType())])


def decode_csv(
    messages: DataFrame,
    schema: str | T.StructType,
    positions: Sequence[str | None],
    value: str = "value",
    separator: str = ",",
    quote: str = '"',
    strict: bool = False,
    derived: Mapping[str, Column] | None = None,
) -> DataFrame:
    """CSV messages to rows by position.

    ``positions`` lists the name of each input column, ``None`` for one that is not kept. ``derived``
    computes columns from the named text fields (``CRASH_DATE`` from a date and a time column).
    """
    names = [name or f"_skip{i}" for i, name in enumerate(positions)]
    all_text = ", ".join(f"`{n}` STRING" for n in [*names, "_bad"])
    options = {"sep": separator, "quote": quote, "columnNameOfCorruptRecord": "_bad"}
    parsed = _parse_once(messages, F.from_csv(value, all_text, options))
    broken = F.col("_doc").isNull() | F.col("_doc._bad").isNotNull()
    marked = parsed.withColumn("_error", F.when(broken, F.lit(MALFORMED)))
    kept = [n for n in positions if n]
    flat = marked.select(*messages.columns, "_error", *[F.col("_doc")[n].alias(n) for n in kept])
    for name, column in (derived or {}).items():
        flat = flat.withColumn(name, column)
    wanted = [f.name for f in _schema(schema).fields]
    flat = flat.select(*messages.columns, "_error", *wanted)
    return cast_fields(flat, schema, strict)


def side() -> Column:
    return F.when(F.col("_error").isNull(), "good").otherwise("bad")


def split_good_bad(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error. Persist ``decoded`` first if both sides are used."""
    return decoded.where(F.col("_error").isNull()).drop("_error"), decoded.where(F.col("_error").isNotNull())


def load_counters(decoded: DataFrame, selected: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows read, loaded, dropped by the load filter, and in error."""
    good = F.col("_error").isNull()
    chosen = F.coalesce(selected, F.lit(False))
    return decoded.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(good & chosen).alias("loaded_rows"),
        F.count_if(good & ~chosen).alias("unselected_rows"),
        F.count_if(~good).alias("error_rows"),
    )
