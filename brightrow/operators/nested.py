"""Flattening of nested data and parsing of messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from brightrow.columns import ref


def _leaves(kind: T.StructType, source: Column | None, prefix: str, sep: str):
    """(name, type, expression) of every field that is not a struct."""
    for field in kind.fields:
        name = f"{prefix}{sep}{field.name}" if prefix else field.name
        value = ref(field.name) if source is None else source.getField(field.name)
        if isinstance(field.dataType, T.StructType):
            yield from _leaves(field.dataType, value, name, sep)
        else:
            yield name, field.dataType, value


def flatten(df: DataFrame, sep: str = ".", arrays: str = "keep") -> DataFrame:
    """Struct fields become columns; arrays stay, or become JSON text (``arrays="json"``)."""
    if arrays not in ("keep", "json"):
        raise ValueError(f"arrays must be keep or json, not {arrays!r}")
    out = []
    for name, kind, value in _leaves(df.schema, None, "", sep):
        if arrays == "json" and isinstance(kind, (T.ArrayType, T.MapType)):
            value = F.to_json(value)
        out.append(value.alias(name))
    return df.select(*out)


def _paths(kind: T.DataType, value: Column, path: Column, sep: str) -> Column:
    """Array of (path, value) entries below a value of a known type."""
    if isinstance(kind, T.StructType):
        parts = [
            _paths(f.dataType, value.getField(f.name), F.concat(path, F.lit(sep + f.name)), sep)
            for f in kind.fields
        ]
        return F.flatten(F.array(*parts))
    if isinstance(kind, T.ArrayType):
        inner = F.transform(
            value,
            lambda item, i: _paths(
                kind.elementType, item, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), sep
            ),
        )
        return F.coalesce(F.flatten(inner), F.array().cast("array<struct<path:string,value:string>>"))
    return F.array(F.struct(path.alias("path"), value.cast("string").alias("value")))


def flatten_indexed(df: DataFrame, keys: Sequence[str], col: str | None = None, sep: str = ".") -> DataFrame:
    """Long form (keys, path, value): list items get paths such as ``tags[0]`` or ``rows[2].x``."""
    kind = df.schema if col is None else df.schema[col].dataType
    parts = [
        _paths(f.dataType, ref(f.name) if col is None else ref(col).getField(f.name), F.lit(f.name), sep)
        for f in kind.fields
        if col is not None or f.name not in keys
    ]
    return df.select(*[ref(k) for k in keys], F.inline(F.flatten(F.array(*parts))))


def widen(
    df: DataFrame, keys: Sequence[str], col: str | None = None, sep: str = ".", max_paths: int | None = None
) -> DataFrame:
    """One text column per path of :func:`flatten_indexed`, in the order of the paths.

    The type tells all paths but the lengths of the lists: the longest of each are found
    by one aggregate per level of nesting. Then the columns are a plain selection. With
    ``max_paths``, more columns than that are an error.
    """
    kind = df.schema if col is None else df.schema[col].dataType
    todo = [
        (f.name, f.dataType, ref(f.name) if col is None else ref(col).getField(f.name))
        for f in kind.fields
        if col is not None or f.name not in keys
    ]
    done: list[tuple[str, Column]] = []
    while todo:
        lists = []
        while todo:
            path, kind, value = todo.pop()
            if isinstance(kind, T.StructType):
                todo += [(path + sep + f.name, f.dataType, value.getField(f.name)) for f in kind.fields]
            elif isinstance(kind, T.ArrayType):
                lists.append((path, kind.elementType, value))
            else:
                done.append((path, value.cast("string")))
        if lists:
            longest = df.agg(*[F.max(F.size(v)).alias(f"n{i}") for i, (_, _, v) in enumerate(lists)]).first()
            for (path, kind, value), size in zip(lists, longest):
                todo += [(f"{path}[{i}]", kind, F.get(value, F.lit(i))) for i in range(max(0, size or 0))]
        if max_paths is not None and len(done) + len(todo) > max_paths:
            raise ValueError(f"more than {max_paths} distinct paths")
    return df.select(*[ref(k) for k in keys], *[v.alias(p) for p, v in sorted(done, key=lambda d: d[0])])


def json_schema(df: DataFrame, col: str) -> str:
    """Common struct type of a JSON text column, found by one aggregate."""
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(ref(col))).alias("s")).first()["s"]
    return found.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING")


def parse_json(df: DataFrame, col: str, schema: str | T.StructType | None = None, into: str | None = None) -> DataFrame:
    """JSON text to a struct column, the schema inferred when none is given."""
    return df.withColumn(into or col, F.from_json(ref(col), schema or json_schema(df, col)))


def parse_messages(df: DataFrame, col: str, schema: str | T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """Message text to columns; text that is no JSON object lands in ``raw`` instead."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    # Only a valid text is looked at twice: once to tell objects apart, once for its fields.
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(ref(col))).startswith("OBJECT"), F.lit(False))
    staged = df.withColumn("__o", is_object)
    staged = staged.withColumn("__m", F.when(F.col("__o"), F.from_json(ref(col), kind)))
    return staged.select(
        *[ref(k) for k in keep],
        *[F.col("__m").getField(f.name).alias(f.name) for f in kind.fields],
        F.when(~F.col("__o"), ref(col)).alias("raw"),
    )


def payload_columns(df: DataFrame, col: str, schema: str | T.StructType | None = None, sep: str = ".") -> DataFrame:
    """API payload text to columns: objects flatten, lists become JSON text, scalars go to ``value``.

    A top-level list makes one row per item.
    """
    variant = F.try_parse_json(ref(col))
    items = F.when(
        F.schema_of_variant(variant).startswith("ARRAY"), F.try_variant_get(variant, "$", "array<variant>")
    ).otherwise(F.array(variant))
    rows = df.select(F.explode(items).alias("__v")).select(F.to_json("__v").alias("__t"), "__v")
    is_object = F.schema_of_variant("__v").startswith("OBJECT")
    objects = F.when(is_object, F.col("__t"))
    schema = schema or json_schema(rows.withColumn("__o", objects), "__o")
    parsed = rows.select(
        F.from_json(objects, schema).alias("data"),
        F.when(~is_object, F.try_variant_get("__v", "$", "string")).alias("value"),
    )
    flat = flatten(parsed.select("data.*", "value"), sep, arrays="json")
    return flat


def last_repeated(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Repeated child elements (arrays) reduced to the last one, at every depth."""
    chosen = {
        f.name: _last(f.dataType, ref(f.name))
        for f in df.schema.fields
        if (cols is None or f.name in set(cols)) and _repeats(f.dataType)
    }
    return df.withColumns(chosen) if chosen else df


def _repeats(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_repeats(f.dataType) for f in kind.fields)
    return isinstance(kind, T.ArrayType)


def _last(kind: T.DataType, value: Column) -> Column:
    if isinstance(kind, T.ArrayType):
        return _last(kind.elementType, F.try_element_at(value, F.lit(-1)))
    if isinstance(kind, T.StructType) and _repeats(kind):
        fields = [_last(f.dataType, value.getField(f.name)).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value
