"""What a reader's client makes of a feed, and how signals travel as JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def feed_view(signals: DataFrame, read: DataFrame, threshold: int, by: str = "run_id") -> DataFrame:
    """Per feed: items, whether it is a quiet day or a failure, items over the notification threshold, and unread ones.

    Columns read: ``signal_id, signal_type, score`` and of ``read`` ``signal_id``.
    """
    seen = read.select("signal_id").distinct().withColumn("_read", F.lit(True))
    item = F.col("signal_type") == "digest_item"
    counts = {"items": item, "notified": item & (F.col("score") >= threshold), "unread": F.col("_read").isNull()}
    kinds = {f"is_{k}": F.max(F.coalesce(F.col("signal_type") == k, F.lit(False))) for k in ("quiet_day", "run_failure")}
    return signals.join(seen, "signal_id", "left").groupBy(by).agg(*[F.count(F.when(c, 1)).alias(n) for n, c in counts.items()], *[c.alias(n) for n, c in kinds.items()])


def is_stale(for_date: Column, today: Column, snapshot: Column) -> Column:
    """A stored snapshot, a feed without a day, or one of a day before."""
    return snapshot | F.coalesce(for_date < today, F.lit(True))


def encode(rows: DataFrame, key: str) -> DataFrame:
    """``key, document``: each row as a JSON object."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("document"))


def _paths(json: Column, kind: DataType, at: str, extra: bool) -> Column:
    """Paths of fields that a JSON value has and its type lacks (``extra``), or the other way, at all depths that the type has."""
    none = F.expr("cast(array() as array<string>)")
    if isinstance(kind, ArrayType):
        if not isinstance(kind.elementType, ArrayType | StructType):
            return none
        elements = F.coalesce(F.from_json(json, "array<string>"), none)
        return F.flatten(F.transform(elements, lambda e: _paths(e, kind.elementType, f"{at}[]", extra)))
    if not isinstance(kind, StructType):
        return none
    keys, names = F.json_object_keys(json), F.array(*[F.lit(f.name) for f in kind.fields])
    here = F.array_except(keys, names) if extra else F.array_except(names, keys)
    dot = f"{at}." if at else ""
    inner = [_paths(F.get_json_object(json, f"$['{f.name}']"), f.dataType, dot + f.name, extra) for f in kind.fields if isinstance(f.dataType, ArrayType | StructType)]
    return F.when(keys.isNotNull(), F.concat(F.transform(here, lambda k: F.concat(F.lit(dot), k)), *inner)).otherwise(none)


def decode(documents: DataFrame, schema: StructType, document: str = "document") -> DataFrame:
    """Adds ``value`` (null if the document is no object), paths of ``unknown`` fields in order, and of ``missing`` ones.

    Fields are compared at all depths that the schema has: ``facts[].by.name`` is a field of an object within those of an array.
    """
    whole = F.json_object_keys(document).isNotNull()
    found = {k: F.array_sort(F.array_distinct(_paths(F.col(document), schema, "", extra))) for k, extra in (("unknown", True), ("missing", False))}
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    return documents.withColumns({"value": F.when(whole, F.from_json(document, schema)), "unknown": found["unknown"], "missing": F.when(whole, found["missing"]).otherwise(F.array_sort(names))})


def decode_items(documents: DataFrame, schema: StructType, required: tuple[str, ...], field: str = "signals", document: str = "document") -> DataFrame:
    """Adds ``items``, those elements of a feed's array that decode, and ``dropped``, how many do not.

    An element is lost if it is no object, or if a required field is absent, null or of another type; others are null then.
    """
    raw = F.coalesce(F.from_json(F.get_json_object(document, f"$['{field}']"), "array<string>"), F.expr("cast(array() as array<string>)"))
    read = F.transform(raw, lambda e: F.when(F.json_object_keys(e).isNotNull(), F.from_json(e, schema)))
    good = F.filter(read, lambda v: reduce(lambda a, b: a & b, [v[r].isNotNull() for r in required], v.isNotNull()))
    return documents.withColumns({"items": good, "dropped": F.size(raw) - F.size(good)})


def delivered(runs: DataFrame, log: str = "log_json") -> DataFrame:
    """Runs that ended well and whose log holds a delivery that did."""
    entries = F.from_json(F.col(log), "delivery array<struct<channel:string,status:string>>")["delivery"]
    return runs.filter((F.col("status") == "ok") & F.coalesce(F.exists(entries, lambda d: d["status"] == "ok"), F.lit(False)))


def moment(text: Column) -> Column:
    """A time stamp in any of the forms feeds use, as UTC; null if it is none."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])
