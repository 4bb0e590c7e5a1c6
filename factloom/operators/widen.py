"""Problem 4: entity, attribute, value rows into wide typed tables, by streamed sparse columnar builders.

Rows are combined per entity and registered attribute before the shuffle, so an entity with a third of all rows sends a few
rows per task. Within each partition they are sorted by entity and streamed through builders: attributes are column indices,
and each output column is gathered from the typed input buffer through an index array whose gaps become the validity mask.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import filled, trimmed

#: Value types of the registry and the typed buffer each is carried in. A whole number of more than 38 digits, or a decimal of more than
#: 26 before or 12 after the point, has no exact value of its column's type: it goes into the map exact_numbers as canonical text.
BUFFERS = {"string": "s", "int": "w", "decimal": "n", "boolean": "b", "date": "d", "timestamp": "t", "string_list": "l"}
SQL_TYPES = {"string": "string", "int": "decimal(38,0)", "decimal": "decimal(38,12)", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz", "string_list": "array<string>"}
_ARROW = {"s": pa.string(), "w": pa.decimal128(38, 0), "n": pa.decimal128(38, 12), "b": pa.bool_(), "d": pa.date32(), "t": pa.timestamp("us"), "l": pa.list_(pa.string())}
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def key_form(c: Column | str) -> Column:
    """A key without letter case and blanks, with - for _."""
    return F.translate(F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]+", "")), "_", "-")


def _canonical(sign: Column, whole: Column, fraction: Column) -> Column:
    """A number in plain notation from its digits, without needless zeros."""
    w, f = F.regexp_replace(whole, "^0+(?=.)", ""), F.regexp_replace(fraction, "0+$", "")
    text = F.when(f == "", w).otherwise(F.concat(w, F.lit("."), f))
    return F.when(text == "0", text).otherwise(F.concat(F.when(sign == "-", "-").otherwise(""), text))


def _whole(t: Column) -> Column:
    """A whole number as canonical text, of any length; commas may separate thousands."""
    plain = F.when(t.rlike(r"^[+-]?(\d+|\d{1,3}(,\d{3})+)(\.0+)?$"), F.replace(t, F.lit(","), F.lit("")))
    return _canonical(F.substring(plain, 1, 1), F.regexp_extract(plain, r"^[+-]?(\d+)", 1), F.lit(""))


_NUMBER = r"^([+-]?)(\d*)[.,]?(\d*)(?:[eE]([+-]?\d{1,3}))?$"


def _decimal(t: Column) -> Column:
    """A decimal as canonical text, of any length; the point may be a comma, and an exponent is worked out."""
    good = F.when(t.rlike(r"^[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d{1,3})?$"), t)
    sign, whole, fraction = (F.regexp_extract(good, _NUMBER, i) for i in (1, 2, 3))
    # with an exponent the point moves over the digits, which zeros lengthen on either side
    power = F.regexp_extract(good, _NUMBER, 4).cast("int")
    digits = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), -power)), whole, fraction, F.repeat(F.lit("0"), F.greatest(F.lit(0), power)))
    point = F.length(whole) + F.greatest(F.lit(0), power) + F.least(F.lit(0), power) + F.greatest(F.lit(0), -power)
    moved = _canonical(sign, F.concat(F.lit("0"), F.substring(digits, F.lit(1), point)), F.substring(digits, point + 1, F.length(digits)))
    return F.when(good.rlike("[eE]"), moved).otherwise(_canonical(sign, F.concat(F.lit("0"), whole), fraction))


def _boolean(t: Column) -> Column:
    low = F.lower(t)
    return F.when(low.isin("true", "t", "yes", "y", "1", "on"), True).when(low.isin("false", "f", "no", "n", "0", "off"), False)


_ISO = r"^(\d{4})-(\d{1,2})-(\d{1,2})[T ](\d{1,2}):(\d{2})((?::\d{2})?)(?:[.,]\d+)?\s*(?:Z|z|UTC|[+-]\d{2}:?\d{2})?$"
_OFFSET = r"([+-]\d{2}):?(\d{2})$"


def _moment(t: Column) -> Column:
    """A time stamp in UTC: ISO with or without fraction and offset, or seconds or milliseconds since 1970."""
    local = F.when(t.rlike(_ISO), F.regexp_replace(t, _ISO, "$1-$2-$3 $4:$5$6")).try_cast("timestamp_ntz")
    part = lambda i: F.regexp_extract(t, _OFFSET, i)
    away = F.when(t.rlike(":" + r"\d{2}.*" + _OFFSET), part(1).cast("int") * 60 + F.concat(F.substring(part(1), 1, 1), part(2)).cast("int")).otherwise(0)
    seconds = F.when(t.rlike(r"^\d{10}(\d{3})?$"), F.substring(t, 1, 10)).cast("int")
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.coalesce(F.timestamp_add("MINUTE", -away, local), F.timestamp_add("SECOND", seconds, start))


def _day(t: Column) -> Column:
    """A day: y-m-d, y/m/d, yyyymmdd, `d Mon yyyy`, or that of a time stamp in UTC."""
    named = r"^(\d{1,2})[ .-]+([A-Za-z]{3})[a-z]*[ .,-]+(\d{4})$"
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(F.regexp_extract(t, named, 2)))
    dashed = F.regexp_replace(F.regexp_replace(t, r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3"), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    plain = F.when(t.rlike(named), F.concat_ws("-", F.regexp_extract(t, named, 3), month.cast("string"), F.regexp_extract(t, named, 1))).otherwise(dashed)
    return F.when(t.contains(":"), _moment(t).cast("date")).when(plain.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), plain.try_cast("date"))


def _texts(v: Column) -> Column:
    """The texts a list value delivers: those of a JSON array, else the value itself; blanks are left out."""
    parsed = F.when(trimmed(v).startswith("["), F.from_json(trimmed(v), "array<string>"))
    return F.filter(F.transform(F.coalesce(parsed, F.array(v)), filled), lambda x: x.isNotNull())


def _registry(keys: DataFrame) -> list[tuple[str, str, str]]:
    """(entity_kind, ext_key, value_type), sorted. The registry is the wide tables' schema, so it has to be known to plan them."""
    rows = [(r[0], r[1], r[2]) for r in keys.select("entity_kind", "ext_key", "value_type").distinct().collect() if all(r)]
    return sorted(r for r in rows if r[2] in BUFFERS)


def _norm(key: str) -> str:
    return re.sub(r"\s+", "", key).lower().replace("_", "-")


def cells(values: DataFrame, registry: list[tuple[str, str, str]]) -> DataFrame:
    """entity_kind, entity_id, idx and one typed buffer per type; idx -1 stands for an entity's unregistered keys."""
    index = F.create_map(*(F.lit(x) for i, (kind, key, _) in enumerate(registry) for x in (f"{kind}|{_norm(key)}", i)))
    is_list = F.col("idx").isin([i for i, r in enumerate(registry) if r[2] == "string_list"] or [-2])
    rows = values.where(F.col("entity_id").isNotNull() & F.col("entity_kind").isNotNull()).select(
        "entity_kind", "entity_id", "ext_value", "loaded_at",
        F.coalesce(F.try_element_at(index, F.concat("entity_kind", F.lit("|"), F.coalesce(key_form("ext_key"), F.lit("")))), F.lit(-1)).alias("idx"),
    )
    rows = rows.select("entity_kind", "entity_id", "idx", F.when(~is_list & (F.col("idx") >= 0), F.struct("loaded_at", "ext_value")).alias("v"), F.explode_outer(F.when(is_list, _texts(F.col("ext_value")))).alias("item"))
    last = rows.groupBy("entity_kind", "entity_id", "idx").agg(F.max("v").alias("v"), F.sort_array(F.collect_set("item")).alias("items"))
    of = lambda *types: F.col("idx").isin([i for i, r in enumerate(registry) if r[2] in types] or [-2])
    # the trimmed text is a column of its own, so that no branch computes it again
    last = last.select("entity_kind", "entity_id", "idx", filled(F.col("v.ext_value")).alias("_t"), "items")
    t = F.col("_t")
    last = last.select("*", F.when(of("int"), _whole(t)).when(of("decimal"), _decimal(t)).alias("_n"))
    n = F.col("_n")
    fits = n.rlike(r"^-?\d{1,38}$") & of("int") | n.rlike(r"^-?\d{1,26}(\.\d{1,12})?$") & of("decimal")
    return last.select(
        "entity_kind", "entity_id", F.col("idx").cast("int").alias("idx"),
        F.when(of("string"), t).alias("s"), F.when(of("int") & fits, n.cast("decimal(38,0)")).alias("w"), F.when(of("decimal") & fits, n.cast("decimal(38,12)")).alias("n"), F.when(~fits, n).alias("x"), F.when(of("boolean"), _boolean(t)).alias("b"),
        F.when(of("date"), _day(t)).alias("d"), F.when(of("timestamp"), _moment(t)).alias("t"), F.when(of("string_list") & (F.size("items") > 0), F.col("items")).alias("l"),
    )


def column_names(registry: list[tuple[str, str, str]]) -> list[str]:
    return [f"{kind}:{key}" for kind, key, _ in registry]


def wide(values: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per entity: entity_kind, entity_id, exact_numbers and a typed column `kind:key` for each registered key; see wide_table().

    exact_numbers maps a column's name to the canonical text of a number that the column's type cannot hold exactly; the column
    itself is null then. So no number is rounded or lost, whatever its length.

    A single value is the latest by loaded_at (null lowest, ties: the largest text); if it is null, blank or not readable as
    its type the cell is null. A list holds the distinct non-blank values of all rows of its key, sorted. Rows without an
    entity are ignored; an entity with only unregistered keys has a row of nulls; an empty table gives no rows.
    """
    registry = _registry(keys)
    names = column_names(registry)
    kinds = [BUFFERS[r[2]] for r in registry]
    types = [_ARROW[BUFFERS[r[2]]] for r in registry]
    schema = pa.schema([("entity_kind", pa.string()), ("entity_id", pa.string()), ("exact_numbers", pa.map_(pa.string(), pa.string())), *zip(names, types)])

    def build(batch: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
        """batch holds whole entities, sorted."""
        n = batch.num_rows
        ids, kind, idx = batch.column("entity_id"), batch.column("entity_kind"), batch.column("idx").to_numpy(zero_copy_only=False)
        same = np.zeros(n, dtype=bool)
        if n > 1:
            a, b = batch.slice(0, n - 1), batch.slice(1)
            same[1:] = pc.and_(pc.equal(a.column("entity_id"), b.column("entity_id")), pc.equal(a.column("entity_kind"), b.column("entity_kind"))).to_numpy(zero_copy_only=False)
        row = np.cumsum(~same) - 1
        first = pa.array(np.flatnonzero(~same))
        exact = batch.column("x")
        there = np.flatnonzero(exact.is_valid().to_numpy(zero_copy_only=False))
        offsets = np.zeros(len(first) + 1, dtype=np.int32)
        np.cumsum(np.bincount(row[there], minlength=len(first)), out=offsets[1:])
        exact_numbers = pa.MapArray.from_arrays(pa.array(offsets), pa.array([names[i] for i in idx[there]], pa.string()), exact.take(pa.array(there)))
        out = [kind.take(first), ids.take(first), exact_numbers]
        for j, (k, t) in enumerate(zip(kinds, types)):
            at = np.full(len(first), -1, dtype=np.int64)
            here = np.flatnonzero(idx == j)
            at[row[here]] = here
            out.append(batch.column(k).take(pa.array(at, mask=at < 0)).cast(t))
        return pa.RecordBatch.from_arrays(out, schema=schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            # the last entity may go on in the next batch; it has at most one row per registered key
            last = batch.num_rows - 1
            ids, kinds_ = batch.column("entity_id"), batch.column("entity_kind")
            while last > 0 and ids[last - 1] == ids[last] and kinds_[last - 1] == kinds_[last]:
                last -= 1
            if last:
                yield build(batch.slice(0, last))
            held = batch.slice(last)
        if held is not None:
            yield build(held)

    spark_schema = "entity_kind string, entity_id string, exact_numbers map<string,string>" + "".join(f", `{n}` {SQL_TYPES[r[2]]}" for n, r in zip(names, registry))
    shuffled = cells(values, registry).repartition("entity_kind", "entity_id").sortWithinPartitions("entity_kind", "entity_id", "idx")
    return shuffled.mapInArrow(stream, spark_schema)


def wide_table(values: DataFrame, keys: DataFrame, kind: str) -> DataFrame:
    """The wide table of one kind of entity: entity_id, its registered keys as typed columns (dots and dashes as in the key), and exact_numbers
    with the numbers that no column's type can hold, by registered key."""
    full = wide(values.where(F.col("entity_kind") == kind), keys.where(F.col("entity_kind") == kind))
    exact = F.transform_keys("exact_numbers", lambda k, _: F.substring(k, F.lit(len(kind) + 2), F.length(k)))
    return full.select("entity_id", exact.alias("exact_numbers"), *(F.col(f"`{c}`").alias(c.split(":", 1)[1]) for c in full.columns[3:]))


def cell_text(c: Column, value_type: str) -> Column:
    """A typed cell as text: numbers in plain notation without needless zeros, times in UTC, lists joined by |."""
    if value_type in ("int", "decimal"):
        return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if value_type == "date":
        return F.date_format(c, "yyyy-MM-dd")
    if value_type == "timestamp":
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if value_type == "string_list":
        return F.array_join(c, "|")
    return c.cast("string")


def _cell(kind: str, key: str, value_type: str) -> Column:
    """The cell as text; a number that its column cannot hold comes from exact_numbers."""
    text = cell_text(F.col(f"`{kind}:{key}`"), value_type)
    return F.coalesce(text, F.try_element_at("exact_numbers", F.lit(f"{kind}:{key}"))) if value_type in ("int", "decimal") else text


def filled_cells(values: DataFrame, keys: DataFrame) -> DataFrame:
    """entity_id, ext_key, cell_value: the wide tables' filled cells as text."""
    full = wide(values, keys)
    registry = _registry(keys)
    rows = F.array(*(F.struct(F.lit(key).alias("ext_key"), _cell(kind, key, t).alias("cell_value")) for kind, key, t in registry))
    return full.select("entity_id", F.inline(F.filter(rows, lambda r: r["cell_value"].isNotNull())))
