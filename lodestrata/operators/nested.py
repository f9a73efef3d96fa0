"""Deeply nested records as flat tables, by Dewey labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.text import strict_json

NODE = "array<struct<path:string,label:array<int>,value:string>>"


def _fields(kind: T.DataType) -> list[T.StructField]:
    return list(kind.fields) if isinstance(kind, T.StructType) else []


def _nodes(column: Column, kind: T.ArrayType, path: str, label: Column, values: bool) -> Column:
    """Nodes of an array column and of all arrays below it; null elements keep their place but give no node."""
    element = kind.elementType
    nested = [(i, f) for i, f in enumerate(_fields(element)) if isinstance(f.dataType, T.ArrayType)]
    scalars = [f for f in _fields(element) if not isinstance(f.dataType, T.ArrayType)]

    def value(x: Column) -> Column:
        if not values:
            return F.lit(None).cast("string")
        if isinstance(element, T.StructType):
            return F.to_json(F.struct(*[x.getField(f.name).alias(f.name) for f in scalars]))
        return x.cast("string")

    def below(x: Column, i: Column) -> Column:
        here = F.concat(label, F.array((i + 1).cast("int")))
        own = F.array(F.struct(F.lit(path).alias("path"), here.alias("label"), value(x).alias("value")))
        deeper = [_nodes(x.getField(f.name), f.dataType, f"{path}.{f.name}", F.concat(here, F.array(F.lit(slot + 1).cast("int"))), values) for slot, f in nested]
        return F.when(x.isNotNull(), F.concat(own, *deeper)).otherwise(F.array().cast(NODE))

    return F.coalesce(F.flatten(F.transform(column, below)), F.array().cast(NODE))


def dewey_nodes(df: DataFrame, key: list[str], columns: list[str], values: bool = True) -> DataFrame:
    """Every array element below `columns` as one row: key, path, label, parent_path, parent_label, value.

    A label alternates the slot of an array within its parent and the element's 1-based place in it, so the parent's
    label is the label without its last two numbers (empty for elements of the record itself). Null arrays and null
    elements give no row, but a null element keeps its place. `value` holds the element's scalar fields as JSON text,
    or the scalar itself. One pass over the input; nothing is shuffled.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    slots = [_nodes(F.col(c), kinds[c], c, F.array(F.lit(i + 1).cast("int")), values) for i, c in enumerate(columns)]
    one = df.select(*key, F.explode(F.concat(*slots)).alias("_n"))
    label, path = F.col("_n.label"), F.col("_n.path")
    return one.select(
        *key,
        path.alias("path"),
        label.alias("label"),
        F.when(F.size(label) > 2, F.regexp_replace(path, r"\.[^.]*$", "")).alias("parent_path"),
        F.slice(label, 1, F.size(label) - 2).alias("parent_label"),
        F.col("_n.value").alias("value"),
    )


def flat_tables(nodes: DataFrame, key: list[str], df: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """The nodes of `dewey_nodes` grouped by schema path: one typed table per path, with label and parent label."""
    found: dict[str, T.DataType] = {}

    def walk(path: str, kind: T.DataType) -> None:
        if isinstance(kind, T.ArrayType):
            found[path] = kind.elementType
            for f in _fields(kind.elementType):
                walk(f"{path}.{f.name}", f.dataType)

    for f in df.schema.fields:
        if f.name in columns:
            walk(f.name, f.dataType)
    tables = {}
    for path, kind in found.items():
        rows = nodes.where(F.col("path") == path)
        if isinstance(kind, T.StructType):
            scalars = T.StructType([f for f in kind.fields if not isinstance(f.dataType, T.ArrayType)])
            parsed = rows.withColumn("_v", F.from_json("value", scalars))
            tables[path] = parsed.select(*key, "label", "parent_label", *[F.col(f"_v.{f.name}").alias(f.name) for f in scalars.fields])
        else:
            tables[path] = rows.select(*key, "label", "parent_label", F.col("value").cast(kind).alias("value"))
    return tables


# --- flows, whichever shape they were delivered in ---


def _spellings(name: str) -> list[str]:
    """A camelCase field name as agents spelled it: camel, snake, kebab, Pascal and lower case."""
    words = "".join("_" + c.lower() if c.isupper() else c for c in name).split("_")
    return list(dict.fromkeys([name, "_".join(words), "-".join(words), "".join(w.title() for w in words), "".join(words)]))


def _pick(v: Column, name: str) -> Column:
    """Field `name` of a variant object in any spelling; variant null and other shapes give null."""
    tries = [F.try_variant_get(v, f'$["{s}"]', "variant") for s in _spellings(name)]
    return F.coalesce(*[F.when(~F.is_variant_null(t), t) for t in tries])


def _shape(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _unquoted(v: Column) -> Column:
    """A variant that is a text holding JSON, as that JSON; texts that aren't JSON give null."""
    return F.when(_shape(v) == "STRING", strict_json(F.try_variant_get(v, "$", "string"))).otherwise(v)


def _elements(v: Column) -> Column:
    """A variant as array<variant>: an object in place of an array is its only element, JSON text counts as its content."""
    plain = _unquoted(v)
    return F.when(_shape(plain) == "ARRAY", F.try_variant_get(plain, "$", "array<variant>")).when(_shape(plain) == "OBJECT", F.array(plain))


def _text(v: Column, name: str) -> Column:
    return F.try_variant_get(_pick(v, name), "$", "string")


def _each(v: Column, make) -> Column:
    """Elements of a variant array turned by `make`; null elements stay null."""
    return F.transform(_elements(v), lambda x: F.when(x.isNotNull() & ~F.is_variant_null(x), make(x)))


def _mode(v: Column) -> Column:
    bare = F.when(_shape(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.struct(
        F.coalesce(_text(v, "mode"), bare).alias("mode"),
        _text(v, "surfacedAs").alias("surfacedAs"),
        F.try_variant_get(_pick(v, "dataLossRisk"), "$", "boolean").alias("dataLossRisk"),
    )


def _ref(v: Column) -> Column:
    return F.struct(*[_text(v, n).alias(n) for n in ("kind", "name", "relation")])


def _step(v: Column) -> Column:
    return F.struct(
        *[_text(v, n).alias(n) for n in ("id", "name", "kind", "symbol")],
        _each(_pick(v, "failureModes"), _mode).alias("failureModes"),
        _each(_pick(v, "refs"), _ref).alias("refs"),
    )


def _sink(v: Column) -> Column:
    return F.struct(*[_text(v, n).alias(n) for n in ("type", "target")])


def latest_flows(flows: DataFrame) -> DataFrame:
    """Each flow's row with the latest captured_at (then ingested_at); rows without flow_id are left out."""
    newest = Window.partitionBy("flow_id").orderBy(F.col("captured_at").desc_nulls_last(), F.col("ingested_at").desc_nulls_last())
    return flows.where("flow_id is not null").withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def uniform_flows(flows: DataFrame) -> DataFrame:
    """flow_id, steps and sinks in one typed shape, from the nested columns or else from spec_json.

    A spec may sit under `spec`, spell its fields in any case, hand over an object instead of an array or an array
    as JSON text, and name a failure mode by a bare text. A spec_json that isn't JSON gives null steps and sinks.
    """
    parsed = flows.withColumn("_doc", _document())
    inner = _unquoted(_pick(F.col("_doc"), "spec"))
    spec = parsed.withColumn("_spec", F.coalesce(F.when(_shape(inner) == "OBJECT", inner), F.col("_doc")))
    return spec.select(
        "flow_id",
        F.coalesce("steps", _each(_pick(F.col("_spec"), "steps"), _step)).alias("steps"),
        F.coalesce("sinks", _each(_pick(F.col("_spec"), "sinks"), _sink)).alias("sinks"),
    )


def _document() -> Column:
    return F.when(F.col("steps").isNull() & F.col("sinks").isNull(), strict_json(F.col("spec_json")))


def _once(value: Column, make) -> Column:
    """`make` of a value that is computed once, however often `make` uses it."""
    return F.get(F.transform(F.array(value), make), 0)


def whole_flows(flows: DataFrame) -> DataFrame:
    """All rows and columns of flows, with steps, sinks and trigger from spec_json where it is all that was delivered.

    spec_json is null throughout: it has been read, and one that isn't JSON leaves the row without steps and sinks.
    """

    def trigger(v: Column) -> Column:
        return F.when(_shape(v) == "OBJECT", F.struct(*[_text(v, n).alias(n) for n in ("type", "method", "path", "entrypoint")]))

    def spec(doc: Column) -> Column:
        return _once(_unquoted(_pick(doc, "spec")), lambda inner: F.coalesce(F.when(_shape(inner) == "OBJECT", inner), doc))

    # each part is a column of its own, so that a query that needs one only doesn't read the others
    read = flows.withColumn("_spec", _once(_document(), spec))
    filled = {
        "steps": F.coalesce("steps", _once(F.col("_spec"), lambda v: _each(_pick(v, "steps"), _step))),
        "sinks": F.coalesce("sinks", _once(F.col("_spec"), lambda v: _each(_pick(v, "sinks"), _sink))),
        "flow_trigger": F.coalesce("flow_trigger", _once(F.col("_spec"), lambda v: _once(_unquoted(_pick(v, "trigger")), trigger))),
        "spec_json": F.lit(None).cast("string"),
    }
    return read.withColumns(filled).drop("_spec")


#: Child table of a schema path of flows.
CHILD = {"steps": "step", "steps.failureModes": "mode", "sinks": "sink", "steps.refs": "ref"}


def flow_children(flows: DataFrame) -> DataFrame:
    """flow_id, child, pos, sub_pos, path, label, parent_label and value of every element of the latest flows."""
    nodes = dewey_nodes(uniform_flows(latest_flows(flows)), ["flow_id"], ["steps", "sinks"])
    child = F.create_map(*[F.lit(x) for pair in CHILD.items() for x in pair])
    return nodes.withColumns({"child": F.try_element_at(child, F.col("path")), "pos": F.get("label", 1), "sub_pos": F.coalesce(F.get("label", 3), F.lit(0))})
