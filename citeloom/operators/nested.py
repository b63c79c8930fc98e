"""Deeply nested records into related flat tables, by Dewey labels.

A node's label is the path of ordinals that leads to it; its parent's label is
the same path without the last step, so parent links need no join.  Nodes with
the same schema path form one table.  The whole label set of a record is built
by one expression over the parsed variant, inside the JVM, and exploded once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.ids import strip_ws


@dataclass(frozen=True)
class NodeSpec:
    """A kind of child object: its name, the keys that may hold it, and the kinds below it."""

    name: str
    keys: tuple[str, ...]
    children: tuple["NodeSpec", ...] = field(default=())


#: Keys as the four sources write them.
SCHOLARLY = (
    NodeSpec("author", ("authorships", "author", "authors"), (NodeSpec("affiliation", ("institutions", "affiliation", "affiliations")),)),
    NodeSpec("reference", ("referenced_works", "reference", "references")),
    NodeSpec("funder", ("grants", "funder"), (NodeSpec("award", ("award_ids", "award")),)),
)
#: Keys under which an answer wraps the record.
WRAPPERS = ("$.message", "$.results[0]", "$.data")


def parse_record(text: Column, wrappers: Sequence[str] = WRAPPERS) -> Column:
    """The record in a JSON text as a variant, or null where the text holds no JSON object.

    JSON quoted as a string is parsed again, an array stands for its first
    element, and a wrapper's content takes the wrapper's place if it is an object.
    Null, blank, broken and scalar texts give null.
    """
    def plain(t: Column) -> Column:
        return F.when(t.startswith('"'), strip_ws(F.try_variant_get(F.try_parse_json(t), "$", "string"))).otherwise(t)

    def first(t: Column) -> Column:
        return F.when(t.startswith("["), F.try_variant_get(F.try_parse_json(t), "$[0]", "variant")).when(t.startswith("{"), F.try_parse_json(t))

    v = let(let(let(strip_ws(text), plain), first), _object)
    return let(v, lambda x: unwrap(x, wrappers))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` evaluated once, however often ``f`` mentions it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _object(v: Column) -> Column:
    return F.when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), v)


def unwrap(v: Column, wrappers: Sequence[str] = WRAPPERS) -> Column:
    """The content of the first wrapper that holds an object, else ``v``."""
    return F.coalesce(*[let(F.try_variant_get(v, w, "variant"), _object) for w in wrappers], v)


def children(v: Column, keys: Sequence[str]) -> Column:
    """The child objects under the first of ``keys`` that holds any value; a single value counts as an array of one."""
    def listed(x: Column) -> Column:
        return F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.when(x.isNotNull() & ~F.is_variant_null(x), F.array(x)))

    return F.coalesce(*[let(F.try_variant_get(v, f"$.{k}", "variant"), listed) for k in keys])


def labels(v: Column, specs: Sequence[NodeSpec], values: bool = False) -> Column:
    """array<struct<path, dewey[, value]>>: every node below ``v``; null elements keep their ordinal but give no node."""

    return F.concat(*[_or_empty(x, values) for x in _walk(v, specs, "", None, values)])


def _or_empty(a: Column, values: bool) -> Column:
    kind = "array<struct<path:string,dewey:array<int>" + (",value:string" if values else "") + ">>"
    return F.coalesce(a.cast(kind), F.array().cast(kind))


def _walk(node: Column, specs: Sequence[NodeSpec], path: str, at: Column | None, values: bool) -> list[Column]:
    found = []
    for s in specs:
        here = f"{path}/{s.name}" if path else s.name
        kids = children(node, s.keys)
        found.append(F.array_compact(F.transform(kids, _node(here, at, values))))
        if s.children:
            found.append(F.flatten(F.transform(kids, _below(s, here, at, values))))
    return found


def _label(at: Column | None, i: Column) -> Column:
    return F.array(i) if at is None else F.concat(at, F.array(i))


def _node(path: str, at: Column | None, values: bool):
    def node(x: Column, i: Column) -> Column:
        cols = [F.lit(path).alias("path"), _label(at, i).alias("dewey")] + [F.to_json(x).alias("value")] * values
        return F.when(x.isNotNull() & ~F.is_variant_null(x), F.struct(*cols))

    return node


def _below(s: NodeSpec, path: str, at: Column | None, values: bool):
    def below(x: Column, i: Column) -> Column:
        return F.concat(*[_or_empty(y, values) for y in _walk(x, s.children, path, _label(at, i), values)])

    return below


def newest_labels(df: DataFrame, keys: Sequence[str], text: str, at: str, specs: Sequence[NodeSpec] = SCHOLARLY, values: bool = False) -> DataFrame:
    """(keys..., path, dewey[, value]): the nodes of the newest text of each key that holds a JSON object.

    Labels are built before the shuffle, so what moves is ordinals, not texts; the
    newest is a combinable aggregate, so a key with very many fetches is no hot
    spot.  Equal times: the text with the larger hash.  A null time is the oldest,
    null keys form a group of their own.
    """
    # one expression and no filter: a predicate on it would be pushed down and evaluate it twice
    row = let(parse_record(F.col(text)), lambda v: F.when(v.isNotNull(), F.struct(F.col(at).alias("at"), F.xxhash64(text).alias("h"), labels(v, specs, values).alias("n"))))
    newest = df.select(*keys, row.alias("_r")).groupBy(*keys).agg(F.max("_r").alias("_r"))
    return newest.select(*keys, F.explode("_r.n").alias("_n")).select(*keys, "_n.*")


def child_rows(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., child, parent_no, child_no) of labelled nodes: parent by truncation of the label, -1 at the top."""
    return nodes.select(
        *keys,
        F.element_at(F.split("path", "/"), -1).alias("child"),
        F.when(F.size("dewey") > 1, F.element_at("dewey", -2)).otherwise(F.lit(-1)).alias("parent_no"),
        F.element_at("dewey", -1).alias("child_no"),
    )


def as_tables(nodes: DataFrame, specs: Sequence[NodeSpec] = SCHOLARLY) -> dict[str, DataFrame]:
    """One DataFrame per schema path, with ``parent`` (the truncated label) beside ``dewey``."""
    out: dict[str, DataFrame] = {}

    def walk(specs: Sequence[NodeSpec], path: str) -> None:
        for s in specs:
            here = f"{path}/{s.name}" if path else s.name
            parent = F.when(F.size("dewey") > 1, F.slice("dewey", 1, F.size("dewey") - 1))
            out[here] = nodes.filter(F.col("path") == here).withColumn("parent", parent)
            walk(s.children, here)

    walk(specs, "")
    return out


def all_nodes(df: DataFrame, keys: Sequence[str], text: str, max_depth: int = 8) -> DataFrame:
    """(keys..., dewey, path, value): every node of any JSON text, with no schema given.

    Level by level through ``variant_explode``: object members are numbered in the
    variant's order, array elements by position; ``path`` holds the keys and ``[]``
    for elements.  Levels below ``max_depth`` stay inside their ancestor's value.
    """
    spark = df.sparkSession
    level = df.select(*keys, F.array().cast("array<int>").alias("dewey"), F.lit("$").alias("path"), F.try_parse_json(F.col(text)).alias("v")).filter("v is not null")
    out = []
    cols = ", ".join(f"t.`{k}`" for k in keys)
    for _ in range(max_depth):
        # a member has a key, an element has none
        sql = f"select {cols}, concat(t.dewey, array(e.pos)) as dewey, concat(t.path, coalesce('.' || e.key, '[]')) as path, e.value as v from {{level}} t, lateral variant_explode(t.v) e"
        level = spark.sql(sql, level=level)
        out.append(level)
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return all_.select(*keys, "dewey", "path", F.to_json("v").alias("value"))
