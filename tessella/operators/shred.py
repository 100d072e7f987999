"""Shredding nested JSON records into an adjacency table, and entity tables out of it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.rows import latest

NODE_SCHEMA = "record_id long, node int, parent int, label string, ordinal int, kind string, scalar string, shape string, above array<int>, names array<string>"
_ARROW = pa.schema(
    [("record_id", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string()), ("shape", pa.string()), ("above", pa.list_(pa.int32())), ("names", pa.list_(pa.string()))]
)
#: Rows handed on at once.
BATCH = 50_000
#: What lies deeper is told as unreadable: a node tells its whole line, so a record of d levels takes d * d entries.
MOST_LEVELS = 2_000


class _Pairs(list):
    """An object as its pairs in order; repeated keys stay, each one a child of its own."""


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(object_pairs_hook=_Pairs, parse_float=str, parse_int=str, parse_constant=_refuse)
_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"(?:true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.+-])", re.ASCII)
_WORDS = {"true": True, "false": False, "null": None}


def _deep(text: str):
    """The value of a JSON text of any depth: brackets open on a list instead of on the call stack."""
    stack: list[tuple[list, str | None]] = []
    at = _SPACE.match(text, 0).end()
    value, key, done = None, None, False
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            stack.append((_Pairs() if c == "{" else [], key))
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                done = True
        elif c == '"':
            value, at = json.decoder.scanstring(text, at + 1)
        elif m := _ATOM.match(text, at):
            value, at = _WORDS.get(m[0], m[0]), m.end()
        else:
            raise ValueError("value expected")
        if c not in ("{", "["):
            done = None
        if done is False:  # just opened: the first member follows
            key, at = _member(text, at) if isinstance(stack[-1][0], _Pairs) else (None, at)
            continue
        while True:  # a value is complete, or a bracket closes
            if done:
                value, key = stack.pop()
                at, done = at + 1, None
            at = _SPACE.match(text, at).end()
            if not stack:
                if at != len(text):
                    raise ValueError("more after the value")
                return value
            held = stack[-1][0]
            held.append((key, value) if isinstance(held, _Pairs) else value)
            c = text[at : at + 1]
            if c == ",":
                at = _SPACE.match(text, at + 1).end()
                key, at = _member(text, at) if isinstance(held, _Pairs) else (None, at)
                done = False
                break
            if c != ("}" if isinstance(held, _Pairs) else "]"):
                raise ValueError("closing bracket expected")
            done = True


def _member(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError("key expected")
    key, at = json.decoder.scanstring(text, at + 1)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError("colon expected")
    return key, _SPACE.match(text, at + 1).end()


def _decoded(text: str):
    """The value of a JSON text. Raises ValueError for what is none; depth is no reason."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _deep(text)


def _opened(value):
    """What a value stands for: a JSON string that holds an object, a list or a string is opened, however often."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        try:
            value = _decoded(value)
        except ValueError:
            break
    return value


def _pointer(label: str) -> str:
    return "~2" if label == "[]" else label.replace("~", "~0").replace("/", "~1")


def _outer(root, label: str, kind: str):
    """``root``, or what its member ``label`` holds if that is of the kind."""
    for k, v in reversed(root) if type(root) is _Pairs else ():
        if k == label:
            v = _opened(v)
            return v if type(v) is (_Pairs if kind == "object" else list) else root
    return root


def _nodes(record_id, text: str, outer: tuple[str, str] | None, out: list[tuple]) -> None:
    """Appends the nodes of one record in document order, without recursion; an unreadable text is one node that says why."""
    try:
        root = _opened(_decoded(text))
    except ValueError as e:
        out.append((record_id, 0, None, None, 0, "unreadable", str(e), "", None, None))
        return
    if outer:
        root = _outer(root, *outer)
    node = -1
    # An entry: parent, label, ordinal, value, shape, and the ids and names of the nodes above.
    stack = [(None, None, 0, root, "", (), ())]
    add, push = out.append, stack.append
    while stack:
        parent, label, ordinal, value, shape, above, names = stack.pop()
        node += 1
        if type(value) is str:
            value = _opened(value)
        if len(above) >= MOST_LEVELS and isinstance(value, list) and value:
            add((record_id, node, parent, label, ordinal, "unreadable", f"deeper than {MOST_LEVELS} levels", "", None, None))
        elif type(value) is _Pairs:
            name = label
            for k, v in value:
                if k == "name" and v is not None:
                    v = _opened(v)
                    if v is not None and type(v) is not list and type(v) is not _Pairs:
                        name = _text(v)
            above, names = (*above, node), (*names, name)
            add((record_id, node, parent, label, ordinal, "object", None, shape, above, names))
            for i in range(len(value) - 1, -1, -1):
                k, v = value[i]
                push((node, k, i, v, f"{shape}/{_pointer(k)}", above, names))
        elif type(value) is list:
            add((record_id, node, parent, label, ordinal, "list", None, shape, None, None))
            shape, above, names = shape + "/[]", (*above, node), (*names, None)
            for i in range(len(value) - 1, -1, -1):
                push((node, None, i, value[i], shape, above, names))
        elif value is None:
            add((record_id, node, parent, label, ordinal, "null", None, shape, None, None))
        else:
            add((record_id, node, parent, label, ordinal, "scalar", _text(value), shape, None, None))


def _text(value) -> str:
    return value if type(value) is str else str(value).lower()


def adjacency(df: DataFrame, record_id: str, text: str, outer: tuple[str, str] | None = None) -> DataFrame:
    """The adjacency table of the JSON texts: ``record_id, node, parent, label, ordinal, kind, scalar, shape, above, names``.

    One row per JSON node. ``node`` numbers the record's nodes in document order from 0, the root; ``parent`` is the node above, ``label`` its
    key in an object, ``ordinal`` its place among its siblings, ``kind`` one of object, list, scalar and null, ``shape`` the labels from the root with list
    elements as ``[]`` (in labels ``~`` reads ``~0``, ``/`` reads ``~1``, and ``[]`` reads ``~2``). An object also tells the line from the root down to itself, one entry a level: ``above`` the
    nodes, ``names`` their scalar children ``name``, else their keys, null for lists. ``outer`` names a label and a kind: an outer object whose member of that label is of that kind stands for the member. A JSON string that holds JSON stands for what it
    holds. Null and empty texts give no node. A text that is no JSON gives one node of kind ``unreadable`` whose scalar is the reason. The parser knows no depth
    limit; a part below level 2,000 is one node of kind ``unreadable``. The parse is the only Python step.
    """

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(_ARROW)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

        for batch in batches:
            for rid, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x:
                    _nodes(rid, x, outer, out)
                    if len(out) > BATCH:
                        yield rows()
                        out.clear()
        yield rows()

    given = df.where(F.col(record_id).isNotNull() & F.col(text).isNotNull()).select(F.col(record_id).cast("long").alias("record_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(shred, NODE_SCHEMA)


def rejects(nodes: DataFrame) -> DataFrame:
    """``record_id, reason`` of the records whose text, or a part of it, gave no nodes."""
    return nodes.where("kind = 'unreadable'").select("record_id", F.col("scalar").alias("reason")).distinct()


def entities(nodes: DataFrame, steps: Column, attributes: dict[str, str]) -> DataFrame:
    """The object nodes that ``steps`` takes for entities, joined with their scalar children, which are pivoted into columns.

    ``steps`` gives, from a node's shape, which of the objects above it and itself are entities: an array of their indexes from the outermost, null
    where the node is none. ``attributes`` maps a child label to a column. ``name`` is the scalar child ``name``, else the node's own key. The
    parent link is ``parent_entity``: the nearest entity above, null at the top; ``node_path`` joins the
    names from the outermost entity to this one with ``>``. Objects without a name are no entities, neither is what lies below them. Repeated keys: the last counts.

    Object and child meet by the node they belong to, within one partition per record, whose rows are bounded by one text.
    """
    wanted = ["name", *[a for a in attributes if a != "name"]]
    here = F.col("kind") == "object"
    used = nodes.select("record_id", "node", "parent", "label", "ordinal", "scalar", "above", "names", F.when(here, steps).alias("steps"), here.alias("object"))
    used = used.where(F.col("steps").isNotNull() | (F.col("label").isin(wanted) & F.col("scalar").isNotNull()))
    owner = F.when(F.col("object"), F.col("node")).otherwise(F.col("parent")).alias("owner")
    both = used.repartition("record_id").select("record_id", owner, "object", "label", "ordinal", "scalar", "above", "names", "steps")
    this = F.max_by(F.struct("label", "ordinal", "above", "names", "steps"), F.when(F.col("object"), 1)).alias("o")
    values = [F.max_by("scalar", F.when(~F.col("object") & (F.col("label") == a), F.col("ordinal"))).alias(f"__{a}") for a in wanted]
    joined = both.groupBy("record_id", "owner").agg(this, *values).where("o.steps is not null")
    named = joined.where(F.coalesce("__name", "o.label").isNotNull()).withColumn("line", F.filter("o.steps", lambda i: F.get("o.names", i).isNotNull()))
    return named.select(
        "record_id",
        F.col("owner").alias("node"),
        F.when(F.size("line") > 1, F.get("o.above", F.element_at("line", -2))).alias("parent_entity"),
        F.col("o.ordinal").alias("ordinal"),
        F.size("line").alias("level"),
        F.coalesce("__name", "o.label").alias("name"),
        F.array_join(F.transform("line", lambda i: F.get("o.names", i)), ">").alias("node_path"),
        *[F.col(f"__{a}").alias(c) for a, c in attributes.items() if a != "name"],
    )


#: A field of the outer list or object; below a field its children stand in ``fields`` or in ``items.fields``, as a list or keyed.
_FIELD = r"^/[^/]+(?:/(?:fields|items/fields)/[^/]+)*$"


def field_steps(shape: Column) -> Column:
    """The levels of the fields from the outermost down to the node of this shape, null where that is no field; ``attrs`` and defaults do not count."""
    jumps = F.regexp_extract_all(F.regexp_replace(shape, "^/[^/]+", ""), F.lit("/(fields|items/fields)/[^/]+"), 1)
    deeper = F.transform(jumps, lambda _, i: F.aggregate(F.slice(jumps, F.lit(1), i + 1), F.lit(1), lambda n, j: n + F.when(j == "fields", 2).otherwise(3)))
    return F.when(shape.rlike(_FIELD), F.concat(F.array(F.lit(1)), deeper))


def domain_steps(shape: Column) -> Column:
    """The levels of domain and language for elements of ``domains`` and of a domain's ``languages``; ``owners`` do not count."""
    return F.when(shape.rlike("^/domains/[^/]+$"), F.array(F.lit(2))).when(shape.rlike("^/domains/[^/]+/languages/[^/]+$"), F.array(F.lit(2), F.lit(4)))


def model_nodes(models: DataFrame) -> DataFrame:
    """The adjacency table of ``fields_json``, each id read once; an outer object whose ``fields`` is a list stands for that list, another is keyed by field name."""
    return adjacency(latest(models.select("id", "fields_json"), ["id"]), "id", "fields_json", ("fields", "list"))


def snapshot_nodes(snapshots: DataFrame) -> DataFrame:
    """The adjacency table of ``summary_json``, each id read once; an outer ``summary`` stands for the summary."""
    return adjacency(latest(snapshots.select("id", "summary_json"), ["id"]), "id", "summary_json", ("summary", "object"))


def model_fields(models: DataFrame) -> DataFrame:
    """Flat child table of ``fields_json``: one row per named field object, see :func:`entities`."""
    return entities(model_nodes(models), field_steps(F.col("shape")), {"type": "type", "nullable": "nullable", "default": "default_value"})


def snapshot_domains(snapshots: DataFrame) -> DataFrame:
    """Flat child table of ``summary_json``: domains and their languages, see :func:`entities`."""
    return entities(snapshot_nodes(snapshots), domain_steps(F.col("shape")), {"files": "files"})
