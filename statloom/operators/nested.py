"""Nested JSON records to related flat tables, by shared inlining.

1. :func:`schema_graph` reads every payload once and aggregates the element graph: which object element stands under
   which other one, and whether it ever repeats. Each partition folds its payloads first, so that only distinct edges
   are shuffled.
2. :func:`plan_tables` decides on that graph alone. The root and every repeated, shared (more than one parent element)
   or recursive element becomes a table; all other elements are inlined into the nearest ancestor that has one.
3. :func:`shred` reads the payloads again and emits the rows of all tables, each with the key of its parent row;
   :func:`table_of` gives one table of them with real columns.

Defined cases
- A payload that is null, blank, incomplete or otherwise no JSON yields no rows. One that was encoded as a JSON string,
  however often, counts as what it holds. A leading byte-order mark is ignored. Any depth is read.
- A node is an object. An object where a list could stand is a list of one; list entries that are not objects are
  neither nodes nor counted in their positions. Lists inside lists are flattened, but not at a declared element.
- Scalars become strings: numbers as their digits as written, booleans ``true``/``false``. An object with a scalar
  member ``content`` also stands for that value in its parent; if it has no other member it is no node, unless its
  element is declared. Of a name that an object has twice the last counts, as JSON readers have it.
- A scalar in a list is a repeated element: its rows stand in the table of the member's name and ``[]``, the value as
  ``content``, the position that in the list. Nulls have no row.
- Null record ids are kept as null; repeated records repeat their rows. Extra columns of the input are ignored.
- Keys that clash with the bookkeeping columns cannot collide: attributes live in a map until :func:`table_of` names them.
  A dot in a member's name is written ``\\.`` there, as plain dots name inlined members.
- Keys of rows are their paths; rows below PATH_LEVELS levels are numbered within their record instead and have no path.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element name of a payload's outermost object.
ROOT = "$"
#: Member that carries the value of a wrapped scalar.
VALUE_KEY = "content"
#: What the name of a table of repeated scalars ends with.
VALUES = "[]"
#: The graph has one row for each pair of element names. Beyond this many the keys are data; then every element gets a table.
MAX_EDGES = 50_000
#: Rows this deep are keyed by their path: deeper ones would make the paths of a chain grow with its square.
PATH_LEVELS = 1_000
#: Rows of the result that are gathered before they are handed on.
ROWS_AT_ONCE = 20_000

NODE_SCHEMA = (
    "record_id string, table_name string, path_names array<string>, path_positions array<int>, "
    "node_id string, parent_table string, parent_depth int, parent_id string, members array<string>, attrs map<string,string>"
)
_NODE_TYPES = (
    pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()),
)


class _Number(str):
    """A JSON number as written, to tell it from a string when a payload is unwrapped."""


def _no_constant(text: str) -> None:
    raise ValueError(text)


_decoder = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_no_constant)
_TOKEN = re.compile(r"[ \t\n\r]*(?:([\[\]{},:])|(\")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|(true|false|null))")
_WORDS = {"true": True, "false": False, "null": None}


def _decode_deep(text: str):
    """Like the decoder, for payloads too deep for it: open containers stand on a list, not on the call stack."""
    root: list = []
    open_ones: list = [root]
    at, want, key = 0, "value", None
    while True:
        if not (m := _TOKEN.match(text, at)):
            if len(open_ones) == 1 and root and not text[at:].strip(" \t\n\r"):
                return root[0]
            raise ValueError(at)
        at, mark, top = m.end(), m[1], open_ones[-1]
        if top is root and root:
            raise ValueError(at)
        if mark and mark in "]}" and want in ("value or end", "key or end", "next"):
            if (mark == "]") != isinstance(top, list) or top is root:
                raise ValueError(at)
            open_ones.pop()
            want = "next"
        elif mark == "," and want == "next":
            want = "value" if isinstance(top, list) else "key"
        elif mark == ":" and want == "colon":
            want = "value"
        elif m[2] and want in ("key", "key or end"):
            key, at = json.decoder.scanstring(text, at)
            want = "colon"
        elif want in ("value", "value or end") and not (mark and mark not in "[{"):
            if m[2]:
                value, at = json.decoder.scanstring(text, at)
            else:
                value = [] if mark == "[" else {} if mark == "{" else _Number(m[3]) if m[3] else _WORDS[m[4]]
            if isinstance(top, list):
                top.append(value)
            else:
                top[key] = value
            want = "next"
            if mark:
                open_ones.append(value)
                want = "value or end" if mark == "[" else "key or end"
        else:
            raise ValueError(at)


def decode_payload(text: str | None):
    """The object or list that ``text`` encodes, or None."""
    value = text
    try:
        while isinstance(value, str) and not isinstance(value, _Number):
            plain = value.lstrip("\ufeff")
            try:
                value = _decoder.decode(plain)
            except RecursionError:
                value = _decode_deep(plain)
    except ValueError:
        return None
    return value if isinstance(value, dict | list) else None


def _scalar(value) -> str | None:
    """``value`` as a string if it is a scalar or a wrapped one, else None."""
    if isinstance(value, dict):
        value = value.get(VALUE_KEY)
    if value is None or isinstance(value, dict | list):
        return None
    return ("false", "true")[value] if isinstance(value, bool) else str(value)


def _entries(value, declared: bool) -> tuple[list[dict], list[tuple[int, str]]]:
    """The nodes that stand at one member, in order, and the scalars of its lists with their positions."""
    if isinstance(value, dict):
        return ([value] if declared or len(value) != 1 or _scalar(value) is None else []), []
    nodes, scalars, rest, at = [], [], [(value, True)], 0
    while rest:
        x, is_list = rest.pop()
        if is_list and isinstance(x, list):
            rest.extend((y, not declared) for y in reversed(x))
            continue
        if isinstance(x, dict) and (declared or len(x) != 1 or _scalar(x) is None):
            nodes.append(x)
        elif (text := _scalar(x)) is not None:
            scalars.append((at, text))
        at += 1
    return nodes, scalars


def _column_batches(batches: Iterable[pa.RecordBatch], columns: int) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True)


def schema_graph(df: DataFrame, json_col: str, declared: frozenset[str] = frozenset()) -> DataFrame:
    """(parent, child, repeated, occurrences) of the elements in ``json_col``; one row for each edge."""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: dict[tuple[str, str], list] = {}
        for (text,) in _column_batches(batches, 1):
            value = decode_payload(text)
            # the outermost list, if any, makes the root repeat
            todo = [("", ROOT, isinstance(value, list), x) for x in _entries(value, False)[0]]
            while todo:
                parent, name, listed, node = todo.pop()
                edge = edges.setdefault((parent, name), [False, 0])
                edge[0] |= listed
                edge[1] += 1
                for key, member in node.items():
                    if isinstance(member, dict | list):
                        nodes, scalars = _entries(member, key in declared)
                        todo.extend((name, key, isinstance(member, list), x) for x in nodes)
                        if scalars:
                            edge = edges.setdefault((name, key + VALUES), [True, 0])
                            edge[1] += len(scalars)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in edges], pa.string()),
                pa.array([k[1] for k in edges], pa.string()),
                pa.array([v[0] for v in edges.values()], pa.bool_()),
                pa.array([v[1] for v in edges.values()], pa.int64()),
            ],
            names=["parent", "child", "repeated", "occurrences"],
        )

    schema = "parent string, child string, repeated boolean, occurrences long"
    return (
        df.select(F.col(json_col).alias("payload"))
        .mapInArrow(fold, schema)
        .groupBy("parent", "child")
        .agg(F.bool_or("repeated").alias("repeated"), F.sum("occurrences").alias("occurrences"))
    )


@dataclass(frozen=True)
class TablePlan:
    """Elements that have a table of their own; reasons says why. With ``all_elements`` there is nothing inlined."""

    reasons: dict[str, str]
    declared: frozenset[str] = frozenset()
    all_elements: bool = False

    @property
    def tables(self) -> frozenset[str]:
        return frozenset(self.reasons)


def plan_tables(graph: DataFrame, declared: frozenset[str] = frozenset()) -> TablePlan:
    """Shared inlining over the element graph, whose size is that of the schema, not of the data.

    ``declared`` names elements that may repeat by their schema, also where no payload at hand repeats them. A graph of
    more than MAX_EDGES pairs does not come to the driver: then every element has a table of its own.
    """
    edges = graph.limit(MAX_EDGES + 1).collect()
    if len(edges) > MAX_EDGES:
        return TablePlan({}, declared, all_elements=True)
    parents: dict[str, set[str]] = {}
    repeated: set[str] = set()
    for e in edges:
        parents.setdefault(e.child, set()).add(e.parent)
        if e.repeated:
            repeated.add(e.child)

    def ancestors(name: str) -> set[str]:
        seen, rest = set(), [*parents.get(name, ())]
        while rest:
            x = rest.pop()
            if x not in seen:
                seen.add(x)
                rest.extend(parents.get(x, ()))
        return seen

    reasons = {}
    for name in sorted(parents):
        if name == ROOT:
            reasons[name] = "root"
        elif name in ancestors(name):
            reasons[name] = "recursive"
        elif name in repeated or name in declared:
            reasons[name] = "repeated"
        elif len(parents[name]) > 1:
            reasons[name] = "shared"
    return TablePlan(reasons, declared)


def shred(df: DataFrame, id_col: str, json_col: str, plan: TablePlan, attributes: set[str] | None = None) -> DataFrame:
    """Rows of all tables of ``plan``: where each node stands, its parent row, and its scalars with inlined ones.

    ``path_names``/``path_positions`` lead from the root to the node; their first ``parent_depth`` entries lead to the parent
    row (0: none). ``node_id`` and ``parent_id`` are the keys of both within the record. ``attributes`` prunes the scalars
    to those whose last name is listed (all by default), and repeated scalars likewise.
    """
    tables, declared, everything = plan.tables, plan.declared, plan.all_elements

    def rows_of(record_id, value) -> Iterator[tuple]:
        todo = [((ROOT,), (i,), 1, None, None, "", x, None) for i, x in reversed([*enumerate(_entries(value, False)[0])])]
        count = 0
        while todo:
            # ``row`` is that of the node or of the nearest ancestor that has one: (table, depth, key, attributes)
            names, positions, depth, row, at, prefix, node, text = todo.pop()
            name = at or names[-1]
            if text is not None or row is None or everything or name in tables or positions[-1]:
                count += 1
                parent, attrs = row, {}
                key = "/".join(f"{n}:{i}" for n, i in zip(names, positions, strict=True)) if depth <= PATH_LEVELS else f"#{count}"
                row, prefix = (name, depth, key, attrs), ""
                above = parent[:3] if parent else (None, 0, None)
                given = (names, positions) if depth <= PATH_LEVELS else (None, None)
                yield record_id, name, *given, key, above[0], above[1], above[2], [*node], attrs
                if text is not None:
                    attrs[VALUE_KEY] = text
                    continue
            attrs, inner = row[3], []
            for member_name, member in node.items():
                wanted = attributes is None or member_name in attributes
                written_name = member_name.replace(".", "\\.") if "." in member_name else member_name
                if wanted and (scalar := _scalar(member)) is not None:
                    attrs[prefix + written_name] = scalar
                if isinstance(member, dict | list):
                    nodes, scalars = _entries(member, member_name in declared)
                    here = depth < PATH_LEVELS
                    for i, x in enumerate(nodes):
                        path = ((*names, member_name), (*positions, i)) if here else ((member_name,), (i,))
                        inner.append((*path, depth + 1, row, member_name, f"{prefix}{written_name}.", x, None))
                    for i, scalar in scalars if wanted else ():
                        path = ((*names, member_name + VALUES), (*positions, i)) if here else ((member_name + VALUES,), (i,))
                        inner.append((*path, depth + 1, row, member_name + VALUES, "", {}, scalar))
            todo.extend(reversed(inner))

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[tuple]) -> pa.RecordBatch:
            columns = [*zip(*rows, strict=True)]
            columns[9] = [[*x.items()] for x in columns[9]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _NODE_TYPES, strict=True)], names=[x.split()[0] for x in NODE_SCHEMA.split(", ")])

        for batch in batches:
            out: list[tuple] = []
            for record_id, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                value = decode_payload(text)
                if value is not None:
                    # inlined scalars are added to a row until its record is done
                    for row in rows_of(record_id, value):
                        out.append(row)
                if len(out) > ROWS_AT_ONCE:
                    yield told(out)
                    out = []
            if out:
                yield told(out)

    return df.select(F.col(id_col).cast("string").alias("record_id"), F.col(json_col).alias("payload")).mapInArrow(emit, NODE_SCHEMA)


def table_of(nodes: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One flat table: record_id, node_id, parent_table, parent_id and ``columns`` (dots name inlined members)."""
    return nodes.filter(F.col("table_name") == name).select(
        "record_id", "node_id", "parent_table", "parent_id", *(F.col("attrs")[c].alias(c.replace(".", "_")) for c in columns)
    )


def inline_shared(
    df: DataFrame, id_col: str, json_col: str, attributes: set[str] | None = None, declared: frozenset[str] = frozenset()
) -> tuple[TablePlan, DataFrame]:
    """The whole operator: analyse, decide, shred."""
    plan = plan_tables(schema_graph(df, json_col, declared), declared)
    return plan, shred(df, id_col, json_col, plan, attributes)
