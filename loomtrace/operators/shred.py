"""Nested records as columns with repetition and definition levels, and back to flat tables.

A ``Shredder`` writes records as leaf columns: for every leaf path the values with, each,
a repetition level (the repeated ancestor at which this entry starts a new instance; 0
starts a record) and a definition level (how many optional or repeated ancestors are
present). ``instances`` reads from the level sequence of a leaf which instance of each
repeated ancestor an entry belongs to; a table per repeated ancestor follows from it,
with the ordinals of parent and child as the link. Columns hold a whole batch of records,
so that tables are read off them by array operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEVELS_TYPE = "array<struct<path:string, reps:array<int>, defs:array<int>, vals:array<string>>>"
_LEVELS_ARROW = pa.list_(
    pa.struct([("path", pa.string()), ("reps", pa.list_(pa.int32())), ("defs", pa.list_(pa.int32())), ("vals", pa.list_(pa.string()))])
)


@dataclass
class Leaf:
    """An optional scalar, kept as text."""


@dataclass
class Group:
    """An optional record. A field may hold the group itself: nesting of any depth."""

    fields: dict = field(default_factory=dict)


@dataclass
class Repeated:
    """An optional list."""

    item: object


@dataclass
class Column:
    reps: list = field(default_factory=list)
    defs: list = field(default_factory=list)
    vals: list = field(default_factory=list)


def depth_of(node: object, value: object) -> int:
    """How often a recursive group occurs within itself in ``value``, at most."""
    deepest, todo = 0, [(node, value, 0)]
    while todo:
        n, v, d = todo.pop()
        if v is None:
            continue
        if isinstance(n, Repeated):
            if not isinstance(n.item, Leaf):
                todo += [(n.item, x, d) for x in v]
        elif isinstance(n, Group):
            d += 1
            deepest = max(deepest, d)
            todo += [(sub, v[name], d) for name, sub in n.fields.items() if not isinstance(sub, Leaf) and v.get(name) is not None]
    return deepest


class Shredder:
    """Leaf columns of records of one schema, of which recursive fields are unrolled ``limit`` groups deep.

    A null record, a null or empty list and an absent field each leave one entry with
    a lower definition level in every leaf below, so all leaves under one repeated
    ancestor count its instances alike. ``limit`` must be above the ``depth_of`` every
    record, so that its innermost lists leave their null or empty mark.
    """

    def __init__(self, schema: Group, limit: int):
        self.schema, self.limit = schema, limit
        self.columns: dict[str, Column] = {}
        self._below: dict[tuple[int, str], list[Column]] = {}
        self._fields: dict[tuple[int, str], list[tuple[str, object, str]]] = {}
        self._leaves(schema, "", 0)

    def _leaves(self, node: object, path: str, depth: int) -> list[Column]:
        todo, found = [(node, path, depth)], []
        while todo:
            n, p, d = todo.pop()
            if isinstance(n, Leaf):
                found.append(self.columns.setdefault(p, Column()))
            elif isinstance(n, Repeated):
                todo.append((n.item, p + "[]", d))
            elif d < self.limit:
                todo += [(sub, f"{p}.{name}" if p else name, d + 1) for name, sub in n.fields.items()]
        return found

    def _absent(self, node: object, path: str, depth: int, r: int, d: int) -> None:
        below = self._below.get((id(node), path))
        if below is None:
            below = self._below[id(node), path] = self._leaves(node, path, depth)
        for c in below:
            c.reps.append(r)
            c.defs.append(d)
            c.vals.append(None)

    def add(self, record: dict | None) -> None:
        """One more record, written without recursion, its fields and list items in order."""
        todo = [(self.schema, record, "", 0, 0, 0, 0)]
        while todo:
            node, value, path, depth, rep, r, d = todo.pop()
            if value is None:
                self._absent(node, path, depth, r, d)
            elif isinstance(node, Leaf):
                c = self.columns[path]
                c.reps.append(r)
                c.defs.append(d + 1)
                c.vals.append(value)
            elif isinstance(node, Repeated):
                if not value:
                    self._absent(node, path, depth, r, d + 1)
                elif isinstance(node.item, Leaf):
                    # all values of a list at once
                    c = self.columns[path + "[]"]
                    c.reps.append(r)
                    c.reps += [rep + 1] * (len(value) - 1)
                    c.defs += [d + 2 if x is None else d + 3 for x in value] if None in value else [d + 3] * len(value)
                    c.vals += value
                else:
                    at = path + "[]"
                    todo += [(node.item, x, at, depth, rep + 1, rep + 1, d + 2) for x in value[:0:-1]]
                    todo.append((node.item, value[0], at, depth, rep + 1, r, d + 2))
            elif depth < self.limit:
                fields = self._fields.get((id(node), path))
                if fields is None:
                    fields = self._fields[id(node), path] = [(name, sub, f"{path}.{name}" if path else name) for name, sub in reversed(node.fields.items())]
                todo += [(sub, value.get(name), at, depth + 1, rep, r, d + 1) for name, sub, at in fields]


def shred(record: dict | None, schema: Group) -> dict[str, Column]:
    """Leaf columns of one record. A recursive field is unrolled as deep as the record goes."""
    s = Shredder(schema, depth_of(schema, record) + 1)
    s.add(record)
    return s.columns


@dataclass
class Levels:
    """Of one repeated ancestor, read from a leaf below it: per entry the ordinal of its instance and of the enclosing one."""

    own: np.ndarray
    parent: np.ndarray
    starts: np.ndarray


def instances(reps: np.ndarray, defs: np.ndarray, depth: int, present: int) -> Levels:
    """``depth``: repeated ancestors down to the wanted one; ``present``: definition level from which an instance exists."""
    reps = np.asarray(reps, dtype=np.int32)
    first = reps <= depth
    return Levels(np.cumsum(first) - 1, np.cumsum(reps <= depth - 1) - 1, first & (np.asarray(defs) >= present))


def unshred(columns: dict[str, Column], schema: Group) -> dict | None:
    """The record again, from nothing but levels and values (the round trip of ``shred``)."""

    def read(node: object, entries: dict[str, list], path: str, rep: int, d: int) -> object:
        mine = {p: e for p, e in entries.items() if p == path or p.startswith(path + "." if path else "") or p.startswith(path + "[]")}
        if not mine:
            return None
        top = max(e[0][1] for e in mine.values())
        if isinstance(node, Leaf):
            return mine[path][0][2] if mine[path][0][1] > d else None
        if top <= d:
            return None
        if isinstance(node, Repeated):
            if top == d + 1:
                return []
            groups: list[dict[str, list]] = []
            for p, e in mine.items():
                k = -1
                for x in e:
                    k += x[0] <= rep + 1 if k >= 0 else 1
                    while len(groups) <= k:
                        groups.append({})
                    groups[k].setdefault(p, []).append(x)
            return [read(node.item, g, path + "[]", rep + 1, d + 2) for g in groups]
        return {n: read(sub, mine, f"{path}.{n}" if path else n, rep, d + 1) for n, sub in node.fields.items()}

    return read(schema, {p: list(zip(c.reps, c.defs, c.vals)) for p, c in columns.items()}, "", 0, 0)


def shred_table(df: DataFrame, text: str, reader: Callable[[str | None], dict | None], schema: Group) -> DataFrame:
    """``df`` without column ``text`` but with ``levels``: the leaf columns of each row's record.

    ``reader`` turns the text into a record of ``schema``; where it gives None the row
    stays and ``levels`` is empty. A column that was called ``levels`` is replaced. Records are read one at a time in Arrow batches.
    """
    keep = [c for c in df.columns if c not in (text, "levels")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            levels = []
            for body in b.column(b.schema.get_field_index(text)).to_pylist():
                rec = reader(body)
                levels.append(
                    [] if rec is None else [{"path": p, "reps": c.reps, "defs": c.defs, "vals": c.vals} for p, c in shred(rec, schema).items()]
                )
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array(levels, _LEVELS_ARROW)], names=[*keep, "levels"])

    kinds = dict(df.dtypes)
    return df.select(*keep, text).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"levels {LEVELS_TYPE}"]))
