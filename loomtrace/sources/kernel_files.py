"""Kernel files: JSON of several layouts into flat tables, and back into JSON.

Layouts read (member names in any letter case, with or without byte order mark, the
whole file possibly stored as one JSON string): ``{"Kernels": {kid: {...}}}``,
``{"Kernels": [[kid, {...}], ...]}``, the older ``{kid: [ids]}`` and ``[[ids], ...]``.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.shred import Column, Group, Leaf, Repeated, Shredder, depth_of, instances, shred_table

# Members of the current layout, in lower case.
MEMBERS = {"kernels", "validblocks", "blockcounts", "typeone", "typetwo", "typetwofive", "typethree", "typefour", "typethreefive"}

BLANKS = " \t\r"
_HEX = re.compile(r"0[xX][0-9a-fA-F]+\Z")
#: Digits of the longest whole number that is written out; 1e99999999 has more.
MOST_DIGITS = 1 << 24

KERNEL = Group()
KERNEL.fields = {"key": Leaf(), "blocks": Repeated(Leaf()), "labels": Repeated(Leaf()), "kernels": Repeated(KERNEL)}
FILE = Group({"layout": Leaf(), "kernels": Repeated(KERNEL)})


class Pairs(list):
    """Members of a JSON object in order; repeated names stay."""


class Number(str):
    """A JSON number as it is written, if it is not a whole one that ``int`` holds."""


_DECODER = json.JSONDecoder(object_pairs_hook=Pairs, parse_float=Number, parse_constant=lambda _: None)
#: For texts with whole numbers that are too long to become ``int``.
_SLOWER = json.JSONDecoder(object_pairs_hook=Pairs, parse_int=Number, parse_float=Number, parse_constant=lambda _: None)
_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true)|(false)|(null|NaN|-?Infinity)")


def _deep(text: str) -> object:
    """What ``_DECODER`` gives, by a stack of open objects and lists in place of recursion: for nesting beyond its depth."""
    pos = _SPACE.match(text).end()
    # of each open container: itself, and the name of the member that is to come
    stack: list[list] = []
    done = False
    value: object = None
    while not done:
        c = text[pos : pos + 1]
        if c == "{" or c == "[":
            pos = _SPACE.match(text, pos + 1).end()
            close = "}" if c == "{" else "]"
            if text[pos : pos + 1] == close:
                value, pos = Pairs() if c == "{" else [], pos + 1
            else:
                stack.append([Pairs() if c == "{" else [], None])
                if c == "{":
                    stack[-1][1], pos = _name(text, pos)
                continue
        elif c == '"':
            value, pos = json.decoder.scanstring(text, pos + 1, True)
        elif (m := _SCALAR.match(text, pos)) is not None:
            value, pos = _number(m[1]) if m[1] else True if m[2] else False if m[3] else None, m.end()
        else:
            raise ValueError(pos)
        # the value belongs to the innermost container, which may be complete with it, and so on
        while True:
            pos = _SPACE.match(text, pos).end()
            if not stack:
                done = True
                break
            held, name = stack[-1]
            held.append((name, value) if isinstance(held, Pairs) else value)
            c, pos = text[pos : pos + 1], pos + 1
            if c == ",":
                pos = _SPACE.match(text, pos).end()
                if isinstance(held, Pairs):
                    stack[-1][1], pos = _name(text, pos)
                break
            if c != ("}" if isinstance(held, Pairs) else "]"):
                raise ValueError(pos)
            value = stack.pop()[0]
    if pos != len(text):
        raise ValueError(pos)
    return value


def _number(text: str) -> int | Number:
    if text.lstrip("-").isdigit():
        try:
            return int(text)
        except ValueError:
            pass
    return Number(text)


def _name(text: str, pos: int) -> tuple[str, int]:
    """A member's name and where its value begins."""
    if text[pos : pos + 1] != '"':
        raise ValueError(pos)
    name, pos = json.decoder.scanstring(text, pos + 1, True)
    pos = _SPACE.match(text, pos).end()
    if text[pos : pos + 1] != ":":
        raise ValueError(pos)
    return name, _SPACE.match(text, pos + 1).end()


def _decode(text: str) -> object:
    try:
        try:
            return _DECODER.decode(text)
        except json.JSONDecodeError:
            raise
        except ValueError:
            return _SLOWER.decode(text)
    except RecursionError:
        return _deep(text)


def read_json(body: str | None) -> object:
    """Value of a complete JSON text, however deep, else None."""
    for _ in range(3):
        if body is None:
            return None
        text = body.removeprefix("\ufeff").strip()
        try:
            value = _decode(text)
        except ValueError:
            return None
        if not isinstance(value, str) or isinstance(value, Number):
            return value
        body = value
    return None


def _is_list(x: object) -> bool:
    return isinstance(x, list) and not isinstance(x, Pairs)


def _whole(x: str) -> str | None:
    """A JSON number >= 0 without fraction in decimal, else None."""
    n = Decimal(x)
    if n.is_signed() and n != 0 or not n.is_finite():
        return None
    if not n:
        return "0"
    _, digits, exponent = n.as_tuple()
    text = "".join(map(str, digits))
    if exponent >= 0:
        return text + "0" * exponent if len(text) + exponent <= MOST_DIGITS else None
    return text[:exponent] if len(text) > -exponent and not text[exponent:].strip("0") else None


def _decimal(n: int) -> str:
    try:
        return str(n)
    except ValueError:
        most = sys.get_int_max_str_digits()
        sys.set_int_max_str_digits(0)
        try:
            return str(n)
        finally:
            sys.set_int_max_str_digits(most)


def block_text(x: object) -> str | None:
    """A block id in decimal: whole number >= 0, or text of digits or ``0x`` and hex digits, of any length; else None."""
    if type(x) is int:
        return str(x) if x >= 0 else None
    if not isinstance(x, str):
        return None
    if x.isascii() and x.isdigit():
        return x if x[0] != "0" else x.lstrip("0") or "0"
    if isinstance(x, Number):
        try:
            return _whole(x)
        except (InvalidOperation, ValueError):
            return None
    t = x.strip(BLANKS)
    if t.isascii() and t.isdigit():
        return t.lstrip("0") or "0"
    return _decimal(int(t, 16)) if _HEX.match(t) else None


def _blocks(x: object) -> list[str] | None:
    if x is None:
        return None
    ids = [block_text(i) for i in (x if _is_list(x) else [x])]
    return [i for i in ids if i is not None]


def _labels(x: object) -> list[str] | None:
    if x is None:
        return None
    texts = [t for t in (x if _is_list(x) else [x]) if isinstance(t, str) and not isinstance(t, Number)]
    return [p for t in texts for s in t.split(";") if (p := s.strip())]


def _entries(x: object) -> list[tuple[str, object]] | None:
    """Key and value of each kernel in an object, a list of pairs or a plain list (position as key)."""
    if isinstance(x, Pairs):
        return [(str(k), v) for k, v in x]
    if not _is_list(x):
        return None
    paired = x and all(_is_list(e) and len(e) == 2 and isinstance(e[0], (str, int)) and not isinstance(e[0], bool) and isinstance(e[1], list) for e in x)
    return [(str(e[0]), e[1]) for e in x] if paired else [(str(i), e) for i, e in enumerate(x)]


def _kernels(entries: list[tuple[str, object]]) -> list[dict]:
    """Records of schema ``KERNEL`` for keys and values, with those of kernels inside, at any depth."""
    out: list[dict] = []
    todo = [(entries, out)]
    while todo:
        some, into = todo.pop()
        for key, x in some:
            k: dict = {"key": key, "blocks": None, "labels": None, "kernels": None}
            into.append(k)
            if not isinstance(x, Pairs):
                k["blocks"] = _blocks(x)
                continue
            for name, v in x:
                name = name.lower()
                if name == "blocks":
                    more = _blocks(v)
                    k["blocks"] = more if k["blocks"] is None else k["blocks"] + (more or [])
                elif name == "label":
                    more = _labels(v)
                    k["labels"] = more if k["labels"] is None else k["labels"] + (more or [])
                elif name == "kernels" and (inner := _entries(v)) is not None:
                    k["kernels"] = k["kernels"] or []
                    todo.append((inner, k["kernels"]))
    return out


def read_kernel_file(body: str | None) -> dict | None:
    """The record of schema ``FILE`` in a body; None where the body is no complete JSON object or list."""
    value = read_json(body)
    if isinstance(value, Pairs) and any(k.lower() in MEMBERS for k, _ in value):
        found = [e for k, v in value if k.lower() == "kernels" for e in (_entries(v) or [])]
        listed = any(k.lower() == "kernels" and _is_list(v) for k, v in value)
        layout = "pairs" if listed else "map"
    elif isinstance(value, list):
        found, layout = _entries(value) or [], "flat map" if isinstance(value, Pairs) else "flat list"
    else:
        return None
    return {"layout": layout, "kernels": _kernels(found)}


def _flatten(columns: dict[str, Column]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray | None, int, np.ndarray | None]]:
    """(table, record, kid, outer kid, depth, item) of a batch of files, as arrays, from its level sequences.

    One pass per nesting depth: kernels of depth n are the instances of the n-th
    repeated ancestor; their keys extend those of the enclosing instances.
    """
    outer: np.ndarray | None = None
    of_outer: np.ndarray | None = None
    depth, path = 1, "kernels[]"
    while (c := columns.get(f"{path}.key")) is not None:
        # definition levels: record 1, then list, element and group (3) for each depth, then the leaf itself
        lv = instances(c.reps, c.defs, depth, 1 + 3 * depth)
        own, parent = lv.own[lv.starts], lv.parent[lv.starts]
        if not len(own):
            return
        keys = np.array(c.vals, dtype=object)[lv.starts]
        n = int(lv.own[-1]) + 1
        kids, of = np.empty(n, dtype=object), np.zeros(n, dtype=np.int64)
        kids[own] = keys if outer is None else np.array([f"{a}/{b}" for a, b in zip(outer[parent], keys)], dtype=object)
        of[own] = parent if of_outer is None else of_outer[parent]
        yield "kernel", of[own], kids[own], None if outer is None else outer[parent], depth, None
        for name, table in (("blocks[]", "block"), ("labels[]", "label")):
            leaf = columns[f"{path}.{name}"]
            at = instances(leaf.reps, leaf.defs, depth + 1, 4 + 3 * depth)
            parent = at.parent[at.starts]
            yield table, of[parent], kids[parent], None, depth, np.array(leaf.vals, dtype=object)[at.starts]
        outer, of_outer, depth, path = kids, of, depth + 1, f"{path}.kernels[]"


def _texts(x: np.ndarray) -> pa.Array:
    """As a column of text; half characters, which UTF-8 cannot hold, become ``?``."""
    try:
        return pa.array(x, pa.string())
    except UnicodeEncodeError:
        return pa.array([t.encode("utf-8", "replace").decode() for t in x], pa.string())


_FLAT = "child string, kid string, outer_kid string, depth int, item string"
#: Characters of files whose levels are held at once; a longer file is worked on alone.
AT_ONCE = 1 << 22


def _parts(bodies: list[str | None]) -> Iterator[tuple[list[int], dict[str, Column]]]:
    """(row numbers, leaf columns of their records): files of about ``AT_ONCE`` characters, those of one depth together."""
    held: dict[int, list[tuple[int, dict]]] = {}
    size = 0

    def shredded() -> Iterator[tuple[list[int], dict[str, Column]]]:
        for depth, records in held.items():
            s = Shredder(FILE, depth + 1)
            for _, r in records:
                s.add(r)
            yield [i for i, _ in records], s.columns
        held.clear()

    for i, body in enumerate(bodies):
        size += len(body or "")
        if (r := read_kernel_file(body)) is not None:
            held.setdefault(depth_of(FILE, r), []).append((i, r))
        if size > AT_ONCE:
            size = 0
            yield from shredded()
    yield from shredded()


def kernel_rows(files: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Flat rows of all tables: ``keys`` and ``child`` (``kernel``, ``block`` or ``label``), ``kid``, ``outer_kid``, ``depth``, ``item``.

    ``kid`` is the outer kernels' keys and the kernel's own, joined by ``/``: the parent
    key of block and label rows, as the columns ``keys`` are of kernel rows. ``keys`` must
    not have these names. Files stored twice give their rows twice; a file that gives
    nothing gives none. Files are parsed, shredded and read off their level sequences
    in one pass over Arrow batches.
    """
    if set(keys) & {"child", "kid", "outer_kid", "depth", "item"}:
        raise ValueError("a key has the name of a result column")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, columns in _parts(b.column(b.schema.get_field_index(body)).to_pylist()):
                rows = np.array(at, dtype=np.int64)
                for child, record, kid, outer, depth, item in _flatten(columns):
                    n = len(record)
                    text = lambda x, n=n: pa.nulls(n, pa.string()) if x is None else _texts(x)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(b.schema.get_field_index(k)).take(pa.array(rows[record])) for k in keys]
                        + [pa.repeat(child, n).cast(pa.string()), text(kid), text(outer), pa.array(np.full(n, depth, dtype=np.int32)), text(item)],
                        names=[*keys, "child", "kid", "outer_kid", "depth", "item"],
                    )

    kinds = dict(files.dtypes)
    return files.select(*keys, body).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), _FLAT]))


def file_table(files: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """One row per stored file: ``keys``, ``layout`` (NULL where the body gives nothing) and the number of outermost kernels."""
    levels = shred_table(files.select(*keys, body), body, read_kernel_file, FILE)
    leaf = lambda p: F.expr(f"try_element_at(filter(levels, c -> c.path = '{p}'), 1)")
    top = leaf("kernels[].key")
    n = F.size(F.filter(top["defs"], lambda d: d >= 4))
    return levels.select(*keys, F.get(leaf("layout")["vals"], F.lit(0)).alias("layout"), F.when(F.size("levels") > 0, F.coalesce(n, F.lit(0))).alias("n_kernels"))


# The members that hold the kernels of a stage, in the order of the pipeline.
STAGES = ("TypeOne", "TypeTwo", "TypeTwoFive", "TypeThree", "TypeFour", "TypeThreeFive")


def numbered_sets(kernels: DataFrame) -> DataFrame:
    """``trace_id, stage, blocks, label, kid``: the different non-empty sets (``blocks``, sorted) of each trace and stage, numbered from 0 in their order.

    Of equal sets the greatest label stays.
    """
    sets = kernels.where(F.size("blocks") > 0).groupBy("trace_id", "stage", "blocks").agg(F.max("label").alias("label"))
    return sets.withColumn("kid", F.row_number().over(W.partitionBy("trace_id", "stage").orderBy("blocks")) - 1)


def to_kernel_files(kernels: DataFrame, counts: DataFrame) -> DataFrame:
    """``trace_id, body``: one kernel file per trace, with all members; its size is bounded by static code.

    ``kernels``: ``trace_id, stage, blocks`` (sorted), ``label``; ``counts``: ``trace_id, block_id, cnt``.
    ``Kernels`` holds the last stage; it and ``ValidBlocks`` are ``{}`` and ``[]`` where there
    are none. Labels that are empty are left out; keys are in the order of text.
    """
    sets = numbered_sets(kernels.where(F.col("trace_id").isNotNull() & F.col("stage").isin(list(STAGES)))).withColumn("key", F.col("kid").cast("string"))
    entry = lambda stage, value: F.collect_list(F.when(F.col("stage") == stage, F.struct("key", value.alias("value"))))
    final = F.struct(F.col("blocks").alias("Blocks"), F.nullif("label", F.lit("")).alias("Label"))
    per = sets.groupBy("trace_id").agg(entry(STAGES[-1], final).alias("Kernels"), *[entry(n, F.col("blocks")).alias(n) for n in STAGES])
    runs = counts.where(F.col("trace_id").isNotNull()).groupBy("trace_id").agg(
        F.array_sort(F.collect_list("block_id")).alias("ValidBlocks"), F.collect_list(F.struct(F.col("block_id").cast("string").alias("key"), F.col("cnt").alias("value"))).alias("BlockCounts")
    )
    all_ = per.join(runs, "trace_id", "full")
    maps = {n: F.map_from_entries(F.array_sort(F.coalesce(n, F.array().cast(dict(all_.dtypes)[n])))) for n in ("Kernels", "BlockCounts", *STAGES)}
    valid = F.coalesce("ValidBlocks", F.array().cast("array<bigint>"))
    members = [maps["Kernels"].alias("Kernels"), valid.alias("ValidBlocks"), maps["BlockCounts"].alias("BlockCounts"), *[maps[n].alias(n) for n in STAGES]]
    return all_.select("trace_id", F.to_json(F.struct(*members)).alias("body"))
