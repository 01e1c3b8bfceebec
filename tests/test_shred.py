"""Shredding: exact round trip, links, and kernel files against a plain recursive reader."""

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomtrace.functions.arrow import plain as values
from loomtrace.operators.shred import Group, Leaf, Repeated, Shredder, depth_of, instances, shred, unshred
from loomtrace.sources.kernel_files import _deep, block_text, file_table, kernel_rows, read_json, read_kernel_file, to_kernel_files
from loomtrace.sources.texts import read_texts, write_texts

NODE = Group()
NODE.fields = {"name": Leaf(), "tags": Repeated(Leaf()), "kids": Repeated(NODE), "grid": Repeated(Repeated(Leaf()))}
word = st.one_of(st.none(), st.text(max_size=3))
lists = st.one_of(st.none(), st.lists(word, max_size=3))


def node(kids):
    return st.one_of(st.none(), st.fixed_dictionaries({"name": word, "tags": lists, "kids": st.one_of(st.none(), st.lists(kids, max_size=3)), "grid": st.one_of(st.none(), st.lists(lists, max_size=3))}))


@settings(max_examples=200, deadline=None)
@given(st.recursive(node(st.none()), node, max_leaves=8))
def test_round_trip(record):
    assert unshred(shred(record, NODE), NODE) == record


@settings(max_examples=100, deadline=None)
@given(st.lists(st.recursive(node(st.none()), node, max_leaves=6), min_size=1, max_size=5))
def test_batches(records):
    """The columns of a batch are those of its records one after the other."""
    limit = max(depth_of(NODE, r) for r in records) + 1
    whole, parts = Shredder(NODE, limit), [Shredder(NODE, limit) for _ in records]
    for r, p in zip(records, parts):
        whole.add(r)
        p.add(r)
        assert unshred(p.columns, NODE) == r
    for path, c in whole.columns.items():
        for f in ("reps", "defs", "vals"):
            assert getattr(c, f) == [x for p in parts for x in getattr(p.columns[path], f)]


json_values = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=4)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(max_size=3), x, max_size=3)), max_leaves=10)


@settings(max_examples=200, deadline=None)
@given(json_values, st.integers(0, 5), st.sampled_from(["", "x", ",", "]", "}", '"', ":", "1"]))
def test_deep_reader(value, cut, more):
    """The reader without recursion agrees with the other on whole and on damaged texts."""
    for text in (json.dumps(value), json.dumps(value, indent=1)[cut:] + more, json.dumps(value)[:-cut] if cut else "{}"):
        try:
            got = _deep(text.strip())
        except ValueError:
            got = None
        want = read_json(text) if not isinstance(got, str) or type(got) is not str else got
        assert got == want and type(got) is type(want)


def test_deep_files(spark):
    deep = lambda n: "[" * n + "]" * n
    inner = '{"Blocks":[1],"Kernels":{"a":' * 1500 + "[7]" + "}}" * 1500
    bodies = ['{"Kernels":{"0":{"Blocks":[1,2]}},"Other":%s}' % deep(50_000), '{"Kernels":{"0":{"Blocks":[3,%s]}}}' % deep(50_000), '{"Kernels":{"0":{"Blocks":[4]},"x":%s' % deep(50_000), '{"Kernels":{"k":%s}}' % inner]
    df = spark.createDataFrame(list(enumerate(bodies)), "f int, body string")
    got = {(r.f, r.kid, r.item) for r in kernel_rows(df, ["f"]).where("child = 'block'").collect()}
    assert {x for x in got if x[0] < 3} == {(0, "0", "1"), (0, "0", "2"), (1, "0", "3")}
    assert {x[1:] for x in got if x[0] == 3} == {("k" + "/a" * i, "1") for i in range(1500)} | {("k" + "/a" * 1500, "7")}


def test_levels():
    c = shred({"name": "r", "tags": ["a", "b"], "kids": [{"name": "x", "tags": [], "kids": None, "grid": None}, None, {"name": "y", "tags": ["c"], "kids": None, "grid": None}], "grid": None}, NODE)
    assert c["tags[]"].vals == ["a", "b"] and c["tags[]"].reps == [0, 1]
    k = c["kids[].tags[]"]
    assert k.reps == [0, 1, 1] and k.vals == [None, None, "c"]
    lv = instances(k.reps, k.defs, 1, 4)
    assert lv.own.tolist() == [0, 1, 2] and lv.starts.tolist() == [True, False, True]


def plain(body):
    """Block and label links of a kernel file, by direct recursion."""
    out = set()
    if body is None:
        return out
    try:
        x = json.loads(body.lstrip("﻿"))
        if isinstance(x, str):
            x = json.loads(x)
    except ValueError:
        return out

    def kernels(x):
        if isinstance(x, dict):
            return list(x.items())
        if isinstance(x, list):
            if x and all(isinstance(e, list) and len(e) == 2 and not isinstance(e[0], (list, dict)) and isinstance(e[1], (list, dict)) for e in x):
                return [(str(a), b) for a, b in x]
            return [(str(i), e) for i, e in enumerate(x)]
        return []

    def block(x):
        if isinstance(x, bool) or x is None:
            return None
        if isinstance(x, (int, float)):
            return str(int(x)) if x >= 0 and x == int(x) else None
        t = x.strip(" \t\r")
        if t.isascii() and t.isdigit():
            return str(int(t))
        if t[:2] in ("0x", "0X") and t[2:] and all(c in "0123456789abcdefABCDEF" for c in t[2:]):
            return str(int(t, 16))
        return None

    def walk(kid, v):
        if not isinstance(v, dict):
            for b in v if isinstance(v, list) else [v]:
                if not isinstance(b, (list, dict)) and block(b) is not None:
                    out.add((kid, "block", block(b)))
            return
        for name, m in v.items():
            if name.lower() == "blocks":
                for b in m if isinstance(m, list) else [m]:
                    if not isinstance(b, (list, dict)) and block(b) is not None:
                        out.add((kid, "block", block(b)))
            elif name.lower() == "label":
                for t in m if isinstance(m, list) else [m]:
                    if isinstance(t, str):
                        out.update((kid, "label", p.strip()) for p in t.split(";") if p.strip())
            elif name.lower() == "kernels":
                for k, e in kernels(m):
                    walk(f"{kid}/{k}", e)

    known = {"kernels", "validblocks", "blockcounts", "typeone", "typetwo", "typetwofive", "typethree", "typefour", "typethreefive"}
    if isinstance(x, dict) and any(k.lower() in known for k in x):
        for name, v in x.items():
            if name.lower() == "kernels":
                for k, e in kernels(v):
                    walk(k, e)
    else:
        for k, e in kernels(x):
            walk(k, e)
    return out


BODIES = [
    None, "", " ", "{", "null", "3", '"x"', "[]", "{}", '{"Kernels":null}', '{"Kernels":{}}', '{"ValidBlocks":[1]}',
    '{"Kernels":{"0":{"Blocks":[1,2,2,-1,null,"0X1F"," 7\\r",3.0,3.5,"x","-4",true],"Label":"a; b;;"}}}',
    '{"kernels":[[0,{"BLOCKS":5,"LABEL":["p;q"," "]}],["k",{"Kernels":{"1":{"Blocks":["0x10"],"Label":"in","KERNELS":[["z",{"Blocks":[9]}]]}}}]]}',
    '{"0":[1,2],"K1_x":[3,"0x4"],"2":null}', "[[1,2],[],[3]]", '﻿{"0":[8]}', json.dumps('{"Kernels":{"0":{"Blocks":[6]}}}'),
    '{"Kernels":{"0":{"Blocks":[1]}}', '{"Kernels":{"0":{"Blocks":[1]}}} x', "[" * 5000, '{"Kernels":{"a":{"Label":5,"Blocks":{"x":1}},"b":null,"c":[4]}}',
]


def test_kernel_files(spark):
    rows = [(i, "t", "clash", b) for i, b in enumerate(BODIES)]
    df = spark.createDataFrame(rows, "file_id bigint, trace_id string, levels string, body string")
    got = {(r.file_id, r.kid, r.child, r.item) for r in kernel_rows(df, ["file_id"]).collect() if r.child != "kernel"}
    assert got == {(i, *x) for i, b in enumerate(BODIES) for x in plain(b)}
    outer = {(r.kid, r.outer_kid, r.depth) for r in kernel_rows(df, ["file_id"]).where("child = 'kernel' and file_id = 13").collect()}
    assert outer == {("0", None, 1), ("k", None, 1), ("k/1", "k", 2), ("k/1/z", "k/1", 3)}
    files = {r.file_id: (r.layout, r.n_kernels) for r in file_table(df, ["file_id"]).collect()}
    assert files[0] == (None, None) and files[13] == ("pairs", 2) and files[15] == ("flat list", 3) and files[10] == ("map", 0)
    assert kernel_rows(df.limit(0), ["file_id"]).count() == 0


def test_long_body(spark):
    big = json.dumps({"Kernels": {str(k): {"Blocks": list(range(2000))} for k in range(100)}})
    df = spark.createDataFrame([(1, big)], "file_id bigint, body string")
    assert kernel_rows(df, ["file_id"]).where("child = 'block'").count() == 200_000


def test_ids(spark):
    n = 10**5000 + 7
    texts = ["1" + "0" * 41, "1e41", "1E+5", "100e-2", "15e-1", "-0", "-0.0", "-1", "1e999999999999", json.dumps(f" {'0' * 9}12\r"), json.dumps("0x" + "f" * 4000), json.dumps(hex(n)), json.dumps("1" * 9000), '"\\ud800"', '"12\\n"', '"0x1f\\n"', "true", "[1]", '"1e3"', "0.000"]
    want = ["1" + "0" * 41, "1" + "0" * 41, "100000", "1", None, "0", "0", None, None, "12", None, "1" + "0" * 4999 + "7", "1" * 9000, None, None, None, None, None, None, "0"]
    got = [block_text(read_json(f"[{t}]")[0]) for t in texts]
    assert [g for i, g in enumerate(got) if i != 10] == [w for i, w in enumerate(want) if i != 10] and len(got[10]) == 4817
    rows = kernel_rows(spark.createDataFrame([(1, '{"a\\ud800":{"Label":"x\\udc00;y"}, "Kernels":{"\\ud800":{"Label":"x\\udc00;y"}}}')], "f int, body string"), ["f"]).where("child = 'label'")
    assert {(r.kid, r.item) for r in rows.collect()} == {("?", "x?"), ("?", "y")}


def test_texts():
    assert block_text("0" * 5000 + "7") == "7" and block_text("") is None and read_json("﻿[1]") == [1]
    assert read_kernel_file('{"0":[1]}')["layout"] == "flat map"


def test_sink_round_trip(spark, tmp_path):
    rng = random.Random(1)
    want = {t: sorted({tuple(sorted(rng.sample(range(100), 5))) for _ in range(20)}) for t in ("a", "../b")}
    rows = [(t, "TypeThreeFive", list(b), 'l"' if i % 2 else "") for t, bs in want.items() for i, b in enumerate(bs)]
    rows += [(*rows[0][:3], None), ("a", "TypeOne", [7], "x"), ("a", "TypeOne", [], "x"), (None, "TypeOne", [7], "x"), ("a", "Other", [7], "x")]
    df = spark.createDataFrame(rows, "trace_id string, stage string, blocks array<bigint>, label string")
    counts = spark.createDataFrame([("a", 5, 2), ("a", 10, 1), ("c", 1, 1), (None, 1, 1)], "trace_id string, block_id bigint, cnt bigint")
    bodies = to_kernel_files(df, counts)
    got = {r.trace_id: json.loads(r.body) for r in bodies.collect()}
    assert set(got) == {"a", "../b", "c"} and got["c"]["Kernels"] == {} and got["c"]["TypeOne"] == {} and got["a"]["TypeOne"] == {"0": [7]}
    assert got["a"]["ValidBlocks"] == [5, 10] and got["a"]["BlockCounts"] == {"5": 2, "10": 1} and got["../b"]["ValidBlocks"] == []
    for t, bs in want.items():
        assert got[t]["Kernels"] == {str(i): {"Blocks": list(b)} | ({"Label": 'l"'} if i % 2 else {}) for i, b in enumerate(bs)}
    write_texts(bodies.selectExpr("trace_id name", "0 part", "body"), str(tmp_path / "k"), ".json")
    back = kernel_rows(read_texts(spark, str(tmp_path / "k"), ".json"), ["name"]).where("child <> 'kernel'").collect()
    assert {(r.name, r.kid, r.item) for r in back if r.child == "block"} == {(t, str(i), str(x)) for t, bs in want.items() for i, b in enumerate(bs) for x in b}
    assert {(r.name, r.kid) for r in back if r.child == "label"} == {(t, str(i)) for t, bs in want.items() for i in range(len(bs)) if i % 2}


def test_plain():
    import pyarrow as pa

    cols = [[1, 2, 3], [None, None], [1, None], ["a", "b"], [True, False], [[1, 2], [], [3]], [["x"], ["y", "z"]], [[1], None], [[1, None]], [{"a": 1}], [1.5], []]
    for c in cols:
        a = pa.array(c)
        assert values(a) == c and values(a[1:]) == c[1:]


def test_texts_in_parts(spark, tmp_path):
    df = spark.createDataFrame([("x", 2, "c"), ("x", 1, "b"), ("x", 0, None), ("y", 0, "é"), ("", 0, "z")], "name string, part int, body string")
    for _ in range(2):
        write_texts(df, f"file:{tmp_path}/t")
    assert {tuple(r) for r in read_texts(spark, f"{tmp_path}/t").collect()} == {("x", "bc"), ("y", "é"), ("", "z")}
