import json
import random

from hanok.operators import trees

GONE = object()


def truth(x):
    return x not in (None, False, 0, "", GONE)


def same(a, b):
    if a is GONE or b is GONE:
        return a is b
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)


def merged(b, m, r):
    """The rule, one value at a time."""
    if same(b, m):
        return r
    if same(b, r):
        return m
    if isinstance(m, list) and isinstance(r, list) and all(isinstance(x, dict) and truth(x.get("id")) for x in m + r):
        sides = [{json.dumps(x["id"]): x for x in s} for s in (r, m, [x for x in (b if isinstance(b, list) else []) if isinstance(x, dict) and truth(x.get("id"))])]
        ids = list(dict.fromkeys(i for s in sides for i in s))
        out = [merged(sides[2].get(i, GONE), sides[1].get(i, GONE), sides[0].get(i, GONE)) for i in ids]
        out = sorted((x for x in out if x is not GONE), key=lambda x: x.get("savedAt") or x.get("createdAt") or 0)
        return out[-10:] if any(truth(x.get("preset")) for x in m) else out
    if isinstance(m, dict) and isinstance(r, dict):
        base = b if isinstance(b, dict) else {}
        out = {k: merged(base.get(k, GONE), m.get(k, GONE), r.get(k, GONE)) for k in {**base, **r, **m}}
        return {k: v for k, v in out.items() if v is not GONE}
    return m


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 3)
    if kind < 3:
        return rng.choice([None, True, 0, 1, 25, "a", "나\"다\\", "", "x/y"])
    if kind == 3:
        return [value(rng, 5) for _ in range(rng.randrange(3))]
    if kind == 4:
        return {k: value(rng, depth + 1) for k in rng.sample(["a", "b", "c/d", 'e"f', "id", "savedAt"], rng.randrange(5))}
    preset = {"preset": True} if kind == 5 else {}
    stamp = lambda: {rng.choice(["savedAt", "createdAt", "other"]): rng.randrange(5)}
    return [{"id": rng.choice([i, str(i)]), **stamp(), **preset, "v": value(rng, depth + 1)} for i in rng.sample(range(1, 20), rng.randrange(15))]


def edited(rng, v):
    """The value with changes somewhere inside."""
    if rng.random() < 0.15:
        return value(rng, 2)
    if isinstance(v, dict):
        out = {k: edited(rng, x) for k, x in v.items() if rng.random() > 0.1}
        return out | ({rng.choice("abz"): value(rng, 3)} if rng.random() < 0.3 else {})
    if isinstance(v, list):
        out = [edited(rng, x) if not isinstance(x, dict) else {**edited(rng, x), **({"id": x["id"]} if "id" in x else {})} if isinstance(e := edited(rng, x), dict) or e is not None else x for x in v if rng.random() > 0.1]
        out = [x for x in out if x is not None]
        if rng.random() < 0.4 and all(isinstance(x, dict) and "id" in x for x in out):
            out.insert(rng.randrange(len(out) + 1), {"id": rng.randrange(30, 60), "savedAt": rng.randrange(9), "v": 1})
        return out
    return v if rng.random() < 0.8 else rng.choice([1, "b", None])


def safe(fn, *args):
    try:
        return fn(*args)
    except TypeError:
        return args[-1]


def test_equals_the_recursive_rule(spark):
    rng = random.Random(11)
    docs = []
    for _ in range(250):
        b = {k: value(rng) for k in ("maps", "storage", "presets")}
        sides = [safe(edited, rng, b) if rng.random() < 0.9 else b for _ in range(2)]
        sides = [GONE if rng.random() < 0.05 else s for s in sides]
        docs.append((b if rng.random() < 0.9 else GONE, *sides))
    frames = []
    for side in range(3):
        rows = [(i, json.dumps(d[side], ensure_ascii=False)) for i, d in enumerate(docs) if d[side] is not GONE]
        frames.append(spark.createDataFrame(rows, "doc int, value string"))
    got = {r.doc: json.loads(r.value) for r in trees.merge_documents(*frames, ["doc"]).collect()}
    want = {i: v for i, d in enumerate(docs) if (v := merged(*d)) is not GONE}
    assert got.keys() == want.keys()
    for i in want:
        assert same(got[i], want[i]), (docs[i], got[i], want[i])
    assert len({json.dumps(w) for w in want.values()}) > 150


def test_lists_cut_presets_inside_the_merge_and_null_is_a_value(spark):
    item = lambda i, v=0: {"id": f"p{i}", "savedAt": i, "preset": True, "v": v}
    base = {"presets": [item(i) for i in range(10)], "x": 1, "gone": 1}
    local = {"presets": [item(i) for i in range(10)] + [item(20, 1)], "x": None, "gone": 1}
    remote = {"presets": [item(i, 5 if i == 9 else 0) for i in range(1, 10)] + [item(15, 2)], "x": 2}
    frames = [spark.createDataFrame([("u", json.dumps(d))], "owner string, value string") for d in (base, local, remote)]
    out = json.loads(trees.merge_documents(*frames, ["owner"]).first().value)
    assert out["x"] is None and "gone" not in out
    assert [p["id"] for p in out["presets"]] == ["p2", "p3", "p4", "p5", "p6", "p7", "p8", "p9", "p15", "p20"]
    assert {p["id"]: p["v"] for p in out["presets"]}["p9"] == 5


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc int, value string")
    assert trees.merge_documents(none, none, none, ["doc"]).collect() == []
