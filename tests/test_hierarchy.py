import random

import pytest

from symvane.operators.hierarchy import descendants, hierarchy


def brute(rows):
    parent = {}
    for i, p, label in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "")):
        parent.setdefault(i, (p, label))
    out = {}
    for i in parent:
        seen, cur = [i], i
        while True:
            p = parent[cur][0]
            if p is None or p not in parent:
                state, root = ("rooted" if p is None else "orphan"), cur
                break
            if p in seen:
                ring = seen[seen.index(p):]
                state, root = ("cycle" if i in ring else "below_cycle"), min(ring)
                break
            seen.append(p)
            cur = p
        ok = state in ("rooted", "orphan")
        out[i] = (state, root, len(seen) - 1 if ok else None, seen[::-1] if ok else None, [parent[x][1] for x in seen[::-1]] if ok else None)
    return out


def run(df, **kw):
    return {r.id: (r.state, r.root_id, r.depth, r.ids, r.path) for r in hierarchy(df, "id", "parent_id", "name", **kw).collect()}


def random_rows(seed, n=70):
    r = random.Random(seed)
    rows = [(i, r.choice([None, r.randrange(n + 5)]), f"n{i}", r.randrange(5)) for i in range(n)]
    if seed == 1:  # a long chain through all partitions, a ring and tails below it
        rows = [(i, i - 1 if i else None, f"n{i}", i % 7) for i in range(n)] + [(100 + i, 100 + (i + 1) % 9, f"c{i}", i % 3) for i in range(9)]
        rows += [(200 + i, 199 + i if i else 104, f"b{i}", i % 3) for i in range(9)]
    if seed == 2:
        rows = [(i, r.randrange(n), f"n{i}", r.randrange(5)) for i in range(n)]
    return rows + rows[:7]


@pytest.mark.parametrize("seed", [0, 1, 2])
@pytest.mark.parametrize("merge_rows", [0, 5, 10**6])
def test_equals_brute_force(spark, seed, merge_rows):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, "id long, parent_id long, name string, f int")
    assert run(df, locality="f", merge_rows=merge_rows, tasks=4) == brute([x[:3] for x in rows])


def test_edges(spark):
    schema = "id long, parent_id long, name string, top long, state string, ids string"  # names the operator uses itself
    assert run(spark.createDataFrame([], schema)) == {}
    rows = [(1, None, None, 5, "x", "y"), (2, 1, "b", 5, "x", "y"), (None, 1, "z", 5, None, None), (3, 3, "self", 1, None, None), (4, 9, "", 1, None, None), (2, 7, "other", 1, None, None)]
    got = run(spark.createDataFrame(rows, schema))
    assert got == brute([r[:3] for r in rows])
    assert got[1] == ("rooted", 1, 0, [1], [None]) and got[3][0] == "cycle" and got[4][:2] == ("orphan", 4)
    assert got[2][:3] == ("rooted", 1, 1)  # of two rows of an id the smallest parent counts


def test_descendants(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 1, "d"), (5, 5, "r")], "id long, parent_id long, name string")
    placed = hierarchy(df, "id", "parent_id", "name")
    assert sorted(tuple(r) for r in descendants(placed).collect()) == [(1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 3, 1)]


def test_hot_parent_without_broadcast(spark, monkeypatch):
    from symvane.operators import hierarchy as mod

    monkeypatch.setattr(mod, "BROADCAST_LINKS", -1)
    monkeypatch.setattr(mod, "TASK_ROWS", 40)
    rows = [(i, 7 if 100 < i < 400 else i // 2 if i else None, f"n{i}", i % 3 if i < 300 else 9) for i in range(500)] + [(900, 901, "o", 1), (902, 901, "o", 2), (903, 903, "c", 2)]
    df = spark.createDataFrame(rows, "id long, parent_id long, name string, f int")
    assert run(df, locality="f", merge_rows=0) == brute([x[:3] for x in rows])


@pytest.mark.parametrize("elements", [10**6, 60])
def test_levels_of_the_merge(spark, monkeypatch, elements):
    from symvane.operators import hierarchy as mod

    monkeypatch.setattr(mod, "FAN", 2)
    monkeypatch.setattr(mod, "MERGE_ELEMENTS", elements)
    r = random.Random(9)
    rows = [(i, i - 1 if i else None, f"n{i}", i // 9) for i in range(120)] + [(200 + i, 200 + (i + 1) % 60, f"c{i}", i // 7) for i in range(60)]
    rows += [(300 + i, r.choice([r.randrange(120), 200 + r.randrange(60), 299 + i, 900]), f"t{i}", i // 5) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, parent_id long, name string, f int")
    calls = []
    monkeypatch.setattr(mod, "_through", lambda *a, keep=mod._through: calls.append(a[0] is not a[1]) or keep(*a))
    assert run(df, locality="f", merge_rows=60, tasks=8) == brute([x[:3] for x in rows])
    assert any(calls) == (elements > 60)
