import random

from loomstone.operators import hierarchy as h


def brute(parents):
    out = {}
    for v in parents:
        x, seen, d = v, set(), 0
        while parents.get(x) in parents and x not in seen:
            seen.add(x)
            x = parents[x]
            d += 1
        out[v] = ("", -1) if x in seen else (x, d)
    return out


def forest(seed, n):
    r = random.Random(seed)
    parents = {f"n{i}": None if r.random() < 0.05 else f"n{r.randrange(max(0, i - 3), i + 1)}" for i in range(n)}
    for i in range(40, 60):  # a hot parent
        parents[f"n{i}"] = "n7"
    parents["n100"] = "n130"  # perhaps a cycle
    parents["n5"] = "gone"
    return parents


def load(spark, parents):
    rows = [(k, f" {v.upper()} " if v and hash(k) % 3 == 0 else v, "x") for k, v in parents.items()]
    rows += rows[:10] + [(None, "n1", "x"), ("n_blank", " ", "x")]
    return h.parent_links(spark.createDataFrame(rows, "id string, parent string, v string"), "id", "parent", "t")


def test_matches_brute_force_in_one_task_and_many_levels(spark):
    parents = forest(4, 700)
    want = brute(parents) | {"n_blank": ("n_blank", 0)}
    for limit in (10_000, 150, 40):
        got = {x.node_id: (x.root_id, x.depth) for x in h.resolve_hierarchy(load(spark, parents), limit).collect()}
        assert got == want, limit


def test_long_cycle_and_long_chain_across_fragments(spark):
    parents = {f"c{i}": f"c{(i + 1) % 300}" for i in range(300)} | {f"d{i}": f"d{i - 1}" if i else None for i in range(300)}
    parents |= {f"b{i}": "c3" for i in range(5)}
    got = {x.node_id: (x.root_id, x.depth) for x in h.resolve_hierarchy(load(spark, parents), 60).collect()}
    assert got == brute(parents) | {"n_blank": ("n_blank", 0)}


def test_paths_and_descendants(spark):
    parents = forest(5, 200)
    want = brute(parents)
    rows = {x.node_id: x for x in h.expand_hierarchy(load(spark, parents)).collect()}
    counts = {x.node_id: x.descendants for x in h.descendant_counts(load(spark, parents), 30).collect()}
    assert counts == {k: x.descendants for k, x in rows.items()}
    below = {}
    for v in parents:
        path, x = [v], v
        if want[v][1] >= 0:
            while parents.get(x) in parents:
                x = parents[x]
                path.append(x)
            for a in path[1:]:
                below[a] = below.get(a, 0) + 1
            assert rows[v].path == path[::-1]
        else:
            assert rows[v].path == [] and rows[v].descendants is None
    assert all(rows[v].descendants == below.get(v, 0) for v in parents if want[v][1] >= 0)


def test_empty(spark):
    assert h.resolve_hierarchy(load(spark, {}).where("false")).count() == 0
    assert h.expand_hierarchy(load(spark, {}).where("false")).count() == 0
