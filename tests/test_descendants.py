"""Which nodes are below each node, against walks up from every node."""

from loomstone.operators import hierarchy as h
from test_hierarchy import forest, load


def test_every_descendant_comes_out(spark):
    parents = forest(5, 150) | {"a": "b", "b": "c", "c": "a", "d": "c", "e": "d", "f": "f"}
    want = set()
    for v in parents:
        x, seen = v, {v}
        while parents.get(x) in parents and parents[x] not in seen:
            x = parents[x]
            seen.add(x)
            want.add((x, v))
    got = [(r.node_id, r.descendant_id) for r in h.descendant_pairs(load(spark, parents), 30).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {("d", "e"), ("a", "b"), ("b", "a"), ("c", "e")} <= want
