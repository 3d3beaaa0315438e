import random

import pytest

from millrace.llm.components import components


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_by_union_find(spark, kind):
    r = random.Random(4)
    edges = {
        "random": [(r.randrange(-60, 60), r.randrange(-60, 60)) for _ in range(50)],
        "path": [(i, i + 1) for i in range(40)],
        "star": [(7, i) for i in range(30)] + [(7, 7), (7, 8), (8, 7)],
        "none": [],
    }[kind]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((g.id, g.component) for g in got) == sorted((x, root(x)) for x in up)
