import random

from trustfold.llm.components import components


def test_against_union_find(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(1000, 1200)]  # a long chain
    edges += [(5000, 5000 + i) for i in range(1, 400)]  # a star
    edges += [(rnd.randrange(300), rnd.randrange(300)) for _ in range(150)] + [(7, 7), (9, 8), (8, 9), (8, 9)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()
    assert len(got) == len(want) and {r["node"]: r["root"] for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
