import random

from lodestrand.operators import blocks


def test_blocks_against_brute_force(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(500, 300 + i) for i in range(40)] + [(rng.randrange(1_000, 1_080), rng.randrange(1_000, 1_080)) for _ in range(50)]
    label = {x: x for a, b in edges if a != b for x in (a, b)}
    for _ in range(len(label)):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    rows = edges + edges[:9] + [(b, a) for a, b in edges[:9]] + [(9_999, 9_999), (None, 5), (7_777, None)]
    got = [tuple(r) for r in blocks.matrix_blocks(spark.createDataFrame(rows, "i bigint, j bigint")).collect()]
    assert len(got) == len(dict(got)) and dict(got) == label
    assert blocks.matrix_blocks(spark.createDataFrame([], "i bigint, j bigint")).collect() == []
