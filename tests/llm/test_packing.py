import math
import random
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pytest

from lodestrand.llm import packing


def best_fit_decreasing(capacity, sizes):
    gaps, containers = [], 0
    for size in sorted(sizes, reverse=True):
        at = bisect_left(gaps, size)
        if at == len(gaps):
            containers += 1
            gap = capacity
        else:
            gap = gaps.pop(at)
        insort(gaps, gap - size)
    return containers


def pieces_of(sizes, capacity):
    return [p for s in sizes if s and s > 0 for p in [capacity] * (s // capacity) + ([s % capacity] if s % capacity else [])]


def stack(events):
    """Tightest free gap before each piece, by a stack per kind."""
    free, out = defaultdict(list), []
    for i, (kind, is_piece) in enumerate(events):
        if not is_piece:
            free[kind].append(i)
        elif free[kind]:
            out.append((i, free[kind].pop()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_sweep_against_a_stack(seed):
    rng = np.random.default_rng(seed)
    kind = np.sort(rng.integers(0, 3, 200)).astype(np.int32)
    is_piece = rng.random(200) < rng.choice([0.3, 0.5, 0.8])
    pieces, gaps = packing.successors(kind, is_piece)
    assert sorted(zip(pieces.tolist(), gaps.tolist(), strict=True)) == stack(list(zip(kind.tolist(), is_piece.tolist(), strict=True)))


@pytest.mark.parametrize("partitions", [1, 7])
def test_match_across_partitions(spark, partitions):
    rng = random.Random(partitions)
    pieces = [(k, rng.randrange(1, 60), True, None, i, 0, -1) for i, k in enumerate([0] * 150 + [1] * 90)]
    pieces = [(k, w, p, w, d, n, c) for k, w, p, _, d, n, c in pieces]
    gaps = [(k, rng.randrange(1, 60), False, None, None, None, i) for i, k in enumerate([0] * 120 + [1] * 130)]
    events = spark.createDataFrame(pieces + gaps, "kind int, width bigint, is_piece boolean, size bigint, doc_id bigint, piece_no bigint, container_id bigint")
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = packing.match(events)[0].collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    width = {(k, c): w for k, w, _, _, _, _, c in gaps}
    for kind in (0, 1):
        own = [r for r in rows if r["kind"] == kind]
        taken = [r["container_id"] for r in own if r["container_id"] is not None]
        assert len(own) == sum(p[0] == kind for p in pieces) and len(set(taken)) == len(taken)
        assert all(width[kind, r["container_id"]] >= r["size"] for r in own if r["container_id"] is not None)
        both = sorted([(-w, False) for k, w, *_ in gaps if k == kind] + [(-w, True) for k, w, *_ in pieces if k == kind])
        assert len(taken) == len(stack([(0, p) for _, p in both]))


def test_pack(spark):
    rng = random.Random(9)
    sizes = [rng.choice([0, None, 3, 17, 17, 17, 40, 64, 65, 300]) if i % 3 else 17 for i in range(700)]
    docs = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id bigint, n_tokens bigint, size string")
    specs = spark.createDataFrame([("a", 64), ("b", 1_000), ("a", 64), ("none", None), ("zero", 0)], "container_name string, capacity_tokens int")
    rows = packing.pack(docs, specs).collect()
    for name, capacity in (("a", 64), ("b", 1_000)):
        own = [r for r in rows if r["container_name"] == name]
        held, inside = defaultdict(list), defaultdict(list)
        for r in own:
            held[r["doc_id"]].append((r["token_from"], r["n_tokens"]))
            inside[r["container_id"]].append((r["position"], r["n_tokens"]))
        for i, s in enumerate(sizes):
            parts = sorted(held.get(i, []))
            assert sum(n for _, n in parts) == (s or 0) and len(parts) == (math.ceil(s / capacity) if s else 0)
            assert all(parts[k][0] + parts[k][1] == parts[k + 1][0] for k in range(len(parts) - 1))
        for parts in inside.values():
            at = 0
            for position, n in sorted(parts):
                assert position == at
                at += n
            assert at <= capacity
        assert len(inside) <= 1.01 * best_fit_decreasing(capacity, pieces_of(sizes, capacity)) + 1
    assert {r["container_name"] for r in rows} == {"a", "b"}
    checked = {r["container_name"]: r for r in packing.audit(packing.pack(docs, specs), specs).collect()}
    assert checked["a"]["n_whole"] == sum(1 for s in sizes if s) and not any(r[c] for r in checked.values() for c in ("n_broken", "n_split", "n_overfull", "n_gappy"))
    assert packing.pack(docs.filter("false"), specs).collect() == []
    assert packing.pack(docs, specs.filter("false")).collect() == []
    filled = {r["container_name"]: r for r in packing.fill(packing.pack(docs, specs), specs).collect()}
    assert filled["a"]["n_tokens"] == sum(s or 0 for s in sizes) and 0.9 < filled["a"]["fill"] <= 1
