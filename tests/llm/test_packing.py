import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediatide.llm import encoding as E
from mediatide.llm import packing as P
from mediatide.llm.packing import BITS, DIMENSIONS, along_curve, curve_keys, fill, hilbert_index, measured, pack, use

pytestmark = pytest.mark.skipif(not os.path.isdir(E.TOKENIZERS), reason="no public tokenizers")


def test_curve_visits_neighbours():
    side = 8
    grid = np.array([(a, b) for a in range(side) for b in range(side)])
    d = hilbert_index(grid, 3)
    assert sorted(d.tolist()) == list(range(side * side))
    path = grid[np.argsort(d)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    corner = hilbert_index(np.full((1, DIMENSIONS), (1 << BITS) - 1))
    assert 0 <= corner[0] < 1 << (BITS * DIMENSIONS)


def test_fill_against_all_subsets():
    rnd = random.Random(2)
    for _ in range(200):
        sizes = [rnd.randint(1, 40) for _ in range(rnd.randint(0, 8))]
        room = rnd.randint(0, 100)
        best = max(s for m in range(1 << len(sizes)) if (s := sum(x for k, x in enumerate(sizes) if m >> k & 1)) <= room)
        assert sum(sizes[k] for k in fill(sizes, room, room)) == best
        assert best >= sum(sizes[k] for k in fill(sizes, room, room // 2)) >= min(best, room // 2)


def test_along_the_curve():
    rnd = random.Random(2)
    for n in (0, 1, 7, 3000):
        # sizes as texts have them: many short ones, some long ones
        sizes = np.array([min(100, int(rnd.lognormvariate(3, 0.9))) if rnd.random() < 0.9 else 0 for _ in range(n)], np.int64)
        which = along_curve(sizes, 100)
        assert len(which) == n
        if n:
            used = np.bincount(which, weights=sizes)
            assert (used <= 100).all()
    assert sizes.sum() / (len(used) * 100) >= 0.98
    spans = [np.ptp(np.flatnonzero(which == c)) + 1 for c in range(len(used)) if (which == c).sum() > 1]
    assert np.median(spans) <= 300


def test_use(spark):
    """Neighbours on the curve share containers, and these are full."""
    rnd = random.Random(4)
    df = spark.createDataFrame([(k, min(5000, int(rnd.lognormvariate(5, 0.9))), k) for k in range(5000)], "doc_id bigint, n_tokens int, place bigint")
    kinds = [("small", 512), ("middle", 2048), ("large", 8192)]
    packed = pack(df, "doc_id", kinds)
    part = packed.select((F.col("curve_rank") / (1 << 40)).cast("int").alias("p")).distinct().count()
    assert part == 2
    for r in use(packed, spark.createDataFrame(kinds, "container_kind string, capacity_tokens int")).collect():
        assert r.filled >= 0.98
        assert r.median_span <= 5000 / part / 10


def test_containers(spark):
    rnd = random.Random(1)
    rows = [(k, " ".join(rnd.choice(["river", "kettle", "waltz"]) for _ in range(rnd.randint(1, 90))), "x") for k in range(400)]
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "word " * 5000, "x"), (1003, "same text", "x"), (1003, "same text", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, place string")
    sized = measured(df, "doc_id", "text")
    got = pack(sized, "doc_id", [("small", 64), ("large", 1000)]).toPandas()
    size = {k: len(E.encoder().encode_ordinary(t or "")) for k, t, _ in rows}
    for kind, capacity in (("small", 64), ("large", 1000)):
        g = got[got.container_kind == kind]
        used = g.groupby("container_id").n_tokens.sum()
        assert used.max() <= capacity
        assert used.sum() == sum(size[k] for k, _, _ in rows)
        assert set(g.doc_id) == set(size)
        split = g[g.piece > 0].doc_id.unique()
        assert all(size[d] > capacity for d in split)
        assert used.sum() / (len(used) * capacity) > 0.9
        pieces = g[g.doc_id == 1002].sort_values("piece")
        assert (pieces.from_token == pieces.piece * capacity).all()
    assert (got[got.doc_id == 1003].groupby("container_kind").size() == 2).all()
    assert pack(sized.limit(0), "doc_id", [("small", 64)]).count() == 0


def test_endless_texts_get_the_same_place(monkeypatch):
    text = " ".join(random.Random(3).choice(["river", "kettle", "waltz", "窗"]) for _ in range(2000))
    signs = P._projection()
    whole = curve_keys([text, "x"], signs)[0]
    monkeypatch.setattr(P, "MOST_CHARS", 1000)
    assert curve_keys([text], signs)[0] == whole
