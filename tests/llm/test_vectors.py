"""Operator 11 against plain Lloyd in whole numbers, and its bounds against the distances that they bound."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievegate.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min((distance(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        best = [[nearest(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        books = [[[sum(x) // len(x) for x in zip(*of, strict=True)] if (of := [cut(v, p) for (_, v, _), b in zip(kept, best, strict=True) if b[p] == e]) else books[p][e] for e in range(len(books[p]))] for p in range(parts)]
    out = []
    for i, v, label in kept:
        found = [nearest(v, p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    total = {}
    for *_, error, label in out:
        total[label] = total.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return sorted(((i, code, error, total[label], digest) for i, code, error, label in out), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("extra").alias(c) for c in ("x", "entry", "lower", "code", "_n", "label_key")]).repartition(4)
    codes, books = vectors.compress(df, **options)
    digest = books.digest() if books else None
    return sorted(((*r, digest) for r in vectors.with_label_error(codes).collect()), key=repr)


def some(n, size=32, seed=3, grid=8):
    rng = random.Random(seed)
    hot = [rng.randrange(-grid, grid) / 16 for _ in range(size)]
    return [(k, hot if k % 3 == 0 else [rng.randrange(-grid, grid) / 16 for _ in range(size)], rng.choice([0, 0, 0, 1, None])) for k in range(n)]


@pytest.mark.parametrize("rounds", [0, 2, 4])
def test_equals_plain_lloyd(spark, rounds):
    rows = some(300)  # a coarse grid: many ties
    assert run(spark, rows, rounds=rounds) == plain(rows, rounds=rounds)


def test_odd_rows(spark):
    rows = [*some(150, seed=5), (None, some(2)[1][1], 1), (7, some(9)[7][1], None), (7, some(9)[8][1], 1), (900, None, 1), (901, [None] * 32, 1), (902, [float("nan")] + [0.0] * 31, 0), (903, [float("inf")] * 32, None)]
    assert run(spark, rows) == plain(rows)
    few = some(10)
    assert run(spark, few) == plain(few)
    assert run(spark, [(1, None, 1)]) == [] and run(spark, []) == []
    assert [(r[1], r[2]) for r in run(spark, [(1, [0.0] * 5, 1), (2, [], None)])] == [(None, None)] * 2
    mixed = run(spark, [*few, (50, [0.5] * 16, 1)])
    assert [r[:3] for r in mixed if r[0] != 50] == [r[:3] for r in plain(few)] and [r[1:3] for r in mixed if r[0] == 50] == [(None, None)]
    with pytest.raises(Exception, match="after scaling"):
        run(spark, [(1, [1e9] * 32, 1)])


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (4, 64, 4))
    x = (centres[:, rng.integers(0, 64, 500)].transpose(1, 0, 2) + rng.integers(-60, 60, (500, 4, 4))).astype(np.int64)
    books = vectors.Codebooks(x[:64].transpose(1, 0, 2).copy())
    step = books.step()
    entry, upper, lower = vectors.first(x, books, step)
    for k in range(3):
        to = vectors.Codebooks(books.entries + rng.integers(-5, 6, books.entries.shape))
        entry, upper, lower, computed = vectors.again(x, to, step, books.moved(to), entry, upper, lower)
        books = to
        d = vectors.squares(x[:, :, None], books.entries[None])
        assert (entry == d.argmin(-1)).all()
        assert (upper >= np.sqrt(np.take_along_axis(d, entry[..., None], -1)[..., 0])).all()
        assert (lower * step[None, :, None] <= np.sqrt(d)).all()
        assert computed < 0.2 * d.size, k


def test_state_keeps_upper_bounds():
    upper = np.sqrt(np.arange(1, 5000, 7, dtype=np.float64))
    assert (np.frombuffer(vectors._wide(upper), "<f4").astype(np.float64) >= upper).all()
