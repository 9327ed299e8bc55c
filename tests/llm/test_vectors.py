"""Vector codes against distances to all entries, in Python's integers."""

import hashlib
import math
import random

import numpy as np

from labelwright.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, code int, error string, packed int"


def brute(rows, parts=8, entries=16, rounds=6, clip=None):
    keep = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(parts, -(-max((len(v) for _, v, _ in keep), default=0) // parts) * parts)
    d = width // parts
    ints = [[math.floor(4096 * x) for x in (*v, *[0.0] * (width - len(v)))] for _, v, _ in keep]
    if clip:
        ints = [[max(-clip, min(clip, x)) for x in v] for v in ints]
    cut = [[tuple(v[p * d : (p + 1) * d]) for p in range(parts)] for v in ints]
    order = sorted(range(len(keep)), key=lambda k: (keep[k][0] is None, keep[k][0] or 0, np.array(keep[k][1], "<f4").tobytes()))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e)) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, a in zip(cut, at) if a[p] == e]
                if mine:
                    books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine))
    at = assign()
    error = [sum(far(v[p], books[p][a[p]]) for p in range(parts)) for v, a in zip(cut, at)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by_label = {}
    for (_, _, label), e in zip(keep, error):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for e in a), err, by_label[label], sha) for (i, _, label), a, err in zip(keep, at, error)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x", 2) for i, v, label in rows], SCHEMA)


def f32(x):
    return float(np.float32(x))


def test_against_all_distances(spark):
    r = random.Random(5)
    rows = [(k, [f32(r.gauss(0, 0.2)) for _ in range(24)], r.choice([None, 0, 1, 2])) for k in range(300)]
    rows += [(300 + k, rows[k % 5][1], 1) for k in range(40)]  # copies
    rows += [(400, None, 1), (401, [None] * 24, 1), (402, [float("nan")] * 24, 1), (403, [float("inf"), *[0.0] * 23], 1), (None, [0.25] * 24, None), (None, [0.5] * 24, 2), (3, [-0.0] * 24, 0), (3, [0.125] * 24, 0)]
    got = vectors.op12_vector_codes(frame(spark, rows).repartition(5))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_awkward_tables(spark):
    short = [(k, [f32(0.1 * k)] * (k % 4 * 5), None if k % 2 else 7) for k in range(9)]  # lengths 0 to 15, fewer rows than entries
    assert sorted(map(tuple, vectors.op12_vector_codes(frame(spark, short)).collect()), key=repr) == brute(short)
    ties = [(k, [f32(v) for v in ([0.0] * 8 if k % 2 else [0.5] * 8)], 1) for k in range(40)]
    assert sorted(map(tuple, vectors.op12_vector_codes(frame(spark, ties)).collect()), key=repr) == brute(ties)
    large = [(k, [f32(3e38 * (-1) ** k), *[f32(k)] * 7], 1) for k in range(20)]
    assert sorted(map(tuple, vectors.op12_vector_codes(frame(spark, large)).collect()), key=repr) == brute(large, clip=1 << (62 - 3) // 2 - 1)
    assert vectors.op12_vector_codes(frame(spark, short).limit(0)).count() == 0
    assert vectors.op12_vector_codes(frame(spark, [(1, None, 1), (2, [float("nan")], 1)])).count() == 0


def test_doubles(spark):
    r = random.Random(8)
    rows = [(k, [r.gauss(0, 1) for _ in range(16)], 0) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, vectors.op12_vector_codes(df).collect()), key=repr) == brute(rows)


def test_masks_hold_the_nearest_and_drop_others():
    r = np.random.default_rng(1)
    for m, d in ((1, 3), (16, 8), (64, 2), (40, 1)):
        entries = r.integers(-50, 50, (m, d))
        entries[-1] = entries[0]
        x = r.integers(-60, 60, (500, d))
        book = vectors.Book(entries)
        at, far = book.nearest(x)
        all_far = ((x[:, None, :] - entries) ** 2).sum(2)
        assert (at == all_far.argmin(1)).all() and (far == all_far.min(1)).all()
        left = np.mean([bin(int(c)).count("1") for c in book.candidates(x)])
        assert left < m * (0.95 if d == 8 else 0.5) or m == 1
