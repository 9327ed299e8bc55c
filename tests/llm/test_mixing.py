"""The mix against a plain version of its targets, and what must hold of every draw."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from labelwright.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, nth int, target string, taken long, start int"


def targets(sizes):
    """source -> Fraction: shares by weight, those over three times the size held there, the rest shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    held, total = {}, Fraction(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in held]
        rest = total - sum(held.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return held | share
        held |= {s: Fraction(3 * sizes[s]) for s in over}


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "x", 9, 0) for i, t, s in rows], SCHEMA)


def made(n=900):
    r = random.Random(3)
    rows = [(k, " ".join(f"d{k}w{j}" for j in range(r.choice([0, 1, 3, 50, 400]))), "big" if k % 3 == 0 else r.choice(["a", "b", "cé", "", None, "z"])) for k in range(n)]
    rows += [(n, "tiny", "only one word"), (n + 1, None, "empty"), (n + 2, "\n\t ", "empty"), (None, "no id here", "big"), (None, "no id here", "big"), (4, rows[4][1], rows[4][2]), (n + 3, " ".join(f"l{j}" for j in range(60_000)), "a")]
    return rows


def test_targets_and_draws(spark):
    rows = made()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = targets(sizes)
    assert any(x == 3 * sizes[s] for s, x in want.items())
    documents, mix = mixing.mixed(docs_of(spark, rows), shard_blocks=500)
    plan = {(r.nth, r.start): r for r in documents.where("size > 0").collect()}
    of = {r.nth: r.source for r in documents.select("nth", "source").distinct().collect()}
    assert len(plan) == sum(size(t) > 0 for _, t, _ in rows) and documents.count() == len(rows)
    assert [of[k] for k in sorted(of)] == sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    pieces = mix.collect()
    taken, per_shard, seen = defaultdict(int), defaultdict(set), set()
    for p in pieces:
        d = plan[p.nth, p.start]
        assert 0 <= p.first_word and p.words > 0 and p.first_word + p.words <= d.size and p.doc_id == d.doc_id
        assert p.place == p.epoch * d.blocks + p.place % d.blocks < d.quota
        assert (p.nth, p.start, p.epoch, p.block) not in seen  # a block of a document once an epoch
        seen.add((p.nth, p.start, p.epoch, p.block))
        taken[p.nth, p.start] += p.words
        per_shard[p.shard].add((p.nth, p.place))
    for key, d in plan.items():
        assert d.size * (d.quota // d.blocks) <= taken[key] <= 3 * d.size
        assert abs(d.target - float(want[d.source])) <= 1e-6 * max(1, d.target) and d.source_size == sizes[d.source]
    by_source = Counter()
    for (nth, _), n in taken.items():
        by_source[of[nth]] += n
    for s, t in want.items():
        assert abs(by_source[s] - t) <= 2 * max(1, sizes[s] // 1024), s
    # every place of every quota is in one shard, and shards are as long as each other
    places = [x for v in per_shard.values() for x in v]
    assert len(places) == len(set(places)) == sum({r.nth: r.quota for r in plan.values()}.values())
    assert len(per_shard) > 8 and max(map(len, per_shard.values())) - min(map(len, per_shard.values())) <= 1
    for shard in list(per_shard)[:5]:
        mine = [p for p in pieces if p.shard == shard]
        assert sorted(p.slot for p in mine) == list(range(1, len(mine) + 1))
        order = [p.nth for p in sorted(mine, key=lambda p: p.slot)]
        assert order != sorted(order)  # shuffled
    # the words of the pieces
    text = {r[0]: r[1] for r in rows if r[0] is not None and r[0] != 4}
    some = mixing.texts(mix.where("doc_id IS NOT NULL AND doc_id <> 4"), docs_of(spark, [(i, t, "s") for i, t in text.items()])).join(mix.select("shard", "slot", "first_word", "words"), ["shard", "slot"])
    for r in some.collect():
        assert r.piece.split() == text[r.doc_id].split()[r.first_word : r.first_word + r.words]


def test_query(spark):
    rows = made(300)
    docs = docs_of(spark, rows)
    got = mixing.op13_mix(docs)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    a = sorted(map(tuple, got.collect()), key=repr)
    assert len(a) == len(rows) and all(t[4] <= 3 * t[1] for t in a)
    assert sorted(map(tuple, mixing.op13_mix(docs.repartition(7, F.rand())).collect()), key=repr) == a  # reruns agree
    assert mixing.op13_mix(docs.limit(0)).count() == 0
    none = mixing.op13_mix(docs_of(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in none) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_permutations():
    for n in (1, 2, 3, 5, 16, 17, 1000):
        for key in (1, 99):
            out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(out.tolist()) == list(range(n))
    assert mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 5, np.uint64)).tolist() != list(range(1000))


def test_split_follows_the_hypergeometric_law(spark):
    """Of 60 + 40 blocks in two shards, one source's count in the first has mean 30 and variance 50 * 0.6 * 0.4 * 50 / 99."""
    quotas = spark.createDataFrame([(0, 60), (1, 40)], "nth long, quota long").coalesce(1)
    import pandas as pd

    each = [mixing._split(1, seed)(pd.DataFrame({"node": [1, 1], "nth": [0, 1], "low": [0, 0], "n": [60, 40]})) for seed in range(2000)]
    first = np.array([int(x[(x.node == 2) & (x.nth == 0)].n.sum()) for x in each])
    assert abs(first.mean() - 30) < 0.3 and abs(first.var() - 50 * 0.6 * 0.4 * 50 / 99) < 0.6
    for depth in (0, 1, 5):
        rows = mixing.split(quotas, depth).collect()
        assert Counter({0: 60, 1: 40}) == sum((Counter({r.nth: r.n}) for r in rows), Counter())
        for nth, q in ((0, 60), (1, 40)):
            at = sorted((r.low, r.n) for r in rows if r.nth == nth)
            assert [x for x, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))] and sum(n for _, n in at) == q
