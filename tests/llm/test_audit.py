"""The filter audit against every order applied one by one."""

import random
import re
from fractions import Fraction
from itertools import permutations
from math import factorial

import pytest

from labelwright.llm import audit

COLUMNS = ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, mask string, good int"
LABELS = "doc_id long, quality int, toxic int, part string"


def fails(rows, doc_id, text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    smaller = doc_id is not None and any(i is not None and i < doc_id and (u or "") == t for i, u, _ in rows)
    return {
        "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
        "D": bool(re.search(r"[#$%&*|]", t)), "E": smaller,
    }


def brute(rows, labels):
    out = []
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(i, fails(rows, i, t)) for i, t, lang in rows if (lang or "") == part]
        good = {i for i, q, _ in labels if q == 1 and i is not None}
        toxic = {i for i, _, x in labels if x == 1 and i is not None}
        here, removed = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [i for i, bad in left if bad[f]]
                left = [(i, bad) for i, bad in left if not bad[f]]
                all_failing = sum(bad[f] for _, bad in mine)
                alone = sum(bad[f] and sum(bad.values()) == 1 for _, bad in mine)
                removed[f] += len(gone)
                here.append([part, "".join(order), step, f, len(left), len(gone), all_failing - len(gone), alone, sum(i in good for i in gone), sum(i in toxic for i in gone)])
        out += [(*r, removed[r[3]]) for r in here]
    return sorted(out)


def test_against_every_order(spark):
    r = random.Random(2)
    long = " ".join(f"w{r.randint(0, 90)}" for _ in range(30_000))
    some = [None, "", "  \n\t", "few words", "MANY Capitals HERE", "a $ b", "a $ b", " ".join(map(str, range(150))), " ".join(map(str, range(150))), "x " * 200, long, long, "é漢字 Ünï x", " ".join(map(str, range(120))) + " #", "CAPS " * 120]
    rows = [(r.choice([None, *range(40)]), r.choice(some), r.choice([None, "", "en", "fr"])) for _ in range(120)] + [(7, "a $ b", "en")] * 3
    labels = [(r.choice([None, *range(40)]), r.choice([None, 0, 1]), r.choice([None, 0, 1])) for _ in range(50)]
    docs = spark.createDataFrame([(i, t, lang, "s", 1, 5, "m", 9) for i, t, lang in rows], SCHEMA)
    told = spark.createDataFrame([(*x, "zz") for x in labels], LABELS)
    got = audit.op11_audit(docs, told)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)
    assert audit.op11_audit(docs.limit(0), told).count() == 0
    assert sorted(map(tuple, audit.op11_audit(docs, told.limit(0)).collect())) == brute(rows, [])


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 6])
def test_least_squares_give_shapley_shares(k):
    r = random.Random(k)
    game = [0] + [r.randint(0, 1000) for _ in range(2**k - 1)]
    want = []
    for i in range(k):
        total = 0
        for order in permutations(range(k)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += game[before | 1 << i] - game[before]
        want.append(Fraction(total, factorial(k)))
    assert audit.shapley(game) == want


def test_other_filters(spark):
    facts = spark.createDataFrame([("p", m, 1, 0, 0) for m in (0, 1, 1, 3, 2)], "part string, mask int, n long, good long, toxic long")
    rows = {(x.filter_order, x.step): x for x in audit.audit(facts, "xy").collect()}
    assert (rows["xy", 1].removed, rows["xy", 2].removed, rows["xy", 2].redundant, rows["yx", 1].removed) == (3, 1, 1, 2)
    assert (rows["xy", 1].shapley, rows["yx", 1].shapley) == (5, 3)
    with pytest.raises(ValueError):
        audit.audit(facts, "abcdefg")
