"""Passages whose keys meet in turns, with the shuffles of a turn gone before the next."""

import random
import time

from labelwright.llm import common, passages


def _shuffles(spark) -> int:
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_shuffles_go_with_the_rows_written(spark):
    before = _shuffles(spark)
    df = spark.range(1000).repartition(3, "id")
    out = common.freed(df)
    until = time.time() + 20  # they are removed in the background
    while _shuffles(spark) > before and time.time() < until:
        time.sleep(0.2)
    assert _shuffles(spark) <= before
    assert out.count() == 1000 and df.count() == 1000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_turns_change_no_row(spark, monkeypatch):
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    common_part, other = words(70), words(80)
    texts = [words(40) + " " + common_part + " " + words(30) for _ in range(5)] + [other + " " + words(20) for _ in range(3)] + [words(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for n in (1, 3):
        monkeypatch.setattr(passages, "TURNS", n)
        found.append(sorted(map(str, passages.op5_passages(docs).collect())))
    assert found[0] == found[1] and len(found[0]) == 8
