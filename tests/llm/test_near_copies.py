"""The near-duplicate stage of the pipeline against brute force."""

import random

from fernlake.llm import near_copies
from tests.llm.conftest import passage


def changed(text, places):
    words = text.split()
    for p in places:
        words[p] = f"other{p}"
    return " ".join(words)


def brute_groups(rows):
    """doc_id -> least doc_id connected by pairs of a five-word Jaccard similarity of 0.8 or more."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    least = {i: i for i in sets}
    for _ in sets:
        before = dict(least)
        for a in sets:
            for b in sets:
                if least[a] != least[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
        if before == least:
            return least
    return least


def test_near_copies_leave_the_pipeline(spark):
    """One or two words of a hundred changed (0.90, 0.81) go, three (0.73) stay."""
    import corpus_pipeline

    rows = []
    for i in range(12):
        base = passage(300 + i, 100)
        rows += [(10 * i + j, changed(base, (20, 45, 70)[:j])) for j in (0, 1, 2)] + [(1000 + i, changed(base, (10, 30, 60, 80)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert kept == {10 * i for i in range(12)} | {1000 + i for i in range(12)}


def test_large_groups_are_compared_whole(spark):
    """Many documents share most of a passage: some are similar, some only to some, some to none."""
    rng = random.Random(8)
    base = passage(400, 70)
    rows = [(i, changed(base, rng.sample(range(70), rng.choice([0, 1, 1, 2, 3])))) for i in range(90)]
    rows += [(100 + i, base + " " + passage(500 + i, rng.choice([5, 12, 17, 25]))) for i in range(50)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "One two"), (205, "two one")]
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert found == brute_groups(rows)
