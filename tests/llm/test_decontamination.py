"""Decontamination of many edited items against brute force."""

import random
from collections import Counter

import pytest

from immunoscan.llm import decontamination

rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]


def prose(n):
    return [rng.choice(WORDS) for _ in range(n)]


def similarity(a, b):
    a, b = (Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4)) for x in (a, b))
    both = (a & b).total()
    return both / (a.total() + b.total() - both)


def test_edited_items_are_found_whatever_their_fingerprints(spark):
    items = [prose(rng.randint(50, 130)) for _ in range(60)]
    docs = []
    for k, item in enumerate(items):
        for _ in range(10):
            copy = list(item)
            for at in rng.sample(range(len(copy)), rng.randint(1, 2)):
                copy[at] = "edited"
            docs.append((k, prose(rng.randint(0, 20)) + copy + prose(rng.randint(0, 20))))
    want = {}
    for d, (k, text) in enumerate(docs):
        n = len(items[k])
        best = max(similarity(text[i : i + n], items[k]) for i in range(len(text) - n + 1))
        if best >= 0.8:
            want[d, k] = best
    df = spark.createDataFrame([(d, " ".join(t)) for d, (_, t) in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contaminated(df, bench).collect()}
    assert len(want) > 200 and got == pytest.approx(want)


def check(spark, items, docs):
    want = {}
    for d, text in docs:
        for k, item in enumerate(items):
            n = min(len(item), len(text))
            best = max(((similarity(text[i : i + n], item), -i) for i in range(len(text) - n + 1)), default=(0, 0))
            if best[0] >= 0.8:
                want[d, k] = max(best, want.get((d, k), best))
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], -r["start_word"]) for r in decontamination.contaminated(df, bench).collect()}
    assert got.keys() == want.keys()
    assert {k: v[0] for k, v in got.items()} == pytest.approx({k: v[0] for k, v in want.items()})
    return want


def test_windows_of_any_order_and_rows_of_one_id(spark):
    items = [prose(90) for _ in range(20)]
    items += [prose(40) + items[0][:50], ["the", "same"] * 30, prose(12) * 4]  # shared and repeated shingles
    docs = [(k, prose(75) + item[45:] + item[:45] + prose(75)) for k, item in enumerate(items[:20])]
    docs += [(100, list(items[1])), (100, list(items[2])), (100, list(items[3]))]
    docs += [(101, items[4][:80]), (102, items[5][:60]), (103, prose(30) + ["the", "same"] * 28 + ["end"] + prose(9)), (104, prose(5) + items[22][:-3] + prose(50) + items[22]), (105, items[6] + items[6][10:] + prose(4))]
    docs += [(106, prose(3000) + items[7][:44] + ["x"] + items[7][44:] + prose(3000))]
    want = check(spark, items, docs)
    assert {(k, k) for k in range(20)} <= want.keys() and {(100, 1), (100, 2), (100, 3), (101, 4)} <= want.keys()


def test_candidates_come_from_the_fingerprints(spark, monkeypatch):
    items = [prose(60) for _ in range(5)]
    df = spark.createDataFrame([(k, " ".join(prose(9) + item + prose(9))) for k, item in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    assert decontamination.contaminated(df, bench).count() == 5
    near = decontamination._near_values
    monkeypatch.setattr(decontamination, "_near_values", lambda *a: near(*a).where("false"))
    assert decontamination.contaminated(df, bench).isEmpty()


def test_every_fingerprint_within_the_radius_meets(spark):
    base = rng.getrandbits(63)
    rows = []
    for d in range(0, 24):
        fp = base
        for bit in rng.sample(range(64), d):
            fp ^= 1 << bit
        rows.append((d, fp - (1 << 64) if fp >> 63 else fp))
    near = spark.createDataFrame(rows, "d int, fp long").select("d", decontamination._in_blocks("fp", 6).alias("b")).select("d", "b.block", "b.value")
    item = decontamination._near_values(spark.createDataFrame([(base,)], "fp long"), "fp", 6, 3)
    assert {r["d"] for r in near.join(item, ["block", "value"]).select("d").distinct().collect()} == set(range(24))
