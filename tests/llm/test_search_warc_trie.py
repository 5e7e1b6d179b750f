"""Operators 11 to 13 against brute force: nulls, empties, ties, repeated rows, clashing columns, very long texts, many ranges."""

import hashlib
import math
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from immunoscan.llm import lexical_search, prefix_trie, warc
from immunoscan.llm.queries import ORACLES, QUERIES
from immunoscan.llm.shared import shared_dir

SF = "/root/testdata/sf0.001"
rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 5))) for _ in range(60)]


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_warc", "op13_prefix_trie"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


# --- 11

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k=10):
    bags = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            m = 100 - 75 + 75 * sum(b.values()) * n // total
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m)) for t, c in Counter(words(text)).items() if t in b)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


DOCS = [(i, " ".join(rng.choices(WORDS, weights=range(1, 61), k=rng.randint(1, 60)))) for i in range(300)]
DOCS += [(1000 + i, DOCS[5][1]) for i in range(40)] + [(7, DOCS[7][1])] * 2  # ties at the edge of the ten, repeated rows
DOCS += [(2000, None), (2001, ""), (2002, " ,;- "), (None, DOCS[9][1]), (2003, " ".join(rng.choices(WORDS, k=60000))), (2004, DOCS[3][1].upper() + " ÉÉ")]
ITEMS = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 12)))) for i in range(25)] + [(90, DOCS[5][1]), (90, DOCS[5][1]), (91, None), (92, "?"), (93, "nowhere"), (94, "a a a a b")]


@pytest.mark.parametrize("chunk,block", [(32 << 20, 2000), (500, 7)])
def test_search(spark, chunk, block):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in DOCS], "doc_id long, text string, score string").repartition(3)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, rank int")
    got = lexical_search.search(docs, items, chunk=chunk, block=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(DOCS, ITEMS)
    assert lexical_search.search(docs.where("doc_id = -1"), items).isEmpty()
    assert lexical_search.search(docs, items.where("item_id = -1")).isEmpty()


def test_search_stops_before_the_ends_of_lists():
    known = {w.encode(): i for i, w in enumerate(sorted(set(WORDS)))}
    found = [lexical_search.terms_of(" ".join(rng.choices(WORDS, weights=range(1, 61), k=rng.randint(20, 60)))) for _ in range(3000)]
    found[17] = [WORDS[2].encode()] * 20 + [WORDS[3].encode()] * 20
    part = lexical_search.Chunk(found, known, 3000, sum(map(len, found)))
    import numpy as np

    terms = np.array([known[WORDS[2].encode()], known[WORDS[3].encode()]])
    docs, scores = lexical_search.best_positions(part, terms, np.array([100, 100]), 1, 0)
    assert docs[scores.argmax()] == 17 and docs.size < np.unique(np.concatenate([part.doc[part.starts[t] : part.starts[t + 1]] for t in terms])).size


# --- 12

def test_warc(spark):
    long = "é" * 700_000
    rows = [(i, f"http://a.example/{i}", "x" * 1000 + str(i % 7)) for i in range(200)]
    rows += [(500 + i, f"http://b.example/{i}", "short") for i in range(5)]  # under the bound: all responses
    rows += [(600, None, None), (601, "", ""), (602, "http://c/\r\nWARC-Type: x", long), (603, "http://d/", long), (None, "http://e/", long), (604, "u", "y" * 1500), (604, "v", "y" * 1500), (None, "w", "z" * 2000)]
    pages = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, digest int").repartition(6)
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = warc.write(pages, folder, roll=3000)
    assert index.count() == len(rows) and index.select("archive").distinct().count() > 6
    holder = defaultdict(lambda: -1)
    for i, _, h in rows:
        holder[h] = max(holder[h], -1 if i is None else i)

    def want(i, u, h):
        data = (h or "").encode()
        again = len(data) >= 1000 and holder[h] >= 0 and holder[h] != i
        return (i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", holder[h] if again else None, None if u is None else u.replace("\r", "%0D").replace("\n", "%0A"), b"" if again else data)

    got = warc.read(index, folder, payload=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")
    assert sorted((tuple(r)[:-1] + (bytes(r[-1]),) for r in got.collect()), key=str) == sorted((want(*r) for r in rows), key=str)
    some = warc.read(index.where("page_id in (3, 602)"), folder, payload=True).collect()
    assert {r["page_id"]: bytes(r["payload"]) for r in some} == {3: b"", 602: b""}  # both are revisits
    assert warc.read(warc.write(pages.where("page_id = -1"), folder + "x"), folder + "x").isEmpty()


def test_ranges_lie_together():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 200, 5), ("b", 205, 5), ("b", 230, 90)]
    assert [len(g) for g in warc.ranges(rows, gap=50, most=100)] == [2, 1, 1, 1] and [len(g) for g in warc.ranges(rows, gap=500, most=1000)] == [3, 2]


# --- 13

def nodes_of(rows):
    """By definition."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, below = [], {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(below[k][1] for k in kids[p])
        below[p] = (sum(below[k][0] for k in kids[p]) or 1, saved)
        ends = ",".join(str(c) for c in members[p] if convs[c] == p)
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed):
    r = random.Random(seed)
    rows, letters = [], ["", "aé", "b", "ccc"]
    for c in range(0, 420, 1 + seed):
        for turn in range(r.choice([0, 1, 2, 3, 6, 9])):
            rows.append((c, turn, r.choice(["user", "bot"]), r.choice(letters)))
    for c in range(1000, 1100):  # one conversation many times, and prefixes of it
        rows += [(c, t, "user", f"same {t}") for t in range(7 if c % 9 else 6)]
    rows += [(5000, t, "user", f"same {t}") for t in range(300)] + [(5001, t, "user", f"same {t}") for t in range(299)]
    rows += [(7000, None, "x", "late"), (7000, 0, "x", "z"), (7000, 0, None, "y"), (7001, 1, "x", None), (None, 1, "x", "lost"), (7002, 1, "u", "l" * 100_000), (7003, 2, "u", "v"), (7003, 2, "u", "v")]
    return rows


@pytest.mark.parametrize("seed,parts", [(0, 1), (1, 3), (2, 17), (3, 64)])
def test_trie(spark, seed, parts):
    rows = talk(seed)
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = prefix_trie.trie(prefix_trie.rebuilt(table)).select(*[c.split()[0] for c in prefix_trie.NODE.split(", ")]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((tuple(r) for r in got), key=str) == nodes_of(rows)


def test_trie_of_nothing(spark):
    table = spark.createDataFrame([(None, 1, "x", "y")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(prefix_trie.rebuilt(table)).isEmpty() and prefix_trie.trie(prefix_trie.rebuilt(table.where(F.lit(False)))).isEmpty()
