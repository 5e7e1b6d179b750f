"""The URL models, the threshold and every verdict, recomputed by their definition."""

import math
import random
from collections import Counter, defaultdict

import pytest

from immunoscan.llm import url_filter as U

rng = random.Random(31)
NAMES = ["shop", "news", "spam", "zz", "blog", "free"]


def _url(kind):
    host = rng.choice(NAMES[: 3 if kind else 6]) + rng.choice(["", "1", "x"]) + (".com" if kind else rng.choice([".net", ".net", ".org"]))
    return f"http://{host}/{rng.choice(['en', 'es', 'fr', 'a'])}/{rng.randrange(60)}" + rng.choice(["", "?q=1", "#top", ".html"])


URLS = [_url(k % 2) for k in range(400)] + [None, "", "no scheme", "http://", "https://A.Com/UP?x", "http://x.org/" + "long/" * 4000, "http://example.com/en/1", "http://www.example.com/en/1"]
URLS += URLS[:30]


def _rule(host, path):
    best = None
    for what, text in U.RULES:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[1])):
            best = (what, text)
    return best or (None, None)


def _split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest[: min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])]
    path = rest[len(host) :]
    path = path[: min([path.index(c) for c in "?#" if c in path] + [len(path)])]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def _grams(t):
    padded = "\u0002" + t
    return [padded[i - k : i + 1] for i in range(1, len(t) + 1) for k in range(min(i, U.ORDER) + 1)]


def test_models_threshold_and_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, t string").repartition(3)
    got = {r["page_id"]: r for r in U.judge(pages).collect()}
    assert len(got) == len(URLS)
    parts = [_split(u) for u in URLS]
    urls = Counter((h + p, _rule(h, p)[0]) for h, p in parts)
    held = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t, _ in urls], "t string").select("t", U._held().alias("h")).collect()}
    count = defaultdict(lambda: [0, 0])
    for (t, ruled), n in urls.items():
        if ruled and not held[t]:
            for g in _grams(t):
                count[g][ruled == "block"] += n
    total = defaultdict(lambda: [0, 0])
    for g, c in count.items():
        for x in (0, 1):
            total[g[:-1]][x] += c[x]
    known = {}
    for g in sorted(count, key=len):
        low = known[g[1:]] if len(g) > 1 else (1 / 256, 1 / 256, 0.0, 0.0)
        pa, pr = ((count[g][x] + U.WEIGHT * low[x]) / (total[g[:-1]][x] + U.WEIGHT) for x in (0, 1))
        known[g] = (pa, pr, math.log(pa / pr), math.log(pa / pr) - low[2])
    score = {t: sum(known[g][3] for g in _grams(t) if g in known) / len(t) if t else 0.0 for t, _ in urls}
    steps = defaultdict(lambda: [0, 0])
    for (t, ruled), n in urls.items():
        if ruled and held[t]:
            steps[math.floor(round(score[t], 6) * 1000)][ruled == "block"] += n
    all_a, all_r = sum(s[0] for s in steps.values()), sum(s[1] for s in steps.values())
    best, below_a, below_r, before = None, 0, 0, None
    for step in sorted(steps):
        wrong = below_a / all_a + 1 - below_r / all_r
        if best is None or wrong < best[0] - 1e-12:
            best = (wrong, ((before + 1 if before is not None else step) + step) / 2000)
        below_a, below_r, before = below_a + steps[step][0], below_r + steps[step][1], step
    for i, (h, p) in enumerate(parts):
        ruled, rule = _rule(h, p)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (h, p, rule)
        assert r["cut"] == pytest.approx(best[1], abs=1e-9)
        if ruled is None:
            assert r["score"] == pytest.approx(score[h + p], abs=2e-6)
        assert r["verdict"] == (ruled or ("allow" if r["score"] >= best[1] else "block"))
