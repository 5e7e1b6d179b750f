"""Registered paths of operators 9 and 10 against plain Python: digests, spans, added spans, very long texts, repeated rows."""

import hashlib
import random
import re

from immunoscan.llm import bpe, secrets

rng = random.Random(12)
BASE = [
    ("assign", re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]
WIDE = [(kind, re.compile(rx.replace("(?i:", "(?i:")), group, least) for kind, rx, group, least in secrets.WIDE]


def spans(text, kinds, first=0):
    return [(m.start(), first + k, m.end(), kind, m[group]) for k, (kind, rx, group, least) in enumerate(kinds) for m in rx.finditer(text) if len(m[group]) >= least]


def token(n):
    return "".join(rng.choice("abcdefXYZ0123456789") for _ in range(n - 2)) + "a1"


SHARED = "Example1Token2Value3"
TEXTS = ["", None, "é😀 password = hunter2hunter2 and " + token(40), f"authorization: Bearer {token(24)}", "pwd=short", f"postgres://bob:{token(12)}@db.example/x", f"AKIA{token(16).upper()} AKIA1234", "0f" * 16 + " " + "0f" * 15]
TEXTS += [f"doc {i} uses {SHARED} here" for i in range(9)] + [f"auth={token(20)} {i}" for i in range(4)]
TEXTS += [" ".join(f"é token={token(10)} {'ab' * 20}{i}" for i in range(4000)), "😀" * 5000 + " secret: " + token(12), "AKIA" * 3000]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2]), (2, TEXTS[2]), (None, TEXTS[3])]


def test_spans_equal_plain_scans(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "s" if i is None or i % 2 else None, 0) for i, t in ROWS], "doc_id long, text string, source string, live int").repartition(4)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = secrets.op10_secret_scan(spark, str(tmp_path)).collect()
    owners = {}
    for _, t in ROWS:
        for *_, value in spans(t or "", BASE) + spans(t or "", WIDE, 3):
            owners.setdefault(value, set()).add(t)
    assert len(got) == len(ROWS)
    texts = {i: t or "" for i, t in ROWS}
    shown = 0
    for r in got:
        base = sorted(spans(texts[r["doc_id"]], BASE))
        more = [s for s in spans(texts[r["doc_id"]], WIDE, 3) if re.search("[0-9]", s[4]) and re.search("[A-Za-z]", s[4]) and len(owners[s[4]]) <= secrets.OWNERS and not any(s[0] < b[2] and b[0] < s[2] for b in base)]
        line = lambda x: ",".join(f"{kind}:{a}:{b}" for a, _, b, kind, _ in sorted(x))
        assert r["base_sha256"] == hashlib.sha256(line(base).encode()).hexdigest() and r["spans"] == line(base + more)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in base) for k in range(3)]
        shown += len(more)
    kinds = {x.split(":")[0] for r in got for x in r["spans"].split(",") if x}
    assert shown > 6 and {"owned", "keyed", "login"} <= kinds and not any(SHARED in str(r["spans"]) for r in got)
    assert all(not r["spans"] for r in got if r["doc_id"] in range(8, 17))  # what nine texts have is an example


def test_digests_equal_tiktoken(spark):
    import public_tokenizers
    import tiktoken

    ranks = bpe.ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    reference = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, " ", "Hello, wörld! 😀😀", "a" * 5000, "x\r\n\r\n  y\t\tz", "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(3000)), "the quick brown fox " * 2000, "zzxqj" * 300]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[3], 1), (None, texts[3], 1)], "doc_id long, text string, n_tokens int").repartition(3)
    want = sorted(((i, t or "") for i, t in [*enumerate(texts), (0, texts[3]), (None, texts[3])]), key=str)
    got = sorted(bpe.digests(df, ranks, public_tokenizers.PATTERN).collect(), key=lambda r: str((r["doc_id"], r["decoded_sha256"])))
    hashed = []
    for i, t in want:
        ids = reference.encode_ordinary(t)
        hashed.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(hashed, key=lambda r: str((r[0], r[3])))


def test_the_sample_does_not_depend_on_partitions(spark):
    from immunoscan.llm import language_id

    rows = [(i, " ".join(token(5) for _ in range(40)), "en" if i % 3 else "de") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.sample(df.repartition(1), 50) == language_id.sample(df.repartition(7), 50) and len(language_id.sample(df, 50)) == 50
