import hashlib
import random
from collections import Counter

from braidlake.llm.suffix_dedup import remove_repeats


def brute(rows, t):
    texts = [(i, (x or "").encode()) for i, x in rows]
    seen = Counter(b[p : p + t] for i, b in texts if i is not None for p in range(len(b) - t + 1))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        if i is not None:
            for p in range(len(b) - t + 1):
                if seen[b[p : p + t]] > 1:
                    gone[p : p + t] = [True] * t
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, t, k):
    df = spark.createDataFrame([(i, x, "a", 1) for i, x in rows], "doc_id long, text string, h string, q int")
    return sorted([tuple(r)[:5] for r in remove_repeats(df, t, k=k).collect()], key=str)


def mutate(rng, s, n):
    s = list(s)
    for _ in range(n):
        s[rng.randrange(len(s))] = rng.choice("xyzü")
    return "".join(s)


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(600)) for _ in range(3)]
    rows = [(i, mutate(rng, rng.choice(base), rng.randrange(8))) for i in range(24)]
    rows += [(100, None), (101, ""), (102, "a" * 500), (103, "ab" * 150), (104, base[0]), (104, base[0]), (105, base[1] + base[1])]
    rows += [(104, base[2]), (None, base[0]), (106, "short"), (107, "-" + base[2][100:350] + "+" + base[0][50:260])]
    assert run(spark, rows, 70, 11) == brute(rows, 70)


def test_empty_table(spark):
    assert run(spark, [], 70, 11) == []
