import random
import re

import numpy as np

from braidlake.llm import near_dedup, setsketch
from braidlake.llm.near_dedup import near_components


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["Al", "be", "ça", "De", "el", "fu"]) + str(rng.randrange(40))
    base = [[word() for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(90):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            t[rng.randrange(60)] = word()
        rows.append((i * 17 % 97, " ".join(t)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "ONE two"), (505, " ".join(base[0])), (505, " ".join(base[3])), (None, " ".join(base[0])), (506, "a " * 50), (507, "a a a a a a")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_shingles int")
    for k in (4, 5):
        got = sorted([tuple(r) for r in near_components(df, shingle=k).collect()], key=str)
        assert got == brute(rows, k, 80)


def test_empty_table(spark):
    assert near_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 1000).astype(np.uint64), rng.integers(0, 2**63, 1000).astype(np.uint64)
    for shared in (0, 400, 800, 1000):
        s, t = a, np.concatenate([a[:shared], b[shared:]])
        ra, rb = (setsketch.registers(x, np.array([0]), 1024) for x in (s, t))
        got = setsketch.likely_similarity(ra, rb, np.array([1000]), np.array([1000]))[0]
        assert abs(got - shared / (2000 - shared)) < 0.06
        union = setsketch.registers(np.union1d(s, t), np.array([0]), 1024)
        assert (setsketch.merge(ra, rb) == union).all()


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    """Two families that share buckets, compared in pairs of blocks of three rows, and a very long text."""
    whole = near_dedup.plausible
    monkeypatch.setattr(near_dedup, "plausible", lambda *a: whole(*a, block=3))
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(40):
        t = list(base)
        for k in range(rng.choice([1, 2, 4, 5])):
            t[(i * 13 + k * 31) % 100] = f"x{i % 5}.{k}"
        rows.append((i, " ".join(t)))
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(40000))
    rows += [(100, long), (101, long + " more"), (102, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in near_components(df, shingle=4).collect()], key=str)
    assert got == brute(rows, 4, 80)
