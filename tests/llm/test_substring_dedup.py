import hashlib
import random
import re

import numpy as np
import pytest

from braidlake.llm.substring_dedup import SuffixTree, remove_earlier_passages


def brute(rows, w):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", x or "")) for i, x in rows]
    least = {}
    for i, t in split:
        if i is not None:
            for p in range(len(t) - w + 1):
                s = tuple(t[p : p + w])
                least[s] = min(i, least.get(s, i))
    out = []
    for i, t in split:
        gone = [False] * len(t)
        for p in range(len(t) - w + 1):
            if i is not None and least[tuple(t[p : p + w])] < i:
                gone[p : p + w] = [True] * w
        kept = " ".join(x for x, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def rows_of(rng):
    def passage(n):
        return [rng.choice(["al", "be", "ça", "de", "el", "fu"]) + str(rng.randrange(9)) for _ in range(n)]

    base = [passage(80) for _ in range(3)]
    rows = []
    for i in range(30):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            t[rng.randrange(80)] = "x" + str(rng.randrange(50))
        rows.append((i * 7 % 31, rng.choice([" ", "\n", " \t"]).join(t)))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "a " * 60), (204, "a " * 60), (205, " ".join(base[0] + base[0]))]
    rows += [(205, " ".join(base[0] + base[0])), (3, " ".join(base[1])), (None, " ".join(base[2])), (206, " ".join(base[2][:14])), (207, " ".join(base[2][5:40] + base[0][:30]))]
    return rows


@pytest.mark.parametrize("limit", [2048, 3])
def test_against_brute_force(spark, limit):
    rows = rows_of(random.Random(limit))
    df = spark.createDataFrame([(i, x, 5) for i, x in rows], "doc_id long, text string, q int")
    got = sorted([tuple(r) for r in remove_earlier_passages(df, 12, k=3, group_limit=limit).collect()], key=str)
    assert got == brute(rows, 12)


def test_empty_table(spark):
    assert remove_earlier_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tree_nodes_and_maximal_repeats():
    """Nodes are the sets of suffixes that share a prefix which not all of them continue alike; by brute force."""
    for seed in range(40):
        rng = np.random.default_rng(seed)
        text = rng.integers(1, 4, 40).astype(np.uint64)
        size = np.minimum(rng.integers(4, 12, 40), 40 - np.arange(40))
        rows = np.append(text, np.zeros(12, np.uint64))[np.arange(40)[:, None] + np.arange(12)]
        tree = SuffixTree(rows, size, 2)
        prefix = {}
        for i in range(40):
            for d in range(2, size[i] + 1):
                prefix.setdefault(tuple(text[i : i + d]), set()).add(i)
        best = {}
        for p, own in prefix.items():
            if len(own) > 1:
                best[frozenset(own)] = max(len(p), best.get(frozenset(own), 0))
        got = {frozenset(int(k) for k in tree.order[x : y + 1]): d for d, x, y in tree.nodes}
        assert got == best
        before = np.append(np.uint64(0), text[:-1])
        left = {own for own in best if 0 in own or len({text[i - 1] for i in own}) > 1}
        assert {frozenset(int(k) for k in tree.order[x : y + 1]) for _, x, y in tree.maximal_repeats(before)} == left
        doc = rng.integers(0, 6, 40)
        least = tree.least_above(doc)
        assert all(least[i] == min(doc[j] for j in prefix.get(tuple(text[i : i + 2]), {i}) | {i}) if size[i] >= 2 else least[i] == doc[i] for i in range(40))


def test_very_long_text(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60000))
    part = long[200_000:204_000].strip()
    rows = [(1, long), (2, part), (3, None), (4, "x " * 30000), (5, "x " * 100)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in remove_earlier_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (60000, 0) and got[4][1] == 0 and got[5] == (100, 100)
    assert 0 < got[2][0] - got[2][1] <= 2 or got[2][0] == got[2][1]
