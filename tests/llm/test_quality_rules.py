import random
import re

from braidlake.llm.quality_rules import BASE, BIT, STRICT, ablations, apply_policy, ledger


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit)


def test_measurements_and_policies(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b c", "a a a a", "a b c a b c d", "ü# é\x0b*ñ x <b>\x85"]
    texts += [" ".join(rng.choice("abcd") for _ in range(n)) for n in (10, 60, 300)]
    texts += ["\n".join(rng.choice(["one line", " ", "two", "thrée $"]) for _ in range(40))]
    texts += [" ".join(f"w{rng.randrange(60)}" for _ in range(900)), " ".join(f"w{i}" for i in range(60)), "x y z " * 3000]
    rows = ledger(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, w int"))
    got = {r.doc_id: r for r in apply_policy(rows, BASE).collect()}
    for i, t in enumerate(texts[:-1]):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        assert r.kept == (r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words)
    assert got[len(texts) - 1].n_repeat_words == 9000
    full = apply_policy(rows, STRICT).collect()
    for rule, failed, only in ablations(rows, STRICT).collect():
        assert failed == sum(bool(r.failed & BIT[rule]) for r in full)
        assert only == sum(r.failed == BIT[rule] for r in full)
    assert {r.n_failed for r in ablations(rows.limit(0), BASE).collect()} == {0}
    odd = ledger(spark.createDataFrame([(None, "a b", 1), (7, "a b", 2), (7, "a b", 3)], "doc_id long, text string, failed int"))
    assert sorted((tuple(r) for r in odd.collect()), key=str) == sorted([(i, 2, 2, 0, 1, 0, 0, 1 | 16) for i in (None, 7, 7)], key=str)
    assert odd.limit(0).collect() == [] and ledger(odd.select("doc_id", odd.n_words.cast("string").alias("text")).limit(0)).collect() == []


def test_branches_of_the_repeat_count_agree(spark):
    """Windows that repeat by the thousand take the sorted path, few of them the looked-up one."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(k)}" for _ in range(400)) for k in (3, 5, 8, 20, 200)]
    got = {r.doc_id: r.n_repeat_words for r in ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i] == brute(t)[5] for i, t in enumerate(texts))
