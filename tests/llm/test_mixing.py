import numpy as np

import pytest

from braidlake.llm import mixing
from braidlake.llm.mixing import mixed, rake, sampled
from braidlake.llm.topics import NO_TOPIC, fit_topics, word_classes


def rows(n=400):
    rng = np.random.default_rng(8)
    out = []
    for i in range(n):
        words = [f"subject{rng.integers(6)}" for _ in range(rng.integers(1, 40))]
        out.append((i, " ".join(words), str(rng.choice(["big", "mid", "small"], p=[0.7, 0.25, 0.05])), str(rng.choice(["en", "fr"], p=[0.8, 0.2])), i))
    out += [(1000, None, "big", "en", 0), (1001, "", None, None, 0), (1002, "subject3 only", None, "en", 0), (None, "subject1 x", "big", None, 0), (5, out[5][1], out[5][2], out[5][3], 0)]
    return out


SCHEMA = "doc_id long, text string, source string, lang string, weight long"


def brute(cells, powers):
    """Raking of a dense table, margin after margin."""
    names = [sorted({c[k] for c in cells}) for k in range(3)]
    t = np.zeros([len(x) for x in names])
    for c, v in cells.items():
        t[tuple(names[k].index(c[k]) for k in range(3))] = v
    w = t.copy()
    for _ in range(500):
        for k in range(3):
            other = tuple(x for x in range(3) if x != k)
            want = t.sum(other) ** powers[k]
            want = want / want.sum() * t.sum()
            shape = [1, 1, 1]
            shape[k] = -1
            w = w * (want / w.sum(other)).reshape(shape)
    return {c: w[i] / t[i] for c in cells for i in [tuple(names[k].index(c[k]) for k in range(3))]}


def test_weights_margins_and_sample(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = mixed(docs, fraction=0.5).collect()
    assert len(got) == len(rows())
    cells = {}
    for r in got:
        if r.n_tokens:
            cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + r.n_tokens
    want = brute(cells, (0.7, 0.7, 0.5))
    for r in got:
        assert abs(r.weight - (want[r.source, r.lang, r.topic] if r.n_tokens else 0)) < 1e-4 * max(1, r.weight)
    total = sum(r.n_tokens for r in got)
    assert abs(sum(r.n_tokens * r.probability for r in got) / total - 0.5) < 0.01
    assert not any(r.kept for r in got if not r.n_tokens)
    assert {bool(r.kept) for r in got} == {True, False}
    five = [tuple(r) for r in got if r.doc_id == 5]
    assert len(five) == 2 and five[0] == five[1]
    assert all(r.converged and r.residual <= mixing.TOLERANCE for r in got)
    kept = sampled(docs, fraction=0.5)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in got if r.kept), key=str) and kept.columns == docs.columns


def test_given_targets(spark):
    docs = spark.createDataFrame([(*r, str(k % 3), k, 0.5) for k, r in enumerate(rows())], SCHEMA + ", about string, u_0 int, share_0 double")
    targets = {"source": {"big": 0.2, "mid": 0.5, "small": 0.3}, "lang": {"en": 0.5, "fr": 0.5}, "topic": {"0": 0.2, "1": 0.3, "2": 0.5}}
    got = mixed(docs, targets=targets, topic_col="about").collect()
    for margin, shares in targets.items():
        total = sum(r.weight * r.n_tokens for r in got)
        for k, want in shares.items():
            assert abs(sum(r.weight * r.n_tokens for r in got if r[margin] == k) / total - want) < 1e-5
    assert all(r.weight == 0 for r in got if r.source == "(none)")
    kept = sampled(docs, targets=targets, topic_col="about")
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in got if r.kept), key=str)
    for wrong in ({"source": {"big": 0.4}}, {"colour": {"red": 1.0}}, {"lang": {"de": 0.5, "en": 0.5}}, {"source": {"other": 1.0}}):
        with pytest.raises(ValueError, match=r"sum to 1|no margin|no tokens"):
            mixed(docs, targets=wrong, topic_col="about")


def test_contradiction_is_reported(spark):
    cells = spark.createDataFrame([("a", "x", "0", 10), ("b", "y", "0", 10)], "source string, lang string, topic string, tokens long")
    fit = rake(cells, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}})
    assert not fit.converged and max(fit.residual.values()) > 0.1
    assert rake(cells, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.9, "y": 0.1}}).converged


def test_topics_find_groups_of_words(spark):
    rng = np.random.default_rng(2)
    groups = [[f"{g}word{i}" for i in range(30)] for g in "abc"]
    docs = [(i, " ".join(["the", "of", *rng.choice(groups[i % 3], 12)])) for i in range(300)]
    model = fit_topics(spark.createDataFrame(docs, "doc_id long, text string"), n=3, common=0.5)
    from braidlake.llm.flat import text_blocks
    import pyarrow as pa

    ((_, _, flat, offsets),) = text_blocks(pa.array([t for _, t in docs]))
    _, row, found = word_classes(flat, offsets)
    topic = model.of(row, found, 300)
    assert all(len(set(topic[g::3])) == 1 for g in range(3)) and len(set(topic)) == 3
    empty = fit_topics(spark.createDataFrame([(1, None)], "doc_id long, text string"))
    assert empty.of(row, found, 300).tolist() == [NO_TOPIC] * 300


def test_empty(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert mixed(docs.limit(0)).collect() == [] and sampled(docs.limit(0)).collect() == []
    assert not any(r.kept for r in mixed(docs.filter("text = ''")).collect())
