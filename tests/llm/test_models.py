import numpy as np

from braidlake.llm.quality_classifier import CumulativeLink, fit, fit_quality, scored, selected
from braidlake.llm.toxicity import fit_chain, fit_toxicity, toxicity


def corpus(spark, n=600):
    rng = np.random.default_rng(5)
    vocab = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("an", "er", "oti", "uren")]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(vocab, rng.integers(5, 80)))
        bad, tox = rng.random() < 0.2, rng.random() < 0.15
        if tox:
            for _ in range(2):
                w[rng.integers(len(w))] = str(rng.choice(["nasty", "vile"]))
        text = " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w)
        rows.append((i, text, "x"))
        labels.append((i, int(not bad), int(tox)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


GRADE = "CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END"
CATEGORIES = {"loud": "int(toxic = 1 AND quality = 0)", "toxic": "toxic"}
ODD = [(1000, None, "x"), (1001, "", "x"), (1002, " \n", "x"), (None, "ber ban", "x"), (7, "ber ban", "x"), (1003, "gan " * 40000, "x")]


def test_ordinal_fit_recovers_thresholds():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3)).astype(np.float32)
    s = x @ np.array([3.0, -2.0, 0.0])
    u = rng.random(4000)
    y = (u[:, None] > 1 / (1 + np.exp(-(np.array([-0.5, 1.5])[None] - s[:, None])))).sum(1)
    m = fit(x, y, 3, penalty=0.0)
    assert m.thresholds[0] < m.thresholds[1]
    p = m.probabilities(x @ m.weights)
    assert np.allclose(p.sum(1), 1) and abs(p[:, 2].mean() - (y == 2).mean()) < 0.02


def test_probabilities_by_hand():
    p = CumulativeLink(np.zeros(1), np.array([0.0, 1.0])).probabilities(np.array([0.0]))[0]
    assert np.allclose(p, [0.5, 1 / (1 + np.exp(-1)) - 0.5, 1 - 1 / (1 + np.exp(-1))])


def test_quality_held_out(spark):
    docs, labels = corpus(spark)
    model = fit_quality(docs, labels.filter("doc_id % 3 <> 0"), GRADE, 3, bound=300)
    got = {r.doc_id: r for r in scored(docs, model).collect()}
    test = labels.filter("doc_id % 3 = 0").collect()
    assert sum(got[r.doc_id].kept == bool(r.quality) for r in test) >= 0.97 * len(test)
    odd = spark.createDataFrame(ODD, docs.schema)
    rows = scored(odd, model).collect()
    assert len(rows) == len(ODD) and sum(r.score == 0 for r in rows) >= 3 and all(0 <= r.p_tail <= 1 and 0 <= r.expected_grade <= 2 for r in rows)
    same = [tuple(r)[1:] for r in rows if r.doc_id in (None, 7)]
    assert same[0] == same[1]
    keeps = {r.doc_id for r in rows if r.kept}
    assert {r.doc_id for r in selected(odd, model).collect()} == keeps and selected(odd, model).columns == odd.columns
    assert scored(docs.limit(0), model).collect() == []
    assert fit_quality(docs, labels.limit(0), GRADE, 3) is None
    assert {r.kept for r in scored(odd, None).collect()} == {True} and selected(odd, None).count() == len(ODD)


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(2)
    x = (rng.random((800, 4)) < 0.4).astype(np.float32)
    first = x[:, 0]
    second = (first > 0) & (x[:, 1] > 0)
    chain = fit_chain(x, np.stack([first, second], 1), np.arange(800) % 5, [np.arange(4)] * 6, ("a", "b"), np.arange(4, dtype=np.uint64))
    assert [len(w) for w in chain.weights] == [5, 6] and chain.weights[1][4] > 0
    p = chain.probabilities(x)
    assert ((p > 0.5) == np.stack([first, second], 1)).mean() > 0.99


def test_unseen_rows_are_judged_by_words_chosen_without_them():
    """A word that is in one fold only would tell everything about it; the models of that fold don't see the word."""
    rng = np.random.default_rng(3)
    fold, y = np.arange(500) % 5, rng.integers(0, 2, 500)
    x = np.stack([(fold == 0) * y, rng.integers(0, 2, 500)], 1).astype(np.float32)
    chain = fit_chain(x, np.stack([y, y], 1), fold, [np.array([1]), *[np.array([0, 1])] * 5], ("a", "b"), np.arange(2, dtype=np.uint64))
    assert len(chain.weights[1]) == 4


def test_toxicity_held_out(spark):
    docs, labels = corpus(spark)
    chain = fit_toxicity(docs, labels.filter("doc_id % 3 <> 0"), CATEGORIES, bound=350, vocabulary=64)
    got = {r.doc_id: r for r in toxicity(docs, chain, tuple(CATEGORIES)).collect()}
    test = labels.filter("doc_id % 3 = 0").collect()
    assert sum(got[r.doc_id].toxic == bool(r.toxic) for r in test) >= 0.97 * len(test)
    odd = toxicity(spark.createDataFrame(ODD, docs.schema), chain, tuple(CATEGORIES)).collect()
    assert len(odd) == len(ODD) and not any(r.toxic for r in odd)
    assert toxicity(docs.limit(0), chain, tuple(CATEGORIES)).collect() == []
    assert fit_toxicity(docs, labels.limit(0), CATEGORIES) is None
    assert {r.toxic for r in toxicity(docs, None, tuple(CATEGORIES)).collect()} == {False}
