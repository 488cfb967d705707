import os
import random

import numpy as np
import pytest
from test_line_dedup import brute as brute_lines
from test_near_dedup import brute as brute_near

from braidlake.llm import queries
from braidlake.llm.mixing import mixed
from braidlake.llm.pieces import MODEL
from braidlake.llm.quality_classifier import fit_quality, scored

corpus_pipeline = pytest.importorskip("corpus_pipeline")
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
CLASH = ["id_0", "key_0", "flags_0", "kept_0", "gone_0", "u_0", "share_0", "source_0", "a_0"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASH)


def corpus():
    rng = random.Random(12)
    vocab = [a + b for a in ("b", "tr", "gl", "k", "st") for b in ("an", "orin", "el", "uma", "iter", "ob")]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [line(12) for _ in range(4)]
    rows, labels = [], []
    for i in range(160):
        bad = rng.random() < 0.2
        text = "\n".join(rng.choice(shared) if rng.random() < 0.15 else line(rng.randrange(5, 30)) for _ in range(rng.randrange(1, 6)))
        if i % 9 == 0 and i:
            base = rows[i - 1][1].split(" ")
            base[rng.randrange(len(base))] = rng.choice(vocab)
            text, bad = " ".join(base), labels[i - 1][1] == 0
        elif bad:
            text = " ".join(x.upper() + "#$" for x in text.split(" "))
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["web", "web", "book"]), len(text)))
        labels.append((i, int(not bad), 0))
    rows += [(500, None, "en", "web", 0), (501, "", "en", "web", 0), (502, " \n\t", None, None, 0), (503, rows[4][1], "en", "web", 1), (503, rows[4][1], "en", "web", 1), (None, rows[5][1], "fr", "book", 1), (504, "gan el " * 9000, "en", "web", 1)]
    return [(*r, *range(len(CLASH))) for r in rows], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


@needs_model
def test_each_stage_against_its_plain_version(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "ids" or docs.columns == columns
    after = {name: spark.read.parquet(str(tmp_path / name)) for name, _ in corpus_pipeline.STAGES}

    judged = scored(seen["quality"], fit_quality(seen["quality"], spark.read.parquet(f"{folder}/labels.parquet"), queries.GRADE, queries.GRADES)).collect()
    assert sorted((r.doc_id for r in judged if r.kept), key=str) == sorted((r.doc_id for r in after["quality"].collect()), key=str)
    labels = dict(corpus()[1][k][:2] for k in range(160))
    wrong = [r for r in judged if r.doc_id in labels and r.kept != bool(labels[r.doc_id])]
    assert len(wrong) <= 5

    before = [(r.doc_id, r.text) for r in seen["lines"].collect()]
    word = lambda t: t is not None and bool(t.split())
    want = {}
    for i, n, _, kept in brute_lines(before, 80):
        want.setdefault(i, []).append(kept)
    had = {}
    for i, t in before:
        had.setdefault(i, []).append(t)
    expect = sorted(((i, k) for i in want for k in want[i] if word(k) or not any(word(t) for t in had[i])), key=str)
    assert sorted(((r.doc_id, r.text) for r in after["lines"].collect()), key=str) == expect

    before = [(r.doc_id, r.text) for r in seen["near_copies"].collect()]
    keeps = {i for i, _, _, kept in brute_near(before, 5, 80) if kept}
    assert sorted(((r.doc_id, r.text) for r in after["near_copies"].collect()), key=str) == sorted(((i, t) for i, t in before if i in keeps), key=str)

    mix = mixed(seen["mix"]).collect()
    assert sorted((r.doc_id for r in mix if r.kept), key=str) == sorted((r.doc_id for r in after["mix"].collect()), key=str) and {r.kept for r in mix} == {True, False}

    spm = pytest.importorskip("sentencepiece")
    library = spm.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in seen["ids"].collect()}
    rows = after["ids"].collect()
    assert len(rows) == seen["ids"].count() and all(list(r.ids) == library.encode(texts[r.doc_id]) and r.lossless for r in rows)
    assert key(corpus_pipeline.run(spark, folder).select("doc_id", "n_ids", "ids_sha256").collect()) == key(after["ids"].select("doc_id", "n_ids", "ids_sha256").collect())


@needs_model
def test_empty_table(spark, folder, tmp_path):
    at = str(tmp_path)
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    assert corpus_pipeline.run(spark, at).collect() == []


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "mix", "ids"]
    assert np.all([callable(f) for _, f in corpus_pipeline.STAGES])
