import os
import random

import numpy as np
import pytest

from braidlake.llm import pieces
from braidlake.llm.pieces import MODEL, Codec, Lattice, Model, encoded

spm = pytest.importorskip("sentencepiece")
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")


def data():
    with open(MODEL, "rb") as f:
        return f.read()


def texts():
    rng = random.Random(4)
    out = ["", " ", "   ", "a", " a  b ", "Hello  world\n\tx é 你   ", "\n\n x\ny", "<0x0A> <s> </s>", "word,\nnext", "x" * 3000, " " * 100, "ab " * 500, "\U0001f600 ok"]
    for _ in range(150):
        out.append("".join(rng.choice("abcdehinorst  ,.\néß你\U0001f600") for _ in range(rng.randrange(1, 80))))
        out.append("".join(rng.choice(["the", "tion", "ing", " ", " ", "er", "ea", ",", "."]) for _ in range(rng.randrange(1, 60))))
    return out


@needs_model
@pytest.mark.parametrize(("memo", "block", "lane"), [(1 << 17, 1 << 20, 64), (50, 40, 5)])
def test_ids_are_the_librarys(memo, block, lane, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", block)
    monkeypatch.setattr(pieces, "LANE", lane)
    library, own = spm.SentencePieceProcessor(model_file=MODEL), Codec(Lattice(data()), memo)
    for t in texts():
        ids = own.encode(t)
        assert ids == library.encode(t), t
        assert own.decode(ids) == t, t
    together = {}
    for i, ids, _, _, _ in own.rows(texts()):
        together.setdefault(i, []).extend(ids.tolist())
    assert list(together.values()) == library.encode(texts())


@needs_model
def test_unigram_model():
    """The same pieces as a unigram model: the best sum of scores, by brute force over all splits, in lanes and in a window."""
    lattice = Lattice(data())
    model = lattice.model
    model.type = pieces.UNIGRAM
    rng = random.Random(1)
    for _ in range(60):
        t = "".join(rng.choice("theraniéx▁") for _ in range(rng.randrange(1, 25)))
        best = [0.0] + [-1e30] * len(t)
        for j in range(1, len(t) + 1):
            for i in range(max(0, j - model.longest), j):
                piece = t[i:j]
                score = model.scores[model.ids[piece]] if piece in model.ids else model.floor if j - i == 1 else None
                if score is not None:
                    best[j] = max(best[j], best[i] + score)
        window = [i for part in model.search(t) for i in part]
        lanes = pieces.Search(lattice).block([t])[0].tolist()
        for ids in (window, lanes):
            got = sum(model.scores[i] for i in ids if i not in model.bytes.values())
            got += model.floor * sum(c not in model.ids for c in t)
            assert abs(got - best[-1]) < 1e-6, t


@needs_model
def test_borders_of_pieces():
    lattice = Lattice(data())
    rng = random.Random(5)
    ids = [i for i in lattice.model.ids.values()]
    common = [i for p, i in lattice.model.ids.items() if len(p) < 4 and p.isascii()]
    a = np.array([rng.choice(common if k % 2 else ids) for k in range(4000)])
    b = np.array([rng.choice(common if k % 3 else ids) for k in range(4000)])
    p = lattice.model.pieces
    assert lattice.may_follow(a, b).tolist() == [lattice.model.merged(p[x] + p[y]) == [p[x], p[y]] for x, y in zip(a, b, strict=True)]


@needs_model
def test_other_models_are_refused():
    def piece(text, kind):
        raw = text.encode()
        body = b"\x0a" + bytes([len(raw)]) + raw + b"\x18" + bytes([kind])
        return b"\x0a" + bytes([len(body)]) + body

    spec = b"\x1a\x04\x20\x00\x28\x01"
    for kind in (pieces.USER, pieces.UNUSED):
        with pytest.raises(ValueError, match="user-defined"):
            Model(piece("<unk>", pieces.UNKNOWN) + piece("ab", kind) + spec)
    with pytest.raises(ValueError, match="byte pieces"):
        Model(piece("<unk>", pieces.UNKNOWN) + piece("ab", pieces.NORMAL) + spec)


@needs_model
def test_commits_before_the_end():
    model = Model(data())
    seen, most = [], 0

    def chars():
        for c in "▁the▁tion" * 200:
            seen.append(c)
            yield c

    got = []
    for part in model.search(chars()):
        got += part
        most = max(most, len(seen) - len("".join(model.pieces[i] for i in got)))
    assert "".join(model.pieces[i] for i in got) == "▁the▁tion" * 200 and most <= 3 * model.longest


@needs_model
def test_table(spark):
    rows = [(None, "a b", 1), (1, None, 2), (2, "", 3), (3, "same text", 4), (3, "same text", 5), (4, "lang ▁ sign", 6), (5, "word " * 30000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {(r.doc_id, r.n_bytes): r for r in encoded(df, keep=("ids", "decoded", "ids_sha256", "decoded_sha256")).collect()}
    assert len(got) == 6
    library = spm.SentencePieceProcessor(model_file=MODEL)
    for i, t, _ in rows:
        r = got[i, len((t or "").encode())]
        assert list(r.ids) == library.encode(t or "") and r.n_ids == len(r.ids) and r.lossless == ("▁" not in (t or ""))
        assert r.decoded == (t or "").replace("▁", " ")
    assert encoded(df.limit(0)).collect() == []
