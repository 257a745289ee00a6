from __future__ import annotations

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import pieces, queries

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")
ANY = st.text(alphabet=st.one_of(st.characters(codec="utf-8", exclude_characters=[pieces.MARK]), st.sampled_from(" \nabe tho")), max_size=40)


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.read_model())


def best(model, text):
    """Score of the best split, by trying every piece at every place."""
    usable = {p: s for p, s, kind in model.pieces if kind in (pieces.NORMAL, pieces.USER) and p}
    score = [0.0] + [-1e300] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 32), end):
            if (s := usable.get(text[start:end])) is not None:
                score[end] = max(score[end], score[start] + s)
        if text[end - 1] not in usable:
            score[end] = max(score[end], score[end - 1] + model.low)
    return score[-1]


def total(model, ids):
    """Score of ids; the bytes of one character count as one unknown."""
    out, k = 0.0, 0
    while k < len(ids):
        p, s, kind = model.pieces[ids[k]]
        if kind == pieces.BYTE:
            b = int(p[3:5], 16)
            k += 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            out += model.low
        else:
            out, k = out + s, k + 1
    return out


@settings(max_examples=150, deadline=None)
@given(ANY)
def test_best_split_and_round_trip(model, text):
    ids = model.encode(text)
    assert model.decode(ids) == text
    assert total(model, ids) == pytest.approx(best(model, model.normalise(text)))


def test_stretches_lose_nothing(model):
    text = model.normalise("the  quick\n\nbrown\tfox  é 漢字 😀 jumps " + "x" * 300)
    assert total(model, model.viterbi(text)) == pytest.approx(total(model, model.encode("the  quick\n\nbrown\tfox  é 漢字 😀 jumps " + "x" * 300)))


def test_trie_holds_all_pieces(model):
    t = model.trie
    for k, (p, _, kind) in enumerate(model.pieces):
        if kind == pieces.NORMAL:
            s = 0
            for b in p.encode():
                assert t.check[t.base[s] + b + 1] == s
                s = t.base[s] + b + 1
            assert t.value[s] == k


def test_library_decodes_the_same(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.read_model())
    for text in ("Hello world", " a  b", "漢字 😀", "x\ny"):
        assert sp.decode(model.encode(text)) == text


def test_library_encodes_the_same(model, corpus):
    """The library's own unigram split of the same file; of equally good splits either may be taken."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.read_model())
    texts = [t for _, t in corpus if t] + ["Hello world, the quick brown fox isn't late.", " a  b", "漢字 😀 naïve", "x\ny\tz", "aaaaaaaaaaaaaaaaaaaaaaaa", "internationalisation, 2024-01-02: 3.14159"]
    same = 0
    for text in texts:
        ids, told = model.encode(text), sp.encode(text)
        same += ids == told
        assert total(model, ids) == pytest.approx(total(model, told), rel=1e-5)
        assert sp.decode(ids) == text
    assert same >= 0.95 * len(texts)


def test_scores_are_log_probabilities(model):
    import math

    normal = [s for _, s, kind in model.pieces if kind == pieces.NORMAL]
    assert sum(map(math.exp, normal)) == pytest.approx(1, abs=1e-4) and max(normal) < 0


def test_other_types_are_refused():
    with open(pieces.MODEL, "rb") as f:
        raw = f.read()
    assert pieces.model_type(raw) == pieces.BPE and pieces.model_type(pieces.unigram(raw)) == pieces.UNIGRAM
    assert pieces.unigram(pieces.unigram(raw)) == pieces.unigram(raw)
    with pytest.raises(ValueError):
        pieces.Pieces(raw)
    with pytest.raises(ValueError):
        pieces.unigram(b"\x12\x02\x18\x03")


def test_documents(documents, corpus, empty):
    got = pieces.encode_documents(documents).collect()
    assert len(got) == len(corpus) and all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in got)
    assert {r["n_pieces"] for r in got if r["doc_id"] in (100, 101)} == {0}
    assert "ids" not in pieces.encode_documents(documents, keep_ids=False).columns
    assert pieces.encode_documents(empty).collect() == []


def test_the_query_returns_the_pieces(spark, documents, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    model, got = pieces.load(pieces.read_model()), queries.op3_pieces(spark, str(tmp_path)).collect()
    assert sorted(model.decode(r["ids"]) for r in got) == sorted(r["text"] or "" for r in documents.collect())
