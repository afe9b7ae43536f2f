import pytest
from hypothesis import given, settings, strategies as st
from sentencepiece import SentencePieceProcessor

from fixtures import ODD, documents, prose
from lexmill.llm import pieces as P
from lexmill.llm.queries import PIECE_MODEL

LIBRARY = SentencePieceProcessor(model_file=PIECE_MODEL)
OWN = P.Encoder(PIECE_MODEL)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_ids_equal_the_librarys_and_decode(texts):
    for text, ids in zip(texts, OWN.encode(texts)):
        if "\x00" not in text:
            assert ids.tolist() == LIBRARY.encode(text)
        if P.MARK not in text:
            assert OWN.vocabulary.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aeintrs hélo▁", max_size=14), min_size=1, max_size=20))
def test_shared_prefixes_change_nothing(words):
    together = OWN.vocabulary.encode_words(sorted(set(words)))
    assert all(OWN.vocabulary.encode_words([w]) == {w: together[w]} for w in together)


def test_unigram_kind_takes_the_best_path():
    vocabulary = P.Vocabulary(PIECE_MODEL)
    vocabulary.merges = False
    vocabulary.score = {i: -((i * 7919) % 101) / 10 for i in vocabulary.score}

    def best(word):
        states = [(0.0, [])]
        for end in range(1, len(word) + 1):
            options = [
                (states[s][0] + vocabulary.score[vocabulary.number[word[s:end]]], states[s][1] + [vocabulary.number[word[s:end]]])
                for s in range(end)
                if word[s:end] in vocabulary.number
            ]
            states.append(max(options, key=lambda o: o[0]))
        return states[-1][0]

    for word in ("▁international", "▁thereand", "hello", "▁a"):
        ids = memoryview(vocabulary.encode_words([word])[word]).cast("i").tolist()
        assert "".join(vocabulary.texts[i] for i in ids) == word
        assert sum(vocabulary.score[i] for i in ids) == pytest.approx(best(word))


def test_tables(spark):
    texts = ODD + [" ".join(prose(k, 50)) for k in range(20)] * 2
    rows = P.encode(documents(spark, texts), PIECE_MODEL)
    got = {r["doc_id"]: r for r in rows.collect()}
    for i, text in enumerate(texts):
        assert got[i]["ids"] == LIBRARY.encode(text or "") and got[i]["n_ids"] == len(got[i]["ids"]) and got[i]["round_trip"]
    back = {r["doc_id"]: r["text"] for r in P.decode(rows, PIECE_MODEL).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert P.encode(documents(spark, []), PIECE_MODEL).count() == 0
