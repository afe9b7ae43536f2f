import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from fixtures import ALNUM, LOWER, WORD, words
from lexmill.llm import kernel as K

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \t\né€-", max_size=20)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_words_and_lines_are_those_of_plain_python(texts, limit):
    met = {}
    rows = 0
    for first, data, offsets in K.chunks(pa.array(texts, pa.string()), limit):
        own = texts[first : first + len(offsets) - 1]
        rows += len(own)
        for gap, pattern in ((K.BLANK, WORD), (K.NOT_ALNUM, ALNUM)):
            spans = K.words(data, offsets, gap)
            for i, text in enumerate(own):
                expected = words(text, pattern)
                assert spans.of[i + 1] - spans.of[i] == len(expected)
                for word, found in zip(expected, spans.hash[spans.of[i] : spans.of[i + 1]]):
                    assert met.setdefault(word, found) == found
        starts, of_text = K.lines(data, offsets)
        for i, text in enumerate(own):
            got = [bytes(data[starts[j] : starts[j + 1]]).decode() for j in range(of_text[i], of_text[i + 1])]
            assert [g.removesuffix("\n") for g in got] == (text or "").split("\n")
    assert rows == len(texts) and len(set(met.values())) == len(met)


def test_shingles():
    flat, offsets = np.frombuffer(b"a b a b a b", np.uint8), np.array([0, 11])
    spans = K.words(flat, offsets)
    assert len(K.shingles(spans.hash, 2)) == 2 and len(K.shingles(spans.hash, 9)) == 1
    assert len(K.shingles(spans.hash[:0], 2)) == 0
    hashes, first = K.sequences(spans, 2)
    assert len(set(hashes)) == 2 and list(first) == [0, 1, 2, 3, 4]
    assert "AbC".translate(LOWER) == "abc"
