import numpy as np
import pyarrow as pa

from gradelens.llm.textops import ALNUM_WORDS, SPACE_WORDS, Words, text_slices


def _batch(texts):
    return pa.RecordBatch.from_arrays([pa.array([None if t is None else t.encode() for t in texts], pa.binary())], ["text"])


def test_words_are_those_of_the_patterns():
    texts = [None, "", " a  bc\n", "The QUICKÉ fox-9", "x", "éé é"]
    (_, _, off, data), = text_slices(_batch(texts))
    words = Words(off, data, SPACE_WORDS, False)
    got = [[bytes(data[a:b]).decode() for a, b in zip(words.start[i:j], words.end[i:j])] for i, j in zip(words.first, words.first[1:])]
    assert got == [(t or "").split() for t in texts]
    low = Words(off, data, ALNUM_WORDS, True)
    assert [bytes(low.data[a:b]).decode() for a, b in zip(low.start, low.end)] == ["a", "bc", "the", "quickÉ", "fox", "9", "x", "éé", "é"]


def test_texts_without_space_between_do_not_join():
    off, data = np.array([0, 2, 4]), np.frombuffer(b"abcd", np.uint8)
    words = Words(off, data, SPACE_WORDS, False)
    assert words.count.tolist() == [1, 1] and words.end.tolist() == [2, 4]


def test_equal_words_have_equal_hashes_anywhere():
    text = b"one two one three two one two"
    words = Words(np.array([0, len(text)]), np.frombuffer(text, np.uint8), SPACE_WORDS, False)
    h = words.hash
    assert h[0] == h[2] == h[5] and h[1] == h[4] == h[6] and len(set(h.tolist())) == 3
    pairs, inside = words.windows(2)
    assert pairs[0] == pairs[5] and len(set(pairs.tolist())) == 4 and inside.all()


def test_slices_cover_all_rows_once():
    texts = ["x" * n for n in (0, 5, 90, 0, 40, 200, 1)]
    batch = _batch(texts)
    seen = [(i, j) for i, j, _, _ in text_slices(batch, most=100)]
    assert seen[0][0] == 0 and seen[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(seen, seen[1:]))
    assert b"".join(d.tobytes() for _, _, _, d in text_slices(batch.slice(2, 4), most=50)) == "".join(texts[2:6]).encode()
