import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """``make(texts)``: a documents table; ids are 0, 1, ... unless pairs are given."""
    def build(rows, lang=None):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in rows], DOCS)
    return build


def long_text(words: int, seed: int = 0) -> str:
    import random
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(words))


#: Texts that every operator must stand: null, empty, white space, marks, one word, odd characters, one very long word, a very long text.
ODD = [None, "", "   \n\t ", "!!! ... ???", "word", "é中文 \U0001f600 á 　x", "x" * 30_000, long_text(9_000), "word", "a b c d e"]
