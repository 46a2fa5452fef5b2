import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from gradelens.llm import packing, token_count
from gradelens.llm.packing import differencing, windows_of
from gradelens.llm.token_count import TokenCounter, count
from gradelens.llm.token_pieces import TokenEncoder
from llm.conftest import ODD, long_text

MARKS = [" ", "  ", "\n", "\n ", "\t", "a", "b'", "'s", "9", "<|endoftext|>", "é", "é", " ́", "　", "\x1c", "\x85", "\0", ".", ",", "中", "É", "×", "Σ ", "the "]


def _fuzz(n, most):
    rng = random.Random(3)
    return ["".join(rng.choice(MARKS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_encoder_gives_the_library_s_ids():
    path = P.path("byte_bpe_50k.json")
    texts = _fuzz(3000, 30) + [long_text(500)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    got = TokenEncoder(path, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ids(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


@pytest.mark.parametrize("sizes", [(1 << 15, 1 << 14, 256), (40, 60, 16), (10, 12, 2)])
def test_counter_gives_the_library_s_counts(sizes):
    path = P.path("word_bpe_49k.json")
    texts = _fuzz(1500, 120) + [long_text(3000), "x" * 500, "x" * 300 + " y" * 50]
    want = [len(e) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert TokenCounter(path, *sizes).counts(texts) == want


def test_huge_documents_are_spliced_to_the_same_count():
    path = P.path("word_bpe_49k.json")
    text = long_text(12_000) + "z" * 70_000 + " end " + long_text(3_000, 1)
    counter = TokenCounter(path)
    assert len(text) > counter.huge
    assert counter.counts([text]) == [len(Tokenizer.from_file(path).encode(text, add_special_tokens=False))]


def test_token_counts_of_odd_rows(make):
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = {r["doc_id"]: r for r in count(make(ODD), path).collect()}
    for i, t in enumerate(ODD):
        n = len(tok.encode(t or "", add_special_tokens=False))
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"], rows[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048)
    assert count(make([]), path).count() == 0


def test_differencing_deals_every_item_once_and_evenly():
    rng = random.Random(1)
    sizes = [rng.randint(1, 200) for _ in range(400)]
    parts = differencing(sizes, 16)
    assert sorted(i for p in parts for i in p) == list(range(400)) and len(parts) == 16
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) <= 20
    assert sorted(map(tuple, differencing([8, 7, 6, 5, 4], 2))) in ([(0, 2), (1, 3, 4)], [(0, 3, 4), (1, 2)], [(0, 4), (1, 2, 3)], [(0, 1), (2, 3, 4)])


def test_window_count_rises_until_all_fit():
    for sizes in ([60, 60, 60], [100, 100, 1], [1], [50] * 9):
        got = windows_of(sizes, 100)
        assert sorted(i for w in got for i in w) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in w) <= 100 for w in got)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_every_id_lies_in_one_piece(make, capacity):
    path = P.path("byte_bpe_50k.json")
    texts = ODD + [long_text(n, n) for n in (3, 50, 700, 2500)]
    docs = make(texts)
    rows = packing.pack(docs, path, capacity=capacity).collect()
    tok = Tokenizer.from_file(path)
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    for i, want in ids.items():
        pieces = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        at = 0
        for r in pieces:
            assert r["start"] == at and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(np.array(want[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(want)
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= capacity
    assert packing.pack(make([]), path).count() == 0


SCRIPTS = {
    "cyrillic": "Съешь же ещё этих мягких французских булок, да выпей чаю. ",
    "chinese": "天地玄黄，宇宙洪荒。日月盈昃，辰宿列张！寒来暑往；秋收冬藏？",
    "marks": "Ἄνδρα μοι ἔννεπε, μοῦσα, cafe\u0301 it's o'clock 'tis 12.5 <|endoftext|> \u0301x e\u0301. ",
    "no places": "永和九年岁在癸丑",
}


@pytest.mark.parametrize("name", SCRIPTS)
def test_chunks_of_any_script_stay_small(name):
    path = P.path("word_bpe_49k.json")
    text = SCRIPTS[name] * (6000 // len(SCRIPTS[name]))
    counter = token_count.TokenCounter(path, huge=400, chunk=200, overlap=80)
    taken, own = [], counter._offsets

    def seen(t, at, end):
        taken.append(end - at)
        return own(t, at, end)

    counter._offsets = seen
    assert counter.counts([text]) == [len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)]
    assert len(taken) > 1 and (name == "no places" or max(taken) <= 2 * (200 + 80))


def test_little_padding_and_repeated_rows(make):
    path = P.path("byte_bpe_50k.json")
    docs = make([long_text(300 + i, i) for i in range(400)] + [(7, long_text(307, 7))] * 3).coalesce(1)
    rows = packing.pack(docs, path).collect()
    used = sum(r["length"] for r in rows)
    assert used / (2048 * len({r["sequence_id"] for r in rows})) > 0.97
    assert len([r for r in rows if r["doc_id"] == 7 and r["start"] == 0]) == 4
