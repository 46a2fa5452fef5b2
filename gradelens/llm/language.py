"""Language identification: script ranges, per-word scores, and Viterbi over the words.

Characters are numbers in one array per slice of text.  A word is a run of
letters; its script comes from fixed code point ranges, and only languages with a
share of their letters in that script are candidates for it; for a script that no
language uses all are.  A word's score for a language is the sum of
the log probabilities of its letter triples (with the marks of its ends), learned
as hashed counts from all labelled documents.  Viterbi with a penalty for every
switch labels the words, so a text of several languages falls into spans; the
language with the most letters is the document's.

Viterbi runs on all words of a slice at once: words are cut into blocks of
``BLOCK``, a block's best transfer scores between its ends are found for all blocks
side by side, blocks are chained per document, and the best labels inside follow
from the forward and backward scores at the block's ends.  It is exact.

Learning is one pass that counts triples per task, adds them up in Spark and
brings one table of ``languages x BUCKETS`` numbers to the driver; prediction is one
pass without a shuffle.  The table grows with the number of languages (128 KB each),
not with the documents; with many of them a task takes its text in smaller slices.

Defined cases: null text or text without a letter is ``und`` with score 0, any other
gets a learned language; without labelled rows nothing is learned and all texts are ``und``;
ties go to the first language by name; very long texts are read whole; an empty table gives
no rows; repeated rows are predicted alike; other columns are not read.
"""
from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import prepare, text_slices

BUCKETS = 1 << 15
SWITCH = 12.0
BLOCK = 32
SLICE = 1 << 20
#: Languages up to which a task's slices have ``SLICE`` bytes.
FEW_LANGUAGES = 64
#: A language is a candidate for a script that holds this share of its letters.
SCRIPT_SHARE = 0.01

# Unicode blocks of the common scripts (first and last code point).
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3040, 0x30FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
N_SCRIPTS = len(SCRIPTS) + 1

_tables: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: is it a letter, its lower case, its script (0: any other)."""
    if not _tables:
        n = 0x110000
        letter = np.zeros(n, bool)
        lower = np.arange(n, dtype=np.uint32)
        for i in range(0x30000):
            c = chr(i)
            if unicodedata.category(c)[0] == "L":
                letter[i] = True
                if len(c.lower()) == 1:
                    lower[i] = ord(c.lower())
        letter[0x30000:0x32000] = True
        script = np.zeros(n, np.int8)
        for k, spans in enumerate(SCRIPTS.values(), 1):
            for a, b in spans:
                script[a:b + 1] = k
        _tables.extend([letter, lower, script])
    return tuple(_tables)


def code_points(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the slice and where each text begins among them."""
    text = raw.decode("utf-8", "replace")
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return cps, np.concatenate([[0], np.cumsum(lead)])[offsets] if len(raw) else np.zeros(len(offsets), np.int64)


def triples(cps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all letters and the bucket of the triple around each (other characters count as one mark)."""
    letter, lower, _ = tables()
    is_letter = letter[cps]
    x = np.where(is_letter, lower[cps], 0).astype(np.uint64)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    begins = first[:-1][first[:-1] < len(x)]
    before[begins] = 0                                  # texts don't touch
    ends = first[1:-1] - 1
    after[ends[ends >= 0]] = 0
    at = np.flatnonzero(is_letter)
    h = (before[at] * np.uint64(0x9E3779B97F4A7C15) ^ x[at] * np.uint64(0xD6E8FEB86659FD93) ^ after[at] * np.uint64(0xA0761D6478BD642F))
    return at, ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64)


class LanguageModel:
    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        """``counts``: languages x BUCKETS; ``scripts``: languages x N_SCRIPTS letters."""
        self.languages = languages
        total = counts.sum(1, keepdims=True)
        self.log = np.ascontiguousarray(np.log((counts + 0.5) / (total + 0.5 * BUCKETS)).T.astype(np.float32))
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        allowed = (share >= SCRIPT_SHARE).T                                    # script x language
        self.allowed = np.ascontiguousarray(allowed | ~allowed.any(1, keepdims=True))

    def labels(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi labels of all words of several texts (``first``: each text's first word, and the end)."""
        return viterbi(scores, first, SWITCH)

    def predict(self, raw: bytes, offsets: np.ndarray) -> list[tuple[str, float, list[tuple[int, int, str]] | None]]:
        """For each text the language and its share of the letters."""
        n = len(offsets) - 1
        cps, first = code_points(raw, offsets)
        at, bucket = triples(cps, first)
        if not len(at) or not self.languages:
            return [("und", 0.0)] * n
        owner = np.searchsorted(first, at, "right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
        word = np.flatnonzero(new)                                             # first letter of each word
        letters = np.diff(np.append(word, len(at)))
        scores = np.add.reduceat(self.log[bucket], word, axis=0)
        allowed = self.allowed[tables()[2][cps[at[word]]]]
        scores = np.where(allowed, scores, scores.min(1, keepdims=True) - 50)
        own = owner[word]
        starts = np.searchsorted(own, np.arange(n + 1))
        label = self.labels(scores, starts)
        weight = np.zeros((n, len(self.languages)))
        np.add.at(weight, (own, label), letters)
        total = np.bincount(own, letters, n)
        best = weight.argmax(1)
        top = weight[np.arange(n), best]
        return [(self.languages[b], float(t / s)) if t > 0 else ("und", 0.0) for b, t, s in zip(best, top, total)]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """``(start, end, language)`` of the runs of equally labelled words of one text."""
        raw = text.encode()
        cps, first = code_points(raw, np.array([0, len(raw)]))
        at, bucket = triples(cps, first)
        if not len(at) or not self.languages:
            return []
        word = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
        scores = np.add.reduceat(self.log[bucket], word, axis=0)
        allowed = self.allowed[tables()[2][cps[at[word]]]]
        scores = np.where(allowed, scores, scores.min(1, keepdims=True) - 50)
        label = self.labels(scores, np.array([0, len(word)]))
        last = np.append(word[1:], len(at)) - 1
        out: list[tuple[int, int, str]] = []
        for w, e, k in zip(word, last, label):
            if out and out[-1][2] == self.languages[k]:
                out[-1] = (out[-1][0], int(at[e]) + 1, out[-1][2])
            else:
                out.append((int(at[w]), int(at[e]) + 1, self.languages[k]))
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float, block: int = BLOCK) -> np.ndarray:
    """Labels of the best path of each text: word scores less ``penalty`` for each change of label."""
    count = np.diff(first)
    n_blocks = -(-count // block)
    total, k = int(n_blocks.sum()), scores.shape[1]
    if not total:
        return np.zeros(0, np.int64)
    block_first = np.concatenate([[0], np.cumsum(n_blocks)])
    text_of = np.repeat(np.arange(len(count)), n_blocks)
    begin = first[:-1][text_of] + (np.arange(total) - block_first[text_of]) * block
    size = np.minimum(block, first[1:][text_of] - begin)
    place = begin[:, None] + np.arange(block)
    inside = np.arange(block) < size[:, None]
    s = np.where(inside[:, :, None], scores[np.minimum(place, len(scores) - 1)], 0).astype(np.float32)

    def step(v: np.ndarray) -> np.ndarray:
        """Best score before a word, by its label: stay, or come from the best other."""
        return np.maximum(v, v.max(-1, keepdims=True) - penalty)

    # transfer[b, i, j]: best score of block b's words when the word before has label i and the last has label j
    transfer = np.where(np.eye(k, dtype=bool), 0, -penalty).astype(np.float32)[None] + s[:, 0, None, :]
    for t in range(1, block):
        nxt = step(transfer) + s[:, t, None, :]
        transfer = np.where(inside[:, t, None, None], nxt, transfer)
    enter = np.zeros((total, k), np.float32)            # score of the words before a block, by the label of the last of them
    leave = np.zeros((total, k), np.float32)            # score of the words after a block, by the label of the block's last word
    longest = int(n_blocks.max())
    for b in range(1, longest):
        at = block_first[:-1][n_blocks > b] + b
        enter[at] = (enter[at - 1][:, :, None] + transfer[at - 1]).max(1)
    for b in range(longest - 2, -1, -1):
        at = block_first[:-1][n_blocks > b + 1] + b
        leave[at] = (transfer[at + 1] + leave[at + 1][:, None, :]).max(2)
    # a text's first word has no word before: any label is free
    start = block_first[:-1][n_blocks > 0]
    head = np.zeros(total, bool)
    head[start] = True
    forward = np.empty((total, block, k), np.float32)
    forward[:, 0] = np.where(head[:, None], 0, step(enter)) + s[:, 0]
    for t in range(1, block):
        forward[:, t] = np.where(inside[:, t, None], step(forward[:, t - 1]) + s[:, t], forward[:, t - 1])
    # choose the last label, then walk back: stay when staying is best
    label = np.zeros((total, block), np.int64)
    after = (forward[:, block - 1] + leave).argmax(1)
    label[:, block - 1] = after
    for t in range(block - 2, -1, -1):
        nxt = label[:, t + 1]
        cost = forward[:, t] - penalty
        cost[np.arange(total), nxt] += penalty
        moved = np.where(cost.max(1) > cost[np.arange(total), nxt], cost.argmax(1), nxt)
        label[:, t] = np.where(inside[:, t + 1], moved, nxt)
    out = np.zeros(len(scores), np.int64)
    out[place[inside]] = label[inside]
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, usable: Column | None = None) -> LanguageModel:
    """Count triples and scripts of all rows with a language and a text (of those that ``usable`` chooses)."""
    prepare(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(usable) if usable is not None else rows
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([], np.zeros((0, BUCKETS)), np.zeros((0, N_SCRIPTS)))
    number = {x: i for i, x in enumerate(languages)}
    width = BUCKETS + N_SCRIPTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}                                     # languages that the task has met
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for i, j, off, data in text_slices(batch, most=SLICE):
                raw = data.tobytes()
                cps, first = code_points(raw, off)
                at, bucket = triples(cps, first)
                met, of = np.unique(lang[i:j], return_inverse=True)
                of = of[np.searchsorted(first, at, "right") - 1]
                found = np.bincount(of * width + bucket, minlength=len(met) * width)
                found += np.bincount(of * width + BUCKETS + tables()[2][cps[at]], minlength=len(met) * width)
                for k, row in zip(met.tolist(), found.reshape(len(met), width)):
                    counts[k] = counts[k] + row if k in counts else row
            if len(counts) > FEW_LANGUAGES:                                    # a task holds the counts of some languages
                yield from sent(counts)
                counts = {}
        yield from sent(counts)

    def sent(counts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, row in counts.items():
            used = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k), pa.int32()), pa.array(used, pa.int32()), pa.array(row[used])], ["lang", "bucket", "n"])

    learn = rows.select("lang", F.col("text").cast("binary").alias("text"))
    summed = learn.mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), width))
    counts[summed["lang"], summed["bucket"]] = summed["n"]
    return LanguageModel(languages, counts[:, :BUCKETS], counts[:, BUCKETS:])


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per row: ``doc_id, lang_pred, score``."""
    held = prepare(docs.sparkSession).sparkContext.broadcast(model)      # languages x BUCKETS numbers
    most = SLICE * FEW_LANGUAGES // max(FEW_LANGUAGES, len(model.languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, off, data in text_slices(batch, most=most):
                lang, score = zip(*held.value.predict(data.tobytes(), off))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return src.mapInArrow(run, "doc_id long, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, held_out, lang_pred, score``; held-out documents are not learned from."""
    model = fit(docs, ~F.coalesce(held_out(), F.lit(False)))
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
