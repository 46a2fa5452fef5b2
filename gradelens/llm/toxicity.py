"""Toxicity by compression distance.

Zstandard dictionaries are trained (``train_dictionary``) on all text of a labelled
sample.  Two of them, one of toxic and one of ordinary documents, compress passages
of ``PASSAGE`` words, each overlapping half of the next; the difference of the two
lengths is a passage's distance.  Trained dictionaries alone miss single words that
tell the classes apart, because they hold what is frequent.  So single words (or
pieces of very long ones) have distances too, under two dictionaries that begin with
one trained on both classes and end with the pieces of words that set a class apart:
all whose excess chance doesn't explain, the most telling last, where a match is
cheapest.  Words are compressed after a common lead-in and in two bytes a character,
so that the fixed cost of a match weighs less against the characters it saves.  A
document's greatest distances go through a logistic threshold that is calibrated on
other labelled documents.

The model is fitted on a bounded sample of labelled rows: about ``2 * SAMPLE``
per class (two thirds for the dictionaries, one for calibration), chosen by hash, of
at most ``SAMPLE_CHARS`` characters; the class shares that calibrate it are counted over
all labelled rows.  Scoring reads every whole text, in one pass without a shuffle.

Defined cases: null and empty texts have no window and get the score of distance
zero; without labelled rows of both classes every score is the share of toxic rows
(zero when there are no labels); a document labelled twice is toxic if either label
says so; null labels and ids are not learned from; repeated rows score alike; other
columns are not read.
"""
from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import by_hash, prepare, text_slices

SAMPLE = 800
SAMPLE_CHARS = 30_000
SHARED_WORDS = 600
DICTIONARY_BYTES = 16_384
#: Words of a passage, and the most characters of one.
PASSAGE = 16
PASSAGE_CHARS = 256
PIECE_CHARS = range(4, 13)
WINDOW_CHARS = 32
KEEP_WINDOWS = 300_000
TOP = (1, 2, 4, 8)
FAR = (1, 2, 4)
WEIGHTS = 2 * len(TOP) + len(FAR) + 3
MARKS = ".,!?;:\"'()*#"
#: Least share of the ordinary calibration documents that ``reject`` leaves alone.
KEEP_ORDINARY = 0.9


def windows(text: str) -> list[str]:
    """The distinct words, in lower case and without marks around; long words in pieces."""
    return _windows(text.lower().split())


def _windows(words: list[str]) -> list[str]:
    out = []
    for w in dict.fromkeys(words):
        w = w.strip(MARKS)
        if len(w) <= WINDOW_CHARS:
            if w:
                out.append(w)
        else:
            out += [w[i:i + WINDOW_CHARS] for i in range(0, len(w), WINDOW_CHARS)]
    return out


def _pieces(docs: list[list[str]]) -> Counter:
    """In how many documents each piece of a word (with the blanks around it) occurs."""
    found: Counter = Counter()
    for words in docs:
        found.update({w[i:i + n] for w in (f" {w} " for w in words) for n in PIECE_CHARS for i in range(len(w) - n + 1)})
    return found


def passages(text: str) -> list[str]:
    """The distinct runs of ``PASSAGE`` words in lower case, each half over the one before; long ones in pieces."""
    return _passages(text.lower().split())


def _passages(words: list[str]) -> list[str]:
    half = PASSAGE // 2
    runs = (" ".join(words[i:i + PASSAGE]) for i in range(0, max(1, len(words) - half), half)) if words else ()
    return list(dict.fromkeys(r[i:i + PASSAGE_CHARS] for r in runs for i in range(0, len(r), PASSAGE_CHARS)))


def trained(texts: list[str], coding: str) -> bytes:
    """A dictionary trained on all of ``texts``; of too little text to train on, the text itself."""
    import zstandard as zs
    lines = [" ".join(t.lower().split()) for t in texts]
    samples = [x.encode(coding, "replace") for t in lines for x in (t[i:i + 500] for i in range(0, len(t), 500)) if len(x) >= 8]
    try:
        return zs.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)


def telling(own: Counter, other: Counter, n_own: int, n_other: int) -> list[str]:
    """Pieces far more frequent in one class than chance explains, none inside a more telling one, the most telling first."""
    tested = {g: c for g, c in own.items() if c >= 4}
    odds = {g: np.log((c + 0.5) / (n_own + 1)) - np.log((other[g] + 0.5) / (n_other + 1)) for g, c in tested.items()}
    share = n_own / max(1, n_own + n_other)

    def unlikely(c: int, o: int) -> float:
        """Log of a bound (Chernoff) on the chance that ``c`` of ``c + o`` documents are of this class."""
        p = c / (c + o)
        return -(c + o) * (p * np.log(p / share) + ((1 - p) * np.log((1 - p) / (1 - share)) if o else 0))

    most = -np.log(max(1, len(tested)))                 # less than one piece of all by chance
    out: list[str] = []
    held = ""
    for g in sorted((g for g in odds if odds[g] > 1.5 and unlikely(own[g], other[g]) < most), key=lambda g: (-own[g] * odds[g], -len(g), g)):
        if g not in held:
            out.append(g)
            held += g + "\0"
    return out


def _first_of_kind(docs: list[list[str]]) -> list[list[str]]:
    """Without documents that share a run of words with an earlier one: copies would count a rare word many times."""
    seen: set = set()
    out = []
    for words in docs:
        runs = {tuple(words[i:i + 4]) for i in (0, len(words) // 3, len(words) // 2, 2 * len(words) // 3) if i + 4 <= len(words)}
        if not runs & seen:
            out.append(words)
        seen |= runs
    return out


class ToxicModel:
    """Two dictionaries and the calibration; compressors are made where the model is used."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        bad, good = _first_of_kind([windows(t) for t in toxic]), _first_of_kind([windows(t) for t in ordinary])
        frequent = [w for w, _ in Counter(w for d in good for w in d).most_common(SHARED_WORDS)]
        self.lead = " ".join(frequent[:8])[:24] + " "
        shared = " ".join(sorted(frequent)) + " " + self.lead
        both = trained([*toxic, *ordinary], "utf-16-le")
        p, q = _pieces(bad), _pieces(good)
        self.toxic = both + (shared + "".join(reversed(telling(p, q, len(bad), len(good)))) + " ").encode("utf-16-le", "replace")
        self.ordinary = both + (shared + "".join(reversed(telling(q, p, len(good), len(bad)))) + " ").encode("utf-16-le", "replace")
        self.trained_toxic, self.trained_ordinary = trained(toxic, "utf-8"), trained(ordinary, "utf-8")
        self.weights = np.zeros(WEIGHTS)
        #: documents that score this much or more are rejected
        self.limit = 0.5

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    @staticmethod
    def _compressor(content: bytes):
        import zstandard as zs
        how = zs.ZstdCompressionParameters(
            format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0, window_log=17,
            hash_log=15, chain_log=15, search_log=6, min_match=3, target_length=32, strategy=zs.STRATEGY_BTULTRA)
        held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_AUTO)
        held.precompute_compress(compression_params=how)
        return zs.ZstdCompressor(dict_data=held, compression_params=how).compress

    @staticmethod
    def _fast(content: bytes):
        import zstandard as zs
        held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_AUTO)
        held.precompute_compress(level=3)
        return zs.ZstdCompressor(dict_data=held, level=3, write_content_size=False, write_dict_id=False, write_checksum=False).compress

    def far(self, words: list[str]) -> list[int]:
        """By how much shorter each passage is under the dictionary trained on toxic text, greatest first."""
        if not hasattr(self, "_pair"):
            self._pair = self._fast(self.trained_ordinary), self._fast(self.trained_toxic)
        ordinary, toxic = self._pair
        parts = [x.encode("utf-8", "replace") for x in _passages(words)]
        return sorted((len(ordinary(x)) - len(toxic(x)) for x in parts), reverse=True)

    def distances(self, words: list[str]) -> list[tuple[int, float]]:
        """By how much shorter each window is under the toxic dictionary, and that as a share of its own ordinary length."""
        if not hasattr(self, "_both"):
            self._both, self._kept, self._older = (self._compressor(self.ordinary), self._compressor(self.toxic)), {}, {}
            self._bare = len(self._both[0](self.lead.encode("utf-16-le", "replace")))
        ordinary, toxic = self._both
        kept = self._kept
        out = list(map(kept.get, words))
        if None in out:
            if len(kept) > KEEP_WINDOWS // 2:             # words not met again until the next time are forgotten
                self._older, self._kept = kept, {}
                kept = self._kept
            older = self._older
            for i, x in enumerate(out):
                if x is None:
                    if (x := older.get(words[i])) is not None:
                        out[i] = kept[words[i]] = x
                        continue
                    framed = f"{self.lead}{words[i]} ".encode("utf-16-le", "replace")
                    plain = len(ordinary(framed))
                    d = plain - len(toxic(framed))
                    out[i] = kept[words[i]] = (d, d / max(4, plain - self._bare))
        return out

    def features(self, text: str) -> list[float]:
        words = text.lower().split()
        got = self.distances(_windows(words))
        d = sorted([x for x, _ in got], reverse=True)[:TOP[-1]]
        r = sorted([x for _, x in got], reverse=True)[:TOP[-1]]
        far = self.far(words)
        return [*(sum(d[:m]) / m for m in TOP), *(4 * sum(r[:m]) / m for m in TOP), *(sum(far[:m]) / m / 4 for m in FAR),
                sum(far) / max(1, len(far)), float(np.log1p(len(got))), 1.0]

    def calibrate(self, texts: list[str], labels: list[int], share: float) -> None:
        """Logistic weights by Newton steps, then the class share of all labelled rows instead of the sample's.

        A score is so the chance that a document is toxic, which is small for most where few are.
        What to reject is another matter: ``limit`` is the score that ``KEEP_ORDINARY`` of the ordinary
        documents at least stay under and that tells the calibration documents apart best
        (greatest sum of the toxic share at or over it and the ordinary share under it).
        """
        x, y = np.array([self.features(t) for t in texts]), np.array(labels, float)
        w, ridge = np.zeros(x.shape[1]), np.diag([0.5] * (x.shape[1] - 1) + [1e-6])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
            w += step
            if abs(step).max() < 1e-6:
                break
        sample = min(max(y.mean(), 1e-6), 1 - 1e-6)
        share = min(max(share, 1e-6), 1 - 1e-6)
        w[-1] += np.log(share / (1 - share)) - np.log(sample / (1 - sample))
        self.weights = w
        scores = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        clean, toxic = np.sort(scores[y == 0]), np.sort(scores[y == 1])
        if len(clean) and len(toxic):
            at = np.unique(scores)
            left = np.searchsorted(clean, at, "left") / len(clean)
            caught = 1 - np.searchsorted(toxic, at, "left") / len(toxic)
            best = int(np.argmax(np.where(left >= KEEP_ORDINARY, left + caught, -1.0)))
            if left[best] >= KEEP_ORDINARY:               # halfway to the score below
                self.limit = float((at[best] + at[max(0, best - 1)]) / 2) if best else float(at[0])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.features(text), self.weights), -30, 30))))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> ToxicModel | float:
    """A model from labelled documents (``usable`` chooses among the labels), or the share of toxic rows when a class is missing."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if not counts.get(0) or not counts.get(1):
        return share
    # about 2 * sample ids of each class, chosen by hash: tasks send only these
    chosen = known.where(F.when(F.col("toxic") > 0, by_hash(2 * sample / counts[1], "doc_id", seed="toxicity"))
                         .otherwise(by_hash(2 * sample / counts[0], "doc_id", seed="toxicity"))).limit(8 * sample)
    short = docs.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", "text")
    rows = short.join(F.broadcast(chosen), "doc_id").limit(16 * sample).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["text"]))
    sides = {t: [r["text"] for r in rows if (r["toxic"] > 0) == bool(t)] for t in (0, 1)}
    if not sides[0] or not sides[1]:
        return share
    model = ToxicModel(*([x for i, x in enumerate(sides[t]) if i % 3 or len(sides[t]) < 3] for t in (1, 0)))
    rest = [(x, t) for t in (1, 0) for i, x in enumerate(sides[t]) if i % 3 == 0 or len(sides[t]) < 3]
    model.calibrate([t for t, _ in rest], [y for _, y in rest], share)
    return model


_LOADED: dict[bytes, ToxicModel] = {}


def _loaded(model: ToxicModel, key: bytes) -> ToxicModel:
    """The model of this ``key`` that an earlier task of this Python worker used, with the distances it knows; else ``model``."""
    if key not in _LOADED:
        _LOADED.clear()                                   # one model at a time
        _LOADED[key] = model
    return _LOADED[key]


def score(docs: DataFrame, model: ToxicModel | float, text_col: str = "text") -> Column:
    """A column with the score of ``text_col``, from 0 to 1."""
    prepare(docs.sparkSession)
    if not isinstance(model, ToxicModel):
        return F.lit(float(model))

    key = uuid.uuid4().bytes

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _loaded(model, key)
        for col in it:
            out: list[float] = []
            for _, _, off, data in text_slices(pa.RecordBatch.from_arrays([col], ["text"])):
                raw = data.tobytes()
                out += [own.score(raw[a:b].decode("utf-8", "replace")) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.array(out, pa.float64())

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(F.col(text_col).cast("binary"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted``; labels of held-out documents are not learned from."""
    model = fit(docs, labels, ~held_out())
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(docs, model).alias("score"))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: ToxicModel | float, threshold: float | None = None) -> DataFrame:
    """The documents whose score is under ``threshold`` (else the model's ``limit``), with their columns.

    Without a model (labels of one class only) every score is the share of toxic rows, and 0.5 the limit.
    """
    if threshold is None:
        threshold = model.limit if isinstance(model, ToxicModel) else 0.5
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, score(docs, model)).where(F.col(name) < threshold).drop(name)
