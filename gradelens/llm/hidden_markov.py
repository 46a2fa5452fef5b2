"""A hidden Markov language model, trained by Baum-Welch over all training documents.

``STATES`` latent states follow one another by a transition matrix and emit word
classes; a class (one of ``CLASSES``, by a hash of the word) gives its words by their corpus
counts.  So ``P(word | state) = P(class | state) * (c + 1) / (C + V + 1)`` with the class's counted
tokens C and distinct words V; a word never counted takes its class's one share for
unknown words.  The word counts grow with the corpus and stay in Spark; the state
parameters have a fixed size, which bounds what is broadcast and collected.

Shape of the job: one pass turns the documents into slices (distinct words, places
of every token; written once).  Words are counted by partial sums.  Each round of
Baum-Welch is one pass over the slices: training documents, cut into sequences of at most
``SEQUENCE`` tokens, give expected counts, summed in each task and then by class.
Each slice sends its distinct words once and gets their corpus counts back, so a word
that is everywhere is one row a slice; scoring joins slices and counts and runs the
scaled forward recursion over whole documents, uncut, for the exact likelihood.

Defined cases: a null or empty text is its end token alone; a null id is a training
document; repeated rows (and ids) are documents of their own; words that only
held-out documents hold have count 0; without training documents all counts are 0 and
the states start from their initial noise; a task holds one slice or one text, however long;
an empty table gives no rows; only the id and the text are read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelens.session import cut_lineage

from .slices import listed, packed, slice_ids, unpacked
from .textops import SPACE_WORDS, Words, as_bytes, prepare, text_slices

STATES = 8
CLASSES = 1 << 16
ROUNDS = 5
SEQUENCE = 256
SLICE = 16 << 20
#: Text whose expected counts one task of a round sums up.
ROUND_BYTES = 256 << 20
#: Sequences that one step of the recursion advances together.
TOGETHER = 1024
#: Weight of the corpus's own class shares in each state's, as a share of the state's tokens.
PRIOR = 0.05
_SEED = 11
_END = np.uint64(0)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


# ---- slices -------------------------------------------------------------------------------------------------------

_SLICE_SCHEMA = ("slice long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, at binary, class array<int>, "
                 "word array<binary>, n array<long>")


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    number = slice_ids()

    def flush():
        counts = np.concatenate([w.count for w in held])
        base = np.cumsum([0, *[len(w.data) for w in held]])
        text = np.concatenate([w.data for w in held]).tobytes()
        start = np.concatenate([w.start + b for w, b in zip(held, base)])
        end = np.concatenate([w.end + b for w, b in zip(held, base)])
        closing = np.cumsum(counts)                       # an end token behind each document
        hashes = np.insert(np.concatenate([w.hash for w in held]), closing, _END)
        start, end = np.insert(start, closing, 0), np.insert(end, closing, 0)
        out = pa.concat_arrays(outs)
        training = np.repeat(~out.to_numpy(zero_copy_only=False).astype(bool), counts + 1)
        distinct, first, at, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")         # frequent words get the small numbers
        distinct, first = distinct[order], first[order]
        at = np.argsort(order)[at]
        words = [text[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
        row = [pa.array([next(number)]), listed(pa.concat_arrays(ids)), listed(out), listed(pa.array(counts + 1)), pa.array([packed(at)], pa.binary()),
               listed(pa.array((distinct % np.uint64(CLASSES)).astype(np.int32))), listed(pa.array(words, pa.binary())),
               listed(pa.array(np.bincount(at[training], minlength=len(distinct)).astype(np.int64)))]
        return pa.RecordBatch.from_arrays(row, ["slice", "doc_id", "held_out", "n_tokens", "at", "class", "word", "n"])

    ids, outs, held, size = [], [], [], 0
    for batch in batches:
        for i, j, off, data in text_slices(batch, "text"):
            held.append(Words(off, data, SPACE_WORDS, lower=True))
            ids.append(batch.column(0).slice(i, j - i))
            outs.append(batch.column(1).slice(i, j - i))
            size += len(data) + 64 * (j - i)
            if size >= most:
                yield flush()
                ids, outs, held, size = [], [], [], 0
    if held:
        yield flush()


def slices_of(docs: DataFrame, slice_bytes: int = SLICE) -> DataFrame:
    """Documents as slices of numbered words, as a written table."""
    prepare(docs.sparkSession)
    src = as_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                   .withColumn("held_out", held_out()), "doc_id", "held_out")
    return cut_lineage(src.mapInArrow(lambda it: _slices(it, slice_bytes), _SLICE_SCHEMA), compression="zstd")


def word_counts(slices: DataFrame) -> DataFrame:
    """Corpus counts of every slice's words, as a written table.

    ``slice``, ``at`` (the word's number there), ``class``, ``n`` (its training tokens there),
    ``count`` (everywhere) and ``first``, true in one of the slices that hold the word.
    """
    asked = slices.select("slice", F.posexplode(F.arrays_zip("word", "class", "n")).alias("at", "w")).select("slice", "at", "w.*")
    same = Window.partitionBy("word").orderBy("slice")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return cut_lineage(asked.select("slice", "at", "class", "n", F.sum("n").over(whole).alias("count"), (F.row_number().over(same) == 1).alias("first")),
                       compression="zstd")


# ---- model --------------------------------------------------------------------------------------------------------

@dataclass
class Model:
    """``emit`` [class, state], ``move`` [from, to], ``begin`` [state]; token and word counts of the training documents."""
    begin: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    tokens: int
    words: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    def log_word(self, count: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 P(word | class)."""
        return np.log10((count + 1.0) / (self.class_tokens[cls] + self.class_words[cls] + 1.0))

    def log_base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1.0) / (self.tokens + self.words + 1.0))


def class_share(class_tokens: np.ndarray, class_words: np.ndarray) -> np.ndarray:
    """The corpus's smoothed share of each class; every class has some."""
    share = class_tokens + class_words + 1.0
    return share / share.sum()


def normalised(emit: np.ndarray, move: np.ndarray, begin: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities from expected counts: emissions leaning on the corpus share, moves and begins with one count spread."""
    states = emit.shape[1]
    lean = PRIOR * emit.sum() / states + 1.0
    emit = (emit + lean * share[:, None]) / (emit.sum(0) + lean)
    move = move + 1.0 / states
    begin = begin + 1.0 / states
    return emit, move / move.sum(1, keepdims=True), begin / begin.sum()


def first_guess(share: np.ndarray, states: int = STATES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sticky states whose emissions are the corpus's, each disturbed by its own fixed noise."""
    noise = np.exp(np.random.default_rng(_SEED).normal(0.0, 1.0, (len(share), states)))
    emit = share[:, None] * noise
    return emit / emit.sum(0), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), np.full(states, 1.0 / states)


def time_major(lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all tokens, step by step over sequences that are sorted by falling length.

    Returns the order of the sequences, the number still running at each step, and the places.
    """
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths[order[0]]) if len(order) else 0
    running = np.searchsorted(-lengths[order], -np.arange(longest), "left")
    step = np.repeat(np.arange(longest), running)
    rank = np.arange(len(step)) - np.repeat(np.cumsum(running) - running, running)
    return order, running, starts[order][rank] + step


def log_likelihood(cls: np.ndarray, lengths: np.ndarray, begin: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """log10 probability of each class sequence (``cls`` holds them end to end), by the scaled forward recursion."""
    order, running, places = time_major(lengths, np.cumsum(lengths) - lengths)
    total = np.zeros(len(lengths))
    at, alpha = 0, None
    for n in running.tolist():
        b = emit[cls[places[at:at + n]]]
        alpha = (begin if alpha is None else alpha[:n] @ move) * b
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        total[:n] += np.log10(scale)
        at += n
    out = np.empty(len(lengths))
    out[order] = total
    return out


def expected_counts(cls: np.ndarray, lengths: np.ndarray, begin: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of emissions, moves and begins of some sequences, and their log10 probability."""
    _, running, places = time_major(lengths, np.cumsum(lengths) - lengths)
    states, seen = emit.shape[1], cls[places]
    b = emit[seen]
    alpha, scale = np.empty_like(b), np.empty(len(b), b.dtype)
    ends = np.cumsum(running)
    prior = None
    for n, end in zip(running.tolist(), ends.tolist()):
        x = (begin if prior is None else prior[:n] @ move) * b[end - n:end]
        s = x.sum(1)
        x /= s[:, None]
        alpha[end - n:end], scale[end - n:end], prior = x, s, x
    b /= scale[:, None]                                    # from here on: emission over its step's scale
    beta = np.ones_like(b)
    moves = np.zeros((states, states))
    for t in range(len(running) - 1, 0, -1):
        n, end = int(running[t]), int(ends[t])
        before = end - n - int(running[t - 1])
        nxt = b[end - n:end] * beta[end - n:end]
        moves += alpha[before:before + n].T @ nxt
        beta[before:before + n] = nxt @ move.T
    gamma = alpha * beta
    emits = np.stack([np.bincount(seen, gamma[:, k], len(emit)) for k in range(states)], 1)
    n = int(running[0]) if len(running) else 0
    return emits, moves * move, gamma[:n].sum(0), float(np.log10(scale).sum())


def _lengths_in(lengths: np.ndarray, most: int) -> np.ndarray:
    """Lengths of the sequences that documents are cut into, in order."""
    pieces = -(-lengths // most)
    out = np.full(int(pieces.sum()), most, np.int64)
    out[np.cumsum(pieces) - 1] = lengths - (pieces - 1) * most
    return out


def _round(batches: Iterator[pa.RecordBatch], parameters) -> Iterator[pa.RecordBatch]:
    """Expected counts of a task's slices: rows of a class, then of moves (-1-state), begins (-100), log likelihood (-200)."""
    begin, move, emit = (x.astype(np.float32) for x in parameters.value)
    states = emit.shape[1]
    emits, moves, begins, fit = np.zeros(emit.shape), np.zeros((states, states)), np.zeros(states), 0.0
    for batch in batches:
        for r in range(batch.num_rows):
            n, out, at, classes = (batch.column(i)[r] for i in range(4))
            n, out = n.values.to_numpy(), out.values.to_numpy(zero_copy_only=False).astype(bool)
            cls = classes.values.to_numpy()[unpacked(at.as_py())][~np.repeat(out, n)]
            lengths = _lengths_in(n[~out], SEQUENCE)
            ends = np.cumsum(lengths)
            for i in range(0, len(lengths), TOGETHER):
                part = lengths[i:i + TOGETHER]
                begin_at = int(ends[i] - lengths[i])
                e, m, b, f = expected_counts(cls[begin_at:begin_at + int(part.sum())], part, begin, move, emit)
                emits, moves, begins, fit = emits + e, moves + m, begins + b, fit + f
    if begins.any():
        used = np.flatnonzero(emits.any(1))
        rows = np.concatenate([emits[used], moves, begins[None], np.full((1, states), fit)])
        key = np.r_[used, -1 - np.arange(states), -100, -200]
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), *[pa.array(rows[:, k]) for k in range(states)]], ["class", *[f"e{k}" for k in range(states)]])


def fit(slices: DataFrame, counts: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model of the slices' training documents, and the log10 likelihood before each round."""
    spark = slices.sparkSession
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    words = F.sum((F.col("first") & (F.col("count") > 0)).cast("long"))
    for r in counts.groupBy("class").agg(F.sum("n").alias("tokens"), words.alias("words")).collect():               # at most CLASSES rows
        class_tokens[r["class"]], class_words[r["class"]] = r["tokens"], r["words"]
    share = class_share(class_tokens, class_words)
    emit, move, begin = first_guess(share, states)
    fits = []
    columns = [f"e{k}" for k in range(states)]
    # each task sends the counts of all classes, so a round has no more tasks than its text or the cores ask for
    size = slices.select(F.sum(F.length("at"))).first()[0] or 0
    dealt = slices.select("n_tokens", "held_out", "at", "class").coalesce(max(2 * spark.sparkContext.defaultParallelism, size // ROUND_BYTES))
    for _ in range(rounds):
        parameters = spark.sparkContext.broadcast((begin, move, emit))                                          # CLASSES * states numbers
        sums = (dealt.mapInArrow(lambda it: _round(it, parameters), "class int, " + ", ".join(f"{c} double" for c in columns))
                .groupBy("class").agg(*[F.sum(c).alias(c) for c in columns])).toPandas().set_index("class")      # at most CLASSES + states + 2 rows
        parameters.unpersist()
        if sums.empty:
            break
        fits.append(float(sums.loc[-200, "e0"]))
        emits = np.zeros((CLASSES, states))
        own = sums[sums.index >= 0]
        emits[own.index.to_numpy()] = own.to_numpy()
        moves = sums.loc[[-1 - k for k in range(states)]].to_numpy()
        emit, move, begin = normalised(emits, moves, sums.loc[-100].to_numpy(), share)
    return Model(begin, move, emit, int(class_tokens.sum()), int(class_words.sum()), class_tokens, class_words), fits


def _scores(found: pa.Table, answers: pa.Table, m: Model) -> pa.Table:
    """Documents of one slice."""
    col = {name: found.column(name)[0] for name in found.column_names}
    at, n, of_class = unpacked(col["at"].as_py()), col["n_tokens"].values.to_numpy(), col["class"].values.to_numpy()
    count = np.zeros(len(of_class), np.int64)
    count[answers.column("at").to_numpy()] = answers.column("count").to_numpy()
    first = np.cumsum(n) - n
    known = np.add.reduceat((count > 0)[at].astype(np.int64), first)
    base = np.add.reduceat(m.log_base(count)[at], first)
    score = np.add.reduceat(m.log_word(count, of_class)[at], first) + log_likelihood(of_class[at], n, m.begin, m.move, m.emit)
    return pa.Table.from_arrays(
        [col["doc_id"].values, col["held_out"].values, pa.array(n), pa.array(known), pa.array(np.full(len(n), m.tokens, np.int64)), pa.array(base), pa.array(score)],
        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(slices: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """Per document of the slices: its exact log10 probability under the model and under the smoothed word counts."""
    shared = slices.sparkSession.sparkContext.broadcast(model)
    found = slices.select("slice", "doc_id", "held_out", "n_tokens", "at", "class").groupBy("slice")
    return found.cogroup(counts.select("slice", "at", "count").groupBy("slice")).applyInArrow(
        lambda a, b: _scores(a, b, shared.value),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def report(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, slice_bytes: int = SLICE) -> DataFrame:
    """Scores of all documents by the model of those that are not held out."""
    slices = slices_of(docs, slice_bytes)
    counts = word_counts(slices)
    model, _ = fit(slices, counts, states, rounds)
    return score(slices, counts, model)
