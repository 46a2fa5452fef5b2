"""Personal data: base patterns, and a character-level BiLSTM-CRF that adds spans.

Base spans follow fixed patterns with checks (address parts, digit counts, Luhn);
they are scanned in linear time.  The network is trained on labelled spans: the base
spans of a bounded sample of documents (about ``SAMPLE`` of them, chosen by hash) in
``SAMPLE_WINDOWS`` windows of ``WINDOW`` characters around their digits and ``@``, chosen by
hash over all windows of the sample, half of them in equal shares from those that hold
each kind.  Whole texts are tagged in
overlapping windows; a character's scores are the mean over the windows that hold
it, and one Viterbi pass over each covered stretch reconciles them.  A span without
a digit or ``@`` is never kept, so windows without either are not run.  A tagged
span loses the blanks at its ends and what base spans hold of it; each part that is left
is added when it has enough characters.

Defined cases: null and empty texts have no spans; a sample without any base span
adds nothing; of spans of one kind that begin together the longer is listed last; a very long
text is tagged whole, its digit-rich stretches take some 100 bytes a character; an empty
table gives no rows; repeated rows have equal spans; ``report`` reads only the id and the
text, ``mask`` changes only the text, whatever the other columns are called.
"""
from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm_crf import BiLstmCrf
from .textops import as_bytes, by_hash, prepare, text_slices

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 2000
SAMPLE_CHARS = 30_000
SAMPLE_WINDOWS = 3000
WINDOW = 64
STRIDE = 32
#: Least digits, or for addresses characters, of an added span.
LEAST = {"email": 6, "ip": 4, "card": 13, "phone": 9}

_TRIGGER = re.compile(r"[0-9@]")
_TRIGGER_BYTES = re.compile(rb"[0-9@]")
_EMAIL = re.compile(r"([A-Za-z0-9._%+-]++)(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the base patterns, by kind as listed and start."""
    if not _TRIGGER.search(text):
        return []
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", m.start(), m.end()) for m in _EMAIL.finditer(text) if m.group(2)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:] or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 40:
            digits = "".join(_DIGITS.findall(m.group()))
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# Character classes: single marks that matter, then digits, lower and upper case, other letters, white space, the rest.
_SINGLE = "@.-+()_%:/#, "
_CLASSES = len(_SINGLE) + 6
PAD = _CLASSES
_ASCII = np.array([_SINGLE.index(c) if c in _SINGLE else len(_SINGLE) + (0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 4 if c.isspace() else 5)
                   for c in map(chr, range(128))], np.int64)


def classes_of(text: str) -> np.ndarray:
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(cps < 128, _ASCII[np.minimum(cps, 127)], len(_SINGLE) + 3)


def starts_of(text: str) -> list[int]:
    """Starts of the overlapping windows that hold a digit or ``@``."""
    last = max(0, len(text) - 1) // STRIDE
    got: set[int] = set()
    for m in re.finditer(r"[0-9@]+", text):
        for k in range(max(0, (m.start() - WINDOW) // STRIDE + 1), min(last, (m.end() - 1) // STRIDE) + 1):
            got.add(k * STRIDE)
    return sorted(got)


def _windows(codes: np.ndarray, starts: list[int]) -> np.ndarray:
    padded = np.concatenate([codes, np.full(WINDOW, PAD)])
    return padded[np.array(starts, np.int64)[:, None] + np.arange(WINDOW)]


def _chosen(places: list[tuple[int, int]], tagged: list[np.ndarray], texts: list[str], most: int = SAMPLE_WINDOWS) -> list[tuple[int, int]]:
    """Training windows in hash order: equal shares of each kind's for half of them, then any."""
    seed = [zlib.crc32(t.encode("utf-8", "replace")) for t in texts]
    order = sorted(places, key=lambda p: (zlib.crc32(b"%d:%d" % (seed[p[0]], p[1])), p))
    taken: dict[tuple[int, int], None] = {}
    for kind in range(1, len(KINDS) + 1):
        holding = [p for p in order if (tagged[p[0]][p[1]:p[1] + WINDOW] == kind).any()]
        taken |= dict.fromkeys(holding[:most // (2 * len(KINDS))])
    for p in order:
        if len(taken) >= most:
            break
        taken.setdefault(p)
    return [p for p in order if p in taken]


def outside(span: tuple[str, int, int], known: list[tuple[str, int, int]], text: str) -> list[tuple[str, int, int]]:
    """The parts of ``span`` that no known span holds, without blanks at their ends, that are long enough for its kind."""
    kind, a, b = span
    parts, at = [], a
    for _, s, e in sorted(known, key=lambda x: x[1]):
        if s < b and e > at:
            parts.append((at, s))
            at = e
    parts.append((at, b))
    out = []
    for s, e in parts:
        piece = text[s:e]
        s, e = s + len(piece) - len(piece.lstrip()), e - (len(piece) - len(piece.rstrip()))
        piece = text[s:e] if s < e else ""
        size = len(piece) if kind == "email" else sum(c.isdigit() for c in piece)
        if size >= LEAST[kind] and (kind != "email" or "@" in piece):
            out.append((kind, s, e))
    return out


class PiiModel:
    """The trained network, or none when the sample held no base span."""

    def __init__(self, texts: list[str]):
        tagged, places = [], []
        for d, text in enumerate(texts):
            tags = np.zeros(len(text) + WINDOW, np.int8)
            for kind, a, b in reversed(base_spans(text)):
                tags[a:b] = KINDS.index(kind) + 1
            tagged.append(tags)
            places += [(d, s) for s in starts_of(text)]
        xs, ys = [], []
        for d, s in _chosen(places, tagged, texts):
            xs.append(_windows(classes_of(texts[d][s:s + WINDOW]), [0]))
            ys.append(tagged[d][None, s:s + WINDOW].astype(np.int64))
        self.net = None
        if ys and np.concatenate(ys).any():
            self.net = BiLstmCrf(_CLASSES + 1, len(KINDS) + 1)
            self.losses = self.net.train(np.concatenate(xs), np.concatenate(ys))

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Base and added spans of each text, by kind as listed, then start."""
        base = [base_spans(t) for t in texts]
        added = self._tagged(texts) if self.net is not None else [[] for _ in texts]
        out = []
        for text, known, more in zip(texts, base, added):
            for span in more:
                near = [k for k in known if k[1] < span[2] and k[2] > span[1]]
                known = [*known, *outside(span, near, text)]
            out.append(sorted(known, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))
        return out

    def _tagged(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        starts = [starts_of(t) for t in texts]
        todo = [d for d, s in enumerate(starts) if s]
        if not todo:
            return out
        x = np.concatenate([_windows(classes_of(texts[d]), starts[d]) for d in todo])
        e = np.concatenate([self.net.emissions(x[i:i + 2048]) for i in range(0, len(x), 2048)])
        stretches, at = [], 0
        for d in todo:
            s = starts[d]
            cuts = [0, *(i for i in range(1, len(s)) if s[i] > s[i - 1] + WINDOW), len(s)]
            for a, b in zip(cuts, cuts[1:]):                    # windows that overlap or meet are one stretch
                begin, end = s[a], min(s[b - 1] + WINDOW, len(texts[d]))
                total, seen = np.zeros((s[b - 1] + WINDOW - begin, e.shape[2])), np.zeros((s[b - 1] + WINDOW - begin, 1))
                for i in range(a, b):
                    total[s[i] - begin:s[i] - begin + WINDOW] += e[at + i]
                    seen[s[i] - begin:s[i] - begin + WINDOW] += 1
                stretches.append((d, begin, (total / np.maximum(seen, 1))[:end - begin]))
            at += len(s)
        stretches.sort(key=lambda x: len(x[2]))
        i = 0
        while i < len(stretches):
            j = i + 1
            while j < len(stretches) and j - i < 512 and (j - i + 1) * len(stretches[j][2]) <= 1 << 18:
                j += 1
            part = stretches[i:j]
            lengths = np.array([len(s[2]) for s in part])
            padded = np.zeros((len(part), lengths.max(), e.shape[2]))
            for row, s in zip(padded, part):
                row[:len(s[2])] = s[2]
            for (d, begin, _), tags, n in zip(part, self.net.decode(padded, lengths), lengths):
                out[d] += _runs(begin, tags[:n])
            i = j
        return out


def _runs(begin: int, tags: np.ndarray) -> list[tuple[str, int, int]]:
    """The runs of one kind among the tags."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(tags)) + 1, [len(tags)]])
    return [(KINDS[tags[a] - 1], int(begin + a), int(begin + b)) for a, b in zip(cuts, cuts[1:]) if tags[a]]


def fit(docs: DataFrame) -> PiiModel:
    """The network, from the base spans of a bounded sample of documents that hold a digit or ``@``."""
    short = docs.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9]{4}|@")).select("text")
    n = short.count()
    rows = short.where(by_hash(SAMPLE / max(1, n), "text", seed="pii")).limit(2 * SAMPLE).collect()
    return PiiModel(sorted({r["text"] for r in rows}, key=lambda t: zlib.crc32(t.encode("utf-8", "replace"))))


def _decoded(batch: pa.RecordBatch, i: int, off: np.ndarray, data: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def report(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """Per row: base spans by kind, the digest of the base spans, and all spans in writing."""
    model = model or fit(docs)
    held = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, off, data in text_slices(batch):
                texts = _decoded(batch, i, off, data)
                with_any = [k for k, t in enumerate(texts) if _TRIGGER.search(t)]
                every: list[list] = [[] for _ in texts]
                for k, spans in zip(with_any, held.value.spans([texts[k] for k in with_any])):
                    every[k] = spans
                base = [base_spans(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *[pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64()) for kind in KINDS],
                     pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base]), pa.array([written(s) for s in every], pa.string())],
                    ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    src = as_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    return src.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span (overlapping ones together) replaced by its kind in brackets."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def mask(docs: DataFrame, model: PiiModel | None = None, text_col: str = "text") -> DataFrame:
    """The documents with personal data replaced; other columns and null texts stay."""
    model = model or fit(docs)
    held = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            out: list[str | None] = []
            for i, j, off, data in text_slices(pa.RecordBatch.from_arrays([col], ["text"])):
                texts = _decoded(None, i, off, data)
                at = [k for k, t in enumerate(texts) if _TRIGGER.search(t)]
                for k, spans in zip(at, held.value.spans([texts[k] for k in at])):
                    texts[k] = masked(texts[k], spans)
                out += texts
            yield pa.array([None if not v else t for v, t in zip(col.is_valid().to_pylist(), out)], pa.string())

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(text_col, F.arrow_udf(run, "string")(F.col(text_col).cast("binary")))
