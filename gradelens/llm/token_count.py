"""Exact token counts of whole texts; huge documents by overlapping chunks that are spliced.

``word_bpe_49k`` cuts a text into runs of letters, single digits and runs of other
characters, and drops white space.  No run goes on over a blank or line feed, and one of
letters or a digit ends before a mark such as a comma or a full stop, in any script; no
normalisation joins characters there.  These places are *stable*, whatever stands around them.

* A document of more than ``HUGE`` code points is encoded in chunks that overlap,
  with offsets.  Two neighbouring chunks are spliced at a stable boundary inside
  their overlap where both have a token boundary and from which their tokens
  agree to the end of the overlap; when there is none the overlap is doubled and
  the chunk encoded anew.  The encoder so holds a chunk, however long the text; only
  a run that has no stable place inside is encoded whole, since its tokens
  depend on all of it.
* A shorter document is counted part by part between blanks and line feeds; as
  words repeat, each distinct part is encoded by the library once and its count
  kept, up to a bounded number of parts.

Defined cases: a null or empty text has no tokens; the strings of special tokens
are handled as the library does; a very long text is counted chunk by chunk; repeated rows
count alike; an empty table has no rows; only the id and the text are read.
"""
from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import as_bytes, prepare, text_slices

HUGE = 1 << 15
CHUNK = 1 << 14
OVERLAP = 256
KEEP_PARTS = 400_000
KEEP_CHARS = 64
#: Parts that one encoder call takes.
JOINED = 256
LIMIT = 2048

_STABLE = re.compile(r"[ \n]|(?<=[^\W_])[.,;:!?()、。，；：！？「」『』（）]")


class TokenCounter:
    def __init__(self, path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(path)
        self.huge, self.chunk, self.overlap = huge, chunk, overlap
        self._kept: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        kept = self._kept
        if len(kept) > KEEP_PARTS:
            kept.clear()
        cut = [None if len(t) > self.huge else t.replace("\n", " ").split(" ") for t in texts]
        new = list({p for parts in cut if parts for p in parts if p not in kept})
        for i in range(0, len(new), JOINED):
            self._learn(new[i:i + JOINED])
        out = [self.spliced(t) if parts is None else sum(map(kept.__getitem__, parts)) for t, parts in zip(texts, cut)]
        for p in new:
            if len(p) > KEEP_CHARS:
                del kept[p]
        return out

    def _learn(self, parts: list[str]) -> None:
        """Token counts of distinct parts, encoded in one call with line feeds between them."""
        starts = np.cumsum([0, *[len(p) + 1 for p in parts]])
        at = [a for a, _ in self._tok.encode("\n".join(parts), add_special_tokens=False).offsets]
        self._kept.update(zip(parts, np.diff(np.searchsorted(at, starts)).tolist()))

    def _offsets(self, text: str, at: int, end: int) -> list[tuple[int, int]]:
        return [(a + at, b + at) for a, b in self._tok.encode(text[at:end], add_special_tokens=False).offsets]

    def spliced(self, text: str) -> int:
        """Tokens of a long text: those of each chunk between its splices."""
        total, begin, lap = 0, 0, self.overlap
        end = min(len(text), self.chunk + lap)
        left = self._offsets(text, 0, end)
        while end < len(text):
            at = max(begin + 1, end - lap)
            stop = min(len(text), at + max(self.chunk, lap) + lap)
            right = self._offsets(text, at, stop)
            p = self._boundary(text, left, right, at, end)
            if p is None:                                   # widen: the chunk reaches further, the next one starts earlier
                lap *= 2
                end = min(len(text), end + lap)
                left = self._offsets(text, begin, end)
                continue
            total += sum(1 for a, _ in left if begin <= a < p)
            begin, end, left, lap = p, stop, right, self.overlap
        return total + sum(1 for a, _ in left if a >= begin)

    @staticmethod
    def _boundary(text: str, left: list, right: list, at: int, end: int) -> int | None:
        """The first stable place in ``[at, end)`` from which both sides have the same tokens to the last stable place."""
        places = [m.start() for m in _STABLE.finditer(text, at, end)]
        if len(places) < 2:
            return None
        for p in places[:-1]:
            a = [x for x in left if x[0] >= p and x[1] <= places[-1]]
            b = [x for x in right if x[0] >= p and x[1] <= places[-1]]
            if a == b and not any(x[0] < p < x[1] for x in left) and not any(x[0] < p < x[1] for x in right):
                return p
        return None


def count(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: bytes of UTF-8, tokens, and whether there are more than ``limit``."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(tokenizer_path)
        for batch in batches:
            for i, j, off, data in text_slices(batch):
                raw = data.tobytes()
                n = counter.counts([raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(off[1:] - off[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    src = as_bytes(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    return src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
