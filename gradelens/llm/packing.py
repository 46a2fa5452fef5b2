"""Packing token ids into fixed windows by multiway differencing.

Each document's ids (with a closing id) are cut into pieces and the pieces are
dealt to windows of at most ``capacity`` ids.  A task works on blocks of
``BLOCK_WINDOWS`` windows: it takes pieces until a block is full but for a small
slack, and splits them over the block's windows by Karmarkar-Karp differencing:
every piece starts as a partial partition with one non-empty part, and the two
partial partitions of the largest imbalance are merged again and again, the
fullest part of one with the emptiest of the other, so the imbalances cancel.
The parts come out nearly equal.  The few ids by which a part of a full block
exceeds the capacity are cut off and carried to the next block; in a task's last
block the window count rises and the block is split anew, until the fullest part
fits.  Nothing is shuffled: the windows of one input split form a run of sequence ids of its own, which a rerun
of a lost task makes again in the same way.

Defined cases: a null or empty text has the closing id only; repeated rows are
packed as rows of their own; an empty table gives no rows; columns other than
the id and the text are not read.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import as_bytes, prepare, text_slices
from .token_pieces import TokenEncoder, crc32

CAPACITY = 2048
END_ID = 1
BLOCK_WINDOWS = 64
#: A piece holds at most capacity / PIECES ids, so that parts have enough pieces to balance.
PIECES = 8
#: Share of a block that is left empty for the imbalance that remains.
SLACK = 0.001

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Split ``sizes`` into ``ways`` parts of nearly equal sums (Karmarkar-Karp).

    A partial partition is a list of (sum, members) by falling sum, without its
    empty parts; its imbalance is the largest sum less the smallest.
    """
    heap = [(-s, i, [(s, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        free = ways - len(a) - len(b)
        if free >= 0:
            merged = a + b
        else:                                     # b's largest meet a's empty parts, the next ones a's smallest
            k, z = -free, ways - len(a)
            both = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(reversed(a), b[z:])]
            merged = a[:len(a) - k] + both + b[:z]
        merged.sort(key=_total, reverse=True)
        least = merged[-1][0] if len(merged) == ways else 0
        heapq.heappush(heap, (least - merged[0][0], order, merged))
        order += 1
    parts = [_flatten(m) for _, m in heap[0][2]] if heap else []
    return parts + [[] for _ in range(ways - len(parts))]


def _total(part: tuple) -> int:
    return part[0]


def _flatten(tree: tuple) -> list[int]:
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo.extend(x)
        else:
            out.append(x)
    return sorted(out)


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; the count rises until they fit."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, ways)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return [p for p in parts if p]
        ways += 1


class _Packer:
    """Collects pieces ``(doc_id, start, ids, doc_tokens)`` and turns full blocks into rows."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next_id = capacity, base
        self.room = BLOCK_WINDOWS * capacity - max(1, int(SLACK * BLOCK_WINDOWS * capacity))
        self.pieces: list[tuple] = []
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        total, start, most = len(ids) // 4, 0, max(1, self.capacity // PIECES)
        while total - start >= self.capacity:     # whole windows need no balancing
            self._emit([(doc_id, start, ids[4 * start:4 * (start + self.capacity)], total)])
            start += self.capacity
        even = -(-(total - start) // -(-(total - start) // most)) if start < total else 0
        while start < total:                      # equal pieces of a document, so that sizes differ between documents
            n = min(even, total - start, self.room - self.held)
            self.pieces.append((doc_id, start, ids[4 * start:4 * (start + n)], total))
            self.held += n
            start += n
            if self.held == self.room:
                self._block()

    def _block(self) -> None:
        """A full block's windows; what exceeds the capacity of one is cut off and goes to the next block."""
        pieces, self.pieces, self.held = self.pieces, [], 0
        for part in differencing([len(p[2]) // 4 for p in pieces], BLOCK_WINDOWS):
            part = [pieces[i] for i in part]
            over = sum(len(p[2]) for p in part) // 4 - self.capacity
            while over > 0:
                at = max(range(len(part)), key=lambda i: len(part[i][2]))
                doc_id, start, ids, total = part.pop(at)
                keep = max(0, len(ids) // 4 - over)
                over -= len(ids) // 4 - keep
                if keep:
                    part.insert(at, (doc_id, start, ids[:4 * keep], total))
                self.pieces.append((doc_id, start + keep, ids[4 * keep:], total))
                self.held += len(ids) // 4 - keep
            if part:
                self._emit(part)

    def close(self) -> None:
        """The last block: its window count rises until no window exceeds the capacity."""
        if self.pieces:
            for part in windows_of([len(p[2]) // 4 for p in self.pieces], self.capacity):
                self._emit([self.pieces[i] for i in part])
        self.pieces, self.held = [], 0

    def _emit(self, pieces: list[tuple]) -> None:
        """One window; pieces of a document that follow one another are joined again."""
        joined: list[list] = []
        for p in pieces:
            if joined and joined[-1][0] == p[0] and joined[-1][4] == p[3] and joined[-1][1] + len(joined[-1][2]) // 4 == p[1]:
                joined[-1][2] += p[2]
            else:
                joined.append([p[0], p[1], p[2], p[3], p[3]])
        at = 0
        for doc_id, start, ids, total, _ in joined:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, crc32(ids), total, self.next_id, at))
            at += n
        self.next_id += 1

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) if self.rows else [[] for _ in range(7)]
        self.rows = []
        names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None,
         capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: document, place in it, length, CRC-32 of its ids, sequence and place there.

    ``ranks_path`` and ``pattern`` may name the rank file of the same vocabulary (see ``token_pieces``).
    """
    prepare(docs.sparkSession)
    closing = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TokenEncoder(tokenizer_path, ranks_path, pattern)
        packer = _Packer(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, off, data in text_slices(batch):
                raw = data.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                for doc_id, got in zip(ids[i:j], coder.ids(texts)):
                    packer.add(doc_id, got + closing)
                yield packer.take()
        packer.close()
        yield packer.take()

    src = as_bytes(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    return src.mapInArrow(run, PIECE_SCHEMA)
