"""Harmonic packing: documents of tokens into sequences of fixed capacity, each worker for itself.

A piece of length x belongs to class k when k of its kind fill a sequence: C/(k+1) < x <= C/k. A
sequence of class k takes exactly k pieces, whatever they are, so packing needs neither a search nor
knowledge of other workers: one pass, no shuffle, a bounded number of open sequences.

Plain harmonic packing wastes up to 1/(k+1) of a sequence. Documents may be cut here, so a piece that
would waste more than ``slack`` of its sequence first gives up a part of exactly C/(k+1), which wastes
next to nothing in its own class. Pieces below the last class fill a sequence one after another. What
is open at the end of a worker's documents is joined, cut into full sequences, and the rest into
sequences of a power of two, which need no padding.

Nulls and empty texts are one end token. Repeated rows are documents of their own. An empty table
gives no pieces. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.tokens import WordTokens

SCHEMA = ("doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, ids binary")
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                    ("ids", pa.binary())])


class Packer:
    """The open sequences of one worker. A piece is (doc_id, start, doc_tokens, ids); a placed piece
    has its sequence and offset as well."""

    def __init__(self, capacity: int, classes: int, slack: float, first_id: int):
        self._capacity = capacity
        self._classes = classes
        self._waste = int(capacity * slack)
        self._next = first_id
        self._open: dict[int, list[tuple]] = {}
        self._small: list[tuple] = []
        self._small_size = 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, total, ids in pieces:
            size = len(ids) // 4
            yield doc, start, size, total, self._next, at, ids
            at += size
        self._next += 1

    def cut(self, left: int) -> int:
        """How many of the next tokens of a document form a piece."""
        if left >= self._capacity:
            return self._capacity
        k = self._capacity // left
        if k > self._classes or self._capacity - k * left <= self._waste:
            return left
        return self._capacity // (k + 1)

    def add(self, doc: int | None, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        at = 0
        while at < total:
            size = self.cut(total - at)
            piece = (doc, at, total, ids[4 * at:4 * (at + size)])
            at += size
            k = self._capacity // size
            if k > self._classes:
                yield from self._add_small(piece)
                continue
            pieces = self._open.setdefault(k, [])
            pieces.append(piece)
            if len(pieces) == k:
                yield from self._close(self._open.pop(k))

    def _add_small(self, piece: tuple) -> Iterator[tuple]:
        """Next fit with a cut: the sequence in hand is filled to the last token."""
        doc, start, total, ids = piece
        while ids:
            room = self._capacity - self._small_size
            head, ids = ids[:4 * room], ids[4 * room:]
            self._small.append((doc, start, total, head))
            start += len(head) // 4
            self._small_size += len(head) // 4
            if self._small_size == self._capacity:
                full, self._small, self._small_size = self._small, [], 0
                yield from self._close(full)

    def finish(self) -> Iterator[tuple]:
        for k in sorted(self._open):
            for piece in self._open.pop(k):
                yield from self._add_small(piece)
        while self._small_size:
            size = 1 << (self._small_size.bit_length() - 1)
            taken, rest, room = [], [], size
            for doc, start, total, ids in self._small:
                head, tail = ids[:4 * room], ids[4 * room:]
                if head:
                    taken.append((doc, start, total, head))
                    room -= len(head) // 4
                if tail:
                    rest.append((doc, start + len(head) // 4, total, tail))
            yield from self._close(taken)
            self._small, self._small_size = rest, self._small_size - size


def pack(docs: DataFrame, vocabulary: str | Callable[[], str], capacity: int = 2048, end_id: int = 1,
         classes: int = 32, slack: float = 1 / 64) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their place: one row per piece, ``ids`` as 32-bit numbers.

    ``vocabulary`` is the file's path on the executors, or a function that finds it there. Up to
    ``classes`` sequences of at most ``capacity`` tokens are open per worker at any time.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(vocabulary if isinstance(vocabulary, str) else vocabulary())
        # Distinct for every task, the same when a task is tried again.
        packer = Packer(capacity, classes, slack, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []

        def flushed():
            return pa.RecordBatch.from_arrays(
                [pa.array(column, field.type) for column, field in zip(zip(*rows), _ARROW)], schema=_ARROW)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                for row in packer.add(doc, tokens.of(text or b"") + end):
                    rows.append(row)
                    if len(rows) == 1024:
                        yield flushed()
                        rows.clear()
        rows.extend(packer.finish())
        if rows:
            yield flushed()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
