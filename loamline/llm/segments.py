"""N-best segmentations over a piece vocabulary, exact, and decoding.

The lattice of a text has an edge for every vocabulary piece at every place. Forward Viterbi gives the
best score from the beginning to each place; a search backward from the end uses it as heuristic.
As it is the exact rest cost, A* takes only paths that are in the result, in order of score.

No piece holds a space sign behind another character, so a text's lattice falls apart in front of
every run of space signs, and each part is searched by itself, mostly from a cache. The n best
of the whole are then the best of every part with few alternatives: an alternative that is not among
the n - 1 cheapest ones of the text cannot occur, since each of those alone would be better.

Scores are the vocabulary's own (in a BPE vocabulary, minus the rank). A character that no piece holds
is written in byte pieces, at a score below all others. Which of several equally good segmentations come
first follows from the order of the search, the same in every run; their number does not slow it down.
Null texts read as empty: one segmentation without pieces. Repeated rows get equal results, an empty table
gives none. Other columns are not read.
"""

from __future__ import annotations

import gc
import heapq
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_PARTS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
Segmentation = tuple[float, tuple[int, ...]]
Part = tuple[float, bytes, float]
_NEVER = float("inf")


class Recent:
    """A bounded cache: what was not used while ``limit`` newer keys came in is forgotten."""

    def __init__(self, limit: int):
        self._limit = limit
        self.new: dict = {}  # a miss here is no miss; loops look here first, as it costs no call
        self._old: dict = {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and self._old:
            found = self._old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self._limit:
            self._old, self.new = self.new, {}
        self.new[key] = value


class Lattice:
    """Pieces with scores, and the n best paths through the lattice of one part."""

    def __init__(self, path: str, n: int, limit: int = 300_000):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        usable = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        floor = min(s for s in map(model.get_score, usable) if s > -1e8)
        # Runs of space signs are marked as user-defined in some vocabularies; they score as the last piece.
        self.pieces = {model.id_to_piece(i): (i, max(model.get_score(i), floor)) for i in usable}
        self._spelled = {i: p.encode() for p, (i, _) in self.pieces.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        # Every beginning of a piece, with the piece's id and score where it is one itself.
        self._begins: dict[str, tuple[int, float] | None] = {}
        for piece in self.pieces:
            for stop in range(1, len(piece) + 1):
                self._begins.setdefault(piece[:stop], self.pieces.get(piece[:stop]))
        # The same as nested tables by character: (table behind it, cost, id), and the pairs inside pieces.
        self._trie: dict = {}
        self._joints: set[str] = set()
        for piece, (i, score) in self.pieces.items():
            table = self._trie
            for c in piece[:-1]:
                entry = table.get(c, (None, 0.0, None))
                if entry[0] is None:
                    entry = table[c] = ({}, *entry[1:])
                table = entry[0]
            table[piece[-1]] = (table.get(piece[-1], (None,))[0], -score, i)
            self._joints.update(piece[k:k + 2] for k in range(len(piece) - 1))
        self._byte_score = floor - 10.0
        self._n = n
        self._latest: tuple[str | None, list[Segmentation]] = (None, [])
        self._cache, self._sections, self._searched = Recent(limit), Recent(limit), Recent(limit // 20)

    def part(self, text: str) -> Part:
        """Best score of a part, its ids as 32-bit numbers, and what the second best costs more."""
        found = self._cache.get(text)
        if found:
            return found
        found = self._joined(text)
        if len(text) <= 64:
            self._cache.put(text, found)
        return found

    def _joined(self, text: str) -> Part:
        """A part from its sections: it is cut wherever no piece holds the two characters side by side, as no
        edge crosses there. A gap of 0 is a tie, and then the search decides which ids come first."""
        joints, start, sections = self._joints, 0, []
        for at in range(1, len(text)):
            if text[at - 1:at + 1] not in joints:
                sections.append(text[start:at])
                start = at
        sections.append(text[start:])
        known = self._sections.new.get
        found = [known(s) or self._sections.get(s) or self._section(s) for s in sections]
        gap = min([f[2] for f in found])
        if gap == 0:
            score, ids = self._search_once(text)[0]
            return score, struct.pack(f"<{len(ids)}I", *ids), gap
        if len(found) == 1:
            return found[0]
        return sum([f[0] for f in found]), b"".join([f[1] for f in found]), gap

    def _section(self, text: str) -> Part:
        """Viterbi with the two best costs (scores with their sign turned) per place."""
        size, root = len(text), self._trie
        first, second = [_NEVER] * (size + 1), [_NEVER] * (size + 1)
        came: list = [None] * (size + 1)
        first[0] = 0.0
        for at in range(size):
            one, two, node = first[at], second[at], root
            for stop in range(at + 1, size + 1):
                entry = node.get(text[stop - 1])
                if entry is None:
                    break
                node, more, piece = entry
                if piece is not None:
                    cost, best = one + more, first[stop]
                    if cost < best:
                        other = two + more
                        second[stop] = best if best < other else other
                        first[stop], came[stop] = cost, (at, piece)
                    elif cost < second[stop]:
                        second[stop] = cost
                if node is None:
                    break
            if text[at] not in self.pieces:
                first[at + 1], second[at + 1] = one - self._byte_score, two - self._byte_score
                came[at + 1] = (at, None)
        path: list[int] = []
        at = size
        while at:
            start, piece = came[at]
            if piece is None:
                path += [self.bytes[b] for b in reversed(text[start].encode("utf-8", "replace"))]
            else:
                path.append(piece)
            at = start
        path.reverse()
        found = -first[size], struct.pack(f"<{len(path)}I", *path), second[size] - first[size]
        if size <= 64:
            self._sections.put(text, found)
        return found

    def search(self, text: str) -> list[Segmentation]:
        """Up to n segmentations of a part, best first."""
        size, begins = len(text), self._begins
        best = [float("-inf")] * (size + 1)
        best[0] = 0.0
        ending: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
        for at in range(size):
            so_far = best[at]
            for stop in range(at + 1, size + 1):
                piece = begins.get(text[at:stop], False)
                if piece:
                    ending[stop].append((at, piece[1], (piece[0],)))
                    if so_far + piece[1] > best[stop]:
                        best[stop] = so_far + piece[1]
                elif piece is False:
                    break
            if text[at] not in self.pieces:
                raw = tuple(self.bytes[b] for b in text[at].encode("utf-8", "replace"))
                ending[at + 1].append((at, self._byte_score, raw))
                best[at + 1] = max(best[at + 1], best[at] + self._byte_score)
        # (estimate of the whole, place, behind it: score and pieces as a linked list). Among equal estimates the
        # one nearest the beginning goes first. Whatever leads to a place, only its n best ways on to the end can
        # be part of the result, so a place is left at most n times and ties cannot multiply.
        out: list[Segmentation] = []
        turn, left = 0, [0] * (size + 1)
        heap: list[tuple] = [(-best[size], size, turn, 0.0, None)]
        while heap and len(out) < self._n:
            estimate, place, _, behind, tail = heapq.heappop(heap)
            if place == 0:
                ids: list[int] = []
                while tail:
                    ids.extend(tail[0])
                    tail = tail[1]
                out.append((-estimate, tuple(ids)))
                continue
            if left[place] == self._n:
                continue
            left[place] += 1
            for start, score, ids in ending[place]:
                turn += 1
                heapq.heappush(heap, (-(best[start] + score + behind), start, turn, score + behind, (ids, tail)))
        return out

    def _search_once(self, text: str) -> list[Segmentation]:
        """The search of the same text again, as for its first path and then for the others, is remembered."""
        if self._latest[0] != text:
            self._latest = (text, self.search(text))
        return self._latest[1]

    def _alternatives(self, text: str) -> list[Segmentation]:
        """All of the n best of a part but the first."""
        found = self._searched.get(text)
        if found is None:
            found = self._search_once(text)[1:]
            if len(text) <= 64:
                self._searched.put(text, found)
        return found

    def text(self, text: str) -> list[tuple[float, bytes]]:
        """Up to n segmentations of a whole text, best first: score and ids as 32-bit numbers."""
        if not text:
            return [(0.0, b"")]
        names = _PARTS.findall(SPACE + text.replace(" ", SPACE))
        known = self._cache.new.get
        parts = [known(name) or self.part(name) for name in names]
        total = sum([p[0] for p in parts])
        gaps = [p[2] for p in parts]
        # The n - 1 cheapest alternatives lie in the n - 1 parts whose second best costs least.
        near = heapq.nsmallest(self._n - 1, range(len(gaps)), gaps.__getitem__)
        other = {i: self._alternatives(names[i]) for i in near if gaps[i] < _NEVER}
        cheap = heapq.nsmallest(self._n - 1, [(parts[i][0] - score, i, k) for i, found in other.items()
                                              for k, (score, _) in enumerate(found)])
        changes: list[tuple[float, tuple]] = [(0.0, ())]
        for cost, i, k in cheap:
            more = [(c + cost, (*chosen, (i, k))) for c, chosen in changes if all(i != j for j, _ in chosen)]
            changes = sorted(changes + more)[:self._n]
        ids = [p[1] for p in parts]
        out = []
        for cost, chosen in changes:
            for i, k in chosen:
                ids[i] = struct.pack(f"<{len(other[i][k][1])}I", *other[i][k][1])
            out.append((total - cost, b"".join(ids)))
            for i, _ in chosen:
                ids[i] = parts[i][1]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of a segmentation: pieces and bytes joined, the space sign in front dropped."""
        raw = b"".join(map(self._spelled.__getitem__, memoryview(ids).cast("I")))
        return raw.decode("utf-8", "replace").replace(SPACE, " ")[1:]


@lru_cache(maxsize=1)
def worker_lattice(path: str, n: int) -> Lattice:
    """One lattice per Python worker, so that later tasks find its caches filled."""
    lattice = Lattice(path, n)
    gc.freeze()  # the tables stay; the collector need not walk them again and again
    return lattice


_SCHEMA = "doc_id bigint, paths array<struct<score:double,ids:array<int>>>"


def encode(docs: DataFrame, model: str | Callable[[], str], n: int = 4) -> DataFrame:
    """(doc_id, paths): up to ``n`` segmentations per row of ``docs`` (doc_id, text), best first."""
    paths = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = worker_lattice(model if isinstance(model, str) else model(), n)
        for batch in batches:
            for lo in range(0, len(batch), 64):
                some = batch.slice(lo, 64)
                found = [[{"score": s, "ids": memoryview(ids).cast("I").tolist()} for s, ids in lattice.text(t or "")]
                         for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, paths)], names=["doc_id", "paths"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)


def digests(docs: DataFrame, model: str | Callable[[], str], n: int = 4) -> DataFrame:
    """What encoding and decoding each row gives, without the ids: number of paths, pieces and score of the
    best, all scores, a checksum of every path, and whether the best path decodes to the text."""
    schema = ("doc_id bigint, n_paths bigint, n_pieces bigint, best_score double, scores array<double>, "
              "ids_crc32 array<bigint>, round_trip boolean")
    types = pa.schema([("doc_id", pa.int64()), ("n_paths", pa.int64()), ("n_pieces", pa.int64()), ("best_score", pa.float64()),
                       ("scores", pa.list_(pa.float64())), ("ids_crc32", pa.list_(pa.int64())), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = worker_lattice(model if isinstance(model, str) else model(), n)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                found = lattice.text(text)
                rows.append((doc, len(found), len(found[0][1]) // 4, found[0][0], [s for s, _ in found],
                             [zlib.crc32(ids) for _, ids in found], lattice.decode(found[0][1]) == text))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)], schema=types)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)
