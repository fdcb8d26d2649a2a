"""Long repeated word sequences, found by recompression.

Words get names (hashes of their bytes). A round first names maximal runs of one name, then pairs:
names fall in two halves by a bit of theirs, and a left name followed by a right one becomes a pair.
Names are functions of what they stand for, so equal substrings get equal names everywhere in the
corpus, except near their ends, where a neighbour outside decides. Every symbol therefore carries its
*context*: the words that determine it. A window of ``width`` words is represented by one symbol whose
context lies inside it: of the highest round, then of the smallest hash, then the first. Equal windows
choose equal symbols, so a window that occurs twice has an anchor that occurs twice.

1. Count anchors over the corpus (combined per batch and before the shuffle).
2. Mark shared anchors in a bit table of fixed size. A wrong mark costs work, never a result.
3. Windows of shared anchors meet by anchor, carrying a hash of all their words; the first by
   (doc_id, start) stays. Of equal windows in one batch only the first travels. Windows of anchors
   that hold more than a 2^-20 share meet by window instead, first among those of one share of the batches, then
   the first of each share, so neither an anchor nor a window that all batches hold gathers in one task.
4. The words of all other such windows are cut from their documents.

Nulls and empty texts have no words. Rows without a ``doc_id`` are left whole and are no one's source.
Repeated rows are one document: neither is earlier than the other. Where one ``doc_id`` has several
texts, each is cut by its own windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.llm.blocks import Words, find_words, free_name, mix
from loamline.llm.graphs import written

ROUNDS = 2
# Context lengths are rounded up to one of these (and to the width itself).
_LENGTHS = (1, 4, 8, 12, 16)
_POSITION_BITS = np.uint64(26)
_LEVEL_SHIFT = np.uint64(62)
_RUN = np.uint64(0xA24BAED4963EE407)
_PAIR = np.uint64(0x9FB21C651E98DF25)
_POWER = 0xC6A4A7935BD1E995
_INVERSE = pow(_POWER, -1, 1 << 64)

BITS = 28
HOT_SHARE = 2.0 ** -20
HOT_LEAST = 4096
# Equal windows of a frequent anchor meet in so many shares before they meet all together.
SHARES = 64


@dataclass
class Symbols:
    """One level of the parse: names, the words covered [lo, hi) and the context [cl, cr)."""

    name: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    cl: np.ndarray
    cr: np.ndarray


def name_runs(s: Symbols) -> Symbols:
    """Maximal runs of a name become one symbol. Both neighbours must be known to differ."""
    n = len(s.name)
    start = np.flatnonzero(np.concatenate([[True], s.name[1:] != s.name[:-1]]))
    stop = np.append(start[1:], n)
    length = (stop - start).astype(np.uint64)
    name = np.where(length > 1, mix(s.name[start] ^ mix(length * _RUN)), s.name[start])
    before, after = np.maximum(start - 1, 0), np.minimum(stop, n - 1)
    cl = np.minimum(np.minimum.reduceat(s.cl, start), np.minimum(s.cl[before], s.cl[after]))
    cr = np.maximum(np.maximum.reduceat(s.cr, start), np.maximum(s.cr[before], s.cr[after]))
    return Symbols(name, s.lo[start], s.hi[stop - 1], cl, cr)


def name_pairs(s: Symbols, level: int) -> Symbols:
    """A left name followed by a right one becomes a pair. A pair is determined by its two parts; a
    symbol that stays alone depends on the neighbour it might have joined."""
    n = len(s.name)
    left = ((s.name >> np.uint64(level + 3)) & np.uint64(1)).astype(bool)
    joined = np.concatenate([left[:-1] & ~left[1:], [False]])  # this symbol and the next
    second = np.concatenate([[False], joined[:-1]])
    at = np.flatnonzero(~second)
    paired = joined[at]
    nxt, prev = np.minimum(at + 1, n - 1), np.maximum(at - 1, 0)
    name = np.where(paired, mix(s.name[at] * _PAIR + s.name[nxt]), s.name[at])
    neighbour = np.where(paired | left[at], nxt, prev)
    return Symbols(name, s.lo[at], np.where(paired, s.hi[nxt], s.hi[at]),
                   np.minimum(s.cl[at], s.cl[neighbour]), np.maximum(s.cr[at], s.cr[neighbour]))


def levels(names: np.ndarray) -> list[Symbols]:
    """The words themselves and the symbols after each round."""
    at = np.arange(len(names))
    out = [Symbols(names, at, at + 1, at, at + 1)]
    for level in range(1, ROUNDS + 1):
        out.append(name_pairs(name_runs(out[-1]), level))
    return out


def _sliding_max(x: np.ndarray, width: int) -> np.ndarray:
    """Maximum of every ``width`` consecutive values, by doubling."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        x = np.maximum(x[:-step], x[step:])
        reach += step
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^n, modulo 2^64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Windows:
    """Anchors and hashes of all windows of a batch, in arrays with a barrier on each side of a document."""

    def __init__(self, words: Words, width: int):
        docs = len(words.first) - 1
        barrier = words.first + np.arange(docs + 1)
        total = len(words) + docs + 1
        word = np.ones(total, bool)
        word[barrier] = False
        names = np.empty(total, np.uint64)
        names[word] = words.hashes()
        names[barrier] = mix(np.arange(docs + 1, dtype=np.uint64) + np.uint64(0xDEAD10CC))
        self.doc = np.cumsum(~word) - 1
        self.start = np.arange(total) - barrier[self.doc] - 1
        n = max(total - width + 1, 0)
        last_barrier = np.maximum.accumulate(np.where(word, -1, np.arange(total)))
        self.at = np.flatnonzero(last_barrier[width - 1:] < np.arange(n)) if n else np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        self.hash = np.zeros(0, np.uint64)
        if not len(self.at):
            return
        inverse, power = _powers(_INVERSE, total), _powers(_POWER, total)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(names + _RUN) * inverse[:-1])])
        self.hash = mix((sums[self.at + width] - sums[self.at]) * power[self.at])
        parse = levels(names)
        best = self._choose(parse, total, width)[self.at]
        level = (best >> _LEVEL_SHIFT).astype(np.int64)
        lo = ((np.uint64(1) << _POSITION_BITS) - np.uint64(1) - (best & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))))
        lo = lo.astype(np.int64)
        self.key = np.empty(len(best), np.uint64)
        for number, symbols in enumerate(parse):
            mine = level == number
            i = np.searchsorted(symbols.lo, lo[mine])
            cl, cr = symbols.cl[i], symbols.cr[i]
            inside = (sums[cr] - sums[cl]) * power[cl]
            self.key[mine] = mix(inside ^ mix(symbols.name[i] + np.uint64(number)))
        self.anchor = best

    @staticmethod
    def _choose(parse: list[Symbols], total: int, width: int) -> np.ndarray:
        """For every window start the best symbol whose context lies inside the window."""
        lengths = np.array([x for x in _LENGTHS if x < width] + [width])
        ranked = [np.zeros(total, np.uint64) for _ in lengths]
        low = (np.uint64(1) << _POSITION_BITS) - np.uint64(1)
        for level, s in enumerate(parse):
            context = s.cr - s.cl
            fits = np.flatnonzero((context <= width) & (s.cl >= 0))
            hashed = (mix(s.name[fits] + np.uint64(level)) >> np.uint64(28)) << _POSITION_BITS
            rank = (np.uint64(level) << _LEVEL_SHIFT) | hashed | (low - s.lo[fits].astype(np.uint64))
            kind = np.searchsorted(lengths, context[fits])
            for k in range(len(lengths)):
                mine = kind == k
                # A padded context that would pass the end of the batch is seen by no window anyway.
                np.maximum.at(ranked[k], s.cl[fits[mine]], rank[mine])
        best = np.zeros(total - width + 1, np.uint64)
        for k, length in enumerate(lengths):
            best = np.maximum(best, _sliding_max(ranked[k], width - int(length) + 1)[:len(best)])
        return best


def _counted(docs: DataFrame, width: int) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Windows(find_words(batch.column(0)), width)
            if len(w.at):
                new = np.concatenate([[True], w.anchor[1:] != w.anchor[:-1]])  # an anchor's windows are neighbours
                key, n = np.unique(w.key[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], schema=schema)

    return (docs.select("text").mapInArrow(run, "key bigint, n bigint")
            .groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1"))


def _bit_table(shared: DataFrame) -> np.ndarray:
    """2^BITS bits: one per shared anchor, by its low bits. At most 2^(BITS-6) short rows arrive here."""
    slot = F.col("key").bitwiseAND((1 << BITS) - 1)
    words = (shared.select(F.shiftright(slot, 6).alias("word"),
                           F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(63).cast("int")).alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits"))).toArrow()
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table.view(np.uint64)


def _marked(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = key & np.uint64((1 << BITS) - 1)
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def _firsts(key: np.ndarray, hashes: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows have no equal one with a smaller (doc, start)?"""
    order = np.lexsort((start, doc, hashes, key))
    k, h, d, s = key[order], hashes[order], doc[order], start[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])])
    group = np.cumsum(new) - 1
    lead = np.flatnonzero(new)[group]
    out = np.empty(len(key), bool)
    out[order] = (d == d[lead]) & (s == s[lead])
    return out


_FOUND_ARROW = pa.schema([("route", pa.int64()), ("again", pa.bool_()), ("key", pa.int64()), ("doc_id", pa.int64()),
                          ("sig", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary())])
_FOUND = "route bigint, again boolean, key bigint, doc_id bigint, sig bigint, start int, n int, hashes binary"


def _runs(*same: np.ndarray, start: np.ndarray, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of consecutive starts with equal values of ``same`` begin, and their lengths."""
    new = np.ones(len(start), bool)
    new[1:] = start[1:] != start[:-1] + 1
    for column in same:
        new[1:] |= column[1:] != column[:-1]
    if alone is not None:
        new |= alone
        new[1:] |= alone[:-1]
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(start)))


def _found(route, again, key, doc, sig, start, n, hashes: pa.Array | None = None) -> pa.RecordBatch:
    """Rows of consecutive windows; without hashes they are to be cut."""
    count = len(doc)
    route, key = (np.broadcast_to(x, count).astype(np.uint64).view(np.int64) for x in (route, key))
    again = np.broadcast_to(again, count).astype(bool)
    columns = (route, again, key, doc, sig, start.astype(np.int32), n.astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [*map(pa.array, columns), pa.nulls(count, pa.binary()) if hashes is None else hashes], schema=_FOUND_ARROW)


def _binaries(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Values from each of ``begin`` to the next as one binary value."""
    offsets = (np.append(begin, len(values)) * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [
        None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _candidates(docs: DataFrame, width: int, table, hot) -> DataFrame:
    """Windows of marked anchors. Rows with hashes go on to be compared; rows without hold windows that
    an equal one in the same batch has already beaten. A window of a frequent anchor is a row of its own
    and meets its equals among those of one share of the batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Windows(find_words(batch.column(2)), width)
            if not len(w.at):
                continue
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy()
            sigs = batch.column(1).to_numpy()
            row = w.doc[w.at]
            take = np.flatnonzero(_marked(table.value, w.key) & known[row])
            if not len(take):
                continue
            row, start = row[take], w.start[w.at[take]]
            key, hashes, anchor, doc = w.key[take], w.hash[take], w.anchor[take], ids[row]
            first = _firsts(key, hashes, doc, start)
            lost = np.flatnonzero(~first)
            begin, n = _runs(row[lost], start=start[lost])
            at = lost[begin]
            yield _found(mix(doc[at].astype(np.uint64)), False, 0, doc[at], sigs[row[at]], start[at], n)
            kept = np.flatnonzero(first)
            busy = np.isin(key[kept], hot.value)
            begin, n = _runs(row[kept], anchor[kept], start=start[kept], alone=busy)
            at, again = kept[begin], busy[begin]
            share = mix(sigs[:1].astype(np.uint64)) % np.uint64(SHARES)
            route = np.where(again, mix(hashes[at] ^ mix(share + _RUN)), key[at])
            yield _found(route, again, key[at], doc[at], sigs[row[at]], start[at], n, _binaries(hashes[kept], begin))

    return docs.select("doc_id", F.xxhash64("text").alias("sig"), "text").mapInArrow(run, _FOUND)


def _beaten(candidates: DataFrame, most: int = 500_000) -> DataFrame:
    """Rows without hashes: windows that are not the first of their kind. Rows with hashes: windows that were the
    first in their share, to be compared ``again`` with those of the others. Rows arrive sorted by route; equal
    windows have equal routes, and a batch of whole routes is compared at a time."""

    def resolve(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        key, doc, sig, start, n, again = (
            table[c].to_numpy() for c in ("key", "doc_id", "sig", "start", "n", "again"))
        hashes = np.frombuffer(b"".join(table["hashes"].to_pylist()), np.uint64)
        of = np.repeat(np.arange(len(n)), n)
        begin = np.cumsum(n) - n
        at = start[of] + (np.arange(len(of)) - begin[of])
        first = _firsts(key.view(np.uint64)[of], hashes, doc[of], at)
        lost = np.flatnonzero(~first)
        begin, length = _runs(of[lost], start=at[lost])
        r = of[lost][begin]
        yield _found(0, False, 0, doc[r], sig[r], at[lost][begin], length)
        kept = np.flatnonzero(first & again[of])
        r = of[kept]
        yield _found(mix(hashes[kept]), False, key[r], doc[r], sig[r], start[r], n[r],
                     _binaries(hashes[kept], np.arange(len(kept))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, schema=_FOUND_ARROW)
            yield batch.filter(batch.column("hashes").is_null())
            batch = batch.filter(batch.column("hashes").is_valid())
            if not len(batch):
                continue
            if size > most:
                # Everything up to the last change of route is complete.
                route = batch.column(0).to_numpy()
                change = np.flatnonzero(np.concatenate([[held[-1].column(0)[-1].as_py() != route[0]],
                                                        route[1:] != route[:-1]]))
                if len(change):
                    head, batch = batch.slice(0, change[-1]), batch.slice(change[-1])
                    yield from resolve([*held, head])
                    held, size = [], 0
            held.append(batch)
            size += batch.column("hashes").nbytes // 8
        if held:
            yield from resolve(held)

    return candidates.repartition("route").sortWithinPartitions("route").mapInArrow(run, _FOUND)


def _all_beaten(candidates: DataFrame) -> DataFrame:
    """Runs of windows to be cut: (doc_id, sig, start, n)."""
    judged = written(_beaten(candidates), "cuts")
    done, again = judged.filter("hashes IS NULL"), judged.filter("hashes IS NOT NULL")
    return (done.unionByName(_beaten(again).filter("hashes IS NULL"))
            .select("doc_id", "sig", "start", "n"))


def _cut_text(text: bytes, words: Words, lo: int, hi: int, runs: np.ndarray, width: int) -> tuple[int, bytes]:
    """Number of words covered by runs (start, n) of windows, and the text without them."""
    n = hi - lo
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1] - 1 + width, -1)
    gone = np.cumsum(edge[:-1]) > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    base = words.starts[lo:hi]
    out, at = [], 0
    for a, b in zip(turn[::2], turn[1::2]):
        out.append(text[at:base[a]])
        at = int(base[b]) if b < n else len(text)
    out.append(text[at:])
    return int(gone.sum()), b"".join(out)


def cut_repeats(docs: DataFrame, width: int = 20, into: str = "_cut") -> DataFrame:
    """``docs`` with a struct column: ``n_words``, ``n_removed`` and ``text``, which lacks every word
    covered by a window of ``width`` words that also starts earlier; what stays keeps its white space."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = written(_counted(plain, width), "anchors")
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = shared.filter(F.col("n") > max(HOT_LEAST, total * HOT_SHARE)).select("key").toArrow()["key"].to_numpy()
    table = spark.sparkContext.broadcast(_bit_table(shared))
    busy = spark.sparkContext.broadcast(hot.view(np.uint64))
    sig, windows, cut_doc, cut_sig = (free_name(docs, c) for c in ("_sig", "_windows", "_cut_doc", "_cut_sig"))
    # A run is one number, which a list holds in eight bytes.
    packed = F.shiftleft(F.col("start").cast("bigint"), 32).bitwiseOR(F.col("n").cast("bigint"))
    per_doc = (_all_beaten(_candidates(plain, width, table, busy))
               .groupBy(F.col("doc_id").alias(cut_doc), F.col("sig").alias(cut_sig))
               .agg(F.collect_list(packed).alias(windows)))
    marked = docs.withColumn(sig, F.xxhash64(F.col("text").cast("string")))
    joined = marked.join(per_doc, (F.col("doc_id") == F.col(cut_doc)) & (F.col(sig) == F.col(cut_sig)), "left").select(
        *docs.columns, windows)
    at, where = docs.columns.index("text"), len(docs.columns)
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            words = find_words(texts)
            raw = texts.cast(pa.binary()).to_pylist()
            # Word positions are relative to the batch; a document's own begin at its first byte.
            begin = np.cumsum([0, *[len(t or b"") for t in raw]])
            kept = []
            for i, lists in enumerate(batch.column(where).to_pylist()):
                lo, hi = int(words.first[i]), int(words.first[i + 1])
                if not lists:
                    kept.append((hi - lo, 0, raw[i] or b""))
                    continue
                own = Words(words.data, words.starts[lo:hi] - begin[i], words.ends[lo:hi] - begin[i], words.first)
                packed = np.array(lists, np.int64)
                runs = np.stack([packed >> 32, packed & 0xFFFFFFFF], axis=1)
                kept.append((hi - lo, *_cut_text(raw[i], own, 0, hi - lo, runs, width)))
            columns = zip(*kept) if kept else ([], [], [])
            result = pa.StructArray.from_arrays(
                [pa.array(c, pa.binary()).cast(f.type) if f.name == "text" else pa.array(c, f.type)
                 for c, f in zip(columns, kind)], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[:where], result], names=[*batch.schema.names[:where], into])

    fields = [*docs.schema.fields, T.StructField(into, T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("text", T.StringType())]))]
    return joined.mapInArrow(run, T.StructType(fields))
