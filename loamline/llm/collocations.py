"""Phrase collocations counted over a prefix-free parse; exact.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words
``[^\\x20\\x09]+``. Everything is per language. A phrase of two or more words is scored by how often it
occurs against how often its two parts do, at the cut where that ratio is lowest.

The parse: a window of ``longest - 1`` words whose hash is 0 modulo ``period`` is a *trigger*, and a chunk
reaches from one trigger to the end of the next, so neighbours overlap by one window and equal passages
give equal chunks wherever they stand. (A stretch without triggers is cut after ``_REACH`` words, counted
from its own beginning.) Distinct chunks are the dictionary, with the number of times the parse uses each.
An n-gram belongs to the chunk that *owns* its first word; the words of the overlap are owned by the chunk
that begins with them, so every occurrence counts once. Counts are taken inside distinct chunks, weighted
with the frequency of the chunk.

Counting goes up by length. A phrase cannot occur more often than its parts, so an n-gram is only counted
where both its (n-1)-grams are frequent; a bit table of the frequent ones tells most places where they are
not. The table takes 16 bits a key up to ``_BITS`` bits, which bounds it to 16 MB; beyond that it lets more
n-grams through, which are counted and dropped. Keys are 128-bit hashes of the words and the language.

Null texts read as empty, null languages as ``und``. Repeated rows count each. Ties in score and count are
ordered by phrase. A text of any length is one row of an Arrow batch, its chunks leave in slices. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamline.llm.blocks import LOWER, Words, find_words, mix, raw_bytes, rolling
from loamline.llm.graphs import written

PERIOD = 16
_REACH = 64
_BITS = 1 << 27
# Bytes of chunks that are counted together before anything leaves the worker.
_BLOCK = 12 << 20
_SLICE = 1 << 16

# Separators of pieces become line feeds; all other bytes keep their class.
_SPLIT = LOWER.copy()
_SPLIT[list(b".,;:!?\x0b\x0c\r")] = 0x0A


def _pieces(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of the texts and, for each, whether a piece begins with it."""
    data, at = raw_bytes(texts)
    data = _SPLIT[data]
    flat = pa.Array.from_buffers(pa.large_string(), len(texts),
                                 [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data)])
    words = find_words(flat)
    breaks = np.cumsum(data == 0x0A, dtype=np.int64)
    place = breaks[words.starts] if len(words) else np.zeros(0, np.int64)
    begins = np.ones(len(words), bool)
    begins[1:] = place[1:] != place[:-1]
    begins[words.first[:-1][words.first[:-1] < len(words)]] = True
    return words, begins


def _cuts(words: Words, begins: np.ndarray, window: int, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, owned) of every chunk, in words."""
    total = len(words)
    heads = np.flatnonzero(begins)
    stops = np.append(heads[1:], total)
    piece_end = np.repeat(stops, stops - heads)
    starts = begins.copy()
    triggers = rolling(words.hashes(), window) % np.uint64(period) == 0
    at = np.flatnonzero(triggers)
    starts[at[at + window <= piece_end[at]]] = True
    first = np.flatnonzero(starts)
    length = np.diff(np.append(first, total))
    parts = -(-length // _REACH)
    start = np.repeat(first, parts) + _REACH * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    after = np.append(start[1:], total)
    return start, np.minimum(after + window, piece_end[start]), np.minimum(after, piece_end[start]) - start


def _spelled(words: Words, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Runs of words as texts, one space between words."""
    count = stop - start
    word = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
    size = words.ends[word] - words.starts[word] + 1
    ends = np.cumsum(size)
    index = np.repeat(words.starts[word] - (ends - size), size) + np.arange(ends[-1])
    spaces = ends - 1
    index[spaces] = 0
    flat = words.data[index]
    flat[spaces] = 0x20
    # The space behind a run is not part of it.
    last = np.cumsum(count) - 1
    keep = np.ones(len(flat), bool)
    keep[spaces[last]] = False
    offsets = np.append(0, ends[last] - np.arange(1, len(last) + 1)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets.tobytes()),
                                                           pa.py_buffer(flat[keep].tobytes())])


def parse(docs: DataFrame, longest: int, period: int = PERIOD) -> DataFrame:
    """(lang, chunk, owned): the parse of every text, a row per chunk; ``owned`` words count as beginnings."""
    schema = pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("owned", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, begins = _pieces(batch.column(1))
            if not len(words):
                continue
            start, stop, owned = _cuts(words, begins, longest - 1, period)
            doc = np.searchsorted(words.first, start, side="right") - 1
            for lo in range(0, len(start), _SLICE):
                some = slice(lo, lo + _SLICE)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc[some])), _spelled(words, start[some], stop[some]),
                     pa.array(owned[some].astype(np.int32))], schema=schema)

    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "lang string, chunk string, owned int")


def dictionary(docs: DataFrame, longest: int, period: int = PERIOD) -> DataFrame:
    """(id, lang, chunk, owned, uses): distinct chunks and how often the parse uses them."""
    found = parse(docs, longest, period).groupBy("lang", "chunk", "owned").agg(F.count("*").alias("uses"))
    return written(found.select(F.monotonically_increasing_id().alias("id"), "*"), "chunks")


class _Keys:
    """128-bit keys of n-grams in a block of chunks, as two arrays by position of the first word."""

    def __init__(self, langs: pa.Array, chunks: pa.Array):
        self.words = find_words(chunks)
        self._one = self.words.hashes()
        self._two = replace(self.words, data=self.words.data ^ np.uint8(0xA5)).hashes()
        named = langs.dictionary_encode()
        seeds = [hashlib.md5(name.encode("utf-8", "surrogatepass")).digest() for name in named.dictionary.to_pylist()]
        seed = np.frombuffer(b"".join(seeds), np.uint64).reshape(-1, 2)[named.indices.to_numpy(False)]
        per_word = np.repeat(np.arange(len(chunks)), np.diff(self.words.first))
        self._seed = seed[per_word]

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = rolling(self._one, n), rolling(self._two * np.uint64(0xC2B2AE3D27D4EB4F), n)
        return mix(a ^ self._seed[:len(a), 0]), mix(b ^ self._seed[:len(b), 1])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= _BLOCK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def _probes(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return a & mask, b & mask


def _member(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = _probes(a, b, len(table) * 64)
    six, low = np.uint64(6), np.uint64(63)
    return ((table[x >> six] >> (x & low)) & (table[y >> six] >> (y & low)) & np.uint64(1)).astype(bool)


def bit_table(keys: DataFrame) -> np.ndarray:
    """Two bits for each key (a, b), in a table of 16 bits a key, ``_BITS`` at most."""
    bits = 1 << 12
    while bits < 16 * keys.count() and bits < _BITS:
        bits <<= 1
    probe = keys.select(F.explode(F.array(F.col("a").bitwiseAND(bits - 1), F.col("b").bitwiseAND(bits - 1))).alias("bit"))
    rows = probe.groupBy((F.shiftright("bit", 6)).alias("slot")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("word")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    if rows.num_rows:
        table[rows.column("slot").to_numpy()] = rows.column("word").to_numpy().view(np.uint64)
    return table


def count_level(chunks: DataFrame, n: int, least: int, frequent: np.ndarray | None) -> DataFrame:
    """(a, b, f, id) of the n-grams that occur ``least`` times; ``id`` is a chunk that owns one."""
    spark = chunks.sparkSession
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("f", pa.int64()), ("id", pa.int64())])
    sent = None if frequent is None else spark.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            keys = _Keys(_column(table, "lang"), _column(table, "chunk"))
            first, total = keys.words.first, len(keys.words)
            size = np.diff(first)
            owned = np.minimum(_column(table, "owned").to_numpy(), size - n + 1)
            owned = np.maximum(owned, 0)
            row = np.repeat(np.arange(len(size)), owned)
            at = np.repeat(first[:-1] - (np.cumsum(owned) - owned), owned) + np.arange(owned.sum())
            if not len(at):
                continue
            if sent is not None:
                a, b = keys.of(n - 1)
                known = np.zeros(total + 1, bool)
                known[:len(a)] = _member(sent.value, a, b)
                both = known[at] & known[at + 1]
                row, at = row[both], at[both]
            a, b = (k[at] for k in keys.of(n))
            order = np.argsort(a, kind="stable")
            a, b, row = a[order], b[order], row[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            lead = np.flatnonzero(new)
            if len(lead):
                uses, ids = _column(table, "uses").to_numpy(), _column(table, "id").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[lead].view(np.int64)), pa.array(b[lead].view(np.int64)),
                     pa.array(np.add.reduceat(uses[row], lead)), pa.array(ids[row[lead]])], schema=schema)

    rows = chunks.mapInArrow(run, "a bigint, b bigint, f bigint, id bigint")
    return rows.groupBy("a", "b").agg(F.sum("f").alias("f"), F.min("id").alias("id")).filter(F.col("f") >= least)


_PHRASES = ("lang string, phrase string, a bigint, b bigint, f bigint, "
            "cuts array<struct<k:int,la:bigint,lb:bigint,ra:bigint,rb:bigint>>, inner array<struct<a:bigint,b:bigint>>")


def spell(chunks: DataFrame, candidates: DataFrame, shortest: int, longest: int) -> DataFrame:
    """Words and parts of the candidates (a, b, f, id), read from the chunk that each one names."""
    cut = pa.struct([("k", pa.int32()), *[(c, pa.int64()) for c in ("la", "lb", "ra", "rb")]])
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), *[(c, pa.int64()) for c in "abf"],
                        ("cuts", pa.list_(cut)), ("inner", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts, wanted = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            keys = _Keys(langs, texts)
            levels = {n: [k.view(np.int64).tolist() for k in keys.of(n)] for n in range(1, longest + 1)}
            first = keys.words.first.tolist()
            rows = []

            def key(at: int, n: int) -> tuple[int, int]:
                return levels[n][0][at], levels[n][1][at]

            for i, lang in enumerate(langs.to_pylist()):
                place = {key(at, n): (at, n) for n in range(2, longest + 1) for at in range(first[i], first[i + 1] - n + 1)}
                for found in wanted[i]:
                    at, n = place[found["a"], found["b"]]
                    phrase = b" ".join(keys.words.text(w) for w in range(at, at + n)).decode("utf-8", "surrogatepass")
                    cuts = [dict(zip(("k", "la", "lb", "ra", "rb"), (k, *key(at, k), *key(at + k, n - k)))) for k in range(1, n)]
                    inner = {key(at + j, m) for m in range(shortest, n) for j in range(n - m + 1)}
                    rows.append((lang, phrase, found["a"], found["b"], found["f"], cuts,
                                 [{"a": x, "b": y} for x, y in inner]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    by_chunk = candidates.groupBy("id").agg(F.collect_list(F.struct("a", "b", "f")).alias("wanted"))
    return chunks.join(by_chunk, "id").select("lang", "chunk", "wanted").mapInArrow(run, _PHRASES)


def _scored(phrases: DataFrame) -> DataFrame:
    """The lowest cut of each phrase. Products go beyond 64 bits, so whole numbers of any size are used."""
    names = ["lang", "phrase", "ka", "kb", "a", "l", "r", "score"]
    types = [pa.string(), pa.string(), *[pa.int64()] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, phrase, ka, kb, f, cuts in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                score, _, l, r = min((1_000_000 * f * f // (c["l"] * c["r"]), c["k"], c["l"], c["r"]) for c in cuts)
                rows.append((lang, phrase, ka, kb, f, l, r, score))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return phrases.mapInArrow(run, "lang string, phrase string, ka bigint, kb bigint, a bigint, l bigint, r bigint, score bigint")


def mine(docs: DataFrame, shortest: int = 2, longest: int = 3, least: int = 10, cover: int = 50, first: int = 2000,
         period: int = PERIOD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases of ``shortest`` to ``longest``
    words that occur ``least`` times, without those that lie inside a longer one with ``cover`` percent of
    their occurrences."""
    if not 2 <= shortest <= longest:
        raise ValueError("phrases have at least two words")
    chunks = dictionary(docs, longest, period)
    levels, table = [], None
    for n in range(1, longest + 1):
        level = written(count_level(chunks, n, least, table), f"grams-{n}")
        levels.append(level)
        if n < longest:
            table = bit_table(level)

    candidates = levels[shortest - 1]
    for level in levels[shortest:]:
        candidates = candidates.union(level)
    phrases = written(spell(chunks, candidates, shortest, longest), "phrases")

    every = levels[0]
    for level in levels[1:longest - 1]:
        every = every.union(level)
    part = every.select("a", "b", "f")
    left = part.select(F.col("a").alias("la"), F.col("b").alias("lb"), F.col("f").alias("l"))
    right = part.select(F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("f").alias("r"))
    cuts = phrases.select("lang", "phrase", "a", "b", "f", F.inline("cuts")).join(left, ["la", "lb"]).join(right, ["ra", "rb"])
    whole = cuts.groupBy("lang", "phrase", "a", "b", "f").agg(F.collect_list(F.struct("k", "l", "r")).alias("cuts"))
    scored = _scored(whole)

    within = phrases.select(F.col("f").alias("longer"), F.inline("inner").alias("ka", "kb")).groupBy("ka", "kb").agg(
        F.max("longer").alias("longer"))
    kept = scored.join(within, ["ka", "kb"], "left").filter(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(cover) * F.col("a")))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    words = chunks.groupBy("lang").agg(F.sum(F.col("owned") * F.col("uses")).alias("n"))
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
