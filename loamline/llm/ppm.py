"""Text probability by partial matching: a byte-context trie, escapes, symbol exclusion.

The model counts which byte follows each context of up to ``ORDER`` bytes in the training texts. A
byte is coded in the longest context that has been seen; if it never followed there, an escape is
coded (method C: as probable as the number of distinct followers) and the next shorter context is
tried, without the bytes that the longer one has already ruled out. Below the empty context all bytes
not yet ruled out are equally probable. A text ends with a symbol of its own; probabilities of all
texts add up to one. Letters A-Z are read as a-z.

All counts come from counting (context, byte) strings over the corpus. Up to ``SHARD`` distinct strings,
the model is broadcast. Beyond that it stays a Spark table, cut by the last three context bytes (two, if the
corpus has more than ``PART`` strings of three bytes): a part has everything about contexts of that length and
more, and the shorter ones are broadcast. A task holds one part, and neither driver nor task the model. The most frequent strings, ``SHARD``
at most, are costed once and broadcast; only the others are sent from the documents to the part that knows
what they cost. Of the words, the most frequent ``HEAD`` are broadcast, the others are joined.

Null texts are empty, and an empty text is its end symbol. Rows without a ``doc_id`` train nothing and
are not held out. Repeated rows count as often as they occur and get equal scores. Without training
texts every byte has the same probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.blocks import LOWER, Words, find_words, raw_bytes
from loamline.llm.graphs import written

ORDER = 5
SHARD = 4_000_000
HEAD = 1 << 18
CHUNK = 1 << 20
# Strings of a part of a model that stays a table, about; and strings whose costs are looked up at a time.
PART = 1 << 19
ASKED = 1 << 17
# Bytes that UTF-8 never uses: before the first byte of a text, and after the last.
START, END = 0xFE, 0xFF
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def held_out(doc_id: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


class Table:
    """64-bit keys to positions, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self._shift = np.uint64(64 - bits)
        self._mask = (1 << bits) - 1
        self._keys = np.full(1 << bits, _FREE, np.uint64)
        self._where = np.zeros(1 << bits, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self._keys[slot] == _FREE
            self._keys[slot[free]] = keys[left[free]]
            done = self._keys[slot] == keys[left]
            self._where[slot[done]] = left[done]
            left, slot = left[~done], (slot[~done] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys, -1 for those that are absent."""
        slot = self._slot(keys)
        there = self._keys[slot]
        out = np.where(there == keys, self._where[slot], -1)
        left = np.flatnonzero((there != keys) & (there != _FREE))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self._mask
            there = self._keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self._where[slot[hit]]
            go = ~hit & (there != _FREE)
            left, slot = left[go], slot[go]
        return out


class Level:
    """Contexts of one length: log10 counts per (context, byte), and per context what an escape costs
    and what counts are divided by."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.codes, self.counts = codes, counts
        context = codes >> np.uint64(8)
        begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(codes) else np.zeros(0, int)
        self.context = context[begin]
        self.of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(codes))))
        self.total = np.bincount(self.of, counts, len(begin)) if len(codes) else np.zeros(0)
        self.kinds = np.bincount(self.of, minlength=len(begin)).astype(float) if len(codes) else np.zeros(0)
        self.symbol = Table(codes)
        self.node = Table(self.context)
        self.log_count = np.log10(counts.astype(float))
        self.log_norm = np.log10(self.total + self.kinds)
        self.log_escape = np.log10(self.kinds) - self.log_norm

    def exclude(self, longer: Level, mask: np.uint64) -> None:
        """Costs in this level after an escape from each context of the longer one."""
        at = self.symbol.find(longer.codes & mask)
        home = self.node.find(longer.context & (mask >> np.uint64(8)))
        total = self.total[home] - np.bincount(longer.of, self.counts[at], len(longer.context))
        kinds = self.kinds[home] - longer.kinds
        some = kinds > 0
        longer.then_norm = np.log10(np.where(some, total + kinds, 1.0))
        longer.then_escape = np.where(some, np.log10(np.where(some, kinds, 1.0)) - longer.then_norm, 0.0)


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << (8 * size)) - 1)


class Model:
    """A trie, or a part of one. ``codes`` are strings of ORDER context bytes and a byte, ``short`` those of
    fewer than ``cut`` context bytes."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, short: np.ndarray, short_counts: np.ndarray, cut: int = 2):
        self.levels: list[Level] = []
        for size in range(ORDER + 1):
            source, n = (codes, counts) if size >= cut else (short, short_counts)
            key, at = np.unique(source & _mask(size + 1), return_inverse=True)
            self.levels.append(Level(key, np.bincount(at, n, len(key)).astype(np.int64)))
        for size in range(ORDER):
            self.levels[size].exclude(self.levels[size + 1], _mask(size + 1))
        self.rest = 256 - (self.levels[0].kinds[0] if len(self.levels[0].kinds) else 0)
        for level in self.levels:
            del level.codes, level.counts, level.context, level.total, level.kinds

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each byte after its context."""
        out = np.zeros(len(codes))
        left = np.arange(len(codes))
        came = np.full(len(codes), -1)  # context of the longer level that was escaped from
        for size in range(ORDER, -1, -1):
            level = self.levels[size]
            longer = self.levels[size + 1] if size < ORDER else None
            code = codes[left] & _mask(size + 1)
            at = level.symbol.find(code)
            escaped = came >= 0
            hit = at >= 0
            if hit.any():
                i = at[hit]
                norm = level.log_norm[level.of[i]]
                if longer is not None and escaped.any():
                    norm = np.where(escaped[hit], longer.then_norm[came[hit]], norm)
                out[left[hit]] += level.log_count[i] - norm
            miss = ~hit
            left, code, came, escaped = left[miss], code[miss], came[miss], escaped[miss]
            if not len(left):
                return out
            node = level.node.find(code >> np.uint64(8))
            cost = np.where(node >= 0, level.log_escape[node] if len(level.log_escape) else 0.0, 0.0)
            if longer is not None and escaped.any():
                cost = np.where(escaped, longer.then_escape[came], cost)
            out[left] += cost
            came = node
        out[left] -= np.log10(max(self.rest, 1))
        return out


class Known:
    """Costs of some strings."""

    def __init__(self, codes: np.ndarray, costs: np.ndarray):
        self.where, self.costs = Table(codes), np.append(costs, np.nan)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """Costs of the codes, NaN for those that are absent."""
        return self.costs[self.where.find(codes)]


_made: list = [None, None]


def _once(shared, make: Callable):
    """``make`` of a broadcast's values, kept by the worker for the tasks that follow."""
    if _made[0] is not shared:
        _made[:] = None, None
        _made[:] = shared, make(*shared.value)
    return _made[1]


def _strings(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, document) of all positions of a batch, in chunks: each byte of a text and its end, after
    ORDER bytes of context."""
    data, at = raw_bytes(texts)
    size = np.diff(at)
    docs = len(size)
    begin = at[:-1] + np.arange(docs) * (ORDER + 1)
    flat = np.full(len(data) + docs * (ORDER + 1), START, np.uint8)
    of_byte = np.repeat(np.arange(docs), size)
    flat[np.arange(len(data)) + (of_byte + 1) * ORDER + of_byte] = LOWER[data]
    flat[begin + ORDER + size] = END
    steps = size + 1  # positions per document
    first = np.concatenate([[0], np.cumsum(steps)])
    for lo in range(0, int(first[-1]), CHUNK):
        position = np.arange(lo, min(lo + CHUNK, int(first[-1])))
        doc = np.searchsorted(first, position, "right") - 1
        where = position + doc * ORDER
        code = np.zeros(len(where), np.uint64)
        for i in range(ORDER + 1):
            code = (code << np.uint64(8)) | flat[where + i]
        yield code, doc


def _byte_strings(train: DataFrame) -> DataFrame:
    schema = pa.schema([("code", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for code, _ in _strings(batch.column(0)):
                key, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], schema=schema)

    return train.select("text").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def _word_array(words: Words, at: np.ndarray) -> pa.Array:
    return pa.array([words.text(i) for i in at.tolist()], pa.binary())


def _words(train: DataFrame) -> DataFrame:
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = find_words(batch.column(0), lower=True)
            _, at, n = np.unique(words.hashes(), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([_word_array(words, at), pa.array(n, pa.int64())], schema=schema)

    return train.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _head(words: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words: at most ``size`` rows."""
    top = words.orderBy(F.desc("n"), "word").limit(size).toArrow()
    found = find_words(top["word"].combine_chunks().cast(pa.string()) if top.num_rows else pa.array([], pa.string()))
    return found.hashes(), top["n"].to_numpy()


def _collected(strings: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = strings.toArrow()
    code, n = rows["code"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(code)
    return code[order], n[order]


def _model(strings: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All strings in order, and their counts."""
    return _collected(strings)


def _shortest(strings: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Strings of fewer context bytes than a model is cut by, their counts, and that number of bytes."""
    for cut in (3, 2):
        short = strings.groupBy(F.col("code").bitwiseAND(int(_mask(cut))).alias("code")).agg(F.sum("n").alias("n"))
        if cut == 2 or short.count() <= PART:
            return *_collected(short), cut


def _frequent(strings: DataFrame, size: int) -> DataFrame:
    """The most frequent strings: at most ``size`` rows, and all of a count or none."""
    rows = strings.groupBy("n").agg(F.count("*").alias("kinds")).toArrow()
    n, kinds = rows["n"].to_numpy(), rows["kinds"].to_numpy()
    order = np.argsort(-n)
    fits = np.cumsum(kinds[order]) <= size
    return strings.filter(F.col("n") >= (int(n[order][fits][-1]) if fits.any() else int(n.max()) + 1))


def _costs(strings: DataFrame, asked: DataFrame, short, cut: int, parts: int) -> DataFrame:
    """(row, score): what the strings of each row of ``asked`` (row, code, n) cost together.

    Strings of the model and those asked for meet by their last ``cut`` context bytes. In a task the model comes
    first, as the rows are sorted, and the others stream past it.
    """
    schema = pa.schema([("row", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _made[:] = None, None
        model, held, size = None, [], 0

        def answer() -> pa.RecordBatch:
            row, code, n = map(np.concatenate, zip(*held))
            key, at = np.unique(row, return_inverse=True)
            score = np.bincount(at, n * model.log10(code.view(np.uint64)), len(key))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(score)], schema=schema)

        mine = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for batch in batches:
            row, code, n = (batch.column(i) for i in range(3))
            begin = row.null_count
            if begin:
                mine.append((code[:begin].to_numpy(), n[:begin].to_numpy()))
            if begin == len(row):
                continue
            if model is None:
                codes, counts = map(np.concatenate, zip(*mine))
                model, mine = Model(codes.view(np.uint64), counts, *short.value, cut), None
            held.append((row[begin:].to_numpy(), code[begin:].to_numpy(), n[begin:].to_numpy()))
            size += len(row) - begin
            if size >= ASKED:
                yield answer()
                held, size = [], 0
        if held:
            yield answer()

    both = strings.select(F.lit(None).cast("bigint").alias("row"), "code", "n").unionByName(asked.select("row", "code", "n"))
    dealt = both.repartition(parts, F.shiftrightunsigned("code", 8).bitwiseAND(int(_mask(cut))))
    return dealt.sortWithinPartitions(F.col("row").isNotNull()).mapInArrow(run, "row bigint, score double").groupBy("row").agg(
        F.sum("score").alias("score"))


def _cost_arrays(costs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = costs.toArrow()
    return rows["row"].to_numpy().view(np.uint64), rows["score"].to_numpy()


def _whole(codes: np.ndarray, counts: np.ndarray) -> Model:
    short, at = np.unique(codes & _mask(2), return_inverse=True)
    return Model(codes, counts, short, np.bincount(at, counts, len(short)).astype(np.int64))


_SCORED = ("row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, "
           "tail array<struct<word:binary,n:bigint>>, rest array<struct<code:bigint,n:bigint>>")


def _counted(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by document and key, and where in it another key or document begins, with the end."""
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(order) else order
    return order, np.append(new, len(order))


def _lists(doc: np.ndarray, docs: int, fields: dict[str, pa.Array]) -> pa.Array:
    """A list of structs per document; ``doc`` is in order."""
    edges = np.searchsorted(doc, np.arange(docs + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))


def _scored(docs: DataFrame, trie, make: Callable, head, denominator: float, end_count: int) -> DataFrame:
    tail_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
    rest_type = pa.list_(pa.struct([("code", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = head.value
        frequent = Table(hashes)
        known = np.log10((counts + 1) / denominator) if len(counts) else np.zeros(0)
        model = _once(trie, make)
        for batch in batches:
            texts = batch.column(2)
            docs_here = len(texts)
            score = np.zeros(docs_here)
            rest = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for code, doc in _strings(texts):
                cost = model.log10(code)
                left = np.flatnonzero(np.isnan(cost))
                cost[left] = 0.0
                score += np.bincount(doc, cost, docs_here)
                if len(left):
                    order, new = _counted(code[left], doc[left])
                    at = left[order[new[:-1]]]
                    rest.append((doc[at], code[at].view(np.int64), np.diff(new)))
            of_rest, rest_code, rest_n = map(np.concatenate, zip(*rest))
            words = find_words(texts, lower=True)
            of = words.doc_of_word()
            hashed = words.hashes()
            at = frequent.find(hashed)
            hit = at >= 0
            n_known = np.bincount(of[hit], minlength=docs_here) + (end_count > 0)
            base = np.bincount(of[hit], known[at[hit]], docs_here) + np.log10((end_count + 1) / denominator)
            rare = np.flatnonzero(~hit)
            order, new = _counted(hashed[rare], of[rare])
            first = rare[order[new[:-1]]]
            tail = _lists(of[first], docs_here, {"word": _word_array(words, first), "n": pa.array(np.diff(new), pa.int64())})
            more = _lists(of_rest, docs_here, {"code": pa.array(rest_code), "n": pa.array(rest_n, pa.int64())})
            yield pa.RecordBatch.from_arrays([
                batch.column(3), batch.column(0), batch.column(1), pa.array(np.diff(words.first) + 1, pa.int64()),
                pa.array(n_known, pa.int64()), pa.array(base), pa.array(score), tail.cast(tail_type), more.cast(rest_type)],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail", "rest"])

    return docs.mapInArrow(run, _SCORED)


def score_texts(docs: DataFrame, shard: int = SHARD, head: int = HEAD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the model's score and a unigram baseline, both log10. A model
    of more than ``shard`` strings stays a table; so many strings at most are broadcast with their costs."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    train = rows.filter(~F.col("held_out") & F.col("doc_id").isNotNull())
    strings = written(_byte_strings(train), "strings")
    words = written(_words(train), "words")
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = train.count()
    tokens, kinds = tokens + ends, kinds + (ends > 0)
    denominator = float(tokens + kinds + 1)
    share = spark.sparkContext.broadcast
    kinds_of_strings = strings.count()
    if kinds_of_strings <= shard:
        trie, make = share(_model(strings)), _whole
    else:
        *low, cut = _shortest(strings)
        short = share(tuple(low))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kinds_of_strings // PART))
        wanted = _frequent(strings, shard).select("code", F.col("code").alias("row"), F.lit(1).cast("bigint").alias("n"))
        trie, make = share(_cost_arrays(_costs(strings, wanted, short, cut, parts))), Known
    scored = written(_scored(rows, trie, make, share(_head(words, head)), denominator, ends), "scored")
    if kinds_of_strings > shard:
        rest = _costs(strings, scored.select("row", F.inline("rest")), short, cut, parts)
        scored = scored.join(rest.withColumnRenamed("score", "more"), "row", "left").withColumn(
            "score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    rare = scored.select("row", F.inline("tail")).join(
        words.select(F.col("word").alias("_w"), F.col("n").alias("c")), F.col("word") == F.col("_w"), "left")
    seen = F.coalesce("c", F.lit(0))
    per_row = rare.groupBy("row").agg(
        F.sum(F.when(seen > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10((seen + 1) / F.lit(denominator))).alias("more_base"))
    return scored.join(per_row, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score")
