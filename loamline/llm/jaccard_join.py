"""N-gram Jaccard self-join by adaptive multi-match prefixes; exact.

A document's set is its distinct shingles of ``width`` words (all words as one shingle when it has
fewer; no words: an empty set that links with nothing). Two sets link when
``100 * intersection >= percent * union``.

Put the tokens of every set in one global order. A set of m tokens shares at least T = ceil(percent m
/ 100) of them with anything it links with, so two linked sets share at least l tokens among the first
``m - T + l`` of either, for every l: the *l-prefix*. A longer prefix costs more rows and in exchange
asks for more shared tokens before a pair is verified. Each document chooses its own l; a pair uses the
smaller of both, which both prefixes cover. The work is done in this order:

- equal sets are one class, found by grouping;
- a first filter in the order of hashes, with l growing with the size: a class goes on only if enough
  tokens of that prefix occur in another row. Copies of a text count as rows here, so that prefixes need not be
  moved to keep one row per class; a class that has only copies drops out at the next step;
- of what is left, document frequencies are counted over the lower half of the hash range, which comes
  first in the order, rare tokens before common ones. Documents too small to be sure of their prefix
  within that half take part with all their tokens;
- each document takes the l with the least estimated cost: rows to join, plus candidates to verify,
  of which there can be at most (rows to join) / l;
- in the list of each token one document, the one with the smallest share of private tokens, is the
  centre; all other members are compared with it on full sets, and links join components;
- what is left are pairs of different components around a common centre. Two linked sets are in one
  list, so both were compared with its centre: what they can share is bounded by the smaller of their
  parts in the centre plus tokens it lacks. Prefixes are therefore taken once more, over the tokens that
  the centre lacks (``near_dups._around``, a general step on compared pairs); of the pairs that share one
  there, or need none, those with at least l tokens in both l-prefixes are verified. Pairs inside a component are never made, so
  a large group of copies costs its size, not its square.

Links are verified on full sets (64-bit shingle hashes). Nothing is capped: every linked pair of
different texts is either verified or inside a component that verified links already join.

Nulls: a null text has no words; rows without a ``doc_id`` link with nothing and get a null component.
Repeated rows get equal results; rows that share a ``doc_id`` but not the text are classes of their
own. Ties do not matter to the result. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm import near_dups
from loamline.llm.blocks import find_words, rolling
from loamline.llm.graphs import components, written

# A first-filter prefix has one more token, and asks for one more, for this many tokens of the set.
STEP = 10
# Verifying a candidate moves two whole sets; this many of their tokens cost as much as one joined row.
VERIFY = 8


def shingles(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a batch."""
    words = find_words(texts, lower=True)
    hashes = words.hashes()
    windows = rolling(hashes, width)
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if lo == hi:
            yield np.zeros(0, np.uint64)
        elif hi - lo < width:
            yield rolling(hashes[lo:hi], hi - lo)
        else:
            yield np.unique(windows[lo:hi - width + 1])


def _key(tokens: np.ndarray) -> bytes | None:
    return hashlib.md5(tokens.tobytes()).digest() if len(tokens) else None


def _shared_at_least(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, class, low): the class names the set, ``low`` is the first filter's prefix. Of equal
    sets in a batch only the first row with an id has one; so the first such row of a class always does."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()),
                        ("low", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingles(batch.column(1), width))
            keys = [_key(s) for s in sets]
            named = batch.column(0).is_valid().to_pylist()
            first = {key: i for i, key in reversed(list(enumerate(keys))) if named[i]}
            low = [s[:len(s) - _shared_at_least(len(s), percent) + 1 + len(s) // STEP if first.get(key) == i else 0]
                   .view(np.int64) for i, (s, key) in enumerate(zip(sets, keys))]
            ends = np.cumsum([0, *map(len, low)]).astype(np.int32)
            flat = np.concatenate(low) if low else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(keys, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], schema=schema)

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, class binary, low array<bigint>")


def whole_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(class, m, half, shingles, some): all tokens in one value, how many lie in the lower half of the hash range (top bit
    clear), and those that take part in counting: that half, or all where the half may not hold the prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                rows = []
                for s in shingles(batch.column(1).slice(lo, 64), width):
                    half = int(np.searchsorted(s, np.uint64(1 << 63)))
                    sure = half >= len(s) - _shared_at_least(len(s), percent) + 1 + len(s) // STEP
                    tokens = s.view(np.int64)
                    rows.append((_key(s), len(s), half, s.tobytes(), tokens[:half] if sure else tokens))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.binary(),
                                                                pa.list_(pa.int64())))],
                    names=["class", "m", "half", "shingles", "some"])

    return docs.mapInArrow(run, "class binary, m bigint, half bigint, shingles binary, some array<bigint>")


def choose_prefix(tokens: np.ndarray, df: np.ndarray, m: int, half: int, taken: int, percent: int
                  ) -> tuple[int, np.ndarray, np.ndarray]:
    """(l, tokens, levels) of one set, from its shared tokens and their document frequencies; ``taken`` of its
    tokens were counted. A token's level is the smallest l whose prefix holds it."""
    upper = tokens < 0
    order = np.lexsort((tokens, df, upper))
    tokens, df, upper = tokens[order], df[order], upper[order]
    low = int(np.count_nonzero(~upper))
    # Tokens that nobody shares come first in each half.
    place = np.arange(len(tokens)) + np.where(upper, m - len(tokens), half - low)
    base = m - _shared_at_least(m, percent)
    level = np.maximum(place - base + 1, 1)
    within = level <= taken - base
    tokens, df, level = tokens[within], df[within], level[within]
    if not len(level) or level[0] > 1:
        return 0, tokens[:0], level[:0]
    last = np.append(level[1:] != level[:-1], True)
    ell = level[last]
    rows = np.cumsum(df - 1)[last]
    best = int(np.argmin(rows * (1 + m / (VERIFY * ell))))
    kept = level <= ell[best]
    return int(ell[best]), tokens[kept], level[kept]


def prefixes(counted: DataFrame, percent: int) -> DataFrame:
    """(token, node, m, ell, level, private) of every document's prefix, from (node, m, half, taken, shared)."""
    names = ["token", "node", "m", "ell", "level", "private"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            lists = batch.column(4)
            values, ends = lists.flatten(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(False)))
            token, df = (values.field(i).to_numpy(False) for i in (0, 1))
            for i, (node, m, half, taken) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(4)])):
                at = slice(int(ends[i]), int(ends[i + 1]))
                ell, kept, level = choose_prefix(token[at], df[at], m, half, taken, percent)
                n = len(kept)
                out.append((kept, np.full(n, node), np.full(n, m), np.full(n, ell), level,
                            np.full(n, 1 - (at.stop - at.start) / taken)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(np.float64 if name == "private" else np.int64))
                     for name, c in zip(names, zip(*out))], names=names)

    return counted.mapInArrow(run, "token bigint, node bigint, m bigint, ell bigint, level bigint, private double")


def _stars(posts: DataFrame) -> DataFrame:
    """(x, c): members of a token's list with the centre of that list."""
    centre = posts.groupBy("token").agg(F.min(F.struct("private", "m", "node"))["node"].alias("c"), F.count("*").alias("n"))
    met = posts.join(centre.filter("n > 1"), "token").filter(F.col("node") != F.col("c"))
    return met.select(F.col("node").alias("x"), "c").distinct()


def _matched(pairs: DataFrame, posts: DataFrame) -> DataFrame:
    """Pairs (x, c) that share as many prefix tokens as the smaller of their l asks for."""
    mine = pairs.join(posts.withColumnRenamed("node", "x").alias("p"), "x")
    met = mine.join(posts.withColumnRenamed("node", "c").alias("q"), ["c", "token"]).filter(
        F.greatest("p.level", "q.level") <= F.least("p.ell", "q.ell"))
    counted = met.groupBy("x", "c").agg(F.count("*").alias("met"), F.max(F.least("p.ell", "q.ell")).alias("asked"))
    return counted.filter("met >= asked").select("x", "c")


def linked_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text"))
    sketch = written(sketches(docs, width, percent).withColumn("row", F.monotonically_increasing_id()), "sketches")

    # One row stands for its class; its number is the node of the graph.
    classes = written(sketch.filter("class IS NOT NULL AND doc_id IS NOT NULL").groupBy("class").agg(
        F.min("row").alias("node"), F.min_by("doc_id", "row").alias("reader"), F.min("doc_id").alias("least"),
        F.max("n_shingles").alias("m")), "classes")

    low = sketch.filter("doc_id IS NOT NULL").select(F.col("row").alias("node"), F.explode("low").alias("token"))
    common = low.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token")
    hits = low.join(common, "token", "left_semi").groupBy("node").agg(F.count("*").alias("hits"))
    # A partner has at least T tokens, so its prefix asks for at least this many.
    least = F.lit(1) + F.floor(F.ceil(F.col("m") * percent / 100) / STEP)
    alive = written(classes.join(hits, "node").filter(F.col("hits") >= least).select("node", "class", "reader"), "alive")

    texts = docs.join(alive.select(F.col("reader").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = written(whole_sets(texts, width, percent).join(alive.select("node", "class"), "class").drop("class")
                   .dropDuplicates(["node"]), "sets")
    some = sets.select("node", F.explode("some").alias("token"))
    df = some.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    shared = some.join(df, "token").groupBy("node").agg(F.collect_list(F.struct("token", "df")).alias("shared"))
    counted = shared.join(sets.select("node", "m", "half", F.size("some").cast("bigint").alias("taken")), "node")
    posts = written(prefixes(counted.select("node", "m", "half", "taken", "shared"), percent), "prefixes")

    by_node = sets.select(F.col("node").alias("doc_id"), "shingles")
    compared = written(near_dups._compare(written(_stars(posts), "stars"), by_node, private=True), "compared")
    hit = near_dups._similar(percent, F.col("both"), F.col("m") + F.col("n"))
    links = compared.filter(hit).select(F.col("x").alias("u"), F.col("c").alias("v"))
    labels = components(links, "u", "v")
    rest = near_dups._around(compared, labels, percent)
    if not rest.isEmpty():
        more = near_dups._compare(_matched(rest, posts), by_node, private=False).filter(hit).select(F.col("x").alias("u"), F.col("c").alias("v"))
        labels = components(more.union(labels.select("component", "node")), "u", "v")

    # From nodes to documents: the smallest id of any class in the component.
    of = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = of.groupBy("component").agg(F.min("least").alias("_component"))
    of_class = written(of.join(smallest, "component").select("class", "_component"), "of_class")
    return sketch.select("doc_id", "n_shingles", "class").join(of_class, "class", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id"))
