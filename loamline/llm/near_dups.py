"""Near duplicates by min-max hashing.

A document's set is its distinct shingles of ``width`` words (all words as one shingle when it has
fewer; no words: an empty set that links with nothing). Each hash function gives two values, the
minimum *and* the maximum over the set; both agree between two sets with a probability equal to their
similarity, so half the evaluations fill the same signature. Bands of ``rows`` values propose
candidates; a link is confirmed on the full sets.

Two documents at the threshold 0.75 share no band with probability (1 - 0.75^4)^32 < 6e-6; above it
the figure falls fast. The rest is exact:

- documents with equal word sequences are one class, found by grouping, not by pairs;
- in every bucket all members are compared with its *centre*, the member that meets most others in
  all its buckets: in a group of edited copies that is the original or the copy nearest to it. Links
  join components;
- what is left are pairs of different components around a common centre. Of these only pairs that
  share a shingle which the centre lacks, or whose sizes allow it without one, can be similar
  (``_around``); all of them are compared. Pairs inside a component are never made.

Rows without a ``doc_id`` link with nothing and are kept. Repeated rows get equal results; where one
``doc_id`` has several texts, each row follows its own text. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamline.llm.blocks import batches_of, find_words, inside_documents, mix, rolling
from loamline.llm.graphs import components, written

_SKETCH = "doc_id bigint, n_shingles bigint, class binary, bands array<bigint>"
_SETS = "doc_id bigint, shingles binary"


def _document_shingles(texts: pa.Array, width: int) -> Iterator[tuple[bytes | None, np.ndarray]]:
    """(key of the word sequence, sorted distinct shingle hashes) of each text of a batch."""
    words = find_words(texts, lower=True)
    hashes = words.hashes()
    windows = rolling(hashes, width)
    # Checked against the document's end: windows are laid over the whole batch.
    assert len(windows) == len(inside_documents(words.first, width))
    for i in range(len(texts)):
        lo, hi = int(words.first[i]), int(words.first[i + 1])
        if lo == hi:
            yield None, np.zeros(0, np.uint64)
        elif hi - lo < width:
            yield hashlib.md5(hashes[lo:hi].tobytes()).digest(), rolling(hashes[lo:hi], hi - lo)
        else:
            yield hashlib.md5(hashes[lo:hi].tobytes()).digest(), np.unique(windows[lo:hi - width + 1])


class MinMax:
    """Signatures of ``2 * functions`` values, cut into bands."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        functions = bands * rows // 2
        draw = np.random.default_rng(seed).integers(1, 2**63, (2, functions), dtype=np.uint64)
        self._times, self._plus = draw[0] | np.uint64(1), draw[1]
        self._bands, self._rows = bands, rows

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self._times), np.iinfo(np.uint64).max, np.uint64)
        high = np.zeros(len(self._times), np.uint64)
        for at in range(0, len(shingles), 2048):
            values = shingles[at:at + 2048, None] * self._times + self._plus
            np.minimum(low, values.min(axis=0), out=low)
            np.maximum(high, values.max(axis=0), out=high)
        return np.concatenate([low, np.roll(high, -1)])

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        """A 64-bit key per band, different between bands. A band has minima of some functions and maxima of
        the functions next to them, so its values belong to different permutations."""
        values = self.signature(shingles).reshape(self._rows, self._bands).T
        key = mix(np.arange(self._bands, dtype=np.uint64) + np.uint64(0x5BD1E995))
        for column in values.T:
            key = mix(key ^ column)
        return key.view(np.int64)


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()),
                        ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinMax(bands, rows)
        for batch in batches:
            found = _document_shingles(batch.column(1), width)
            yield from batches_of(
                ((doc, len(s), key, hasher.bands(s) if key else None)
                 for doc, (key, s) in zip(batch.column(0).to_pylist(), found)), schema)

    return docs.mapInArrow(run, _SKETCH)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _document_shingles(batch.column(1), width)
            yield from batches_of(((doc, s.tobytes()) for doc, (_, s) in zip(batch.column(0).to_pylist(), found)),
                                  schema, 512)

    return docs.mapInArrow(run, _SETS)


def _compare(pairs: DataFrame, sets: DataFrame, private: bool) -> DataFrame:
    """Exact overlap of pairs (x, c): ``both`` shingles are common; with ``private``, also the shingles
    of x that c lacks."""
    schema = pa.schema([("x", pa.int64()), ("c", pa.int64()), ("both", pa.int64()), ("m", pa.int64()),
                        ("n", pa.int64()), ("own", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(batch):
            for x, c, left, right in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                s, t = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                common = t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s
                own = s[~common].view(np.int64) if private else None
                yield x, c, int(np.count_nonzero(common)), len(s), len(t), own

        for batch in batches:
            yield from batches_of(compared(batch), schema, 1024)

    left = sets.select(F.col("doc_id").alias("x"), F.col("shingles").alias("s"))
    right = sets.select(F.col("doc_id").alias("c"), F.col("shingles").alias("t"))
    joined = pairs.select("x", "c").join(left, "x").join(right, "c").select("x", "c", "s", "t")
    return joined.mapInArrow(run, "x bigint, c bigint, both bigint, m bigint, n bigint, own array<bigint>")


def _similar(percent: int, both: Column, sizes: Column) -> Column:
    """100 * intersection >= percent * union, by the sum of the sizes."""
    return F.lit(100 + percent) * both >= F.lit(percent) * sizes


def _centres(members: DataFrame) -> DataFrame:
    """The member of each bucket that meets most others in all its buckets."""
    first = F.struct("centrality", -F.col("doc_id"))
    return written(members.groupBy("band").agg(F.max_by("doc_id", first).alias("c")), "centres")


def _around(compared: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components around a common centre that can still be similar.

    Of x and a around c, the common part is at most the smaller of their parts in c, plus what both
    have outside c. So they are similar only if they share a shingle that c lacks, or if the smaller
    part in c alone would do, which bounds the size of a by that of x. Private shingles are taken from
    the rarest on: what x and a can share from a common one on is at most what either has left, so a
    pair that is similar passes at the rarest shingle it shares.
    """
    of = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    around = compared.join(of, F.col("x") == F.col("_n"), "left").withColumn(
        "comp", F.coalesce("_c", "x")).drop("_n", "_c")
    around = around.join(of, F.col("c") == F.col("_n"), "left").withColumn(
        "home", F.coalesce("_c", "c")).drop("_n", "_c")
    around = written(around, "around")

    # A pair needs at least ``need`` common shingles outside c, so the rarest of them is among all but
    # the ``need - 1`` most common ones of either side; the order is the same for all around c.
    need = F.greatest(F.ceil(F.col("m") * percent / 100) - F.col("both"), F.lit(1))
    token = written(around.select("c", "x", "comp", "m", "both", F.size("own").alias("private"), (F.size("own") - need + 1).alias("prefix"),
                                F.explode("own").alias("token"))
                    .filter("prefix > 0"), "private")
    spread = written(token.groupBy("c", "token").agg(F.count("*").alias("n"), F.min("comp").alias("low"),
                                                     F.max("comp").alias("high")), "spread")
    place = F.row_number().over(Window.partitionBy("c", "x").orderBy("n", "token"))
    token = written(token.join(spread, ["c", "token"]).withColumn("place", place).filter(
        "place <= prefix AND low < high").select(
        "c", "token", "x", "comp", "m", "both", (F.col("private") - F.col("place") + 1).alias("rest")), "prefixes")
    others = token.select("c", "token", F.col("x").alias("a"), F.col("comp").alias("theirs"), F.col("m").alias("size"),
                          F.col("both").alias("their_both"), F.col("rest").alias("their_rest"))
    most = F.least("both", "their_both") + F.least("rest", "their_rest")
    by_token = token.join(others, ["c", "token"]).filter(
        (F.col("comp") != F.col("theirs")) & (F.col("x") < F.col("a"))
        & _similar(percent, most, F.col("m") + F.col("size")))

    # Sizes are compared in steps of the centre's size, exactly after the join.
    reach = F.floor(F.lit(100 + percent) * F.col("both") / percent) - F.col("m")

    def step(size: Column) -> Column:
        return F.floor(size * 64 / F.col("n"))

    strangers = around.filter(F.col("comp") != F.col("home")).withColumn("reach", reach).filter(
        F.lit(100) * F.col("reach") >= F.lit(percent) * F.col("m")).select(
        "c", "x", "comp", "m", "reach", F.explode(F.sequence(step(F.col("m") * percent / 100), step(F.col("reach")))).alias("step"))
    others = around.select("c", F.col("x").alias("a"), F.col("comp").alias("theirs"), F.col("m").alias("size"),
                           reach.alias("back"), step(F.col("m")).alias("step"))
    by_size = strangers.join(others, ["c", "step"]).filter(
        (F.col("comp") != F.col("theirs")) & (F.col("size") <= F.col("reach")) & (F.col("m") <= F.col("back")))
    pairs = by_token.select("x", F.col("a").alias("c")).union(
        by_size.select(F.least("x", "a").alias("x"), F.greatest("x", "a").alias("c")))
    return written(pairs.distinct(), "pairs")


def numbered(docs: DataFrame, number: str) -> DataFrame | None:
    """``docs`` as a table with a number per row, where a ``doc_id`` occurs more than once; else None."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 AND doc_id IS NOT NULL").isEmpty():
        return None
    return written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, bands: int = 32, rows: int = 4) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text"))
    apart = numbered(docs, "row")
    if apart is None:
        return _of_ids(docs, width, percent, bands, rows)
    # Ids do not tell rows apart, so the search goes by row numbers; components get their smallest id at the end.
    by_row = apart.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("doc_id"), "text")
    found = written(_of_ids(by_row, width, percent, bands, rows).select(
        F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("group")), "found")
    named = found.join(apart.select("row", "doc_id"), "row", "left")
    least = named.filter("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "group", "left").select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _of_ids(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """The same for documents with ids of their own."""
    sketch = written(sketches(docs, width, bands, rows), "sketches")

    # Equal word sequences: one class, one representative.
    classes = written(sketch.filter(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
                      .groupBy("class").agg(F.min("doc_id").alias("rep")), "classes")

    one = sketch.join(classes.select(F.col("rep").alias("doc_id"), "class"), ["doc_id", "class"], "left_semi")
    member = written(one.select("doc_id", F.explode("bands").alias("band")).distinct(), "members")
    crowded = written(member.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "crowded")
    held = written(member.join(crowded, "band"), "held")
    centrality = held.groupBy("doc_id").agg(F.sum("n").alias("centrality"))
    buckets = written(held.select("band", "doc_id").join(centrality, "doc_id"), "buckets")

    # Sets of those that share a bucket with anyone; all others need none.
    texts = docs.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = written(shingle_sets(texts, width), "sets")

    centres = _centres(buckets)
    star = written(buckets.join(centres, "band").filter(F.col("doc_id") != F.col("c"))
                   .select(F.col("doc_id").alias("x"), "c").distinct(), "stars")
    compared = written(_compare(star, sets, private=True), "compared")
    hit = _similar(percent, F.col("both"), F.col("m") + F.col("n"))
    labels = components(compared.filter(hit).select(F.col("x").alias("a"), F.col("c").alias("b")))
    pairs = _around(compared, labels, percent)
    if not pairs.isEmpty():
        found = _compare(pairs, sets, private=False).filter(hit)
        labels = components(found.select(F.col("x").alias("a"), F.col("c").alias("b"))
                            .union(labels.select("component", "node")))

    of_class = classes.join(labels, classes["rep"] == labels["node"], "left").select(
        "class", F.coalesce("component", "rep").alias("_component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return sketch.join(written(of_class, "classes"), "class", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
