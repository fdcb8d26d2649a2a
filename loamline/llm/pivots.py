"""Exact top-k by inner product over a pivot-distance index.

Vectors are read as whole numbers, floor(256 x), and get one more coordinate, sqrt(M^2 - |x|^2) with M
the greatest length, queries a zero. The nearest neighbours of a query are then its highest inner
products. Each distinct vector is keyed by its nearest pivot and its distance to it; distances are cut
into rings, so a ring is an annulus around a pivot. By the triangle inequality a vector at distance r
of a pivot is at least |d - r| away from a query at distance d of it.

Search goes outwards. First a query meets its own ring and the rings beside it, which bounds the
distance of its k-th neighbour; then, around every pivot, the rings that this bound does not rule out.
Nothing else can hold a better vector, so the result is exact; scores are computed on whole numbers.

Equal vectors are one entry that knows its ``k + 1`` smallest ids: no more can ever be among the best k.
Rings and the queries that meet them are cut into blocks of bounded size, and a task multiplies one
block of vectors by one block of queries at a time. Pivots come from a bounded sample of vectors, the
ones with the lowest hashes; every vector is indexed.

Components may be as large as doubles get. Distances are then taken on scaled values, with a margin for what
that loses; scores are always exact, in whole numbers of any size where 64 bits are not enough, and the order
follows them. A score beyond 64 bits is shown as the largest or smallest long.

Rows without an id, or whose vector is null or holds null or non-finite components (256 times the component
included), take no part. Vectors meet those of their own length only. Rows that repeat an id are one entry
per distinct vector. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamline.llm.graphs import written

SAMPLE = 4096
PIVOTS = 48
RINGS = 24
BLOCK = 2048


def whole_numbers(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v, size): components as little-endian 32-bit numbers, or as doubles where one needs more bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, sizes = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or x is None or None in x:
                    continue
                with np.errstate(over="ignore"):
                    scaled = np.floor(256 * np.array(x, np.float64))
                if np.isfinite(scaled).all():
                    ids.append(i)
                    sizes.append(len(x))
                    out.append((scaled + 0.0).astype("<i4" if (np.abs(scaled) < 2**31).all() else "<f8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(sizes, pa.int32())],
                names=["vec_id", "v", "size"])

    rows = df.select(F.col(vec_id).cast("bigint"), F.col(vector).cast("array<double>"))
    return rows.mapInArrow(run, "vec_id bigint, v binary, size int")


def matrix(values: list[bytes], size: int) -> np.ndarray:
    if all(len(v) == 4 * size for v in values):
        return np.frombuffer(b"".join(values), "<i4").reshape(len(values), size).astype(np.float64)
    rows = [np.frombuffer(v, "<i4" if len(v) == 4 * size else "<f8").astype(np.float64) for v in values]
    return np.array(rows).reshape(len(values), size)


def products(queries: np.ndarray, vectors: np.ndarray, wide: bool) -> np.ndarray:
    """Inner products of whole numbers: floats where they are exact, else 64-bit integers, or with ``wide``
    Python's."""
    reach = max(1.0, np.abs(queries).max(initial=0)) * max(1.0, np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if reach < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    if not wide:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    left, right = (np.array([[int(c) for c in row] for row in x], object).reshape(x.shape) for x in (queries, vectors))
    return left @ right.T


class Scale:
    """Powers of two that bring components below 2^31 for distances; ``wide`` scores leave 64 bits."""

    def __init__(self, reach: float, size: int):
        self.bits = max(0, int(np.frexp(reach)[1]) - 31)
        self.wide = self.bits > 0 or size * reach * reach >= 2.0**62
        # Scores as text of one width sort like numbers.
        self._above = (int(reach) + 1) ** 2 * max(1, size)
        self._digits = len(str(2 * self._above))

    def matrix(self, values: list[bytes], size: int) -> np.ndarray:
        return np.ldexp(matrix(values, size), -self.bits)

    def key(self, score: int) -> str:
        return str(score + self._above).zfill(self._digits) if self.wide else ""

    def near(self, score: int) -> float:
        return score / (1 << 2 * self.bits)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Vectors far apart from each other, then moved to the mean of what is nearest to them."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [0]
    away = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    pivots = sample[chosen].astype(np.float64)
    for _ in range(8):
        near = _distances(sample, pivots).argmin(axis=1)
        for p in range(len(pivots)):
            if (near == p).any():
                pivots[p] = sample[near == p].mean(axis=0)
    return pivots


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate that makes all vectors equally long."""
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x**2).sum(axis=1), 0))])


def _with_pivots(df: DataFrame, column: str, index, scale: Scale, longest: float | None, width: float, every: bool) -> DataFrame:
    """``df`` with pivot, distance and ring of its vectors: the nearest pivot, or all of them (``every``).
    Queries (``longest`` None) get a zero for the added coordinate."""
    names = df.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = index.value
        for batch in batches:
            if not len(batch):
                continue
            x = scale.matrix(batch.column(at).to_pylist(), pivots.shape[1] - 1)
            x = _lifted(x, longest) if longest is not None else np.column_stack([x, np.zeros(len(x))])
            d = _distances(x, pivots)
            if every:
                row = np.repeat(np.arange(len(x)), len(pivots))
                pivot = np.tile(np.arange(len(pivots)), len(x))
            else:
                row, pivot = np.arange(len(x)), d.argmin(axis=1)
            found = d[row, pivot]
            yield pa.RecordBatch.from_arrays(
                [*batch.take(pa.array(row)).columns, pa.array(pivot.astype(np.int32)), pa.array(found),
                 pa.array((found // width).astype(np.int64))], names=[*names, "pivot", "d", "ring"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, pivot int, d double, ring bigint")


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of at most about ``BLOCK`` rows per (pivot, ring): their number is ``parts``."""
    counted = rows.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))
    return written(counted, "blocks")


def _search(queries: DataFrame, index: DataFrame, parts: DataFrame, scale: Scale, k: int, size: int) -> DataFrame:
    """Best ``k`` (query, vec_id, score, key, near) of each query among the rings it is sent to. ``queries`` has
    (q, pivot, ring). Scores are ordered by ``key`` first, which is empty where they fit into 64 bits."""
    asked = queries.join(parts.withColumnRenamed("parts", "vector_parts"), ["pivot", "ring"])
    load = asked.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("query_parts"))
    load = written(load, "load")
    key = ["pivot", "ring", "vector_part", "query_part"]
    left = asked.join(load, ["pivot", "ring"]).select(
        "q", "pivot", "ring", F.explode(F.sequence(F.lit(0), F.col("vector_parts") - 1)).alias("vector_part"),
        F.pmod(F.xxhash64("q"), F.col("query_parts")).cast("int").alias("query_part"))
    right = (index.join(parts, ["pivot", "ring"]).join(load, ["pivot", "ring"]).select(
        "v", "ids", "pivot", "ring", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("vector_part"),
        F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("query_part")))

    def run(_, asked_: pa.Table, vectors: pa.Table) -> pa.Table:
        out_q, out_id, out_score = [], [], []
        if asked_.num_rows and vectors.num_rows:
            qs = asked_["q"].to_pylist()
            ids = vectors["ids"].to_pylist()
            found = products(matrix(qs, size), matrix(vectors["v"].to_pylist(), size), scale.wide)
            for i, q in enumerate(qs):
                row = found[i]
                if len(row) > k:
                    least = np.partition(row, len(row) - k)[len(row) - k] if not scale.wide else sorted(row)[-k]
                    at = np.flatnonzero(row >= least)
                else:
                    at = np.arange(len(row))
                best = sorted((-int(row[j]), x) for j in at for x in ids[j])[:k]
                out_q += [q] * len(best)
                out_score += [-s for s, _ in best]
                out_id += [x for _, x in best]
        return pa.table({"q": pa.array(out_q, pa.binary()), "vec_id": pa.array(out_id, pa.int64()),
                         "score": pa.array([min(max(s, -2**63), 2**63 - 1) for s in out_score], pa.int64()),
                         "key": pa.array(map(scale.key, out_score), pa.string()),
                         "near": pa.array(map(scale.near, out_score), pa.float64())})

    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        run, "q binary, vec_id bigint, score bigint, key string, near double")
    best = Window.partitionBy("q").orderBy(F.desc("key"), F.desc("score"), "vec_id")
    return met.distinct().withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n")


def _one_length(vectors: DataFrame, wanted: DataFrame, k: int, size: int) -> DataFrame:
    """Top ``k`` + 1 of each distinct query vector among all vectors of one length, its own id included."""
    spark = vectors.sparkSession
    by_id = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.select("v", "vec_id").distinct().withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1)
    entries = written(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")

    def reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([float(np.abs(matrix(batch.column(0).to_pylist(), size)).max(initial=0))])], names=["r"])

    scale = Scale(entries.select("v").mapInArrow(reaches, "r double").agg(F.max("r")).first()[0], size)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = scale.matrix(batch.column(0).to_pylist(), size)
                yield pa.RecordBatch.from_arrays([pa.array([float((x**2).sum(axis=1).max(initial=0))])], names=["l"])

    longest = entries.select("v").mapInArrow(lengths, "l double").agg(F.max("l")).first()[0]
    drawn = entries.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").toArrow()["v"].to_pylist()
    sample = _lifted(scale.matrix(drawn, size), longest)
    pivots = choose_pivots(sample, PIVOTS)
    near = _distances(sample, pivots).min(axis=1)
    width = max(float(near.max(initial=0)) / RINGS, 1e-6 * max(longest, 1.0) ** 0.5, 1e-9)
    shared = spark.sparkContext.broadcast(pivots)

    index = written(_with_pivots(entries, "v", shared, scale, longest, width, False), "index")
    parts = _blocks(index)
    asked = written(wanted.select(F.col("v").alias("q")).distinct(), "asked")

    home = _with_pivots(asked, "q", shared, scale, None, width, False)
    # The nearest ring that exists: a query lies off the surface on which all lifted vectors lie.
    rings = parts.select("pivot", F.col("ring").alias("have"))
    nearest = home.join(rings, "pivot").groupBy("q", "pivot", "ring").agg(
        F.min(F.struct(F.abs(F.col("have") - F.col("ring")).alias("off"), "have"))["have"].alias("have"))
    around = nearest.select("q", "pivot", F.explode(F.sequence(F.col("have") - 1, F.col("have") + 1)).alias("ring"))
    first = written(_search(around, index, parts, scale, k + 1, size), "first")

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = scale.matrix(batch.column(0).to_pylist(), size)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((x**2).sum(axis=1))], names=["q", "qq"])

    bound = first.groupBy("q").agg(F.count("*").alias("n"), F.min("near").alias("score"))
    known = asked.mapInArrow(squares, "q binary, qq double").join(bound, "q", "left")
    # |q - x|^2 = |q|^2 + M^2 - 2 q x; a margin covers what floating point loses.
    far = F.sqrt(F.greatest(F.col("qq") + F.lit(longest) - 2 * F.col("score"), F.lit(0.0)))
    reach = F.when(F.col("n") > k, far * (1 + 1e-9) + F.lit(1e-6 * max(longest, 1.0) ** 0.5)).otherwise(F.lit(float("inf")))
    every = _with_pivots(asked, "q", shared, scale, None, width, True).join(
        known.select("q", reach.alias("reach")), "q")
    rest = every.join(rings, "pivot").filter(
        (F.col("have") * F.lit(width) <= F.col("d") + F.col("reach"))
        & ((F.col("have") + 1) * F.lit(width) >= F.col("d") - F.col("reach"))).select(
        "q", "pivot", F.col("have").alias("ring"))
    return _search(rest, index, parts, scale, k + 1, size)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that meet the condition ``queries``."""
    rows = written(whole_numbers(vectors, vec_id, vector), "vectors")
    chosen = rows.filter(queries)
    out = None
    for size in sorted(r["size"] for r in chosen.select("size").distinct().collect()):
        mine = rows.filter(F.col("size") == size)
        best = _one_length(mine, chosen.filter(F.col("size") == size), k, size)
        found = chosen.filter(F.col("size") == size).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).join(best, "q")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    others = out.filter(F.col("vec_id") != F.col("query_id")).dropDuplicates(["query_id", "vec_id", "score", "key"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("key"), F.desc("score"), "vec_id"))
    return others.select("query_id", place.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
