"""Decision lists over text statistics, learned by sequential covering.

Statistics are counted once per whole text. A list is learned from labelled statistics: a rule grows
condition by condition (``statistic <= t`` or ``> t``, by information gain) until it covers no good
row, is pruned on rows it did not grow on, and is kept if it is precise enough there; the rows it
covers leave, and the next rule follows. The result is an ordered list of threshold conjunctions,
emitted as one Spark conditional expression, so judging rows is native and needs no model object.

Learning takes at most ``max_rows`` labelled rows (a documented bound, drawn by a hash of the id);
judging covers every row. Nulls and empty texts have zero counts. Without labels, or with labels of
one kind only, the list is empty and rejects nothing. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.llm.blocks import IS_SPACE, free_name

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines",
          "n_distinct_words", "n_upper", "n_digits", "n_marks")
RATIOS = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "words_per_line",
          "distinct_share", "upper_share", "digit_share", "mark_share")

# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
_MARKS = b"!?\"'()[]{}/\\@^_~`=+;:"


def _count(text: bytes, members: bytes) -> int:
    return len(text) - len(text.translate(None, members))


def _repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    seen: set = set()
    twice: set = set()
    if len(set(windows)) == len(windows):
        return 0
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(np.fromiter((w in twice for w in windows), bool, len(windows)))
    covered[at] += 1
    np.subtract.at(covered, at + 3, 1) if len(at) else None
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


def text_counts(text: bytes) -> tuple[int, ...]:
    """``COUNTS`` of one text."""
    words = text.split()
    data = np.frombuffer(text, np.uint8)
    chars = int(np.count_nonzero((data & 0xC0) != 0x80))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (len(words), chars - int(np.count_nonzero(IS_SPACE[data])), _count(text, SYMBOLS),
            len(lines) - len(set(lines)), _repeated_words(words), chars, len(lines), len(set(words)),
            _count(text, _UPPER), _count(text, _DIGITS), _count(text, _MARKS))


def with_counts(docs: DataFrame, text: str, into: str) -> DataFrame:
    """``docs`` with the counts of a text column as one struct column ``into``."""
    kind = pa.struct([(name, pa.int64()) for name in COUNTS])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            columns = zip(*[text_counts(t or b"") for t in texts]) if texts else [[]] * len(COUNTS)
            counts = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], names=[*batch.schema.names, into])

    counted = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, counted)]))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def ratios(counts: Column) -> dict[str, Column]:
    """What rules may test, from the counts."""
    c = {name: counts[name] for name in COUNTS}
    return dict(zip(RATIOS, (
        c["n_words"].cast("double"), _share(c["word_chars"], c["n_words"]),
        _share(c["n_symbols"], c["n_chars"]), _share(c["n_dup_lines"], c["n_lines"]),
        _share(c["n_repeat_words"], c["n_words"]), _share(c["n_words"], c["n_lines"]),
        _share(c["n_distinct_words"], c["n_words"]), _share(c["n_upper"], c["n_chars"]),
        _share(c["n_digits"], c["n_chars"]), _share(c["n_marks"], c["n_chars"]))))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: Sequence[str]) -> np.ndarray:
        column = x[:, names.index(self.statistic)]
        return column > self.threshold if self.above else column <= self.threshold

    def column(self, values: dict[str, Column]) -> Column:
        value = values[self.statistic]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """Rows that meet all conditions are bad; ``precision`` is what pruning rows showed."""

    conditions: tuple[Condition, ...]
    precision: float

    def holds(self, x: np.ndarray, names: Sequence[str]) -> np.ndarray:
        return np.logical_and.reduce([c.holds(x, names) for c in self.conditions])


class DecisionList(tuple):
    """Rules in order; the first that holds decides."""

    def rule_number(self, values: dict[str, Column]) -> Column:
        """Number of the deciding rule, counted from 1; 0 where none holds."""
        out = F.lit(0)
        for i in reversed(range(len(self))):
            met = F.lit(True)
            for condition in self[i].conditions:
                met = met & condition.column(values)
            out = F.when(met, F.lit(i + 1)).otherwise(out)
        return out

    def lines(self) -> list[str]:
        return [" and ".join(map(str, rule.conditions)) + f" -> bad ({rule.precision:.3f})" for rule in self]


def _gain(p: np.ndarray, n: np.ndarray, total_p: int, total_n: int) -> np.ndarray:
    """Information gained on the bad rows a condition keeps."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(total_p / (total_p + total_n))), -np.inf)


def _best_condition(x: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> Condition | None:
    total_p, total_n = int(bad.sum()), int((~bad).sum())
    best, best_gain = None, 1e-9
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        v, b = x[order, j], bad[order]
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if not len(cuts):
            continue
        low_p = np.cumsum(b)[cuts]
        low_n = cuts + 1 - low_p
        for above in (False, True):
            p, n = (total_p - low_p, total_n - low_n) if above else (low_p, low_n)
            gain = _gain(p.astype(float), n.astype(float), total_p, total_n)
            i = int(np.argmax(gain))
            if gain[i] > best_gain:
                middle = float(v[cuts[i]] + (v[cuts[i] + 1] - v[cuts[i]]) / 2)
                best, best_gain = Condition(name, above, middle), float(gain[i])
    return best


def learn_list(x: np.ndarray, bad: np.ndarray, names: Sequence[str] = RATIOS, min_precision: float = 0.9,
               min_covered: int = 3, max_conditions: int = 6, max_rules: int = 32, seed: int = 7) -> DecisionList:
    """Sequential covering of the bad rows. Two thirds of the rows grow rules, one third prunes them."""
    grow = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        g, t = left & grow, left & ~grow
        if bad[g].sum() < min_covered or not (~bad[g]).any():
            break
        conditions: list[Condition] = []
        inside = g.copy()
        while len(conditions) < max_conditions and (~bad[inside]).any():
            found = _best_condition(x[inside], bad[inside], names)
            if found is None:
                break
            conditions.append(found)
            inside &= found.holds(x, names)
        if not conditions:
            break

        def judged(count: int) -> tuple[float, int]:
            met = t & Rule(tuple(conditions[:count]), 0).holds(x, names)
            p, n = int(bad[met].sum()), int((~bad[met]).sum())
            return ((p - n) / (p + n) if p + n else -1.0, p)

        count = max(range(1, len(conditions) + 1), key=lambda c: (*judged(c), -c))
        kept = Rule(tuple(conditions[:count]), 0)
        met = t & kept.holds(x, names)
        p, n = int(bad[met].sum()), int((~bad[met]).sum())
        precision = (p + 1) / (p + n + 2)
        if p < min_covered or p / (p + n) < min_precision:
            break
        rules.append(Rule(kept.conditions, precision))
        left &= ~kept.holds(x, names)
    return DecisionList(rules)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Ratios and verdicts of at most ``max_rows`` labelled documents, the ones with the lowest hashes."""
    known = (labels.select("doc_id", F.col("quality").alias("_quality"))
             .filter(F.col("doc_id").isNotNull() & F.col("_quality").isNotNull())
             .groupBy("doc_id").agg(F.min("_quality").alias("_quality")))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    counted = with_counts(texts, "text", "_counts")
    got = counted.select("doc_id", *[c.alias(n) for n, c in ratios(F.col("_counts")).items()], "_quality").toArrow()
    x = np.column_stack([got[name].to_numpy() for name in RATIOS]) if got.num_rows else np.zeros((0, len(RATIOS)))
    bad = got["_quality"].to_numpy() == 0 if got.num_rows else np.zeros(0, bool)
    order = np.lexsort((*x.T, got["doc_id"].to_numpy()))  # rows arrive in any order; learning must not depend on it
    return x[order], bad[order]


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **settings) -> DecisionList:
    """A list from labelled documents. The rows drawn are at most ``max_rows`` short tuples, also as
    the broadcast side that finds their texts."""
    x, bad = labelled_sample(docs, labels, max_rows)
    return learn_list(x, bad, **settings)


def judge(docs: DataFrame, rules: DecisionList, text: str = "text", into: str = "_quality") -> DataFrame:
    """``docs`` with a struct column: the counts, ``base_failed``, the deciding ``rule`` and ``kept``."""
    raw = free_name(docs, "_counts")
    c = F.col(raw)
    failed = (c["n_words"] < 50) | (F.lit(100) * c["n_repeat_words"] > F.lit(50) * c["n_words"])
    rule = rules.rule_number(ratios(c))
    judged = with_counts(docs, text, raw).withColumn(into, F.struct(
        *[c[name].alias(name) for name in COUNTS], failed.alias("base_failed"), rule.alias("rule"),
        (~failed & (rule == 0)).alias("kept")))
    return judged.drop(raw)
