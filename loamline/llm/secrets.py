"""Multipart credential linking, in SQL functions only.

Patterns of two sorts are searched in whole texts. *Strong* ones are findings by themselves. *Weak*
ones are parts of a credential: identifiers (who), secrets (proof) and endpoints (where). Alone they
occur everywhere; a weak part is reported only if a complementary part lies in the same scope, at
most ``scope`` characters between them: a secret with an identifier or an endpoint, and an identifier
or endpoint with a secret. Parts may lie in one another, such as a secret in the query of an endpoint.
Strong findings serve as parts, too.

Positions are code points. They come from the lengths of what lies between matches, added up per
document and kind. Parts meet in an interval join: each part enters the cells of ``scope`` characters its
surroundings touch, and cells are joined by equality and distance.

Nulls and empty texts have no findings. Rows are identified by ``doc_id`` and a hash of the text, so
repeated rows get equal findings. Other columns are kept out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.blocks import free_name
from loamline.llm.graphs import written
from loamline.operators.parsing import once

# Strong kinds in the order in which spans of one start are listed.
STRONG = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
}
# Weak parts by role, each searched on its own: parts of different roles may overlap.
WEAK = {
    "ident": r"""(?i:access_?key_?id|client_?id|account|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""",
    "proof": (r"""(?i:pwd|pass|auth|credential|key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}"""
              r"""|(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"""),
    "place": r"""(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|s3|ssh|ftp)://[^\x20\x09-\x0D"'<>]+"""
             r"""|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._-]{4,}""",
}
KINDS = (*STRONG, *WEAK)
# What a kind contributes to a credential.
ROLE = {"assign": "proof", "access": "ident", "hex": "proof", "ident": "ident", "proof": "proof", "place": "place"}
_PATTERN = STRONG | WEAK


def _parts(text: Column, pattern: str) -> tuple[Column, Column]:
    """Matches of a pattern, and the lengths of what lies before each of them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return found, gaps


def _matches(docs: DataFrame) -> DataFrame:
    """One row per document: its key, and per sort the matches with their gaps. Texts end here."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumn(
        "sig", F.xxhash64("text"))
    out = rows
    for kind, pattern in _PATTERN.items():
        # Most texts hold nothing of a kind: they are searched once and not split.
        found, gaps = _parts(F.col("text"), pattern)
        out = once(out, **{f"{kind}_found": found})
        empty = F.array().cast("array<int>")
        out = out.withColumn(f"{kind}_gaps", F.when(F.size(f"{kind}_found") > 0, gaps).otherwise(empty))
    return out.drop("text")


def _spans(matches: DataFrame) -> DataFrame:
    """(doc_id, sig, kind, start, end) of every match that holds."""
    parts = []
    for kind in KINDS:
        found = matches.filter(F.size(f"{kind}_found") > 0).select(
            "doc_id", "sig", F.posexplode(F.arrays_zip(F.col(f"{kind}_found").alias("m"), F.col(f"{kind}_gaps").alias("g"))))
        row = found.select("doc_id", "sig", F.lit(kind).alias("kind"), "pos", F.col("col.m").alias("m"),
                           F.col("col.g").alias("gap")).filter(F.col("m").isNotNull())
        if kind == "assign":
            good = F.length(F.regexp_extract("m", STRONG["assign"], 2)) >= 8
        elif kind == "access":
            good = F.length("m") >= 16
        else:
            good = F.lit(True)
        parts.append(row.select("doc_id", "sig", "kind", "pos", "gap",
                                F.length("m").alias("size"), good.alias("good")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    before = (Window.partitionBy("doc_id", "sig", "kind").orderBy("pos")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = F.sum(F.col("gap").cast("bigint") + F.col("size")).over(before)
    return every.withColumn("end", end).filter("good").select(
        "doc_id", "sig", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def _linked(spans: DataFrame, scope: int) -> DataFrame:
    """Weak spans with a complementary part at most ``scope`` characters away.

    A weak part enters every cell that its surroundings touch, other parts every cell they lie in.
    Spans of one kind do not overlap, so a cell holds a bounded number of parts and the join stays in
    proportion to the text.
    """
    role = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])[F.col("kind")]

    def cells(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))

    key = ["doc_id", "sig"]
    weak = spans.filter(F.col("kind").isin(*WEAK)).select(
        *key, "kind", "start", "end", role.alias("role"), cells(F.col("start") - scope, F.col("end") + scope).alias("cell"))
    other = spans.select(F.col("doc_id").alias("d"), F.col("sig").alias("s"), F.col("start").alias("from"),
                         F.col("end").alias("to"), role.alias("part"),
                         cells(F.col("start"), F.col("end")).alias("c"))
    complement = F.when(F.col("role") == "proof", F.col("part") != "proof").otherwise(F.col("part") == "proof")
    close = (F.col("from") - F.col("end") <= scope) & (F.col("start") - F.col("to") <= scope)
    met = weak.join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sig") == F.col("s"))
                    & (F.col("cell") == F.col("c")) & complement & close, "left_semi")
    return met.select(*key, "kind", "start", "end").distinct()


def secret_spans(docs: DataFrame, scope: int = 200) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): ``rows`` has doc_id and sig of every row of ``docs`` (doc_id, text); ``spans`` has
    the strong and the linked weak spans of each distinct (doc_id, sig): kind, start, end."""
    matches = written(_matches(docs), "matches")
    spans = written(_spans(matches.dropDuplicates(["doc_id", "sig"])), "spans")
    found = spans.filter(F.col("kind").isin(*STRONG)).unionByName(_linked(spans, scope))
    return matches.select("doc_id", "sig"), found


def _rank() -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))


def _listed(only_strong: bool) -> Column:
    """All spans of a group as ``kind:start:end``, by start, then kind as listed."""
    entry = F.struct("start", _rank().alias("rank"), "end", "kind")
    entries = F.collect_list(F.when(F.col("kind").isin(*STRONG), entry) if only_strong else entry)
    return F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat_ws(
        ":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",")


def scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """Findings per row: doc_id, counts of the strong kinds and of linked parts, ``base_spans`` and
    ``spans`` as text."""
    rows, spans = secret_spans(docs, scope)
    per = spans.groupBy(F.col("doc_id").alias("_d"), F.col("sig").alias("_s")).agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in STRONG],
        F.count_if(F.col("kind").isin(*WEAK)).alias("n_linked"),
        _listed(True).alias("base_spans"), _listed(False).alias("spans"))
    counts = [f"n_{k}" for k in STRONG] + ["n_linked"]
    return rows.join(per, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("sig") == F.col("_s")), "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_spans", "spans")])


def redact(docs: DataFrame, scope: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mark``; overlapping findings become one."""
    _, spans = secret_spans(docs.select("doc_id", "text"), scope)
    inner = Window.partitionBy("doc_id", "sig").orderBy("start", "end")
    until = F.max("end").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    block = spans.withColumn("new", F.coalesce(F.col("start") > until, F.lit(True)).cast("int")).withColumn(
        "block", F.sum("new").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    merged = block.groupBy("doc_id", "sig", "block").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    sig, d, s, listed = (free_name(docs, c) for c in ("_sig", "_d", "_s", "_cuts"))
    cuts = merged.groupBy(F.col("doc_id").alias(d), F.col("sig").alias(s)).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias(listed))
    text = F.col("text").cast("string")
    joined = docs.withColumn(sig, F.xxhash64(F.coalesce(text, F.lit("")))).join(
        cuts, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(sig) == F.col(s)), "left")
    size = F.size(listed)

    def before(cut: Column, i: Column) -> Column:
        last = F.when(i > 0, F.element_at(listed, F.greatest(i, F.lit(1)))["end"]).otherwise(F.lit(0))
        return F.concat(F.substring(text, (last + 1).cast("int"), (cut["start"] - last).cast("int")), F.lit(mark))

    tail = F.substring(text, (F.element_at(listed, -1)["end"] + 1).cast("int"), F.length(text))
    clean = F.when(size > 0, F.concat(F.array_join(F.transform(listed, before), ""), tail)).otherwise(text)
    return joined.select(*[clean.alias("text") if c == "text" else F.col(c) for c in docs.columns])
