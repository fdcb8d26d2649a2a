"""Conversations of any declared layout as canonical turns, and turns as training text.

A record is JSON. Its *fingerprint* is a hash of its sorted nested field paths (``messages[].role``);
it selects the declared layout, whose mapping says where turns, roles and texts are. Layouts are data:
supporting another one means adding an entry. Optional fields give a layout several fingerprints.
Records of no declared layout come out as one row with a null layout, not dropped.

The template marks turns with four control strings. Texts and roles may contain anything: a backslash
is doubled and put after the first character of each control string, so no control string survives in
a text, and reading back is exact. Nulls read as empty texts and empty roles. Turns of one number are
ordered by role and text; repeated rows are turns of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """Where a turn's text is, and its role: a fixed one or the name of a field."""

    text: str
    role: str | None = None
    role_field: str | None = None


@dataclass(frozen=True)
class Layout:
    """Field paths of a record and the turns they hold. ``items`` names a list of turns; ``number`` and
    ``conversation`` name the fields of a record that is one turn of a conversation itself."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[Turn, ...]
    items: str | None = None
    optional: tuple[str, ...] = ()
    number: str | None = None

    def fingerprints(self) -> list[str]:
        return [fingerprint([*self.paths, *some]) for n in range(len(self.optional) + 1)
                for some in itertools.combinations(self.optional, n)]


ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

LAYOUTS = (
    Layout("turn_row", ("conv_id", "turn", "role", "text"), (Turn("text", role_field="role"),), number="turn"),
    Layout("messages", ("messages[].role", "messages[].content"), (Turn("content", role_field="role"),),
           items="messages", optional=("id", "messages[].name")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), (Turn("value", role_field="from"),),
           items="conversations", optional=("id", "system")),
    Layout("instruction", ("instruction", "output"), (
        Turn("system", "system"), Turn("instruction", "user"), Turn("input", "user"), Turn("output", "assistant")),
        optional=("id", "input", "system")),
    Layout("prompt", ("prompt", "completion"), (Turn("prompt", "user"), Turn("completion", "assistant")),
           optional=("id",)),
    Layout("question", ("question", "answer.text"), (Turn("question", "user"), Turn("answer.text", "assistant")),
           optional=("id",)),
)


def field_paths(value, prefix: str = "") -> set[str]:
    """Paths of all leaves; list items share a path, empty lists and objects are leaves."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, f"{prefix}[]") for v in value))
    return {prefix}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _at(record, path: str):
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def _as_text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record, layout: Layout) -> Iterator[tuple[int, str, str]]:
    """(number, role, text) of each turn of a record."""
    if layout.items is None:
        found = [(t, record) for t in layout.turns if layout.number or _at(record, t.text) is not None]
    else:
        found = [(t, item) for item in record[layout.items] for t in layout.turns]
    extra = [("system", record["system"])] if layout.items and record.get("system") is not None else []
    for i, (role, text) in enumerate([*extra, *[(t.role or _as_text(_at(r, t.role_field)), _at(r, t.text)) for t, r in found]]):
        role = role if layout.number else ROLE_NAMES.get(role, role)
        yield i, role, _as_text(text)


_TURNS = "conv_id bigint, turn bigint, role string, text string, layout string"
_TURN_TYPES = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                         ("layout", pa.string())])


def canonical_turns(records: DataFrame, conv_id: str, record: str, layouts=LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text, layout) of the turns of JSON records."""
    known = {f: layout for layout in layouts for f in layout.fingerprints()}

    def read(conv, body):
        try:
            value = json.loads(body or "null")
        except ValueError:
            value = None
        layout = known.get(fingerprint(field_paths(value))) if isinstance(value, dict) else None
        if layout is None:
            yield conv, None, None, body, None
            return
        for i, role, text in turns_of(value, layout):
            yield conv, (value[layout.number] if layout.number else i), role, text, layout.name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for c, r in zip(*[batch.column(i).to_pylist() for i in (0, 1)]) for row in read(c, r)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TURN_TYPES)], schema=_TURN_TYPES)

    return records.select(F.col(conv_id).cast("bigint"), F.col(record)).mapInArrow(run, _TURNS)


# The template's control strings. None has its first character anywhere else.
OPEN, CLOSE, ASK, SAY = "<s>", "</s>", "[INST]", "[/INST]"
_CONTROL = r"(<|\[)(s>|/s>|INST\]|/INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def format_turns(turns: DataFrame) -> DataFrame:
    """``turns`` with ``formatted``, and for assistant turns the span of the loss in it (code points).

    An assistant turn is ``<s>role[/INST]text</s>``, any other ``<s>role[INST]text[/INST]``."""
    role = F.coalesce("role", F.lit(""))
    said = escape(F.coalesce("text", F.lit("")))
    ours = role == "assistant"
    head = F.concat(F.lit(OPEN), escape(role), F.when(ours, SAY).otherwise(ASK))
    return turns.select(
        *turns.columns, F.concat(head, said, F.when(ours, CLOSE).otherwise(SAY)).alias("formatted"),
        F.when(ours, F.length(head)).alias("loss_start"), F.when(ours, F.length(head) + F.length(said)).alias("loss_end"))





def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        stop = min(i for i in (formatted.find(ASK, at), formatted.find(SAY, at)) if i >= 0)
        role = formatted[at + len(OPEN):stop]
        begin, close = (stop + len(ASK), SAY) if formatted.startswith(ASK, stop) else (stop + len(SAY), CLOSE)
        end = formatted.index(close, begin)
        out.append((unescape(role), unescape(formatted[begin:end])))
        at = end + len(close)
    return out


_DIGEST = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
           "formatted_chars bigint")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, from the formatted text and its loss spans alone.

    A digest needs its turns in order: conversations are hashed to partitions and sorted there, and a
    task reads turn after turn with one conversation's hash states in hand, however long it is."""
    types = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                       ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None

        def done():
            conv, n, turns, chars, loss, size = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            rows = []
            for conv, text, start, end in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if conv != now:
                    if state:
                        rows.append(done())
                    now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[5] += len(text)
                for role, said in read_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    said = unescape(text[start:end])
                    state[3] += len(said)
                    state[4].update(said.encode("utf-8", "surrogatepass"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)], schema=types)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(done(), types)], schema=types)

    ordered = formatted.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, _DIGEST)
