"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn; a deterministic parser reads the rendered text
again. A turn whose recovered role or text differs from the source has its control strings
escaped until the round trip is exact. Both directions work turn by turn and keep hashes
only, so a conversation of any length passes through a task in bounded memory.

Grammar: user turns are `<s>[INST] text [/INST]`, assistant turns `<s> text </s>`, all
others `<s>[ROLE] "role as JSON" text [/ROLE]`. A backslash behind the first character
of a control string takes its meaning away; the parser removes one such backslash.

Defined results: a null text is empty, a null role is the empty role; turns come by turn
number, then role, then text, nulls first; a null conv_id is a conversation of its own
with a null id; repeated rows are repeated turns; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")

_ANY = re.compile(r"[<\[](\\*)(?:/?s>|/?INST\]|/?ROLE\])")
_LIVE = re.compile(r"</?s>|\[/?(?:INST|ROLE)\]")
_SHIELDED = re.compile(r"([<\[])\\(\\*)(?=/?s>|/?INST\]|/?ROLE\])")
_JSON = json.JSONDecoder()


class BadFormat(ValueError):
    pass


def escape(text: str) -> str:
    return _ANY.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _SHIELDED.sub(r"\1\2", text)


def render(role: str, text: str) -> str:
    """One turn, with what it holds taken as it is."""
    if role == "user":
        return f"<s>[INST] {text} [/INST]"
    if role == "assistant":
        return f"<s> {text} </s>"
    return f"<s>[ROLE] {json.dumps(role).replace('<', chr(92) + 'u003c').replace('[', chr(92) + 'u005b')} {text} [/ROLE]"


def parse(formatted: str) -> list[tuple[str, str, tuple[int, int]]]:
    """(role, text, place of the still escaped text) of each turn."""
    turns, at = [], 0

    def take(want: str) -> None:
        nonlocal at
        if not formatted.startswith(want, at):
            raise BadFormat(f"{want!r} expected at {at}")
        at += len(want)

    while at < len(formatted):
        take("<s>")
        role, close = "assistant", " </s>"
        if formatted.startswith("[INST]", at):
            role, close = "user", " [/INST]"
            take("[INST]")
        elif formatted.startswith("[ROLE]", at):
            close = " [/ROLE]"
            take("[ROLE] ")
            role, at = _JSON.raw_decode(formatted, at)
        take(" ")
        found = _LIVE.search(formatted, at)
        if not found or found[0] != close[1:] or found.start() - 1 < at or formatted[found.start() - 1] != " ":
            raise BadFormat(f"{close!r} expected after {at}")
        end = found.start() - 1
        turns.append((role, unescape(formatted[at:end]), (at, end)))
        at = end
        take(close)
    return turns


def recovered(formatted: str) -> list[tuple[str, str, tuple[int, int]]] | None:
    try:
        return parse(formatted)
    except (BadFormat, ValueError):
        return None


def safe_turn(role: str, text: str) -> tuple[str, str, str, tuple[int, int]]:
    """The rendered turn, and role, text and place of the text as the parser gives them back."""
    body = text
    while True:
        formatted = render(role, body)
        got = recovered(formatted)
        if got is not None and len(got) == 1 and got[0][:2] == (role, text):
            return formatted, *got[0]
        if body != text:
            raise BadFormat("an escaped turn does not come back")
        body = escape(text)


def format_turns(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Each turn rendered: conv_id, turn, role, text, formatted, loss_start, loss_end (code points in formatted; null outside the loss)."""
    schema = "conv_id long, turn long, role string, text string, formatted string, loss_start int, loss_end int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for c, t, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                formatted, r, got, (start, end) = safe_turn(role or "", text or "")
                rows.append((c, t, r, got, formatted, *((start, end) if r == loss_role else (None, None))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.int32(), pa.int32()])], [x.split()[0] for x in schema.split(", ")])

    common.prepare(conversations.sparkSession)
    return _turns(conversations).mapInArrow(run, schema)


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Conversation:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss_role: str) -> None:
        """Everything is taken from the formatted text."""
        for role, text, _ in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == loss_role:
                self.loss.update(text.encode())
                self.loss_chars += len(text)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation, read back from its formatted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in DIGEST.split(", ")]
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
        now: _Conversation | None = None
        done: list[tuple] = []
        for b in batches:
            for conv_id, _, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv_id)
                now.add(safe_turn(role or "", text or "")[0], loss_role)
            if len(done) >= 1000:
                yield out(done)
                done = []
        if now is not None:
            done.append(now.row())
        if done:
            yield out(done)

    common.prepare(conversations.sparkSession)
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")]
    return _turns(conversations).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, DIGEST)


#: DuckDB SQL for digests() over conversations and conversation -1: an escape adds one character for each control string, shielded ones included.
ORACLE = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (
  select *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:/?s>|/?INST\]|/?ROLE\])'))
         + case role when 'user' then 18 when 'assistant' then 9 else length(q) + 19 end as n from (select *, to_json(role)::varchar as q from c) s)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256, sum(n)::bigint as formatted_chars
from t group by conv_id
"""
