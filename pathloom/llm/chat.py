"""Chat formatting by incremental black-box rendering.

A template renders a list of ``(role, text)`` turns to a string and is never
looked into.  The prefixes of a conversation, of one turn, two turns and so on,
are rendered one after the other, and each output is compared with the one
before: what it goes on with is the new turn's span.  Where it does not begin
with the whole earlier output the template rewrites history; then ``kept`` says
how much of the earlier output still stands, ``rewritten`` is true, and the part
after ``kept`` replaces the rest, so the last turn's output can always be put
together from the rows.

Where an assistant's text stands inside its span is found the same way: the
prefix is rendered twice more with other last texts, and what the two outputs
share at either end is not text.

A conversation's turns and its last output are held in memory, by one task, and
the work grows with the square of the number of its turns, as black boxes ask
for.  A template that declares itself ``independent`` (a turn's output does not
depend on earlier turns) is held to that over the first ``FULL`` turns and from
there on rendered after the ``CONTEXT`` turns before, so that a conversation of
any length is streamed.

Defined cases: a null text or role is empty; turns of the same number are put
in order of role and text, and repeated rows are repeated turns; rows with a
null conversation id are one conversation; a text that the template leaves out
or changes beyond recognition gets no place, and is not under the loss mask; nor
are the texts of turns that rewrite history.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import emit, table

Turn = tuple[str, str]

#: Turns of a conversation up to which every template is rendered with all turns before; turns that are rendered along with later ones, if the template is independent of more.
FULL, CONTEXT = 512, 8
#: Texts that are put in a turn's place to find where its own text stands.
PROBES = ("\ue000", "\ue001")
#: Strings that steer a model and so never stand unescaped inside a text.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, CLOSE = CONTROL[0], CONTROL[1]
_FIND = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))
_UNESCAPE = re.compile(r"\\(\\?)")
_UNESCAPE_ROLE = re.compile(r"\\([\\n]?)")


def escape(text: str) -> str:
    """A backslash is doubled; one is put after the first character of a control string."""
    return _FIND.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    """As ``escape``; a line feed becomes a backslash and an n, as it ends the role."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _UNESCAPE_ROLE.sub(lambda m: {"n": "\n"}.get(m[1], m[1]), role)


@lru_cache(maxsize=512)
def _block(role: str, text: str) -> str:
    return f"{OPEN}{escape_role(role)}\n{escape(text)}{CLOSE}\n"


def chatml(turns: Sequence[Turn]) -> str:
    """The template of this module: one marked block per turn."""
    return "".join(_block(role, text) for role, text in turns)


def parse_chatml(span: str) -> Turn:
    """Role and text of one turn's span, unescaped."""
    return unescape_role(span[len(OPEN) : span.index("\n")]), unescape(span[span.index("\n") + 1 : span.rindex(CLOSE)])


@dataclass(frozen=True)
class Template:
    """``render`` is the black box; ``read`` and ``unescape`` are only for reading its output back."""

    render: Callable[[Sequence[Turn]], str]
    independent: bool = False
    read: Callable[[str], Turn] | None = None
    unescape: Callable[[str], str] = str


CHATML = Template(chatml, True, parse_chatml, unescape)


@dataclass(frozen=True)
class Span:
    """What one more turn does to the output: ``kept`` code points of it stay and ``added`` follows; the place of the turn's text in ``added``."""

    kept: int
    added: str
    rewritten: bool
    start: int | None = None
    end: int | None = None


def _alike(a: str, b: str) -> int:
    """How many code points two strings begin with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def text_place(render: Callable, before: list[Turn], turn: Turn, output: str) -> tuple[int, int] | None:
    """Where the last turn's text stands in ``output``, found by rendering other texts in its place."""
    a, b = (render([*before, (turn[0], probe)]) for probe in PROBES)
    head, tail = _alike(a, b), _alike(a[::-1], b[::-1])
    end = len(output) - tail
    if a[head : len(a) - tail] != PROBES[0]:
        return None  # left out, changed or repeated
    return (head, end) if head <= end and output.startswith(a[:head]) and output.endswith(a[len(a) - tail :]) else None


def rendered(template: Template, turns: Iterator[Turn], placed: Callable[[Turn], bool] = lambda turn: False) -> Iterator[Span]:
    """A span for each turn of one conversation; the text's place is looked for where ``placed`` says so."""
    before: list[Turn] = []
    output, gone, n = "", 0, 0  # the output of ``before``, and the code points of turns that are no longer in it
    for turn in turns:
        if template.independent and n >= FULL:
            dropped = template.render(before[: len(before) - CONTEXT])
            before = before[len(before) - CONTEXT :]
            output, gone = template.render(before), gone + len(dropped)
        now = template.render([*before, turn])
        kept = len(output) if now.startswith(output) else _alike(output, now)
        place = text_place(template.render, before, turn, now) if kept == len(output) and placed(turn) else None
        yield Span(gone + kept, now[kept:], kept < len(output), *(None, None) if place is None or place[0] < kept else (place[0] - kept, place[1] - kept))
        if kept < len(output) and template.independent:
            raise ValueError("a template that declares its turns independent rewrites history")
        before.append(turn)
        output, n = now, n + 1


_SPANS = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("formatted", pa.string()), ("kept", pa.int64()), ("rewritten", pa.bool_()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("in_loss", pa.bool_())])
_SPANS_DDL = "conv_id long, turn_no long, formatted string, kept long, rewritten boolean, text_start long, text_end long, in_loss boolean"


def _ordered(conversations: DataFrame) -> DataFrame:
    """One conversation's turns together and in order; nothing is gathered in memory."""
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), F.coalesce(conversations["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(conversations["text"].cast("string"), F.lit("")).alias("text")
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def is_assistant(turn: Turn) -> bool:
    return turn[0] == "assistant"


def format_turns(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per turn: its part of the formatted conversation, how much of the output before it stays, and the place of an assistant's text in the part.

    The loss mask covers the text of the assistant's turns.
    """

    def run(batches):
        def turns():
            for batch in batches:
                yield from zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True)

        def rows():
            for conv_id, mine in groupby(turns(), key=lambda t: t[0]):
                for no, s in enumerate(rendered(template, ((role, text) for _, role, text in mine), is_assistant)):
                    yield conv_id, no, s.added, s.kept, s.rewritten, s.start, s.end, s.start is not None

        yield from emit(_SPANS, rows(), lambda r: len(r[2]))

    return _ordered(conversations).mapInArrow(run, _SPANS_DDL)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation, from ``format_turns``'s output alone, by the template's own ``read`` and ``unescape``.

    It takes the partitions as ``format_turns`` leaves them, each conversation
    whole and in order, and keeps two running digests for the current one.
    """

    def run(batches):
        def rows():
            conv, state = None, None
            for batch in batches:
                for conv_id, _, span, kept, _, start, end, in_loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if state is None or conv_id != conv:
                        if state:
                            yield _closed(conv, state)
                        conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    role, text = template.read(span)
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if in_loss:
                        masked = template.unescape(span[start:end])
                        state[2] += len(masked)
                        state[3].update(masked.encode())
                    state[4] = kept + len(span)
            if state:
                yield _closed(conv, state)

        yield from emit(_DIGEST, rows(), lambda r: 200)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _closed(conv, s) -> tuple:
    return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(given.unionByName(more)))


def _lengthened(column: str, *more: str) -> str:
    """SQL: code points of the escaped column."""
    grown = [f"(length({column}) - length(replace({column}, '{x}', ''))) / {len(x)}" for x in ("\\", *CONTROL, *more)]
    return f"length({column}) + " + " + ".join(f"cast({g} as bigint)" for g in grown)


OP9_SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum({len(OPEN) + len(CLOSE) + 2} + {_lengthened("role", chr(10))} + {_lengthened("text")}) as bigint) as formatted_chars
from t group by conv_id
"""
