"""Chat formatting with a template that is only called, never looked into."""

from __future__ import annotations

import os.path
import re
from collections.abc import Callable, Collection, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Turn = tuple[str, str]
Render = Callable[[Sequence[Turn]], str]

BEGIN, OPEN, CLOSE = "<s>", "[TURN ", "[/TURN]\n"
#: Strings that must not be mistaken for marks: those of this template and of common others.
CONTROLS = ["<s>", "</s>", "<|", "[INST]", "[/INST]", "[TURN", "[/TURN]"]
#: Stands for a turn's text while its place is looked for.
PROBE = "\x02\x03\x02"


def escape(text: str) -> str:
    """Double every backslash, and put one behind the first character of each control string."""
    text = text.replace("\\", "\\\\")
    for control in CONTROLS:
        text = text.replace(control, f"{control[0]}\\{control[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def render(turns: Sequence[Turn]) -> str:
    """``<s>``, then for each turn ``[TURN role]``, a line break, the text, ``[/TURN]`` and a line break."""
    marked = [f"{OPEN}{escape(role).replace(']', chr(92) + ']')}]\n{escape(text)}{CLOSE}" for role, text in turns]
    return BEGIN + "".join(marked)


_TURN = re.compile(r"\[TURN ((?:[^\]\\]|\\.)*)\]\n((?:[^\\\[]|\\.|\[(?!/TURN\]\n))*)\[/TURN\]\n", re.DOTALL)


def read_back(formatted: str) -> list[Turn]:
    """The turns of a text that ``render`` has made."""
    turns, at = [], len(BEGIN)
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def spans(template: Render, turns: Sequence[Turn], loss_roles: Collection[str]) -> tuple[str, list[dict], int | None]:
    """The formatted text, the span of each turn, and the first turn that changed what was rendered before it.

    Successive prefixes are rendered and neighbours compared: what a prefix adds is its last turn's span.  The
    place of a text inside the span of a turn with loss is found by rendering a probe instead of it.
    A template that rewrites its history is reported with the turn that made it do so; the spans of turns up to
    there no longer hold, and a turn then begins where the two outputs part.
    """
    before, found, rewritten = template([]), [], None
    for k, (role, text) in enumerate(turns, 1):
        after = template(turns[:k])
        start = len(before)
        if not after.startswith(before):
            start = len(os.path.commonprefix([before, after]))
            rewritten = k if rewritten is None else rewritten
        span = {"role": role, "start": start, "end": len(after), "text_start": None, "text_end": None}
        if role in loss_roles:
            probed = template([*turns[: k - 1], (role, PROBE)])
            head = probed.rfind(PROBE)
            if head >= start:
                span |= {"text_start": head, "text_end": len(after) - (len(probed) - head - len(PROBE))}
        found.append(span)
        before = after
    return before, found, rewritten


_SPAN = T.StructType(
    [T.StructField("role", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("start", "end", "text_start", "text_end")]]
)
_ARROW_SPAN = pa.struct([("role", pa.string()), *[(n, pa.int64()) for n in ("start", "end", "text_start", "text_end")]])


def format_chats(
    turns: DataFrame, template: Render = render, loss_roles: Collection[str] = ("assistant",), conv_id: str = "conv_id",
    turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``spans`` (role, start, end, text_start, text_end; in
    characters) and ``rewritten`` (the first turn at which the template rewrote its history, else null).

    The loss mask of a conversation is the text spans that are not null.  Turns are ordered by number, then role, then
    text; repeated rows are turns of their own; a null number comes first.  Null roles and texts count as empty.
    Rows without a conversation identifier form one conversation with a null identifier.  An empty table gives an
    empty result.  Further columns are not read.  One conversation is one text, and is formatted by one task.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    talks = talks.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    kind = talks.schema["conv_id"]
    schema = T.StructType(
        [kind, T.StructField("formatted", T.StringType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("rewritten", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [
                    spans(template, [(t["role"], t["text"]) for t in talk.as_py()], loss_roles) for talk in part.column(1)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([m[0] for m in made], pa.string()),
                     pa.array([m[1] for m in made], pa.list_(_ARROW_SPAN)), pa.array([m[2] for m in made], pa.int64())],
                    schema.fieldNames(),
                )

    return talks.mapInArrow(run, schema)
