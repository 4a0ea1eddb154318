"""Chat formatting: conversations rendered by a compiled template, with a loss mask, and read back.

The template marks turns by control strings. Inside texts and roles, a backslash is doubled and a control string gets a backslash
after its first character, so no text can end its own turn, and reading back undoes exactly that.

Rows meet by conversation in sorted partitions that are read turn by turn; one conversation becomes one text, so it is the unit
of memory. Turns are ordered by turn, then role, then text, nulls first.

Results: a null text or role is empty; rows that repeat are turns that repeat; a null conversation id is a conversation of its own;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import over_batches
from .template import compiled

# fixed values: the control strings of the template below
CONTROLS = ("[INST]", "[/INST]", "[OUT]", "</s>", "[ROLE]", "[/ROLE]", "[END]")
TEMPLATE = (
    '{% for m in messages %}{% if m.role == "user" %}[INST] {{ m.text | escape }} [/INST]'
    '{% elif m.role == "assistant" %}[OUT] {% generation %}{{ m.text | escape }}{% endgeneration %}</s>'
    "{% else %}[ROLE]{{ m.role | escape }}[/ROLE]{{ m.text | escape }}[END]{% endif %}{% endfor %}"
)
#: What opens a turn: how the role is known, and what closes its text.
TURNS = {"[INST] ": ("user", " [/INST]"), "[OUT] ": ("assistant", "</s>"), "[ROLE]": (None, "[END]")}
_GUARDED = r"\\|" + "|".join(re.escape(c) for c in CONTROLS)


def escape(text: str | None) -> str:
    return re.sub(_GUARDED, lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text or "")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read_turns(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered conversation."""
    out, at = [], 0
    while at < len(text):
        opener = next((o for o in TURNS if text.startswith(o, at)), None)
        if opener is None:
            raise ValueError(f"no turn starts at {at}")
        role, closer = TURNS[opener]
        at += len(opener)
        if role is None:
            end = text.index("[/ROLE]", at)
            role, at = unescape(text[at:end]), end + len("[/ROLE]")
        end = text.index(closer, at)
        out.append((role, unescape(text[at:end])))
        at = end + len(closer)
    return out


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, text, spans): each conversation rendered; ``spans`` are the (start, end) characters under the loss mask."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    compiled(template, {"escape": escape})  # a template that cannot be compiled fails here, before any task

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = compiled(template, {"escape": escape})
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        now, messages, ids, texts, spans, size = None, [], [], [], [], 0

        def close() -> int:
            text, marked = draw({"messages": messages})
            ids.append(now)
            texts.append(text)
            spans.append([{"start": a, "end": b} for a, b in marked])
            return len(text)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(texts, pa.string()), pa.array(spans, kind)], ["conv_id", "text", "spans"])

        for b in batches:
            id_type = b.column("conv_id").type
            for conv, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
                if messages and conv != now:
                    size += close()
                    messages = []
                    if size > 1 << 22:
                        yield batch()
                        ids, texts, spans, size = [], [], [], 0
                now = conv
                messages.append({"role": role, "text": text})
        if messages:
            close()
        if ids:
            yield batch()

    kind = dict(rows.dtypes)["conv_id"]
    return over_batches(dealt.select("conv_id", "role", "text"), render, f"conv_id {kind}, text string, spans array<struct<start: bigint, end: bigint>>")


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted_chars) from rendered text alone; ``loss`` are the unescaped texts under the mask."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns, loss, size = [], [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                turns.append([{"role": r, "text": t} for r, t in read_turns(text)])
                loss.append([unescape(text[x["start"]:x["end"]]) for x in spans])
                size.append(len(text))
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), pa.array(turns, kind), pa.array(loss, pa.list_(pa.string())), pa.array(size, pa.int64())],
                ["conv_id", "turns", "loss", "formatted_chars"])

    kind = dict(rendered.dtypes)["conv_id"]
    return over_batches(rendered, read, f"conv_id {kind}, turns array<struct<role: string, text: string>>, loss array<string>, formatted_chars long")
