"""Chat formatting with a grammar round trip.

Each turn is rendered between the marks of its role. A deterministic parser
reads the rendered turn back; where role or text differ from the source, the
content's control strings are escaped by a backslash and the turn is
rendered again, until the two are identical. The marks that open a turn
begin differently and a turn ends at the first closing mark of its role, so
that turns that read back alone read back in any sequence.

Grammar: user `[INST] text [/INST]`, assistant ` text </s>`, system
`<<SYS>>\\ntext\\n<</SYS>>\\n`, any other role `[ROLE name] text [/ROLE]`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from riskweave.llm.frames import batch, with_fallback

# The marks of the template.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n")}
OTHER_OPEN, OTHER_CLOSE = "[ROLE ", " [/ROLE]"
CONTROL = re.compile(r"\\|\[/?INST\]|\[/?ROLE|</?s>|<</?SYS>>")
NAME = re.compile(r"[\\\]]")
ESCAPED = re.compile(r"\\(.)", re.S)

TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                   ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
RESULT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def escape(content: str, control: re.Pattern = CONTROL) -> str:
    return control.sub(lambda m: "\\" + m.group(), content)


def unescape(content: str) -> str:
    return ESCAPED.sub(r"\1", content)


def parse(rendered: str, at: int = 0) -> tuple[str, str, int, int, int] | None:
    """The turn at ``at``: (role, text, start and end of its raw content,
    end of the turn), or None if the grammar has none there."""
    for role, (opening, closing) in MARKS.items():
        if rendered.startswith(opening, at):
            start = at + len(opening)
            end = rendered.find(closing, start)
            return None if end < 0 else (role, unescape(rendered[start:end]), start, end, end + len(closing))
    if not rendered.startswith(OTHER_OPEN, at):
        return None
    name = re.compile(r"((?:\\.|[^\\\]])*)\] ", re.S).match(rendered, at + len(OTHER_OPEN))
    end = rendered.find(OTHER_CLOSE, name.end()) if name else -1
    return None if end < 0 else (unescape(name.group(1)), unescape(rendered[name.end():end]), name.end(), end, end + len(OTHER_CLOSE))


def parse_all(rendered: str) -> list[tuple[str, str]]:
    """All (role, text) turns of a rendered conversation."""
    out, at = [], 0
    while at < len(rendered):
        turn = parse(rendered, at)
        if turn is None:
            raise ValueError(f"no turn at {at}")
        out.append(turn[:2])
        at = turn[4]
    return out


def render(role: str, text: str) -> tuple[str, str, str, int, int]:
    """(formatted turn, role and text read back from it, start and end of
    the content in it); escapes until what is read back is the source."""
    for content in (text, escape(text)):
        opening, closing = MARKS.get(role) or (f"{OTHER_OPEN}{escape(role, NAME)}] ", OTHER_CLOSE)
        formatted = opening + content + closing
        turn = parse(formatted)
        if turn and turn[:2] == (role, text) and turn[4] == len(formatted):
            return formatted, turn[0], turn[1], turn[2], turn[3]
    raise ValueError(f"a turn of role {role!r} does not read back")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text as read back, formatted, and the loss
    mask (loss_start, loss_end: content of an assistant turn in formatted,
    code points; else null). Null role and null text count as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [render(r or "", t or "") for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
            mask = [(s, e) if role == "assistant" else (None, None) for _, role, _, s, e in rows]
            yield batch(TURNS, conv_id=b.column("conv_id"), turn=b.column("turn"), role=[r[1] for r in rows], text=[r[2] for r in rows],
                        formatted=[r[0] for r in rows], loss_start=[m[0] for m in mask], loss_end=[m[1] for m in mask])

    return with_fallback(conversations, conv_id="bigint", turn="bigint", role="string", text="string").mapInArrow(
        run, "conv_id bigint, turn bigint, role string, text string, formatted string, loss_start bigint, loss_end bigint")


def digest_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted turns in order:
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are ordered by turn (null first), then role, then text. A null
    conv_id is a conversation of its own. A conversation is streamed in
    order through its digests, so that its length needs no memory.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None

        def ended() -> pa.RecordBatch:
            return batch(RESULT, conv_id=[state["conv_id"]], n_turns=[state["n"]], turns_sha256=[state["turns"].hexdigest()],
                         loss_chars=[state["loss_chars"]], loss_sha256=[state["loss"].hexdigest()], formatted_chars=[state["chars"]])

        for b in batches:
            done = []
            for conv_id, formatted, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if state is None or state["conv_id"] != conv_id:
                    if state is not None:
                        done.append(ended())
                    state = {"conv_id": conv_id, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                role, text, *_ = parse(formatted)
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode())
                state["chars"] += len(formatted)
                if start is not None:
                    masked = unescape(formatted[start:end])
                    state["loss"].update(masked.encode())
                    state["loss_chars"] += len(masked)
            yield from done
        if state is not None:
            yield ended()

    order = ["conv_id", "turn", "role", "text"]
    return turns.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
