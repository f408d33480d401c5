"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id long, turn long, kind string, text string, loss boolean, valid boolean"


@dataclass(frozen=True)
class Template:
    """What marks a turn, which roles bear loss, and which role may follow which.

    `allowed` maps a state (the last role, or "" at the start) to the roles that may come
    next; a conversation is valid if every step is allowed and it ends on an `ends` role.
    """

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    allowed: dict[str, frozenset[str]] = field(
        default_factory=lambda: {"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})}
    )
    ends: frozenset[str] = frozenset({"assistant"})

    def follows(self, state: str, role: str) -> bool:
        return role in self.allowed.get(state, ())


def escape(text: str) -> str:
    """No control string is left in a text: every `<`, backslashes, `|` gets one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    """The inverse of `escape`."""
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """Roles stand on the marker's line, so line ends and `<` in them are percent-encoded."""
    return role.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C")


def unescape_role(role: str) -> str:
    """The inverse of `escape_role`."""
    return role.replace("%3C", "<").replace("%0A", "\n").replace("%25", "%")


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Text segments (conv_id, turn, kind, text, loss, valid) of all conversations, in order within each partition.

    A turn gives three segments: the head (marker and role), the escaped text, which bears
    loss for the template's roles, and the tail.  A conversation's segments joined are its
    formatted text.  `turn` counts from 0 in the order of the turn column; rows that share a
    turn number are taken by role and text, and nulls come first.  `valid` tells whether the
    machine accepted the turns so far.  Null texts and roles are empty; null conv_ids are
    one conversation.  Rows are streamed, so a conversation may be longer than memory.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, turn, valid = object(), "", 0, True
        for batch in batches:
            out = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != current:
                    current, state, turn, valid = conv, "", 0, True
                valid = valid and template.follows(state, role)
                loss = role in template.loss_roles
                out.append((conv, turn, "head", template.open + escape_role(role) + template.after_role, False, valid))
                out.append((conv, turn, "text", escape(text), loss, valid))
                out.append((conv, turn, "tail", template.close, False, valid))
                state, turn = role, turn + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _ARROW, strict=True)], names=_NAMES)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, SEGMENTS)


_ARROW = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
_NAMES = ["conv_id", "turn", "kind", "text", "loss", "valid"]


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """What a reader of the formatted text finds, a row for each conversation.

    Turns are parsed from the joined segments by the template's markers alone and their
    texts unescaped; the loss text is taken from the segments' flags.  Digests are fed turn
    by turn.  Takes segments as `format_conversations` leaves them: whole and in order
    within partitions.  `valid` also needs a closing role.
    """
    template = template or Template()
    turn_of = re.compile(re.escape(template.open) + r"([^\n]*)" + re.escape(template.after_role) + r"(.*?)" + re.escape(template.close), re.DOTALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: dict | None = None
        held = ""
        for batch in batches:
            done = []
            for conv, text, loss, valid in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if current is None or conv != current["conv_id"]:
                    done += [_digest(current, template)] if current else []
                    current, held = {"conv_id": conv, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "valid": True, "last": ""}, ""
                current["chars"] += len(text)
                current["valid"] &= valid
                if loss:
                    said = unescape(text)
                    current["loss_chars"] += len(said)
                    current["loss"].update(said.encode())
                held += text
                if text == template.close and (found := turn_of.fullmatch(held)):
                    role, said = unescape_role(found[1]), unescape(found[2])
                    current["turns"].update(f"{role}\n{said}\n".encode())
                    current["n"] += 1
                    current["last"], held = role, ""
            if done:
                yield _rows(done)
        if current:
            yield _rows([_digest(current, template)])

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def _digest(x: dict, template: Template) -> dict:
    return {"conv_id": x["conv_id"], "n_turns": x["n"], "turns_sha256": x["turns"].hexdigest(), "loss_chars": x["loss_chars"], "loss_sha256": x["loss"].hexdigest(), "formatted_chars": x["chars"], "valid": x["valid"] and x["last"] in template.ends}


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "valid": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))
