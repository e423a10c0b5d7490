"""Chat formatting: a finite-state machine over roles, a declarative template, text segments with loss flags.

Rows of a conversation are brought together and sorted, and stream through their task turn by turn: the machine's state
and the digests carry over from batch to batch, so a conversation of any length takes constant memory. The segments of a
conversation are joined to one string with the spans under loss; what is read back is this string, by its marks alone.

A turn is written as `### <role>: `, the text, ` </turn>` and a line end. Inside texts (and roles that the template does not
name) a backslash is put before every backslash and every control string, so that an unescaped control string is always
the template's; reading back takes the character after a backslash as it is.

Defined results: a null text is empty; a null role is the empty role; a null conv_id is a conversation of its own; turns
with the same number go by role, then text, nulls first; repeated rows are turns of their own; conversations whose order
the machine rejects are formatted all the same and marked invalid with the first bad turn; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Code points of formatted text in one row; a longer conversation goes on in the next.
PART_CHARS = 1 << 20
#: Code points of formatted text that are put out together.
BATCH_CHARS = 1 << 23
#: Turns that are segments at the same time.
TURNS = 512


@dataclass(frozen=True)
class Template:
    """How turns are marked, which roles carry loss, and which role may follow which ("" is the start)."""

    head: str = "### "
    after_role: str = ": "
    tail: str = " </turn>\n"
    end: str = "</turn>"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"})
    loss_roles: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user", "tool"}),
            "tool": frozenset({"assistant", "tool"}),
        }
    )

    def escape(self, text: str) -> str:
        return re.sub("|".join(map(re.escape, ("\\", self.head, self.end))), lambda m: "\\" + m[0], text)

    def role_mark(self, role: str) -> str:
        """The template's name of a role, or @ and the escaped role."""
        return self.names[role] if role in self.names else "@" + self.escape(role).replace(":", "\\:")

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn as (text, under loss), to be concatenated."""
        return [(f"{self.head}{self.role_mark(role)}{self.after_role}", False), (self.escape(text), role in self.loss_roles), (self.tail, False)]

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def ends(self, text: str) -> Iterator[int]:
        """Where each turn ends in a formatted text: after every end mark that no backslash escapes."""
        at = 0
        while (at := text.find(self.end, at)) >= 0:
            before = at
            while before and text[before - 1] == "\\":
                before -= 1
            at += len(self.end)
            if (at - len(self.end) - before) % 2 == 0:
                at += len(self.tail) - self.tail.index(self.end) - len(self.end)
                yield at

    def parse(self, turn: str) -> tuple[str, str]:
        """role and text of one formatted turn."""
        if not turn.startswith(self.head) or not turn.endswith(self.tail):
            raise ValueError("not a formatted turn")
        mark = re.match(rf"((?:[^\\:]|\\.)*){re.escape(self.after_role)}", turn[len(self.head) :], flags=re.DOTALL)
        if mark is None:
            raise ValueError("a turn without a role")
        role = self.unescape(mark[1][1:]) if mark[1].startswith("@") else {v: k for k, v in self.names.items()}[mark[1]]
        body = turn[len(self.head) + mark.end() : -len(self.tail)]
        if re.search(rf"(?<!\\)(?:\\\\)*(?:{re.escape(self.head)}|{re.escape(self.end)})", body):
            raise ValueError("a control string inside a turn")
        return role, self.unescape(body)


def in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with each conversation whole and sorted in one partition."""
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _turns(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    """Turns in order as segments, with the machine's state; what format_turns gives for each batch."""
    now, index, state, ok = object(), 0, "", True
    kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
    for batch in batches:
        indices, oks, segments = [], [], []
        for conv, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist()):
            if conv != now:
                now, index, state, ok = conv, 0, "", True
            ok = ok and role in template.follows.get(state, ())
            segments.append([{"text": t, "loss": loss} for t, loss in template.segments(role, text)])
            indices.append(index)
            oks.append(ok)
            index, state = index + 1, role
        yield pa.RecordBatch.from_arrays([batch["conv_id"], pa.array(indices, pa.int64()), pa.array(segments, kind), pa.array(oks, pa.bool_())], ["conv_id", "turn_index", "segments", "state_ok"])


def format_turns(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """A row per turn, in order: conv_id, turn_index (from 0), segments (text, loss), state_ok (no bad turn so far)."""
    template = template or Template()
    return in_order(conversations).mapInArrow(lambda batches: _turns(batches, template), "conv_id bigint, turn_index bigint, segments array<struct<text: string, loss: boolean>>, state_ok boolean")


PARTS = "conv_id bigint, part bigint, text string, loss array<struct<start: bigint, end: bigint>>, first_bad_turn bigint"


def format_conversations(conversations: DataFrame, template: Template | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """Every conversation as one formatted string, in order: conv_id, part (from 0), text, loss, first_bad_turn.

    loss: the spans [start, end) of text, in code points, that are under loss. A string of more than part_chars code points
    goes on in the next part; neither a mark of the template nor an escaped character is cut in two. first_bad_turn: the
    first turn so far that the machine rejects.
    """
    template = template or Template()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, bad = object(), 0, None
        text: list[str] = []
        spans: list[list[int]] = []
        size, rows, held = 0, [], 0

        def put() -> None:
            """Ends the part."""
            nonlocal part, size, held, text, spans
            if size:
                rows.append((now, part, "".join(text), [{"start": a, "end": b} for a, b in spans], bad))
                part, held = part + 1, held + size
                text, spans, size = [], [], 0

        def batch_of() -> pa.RecordBatch:
            nonlocal rows, held
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), kind, pa.int64()))], ["conv_id", "part", "text", "loss", "first_bad_turn"])
            rows, held = [], 0
            return out

        small = (batch.slice(i, TURNS) for batch in batches for i in range(0, batch.num_rows, TURNS))
        for batch in _turns(small, template):
            for conv, index, segments, ok in zip(batch["conv_id"].to_pylist(), batch["turn_index"].to_pylist(), batch["segments"], batch["state_ok"].to_pylist()):
                if conv != now:
                    put()
                    now, part, bad = conv, 0, None
                bad = index if bad is None and not ok else bad
                for which, segment in enumerate(segments.as_py()):
                    whole, at = segment["text"], 0
                    while at < len(whole):
                        cut = len(whole)
                        if which == 1 and cut - at > part_chars - size:
                            cut = at + max(part_chars - size, 0)
                            slashes = cut - at - len(whole[at:cut].rstrip("\\"))
                            cut += slashes % 2  # an escaped character stays with its backslash
                        piece = whole[at:cut]
                        if segment["loss"] and piece:
                            if spans and spans[-1][1] == size:
                                spans[-1][1] += len(piece)
                            else:
                                spans.append([size, size + len(piece)])
                        text.append(piece)
                        size, at = size + len(piece), cut
                        if size >= part_chars:
                            put()
                            if held >= BATCH_CHARS:
                                yield batch_of()
            if rows:
                yield batch_of()
        put()
        if rows:
            yield batch_of()

    return in_order(conversations).mapInArrow(of, PARTS)


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """A row per conversation from format_conversations' rows: counts and digests of what the strings and their spans say.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, first_bad_turn. Turns are found by the
    unescaped end marks in the string, roles by the marks before them.
    """
    template = template or Template()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "first_bad_turn"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row, done = object(), None, []
        begun: list[str] = []  # what earlier parts hold of a turn that goes on

        def close() -> None:
            if any(begun):
                raise ValueError(f"conversation {now} ends within a turn")
            if row is not None:
                row[2], row[4] = row[2].hexdigest(), row[4].hexdigest()
                done.append(row)

        for batch in batches:
            for conv, text, loss, bad in zip(batch["conv_id"].to_pylist(), batch["text"], batch["loss"].to_pylist(), batch["first_bad_turn"].to_pylist()):
                text = text.as_py()
                if conv != now:
                    close()
                    now, row, begun = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, None], []
                row[5] += len(text)
                if bad is not None and row[6]:
                    row[6], row[7] = False, bad
                for span in loss:
                    learned = template.unescape(text[span["start"] : span["end"]])
                    row[3] += len(learned)
                    row[4].update(learned.encode("utf-8", "surrogatepass"))
                start = 0
                for end in template.ends(text):
                    role, said = template.parse("".join([*begun, text[start:end]]))
                    begun, start = [], end
                    row[1] += 1
                    row[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if start < len(text):
                    begun.append(text[start:])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

    return formatted.mapInArrow(of, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean, first_bad_turn bigint")
