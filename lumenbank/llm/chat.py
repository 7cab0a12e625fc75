"""Chat formatting: a state machine over roles, and text segments with loss flags from a declarative template."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Turn:
    """What stands before and after a role's text, and whether the text is learned."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks of each role, other roles' marks, and the allowed steps of the state machine.

    Control strings are a bracket, a slash at most, and a word. Inside texts a
    backslash goes in after the bracket, one more where some stand already, so
    no text holds a control string and taking one out gives the text back.
    """

    roles: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("[SYS] ", " [/SYS]"),
            "user": Turn("[INST] ", " [/INST]"),
            "assistant": Turn(" ", "</s>", loss=True),
        }
    )
    other_open: str = "[ROLE]"
    other_close: str = "[/ROLE] "
    other_after: str = "</s>"
    steps: tuple[tuple[str | None, str], ...] = ((None, "system"), (None, "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"))
    words: str = r"/?s>|/?(?:INST|SYS|ROLE)\]"

    @property
    def escaping(self) -> str:
        return rf"([<\[])(\\*)(?={self.words})"

    @property
    def unescaping(self) -> str:
        return rf"([<\[])\\(\\*)(?={self.words})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.escaping, r"$1\\$2")

    def unescape(self, text: str) -> str:
        return re.sub(self.unescaping, r"\1\2", text)

    def next_turn(self, text: str) -> tuple[str, str, int] | None:
        """Role and text (unescaped) of the turn that ``text`` begins with, and where it ends; None if it isn't whole yet.

        Marks alone tell: texts hold no control string, so the first closing one ends the turn.
        """
        role, before, after = None, "", ""
        if text.startswith(self.other_open):
            at = text.find(self.other_close)
            if at < 0:
                return None
            role, before, after = self.unescape(text[len(self.other_open) : at]), text[: at + len(self.other_close)], self.other_after
        else:
            for name, turn in sorted(self.roles.items(), key=lambda x: -len(x[1].before)):
                if text.startswith(turn.before):
                    role, before, after = name, turn.before, turn.after
                    break
        end = text.find(after, len(before)) if role is not None else -1
        return None if end < 0 else (role, self.unescape(text[len(before) : end]), end + len(after))


SEGMENTS = "array<struct<text:string,loss:boolean>>"


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """A row per turn: conv_id, place, valid, and ``segments`` with their loss flags, in order of conv_id and place.

    Turns go by ``turn``, then role and text, so repeated turns have a fixed
    order; a null turn comes first. A null role or text is empty. ``valid``
    tells whether the state machine allows the step from the role before;
    a turn that it doesn't allow is still formatted. A conversation's turns
    share a partition and are sorted there, and no task holds them at once.
    Other columns are ignored; an empty table gives no rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    in_order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumns({"place": F.row_number().over(in_order), "was": F.lag("role").over(in_order)})
    valid = reduce(lambda a, b: a | b, [F.col("was").eqNullSafe(F.lit(a)) & (F.col("role") == b) for a, b in template.steps])

    def segments(before: Column, after: Column, loss: bool) -> Column:
        part = lambda c, learned: F.struct(c.alias("text"), F.lit(learned).alias("loss"))
        return F.array(part(before, False), part(template.escape(F.col("text")), loss), part(after, False))

    other = segments(F.concat(F.lit(template.other_open), template.escape(F.col("role")), F.lit(template.other_close)), F.lit(template.other_after), False)
    formatted = reduce(lambda rest, r: F.when(F.col("role") == r[0], segments(F.lit(r[1].before), F.lit(r[1].after), r[1].loss)).otherwise(rest), template.roles.items(), other)
    return rows.select("conv_id", "place", valid.alias("valid"), formatted.alias("segments")).sortWithinPartitions("conv_id", "place")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests per conversation of what :func:`format_turns` gave.

    The segments of a conversation are joined into its formatted text, which is
    parsed again by its marks as it grows: neither rows nor segments tell where
    a turn ends. Only the turn that is open is held. What is learned is read
    from the segments under the loss mask.
    """
    schema = StructType.fromDDL(f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, invalid_turns long")

    def run(batches):
        arrow, now, state = to_arrow_schema(schema), object(), None

        def close():
            if state["open"]:
                raise ValueError("a conversation ends within a turn")
            return now, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["invalid"]

        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)
        for batch in batches:
            done = []
            for at in range(batch.num_rows):
                conv, valid, segments = (batch.column(c)[at].as_py() for c in ("conv_id", "valid", "segments"))
                if conv != now:
                    if state:
                        done.append(close())
                    now, state = conv, {"n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "invalid": 0, "open": ""}
                new = "".join(s["text"] for s in segments)
                state["open"] += new
                while turn := template.next_turn(state["open"]):
                    role, text, end = turn
                    state["turns"].update(f"{role}\n{text}\n".encode())
                    state["open"] = state["open"][end:]
                    state["n"] += 1
                learned = "".join(template.unescape(s["text"]) for s in segments if s["loss"])
                state["loss"].update(learned.encode())
                state["loss_chars"] += len(learned)
                state["chars"] += len(new)
                state["invalid"] += not valid
            if done:
                yield pack(done)
        if state:
            yield pack([close()])

    return formatted.mapInArrow(run, schema)
