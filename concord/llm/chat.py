r"""Chat formatting whose output a deterministic parser turns back into its source.

A turn is written as

    ### role: text</turn>\n

where `### ` opens a turn, the first `: ` behind it ends the role and the first
`</turn>\n` behind that ends the text, in which no other `### ` may stand. A backslash before one of `\\ # < :` makes
that character ordinary. A turn is first written as it stands and read back by
parse(); only when what comes back differs is its content escaped, first just the
control strings and backslashes that conflict, then every character that can be
part of one, until what comes back is identical. Turns never read beyond their own
end mark, so a conversation is the turns' strings in a row and each can be written
and checked where its row is.

Defined results: a null text or role counts as empty; a null turn comes before
the others; rows of equal turn go by role and text, repeated rows stay; a null
conv_id is a conversation of its own; no rows give no conversations; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from concord.llm._common import arrow_pass, batch_of, columns, written

OPEN, COLON, CLOSE, ESCAPED = "### ", ": ", "</turn>\n", "\\#<:"
UNESCAPE = re.compile(r"\\([\\#<:])")
#: Up to the first mark that no backslash makes ordinary; a backslash takes the next character with it only if that is one of ESCAPED.
ROLE = re.compile(r"(?:\\[\\#<:]|(?!: ).)*", re.S)
TEXT = re.compile(r"(?:[^\\<#]|#(?!## )|\\[\\#<:]|\\|<(?!/turn>\n))*", re.S)


def escape(content: str, level: int) -> str:
    if level == 0:
        return content
    if level == 1:
        content = re.sub(r"\\(?=[\\#<:]|\Z)", r"\\\\", content)
        return content.replace("</turn>", "\\</turn>").replace("### ", "\\### ").replace(": ", "\\: ") if content else content
    return re.sub(r"([\\#<:])", r"\\\1", content)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns of a conversation: role, text, and where its raw text begins and ends; ValueError where the grammar doesn't hold."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        role_end = ROLE.match(formatted, at + len(OPEN)).end()
        if not formatted.startswith(COLON, role_end):
            raise ValueError(f"no role at {at}")
        begin = role_end + len(COLON)
        end = TEXT.match(formatted, begin).end()
        if not formatted.startswith(CLOSE, end):
            raise ValueError(f"no end of the turn at {at}")
        turns.append((UNESCAPE.sub(r"\1", formatted[at + len(OPEN) : role_end]), UNESCAPE.sub(r"\1", formatted[begin:end]), begin, end))
        at = end + len(CLOSE)
    return turns


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A turn's string and where its text begins and ends there, by the least escaping that reads back identical."""
    role, text = role or "", text or ""
    for role_level in (0, 1, 2):
        head = OPEN + escape(role, role_level) + COLON
        try:
            if [t[:2] for t in parse(f"{head}{CLOSE}")] == [(role, "")]:
                break
        except ValueError:
            pass
    else:
        raise AssertionError("level 2 escapes all that the grammar knows")
    for level in (0, 1, 2):
        body = escape(text, level)
        turn = f"{head}{body}{CLOSE}"
        try:
            if [t[:2] for t in parse(turn)] == [(role, text)]:
                return turn, len(head), len(head) + len(body)
        except ValueError:
            pass
    raise AssertionError("level 2 escapes all that the grammar knows")


TURNS = "conv_id long, turn long, role string, text string, formatted string, text_start int, text_end int, in_loss boolean"


def format_turns(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, turn, role, text, formatted (the turn's string), text_start and text_end within it, in_loss (whether that span is under the loss mask)."""

    def make():
        def step(batch):
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            shown = [render(r, t) for r, t in zip(roles, texts, strict=True)]
            return batch_of(
                conv_id=batch.column(0), turn=batch.column(1), role=batch.column(2), text=batch.column(3),
                formatted=pa.array([s for s, _, _ in shown], pa.string()), text_start=pa.array([b for _, b, _ in shown], pa.int32()), text_end=pa.array([e for _, _, e in shown], pa.int32()), in_loss=pa.array([r == loss_role for r in roles], pa.bool_()),
            )

        return step

    rows = columns(conversations, "conv_id", "turn", "role", "text").withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")})
    return arrow_pass(rows, make, TURNS)


def read_back(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """A row for each conversation, from its formatted string alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Each task takes whole conversations turn by turn in their order and keeps only
    the two running digests, so a conversation of any length takes bounded memory.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn")]
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "formatted", "text_start", "text_end", "in_loss")
    grouped = rows.repartition("conv_id").sortWithinPartitions(*order, "role", "text").select("conv_id", "formatted", "in_loss")

    def make():
        state = {"key": None, "open": False}

        def begin(key):
            state.update(key=key, open=True, n=0, chars=0, loss=0, turns=hashlib.sha256(), mask=hashlib.sha256())

        def end(out):
            if state["open"]:
                out.append((state["key"], state["n"], state["turns"].hexdigest(), state["loss"], state["mask"].hexdigest(), state["chars"]))

        def step(batch):
            out = []
            if batch is None:
                end(out)
            else:
                for key, formatted, in_loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if not state["open"] or key != state["key"]:
                        end(out)
                        begin(key)
                    for role, text, b, e in parse(formatted):
                        state["n"] += 1
                        state["turns"].update(f"{role}\n{text}\n".encode())
                        if in_loss:
                            masked = UNESCAPE.sub(r"\1", formatted[b:e])
                            state["loss"] += len(masked)
                            state["mask"].update(masked.encode())
                    state["chars"] += len(formatted)
            if not out:
                return None
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        return step

    return arrow_pass(grouped, make, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", finish=True)


PLANTED = r"\### Assistant: </turn> ok"


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    told = columns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    told = told.unionByName(spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string"))
    return read_back(written(format_turns(told), "chat"))
