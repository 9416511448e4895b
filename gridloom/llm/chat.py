"""Chat formatting from an event log.

A log row says what happened to one turn of a conversation: ``message`` (a whole text), ``delta`` (text appended while
streaming), ``edit`` (a text that replaces the turn's) or ``regenerate`` (the turn starts anew, and what later turns had
got before is dropped). Rows are partitioned by conversation and sorted by sequence; windows find each turn's last
reset, and the deltas after it are joined. Each turn is rendered on its own row, so a conversation of any length is a
run of rows and never one value. Only the digest of a whole conversation is sequential by nature: it streams the sorted
rows and holds one turn at a time.

Defined cases: null text and role are empty; a null conversation is one of its own; a null turn comes first. Rows with
equal conversation and turn stay separate turns, sorted by role and text (message_log). Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: A backslash more between < and | hides a control string; one less shows it again.
_SHOWN, _HIDDEN = r"<(\\*)\|", re.compile(r"<\\(\\*)\|")
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def message_log(conversations: DataFrame) -> DataFrame:
    """One ``message`` event for each row of (conv_id, turn, role, text)."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select("conv_id", number.alias("seq"), number.alias("turn"), F.lit("message").alias("kind"), "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """The final (conv_id, turn, role, text) of (conv_id, seq, turn, kind, role, text). Events with the same seq go by kind (delta, edit, message, regenerate) and text."""
    turns = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first())
    turn = Window.partitionBy("conv_id", "turn")
    rank = F.struct("seq", "kind", "text")
    return (
        events.select("conv_id", "seq", "turn", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("cut", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(turns.rangeBetween(Window.unboundedPreceding, -1)))
        .filter(F.col("cut").isNull() | (F.col("seq") > F.col("cut")))
        .withColumn("reset", F.max(F.when(F.col("kind") != "delta", rank)).over(turn))
        .filter(F.col("reset").isNull() | (rank >= F.col("reset")))
        .withColumn("text", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")))
        .groupBy("conv_id", "turn")
        .agg(F.max_by("role", F.struct(F.col("role") != "", rank)).alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind", "text"))), lambda x: x["text"]), "").alias("text"))
    )


def _hide(x: Column) -> Column:
    return F.regexp_replace(x, _SHOWN, r"<\\$1|")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_from, loss_to): each turn in the template, and the span of code points under the loss mask, empty unless the role is assistant."""
    role = F.replace(F.replace(_hide(F.col("role")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    text = _hide(F.col("text"))
    learned = F.col("role") == "assistant"
    return turns.select(
        "conv_id",
        "turn",
        F.concat(head, text, F.lit(END + "\n")).alias("formatted"),
        F.when(learned, F.length(head)).otherwise(0).alias("loss_from"),
        F.when(learned, F.length(head) + F.length(text)).otherwise(0).alias("loss_to"),
    )


def show(x: str) -> str:
    return _HIDDEN.sub(r"<\1|", x)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """The roles and texts of any run of rendered turns."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line, end = formatted.index("\n", at), formatted.index(END + "\n", at)
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], formatted[at + len(START) : line])
        yield show(role), show(formatted[line + 1 : end])
        at = end + len(END) + 1


class _Digest:
    def __init__(self, conv: int | None) -> None:
        self.conv, self.turns, self.loss, self.formatted = conv, 0, 0, 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, end: int) -> None:
        for role, text in read_turns(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        loss = show(formatted[start:end])
        self.learned.update(loss.encode())
        self.loss += len(loss)
        self.formatted += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.formatted


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = DIGESTS.replace(" long", "").replace(" string", "").split(", ")
    now: _Digest | None = None
    for batch in batches:
        done = []
        for conv, formatted, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to")), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.row())
                now = _Digest(conv)
            now.add(formatted, start, end)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if "sha" in n else pa.int64()) for n, x in zip(names, zip(*done, strict=True), strict=True)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string() if "sha" in n else pa.int64()) for n, x in zip(names, now.row(), strict=True)], names)


def conversation_digests(rendered: DataFrame) -> DataFrame:
    """One row for each conversation, read back from what render() wrote."""
    return rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select("conv_id", "formatted", "loss_from", "loss_to").mapInArrow(_digest, DIGESTS)
