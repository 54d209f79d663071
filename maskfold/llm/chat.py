"""Chat logs to training text, event-sourced.

A log holds events per conversation: `message` (a whole turn), `delta` (more text of a turn), `edit` (new
text for a turn) and `regenerate` (the turn and all later ones are void; new deltas or messages follow).
Logs are partitioned by conversation and sorted; which events still count is decided by two windows, the
rest is one streaming pass that holds a single message at a time. Output is rendered text in parts of whole
turns with the spans of the loss mask.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that mark turns or ends in common chat templates.
CONTROL = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
PART_CHARS = 1_000_000
EVENTS = "conv_id, seq, kind, turn, role, text"

_escape = re.compile(r"\\|[<\[](?=" + "|".join(sorted(re.escape(c[1:]) for c in CONTROL)) + ")")
_unescape = re.compile(r"\\(.)", re.S)
_turn = re.compile(re.escape(OPEN) + r"((?:[^\\\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?!\|im_end\|>))*+)" + re.escape(CLOSE) + "\n", re.S)


def escape(text: str) -> str:
    r"""Double each backslash and put one inside each control string, after its first character."""
    return _escape.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _unescape.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def events_of_turns(turns: DataFrame) -> DataFrame:
    """Each row (conv_id, turn, role, text) as one message event.

    Rows are numbered by turn, null first; ties and repeated rows are turns of their own, by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    n = F.row_number().over(order).cast("long")
    return turns.select("conv_id", n.alias("seq"), F.lit("message").alias("kind"), n.alias("turn"), "role", "text")


def live_events(events: DataFrame) -> DataFrame:
    """The events that make up the final messages: no later regenerate of this or an earlier turn, no
    later message or edit of the same turn. Of equal `seq` the order is turn, kind, role, text.
    """
    key = [F.col(c) for c in ("seq", "turn", "kind", "role", "text")]
    later = Window.partitionBy("conv_id").orderBy(*[c.desc() for c in key]).rowsBetween(Window.unboundedPreceding, -1)
    void = F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later)
    resets = F.col("kind").isin("message", "edit", "regenerate")
    same = Window.partitionBy("conv_id", "turn").orderBy(*[c.desc() for c in key]).rowsBetween(Window.unboundedPreceding, -1)
    replaced = F.max(resets.cast("int")).over(same)
    role = F.last("role", True).over(Window.partitionBy("conv_id", "turn").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0))
    return (
        events.withColumn("__void", void)
        .where(F.col("__void").isNull() | (F.col("turn") < F.col("__void")))
        .withColumns({"__replaced": F.coalesce(replaced, F.lit(0)), "role": role})
        .where("__replaced = 0 and kind <> 'regenerate'")
        .select("conv_id", "turn", "seq", "kind", "role", "text")
    )


RENDERED = "conv_id long, part int, n_turns long, text string, loss array<struct<start:long,end:long>>"


def _render(max_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([
            ("conv_id", pa.int64()), ("part", pa.int32()), ("n_turns", pa.int64()), ("text", pa.string()),
            ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ])
        rows: list[dict] = []
        held = 0
        conv: object = None
        turn: object = None
        role, said = "", []
        pieces, spans, at, n, part = [], [], 0, 0, 0
        begun = False

        def close_turn() -> None:
            nonlocal at, n, said
            body = escape("".join(said))
            head = f"{OPEN}{escape_role(role)}\n"
            if role == "assistant":
                spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
            pieces.append(f"{head}{body}{CLOSE}\n")
            at += len(pieces[-1])
            n += 1
            said = []

        def close_part() -> None:
            nonlocal pieces, spans, at, n, part, held
            rows.append({"conv_id": conv, "part": part, "n_turns": n, "text": "".join(pieces), "loss": spans})
            held += at
            pieces, spans, at, n, part = [], [], 0, 0, part + 1

        for batch in batches:
            for c, t, r, x in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text")), strict=True):
                if not begun or c != conv or t != turn:
                    if begun:
                        close_turn()
                        if c != conv or at >= max_chars:
                            close_part()
                    if not begun or c != conv:
                        part = 0
                    begun, conv, turn, role = True, c, t, ""
                role = r or role
                said.append(x or "")
            if held > 4_000_000 or len(rows) > 2_000:
                yield pa.RecordBatch.from_pylist(rows, kind)
                rows, held = [], 0
        if begun:
            close_turn()
            close_part()
        yield pa.RecordBatch.from_pylist(rows, kind)

    return run


def render(events: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Final messages as text: one row per conversation and part of about `part_chars` characters of whole turns.

    Columns conv_id, part, n_turns, text, loss (spans of assistant text in code points). Null text and role
    are empty, a null conv_id is a conversation of its own, an empty log gives no rows, turns left void give no text.
    """
    live = live_events(events)
    key = ["conv_id", "turn", "seq", "kind", "role", "text"]
    return live.repartition("conv_id").sortWithinPartitions(*key).mapInArrow(_render(part_chars), RENDERED)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _turn.finditer(text)]


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_parts int"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_parts"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32()]
    rows: list[list] = []
    state: list | None = None

    def done() -> None:
        conv, n, turns, chars, loss, total, parts = state
        rows.append([conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, parts])

    def out() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

    for batch in batches:
        for conv, part, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "text", "loss")), strict=True):
            if part == 0:
                if state:
                    done()
                state = [conv, 0, sha256(), 0, sha256(), 0, 0]
            for role, said in parse(text):
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
            for s in spans:
                said = unescape(text[s["start"] : s["end"]])
                state[3] += len(said)
                state[4].update(said.encode())
            state[5] += len(text)
            state[6] += 1
        if len(rows) > 5_000:
            yield out()
            rows = []
    if state:
        done()
    yield out()


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests per conversation, parsed from the rendered parts and their loss spans in order."""
    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.select("conv_id", "part", "text", "loss").mapInArrow(_digest, DIGEST)
