"""Chat formatting with offset-aligned masks (operator 9).

A conversation becomes one string, ``<s>role\\ntext</s>\\n`` for each turn. It is encoded once by a lossless byte-level
tokenizer, whose tokens' bytes give their offsets. The turn spans of the string and the offsets of the tokens are both
sorted, so binary search finds the first and last token of each assistant text; their spans cut to the turn give the loss
mask, exact to the character. A token that reaches over the border of a text counts as learned, in its range of tokens;
``straddling`` tells how many of a text's tokens (0 to 2) do.

Control strings inside texts are escaped by a backslash after their first character; those that look escaped get one
more, so that unescaping is exact. In roles, backslash and newline are escaped too.

Rows of a conversation are dealt out by conv_id and sorted in their partition by (turn, role, text); a worker streams
over them and holds one segment. A conversation is cut into segments of at least ``SEGMENT`` characters between turns,
where encoding starts anew, so that even a conversation of any length takes bounded memory; a single turn is never cut.
A conversation is one task's work, as its digests are sequential, and rows without conv_id are one conversation.

Turns of one number are ordered by role and text. Other columns are ignored. Null role and text: empty strings. Null conv_id: one conversation. Repeated rows: turns each. An empty table: no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.llm.bpe import load_bytes
from corvidex.llm.common import table

VOCABULARY = "byte_bpe_50k.json"
SEGMENT = 1 << 20
#: Characters of segments that go into one record batch.
BATCH = 1 << 20
#: Strings that chat formats give a meaning.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>")
LEARNED = "assistant"

_PLAIN = regex.compile("|".join(rf"{regex.escape(c[0])}\\*{regex.escape(c[1:])}" for c in CONTROL))
_ESCAPED = regex.compile("|".join(rf"{regex.escape(c[0])}\\+{regex.escape(c[1:])}" for c in CONTROL))
_TURN = regex.compile(r"<s>(.*)\n((?s:.*?))</s>\n")


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return regex.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The string of some turns and the span of each text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>{escape_role(role)}\n", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}</s>\n")
        at += len(parts[-1])
    return "".join(parts), spans


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of tokens that touch the sorted ``spans``. offsets: n x 2, sorted."""
    if not len(offsets) or not spans:
        return [(0, 0)] * len(spans)
    start, end = np.asarray(spans).T
    first = np.searchsorted(offsets[:, 1], start, side="right")
    last = np.searchsorted(offsets[:, 0], end, side="left")
    return [(int(a), int(max(a, b))) for a, b in zip(first, last)]


SEGMENTS = "conv_id bigint, segment bigint, formatted string, ids array<int>, token_start array<int>, token_end array<int>, loss array<struct<first:int,last:int,start:int,end:int,straddling:int>>"


def format_conversations(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Segments of formatted conversations: string, ids with offsets, and for each assistant text its tokens and span."""
    narrow = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bytes(vocabulary)
        now, held, size, segment = object(), [], 0, 0
        rows: list[tuple] = []

        def close() -> None:
            formatted, spans = render(held)
            ids = bpe.encode(formatted)
            offsets = bpe.offsets_of(formatted, ids)
            spans = [s for s, (role, _) in zip(spans, held) if role == LEARNED]
            loss = []
            for (a, b), (s, e) in zip(mask(offsets, spans), spans):
                over = len({x for x in (a, b - 1) if a < b and (offsets[x, 0] < s or offsets[x, 1] > e)})
                loss.append({"first": a, "last": b, "start": s, "end": e, "straddling": over})
            rows.append((now, segment, formatted, ids, offsets, loss))

        def flush() -> pa.RecordBatch:
            conv, number, formatted, ids, offsets, loss = zip(*rows)
            border = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            flat = lambda x: pa.ListArray.from_arrays(border, pa.array(np.concatenate(x).astype(np.int32)))
            out = pa.RecordBatch.from_pydict(
                {
                    "conv_id": pa.array(conv, pa.int64()),
                    "segment": pa.array(number, pa.int64()),
                    "formatted": pa.array(formatted, pa.string()),
                    "ids": flat(ids),
                    "token_start": flat([x[:, 0] for x in offsets]),
                    "token_end": flat([x[:, 1] for x in offsets]),
                    "loss": pa.array(loss, pa.list_(pa.struct([(k, pa.int32()) for k in ("first", "last", "start", "end", "straddling")]))),
                }
            )
            rows.clear()
            return out

        gathered = 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if held and (conv != now or size >= SEGMENT):
                    close()
                    gathered += size
                    held, size, segment = [], 0, segment + 1
                    if gathered >= BATCH:
                        yield flush()
                        gathered = 0
                if conv != now:
                    now, segment = conv, 0
                held.append((role, text))
                size += len(text)
        if held:
            close()
        if rows:
            yield flush()

    return dealt.mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame) -> DataFrame:
    """What formatted conversations hold, from their strings, offsets and masks alone; segments as they were made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        done: list[tuple] = []

        def close() -> None:
            n, turns, chars, loss, size = state
            done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            done.clear()
            return out

        for batch in batches:
            start, end = batch.column("token_start"), batch.column("token_end")
            begin, starts, ends = start.offsets.to_numpy(), start.values.to_numpy(), end.values.to_numpy()
            for k, (conv, text, loss) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")))):
                if conv != now or state is None:
                    if state is not None:
                        close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for m in _TURN.finditer(text):
                    state[0] += 1
                    state[1].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                for own in loss:
                    if own["first"] < own["last"]:
                        a, b = max(own["start"], int(starts[begin[k] + own["first"]])), min(own["end"], int(ends[begin[k] + own["last"] - 1]))
                        learned = unescape(text[a:b])
                        state[2] += len(learned)
                        state[3].update(learned.encode())
                state[4] += len(text)
            if done:
                yield flush()
        if state is not None:
            close()
            yield flush()

    return segments.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_conversations(turns.unionByName(own)))


QUERIES = {"op9_chat_format": op9_chat_format}
ORACLES: dict[str, str] = {}
