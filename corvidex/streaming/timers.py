"""Streams with timers in event time: bursts of changes after a quiet time, and one ordered queue for each group.

Rows of a group are held in its state until the watermark has passed what they wait for; so results depend neither on how
rows fall into batches nor on their order within the lateness. State has the rows of a group that are younger than that,
and goes with its last row. A stream that is started again goes on from its checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvidex.streaming.jobs import folder


def bursts(changes: DataFrame, group: str, path: str, ts: str, quiet: int, lateness: str = "10 minutes") -> DataFrame:
    """group, first, last (ms), n, paths: the changes of a group without a pause of more than ``quiet`` seconds, once it has
    been quiet for that long; each path once, in the order in which they changed first, equal times by name. Null groups,
    paths and times are no changes."""
    wait = quiet * 1000

    def closed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for batch in batches:
            held += zip(batch["__ms"].tolist(), batch["__path"].tolist())
        held.sort()
        cuts = [0, *[i for i in range(1, len(held)) if held[i][0] - held[i - 1][0] > wait], len(held)]
        runs = [held[a:b] for a, b in zip(cuts, cuts[1:])]
        now = state.getCurrentWatermarkMs()
        done = [run for run in runs if run and run[-1][0] + wait < now]
        left = [x for run in runs if run and run[-1][0] + wait >= now for x in run]
        if left:
            state.update(([x for x, _ in left], [x for _, x in left]))
            first = next(run for run in runs if run and run[-1][0] + wait >= now)
            state.setTimeoutTimestamp(max(first[-1][0] + wait, now + 1))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame({"group": [key[0]] * len(done), "first": [r[0][0] for r in done], "last": [r[-1][0] for r in done], "n": [len(r) for r in done], "paths": [list(dict.fromkeys(x for _, x in r)) for r in done]})

    kind = changes.schema[group].dataType.simpleString()
    rows = changes.select(F.col(group).alias("__group"), F.col(path).alias("__path"), F.col(ts).alias("__ts"), F.unix_millis(ts).alias("__ms")).dropna()
    return rows.withWatermark("__ts", lateness).groupBy("__group").applyInPandasWithState(
        closed, f"group {kind}, first bigint, last bigint, n bigint, paths array<string>", "ts array<bigint>, path array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )


def in_turn(rows: DataFrame, group: str, ts: str, key: str, payload: str, step: Callable[[dict, str | None], tuple[dict, str]], lateness: str = "10 minutes", held: int = 200) -> DataFrame:
    """group, key, position, status, result: the rows of each group one after the other, by time and key, each given what
    the one before it left.

    ``step(memory, payload)`` returns (memory, result); memory is a JSON value of its group. A row whose step raises has the
    status ``error``, and the group goes on with the memory before it. Groups run side by side. ``held``: entries that a
    list in memory may have; longer ones are cut to their last, which bounds the state.
    """

    def drained(group_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, position, memory = [], 0, {}
        if state.exists:
            ts_, keys, payloads, position, kept = state.get
            waiting, memory = list(zip(ts_, keys, payloads)), json.loads(kept)
        for batch in batches:
            waiting += zip(batch["__ms"].tolist(), batch["__key"].tolist(), batch["__payload"].tolist())
        waiting.sort(key=lambda x: x[:2])
        now, out = state.getCurrentWatermarkMs(), []
        while waiting and waiting[0][0] < now:
            _, name, given = waiting.pop(0)
            position += 1
            try:
                after, result = step(json.loads(json.dumps(memory)), given)
                memory = {k: v[-held:] if isinstance(v, list) else v for k, v in after.items()}
                out.append((group_key[0], name, position, "ok", result))
            except Exception as e:  # one bad row doesn't stop a group
                out.append((group_key[0], name, position, "error", f"{type(e).__name__}: {e}"))
        state.update(([x[0] for x in waiting], [x[1] for x in waiting], [x[2] for x in waiting], position, json.dumps(memory)))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0], now + 1))
        if out:
            yield pd.DataFrame(out, columns=["group", "key", "position", "status", "result"])

    kinds = [rows.schema[c].dataType.simpleString() for c in (group, key)]
    taken = rows.select(F.col(group).alias("__group"), F.col(ts).alias("__ts"), F.unix_millis(ts).alias("__ms"), F.col(key).alias("__key"), F.col(payload).cast("string").alias("__payload")).dropna(subset=["__group", "__ts", "__key"])
    return taken.withWatermark("__ts", lateness).groupBy("__group").applyInPandasWithState(
        drained, f"group {kinds[0]}, key {kinds[1]}, position bigint, status string, result string", f"ts array<bigint>, key array<{kinds[1]}>, payload array<string>, position bigint, memory string", "append", GroupStateTimeout.EventTimeTimeout
    )


def finished(spark: SparkSession, stream: DataFrame, label: str, out: str | None = None) -> DataFrame:
    """Run a stream until all that is there is read; its rows so far. The same ``out`` again goes on from its checkpoint."""
    out = out or folder(spark, label)
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
