"""The state machines on streams, with the steps that the batch fold uses.

Rows of one video may arrive out of order within the watermark: they wait in the state until the
watermark has passed their time, and then run in order.  Later rows are dropped (and counted) by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framequarry.operators.state import Machine


def run_machine(stream: DataFrame, machine: Machine, columns: list[str], key: str = "video_id", time: str = "ts", tie: str = "frame_idx", delay: str = "10 minutes") -> DataFrame:
    """key, time, tie and the machine's output for each row of a stream, once the watermark has passed it.

    columns: what the step reads (booleans, numbers, strings or arrays of structs); they travel as JSON, so the
    state is two strings whatever the machine.
    """
    row = F.to_json(F.struct(tie, *columns), {"ignoreNullFields": "false"})
    narrow = stream.withWatermark(time, delay).select(key, time, tie, row.alias("_row"))
    out = T.StructType([narrow.schema[key], narrow.schema[time], narrow.schema[tie]] + [T.StructField(n, t) for n, t in machine.output])
    names = [n for n, _ in machine.output]

    def advance(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine_state, waiting = (json.loads(x) for x in state.get) if state.exists else (machine.start(), [])
        if not state.hasTimedOut:
            for b in batches:
                waiting += [[t.value, int(k), r] for t, k, r in zip(b[time], b[tie], b["_row"])]
        waiting.sort(key=lambda w: (w[0], w[1]))
        passed = state.getCurrentWatermarkMs() * 1_000_000
        ready = [w for w in waiting if w[0] <= passed]
        waiting = waiting[len(ready) :]
        found = []
        for t, k, r in ready:
            machine_state, o = machine.step(machine_state, json.loads(r))
            found.append([group[0], pd.Timestamp(t), k, *[o[n] for n in names]])
        state.update((json.dumps(machine_state), json.dumps(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1_000_000, state.getCurrentWatermarkMs() + 1))
        if found:
            yield pd.DataFrame(found, columns=[key, time, tie, *names])

    return narrow.groupBy(key).applyInPandasWithState(advance, out, T.StructType([T.StructField("machine", T.StringType()), T.StructField("waiting", T.StringType())]), "append", GroupStateTimeout.EventTimeTimeout)


def segments(stream: DataFrame, gap: str, key: str = "video_id", time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Runs of rows no further apart than `gap` by session windows: key, start, end, rows."""
    s = stream.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("rows"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows")


def empty_frame_rates(stream: DataFrame, window: str, taus=(0.3, 0.5, 0.7), time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """False positives on empty frames by tumbling window and tau. stream: ts, is_empty, scores (array of double)."""
    tau = F.explode(F.array(*[F.lit(float(t)) for t in taus]))
    rows = stream.withWatermark(time, delay).where("is_empty").select(time, "scores", tau.alias("tau"))
    n = F.size(F.filter("scores", lambda s: s >= F.col("tau")))
    t = rows.groupBy(F.window(time, window).alias("w"), "tau").agg(F.count("*").alias("num_empty"), F.count_if(n > 0).alias("fp_frames"), F.sum(n).alias("fp_count"))
    return t.select(F.col("w.start").alias("start"), "tau", "num_empty", "fp_frames", "fp_count", (F.col("fp_frames") / F.col("num_empty")).alias("effr"))
