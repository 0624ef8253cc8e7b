"""Structured Streaming forms: greedy groups with keyed state, and an idempotent
append of indexed batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.grouping import score
from ..operators.timeline import KEY

CLOSED = f"{KEY} long, ordinal long, first long, last long, frames long, floor int"
STATE = "ordinal long, first long, last long, rep long, prev long, low int"


def greedy_groups(frames: DataFrame, value: str, least: int = 9700) -> DataFrame:
    """Groups that a stream of frames (source_key, frame_id, value) has closed.

    The state of a source is its open group; frames of a source must come in
    order over the micro-batches, a gap or an older frame is an error.  The open
    group is given out when a frame with a null value ends the source.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = list(state.get) if state.exists else None
        closed = []
        for f, v in sorted((int(a), None if pd.isna(b) else int(b)) for p in batches for a, b in zip(p.frame_id, p.value)):
            if open_ is not None and f != open_[2] + 1:
                raise ValueError(f"source {key[0]}: frame {f} after {open_[2]}")
            if v is not None and open_ is not None:
                to_rep = score(open_[3], v)
                if to_rep >= least and score(open_[4], v) >= least:
                    open_[2], open_[4], open_[5] = f, v, min(open_[5], to_rep)
                    continue
            n = 0
            if open_ is not None:
                n = open_[0] + 1
                closed.append((key[0], open_[0], open_[1], open_[2], open_[2] - open_[1] + 1, open_[5]))
            open_ = None if v is None else [n, f, f, v, v, 10000]
        if open_ is None:
            if state.exists:
                state.remove()
        else:
            state.update(tuple(open_))
        if closed:
            yield pd.DataFrame(closed, columns=[KEY, "ordinal", "first", "last", "frames", "floor"])

    rows = frames.selectExpr(KEY, "frame_id", f"{value} as value")
    return rows.groupBy(KEY).applyInPandasWithState(step, CLOSED, STATE, "append", GroupStateTimeout.NoTimeout)


def append_batches(frames: DataFrame, path: str, checkpoint: str):
    """A streaming write of indexed frames: each micro-batch is a folder of its
    own under its number, so a batch that is tried again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
