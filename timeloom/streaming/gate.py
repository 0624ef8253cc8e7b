"""Stateful rules of a live slider: the request gate and the admission of samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy
from ..functions.policy import Gate

#: What each kind of event is to the gate.
KINDS = {"click": "submit", "view": "submit", "purchase": "finish", "error": "invalidate"}


def replay(events: DataFrame) -> DataFrame:
    """Gate outcomes of (session, seq, kind, target): one gate per session, its
    events in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, gate = None, None
        for b in batches:
            out = []
            for s, kind, target in zip(*(b.column(c).to_pylist() for c in ("session", "kind", "target"))):
                if gate is None or s != name:
                    name, gate = s, Gate()
                what = KINDS.get(kind, kind)
                out.append(gate.submit(target) if what == "submit" else gate.finish() if what == "finish" else gate.invalidate() if what == "invalidate" else "ignored")
            yield pa.RecordBatch.from_arrays([b.column("session"), b.column("seq"), pa.array(out, pa.string())], ["session", "seq", "outcome"])

    rows = events.selectExpr("cast(session as long) session", "seq", "kind", "cast(target as long) target").repartition("session").sortWithinPartitions("session", "seq")
    return rows.mapInArrow(work, "session long, seq long, outcome string")


def steps(samples: DataFrame) -> DataFrame:
    """What each sample's step from the one before says, as columns: ``wait``, the
    gap that its pace asks for, and ``turned``, whether it goes the other way than
    the last step that went any.  A sample that can't be one (no session, no
    finite fraction, a time below zero) is not ``usable`` and ends the ``life`` of
    what came before.  Fractions are 32-bit floats."""
    ok = F.coalesce((F.col("session") > 0) & ~F.isnan("fraction") & (F.abs("fraction") != float("inf")) & (F.col("at") >= 0), F.lit(False))
    whole = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = samples.withColumn("usable", ok).withColumn("life", F.count_if(~F.col("usable")).over(whole))
    w = Window.partitionBy("session", "life", "usable").orderBy("seq")
    x = F.least(F.greatest(F.col("fraction"), F.lit(0).cast("float")), F.lit(1).cast("float"))
    rows = rows.withColumn("x", x).withColumns({"step": F.col("x") - F.lag("x").over(w), "gone": F.col("at") - F.lag("at").over(w)})
    epsilon = F.lit(policy.EPSILON).cast("float")
    rows = rows.withColumn("way", F.when(F.col("step") > epsilon, 1).when(F.col("step") < -epsilon, -1))
    earlier = F.last("way", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    pace = F.when(F.col("gone") > 0, F.abs("step").cast("double") * 1e9 / F.col("gone")).otherwise(0.0)
    wait = F.when(pace >= policy.FAST_VELOCITY, policy.FAST_NS).when(pace >= policy.MEDIUM_VELOCITY, policy.MEDIUM_NS).otherwise(policy.SLOW_NS)
    return rows.select("session", "seq", "life", "usable", "x", "target", "at", wait.alias("wait"), F.coalesce(F.col("way") != earlier, F.lit(False)).alias("turned"))


def admit(samples: DataFrame) -> DataFrame:
    """now, later (with ms) or none for (session, seq, fraction, target, at).

    A sample is admitted when the gap since the last admitted one has reached the
    shortest of those that apply: by pace, by a turn, by a jump away from it; one
    of the same target never is.  Only the last admitted sample is carried on, so
    the fold's state is constant; all else are columns of :func:`steps`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        life, last = None, None  # fraction, target and time of what was admitted
        far = np.float32(policy.JUMP)
        for b in batches:
            plans, waits = [], []
            fractions = b.column("x").to_numpy(zero_copy_only=False).astype(np.float32)
            for k, (session, part, usable, target, at, wait, turned) in enumerate(zip(*(b.column(c).to_pylist() for c in ("session", "life", "usable", "target", "at", "wait", "turned")))):
                if (session, part) != life:
                    life, last = (session, part), None
                what, ms = "none", 0
                if usable and last is None:
                    what = "now"
                elif usable and target != last[1]:
                    since = max(0, at - last[2])
                    gaps = [wait, policy.JUMP_NS] if abs(fractions[k] - last[0]) >= far else [wait]
                    if since >= min([*gaps, policy.REVERSAL_NS] if turned else gaps):
                        what = "now"
                    else:
                        what, ms = "later", -(-max(1, min(gaps) - since) // policy.MS)
                if what == "now":
                    last = (fractions[k], target, at)
                plans.append(what)
                waits.append(ms)
            yield pa.RecordBatch.from_arrays([b.column("session"), b.column("seq"), pa.array(plans, pa.string()), pa.array(waits, pa.int64())], ["session", "seq", "plan", "wait_ms"])

    rows = steps(samples.selectExpr("cast(session as long) session", "seq", "cast(fraction as float) fraction", "cast(target as long) target", "cast(at as long) at"))
    return rows.repartition("session").sortWithinPartitions("session", "seq").mapInArrow(work, "session long, seq long, plan string, wait_ms long")
