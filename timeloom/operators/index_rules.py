"""Rows that a stored frame index can't hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values with a time base of their own: the parts that are null together with them.
TIMED = {"ticks": ("num", "den", "us"), "duration": ("num", "den"), "anchor": ("num", "den", "us")}


def _rules(num: int, den: int) -> dict[str, Column]:
    flag = lambda c: ~F.col(c).isin(0, 1)
    rules = {"keyframe flag": flag("keyframe"), "corrupt flag": flag("corrupt"), "anchor kind": flag("anchor_kind")}
    for name, parts in TIMED.items():
        value = F.col("anchor_ticks" if name == "anchor" else name)
        rules |= {f"{name} without {p}": value.isNull() != F.col(f"{name}_{p}").isNull() for p in parts}
        other = (F.col(f"{name}_num") != num) | (F.col(f"{name}_den") != den)
        if name == "duration":
            rules["duration value"] = value.isNotNull() & ((value <= 0) | other)
        else:
            rules[f"{name} time base"] = value.isNotNull() & other
    at, frame = F.col("anchor_frame"), F.col("frame_id")
    none, some = F.col("anchor_kind") == 0, F.col("anchor_kind") == 1
    rules["anchor of none"] = none & (at.isNotNull() | F.col("anchor_ticks").isNotNull())
    rules["anchor frame"] = some & (at.isNull() | (at < 0) | (at > frame))
    rules["keyframe not its anchor"] = (F.col("keyframe") == 1) & (F.col("corrupt") == 0) & (~some | (at != frame))
    return rules


def impossible(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of a stream with the time base num / den that break a rule, with the
    names of all ``rules`` that they break; a rule that a null leaves open holds."""
    names = F.array(*(F.when(r, n) for n, r in _rules(num, den).items()))
    return rows.withColumn("rules", F.array_compact(names)).filter(F.size("rules") > 0)
