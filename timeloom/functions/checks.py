"""Argument and row checks with typed errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class PolicyError(ValueError):
    """A setting outside its range."""


def similarity_policy(max_distance: int = 8, least: int = 9700, cap: int = 64, batch: int = 128) -> None:
    if not 0 <= max_distance <= 64:
        raise PolicyError("a hash distance is within 0..64")
    if not 0 <= least <= 10000:
        raise PolicyError("a score is within 0..10000")
    if cap <= 0 or batch <= 0:
        raise PolicyError("caps and batches are positive")


def stream(kind: str, num: int, den: int) -> None:
    if kind != "video":
        raise PolicyError(f"a {kind} stream has no frames")
    if num <= 0 or den <= 0:
        raise PolicyError("a time base is positive")


def same_time_base(num: Column, den: Column, want_num: int, want_den: int, value: Column) -> Column:
    """``value`` where the time base is the wanted one; an error elsewhere."""
    ok = (num == want_num) & (den == want_den)
    return F.when(ok, value).otherwise(F.raise_error(F.lit("another time base")).cast("long"))


def artifact(frame_id: Column, ticks: Column, width: Column, height: Column, generation: Column, key_ok: Column) -> Column:
    """A frame or a time, positive sizes and generation, a confined key."""
    return (frame_id.isNotNull() | ticks.isNotNull()) & (width > 0) & (height > 0) & (generation > 0) & key_ok


def progress(lifecycle: Column, completed: Column, total: Column, generation: Column) -> Column:
    """What a progress row may say: complete means that all are completed."""
    return (generation > 0) & (completed >= 0) & (total.isNull() | (completed <= total)) & ((lifecycle != "complete") | (total.isNotNull() & (total == completed)))


def decoder_class(sdk: Column, hardware: Column, software: Column) -> Column:
    return F.when(sdk < 29, "Unknown").when(software, "Software").when(hardware, "Hardware").otherwise("Unknown")


def selection_fault(kind: Column, start: Column, end: Column, every: Column) -> Column:
    """Why a manifest can't hold a selection, or null: ranges of frames or times
    run forward, and whatever is sampled is sampled every n with n > 0."""
    ranged = kind.isin("frames", "times")
    return (
        F.when(ranged & (start > end), F.concat(kind, F.lit(" are reversed")))
        .when((ranged | (kind == "all")) & ~F.coalesce(every > 0, F.lit(False)), "interval isn't positive")
    )
