"""Pictures as rows: frame_id, width, height, stride, pixels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as px

PICTURE = "frame_id long, width int, height int, stride int, pixels binary"
_COLUMNS = ("frame_id", "width", "height", "stride", "pixels")


def valid(width: Column, height: Column, stride: Column, pixels: Column) -> Column:
    """Sides above 0, rows of four bytes a pixel at least, and just as many bytes."""
    return F.coalesce((width > 0) & (height > 0) & (stride >= width * 4) & (F.octet_length(pixels) == stride * height), F.lit(False))


def per_picture(rows: DataFrame, make: Callable, schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    """One row out for each picture: frame_id and what ``make`` gives for it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(f, *make(px.picture(p, w, h, s))) for f, w, h, s, p in zip(*(b.column(c).to_pylist() for c in _COLUMNS))]
            cols = list(zip(*out)) or [[] for _ in range(len(names) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), *types])], ["frame_id", *names])

    return rows.select(*_COLUMNS).mapInArrow(work, f"frame_id long, {schema}")


def tight(rows: DataFrame) -> DataFrame:
    """The visible pixels without padding."""
    return per_picture(rows, lambda p: (p.tobytes(),), "tight binary", ["tight"], [pa.binary()])


def rgb(rows: DataFrame) -> DataFrame:
    return per_picture(rows, lambda p: (p[..., :3].tobytes(),), "rgb binary", ["rgb"], [pa.binary()])


def resampled(rows: DataFrame, width: int, height: int) -> DataFrame:
    return per_picture(rows, lambda p: (px.resample(p, width, height).astype(np.uint8).tobytes(),), "rgb binary", ["rgb"], [pa.binary()])


def previews(rows: DataFrame, edge: int) -> DataFrame:
    """Nearest, no larger than ``edge`` on the longest side."""
    if edge <= 0:
        raise ValueError("the edge isn't positive")

    def make(p):
        q = px.preview(p, edge)
        return q.shape[1], q.shape[0], q.shape[1] * 4, np.ascontiguousarray(q).tobytes()

    names = ["width", "height", "stride", "pixels"]
    return per_picture(rows, make, "width int, height int, stride int, pixels binary", names, [pa.int32(), pa.int32(), pa.int32(), pa.binary()])


def encoded(rows: DataFrame, image: str = "png") -> DataFrame:
    """Encoded pictures and their sizes; PNG keeps alpha and every pixel."""
    if image != "png":
        raise ValueError(f"no encoder for {image}: this build has PNG alone")

    def make(p):
        data = px.encode_png(p)
        return data, len(data)

    return per_picture(rows, make, "data binary, bytes long", ["data", "bytes"], [pa.binary(), pa.int64()])


def pair_scores(pairs: DataFrame, descriptors: DataFrame, kernel: Callable, name: str) -> DataFrame:
    """A kernel over pairs (target, frame_id) of 16 x 16 descriptors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, px.SIDE, px.SIDE, 3) for c in ("a", "b"))
                yield pa.RecordBatch.from_arrays([part.column("target"), part.column("frame_id"), pa.array(kernel(x, y), pa.int64())], ["target", "frame_id", name])

    d = descriptors.select("frame_id", F.col("rgb").alias("b"))
    both = pairs.join(d, "frame_id").join(d.select(F.col("frame_id").alias("target"), F.col("b").alias("a")), "target")
    return both.select("target", "frame_id", "a", "b").mapInArrow(work, f"target long, frame_id long, {name} long")
