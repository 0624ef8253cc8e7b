"""A bounded probe of MP4 and MOV files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

PROBE = "path string, duration_us long, width int, height int, rotation int, frames long, fps double, error string"
_NESTED = (b"moov", b"trak", b"mdia", b"minf", b"stbl")
DEEPEST = 8


class ContainerError(ValueError):
    """Not a container that can be read."""


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start and end of the content) of the boxes within a range."""
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ContainerError("a long size is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ContainerError(f"box {kind!r} of {size} bytes")
        yield kind, at + head, at + size
        at += size


def probe(data: bytes) -> dict:
    """duration_us, width, height, rotation, frames and fps of the first video track."""
    out = {"duration_us": None, "width": None, "height": None, "rotation": 0, "frames": None, "fps": None}
    tracks: list[dict] = []

    def time(a: int) -> tuple[int, int]:
        if data[a]:
            return struct.unpack_from(">IQ", data, a + 20)
        return struct.unpack_from(">II", data, a + 12)

    def walk(start: int, end: int, depth: int, track: dict | None) -> None:
        if depth > DEEPEST:
            raise ContainerError("boxes are too deep")
        for kind, a, b in boxes(data, start, end):
            if kind == b"trak":
                tracks.append(track_ := {})
                walk(a, b, depth + 1, track_)
            elif kind in _NESTED:
                walk(a, b, depth + 1, track)
            elif kind == b"mvhd":
                scale, length = time(a)
                if scale:
                    out["duration_us"] = length * 1_000_000 // scale
            elif track is not None and kind == b"tkhd":
                m = struct.unpack_from(">9i", data, a + (52 if data[a] else 40))
                track["rotation"] = {(1, 0): 0, (0, 1): 90, (-1, 0): 180, (0, -1): 270}.get(tuple((x > 0) - (x < 0) for x in m[:2]), 0)
                track["width"], track["height"] = (x >> 16 for x in struct.unpack_from(">II", data, b - 8))
            elif track is not None and kind == b"mdhd":
                track["scale"], track["length"] = time(a)
            elif track is not None and kind == b"hdlr":
                track["kind"] = bytes(data[a + 8 : a + 12])
            elif track is not None and kind == b"stsz":
                track["frames"] = struct.unpack_from(">I", data, a + 8)[0]

    try:
        walk(0, len(data), 0, None)
    except struct.error as e:
        raise ContainerError(f"a box is cut off: {e}") from None
    video = next((t for t in tracks if t.get("kind") == b"vide"), None)
    if video is None:
        raise ContainerError("no video track")
    out |= {k: video.get(k) for k in ("width", "height", "rotation", "frames")}
    if video.get("scale") and video.get("length"):
        out["duration_us"] = out["duration_us"] or video["length"] * 1_000_000 // video["scale"]
        if video.get("frames"):
            out["fps"] = video["frames"] * video["scale"] / video["length"]
    return out


def inspect(files: DataFrame) -> DataFrame:
    """Probe the rows of ``spark.read.format("binaryFile")``; what can't be read
    has its reason in ``error``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("duration_us", "width", "height", "rotation", "frames", "fps", "error")
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.string())
        for b in batches:
            rows = []
            for content in b.column("content"):
                try:
                    rows.append(probe(content.as_py()))
                except ContainerError as e:
                    rows.append({"error": str(e)})
            yield pa.RecordBatch.from_arrays([b.column("path"), *(pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types))], ["path", *names])

    return files.select("path", "content").mapInArrow(work, PROBE)
