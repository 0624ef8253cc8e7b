"""Decoded frames as a Spark data source: the place to plug a decoder in."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source_key long, frame_id long, ticks long, duration_ticks long, keyframe boolean, corrupt boolean"


class Decoder:
    """What a decoder gives: frames of one stream in order, from a frame on."""

    def __init__(self, options: dict):
        self.options = options

    def frames(self, source_key: int, start: int, end: int) -> Iterator[tuple]:
        raise NotImplementedError


class SyntheticDecoder(Decoder):
    """Frames of 40 ticks with a keyframe every 30."""

    def frames(self, source_key: int, start: int, end: int) -> Iterator[tuple]:
        for i in range(start, end):
            yield source_key, i, 40 * i, 40, i % 30 == 0, False


DECODERS: dict[str, type[Decoder]] = {"synthetic": SyntheticDecoder}


class _Range(InputPartition):
    def __init__(self, source_key: int, start: int, end: int):
        self.source_key, self.start, self.end = source_key, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.decoder = DECODERS[options.get("decoder", "synthetic")](dict(options))

    def partitions(self) -> list[InputPartition]:
        n, step = int(self.options.get("frames", 0)), int(self.options.get("framesPerTask", 10000))
        return [_Range(s, a, min(n, a + step)) for s in range(int(self.options.get("sources", 1))) for a in range(0, n, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        yield from self.decoder.frames(partition.source_key, partition.start, partition.end)


class DecodedFrames(DataSource):
    """``spark.read.format("decoded_frames")``; options decoder, sources, frames,
    framesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "decoded_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark) -> None:
    spark.dataSource.register(DecodedFrames)
