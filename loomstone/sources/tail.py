"""A streaming source that follows a growing JSON-lines file by byte offset."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _TailReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def latestOffset(self) -> dict:
        """The end of the last complete line; a torn one waits for its rest."""
        if not os.path.exists(self.path):
            return {"byte": 0}
        size = os.path.getsize(self.path)
        with open(self.path, "rb") as f:
            at = size
            while at > 0:
                lo = max(0, at - 65_536)
                f.seek(lo)
                cut = f.read(at - lo).rfind(b"\n")
                if cut >= 0:
                    return {"byte": lo + cut + 1}
                at = lo
        return {"byte": 0}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["byte"] < start["byte"]:
            raise ValueError(f"{self.path} shrank below offset {start['byte']}")
        return [_Range(self.path, start["byte"], end["byte"])]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline()
                text = line.decode("utf-8").strip()
                if text:
                    yield (at, text)
                at += len(line)


class TailSource(DataSource):
    """``spark.readStream.format("jsonl_tail").load(path)``: (seq, raw), ``seq``
    being the byte at which the line begins."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "seq long, raw string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _TailReader(self.options["path"])


def register(spark) -> None:
    spark.dataSource.register(TailSource)
