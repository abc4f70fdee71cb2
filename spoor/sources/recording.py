"""Binary recordings as a Spark data source: ``spark.read.format("recording")`` and ``spark.readStream.format("recording")``.

Both give the raw records of whole blocks (container.RECORDS). A partition is a run of neighbouring blocks, or several runs
of small files. The stream's
offset names, for every file, the byte and the number of the next block; a block that is not finished yet waits for a later
trigger, so a file that grows gives each record once, also after a restart from the checkpoint. Files are opened where the
tasks run; damage other than an unfinished tail fails the job.

Options: ``path`` (one file or folder), or ``paths``, a JSON list of several.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from spoor.sources import container

PART_BYTES = 16 << 20      # stored bytes of the blocks that one task decodes


class BlockRun(InputPartition):
    """Neighbouring blocks of a file: (offset, number, decoded size, stored size, records, checksum) each."""

    def __init__(self, path: str, blocks: list[tuple]):
        super().__init__((path, blocks[0][0]))
        self.path, self.blocks = path, blocks


class BlockRuns(InputPartition):
    """Runs that one task reads, one after the other."""

    def __init__(self, runs: list[BlockRun]):
        super().__init__((runs[0].path, runs[0].blocks[0][0]))
        self.runs = runs


def _together(runs: Iterator[BlockRun]) -> list[BlockRuns]:
    """Runs in their order, as many in a task as PART_BYTES holds."""
    parts, size = [], 0
    for run in runs:
        own = sum(stored for _, _, _, stored, _, _ in run.blocks)
        if parts and size + own <= PART_BYTES:
            parts[-1].append(run)
            size += own
        else:
            parts.append([run])
            size = own
    return [BlockRuns(part) for part in parts]


def _paths(options: dict) -> list[str]:
    if "paths" in options:
        return json.loads(options["paths"])
    return [options["path"]]


def _runs(path: str, at: int, number: int, stop: int | None = None) -> Iterator[BlockRun]:
    """The whole blocks of a file from a place on, up to the byte ``stop``, as runs."""
    blocks, size = [], 0
    for _, offset, block, codec, decoded, stored, records, crc, status, problem, _ in container.hop(path, at, number):
        if stop is not None and offset >= stop:
            break
        if status == "Incomplete" and problem != "block footer":
            break
        if status != "Block":
            raise ValueError(f"{path}: {problem or 'block codec not available'} (block {block})")
        if blocks and size + stored > PART_BYTES:
            yield BlockRun(path, blocks)
            blocks, size = [], 0
        blocks.append((offset, block, decoded, stored, records, crc))
        size += stored
    if blocks:
        yield BlockRun(path, blocks)


def _read(part: BlockRun):
    with container._open(part.path) as file:
        for offset, number, decoded, stored, records, crc in part.blocks:
            data = container._payload(file, offset, stored)
            try:
                found = container.checked(data, decoded, records, crc)
            except ValueError as error:
                raise ValueError(f"{part.path}: {error} (block {number})") from error
            yield from container.record_batches(part.path, number, data, found)


class RecordingReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[BlockRuns]:
        return _together(run for path in self.paths for run in _runs(path, container.FILE_HEADER_SIZE, 1))

    def read(self, partition: BlockRuns):
        for run in partition.runs:
            yield from _read(run)


class RecordingStream(DataSourceStreamReader):
    def __init__(self, paths: list[str]):
        self.paths = paths
        self.latest = {path: [container.FILE_HEADER_SIZE, 1] for path in paths}

    def initialOffset(self) -> dict:
        return {path: [container.FILE_HEADER_SIZE, 1] for path in self.paths}

    def latestOffset(self) -> dict:
        """Hops on from the blocks known so far."""
        for path, (at, number) in self.latest.items():
            for run in _runs(path, at, number):
                offset, block, _, stored, _, _ = run.blocks[-1]
                self.latest[path] = [offset + container.BLOCK_HEADER_SIZE + stored + container.FOOTER_SIZE, block + 1]
        return {path: list(place) for path, place in self.latest.items()}

    def partitions(self, start: dict, end: dict) -> list[BlockRuns]:
        known = self.initialOffset() | start
        return _together(run for path, (stop, _) in end.items() for run in _runs(path, *known[path], stop))

    def read(self, partition: BlockRuns):
        for run in partition.runs:
            yield from _read(run)

    def commit(self, end: dict) -> None:
        pass


class Recording(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return container.RECORDS

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(_paths(self.options))

    def streamReader(self, schema) -> RecordingStream:
        return RecordingStream(_paths(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Recording)


def read(spark: SparkSession, paths: list[str]):
    """The raw records of recordings (files, or folders that hold one)."""
    register(spark)
    return spark.read.format("recording").option("paths", json.dumps([container.resolve(spark, p) for p in paths])).load()


def stream(spark: SparkSession, paths: list[str]):
    """The raw records of recordings that may still grow."""
    register(spark)
    return spark.readStream.format("recording").option("paths", json.dumps([container.resolve(spark, p) for p in paths])).load()


def read_by_type(spark: SparkSession, paths: list[str], staging: str):
    """The same records, read from the files once into a table partitioned by record type: decoding all types then takes a
    partition each, where each would otherwise read whole files again."""
    read(spark, paths).write.mode("errorifexists").partitionBy("type").parquet(staging)
    return spark.read.schema(container.RECORDS).parquet(staging)
