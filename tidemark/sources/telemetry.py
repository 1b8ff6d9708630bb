"""Telemetry as a Python data source: a stream with offsets and partitions, and a batch drain with a deadline.

A port is what knows the readings: ``topics()``, ``latest()`` (offset of each topic's end) and ``read(topic, start, end)``.
It is made in every task from ``factory`` ("module:callable") and ``config`` (a JSON text), so nothing but offsets and
ranges passes through the driver, and a restarted stream goes on where its checkpoint's offsets end.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from typing import Any, Protocol
from urllib.parse import quote, unquote

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "_timestamp timestamp, _deviceId string, uri string, value double, _unit string, _quality string"
#: Offsets of a topic that one task reads, at most, unless ``maxPerPartition`` says otherwise.
MAX_PER_PARTITION = 64 << 20


class Port(Protocol):
    def latest(self) -> dict[str, int]: ...

    def read(self, topic: str, start: int, end: int) -> Iterator[tuple]: ...


class SpoolPort:
    """Append-only files of JSON lines, one for each device/metric, in a folder that all hosts share; offsets are bytes."""

    def __init__(self, config: dict[str, Any]):
        self.files, self.root = pafs.FileSystem.from_uri(config["folder"])

    def latest(self) -> dict[str, int]:
        found = self.files.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))
        return {unquote(f.base_name[:-6]): f.size for f in found if f.base_name.endswith(".jsonl")}

    def read(self, topic: str, start: int, end: int) -> Iterator[tuple]:
        """The readings whose line begins within [start, end); a line that isn't finished yet waits for its end."""
        device = topic.partition("/")[0]
        with self.files.open_input_file(f"{self.root}/{quote(topic, safe='')}.jsonl") as f:
            at = start
            if start:
                f.seek(start - 1)
                before = f.read(1)
                while before and before != b"\n":  # the line was begun before
                    before, at = f.read(1), at + 1
            f.seek(at)
            rest = b""
            while at < end:
                rest += f.read(1 << 20) or b""
                lines = rest.split(b"\n")
                if len(lines) == 1:
                    break
                for line in lines[:-1]:
                    if at >= end:
                        return
                    at += len(line) + 1
                    if line.strip():
                        r = json.loads(line)
                        yield datetime.fromisoformat(r["t"]), device, f"io://{topic}", None if r.get("v") is None else float(r["v"]), r.get("unit"), r.get("quality", "good")
                rest = lines[-1]

    def finished(self, topic: str, end: int) -> int:
        """``end`` less what belongs to an unfinished last line."""
        with self.files.open_input_file(f"{self.root}/{quote(topic, safe='')}.jsonl") as f:
            at = end
            while at > 0:
                size = min(4096, at)
                f.seek(at - size)
                cut = f.read(size).rfind(b"\n")
                if cut >= 0:
                    return at - size + cut + 1
                at -= size
        return 0


@dataclass
class Part(InputPartition):
    topic: str
    start: int
    end: int


class _Options:
    def __init__(self, options: dict[str, str]):
        self.factory, self.config = options.get("factory", f"{__name__}:SpoolPort"), options.get("config", "{}")
        self.device, self.metric = options.get("device", "*"), options.get("metric", "*")
        self.per_batch = int(options["maxPerBatch"]) if "maxPerBatch" in options else None
        self.per_partition = int(options.get("maxPerPartition", MAX_PER_PARTITION))
        self.deadline = float(options["deadlineSeconds"]) if "deadlineSeconds" in options else None

    def port(self) -> Port:
        module, _, name = self.factory.partition(":")
        return getattr(importlib.import_module(module), name)(json.loads(self.config))

    def latest(self) -> dict[str, int]:
        port = self.port()
        ends = {t: n for t, n in port.latest().items() if self.device in ("*", "", t.partition("/")[0]) and self.metric in ("*", "", t.partition("/")[2])}
        return {t: port.finished(t, n) for t, n in ends.items()} if hasattr(port, "finished") else ends

    def parts(self, start: dict[str, int], end: dict[str, int]) -> list[Part]:
        return [Part(t, a, min(a + self.per_partition, n)) for t, n in sorted(end.items()) for a in range(start.get(t, 0), n, self.per_partition)]


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = _Options(options)
        self.given: dict[str, int] | None = None

    def initialOffset(self) -> dict[str, int]:
        return {}

    def latestOffset(self) -> dict[str, int]:
        ends, most = self.options.latest(), self.options.per_batch
        if most is not None:
            before = self.given or {}
            ends = {t: min(n, before.get(t, 0) + most) for t, n in ends.items()}
        return ends

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Part]:
        self.given = end
        return self.options.parts(start, end)

    def read(self, partition: Part | None) -> Iterator[tuple]:
        return iter(()) if partition is None else self.options.port().read(partition.topic, partition.start, partition.end)


class _Drain(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = _Options(options)

    def partitions(self) -> list[Part]:
        return self.options.parts({}, self.options.latest())

    def read(self, partition: Part | None) -> Iterator[tuple]:
        if partition is None:  # Spark asks once where there are no parts
            return
        limit, began = self.options.deadline, time.monotonic()
        for row in self.options.port().read(partition.topic, partition.start, partition.end):
            if limit is not None and time.monotonic() - began > limit:
                raise TimeoutError(f"source.timeout: {partition.topic} wasn't read within {limit} s")
            yield row


class TelemetryDataSource(DataSource):
    """``spark.read`` or ``spark.readStream`` with format "telemetry"; options factory, config, device, metric, maxPerBatch, maxPerPartition, deadlineSeconds."""

    @classmethod
    def name(cls) -> str:
        return "telemetry"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Drain(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)
