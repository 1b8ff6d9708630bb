"""Adapters and the registry that routes to them; filters and time ranges become ``where`` for every source."""

from __future__ import annotations

import csv
import io
import json
import re
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..operators.merge import TIME
from . import synthetic, telemetry


class SourceAdapter(Protocol):
    """``available()`` and, for what can stream, ``subscribe(spark, query)`` may be there as well."""

    def query(self, spark: SparkSession, query: str) -> DataFrame: ...


def detect_format(text: str) -> str:
    return "json" if text.lstrip()[:1] in ("[", "{") else "csv"


def detect_delimiter(header: str) -> str:
    return next((d for d in ("\t", ",", ";") if d in header), ",")


@dataclass
class UploadSource:
    """CSV or JSON, from a path that Spark reads or from text given in place."""

    path: str | None = None
    text: str | None = None

    def query(self, spark: SparkSession, query: str = "") -> DataFrame:
        try:
            return self._path(spark, self.path) if self.path else self._text(spark, self.text if self.text is not None else query)
        except EngineError:
            raise
        except Exception as e:
            raise EngineError("source.schema_mismatch", f"upload: {e}") from e

    def _path(self, spark: SparkSession, path: str) -> DataFrame:
        head = spark.read.text(path).limit(1).collect()
        first = head[0][0] if head else ""
        if detect_format(first) == "json":
            return spark.read.json(path, multiLine=True, mode="FAILFAST")
        return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, sep=detect_delimiter(first))

    def _text(self, spark: SparkSession, text: str) -> DataFrame:
        """Text in place is as large as a request: it is parsed on the driver, types are found by Spark's reader."""
        if detect_format(text) == "json":
            items = json.loads(text)
            rows = [json.dumps(x) for x in (items if isinstance(items, list) else [items]) if isinstance(x, dict)]
            return spark.read.json(spark.sparkContext.parallelize(rows), mode="FAILFAST")
        lines = text.lstrip("\n\r")
        reader = csv.reader(io.StringIO(lines), delimiter=detect_delimiter(lines.split("\n", 1)[0]), skipinitialspace=True)
        rows = [[c.strip() for c in r] for r in reader if any(c.strip() for c in r)]
        if not rows:
            raise EngineError("source.schema_mismatch", "there is no header")
        if any(len(r) != len(rows[0]) for r in rows):
            raise EngineError("source.schema_mismatch", "a row has more or fewer cells than the header")
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_MINIMAL, lineterminator="\n").writerows([[c.replace("\n", "\\n") for c in r] for r in rows])
        made = spark.read.csv(spark.sparkContext.parallelize(out.getvalue().splitlines()), header=True, inferSchema=True, quote='"', escape='"')
        strings = [c for c, k in made.dtypes if k == "string"]
        return made.withColumns({c: F.replace(F.col(c), F.lit("\\n"), F.lit("\n")) for c in strings}) if strings else made


def extract(value: Any, path: str) -> Any:
    """a.b, or items[].f for the field of the first item."""
    for i, part in enumerate(parts := path.split(".")):
        if not isinstance(value, Mapping):
            return None
        if part.endswith("[]"):
            items = value.get(part[:-2])
            if not isinstance(items, list) or not items:
                return None
            rest = parts[i + 1 :]
            return extract(items[0], ".".join(rest)) if rest and isinstance(items[0], Mapping) else items
        value = value.get(part)
    return value


def safe_details(config: Any) -> dict[str, Any]:
    """What an error may say of a request: never values of headers, queries or credentials."""
    if not isinstance(config, Mapping):
        return {}
    url = urlsplit(str(config.get("url", "")))
    host = url.hostname or ""
    out: dict[str, Any] = {"url": f"{url.scheme}://{host}{f':{url.port}' if url.port else ''}{url.path}", "method": config.get("method", "GET")}
    if url.query:
        out["queryNames"] = [k for k, _ in parse_qsl(url.query, keep_blank_values=True)]
    if config.get("headers"):
        out["headerNames"] = sorted(config["headers"])
    return out


@dataclass
class ApiSource:
    """HTTP by an injected ``fetch(config) -> (status, text)``."""

    fetch: Callable[[Mapping[str, Any]], tuple[int, str]]

    def query(self, spark: SparkSession, query: str) -> DataFrame:
        try:
            config = json.loads(query)
        except ValueError as e:
            raise EngineError("source.schema_mismatch", "the query must be a JSON configuration", details={"queryLength": len(query)}) from e
        try:
            status, body = self.fetch(config)
        except TimeoutError as e:
            raise EngineError("source.timeout", "the request timed out", details=safe_details(config)) from e
        except OSError as e:
            raise EngineError("source.unavailable", "the request failed", details=safe_details(config)) from e
        if status in (401, 403):
            raise EngineError("source.unauthorized", f"status {status}", details=safe_details(config))
        if status >= 400:
            raise EngineError("source.unavailable", f"status {status}", details=safe_details(config))
        data = json.loads(body)
        items = extract(data, config["dataArrayPath"]) if config.get("dataArrayPath") else data
        items = [x for x in (items if isinstance(items, list) else [items]) if isinstance(x, Mapping)]
        mapping = config.get("responseMapping")
        rows = [{k: extract(x, p) for k, p in mapping.items()} if mapping else x for x in items]
        return spark.read.json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


def _topic(query: str) -> tuple[str, str]:
    if not query.startswith("io://"):
        raise EngineError("source.schema_mismatch", "telemetry queries are io://device/metric")
    device, _, metric = query[5:].partition("/")
    return device or "*", metric or "*"


@dataclass
class TelemetrySource:
    """io://{device}/{metric} over a frame of readings: _timestamp, _deviceId, uri, value, _unit, _quality."""

    readings: DataFrame

    def query(self, spark: SparkSession, query: str) -> DataFrame:
        device, metric = _topic(query)
        rows = self.readings if device == "*" else self.readings.where(F.col("_deviceId") == device)
        return rows if metric == "*" else rows.where(F.col("uri") == query)


@dataclass
class TelemetryPortSource:
    """io://{device}/{metric} through a port (see ``telemetry``): drained up to its present end, or as a stream.

    ``options``: factory, config and limits of the data source.
    """

    options: Mapping[str, str]

    def _options(self, spark: SparkSession, query: str) -> dict[str, str]:
        device, metric = _topic(query)
        spark.dataSource.register(telemetry.TelemetryDataSource)
        return {**self.options, "device": device, "metric": metric}

    def query(self, spark: SparkSession, query: str) -> DataFrame:
        return spark.read.format("telemetry").options(**self._options(spark, query)).load()

    def subscribe(self, spark: SparkSession, query: str) -> DataFrame:
        return spark.readStream.format("telemetry").options(**self._options(spark, query)).load()


@dataclass
class FactSource:
    """Facts: _factId, _factType, _timestamp, _confidence, and content (a map, JSON text or variant) that becomes columns.

    The query is the type, or a JSON object with ``type`` and ``entityId`` (matched with the column _entityId).  Columns
    and their types come from one aggregate over the contents; a field of several types is text.
    """

    facts: DataFrame

    def query(self, spark: SparkSession, query: str) -> DataFrame:
        wanted = json.loads(query) if query.lstrip().startswith("{") else {"type": query}
        rows = self.facts.where(F.col("_factType") == wanted["type"])
        if wanted.get("entityId") is not None:
            if "_entityId" not in rows.columns:
                raise EngineError("source.schema_mismatch", "the facts have no _entityId")
            rows = rows.where(F.col("_entityId") == wanted["entityId"])
        if "content" not in rows.columns:
            return rows
        kind = rows.schema["content"].dataType
        content = F.col("content") if isinstance(kind, T.VariantType) else F.parse_json(F.col("content") if isinstance(kind, T.StringType) else F.to_json("content"))
        whole = rows.withColumn("content", content)
        found = whole.agg(F.schema_of_variant_agg("content")).first()[0]
        fields = variant_fields(found or "")
        return whole.select(*(c for c in rows.columns if c != "content"), *(F.try_variant_get("content", f"$[{json.dumps(k)}]", t).alias(k) for k, t in fields))


def variant_fields(schema: str) -> list[tuple[str, str]]:
    """(key, type to read it as) of the objects that ``schema_of_variant_agg`` describes, by key."""
    if not schema.startswith("OBJECT<"):
        return []
    struct = T._parse_datatype_string(re.sub(r"\bVOID\b", "STRING", schema.replace("OBJECT<", "STRUCT<", 1).replace("OBJECT<>", "STRING")).replace("OBJECT<", "STRUCT<"))
    number = lambda t: "double" if isinstance(t, (T.DecimalType, T.FloatType)) else "string" if isinstance(t, (T.VariantType, T.StructType, T.ArrayType, T.MapType)) else t.simpleString()
    return sorted((f.name, number(f.dataType)) for f in struct.fields)


class SyntheticSource:
    def query(self, spark: SparkSession, query: str) -> DataFrame:
        return synthetic.generate(spark, query)

    def subscribe(self, spark: SparkSession, query: str) -> DataFrame:
        return synthetic.stream(spark, query)


@dataclass
class TableSource:
    """Named tables: a path template with {query}, or registered frames."""

    template: str

    def query(self, spark: SparkSession, query: str) -> DataFrame:
        return spark.read.parquet(self.template.format(query=query))


@dataclass
class SourceRegistry:
    adapters: dict[str, SourceAdapter] = field(default_factory=dict)

    def register(self, kind: str, adapter: SourceAdapter) -> None:
        self.adapters[kind] = adapter

    def unregister(self, kind: str) -> None:
        self.adapters.pop(kind, None)

    def types(self) -> list[str]:
        return list(self.adapters)

    def available(self, kind: str) -> bool:
        """Whether there is an adapter that says it can answer; one that says nothing can."""
        return kind in self.adapters and bool(getattr(self.adapters[kind], "available", lambda: True)())

    def _adapter(self, kind: str) -> SourceAdapter:
        if kind not in self.adapters:
            raise EngineError("source.unavailable", f'no source of type "{kind}"', details={"sourceType": kind, "available": self.types()})
        if not self.available(kind):
            raise EngineError("source.unavailable", f'the source "{kind}" is not available', details={"sourceType": kind})
        return self.adapters[kind]

    def schema(self, spark: SparkSession, kind: str, query: str = "") -> T.StructType:
        """Columns and types of what a query gives; nothing is run that the reader needn't run for its schema."""
        return self._adapter(kind).query(spark, query).schema

    def subscribe(self, spark: SparkSession, kind: str, query: str = "", where: str | None = None) -> DataFrame:
        """A streaming frame, from an adapter that can make one."""
        adapter = self._adapter(kind)
        df = adapter.subscribe(spark, query) if hasattr(adapter, "subscribe") else adapter.query(spark, query)
        if not df.isStreaming:
            raise EngineError("source.unavailable", f'the source "{kind}" does not stream', details={"sourceType": kind})
        return df.where(where) if where else df

    def read(self, spark: SparkSession, kind: str, query: str = "", where: str | None = None, time_range: tuple[Any, Any] | None = None) -> DataFrame:
        df = self._adapter(kind).query(spark, query)
        if where:
            df = df.where(where)
        if time_range and TIME in df.columns:
            df = df.where(F.col(TIME).between(F.lit(time_range[0]), F.lit(time_range[1])))
        return df


def with_retry(action: Callable[[], Any], retries: int = 3, delay: float = 1.0, factor: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Runs ``action`` again after transient source errors, waiting longer each time."""
    for attempt in range(retries + 1):
        try:
            return action()
        except EngineError as e:
            if e.code not in ("source.unavailable", "source.timeout"):
                raise
            if attempt == retries:
                raise EngineError("job.retry_exhausted", f"{retries} retries failed: {e}", details={"attempts": attempt + 1}) from e
        sleep(delay * factor**attempt)
    return None
