"""Runs specs: sources, merge, transforms, steps, artifacts, alerts. Everything up to the artifacts is lazy."""

from __future__ import annotations

import json
import math
import threading
import time
import uuid
from collections.abc import Callable, Mapping
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from ..durations import seconds
from ..errors import EngineError
from ..functions.base import Result
from ..functions.registry import Registry
from ..operators import merge
from ..operators.steplog import StepLog
from ..operators.transforms import TransformPipeline, time_column
from ..series import INDEX, SeriesKey, materialised, shared_dir
from ..sources.registry import SourceRegistry, with_retry
from ..streaming import stateful
from ..streaming.alerts import Condition, Publisher, Rule, evaluate_frame, parse
from .governance import AuditLog, Policy
from .model import MOVES, Artifact, InputSource, Job, OutputDef, Spec, StepInput, validate
from .store import ArtifactStore, SpecStore

#: Values of one series artifact that are brought to the driver; beyond it the artifact holds the frame itself.
SERIES_VALUES = 100_000
TIMEOUTS = {"batch": 30 * 60, "adhoc": 5 * 60}


#: Fixed value: microseconds from the epoch over which a numeric index is spread.
INDEX_SPAN = 1_000_000_000
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def series_points(values: Any, index: Any) -> list[dict] | DataFrame:
    """(t, v) of values against their index: times as they are, numbers spread over ``INDEX_SPAN``, else the position.

    A frame of values stays a frame, against its own index.
    """
    if isinstance(values, DataFrame):
        order, column = values.columns
        number = isinstance(values.schema[order].dataType, T.NumericType)
        if not number:
            return values.select(F.col(order).alias("t"), F.col(column).alias("v"))
        low, high = values.agg(F.min(order), F.max(order)).first()
        place = F.round((F.col(order) - F.lit(low)) / F.lit((high - low) or 1) * INDEX_SPAN) if low is not None else F.lit(0)
        return values.select(F.timestamp_micros(place.cast("long")).alias("t"), F.col(column).alias("v"))
    values = [v for v in (values if isinstance(values, list) else [values]) if isinstance(v, (int, float)) and not isinstance(v, bool)]
    index = index if isinstance(index, list) else []
    numbers = [float(x) for x in index[: len(values)] if isinstance(x, (int, float))]
    low, span = (min(numbers), max(numbers) - min(numbers)) if numbers else (0.0, 0.0)
    out = []
    for i, v in enumerate(values):
        x = index[i] if i < len(index) else None
        if not isinstance(x, datetime):
            place = math.floor((float(x) - low) / span * INDEX_SPAN + 0.5) if isinstance(x, (int, float)) and span > 0 else i
            x = _EPOCH + timedelta(microseconds=place)
        out.append({"t": x, "v": float(v)})
    return out


class Engine:
    def __init__(self, spark: SparkSession, sources: SourceRegistry, functions: Registry | None = None, transforms: TransformPipeline | None = None, publisher: Publisher | None = None, policy: Policy | None = None, metrics: Callable[[str, float], None] = lambda name, value: None, clock: Callable[[], datetime] | None = None, step_log: bool = False):
        """``step_log``: rows before and after each transform go to the job's log, and batch throughput to ``metrics``."""
        self.step_log = step_log
        self.spark, self.sources = spark, sources
        self.functions, self.transforms = functions or Registry(), transforms or TransformPipeline()
        self.publisher, self.policy, self.metrics, self.clock = publisher or Publisher(), policy or Policy(), metrics, clock
        self.specs, self.artifacts, self.audit = SpecStore(), ArtifactStore(), AuditLog()
        self.jobs: dict[str, Job] = {}

    # -- specs ----------------------------------------------------------------------------------------------------------

    def create_spec(self, spec: Spec | Mapping) -> Spec:
        spec = spec if isinstance(spec, Spec) else Spec.from_dict(spec)
        issues = validate(spec, self.functions.by_name)
        if issues:
            raise EngineError("spec.invalid", "; ".join(f"{i.code} {i.field}: {i.message}" for i in issues), details={"issues": issues})
        self.specs.put(spec)
        return spec

    # -- running --------------------------------------------------------------------------------------------------------

    def run(self, spec: Spec | str, mode: str = "batch", parameters: Mapping[str, Any] | None = None, actor: str = "system", role: str | None = None) -> Job:
        spec = self.specs.get(spec) if isinstance(spec, str) else spec
        if role is not None:
            self.policy.check(actor, role, "execute")
        self.audit.add(actor, "run", spec.spec_id)
        job = Job(f"job-{uuid.uuid4().hex[:12]}", spec.spec_id, spec.version, mode, parameters={**spec.parameters, **(parameters or {})})
        self.jobs[job.job_id] = job
        self._move(job, "running")
        started = datetime.now()
        try:
            if mode == "streaming":
                self._stream(spec, job)
                return job
            self.spark.sparkContext.setJobGroup(job.job_id, spec.spec_id, interruptOnCancel=True)
            timer = threading.Timer(TIMEOUTS.get(mode, TIMEOUTS["batch"]), self._late, (job,))
            timer.daemon = True
            timer.start()
            try:
                self._batch(spec, job, mode)
            finally:
                timer.cancel()
            if job.status == "running" and any(e["code"] == "job.timeout" for e in job.errors):
                self._move(job, "failed")
            elif job.status == "running":
                self._move(job, "completed")
                job.progress = 1.0
        except Exception as e:  # results are lazy: Spark's own errors come up here too
            if not any(x["code"] == "job.timeout" for x in job.errors):
                known = isinstance(e, EngineError)
                job.errors.append({"code": e.code, "message": e.message, "step": e.step} if known else {"code": "analysis.execution_error", "message": str(e).strip().split("\n")[0][:500], "step": None})
            if job.status == "running":
                self._move(job, "failed")
        self.metrics("analysis.job_duration_ms", (datetime.now() - started).total_seconds() * 1000)
        self.metrics("analysis.failure_rate", float(job.status == "failed"))
        return job

    def _late(self, job: Job) -> None:
        job.errors.append({"code": "job.timeout", "message": f"no result after {TIMEOUTS.get(job.mode, TIMEOUTS['batch'])} s"})
        self.spark.sparkContext.cancelJobGroup(job.job_id)

    def cancel(self, job_id: str) -> Job:
        job = self.job(job_id)
        if job.handle is not None:
            self._move(job, "canceled")
            job.handle.stop()
        else:
            self.spark.sparkContext.cancelJobGroup(job_id)
            self._move(job, "canceled")
        return job

    def job(self, job_id: str) -> Job:
        if job_id not in self.jobs:
            raise EngineError("job.not_found", f'no job "{job_id}"')
        job = self.jobs[job_id]
        if job.handle is not None and job.status == "running" and not job.handle.isActive:
            job.watch.join()
        return job

    def _move(self, job: Job, status: str) -> None:
        if status not in MOVES.get(job.status, ()):
            raise EngineError("job.invalid_transition", f"{job.status} to {status}")
        job.status = status

    def _read(self, s: InputSource) -> DataFrame:
        df = self.sources.read(self.spark, s.source_type, s.query, s.filter, s.time_range)
        return merge.alias_columns(df, s.column_aliases)

    def _acquire(self, spec: Spec, job: Job, mode: str) -> DataFrame:
        parts = []
        for s in spec.input_sources:
            try:
                parts.append((s.merge, self._read(s) if mode == "adhoc" else with_retry(lambda s=s: self._read(s))))
            except EngineError as e:
                if mode == "adhoc":
                    raise
                job.errors.append({"code": e.code, "message": e.message, "source": s.source_type})
        if not parts:
            raise EngineError("source.unavailable", "no source answered", details={"errors": job.errors})
        return merge.merge(parts)

    def _key(self, df: DataFrame, spec: Spec) -> SeriesKey:
        order = [c for c in spec.order_by if c in df.columns]
        return SeriesKey.of(order or [time_column(df) or df.columns[0]])

    def _batch(self, spec: Spec, job: Job, mode: str) -> None:
        data = self._acquire(spec, job, mode)
        key = self._key(data, spec)
        log = StepLog() if self.step_log else None
        data = log.watch(data, "input") if log else data
        data = self.transforms.run(data, [(t.name, t.parameters) for t in spec.transforms], key, log)
        shared = len(spec.analysis_steps) + any(o.type == "alert" for o in spec.outputs) > 1
        if shared:
            data = data.persist()
        results: dict[str, Result] = {}
        try:
            for s in spec.analysis_steps:
                own, own_key = (self._step_data(results, s.input) if s.input else (data, key))
                own = self.transforms.run(own, [(t.name, t.parameters) for t in s.transforms], own_key)
                params = {**s.parameters, **(job.parameters if mode == "adhoc" else {})}
                results[s.result_key] = self.functions.run(s.function, own, own_key, params)
                job.logs.append(f"{s.result_key}: {s.function}")
            for o in spec.outputs:
                if o.type != "alert" and (a := self._artifact(spec, job, o, results)) is not None:
                    self.artifacts.save(a)
                    job.artifact_ids.append(a.artifact_id)
            self._alerts(spec, job, data, key)
            if log:
                self._logged(job, log)
        finally:
            if shared:
                data.unpersist()

    def _logged(self, job: Job, log: StepLog) -> None:
        took = time.monotonic() - log.began
        entries = log.entries()
        for e in entries[1:]:
            job.logs.append(f"{e['step']}: {e['rowsIn']} -> {e['rowsOut']} rows, columns {', '.join(e['columns'])}")
        if entries[0]["rowsOut"] is not None:
            self.metrics("analysis.throughput", entries[0]["rowsOut"] / max(took, 1e-9))

    def _step_data(self, results: dict[str, Result], i: StepInput) -> tuple[DataFrame, SeriesKey]:
        """An array field of an earlier step as a table: it stays distributed."""
        got = results[i.from_].series.get(i.field)
        if got is None or not isinstance(got[0].schema[got[1]].dataType, T.NumericType):
            raise EngineError("analysis.invalid_step_input", f'"{i.from_}.{i.field}" is no numeric array')
        frame, column = got
        out = frame.select(F.col(INDEX), F.col(column).cast("double").alias(i.column))
        if i.index_field:
            other = results[i.from_].series.get(i.index_field)
            if other is None:
                raise EngineError("analysis.invalid_step_input", f'"{i.from_}.{i.index_field}" is no array')
            if other[0] is frame:
                out = frame.select(F.col(INDEX), F.col(column).cast("double").alias(i.column), F.col(other[1]).cast("double").alias(i.index_column))
            else:
                out = out.join(other[0].select(F.col(INDEX), F.col(other[1]).cast("double").alias(i.index_column)), INDEX)
        return out.withColumnRenamed(INDEX, "_position"), SeriesKey.of("_position")

    def _rows(self, frame: DataFrame) -> list[dict] | None:
        """All rows, or nothing where they have more than ``SERIES_VALUES`` values."""
        most = SERIES_VALUES // len(frame.columns)
        rows = frame.limit(most + 1).collect()
        return [r.asDict(recursive=True) for r in rows] if len(rows) <= most else None

    def _value(self, result: Result, field: str | None) -> Any:
        """The bounded value of a field: a number, or a list; whole results are maps of their scalars, of the frame itself beyond the bound."""
        if field is None:
            rows = self._rows(result.scalars) if result.scalars is not None else []
            if rows is None:
                return {**result.plain, "rows": result.scalars}
            return {**result.plain, **(rows[0] if len(rows) == 1 else {"rows": rows})}
        if field in result.plain:
            return result.plain[field]
        if field in result.series:
            frame, column = result.series[field]
            if frame.columns == [field]:  # one number
                row = frame.first()
                return row[0] if row else None
            order = INDEX if INDEX in frame.columns else frame.columns[0]
            found = [r[0] for r in frame.orderBy(order).select(column).limit(SERIES_VALUES + 1).collect()]
            return found if len(found) <= SERIES_VALUES else frame.select(order, column)
        if result.scalars is not None and field in result.scalars.columns:
            rows = self._rows(result.scalars)
            if rows is None:
                return result.scalars
            values = [r[field] for r in rows]
            size = len({r["a"] for r in rows}) if rows and {"a", "b"} <= set(rows[0]) else 0
            if size and size * size == len(rows):  # a matrix, by rows
                return [values[k : k + size] for k in range(0, len(values), size)]
            return values if len(values) > 1 else values[0] if values else None
        raise KeyError(field)

    def _artifact(self, spec: Spec, job: Job, o: OutputDef, results: dict[str, Result]) -> Artifact | None:
        result = results[o.source_key]
        try:
            value = self._value(result, o.field)
            index = self._value(result, o.index_field) if o.index_field else None
        except KeyError as e:
            job.errors.append({"code": "artifact.unproduced_field", "message": f'"{o.source_key}.{e.args[0]}" was not made', "output": o.name})
            return None
        extra = {"index": index} if index is not None else {}
        if o.type == "summary" and not (isinstance(value, DataFrame) or isinstance(value, dict) and isinstance(value.get("rows"), DataFrame)):
            value = json.dumps(value, default=str)
        elif o.type == "metric" and not isinstance(value, (int, float, bool)) and value is not None:
            numbers = [v for v in value.values() if isinstance(v, (int, float))] if isinstance(value, dict) else value if isinstance(value, list) else []
            value = float(numbers[0]) if numbers else 0.0
        elif o.type == "model":
            held = value if isinstance(value, dict) else {}
            extra |= {"modelVersion": o.parameters.get("modelVersion") or held.get("modelVersion", spec.version), "performanceMetrics": o.parameters.get("performanceMetrics") or held.get("performanceMetrics") or {"result": 1}}
            value = held.get("parameters", value)
            if not value:
                raise EngineError("artifact.build_error", f'model "{o.name}" has no parameters')
        elif o.type == "chart":
            extra |= {"series": [{"name": o.field or o.name, "points": series_points(value, index)}], "xAxis": {"label": o.index_field or "index", "type": "linear"}, "yAxis": {"label": o.field or "value", "type": "linear"}}
        elif o.type == "series":
            value = value if isinstance(value, (list, DataFrame)) else [value]
            extra |= {"points": series_points(value, index)}
        return Artifact(f"artifact-{uuid.uuid4().hex[:12]}", o.type, o.name, value, job.job_id, spec.spec_id, spec.version, list(o.parameters.get("tags", [])), extra=extra)

    # -- alerts ---------------------------------------------------------------------------------------------------------

    def _rules(self, spec: Spec) -> list[Rule]:
        return [Rule(o.name, o.parameters.get("condition", "value > 0"), o.parameters.get("severity", "warn"), o.parameters.get("actionHook")) for o in spec.outputs if o.type == "alert"]

    def _alerts(self, spec: Spec, job: Job, data: DataFrame, key: SeriesKey) -> list[dict]:
        rules = self._rules(spec)
        if not rules:
            return []
        now = self.clock() if self.clock else None
        hooks = {r.rule_id: r.action_hook for r in rules}
        found = [r.asDict() for r in evaluate_frame(data, rules, key.order_by, now).collect()]  # a row per rule
        for a in found:
            art = Artifact(f"artifact-{uuid.uuid4().hex[:12]}", "alert", a["ruleId"], a, job.job_id, spec.spec_id, spec.version)
            self.artifacts.save(art)
            job.artifact_ids.append(art.artifact_id)
            if a["triggered"]:
                self.publisher.send(a, hooks[a["ruleId"]])
        self.metrics("analysis.alert_count", float(sum(a["triggered"] for a in found)))
        return found

    def evaluate_alert(self, artifact_id: str) -> dict:
        """The rule of an alert artifact against its spec's first source that answers."""
        art = self.artifacts.get(artifact_id)
        spec = self.specs.get(art.spec_id)
        for s in spec.input_sources:
            try:
                df = self._read(s)
            except EngineError:
                continue
            rule = next(r for r in self._rules(spec) if r.rule_id == art.name)
            return evaluate_frame(df, [rule], self._key(df, spec).order_by, self.clock() if self.clock else None).first().asDict()
        raise EngineError("source.unavailable", "no source answered")

    # -- streams --------------------------------------------------------------------------------------------------------

    def _stream(self, spec: Spec, job: Job) -> None:
        """One running query for the source: windows as keyed state, artifacts per trigger, rules over the windows' points.

        Row-wise transforms run before the windows.  A rule's column is one of the source's; ``value``, where the source
        has no such column, is the window's value.  With ``availableNow`` the job ends with the stream.
        """
        first = spec.input_sources[0]
        source = merge.alias_columns(self.sources.subscribe(self.spark, first.source_type, first.query, first.filter), first.column_aliases)
        p = job.parameters
        if spec.transforms:
            whole_series = {"sort", "fillna", "resample", "join"}
            for t in spec.transforms:
                if t.name in whole_series and not (t.name == "fillna" and t.parameters.get("method", "value") == "value"):
                    raise EngineError("transform.parameter_error", f'"{t.name}" needs the whole series and can\'t run on a stream', step=f"transform:{t.name}")
            source = self.transforms.run(source, [(t.name, t.parameters) for t in spec.transforms], self._key(source, spec))
        ts = p.get("timestampColumn") or time_column(source)
        value = p.get("valueColumn") or next(f.name for f in source.schema if isinstance(f.dataType, T.NumericType))
        rules = self._rules(spec)
        hooks = {r.rule_id: r.action_hook for r in rules}
        shape = stateful.shape_of(p.get("windowSize", "5m"), p.get("windowKind", "sliding"), p.get("maxWindowPoints"), p.get("allowedLateness"), [self._condition(job, r) for r in rules], self.clock().timestamp() if self.clock else None)
        made = stateful.stream_windows(source, ts, value, shape, p.get("keyColumn"))

        def each(batch: DataFrame, number: int) -> None:
            batch = batch.persist()  # artifacts and alerts read it
            own = batch.drop("alerts")
            states = self._rows(own)
            if states is None:  # the batch ends with its trigger: its table stays
                own = materialised(own, "stream-batch")
            for state in [own] if states is None else states:
                for o in spec.outputs:
                    if o.source_key in ("windowState", "pointCount", "lateDropped", "overflowDropped"):
                        whole = o.source_key == "windowState"
                        v = state if whole else state.select("series", "windowEnd", o.source_key) if states is None else state[o.source_key]
                        art = Artifact(f"artifact-{uuid.uuid4().hex[:12]}", o.type, o.name, v, job.job_id, spec.spec_id, spec.version, extra={"batch": number})
                        self.artifacts.save(art)
                        job.artifact_ids.append(art.artifact_id)
            if rules:
                for a in batch.select("series", F.explode("alerts").alias("a")).where("a.triggered").toLocalIterator():
                    r = rules[a["a"]["rule"]]
                    self.publisher.send({"ruleId": r.rule_id, "severity": r.severity, "condition": r.condition, "triggered": True, "value": a["a"]["value"], "at": a["a"]["at"], "series": a["series"]}, hooks[r.rule_id])
            batch.unpersist()

        place = p.get("checkpointLocation") or f"{shared_dir(self.spark)}/stream-{job.job_id}"
        writer = made.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", place)
        writer = writer.trigger(availableNow=True) if p.get("availableNow") else writer.trigger(processingTime=f"{seconds(p.get('emitInterval') or '1m', 60)} seconds")
        with stateful.state_store(self.spark):
            job.handle = writer.start()

        def ended() -> None:
            """What still waits at the end of a finished stream is released; then the job is done."""
            try:
                try:
                    job.handle.awaitTermination()
                finally:
                    self.spark.streams.removeListener(job.listener)
                if job.status != "running" or not p.get("availableNow"):
                    return
                if shape.lateness is not None:
                    each(stateful.flushed(self.spark, place, shape), -1)
                self._move(job, "completed")
                job.progress = 1.0
            except Exception as e:
                if job.status == "running":
                    job.errors.append({"code": "stream.error", "message": str(e).strip().split("\n")[0][:500]})
                    self._move(job, "failed")

        self._listen(job)
        job.watch = threading.Thread(target=ended, name=job.job_id, daemon=True)
        job.watch.start()

    def _listen(self, job: Job) -> None:
        """Every micro-batch of the job's query tells its throughput."""
        metrics, query = self.metrics, job.handle.id

        class Progress(StreamingQueryListener):
            def onQueryStarted(self, event) -> None:
                pass

            def onQueryProgress(self, event) -> None:
                if str(event.progress.id) == query:
                    metrics("analysis.throughput", float(event.progress.processedRowsPerSecond))

            def onQueryIdle(self, event) -> None:
                pass

            def onQueryTerminated(self, event) -> None:
                pass

        job.listener = Progress()
        self.spark.streams.addListener(job.listener)

    def _condition(self, job: Job, rule: Rule) -> Condition | None:
        """The rule's condition; one that can't be read is noted and never holds."""
        try:
            return parse(rule.condition)
        except EngineError as e:
            job.errors.append({"code": e.code, "message": e.message, "ruleId": rule.rule_id})
            return None
