"""Alert conditions: a small language, compiled so that all rules of a run share one aggregate query."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durations import seconds
from ..errors import EngineError
from ..operators.merge import TIME

#: The grammar of conditions.
_OPS = r"(>=|<=|==|!=|>|<)"
_RATE = re.compile(rf'rate\((\w+),\s*"([^"]+)",\s*(\d+[smhd])\)\s*{_OPS}\s*(.+)')
_WINDOW = re.compile(rf"(\w+)\((\w+),\s*(\d+[smhd])\)\s*{_OPS}\s*(.+)")
_SIMPLE = re.compile(rf"(\w+)\s+{_OPS}\s+(.+)")
COMPARE: dict[str, Callable[[Any, Any], Any]] = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


@dataclass(frozen=True)
class Condition:
    kind: str  # simple, window, rate
    column: str
    operator: str
    threshold: float
    window: str = ""
    aggregate: str = ""
    match: str = ""


def parse(text: str) -> Condition:
    s = text.strip()

    def threshold(x: str) -> float:
        try:
            return float(x.strip())
        except ValueError as e:
            raise EngineError("alert.invalid_condition", f'bad threshold in "{text}"') from e

    if m := _RATE.fullmatch(s):
        return Condition("rate", m[1], m[4], threshold(m[5]), m[3], match=m[2])
    if m := _WINDOW.fullmatch(s):
        return Condition("window", m[2], m[4], threshold(m[5]), m[3], aggregate=m[1])
    if m := _SIMPLE.fullmatch(s):
        return Condition("simple", m[1], m[2], threshold(m[3]))
    parts = s.split()
    if len(parts) >= 3 and parts[1] in COMPARE:
        return Condition("simple", parts[0], parts[1], threshold(parts[2]))
    raise EngineError("alert.invalid_condition", f'can\'t read "{text}"')


def _number(c: str) -> Column:
    return F.col(c).cast("string").try_cast("double")


def aggregate_for(df: DataFrame, c: Condition, order: Column, top: Any, now: datetime) -> Column:
    """The rule's value, with whether it triggers, as one struct-valued aggregate."""
    if c.column not in df.columns:
        return F.struct(F.lit(False).alias("triggered"), F.lit(None).cast("double").alias("value"))
    t = F.unix_micros(F.col(TIME).cast("timestamp")) if TIME in df.columns else None
    if c.kind == "simple":
        hit = COMPARE[c.operator](_number(c.column), F.lit(c.threshold))
        found = F.min_by(_number(c.column), F.when(hit, order))
        any_hit = F.coalesce(F.bool_or(hit), F.lit(False))
        return F.struct(any_hit.alias("triggered"), F.when(any_hit, found).otherwise(F.max_by(_number(c.column), order)).alias("value"))
    if c.kind == "rate":
        minutes = seconds(c.window) / 60
        inside = (F.col(c.column).cast("string") == c.match) & ((t >= int(now.timestamp() * 1e6) - seconds(c.window) * 1_000_000) | t.isNull() if t is not None else F.lit(True))
        rate = F.count_if(F.coalesce(inside, F.lit(False))) / F.lit(minutes) if minutes else F.lit(None).cast("double")
        return F.struct(F.coalesce(COMPARE[c.operator](rate, F.lit(c.threshold)), F.lit(False)).alias("triggered"), rate.cast("double").alias("value"))
    x = F.when(t >= F.lit(top) - seconds(c.window) * 1_000_000, _number(c.column)) if t is not None and top is not None else _number(c.column)
    n = F.count(x)
    made = {"avg": F.avg(x), "min": F.min(x), "max": F.max(x), "sum": F.sum(x), "count": n.cast("double"), "std": F.coalesce(F.stddev_samp(x), F.lit(0.0))}
    value = F.when(n > 0, made.get(c.aggregate, F.lit(0.0)))
    return F.struct(F.coalesce(COMPARE[c.operator](value, F.lit(c.threshold)), F.lit(False)).alias("triggered"), value.alias("value"))


@dataclass(frozen=True)
class Rule:
    rule_id: str
    condition: str
    severity: str = "warn"
    action_hook: str | None = None


def evaluate_frame(df: DataFrame, rules: Sequence[Rule], order_by: Sequence[str], now: datetime | None = None) -> DataFrame:
    """(ruleId, severity, condition, triggered, value): every rule in one aggregate. Rules that can't be read don't trigger."""
    now = now or datetime.now(timezone.utc)
    parsed: list[Condition | None] = []
    for r in rules:
        try:
            parsed.append(parse(r.condition))
        except EngineError:
            parsed.append(None)
    top: dict[str, int] = {}
    windows = sorted({c.column for c in parsed if c and c.kind == "window" and c.column in df.columns})
    if windows and TIME in df.columns:
        micros = F.unix_micros(F.col(TIME).cast("timestamp"))
        row = df.agg(*(F.max(F.when(_number(c).isNotNull(), micros)).alias(c) for c in windows)).first()
        top = {c: row[c] for c in windows}
    order = F.struct(*order_by)
    nothing = F.struct(F.lit(False).alias("triggered"), F.lit(None).cast("double").alias("value"))
    aggs = [(aggregate_for(df, c, order, top.get(c.column), now) if c else nothing).alias(f"r{i}") for i, c in enumerate(parsed)]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    rows = F.array(*(F.struct(F.lit(r.rule_id).alias("ruleId"), F.lit(r.severity).alias("severity"), F.lit(r.condition).alias("condition"), F.col(f"r{i}.triggered").alias("triggered"), F.col(f"r{i}.value").alias("value")) for i, r in enumerate(rules)))
    return one.select(F.explode(rows).alias("x")).select("x.*")


@dataclass
class Publisher:
    """Sends triggered alerts on; hooks are form:<template>, others only leave a warning. Neither stops a run."""

    publish: Callable[[str, dict], None] = lambda topic, payload: None
    warnings: list[dict] = field(default_factory=list)

    def send(self, alert: dict, hook: str | None = None) -> None:
        try:
            self.publish("analysis.alert", alert)
            if hook and hook.startswith("form:"):
                self.publish("analysis.alert.form", {**alert, "template": hook[5:]})
            elif hook:
                self.warnings.append({"hook": hook, "ruleId": alert["ruleId"]})
        except Exception as e:
            self.warnings.append({"code": "alert.publish_failed", "message": str(e), "ruleId": alert["ruleId"]})
