"""Roles, the audit log, masking, and plug-in versions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError

# What each role may do, from the least to the most powerful.
OPERATOR = ("list_specs", "view_spec", "execute", "view_job", "view_artifacts", "cancel_own_job")
ENGINEER = (*OPERATOR, "create_spec", "update_spec")
ADMIN = (*ENGINEER, "cancel_any_job", "view_audit", "manage_rbac")
ROLES = {"operator": OPERATOR, "engineer": ENGINEER, "admin": ADMIN}
_RANK = list(ROLES)


@dataclass
class Policy:
    def effective(self, role: str, groups: Iterable[str] = ()) -> str:
        """The strongest of the role and the roles of the groups; a group may be written in the plural."""
        named = [g.lower().removesuffix("s") for g in groups]
        best = max([r for r in named if r in ROLES], key=_RANK.index, default=None)
        here = _RANK.index(role) if role in ROLES else 0
        return best if best and _RANK.index(best) > here else role

    def check(self, actor: str, role: str, operation: str, groups: Iterable[str] = ()) -> None:
        got = self.effective(role, groups)
        if operation not in ROLES.get(got, ()):
            raise EngineError("governance.unauthorized", f'"{actor}" as {got} may not {operation}', details={"actorId": actor, "role": got, "operation": operation})


@dataclass
class AuditLog:
    """``sink``: where entries are kept besides; an action whose entry can't be kept doesn't happen."""

    entries: list[dict] = field(default_factory=list)
    sink: Callable[[dict], None] | None = None

    def add(self, actor: str, action: str, target: str) -> None:
        entry = {"time": datetime.now(timezone.utc), "actor": actor, "action": action, "target": target}
        if self.sink is not None:
            try:
                self.sink(entry)
            except Exception as e:
                raise EngineError("governance.audit_failed", f"{action} of {target}: {e}") from e
        self.entries.append(entry)

    def between(self, start: datetime, end: datetime) -> list[dict]:
        return [e for e in self.entries if start <= e["time"] <= end]


MASK = "***"


def mask_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.lit(MASK) for c in columns if c in df.columns})


def _version(text: str) -> tuple[int, int, int]:
    a, b, c = (text.split("-")[0].split("+")[0].split(".") + ["0", "0"])[:3]
    return int(a), int(b), int(c)


def compatible(range_: str, version: str) -> bool:
    """^1.2.0, or space-separated >=, >, <=, <, = conditions; what is no version fits nothing."""
    try:
        v, parts = _version(version), range_.split()
        [_version(part.lstrip("<>=^")) for part in parts]
    except ValueError:
        return False
    for part in parts:
        op = next(o for o in (">=", "<=", "^", ">", "<", "=", "") if part.startswith(o))
        w = _version(part[len(op) :])
        ok = {">=": v >= w, "<=": v <= w, ">": v > w, "<": v < w, "=": v == w, "": v == w, "^": v >= w and v[0] == w[0]}[op]
        if not ok:
            return False
    return True
