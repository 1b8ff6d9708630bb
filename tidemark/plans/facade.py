"""The tool and resource surface over an engine."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any
from urllib.parse import urlsplit

from ..errors import EngineError
from .engine import Engine
from .model import Spec

TOOLS = ("list_specs", "run", "get_job", "get_artifacts", "create_spec", "update_spec", "evaluate_alert")


class Facade:
    def __init__(self, engine: Engine):
        self.engine = engine

    def call(self, tool: str, args: Mapping[str, Any], role: str | None = None, actor: str = "anonymous") -> dict:
        """Results as maps; errors as {"error": {code, message}}."""
        try:
            name = tool.removeprefix("analysis.")
            if name not in TOOLS:
                raise EngineError("mcp.unknown_tool", f'no tool "{tool}"')
            allowed = {"run": "execute", "get_job": "view_job", "get_artifacts": "view_artifacts", "evaluate_alert": "execute"}.get(name, name)
            if role is not None:
                self.engine.policy.check(actor, role, allowed)
            return getattr(self, f"_{name}")(args)
        except KeyError as e:
            return {"error": {"code": "mcp.invalid_arguments", "message": f"{e.args[0]} is missing"}}
        except EngineError as e:
            return {"error": {"code": e.code, "message": e.message}}

    def _list_specs(self, a):
        return {"specs": [{"specId": s.spec_id, "version": s.version} for s in self.engine.specs.search(a.get("query", ""), a.get("limit"), a.get("offset", 0))]}

    def _run(self, a):
        job = self.engine.run(a["specId"], a.get("mode", "batch"), a.get("parameters"))
        return {"jobId": job.job_id, "status": job.status}

    def _get_job(self, a):
        j = self.engine.job(a["jobId"])
        return {"jobId": j.job_id, "status": j.status, "progress": j.progress, "errors": j.errors, "artifactIds": j.artifact_ids}

    def _get_artifacts(self, a):
        found = self.engine.artifacts.query(a.get("jobId"), a.get("specId"), a.get("type"), a.get("tags"), limit=a.get("limit"))
        return {"artifacts": [{"artifactId": x.artifact_id, "type": x.kind, "name": x.name, "value": x.value} for x in found]}

    def _create_spec(self, a):
        s = self.engine.create_spec(a["spec"])
        return {"specId": s.spec_id, "version": s.version}

    def _update_spec(self, a):
        spec = Spec.from_dict(a["spec"])
        self.engine.specs.get(spec.spec_id)
        return self._create_spec({"spec": spec})

    def _evaluate_alert(self, a):
        return self.engine.evaluate_alert(a["alertRuleId"])

    def resource(self, uri: str) -> dict:
        """analysis:///spec/<id>[/v/<version>], /artifact/<id>, /job/<id>, /catalog"""
        u = urlsplit(uri)
        parts = [p for p in u.path.split("/") if p]
        if u.scheme != "analysis" or not parts:
            raise EngineError("mcp.invalid_uri", f'bad URI "{uri}"')
        if parts[0] == "catalog":
            return {"functions": [{"name": i.name, "required": list(i.required), "optional": list(i.optional), "results": list(i.results)} for i in self.engine.functions.by_name.values()]}
        if parts[0] not in ("spec", "artifact", "job"):
            raise EngineError("mcp.unknown_resource", f'no resource "{parts[0]}"')
        if len(parts) < 2:
            raise EngineError("mcp.invalid_uri", "an id is missing")
        if parts[0] == "spec":
            s = self.engine.specs.get(parts[1], parts[3] if len(parts) >= 4 and parts[2] == "v" else None)
            return {"specId": s.spec_id, "version": s.version}
        if parts[0] == "artifact":
            x = self.engine.artifacts.get(parts[1])
            return {"artifactId": x.artifact_id, "type": x.kind, "name": x.name, "value": x.value}
        return self._get_job({"jobId": parts[1]})
