"""Functions from outside: a manifest says for which engine versions a function is made, and how long it may take."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.util import inheritable_thread_target

from ..errors import EngineError
from ..functions.base import Params, Result
from ..functions.registry import Function, FunctionInfo, Registry
from ..series import SeriesKey
from .governance import compatible

VERSION = "1.0.0"
TIMEOUT = 60.0


@dataclass(frozen=True)
class Manifest:
    name: str
    versions: str | None = None  # e.g. ^1.0.0, or >=1.0.0 <2.0.0
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    results: tuple[str, ...] = ()
    description: str = ""


def limited(name: str, fn: Function, timeout: float) -> Function:
    """``fn`` in a thread of its own; after ``timeout`` seconds the Spark jobs that it started are cancelled.

    The limit holds for making the result. What of it is lazy runs with the job that asks for it.
    """

    def run(df: DataFrame, key: SeriesKey, params: Params) -> Result:
        spark, tag = df.sparkSession, f"plugin-{uuid.uuid4().hex}"

        def work() -> Result:
            spark.addTag(tag)
            try:
                return fn(df, key, params)
            finally:
                spark.removeTag(tag)

        pool = ThreadPoolExecutor(1, thread_name_prefix=name)
        future = pool.submit(inheritable_thread_target(spark)(work))
        try:
            return future.result(timeout)
        except EngineError:
            raise
        except Exception as e:
            if isinstance(e, TimeoutError) and not future.done():
                spark.interruptTag(tag)
                raise EngineError("analysis.execution_error", f'"{name}" took more than {timeout:g} s', details={"timeout": timeout}) from e
            raise EngineError("plugin.execution_error", f"{name}: {e}", step=f"function:{name}") from e
        finally:
            pool.shutdown(wait=False)

    return run


class PluginLoader:
    def __init__(self, functions: Registry, version: str = VERSION, timeout: float = TIMEOUT):
        self.functions, self.version, self.timeout = functions, version, timeout
        self.manifests: dict[str, Manifest] = {}

    def load(self, manifest: Manifest, fn: Function) -> None:
        if not manifest.name:
            raise EngineError("plugin.invalid_manifest", "the function has no name")
        if manifest.versions is None:
            raise EngineError("plugin.invalid_manifest", f'"{manifest.name}" names no versions')
        if not compatible(manifest.versions, self.version):
            raise EngineError("plugin.incompatible_version", f'"{manifest.name}" is for {manifest.versions}, this is {self.version}', details={"plugin": manifest.name, "supportedRange": manifest.versions, "currentVersion": self.version})
        self.functions.register(FunctionInfo(manifest.name, limited(manifest.name, fn, self.timeout), manifest.required, manifest.optional, manifest.results, manifest.description))
        self.manifests[manifest.name] = manifest

    def unload(self, name: str) -> None:
        """Only what was loaded here: built-in functions stay."""
        if self.manifests.pop(name, None) is not None:
            self.functions.unregister(name)

    def is_plugin(self, name: str) -> bool:
        return name in self.manifests
