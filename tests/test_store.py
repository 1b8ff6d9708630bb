"""Artifacts beyond the driver's bound, saved and read back whole."""

import json
from datetime import timezone

import numpy as np

from tidemark.plans.model import Artifact
from tidemark.plans.store import ArtifactStore, KeyValueStore, restored

N = 200_000


def artifact(kind, value, name="a"):
    return Artifact(f"artifact-{name}", kind, name, value, "job", "spec", "1.0.0")


def test_a_long_series_is_read_back_whole(spark):
    frame = spark.range(N).selectExpr("id AS idx", "sin(id) AS value")
    held = {}
    kept = KeyValueStore("ns", held.get, held.__setitem__)
    store = ArtifactStore(kept)
    store.save(artifact("series", frame))
    store.save(artifact("table", {"n": 1, "rows": spark.range(5)}, "b"))
    again = ArtifactStore(kept)
    got = again.get("artifact-a", spark)
    assert got.value.count() == N and got.created_at.tzinfo is not None and got.created_at == store.get("artifact-a").created_at.astimezone(timezone.utc)
    values = got.value.orderBy("idx").toPandas()["value"].to_numpy()
    assert np.array_equal(values, frame.orderBy("idx").toPandas()["value"].to_numpy())
    b = again.get("artifact-b", spark).value
    assert b["n"] == 1 and sorted(r.id for r in b["rows"].collect()) == [0, 1, 2, 3, 4]


def test_artifacts_as_rows_name_the_tables_of_their_frames(spark):
    store = ArtifactStore()
    store.save(artifact("series", spark.range(N)))
    store.save(artifact("metric", 2.5, "m"))
    rows = {r.name: json.loads(r.payload) for r in store.to_frame(spark).collect()}
    assert rows["m"] == 2.5 and restored(spark, rows["a"]).agg({"id": "sum"}).first()[0] == N * (N - 1) // 2


