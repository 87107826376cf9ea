import glob
import random

import pytest
from pyspark.sql import DataFrameWriter

from semgraph.plans.ingest import ingest
from semgraph.sources.graph_commits import compact, live_commits, read_commits, remove_entities

RECORD = "id string, name string, owner_id string, n long"
RULES = {"entity_type_mapping": {"id": "Thing"}}


def take(spark, path, rows, ws="w", **more):
    return ingest(spark.createDataFrame(rows, RECORD), ws, "n", path, rules=RULES, **more).first()


def held(spark, path):
    entities, relations = read_commits(spark, path)
    return ({(r["workspace_id"], r["id"]): r["props"].get("name") for r in entities.collect()},
            sorted((r["workspace_id"], r["source_id"], r["target_id"]) for r in relations.collect()))


def test_ingests_add_up(spark, tmp_path):
    path = str(tmp_path / "g")
    first = [("1", "a", "9", 1), ("1", "b", "9", 2), ("2", "A ", "9", 3)]
    take(spark, path, first)
    want = ({("w", "Thing:1"): "b", ("w", "Thing:2"): "A "}, [("w", "Thing:1", "Owner:9"), ("w", "Thing:2", "Owner:9")])
    got = held(spark, path)
    assert got[1] == want[1] and got[0]["w", "Thing:1"] == "b"
    take(spark, path, first)
    assert held(spark, path) == got and len(read_commits(spark, path)[0].collect()) == len(got[0])
    take(spark, path, [("1", "c", "9", 0)])
    assert held(spark, path)[0]["w", "Thing:1"] == "c"
    take(spark, path, first[:2])
    assert held(spark, path)[0]["w", "Thing:1"] == "c"
    take(spark, path, [("1", "other", "9", 0)], ws="007")
    whole = held(spark, path)
    assert whole[0]["007", "Thing:1"] == "other" and whole[0]["w", "Thing:1"] == "c"
    compact(spark, path)
    assert len(live_commits(spark, path)) == 1 and held(spark, path) == whole
    assert compact(spark, path) is None


def test_a_run_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "g")
    take(spark, path, [("1", "a", "9", 1)])
    before, write = held(spark, path), DataFrameWriter.parquet

    def dies(self, target, *rest, **more):
        if "/relations/" in target:
            raise RuntimeError("lost")
        return write(self, target, *rest, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    with pytest.raises(RuntimeError, match="lost"):
        take(spark, path, [("1", "b", "8", 1), ("2", "c", "8", 2)])
    monkeypatch.undo()
    assert held(spark, path) == before
    take(spark, path, [("1", "b", "8", 1), ("2", "c", "8", 2)])
    assert held(spark, path)[0] == {("w", "Thing:1"): "b", ("w", "Thing:2"): "c"}


def test_a_small_ingest_writes_few_files(spark, tmp_path):
    path = str(tmp_path / "g")
    take(spark, path, [(str(i), f"n{i}", str(i % 7), i) for i in range(500)])
    before = set(glob.glob(f"{path}/**/*.parquet", recursive=True))
    take(spark, path, [("3", "new", "1", 0)])
    after = set(glob.glob(f"{path}/**/*.parquet", recursive=True))
    assert before < after and len(after - before) <= 4
    assert len(held(spark, path)[0]) == 500


def test_removed_entities_may_come_back(spark, tmp_path):
    path = str(tmp_path / "g")
    rows = [("1", "a", "9", 1), ("2", "b", "9", 2)]
    for ws in ("v", "w"):
        take(spark, path, rows, ws=ws)
    remove_entities(spark, path, spark.createDataFrame([("w", "Thing:1"), ("w", "none")], "workspace_id string, id string"))
    left = held(spark, path)
    assert left == ({("v", "Thing:1"): "a", ("v", "Thing:2"): "b", ("w", "Thing:2"): "b"},
                    [("v", "Thing:1", "Owner:9"), ("v", "Thing:2", "Owner:9"), ("w", "Thing:2", "Owner:9")])
    take(spark, path, rows)
    assert held(spark, path)[0] == {**left[0], ("w", "Thing:1"): "a"}


def test_random_ingests_against_a_dictionary(spark, tmp_path):
    rng, path = random.Random(11), str(tmp_path / "g")
    seen, graph = set(), {}
    for _ in range(6):
        rows = [(str(rng.randint(1, 5)), rng.choice("abcdef"), None, n) for n in range(4)]
        take(spark, path, rows, compact_after=3)
        for ident, name, _owner, n in rows:
            if (name, n) not in seen:
                seen.add((name, n))
                graph["w", f"Thing:{ident}"] = name
        assert held(spark, path)[0] == graph


def test_no_graph_yet(spark, tmp_path):
    with pytest.raises(ValueError):
        read_commits(spark, str(tmp_path / "g"))
    take(spark, str(tmp_path / "g"), [])
    assert held(spark, str(tmp_path / "g")) == ({}, [])
