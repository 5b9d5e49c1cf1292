"""The pipeline source file, loaded as the runner loads it; its flows run on this session instead of a server."""

from __future__ import annotations

import importlib.util
from pathlib import Path

import pytest
import yaml
from pyspark.pipelines.graph_element_registry import GraphElementRegistry, graph_element_registration_context
from pyspark.pipelines.output import MaterializedView, TemporaryView

from covenant import Contract, apply_contract
from covenant.plans.job import bundled_contracts
from tests.helpers import rows

FOLDER = Path(__file__).parent.parent / "pipeline_source"
SUFFIXES = ("_bronze", "_typed", "_judged", "", "_quarantine")
TAGS = """
version: "1"
name: tags
source: {format: parquet, path: raw/tags}
primary_key: [k]
partition_by: [day]
dedup: {keys: [k], order_by: at, keep: last}
columns:
  - {name: k, type: long, nullable: false}
  - {name: at, type: timestamp, nullable: false}
  - {name: tag, type: string, rules: {regex: "^a", on_fail: quarantine}}
  - {name: mail, type: string, rules: {unique: true, on_fail: warn}}
derived:
  - {name: day, from: at, expr: to_date}
"""


class Recorder(GraphElementRegistry):
    def __init__(self):
        self.outputs, self.flows = {}, {}

    def register_output(self, output):
        assert output.name not in self.outputs
        self.outputs[output.name] = output

    def register_flow(self, flow):
        assert flow.target in self.outputs or flow.name == flow.target
        self.flows[flow.target] = flow

    def register_sql(self, sql_text, file_path):
        raise AssertionError("the source has no SQL files")


def load() -> Recorder:
    """Every file of the folders in the spec, under the registry that Spark's own decorators write to."""
    recorder = Recorder()
    spec = yaml.safe_load((FOLDER / "spark-pipeline.yml").read_text())
    with graph_element_registration_context(recorder):
        for library in spec["libraries"]:
            for file in sorted(p for p in FOLDER.glob(library["glob"]["include"] + "/*.py")):
                found = importlib.util.spec_from_file_location(file.stem, str(file))
                found.loader.exec_module(importlib.util.module_from_spec(found))
    return recorder


@pytest.fixture
def settings(spark):
    """Sets configuration as a spec does, and takes it back."""
    taken = []

    def give(**values):
        for name, value in values.items():
            taken.append(f"spark.covenant.{name}")
            spark.conf.set(taken[-1], value)

    yield give
    for name in taken:
        spark.conf.unset(name)


def test_spec_has_what_the_runner_takes():
    spec = yaml.safe_load((FOLDER / "spark-pipeline.yml").read_text())
    assert {"name", "storage"} <= set(spec) <= {"name", "storage", "catalog", "database", "schema", "configuration", "libraries"}
    assert all(isinstance(v, str) for v in spec["configuration"].values())
    assert all(library["glob"]["include"].endswith("/**") for library in spec["libraries"])


def test_bundled_contracts_register(spark, settings):
    settings(source_base="/landing")
    contracts, loaded = bundled_contracts(), load()
    assert list(loaded.outputs) == [f"{c.name}{s}" for c in contracts for s in SUFFIXES]
    assert set(loaded.flows) == set(loaded.outputs)
    for contract in contracts:
        valid, rejected = loaded.outputs[contract.name], loaded.outputs[f"{contract.name}_quarantine"]
        assert isinstance(valid, MaterializedView) and isinstance(rejected, MaterializedView)
        assert tuple(valid.partition_cols or ()) == contract.partition_by
        assert all(isinstance(loaded.outputs[f"{contract.name}{s}"], TemporaryView) for s in SUFFIXES[:2])


def test_flows_give_what_the_batch_plan_gives(spark, settings, tmp_path):
    data = [(i % 40, f"2024-05-{1 + i % 28:02d} 10:00:00", ("a", "b")[i % 7 == 0], f"m{i % 30}") for i in range(90)]
    data += [(None, "2024-05-01 00:00:00", "a", "m"), (99, None, "a", None), (98, "2024-05-01 00:00:00", None, None)]
    raw = spark.createDataFrame(data, "k long, at string, tag string, mail string").selectExpr("k", "timestamp(at) AS at", "tag", "mail")
    raw.write.parquet(str(tmp_path / "landing" / "raw" / "tags"))
    (tmp_path / "tags.yaml").write_text(TAGS)
    settings(contracts=str(tmp_path / "*.yaml"), source_base=str(tmp_path / "landing" / "raw"))
    loaded = load()
    assert list(loaded.outputs) == [f"tags{s}" for s in SUFFIXES]
    for name in loaded.outputs:
        loaded.flows[name].func().createOrReplaceTempView(name)
    batch = apply_contract(raw, Contract.from_yaml(tmp_path / "tags.yaml"))
    assert rows(spark.table("tags")) == rows(batch.valid) != []
    assert rows(spark.table("tags_quarantine")) == rows(batch.quarantine) != []
    assert loaded.outputs["tags"].partition_cols == ["day"]
    assert isinstance(loaded.outputs["tags_judged"], MaterializedView)  # two datasets read it


def test_no_contract_is_told(spark, settings, tmp_path):
    settings(contracts=str(tmp_path / "none-*.yaml"))
    with pytest.raises(SystemExit, match="no contract"):
        load()
