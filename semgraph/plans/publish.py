"""Verify, publish and roll back semantic views."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.plans.semantic import BoundModel, JoinTree, SemanticError, SemanticModel

PROBLEMS = "element_kind string, element_name string, error string"


def _problem_rows(spark: SparkSession, model: SemanticModel, tables: dict | None,
                  base_path: str | None) -> list[tuple[str, str, str]]:
    problems: list[tuple[str, str, str]] = []
    frames: dict[str, DataFrame] = {}
    for name in model.objects:
        try:
            one = SemanticModel(model.name, objects={name: model.objects[name]},
                                table_mappings=model.table_mappings)
            frames[name] = one.bind(spark, tables, base_path).frames[name]
        except AnalysisException as e:
            problems.append(("object", name, e.getCondition() or "UNBOUND"))
    for name, frame in frames.items():
        present = set(frame.columns)
        problems += [("property", f"{name}.{prop}", "UNRESOLVED_COLUMN")
                     for prop, _kind in model.objects[name].properties if prop not in present]
    for rel in model.relationships:
        for side, at in ((rel.from_object, 0), (rel.to_object, 1)):
            if side in frames:
                problems += [("relationship", rel.name, f"UNRESOLVED_COLUMN {side}.{pair[at]}")
                             for pair in rel.join_keys if pair[at] not in frames[side].columns]
            elif side not in model.objects:
                problems.append(("relationship", rel.name, f"UNKNOWN_OBJECT {side}"))
    bound = BoundModel(model, spark, frames)
    for metric in model.metrics.values():
        try:
            tree = model.join_tree(metric, set())
            if set(tree.objects) <= frames.keys():
                bound.joined(tree).agg(F.expr(metric.aggregate)).schema
        except SemanticError as e:
            problems.append(("metric", metric.name, str(e)))
        except AnalysisException as e:
            problems.append(("metric", metric.name, e.getCondition() or "UNRESOLVED"))
    for name, source in model.dimensions.items():
        obj, _, prop = source.partition(".")
        if obj not in model.objects:
            problems.append(("dimension", name, f"UNKNOWN_OBJECT {obj}"))
        elif obj in frames and prop not in frames[obj].columns:
            problems.append(("dimension", name, f"UNRESOLVED_COLUMN {source}"))
    return problems


def verify_model(spark: SparkSession, model: SemanticModel, tables: dict | None = None,
                 base_path: str | None = None) -> DataFrame:
    """Bind tables, columns and expressions without running anything; one row per problem."""
    return spark.createDataFrame(_problem_rows(spark, model, tables, base_path), PROBLEMS)


def verify_environments(spark: SparkSession, model: SemanticModel,
                        environments: dict[str, dict]) -> DataFrame:
    """Verify one model against several bindings; an environment without problems has one row
    whose ``error`` is NULL."""
    rows = []
    for env, binding in environments.items():
        found = _problem_rows(spark, model, binding.get("tables"), binding.get("base_path"))
        rows += [(env, *p) for p in found] or [(env, None, None, None)]
    return spark.createDataFrame(rows, f"env string, {PROBLEMS}")


def joined_view(bound: BoundModel, root: str | None = None) -> DataFrame:
    """All objects reachable from the root side by side, columns named ``Object_column``."""
    model = bound.model
    if root is None:
        reach = {name: model.routes_from(name) for name in model.objects}
        root = max(sorted(reach), key=lambda name: len(reach[name]))
    steps: list[tuple] = []
    for target, routes in model.routes_from(root).items():
        if len(routes) > 1:
            raise SemanticError(f"ambiguous join: several routes from {root} to {target}")
        steps += [s for s in routes[0] if s not in steps]
    tree = JoinTree(root, tuple(steps))
    columns = [F.col(f"{obj}.{c}").alias(f"{obj}_{c}")
               for obj in tree.objects for c in bound.frames[obj].columns]
    return bound.joined(tree).select(*columns)


def publish(bound: BoundModel, view_name: str, root: str | None = None) -> DataFrame:
    """Publish the joined view of a bound model."""
    view = joined_view(bound, root)
    view.createOrReplaceTempView(view_name)
    return view


def rollback(spark: SparkSession, registry: DataFrame, view_name: str,
             tables: dict | None = None, base_path: str | None = None) -> str | None:
    """Republish the version before the newest one, or drop the view when there is none.

    ``registry`` holds ``view_name, version_number, model_json``; two rows of it reach the driver.
    Returns the version now published.
    """
    newest = (registry.filter(F.col("view_name") == view_name)
              .orderBy(F.desc("version_number")).limit(2)
              .select("version_number", "model_json").collect())
    if len(newest) < 2:
        spark.catalog.dropTempView(view_name)
        return None
    model = SemanticModel.from_json(newest[1]["model_json"])
    publish(model.bind(spark, tables, base_path), view_name)
    return str(newest[1]["version_number"])
