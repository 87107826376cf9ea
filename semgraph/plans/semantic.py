"""Semantic models and fan-out-safe metric queries over bound tables."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Model types and the Spark types they are read as (fixed values); any other type is a string.
SPARK_TYPES = {
    "string": "string",
    "number": "double",
    "integer": "bigint",
    "decimal": "decimal(38,18)",
    "boolean": "boolean",
    "date": "date",
    "timestamp": "timestamp",
    "time": "string",
}

# How a metric type aggregates a bare column (fixed values).
AGGREGATES = {
    "sum": "SUM({})",
    "count": "COUNT({})",
    "average": "AVG({})",
    "min": "MIN({})",
    "max": "MAX({})",
    "distinct_count": "COUNT(DISTINCT {})",
}


class SemanticError(ValueError):
    """A query that the model cannot answer without guessing."""


@dataclass(frozen=True)
class ModelObject:
    name: str
    identifiers: tuple[str, ...] = ()
    properties: tuple[tuple[str, str], ...] = ()
    table: str | None = None
    description: str | None = None


@dataclass(frozen=True)
class Relationship:
    name: str
    from_object: str
    to_object: str
    join_keys: tuple[tuple[str, str], ...]
    cardinality: str = "many_to_one"

    def walk(self) -> tuple[str, str, tuple[tuple[str, str], ...]] | None:
        """(near, far, keys) in the direction that never multiplies near rows."""
        if self.cardinality == "many_to_many":
            return None
        if self.cardinality == "one_to_many":
            return self.to_object, self.from_object, tuple((b, a) for a, b in self.join_keys)
        return self.from_object, self.to_object, self.join_keys


@dataclass(frozen=True)
class Metric:
    name: str
    expression: str
    grain: tuple[str, ...] = ()
    type: str = "custom"
    format: str | None = None

    @property
    def aggregate(self) -> str:
        """The expression, a bare column wrapped by the metric's type."""
        if re.fullmatch(r"\w+\.\w+", self.expression.strip()):
            return AGGREGATES.get(self.type, "{}").format(self.expression.strip())
        return self.expression

    @property
    def ignores_repeats(self) -> bool:
        """Whether repeated input rows leave the result unchanged."""
        calls = re.findall(r"(\w+)\s*\(\s*(DISTINCT\b)?", self.aggregate, re.IGNORECASE)
        counting = [(n.upper(), d) for n, d in calls
                    if n.upper() in ("SUM", "COUNT", "AVG", "MIN", "MAX")]
        return bool(counting) and all(d or n in ("MIN", "MAX") for n, d in counting)


@dataclass(frozen=True)
class JoinTree:
    """A root object and the relationships joined outward from it, nearest first."""
    root: str
    steps: tuple[tuple[Relationship, str, str], ...] = ()

    @property
    def objects(self) -> tuple[str, ...]:
        return (self.root, *(far for _rel, _near, far in self.steps))


@dataclass(frozen=True)
class SemanticModel:
    """A model definition; driver-side metadata only."""
    name: str
    version: str = "1.0.0"
    objects: dict[str, ModelObject] = field(default_factory=dict)
    relationships: tuple[Relationship, ...] = ()
    metrics: dict[str, Metric] = field(default_factory=dict)
    dimensions: dict[str, str] = field(default_factory=dict)
    table_mappings: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, doc: dict) -> "SemanticModel":
        mapping = doc.get("mapping") or doc.get("snowflake") or {}
        objects = {
            o["name"]: ModelObject(
                o["name"], tuple(sorted(o.get("identifiers", ()))),
                tuple(sorted((p["name"], p["type"]) for p in o.get("properties", ()))),
                (o.get("mapping") or o.get("snowflake") or {}).get("table"),
                o.get("description"))
            for o in doc.get("objects", ())
        }
        rels = tuple(sorted(
            (Relationship(r["name"], r["from"], r["to"],
                          tuple(sorted(tuple(k) for k in r.get("joinKeys", ()))),
                          r.get("cardinality", "many_to_one"))
             for r in doc.get("relationships", ())), key=lambda r: r.name))
        metrics = {
            m["name"]: Metric(m["name"], m["expression"], tuple(sorted(m.get("grain", ()))),
                              m.get("type", "custom"), m.get("format"))
            for m in doc.get("metrics", ())
        }
        dims = {d["name"]: d["sourceProperty"] for d in doc.get("dimensions", ())}
        return cls(doc.get("name") or "semantic_model", doc.get("version", "1.0.0"), objects,
                   rels, metrics, dims, dict(mapping.get("tableMappings", {})))

    @classmethod
    def from_json(cls, text: str) -> "SemanticModel":
        return cls.from_dict(json.loads(text))

    def table_of(self, name: str) -> str:
        """Physical table: the object's own, else the mapping, else the lower-cased name."""
        return self.objects[name].table or self.table_mappings.get(name) or name.lower()

    def bind(self, spark: SparkSession, tables: dict | None = None,
             base_path: str | None = None) -> "BoundModel":
        """Attach tables to the objects.

        ``tables`` maps an object to a DataFrame, a table name or a parquet path; the others come
        from ``base_path/<table>.parquet`` or the catalog.
        """
        def load(name: str) -> DataFrame:
            source = (tables or {}).get(name, self.table_of(name))
            if isinstance(source, DataFrame):
                return source
            if "/" in source:
                return spark.read.parquet(source)
            if base_path:
                return spark.read.parquet(f"{base_path}/{source}.parquet")
            return spark.table(source)
        return BoundModel(self, spark, {name: load(name) for name in self.objects})

    def objects_in(self, text: str) -> set[str]:
        """Objects named as ``Object.property`` in an expression, outside string literals."""
        bare = re.sub(r"'(?:[^']|'')*'", "", text)
        return {n for n in re.findall(r"\b(\w+)\s*\.\s*\w+", bare) if n in self.objects}

    def dimension_source(self, dimension: str) -> str:
        source = self.dimensions.get(dimension, dimension)
        if source.split(".")[0] not in self.objects or source.count(".") != 1:
            raise SemanticError(f"unknown dimension {dimension!r}")
        return source

    def steps_out(self) -> dict[str, list[tuple]]:
        """Joins that keep the rows of the near object, ``(relationship, near, far)`` by near object."""
        steps: dict[str, list[tuple]] = {}
        for rel in self.relationships:
            step = rel.walk()
            if step and step[0] in self.objects and step[1] in self.objects:
                steps.setdefault(step[0], []).append((rel, step[0], step[1]))
        return steps

    def routes_from(self, root: str) -> dict[str, list[tuple]]:
        """Directed routes without repeated objects from ``root`` to each object it reaches: a shortest one, and
        a second one where there is any.

        An object's last step comes from an object that can be reached without it, that is, one it does not
        dominate. With two such steps it has two routes; with one, every route goes through that step, and it
        has a second route just when the object before has one. So cycles need no enumeration of routes.
        """
        steps = self.steps_out()
        first = _shortest(steps, root)
        above = _dominators(steps, root)
        into: dict[str, list[tuple]] = {}
        for step in (s for near in first for s in steps.get(near, ())):
            if step[2] != root and step[2] not in _chain(above, step[1]):
                into.setdefault(step[2], []).append(step)
        found: dict[str, list[tuple]] = {}
        for name, route in first.items():  # nearer objects come first
            found[name] = [route]
            if not route:
                continue
            others = [s for s in into[name] if s is not route[-1]]
            if others:
                found[name].append(_shortest(steps, root, without=name)[others[0][1]] + (others[0],))
            elif len(found[route[-1][1]]) > 1:
                found[name].append(found[route[-1][1]][1] + (route[-1],))
        return found

    def join_tree(self, metric: Metric, others: set[str]) -> JoinTree:
        """The one tree whose root sees every needed object without multiplying metric rows."""
        own = self.objects_in(metric.aggregate)
        if not own:
            raise SemanticError(f"metric {metric.name!r} names no object of the model")
        needed = own | others
        roots = sorted(self.objects) if metric.ignores_repeats else sorted(own)
        reaching = [(root, routes) for root in roots
                    if needed <= (routes := self.routes_from(root)).keys()]
        reaching.sort(key=lambda item: (item[0] not in own, item[0] not in needed))
        if not reaching:
            raise SemanticError(
                f"metric {metric.name!r}: no object reaches {sorted(needed)} without fan-out")
        root, routes = reaching[0]
        steps: list[tuple] = []
        for target in sorted(needed):
            if len(routes[target]) > 1:
                ways = " or ".join("-".join([root, *(far for _r, _n, far in way)]) for way in routes[target])
                raise SemanticError(f"ambiguous join: several routes from {root} to {target}: {ways}")
            steps += [s for s in routes[target][0] if s not in steps]
        return JoinTree(root, tuple(steps))


def _shortest(steps: dict[str, list[tuple]], root: str, without: str | None = None) -> dict[str, tuple]:
    """A shortest route to each object that ``root`` reaches without passing ``without``; nearer ones first."""
    found: dict[str, tuple] = {root: ()}
    frontier = [root]
    for here in frontier:
        for step in steps.get(here, ()):
            if step[2] not in found and step[2] != without:
                found[step[2]] = found[here] + (step,)
                frontier.append(step[2])
    return found


def _dominators(steps: dict[str, list[tuple]], root: str) -> dict[str, str]:
    """Immediate dominator of each reachable object: the last one that all routes to it share. Found by
    iteration in reverse postorder (Cooper, Harvey and Kennedy, 2001)."""
    order, seen, stack = [], {root}, [(root, iter(steps.get(root, ())))]
    while stack:
        here, rest = stack[-1]
        far = next((s[2] for s in rest if s[2] not in seen), None)
        if far is None:
            order.append(here)
            stack.pop()
        else:
            seen.add(far)
            stack.append((far, iter(steps.get(far, ()))))
    rank = {name: i for i, name in enumerate(order)}
    before: dict[str, list[str]] = {}
    for near in order:
        for step in steps.get(near, ()):
            before.setdefault(step[2], []).append(near)
    above = {root: root}
    changed = True
    while changed:
        changed = False
        for name in reversed(order[:-1]):
            known = [n for n in before[name] if n in above]
            best = known[0]
            for other in known[1:]:
                while best != other:
                    if rank[best] < rank[other]:
                        best = above[best]
                    else:
                        other = above[other]
            if above.get(name) != best:
                above[name] = best
                changed = True
    return above


def _chain(above: dict[str, str], name: str) -> set[str]:
    """The dominators of an object, itself included."""
    chain = {name}
    while above[name] != name:
        name = above[name]
        chain.add(name)
    return chain


@dataclass(frozen=True)
class BoundModel:
    """A model together with the DataFrames of its objects."""
    model: SemanticModel
    spark: SparkSession
    frames: dict[str, DataFrame]

    def frame(self, name: str) -> DataFrame:
        return self.frames[name].alias(name)

    def joined(self, tree: JoinTree) -> DataFrame:
        """Root joined outward; ``one_to_one`` is inner, every other cardinality keeps the root
        rows. Sides and algorithm are left to the planner, which knows the sizes."""
        df = self.frame(tree.root)
        for rel, near, far in tree.steps:
            keys = rel.walk()[2]
            on = [F.col(f"{near}.{a}") == F.col(f"{far}.{b}") for a, b in keys]
            df = df.join(self.frame(far), on, "inner" if rel.cardinality == "one_to_one" else "left")
        return df


def format_metric(col: Column, pattern: str) -> Column:
    """Render a number by a pattern such as ``$#,##0.00``: literal prefix and suffix, thousands
    separators, fixed decimals; ``%`` scales by 100."""
    match = re.fullmatch(r"([^#0]*)([#0,]+)(?:\.(0+))?(.*)", pattern)
    if not match:
        return col.cast("string")
    prefix, whole, decimals, suffix = match.groups()
    number = col * 100 if "%" in suffix else col
    text = F.format_number(number, len(decimals or ""))
    if "," not in whole:
        text = F.regexp_replace(text, ",", "")
    return F.concat(F.lit(prefix), text, F.lit(suffix))


def _plan(bound: BoundModel, metrics: list[str], dimensions: list[str], where: str | None,
          at_grain: bool) -> tuple[dict[JoinTree, list[Metric]], dict[str, str]]:
    """Group the metrics by join tree and resolve the output dimensions."""
    model = bound.model
    chosen = []
    for name in metrics:
        if name not in model.metrics:
            raise SemanticError(f"unknown metric {name!r}")
        chosen.append(model.metrics[name])
    dims = {d.split(".")[-1]: model.dimension_source(d) for d in dimensions}
    if at_grain:
        grains = {m.grain for m in chosen}
        if len(grains) != 1:
            raise SemanticError("metrics at their grain must share one grain")
        for name in grains.pop():
            if not model.objects[name].identifiers:
                raise SemanticError(f"object {name!r} has no identifier to group by")
            dims.update({i: f"{name}.{i}" for i in model.objects[name].identifiers})
    others = {s.split(".")[0] for s in dims.values()} | model.objects_in(where or "")
    trees: dict[JoinTree, list[Metric]] = {}
    for metric in chosen:
        trees.setdefault(model.join_tree(metric, others), []).append(metric)
    return trees, dims


def semantic_query(bound: BoundModel, metrics: list[str], dimensions: list[str] = (),
                   where: str | None = None, order_by: str | None = None, desc: bool = True,
                   limit: int | None = None, at_grain: bool = False,
                   formatted: bool = False) -> DataFrame:
    """Metrics grouped by dimensions.

    Every metric is aggregated on its own join tree, so one metric's joins never multiply the rows
    of another; metrics with the same tree share one pass. The aggregates, already one row per
    dimension tuple, are lined up by a union and a second, small grouping, which treats a NULL
    dimension as a group of its own.
    """
    trees, dims = _plan(bound, list(metrics), list(dimensions), where, at_grain)
    keys = [F.col(source).alias(name) for name, source in dims.items()]
    parts = []
    for tree, members in trees.items():
        rows = bound.joined(tree)
        if where:
            rows = rows.filter(F.expr(where))
        parts.append(rows.groupBy(*keys).agg(*[F.expr(m.aggregate).alias(m.name) for m in members]))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    if len(parts) > 1:
        result = result.groupBy(*dims).agg(
            *[F.any_value(m, F.lit(True)).alias(m) for m in metrics])
    result = result.select(*dims, *metrics)
    if order_by:
        first = F.col(order_by).desc() if desc else F.col(order_by).asc()
        result = result.orderBy(first, *[F.col(d).asc() for d in dims])
    if limit is not None:
        result = result.limit(limit)
    if formatted:
        by_name = {m.name: m for ms in trees.values() for m in ms}
        result = result.select(*dims, *[
            (format_metric(F.col(n), by_name[n].format) if by_name[n].format else F.col(n)).alias(n)
            for n in metrics])
    return result


def object_view(bound: BoundModel, name: str) -> DataFrame:
    """The object's descriptive properties, identifiers left out, in their declared types."""
    obj = bound.model.objects[name]
    return bound.frames[name].select(*[
        F.col(prop).cast(SPARK_TYPES.get(kind, "string")).alias(prop)
        for prop, kind in obj.properties if prop not in obj.identifiers])


def describe_query(bound: BoundModel, metrics: list[str], dimensions: list[str] = (),
                   where: str | None = None, order_by: str | None = None,
                   limit: int | None = None, at_grain: bool = False) -> DataFrame:
    """One row per join tree: the objects, relationships and SQL text a query uses."""
    trees, dims = _plan(bound, list(metrics), list(dimensions), where, at_grain)
    rows = []
    for tree, members in trees.items():
        picked = [*dims.values(), *[f"{m.aggregate} AS {m.name}" for m in members]]
        sql = f"SELECT {', '.join(picked)} FROM {tree.root}"
        for rel, near, far in tree.steps:
            on = " AND ".join(f"{near}.{a} = {far}.{b}" for a, b in rel.walk()[2])
            how = "INNER" if rel.cardinality == "one_to_one" else "LEFT"
            sql += f" {how} JOIN {far} ON {on}"
        if where:
            sql += f" WHERE {where}"
        if dims:
            sql += f" GROUP BY {', '.join(dims.values())}"
        if order_by:
            sql += f" ORDER BY {order_by} DESC"
        if limit is not None:
            sql += f" LIMIT {limit}"
        rows.append(([m.name for m in members], list(tree.objects),
                     [r.name for r, _n, _f in tree.steps], sql))
    return bound.spark.createDataFrame(
        rows, "metrics array<string>, tables array<string>, relationships array<string>, sql string")


def with_tables(model: SemanticModel, mappings: dict[str, str]) -> SemanticModel:
    """The same model over other physical tables."""
    return replace(model, table_mappings={**model.table_mappings, **mappings})
