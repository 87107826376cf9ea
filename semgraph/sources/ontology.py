"""Ontology definitions: entity types, relation types and constraints."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Ontology:
    """A declared ontology; driver-side metadata with one table view per part."""
    entities: list[dict] = field(default_factory=list)
    relations: list[dict] = field(default_factory=list)
    constraints: list[dict] = field(default_factory=list)
    hierarchies: list[dict] = field(default_factory=list)
    version: str = "1.0.0"

    @classmethod
    def from_dict(cls, doc: dict) -> "Ontology":
        return cls(list(doc.get("entities") or []), list(doc.get("relations") or []),
                   list(doc.get("constraints") or []), list(doc.get("hierarchies") or []),
                   str(doc.get("version", "1.0.0")))

    def entity(self, name: str) -> dict | None:
        return next((e for e in self.entities if e["name"] == name), None)

    def property_names(self) -> dict[str, list[str]]:
        """Entity type → its property names, in declaration order; the first declaration of a
        type counts."""
        found: dict[str, list[str]] = {}
        for e in self.entities:
            found.setdefault(e["name"], [p["name"] for p in e.get("properties") or []])
        return found

    def allowed(self, relation: dict, end: str) -> list[str]:
        """Entity types allowed at the ``source`` or ``target`` end; ``*`` is every declared one."""
        ends = relation.get(end, "*")
        if ends == "*":
            return [e["name"] for e in self.entities]
        return [ends] if isinstance(ends, str) else list(ends)

    def tables(self, spark: SparkSession, ontology_id: str = "ontology") -> dict[str, DataFrame]:
        """The parts as rows, in the layout the quality operator reads."""
        def ends(value) -> list[str]:
            return [value] if isinstance(value, str) else list(value)

        props = []
        for kind, owners in (("entity", self.entities), ("relation", self.relations)):
            for pos, owner in enumerate(owners):
                props += [(ontology_id, kind, pos, p["name"], p["type"],
                           bool(p.get("required", False)), bool(p.get("indexed", False)))
                          for p in owner.get("properties") or []]
        return {
            "meta": spark.createDataFrame(
                [(ontology_id, self.version, len(self.hierarchies))],
                "ontology_id string, version string, n_hierarchies long"),
            "entities": spark.createDataFrame(
                [(ontology_id, i, e["name"], e.get("description"), e.get("parent"))
                 for i, e in enumerate(self.entities)],
                "ontology_id string, pos long, name string, description string, parent string"),
            "relations": spark.createDataFrame(
                [(ontology_id, i, r["name"], ends(r.get("source", "*")),
                  ends(r.get("target", "*")), bool(r.get("directed", True)))
                 for i, r in enumerate(self.relations)],
                "ontology_id string, pos long, name string, sources array<string>, "
                "targets array<string>, directed boolean"),
            "properties": spark.createDataFrame(
                props, "ontology_id string, owner_kind string, owner_pos long, name string, "
                       "type string, required boolean, indexed boolean"),
            "constraints": spark.createDataFrame(
                [(ontology_id, c["type"], c["entity"], c["property"],
                  None if c.get("min") is None else float(c["min"]),
                  None if c.get("max") is None else float(c["max"]), c.get("pattern"))
                 for c in self.constraints],
                "ontology_id string, type string, entity string, property string, "
                "min double, max double, pattern string"),
        }


def read_ontology(spark: SparkSession, path: str) -> Ontology:
    """Load an ontology from a YAML or JSON file of any file system Spark reaches.

    The file is a definition, read whole on the driver.
    """
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    return Ontology.from_dict(yaml.safe_load(text["value"]) if text else {})
