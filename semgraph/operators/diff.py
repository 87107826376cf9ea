"""Difference between model versions, for many models at once.

All five element kinds share one row layout and both sides are stacked, so a single grouping lines
up old and new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semgraph.sources.models import Registry

# Strictness of a cardinality; unknown ones count as 0 (fixed values).
CARDINALITY_RANK = {"many_to_many": 0, "many_to_one": 1, "one_to_many": 1, "one_to_one": 2}

CHANGE = ["category", "change_type", "element_name", "old_value", "new_value"]


SLOT = ["kind", "owner", "name"]


def elements(reg: Registry, keys: list[str] = ("model_id",)) -> DataFrame:
    """``keys, kind, owner, name, ord`` and ``_e`` with description, text and items: the parts a
    diff looks at."""
    none, no_items = F.lit(None).cast("string"), F.lit(None).cast("array<string>")

    def rows(df: DataFrame, kind: str, owner: Column, text: Column, items: Column) -> DataFrame:
        return df.select(*keys, F.lit(kind).alias("kind"), owner.alias("owner"), "name",
                         "ord", F.struct("description", text.alias("text"),
                                         F.sort_array(items).alias("items")).alias("_e"))

    pairs = F.array_distinct(F.transform("join_keys", lambda k: F.concat(
        k["from_key"], F.lit("="), k["to_key"])))
    parts = [
        rows(reg.objects, "object", F.lit(""), none, F.array_distinct("identifiers")),
        rows(reg.properties, "property", F.col("object"), F.col("type"), no_items),
        rows(reg.relationships, "relationship", F.lit(""), F.col("cardinality"), pairs),
        rows(reg.metrics, "metric", F.lit(""), F.col("expression"), F.array_distinct("grain")),
        rows(reg.dimensions, "dimension", F.lit(""), F.col("source_property"), no_items),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _shown(items: Column) -> Column:
    return F.array_join(items, ",")


def diff_models(old: Registry, new: Registry) -> DataFrame:
    """Changes per model: ``model_id, category, change_type, element_name, old_value, new_value``.

    Properties are compared only where their object exists on both sides.
    """
    return diff_elements(elements(old), elements(new), ["model_id"])


def changes_by_kind(old: Registry, new: Registry) -> DataFrame:
    """``diff_models`` with the ``kind`` of element in front; a filter on it reaches the element tables."""
    sides = elements(old).withColumn("_old", F.lit(True)).unionByName(elements(new).withColumn("_old", F.lit(False)))
    return diff_stacked(sides, ["model_id"], apart=True)


def diff_elements(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Changes between two sets of elements per ``keys``. Of elements with one name the last in
    order counts."""
    stacked = old.withColumn("_old", F.lit(True)).unionByName(new.withColumn("_old", F.lit(False)))
    return diff_stacked(stacked, keys).drop("kind")


def diff_stacked(stacked: DataFrame, keys: list[str], apart: bool = False) -> DataFrame:
    """``keys, kind`` and the change, of elements marked ``_old`` or not. Only grouped by keys and parts of the
    slot, so elements that lie together by key stay where they are. They are sorted once: the grouping begins with
    the object, so that the window over objects finds its rows in order, and with a number, so that few texts are
    compared. With ``apart`` properties, which need their objects, are compared apart from the others, so that a
    filter on ``kind`` reaches the element tables."""
    kind = F.col("kind")
    of_object = kind.isin("object", "property")
    group = ["_place", *keys, "_of_object", "_object"]
    marked = stacked.withColumn("_of_object", of_object).withColumn(
        "_object", F.when(kind == "object", F.col("name")).when(of_object, F.col("owner")))
    both = marked.withColumn("_place", F.xxhash64(*group[1:])).groupBy(*group, *SLOT).agg(
        F.max_by("_e", F.when(F.col("_old"), F.col("ord"))).alias("o"),
        F.max_by("_e", F.when(~F.col("_old"), F.col("ord"))).alias("n"))
    label = F.when(kind == "property", F.concat_ws(".", "owner", "name")).otherwise(F.col("name"))
    none = F.lit(None).cast("string")
    present = F.col("o").isNotNull() & F.col("n").isNotNull()

    def change(category: Column, breaking: Column, old_value: Column, new_value: Column) -> Column:
        return F.struct(
            category.alias("category"), F.when(breaking, "breaking").otherwise("non_breaking").alias("change_type"),
            label.alias("element_name"), old_value.alias("old_value"), new_value.alias("new_value"))

    gone, come = F.col("n").isNull(), F.col("o").isNull()
    o_items, n_items = F.col("o.items"), F.col("n.items")
    items_differ = present & ~o_items.eqNullSafe(n_items)
    text_differs = present & ~F.col("o.text").eqNullSafe(F.col("n.text"))
    described = present & ~F.col("o.description").eqNullSafe(F.col("n.description"))
    removed, added = F.array_except(o_items, n_items), F.array_except(n_items, o_items)
    shared = F.size(F.array_intersect(o_items, n_items)) > 0
    rank = F.create_map(*[F.lit(x) for pair in CARDINALITY_RANK.items() for x in pair])
    stricter = (F.coalesce(F.element_at(rank, F.col("n.text")), F.lit(0))
                - F.coalesce(F.element_at(rank, F.col("o.text")), F.lit(0)))
    is_object, is_rel = kind == "object", kind == "relationship"
    relaxed = is_rel & (stricter < 0)

    # changes that exclude each other share a place, without a category where there is none. Few and without a lambda:
    # Java does not compile long methods
    changes = [
        change(F.concat(kind, F.when(come, "_added").when(described, "_description_changed")), F.lit(False),
               F.col("o.description"), F.when(come, F.col("name")).otherwise(F.col("n.description"))),
        change(F.when(gone, F.concat(kind, F.lit("_removed"))), F.lit(True), F.col("name"), none),
        change(F.when(text_differs, F.when(kind == "property", "property_type_changed").when(kind == "metric", "metric_expression_changed")
                      .when(kind == "dimension", "dimension_removed").when(is_rel & (stricter > 0), "relationship_cardinality_tightened")
                      .when(relaxed, "relationship_cardinality_relaxed")), ~relaxed, F.col("o.text"), F.col("n.text")),
        change(F.when(items_differ, F.when(is_object & (F.size(removed) > 0), "identifier_removed").when(is_rel, "relationship_join_keys_changed")
                      .when(kind == "metric", "metric_grain_changed")), F.lit(True),
               _shown(F.when(is_object, removed).otherwise(o_items)), F.when(~is_object, _shown(n_items))),
        change(F.when(items_differ & is_object & (F.size(added) > 0), F.when(shared, "identifier_added").otherwise("identifier_changed")), ~shared,
               F.when(~shared, _shown(o_items)), _shown(F.when(shared, added).otherwise(n_items))),
    ]
    listed = F.inline(F.array(*changes))
    differs = ~present | ~F.col("o").eqNullSafe(F.col("n"))
    on = Window.partitionBy(*group)
    whole = F.lit(True)
    for column in (*keys, "owner"):
        whole = whole & F.col(column).isNotNull()

    def kept(df: DataFrame) -> DataFrame:
        """Changed elements, properties only of objects on both sides."""
        held = df.filter(is_object | differs).withColumn("_kept", F.max(is_object & present).over(on))
        return held.filter((kind != "property") | (F.col("_kept") & whole)).filter(differs)

    def told(df: DataFrame) -> DataFrame:
        return df.select(*keys, "kind", listed).filter("category IS NOT NULL")

    if apart:
        rest = told(both.filter("kind <> 'property'").filter(differs))
        of_kept = told(kept(both.filter(of_object)).filter("kind = 'property'"))
        return rest.unionByName(of_kept).select(*keys, "kind", *CHANGE)
    return told(kept(both)).select(*keys, "kind", *CHANGE)


def diff_summary(changes: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Breaking, non-breaking and total changes per model; with ``models`` also those without."""
    counts = changes.groupBy("model_id").agg(
        F.count_if(F.col("change_type") == "breaking").alias("total_breaking"),
        F.count_if(F.col("change_type") == "non_breaking").alias("total_non_breaking"),
        F.count("*").alias("total_changes"))
    if models is None:
        return counts
    everyone = models.select("model_id").distinct().join(counts, "model_id", "left")
    return everyone.select("model_id", *[
        F.coalesce(c, F.lit(0)).alias(c)
        for c in ("total_breaking", "total_non_breaking", "total_changes")])
