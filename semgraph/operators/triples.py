"""The graph as subject / predicate / object triples, and conjunctive patterns over them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.session import BLOCK, unsorted_writes

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
BASE_URI = "urn:semgraph"
COLUMNS = ["graph", "s", "p", "o"]
Pattern = tuple[str, str, str]


def _encode(col: Column) -> Column:
    """Percent-encode every byte outside the unreserved set, spaces as ``%20``."""
    encoded = F.url_encode(col)
    for mark, text in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(mark), F.lit(text))
    return encoded


def entity_uri(col: Column, base: str = BASE_URI) -> Column:
    return F.concat(F.lit(f"{base}/entity/"), _encode(col))


def to_triples(entities: DataFrame, relations: DataFrame, base: str = BASE_URI) -> DataFrame:
    """Type, id, workspace and property triples of each entity; the edge, its workspace record and
    its property triples of each relation. Each table is scanned once, each subject is encoded once."""
    def pair(key: Column, value: Column) -> Column:
        return F.struct(key.alias("key"), value.alias("value"))

    def prop(name: str) -> Column:
        return F.lit(f"{base}/property/{name}")

    def pairs(*fixed: Column) -> Column:
        return F.posexplode(F.concat(F.array(*fixed), F.map_entries("props"))).alias("_at", "_pair")

    graph = F.concat(F.lit(f"{base}/graph/workspace/"), F.col("workspace_id")).alias("graph")
    at, key, value = F.col("_at"), F.col("_pair.key"), F.col("_pair.value").alias("o")

    own = entities.select("id", "type", "workspace_id", "props", graph, entity_uri(F.col("id"), base).alias("s"),
                          F.concat(F.lit(f"{base}/type/"), _encode(F.col("type"))).alias("_kind"))
    own = own.select("graph", "s", pairs(
        pair(F.lit(RDF_TYPE), F.col("_kind")), pair(prop("id"), F.col("id")), pair(prop("type"), F.col("type")),
        pair(prop("workspace_id"), F.col("workspace_id"))))
    of_entities = own.select(
        "graph", "s", F.when(at < 4, key).otherwise(F.concat(F.lit(f"{base}/property/"), _encode(key))).alias("p"), value)

    edges = relations.select(
        "type", "workspace_id", "props", graph, *[entity_uri(F.col(f"{end}_id"), base).alias(f"_{end}") for end in ("source", "target")],
        F.concat(F.lit(f"{base}/relation/"), _encode(F.col("type"))).alias("_kind"),
        F.concat(F.lit(f"{base}/relation/"), _encode(F.concat_ws("_", "source_id", "target_id", "type"))).alias("_record"))
    edges = edges.select("graph", "_source", "_kind", "_record", pairs(
        pair(F.col("_kind"), F.col("_target")), pair(prop("workspace_id"), F.col("workspace_id")), pair(prop("type"), F.col("type"))))
    of_relations = edges.select(
        "graph", F.when(at.isin(1, 2), F.col("_record")).otherwise(F.col("_source")).alias("s"),
        F.when(at < 3, key).otherwise(F.concat(F.col("_kind"), F.lit("/"), _encode(key))).alias("p"), value)
    return of_entities.unionByName(of_relations)


def triple_stats(triples: DataFrame) -> DataFrame:
    """Distinct subjects and triples per named graph. Rows are shuffled by subject before they are grouped, as a task
    meets few subjects twice, so that grouping first would hold nearly all of its rows."""
    return triples.select("graph", "s").repartition("graph", "s").groupBy("graph").agg(
        F.count_distinct("s").alias("nodes"), F.count("*").alias("edges"))


def write_triples(triples: DataFrame, path: str) -> None:
    """Store the triples in a folder per graph and predicate, so that a pattern reads its predicate only, and
    beside them how many rows, subjects and objects each predicate has. Counts of subjects and objects
    are approximate; they choose an order, not a result."""
    path = path.rstrip("/")
    with unsorted_writes(triples.sparkSession):
        triples.select(*COLUMNS).write.option("parquet.block.size", BLOCK).partitionBy("graph", "p").parquet(f"{path}/triples")
    of_predicate = read_triples(triples.sparkSession, path)[0].groupBy("graph", "p").agg(
        F.count("*").alias("n"), F.approx_count_distinct("s").alias("subjects"),
        F.approx_count_distinct("o").alias("objects"))
    of_predicate.write.parquet(f"{path}/counts")


def read_triples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """Triples and their counts, for ``match_triples``; no counts while they are not written."""
    path = path.rstrip("/")
    triples = spark.read.schema(", ".join(f"{c} string" for c in COLUMNS)).parquet(f"{path}/triples")
    try:
        counts = spark.read.parquet(f"{path}/counts")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        counts = None
    return triples.select(*COLUMNS), counts


def _is_variable(term: str) -> bool:
    return term.startswith("?")


def _variables(pattern: Pattern) -> set[str]:
    return {term[1:] for term in pattern if _is_variable(term)}


def join_order(patterns: list[Pattern], sizes: dict[str | None, tuple[int, int, int]] | None = None) -> list[Pattern]:
    """The patterns in the order in which they join, each sharing a variable with those before.

    ``sizes`` has rows, subjects and objects by predicate, and of all under None. The pattern with the fewest
    expected rows comes first, then always the one with the fewest rows for what is bound by then, so a pattern
    that only closes a cycle comes as soon as both its ends are there. Ties, and all without
    ``sizes``, go in the order written.
    """
    def expected(pattern: Pattern, bound: set[str]) -> float:
        if sizes is None:
            return 0
        s, p, o = pattern
        n, subjects, objects = sizes.get(None if _is_variable(p) else p, (0, 1, 1))
        for term, distinct in ((s, subjects), (o, objects)):
            if not _is_variable(term) or term[1:] in bound:
                n /= max(distinct, 1)
        return n

    waiting, ordered, bound = list(patterns), [], set()
    while waiting:
        reachable = [p for p in waiting if not ordered or _variables(p) & bound]
        if not reachable:
            raise ValueError("every pattern must share a variable with another one")
        ordered.append(min(reachable, key=lambda p: expected(p, bound)))
        waiting.remove(ordered[-1])
        bound |= _variables(ordered[-1])
    return ordered


def _sizes(counts: DataFrame, patterns: list[Pattern], graph: str | None) -> dict[str | None, tuple[int, int, int]]:
    """Counts of the predicates in the patterns, one row each, and of all predicates together."""
    if graph is not None:
        counts = counts.filter(F.col("graph") == graph)
    named = sorted({p for _, p, _ in patterns if not _is_variable(p)})
    per = F.when(F.col("p").isin(named), F.col("p"))
    rows = counts.groupBy(per.alias("p")).agg(*[F.sum(c).alias(c) for c in ("n", "subjects", "objects")]).collect()
    sizes = {r["p"]: (r["n"], r["subjects"], r["objects"]) for r in rows}
    # a subject has several predicates: the largest number of one predicate is a lower bound for all
    sizes[None] = (sum(v[0] for v in sizes.values()), *(max((v[i] for v in sizes.values()), default=1) for i in (1, 2)))
    return sizes


def match_triples(triples: DataFrame, patterns: list[Pattern], select: list[str], limit: int | None = None,
                  graph: str | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Conjunctive pattern match: terms starting with ``?`` are variables, others constants.

    Each pattern is a filtered scan of the triples; patterns join on all shared variables within a named
    graph, so the constants reach the scan and no pattern joins without a key. With ``counts`` (of
    ``read_triples``) the patterns join in the order of ``join_order``, whatever order they are written in.
    """
    if graph is not None:
        triples = triples.filter(F.col("graph") == graph)

    def scan(pattern: Pattern) -> DataFrame:
        rows, names = triples, {}
        for column, term in zip(("s", "p", "o"), pattern, strict=True):
            if not _is_variable(term):
                rows = rows.filter(F.col(column) == term)
            elif term[1:] in names:
                rows = rows.filter(F.col(column) == F.col(names[term[1:]]))
            else:
                names[term[1:]] = column
        return rows.select("graph", *[F.col(c).alias(v) for v, c in names.items()])

    ordered = join_order(patterns, None if counts is None else _sizes(counts, patterns, graph))
    result, bound = scan(ordered[0]), _variables(ordered[0])
    for pattern in ordered[1:]:
        result = result.join(scan(pattern), ["graph", *sorted(_variables(pattern) & bound)])
        bound |= _variables(pattern)
    result = result.select("graph", *select).distinct()
    return result if limit is None else result.orderBy("graph", *select).limit(limit)


def triple_neighbors(triples: DataFrame, base: str = BASE_URI) -> DataFrame:
    """Both directions of every edge triple as one set: the pattern ``{?x ?p ?y} UNION {?y ?p ?x}``."""
    edges = triples.filter(F.col("p").startswith(f"{base}/relation/")
                           & F.col("o").startswith(f"{base}/entity/"))
    out = edges.select("graph", F.col("s").alias("node"), F.col("o").alias("neighbor"), "p",
                       F.lit("out").alias("direction"))
    back = edges.select("graph", F.col("o").alias("node"), F.col("s").alias("neighbor"), "p",
                        F.lit("in").alias("direction"))
    return out.unionByName(back)
