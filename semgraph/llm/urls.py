"""URL rules with DataFrame functions only.

A rule is a host and the start of a path. Each URL is expanded into its host suffixes and the leading
directories of its path; the expressions meet the rules on the first 32 bits of their SHA-256 and count
only if the whole digest is the same and the path starts with the rule's. The order of precedence is one
number, so the best rule of a URL is a plain maximum, combined in the map tasks; the rule's text is read
off the URL again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semgraph.llm.common import LOWER, UPPER, Queries, ascii_lower, free_name, table
from semgraph.session import materialize

QUERIES = Queries()

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow"))


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(after_scheme(url), "^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _slashes(path: Column) -> Column:
    return F.char_length(path) - F.char_length(F.replace(path, F.lit("/"), F.lit("")))


def _directory(path: Column, depth: Column) -> Column:
    """The path up to its slash number ``depth``, included; empty for 0."""
    return F.when(depth == 0, "").otherwise(F.concat(F.call_function("substring_index", path, F.lit("/"), depth.cast("int")), F.lit("/")))


def best_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, best`` of the URLs that a rule fits; ``best`` orders by length of rule, length of its
    host, block before allow, and holds the three."""
    known = rules.filter("host <> '' AND path IS NOT NULL").select(
        ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict").distinct()
    known = known.withColumn("digest", F.sha2(F.concat("rule_host", _directory(F.col("rule_path"), _slashes(F.col("rule_path")))), 256))
    known = known.withColumn("short", F.substring("digest", 1, 8)).withColumn(
        "best", F.expr("shiftleft(CAST(char_length(rule_host) + char_length(rule_path) AS BIGINT), 32)"
                       " + 2 * char_length(rule_host) + IF(verdict = 'block', 1, 0)"))
    # no rule has more labels or directories, so longer expressions meet none
    most = known.agg(F.max(F.size(F.split("rule_host", "\\."))).alias("labels"), F.max(_slashes(F.col("rule_path"))).alias("slashes")).first()
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).filter("host <> ''")
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most.labels or 1))),
                           lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    depths = F.sequence(F.lit(0), F.least(_slashes(F.col("path")), F.lit(most.slashes or 0)))
    expanded = (parts.withColumn("suffix", F.explode(suffixes)).withColumn("depth", F.explode(depths))
                .select("url", "path", F.sha2(F.concat("suffix", _directory(F.col("path"), F.col("depth"))), 256).alias("full")))
    met = expanded.withColumn("short", F.substring("full", 1, 8)).join(known, "short")
    fitting = met.filter((F.col("full") == F.col("digest")) & F.startswith(F.col("path"), F.col("rule_path")))
    return fitting.groupBy("url").agg(F.max("best").alias("best"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` appended.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains if the URL's path starts
    with its path; the longest rule wins, then the longer host, then ``block``. ``rule`` is host and
    path of the winner, else null, and the verdict ``default``. A null URL or one without ``://``
    has empty host and path and no rule. Equal URLs get equal verdicts; every row stays. Columns
    with the new names keep them, and the new ones get underscores in front.
    """
    taken = pages.columns
    host, path, rule, verdict, best, key = (free_name(taken, n) for n in ("host", "path", "rule", "verdict", "best", "best_url"))
    # stored, so that the join reads plain shuffles, of which adaptive execution splits hot URLs
    found = materialize(best_rules(pages.select("url").filter("url IS NOT NULL"), rules)).toDF(key, best)
    met = pages.join(found, F.col("url") == F.col(key), "left")
    whole, own = F.shiftright(best, 32).cast("int"), F.expr(f"CAST((`{best}` & 4294967295) DIV 2 AS INT)")
    return met.withColumn(host, host_of(F.col("url"))).withColumn(path, path_of(F.col("url"))).select(
        *[F.col(f"`{c}`") for c in taken], host, path,
        F.when(F.col(best).isNotNull(), F.concat(F.right(F.col(host), own), F.left(F.col(path), whole - own))).alias(rule),
        F.when(F.col(best).isNull(), default).when(F.col(best) % 2 == 1, "block").otherwise("allow").alias(verdict))


@QUERIES.add("op6_url_filter", f"""
    WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
                 FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    rules(rh, rp, rv) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
    ranked AS (SELECT p.*, rh || rp AS rule, rv,
                      row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS k
               FROM parts p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
    SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM ranked WHERE k = 1""")
def op6(spark, sf):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict")
