"""Regression scoring, usage analytics and the streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import Catalog, read
from semgraph.functions.values import map_fingerprint, map_of
from semgraph.operators.regression import evaluate_answers, regression_summary
from semgraph.operators.usage import (label_cache_hits, miss_instants, request_cost, request_key,
                                      route_model, usage_stats)
from semgraph.session import materialize, scratch_dir
from semgraph.streaming.cache_hits import stream_label_cache_hits
from semgraph.streaming.dedupe import first_entities, stream_dedupe_entities

CATALOG = Catalog()

# ---- regression -------------------------------------------------------------------------------


def expectations(spark, sf):
    """A question per market segment."""
    return read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("question")).agg(
        F.array(F.lit("Order"), F.lit("Customer")).alias("expected_tables"),
        F.array(F.lit("sum"), F.concat(F.lit("status = "), F.min(F.substring("c_mktsegment", 1, 1)))).alias(
            "expected_sql_patterns"),
        F.lower(F.min(F.substring("c_mktsegment", 1, 4))).alias("expected_answer_snippet"))


def answers(spark, sf):
    """An answer per order to its customer's segment question."""
    orders, customers = read(spark, sf, "orders"), read(spark, sf, "customer")
    paired = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return paired.select(
        F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("answer_id"),
        F.col("c_mktsegment").alias("question"), (F.col("o_orderstatus") != "P").alias("success"),
        F.when(F.col("o_totalprice") > 400000, F.lit("timeout")).alias("error"),
        F.when(F.col("o_totalprice") > 50000, F.concat(
            F.lit("SELECT SUM(x) WHERE STATUS = "), F.substring("c_name", 18, 1),
            F.substring("c_mktsegment", 1, 1))).alias("sql"),
        F.when(F.col("o_totalprice") < 300000, F.concat(
            F.lit("The segment "), F.when(F.col("c_nationkey") > 5, F.col("c_mktsegment")).otherwise(
                F.lit("unknown")))).alias("answer"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("Order"), F.lit("Customer"))).otherwise(
            F.array(F.lit("Order"))).alias("tables"),
        F.col("o_totalprice").alias("latency_ms"))


SCORED = """WITH a AS (SELECT *, substr(c_mktsegment, 1, 1) AS letter,
      CASE WHEN o_totalprice > 50000 THEN 'SELECT SUM(x) WHERE STATUS = ' || substr(c_name, 18, 1)
           || substr(c_mktsegment, 1, 1) END AS sql,
      CASE WHEN o_totalprice < 300000 THEN 'The segment ' || CASE WHEN c_nationkey > 5 THEN c_mktsegment
           ELSE 'unknown' END END AS answer
    FROM orders JOIN customer ON o_custkey = c_custkey),
  s AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'API call failed: ' ||
        CASE WHEN o_totalprice > 400000 THEN 'timeout' ELSE 'Unknown error' END
      ELSE NULLIF(concat_ws('; ',
        CASE WHEN o_orderstatus <> 'F' THEN 'Missing expected tables: Customer' END,
        CASE WHEN sql IS NOT NULL AND NOT contains(upper(sql), upper('status = ' || letter))
             THEN 'Missing SQL patterns: status = ' || letter END,
        CASE WHEN answer IS NOT NULL AND NOT contains(lower(answer), lower(substr(c_mktsegment, 1, 4)))
             THEN 'Answer snippet not found: ''' || lower(substr(c_mktsegment, 1, 4)) || '''' END), '')
      END AS reason FROM a)"""


@CATALOG.add("regression_answers", f"""{SCORED}
    SELECT o_orderkey AS answer_id, reason IS NULL AS passed, reason AS failure_reason FROM s""")
def scored(spark, sf):
    return evaluate_answers(expectations(spark, sf), answers(spark, sf)).select(
        "answer_id", "passed", "failure_reason")


@CATALOG.add("regression_summary", f"""{SCORED},
    asked AS (SELECT o_orderpriority, seg FROM (SELECT DISTINCT o_orderpriority FROM orders)
              CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer)),
    gaps AS (SELECT o_orderpriority, COUNT(*) AS n FROM asked
             WHERE substr(seg, 1, 1) = substr('FHABM', CAST(substr(o_orderpriority, 1, 1) AS INT), 1) GROUP BY 1)
    SELECT o_orderpriority AS run, COUNT(*) + MAX(coalesce(n, 0)) AS total_questions,
      COUNT(*) FILTER (reason IS NULL) AS passed, COUNT(*) FILTER (reason IS NOT NULL) + MAX(coalesce(n, 0)) AS failed,
      bool_and(reason IS NULL) AND MAX(coalesce(n, 0)) = 0 AS overall_pass,
      ROUND(SUM(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice ELSE 0 END), 2) AS total_latency_ms
    FROM s LEFT JOIN gaps USING (o_orderpriority)
    WHERE substr(c_mktsegment, 1, 1) <> substr('FHABM', CAST(substr(o_orderpriority, 1, 1) AS INT), 1)
    GROUP BY 1""")
def runs(spark, sf):
    """Every run leaves the questions of one segment out; they count as failed."""
    left_out = F.substring(F.lit("FHABM"), F.substring("run", 1, 1).cast("int"), F.lit(1))
    given = answers(spark, sf).filter(F.substring("question", 1, 1) != left_out)
    results = evaluate_answers(expectations(spark, sf), given, run=["run"])
    return regression_summary(results, ["run"]).withColumn(
        "total_latency_ms", F.round("total_latency_ms", 2))


# ---- usage ------------------------------------------------------------------------------------

def request_log(spark, sf):
    """Turns as model calls: the role picks the model, the text is the prompt."""
    turns = read(spark, sf, "conversations")
    model = (F.when(F.col("role") == "user", "gpt-4o").when(F.col("role") == "system", "gpt-4")
             .otherwise("local-model"))
    return turns.select(
        "conv_id", "turn", model.alias("model"), F.col("role").alias("system"),
        F.col("text").alias("prompt"), F.length("text").alias("input_tokens"),
        F.floor(F.length("text") / 4).alias("output_tokens"))


@CATALOG.add("usage_request_keys", """
    SELECT conv_id, turn, sha256(CASE role WHEN 'user' THEN 'gpt-4o' WHEN 'system' THEN 'gpt-4'
      ELSE 'local-model' END || ':' || role || ':' || text) AS request_key FROM conversations""")
def keys(spark, sf):
    log = request_log(spark, sf)
    return log.select("conv_id", "turn", request_key(
        F.col("model"), F.col("system"), F.col("prompt")).alias("request_key"))


COST = """(length(text) / 1e6 * CASE role WHEN 'user' THEN 5.0 WHEN 'system' THEN 30.0 ELSE 0.5 END
    + (length(text) // 4) / 1e6 * CASE role WHEN 'user' THEN 15.0 WHEN 'system' THEN 60.0 ELSE 1.5 END)"""


@CATALOG.add("usage_request_cost", f"""
    SELECT conv_id, turn, ROUND({COST}::DOUBLE, 9) AS cost FROM conversations""")
def costs(spark, sf):
    return request_cost(request_log(spark, sf)).select("conv_id", "turn", F.round("cost", 9).alias("cost"))


@CATALOG.add("usage_stats", f"""
    SELECT CASE role WHEN 'user' THEN 'gpt-4o' WHEN 'system' THEN 'gpt-4' ELSE 'local-model' END AS model,
      COUNT(*) AS total_requests, COUNT(*) FILTER (turn > 3) AS cached_requests,
      COALESCE(CAST(SUM(length(text)) FILTER (turn <= 3) AS BIGINT), 0) AS total_tokens_input,
      COALESCE(CAST(SUM(length(text) // 4) FILTER (turn <= 3) AS BIGINT), 0) AS total_tokens_output,
      ROUND(COALESCE(SUM({COST}) FILTER (turn <= 3), 0)::DOUBLE, 7) AS total_cost,
      ROUND(COUNT(*) FILTER (turn > 3) / COUNT(*), 6) AS cache_hit_rate,
      ROUND(COUNT(*) FILTER (turn > 3) * 0.01::DOUBLE, 2) AS estimated_savings
    FROM conversations GROUP BY ROLLUP (1)""")
def usage(spark, sf):
    log = request_cost(request_log(spark, sf)).withColumn("cached", F.col("turn") > 3)
    stats = usage_stats(log).drop("is_total")
    for name, digits in (("total_cost", 7), ("cache_hit_rate", 6), ("estimated_savings", 2)):
        stats = stats.withColumn(name, F.round(name, digits))
    return stats


@CATALOG.add("usage_routed_models", """
    SELECT conv_id, turn, CASE WHEN length(text) < 100 THEN 'gpt-4o-mini' WHEN length(text) < 400
      THEN 'gpt-3.5-turbo' ELSE 'gpt-4o' END AS cheap, CASE WHEN length(text) < 100 THEN 'gpt-3.5-turbo'
      WHEN length(text) < 400 THEN 'gpt-4o' ELSE 'gpt-4-turbo' END AS best FROM conversations""")
def routed(spark, sf):
    size = F.length("text")
    level = F.when(size < 100, "simple").when(size < 400, "medium").otherwise("complex")
    return read(spark, sf, "conversations").select(
        "conv_id", "turn", route_model(level).alias("cheap"),
        route_model(level, prefer_cheap=False).alias("best"))


def call_log(spark, sf):
    """Events as calls whose prompt is the event type: five keys share the whole log."""
    return read(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), F.col("event_type").alias("request_key"), "ts")


FILLS = """fills AS (
    SELECT event_type, MIN(ts) AS ts FROM events GROUP BY 1
    UNION ALL SELECT f.event_type, (SELECT MIN(e.ts) FROM events e WHERE e.event_type = f.event_type
      AND e.ts >= f.ts + INTERVAL 3600 SECOND) FROM fills f WHERE f.ts IS NOT NULL)"""


@CATALOG.add("usage_cache_fills", f"""
    WITH RECURSIVE {FILLS} SELECT event_type AS request_key, ts FROM fills WHERE ts IS NOT NULL""")
def fills(spark, sf):
    return miss_instants(call_log(spark, sf))


@CATALOG.add("usage_cache_hits", f"""
    WITH RECURSIVE {FILLS} SELECT event_id AS request_id, (event_type, ts) NOT IN
      (SELECT (event_type, ts) FROM fills WHERE ts IS NOT NULL) AS cached FROM events""")
def hits(spark, sf):
    return label_cache_hits(call_log(spark, sf)).select("request_id", "cached")


# ---- streams ----------------------------------------------------------------------------------

def drain(stream, spark, name, mode="append"):
    """Run a stream over what is there now into the scratch folder and read the result."""
    out = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = (stream.writeStream.outputMode(mode).trigger(availableNow=True)
             .option("checkpointLocation", f"{out}/state").format("parquet").start(f"{out}/rows"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def stream(spark, sf, table):
    """A table as a stream, be it one file or a folder of parts; a pattern, as a plain path of a stream
    must be a folder."""
    return spark.readStream.schema(read(spark, sf, table).schema).parquet(f"{sf.rstrip('/')}/{table}.parque[t]")


@CATALOG.add("stream_deduped_documents", """
    SELECT COUNT(DISTINCT trim(lower(text), chr(9)||chr(10)||chr(13)||' '||chr(160))) AS n,
           COUNT(DISTINCT trim(lower(text), chr(9)||chr(10)||chr(13)||' '||chr(160))) AS fingerprints
    FROM documents""")
def streamed_documents(spark, sf):
    docs = stream(spark, sf, "documents")
    entities = docs.select(
        F.lit("docs").alias("workspace_id"), F.col("doc_id").cast("string").alias("id"),
        F.lit("Document").alias("type"), map_of({"text": F.col("text")}).alias("props"))
    kept = drain(stream_dedupe_entities(entities), spark, "dedupe")
    return kept.agg(F.count("*").alias("n"),
                    F.count_distinct(map_fingerprint(F.col("props"))).alias("fingerprints"))


@CATALOG.add("stream_first_entities", """
    WITH marked AS (SELECT *, CASE WHEN ts - LAG(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens
                    FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts)),
         runs AS (SELECT *, SUM(opens) OVER (PARTITION BY event_type, user_id ORDER BY ts) AS run FROM marked)
    SELECT CAST(MIN(event_id) AS VARCHAR) AS id, COUNT(*) AS n_copies, epoch_us(MAX(ts)) AS last_us FROM runs
    GROUP BY event_type, user_id, run""")
def streamed_first(spark, sf):
    """Events of one type and user within two hours of each other are copies; they arrive up to five hours late, in
    five micro-batches, and a last event a day on moves the watermark past them all."""
    folder = f"{scratch_dir(spark)}/entities-{uuid.uuid4().hex}"
    events = read(spark, sf, "events").select(
        F.lit("events").alias("workspace_id"), F.col("event_id").cast("string").alias("id"), F.lit("Event").alias("type"),
        map_of({"event_type": F.col("event_type"), "user_id": F.col("user_id").cast("string")}).alias("props"),
        F.col("event_id").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    late = events.withColumn("arrival", F.unix_seconds("ts") + F.pmod(F.hash("seq"), F.lit(18_000)))
    first, last = late.agg(F.min("arrival")).scalar(), late.agg(F.max("arrival")).scalar()
    waves = materialize(late.withColumn("wave", F.floor((F.col("arrival") - first) * 5 / (last - first + 1))))
    for wave in range(5):
        waves.filter(F.col("wave") == wave).select(events.columns).coalesce(1).write.mode("append").parquet(folder)
    events.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(
        F.lit("closing").alias("workspace_id"), F.lit("").alias("id"), F.lit("").alias("type"), map_of({}).alias("props"),
        F.lit(-1).cast("long").alias("seq"), "ts").write.mode("append").parquet(folder)
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    kept = drain(first_entities(arriving, gap="2 hours", delay="6 hours", order=("seq",)), spark, "first")
    return kept.select("id", "n_copies", F.unix_micros("last_ts").alias("last_us"))


@CATALOG.add("stream_cache_hits", f"""
    WITH RECURSIVE {FILLS} SELECT event_id AS request_id, (event_type, ts) NOT IN
      (SELECT (event_type, ts) FROM fills WHERE ts IS NOT NULL) AS cached FROM events""")
def streamed_hits(spark, sf):
    """The calls arrive up to six hours late, in six micro-batches; a last call of another key, years on, moves the
    watermark past them all."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    folder = f"{scratch_dir(spark)}/calls-{uuid.uuid4().hex}"
    calls = call_log(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    late = calls.withColumn("arrival", F.unix_seconds("ts") + F.pmod(F.hash("request_id"), F.lit(21_600)))
    first, last = late.agg(F.min("arrival")).scalar(), late.agg(F.max("arrival")).scalar()
    waves = materialize(late.withColumn("wave", F.floor((F.col("arrival") - first) * 6 / (last - first + 1))))
    for wave in range(6):
        waves.filter(F.col("wave") == wave).select(calls.columns).coalesce(1).write.mode("append").parquet(folder)
    calls.agg((F.max("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts")).select(
        F.lit(-1).cast("long").alias("request_id"), F.lit("closing").alias("request_key"), "ts").write.mode("append").parquet(folder)
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        arriving = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        labelled = stream_label_cache_hits(arriving, delay="7 hours", slot=3600)
        return drain(labelled, spark, "hits").select("request_id", "cached")
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)


