"""Labels, parameters, coverage and constraint reports, column clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from featherline.operators import labels, params, tables
from featherline.sources import sinks
from workload import adaptors, steps  # noqa: F401
from workload.adaptors import rounded, table
from workload.registry import query, step

step(
    "twilight_label",
    """
SELECT user_id AS id, CASE WHEN event_type IN ('click', 'view') THEN 'Set' ELSE 'Rise' END AS series, ts AS timestamp,
       CASE WHEN event_type = 'error' THEN 'discard' WHEN event_type = 'view' THEN (event_id % 40)::VARCHAR || '-5'
            ELSE (event_id % 40)::VARCHAR END AS label
FROM events
""",
)


def twilight_labels(spark, sf_dir):
    kind, number = F.col("event_type"), (F.col("event_id") % 40).cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"),
        F.when(kind.isin("click", "view"), "Set").otherwise("Rise").alias("series"),
        F.col("ts").alias("timestamp"),
        F.when(kind == "error", "discard")
        .when(kind == "view", F.concat(number, F.lit("-5")))
        .otherwise(number)
        .alias("label"),
    )


@query(
    "label_staps",
    """
SELECT id, timestamp, label, try_cast(replace(label, '-', '.') AS DOUBLE) AS stap_id,
       try_cast(replace(label, '-', '.') AS DOUBLE) % 1 <> 0 AS is_flight, label = 'discard' AS discarded
FROM twilight_label
""",
)
def label_staps(spark, sf_dir):
    return labels.with_stap(twilight_labels(spark, sf_dir)).drop("series")


@query("valid_labels", "SELECT * FROM twilight_label WHERE label <> 'discard'")
def valid_labels(spark, sf_dir):
    return labels.valid_labels(twilight_labels(spark, sf_dir))


@query(
    "label_changes",
    """
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.quality AS label_before, b.quality AS label_after,
       CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'relabelled' END AS change
FROM labels a
FULL JOIN (SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 1 - l.quality ELSE coalesce(l.quality, 0) END AS quality
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) b
ON a.doc_id = b.doc_id
WHERE a.quality IS DISTINCT FROM b.quality
""",
)
def label_changes(spark, sf_dir):
    before = table(spark, sf_dir, "labels")
    edited = F.when(F.col("toxic") == 1, 1 - F.col("quality")).otherwise(
        F.coalesce(F.col("quality"), F.lit(0))
    )
    after = (
        table(spark, sf_dir, "documents")
        .select("doc_id")
        .join(before, "doc_id", "left")
        .select("doc_id", edited.alias("quality"))
    )
    return labels.label_diff(before, after, ["doc_id"], "quality")


@query(
    "twilight_values",
    """
SELECT id, timestamp, round((m + 720.5) - 1440 * floor((m + 720.5) / 1440), 6) AS value,
       CASE WHEN m + 40 < 720 OR m + 40 >= 1440 THEN 'morning' ELSE 'evening' END AS event
FROM (SELECT id, timestamp,
             hour(timestamp) * 60 + minute(timestamp) + second(timestamp) / 60.0 AS m FROM twilight_label)
""",
)
def twilight_values(spark, sf_dir):
    df = labels.with_twilight_value(twilight_labels(spark, sf_dir), 720.5)
    return labels.normalise_series(df, longitude=10).select(
        "id", "timestamp", rounded("value").alias("value"), "event"
    )


@query(
    "tag_parameters",
    """
WITH own AS (SELECT s_suppkey::VARCHAR AS id, 'k' || s_nationkey AS key, s_name AS value FROM supplier),
     defaults AS (SELECT 'k' || n_nationkey AS key, n_name AS value FROM nation WHERE n_regionkey <> 2)
SELECT coalesce(p.id, o.id) AS id, coalesce(p.key, o.key) AS key, coalesce(o.value, p.value) AS value,
       o.value IS NOT NULL AS overridden
FROM (SELECT t.id, d.key, d.value FROM (SELECT DISTINCT id FROM own) t CROSS JOIN defaults d) p
FULL JOIN own o ON p.id = o.id AND p.key = o.key
""",
)
def tag_parameters(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.concat(F.lit("k"), "s_nationkey").alias("key"),
        F.col("s_name").alias("value"),
    )
    defaults = (
        table(spark, sf_dir, "nation")
        .where(F.col("n_regionkey") != 2)
        .select(
            F.lit("default").alias("id"),
            F.concat(F.lit("k"), "n_nationkey").alias("key"),
            F.col("n_name").alias("value"),
        )
    )
    return params.resolve_params(own.unionByName(defaults))


@query(
    "pooling_weights",
    "SELECT user_id AS id, count(*) AS n, round(ln(count(*)) / count(*), 6) AS weight FROM events GROUP BY ALL",
)
def pooling_weights(spark, sf_dir):
    counts = (
        table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    )
    return params.weighted(counts, "ln(n)/n").withColumn("weight", rounded("weight"))


step(
    "sensor",
    """
SELECT user_id AS id, 'activity' AS sensor, ts AS date FROM events
UNION ALL SELECT user_id, 'light', ts FROM events WHERE event_type = 'view'
UNION ALL SELECT o_custkey, 'pressure', o_orderdate FROM orders
""",
)


def _coverage(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("ts").alias("date"), "event_type"
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("date")
    )
    light = events.where(F.col("event_type") == "view")
    return tables.coverage({"activity": events, "light": light, "pressure": orders})


@query(
    "sensor_coverage",
    'SELECT id, sensor, count(*) AS n, min(date) AS first, max(date) AS last FROM sensor GROUP BY ALL',
)
def sensor_coverage(spark, sf_dir):
    return _coverage(spark, sf_dir)


@query(
    "tags_table",
    """
SELECT id, min(date) AS attached, max(date) AS detached, count(DISTINCT sensor) AS n_sensors FROM sensor GROUP BY id
""",
)
def tags_table(spark, sf_dir):
    return sinks.export_tags(_coverage(spark, sf_dir))


@query(
    "observations_table",
    """
SELECT id, 'equipment' AS observation_type, min(date) AS date FROM sensor GROUP BY id
UNION ALL SELECT id, 'retrieval', max(date) FROM sensor GROUP BY id
""",
)
def observations_table(spark, sf_dir):
    return sinks.export_observations(_coverage(spark, sf_dir))


@query(
    "table_checks",
    """
SELECT 'missing user_id' AS "check", count(*) FILTER (user_id IS NULL) AS n_failed FROM events
UNION ALL SELECT 'domain event_type', count(*) FILTER (event_type NOT IN ('click', 'view')) FROM events
UNION ALL SELECT 'unique user_id,event_type', (count(*) - count(DISTINCT (user_id, event_type))) FROM events
UNION ALL SELECT 'reference user_id', count(*) FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)
""",
)
def table_checks(spark, sf_dir):
    return tables.check_table(
        table(spark, sf_dir, "events"),
        ["user_id", "event_type"],
        required=["user_id"],
        domains={"event_type": ["click", "view"]},
        references={"user_id": (table(spark, sf_dir, "supplier"), "s_suppkey")},
    )


@query(
    "tags_without_orders",
    "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
)
def tags_without_orders(spark, sf_dir):
    tags = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return tables.missing_tags(tags, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


@query(
    "tags_without_events",
    "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)",
)
def tags_without_events(spark, sf_dir):
    tags = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return tables.missing_tags(tags, table(spark, sf_dir, "events").select(F.col("user_id").alias("id")))


@query(
    "stacked_tables",
    """
SELECT user_id AS id, event_type, NULL::VARCHAR AS o_orderpriority FROM events
UNION ALL SELECT o_custkey, NULL, o_orderpriority FROM orders
""",
)
def stacked_tables(spark, sf_dir):
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_type")
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderpriority")
    return tables.union_tables(a, b)


@query("cleaned_columns", "SELECT s_suppkey, s_name FROM supplier")
def cleaned_columns(spark, sf_dir):
    raw = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        "s_name",
        F.col("s_acctbal").alias("...3"),
        F.lit(None).cast("double").alias("empty"),
    )
    return tables.drop_all_null(tables.drop_unnamed(raw))
