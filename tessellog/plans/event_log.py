"""A log of operations derived from the ``events`` table, by one statement for Spark and DuckDB.

A user is a document.  In the order of time, ``error`` events are removals and all
others insertions: the first a root, each later one before (``view``) or after an
earlier one.  ``signup`` insertions also depend on the user's previous event.  Ids
are hashes of event numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEMPLATE = """
SELECT user_id AS doc_id, node_id, op, anchor, ch,
  CASE WHEN event_type = 'signup' AND previous IS NOT NULL AND (anchor IS NULL OR previous <> anchor) THEN {list}(previous) ELSE {none} END AS extra_deps,
  CASE WHEN op = 'remove' AND target IS NOT NULL THEN {list}(target) ELSE {none} END AS targets
FROM (
  SELECT l.user_id, l.node_id, l.event_type, l.previous,
    CASE WHEN NOT l.ins THEN 'remove' WHEN l.j = 0 THEN 'root' WHEN l.event_type = 'view' THEN 'before' ELSE 'after' END AS op,
    CASE WHEN l.ins THEN a.node_id END AS anchor, CASE WHEN l.ins THEN l.ch END AS ch, CASE WHEN NOT l.ins THEN a.node_id END AS target
  FROM (
    SELECT *, CASE WHEN ins THEN CASE WHEN j > 0 THEN CAST(floor(j * 2e0 / 3) AS BIGINT) END WHEN n_before > 0 THEN event_id % n_before END AS at FROM numbered
  ) l LEFT JOIN (SELECT user_id, j, node_id FROM numbered WHERE ins) a ON l.user_id = a.user_id AND l.at = a.j
) x
"""
NUMBERED = """
SELECT user_id, event_id, event_type, ins, node_id, previous, ch, n_upto - 1 AS j, n_upto - CASE WHEN ins THEN 1 ELSE 0 END AS n_before
FROM (
  SELECT user_id, event_id, event_type, event_type <> 'error' AS ins, {sha} AS node_id, {chr} AS ch,
    lag({sha}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous,
    sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_upto
  FROM events
) e
"""
_SPARK = {"sha": "sha2(concat('n', event_id), 256)", "chr": "char(97 + event_id % 26)", "list": "array", "none": "cast(array() as array<string>)"}
_DUCK = {"sha": "sha256('n' || event_id)", "chr": "chr((97 + event_id % 26)::INTEGER)", "list": "list_value", "none": "[]::VARCHAR[]"}


def event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    numbered = spark.sql(NUMBERED.replace("FROM events", "FROM {events}").format(**_SPARK, events="{events}"), events=events)
    return spark.sql(TEMPLATE.replace("FROM numbered", "FROM {numbered}").format(**_SPARK, numbered="{numbered}"), numbered=numbered)


#: The same for DuckDB, as the start of a WITH clause.
DUCK_LOG = f"numbered AS ({NUMBERED.format(**_DUCK)}), nodes AS ({TEMPLATE.format(**_DUCK)})"
#: Canonical order in DuckDB: a path of sibling ranks for each insertion.
DUCK_ORDER = f"""{DUCK_LOG},
ranked AS (SELECT doc_id, node_id, anchor, op, row_number() OVER (PARTITION BY doc_id, anchor, op ORDER BY node_id) AS rank FROM nodes WHERE op <> 'remove'),
paths AS (SELECT doc_id, node_id, [rank] AS path FROM ranked WHERE op = 'root'
  UNION ALL SELECT r.doc_id, r.node_id, list_concat(p.path, [CASE WHEN r.op = 'before' THEN 0 ELSE 2 END, r.rank])
  FROM ranked r JOIN paths p ON r.doc_id = p.doc_id AND r.anchor = p.node_id),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY list_append(path, 1)) - 1 AS place FROM paths),
gone AS (SELECT DISTINCT doc_id, unnest(targets) AS node_id FROM nodes),
shown AS (SELECT o.doc_id, o.node_id, n.ch, row_number() OVER (PARTITION BY o.doc_id ORDER BY place) - 1 AS pos
  FROM ordered o JOIN nodes n USING (doc_id, node_id) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = o.doc_id AND g.node_id = o.node_id))"""
