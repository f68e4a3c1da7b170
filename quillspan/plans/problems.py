"""Queries and oracle SQL of the general data problems (2, 5, 6, 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import hierarchy as hier
from quillspan.operators import instants, references, snapshot_changes
from quillspan.sources.tables import table


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    t = lambda n: table(spark, base, n)
    links = [
        references.Link("items", t("items"), "item_id", "supersedes_item_id", "items", t("items"), "item_id"),
        references.Link("acquisitions", t("acquisitions"), "acquisition_id", "candidate_id", "candidates", t("candidates"), "candidate_id"),
        references.Link("source_provenance", t("source_provenance"), "item_id", "origin_adoption_id", "adoptions", t("adoptions"), "adoption_id"),
    ]
    return references.orphan_references(links, t("removals"))


def p2_counts(spark: SparkSession, base: str) -> DataFrame:
    return references.orphan_counts(p2_found(spark, base))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    t = lambda n: table(spark, base, n)
    items = t("items")
    times = [
        instants.Times("source_provenance", t("source_provenance"), "item_id", ("source_published_at",), "source", items),
        instants.Times("acquisitions", t("acquisitions"), "acquisition_id", ("last_modified", "acquired_at"), "source_label"),
        instants.Times("items", items, "item_id", ("stale_after",), "source"),
    ]
    return instants.record_instants(times, t("source_zones"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return snapshot_changes.snapshot_changes(table(spark, base, "catalog_snapshots"))


def p6_values(spark: SparkSession, base: str) -> DataFrame:
    return snapshot_changes.change_values(table(spark, base, "catalog_snapshots"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return hier.hierarchy(hier.parent_links(table(spark, base, "items")))


def p7_paths(spark: SparkSession, base: str) -> DataFrame:
    found = hier.hierarchy(hier.parent_links(table(spark, base, "items")), paths=True)
    return found.select("item_id", "root_item_id", F.array_join("path", "/").alias("path"))


def p7_descendants(spark: SparkSession, base: str) -> DataFrame:
    return hier.descendants(hier.parent_links(table(spark, base, "items")))


def p7_cycles(spark: SparkSession, base: str) -> DataFrame:
    found = hier.cycles(hier.parent_links(table(spark, base, "items")))
    return found.withColumn("members", F.array_join("members", ","))


def queries():
    return {f.__name__: f for f in (p2_found, p2_counts, p5_found, p6_found, p6_values, p7_found, p7_paths, p7_descendants, p7_cycles)}


_NK = r"nullif(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '')"

_P2 = f"""
WITH kids AS (
  SELECT 'items' AS table_name, 'items' AS parent_table, item_id AS record_key,
         arg_min({_NK.format('supersedes_item_id')}, loaded_at) AS ref, min(loaded_at) AS first_at
  FROM items GROUP BY item_id
  UNION ALL
  SELECT 'acquisitions', 'candidates', acquisition_id, arg_min({_NK.format('candidate_id')}, loaded_at), min(loaded_at)
  FROM acquisitions GROUP BY acquisition_id
  UNION ALL
  SELECT 'source_provenance', 'adoptions', item_id, arg_min({_NK.format('origin_adoption_id')}, loaded_at), min(loaded_at)
  FROM source_provenance GROUP BY item_id),
parents AS (
  SELECT 'items' AS parent_table, {_NK.format('item_id')} AS ref, min(loaded_at) AS parent_first FROM items GROUP BY 2
  UNION ALL SELECT 'candidates', {_NK.format('candidate_id')}, min(loaded_at) FROM candidates GROUP BY 2
  UNION ALL SELECT 'adoptions', {_NK.format('adoption_id')}, min(loaded_at) FROM adoptions GROUP BY 2),
gone AS (SELECT DISTINCT table_name AS parent_table, {_NK.format('record_key')} AS ref FROM removals),
found AS (
  SELECT k.table_name, k.record_key, strftime(k.first_at, '%Y-%m') AS ref_month,
         CASE WHEN p.ref IS NOT NULL THEN CASE WHEN p.parent_first > k.first_at THEN 'late' END
              WHEN g.ref IS NOT NULL THEN 'deleted' ELSE 'missing' END AS status
  FROM kids k LEFT JOIN parents p USING (parent_table, ref) LEFT JOIN gone g USING (parent_table, ref)
  WHERE k.ref IS NOT NULL)
"""

_NV = r"coalesce(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '')"

_P6 = f"""
WITH r AS (
  SELECT snapshot_no, {_NV.format('item_id')} AS item_id, {_NV.format('sha256')} AS sha256,
         {_NV.format('lifecycle_state')} AS lifecycle_state, {_NV.format('candidate_id')} AS candidate_id,
         row_number() OVER (PARTITION BY snapshot_no, {_NV.format('item_id')} ORDER BY loaded_at DESC) AS rn
  FROM catalog_snapshots),
s AS (SELECT * EXCLUDE rn FROM r WHERE rn = 1 AND item_id <> ''),
n AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before_no
      FROM (SELECT DISTINCT snapshot_no FROM s)),
o AS (SELECT n.snapshot_no, s.* EXCLUDE snapshot_no FROM s JOIN n ON s.snapshot_no = n.before_no),
c AS (SELECT s.* FROM s JOIN n USING (snapshot_no) WHERE n.before_no IS NOT NULL),
d AS (
  SELECT snapshot_no, item_id,
         CASE WHEN o.sha256 IS NULL THEN 'added' WHEN c.sha256 IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
         o.sha256 AS old_sha256, o.lifecycle_state AS old_lifecycle_state, o.candidate_id AS old_candidate_id,
         c.sha256 AS new_sha256, c.lifecycle_state AS new_lifecycle_state, c.candidate_id AS new_candidate_id
  FROM o FULL JOIN c USING (snapshot_no, item_id)
  WHERE o.sha256 IS NULL OR c.sha256 IS NULL OR (o.sha256, o.lifecycle_state, o.candidate_id) <> (c.sha256, c.lifecycle_state, c.candidate_id))
"""

_P7 = f"""
WITH RECURSIVE i AS (
  SELECT {_NK.format('item_id')} AS node, arg_min({_NV.format('supersedes_item_id')}, loaded_at) AS up,
         arg_min({_NV.format('superseded_by_item_id')}, loaded_at) AS down
  FROM items GROUP BY 1),
named AS (SELECT down AS node, min(node) AS parent FROM i WHERE down <> '' GROUP BY 1),
e AS (
  SELECT i.node, i.up AS parent FROM i JOIN i AS p ON i.up = p.node
  UNION ALL SELECT i.node, n.parent FROM i JOIN named n ON n.node = i.node WHERE i.up = ''),
anc(node, a, path) AS (
  SELECT node, parent, parent || '/' || node FROM e
  UNION SELECT anc.node, e.parent, CASE WHEN contains(anc.path, e.parent) THEN '' ELSE e.parent || '/' || anc.path END
  FROM anc JOIN e ON e.node = anc.a WHERE anc.path <> ''),
pairs AS (SELECT DISTINCT node, a FROM anc),
ring AS (SELECT node FROM pairs WHERE node = a),
nodes AS (SELECT node FROM e UNION SELECT parent FROM e),
up AS (
  SELECT n.node, count(p.a) AS n_up, count(r.node) AS n_ring, min(r.node) AS ring_low,
         min(CASE WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.node = p.a) THEN p.a END) AS root
  FROM nodes n LEFT JOIN pairs p ON p.node = n.node LEFT JOIN ring r ON r.node = p.a GROUP BY 1),
below AS (SELECT a AS node, count(*) AS n FROM pairs WHERE a <> node GROUP BY 1),
paths AS (SELECT node, arg_max(path, length(path)) AS path FROM anc GROUP BY 1),
found AS (
  SELECT u.node AS item_id,
         CASE WHEN n_ring = 0 THEN coalesce(root, u.node) ELSE ring_low END AS root_item_id,
         CAST(CASE WHEN n_ring = 0 THEN n_up WHEN g.node IS NOT NULL THEN 0 ELSE n_up - n_ring + 1 END AS INTEGER) AS depth,
         CAST(coalesce(b.n, 0) AS INTEGER) AS n_descendants,
         CASE WHEN n_ring = 0 THEN 'tree' WHEN g.node IS NOT NULL THEN 'cycle' ELSE 'hanging' END AS kind
  FROM up u LEFT JOIN ring g ON g.node = u.node LEFT JOIN below b ON b.node = u.node)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2 + "SELECT * FROM found WHERE status IS NOT NULL",
        "p2_counts": _P2 + "SELECT table_name, ref_month, status, count(*) AS n_refs FROM found WHERE status IS NOT NULL GROUP BY 1, 2, 3",
        "p6_found": _P6 + "SELECT snapshot_no, item_id, change_kind FROM d",
        "p6_values": _P6 + "SELECT * FROM d",
        "p7_found": _P7 + "SELECT * FROM found",
        "p7_paths": _P7
        + """, line(node, head, path) AS (
  SELECT node, parent, parent || '/' || node FROM e WHERE node NOT IN (SELECT node FROM ring)
  UNION ALL SELECT line.node, e.parent, e.parent || '/' || line.path FROM line JOIN e ON e.node = line.head
  WHERE line.head NOT IN (SELECT node FROM ring)),
long AS (SELECT node, arg_max(path, length(path)) AS path FROM line GROUP BY 1)
SELECT f.item_id, f.root_item_id, coalesce(l.path, f.item_id) AS path FROM found f LEFT JOIN long l ON l.node = f.item_id""",
        "p7_descendants": _P7 + "SELECT a AS item_id, node AS descendant_id FROM pairs WHERE a <> node",
        "p7_cycles": _P7
        + """SELECT root_item_id, min(e.parent) AS back_edge_from, CAST(count(*) AS INTEGER) AS n_members, string_agg(item_id, ',' ORDER BY item_id) AS members
FROM found LEFT JOIN e ON e.node = found.item_id AND found.item_id = found.root_item_id WHERE kind = 'cycle' GROUP BY 1""",
    }
