"""Queries of the general training-data problems (1, 3, 6)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symvane.operators.hierarchy import descendants, hierarchy
from symvane.operators.incremental import Ledger, changes, processed_ledger, watermark
from symvane.operators.skew import balanced_distinct_count, balanced_join, heavy_keys, plan_loads
from symvane.runtime import cut, scratch_dir, table

#: Least share of all rows of a heavy key.
HEAVY_SHARE = 0.01


def _trees(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "symbols"), "id", "parent_id", "name", locality="file_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Faults of the nesting: cycles, orphans, wrong depths, stored names that no longer fit."""
    placed = cut(_trees(spark, d).drop("ids"))
    broken = placed.filter("state <> 'rooted'").select("id", F.col("state").alias("fault"), "root_id")
    fine = placed.filter("state = 'rooted'").select("id", "root_id", "depth", F.slice("path", 1, F.col("depth")).alias("above"))
    outline = table(spark, d, "outline_rows").groupBy("id").agg(F.min("depth").alias("least"), F.max("depth").alias("most"))
    wrong = fine.select("id", "root_id", "depth").join(outline, "id").filter("least <> depth OR most <> depth").select("id", F.lit("depth").alias("fault"), "root_id")
    stored = table(spark, d, "old_symbols").groupBy("id").agg(F.max(F.struct("stored_at", "qualified_name")).alias("last"))
    parts = F.split(F.col("last.qualified_name"), r"::|\.")
    moved = fine.select("id", "root_id", "above").join(stored, "id").filter(~F.slice(parts, 1, F.size(parts) - 1).eqNullSafe(F.col("above"))).select("id", F.lit("renested").alias("fault"), "root_id")
    return broken.unionByName(wrong).unionByName(moved)


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth and root of every symbol."""
    return _trees(spark, d).select("id", "state", "root_id", "depth", F.concat_ws("/", "path").alias("path"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every symbol, with their distance."""
    return descendants(_trees(spark, d).select("id", "depth", "ids"))


def _ref_keys(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "tmp_refs").select("rid", "name", F.col("owner").cast("string").alias("owner"))
    return refs.select("rid", F.expr("stack(2, 'name', name, 'owner', owner) AS (field, key_text)"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Names and owners that hold at least 1 % of all references."""
    counts = cut(balanced_distinct_count(_ref_keys(spark, d), ["field", "key_text"], "rid"))
    total = counts.filter("field = 'name'").agg(F.sum("n")).first()[0] or 0
    return heavy_keys(counts, total, HEAVY_SHARE).select("field", "key_text")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """References per name and per owner."""
    return balanced_distinct_count(_ref_keys(spark, d), ["field", "key_text"], "rid").withColumnRenamed("n", "refs")


def p3_owners(spark: SparkSession, d: str) -> DataFrame:
    """References of every owner with the owner's kind: the skewed references joined with symbols and shared owners."""
    refs = table(spark, d, "tmp_refs").select("rid", "owner").distinct()
    owners = table(spark, d, "symbols").select(F.col("id").alias("owner"), F.col("kind").alias("owner_kind")).distinct()
    shared = table(spark, d, "shared_owners").select(F.col("id").alias("owner"), F.concat(F.lit("shared "), "kind").alias("owner_kind"))
    joined = balanced_join(refs, owners.unionByName(shared), ["owner"], ["rid"], "left", plan_loads(refs, ["owner"]))
    return joined.groupBy("owner", "owner_kind").agg(F.count(F.lit(1)).alias("refs"))


VERSION = ["sig_hash", "body_hash"]


def _processed(spark: SparkSession, d: str) -> DataFrame:
    plans = table(spark, d, "upsert_plans").filter("outcome = 'committed' AND finished_at IS NOT NULL")
    removals = plans.select(F.explode("removed").alias("id"), F.col("finished_at").alias("removed_at"))
    return processed_ledger(table(spark, d, "old_symbols"), "id", VERSION, "stored_at", removals)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The symbols that the next run has to process."""
    return changes(table(spark, d, "symbols"), cut(_processed(spark, d)), "id", VERSION)


def p6_runs(spark: SparkSession, d: str) -> DataFrame:
    """What a run over the symbols processes after one before it failed, by a ledger on shared storage."""
    ledger = Ledger(spark, f"{scratch_dir(spark)}/symvane-ledger-{uuid.uuid4().hex}", "id", VERSION, T.LongType(), [T.LongType(), T.LongType()])
    ledger.load(_processed(spark, d))
    current = table(spark, d, "symbols").select("id", *VERSION).distinct()

    def process(rows: DataFrame, gone: DataFrame) -> DataFrame:
        held = ledger.frame().select("id", F.lit(True).alias("known"))
        kind = F.when(F.col("known"), "modified").otherwise("added")
        return rows.join(held, "id", "left").select("id", kind.alias("change_kind")).unionByName(gone.select("id", F.lit("removed").alias("change_kind")))

    def fail(rows: DataFrame, gone: DataFrame) -> DataFrame:
        raise RuntimeError("lost")

    for step in (fail, process):
        try:
            found = ledger.run(ledger.pending(current), step, ledger.removed(current))
        except RuntimeError:
            continue
    return found


def p6_reread(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose log the next run reads again: those planned since the oldest one open when the last successful one started."""
    plans = table(spark, d, "upsert_plans").select("plan_id", "file_id", "outcome", "planned_at", "finished_at").distinct()
    since = watermark(plans, "planned_at", "finished_at", F.col("outcome") == "committed", F.col("outcome").isin("failed", "rolled_back"))
    return plans.join(F.broadcast(since), F.col("planned_at") >= F.coalesce("since", "planned_at")).select("plan_id", "file_id", "outcome")


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p3_found, p3_counts, p3_owners, p6_found, p6_reread, p6_runs)}

_WALK = """
WITH RECURSIVE s AS (SELECT DISTINCT id, parent_id, name FROM symbols),
w AS (
  SELECT id, id AS cur, parent_id AS nxt, [id] AS seen, [name] AS path FROM s
  UNION ALL
  SELECT w.id, s.id, s.parent_id, list_append(w.seen, s.id), list_prepend(s.name, w.path)
  FROM w JOIN s ON s.id = w.nxt WHERE NOT list_contains(w.seen, w.nxt)
),
ends AS (
  SELECT w.*, len(seen) - 1 AS depth,
    CASE WHEN nxt IS NULL THEN 'rooted' WHEN NOT list_contains(seen, nxt) THEN 'orphan'
         WHEN nxt = id THEN 'cycle' ELSE 'below_cycle' END AS state,
    CASE WHEN nxt IS NULL OR NOT list_contains(seen, nxt) THEN cur
         ELSE list_min(seen[list_position(seen, nxt):]) END AS root_id
  FROM w WHERE nxt IS NULL OR list_contains(seen, nxt) OR NOT EXISTS (SELECT 1 FROM s WHERE s.id = w.nxt)
)"""

SQL = {
    "p1_found": _WALK + """,
stored AS (SELECT id, arg_max(qualified_name, stored_at) AS q FROM old_symbols GROUP BY id)
SELECT id, state AS fault, root_id FROM ends WHERE state <> 'rooted'
UNION ALL
SELECT e.id, 'depth', root_id FROM ends e JOIN (SELECT DISTINCT id, depth FROM outline_rows) o ON o.id = e.id WHERE state = 'rooted' AND o.depth <> e.depth
UNION ALL
SELECT e.id, 'renested', root_id FROM ends e JOIN stored ON stored.id = e.id
WHERE state = 'rooted' AND list_reverse(list_reverse(string_split(replace(q, '::', '.'), '.'))[2:]) <> path[:depth]""",
    "p1_paths": _WALK + """
SELECT id, state, root_id, CASE WHEN state IN ('rooted', 'orphan') THEN depth END::INT AS depth,
  CASE WHEN state IN ('rooted', 'orphan') THEN array_to_string(path, '/') ELSE '' END AS path FROM ends""",
    "p1_descendants": _WALK + """
SELECT u.anc AS id, e.id AS descendant_id, u.k::INT AS distance
FROM ends e, LATERAL (SELECT unnest(e.seen) AS anc, unnest(range(len(e.seen))) AS k) u
WHERE state IN ('rooted', 'orphan') AND u.k > 0""",
    "p3_found": """
WITH r AS (SELECT DISTINCT rid, name, owner FROM tmp_refs), n AS (SELECT count(*) AS n FROM r)
SELECT 'name' AS field, name AS key_text FROM r GROUP BY name HAVING count(*) >= 0.01 * (SELECT n FROM n)
UNION ALL
SELECT 'owner', CAST(owner AS VARCHAR) FROM r GROUP BY owner HAVING count(*) >= 0.01 * (SELECT n FROM n)""",
    "p3_counts": """
WITH r AS (SELECT DISTINCT rid, name, owner FROM tmp_refs)
SELECT 'name' AS field, name AS key_text, count(*) AS refs FROM r GROUP BY name
UNION ALL
SELECT 'owner', CAST(owner AS VARCHAR), count(*) FROM r GROUP BY owner""",
    "p3_owners": """
WITH r AS (SELECT DISTINCT rid, owner FROM tmp_refs),
o AS (SELECT DISTINCT id, kind FROM symbols UNION ALL SELECT id, 'shared ' || kind FROM shared_owners)
SELECT r.owner, o.kind AS owner_kind, count(*) AS refs FROM r LEFT JOIN o ON o.id = r.owner GROUP BY 1, 2""",
    "p6_reread": """
WITH l AS (SELECT arg_max(planned_at, finished_at) AS own FROM upsert_plans WHERE outcome = 'committed'),
w AS (SELECT min(planned_at) AS since FROM upsert_plans, l WHERE planned_at <= own AND (finished_at IS NULL AND coalesce(outcome, '') NOT IN ('failed', 'rolled_back') OR finished_at > own))
SELECT DISTINCT plan_id, file_id, outcome FROM upsert_plans, w WHERE planned_at >= since""",
    "p6_found": """
WITH stored AS (SELECT id, max(stored_at) AS at, arg_max(sig_hash, stored_at) AS sig, arg_max(body_hash, stored_at) AS body FROM old_symbols GROUP BY id),
gone AS (SELECT id, max(finished_at) AS fin FROM (SELECT unnest(removed) AS id, finished_at FROM upsert_plans WHERE outcome = 'committed') GROUP BY id),
held AS (SELECT s.* FROM stored s LEFT JOIN gone g ON g.id = s.id WHERE g.fin IS NULL OR g.fin <= s.at),
cur AS (SELECT DISTINCT id, sig_hash, body_hash FROM symbols)
SELECT coalesce(c.id, h.id) AS id, CASE WHEN h.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'removed' ELSE 'modified' END AS change_kind
FROM cur c FULL JOIN held h ON h.id = c.id
WHERE h.id IS NULL OR c.id IS NULL OR c.sig_hash <> h.sig OR c.body_hash <> h.body""",
}
SQL["p6_runs"] = SQL["p6_found"]
