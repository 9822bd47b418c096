"""Snapshot queries: two states of the documents and of the orders."""

from __future__ import annotations

from lorespark.catalog import query
from lorespark.operators import changes as C
from lorespark.plans.base import view
from pyspark.sql import functions as F

OLD = "SELECT doc_id AS path, doc_id % 3 AS mtime, {h} AS sha256 FROM documents WHERE doc_id % 10 <> 0"
NEW = "SELECT doc_id AS path, doc_id % 2 AS mtime, CASE WHEN doc_id % 5 = 0 THEN {h2} ELSE {h} END AS sha256 FROM documents WHERE doc_id % 7 <> 0"
SPARK = {"h": "sha2(text, 256)", "h2": "sha2(concat(text, '!'), 256)"}
DUCK = {"h": "sha256(text)", "h2": "sha256(text || '!')"}


def _two(spark, d):
    return view(spark, d, OLD.format(**SPARK)), view(spark, d, NEW.format(**SPARK))


@query("change_set", f"""
WITH o AS ({OLD.format(**DUCK)}), n AS ({NEW.format(**DUCK)}) SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.mtime = n.mtime OR o.sha256 = n.sha256 THEN 'unchanged' ELSE 'modified' END AS state FROM o FULL JOIN n ON o.path = n.path""")
def change_set(spark, d):
    return C.classify(*_two(spark, d))


@query("reparse_set", f"WITH o AS ({OLD.format(**DUCK)}), n AS ({NEW.format(**DUCK)}) SELECT n.path FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = n.path AND o.sha256 = n.sha256)")
def reparse_set(spark, d):
    old, new = _two(spark, d)
    return C.to_parse(new, old).select("path")


@query("state_upsert", f"""
WITH o AS ({OLD.format(**DUCK)}), n AS ({NEW.format(**DUCK)}) SELECT path, mtime, sha256 FROM n WHERE path % 3 = 0 UNION ALL SELECT * FROM o WHERE path % 3 <> 0 AND path % 11 <> 0""")
def state_upsert(spark, d):
    old, new = _two(spark, d)
    packed = new.filter("path % 3 = 0")
    return C.upsert(old, packed, old.filter("path % 11 = 0 OR path % 3 = 0"))


@query("document_diff", """
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS value FROM orders WHERE o_orderkey % 4 <> 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS value FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS change, o.value AS old_value, n.value AS new_value FROM o FULL JOIN n ON o.k = n.k WHERE o.value IS DISTINCT FROM n.value""")
def document_diff(spark, d):
    old = view(spark, d, "SELECT o_orderkey AS k, o_orderstatus AS value FROM orders WHERE o_orderkey % 4 <> 0")
    new = view(spark, d, "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS value FROM orders WHERE o_orderkey % 5 <> 0")
    return C.diff(old, new, ["k"])


@query("line_diff", """
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, '. ')) AS line FROM conversations), o AS (SELECT DISTINCT conv_id, line FROM l WHERE turn % 2 = 0), n AS (SELECT DISTINCT conv_id, line FROM l WHERE turn % 3 <> 0)
(SELECT conv_id, line, 'added' AS change FROM n EXCEPT SELECT conv_id, line, 'added' FROM o) UNION ALL (SELECT conv_id, line, 'removed' FROM o EXCEPT SELECT conv_id, line, 'removed' FROM n)""")
def line_diff(spark, d):
    lines = view(spark, d, "SELECT conv_id, turn, explode(split(text, '\\\\. ')) AS line FROM conversations")
    return C.line_diff(lines.filter("turn % 2 = 0"), lines.filter("turn % 3 <> 0"), "conv_id")


@query("nested_folders", """
WITH f AS (SELECT DISTINCT p_brand || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '/' || p_type ELSE '/' || p_type || '/' || p_size END || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END AS path FROM part)
SELECT path FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE starts_with(a.path, b.path || '/'))""")
def nested_folders(spark, d):
    return C.outermost(view(spark, d, "SELECT DISTINCT concat(p_brand, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN concat('/', p_type) ELSE concat('/', p_type, '/', p_size) END, CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END) AS path FROM part"))


@query("new_sections", """
SELECT DISTINCT user_id, upper(event_type) AS section FROM events e WHERE value > 50 AND NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.value < 5 AND lower(s.event_type) = lower(e.event_type))""")
def new_sections(spark, d):
    asked = view(spark, d, "SELECT DISTINCT user_id, upper(event_type) AS section FROM events WHERE value > 50")
    return C.not_yet(asked, view(spark, d, "SELECT user_id, event_type AS section FROM events WHERE value < 5"), "user_id", "section")


@query("token_intersection", """
SELECT a.doc_id, len(list_intersect(list_distinct(string_split(a.text, ' ')), list_distinct(string_split(b.text, ' ')))) AS shared FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""")
def token_intersection(spark, d):
    a = view(spark, d, "SELECT doc_id, array_distinct(split(text, ' ')) AS w FROM documents")
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return a.join(b, "doc_id").select("doc_id", F.size(F.array_intersect("w", "v")).cast("long").alias("shared"))
