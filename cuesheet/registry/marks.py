"""Marks and cuts over event streams per user and over the region hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.operators import marks as M
from cuesheet.registry.common import table
from cuesheet.registry.timeline import hierarchy
from cuesheet.session import stored

KEYS = ["user_id"]


def _shown(spark, sf_dir):
    """Every event is a child of its user that shows one mark."""
    return table(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("idx"), M.mark_of(F.col("props")).alias("mark")
    )


def _targets(shown):
    """Cut each user before the alphabetically first mark the user shows."""
    return M.visible(shown, KEYS).groupBy("user_id").agg(F.min("mark").alias("mark"))


def marks_visible(spark, sf_dir):
    return M.visible(_shown(spark, sf_dir), KEYS)


def marks_ordered(spark, sf_dir):
    return M.ordered(M.visible(_shown(spark, sf_dir), KEYS), KEYS)


def mark_cut(spark, sf_dir):
    shown = _shown(spark, sf_dir)
    return M.cut_before(shown, M.visible(shown, KEYS), _targets(shown), KEYS)


def marks_after_cut(spark, sf_dir):
    return M.visible(mark_cut(spark, sf_dir), KEYS)


def cut_errors(spark, sf_dir):
    shown = _shown(spark, sf_dir)
    targets = shown.select("user_id").distinct().withColumn("mark", F.lit("5"))
    return M.cut_errors(M.visible(shown, KEYS), targets, KEYS)


def _tree(spark, sf_dir):
    nodes = hierarchy(spark, sf_dir).select("production", "node_id", "parent_id", "depth", "idx")
    marks = nodes.where("depth = 2").select(
        "production", "node_id", F.concat(F.lit("m"), (F.col("idx") % 700).cast("string")).alias("mark")
    )
    return nodes, marks


def nested_marks(spark, sf_dir):
    nodes, marks = _tree(spark, sf_dir)
    return M.bubble(nodes, marks, 2)


def _cut_tree(spark, sf_dir):
    nodes, marks = _tree(spark, sf_dir)
    bubbled = stored(M.bubble(nodes, marks, 2), "bubbled")
    targets = bubbled.where("depth = 0").groupBy("production").agg(F.min("mark").alias("mark"))
    return nodes, M.cut_tree(nodes, bubbled, targets, 2)


def nested_cut(spark, sf_dir):
    return _cut_tree(spark, sf_dir)[1].select("production", "node_id", "depth", "idx")


def cut_requests(spark, sf_dir):
    nodes, left = _cut_tree(spark, sf_dir)
    requests = nodes.where("depth = 2").select("production", "node_id", (F.col("idx") % 7).alias("speaker_no"))
    return M.surviving_requests(requests, left, ["production", "node_id"])


QUERIES = {
    "marks_visible": marks_visible,
    "marks_ordered": marks_ordered,
    "mark_cut": mark_cut,
    "marks_after_cut": marks_after_cut,
    "cut_errors": cut_errors,
    "nested_marks": nested_marks,
    "nested_cut": nested_cut,
    "cut_requests": cut_requests,
}

_SHOWN = """
shown AS (SELECT user_id, event_id AS idx, json_extract_string(props, '$.k') AS mark FROM events),
vis AS (SELECT user_id, mark, min(idx) AS idx FROM shown GROUP BY user_id, mark HAVING count(*) = 1)"""
_CUT = f"""{_SHOWN},
target AS (SELECT user_id, min(mark) AS mark FROM vis GROUP BY user_id),
bound AS (SELECT user_id, idx AS lo FROM target JOIN vis USING (user_id, mark)),
cut AS (SELECT s.user_id, s.idx, s.mark FROM shown s LEFT JOIN bound b ON b.user_id = s.user_id WHERE lo IS NULL OR idx >= lo)"""
_TREE = """
leaf AS (
  SELECT n_regionkey::BIGINT AS production, n_nationkey::BIGINT AS nation, c_custkey AS idx, 'm' || (c_custkey % 700) AS mark
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
nat AS (
  SELECT production, nation, mark, min(idx) AS idx FROM leaf GROUP BY production, nation, mark HAVING count(*) = 1),
reg AS (
  SELECT production, mark, min(nation) AS nation FROM nat GROUP BY production, mark HAVING count(*) = 1),
target AS (SELECT production, min(mark) AS mark FROM reg GROUP BY production),
pth AS (
  SELECT t.production, reg.nation, nat.idx FROM target t JOIN reg ON reg.production = t.production AND reg.mark = t.mark
  JOIN nat ON nat.production = t.production AND nat.nation = reg.nation AND nat.mark = t.mark),
alive AS (
  SELECT l.* FROM leaf l LEFT JOIN pth p ON p.production = l.production
  WHERE p.production IS NULL OR l.nation > p.nation OR (l.nation = p.nation AND l.idx >= p.idx))"""

ORACLE = {
    "marks_visible": f"WITH {_SHOWN} SELECT user_id, mark, idx FROM vis",
    "marks_ordered": f"""WITH {_SHOWN}
SELECT user_id, mark, idx, row_number() OVER (PARTITION BY user_id ORDER BY idx, mark) - 1 AS mark_no FROM vis""",
    "mark_cut": f"WITH {_CUT} SELECT user_id, idx, mark FROM cut",
    "marks_after_cut": f"""WITH {_CUT}
SELECT user_id, mark, min(idx) AS idx FROM cut GROUP BY user_id, mark HAVING count(*) = 1""",
    "cut_errors": f"""WITH {_SHOWN}
SELECT DISTINCT user_id, '5' AS mark, 'Unknown or ambiguous audio mark ''5''' AS message FROM shown
WHERE user_id NOT IN (SELECT user_id FROM vis WHERE mark = '5')""",
    "nested_marks": f"""WITH {_TREE}
SELECT production, 'n' || nation AS node_id, 1 AS depth, mark, idx, 'c' || idx AS child_id FROM nat
UNION ALL SELECT production, 'r' || production, 0, mark, nation, 'n' || nation FROM reg""",
    "nested_cut": f"""WITH {_TREE}
SELECT production, 'c' || idx AS node_id, 2 AS depth, idx FROM alive
UNION ALL SELECT n_regionkey::BIGINT, 'n' || n_nationkey, 1, n_nationkey::BIGINT FROM nation
  LEFT JOIN pth ON production = n_regionkey WHERE production IS NULL OR n_nationkey >= nation
UNION ALL SELECT r_regionkey::BIGINT, 'r' || r_regionkey, 0, 0 FROM region""",
    "cut_requests": f"""WITH {_TREE}
SELECT production, 'c' || idx AS node_id, idx % 7 AS speaker_no FROM alive""",
}
