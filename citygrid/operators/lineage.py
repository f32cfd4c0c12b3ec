"""What a change of settings makes stale: stages, the inputs they claim, snapshots of both."""

from __future__ import annotations

from citygrid.operators import operator

# the stages that read a changed path, and all downstream of them; upstream is what a stage needs
_CHANGED = "SELECT design_id, path FROM {params_diff}"
operator("stage_impact", "stage_edges stage_claims params_diff", f"""
WITH RECURSIVE down AS (SELECT DISTINCT stage AS root, stage FROM (SELECT stage FROM {{stage_claims}} UNION SELECT reads FROM {{stage_edges}} UNION SELECT stage FROM {{stage_edges}}) s
  UNION ALL SELECT d.root, e.stage FROM down d JOIN {{stage_edges}} e ON e.reads = d.stage),
 closed AS (SELECT DISTINCT root, stage FROM down),
 hit AS (SELECT c.design_id, k.stage AS root FROM ({_CHANGED}) c JOIN {{stage_claims}} k ON k.path = c.path),
 needs AS (SELECT stage, count(*) - 1 AS upstream FROM closed GROUP BY stage)
SELECT h.design_id, d.stage, count(DISTINCT h.root) AS causes, min(CASE WHEN h.root = d.stage THEN 1 ELSE 0 END) = 0 AS downstream_only, max(n.upstream) AS upstream FROM hit h JOIN closed d ON d.root = h.root JOIN needs n ON n.stage = d.stage GROUP BY h.design_id, d.stage""")  # fmt: skip

# two snapshots of each design. A stage runs again if its own inputs changed or a stage
# that it reads has another output; one whose output stays equal (rounded settings) stops what is below it
_OWN = f"SELECT d.design_id, s.stage, coalesce(sha1(max(l.keys_old)) <> sha1(max(l.keys_new)), false) AS changed FROM (SELECT DISTINCT design_id FROM {{designs}}) d CROSS JOIN (SELECT stage FROM {{stage_edges}} UNION SELECT reads FROM {{stage_edges}}) s LEFT JOIN (SELECT v.design_id, c.stage, KEYS_OLD AS keys_old, KEYS_NEW AS keys_new FROM {{leaf_snapshots}} v JOIN {{stage_claims}} c ON c.path = v.path GROUP BY v.design_id, c.stage) l ON l.design_id = d.design_id AND l.stage = s.stage GROUP BY d.design_id, s.stage"
_PLAN = f"""
WITH RECURSIVE own AS ({_OWN}),
 stale AS (SELECT design_id, stage FROM own WHERE changed UNION ALL SELECT s.design_id, e.stage FROM stale s JOIN {{stage_edges}} e ON e.reads = s.stage LEFT JOIN {{equal_outputs}} q ON q.design_id = s.design_id AND q.stage = s.stage WHERE q.stage IS NULL),
 ran AS (SELECT DISTINCT design_id, stage FROM stale)
SELECT o.design_id, o.stage, CASE WHEN r.stage IS NULL THEN 'cached' WHEN q.stage IS NOT NULL THEN 'run, equal output' ELSE 'run' END AS plan, o.changed FROM own o LEFT JOIN ran r ON r.design_id = o.design_id AND r.stage = o.stage LEFT JOIN {{equal_outputs}} q ON q.design_id = o.design_id AND q.stage = o.stage"""
_key = lambda c, spark: f"array_join(array_sort(collect_list(concat(v.path, '=', v.{c}))), '|')" if spark else f"string_agg(concat(v.path, '=', v.{c}), '|' ORDER BY v.path)"
operator("incremental_plan", "designs leaf_snapshots equal_outputs stage_edges stage_claims", *[_PLAN.replace("KEYS_OLD", _key("old", s)).replace("KEYS_NEW", _key("new", s)) for s in (True, False)])
