"""Pipeline telemetry, job events and their timing rules in batch form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from citygrid.operators import operator, planned

# spans of a run and scope by name; a parent that is unknown or the span itself makes a root. Self time is what the
# children leave; the total of depth 0 is that of the roots
_FOLD = """
WITH s AS (SELECT run_id, scope, name, max(parent) AS parent, count(*) AS n, CAST(sum(CAST(floor(duration_ms * 1000) AS BIGINT)) AS BIGINT) AS total_us, max_by(CAST(floor(duration_ms * 1000) AS BIGINT), ms * 100000 + event_id % 100000) AS last_us, CAST(sum(bytes) AS BIGINT) AS bytes, min(ms) AS first_ms FROM {spans} GROUP BY run_id, scope, name),
 t AS (SELECT s.run_id, s.scope, s.name, s.n, s.total_us, s.last_us, s.bytes, s.first_ms, CASE WHEN p.name IS NOT NULL AND s.parent <> s.name THEN s.parent END AS parent FROM s LEFT JOIN s p ON p.run_id = s.run_id AND p.scope = s.scope AND p.name = s.parent),
 k AS (SELECT run_id, scope, parent, sum(total_us) AS below_us FROM t WHERE parent IS NOT NULL GROUP BY run_id, scope, parent)
SELECT t.run_id, t.scope, t.name, t.parent, t.n, t.total_us, t.total_us - CAST(coalesce(k.below_us, 0) AS BIGINT) AS self_us, t.last_us, t.bytes, t.first_ms, CAST(sum(CASE WHEN t.parent IS NULL THEN t.total_us ELSE 0 END) OVER (PARTITION BY t.run_id, t.scope) AS BIGINT) AS root_us
FROM t LEFT JOIN k ON k.run_id = t.run_id AND k.scope = t.scope AND k.parent = t.name"""
operator("perf_fold", "spans", _FOLD)

# rows of perf_fold depth first: children under their parent by their first start, what no root reaches last
_TREE = """
WITH RECURSIVE r AS (SELECT *, lpad(CAST(row_number() OVER (PARTITION BY run_id, scope, parent ORDER BY first_ms, name) AS STRING), 4, '0') AS step FROM {perf_fold}),
 walk AS (SELECT run_id, scope, name, 0 AS depth, step AS path FROM r WHERE parent IS NULL
  UNION ALL SELECT c.run_id, c.scope, c.name, w.depth + 1, concat(w.path, '/', c.step) FROM walk w JOIN r c ON c.run_id = w.run_id AND c.scope = w.scope AND c.parent = w.name),
 all_of AS (SELECT run_id, scope, name, depth, path FROM walk UNION ALL SELECT r.run_id, r.scope, r.name, 0, concat('z', r.name) FROM r LEFT JOIN walk w ON w.run_id = r.run_id AND w.scope = r.scope AND w.name = r.name WHERE w.name IS NULL)
SELECT run_id, scope, name, depth, row_number() OVER (PARTITION BY run_id, scope ORDER BY path) AS place FROM all_of"""
operator("perf_tree", "perf_fold", _TREE)

operator("perf_runs", "spans", """
SELECT run_id, CAST(part AS BIGINT) AS part, count(*) AS n, min(ms) AS first_ms FROM (SELECT *, max(part) OVER (PARTITION BY run_id) AS last FROM (
 SELECT *, coalesce(sum(CASE WHEN name = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM {spans}) q) p WHERE part > last - 10 GROUP BY run_id, part""")  # fmt: skip

# fixed values: kinds of resources; each kind's counts, bytes and time with their total, and the ten largest by transfer
_KIND = "CASE name WHEN 'view' THEN 'document' WHEN 'click' THEN 'script' WHEN 'purchase' THEN 'data' ELSE 'other' END"
operator("resource_totals", "spans", f"""
SELECT coalesce(kind, 'total') AS kind, CAST(NULL AS BIGINT) AS event_id, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(CAST(floor(duration_ms * 1000) AS BIGINT)) AS BIGINT) AS total_us FROM (SELECT *, {_KIND} AS kind FROM {{spans}}) q GROUP BY ROLLUP(kind)
UNION ALL SELECT kind, event_id, CAST(place AS BIGINT), bytes, CAST(floor(duration_ms * 1000) AS BIGINT) FROM (SELECT *, {_KIND} AS kind, row_number() OVER (ORDER BY bytes DESC, decoded DESC, event_id) AS place FROM (SELECT * FROM {{spans}} ORDER BY bytes DESC, decoded DESC, event_id LIMIT 10) t) p""")  # fmt: skip

# a newer job of a session ends the one before it at its own first event; what comes after a job's end is ignored
operator("job_status", "jobs", """
WITH began AS (SELECT session_id, job_no, min(ms * 100000 + event_id % 100000) AS began FROM {jobs} GROUP BY session_id, job_no),
 until AS (SELECT session_id, job_no, lead(began) OVER (PARTITION BY session_id ORDER BY job_no) AS taken FROM began),
 o AS (SELECT j.*, u.taken, j.ms * 100000 + j.event_id % 100000 AS moment FROM {jobs} j JOIN until u ON u.session_id = j.session_id AND u.job_no = j.job_no),
 e AS (SELECT *, min(CASE WHEN status IN ('done', 'failed') THEN moment END) OVER (PARTITION BY session_id, job_no) AS ended FROM o WHERE taken IS NULL OR moment < taken),
 last_of AS (SELECT *, row_number() OVER (PARTITION BY session_id, job_no ORDER BY moment DESC) AS nth FROM e WHERE ended IS NULL OR moment <= ended)
SELECT session_id, job_id, CASE WHEN status IN ('queued', 'running') AND taken IS NOT NULL THEN 'cancelled' ELSE status END AS status, progress FROM last_of WHERE nth = 1""", """
WITH began AS (SELECT session_id, job_no, min(ms * 100000 + event_id % 100000) AS began FROM {jobs} GROUP BY session_id, job_no),
 own AS (SELECT session_id, job_no, job_id, status, progress, ms * 100000 + event_id % 100000 AS moment FROM {jobs}),
 valid AS (SELECT o.* FROM own o WHERE NOT EXISTS (SELECT 1 FROM began b WHERE b.session_id = o.session_id AND b.job_no > o.job_no AND b.began <= o.moment)),
 kept AS (SELECT v.* FROM valid v WHERE NOT EXISTS (SELECT 1 FROM valid x WHERE x.session_id = v.session_id AND x.job_no = v.job_no AND x.status IN ('done', 'failed') AND x.moment < v.moment)),
 last_of AS (SELECT session_id, job_no, max(moment) AS moment FROM kept GROUP BY session_id, job_no)
SELECT k.session_id, k.job_id, CASE WHEN k.status IN ('done', 'failed') THEN k.status WHEN EXISTS (SELECT 1 FROM began b WHERE b.session_id = k.session_id AND b.job_no > k.job_no) THEN 'cancelled' ELSE k.status END AS status, k.progress
FROM kept k JOIN last_of l ON l.session_id = k.session_id AND l.job_no = k.job_no AND l.moment = k.moment""")  # fmt: skip

# a lookup of a key within the time to live of its last fetched one is served, the rest are fetched
TTL_MS = 21600000


def fetches(ms: np.ndarray, last: int | None, ttl: int = TTL_MS) -> tuple[list[int], int | None]:
    """Positions in sorted ``ms`` that are fetched, and the last fetch: from one to the next it is a jump."""
    out, at = [], 0
    while True:
        at = at if last is None else at + int(np.searchsorted(ms[at:], last + ttl, side="right"))
        if at >= len(ms):
            return out, last
        out.append(at)
        last, at = int(ms[at]), at + 1


@planned("dedupe_ttl", "clicks", f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS nth FROM {{clicks}}),
 f AS (SELECT user_id, event_id, ms, nth FROM o WHERE nth = 1 UNION ALL SELECT n.user_id, n.event_id, n.ms, n.nth FROM f, LATERAL (SELECT o.user_id, o.event_id, o.ms, o.nth FROM o WHERE o.user_id = f.user_id AND o.ms - f.ms > {TTL_MS} ORDER BY o.nth LIMIT 1) n)
SELECT user_id, event_id, ms FROM f""")
def dedupe_ttl(clicks: DataFrame) -> DataFrame:
    """Lookups come sorted by key and time, batch after batch; what is held of a key is its last fetch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = object(), None
        for pdf in batches:
            ids = pdf["user_id"].to_numpy()
            begins = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]).tolist() if len(ids) else []
            kept = []
            for a, b in zip(begins, [*begins[1:], len(ids)]):
                found, last = fetches(pdf["ms"].to_numpy()[a:b], last if ids[a] == key else None)
                key = ids[a]
                kept += [a + k for k in found]
            yield pdf.iloc[kept]

    given = clicks.select("user_id", "event_id", "ms")
    return given.repartition("user_id").sortWithinPartitions("user_id", "ms", "event_id").mapInPandas(run, given.schema)


operator("debounce", "clicks", """
SELECT user_id, event_id, ms FROM (SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS following FROM {clicks}) q WHERE following IS NULL OR following - ms >= 7200000""")  # fmt: skip

operator("coalesce_history", "clicks", """
WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type AND ms - lag(ms) OVER w <= 7200000 THEN 0 ELSE 1 END AS starts FROM {clicks} WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
 g AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS entry FROM f),
 h AS (SELECT user_id, CAST(entry AS BIGINT) AS entry, max(event_type) AS path, count(*) AS n, max(ms) AS last_ms FROM g GROUP BY user_id, entry)
SELECT user_id, entry, path, n, last_ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY entry DESC) AS back FROM h) q WHERE back <= 100""")  # fmt: skip

operator("request_pacing", "clicks", """
SELECT user_id, event_id, CAST(max(ms - 7200000 * i) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 7200000 * i AS BIGINT) AS start_ms FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i FROM {clicks} WHERE event_type <> 'error') q""")  # fmt: skip

operator("latest_within_ttl", "clicks", """
SELECT user_id, event_id, CASE WHEN ms - stored_ms <= 21600000 THEN stored_ms END AS stored_ms FROM (
 SELECT *, max(CASE WHEN event_type = 'purchase' THEN ms END) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stored_ms FROM {clicks} WHERE event_type IN ('view', 'purchase')) q WHERE event_type = 'view'""")  # fmt: skip

# tumbling hours and hours that slide by 20 minutes: counts, totals, nearest-rank 95th percentile, long tasks
_WINDOWED = """
SELECT kind, name, start_ms, count(*) AS n, CAST(sum(us) AS BIGINT) AS total_us, CAST(max(CASE WHEN nth = ceil(95e-2 * of_n) THEN us END) AS BIGINT) AS p95_us, count_if(duration_ms >= 50) AS long_tasks, coalesce(max(CASE WHEN duration_ms >= 50 THEN duration_ms END), 0e0) AS longest_ms FROM (
 SELECT *, row_number() OVER (PARTITION BY kind, name, start_ms ORDER BY us, event_id) AS nth, count(*) OVER (PARTITION BY kind, name, start_ms) AS of_n FROM (
  SELECT s.name, s.event_id, s.duration_ms, CAST(floor(s.duration_ms * 1000) AS BIGINT) AS us, w.kind, CASE WHEN w.kind = 'tumbling' THEN CAST(floor(s.ms / 3600000) AS BIGINT) * 3600000 ELSE (CAST(floor(s.ms / 1200000) AS BIGINT) - w.back) * 1200000 END AS start_ms
  FROM {spans} s CROSS JOIN (VALUES ('tumbling', 0), ('sliding', 0), ('sliding', 1), ('sliding', 2)) AS w(kind, back)) p) q GROUP BY kind, name, start_ms"""
operator("telemetry_windows", "spans", _WINDOWED)
