"""Parts of the queries' SQL: rules that act row after row, as recursive table expressions."""

from __future__ import annotations


def greedy(name: str, rows: str, key: str, order: str, radius: float, apart: str | None = None) -> str:
    """``name`` (id, seed_id) of ``rows`` (id, x, y, ...): each row in order joins its earliest seed, or seeds a group."""
    side = f"s.{apart}" if apart else "0"
    far = f" AND q.f <> {side}" if apart else ""
    seed = f"{{'i': s.id, 'x': s.x, 'y': s.y, 'f': {side}}}"
    return f"""{name}_s AS (SELECT *, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY {order}, id) AS n FROM ({rows}) z),
 {name}_g AS (SELECT s.k, s.n, [{seed}] AS seeds, s.id, s.id AS seed_id FROM {name}_s s WHERE n=1
 UNION ALL SELECT k, n, CASE WHEN len(hit)=0 THEN list_append(seeds, own) ELSE seeds END, id, CASE WHEN len(hit)=0 THEN id ELSE hit[1].i END
  FROM (SELECT s.k, s.n, s.id, g.seeds, {seed} AS own, list_filter(g.seeds, lambda q: sqrt(pow(q.x-s.x,2)+pow(q.y-s.y,2)) < {radius}{far}) AS hit
   FROM {name}_g g JOIN {name}_s s ON s.k=g.k AND s.n=g.n+1) h),
 {name} AS (SELECT id, seed_id FROM {name}_g)"""


def admitted(name: str, rows: str, order: str, n: int, seconds: int, uses: str = "true") -> str:
    """``name`` (all columns of rows, admitted): at most n admitted rows of a user in the trailing seconds; rows have user_id and moment."""
    return f"""{name}_s AS (SELECT *, {uses} AS uses_up, epoch_us(moment) AS us, row_number() OVER (PARTITION BY user_id ORDER BY moment, {order}) AS n FROM ({rows}) z),
 {name}_g AS (SELECT user_id AS u, 0::BIGINT AS n, []::BIGINT[] AS held, true AS ok FROM {name}_s WHERE n=1
 UNION ALL SELECT u, n, CASE WHEN len(recent) < {n} AND uses_up THEN list_append(recent, us) ELSE recent END, len(recent) < {n}
  FROM (SELECT s.user_id AS u, s.n, s.uses_up, s.us, list_filter(g.held, lambda t: t > s.us - {seconds}*1000000::BIGINT) AS recent FROM {name}_g g JOIN {name}_s s ON s.user_id IS NOT DISTINCT FROM g.u AND s.n=g.n+1) h),
 {name} AS (SELECT s.*, g.ok AS admitted FROM {name}_s s JOIN {name}_g g ON g.u IS NOT DISTINCT FROM s.user_id AND g.n=s.n)"""


def least_costs(name: str, starts: str, arcs: str) -> str:
    """``name`` (pair_id, spot, cost): least costs from starts (pair_id, spot) over arcs (a, b, w); arcs may depend on the pair's floor."""
    return f"""{name}_a AS MATERIALIZED ({arcs}),
 {name}(pair_id, spot, cost) USING KEY (pair_id, spot) AS (SELECT pair_id, spot, 0.0::DOUBLE FROM ({starts}) z
 UNION SELECT d.pair_id, a.b, min(d.cost+a.w) FROM {name} d JOIN {name}_a a ON a.a=d.spot LEFT JOIN recurring.{name} r ON r.pair_id=d.pair_id AND r.spot=a.b WHERE r.cost IS NULL OR d.cost+a.w < r.cost GROUP BY d.pair_id, a.b)"""
