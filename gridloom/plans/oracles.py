"""The walk and the folds in plain SQL, set-based, for engines that have no batch walk; used to check results."""

from __future__ import annotations

from gridloom.functions import exprs
from gridloom.functions.params import MapParams
from gridloom.sources.rays import RAY_COLUMNS


def rays_cte(where: str = "true") -> str:
    columns = ", ".join(f"{e} AS {n}" for n, e in RAY_COLUMNS.items())
    return f"rays AS (SELECT {columns}, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 AS ts, user_id FROM events WHERE {where})"


def visits_cte(p: MapParams = MapParams(), rays: str = "rays", visits: str = "visits") -> str:
    k = ", ".join(f"{exprs.key(f'{e}{a}', p, i)} AS k{n}{a}" for i, a in enumerate("xyz") for n, e in ((0, "o"), (1, "s")))
    r = exprs.num(p.resolution)
    parts = []
    for i, a in enumerate("xyz"):
        wall = f"({exprs.centre(f'k0{a}', p, i)} + sign(k1{a} - k0{a}) * {r} / 2)"
        inverse = f"(CASE WHEN len = 0 THEN 0e0 ELSE 1e0 / nullif((s{a} - o{a}) / nullif(len, 0e0), 0e0) END)"
        parts.append(f"SELECT seq, {i} AS axis, sign(k1{a} - k0{a}) AS s, (({wall} - o{a}) * {inverse}) AS f, (({wall} + sign(k1{a} - k0{a}) * {r} - o{a}) * {inverse}) AS g, unnest(range(abs(k1{a} - k0{a}))) AS k FROM {visits}_k")
    moved = ", ".join(f"(k0{a} + coalesce(sum(CASE WHEN axis = {i} THEN s ELSE 0 END) OVER w, 0))::INT AS g{a}" for i, a in enumerate("xyz"))
    return f"""{visits}_l AS (SELECT *, {exprs.RAY_LENGTH} AS raw_len FROM {rays}),
{visits}_k AS (SELECT *, CASE WHEN raw_len * raw_len <= 1e-6 THEN 0e0 ELSE raw_len END AS len, {k} FROM {visits}_l),
{visits}_c AS (SELECT seq, axis, s, f + (g - f) * k AS t FROM ({" UNION ALL ".join(parts)})),
{visits} AS (SELECT seq, step, gx, gy, gz, enter, exit, false AS sample FROM (SELECT c.seq, (row_number() OVER (PARTITION BY c.seq ORDER BY t, axis DESC) - 1)::INT AS step, {moved}, coalesce(lag(t) OVER (PARTITION BY c.seq ORDER BY t, axis DESC), 0e0) AS enter, t AS exit
  FROM {visits}_c c JOIN {visits}_k USING (seq) WINDOW w AS (PARTITION BY c.seq ORDER BY t, axis DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  UNION ALL SELECT seq, coalesce(n, 0)::INT, k1x, k1y, k1z, coalesce(m, 0e0), len, true FROM {visits}_k LEFT JOIN (SELECT seq, max(t) AS m, count(*) AS n FROM {visits}_c GROUP BY seq) USING (seq))"""


def voxels_cte(p: MapParams = MapParams(), visits: str = "visits", voxels: str = "voxels", hit: str = "sample", where: str = "true") -> str:
    step = f"CASE WHEN b THEN least((a + {exprs.num(p.hit)}::FLOAT)::FLOAT, {exprs.num(p.high)}::FLOAT) ELSE greatest((a + {exprs.num(p.miss)}::FLOAT)::FLOAT, {exprs.num(p.low)}::FLOAT) END"
    # a reduction keeps one type: the state and the updates are both structs
    fold = f"list_reduce(list_prepend({{'v': 0::FLOAT, 'b': false}}, list({{'v': 0::FLOAT, 'b': {hit}}} ORDER BY seq, sample)), lambda x, y: {{'v': ({step.replace('(a +', '(x.v +').replace('WHEN b ', 'WHEN y.b ')})::FLOAT, 'b': y.b}}).v"
    return f"{voxels} AS (SELECT gx, gy, gz, {fold} AS occupancy, count(*) AS n_ops FROM {visits} WHERE {where} GROUP BY gx, gy, gz)"


def base(p: MapParams = MapParams(), where: str = "true") -> str:
    """WITH rays, visits, voxels."""
    return f"WITH {rays_cte(where)},\n{visits_cte(p)},\n{voxels_cte(p)}"
