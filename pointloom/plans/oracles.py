"""SQL of the registered queries, put together from common table expressions."""

from __future__ import annotations

EMB = "SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label AS classification FROM embeddings"
ORD = "SELECT o_orderkey AS point_id, o_totalprice / 1000.0 AS x, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) / 10.0 AS y, CAST(o_custkey % 1000 AS DOUBLE) / 10.0 AS z FROM orders"
LINE = "SELECT l_orderkey AS point_id, l_quantity AS x, l_extendedprice / 1000.0 AS y, l_discount * 100.0 AS z, CAST(l_partkey % 65536 AS INTEGER) AS intensity, l_linenumber AS classification, CAST(l_suppkey * 7919 % 65536 AS INTEGER) AS r, CAST(l_suppkey * 104729 % 65536 AS INTEGER) AS g, CAST(l_suppkey * 1299709 % 65536 AS INTEGER) AS b FROM lineitem"
PICKS = "SELECT event_id, user_id AS session, ts, value AS x, CAST(minute(ts) AS DOUBLE) AS y, CAST(user_id AS DOUBLE) AS z FROM events WHERE event_type = 'click'"
POINTS = {"emb": EMB, "ord": ORD, "line": LINE, "picks": PICKS}


def points(name: str) -> str:
    return f"pts AS ({POINTS[name]})"


CUBE = "cube AS (SELECT min(x) AS cx, min(y) AS cy, min(z) AS cz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS edge FROM pts)"


def cell(axis: str, cells: int) -> str:
    return f"CAST(least(greatest(floor(({axis} - c{axis}) / edge * {cells}.0), 0), {cells - 1}) AS BIGINT)"


def spread(v: str) -> str:
    return f"CAST(list_sum(list_transform(range(21), lambda i: (({v} // (CAST(1 AS BIGINT) << i)) % 2) * (CAST(1 AS BIGINT) << (3 * i)))) AS BIGINT)"


CODES = (
    f"q AS (SELECT pts.*, cx, cy, cz, edge, {cell('x', 1 << 21)} AS qx, {cell('y', 1 << 21)} AS qy, {cell('z', 1 << 21)} AS qz FROM pts, cube), "
    f"coded AS (SELECT q.*, 4 * {spread('qx')} + 2 * {spread('qy')} + {spread('qz')} AS morton FROM q)"
)


def digits(code: str, n: int = 21) -> str:
    """Octal digits of a code of n digits, from the most significant."""
    return f"array_to_string(list_transform(range({n}), lambda i: CAST(({code} // (CAST(1 AS BIGINT) << (3 * ({n - 1} - i)))) % 8 AS VARCHAR)), '')"


def base(name: str) -> str:
    return f"{points(name)}, {CUBE}, {CODES}"


def chunks(level: int, cap: str) -> str:
    """cap: an SQL expression over cnt.total."""
    return (
        f"cnt AS (SELECT count(*) AS total FROM pts), fine AS (SELECT morton // (CAST(1 AS BIGINT) << {3 * (21 - level)}) AS finest, count(*) AS n FROM coded GROUP BY 1), "
        f"lv AS (SELECT finest, n, unnest(range({level + 1})) AS level FROM fine), ab AS (SELECT *, finest // (CAST(1 AS BIGINT) << (3 * ({level} - level))) AS above FROM lv), "
        f"tot AS (SELECT level, above, CAST(sum(n) AS BIGINT) AS total FROM ab GROUP BY 1, 2), "
        f"fit AS (SELECT ab.finest, min(ab.level) AS level FROM ab JOIN tot USING (level, above), cnt WHERE tot.total <= {cap} OR ab.level = {level} GROUP BY 1), "
        f"plan AS (SELECT fit.finest, fit.level, 'r' || substr({digits('fit.finest', level)}, 1, CAST(fit.level AS INTEGER)) AS chunk FROM fit), "
        f"chunked AS (SELECT coded.*, 'r' || {digits('coded.morton')} AS whole, plan.chunk, plan.level AS chunk_level FROM coded JOIN plan ON coded.morton // (CAST(1 AS BIGINT) << {3 * (21 - level)}) = plan.finest)"
    )


def leaves(cap: int) -> str:
    return (
        "deep AS (SELECT point_id, chunk_level, whole, unnest(range(CAST(chunk_level AS INTEGER), CAST(least(chunk_level + 20, 21) AS INTEGER) + 1)) AS level FROM chunked), "
        "held AS (SELECT *, count(*) OVER (PARTITION BY level, substr(whole, 1, CAST(level AS INTEGER) + 1)) AS n FROM deep), "
        f"leafed AS (SELECT point_id, whole, min(level) AS leaf_level FROM held WHERE n <= {cap} OR level = least(chunk_level + 20, 21) GROUP BY 1, 2), "
        "leaf AS (SELECT substr(whole, 1, CAST(leaf_level AS INTEGER) + 1) AS node, leaf_level AS level, count(*) AS num_points FROM leafed GROUP BY 1, 2), "
        "anc AS (SELECT substr(node, 1, CAST(k AS INTEGER)) AS name, node, num_points FROM (SELECT node, num_points, unnest(range(1, length(node) + 1)) AS k FROM leaf)), "
        "nodes AS (SELECT name AS node, CAST(length(name) - 1 AS INTEGER) AS level, max(CASE WHEN name = node THEN 1 ELSE 0 END) AS is_leaf, CAST(sum(num_points) AS BIGINT) AS subtree_points FROM anc GROUP BY name)"
    )


def boxes(grid: int) -> str:
    """boxed: nodes with their cubes, from the digits of their names."""
    axis = lambda bit: f"CAST(list_sum(list_transform(range(1, length(node)), lambda i: ((CAST(substr(node, CAST(i AS INTEGER) + 1, 1) AS INTEGER) // {bit}) % 2) * power(2.0, length(node) - 1 - i))) AS DOUBLE)"
    return (
        "nb AS (SELECT nodes.*, edge / power(2.0, length(node) - 1) AS e, cx, cy, cz FROM nodes, cube), "
        f"boxed AS (SELECT node, level, is_leaf, subtree_points, cx + coalesce({axis(4)}, 0) * e AS min_x, cy + coalesce({axis(2)}, 0) * e AS min_y, cz + coalesce({axis(1)}, 0) * e AS min_z, "
        f"cx + coalesce({axis(4)}, 0) * e + e AS max_x, cy + coalesce({axis(2)}, 0) * e + e AS max_y, cz + coalesce({axis(1)}, 0) * e + e AS max_z, e / {grid} AS spacing FROM nb)"
    )


def frustum(planes: list[tuple[float, float, float, float]]) -> str:
    parts = []
    for a, b, c, d in planes:
        far = " + ".join(f"{'max' if v >= 0 else 'min'}_{axis} * CAST({v!r} AS DOUBLE)" for axis, v in zip("xyz", (a, b, c), strict=True))
        parts.append(f"({far} + CAST({d!r} AS DOUBLE) >= 0)")
    return " AND ".join(parts)


def screen_error(position: tuple[float, float, float], factor: float) -> str:
    d2 = " + ".join(f"power((min_{a} + max_{a}) / 2 - {p!r}, 2)" for a, p in zip("xyz", position, strict=True))
    return f"(spacing * CAST({factor!r} AS DOUBLE) / sqrt({d2}))"


def clip(m, row: int) -> str:
    return "(" + " + ".join([f"{a} * CAST({float(m[row, k])!r} AS DOUBLE)" for k, a in enumerate("xyz")]) + f" + CAST({float(m[row, 3])!r} AS DOUBLE))"
