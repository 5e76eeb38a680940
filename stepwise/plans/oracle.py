"""Reference SQL for the registered queries (DuckDB dialect).

Loops are unrolled into ``MATERIALIZED`` CTEs, one per superstep; the step
counts are those of the registered queries.  Extra unrolled steps leave a
converged result unchanged (empty workset / fixpoint).
"""

from __future__ import annotations

import math

# Fixed values of the jobs, written here a second time on purpose.
D = "0.85::DOUBLE"
DELTA_THRESHOLD = 0.1
EPSILON = 0.0001
LEARNING_RATE = 0.01

PR_LINKS = "SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem"
SINK_LINKS = "SELECT o_custkey AS src, o_orderkey AS dst FROM orders"
CC_EDGES = "SELECT l_orderkey AS src, 1000000 + l_partkey AS dst FROM lineitem"
POINTS = ("SELECT row_number() OVER () AS rid, l_quantity AS x, l_extendedprice / 1000.0 AS y "
          "FROM lineitem")
SAMPLES = "SELECT l_quantity / 50.0 AS x, l_extendedprice / 100000.0 AS y FROM lineitem"
ROW_IDS = "SELECT l_orderkey * 8 + l_linenumber AS id FROM lineitem"
CPU = ("SELECT event_type AS job, CAST(dayofyear(ts) AS INTEGER) AS iteration, "
       "CAST(((user_id % 8) + 8) % 8 AS VARCHAR) AS worker, value / 500.0 AS sample, ts "
       "FROM events")


def with_ctes(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def portable_round(sql: str, digits: int = 6) -> str:
    """Rewrite every ``round(expr, 6)`` as ``round(expr * 1e6) / 1e6``.

    Rounding a double to an integer is identical in Spark and DuckDB (half
    away from zero on the same double); rounding to decimals is not (Spark
    rounds the shortest decimal string, DuckDB the scaled binary value), so
    both sides round through the scaled form.
    """
    token, scale = "round(", f"{10 ** digits}.0"
    out, i = [], 0
    while True:
        j = sql.find(token, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        k, depth = j + len(token), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + len(token):k - 1]
        suffix = f", {digits}"
        if inner.endswith(suffix):
            expr = portable_round(inner[:-len(suffix)], digits)
            out.append(sql[i:j] + f"(round(({expr}) * {scale}) / {scale})")
        else:
            out.append(sql[i:j] + token + portable_round(inner, digits) + ")")
        i = k


# --- PageRank ---------------------------------------------------------------

def pr_base(links_sql: str, p: str = "") -> list[str]:
    return [
        f"{p}links AS MATERIALIZED ({links_sql})",
        f"{p}deg AS MATERIALIZED (SELECT src, CAST(count(*) AS DOUBLE) AS deg FROM {p}links GROUP BY src)",
        f"{p}np AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM "
        f"(SELECT src AS id FROM {p}links UNION SELECT dst AS id FROM {p}links) u)",
        f"{p}s0 AS MATERIALIZED (SELECT DISTINCT src AS id, 1.0::DOUBLE AS rank FROM {p}links)",
    ]


def pr_delta_steps(steps: int, threshold: float, p: str = "") -> list[str]:
    out = [f"{p}w0 AS MATERIALIZED (SELECT id, rank - 1.0::DOUBLE / (SELECT n FROM {p}np) AS delta FROM {p}s0)"]
    share = f"{D} * w.delta / d.deg"
    for i in range(1, steps + 1):
        out.append(
            f"{p}w{i} AS MATERIALIZED (SELECT l.dst AS id, sum({share}) AS delta "
            f"FROM {p}w{i-1} w JOIN {p}links l ON l.src = w.id JOIN {p}deg d ON d.src = l.src "
            f"GROUP BY l.dst HAVING abs(sum({share})) > {threshold!r})")
        out.append(
            f"{p}s{i} AS MATERIALIZED (SELECT s.id, CASE WHEN w.delta IS NULL THEN s.rank "
            f"ELSE s.rank + w.delta END AS rank FROM {p}s{i-1} s LEFT JOIN {p}w{i} w ON s.id = w.id)")
    return out


def pagerank_delta(links_sql: str = PR_LINKS, steps: int = 10,
                   threshold: float = DELTA_THRESHOLD) -> str:
    ctes = pr_base(links_sql) + pr_delta_steps(steps, threshold)
    return with_ctes(ctes, f"SELECT id, round(rank, 6) AS rank FROM s{steps}")


def _executed(i: int) -> str:
    """A step runs if its workset (the delta before) has rows."""
    return f"EXISTS (SELECT 1 FROM w{i-1})"


def pagerank_active(links_sql: str = PR_LINKS, steps: int = 10,
                    threshold: float = DELTA_THRESHOLD) -> str:
    ctes = pr_base(links_sql) + pr_delta_steps(steps, threshold)
    parts = [f"SELECT CAST({i} AS INTEGER) AS iteration, (SELECT count(*) FROM w{i}) AS active_pages "
             f"WHERE {_executed(i)}" for i in range(1, steps + 1)]
    return with_ctes(ctes, "\nUNION ALL\n".join(parts))


def _pagerank_counters(steps: int, solution_every: int = 5) -> list[tuple[str, int, str, str]]:
    """(operator, iteration, count, condition) of every counter of the delta loop."""
    out = [("initial", 0, "SELECT count(*) FROM w0", "true")]
    for i in range(1, steps + 1):
        shares = f"SELECT count(*) FROM w{i-1} w JOIN pairs p ON p.src = w.id"
        out += [("workset-in", i, f"SELECT count(*) FROM w{i-1}", _executed(i)),
                ("shares-out", i, shares, _executed(i)),
                ("delta", i, f"SELECT count(*) FROM w{i}", _executed(i))]
    return out


def pagerank_counters(links_sql: str = PR_LINKS, steps: int = 10, threshold: float = DELTA_THRESHOLD,
                      dump: bool = False) -> str:
    ctes = pr_base(links_sql) + pr_delta_steps(steps, threshold) + [
        "pairs AS MATERIALIZED (SELECT DISTINCT src, dst FROM links)"]
    full = {"initial": "pagerank-initial", "delta": "pagerank-delta"}
    parts = []
    for op, i, count, cond in _pagerank_counters(steps):
        name = full.get(op, op)
        cols = (f"'{name}-iter_{i}' AS name, ({count}) AS value" if dump else
                f"'{name}' AS operator, CAST({i} AS INTEGER) AS iteration, ({count}) AS rows")
        parts.append(f"SELECT {cols} WHERE {cond}")
    body = "\nUNION ALL\n".join(parts)
    return with_ctes(ctes, f"SELECT name, value FROM ({body}) t ORDER BY name" if dump else body)


def delta_totals(links_sql: str = PR_LINKS, steps: int = 10, threshold: float = DELTA_THRESHOLD) -> str:
    """Rows per step over all partitions; a partition without rows has no counter."""
    ctes = pr_base(links_sql) + pr_delta_steps(steps, threshold)
    parts = [f"SELECT 'pagerank-delta' AS operator, CAST({i} AS INTEGER) AS iteration, "
             f"(SELECT count(*) FROM w{i}) AS rows WHERE EXISTS (SELECT 1 FROM w{i})" for i in range(1, steps + 1)]
    return with_ctes(ctes, "\nUNION ALL\n".join(parts))


def threshold_sweep(links_sql: str, thresholds: list[float], steps: int) -> str:
    ctes, parts = [], []
    for k, t in enumerate(thresholds):
        p = f"t{k}_"
        ctes += pr_base(links_sql, p) + pr_delta_steps(steps, t, p)
        parts.append(f"SELECT {t!r}::DOUBLE AS threshold, id, round(rank, 6) AS rank FROM {p}s{steps}")
    return with_ctes(ctes, "\nUNION ALL\n".join(parts))


def pagerank_bulk(links_sql: str = PR_LINKS, steps: int = 10, eps: float = EPSILON) -> str:
    ctes = pr_base(links_sql)
    ctes[3] = "r0 AS MATERIALIZED (SELECT DISTINCT src AS id, 1.0::DOUBLE AS rank FROM links)"
    jump = f"(1.0::DOUBLE - {D}) / (SELECT n FROM np)"
    for i in range(1, steps + 1):
        ctes.append(
            f"r{i} AS MATERIALIZED (SELECT l.dst AS id, sum(r.rank / d.deg) * {D} + {jump} AS rank "
            f"FROM r{i-1} r JOIN links l ON l.src = r.id JOIN deg d ON d.src = l.src GROUP BY l.dst)")
        ctes.append(
            f"c{i} AS MATERIALIZED (SELECT {i} AS it, count(*) AS k FROM r{i} a JOIN r{i-1} b "
            f"ON a.id = b.id WHERE abs(a.rank - b.rank) > {eps!r})")
    counts = " UNION ALL ".join(f"SELECT it, k FROM c{i}" for i in range(1, steps + 1))
    ctes.append(f"stop AS MATERIALIZED (SELECT coalesce(min(it), {steps}) AS it FROM ({counts}) c WHERE k = 0)")
    parts = [f"SELECT id, round(rank, 6) AS rank FROM r{i} WHERE (SELECT it FROM stop) = {i}"
             for i in range(1, steps + 1)]
    return with_ctes(ctes, "\nUNION ALL\n".join(parts))


def adjacency(links_sql: str, rows: int) -> str:
    """Chunk = leading 32 bits of md5("<target>:<number among parallel links>"), modulo the chunks."""
    bits = "CAST('0x' || substr(md5(dst || ':' || copy), 1, 8) AS BIGINT)"
    return with_ctes(
        [f"links AS MATERIALIZED ({links_sql})",
         "each AS (SELECT src, dst, row_number() OVER (PARTITION BY src, dst) AS copy, "
         "count(*) OVER (PARTITION BY src) AS deg FROM links)"],
        f"SELECT src, {bits} % CAST(ceil(deg / {rows}.0) AS BIGINT) AS chunk, list_sort(list(dst)) AS neighbors "
        "FROM each GROUP BY ALL")


# --- single PageRank steps ---------------------------------------------------

def pr_one_step(body: str, delta: bool = False) -> str:
    ctes = pr_base(PR_LINKS)
    if delta:
        ctes += pr_delta_steps(1, DELTA_THRESHOLD)
    return with_ctes(ctes, body)


PAIRS = "(SELECT src, dst, count(*) AS w FROM links GROUP BY src, dst)"
PR_SHARES = pr_one_step(
    "SELECT l.dst AS id, round(s.rank / d.deg * l.w, 6) AS share FROM s0 s "
    f"JOIN {PAIRS} l ON l.src = s.id JOIN deg d ON d.src = l.src")
PR_SUM_CTE = ("sums AS MATERIALIZED (SELECT l.dst AS id, sum(s.rank / d.deg) AS rank FROM s0 s "
              "JOIN links l ON l.src = s.id JOIN deg d ON d.src = l.src GROUP BY l.dst)")
PR_SUM = with_ctes(pr_base(PR_LINKS) + [PR_SUM_CTE], "SELECT id, round(rank, 6) AS rank FROM sums")
PR_DAMPEN_CTE = (f"damp AS MATERIALIZED (SELECT id, rank * {D} + (1.0::DOUBLE - {D}) / "
                 "(SELECT n FROM np) AS rank FROM sums)")
PR_DAMPEN = with_ctes(pr_base(PR_LINKS) + [PR_SUM_CTE, PR_DAMPEN_CTE],
                      "SELECT id, round(rank, 6) AS rank FROM damp")
PR_CHANGED = with_ctes(
    pr_base(PR_LINKS) + [PR_SUM_CTE, PR_DAMPEN_CTE],
    f"SELECT a.id, round(a.rank, 6) AS rank, coalesce(abs(a.rank - b.rank) > {EPSILON!r}, false) AS changed "
    f"FROM damp a LEFT JOIN s0 b ON a.id = b.id")
PRD_SHARES = pr_one_step(
    f"SELECT l.dst AS id, round({D} * w.delta / d.deg * l.w, 6) AS share FROM w0 w "
    f"JOIN {PAIRS} l ON l.src = w.id JOIN deg d ON d.src = l.src", delta=True)
PRD_SUM_FILTER = pr_one_step("SELECT id, round(delta, 6) AS delta FROM w1", delta=True)
PRD_UPDATE = pr_one_step(
    "SELECT id, round(rank, 6) AS rank FROM s1", delta=True)


# --- connected components -----------------------------------------------------

def cc_base(edges_sql: str = CC_EDGES) -> list[str]:
    return [
        f"dir AS MATERIALIZED ({edges_sql})",
        "e AS MATERIALIZED (SELECT src, dst FROM dir UNION ALL SELECT dst AS src, src AS dst FROM dir)",
        "s0 AS MATERIALIZED (SELECT DISTINCT src AS v, src AS comp FROM e)",
    ]


def cc_steps(steps: int) -> list[str]:
    out = []
    for i in range(1, steps + 1):
        out.append(f"m{i} AS MATERIALIZED (SELECT e.dst AS v, min(s.comp) AS comp FROM s{i-1} s "
                   f"JOIN e ON e.src = s.v GROUP BY e.dst)")
        out.append(f"s{i} AS MATERIALIZED (SELECT s.v, CASE WHEN m.comp < s.comp THEN m.comp "
                   f"ELSE s.comp END AS comp FROM s{i-1} s LEFT JOIN m{i} m ON m.v = s.v)")
    return out


def components(steps: int = 20, edges_sql: str = CC_EDGES) -> str:
    return with_ctes(cc_base(edges_sql) + cc_steps(steps), f"SELECT v, comp FROM s{steps}")


def cc_delta_counters(steps: int = 20, edges_sql: str = CC_EDGES) -> str:
    """Rows in and out of the operators of the delta loop, executed steps only."""
    ctes = cc_base(edges_sql) + cc_steps(steps) + ["pairs AS MATERIALIZED (SELECT DISTINCT src, dst FROM e)"]
    ctes.append("w0 AS MATERIALIZED (SELECT v, comp FROM s0)")
    parts = ["SELECT 'components-initial' AS operator, CAST(0 AS INTEGER) AS iteration, count(*) AS rows FROM w0"]
    for i in range(1, steps + 1):
        ctes.append(f"w{i} AS MATERIALIZED (SELECT a.v, a.comp FROM s{i} a JOIN s{i-1} b ON a.v = b.v "
                    "WHERE a.comp < b.comp)")
        ctes.append(f"o{i} AS MATERIALIZED (SELECT p.dst AS v, w.comp FROM w{i-1} w JOIN pairs p ON p.src = w.v)")
        for op, what in (("workset-in", f"w{i-1}"), ("candidates-out", f"o{i}"),
                         ("minima-out", f"(SELECT DISTINCT v FROM o{i}) m"), ("components-delta", f"w{i}")):
            parts.append(f"SELECT '{op}' AS operator, CAST({i} AS INTEGER) AS iteration, "
                         f"(SELECT count(*) FROM {what}) AS rows WHERE EXISTS (SELECT 1 FROM w{i-1})")
    return with_ctes(ctes, "\nUNION ALL\n".join(parts))


CC_CANDIDATES = with_ctes(cc_base(), "SELECT e.dst AS v, s.comp FROM s0 s "
                          "JOIN (SELECT DISTINCT src, dst FROM e) e ON e.src = s.v")
CC_MIN = with_ctes(cc_base() + cc_steps(1), "SELECT v, comp FROM m1")
CC_DELTA = with_ctes(cc_base() + cc_steps(1),
                     "SELECT m.v, m.comp FROM m1 m JOIN s0 s ON m.v = s.v WHERE m.comp < s.comp")
CC_RELAX = with_ctes(cc_base() + cc_steps(1), "SELECT s1.v, s1.comp, s1.comp < s0.comp AS changed "
                     "FROM s1 JOIN s0 ON s0.v = s1.v")
CC_UPDATE = with_ctes(cc_base() + cc_steps(1), "SELECT v, comp FROM s1")


MANY_CENTERS = ("SELECT c_custkey AS id, c_custkey % 50 + 0.5::DOUBLE AS x, c_custkey % 97 + 0.25::DOUBLE AS y "
                "FROM customer")


# --- k-means -----------------------------------------------------------------

def km_base(centers: list[tuple[int, float, float]] | str) -> list[str]:
    if isinstance(centers, str):
        return [f"pts AS MATERIALIZED ({POINTS})", f"c0 AS MATERIALIZED ({centers})"]
    vals = ", ".join(f"({i}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for i, x, y in centers)
    return [f"pts AS MATERIALIZED ({POINTS})",
            f"c0 AS MATERIALIZED (SELECT * FROM (VALUES {vals}) v(id, x, y))"]


def _dist(p: str, c: str) -> str:
    return f"sqrt(({p}.x - {c}.x) * ({p}.x - {c}.x) + ({p}.y - {c}.y) * ({p}.y - {c}.y))"


def km_steps(steps: int) -> list[str]:
    out = []
    for i in range(1, steps + 1):
        out.append(
            f"a{i} AS MATERIALIZED (SELECT p.rid, p.x, p.y, "
            f"min({{'d': {_dist('p', 'c')}, 'id': c.id}}).id AS cid FROM pts p, c{i-1} c "
            f"GROUP BY p.rid, p.x, p.y)")
        out.append(f"c{i} AS MATERIALIZED (SELECT cid AS id, sum(x) / count(*) AS x, "
                   f"sum(y) / count(*) AS y FROM a{i} GROUP BY cid)")
    return out


def km_assignment(centers, steps: int) -> str:
    ctes = km_base(centers) + km_steps(steps)
    ctes.append(f"fin AS MATERIALIZED (SELECT p.rid, p.x, p.y, "
                f"min({{'d': {_dist('p', 'c')}, 'id': c.id}}).id AS cluster FROM pts p, c{steps} c "
                f"GROUP BY p.rid, p.x, p.y)")
    return with_ctes(ctes, "SELECT x, y, CAST(cluster AS INTEGER) AS cluster FROM fin")


def km_centers(centers, steps: int) -> str:
    return with_ctes(km_base(centers) + km_steps(steps),
                     f"SELECT CAST(id AS INTEGER) AS id, round(x, 6) AS x, round(y, 6) AS y FROM c{steps}")


def km_distance(centers) -> str:
    return with_ctes(km_base(centers),
                     f"SELECT p.x, p.y, round(min({_dist('p', 'c')}), 6) AS distance "
                     f"FROM pts p, c0 c GROUP BY p.rid, p.x, p.y")


def km_assign(centers) -> str:
    return with_ctes(km_base(centers) + km_steps(1),
                     "SELECT x, y, CAST(cid AS INTEGER) AS cluster FROM a1")


def km_sums(centers) -> str:
    return with_ctes(km_base(centers) + km_steps(1),
                     "SELECT CAST(cid AS INTEGER) AS id, round(sum(x), 6) AS sum_x, round(sum(y), 6) AS sum_y, "
                     "count(*) AS n FROM a1 GROUP BY cid")


def km_means(centers) -> str:
    return km_centers(centers, 1)


# --- linear regression --------------------------------------------------------

def _lr_update(p: str, s: str = "s") -> tuple[str, str]:
    err = f"(({p}.theta0 + {p}.theta1 * {s}.x) - {s}.y)"
    r = f"{LEARNING_RATE!r}::DOUBLE"
    return (f"{p}.theta0 - {r} * {err}", f"{p}.theta1 - {r} * ({err} * {s}.x)")


def lr_base(start: tuple[float, float]) -> list[str]:
    return [f"smp AS MATERIALIZED ({SAMPLES})",
            f"p0 AS MATERIALIZED (SELECT {start[0]!r}::DOUBLE AS theta0, {start[1]!r}::DOUBLE AS theta1)"]


def lr_steps(steps: int) -> list[str]:
    out = []
    for i in range(1, steps + 1):
        t0, t1 = _lr_update("p")
        out.append(f"p{i} AS MATERIALIZED (SELECT sum({t0}) / count(*) AS theta0, "
                   f"sum({t1}) / count(*) AS theta1 FROM smp s, p{i-1} p)")
    return out


def linreg(start, steps: int) -> str:
    return with_ctes(lr_base(start) + lr_steps(steps),
                     f"SELECT round(theta0, 6) AS theta0, round(theta1, 6) AS theta1 FROM p{steps}")


def lr_step(start) -> str:
    t0, t1 = _lr_update("p")
    return with_ctes(lr_base(start),
                     f"SELECT round({t0}, 6) AS theta0, round({t1}, 6) AS theta1 FROM smp s, p0 p")


def lr_sums(start) -> str:
    t0, t1 = _lr_update("p")
    return with_ctes(lr_base(start),
                     f"SELECT round(sum({t0}), 6) AS sum_t0, round(sum({t1}), 6) AS sum_t1, "
                     f"count(*) AS n FROM smp s, p0 p")


# --- generators -----------------------------------------------------------------

def _bits_sql(id_expr: str, salt: str, start: int) -> str:
    return (f"CAST(CAST(('0x' || substr(md5('{salt}' || ':' || CAST({id_expr} AS VARCHAR)), {start}, 13)) "
            f"AS BIGINT) AS DOUBLE) / {float(2 ** 52)!r}")


def uniform_sql(id_expr: str, salt: str) -> str:
    return _bits_sql(id_expr, salt, 1)


def gaussian_sql(id_expr: str, salt: str) -> str:
    u1 = f"(1.0::DOUBLE - {_bits_sql(id_expr, salt, 1)})"
    u2 = _bits_sql(id_expr, salt, 14)
    return f"(sqrt(-2.0::DOUBLE * ln({u1})) * cos({2.0 * math.pi!r}::DOUBLE * {u2}))"


def gen_centers(ids_sql: str, salt: str, value_range: float = 100.0) -> str:
    half = value_range / 2.0
    return (f"SELECT CAST(id AS INTEGER) AS id, "
            f"round({uniform_sql('id', salt + 'x')} * {value_range!r} - {half!r}, 6) AS x, "
            f"round({uniform_sql('id', salt + 'y')} * {value_range!r} - {half!r}, 6) AS y "
            f"FROM ({ids_sql}) t")


def gen_points(ids_sql: str, means_ids_sql: str, weight_sql: str, sd: float = 8.0,
               means_salt: str = "centers", value_range: float = 100.0,
               salt: str = "points") -> str:
    """Points around means with the given ids 0 .. k-1 and weights (an expression over id)."""
    half = value_range / 2.0
    means = (f"SELECT id, {uniform_sql('id', means_salt + 'x')} * {value_range!r} - {half!r} AS x, "
             f"{uniform_sql('id', means_salt + 'y')} * {value_range!r} - {half!r} AS y, {weight_sql} AS weight "
             f"FROM ({means_ids_sql}) r")
    return with_ctes(
        [f"m AS MATERIALIZED ({means})",
         "b AS MATERIALIZED (SELECT *, (sum(weight) OVER (ORDER BY id) - weight) / (SELECT sum(weight) FROM m)::DOUBLE "
         "AS lo, sum(weight) OVER (ORDER BY id) / (SELECT sum(weight) FROM m)::DOUBLE AS hi FROM m)",
         f"p AS MATERIALIZED (SELECT id, {uniform_sql('id', salt + 'c')} AS u FROM ({ids_sql}) t)"],
        f"SELECT p.id, round({gaussian_sql('p.id', salt + 'x')} * {sd!r} + b.x, 6) AS x, "
        f"round({gaussian_sql('p.id', salt + 'y')} * {sd!r} + b.y, 6) AS y "
        "FROM p JOIN b ON p.u >= b.lo AND p.u < b.hi")


def gen_samples(ids_sql: str, salt: str = "samples") -> str:
    x = gaussian_sql("id", salt + "x")
    return (f"SELECT id, round({x}, 6) AS x, "
            f"round(2.0::DOUBLE * {x} + 0.01::DOUBLE * {gaussian_sql('id', salt + 'y')}, 6) AS y "
            f"FROM ({ids_sql}) t")


def gen_uniform(ids_sql: str, salt: str = "u") -> str:
    return f"SELECT id, round({uniform_sql('id', salt)}, 6) AS u FROM ({ids_sql}) t"
