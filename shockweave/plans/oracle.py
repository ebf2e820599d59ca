"""DuckDB SQL for every registered query, over the driver tables.

Each statement is a chain of common table expressions; a query names the last
one it needs and everything before it is prepended.
"""

from __future__ import annotations

from shockweave.plans.fixtures import BASE_YEAR, HAZARD_OF_PRIORITY, MIN_YEARS, USER_SECTORS, YEARS

# Stated here, not taken from the queries: delivered part of covered needs,
# controls of runs to the settled state, map bounds, smallest change of a link that counts.
GAMMA = 0.5
SETTLED_GAMMA, SETTLED_TOL, SETTLED_ITERATIONS = 0.05, 1e-4, 200
#: A^k is added up to k = 2^POWERS - 1.
POWERS = 9
BOUNDS = (5.0, 40.0, 950.0, 1500.0)
MOVED = {"a": "1e-9", "z": "1e-3"}


def money(c: str, digits: int = 2, name: str | None = None) -> str:
    """An amount in decimals, where halves are round numbers on both sides."""
    return f"CAST(round(CAST({c} AS DECIMAL(32, 5)), {digits}) AS DOUBLE) AS {name or c.split('.')[-1]}"


def rate(c: str, digits: int = 8, name: str | None = None) -> str:
    return f"round({c}, {digits}) + 0.0 AS {name or c.split('.')[-1]}"


def plain(c: str, name: str | None = None) -> str:
    return rate(c, 4, name)


def ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN {num} / {den} ELSE 0.0 END"


def _ctes() -> list[tuple[str, str]]:
    """Named building blocks in dependency order."""
    c: list[tuple[str, str]] = []

    def add(name: str, sql: str) -> None:
        c.append((name, sql))

    add("fx_lines", """
        SELECT CAST(year(o.o_orderdate) AS INTEGER) AS time_period,
               sn.n_name AS c_orig, p.p_type AS ptype, p.p_brand AS brand, cn.n_name AS c_dest, cn.n_nationkey AS dest_key, c.c_custkey AS custkey,
               CASE c.c_mktsegment
                 WHEN 'HOUSEHOLD' THEN 'HH' WHEN 'BUILDING' THEN 'CF' WHEN 'AUTOMOBILE' THEN 'GOV'
                 ELSE CASE c.c_custkey % 6
                        WHEN 0 THEN 'P_ECONOMY' WHEN 1 THEN 'P_LARGE' WHEN 2 THEN 'P_MEDIUM'
                        WHEN 3 THEN 'P_PROMO' WHEN 4 THEN 'P_SMALL' ELSE 'P_STANDARD' END
               END AS ind_use,
               o.o_orderpriority AS priority, l.l_returnflag AS returnflag,
               l.l_extendedprice AS price, l.l_extendedprice * (1 - l.l_discount) AS net_price,
               l.l_extendedprice * l.l_tax AS tax_amount, l.l_quantity * p.p_retailprice AS volume
        FROM lineitem l
        JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN part p ON p.p_partkey = l.l_partkey
        JOIN supplier s ON s.s_suppkey = l.l_suppkey
        JOIN nation sn ON sn.n_nationkey = s.s_nationkey
        JOIN customer c ON c.c_custkey = o.o_custkey
        JOIN nation cn ON cn.n_nationkey = c.c_nationkey""")
    add("fx_flow", """
        SELECT time_period, c_orig, concat('P_', ptype) AS ind_ava, c_dest, ind_use, SUM(net_price) AS value
        FROM fx_lines GROUP BY ALL
        UNION ALL
        SELECT time_period, c_orig, 'LAB', c_orig, concat('P_', ptype), SUM(tax_amount)
        FROM fx_lines GROUP BY time_period, c_orig, concat('P_', ptype)""")
    hazards = ", ".join(
        f"SUM(CASE WHEN returnflag = 'R' AND priority = '{p}' THEN price ELSE 0 END) AS {h}"
        for h, p in HAZARD_OF_PRIORITY.items()
    )
    add("fx_loss_type", f"SELECT c_dest AS ISO2, {hazards} FROM fx_lines GROUP BY c_dest")
    years = ", ".join(
        f"SUM(CASE WHEN returnflag = 'R' AND time_period = {y} THEN price ELSE 0 END) AS y{y}" for y in YEARS
    )
    add("fx_loss_year", f"SELECT c_dest AS ISO2, {years} FROM fx_lines GROUP BY c_dest")
    add("fx_output_cells", f"""
        SELECT c_dest AS geo, time_period AS year, 'CP_MEUR' AS unit, SUM(price) AS value
        FROM fx_lines WHERE NOT (dest_key % 7 = 3 AND time_period = 1995) GROUP BY c_dest, time_period
        UNION ALL
        SELECT c_dest, time_period, 'CLV20_MEUR', SUM(volume) FROM fx_lines
        WHERE NOT (dest_key % 7 = 3 AND time_period = 1995) AND NOT (dest_key % 5 = 0 AND time_period = {BASE_YEAR})
        GROUP BY c_dest, time_period""")
    add("fx_code_dim", """
        SELECT DISTINCT
          CASE WHEN p_type IN ('SMALL', 'PROMO') THEN '  ' ELSE concat(' ', p_type, ' ') END AS code63,
          concat('Detailed ', p_type) AS des63, p_type AS code11, concat('Broad ', p_type, ' ') AS des11
        FROM part""")
    add("fx_country_dim", """
        SELECT n_name AS code, concat('C', CAST(n_nationkey AS VARCHAR)) AS iso3,
               concat('Country ', CAST(n_nationkey AS VARCHAR)) AS name
        FROM nation WHERE n_nationkey < 20""")
    add("fx_emp_intensity", """
        SELECT concat('P_', p_type) AS sector, AVG(p_size) / 1000000.0 AS emp_per_output
        FROM part GROUP BY concat('P_', p_type)""")
    add("fx_scenarios", """
        SELECT * FROM (VALUES
          ('S0', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE)),
          ('S1', 'NATION_3', NULL, 10.0, 0.0), ('S2', 'NATION_7', 'P_SMALL', 5.0, 0.0),
          ('S3', NULL, 'P_PROMO', 2.5, 0.0), ('S4', NULL, NULL, 0.0, 4.0)
        ) AS t(scenario_id, country, sector, supply_pct, demand_pct)""")
    # network
    add("net_flow", "SELECT * FROM fx_flow WHERE time_period = (SELECT max(time_period) FROM fx_flow)")
    add("accounts", """
        SELECT c_orig AS country, ind_ava AS sector FROM net_flow WHERE starts_with(ind_ava, 'P_')
        UNION SELECT c_dest, ind_use FROM net_flow WHERE starts_with(ind_use, 'P_')""")
    add("ids", """
        SELECT CAST(row_number() OVER (ORDER BY country, sector) - 1 AS INTEGER) AS node,
               concat(country, '::', sector) AS label, country, sector,
               CAST(dense_rank() OVER (ORDER BY sector) - 1 AS INTEGER) AS globsec
        FROM accounts""")
    add("raw_edges", """
        SELECT a.node AS i, b.node AS j, a.globsec, SUM(f.value) AS z
        FROM net_flow f
        JOIN ids a ON a.country = f.c_orig AND a.sector = f.ind_ava
        JOIN ids b ON b.country = f.c_dest AND b.sector = f.ind_use
        WHERE starts_with(f.ind_ava, 'P_') AND starts_with(f.ind_use, 'P_')
        GROUP BY a.node, b.node, a.globsec""")
    add("nodes", """
        SELECT n.*, coalesce(d.fd, 0.0) AS fd, coalesce(r.z, 0.0) AS z_row, coalesce(k.z, 0.0) AS z_col,
               coalesce(r.z, 0.0) + coalesce(d.fd, 0.0) AS x
        FROM ids n
        LEFT JOIN (SELECT c_orig, ind_ava, SUM(value) AS fd FROM net_flow
                   WHERE starts_with(ind_ava, 'P_') AND ind_use IN ('HH', 'GOV', 'CF', 'WRL_REST')
                   GROUP BY c_orig, ind_ava) d ON d.c_orig = n.country AND d.ind_ava = n.sector
        LEFT JOIN (SELECT i, SUM(z) AS z FROM raw_edges GROUP BY i) r ON r.i = n.node
        LEFT JOIN (SELECT j, SUM(z) AS z FROM raw_edges GROUP BY j) k ON k.j = n.node""")
    add("edges", """
        SELECT e.i, e.j, e.globsec, e.z, CASE WHEN n.x <> 0 THEN e.z / n.x ELSE 0.0 END AS a
        FROM raw_edges e JOIN nodes n ON n.node = e.j""")
    add("tech", "SELECT globsec, j, SUM(a) AS ag FROM edges GROUP BY globsec, j")
    add("shocks", """
        SELECT s.scenario_id, n.node, n.label,
          CASE WHEN (s.country IS NULL OR s.country = n.country) AND (s.sector IS NULL OR s.sector = n.sector)
               THEN s.demand_pct / 100.0 ELSE 0.0 END AS sd,
          CASE WHEN (s.country IS NULL OR s.country = n.country) AND (s.sector IS NULL OR s.sector = n.sector)
               THEN s.supply_pct / 100.0 ELSE 0.0 END AS sp
        FROM fx_scenarios s CROSS JOIN nodes n""")
    add("start", """
        SELECT s.scenario_id, n.node, n.label, n.country, n.sector, n.globsec, n.x AS x0, n.fd AS fd0, n.z_row,
               n.z_col AS z_col0, s.sd, s.sp, n.x * (1 - s.sp) AS cap, n.fd * (1 - s.sd) AS fd
        FROM shocks s JOIN nodes n ON n.node = s.node""")
    add("state", "SELECT *, x0 * (1 - sd) AS xdem FROM start")
    c.extend(_step("", "state"))
    c.extend(_requirements())
    c.extend(_settled("c_", "start"))
    # larger network: sector = type x brand
    add("pairs", """
        SELECT pair, row_number() OVER (ORDER BY pair) - 1 AS k
        FROM (SELECT DISTINCT concat(p_type, '_', p_brand) AS pair FROM part)""")
    add("detail_flow", f"""
        SELECT l.c_orig, concat('P_', l.ptype, '_', l.brand) AS ind_ava, l.c_dest,
               CASE WHEN starts_with(l.ind_use, 'P_') THEN coalesce('P_' || p.pair, l.ind_use) ELSE l.ind_use END AS ind_use,
               l.net_price AS value
        FROM fx_lines l LEFT JOIN pairs p ON p.k = l.custkey % 150 WHERE l.time_period = (SELECT max(time_period) FROM fx_lines)""")
    add("detail_sums", """
        SELECT country, sector, SUM(fd) AS fd, SUM(z_row) AS z_row, SUM(z_col) AS z_col FROM (
          SELECT c_orig AS country, ind_ava AS sector, CASE WHEN ind_use IN ('HH', 'GOV', 'CF', 'WRL_REST') THEN value ELSE 0 END AS fd,
                 CASE WHEN starts_with(ind_use, 'P_') THEN value ELSE 0 END AS z_row, 0 AS z_col FROM detail_flow
          UNION ALL
          SELECT c_dest, ind_use, 0, 0, value FROM detail_flow WHERE starts_with(ind_use, 'P_'))
        GROUP BY country, sector""")
    # output and calibration
    add("series", """
        SELECT geo, year, max(CASE WHEN unit = 'CP_MEUR' THEN value END) AS cp,
               max(CASE WHEN unit = 'CLV20_MEUR' THEN value END) AS clv
        FROM fx_output_cells GROUP BY geo, year""")
    add("pooled", """
        SELECT year, SUM(cp) / SUM(clv) AS d_pool FROM series WHERE cp IS NOT NULL AND clv IS NOT NULL GROUP BY year""")
    add("output", f"""
        SELECT * FROM (
          SELECT s.geo, s.year, s.cp, s.clv, l.price_level, p.d_pool,
                 coalesce(s.clv * l.price_level, s.cp * (b.d_base / p.d_pool)) AS output_mn_eur,
                 (s.clv * l.price_level) IS NULL AS used_pooled_deflator
          FROM series s
          LEFT JOIN (SELECT geo, cp / clv AS price_level FROM series WHERE year = {BASE_YEAR}) l ON l.geo = s.geo
          LEFT JOIN pooled p ON p.year = s.year
          CROSS JOIN (SELECT max(d_pool) AS d_base FROM pooled WHERE year = {BASE_YEAR}) b
        ) WHERE output_mn_eur IS NOT NULL""")
    total = " + ".join(HAZARD_OF_PRIORITY)
    add("shares", " UNION ALL ".join(
        f"SELECT ISO2, '{h}' AS hazard, {ratio(h, f'({total})')} AS omega FROM fx_loss_type" for h in HAZARD_OF_PRIORITY
    ))
    add("annual", " UNION ALL ".join(
        f"SELECT ISO2, CAST({y} AS INTEGER) AS year, y{y} AS loss_total FROM fx_loss_year" for y in YEARS
    ))
    add("panel", f"""
        SELECT a.ISO2, a.year, s.hazard, a.loss_total * s.omega AS loss_hazard, o.output_mn_eur,
               {ratio('a.loss_total * s.omega', 'o.output_mn_eur')} AS intensity
        FROM annual a LEFT JOIN shares s ON s.ISO2 = a.ISO2
        JOIN output o ON o.geo = a.ISO2 AND o.year = a.year""")
    levels = {"moderate": 0.50, "severe": 0.75, "extreme": 0.90, "very_extreme": 0.95}
    cont = ", ".join(f"quantile_cont(intensity, {q}) AS {n}" for n, q in levels.items())
    add("percentiles", f"""
        SELECT ISO2, hazard, {cont} FROM panel WHERE hazard IS NOT NULL
        GROUP BY ISO2, hazard HAVING count(intensity) >= {MIN_YEARS}""")
    add("grid", """
        SELECT concat(n.n_name, '|', h.hazard, '|', l.level) AS scenario_id, n.n_name AS ISO2, h.hazard, l.level
        FROM nation n CROSS JOIN (VALUES """ + ", ".join(f"('{h}')" for h in HAZARD_OF_PRIORITY) + """) AS h(hazard)
        CROSS JOIN (VALUES """ + ", ".join(f"('{n}')" for n in levels) + """) AS l(level)""")
    add("scalars_long", " UNION ALL ".join(
        f"SELECT ISO2, hazard, '{n}' AS level, {n} AS value FROM percentiles" for n in levels
    ))
    add("scalars", """
        SELECT g.*, least(CASE WHEN s.value < 0 THEN 0.0 ELSE coalesce(s.value, 0.0) END, 0.5) AS scalar
        FROM grid g LEFT JOIN scalars_long s ON s.ISO2 = g.ISO2 AND s.hazard = g.hazard AND s.level = g.level""")
    add("decoder", """
        SELECT sector, min(sector_name) AS sector_name FROM (
          SELECT concat('P_', trim(code63)) AS sector, trim(des63) AS sector_name FROM fx_code_dim WHERE length(trim(code63)) > 0
        ) GROUP BY sector
        UNION ALL
        SELECT sector, min(sector_name) FROM (
          SELECT concat('P_', trim(code11)) AS sector, trim(des11) AS sector_name FROM fx_code_dim WHERE length(trim(code11)) > 0
        ) WHERE sector NOT IN (SELECT concat('P_', trim(code63)) FROM fx_code_dim WHERE length(trim(code63)) > 0)
        GROUP BY sector""")
    # impact
    add("impacts", """
        SELECT s.scenario_id, s.node, s.label, s.country, s.sector,
               s.x0 AS X_baseline, s.xs AS X_final, s.x0 - s.xs AS loss_abs,
               s.x0 - s.z_col0 AS VA_baseline, greatest(s.xs - s.z_col, 0.0) AS VA_final,
               (s.x0 - s.z_col0) - greatest(s.xs - s.z_col, 0.0) AS VA_loss_abs,
               e.emp_per_output * s.x0 AS EMP_baseline,
               e.emp_per_output * s.x0 * (CASE WHEN s.x0 > 0 THEN s.xs / s.x0 ELSE 0.0 END) AS EMP_final,
               e.emp_per_output * s.x0 - e.emp_per_output * s.x0 * (CASE WHEN s.x0 > 0 THEN s.xs / s.x0 ELSE 0.0 END) AS EMP_loss_abs
        FROM c_stepped s JOIN fx_emp_intensity e ON e.sector = s.sector""")
    sums = ", ".join(f"SUM({m}) AS {m}" for m in MEASURE_SUMS)
    add("by_country", f"SELECT scenario_id, country, {sums} FROM impacts GROUP BY scenario_id, country")
    add("by_sector", f"""
        SELECT i.scenario_id, i.sector, coalesce(d.sector_name, i.sector) AS sector_name, {sums}
        FROM impacts i LEFT JOIN decoder d ON d.sector = i.sector GROUP BY ALL""")
    for metric, base, after in (
        ("a", "CASE WHEN u.x0 <> 0 THEN e.z0 / u.x0 ELSE 0.0 END", "CASE WHEN u.xs <> 0 THEN e.z1 / u.xs ELSE 0.0 END"),
        ("z", "e.z0", "e.z1"),
    ):
        add(f"changes_{metric}", f"""
            SELECT q.scenario_id, q.i, q.j, ni.label AS i_label, nj.label AS j_label, q.baseline, q.final, q.delta,
                   CASE WHEN q.baseline <> 0 THEN q.delta / q.baseline ELSE 0.0 END AS delta_rel
            FROM (SELECT *, CASE WHEN abs(final - baseline) > {MOVED[metric]} THEN final - baseline ELSE 0.0 END AS delta
                  FROM (SELECT e.scenario_id, e.i, e.j, {base} AS baseline, {after} AS final
                        FROM c_new_edges e JOIN c_stepped u ON u.scenario_id = e.scenario_id AND u.node = e.j)) q
            JOIN ids ni ON ni.node = q.i JOIN ids nj ON nj.node = q.j WHERE q.delta <> 0""")
    add("links", "SELECT * FROM changes_a")
    for agg, src, dst, measure in (
        ("sector", "split_part(i_label, '::', 2)", "split_part(j_label, '::', 2)", "delta"),
        ("country", "split_part(i_label, '::', 1)", "split_part(j_label, '::', 1)", "delta"),
        ("country_pct", "split_part(i_label, '::', 1)", "split_part(j_label, '::', 1)", "delta_rel"),
        ("node", "i_label", "j_label", "delta"),
        ("node_pct", "i_label", "j_label", "delta_rel"),
    ):
        add(f"cells_{agg}", f"""
            SELECT scenario_id, {src} AS src, {dst} AS dst, SUM({measure}) AS value
            FROM links GROUP BY scenario_id, {src}, {dst}""")
        c.extend(_heat(f"cells_{agg}"))
    add("cells_trade", """
        SELECT 0 AS scenario_id, c_orig AS src, c_dest AS dst,
               SUM(CASE WHEN returnflag = 'R' THEN -price ELSE net_price END) AS value
        FROM fx_lines GROUP BY c_orig, c_dest""")
    c.extend(_heat("cells_trade"))
    add("cells_detail", """
        SELECT 0 AS scenario_id, concat(c_orig, '::', brand) AS src, concat(c_dest, '::', ind_use) AS dst,
               SUM(CASE WHEN returnflag = 'R' THEN -price ELSE net_price END) AS value
        FROM fx_lines GROUP BY ALL""")
    c.extend(_heat("cells_detail"))
    add("brands", """
        SELECT *, loss_pct - avg(loss_pct) OVER () AS loss_pct_deviation FROM (
          SELECT concat(c_orig, '::', brand) AS sector_label, SUM(CASE WHEN returnflag = 'R' THEN price ELSE 0 END) AS loss_abs,
                 round(100.0 * SUM(CASE WHEN returnflag = 'R' THEN price ELSE 0 END) / SUM(price), 6) + 0.0 AS loss_pct
          FROM fx_lines GROUP BY ALL)""")
    add("country_rounded", f"SELECT *, {pct('loss_abs', 'X_baseline')} AS loss_pct FROM by_country")
    add("country_dev", """
        SELECT *, loss_pct - avg(loss_pct) OVER (PARTITION BY scenario_id) AS loss_pct_deviation FROM country_rounded""")
    add("sector_dev", f"""
        SELECT *, loss_pct - avg(loss_pct) OVER (PARTITION BY scenario_id) AS loss_pct_deviation FROM (
          SELECT scenario_id, sector_name AS sector_label, round({pct('loss_abs', 'X_baseline')}, 6) + 0.0 AS loss_pct
          FROM by_sector)""")
    add("labelled", """
        SELECT c_custkey, CASE c_custkey % 11 WHEN 1 THEN concat(c_name, '::A::B') WHEN 2 THEN concat(c_name, ':: ')
               WHEN 3 THEN c_name ELSE concat(c_name, '::', c_mktsegment) END AS label FROM customer""")
    # sweep over every country, hazard and level
    add("sweep", """
        SELECT g.scenario_id, n.node, n.globsec, n.x AS x0, n.fd AS fd0, n.z_row, n.z_col AS z_col0, 0.0 AS sd,
               CASE WHEN n.country = g.ISO2 THEN g.scalar ELSE 0.0 END AS sp,
               n.x * (1 - CASE WHEN n.country = g.ISO2 THEN g.scalar ELSE 0.0 END) AS cap, n.fd AS fd, n.x AS xdem
        FROM scalars g CROSS JOIN nodes n""")
    c.extend(_step("sweep_", "sweep"))
    # two iterations with eight rounds each
    add("k1_guess", "SELECT *, x0 AS xdem0 FROM start")
    add("k1_r0", """
        SELECT g.scenario_id, g.node, g.fd - g.xdem0 + coalesce(p.v, 0.0) AS v FROM k1_guess g
        LEFT JOIN (SELECT g.scenario_id, e.i, SUM(e.a * g.xdem0) AS v FROM edges e JOIN k1_guess g ON g.node = e.j
                   GROUP BY g.scenario_id, e.i) p ON p.scenario_id = g.scenario_id AND p.i = g.node""")
    c.extend(_rounds("k1_r", 8))
    add("k1_state", """
        SELECT g.* EXCLUDE (xdem0), g.xdem0 + r.v AS xdem FROM k1_guess g
        JOIN k1_r8 r ON r.scenario_id = g.scenario_id AND r.node = g.node""")
    c.extend(_step("k1_", "k1_state"))
    add("k1_gap", "SELECT scenario_id, SUM(abs(fd_next - fd)) / (SUM(abs(fd)) + 1e-12) AS gap FROM k1_stepped GROUP BY scenario_id")
    add("k2_r0", """
        SELECT s.scenario_id, s.node, s.fd_next - s.fd AS v FROM k1_stepped s
        JOIN k1_gap g ON g.scenario_id = s.scenario_id WHERE g.gap >= 1e-9""")
    c.extend(_rounds("k2_r", 8))
    add("k2_state", """
        SELECT s.scenario_id, s.node, s.label, s.country, s.sector, s.globsec, s.x0, s.fd0, s.z_row, s.z_col0, s.sd, s.sp, s.cap,
               s.fd_next AS fd, s.xdem + r.v AS xdem
        FROM k1_stepped s JOIN k2_r8 r ON r.scenario_id = s.scenario_id AND r.node = s.node""")
    c.extend(_step("k2_", "k2_state"))
    add("k2_gap", "SELECT scenario_id, SUM(abs(fd_next - fd)) / (SUM(abs(fd)) + 1e-12) AS gap FROM k2_stepped GROUP BY scenario_id")
    add("k2_final", """
        SELECT s.*, CAST(1 AS INTEGER) AS iterations, true AS converged FROM k1_stepped s
        JOIN k1_gap g ON g.scenario_id = s.scenario_id WHERE g.gap < 1e-9
        UNION ALL
        SELECT s.*, CAST(2 AS INTEGER), g.gap < 1e-9 FROM k2_stepped s JOIN k2_gap g ON g.scenario_id = s.scenario_id""")
    c.extend(_settled("w_", "sweep"))
    add("d_r0", "SELECT scenario_id, node, fd AS v FROM start")
    c.extend(_rounds("d_r", 30))
    return c


MEASURE_SUMS = (
    "X_baseline", "X_final", "loss_abs", "VA_baseline", "VA_final", "VA_loss_abs",
    "EMP_baseline", "EMP_final", "EMP_loss_abs",
)


def pct(lost: str, base: str) -> str:
    return f"CASE WHEN {base} > 0 THEN 100.0 * {lost} / {base} ELSE 0.0 END"


def _rounds(prefix: str, steps: int) -> list[tuple[str, str]]:
    """``prefix<k> = prefix0 + A prefix<k-1>``."""
    return [
        (
            f"{prefix}{k}",
            f"""SELECT s.scenario_id, s.node, s.v + coalesce(p.v, 0.0) AS v FROM {prefix}0 s
            LEFT JOIN (SELECT x.scenario_id, e.i, SUM(e.a * x.v) AS v FROM edges e JOIN {prefix}{k - 1} x ON x.node = e.j
                       GROUP BY x.scenario_id, e.i) p ON p.scenario_id = s.scenario_id AND p.i = s.node""",
        )
        for k in range(1, steps + 1)
    ]


def _requirements() -> list[tuple[str, str]]:
    """``requirements``: output of ``i`` that a unit of final demand for ``j`` takes, all rounds together.

    The sum of A^k by doubling: (I + A)(I + A^2)(I + A^4)...
    """
    product = "SELECT p.i, q.j, SUM(p.v * q.v) AS v FROM {0} p JOIN {1} q ON q.i = p.j GROUP BY p.i, q.j"
    c = [
        ("req_p0", "SELECT i, j, a AS v FROM edges WHERE a <> 0"),
        ("req_l0", """SELECT i, j, SUM(v) AS v FROM (SELECT node AS i, node AS j, CAST(1.0 AS DOUBLE) AS v FROM ids
            UNION ALL SELECT i, j, v FROM req_p0) GROUP BY i, j"""),
    ]
    for k in range(1, POWERS):
        c.append((f"req_p{k}", product.format(f"req_p{k - 1}", f"req_p{k - 1}")))
        more = product.format(f"req_p{k}", f"req_l{k - 1}")
        c.append((f"req_l{k}", f"SELECT i, j, SUM(v) AS v FROM (SELECT * FROM req_l{k - 1} UNION ALL {more}) GROUP BY i, j"))
    c.append(("requirements", f"SELECT * FROM req_l{POWERS - 1}"))
    return c


def _settled(p: str, start: str) -> list[tuple[str, str]]:
    """Steps from ``start`` until each scenario settles: ``<p>rec`` holds all of them, ``<p>stepped`` the last.

    A scenario whose demand moved by less than the tolerance takes no further step.
    """
    step = [(n, sql) for n, sql in _step("q_", "q_state", SETTLED_GAMMA) if n != "q_new_edges"]
    inner = [
        ("q_open", f"""SELECT scenario_id, node, iteration + 1 AS iteration, fd_next AS fd FROM {p}rec
            WHERE gap >= {SETTLED_TOL} AND iteration < {SETTLED_ITERATIONS}"""),
        ("q_need", """SELECT o.scenario_id, r.i AS node, SUM(r.v * o.fd) AS xdem FROM q_open o
            JOIN requirements r ON r.j = o.node GROUP BY o.scenario_id, r.i"""),
        ("q_state", f"""SELECT b.* EXCLUDE (fd{', xdem' if start == 'sweep' else ''}), o.fd, o.iteration, n.xdem FROM {start} b
            JOIN q_open o ON o.scenario_id = b.scenario_id AND o.node = b.node
            JOIN q_need n ON n.scenario_id = b.scenario_id AND n.node = b.node"""),
        *step,
        ("q_gap", "SELECT scenario_id, SUM(abs(fd_next - fd)) / (SUM(abs(fd)) + 1e-12) AS gap FROM q_stepped GROUP BY scenario_id"),
    ]
    chain = ", ".join(f"{n} AS MATERIALIZED ({sql})" for n, sql in inner)
    xdem = ", xdem" if start == "sweep" else ""
    return [
        (f"{p}rec", f"""
            SELECT scenario_id, node, CAST(0 AS INTEGER) AS iteration, fd, fd AS fd_next, fd AS fd_implied, fd AS xs,
                   CAST(1e300 AS DOUBLE) AS gap FROM {start}
            UNION ALL
            (WITH {chain} SELECT q.scenario_id, q.node, q.iteration, q.fd, q.fd_next, q.fd_implied, q.xs, g.gap
             FROM q_stepped q JOIN q_gap g ON g.scenario_id = q.scenario_id)"""),
        (f"{p}taken", f"SELECT * FROM {p}rec WHERE iteration > 0"),
        (f"{p}end", f"""SELECT scenario_id, iteration AS iterations, gap < {SETTLED_TOL} AS converged FROM {p}taken
            GROUP BY scenario_id, iteration, gap QUALIFY iteration = max(iteration) OVER (PARTITION BY scenario_id)"""),
        (f"{p}need", f"""SELECT t.scenario_id, r.i AS node, SUM(r.v * t.fd) AS xdem FROM {p}taken t
            JOIN {p}end e ON e.scenario_id = t.scenario_id AND e.iterations = t.iteration
            JOIN requirements r ON r.j = t.node GROUP BY t.scenario_id, r.i"""),
        (f"{p}state", f"""SELECT b.* EXCLUDE (fd{xdem}), t.fd, n.xdem, e.iterations, e.converged FROM {start} b
            JOIN {p}end e ON e.scenario_id = b.scenario_id
            JOIN {p}taken t ON t.scenario_id = b.scenario_id AND t.node = b.node AND t.iteration = e.iterations
            JOIN {p}need n ON n.scenario_id = b.scenario_id AND n.node = b.node"""),
        *_step(p, f"{p}state", SETTLED_GAMMA),
    ]


def _step(p: str, state: str, gamma: float = GAMMA) -> list[tuple[str, str]]:
    """One propagation step from ``state``; the result is ``<p>stepped``."""
    return [
        (f"{p}rationed", f"SELECT *, CASE WHEN xdem > 0 THEN least(1.0, (1 - sp) * (x0 / xdem)) ELSE 1.0 END AS r FROM {state}"),
        (f"{p}worst", f"""SELECT t.scenario_id, e.j, min(t.r) AS s FROM edges e JOIN {p}rationed t ON t.node = e.i
            WHERE e.a > 0 GROUP BY t.scenario_id, e.j"""),
        (f"{p}factored", f"""SELECT t.*, coalesce(w.s, 1.0) AS s, least(coalesce(w.s, 1.0), 1 - t.sp) AS row_factor,
              greatest(t.z_row * (1 - t.sp - least(coalesce(w.s, 1.0), 1 - t.sp)) + (t.fd0 * (1 - t.sp) - t.fd), 0.0) AS inv
            FROM {p}rationed t LEFT JOIN {p}worst w ON w.scenario_id = t.scenario_id AND w.j = t.node"""),
        (f"{p}flows", f"""SELECT *, least(con, need) AS base
            FROM (SELECT f.scenario_id, e.i, e.j, e.globsec, e.z, e.a, e.z * f.row_factor AS con, e.z * coalesce(u.xdem / nullif(u.x0, 0), 0.0) AS need,
                         greatest(e.z * (coalesce(u.xdem / nullif(u.x0, 0), 0.0) - f.row_factor), 0.0) AS unmet
                  FROM edges e JOIN {p}factored f ON f.node = e.i
                  JOIN {p}factored u ON u.scenario_id = f.scenario_id AND u.node = e.j)"""),
        (f"{p}inputs", f"""SELECT scenario_id, globsec, j, SUM(base) AS base, SUM(unmet) AS unmet, SUM(a) AS ag
            FROM {p}flows GROUP BY scenario_id, globsec, j"""),
        (f"{p}balance", f"""SELECT *, {gamma} * sub AS frac FROM (
              SELECT v.scenario_id, v.globsec, v.inv_total, coalesce(u.unmet_total, 0.0) AS unmet_total,
                     CASE WHEN coalesce(u.unmet_total, 0.0) > 0 THEN least(1.0, v.inv_total / u.unmet_total) ELSE 0.0 END AS sub
              FROM (SELECT scenario_id, globsec, SUM(inv) AS inv_total FROM {p}factored GROUP BY scenario_id, globsec) v
              LEFT JOIN (SELECT scenario_id, globsec, SUM(unmet) AS unmet_total FROM {p}inputs GROUP BY scenario_id, globsec) u
                ON u.scenario_id = v.scenario_id AND u.globsec = v.globsec)"""),
        (f"{p}supply", f"""SELECT n.*, b.frac * n.unmet AS delivered, n.base + b.frac * n.unmet AS zg
            FROM {p}inputs n JOIN {p}balance b ON b.scenario_id = n.scenario_id AND b.globsec = n.globsec"""),
        (f"{p}shared", f"""SELECT f.*, b.frac, b.inv_total, b.unmet_total, {ratio('f.inv', 'b.inv_total')} AS inv_share
            FROM {p}factored f JOIN {p}balance b ON b.scenario_id = f.scenario_id AND b.globsec = f.globsec"""),
        (f"{p}new_edges", f"""SELECT scenario_id, i, j, SUM(z0) AS z0, SUM(z1) AS z1 FROM (
              SELECT scenario_id, i, j, z AS z0, base AS z1 FROM {p}flows
              UNION ALL
              SELECT h.scenario_id, h.node, u.j, 0.0, h.inv_share * u.delivered
              FROM {p}shared h JOIN {p}supply u ON u.scenario_id = h.scenario_id AND u.globsec = h.globsec
              WHERE h.inv_share * h.frac > 0 AND u.delivered > 0) GROUP BY scenario_id, i, j"""),
        (f"{p}stepped", f"""
            SELECT *, least(fd, fd_implied) AS fd_next FROM (
              SELECT *, greatest(xs - z_new_row, 0.0) AS fd_implied FROM (
                SELECT *, least(xl, xg) AS xs FROM (
                  SELECT h.*, coalesce(b.base_row, 0.0) + h.inv_share * h.frac * h.unmet_total AS z_new_row,
                         h.fd + coalesce(b.base_row, 0.0) + h.inv_share * h.frac * h.unmet_total AS xl,
                         coalesce(g.xg, h.fd + coalesce(b.base_row, 0.0) + h.inv_share * h.frac * h.unmet_total) AS xg,
                         coalesce(g.z_col, 0.0) AS z_col
                  FROM {p}shared h
                  LEFT JOIN (SELECT scenario_id, i, SUM(base) AS base_row FROM {p}flows GROUP BY scenario_id, i) b
                    ON b.scenario_id = h.scenario_id AND b.i = h.node
                  LEFT JOIN (SELECT scenario_id, j, min(CASE WHEN ag > 0 THEN zg / ag END) AS xg, SUM(zg) AS z_col
                             FROM {p}supply GROUP BY scenario_id, j) g
                    ON g.scenario_id = h.scenario_id AND g.j = h.node)))"""),
    ]


def _heat(cells: str) -> list[tuple[str, str]]:
    """Intensity and clipping over the full grid, zero cells included."""
    return [
        (f"{cells}_ranked", f"""
            SELECT scenario_id, a, row_number() OVER (PARTITION BY scenario_id ORDER BY a) - 1 AS pos,
                   count(*) OVER (PARTITION BY scenario_id) AS n
            FROM (SELECT g.scenario_id, abs(coalesce(c.value, 0.0)) AS a
                  FROM (SELECT r.scenario_id, r.src, k.dst
                        FROM (SELECT DISTINCT scenario_id, src FROM {cells}) r
                        JOIN (SELECT DISTINCT scenario_id, dst FROM {cells}) k ON k.scenario_id = r.scenario_id) g
                  LEFT JOIN {cells} c ON c.scenario_id = g.scenario_id AND c.src = g.src AND c.dst = g.dst)"""),
        (f"{cells}_limits", f"""
            SELECT scenario_id, max(CASE WHEN pos = round_even((n - 1) * CAST(0.95 AS DOUBLE), 0) THEN a END) AS cap,
                   max(CASE WHEN pos = round_even((n - 1) * CAST(0.98 AS DOUBLE), 0) THEN a END) AS clip_limit
            FROM {cells}_ranked GROUP BY scenario_id"""),
        (f"{cells}_heat", f"""
            SELECT c.*, CASE WHEN l.cap > 0 THEN least(abs(c.value) / l.cap, 1.0) ELSE 0.0 END AS intensity, l.clip_limit,
                   CASE WHEN l.clip_limit > 0 THEN least(greatest(c.value, -l.clip_limit), l.clip_limit) ELSE c.value END AS clipped
            FROM {cells} c JOIN {cells}_limits l ON l.scenario_id = c.scenario_id"""),
    ]


def _select(columns: list[str], source: str, rest: str = "") -> str:
    return f"SELECT {', '.join(columns)} FROM {source} {rest}".strip()


def _finals() -> dict[str, str]:
    """Last SELECT of every query."""
    q: dict[str, str] = {}
    s, lab = "scenario_id", "label"

    q["latest_period_flows"] = _select(
        ["time_period", "c_orig", "ind_ava", "c_dest", "ind_use", plain("value")], "fx_flow",
        "WHERE time_period = (SELECT max(time_period) FROM fx_flow)")
    q["compact_flow_pairs"] = _select(
        ["c_orig", "ind_ava", "c_dest", "ind_use", plain("SUM(value)", "value")], "fx_flow",
        "GROUP BY c_orig, ind_ava, c_dest, ind_use")
    q["node_table"] = "SELECT * FROM ids"
    q["edge_table"] = _select(["i", "j", "globsec", plain("z")], "raw_edges")
    q["final_demand_output"] = _select([lab, plain("fd"), plain("z_row"), plain("z_col"), plain("x")], "nodes")
    q["detailed_network_output"] = f"""
        SELECT CAST(row_number() OVER (ORDER BY country, sector) - 1 AS INTEGER) AS node, concat(country, '::', sector) AS label,
               CAST(dense_rank() OVER (ORDER BY sector) - 1 AS INTEGER) AS globsec,
               {plain('fd')}, {plain('z_row')}, {plain('z_col')}, {plain('z_row + fd', 'x')} FROM detail_sums"""
    q["network_sanity"] = f"""
        SELECT n.n_nodes, e.n_edges,
          CASE WHEN e.n_edges = n.n_nodes * n.n_nodes THEN e.z ELSE least(e.z, 0.0) END + 0.0 AS min_z,
          CASE WHEN e.n_edges = n.n_nodes * n.n_nodes THEN e.a ELSE least(e.a, 0.0) END + 0.0 AS min_a,
          {plain('n.min_fd')}, {plain('n.min_x')}, {money('e.total_z')}, {money('n.total_fd')}, {money('n.total_x')},
          {rate('n.gap', 2, 'accounting_gap')}
        FROM (SELECT CAST(count(*) AS INTEGER) AS n_nodes, min(fd) AS min_fd, min(x) AS min_x, SUM(fd) AS total_fd,
                     SUM(x) AS total_x, SUM(abs(x - (fd + coalesce(w.z, 0.0)))) AS gap
              FROM nodes LEFT JOIN (SELECT i, SUM(z) AS z FROM raw_edges GROUP BY i) w ON w.i = nodes.node) n
        CROSS JOIN (SELECT CAST(count(*) AS INTEGER) AS n_edges, min(z) AS z, min(a) AS a, SUM(z) AS total_z FROM edges) e"""
    q["coefficients"] = f"""SELECT a.label AS i_label, b.label AS j_label, {rate('e.a')}
        FROM edges e JOIN ids a ON a.node = e.i JOIN ids b ON b.node = e.j"""
    off = "a.country = 'NATION_1' AND b.country = 'NATION_2'"
    q["coefficients_share"] = f"""SELECT a.label AS i_label, b.label AS j_label,
          {rate(f'CASE WHEN {off} THEN e.a * 1.01 ELSE e.a END', 8, 'a')}, {rate('e.a', 8, 't')}
        FROM edges e JOIN ids a ON a.node = e.i JOIN ids b ON b.node = e.j"""
    q["coefficient_check"] = f"""SELECT e.i, e.j, {rate('e.a * 1.01', 8, 'share')}, {rate('e.a', 8, 'derived')},
          {rate('abs(e.a * 1.01 - e.a)', 8, 'gap')}
        FROM edges e JOIN ids a ON a.node = e.i JOIN ids b ON b.node = e.j WHERE {off} AND abs(e.a * 1.01 - e.a) > 1e-6"""
    q["flows_from_catalog"] = _select(
        ["c_orig", "ind_ava", "c_dest", "ind_use", plain("SUM(value)", "value")], "net_flow",
        "GROUP BY c_orig, ind_ava, c_dest, ind_use")
    q["decoder_from_catalog"] = "SELECT * FROM decoder"
    q["global_technology"] = _select(["globsec", "j", rate("ag")], "tech")
    q["sector_decoder"] = "SELECT * FROM decoder WHERE sector IN (SELECT sector FROM accounts)"
    q["node_names"] = """SELECT concat(a.country, '::', a.sector) AS label, coalesce(d.sector_name, a.sector) AS sector_name,
          coalesce(c.iso3, a.country) AS iso3, coalesce(c.name, a.country) AS country_name
        FROM accounts a LEFT JOIN decoder d ON d.sector = a.sector LEFT JOIN fx_country_dim c ON c.code = a.country"""
    q["country_decode"] = """SELECT concat(' ', lower(n.n_name), ' ') AS country, coalesce(c.iso3, n.n_name) AS iso3,
          coalesce(c.name, n.n_name) AS country_name FROM nation n LEFT JOIN fx_country_dim c ON c.code = n.n_name"""
    q["country_selection"] = f"SELECT * FROM ({q['country_decode']}) WHERE iso3 IN ('C1', 'C4', 'C19', 'NATION_22')"
    year_list = ", ".join(f"({y})" for y in YEARS)
    grid = f"""(SELECT DISTINCT geo FROM fx_output_cells) g CROSS JOIN (VALUES ('CP_MEUR'), ('CLV20_MEUR')) AS u(unit)
        CROSS JOIN (VALUES {year_list}) AS y(year)"""
    dense = f"""SELECT g.geo, u.unit, CAST(y.year AS INTEGER) AS year, {plain('c.value')} FROM {grid}
        LEFT JOIN fx_output_cells c ON c.geo = g.geo AND c.unit = u.unit AND c.year = y.year"""
    q["cube_jsonstat_long"] = dense
    q["cube_sdmx_long"] = _select(["geo", "unit", "year", plain("value")], "fx_output_cells")
    q["cube_dispatch"] = f"""SELECT * FROM ({dense}) WHERE geo IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)
        UNION ALL SELECT * FROM ({q['cube_sdmx_long']}) WHERE geo IN (SELECT n_name FROM nation WHERE n_nationkey % 2 <> 0)"""
    q["cube_quarantine"] = """SELECT r_name AS payload_id, CASE WHEN r_regionkey % 2 = 0 THEN 'source reported: timeout'
        ELSE 'unrecognised layout, keys: status' END AS problem FROM region"""
    q["constant_price_output"] = _select(
        ["geo", "year", plain("cp", "cp_mn_eur"), plain("clv", "clv20_mn_eur"), rate("price_level"), money("output_mn_eur"),
         rate("d_pool"), "used_pooled_deflator"], "output")
    # The pooled deflator covers the selected countries only.
    q["constant_price_output_from_cubes"] = f"""
        WITH chosen AS (SELECT s.* FROM series s WHERE s.geo IN (SELECT code FROM fx_country_dim)),
        pool AS (SELECT year, SUM(cp) / SUM(clv) AS d FROM chosen WHERE cp IS NOT NULL AND clv IS NOT NULL GROUP BY year)
        SELECT s.geo, s.year, {money('coalesce(s.clv * l.price_level, s.cp * (b.d / p.d))', 2, 'output_mn_eur')},
               (s.clv * l.price_level) IS NULL AS used_pooled_deflator
        FROM chosen s
        LEFT JOIN (SELECT geo, cp / clv AS price_level FROM chosen WHERE year = {BASE_YEAR}) l ON l.geo = s.geo
        LEFT JOIN pool p ON p.year = s.year
        CROSS JOIN (SELECT max(d) AS d FROM pool WHERE year = {BASE_YEAR}) b
        WHERE coalesce(s.clv * l.price_level, s.cp * (b.d / p.d)) IS NOT NULL"""
    q["fallback_report"] = """SELECT CAST(count(*) AS INTEGER) AS rows_on_fallback,
        string_agg(DISTINCT geo, ',' ORDER BY geo) AS geos_on_fallback FROM output WHERE used_pooled_deflator"""
    q["output_series_export"] = _select(["geo", "year", money("output_mn_eur")], "output")
    q["hazard_shares"] = _select(["ISO2", "hazard", rate("omega")], "shares")
    q["annual_losses"] = _select(["ISO2", "year", plain("loss_total")], "annual")
    q["intensity_panel"] = _select(
        ["ISO2", "year", "hazard", money("loss_hazard"), money("output_mn_eur"), rate("intensity", 10)], "panel")
    q["intensity_panel_years"] = _select(
        ["ISO2", "year", "hazard", rate("intensity", 10)], "panel", "WHERE year IN (1996, 1999)")
    levels = ("moderate", "severe", "extreme", "very_extreme")
    q["percentile_table"] = _select(["ISO2", "hazard", *[rate(n, 10) for n in levels]], "percentiles")
    q["percentiles_kept"] = q["percentile_table"]
    q["losses_from_files"] = q["intensity_panel"]
    q["scenario_grid"] = "SELECT * FROM grid"
    q["shock_scalars"] = _select(
        [s, "ISO2", "hazard", "level", rate("least(scalar, 0.06)", 10, "scalar")], "scalars")
    q["hazard_catalog"] = "SELECT DISTINCT hazard FROM percentiles WHERE length(trim(hazard)) > 0 ORDER BY hazard"
    order = " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(levels, 1))
    q["level_order"] = f"SELECT DISTINCT level, CAST(CASE level {order} END AS INTEGER) AS level_order FROM scalars_long WHERE value > 0"
    q["sector_catalog"] = """SELECT DISTINCT sector FROM (
        SELECT c_orig AS country, ind_ava AS sector FROM fx_flow WHERE starts_with(ind_ava, 'P_')
        UNION ALL SELECT c_dest, ind_use FROM fx_flow WHERE starts_with(ind_use, 'P_')) WHERE country = 'NATION_3'"""
    q["targeted_shocks"] = f"""
        SELECT t.scenario_id, n.label, {rate('''CASE t.scenario_id
              WHEN 'T1' THEN CASE WHEN n.country = 'NATION_3' THEN 0.05 ELSE 0.0 END
              WHEN 'T2' THEN CASE WHEN n.sector = 'P_LARGE' THEN 0.025 ELSE 0.0 END
              WHEN 'T3' THEN CASE WHEN n.country = 'NATION_9' AND n.sector = 'P_MEDIUM' THEN 0.01 ELSE 0.0 END
              WHEN 'T4' THEN CASE WHEN n.country = 'NATION_5' THEN 1.0 ELSE 0.0 END ELSE 0.0 END::DOUBLE''', 8, 'sd')},
            {rate('''CASE t.scenario_id
              WHEN 'T0' THEN 0.1
              WHEN 'T1' THEN CASE WHEN n.country = 'NATION_3' AND n.sector IN ('P_SMALL', 'P_PROMO') THEN 0.1 ELSE 0.0 END
              WHEN 'T2' THEN CASE WHEN n.country = 'NATION_3' AND n.sector = 'P_LARGE' THEN 0.125 ELSE 0.0 END
              WHEN 'T3' THEN CASE WHEN n.country IN ('NATION_1', 'NATION_2') THEN 0.3 ELSE 0.0 END ELSE 0.0 END::DOUBLE''', 8, 'sp')}
        FROM ids n CROSS JOIN (VALUES ('T0'), ('T1'), ('T2'), ('T3'), ('T4')) AS t(scenario_id)"""
    q["flat_shocks"] = f"""SELECT g.scenario_id, n.label, CAST(0.0 AS DOUBLE) AS sd,
        {rate('CASE WHEN n.country = g.ISO2 THEN g.scalar ELSE 0.0 END', 10, 'sp')}
        FROM scalars g CROSS JOIN ids n"""
    q["initial_state"] = _select([s, lab, money("cap"), money("fd"), money("xdem")], "state")
    q["rationing"] = _select([s, lab, rate("r")], "rationed")
    q["bottleneck"] = _select([s, lab, rate("s"), rate("row_factor")], "factored")
    q["inventory"] = _select([s, lab, money("inv")], "factored")
    q["flow_balance"] = _select([s, "i", "j", *[money(x) for x in ("con", "need", "base", "unmet")]], "flows")
    q["substitution"] = _select(
        [s, "globsec", money("inv_total"), money("unmet_total"), rate("sub"), rate("frac")], "balance")
    q["sector_deliveries"] = _select(
        [s, "globsec", "j AS node", rate("ag"), money("delivered"), money("zg")], "supply")
    q["global_feasibility"] = _select([s, lab, money("xl"), money("xg"), money("z_col")], "stepped")
    amounts = ("cap", "fd", "inv", "z_new_row", "xl", "xg", "xs", "fd_implied", "fd_next")
    q["first_step_state"] = _select(
        [s, lab, rate("r"), rate("s"), rate("inv_share"), *[money(x) for x in amounts]], "stepped")
    q["reallocated_edges"] = _select([s, "i", "j", plain("z0"), money("z1")], "new_edges")
    q["step_totals"] = f"""SELECT n.scenario_id, {money('e.tot_con', 1)}, {money('e.tot_need', 1)}, {money('n.tot_new', 1)},
        {money('n.tot_inv', 1)}, {money('e.tot_unmet', 1)}
        FROM (SELECT scenario_id, SUM(z_new_row) AS tot_new, SUM(inv) AS tot_inv FROM stepped GROUP BY scenario_id) n
        JOIN (SELECT scenario_id, SUM(con) AS tot_con, SUM(need) AS tot_need, SUM(unmet) AS tot_unmet FROM flows
              GROUP BY scenario_id) e ON e.scenario_id = n.scenario_id"""
    q["demand_output_k30"] = f"""SELECT d.scenario_id, n.label, {money('d.v', 2, 'xdem')}
        FROM d_r30 d JOIN ids n ON n.node = d.node"""
    q["feasible_state_k2"] = _select(
        [s, lab, "iterations", "converged", *[money(x) for x in ("xdem", "xs", "xl", "xg", "fd_next", "fd_implied")]], "k2_final")
    q["demand_output"] = f"""SELECT t.scenario_id, n.label, {money('t.xdem', 1)} FROM
        (SELECT b.scenario_id, r.i AS node, SUM(r.v * b.fd) AS xdem FROM start b JOIN requirements r ON r.j = b.node GROUP BY b.scenario_id, r.i) t
        JOIN ids n ON n.node = t.node"""
    q["gap_per_iteration"] = f"SELECT DISTINCT scenario_id, iteration, {rate('gap', 9)} FROM c_taken"
    q["feasible_state_converged"] = _select(
        [s, lab, "iterations", "converged", *[money(x, 1) for x in ("xdem", "xs", "xl", "xg", "fd_next", "fd_implied")]], "c_stepped")
    q["history_settled"] = f"""SELECT t.scenario_id, t.iteration, n.label, {money('t.fd', 1)}, {money('t.fd_implied', 1)}, {money('t.xs', 1)}
        FROM c_taken t JOIN ids n ON n.node = t.node"""
    hist = [money("fd"), money("fd_implied"), money("xs")]
    q["history_k2"] = (
        _select([s, "CAST(1 AS INTEGER) AS iteration", lab, *hist], "k1_stepped")
        + " UNION ALL "
        + _select([s, "CAST(2 AS INTEGER) AS iteration", lab, *hist], "k2_stepped"))
    q["demand_diagnostics"] = _select(
        [s, "iterations", "converged", money("SUM(fd0)", 1, "fd_baseline"), money("SUM(fd_next)", 1, "fd_final"),
         money("SUM(fd_implied)", 1, "fd_implied"), money("max(fd_next - fd_implied)", 1, "max_unmet"),
         money("max(fd_implied - fd_next)", 1, "max_slack")], "c_stepped", "GROUP BY scenario_id, iterations, converged")
    q["calibrated_sweep"] = _select(
        [s, "iterations", "converged", money("SUM(x0 - xs)", 0, "loss_abs"), rate("100.0 * SUM(x0 - xs) / SUM(x0)", 6, "loss_pct")],
        "w_stepped", "GROUP BY scenario_id, iterations, converged")

    def measures(prefix: str, digits: int = 1) -> list[str]:
        lost = "loss_abs" if prefix == "X" else f"{prefix}_loss_abs"
        share = "loss_pct" if prefix == "X" else f"{prefix}_loss_pct"
        return [money(f"{prefix}_baseline", digits), money(f"{prefix}_final", digits), money(lost, digits),
                rate(pct(lost, f"{prefix}_baseline"), 6, share)]

    every = [*measures("X"), *measures("VA"), *measures("EMP")]
    q["node_impact"] = _select([s, lab, "country", "sector", *measures("X")], "impacts")
    q["node_impact_csv"] = _select([s, lab, *measures("X")], "impacts")
    q["value_added"] = _select([s, lab, *measures("VA")], "impacts")
    q["employment"] = _select([s, lab, *measures("EMP")], "impacts")
    q["country_impact"] = _select([s, "country", *every], "by_country")
    q["sector_impact"] = _select([s, "sector", "sector_name", *every], "by_sector")
    totals = []
    for m in ("X", "VA", "EMP"):
        b, f = f"SUM({m}_baseline)", f"SUM({m}_final)"
        totals += [money(b, 0, f"{m}_baseline_total"), money(f, 0, f"{m}_final_total"),
                   money(f"({b} - {f})", 0, f"{m}_loss_abs_total"),
                   rate(f"100.0 * ({b} - {f}) / ({b} + 1e-12)", 6, f"{m}_loss_pct_total")]
    q["totals"] = f"""SELECT i.*, {money('d.v', 0, 'FD_post_total')}
        FROM (SELECT scenario_id, {', '.join(totals)} FROM impacts GROUP BY scenario_id) i
        JOIN (SELECT scenario_id, SUM(fd_next) AS v FROM c_stepped GROUP BY scenario_id) d ON d.scenario_id = i.scenario_id"""
    link = [s, "i_label", "j_label"]
    coeff = [rate(x) for x in ("baseline", "final", "delta")] + [rate("delta_rel", 5)]
    flow = [money(x, 1) for x in ("baseline", "final", "delta")] + [rate("delta_rel", 5)]
    q["linkage_deltas_a"] = _select([*link, *coeff], "changes_a")
    q["linkage_deltas_z"] = _select([*link, *flow], "changes_z")

    def top(source: str, direction: str, k: int) -> str:
        return f"""(SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scenario_id ORDER BY delta {direction}, i, j) AS INTEGER)
            AS rank FROM {source}) WHERE rank <= {k})"""

    q["links_weakened"] = q["links_weakened_min_baseline_a"] = _select(["rank", *link, *coeff], top("changes_a", "ASC", 25))
    q["links_strengthened"] = _select(["rank", *link, *coeff], top("changes_a", "DESC", 25))
    kept = "CASE WHEN baseline >= 20000.0 THEN {0} ELSE 0.0 END AS {0}"
    masked = f"""(SELECT scenario_id, i, j, i_label, j_label, delta_rel,
        {', '.join(kept.format(x) for x in ('delta', 'final', 'baseline'))} FROM changes_z)"""
    q["links_weakened_large_flows"] = _select(["rank", *link, *flow], top(masked, "ASC", 15))

    def side(direction: str, name: str) -> str:
        return _select([s, "concat(i_label, ' → ', j_label) AS edge", f"'{name}' AS direction",
                        rate("100.0 * delta", 6, "delta_pp"), rate("100.0 * delta_rel", 4, "delta_rel_pct")],
                       top("changes_a", direction, 20))

    q["links_combined"] = side("ASC", "Weakened") + " UNION ALL " + side("DESC", "Strengthened")
    bundled = {
        "nodes": ("impacts", "loss_abs", 0), "country": ("by_country", "loss_abs", 0), "sector": ("by_sector", "loss_abs", 0),
        "links_all": ("changes_a", "delta", 3), "links_weakened": (f"(SELECT * FROM {top('changes_a', 'ASC', 25)} WHERE delta < 0)", "delta", 3),
        "links_strengthened": (f"(SELECT * FROM {top('changes_a', 'DESC', 25)} WHERE delta > 0)", "delta", 3),
    }
    q["result_bundle"] = " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, scenario_id, CAST(count(*) AS INTEGER) AS n_rows, {rate(f'SUM({m})', k, 'total')} FROM {t} GROUP BY scenario_id"
        for n, (t, m, k) in bundled.items()
    ) + f""" UNION ALL SELECT 'totals', scenario_id, CAST(1 AS INTEGER), {rate('SUM(X_baseline) - SUM(X_final)', 0, 'total')}
        FROM impacts GROUP BY scenario_id"""
    heat = [rate(x, 7) for x in ("value", "intensity", "clip_limit", "clipped")]
    for name, cells in (("heatmap_sector", "sector"), ("heatmap_country", "country"),
                        ("heatmap_country_percentage", "country_pct"), ("heatmap_node", "node")):
        q[name] = _select([s, "src", "dst", *heat], f"cells_{cells}_heat")
    q["heatmap_matrix"] = _select(
        [s, "src", *[rate(f"SUM(CASE WHEN dst = '{c}' THEN value ELSE 0.0 END)", 7, c) for c in USER_SECTORS]],
        "cells_sector", "GROUP BY scenario_id, src")
    q["heatmap_clip"] = _select([s, rate("clip_limit", 7)], "cells_node_pct_limits")
    q["heatmap_trade"] = _select(
        ["src", "dst", money("value"), rate("intensity", 7), money("clip_limit"), money("clipped")], "cells_trade_heat")
    q["heatmap_trade_detail"] = _select(
        ["src", "dst", money("value"), rate("intensity", 7), money("clip_limit"), money("clipped")], "cells_detail_heat")
    signed = ["sector_label", "CASE WHEN loss_pct_deviation >= 0 THEN 'Positive' ELSE 'Negative' END AS direction",
              money("loss_abs"), rate("loss_pct", 6), rate("loss_pct_deviation", 7)]
    q["brand_deviation"] = " UNION ALL ".join(
        _select(signed, f"""(SELECT *, row_number() OVER (ORDER BY loss_pct_deviation {d}, sector_label) AS k
            FROM brands WHERE loss_pct_deviation {op} 0)""", "WHERE k <= 20")
        for d, op in (("ASC", "<"), ("DESC", ">")))
    q["country_deviation"] = _select(
        [s, "country", rate("loss_pct"), rate("loss_pct_deviation")], "country_dev")
    dev = [s, "sector_label", "CASE WHEN loss_pct_deviation >= 0 THEN 'Positive' ELSE 'Negative' END AS direction",
           rate("loss_pct"), rate("loss_pct_deviation")]
    q["sector_distribution"] = _select(dev, "sector_dev")
    q["sector_anomalies"] = " UNION ALL ".join(
        _select(dev, f"""(SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY loss_pct_deviation {d}, sector_label) AS k
            FROM sector_dev WHERE loss_pct_deviation {op} 0)""", "WHERE k <= 2")
        for d, op in (("ASC", "<"), ("DESC", ">")))
    q["map_table"] = f"""SELECT d.scenario_id, d.country, coalesce(c.iso3, d.country) AS iso3, coalesce(c.name, d.country) AS country_name,
          {money('d.loss_abs')}, {rate('d.loss_pct')}, {rate('d.loss_pct_deviation')},
          {rate('-r.m', 8, 'range_min')}, {rate('r.m', 8, 'range_max')}
        FROM country_dev d
        JOIN (SELECT scenario_id, greatest(max(abs(loss_pct_deviation)), 1e-9) AS m FROM country_dev GROUP BY scenario_id) r
          ON r.scenario_id = d.scenario_id
        LEFT JOIN fx_country_dim c ON c.code = d.country"""

    def ranked(source: str, name: str, k: int) -> str:
        return f"""(SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scenario_id ORDER BY loss_abs DESC, {name}) AS INTEGER)
            AS rank FROM (SELECT * REPLACE (round(loss_abs, 3) + 0.0 AS loss_abs) FROM {source})) WHERE rank <= {k})"""

    q["top_countries"] = f"""SELECT t.scenario_id, t.rank, t.country, coalesce(c.name, t.country) AS country_name, {money('t.loss_abs')}
        FROM {ranked('by_country', 'country', 5)} t LEFT JOIN fx_country_dim c ON c.code = t.country"""
    q["top_sectors"] = _select([s, "rank", "sector", "sector_name", money("loss_abs")], ranked("by_sector", "sector", 3))
    x_low, x_high, y_low, y_high = BOUNDS
    inside = f"(p_size BETWEEN {x_low} AND {x_high} AND p_retailprice BETWEEN {y_low} AND {y_high})"
    q["viewport_clip"] = f"""SELECT p_partkey AS point_id, {inside} AS in_bounds,
        {plain(f'least(greatest(CAST(p_size AS DOUBLE), {x_low}), {x_high})', 'x_mapped')},
        {plain(f'least(greatest(p_retailprice, {y_low}), {y_high})', 'y_mapped')} FROM part"""
    q["viewport_drop"] = f"""SELECT p_partkey AS point_id, {inside} AS in_bounds, {plain('CAST(p_size AS DOUBLE)', 'x_mapped')},
        {plain('p_retailprice', 'y_mapped')} FROM part WHERE {inside}"""
    q["label_violations"] = """SELECT c_custkey, label FROM labelled
        WHERE NOT (len(string_split(label, '::')) = 2 AND length(trim(split_part(label, '::', 1))) > 0
                   AND length(trim(split_part(label, '::', 2))) > 0)"""
    q["range_violations"] = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(*) AS INTEGER) AS violations FROM lineitem WHERE {c} IS NULL OR {c} < {lo} OR {c} > {hi}"
        for c, lo, hi in (("l_discount", 0.0, 0.05), ("l_tax", 0.0, 1.0), ("l_quantity", 1.0, 40.0)))
    return q


def oracle_statements() -> dict[str, str]:
    """Complete SQL by query name; only the blocks a query uses are included."""
    blocks = _ctes()
    names = [n for n, _ in blocks]

    def used(sql: str) -> set[str]:
        import re

        words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
        return {n for n in names if n in words}

    bodies = dict(blocks)
    needs = {n: used(b) - {n} for n, b in blocks}

    def closure(start: set[str]) -> set[str]:
        seen, todo = set(), set(start)
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo |= needs[n] - seen
        return seen

    statements = {}
    for name, final in _finals().items():
        keep = closure(used(final))
        chain = ",\n".join(
            f"{n} AS {'' if n.endswith('_rec') else 'MATERIALIZED '}({bodies[n]})" for n in names if n in keep)
        if not chain:
            statements[name] = final.strip()
        elif final.strip().upper().startswith("WITH "):
            statements[name] = f"WITH RECURSIVE {chain},\n{final.strip()[5:]}"
        else:
            statements[name] = f"WITH RECURSIVE {chain}\n{final.strip()}"
    return statements
