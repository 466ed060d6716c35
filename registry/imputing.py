"""Filling of missing cells, step by step and chained."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import boosted as B, impute as I, normal as G
from panelcast.session import write_and_read
from registry.panels import HOURLY, SQL_PANEL_H, T, WIDE, panel_h, panel_w, r, rounded, sql

M = ("m1", "m2", "m3")
ROWS = f"station, {T}, {r(*M)}"
GATE = 3  # of the five stations


def ffill_bfill_day(spark, sf):
    return rounded(I.fill_within(panel_h(spark, sf), HOURLY, "day"), *M)


def ffill_bfill_season(spark, sf):
    return rounded(I.fill_within(panel_h(spark, sf), HOURLY, "season"), *M)


def ffill_only_season(spark, sf):
    return rounded(I.fill_within(panel_h(spark, sf), HOURLY, "season", direction="forward"), *M)


def mean_fill(spark, sf):
    return rounded(I.fill_mean(panel_h(spark, sf), HOURLY), *M)


def zero_fill(spark, sf):
    return rounded(I.fill_zero(panel_h(spark, sf), HOURLY), *M)


def impute_cascade(spark, sf):
    """Neighbours, then day, then season, then mean, then zero."""
    base = write_and_read(panel_h(spark, sf), "panel")
    steps = ["neighbors", "day", "season", "mean", "zero"]
    return rounded(I.impute(base, HOURLY, steps, max_missing=GATE), *M, places=4)


def impute_main_residual(spark, sf):
    return rounded(I.impute(panel_h(spark, sf), HOURLY, I.main_residual_steps("fwbw_day", "mean")), *M)


def missing_count_gate(spark, sf):
    viewed = I.with_neighbors(panel_h(spark, sf), HOURLY)
    gated = viewed.select(
        "station", "ts", "m1_missing", (viewed.m1.isNull() & (viewed.m1_missing < GATE)).cast("int").alias("fill")
    )
    return rounded(gated)


def neighbor_loo_mean(spark, sf):
    viewed = I.with_neighbors(panel_h(spark, sf), HOURLY)
    out = viewed.select("station", "ts", "m1_others", "m2_others", "m3_others")
    return rounded(out, "m1_others", "m2_others", "m3_others", places=8)


def neighbor_line_models(spark, sf):
    models = I.fit_neighbor_lines(panel_h(spark, sf), HOURLY)
    return rounded(models, *[c for c in models.columns if c != "station"])


def neighbor_regression_impute(spark, sf):
    base = write_and_read(panel_h(spark, sf), "panel")
    return rounded(I.fill_from_neighbors(base, HOURLY, GATE), *M, places=4)


def missing_patterns(spark, sf):
    """What EM reads: times by the stations that report, their number, sums and sums of products."""
    base = write_and_read(panel_h(spark, sf), "panel")
    known = {(x.measure, x.station): (x.mean, x.scale) for x in G.moments(base, HOURLY).collect()}
    held = G.patterns(G.times(base, HOURLY, G.station_list(base, HOURLY), known))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v).alias(c)
    names = F.array_join(F.transform("stations", lambda x: x.cast("string")), ",").alias("stations")
    return rounded(held.select("measure", names, "n", total("sums"), total("outer")), "sums", "outer", places=3)


def normal_models(spark, sf):
    """Means, scales and covariances of five stations, fitted with gaps."""
    models = G.fit_normal(panel_h(spark, sf), HOURLY)
    return rounded(models.select("measure", "station", "mean", "scale", F.posexplode("row").alias("other", "covariance"), "settled"), "mean", "scale", "covariance")


def normal_impute(spark, sf):
    """35 stations, each cell from all others at its time."""
    base = write_and_read(panel_w(spark, sf), "panel")
    return rounded(G.fill_from_normal(base, WIDE, 35), *M, places=4)


def imputation_errors(spark, sf):
    """Every seventh reading hidden: mean absolute error of both learned fills on the cells that both can fill."""
    base = write_and_read(panel_h(spark, sf), "panel")
    hidden = F.pmod(F.xxhash64("station", "ts"), F.lit(7)) == 0
    holes = write_and_read(base.withColumns({m: F.when(~hidden, F.col(m)) for m in M}), "holes")
    truth = base.where(hidden).select("station", "ts", *[F.col(m).alias(f"true_{m}") for m in M])
    fills = {"normal": G.fill_from_normal(holes, HOURLY, 5), "line": I.fill_from_neighbors(holes, HOURLY, 5)}
    for name, df in fills.items():
        truth = truth.join(df.select("station", "ts", *[F.col(m).alias(f"{name}_{m}") for m in M]), ["station", "ts"])
    errors = []
    for m in M:
        both = truth.where(F.col(f"true_{m}").isNotNull() & F.col(f"normal_{m}").isNotNull() & F.col(f"line_{m}").isNotNull())
        mean = [F.avg(F.abs(F.col(f"{name}_{m}") - F.col(f"true_{m}"))).alias(name) for name in fills]
        errors.append(both.agg(F.count("*").alias("cells"), *mean).withColumn("measure", F.lit(m)))
    return rounded(errors[0].unionByName(errors[1]).unionByName(errors[2]), "normal", "line")


def boosted_first_splits(spark, sf):
    """The best split of the root of every station's and measure's model, among 16 bins of equal width."""
    splits = B.first_splits(panel_h(spark, sf), HOURLY, bins=16, least_rows=5, edges="width")
    return rounded(splits, "gain", places=4)


def boosted_impute(spark, sf):
    """Gated cells from one boosted model per station and measure."""
    base = write_and_read(panel_h(spark, sf), "panel")
    return rounded(B.fill_from_boosted(base, HOURLY, GATE, B.fit_boosted(base, HOURLY, trees=20)), *M, places=4)


QUERIES = {
    f.__name__: f
    for f in (
        ffill_bfill_day, ffill_bfill_season, ffill_only_season, mean_fill, zero_fill, impute_cascade,
        impute_main_residual, missing_count_gate, neighbor_loo_mean, neighbor_line_models, neighbor_regression_impute,
        missing_patterns, normal_models, normal_impute, imputation_errors, boosted_first_splits, boosted_impute,
    )
}


def fill_cte(name: str, source: str, by: str, both: bool = True) -> str:
    """SQL of the forward (and backward) fill from one relation into another."""
    key = {"day": "CAST(ts AS DATE)", "season": "hour(ts)"}[by]
    cells = []
    for m in M:
        back = f"last_value({m} IGNORE NULLS) OVER (PARTITION BY station, {key} ORDER BY ts ROWS UNBOUNDED PRECEDING)"
        ahead = (
            f"first_value({m} IGNORE NULLS) OVER (PARTITION BY station, {key} ORDER BY ts "
            "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        )
        cells.append(f"coalesce({back}, {ahead}) AS {m}" if both else f"{back} AS {m}")
    return f"\n{name} AS (SELECT station, ts, {', '.join(cells)} FROM {source})"


def mean_cte(name: str, source: str) -> str:
    cells = ", ".join(f"coalesce({m}, avg({m}) OVER (PARTITION BY station)) AS {m}" for m in M)
    return f"\n{name} AS (SELECT station, ts, {cells} FROM {source})"


SQL_VIEWED = (
    "\nreported AS (SELECT station, ts, m1, m2, m3, m1 AS k1, m2 AS k2, CASE WHEN station <> 'error' THEN m3 END AS k3,"
    " 1 AS n1, 1 AS n2, CASE WHEN station <> 'error' THEN 1 END AS n3 FROM panel_h),"
    "\nviewed AS (SELECT station, ts, m1, m2, m3, k1, k2, k3, "
    + ", ".join(
        f"(sum(k{i}) OVER w - coalesce(k{i}, 0)) / nullif(count(k{i}) OVER w - (CASE WHEN k{i} IS NULL THEN 0 ELSE 1 END), 0)"
        f" AS m{i}_others, count(n{i}) OVER w - count(k{i}) OVER w AS m{i}_missing"
        for i in (1, 2, 3)
    )
    + " FROM reported WINDOW w AS (PARTITION BY ts))"
)
SQL_LINES = (
    "\nlines AS (SELECT station, "
    + ", ".join(
        f"regr_slope(k{m[1]}, {m}_others) AS {m}_slope, regr_intercept(k{m[1]}, {m}_others) AS {m}_intercept" for m in M
    )
    + " FROM viewed GROUP BY 1)"
)
SQL_NEIGHBORS = (
    "\nneighbors AS (SELECT v.station, v.ts, "
    + ", ".join(
        f"coalesce({m}, CASE WHEN {m}_missing < {GATE} THEN {m}_slope * {m}_others + {m}_intercept END) AS {m}"
        for m in M
    )
    + " FROM viewed v JOIN lines USING (station))"
)

_LINE_COLUMNS = [f"{m}_{part}" for m in M for part in ("slope", "intercept")]

SQL = {
    "ffill_bfill_day": sql(SQL_PANEL_H, fill_cte("f", "panel_h", "day"), select=f"SELECT {ROWS} FROM f"),
    "ffill_bfill_season": sql(SQL_PANEL_H, fill_cte("f", "panel_h", "season"), select=f"SELECT {ROWS} FROM f"),
    "ffill_only_season": sql(SQL_PANEL_H, fill_cte("f", "panel_h", "season", False), select=f"SELECT {ROWS} FROM f"),
    "mean_fill": sql(SQL_PANEL_H, mean_cte("f", "panel_h"), select=f"SELECT {ROWS} FROM f"),
    "zero_fill": sql(
        SQL_PANEL_H,
        select=f"SELECT station, {T}, " + ", ".join(f"round(coalesce({m}, 0), 6) AS {m}" for m in M) + " FROM panel_h",
    ),
    "impute_cascade": sql(
        SQL_PANEL_H, SQL_VIEWED, SQL_LINES, SQL_NEIGHBORS,
        fill_cte("a", "neighbors", "day"), fill_cte("b", "a", "season"), mean_cte("c", "b"),
        select=f"SELECT station, {T}, " + ", ".join(f"round(coalesce({m}, 0), 4) AS {m}" for m in M) + " FROM c",
    ),
    "impute_main_residual": sql(
        SQL_PANEL_H, fill_cte("a", "panel_h", "day"), mean_cte("b", "a"), select=f"SELECT {ROWS} FROM b"
    ),
    "missing_count_gate": sql(
        SQL_PANEL_H, SQL_VIEWED,
        select=f"""SELECT station, {T}, m1_missing,
        CASE WHEN m1 IS NULL AND m1_missing < {GATE} THEN 1 ELSE 0 END AS fill FROM viewed""",
    ),
    "neighbor_loo_mean": sql(
        SQL_PANEL_H, SQL_VIEWED,
        select=f"SELECT station, {T}, {r('m1_others', 'm2_others', 'm3_others', places=8)} FROM viewed",
    ),
    "neighbor_line_models": sql(
        SQL_PANEL_H, SQL_VIEWED, SQL_LINES, select=f"SELECT station, {r(*_LINE_COLUMNS)} FROM lines"
    ),
    "missing_patterns": sql(
        SQL_PANEL_H,
        """
cells AS (
  SELECT ts, station, 'm1' AS measure, m1 AS v FROM panel_h UNION ALL SELECT ts, station, 'm2', m2 FROM panel_h
  UNION ALL SELECT ts, station, 'm3', m3 FROM panel_h WHERE station <> 'error'
),
scaled AS (
  SELECT measure, ts, dense_rank() OVER (ORDER BY station) - 1 AS place, v,
    (v - avg(v) OVER s) / coalesce(nullif(stddev_pop(v) OVER s, 0), 1) AS z FROM cells WINDOW s AS (PARTITION BY measure, station)
),
at_time AS (
  SELECT measure, ts, string_agg(place::VARCHAR, ',' ORDER BY place) AS stations, sum(z) AS z FROM scaled WHERE v IS NOT NULL GROUP BY 1, 2
)""",
        select='SELECT measure, stations, count(*) AS n, round(sum(z), 3) AS sums, round(sum(z * z), 3) AS "outer" FROM at_time GROUP BY 1, 2',
    ),
    "boosted_first_splits": sql(
        SQL_PANEL_H,
        """
cells AS (
  SELECT ts, station, 'm1' AS measure, m1 AS v FROM panel_h UNION ALL SELECT ts, station, 'm2', m2 FROM panel_h
  UNION ALL SELECT ts, station, 'm3', m3 FROM panel_h WHERE station <> 'error'
),
scaled AS (
  SELECT measure, station, ts, v, (v - avg(v) OVER s) / coalesce(nullif(stddev_pop(v) OVER s, 0), 1) AS z,
    len(list_filter(list_distinct([min(v) OVER s + (max(v) OVER s - min(v) OVER s) * k / 16 FOR k IN range(1, 16)]), lambda e: e < v)) AS bin
  FROM cells WINDOW s AS (PARTITION BY measure, station)
),
pairs AS (
  SELECT y.measure, y.station, x.station AS neighbour, CASE WHEN x.v IS NULL THEN 16 ELSE x.bin END AS bin, -sum(y.z) AS g, count(*) AS n
  FROM scaled y JOIN scaled x ON x.measure = y.measure AND x.ts = y.ts AND x.station <> y.station WHERE y.v IS NOT NULL GROUP BY 1, 2, 3, 4
),
summed AS (
  SELECT *, sum(g) OVER f AS ga, sum(n) OVER f AS na, coalesce(sum(g) FILTER (bin = 16) OVER f, 0) AS gm, coalesce(sum(n) FILTER (bin = 16) OVER f, 0) AS nm,
    sum(g) OVER (f ORDER BY bin) AS gl, sum(n) OVER (f ORDER BY bin) AS nl FROM pairs WINDOW f AS (PARTITION BY measure, station, neighbour)
),
sides AS (
  SELECT measure, station, neighbour, bin AS cut, gap_left, ga, na, gl + CASE WHEN gap_left THEN gm ELSE 0 END AS gl, nl + CASE WHEN gap_left THEN nm ELSE 0 END AS nl
  FROM summed CROSS JOIN (VALUES (false), (true)) s(gap_left) WHERE bin < 16
),
gains AS (
  SELECT *, gl * gl / (nl + 1) + (ga - gl) * (ga - gl) / (na - nl + 1) - ga * ga / (na + 1) AS gain FROM sides WHERE nl >= 5 AND na - nl >= 5
)""",
        select="""SELECT measure, station, neighbour, cut::INT AS cut, gap_left, round(gain, 4) AS gain, na::BIGINT AS n FROM gains
        QUALIFY row_number() OVER (PARTITION BY measure, station ORDER BY round(gain, 6) DESC, neighbour, cut, gap_left) = 1""",
    ),
    "neighbor_regression_impute": sql(
        SQL_PANEL_H, SQL_VIEWED, SQL_LINES, SQL_NEIGHBORS,
        select=f"SELECT station, {T}, {r(*M, places=4)} FROM neighbors",
    ),
}
