"""The queries on the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnframe.functions import encode as E
from kilnframe.operators import densities as Y
from kilnframe.operators import grouped as G
from kilnframe.operators import models as M
from kilnframe.operators import neighbours as N
from kilnframe.operators import prepare as P
from kilnframe.operators import selection as C
from kilnframe.operators import series as S
from kilnframe.operators import stats as T
from kilnframe.operators import trees as X
from kilnframe.plans import chain as H
from kilnframe.plans import flows as W
from kilnframe.sources import tables as D
from kilnframe.sources.shared import folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
SERIES = ("y", "x")
DIMS = tuple(f"e{i}" for i in range(8))
ALL = tuple(f"e{i}" for i in range(64))
_GAPS = {"e0": 11, "e9": 7, "e40": 13}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def union(template: str, names: tuple[str, ...], head: str = "", sep: str = "\nUNION ALL ") -> str:
    return head + sep.join(template.replace("{c}", c) for c in names)


def _hash(key: str, seed: str) -> str:
    return f"(CAST('0x' || substr(md5(concat({key}, ':{seed}')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


WITH_MIXED = f"WITH {D.MIXED_SQL}\n"
WITH_DAILY = f"WITH {D.DAILY_SQL}\n"
WITH_MONTHLY = f"WITH {D.MONTHLY_SQL}\n"
SPLIT_MONTHLY = f"WITH {D.MONTHLY_SQL},\ns AS (SELECT ts, y, x, CASE WHEN row_number() OVER (ORDER BY ts) <= CAST(floor((SELECT count(*) FROM monthly) * 0.9) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM monthly)\n"


def _split_monthly(s: SparkSession, d: str) -> DataFrame:
    return P.split_temporal(D.monthly(s, d), "ts", 0.9)


# -- flagship -------------------------------------------------------------------

METRICS_SQL = """SELECT split, round(sqrt(avg((y - yhat) * (y - yhat))), 4) AS rmse, round(avg(abs(y - yhat)), 4) AS mae, round(avg(abs(y - yhat) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape,
  round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 6) AS r2 FROM f GROUP BY split"""


def _metrics(df: DataFrame) -> DataFrame:
    m = M.forecast_metrics(df, "y", "yhat", ["split"])
    return m.withColumns({"rmse": F.round("rmse", 4), "mae": F.round("mae", 4), "mape": F.round("mape", 6), "r2": F.round("r2", 6)})


@query(SPLIT_MONTHLY + ", l AS (SELECT max_by(y, ts) AS last FROM s WHERE split = 'train'), f AS (SELECT s.*, coalesce(lag(y) OVER (PARTITION BY split ORDER BY ts), last) AS yhat FROM s, l)\n" + METRICS_SQL)
def flagship_monthly_persistence(s: SparkSession, d: str) -> DataFrame:
    return _metrics(M.persistence(_split_monthly(s, d)).withColumn("yhat", F.col("optimist")))


# -- profiling ------------------------------------------------------------------

DESCRIBE = "SELECT {by}'{c}' AS variable, count({c}) AS \"count\", count(DISTINCT {c}) AS nunique, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM {t}"
STATS = ("mean", "std", "p25", "p50", "p75")


@query(union(DESCRIBE.replace("{by}", "").replace("{t}", "lineitem"), NUM))
def s05_describe(s: SparkSession, d: str) -> DataFrame:
    return r6(r6(T.describe(D.table(s, d, "lineitem"), NUM), *STATS), "mean", "std", digits=4)


_SCAN = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"
_SCANNED = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders"


def _scanned(df: DataFrame) -> DataFrame:
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority")


@query(_SCANNED)
def s01_csv_scan(s: SparkSession, d: str) -> DataFrame:
    """The orders written as CSV and scanned with a schema."""
    path = folder(s, "csv")
    D.write_csv(_scanned(D.table(s, d, "orders")), path)
    return D.read_csv(s, path, target="o_orderstatus", schema=_SCAN).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query(_SCANNED)
def s07_json_round(s: SparkSession, d: str) -> DataFrame:
    """The orders written as JSON and read again."""
    path = folder(s, "json")
    D.write_json(_scanned(D.table(s, d, "orders")), path)
    return s.read.schema(_SCAN).json(path).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("SELECT DISTINCT label FROM embeddings ORDER BY label")
def s08_labels(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "embeddings").select("label").distinct().orderBy("label")


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def s10_head(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "orders").orderBy("o_orderkey").limit(5)


TYPED = ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query(union("SELECT '{c}' AS variable, CASE WHEN count(DISTINCT {c}) = 2 THEN 'binary' WHEN count(try_cast(CAST({c} AS VARCHAR) AS DOUBLE)) = count({c}) THEN 'numeric' WHEN count(try_cast(CAST({c} AS VARCHAR) AS TIMESTAMP)) = count({c}) THEN 'date' ELSE 'symbolic' END AS type FROM orders", TYPED))
def p02_variable_types(s: SparkSession, d: str) -> DataFrame:
    return T.variable_types(D.table(s, d, "orders"), TYPED)


@query("SELECT type, count(*) AS n FROM (" + _SQL["p02_variable_types"] + ") GROUP BY type")
def p03_type_counts(s: SparkSession, d: str) -> DataFrame:
    return p02_variable_types(s, d).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_records, CAST(6 AS INT) AS n_variables FROM orders")
def p01_shape(s: SparkSession, d: str) -> DataFrame:
    o = D.table(s, d, "orders")
    return o.agg(F.count("*").alias("n_records")).withColumn("n_variables", F.lit(len(o.columns)))


NULLED = ("l_tax", "text", "band", "code")


@query(WITH_MIXED + "SELECT * FROM (" + union("SELECT '{c}' AS variable, CAST(count(*) - count({c}) AS BIGINT) AS missing FROM mixed", NULLED) + ") WHERE missing > 0")
def p04_missing(s: SparkSession, d: str) -> DataFrame:
    return T.missing(D.mixed(s, d), NULLED)


BOX = "SELECT '{c}' AS variable, (SELECT CAST(min({c}) AS DOUBLE) FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM lineitem) WHERE {c} >= a - 1.5 * (b - a) AND {c} <= b + 1.5 * (b - a)) AS whisker_low, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, (SELECT CAST(max({c}) AS DOUBLE) FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM lineitem) WHERE {c} >= a - 1.5 * (b - a) AND {c} <= b + 1.5 * (b - a)) AS whisker_high FROM lineitem"


@query(union(BOX, NUM))
def p05_box(s: SparkSession, d: str) -> DataFrame:
    return r6(T.box(D.table(s, d, "lineitem"), NUM), "p25", "p50", "p75")


@query("""WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, greatest(10, least(100, CAST(trunc((max(o_totalprice) - min(o_totalprice)) / 1000) AS INT))) AS k FROM orders)
SELECT CAST(least(floor((o_totalprice - lo) / (hi - lo) * k), k - 1) AS INT) AS bin, round(lo + CAST(least(floor((o_totalprice - lo) / (hi - lo) * k), k - 1) AS INT) * (hi - lo) / k, 6) AS left_edge, count(*) AS n FROM orders, b GROUP BY 1, 2""")
def p06_histogram(s: SparkSession, d: str) -> DataFrame:
    return r6(T.histogram(D.table(s, d, "orders"), "o_totalprice"), "left_edge")


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value")
def p07_value_counts(s: SparkSession, d: str) -> DataFrame:
    return T.value_counts(D.table(s, d, "orders"), "o_orderpriority")


@query("SELECT round(avg(o_totalprice), 4) AS normal_mean, round(stddev_pop(o_totalprice), 4) AS normal_std, min(o_totalprice) AS exp_loc, round(avg(o_totalprice) - min(o_totalprice), 4) AS exp_scale, round(avg(ln(o_totalprice)), 6) AS log_mean, round(stddev_pop(ln(o_totalprice)), 6) AS log_std FROM orders")
def p08_density_fits(s: SparkSession, d: str) -> DataFrame:
    f = T.density_fits(D.table(s, d, "orders"), "o_totalprice")
    return f.withColumns({"normal_mean": F.round("normal_mean", 4), "normal_std": F.round("normal_std", 4), "exp_scale": F.round("exp_scale", 4), "log_mean": F.round("log_mean", 6), "log_std": F.round("log_std", 6)})


_LO, _WIDTH = "(SELECT min(o_totalprice) FROM orders)", "(SELECT (max(o_totalprice) - min(o_totalprice)) / 20 FROM orders)"


@query(f"""WITH f AS (SELECT count(*) AS k, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d, min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders),
b AS (SELECT CAST(least(floor((o_totalprice - {_LO}) / {_WIDTH}), 19) AS INT) AS bin, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT *, lo + (bin + 0.5) * w AS c FROM b, f)
SELECT bin, round(c, 4) AS center, n, round(1e6 * n / (k * w), 6) AS density, round(1e6 * exp(-(c - m) * (c - m) / (2 * d * d)) / (d * sqrt(2 * pi())), 6) AS normal, round(1e6 * exp(-(c - lo) / (m - lo)) / (m - lo), 6) AS exponential FROM c""")
def p08_densities(s: SparkSession, d: str) -> DataFrame:
    """Twenty bins of prices with the fitted densities at their centres, for each million."""
    x = Y.densities(D.table(s, d, "orders"), "o_totalprice")
    return x.select("bin", F.round("center", 4).alias("center"), "n", *[F.round(F.col(c) * 1e6, 6).alias(c) for c in ("density", "normal", "exponential")])


@query()
def p08_lognormal(s: SparkSession, d: str) -> DataFrame:
    """The shifted lognormal of prices, of the largest likelihood, at the centre of each bin."""
    return Y.densities(D.table(s, d, "orders"), "o_totalprice").select("bin", "center", "n", "density", "lognormal")


THRESH = "SELECT '{c}' AS variable, round(avg({c}) - 2 * stddev_samp({c}), 5) AS std_low, round(avg({c}) + 2 * stddev_samp({c}), 5) AS std_top, round(quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 5) AS iqr_low, round(quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 5) AS iqr_top FROM lineitem"


@query(union(THRESH, NUM))
def p09_thresholds(s: SparkSession, d: str) -> DataFrame:
    return r6(T.thresholds(D.table(s, d, "lineitem"), NUM), "std_low", "std_top", "iqr_low", "iqr_top", digits=5)


COUNTED = ("l_extendedprice", "l_quantity")
OUT = "SELECT '{c}' AS variable, CAST(count(*) FILTER (WHERE {c} > m + 2 * s OR {c} < m - 2 * s) AS BIGINT) AS n_std, CAST(count(*) FILTER (WHERE {c} > b + 1.5 * (b - a) OR {c} < a - 1.5 * (b - a)) AS BIGINT) AS n_iqr FROM lineitem, (SELECT avg({c}) AS m, stddev_samp({c}) AS s, quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM lineitem)"


@query(union(OUT, COUNTED))
def p10_outlier_counts(s: SparkSession, d: str) -> DataFrame:
    return T.outlier_counts(D.table(s, d, "lineitem"), COUNTED)


@query("SELECT kind, max(n) FILTER (WHERE variable = 'l_extendedprice') AS l_extendedprice, max(n) FILTER (WHERE variable = 'l_quantity') AS l_quantity FROM (SELECT variable, 'std' AS kind, n_std AS n FROM (" + _SQL["p10_outlier_counts"] + ") UNION ALL SELECT variable, 'iqr', n_iqr FROM (" + _SQL["p10_outlier_counts"] + ")) GROUP BY kind")
def p11_outlier_table(s: SparkSession, d: str) -> DataFrame:
    x = p10_outlier_counts(s, d).select("variable", F.expr("stack(2, 'std', n_std, 'iqr', n_iqr) AS (kind, n)"))
    return x.groupBy("kind").pivot("variable", list(COUNTED)).agg(F.max("n"))


@query("SELECT toxic, count(*) AS n FROM labels GROUP BY toxic")
def p12_class_distribution(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "labels").groupBy("toxic").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, CAST(quarter(o_orderdate) AS INT) AS quarter, CAST(month(o_orderdate) AS INT) AS month, CAST(day(o_orderdate) AS INT) AS day FROM orders")
def p13_date_parts(s: SparkSession, d: str) -> DataFrame:
    return T.date_parts(D.table(s, d, "orders"), "o_orderdate").select("o_orderkey", "year", "quarter", "month", "day")


@query(union("SELECT '{c}' AS property, CAST({c}(o_orderdate) AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY 2", ("year", "quarter", "month", "day")))
def p14_date_granularity(s: SparkSession, d: str) -> DataFrame:
    return T.property_counts(p13_date_parts(s, d), ["year", "quarter", "month", "day"])


@query(union("SELECT '{c}' AS property, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 2", ("l_returnflag", "l_linestatus", "l_linenumber")))
def p15_property_granularity(s: SparkSession, d: str) -> DataFrame:
    return T.property_counts(D.table(s, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


DMS = "CASE WHEN {c} >= 0 THEN '{p}' WHEN {c} < 0 THEN '{n}' END AS {c}_hemisphere, CAST(trunc({c}) AS INT) AS {c}_degrees, CAST(floor(round((abs({c}) - floor(abs({c}))) * 60, 9)) AS INT) AS {c}_minutes, round((round((abs({c}) - floor(abs({c}))) * 60, 9) - floor(round((abs({c}) - floor(abs({c}))) * 60, 9))) * 60, 4) AS {c}_seconds"
_DMS = DMS.replace("{c}", "lat").replace("{p}", "Northern").replace("{n}", "Southern") + ", " + DMS.replace("{c}", "lon").replace("{p}", "Eastern").replace("{n}", "Western")


@query(f"WITH {D.GEO_SQL} SELECT c_custkey, {_DMS} FROM geo")
def p16_dms(s: SparkSession, d: str) -> DataFrame:
    g = T.dms(T.dms(D.geo(s, d), "lat", "Northern", "Southern"), "lon", "Eastern", "Western")
    return g.drop("lat", "lon")


@query(f"WITH {D.GEO_SQL}, m AS (SELECT {_DMS} FROM geo WHERE lat IS NOT NULL AND lon IS NOT NULL) " + union("SELECT '{c}' AS property, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM m GROUP BY 2", ("lat_hemisphere", "lat_degrees", "lat_minutes", "lon_hemisphere", "lon_degrees", "lon_minutes")))
def p17_location_granularity(s: SparkSession, d: str) -> DataFrame:
    g = D.geo(s, d).na.drop(subset=["lat", "lon"])
    g = T.dms(T.dms(g, "lat", "Northern", "Southern"), "lon", "Eastern", "Western")
    return T.property_counts(g, ["lat_hemisphere", "lat_degrees", "lat_minutes", "lon_hemisphere", "lon_degrees", "lon_minutes"])


@query("SELECT CAST(floor(l_quantity / 5) AS INT) AS x_bin, CAST(floor(l_extendedprice / 10000) AS INT) AS y_bin, count(*) AS n FROM lineitem GROUP BY 1, 2")
def p18_sparsity(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "lineitem").groupBy(F.floor(F.col("l_quantity") / 5).cast("int").alias("x_bin"), F.floor(F.col("l_extendedprice") / 10000).cast("int").alias("y_bin")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, CAST(floor(l_quantity / 5) AS INT) AS x_bin, CAST(floor(l_extendedprice / 10000) AS INT) AS y_bin, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def p19_sparsity_per_class(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "lineitem").groupBy("l_returnflag", F.floor(F.col("l_quantity") / 5).cast("int").alias("x_bin"), F.floor(F.col("l_extendedprice") / 10000).cast("int").alias("y_bin")).agg(F.count("*").alias("n"))


_PAIRS = f"""WITH {D.wide_sql(range(64))}, l AS (""" + union("SELECT vec_id, target, '{c}' AS v, {c} AS x FROM wide", ALL) + """), r AS (SELECT v, min(x) AS lo, max(x) AS hi FROM l GROUP BY 1),
g AS (SELECT vec_id, target, v, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / (hi - lo) * 10), 9) END AS INT) AS b FROM l JOIN r USING (v))
"""


@query(_PAIRS + "SELECT a.v AS v1, b.v AS v2, a.b AS x_bin, b.b AS y_bin, count(*) AS n FROM g a JOIN g b ON a.vec_id = b.vec_id AND a.v < b.v GROUP BY ALL")
def p18_sparsity_pairs(s: SparkSession, d: str) -> DataFrame:
    """Counts of ten by ten bins for all 2,016 pairs of components."""
    return T.pair_counts(D.wide(s, d, range(64)), ALL)


@query(_PAIRS + "SELECT a.v AS v1, b.v AS v2, CAST(a.target AS BIGINT) AS target, a.b AS x_bin, b.b AS y_bin, count(*) AS n FROM g a JOIN g b ON a.vec_id = b.vec_id AND a.v < b.v GROUP BY ALL")
def p19_sparsity_pairs_per_class(s: SparkSession, d: str) -> DataFrame:
    """The same by class."""
    return T.pair_counts(D.wide(s, d, range(64)), ALL, target="target")



CORR_SQL = f"WITH {D.wide_sql(range(64))}, l AS (" + union("SELECT vec_id, '{c}' AS v, {c} AS x FROM wide", ALL) + ")\nSELECT a.v AS v1, b.v AS v2, round(abs(corr(a.x, b.x)), 6) AS corr FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.v < b.v GROUP BY 1, 2"


@query(CORR_SQL)
def p20_abs_corr(s: SparkSession, d: str) -> DataFrame:
    return r6(T.correlations(D.wide(s, d, range(64)), ALL), "corr")


@query("SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders")
def p21_nunique(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "orders").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderpriority").alias("priorities"))


@query("SELECT DISTINCT o_orderpriority AS label FROM orders")
def p22_unique_labels(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "orders").select(F.col("o_orderpriority").alias("label")).distinct().orderBy("label")


@query(WITH_DAILY + "SELECT count(*) AS n_records, min(ts) AS first_ts, max(ts) AS last_ts FROM daily")
def p23_series_facts(s: SparkSession, d: str) -> DataFrame:
    return D.daily(s, d).agg(F.count("*").alias("n_records"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(WITH_MONTHLY + "SELECT ts, 'y' AS variable, round(y, 4) AS value FROM monthly UNION ALL SELECT ts, 'x', round(x, 4) FROM monthly")
def p24_melt(s: SparkSession, d: str) -> DataFrame:
    return D.monthly(s, d).unpivot(["ts"], ["y", "x"], "variable", "value").withColumn("value", F.round("value", 4))


@query(WITH_DAILY + "SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS ts, round(sum(y), 4) AS y, round(sum(x), 4) AS x FROM daily GROUP BY 1")
def p25_agg_month_sum(s: SparkSession, d: str) -> DataFrame:
    return r6(S.aggregate(D.daily(s, d), "M", {"y": "sum", "x": "sum"}), "y", "x", digits=4)


@query(WITH_DAILY + "SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS ts, round(avg(y), 4) AS y, round(avg(x), 4) AS x FROM daily GROUP BY 1")
def p25_agg_week_mean(s: SparkSession, d: str) -> DataFrame:
    return r6(S.aggregate(D.daily(s, d), "W", {"y": "mean", "x": "mean"}), "y", "x", digits=4)


@query(WITH_DAILY + "SELECT make_timestamp(CAST(floor(year(ts) / 2) * 2 AS BIGINT), 1, 1, 0, 0, 0) AS ts, round(avg(y), 4) AS y FROM daily GROUP BY 1")
def p26_two_years(s: SparkSession, d: str) -> DataFrame:
    return r6(S.aggregate(D.daily(s, d), "two_years", {"y": "mean"}), "y", digits=4)


@query(WITH_DAILY + "SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS ts, round(sum(y), 4) AS y, 'M' AS level FROM daily GROUP BY 1 UNION ALL SELECT CAST(date_trunc('quarter', ts) AS TIMESTAMP), round(sum(y), 4), 'Q' FROM daily GROUP BY 1 UNION ALL SELECT CAST(date_trunc('year', ts) AS TIMESTAMP), round(sum(y), 4), 'Y' FROM daily GROUP BY 1")
def p27_granularity_study(s: SparkSession, d: str) -> DataFrame:
    return r6(S.by_levels(D.daily(s, d), ["M", "Q", "Y"], {"y": "sum"}), "y", digits=4)


BYLEVEL = "lv AS (SELECT 'M' AS level, sum(y) AS y FROM daily GROUP BY date_trunc('month', ts) UNION ALL SELECT 'Q', sum(y) FROM daily GROUP BY date_trunc('quarter', ts))"


@query(f"WITH {D.DAILY_SQL}, {BYLEVEL} SELECT level, 'y' AS variable, count(y) AS \"count\", round(avg(y), 3) AS mean, round(stddev_samp(y), 3) AS std, round(quantile_cont(y, 0.5), 3) AS p50 FROM lv GROUP BY level")
def p28_describe_by_granularity(s: SparkSession, d: str) -> DataFrame:
    x = T.describe(S.by_levels(D.daily(s, d), ["M", "Q"], {"y": "sum"}), ["y"], ["level"])
    return r6(x.select("level", "variable", "count", "mean", "std", "p50"), "mean", "std", "p50", digits=3)


@query(DESCRIBE.replace("{by}", "l_returnflag, l_linestatus, ").replace("{c}", "l_extendedprice").replace("{t}", "lineitem GROUP BY l_returnflag, l_linestatus") + "\nUNION ALL " + DESCRIBE.replace("{by}", "l_returnflag, l_linestatus, ").replace("{c}", "l_quantity").replace("{t}", "lineitem GROUP BY l_returnflag, l_linestatus"))
def p28_describe_by_class(s: SparkSession, d: str) -> DataFrame:
    """Rows of a fact table described by group, in rounds that close group by group."""
    x = G.describe(D.table(s, d, "lineitem"), ["l_extendedprice", "l_quantity"], ["l_returnflag", "l_linestatus"])
    return r6(r6(x, *STATS), "mean", "std", digits=4)


_LEVELS = {"W": "week", "M": "month", "Q": "quarter"}


@query(WITH_DAILY + ", a AS (" + "\nUNION ALL ".join(f"SELECT '{v}' AS level, sum(y) AS y FROM daily GROUP BY date_trunc('{n}', ts)" for v, n in _LEVELS.items()) + "), b AS (SELECT level, min(y) AS lo, max(y) AS hi FROM a GROUP BY 1) SELECT level, CAST(least(floor((y - lo) / (hi - lo) * 10), 9) AS INT) AS bin, round(lo + CAST(least(floor((y - lo) / (hi - lo) * 10), 9) AS INT) * (hi - lo) / 10, 3) AS left_edge, count(*) AS n FROM a JOIN b USING (level) GROUP BY 1, 2, 3")
def p29_histogram_by_granularity(s: SparkSession, d: str) -> DataFrame:
    """Histograms of the weekly, monthly and quarterly sums."""
    x = T.histogram(S.by_levels(D.daily(s, d), list(_LEVELS), {"y": "sum"}), "y", 10, ["level"])
    return r6(x, "left_edge", digits=3)


@query(WITH_MONTHLY + """, a AS (SELECT ts, y, row_number() OVER w AS i, CASE WHEN lag(y, 6) OVER w IS NOT NULL AND lead(y, 6) OVER w IS NOT NULL THEN (sum(y) OVER (ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + 0.5 * lag(y, 6) OVER w + 0.5 * lead(y, 6) OVER w) / 12 END AS t FROM monthly WINDOW w AS (ORDER BY ts)),
p AS (SELECT (i - 1) % 12 AS k, avg(y - t) AS v FROM a GROUP BY 1), c AS (SELECT avg(v) AS c FROM p)
SELECT ts, round(y, 3) AS observed, round(t, 3) AS trend, round(v - c, 3) AS seasonal, round(y - t - (v - c), 3) AS residual FROM a JOIN p ON (i - 1) % 12 = k, c""")
def p30_decompose(s: SparkSession, d: str) -> DataFrame:
    return r6(S.decompose(D.monthly(s, d), "y", 12), "observed", "trend", "seasonal", "residual", digits=3)


@query(WITH_MONTHLY + """, a AS (SELECT ts, y, row_number() OVER (ORDER BY ts) - 1 AS j, count(*) OVER () AS n, avg(y) OVER () AS m, stddev_pop(y) OVER () AS s FROM monthly),
g AS (SELECT k, (SELECT avg(y) FROM a WHERE j >= (k * n) // 10 AND j < ((k + 1) * n) // 10) AS sm FROM generate_series(0, 9) AS t(k))
SELECT ts, round(y, 3) AS y, round(m, 3) AS mean, round(s, 3) AS std, round(sm, 3) AS segment_mean FROM a JOIN g ON g.k = least(j // greatest(n // 10, 1), 9)""")
def p31_stationarity(s: SparkSession, d: str) -> DataFrame:
    return r6(S.stationarity(D.monthly(s, d), "y"), "y", "mean", "std", "segment_mean", digits=3)


@query()
def p32_adf(s: SparkSession, d: str) -> DataFrame:
    return S.adf_by(D.monthly(s, d).unpivot(["ts"], ["y", "x"], "variable", "value"), "variable", "value")


@query(WITH_DAILY + ", a AS (SELECT y - lag(y) OVER (ORDER BY ts) AS dy, lag(y) OVER (ORDER BY ts) AS ly FROM daily) SELECT round(regr_slope(dy, ly), 6) AS slope FROM a")
def p32_adf_lag0_slope(s: SparkSession, d: str) -> DataFrame:
    x = D.daily(s, d).select((F.col("y") - F.lag("y").over(S.over())).alias("dy"), F.lag("y").over(S.over()).alias("ly"))
    return x.agg(F.round(F.regr_slope("dy", "ly"), 6).alias("slope"))


# -- sequence operators -----------------------------------------------------------


@query(WITH_DAILY + "SELECT ts, round(y, 4) AS y, round(lag(y, 1) OVER w, 4) AS lag_1, round(lag(y, 10) OVER w, 4) AS lag_10, round(lag(y, 20) OVER w, 4) AS lag_20 FROM daily WINDOW w AS (ORDER BY ts)")
def w01_lags(s: SparkSession, d: str) -> DataFrame:
    return r6(S.lags(D.daily(s, d), "y", S.lag_series(20, 10)).drop("x"), "y", "lag_1", "lag_10", "lag_20", digits=4)


@query(WITH_MONTHLY + " SELECT k AS lag, round(a.y, 4) AS y, round(b.y, 4) AS lagged FROM (SELECT *, row_number() OVER (ORDER BY ts) AS i FROM monthly) a CROSS JOIN (SELECT CAST(unnest(range(1, 11)) AS INT) AS k) JOIN (SELECT *, row_number() OVER (ORDER BY ts) AS i FROM monthly) b ON b.i = a.i - k")
def w02_lag_scatter(s: SparkSession, d: str) -> DataFrame:
    x = S.lags(D.monthly(s, d), "y", range(1, 11))
    x = x.select("y", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"lag_{k}").alias("lagged")) for k in range(1, 11)])).alias("r")).select("r.lag", "y", "r.lagged").where("lagged is not null")
    return r6(x, "y", "lagged", digits=4)


@query(WITH_MONTHLY + ", a AS (SELECT y, row_number() OVER (ORDER BY ts) AS i FROM monthly) SELECT CAST(k AS INT) AS lag, round((SELECT sum(p.y * q.y) FROM a p JOIN a q ON q.i = p.i - abs(k)) / (SELECT sum(y * y) FROM a), 6) AS value FROM (SELECT unnest(range(-10, 11)) AS k)")
def w03_acorr(s: SparkSession, d: str) -> DataFrame:
    return r6(S.autocorrelation(D.monthly(s, d), "y"), "value")


@query(WITH_DAILY + "SELECT * FROM (SELECT ts, CASE WHEN count(y) OVER w = 25 THEN round(avg(y) OVER w, 4) END AS y FROM daily WINDOW w AS (ORDER BY ts ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)) WHERE y IS NOT NULL")
def w04_rolling_mean(s: SparkSession, d: str) -> DataFrame:
    x = D.daily(s, d).select("ts", S.rolling_mean("y", 25).alias("y")).na.drop()
    return r6(x, "y", digits=4)


@query(SPLIT_MONTHLY + "SELECT ts, split, " + ", ".join(f"round(CASE WHEN split = 'test' THEN y WHEN count(y) OVER (PARTITION BY split ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) = {w} THEN avg(y) OVER (PARTITION BY split ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) END, 4) AS smooth_{w}" for w in (5, 10, 20)) + " FROM s")
def w05_smoothing(s: SparkSession, d: str) -> DataFrame:
    x = S.smooth(_split_monthly(s, d), "y", (5, 10, 20)).drop("y", "x")
    return r6(x, "smooth_5", "smooth_10", "smooth_20", digits=4)


@query(SPLIT_MONTHLY + "SELECT ts, split, round(v, 4) AS y FROM (SELECT ts, split, y - lag(y) OVER (PARTITION BY split ORDER BY ts) AS v FROM s) WHERE v IS NOT NULL")
def w06_diff1(s: SparkSession, d: str) -> DataFrame:
    return r6(S.difference(_split_monthly(s, d).drop("x"), ["y"]), "y", digits=4)


@query(SPLIT_MONTHLY + "SELECT ts, split, round(v, 4) AS y FROM (SELECT ts, split, y - 2 * lag(y) OVER w + lag(y, 2) OVER w AS v FROM s WINDOW w AS (PARTITION BY split ORDER BY ts)) WHERE v IS NOT NULL")
def w07_diff2(s: SparkSession, d: str) -> DataFrame:
    return r6(S.difference(_split_monthly(s, d).drop("x"), ["y"], 2), "y", digits=4)


@query(SPLIT_MONTHLY + "SELECT ts, split, round(v, 4) AS y, round(u, 4) AS x FROM (SELECT ts, split, y - lag(y) OVER w AS v, x - lag(x) OVER w AS u FROM s WINDOW w AS (PARTITION BY split ORDER BY ts)) WHERE v IS NOT NULL AND u IS NOT NULL")
def w08_multidiff(s: SparkSession, d: str) -> DataFrame:
    return r6(S.difference(_split_monthly(s, d), ["y", "x"]), "y", "x", digits=4)


@query(WITH_MONTHLY + "SELECT ts, w1, w4, next FROM (SELECT ts, round(y, 4) AS w1, round(lead(y, 3) OVER w, 4) AS w4, round(lead(y, 4) OVER w, 4) AS next FROM monthly WINDOW w AS (ORDER BY ts)) WHERE next IS NOT NULL")
def w10_sequences(s: SparkSession, d: str) -> DataFrame:
    x = S.sequences(D.monthly(s, d), "y", 4)
    return x.select("ts", F.round(F.col("window")[0], 4).alias("w1"), F.round(F.col("window")[3], 4).alias("w4"), F.round("next", 4).alias("next"))


@query(f"WITH c AS ({CORR_SQL}) SELECT v1, v2, corr, CAST(row_number() OVER (ORDER BY corr DESC, v1 || '|' || v2) AS INT) AS rank FROM c")
def w11_ranking(s: SparkSession, d: str) -> DataFrame:
    return T.ranked(p20_abs_corr(s, d).withColumn("pair", F.concat_ws("|", "v1", "v2")), "corr", "pair").drop("pair")


@query("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS brand_code FROM part")
def w12_label_codes(s: SparkSession, d: str) -> DataFrame:
    return E.codes(D.table(s, d, "part").select("p_partkey", "p_brand"), "p_brand", "brand_code").select("p_partkey", "brand_code")


@query("SELECT min_by(toxic, n) AS minority, max_by(toxic, n) AS majority FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)")
def l04_extreme_classes(s: SparkSession, d: str) -> DataFrame:
    return p12_class_distribution(s, d).agg(F.min_by("toxic", "n").alias("minority"), F.max_by("toxic", "n").alias("majority"))


@query("""WITH RECURSIVE c AS (SELECT row_number() OVER (ORDER BY p_partkey) AS n, p_partkey AS i, p_retailprice AS v FROM part),
f AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS candidate, CAST(0 AS DOUBLE) AS value UNION ALL
  SELECT k + 1, CASE WHEN v - value > 0.001 THEN i ELSE candidate END, CASE WHEN v - value > 0.001 THEN CAST(v AS DOUBLE) ELSE value END FROM f JOIN c ON c.n = f.k + 1)
SELECT candidate, round(value, 6) AS value FROM f ORDER BY k DESC LIMIT 1""")
def l05_incumbent(s: SparkSession, d: str) -> DataFrame:
    return r6(M.incumbent(D.table(s, d, "part"), "p_partkey", "p_retailprice"), "value")


# -- encodings --------------------------------------------------------------------

RANKS = {"1-URGENT": 1.0, "2-HIGH": 2.0, "3-MEDIUM": 3.0, "4-NOT SPECIFIED": 4.0}


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0::DOUBLE WHEN '2-HIGH' THEN 2.0::DOUBLE WHEN '3-MEDIUM' THEN 3.0::DOUBLE WHEN '4-NOT SPECIFIED' THEN 4.0::DOUBLE END AS priority FROM orders")
def e01_ordinal(s: SparkSession, d: str) -> DataFrame:
    known = E.listed("o_orderpriority", list(RANKS))
    return D.table(s, d, "orders").select("o_orderkey", E.ordinal(known, RANKS).cast("double").alias("priority"))


@query("SELECT p_partkey, CASE WHEN p_size < 3 THEN 'small' ELSE 'other' END AS size_class FROM part")
def e02_threshold(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "part").select("p_partkey", E.below("p_size", 3, "small", "other").alias("size_class"))


@query("SELECT p_partkey, substr(p_brand, 1, 3) AS prefix, trim(substr(p_brand, 4)) AS suffix FROM part")
def e04_code_split(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "part").select("p_partkey", F.substring("p_brand", 1, 3).alias("prefix"), F.expr("trim(substring(p_brand, 4))").alias("suffix"))


@query("""WITH a AS (SELECT p_partkey, dense_rank() OVER (ORDER BY substr(p_brand, 1, 3)) - 1 AS p, dense_rank() OVER (ORDER BY trim(substr(p_brand, 4))) - 1 AS q FROM part),
m AS (SELECT CAST(pow(10, ceil(log10(count(DISTINCT trim(substr(p_brand, 4)))))) AS BIGINT) AS m FROM part) SELECT p_partkey, CAST(p * m + q AS BIGINT) AS code FROM a, m""")
def e05_code_combine(s: SparkSession, d: str) -> DataFrame:
    return E.combined_code(D.table(s, d, "part").select("p_partkey", "p_brand"), "p_brand", "code").select("p_partkey", "code")


@query("SELECT o_orderkey, CAST(day(t) AS INT) AS day, CAST(month(t) AS INT) AS month, CAST(quarter(t) AS INT) AS quarter, CAST(year(t) AS INT) AS year, CAST(isodow(t) - 1 AS INT) AS dayofweek FROM (SELECT o_orderkey, try_strptime(strftime(o_orderdate, '%m/%d/%Y'), '%m/%d/%Y') AS t FROM orders)")
def e06_date_parts(s: SparkSession, d: str) -> DataFrame:
    t = F.try_to_timestamp(F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit("MM/dd/yyyy"))
    x = D.table(s, d, "orders").select("o_orderkey", t.alias("t"))
    return x.select("o_orderkey", F.dayofmonth("t").alias("day"), F.month("t").alias("month"), F.quarter("t").alias("quarter"), F.year("t").alias("year"), F.weekday("t").alias("dayofweek"))


@query("SELECT o_orderkey, round(sin(2 * pi() * quarter(o_orderdate) / 4), 6) + 0.0 AS q_sin, round(cos(2 * pi() * quarter(o_orderdate) / 4), 6) + 0.0 AS q_cos FROM orders")
def e08_cyclic(s: SparkSession, d: str) -> DataFrame:
    a, b = E.cyclic(F.quarter("o_orderdate"), 4)
    return D.table(s, d, "orders").select("o_orderkey", (F.round(a, 6) + F.lit(0.0)).alias("q_sin"), (F.round(b, 6) + F.lit(0.0)).alias("q_cos"))


@query("SELECT p_partkey, round(sin(2 * pi() * p_size / m), 3) + 0.0 AS p_size_sin, round(cos(2 * pi() * p_size / m), 3) + 0.0 AS p_size_cos FROM part, (SELECT max(p_size) AS m FROM part)")
def e09_cyclic_max(s: SparkSession, d: str) -> DataFrame:
    x = E.cyclic_by_max(D.table(s, d, "part").select("p_partkey", "p_size"), ["p_size"])
    return x.select("p_partkey", (F.col("p_size_sin") + F.lit(0.0)).alias("p_size_sin"), (F.col("p_size_cos") + F.lit(0.0)).alias("p_size_cos"))


STOP = ("a", "an", "and", "of", "or", "the", "to", "in", "with")
_STOP = ", ".join(f"'{w}'" for w in STOP)


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS token FROM part) WHERE token NOT IN ({_STOP}) GROUP BY token ORDER BY n DESC, token LIMIT 20")
def e10_top_tokens(s: SparkSession, d: str) -> DataFrame:
    return T.top_tokens(D.table(s, d, "part"), "p_name", STOP)


@query(WITH_MIXED + "SELECT row_id, coalesce(CAST(contains(lower(text), 'part') AS INT), 0) AS \"TEXT_HAS_PART\", coalesce(CAST(contains(lower(text), 'e') AS INT), 0) AS \"TEXT_HAS_E\" FROM mixed")
def e10_has_word(s: SparkSession, d: str) -> DataFrame:
    x = E.has_words(D.mixed(s, d), "text", ["part", "e"], "TEXT")
    return x.select("row_id", "TEXT_HAS_PART", "TEXT_HAS_E")


@query("SELECT l_returnflag, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS mapped, count(*) AS n FROM lineitem GROUP BY 1, 2")
def e11_mapping(s: SparkSession, d: str) -> DataFrame:
    m = F.try_element_at(D.literal_map({"R": 1, "A": 0}), F.col("l_returnflag"))
    return D.table(s, d, "lineitem").groupBy("l_returnflag", m.alias("mapped")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, " + ", ".join(f"o_orderstatus = '{v}' AS \"o_orderstatus_{v}\"" for v in "FOP") + " FROM orders")
def e12_dummify(s: SparkSession, d: str) -> DataFrame:
    return E.one_hot(D.table(s, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


# -- rows: filters, samples, splits, joins ------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders")
def r01_drop_columns(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "orders").drop("o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")


@query(WITH_MIXED + "SELECT row_id, l_tax, text, band FROM mixed WHERE l_tax IS NOT NULL AND text IS NOT NULL AND band IS NOT NULL")
def r05_dropna(s: SparkSession, d: str) -> DataFrame:
    return D.mixed(s, d).select("row_id", "l_tax", "text", "band").na.drop("any")


_SPARSE = {"never": "row_id LIKE '%777'", "seldom": "row_id LIKE '%7'", "often": "row_id NOT LIKE '%7'", "tax": "l_tax IS NOT NULL", "named": "text IS NOT NULL", "banded": "band IS NOT NULL"}
_SHARES = ", ".join(f"count(*) FILTER (WHERE {e}) >= count(*) * 0.095 AS {c}" for c, e in _SPARSE.items())


@query(WITH_MIXED + f"""SELECT row_id, variable FROM (SELECT row_id, unnest([{", ".join(f"CASE WHEN {e} THEN '{c}' END" for c, e in _SPARSE.items())}]) AS variable, {" + ".join(f"CAST({e} AND k.{c} AS INT)" for c, e in _SPARSE.items())} + 1 AS there, k.*
FROM mixed, (SELECT {_SHARES} FROM mixed) k) WHERE there >= CAST(floor(7 * 0.6) AS INT) AND variable IS NOT NULL AND CASE variable {" ".join(f"WHEN '{c}' THEN {c}" for c in _SPARSE)} END""")
def r07_drop_sparse(s: SparkSession, d: str) -> DataFrame:
    """Columns with values in under 9.5 % of the rows go, then rows with fewer than four of the seven columns; what is left in long form."""
    x = D.mixed(s, d).select("row_id", *[F.when(F.expr(e), c).alias(c) for c, e in _SPARSE.items()])
    x = P.drop_sparse(x, 0.095, 0.6)
    return x.unpivot("row_id", [c for c in x.columns if c != "row_id"], "variable", "value").where("value is not null").select("row_id", "variable")


@query("SELECT o_orderkey FROM orders ORDER BY md5(concat(o_orderkey, ':42')), o_orderkey LIMIT 500")
def r09_sample(s: SparkSession, d: str) -> DataFrame:
    return P.sample(D.table(s, d, "orders"), "o_orderkey", 500).select("o_orderkey")


@query(f"SELECT o_orderkey, count(*) AS copies FROM (SELECT CAST(floor({_hash('i', '42')} * (SELECT count(*) FROM orders)) AS BIGINT) AS r FROM (SELECT unnest(range(300)) AS i)) JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat(o_orderkey, ':42')), o_orderkey) - 1 AS r FROM orders) USING (r) GROUP BY 1")
def r10_sample_with_replacement(s: SparkSession, d: str) -> DataFrame:
    return P.sample_with_replacement(D.table(s, d, "orders").select("o_orderkey"), "o_orderkey", 300).groupBy("o_orderkey").agg(F.count("*").alias("copies"))


_SPLIT = "CASE WHEN row_number() OVER (ORDER BY md5(concat({k}, ':42')), {k}) <= ceil(0.3 * (SELECT count(*) FROM {t})) THEN 'test' ELSE 'train' END AS split"


@query("SELECT o_orderkey, " + _SPLIT.format(k="o_orderkey", t="orders") + " FROM orders")
def r11_split(s: SparkSession, d: str) -> DataFrame:
    return P.split_random(D.table(s, d, "orders").select("o_orderkey"), "o_orderkey")


@query(SPLIT_MONTHLY + "SELECT ts, split FROM s")
def r12_temporal_split(s: SparkSession, d: str) -> DataFrame:
    return _split_monthly(s, d).select("ts", "split")


@query("SELECT o_orderkey, sum(l_quantity) AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def j02_left_join(s: SparkSession, d: str) -> DataFrame:
    li = D.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"))
    return D.table(s, d, "orders").select("o_orderkey").join(li, "o_orderkey", "left")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j03_semi_join(s: SparkSession, d: str) -> DataFrame:
    o = D.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return D.table(s, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j04_anti_join(s: SparkSession, d: str) -> DataFrame:
    o = D.table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return D.table(s, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def j05_union(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")).unionByName(D.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind")))


# -- preparation ------------------------------------------------------------------


@query(WITH_MIXED + "SELECT row_id, round(coalesce(l_tax, (SELECT avg(l_tax) FROM mixed)), 6) AS l_tax FROM mixed")
def d01_impute_mean(s: SparkSession, d: str) -> DataFrame:
    x = D.mixed(s, d).select("row_id", "l_tax")
    return r6(P.fill(x, P.fit_fill(x, ["l_tax"], [])), "l_tax")


@query(WITH_MIXED + "SELECT row_id, round(coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM mixed)), 6) AS l_tax FROM mixed")
def d02_impute_median(s: SparkSession, d: str) -> DataFrame:
    x = D.mixed(s, d).select("row_id", "l_tax")
    return r6(P.fill(x, P.fit_fill(x, ["l_tax"], [], "median")), "l_tax")


@query(WITH_MIXED + "SELECT row_id, coalesce(band, (SELECT band FROM mixed WHERE band IS NOT NULL GROUP BY band ORDER BY count(*) DESC, band LIMIT 1)) AS band FROM mixed")
def d03_impute_mode(s: SparkSession, d: str) -> DataFrame:
    x = D.mixed(s, d).select("row_id", "band")
    return P.fill(x, P.fit_fill(x, [], ["band"]))


@query(WITH_MIXED + "SELECT row_id, coalesce(l_tax, -1.0) AS l_tax, coalesce(band, 'NA') AS band FROM mixed")
def d04_impute_constant(s: SparkSession, d: str) -> DataFrame:
    return P.fill(D.mixed(s, d).select("row_id", "l_tax", "band"), {"l_tax": -1.0, "band": "NA"})


_B = "(SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s, quantile_cont(l_extendedprice, 0.5) AS q FROM mixed)"


@query(WITH_MIXED + f"SELECT row_id, l_extendedprice FROM mixed, {_B} WHERE NOT coalesce(l_extendedprice > m + 2 * s OR l_extendedprice < m - 2 * s, false)")
def d08_outlier_drop(s: SparkSession, d: str) -> DataFrame:
    x = D.mixed(s, d).select("row_id", "l_extendedprice")
    return P.drop_outliers(x, P.fit_bounds(x, ["l_extendedprice"], 2.0))


@query(WITH_MIXED + f"SELECT row_id, round(CASE WHEN l_extendedprice > m + 2 * s OR l_extendedprice < m - 2 * s THEN q ELSE l_extendedprice END, 5) AS l_extendedprice FROM mixed, {_B}")
def d09_outlier_replace(s: SparkSession, d: str) -> DataFrame:
    x = D.mixed(s, d).select("row_id", "l_extendedprice")
    return r6(P.replace_outliers(x, P.fit_bounds(x, ["l_extendedprice"], 2.0)), "l_extendedprice", digits=5)


@query(WITH_MIXED + f"SELECT row_id, round(CASE WHEN l_extendedprice > m + 2 * s THEN m + 2 * s WHEN l_extendedprice < m - 2 * s THEN m - 2 * s ELSE l_extendedprice END, 5) AS l_extendedprice FROM mixed, {_B}")
def d10_outlier_truncate(s: SparkSession, d: str) -> DataFrame:
    x = D.mixed(s, d).select("row_id", "l_extendedprice")
    return r6(P.truncate_outliers(x, P.fit_bounds(x, ["l_extendedprice"], 2.0)), "l_extendedprice", digits=5)


@query(WITH_MIXED + "SELECT row_id, round((l_quantity - (SELECT avg(l_quantity) FROM mixed)) / (SELECT stddev_pop(l_quantity) FROM mixed), 6) AS l_quantity FROM mixed")
def d11_zscore(s: SparkSession, d: str) -> DataFrame:
    return r6(P.scale(D.mixed(s, d).select("row_id", "l_quantity"), ["l_quantity"]), "l_quantity")


@query(WITH_MIXED + "SELECT row_id, round((l_quantity - (SELECT min(l_quantity) FROM mixed)) / (SELECT max(l_quantity) - min(l_quantity) FROM mixed), 6) AS l_quantity FROM mixed")
def d12_minmax(s: SparkSession, d: str) -> DataFrame:
    return r6(P.scale(D.mixed(s, d).select("row_id", "l_quantity"), ["l_quantity"], "minmax"), "l_quantity")


@query("WITH n AS (SELECT least(count(*) FILTER (WHERE toxic = 1), count(*) FILTER (WHERE toxic = 0)) AS n FROM labels) SELECT doc_id, toxic FROM labels, n QUALIFY row_number() OVER (PARTITION BY toxic ORDER BY md5(concat(doc_id, ':42')), doc_id) <= n")
def d14_undersample(s: SparkSession, d: str) -> DataFrame:
    return P.undersample(D.table(s, d, "labels").select("doc_id", "toxic"), "doc_id", "toxic")


@query(f"""WITH n AS (SELECT count(*) FILTER (WHERE toxic = 1) AS lo, count(*) FILTER (WHERE toxic = 0) AS hi FROM labels), r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat(doc_id, ':42')), doc_id) - 1 AS r FROM labels WHERE toxic = 1)
SELECT doc_id, toxic, CAST(1 AS BIGINT) AS copies FROM labels WHERE toxic = 0 UNION ALL
SELECT doc_id, CAST(1 AS INT), count(*) FROM (SELECT CAST(floor({_hash('i', '42')} * lo) AS INT) AS r FROM n, (SELECT unnest(range((SELECT hi FROM n))) AS i)) JOIN r USING (r) GROUP BY 1""")
def d15_oversample(s: SparkSession, d: str) -> DataFrame:
    x = P.oversample(D.table(s, d, "labels").select("doc_id", F.col("toxic").cast("int").alias("toxic")), "doc_id", "toxic")
    return x.groupBy("doc_id", "toxic").agg(F.count("*").alias("copies"))


_SM = ", ".join(f"round(a.v[{i + 1}] + u * (b.v[{i + 1}] - a.v[{i + 1}]), 6) AS e{i}" for i in range(64))


@query(f"""WITH m AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE label = 0),
n AS (SELECT a.vec_id AS k, b.vec_id AS o, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(sqrt(list_sum([(a.v[i] - b.v[i]) * (a.v[i] - b.v[i]) FOR i IN range(1, 65)])), 9), b.vec_id) AS r FROM m a JOIN m b ON a.vec_id <> b.vec_id QUALIFY r <= 5),
q AS (SELECT (SELECT count(*) FROM m) AS lo, (SELECT count(*) FROM embeddings WHERE label <> 0) AS hi), s AS (SELECT k, count(*) AS near FROM n GROUP BY 1),
h AS (SELECT vec_id, (hi - lo) // lo + CAST(row_number() OVER (ORDER BY md5(concat(vec_id, ':42')), vec_id) <= (hi - lo) % lo AS INT) AS copies FROM m, q),
g AS (SELECT vec_id, CAST(copy AS INT) AS copy, CAST(floor({_hash("concat_ws(':', vec_id, copy)", '42n')} * near) + 1 AS INT) AS r, {_hash("concat_ws(':', vec_id, copy)", '42u')} AS u FROM (SELECT vec_id, unnest(range(1, copies + 1)) AS copy FROM h) JOIN s ON s.k = vec_id)
SELECT g.vec_id, g.copy, {_SM} FROM g JOIN n ON n.k = g.vec_id AND n.r = g.r JOIN m a ON a.vec_id = g.vec_id JOIN m b ON b.vec_id = n.o""")
def d16_smote(s: SparkSession, d: str) -> DataFrame:
    """As many new rows as make both classes equal, in all 64 columns."""
    return r6(P.smote(D.wide(s, d, range(64)), "vec_id", ALL, "target", 1, extra=None), *ALL)


@query(f"WITH {D.wide_sql(range(64))} SELECT variable, round(variance, 8) AS variance FROM (" + union("SELECT '{c}' AS variable, var_samp({c}) AS variance FROM wide", ALL) + ") WHERE variance < 0.0156")
def d17_low_variance(s: SparkSession, d: str) -> DataFrame:
    return r6(T.low_variance(D.wide(s, d, range(64)), ALL, 0.0156), "variance", digits=8)


@query(f"WITH c AS ({CORR_SQL}), m AS (SELECT v1, v2 FROM c WHERE corr >= 0.02 UNION ALL SELECT v2, v1 FROM c WHERE corr >= 0.02) SELECT DISTINCT v2 AS variable FROM m WHERE v1 IN (SELECT v1 FROM m GROUP BY v1 HAVING count(*) >= 2)")
def d18_redundant(s: SparkSession, d: str) -> DataFrame:
    return T.redundant(p20_abs_corr(s, d), 0.02)


# -- models -----------------------------------------------------------------------


def _split_wide(s: SparkSession, d: str, n: int = len(DIMS)) -> DataFrame:
    return D.wide(s, d, range(n)).withColumn("split", F.when(F.pmod("vec_id", F.lit(10)) < 3, "test").otherwise("train"))


SPLIT_WIDE = f"WITH {D.wide_sql(range(64))}, x AS (" + union("SELECT vec_id, CASE WHEN vec_id % 10 < 3 THEN 'test' ELSE 'train' END AS split, target AS label, '{c}' AS variable, {c} AS x FROM wide", ALL) + "),\npr AS (SELECT label AS class, ln(count(*) / sum(count(*)) OVER ()) AS prior FROM x WHERE split = 'train' AND variable = 'e0' GROUP BY label)"
PICK = "SELECT vec_id, split, label, first(class ORDER BY round(ll, 9) DESC, class) AS predicted FROM s GROUP BY vec_id, split, label"


@query(SPLIT_WIDE + f""", ep AS (SELECT max(v) * 1e-9 AS eps FROM (SELECT var_pop(x) AS v FROM x WHERE split = 'train' GROUP BY variable)), f AS (SELECT variable, label AS class, avg(x) AS mu, var_pop(x) + any_value(eps) AS vr FROM x, ep WHERE split = 'train' GROUP BY 1, 2),
s AS (SELECT vec_id, split, label, f.class, sum(-0.5 * ln(2 * pi() * vr) - (x - mu) * (x - mu) / (2 * vr)) + any_value(prior) AS ll FROM x JOIN f USING (variable) JOIN pr ON pr.class = f.class GROUP BY 1, 2, 3, 4) {PICK}""")
def m01_gaussian_nb(s: SparkSession, d: str) -> DataFrame:
    return M.gaussian_nb(_split_wide(s, d, 64), "vec_id", ALL, "target")


@query(SPLIT_WIDE + f""", f AS (SELECT variable, label AS class, (sum(CAST(x > 0 AS DOUBLE)) + 1) / (count(*) + 2) AS p FROM x WHERE split = 'train' GROUP BY 1, 2),
s AS (SELECT vec_id, split, label, f.class, sum(CASE WHEN x > 0 THEN ln(p) ELSE ln(1 - p) END) + any_value(prior) AS ll FROM x JOIN f USING (variable) JOIN pr ON pr.class = f.class GROUP BY 1, 2, 3, 4) {PICK}""")
def m01_bernoulli_nb(s: SparkSession, d: str) -> DataFrame:
    return M.bernoulli_nb(_split_wide(s, d, 64), "vec_id", ALL, "target")


_DIST = {"manhattan": " + ".join(f"abs(a.{c} - b.{c})" for c in ALL), "euclidean": "sqrt(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in ALL) + ")", "chebyshev": "greatest(" + ", ".join(f"abs(a.{c} - b.{c})" for c in ALL) + ")"}
KS = tuple(range(1, 26, 2))


def _votes_sql(asked: str = "a.vec_id % 10 < 3", ks: tuple[int, ...] = KS) -> str:
    """``v``: the most frequent label of the nearest training rows for each metric and k."""
    near = "\nUNION ALL ".join(f"SELECT '{m}' AS metric, a.vec_id, CASE WHEN a.vec_id % 10 < 3 THEN 'test' ELSE 'train' END AS split, a.target AS label, b.target AS vote, b.vec_id AS other, round({e}, 9) AS d FROM wide a JOIN wide b ON {asked} AND b.vec_id % 10 >= 3" for m, e in _DIST.items())
    return f"""WITH {D.wide_sql(range(64))}, n AS ({near}), t AS (SELECT *, row_number() OVER (PARTITION BY metric, vec_id ORDER BY d, other) AS r FROM n QUALIFY r <= {max(ks)}),
c AS (SELECT metric, CAST(k AS INT) AS k, vec_id, split, label, vote, count(*) AS c FROM t, (SELECT unnest({list(ks)}) AS k) WHERE r <= k GROUP BY ALL), v AS (SELECT metric, k, vec_id, split, label, first(vote ORDER BY c DESC, vote) AS predicted FROM c GROUP BY ALL)"""


@query(_votes_sql() + " SELECT metric, k, vec_id, label, predicted FROM v")
def m02_knn(s: SparkSession, d: str) -> DataFrame:
    """Every odd k to 25 by three metrics: 39 settings of one search."""
    return M.knn(_split_wide(s, d, 64), "vec_id", ALL, "target", KS, N.METRICS).select(F.col("slot").alias("metric"), "k", "vec_id", "label", "predicted")


_COUNTED = "CAST(count(*) FILTER (WHERE label = 1 AND predicted = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE label <> 1 AND predicted = 1) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE label = 1 AND predicted <> 1) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE label <> 1 AND predicted <> 1) AS BIGINT) AS tn"
_MEASURED = "round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS auc, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"


def _folded_sql(grid: str, params: str, same: str, measure: str = "recall") -> str:
    """A search in SQL after ``grid``, a table ``m`` of measures by place ``i`` and split: the ordered fold, and the curve of rows that are as the winner by ``same``."""
    out = f"round(accuracy, 6) AS accuracy, round(recall, 6) AS recall, round(precision, 6) AS precision, round(auc, 6) AS auc, round(f1, 6) AS f1"
    return f"""WITH RECURSIVE {grid.removeprefix('WITH ')},
f AS (SELECT 0 AS k, CAST(NULL AS INT) AS w, CAST(0 AS DOUBLE) AS top UNION ALL SELECT f.k + 1, CASE WHEN {measure} - top > 0.001 THEN i ELSE w END, CASE WHEN {measure} - top > 0.001 THEN {measure} ELSE top END FROM f JOIN m ON m.i = f.k AND m.split = 'test'),
b AS (SELECT w FROM f ORDER BY f.k DESC LIMIT 1), best AS (SELECT DISTINCT m.* EXCLUDE (split, accuracy, recall, precision, auc, f1) FROM m JOIN b ON i = w)
SELECT 'grid' AS study, CAST(i AS INT) AS candidate, {params} AS params, split, {out}, coalesce(i = w, false) AS winner FROM m, b
UNION ALL SELECT 'curve', CAST(dense_rank() OVER (ORDER BY i) - 1 AS INT), {params}, split, {out}, i = w FROM m, b WHERE EXISTS (SELECT 1 FROM best WHERE {same})"""


_KNN_GRID = _votes_sql("true") + f", g AS (SELECT metric, k, split, {_COUNTED} FROM v GROUP BY ALL), m AS (SELECT list_position({list(N.METRICS)}, metric) * {len(KS)} - {len(KS)} + (k - 1) // 2 AS i, metric, k, split, {_MEASURED.replace('round(', '(').replace(', 6)', ')')} FROM g)"


def _study(x: DataFrame) -> DataFrame:
    return r6(x, *M.MEASURES)


@query(_folded_sql(_KNN_GRID, "'metric=' || metric || ', k=' || k", "best.metric = m.metric"))
def m02_knn_study(s: SparkSession, d: str) -> DataFrame:
    """The 39 settings on both splits, the winner by recall, and its curve over k."""
    return _study(M.knn_study(_split_wide(s, d, 64), "vec_id", ALL, "target"))


_PRED = "p AS (SELECT doc_id, toxic AS y, CAST(quality = 0 AS INT) AS p, n_chars FROM labels JOIN documents USING (doc_id))"


def _predicted(s: SparkSession, d: str) -> DataFrame:
    x = D.table(s, d, "labels").join(D.table(s, d, "documents"), "doc_id")
    return x.select("doc_id", F.col("toxic").alias("y"), (F.col("quality") == 0).cast("int").alias("p"), "n_chars")


@query(f"WITH {_PRED}, c AS (SELECT CAST(count(*) FILTER (WHERE y = 1 AND p = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE y <> 1 AND p = 1) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE y = 1 AND p <> 1) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE y <> 1 AND p <> 1) AS BIGINT) AS tn FROM p) SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS auc, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c")
def m07_class_metrics(s: SparkSession, d: str) -> DataFrame:
    return r6(M.class_metrics(_predicted(s, d), "y", "p"), "accuracy", "recall", "precision", "auc", "f1")


@query(f"WITH {_PRED}, v AS (SELECT y AS v FROM p UNION SELECT p FROM p) SELECT a.v AS actual, b.v AS predicted, count(p.y) AS n FROM v a CROSS JOIN v b LEFT JOIN p ON p.y = a.v AND p.p = b.v GROUP BY 1, 2")
def m08_confusion(s: SparkSession, d: str) -> DataFrame:
    return M.confusion(_predicted(s, d), "y", "p")


@query(f"WITH {_PRED}, g AS (SELECT n_chars AS score, count(*) FILTER (WHERE y = 1) AS a, count(*) FILTER (WHERE y <> 1) AS b FROM p GROUP BY 1) SELECT score, round(sum(b) OVER w / (SELECT sum(b) FROM g), 6) AS fpr, round(sum(a) OVER w / (SELECT sum(a) FROM g), 6) AS tpr FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)")
def m09_roc(s: SparkSession, d: str) -> DataFrame:
    return r6(M.roc(_predicted(s, d), "y", "n_chars"), "fpr", "tpr")


@query(SPLIT_MONTHLY + ", c AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM s WHERE split = 'train'), f AS (SELECT s.*, b + a * x AS yhat FROM s, c)\n" + METRICS_SQL)
def m10_ols(s: SparkSession, d: str) -> DataFrame:
    return _metrics(M.linear_regression(_split_monthly(s, d), "x", "y"))


@query(SPLIT_MONTHLY + ", f AS (SELECT *, (SELECT avg(y) FROM s WHERE split = 'train') AS yhat FROM s)\n" + METRICS_SQL)
def m12_simple_avg(s: SparkSession, d: str) -> DataFrame:
    return _metrics(M.simple_average(_split_monthly(s, d)))


@query(SPLIT_MONTHLY + ", l AS (SELECT max_by(y, ts) AS v FROM s WHERE split = 'train') SELECT ts, split, round(y, 4) AS y, round(v, 4) AS realist, round(coalesce(lag(y) OVER (PARTITION BY split ORDER BY ts), v), 4) AS optimist FROM s, l")
def m13_persistence(s: SparkSession, d: str) -> DataFrame:
    return r6(M.persistence(_split_monthly(s, d)).drop("x"), "y", "realist", "optimist", digits=4)


@query("WITH RECURSIVE " + SPLIT_MONTHLY.removeprefix("WITH ") + """, t AS (SELECT list(y ORDER BY ts) AS l FROM s WHERE split = 'train'),
r AS (SELECT 0 AS i, l[-5:] AS l, CAST(NULL AS DOUBLE) AS yhat FROM t UNION ALL SELECT i + 1, list_append(l, list_sum(l[-5:]) / 5), list_sum(l[-5:]) / 5 FROM r WHERE i < (SELECT count(*) FROM s)),
n AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY ts) AS i FROM s) SELECT ts, split, round(y, 3) AS y, round(yhat, 3) AS yhat FROM n JOIN r USING (i)""")
def m14_rolling_mean_forecast(s: SparkSession, d: str) -> DataFrame:
    return r6(M.rolling_mean_forecast(_split_monthly(s, d), 5).select("ts", "split", "y", "yhat"), "y", "yhat", digits=3)


@query("WITH RECURSIVE " + SPLIT_MONTHLY.removeprefix("WITH ") + """, n AS (SELECT y, row_number() OVER (ORDER BY ts) AS i FROM s WHERE split = 'train'), r AS (SELECT i, y AS l FROM n WHERE i = 1 UNION ALL SELECT n.i, 0.3 * n.y + (1 - 0.3) * r.l FROM r JOIN n ON n.i = r.i + 1)
SELECT ts, split, round((SELECT l FROM r ORDER BY i DESC LIMIT 1), 3) AS yhat FROM s""")
def m15_exponential_smoothing(s: SparkSession, d: str) -> DataFrame:
    return r6(M.exponential_smoothing(_split_monthly(s, d), 0.3).select("ts", "split", "yhat"), "yhat", digits=3)


def _forecast_folded(forecasts: str) -> str:
    """A search of forecasters in SQL after ``forecasts``, a table ``f(i, params, split, y, yhat)``."""
    inner = METRICS_SQL.replace("SELECT split,", "SELECT i, params, split,").replace("GROUP BY split", "GROUP BY i, params, split")
    for n in (4, 6):
        inner = inner.replace(f", {n}) AS", ", 12) AS")
    return f"""{forecasts}, m AS ({inner}),
o AS (SELECT 0 AS k, CAST(NULL AS INT) AS w, CAST(-100000 AS DOUBLE) AS top UNION ALL SELECT o.k + 1, CASE WHEN r2 - top > 0.001 THEN i ELSE w END, CASE WHEN r2 - top > 0.001 THEN r2 ELSE top END FROM o JOIN m ON m.i = o.k AND m.split = 'test'),
b AS (SELECT w FROM o ORDER BY o.k DESC LIMIT 1) SELECT CAST(i AS INT) AS candidate, params, split, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(mape, 6) AS mape, round(r2, 6) AS r2, coalesce(i = w, false) AS winner FROM m, b"""


def _searched(x: DataFrame) -> DataFrame:
    return x.withColumns({"rmse": F.round("rmse", 4), "mae": F.round("mae", 4), "mape": F.round("mape", 6), "r2": F.round("r2", 6)})


@query(_forecast_folded("WITH RECURSIVE " + SPLIT_MONTHLY.removeprefix("WITH ") + f""", t AS (SELECT list(y ORDER BY ts) AS l FROM s WHERE split = 'train'), ws AS (SELECT unnest({list(M.WINDOWS)}) AS w),
r AS (SELECT w, 0 AS i, l[-w:] AS l, CAST(NULL AS DOUBLE) AS yhat FROM t, ws UNION ALL SELECT w, i + 1, list_append(l, list_sum(l[-w:]) / w)[-w:], list_sum(l[-w:]) / w FROM r WHERE i < (SELECT count(*) FROM s)),
n AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY ts) AS i FROM s), f AS (SELECT list_position({list(M.WINDOWS)}, w) - 1 AS i, 'window=' || w AS params, split, y, yhat FROM n JOIN r USING (i))"""))  # fmt: skip
def m14_rolling_mean_study(s: SparkSession, d: str) -> DataFrame:
    """Ten windows on both splits and the winner by R2."""
    return _searched(M.rolling_mean_study(_split_monthly(s, d)))


@query(_forecast_folded("WITH RECURSIVE " + SPLIT_MONTHLY.removeprefix("WITH ") + f""", n AS (SELECT y, row_number() OVER (ORDER BY ts) AS j FROM s WHERE split = 'train'), al AS (SELECT unnest({list(M.ALPHAS)})::DOUBLE AS a),
r AS (SELECT a, j, y AS l FROM n, al WHERE j = 1 UNION ALL SELECT a, n.j, a * n.y + (1 - a) * r.l FROM r JOIN n ON n.j = r.j + 1),
f AS (SELECT CAST(round(a * 10) - 1 AS INT) AS i, 'alpha=' || a AS params, split, y, last AS yhat FROM s, (SELECT a, max_by(l, j) AS last FROM r GROUP BY a))"""))  # fmt: skip
def m15_smoothing_study(s: SparkSession, d: str) -> DataFrame:
    """Nine levels of smoothing on both splits and the winner by R2."""
    return _searched(M.smoothing_study(_split_monthly(s, d)))


DEPTHS = tuple(range(2, 26, 2))


def _trees(s: SparkSession, d: str, kind: str, grid: list[dict], sizes: tuple[int, ...]):
    return X.search(_split_wide(s, d, 64), ALL, "target", kind, grid, sizes)


@query()
def m03_tree(s: SparkSession, d: str) -> DataFrame:
    """Two criteria at twelve depths from two fits; winner and curve."""
    return _study(_trees(s, d, "tree", [{"impurity": i} for i in ("entropy", "gini")], DEPTHS)[0])


@query()
def m03_tree_importances(s: SparkSession, d: str) -> DataFrame:
    """Variables of the winning tree by what they gain."""
    _, fit = _trees(s, d, "tree", [{"impurity": i} for i in ("entropy", "gini")], DEPTHS)
    return X.importances(s, fit, ALL)


@query()
def m03_tree_top(s: SparkSession, d: str) -> DataFrame:
    """The root and three levels below it of the winning tree."""
    _, fit = _trees(s, d, "tree", [{"impurity": i} for i in ("entropy", "gini")], DEPTHS)
    return X.node_table(s, fit, 3).withColumn("variable", F.get(F.array(*[F.lit(c) for c in ALL]), F.col("feature")))


@query()
def m04_perceptron(s: SparkSession, d: str) -> DataFrame:
    """Four learning rates, each over rounds of 20 iterations that go on from one another."""
    return _study(M.perceptron_study(_split_wide(s, d, 64), ALL, "target", (0.5, 0.05, 0.005, 0.0005), 20, 3))


FOREST = [{"maxDepth": k, "featureSubsetStrategy": str(f)} for k in (2, 5, 7) for f in (0.1, 0.3, 0.5, 0.7, 0.9)]
BOOST = [{"maxDepth": k, "stepSize": r} for k in (2, 5, 7) for r in (0.1, 0.3, 0.5, 0.7, 0.9)]


@query()
def m05_forest(s: SparkSession, d: str) -> DataFrame:
    """60 candidates from 15 fits: three depths, five shares of variables, four sizes."""
    return _study(_trees(s, d, "forest", FOREST, (5, 10, 20, 40))[0])


@query()
def m05_forest_importances(s: SparkSession, d: str) -> DataFrame:
    """Importances of the winning forest with their deviation over its trees."""
    _, fit = _trees(s, d, "forest", FOREST[5:10], (5, 10, 20))
    return X.importances(s, fit, ALL)


@query()
def m06_boosting(s: SparkSession, d: str) -> DataFrame:
    """45 candidates from 15 fits: three depths, five learning rates, three sizes."""
    return _study(_trees(s, d, "boosting", BOOST, (2, 4, 8))[0])


@query()
def m16_arima(s: SparkSession, d: str) -> DataFrame:
    x = _split_monthly(s, d).unpivot(["ts", "split"], ["y", "x"], "variable", "y")
    return M.arima_study(x, "variable", [(p, k, q) for p in (1, 2) for k in (0, 1) for q in (1,)])


# -- studies ----------------------------------------------------------------------


@query()
def d24_imputation_study(s: SparkSession, d: str) -> DataFrame:
    x = _split_wide(s, d, 64).withColumn("e0", F.when(F.col("vec_id") % 11 == 0, None).otherwise(F.col("e0")))
    return W.imputation_study(x, "vec_id", ALL, "target")


@query()
def d25_outlier_study(s: SparkSession, d: str) -> DataFrame:
    return W.outlier_study(_split_wide(s, d, 64), "vec_id", ALL, "target", 2.0)


@query()
def d26_scaling_study(s: SparkSession, d: str) -> DataFrame:
    return W.scaling_study(_split_wide(s, d, 64), "vec_id", ALL, "target")


@query()
def d27_balancing_study(s: SparkSession, d: str) -> DataFrame:
    return W.balancing_study(_split_wide(s, d, 64), "vec_id", ALL, "target")


_FIT = {
    "Simple Average": "(SELECT avg(y) FROM s WHERE split = 'train')",
    "Persistence Realist": "(SELECT max_by(y, ts) FROM s WHERE split = 'train')",
    "Persistence Optimist": "coalesce(lag(y) OVER (PARTITION BY split ORDER BY ts), (SELECT max_by(y, ts) FROM s WHERE split = 'train'))",
    "Linear Regression": "(SELECT regr_intercept(y, x) FROM s WHERE split = 'train') + (SELECT regr_slope(y, x) FROM s WHERE split = 'train') * x",
}


_ALL_MODELS = ("WITH RECURSIVE " + SPLIT_MONTHLY.removeprefix("WITH ") + """, t AS (SELECT list(y ORDER BY ts) AS l FROM s WHERE split = 'train'),
r AS (SELECT 0 AS i, l[-5:] AS l, CAST(NULL AS DOUBLE) AS yhat FROM t UNION ALL SELECT i + 1, list_append(l, list_sum(l[-5:]) / 5), list_sum(l[-5:]) / 5 FROM r WHERE i < (SELECT count(*) FROM s)),
n AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY ts) AS i FROM s), q AS (SELECT y, i FROM n WHERE split = 'train'),
e AS (SELECT i, y AS l FROM q WHERE i = 1 UNION ALL SELECT q.i, 0.3 * q.y + (1 - 0.3) * e.l FROM e JOIN q ON q.i = e.i + 1), f AS (""" + "\nUNION ALL ".join(f"SELECT split, y, {e} AS yhat, '{m}' AS model FROM s" for m, e in _FIT.items())
               + "\nUNION ALL SELECT split, y, yhat, 'Rolling Mean' FROM n JOIN r USING (i)\nUNION ALL SELECT split, y, (SELECT l FROM e ORDER BY i DESC LIMIT 1), 'Exponential Smoothing' FROM s)\n" + METRICS_SQL.replace("SELECT split,", "SELECT model, split,").replace("GROUP BY split", "GROUP BY model, split").replace(", 6) AS r2", ", 6) + 0.0 AS r2"))


@query(_ALL_MODELS)
def d28_forecast_study(s: SparkSession, d: str) -> DataFrame:
    """All six baseline forecasters."""
    return _searched(W.forecast_study(D.monthly(s, d))).withColumn("r2", F.col("r2") + 0.0)


@query()
def d23_aggregation_study(s: SparkSession, d: str) -> DataFrame:
    return W.aggregation_study(D.daily(s, d), ["W", "M", "Q"])


@query()
def m10_multiple_regression(s: SparkSession, d: str) -> DataFrame:
    x = D.table(s, d, "lineitem").select(F.col("l_extendedprice").alias("y"), "l_quantity", "l_discount", "l_tax", F.when(F.pmod(F.xxhash64("l_orderkey"), F.lit(10)) < 3, "test").otherwise("train").alias("split"))
    return M.forecast_metrics(M.multiple_regression(x, ["l_quantity", "l_discount", "l_tax"], "y"), "y", "yhat", ["split"])


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x_events_by_day(s: SparkSession, d: str) -> DataFrame:
    from kilnframe.streaming.periods import windowed

    x = windowed(D.table(s, d, "events"))
    return x.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# -- more rows, fills and selections -------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 200000")
def r04_range_filter(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "orders").where("o_totalprice >= 1000 and o_totalprice <= 200000").select("o_orderkey", "o_totalprice")


@query(WITH_MIXED + "SELECT row_id, band FROM mixed WHERE band IS NOT NULL")
def r06_dropna_subset(s: SparkSession, d: str) -> DataFrame:
    return D.mixed(s, d).select("row_id", "band").na.drop(subset=["band"])


@query("SELECT doc_id FROM labels WHERE toxic = 1")
def r08_filter_class(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "labels").where("toxic = 1").select("doc_id")


@query(WITH_MONTHLY + "SELECT ts, round(y, 4) AS y FROM (SELECT *, row_number() OVER (ORDER BY ts) AS r FROM monthly) WHERE r > 4")
def r14_tail(s: SparkSession, d: str) -> DataFrame:
    x = D.monthly(s, d).withColumn("r", F.row_number().over(Window.orderBy("ts"))).where("r > 4")
    return r6(x.select("ts", "y"), "y", digits=4)


@query("SELECT coalesce(c_custkey, s_suppkey) AS k, c_acctbal, s_acctbal FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def j01_full_join(s: SparkSession, d: str) -> DataFrame:
    a = D.table(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    return a.join(D.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal"), "k", "full")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey")
def l01_sort(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey")


@query(WITH_MIXED + "SELECT row_id, coalesce(text, '') AS text FROM mixed")
def e03_fill_constant(s: SparkSession, d: str) -> DataFrame:
    return D.mixed(s, d).select("row_id", "text").fillna({"text": ""})


@query("SELECT p_partkey, abs(-p_size) AS a, round(sqrt(p_size), 6) AS b, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(trunc(p_retailprice) AS INT) AS t, round(log10(p_retailprice), 6) AS l FROM part")
def e13_numeric_functions(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "part").select("p_partkey", F.abs(-F.col("p_size")).alias("a"), F.round(F.sqrt("p_size"), 6).alias("b"), F.ceil("p_retailprice").alias("c"), F.col("p_retailprice").cast("int").alias("t"), F.round(F.log10("p_retailprice"), 6).alias("l"))


@query("SELECT p_partkey, upper(p_name) AS u, substr(p_brand, 7) AS n, contains(lower(p_type), 'a') AS has_a, CAST(p_size AS DOUBLE) AS size FROM part")
def e14_string_functions(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "part").select("p_partkey", F.upper("p_name").alias("u"), F.substring("p_brand", 7, 100).alias("n"), F.contains(F.lower("p_type"), F.lit("a")).alias("has_a"), F.col("p_size").cast("double").alias("size"))


@query(WITH_MIXED + "SELECT row_id, round(coalesce(l_tax, (SELECT avg(l_tax) FROM mixed)), 6) AS l_tax, coalesce(band, (SELECT band FROM mixed WHERE band IS NOT NULL GROUP BY band ORDER BY count(*) DESC, band LIMIT 1)) AS band FROM mixed")
def d05_impute_frequent(s: SparkSession, d: str) -> DataFrame:
    x = D.mixed(s, d).select("row_id", "l_tax", "band")
    return r6(P.fill(x, P.fit_fill(x, ["l_tax"], ["band"])), "l_tax")


_THERE = " + ".join(f"coalesce((a.{c} - b.{c}) * (a.{c} - b.{c}), 0)" for c in ALL)
_BOTH = " + ".join(f"CAST(a.{c} IS NOT NULL AND b.{c} IS NOT NULL AS INT)" for c in ALL)


@query(f"WITH {D.wide_sql(range(64))}, g AS (SELECT * REPLACE (" + ", ".join(f"CASE WHEN vec_id % {k} = 0 THEN NULL ELSE {c} END AS {c}" for c, k in _GAPS.items()) + f") FROM wide), p AS (SELECT a.vec_id, b.vec_id AS other, round(sqrt(({_THERE}) * 64 / nullif({_BOTH}, 0)), 9) AS d, " + ", ".join(f"a.{c} IS NULL AND b.{c} IS NOT NULL AS m_{c}, b.{c} AS v_{c}" for c in _GAPS) + " FROM g a JOIN g b ON " + " OR ".join(f"a.{c} IS NULL" for c in _GAPS) + ")"
       + "".join(f", f_{c} AS (SELECT vec_id, avg(v) AS v FROM (SELECT vec_id, v_{c} AS v FROM p WHERE m_{c} AND d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, other) <= 5) GROUP BY 1)" for c in _GAPS)
       + " SELECT g.vec_id, " + ", ".join(f"round(coalesce({c}, f_{c}.v), 6) AS {c}" for c in _GAPS) + " FROM g " + " ".join(f"LEFT JOIN f_{c} ON g.vec_id = f_{c}.vec_id" for c in _GAPS))
def d06_knn_impute(s: SparkSession, d: str) -> DataFrame:
    """Gaps in three of 64 columns; distances over all of them."""
    x = D.wide(s, d, range(64)).withColumns({c: F.when(F.col("vec_id") % k == 0, None).otherwise(F.col(c)) for c, k in _GAPS.items()})
    return r6(P.knn_fill(x, "vec_id", ALL).select("vec_id", *_GAPS), *_GAPS)


@query(WITH_MONTHLY + "SELECT ts, round((y - (SELECT avg(y) FROM monthly)) / (SELECT stddev_pop(y) FROM monthly), 6) AS y, round((x - (SELECT avg(x) FROM monthly)) / (SELECT stddev_pop(x) FROM monthly), 6) AS x FROM monthly")
def d13_scale_series(s: SparkSession, d: str) -> DataFrame:
    return r6(P.scale(D.monthly(s, d), ["y", "x"]), "y", "x")


_VAR_AT = P.variance_thresholds(0.03, 0.001)


@query(f"WITH {D.wide_sql(range(64))}, v AS (" + union("SELECT '{c}' AS variable, var_samp({c}) AS variance FROM wide", ALL) + f") SELECT CAST(t AS DOUBLE) AS threshold, variable FROM v, (SELECT unnest({list(_VAR_AT)}) AS t) WHERE variance < t")
def d19_variance_study(s: SparkSession, d: str) -> DataFrame:
    v = T.low_variance(D.wide(s, d, range(64)), ALL, math.inf)
    return v.select("variable", "variance", F.explode(F.array(*[F.lit(t) for t in _VAR_AT])).alias("threshold")).where("variance < threshold").select("threshold", "variable")


_COR_AT = P.correlation_thresholds(0.05, 0.05)


@query(f"WITH c AS ({CORR_SQL}), t AS (SELECT CAST(unnest({list(_COR_AT)}) AS DOUBLE) AS threshold), m AS (SELECT threshold, v1, v2 FROM c, t WHERE corr >= threshold UNION ALL SELECT threshold, v2, v1 FROM c, t WHERE corr >= threshold) SELECT DISTINCT m.threshold, v2 AS variable FROM m JOIN (SELECT threshold, v1 FROM m GROUP BY ALL HAVING count(*) >= 2) k ON m.threshold = k.threshold AND m.v1 = k.v1")
def d20_redundancy_study(s: SparkSession, d: str) -> DataFrame:
    return T.redundant(p20_abs_corr(s, d), _COR_AT)


def _scores_sql(kept: str, ks: tuple[int, ...] = C.KS) -> str:
    """Measures of both naive Bayes models and of nearest neighbours for the table ``kept(threshold, variable)`` of variables that stay."""
    return f"""{SPLIT_WIDE}, {kept},
z AS (SELECT threshold, CAST(count(*) AS INT) AS n_variables, list_transform({list(ALL)}, lambda c: list_contains(list(variable), c)) AS mask FROM kept GROUP BY 1),
ep AS (SELECT threshold, max(v) * 1e-9 AS eps FROM (SELECT variable, var_pop(x) AS v FROM x WHERE split = 'train' GROUP BY 1) JOIN kept USING (variable) GROUP BY 1),
f AS (SELECT variable, label AS class, avg(x) AS mu, var_pop(x) AS vr, (sum(CAST(x > 0 AS DOUBLE)) + 1) / (count(*) + 2) AS p FROM x WHERE split = 'train' GROUP BY 1, 2),
s AS (SELECT threshold, vec_id, split, label, f.class, sum(-0.5 * ln(2 * pi() * (vr + eps)) - (x - mu) * (x - mu) / (2 * (vr + eps))) + any_value(prior) AS g, sum(CASE WHEN x > 0 THEN ln(p) ELSE ln(1 - p) END) + any_value(prior) AS b FROM x JOIN kept USING (variable) JOIN ep USING (threshold) JOIN f USING (variable) JOIN pr ON pr.class = f.class GROUP BY ALL),
e AS (SELECT vec_id, target, [{", ".join(ALL)}] AS v FROM wide),
n AS (SELECT threshold, a.vec_id, CASE WHEN a.vec_id % 10 < 3 THEN 'test' ELSE 'train' END AS split, a.target AS label, b.target AS vote, b.vec_id AS other, round(sqrt(list_sum([CASE WHEN mask[i] THEN (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]) ELSE 0 END FOR i IN range(1, 65)])), 9) AS d FROM e a JOIN e b ON b.vec_id % 10 >= 3, z),
t AS (SELECT *, row_number() OVER (PARTITION BY threshold, vec_id ORDER BY d, other) AS r FROM n QUALIFY r <= {max(ks)}),
c AS (SELECT threshold, k, vec_id, split, label, vote, count(*) AS c FROM t, (SELECT unnest({list(ks)}) AS k) WHERE r <= k GROUP BY ALL),
y AS (SELECT threshold, 'GaussianNB' AS model, split, label, first(class ORDER BY round(g, 9) DESC, class) AS predicted FROM s GROUP BY threshold, vec_id, split, label
UNION ALL SELECT threshold, 'BernoulliNB', split, label, first(class ORDER BY round(b, 9) DESC, class) FROM s GROUP BY threshold, vec_id, split, label
UNION ALL SELECT threshold, 'KNN k=' || k, split, label, first(vote ORDER BY c DESC, vote) FROM c GROUP BY threshold, k, vec_id, split, label),
w AS (SELECT threshold, model, split, {_COUNTED} FROM y GROUP BY ALL) SELECT threshold, n_variables, model, split, {_MEASURED} FROM w JOIN z USING (threshold)"""


_VARS = "v AS (SELECT variable, var_samp(x) AS v FROM x WHERE split = 'train' GROUP BY 1)"


@query(_scores_sql(f"{_VARS}, kept AS MATERIALIZED (SELECT CAST(t AS DOUBLE) AS threshold, variable FROM v, (SELECT unnest({list(_VAR_AT)}) AS t) WHERE NOT v < t)"))
def d19_variance_scores(s: SparkSession, d: str) -> DataFrame:
    """Measures of naive Bayes and nearest neighbours at every variance threshold."""
    x = _split_wide(s, d, 64)
    return _study(C.study(x, "vec_id", ALL, "target", C.variance_sets(x, ALL, _VAR_AT)))


@query(_scores_sql(f"""o AS (SELECT a.variable AS v1, b.variable AS v2, round(abs(corr(a.x, b.x)), 12) AS corr FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.variable < b.variable WHERE a.split = 'train' GROUP BY 1, 2),
th AS (SELECT CAST(unnest({list(_COR_AT)}) AS DOUBLE) AS threshold), mm AS (SELECT threshold, v1, v2 FROM o, th WHERE corr >= threshold UNION ALL SELECT threshold, v2, v1 FROM o, th WHERE corr >= threshold),
gone AS (SELECT DISTINCT mm.threshold, v2 AS variable FROM mm JOIN (SELECT threshold, v1 FROM mm GROUP BY ALL HAVING count(*) >= 2) q ON mm.threshold = q.threshold AND mm.v1 = q.v1),
kept AS MATERIALIZED (SELECT threshold, variable FROM th, (SELECT unnest({list(ALL)}) AS variable) WHERE (threshold, variable) NOT IN (SELECT threshold, variable FROM gone))"""))  # fmt: skip
def d20_redundancy_scores(s: SparkSession, d: str) -> DataFrame:
    """Measures of naive Bayes and nearest neighbours at every correlation threshold."""
    x = _split_wide(s, d, 64)
    return _study(C.study(x, "vec_id", ALL, "target", C.redundancy_sets(x, ALL, _COR_AT)))


@query()
def d30_classification_chain(s: SparkSession, d: str) -> DataFrame:
    """Five stages, each going on from the winner of the one before; a row for each technique."""
    x = _split_wide(s, d, 64).withColumns({c: F.when(F.col("vec_id") % k == 0, None).otherwise(F.col(c)) for c, k in _GAPS.items()})
    t = H.Table(x, "vec_id", ALL, "target")
    return H.run(t, H.classification_stages((0.013, 0.015, 0.017, 0.02), (0.1, 0.15, 0.3)), H.classification_scores(), folder(s, "chain"))[1]


@query()
def d30_forecast_chain(s: SparkSession, d: str) -> DataFrame:
    """Aggregation, scaling, smoothing and differences of the daily series; a row for each technique."""
    t = H.Table(P.split_temporal(D.daily(s, d), "ts", 0.9), "ts", ("y", "x"), "y")
    return H.run(t, H.forecast_stages(), H.forecast_scores, folder(s, "chain"))[1]


@query(f"WITH {D.wide_sql(range(64))}, l AS (" + union("SELECT vec_id, '{c}' AS variable, {c} AS x FROM wide", ALL) + f"), low AS ({_SQL['d17_low_variance']}), same AS ({_SQL['d18_redundant'].replace('0.02', '0.12')})\nSELECT vec_id, variable, x FROM l WHERE variable NOT IN (SELECT variable FROM low) AND variable NOT IN (SELECT variable FROM same)")
def d22_apply_selection(s: SparkSession, d: str) -> DataFrame:
    """Drops what the two selectors name, some of 64 columns, and returns the rest in long form."""
    gone = {r.variable for r in d17_low_variance(s, d).select("variable").union(T.redundant(p20_abs_corr(s, d), 0.12)).collect()}
    x = D.wide(s, d, range(64)).drop("target", *gone)
    left = [c for c in ALL if c not in gone]
    return x.unpivot("vec_id", left, "variable", "x") if left else s.createDataFrame([], "vec_id long, variable string, x double")


_SCALED = {"Original": ("y", "x"), "Standard": ("(y - my) / sy", "(x - mx) / sx"), "MinMax": ("(y - ly) / (hy - ly)", "(x - lx) / (hx - lx)")}


@query(SPLIT_MONTHLY + ", p AS (SELECT avg(y) AS my, stddev_pop(y) AS sy, min(y) AS ly, max(y) AS hy, avg(x) AS mx, stddev_pop(x) AS sx, min(x) AS lx, max(x) AS hx FROM s WHERE split = 'train'), z AS (" + "\nUNION ALL ".join(f"SELECT '{t}' AS technique, split, {y} AS y, {x} AS x FROM s, p" for t, (y, x) in _SCALED.items())
       + "), c AS (SELECT technique, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM z WHERE split = 'train' GROUP BY technique), f AS (SELECT z.*, b + a * x AS yhat FROM z JOIN c USING (technique))\n" + METRICS_SQL.replace("SELECT split,", "SELECT technique, split,").replace("GROUP BY split", "GROUP BY technique, split"))
def d28_forecast_scaling_study(s: SparkSession, d: str) -> DataFrame:
    x = W.forecast_scaling_study(D.monthly(s, d))
    return x.withColumns({"rmse": F.round("rmse", 4), "mae": F.round("mae", 4), "mape": F.round("mape", 6), "r2": F.round("r2", 6)})


@query(_ALL_MODELS)
def m20_forecast_models(s: SparkSession, d: str) -> DataFrame:
    """All six baseline forecasters side by side."""
    return d28_forecast_study(s, d)
