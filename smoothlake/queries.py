"""The registered queries over the driver's tables, with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smoothlake.operators import bayes, diagnostics, gamm, gamlss, knots, mixed, multifamilies, qgam
from smoothlake.operators.bases import make
from smoothlake.operators.gam import bam, compress, gam, BamControl, GamControl, OFFSET, WEIGHT
from smoothlake.operators.families import Poisson
from smoothlake.operators.rowmap import add_columns
from smoothlake.operators.scam import scam, scasm
from smoothlake.plans.formula import Formula, s
from smoothlake.sources.rows import SparkRows, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted curve of price on quantity, with standard errors."""
    li = table(spark, sf_dir, "lineitem")
    m = bam("l_extendedprice ~ s(l_quantity, k=10, bs='cr')", li)
    return m.predict(li.select("l_quantity").distinct(), se=True)


# -- profile, bins, bases --------------------------------------------------------------------------------------

@query("""WITH q AS (SELECT quantile_cont(x, [0.0, 1/9.0::DOUBLE, 2/9.0::DOUBLE, 3/9.0::DOUBLE, 4/9.0::DOUBLE, 5/9.0::DOUBLE, 6/9.0::DOUBLE, 7/9.0::DOUBLE, 8/9.0::DOUBLE, 1.0]) AS q FROM (SELECT DISTINCT l_extendedprice AS x FROM lineitem))
SELECT CAST(i AS INTEGER) AS knot_id, round(q[i + 1], 6) AS knot FROM q, range(10) t(i)""")
def knots_quantile(spark, sf_dir):
    k = knots.place_knots(table(spark, sf_dir, "lineitem"), "l_extendedprice", 10)
    return k.select(F.col("knot_id").cast("int").alias("knot_id"), F.round("knot", 6).alias("knot"))


@query("""WITH r AS (SELECT min(value) lo, max(value) hi FROM events)
SELECT CAST(least(floor((value - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n, round(avg(value), 6) AS mean_value FROM events, r GROUP BY 1""")
def discretize_bins(spark, sf_dir):
    d = knots.equal_bins(table(spark, sf_dir, "events"), "value", 20)
    return d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def _basis(spark, sf_dir, spec, column="l_quantity", digits=8):
    """The distinct values of a column with the raw columns of a basis, b0, b1, ..."""
    x = table(spark, sf_dir, "lineitem").select(F.col(column).cast("double").alias("x")).distinct()
    basis = make(spec, SparkRows(x, 1))
    names = [f"b{i}" for i in range(basis.width)]
    out = add_columns(x, ["x"], lambda cols: dict(zip(names, basis.raw(cols).T, strict=True)), names)
    return out.select("x", *[F.round(n, digits).alias(n) for n in names])


_HAT = "WITH d AS (SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS x FROM lineitem), r AS (SELECT min(x) lo, (max(x) - min(x)) / 5 h FROM d) "


@query(_HAT + "SELECT x, " + ", ".join(f"round(greatest(0, 1 - abs((x - lo) / h - {i})), 8) AS b{i}" for i in range(6)) + " FROM d, r")
def spde_hat_basis(spark, sf_dir):
    return _basis(spark, sf_dir, s("x", bs="spde", k=6))


def _cubic(u: str) -> str:
    """The uniform cubic B-spline in units of knots, centred on 2."""
    return f"CASE WHEN {u} < 0 OR {u} >= 4 THEN 0 WHEN {u} < 1 THEN {u}**3 / 6 WHEN {u} < 2 THEN (-3 * ({u} - 1)**3 + 3 * ({u} - 1)**2 + 3 * ({u} - 1) + 1) / 6 WHEN {u} < 3 THEN (3 * ({u} - 2)**3 - 6 * ({u} - 2)**2 + 4) / 6 ELSE (1 - ({u} - 3))**3 / 6 END"


@query("WITH d AS (SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS x FROM lineitem), r AS (SELECT min(x) lo, (max(x) - min(x)) / 5 h FROM d), u AS (SELECT x, (x - lo) / h AS v FROM d, r) SELECT x, " + ", ".join(f"round({_cubic(f'(v - {i - 3})')}, 6) AS b{i}" for i in range(8)) + " FROM u")
def bspline_basis(spark, sf_dir):
    return _basis(spark, sf_dir, s("x", bs="ps", k=8), digits=6)


@query("""WITH d AS (SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS x FROM lineitem), m AS (SELECT max(x) AS top FROM d)
SELECT x, round(x / top, 8) AS b0, round(pow(x / top, 2), 8) AS b1 FROM d, m""")
def fp_basis(spark, sf_dir):
    return _basis(spark, sf_dir, s("x", bs="fp"))


@query("""WITH d AS (SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS x FROM lineitem),
k AS (SELECT quantile_cont(x, 0.1) k0, quantile_cont(x, 0.3) k1, quantile_cont(x, 0.5) k2, quantile_cont(x, 0.7) k3, quantile_cont(x, 0.9) k4, greatest(0.75 * (max(x) - min(x)) / 4, 0) h0 FROM d),
h AS (SELECT *, greatest(h0, 1.01 * greatest(k1 - k0, k2 - k1, k3 - k2, k4 - k3)) h FROM k)
SELECT x, """ + ", ".join(f"round(CASE WHEN abs(x - k{i}) < h THEN pow(1 - pow(abs(x - k{i}) / h, 3), 3) ELSE 0 END, 6) AS b{i}" for i in range(5)) + " FROM d, h")
def loess_kernel_basis(spark, sf_dir):
    return _basis(spark, sf_dir, s("x", bs="lo", k=5), digits=6)


@query("SELECT x, " + ", ".join(f"round(CASE WHEN x = {v} THEN 1.0 ELSE 0.0 END, 1) AS b{i}" for i, v in enumerate((1, 2, 3, 4, 5, 6, 7))) + " FROM (SELECT DISTINCT CAST(l_linenumber AS DOUBLE) AS x FROM lineitem)")
def factor_basis(spark, sf_dir):
    return _basis(spark, sf_dir, s("x", bs="re"), "l_linenumber", 1)


# -- passes ------------------------------------------------------------------------------------------------------

@query("""WITH t AS (SELECT 1.0 AS x0, CAST(l_quantity AS DOUBLE) AS x1, CAST(l_quantity AS DOUBLE) * l_quantity AS x2 FROM lineitem)
SELECT 'n' AS entry, round(avg(x0), 6) AS v FROM t UNION ALL SELECT 'x', round(avg(x1), 6) FROM t UNION ALL SELECT 'x2', round(avg(x2), 6) FROM t
UNION ALL SELECT 'x3', round(avg(x1 * x2), 4) FROM t UNION ALL SELECT 'x4', round(avg(x2 * x2), 2) FROM t""")
def gram_small(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"))

    def block(cols):
        x = np.vander(cols["x"], 3, increasing=True)
        return {"g": x.T @ x}

    g = SparkRows(li, 0).sweep(block)["g"]
    g = g / g[0, 0]
    rows = [("n", 1.0), ("x", round(g[0, 1], 6)), ("x2", round(g[1, 1], 6)), ("x3", round(g[1, 2], 4)), ("x4", round(g[2, 2], 2))]
    return spark.createDataFrame([(a, float(b)) for a, b in rows], "entry string, v double")


@query("""SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, count(*) AS n FROM lineitem""")
def ols_gaussian(spark, sf_dir):
    m = bam("l_extendedprice ~ l_quantity", table(spark, sf_dir, "lineitem"))
    return spark.createDataFrame([(round(float(m.beta[0]), 4), round(float(m.beta[1]), 6), round(m.r2(), 8), m.n)], "intercept double, slope double, r2 double, n long")


@query("""WITH t AS (SELECT CAST(l_quantity AS DOUBLE) AS y FROM lineitem), m AS (SELECT avg(y) AS mu FROM t), b AS (SELECT CAST(quality AS DOUBLE) AS y FROM labels), mb AS (SELECT avg(y) AS mu FROM b)
SELECT 'normal' AS family, round(avg((y - mu) * (y - mu)), 6) AS deviance FROM t, m UNION ALL SELECT 'poisson', round(avg(2 * (y * ln(y / mu) - (y - mu))), 6) FROM t, m
UNION ALL SELECT 'gamma', round(avg(2 * ((y - mu) / mu - ln(y / mu))), 6) FROM t, m UNION ALL SELECT 'inverse_gaussian', round(avg((y - mu) * (y - mu) / (mu * mu * y)), 6) FROM t, m
UNION ALL SELECT 'binomial', round(avg(-2 * CASE WHEN y = 1 THEN ln(mu) ELSE ln(1 - mu) END), 6) FROM b, mb""")
def null_deviance(spark, sf_dir):
    li, labels = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "labels")
    rows = []
    for family in ("normal", "poisson", "gamma", "inverse_gaussian", "binomial"):
        m = bam("quality ~ 1" if family == "binomial" else "l_quantity ~ 1", labels if family == "binomial" else li, family)
        rows.append((family, round(m.null_deviance / m.n, 6)))
    return spark.createDataFrame(rows, "family string, deviance double")


@query("""WITH t AS (SELECT l_returnflag AS flag, CAST(l_quantity AS DOUBLE) AS y FROM lineitem), m AS (SELECT avg(y) AS mu FROM t)
SELECT flag, round(avg(y - mu), 6) AS response, round(avg((y - mu) / sqrt(mu)), 6) AS pearson, round(avg((y - mu) / mu), 6) AS working,
round(avg(sign(y - mu) * sqrt(2 * (y * ln(y / mu) - (y - mu)))), 6) AS deviance FROM t, m GROUP BY flag""")
def residual_types(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("l_quantity"))
    m = bam("l_quantity ~ 1", li, "poisson")
    out = None
    for kind in ("response", "pearson", "working", "deviance"):
        r = m.residuals(kind, li).groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.avg("resid"), 6).alias(kind))
        out = r if out is None else out.join(r, "flag")
    return out


@query("""WITH t AS (SELECT CAST(l_quantity AS DOUBLE) AS x, l_discount AS d, count(*) AS n, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2)
SELECT x, d, n, round(y, 6) AS mean_y FROM t""")
def compress_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice").withColumn(WEIGHT, F.lit(1.0)).withColumn(OFFSET, F.lit(0.0))
    c = compress(li, Formula("l_extendedprice", ("l_quantity", "l_discount")), Poisson(), BamControl(), None)
    return c.select(F.col("l_quantity").cast("double").alias("x"), F.col("l_discount").alias("d"), F.col(WEIGHT).cast("long").alias("n"), F.round("l_extendedprice", 6).alias("mean_y"))


@query("SELECT count(*) AS n, (SELECT count(*) FROM events) - count(*) AS n_null, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM (SELECT CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events) WHERE value IS NOT NULL")
def validate_columns(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))  # with nulls
    kept, n, r = validate(e, ["value"], ["value"], "drop")
    return spark.createDataFrame([(kept.count(), e.count() - n, round(r["value"][0], 6), round(r["value"][1], 6))], "n long, n_null long, lo double, hi double")


@query("""WITH m AS (SELECT regr_intercept(l_extendedprice, l_quantity) a, regr_slope(l_extendedprice, l_quantity) b FROM lineitem)
SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS x, round(a + b * l_quantity, 4) AS fit FROM lineitem, m""")
def predict_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    p = bam("l_extendedprice ~ l_quantity", li).predict(li.select("l_quantity").distinct())
    return p.select(F.col("l_quantity").cast("double").alias("x"), F.round("fit", 4).alias("fit"))


# -- losses, checks ------------------------------------------------------------------------------------------------

@query("""WITH q AS (SELECT 0.1 AS qu UNION ALL SELECT 0.5 UNION ALL SELECT 0.9), t AS (SELECT CAST(l_quantity AS DOUBLE) AS y FROM lineitem)
SELECT CAST(qu AS DOUBLE) AS qu, round(avg(CASE WHEN y < 25 THEN (1 - qu) * (25 - y) ELSE qu * (y - 25) END), 6) AS loss FROM t, q GROUP BY qu""")
def pinball_losses(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("y"), F.lit(25.0).alias("fit"))
    r = li.agg(*[F.round(F.avg(qgam.pinball("fit", "y", q)), 6) for q in (0.1, 0.5, 0.9)]).first()
    return spark.createDataFrame([(q, v) for q, v in zip((0.1, 0.5, 0.9), r, strict=True)], "qu double, loss double")


@query("""WITH t AS (SELECT CAST(l_quantity AS DOUBLE) AS x, l_extendedprice AS y FROM lineitem), r AS (SELECT min(x) lo, max(x) hi FROM t)
SELECT CAST(least(floor((x - lo) / ((hi - lo) / 8)), 7) AS INTEGER) AS bin, round(avg(CASE WHEN y < 50000 THEN 1.0 ELSE 0.0 END), 8) AS proportion, count(*) AS bin_size FROM t, r GROUP BY 1""")
def cqcheck_bins(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").alias("y"), F.lit(50000.0).alias("fit"))
    return qgam.cqcheck_table(li, "x", "y", "fit", 0.5, 8).select("bin", F.round("proportion", 8).alias("proportion"), "bin_size")


@query("""WITH y AS (SELECT CAST(count(*) AS DOUBLE) AS y FROM lineitem GROUP BY l_orderkey), m AS (SELECT avg(y) AS mu, count(*) AS n FROM y),
k AS (SELECT i AS k, exp(sum(ln(greatest(j, 1)))) AS f FROM range(13) a(i), range(13) b(j) WHERE j <= i GROUP BY i)
SELECT CAST(k.k AS INTEGER) AS count, (SELECT count(*) FROM y WHERE y.y = k.k)::DOUBLE AS observed, round(n * exp(-mu) * pow(mu, k.k) / f, 4) AS expected FROM k, m""")
def rootogram_counts(spark, sf_dir):
    y = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("double").alias("y"))
    r = diagnostics.rootogram(gam("y ~ 1", y, "poisson"), 12)
    return r.select("count", "observed", F.round("expected", 4).alias("expected"))


@query("""WITH g AS (SELECT l_suppkey AS level, count(*) AS n, avg(l_extendedprice) AS a FROM lineitem GROUP BY 1), m AS (SELECT sum(n * n / (n + 10.0) * a) / sum(n * n / (n + 10.0)) AS mu FROM g)
SELECT level, round(n / (n + 10.0) * (a - mu), 4) AS effect FROM g, m""")
def re_group_effects(spark, sf_dir):
    """The effects of ``s(l_suppkey, bs='re', sp=10)``, with a supplier's sums as a row on the cluster."""
    from smoothlake.operators.gamm_large import gamm_large

    li = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_suppkey")
    m = gamm_large("l_extendedprice ~ 1 + (1 | l_suppkey)", li, ratio=10.0, centred=True)
    return m.ranef().select(F.col("level").cast("long").alias("level"), F.round("effect", 4).alias("effect"))


@query("""SELECT a.n_nationkey AS region, count(*) AS degree FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY 1""")
def mrf_laplacian_degree(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    other = n.select(F.col("n_nationkey").alias("other"), "n_regionkey")
    return knots.laplacian(n.join(other, "n_regionkey"), "n_nationkey", "other")


@query()
def concurvity_pairs(spark, sf_dir):
    m = bam("l_extendedprice ~ s(l_quantity, k=4, bs='cr') + s(l_discount, k=4, bs='cr') + l_tax", table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_tax"))
    return spark.createDataFrame([(a, b, v) for (a, b), v in diagnostics.concurvity(m, full=False).items()], "term string, other string, concurvity double")


@query("""WITH t AS (SELECT event_id, value - (SELECT avg(value) FROM events) AS r FROM events), k AS (SELECT event_id, (row_number() OVER (ORDER BY r) - 0.5) / (SELECT count(*) FROM events) AS p, r FROM t)
SELECT CAST(floor(p * 20) AS INTEGER) AS vigintile, count(*) AS n, round(avg(r), 6) AS mean_resid FROM k GROUP BY 1""")
def qq_appraise(spark, sf_dir):
    m = gam("value ~ 1", table(spark, sf_dir, "events"))
    a = diagnostics.appraise(m, "response")
    return a.groupBy(F.floor(F.col("prob") * 20).cast("int").alias("vigintile")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("resid"), 6).alias("mean_resid"))


@query("""WITH t AS (SELECT (CAST(l_quantity AS DOUBLE) - (SELECT min(l_quantity) FROM lineitem)) / (SELECT max(l_quantity) - min(l_quantity) FROM lineitem) * 4 AS u, (l_discount - (SELECT min(l_discount) FROM lineitem)) / (SELECT max(l_discount) - min(l_discount) FROM lineitem) * 4 AS v FROM lineitem)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(avg(greatest(0, 1 - abs(u - i)) * greatest(0, 1 - abs(v - j))), 8) AS moment FROM t, range(5) a(i), range(5) b(j) GROUP BY 1, 2""")
def tensor_moments(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("a"), F.col("l_discount").cast("double").alias("b"))
    rows = SparkRows(li, 1)
    basis = make(Formula("y", (), True, (_te("a", "b"),)).smooths[0], rows)
    r = rows.sweep(lambda c: {"m": basis.raw(c).sum(0), "n": np.array([len(c["a"])])})
    m = r["m"] / r["n"][0]
    return spark.createDataFrame([(k // 5, k % 5, round(float(v), 8)) for k, v in enumerate(m)], "i int, j int, moment double")


def _te(*names):
    from smoothlake.plans.formula import te

    return te(*names, bs="spde", k=5)


@query("""WITH t AS (SELECT l_returnflag AS level, CAST(l_quantity AS DOUBLE) AS x FROM lineitem), r AS (SELECT min(x) lo, (max(x) - min(x)) / 4 h FROM t)
SELECT level, CAST(i AS INTEGER) AS i, round(sum(greatest(0, 1 - abs((x - lo) / h - i))), 4) AS total FROM t, r, range(5) a(i) GROUP BY 1, 2""")
def factor_smooth_sums(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("level"), F.col("l_quantity").cast("double").alias("x"))
    rows = SparkRows(li, 1)
    basis = make(s("x", "level", bs="fs", k=5, xt={"bs": "spde", "by": "level"}), rows)
    t = rows.sweep(lambda c: {"t": basis.raw(c).sum(0)})["t"].reshape(len(basis.levels), -1)
    return spark.createDataFrame([(v, i, round(float(t[a, i]), 4)) for a, v in enumerate(basis.levels) for i in range(t.shape[1])], "level string, i int, total double")


@query("""WITH t AS (SELECT CAST(quality AS DOUBLE) AS y, CAST(n_chars AS DOUBLE) / 10000 AS x FROM labels JOIN documents USING (doc_id)), s AS (SELECT count(*) n, sum(x) sx, sum(x * x) sxx, sum(4 * (y - 0.5)) sz, sum(4 * (y - 0.5) * x) sxz FROM t)
SELECT round((sxx * sz - sx * sxz) / (n * sxx - sx * sx), 8) AS intercept, round((n * sxz - sx * sz) / (n * sxx - sx * sx), 8) AS slope FROM s""")
def logit_first_step(spark, sf_dir):
    from smoothlake.operators.families import Binomial
    from smoothlake.operators.gam import working_pass
    from smoothlake.plans.design import bind

    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    t = t.select(F.col("quality").cast("double").alias("y"), (F.col("n_chars").cast("double") / 10000).alias("x")).withColumn(WEIGHT, F.lit(1.0)).withColumn(OFFSET, F.lit(0.0))
    rows = SparkRows(t, 1)
    f = Formula("y", ("x",))
    r = rows.sweep(working_pass(bind(f, rows), Binomial(), "y", np.zeros(2)))
    b = np.linalg.solve(r["g"], r["b"])
    return spark.createDataFrame([(round(float(b[0]), 8), round(float(b[1]), 8))], "intercept double, slope double")


# -- fits at given smoothing, whose normal equations SQL can solve ---------------------------------------------------

def _eliminated(matrix: str, source: str, n: int) -> str:
    """Recursive CTE ``e``: Gauss-Jordan steps on an n x (n + 1) matrix; the solution is the last column after step n."""
    return f"""e AS (SELECT 0 AS step, {matrix} AS m FROM {source} UNION ALL
SELECT step + 1, list_transform(m, lambda r, i: CASE WHEN i = step + 1 THEN list_transform(r, lambda v: v / r[step + 1]) ELSE list_transform(r, lambda v, j: v - r[step + 1] * m[step + 1][j] / m[step + 1][step + 1]) END) FROM e WHERE step < {n})"""


def _normal_equations(k: int, factor: float, order: int = 2) -> str:
    """Sums of products of the list ``b`` with itself and ``y``, plus ``factor`` times the difference penalty."""
    d = np.diff(np.eye(k), order, axis=0)
    s = d.T @ d
    rows = ["[" + ", ".join([f"sum(b[{i + 1}] * b[{j + 1}]) + {float(factor * s[i, j])}" for j in range(k)] + [f"sum(b[{i + 1}] * y)"]) + "]" for i in range(k)]
    return "[" + ", ".join(rows) + "]"


@query("WITH RECURSIVE r AS (SELECT min(l_quantity) lo, (max(l_quantity) - min(l_quantity)) / 3 h FROM lineitem), u AS (SELECT CAST(l_quantity AS DOUBLE) AS x, l_extendedprice AS y, (l_quantity - lo) / h AS v FROM lineitem, r), "
    + "b AS (SELECT x, y, [" + ", ".join(_cubic(f"(v - {i - 3})") for i in range(6)) + "] AS b FROM u), " + _eliminated(_normal_equations(6, 4000.0 / 16), "b", 6)
    + " SELECT x, round(" + " + ".join(f"b[{i}] * m[{i}][7]" for i in range(1, 7)) + ", 4) AS fit FROM (SELECT DISTINCT x, b FROM b), e WHERE step = 6")
def gam_given_smoothing(spark, sf_dir):
    """A P-spline whose penalty, relative to its largest column sum of 16, weighs 4000."""
    li = table(spark, sf_dir, "lineitem")
    m = bam("l_extendedprice ~ s(l_quantity, k=6, bs='ps', sp=4000.0)", li)
    return m.predict(li.select("l_quantity").distinct()).select(F.col("l_quantity").cast("double").alias("x"), F.round("fit", 4).alias("fit"))


@query("""WITH RECURSIVE g AS (SELECT n_nationkey AS level, n_regionkey AS region, count(c_acctbal) AS n, coalesce(sum(c_acctbal), 0) AS t FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2),
z AS (SELECT region, count(*) AS k FROM g GROUP BY 1), l AS (SELECT 40.0 / (2 * (max(k) - 1)) AS l FROM z),
s AS (SELECT region, sum(t / (n + k * l)) / (1 - any_value(l) * sum(1 / (n + k * l))) AS s FROM g JOIN z USING (region), l GROUP BY 1)
SELECT CAST(level AS BIGINT) AS nation, round((t + l * s) / (n + k * l), 4) AS fit FROM g JOIN z USING (region) JOIN s USING (region), l""")
def mrf_given_smoothing(spark, sf_dir):
    """Balances by nation, smoothed towards the other nations of the region."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    regions: dict = {}
    for r in nations.collect():  # the graph is a parameter of the basis
        regions.setdefault(r.n_regionkey, []).append(r.n_nationkey)
    nb = {v: [w for w in near if w != v] for near in regions.values() for v in near}
    f = Formula("c_acctbal", (), True, (s("c_nationkey", bs="mrf", sp=40.0, xt={"nb": nb}),))
    m = bam(f, table(spark, sf_dir, "customer").select("c_acctbal", "c_nationkey"))
    p = m.predict(nations.select(F.col("n_nationkey").alias("c_nationkey")))
    return p.select(F.col("c_nationkey").cast("long").alias("nation"), F.round("fit", 4).alias("fit"))


def _newton(n_table: str, mean: str, weight: str, start: str) -> str:
    """Recursive CTE ``e`` of Newton steps for two coefficients over rows (x, n, t) held as one list."""
    eta = "e.a + e.c * q.x"
    mu, w = mean.format(eta), weight.format(eta)
    parts = {"g0": f"q.t - q.n * {mu}", "g1": f"(q.t - q.n * {mu}) * q.x", "h0": f"q.n * {w}", "h1": f"q.n * {w} * q.x", "h2": f"q.n * {w} * q.x * q.x"}
    sums = ", ".join(f"list_sum(list_transform(d, lambda q: {v})) AS {k}" for k, v in parts.items())
    return f"""d AS (SELECT list({{'x': x, 'n': n, 't': t}}) AS d FROM {n_table}), e AS (SELECT 0 AS step, {start} AS a, CAST(0 AS DOUBLE) AS c FROM {n_table} UNION ALL
SELECT step + 1, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1), c + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) FROM (SELECT step, a, c, {sums} FROM e, d) WHERE step < 15)"""


_SUMS = "WITH RECURSIVE t AS (SELECT x, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS t FROM ({}) GROUP BY x), "
_LOGIT = "SELECT CAST(quality AS DOUBLE) AS y, CAST(n_chars AS DOUBLE) / 10000 AS x FROM labels JOIN documents USING (doc_id)"


@query(_SUMS.format("SELECT CAST(l_quantity AS DOUBLE) AS y, CAST(l_discount AS DOUBLE) * 10 AS x FROM lineitem") + _newton("t", "exp({})", "exp({})", "ln(sum(t) / sum(n))")
    + " SELECT 'poisson' AS family, round(a, 6) AS intercept, round(c, 6) AS slope FROM e WHERE step = 15")
def glm_poisson(spark, sf_dir):
    """A Poisson regression at its maximum."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("y"), (F.col("l_discount") * 10).alias("x"))
    return _coefficients(spark, bam("y ~ x", li, "poisson", control=GamControl(epsilon=1e-13)))


@query(_SUMS.format(_LOGIT) + _newton("t", "(1 / (1 + exp(-({}))))", "(exp(-({0})) / pow(1 + exp(-({0})), 2))", "ln(sum(t) / (sum(n) - sum(t)))")
    + " SELECT 'binomial' AS family, round(a, 6) AS intercept, round(c, 6) AS slope FROM e WHERE step = 15")
def glm_binomial(spark, sf_dir):
    """A logistic regression at its maximum."""
    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    t = t.select(F.col("quality").cast("double").alias("y"), (F.col("n_chars").cast("double") / 10000).alias("x"))
    return _coefficients(spark, gam("y ~ x", t, "binomial", control=GamControl(epsilon=1e-13)))


_POISSON_ROWS = "SELECT CAST(l_quantity AS DOUBLE) AS y, CAST(l_tax AS DOUBLE) * 10 AS x FROM lineitem"
_AT_END = "SELECT '{0}' AS family, round(a, 5) AS intercept, round(c, 5) AS slope, round(sum(t.t * (a + c * t.x) - {1}){2}, 3) AS loglik FROM t, e WHERE step = 15 GROUP BY a, c"


@query(_SUMS.format(_POISSON_ROWS) + _newton("t", "exp({})", "exp({})", "ln(sum(t) / sum(n))") + _AT_END.format("poisson", "t.n * exp(a + c * t.x)", f" - (SELECT sum(lgamma(y + 1)) FROM ({_POISSON_ROWS}))"))
def general_poisson(spark, sf_dir):
    """A Poisson regression by the general optimizer over rows on the cluster, with its likelihood."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("y"), (F.col("l_tax") * 10).alias("x"))
    return _with_likelihood(spark, gam("y ~ x", li, "poisson", optimizer="general", control=GamControl(local_rows=0)))


@query(_SUMS.format(_LOGIT) + _newton("t", "(1 / (1 + exp(-({}))))", "(exp(-({0})) / pow(1 + exp(-({0})), 2))", "ln(sum(t) / (sum(n) - sum(t)))") + _AT_END.format("binomial", "t.n * ln(1 + exp(a + c * t.x))", ""))
def general_binomial(spark, sf_dir):
    """A logistic regression by the general optimizer over rows on the cluster, with its likelihood."""
    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    t = t.select(F.col("quality").cast("double").alias("y"), (F.col("n_chars").cast("double") / 10000).alias("x"))
    return _with_likelihood(spark, gam("y ~ x", t, "binomial", optimizer="general", control=GamControl(local_rows=0)))


@query("SELECT CAST(count(*) AS DOUBLE) AS n, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem")
def stream_ols(spark, sf_dir):
    """A regression whose rows arrive as a stream, its sums kept in a table."""
    from smoothlake.sources.shared import shared_folder
    from smoothlake.streaming.accumulate import StreamingGam

    path, folder = f"{sf_dir}/lineitem.parquet", shared_folder(spark, "stream")
    li = spark.read.parquet(path)
    model = StreamingGam("l_extendedprice ~ l_quantity", li, state=f"{folder}/state")
    stream = spark.readStream.schema(li.schema).parquet(path[:-1] + "[t]")  # a pattern: the table may be one file
    model.attach(stream, f"{folder}/checkpoint", available_now=True).awaitTermination()
    b = model.solve()["beta"]
    return spark.createDataFrame([(float(model.n), round(float(b[0]), 4), round(float(b[1]), 4))], "n double, intercept double, slope double")


def _with_likelihood(spark, m):
    row = (m.family.name, round(float(m.beta[0]), 5), round(float(m.beta[1]), 5), round(m.loglikelihood(), 3))
    m.close()
    return spark.createDataFrame([row], "family string, intercept double, slope double, loglik double")


def _coefficients(spark, m):
    return spark.createDataFrame([(m.family.name, round(float(m.beta[0]), 6), round(float(m.beta[1]), 6))], "family string, intercept double, slope double")


@query("SELECT l_returnflag AS flag, round(avg(CAST(l_quantity AS DOUBLE)), 4) AS mu, round(stddev_pop(CAST(l_quantity AS DOUBLE)), 4) AS sigma FROM lineitem GROUP BY 1")
def gamlss_groups(spark, sf_dir):
    """Location and scale by group, whose maximum of the likelihood is each group's mean and deviation."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("y"))
    m = gamlss.gamlss(["y ~ l_returnflag", "~ l_returnflag"], li, multifamilies.GaussianLS())
    return m.predict(li.select("l_returnflag").distinct()).select(F.col("l_returnflag").alias("flag"), F.round("mu", 4).alias("mu"), F.round("sigma", 4).alias("sigma"))


# -- fits without a closed form: rows only -------------------------------------------------------------------------

@query()
def gam_price_curve(spark, sf_dir):
    return flagship(spark, sf_dir)


@query()
def gam_cyclic_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.hour("ts").cast("double").alias("hour"), "event_type", "value")
    return bam("value ~ event_type + s(hour, bs='cc', k=8)", e).predict(e.select("hour", "event_type").distinct(), se=True)


@query()
def gam_tensor(spark, sf_dir):
    m = bam("l_extendedprice ~ te(l_quantity, l_discount, k=4)", table(spark, sf_dir, "lineitem"))
    return diagnostics.overview(m)


@query()
def gam_binomial(spark, sf_dir):
    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    t = t.select(F.col("quality").cast("double").alias("quality"), F.log1p(F.col("n_chars").cast("double")).alias("size"), "lang")
    return diagnostics.anova_gam(gam("quality ~ lang + s(size, k=6)", t, "binomial"))


def _counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("o_totalprice").alias("price"))


@query()
def gam_counts(spark, sf_dir):
    c = _counts(spark, sf_dir)
    return spark.createDataFrame([(f, float(m.deviance), m.model_edf()) for f in ("poisson", "nb", "quasipoisson", "tw") for m in [gam("n ~ s(price, k=6)", c, f)]], "family string, deviance double, edf double")


@query()
def gamm_suppliers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", "l_returnflag", "l_linenumber")
    return gamm.gamm("l_extendedprice ~ s(l_quantity, k=5, bs='cr') + (1 | l_returnflag)", li).varcorr()


@query()
def gamm_many_levels(spark, sf_dir):
    from smoothlake.operators.gamm_large import gamm_large

    li = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", "l_suppkey")
    return gamm_large("l_extendedprice ~ s(l_quantity, k=5, bs='cr') + (1 | l_suppkey)", li).ranef()


@query("""WITH c AS (SELECT l_linenumber AS a, month(l_shipdate) AS b, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2), m AS (SELECT avg(y) AS m FROM c),
e AS (SELECT 'line' AS term, CAST(a AS VARCHAR) AS level, (avg(y) - any_value(m)) * count(*) / (count(*) + 3.0) AS effect FROM c, m GROUP BY a
UNION ALL SELECT 'month', CAST(b AS VARCHAR), (avg(y) - any_value(m)) * count(*) / (count(*) + 5.0) FROM c, m GROUP BY b)
SELECT term, level, round(effect, 4) AS effect FROM e""")
def gamm_crossed_balanced(spark, sf_dir):
    """Crossed effects of line and month on cell means at given variances: a balanced table, whose effects are shrunk means."""
    from smoothlake.operators.gamm_crossed import CrossedControl, gamm_crossed

    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line"), F.month("l_shipdate").alias("month"), "l_extendedprice")
    m = gamm_crossed("y ~ 1 + (1 | line) + (1 | month)", li.groupBy("line", "month").agg(F.avg("l_extendedprice").alias("y")), ratios=[3.0, 5.0], control=CrossedControl(tolerance=1e-12, local_rows=0))
    return reduce(DataFrame.unionByName, [m.ranef(t).select(F.lit(t).alias("term"), "level", F.round("effect", 4).alias("effect")) for t in ("line", "month")])


@query()
def gamm_crossed_parts(spark, sf_dir):
    """Variances of suppliers and parts, many levels of each, estimated."""
    from smoothlake.operators.gamm_crossed import gamm_crossed

    li = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("price"), "l_quantity", "l_suppkey", "l_partkey")
    return gamm_crossed("price ~ l_quantity + (1 | l_partkey) + (1 | l_suppkey)", li).varcorr()


@query()
def qgam_prices(spark, sf_dir):
    c = _counts(spark, sf_dir)
    ms = qgam.mqgam("price ~ s(n, k=5, bs='cr')", c, [0.25, 0.75])
    x = c.select("n").distinct()
    return ms[0.25].predict(x).select("n", F.col("fit").alias("q25")).join(ms[0.75].predict(x).select("n", F.col("fit").alias("q75")), "n")


@query()
def gamlss_prices(spark, sf_dir):
    c = _counts(spark, sf_dir).withColumn("price", F.col("price") / 1e5)
    return gamlss.gamlss(["price ~ s(n, k=5, bs='cr')", "~ s(n, k=5, bs='cr')"], c, multifamilies.GaussianLS()).predict(c.select("n").distinct())


@query()
def evgam_peaks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.hour("ts").cast("double").alias("hour"), "value").where("value > 0")
    return gamlss.evgam(["value ~ s(hour, k=5, bs='cr')", "~ 1"], e, multifamilies.GPD()).predict(e.select("hour").distinct())


@query()
def scam_monotone(spark, sf_dir):
    c = _counts(spark, sf_dir).withColumn("price", F.col("price") / 1e5)
    return scam("price ~ s(n, bs='mpi', k=8)", c).predict(c.select("n").distinct())


@query()
def scasm_constrained(spark, sf_dir):
    c = _counts(spark, sf_dir).withColumn("price", F.col("price") / 1e5)
    return scasm("price ~ s(n, bs='sc', k=8, xt=['m+'])", c).predict(c.select("n").distinct())


@query()
def smooth_derivatives(spark, sf_dir):
    return diagnostics.derivatives(bam("l_extendedprice ~ s(l_quantity, k=8, bs='cr')", table(spark, sf_dir, "lineitem")))


@query()
def bayes_gibbs(spark, sf_dir):
    return gam("l_extendedprice ~ s(l_quantity, k=6, bs='cr')", table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity"), priors=bayes.PriorSpec(b=(0.0, 1e6), sigma=1e6), nsamples=300, nchains=2).coeftable()


@query()
def bayes_location_scale(spark, sf_dir):
    """Posterior of location and scale of prices by orders, four chains drawn together."""
    c = _counts(spark, sf_dir).withColumn("price", F.col("price") / 1e5)
    return gam(["price ~ n", "~ n"], c, multifamilies.GaussianLS(), priors=bayes.PriorSpec(), nsamples=100, warmup=80).coeftable()


@query()
def ginla_marginals(spark, sf_dir):
    return bayes.ginla(bam("l_extendedprice ~ s(l_quantity, k=6, bs='cr')", table(spark, sf_dir, "lineitem")), [0, 1])


@query()
def smooth_as_random(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_quantity").distinct()
    return mixed.s2r_predict(mixed.gam_smooth(li, s("l_quantity", bs="cr", k=6)), li)
