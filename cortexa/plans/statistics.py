"""Queries of the statistics: group tests, corrections, correlations, regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distributions
from ..operators import aggregates as agg, stats
from .tables import CTE, events, gradients, groups, p_of_t, read, rounded

A, B = "BUILDING", "MACHINERY"


def _with_group(spark, d):
    return events(spark, d).join(groups(spark, d), "subject")


def group_compare_network_size(spark, d):
    """Size of each label by subject, groups joined, Welch's t for each label."""
    sizes = agg.label_sizes(events(spark, d), ["subject"], "label", F.col("value")).join(groups(spark, d), "subject")
    out = stats.t_test(sizes, ["label"], "grp", "size", A, B, p=False)
    return rounded(out.select("label", "n_a", "n_b", "mean_a", "mean_b", "t", "df"))


def group_compare_corrected(spark, d):
    """The same with p, corrected for the number of labels in two ways."""
    sizes = agg.label_sizes(events(spark, d), ["subject"], "label", F.col("value")).join(groups(spark, d), "subject")
    out = stats.t_test(sizes, ["label"], "grp", "size", A, B)
    return rounded(stats.benjamini_hochberg(stats.bonferroni(out), ties=["label"]).select("label", "t", "df", "p", "p_bonferroni", "p_fdr"))


def pooled_t_by_label(spark, d):
    return rounded(stats.t_test(_with_group(spark, d), ["label"], "grp", "value", A, B, pooled=True, p=False).select("label", "n_a", "n_b", "t", "df"))


def welch_mass_univariate(spark, d):
    """One test for each part, over all line items."""
    rows = read(spark, d, "lineitem")
    return rounded(stats.t_test(rows, ["l_partkey"], "l_returnflag", "l_quantity", "A", "N", p=False).select("l_partkey", "n_a", "n_b", "t", "df"))


def mann_whitney_u(spark, d):
    return rounded(stats.mann_whitney(_with_group(spark, d), ["label"], "grp", "value", A, B, p=False))


def normality_k2(spark, d):
    return rounded(stats.normality(events(spark, d), ["label"], "k"))


def adaptive_test(spark, d):
    return rounded(stats.adaptive_test(_with_group(spark, d), ["label"], "grp", "k", A, B))


def pearson_by_label(spark, d):
    return rounded(stats.pearson(events(spark, d), ["label"], "value", "k", p=False))


def spearman_by_label(spark, d):
    return rounded(stats.spearman(events(spark, d), ["label"], "value", "k", p=False))


def _pvalues(spark, d):
    return read(spark, d, "customer").select("c_custkey", "c_nationkey", (F.pmod(F.col("c_custkey") * 7919, F.lit(1009)) + 1).cast("double").alias("m")).withColumn("p", F.when(F.col("m") < 1000, F.col("m") / 1010)).drop("m")


def bonferroni(spark, d):
    return rounded(stats.bonferroni(_pvalues(spark, d), family=["c_nationkey"]).drop("p"))


def bh_fdr(spark, d):
    return rounded(stats.benjamini_hochberg(_pvalues(spark, d), family=["c_nationkey"], ties=["c_custkey"]).drop("p"))


def regression_residuals(spark, d):
    rows = stats.residuals(events(spark, d), "value", "k", ["label"])
    return rounded(rows.select("event_id", "slope", "intercept", "residual"))


def ols_covariates(spark, d):
    """Price on quantity, discount and tax."""
    out = stats.ols(read(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return out.select("term", *(F.round(c, 3).alias(c) for c in ("coef", "se", "t")), "df", F.round("p", 6).alias("p"))


def ols_single(spark, d):
    return rounded(stats.ols(read(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], p=False).select("term", "coef"))


def mixed_anova(spark, d):
    """Customer segment between subjects, kind of event within them."""
    return rounded(stats.mixed_anova(_with_group(spark, d), "subject", "grp", "label", "value", p=False))


def zscore_outliers(spark, d):
    return rounded(stats.outliers(events(spark, d), "value", ["label"]).select("event_id", "zscore", "outlier"))


def column_correlations(spark, d):
    return rounded(stats.column_correlations(read(spark, d, "lineitem"), "l_orderkey", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


def dispersion_1d(spark, d):
    return rounded(agg.dispersion(gradients(spark, d), ["label"], ["g1"]))


def dispersion_2d(spark, d):
    return rounded(agg.dispersion(gradients(spark, d), ["label"], ["g1", "g2"]))


def dispersion_2d_mean(spark, d):
    return rounded(agg.dispersion(gradients(spark, d), ["label"], ["g1", "g2"], "mean"))


def deviation_within(spark, d):
    return rounded(agg.dispersion(gradients(spark, d), ["label"], ["g1"], "mean", absolute=True))


def network_centroids(spark, d):
    return rounded(agg.centroids(gradients(spark, d), ["hemi", "label"], ["g1", "g2"]))


def between_net_distance(spark, d):
    return rounded(agg.between_distances(agg.centroids(gradients(spark, d), ["hemi", "label"], ["g1", "g2"]), ["hemi"], "label", ["g1", "g2"]))


def eccentricity(spark, d):
    return rounded(agg.eccentricity(gradients(spark, d), ["label"], ["g1", "g2", "g3"]))


def quantile_grid(spark, d):
    """Normal quantiles of shares, as a probit contrast of two stimulus values takes them."""
    rows = events(spark, d).groupBy("label").agg(F.avg((F.col("k") > 50).cast("double")).alias("share"), F.avg((F.col("k") > 80).cast("double")).alias("high"))
    q = [distributions.normal_quantile(F.col(c)) for c in ("share", "high")]
    return rounded(rows.select("label", q[0].alias("at_50"), q[1].alias("at_80"), ((q[1] - q[0]) / 30).alias("slope")))


def shepherd_pi(spark, d):
    """Robust correlation of order totals and balances of customers."""
    totals = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("total"))
    rows = totals.join(read(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    return rounded(stats.shepherd_pi(rows, "total", "c_acctbal", "c_custkey"))


QUERIES = {f.__name__: f for f in (
    shepherd_pi, group_compare_network_size, group_compare_corrected, pooled_t_by_label, welch_mass_univariate, mann_whitney_u, normality_k2, adaptive_test, pearson_by_label,
    spearman_by_label, bonferroni, bh_fdr, regression_residuals, ols_covariates, ols_single, mixed_anova, zscore_outliers, column_correlations, dispersion_1d,
    dispersion_2d, dispersion_2d_mean, deviation_within, network_centroids, between_net_distance, eccentricity, quantile_grid,
)}


def _sides(group: str, value: str, a: str, b: str) -> str:
    return ", ".join(f"count({value}) FILTER ({group} = '{g}') AS n_{s}, avg({value}) FILTER ({group} = '{g}') AS m_{s}, var_samp({value}) FILTER ({group} = '{g}') AS v_{s}" for s, g in (("a", a), ("b", b)))


_WELCH = "round((m_a - m_b) / nullif(sqrt(v_a / n_a + v_b / n_b), 0), 6) + 0.0 AS t, round(pow(v_a / n_a + v_b / n_b, 2) / nullif(pow(v_a / n_a, 2) / (n_a - 1) + pow(v_b / n_b, 2) / (n_b - 1), 0), 6) + 0.0 AS df"
_POOLED = "round((m_a - m_b) / nullif(sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2) * (1 / n_a + 1 / n_b)), 0), 6) + 0.0 AS t, CAST(n_a + n_b - 2 AS DOUBLE) AS df"
_PAIRS = [(a, b) for a in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
_PV = "pv AS (SELECT c_custkey, c_nationkey, CASE WHEN (c_custkey * 7919) % 1009 + 1 < 1000 THEN ((c_custkey * 7919) % 1009 + 1) / 1010 END AS p FROM customer)"


def _dispersion(axes: list[str], mid: str, value: str) -> str:
    return f", c AS (SELECT label, {', '.join(f'{mid}({a}) AS c_{a}' for a in axes)} FROM gd GROUP BY label) SELECT label, count(*) AS n, round(avg({value}), 6) + 0.0 AS dispersion FROM gd JOIN c USING (label) GROUP BY label"


_CENTRES = "SELECT hemi, label, median(g1) AS g1, median(g2) AS g2 FROM gd GROUP BY ALL"

SQL = {name: f"WITH RECURSIVE {CTE.strip()}{body if body.startswith(',') else ' ' + body}" for name, body in {
    "group_compare_corrected": f""", s AS (SELECT subject, label, sum(value) AS size FROM ev GROUP BY ALL), m AS (SELECT label, {_sides('grp', 'size', A, B)} FROM s JOIN gr USING (subject) WHERE grp IN ('{A}', '{B}') GROUP BY label),
      t AS (SELECT label, (m_a - m_b) / sqrt(v_a / n_a + v_b / n_b) AS t, pow(v_a / n_a + v_b / n_b, 2) / (pow(v_a / n_a, 2) / (n_a - 1) + pow(v_b / n_b, 2) / (n_b - 1)) AS df FROM m),
      p AS (SELECT label, t, df, {p_of_t('t', 'df')} AS p FROM t), r AS (SELECT *, row_number() OVER (ORDER BY p, label) AS r, count(*) OVER () AS n FROM p)
      SELECT label, round(t, 6) + 0.0 AS t, round(df, 6) + 0.0 AS df, round(p, 6) + 0.0 AS p, round(least(1.0, p * n), 6) + 0.0 AS p_bonferroni, round(least(1.0, min(p * n / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) + 0.0 AS p_fdr FROM r""",
    "quantile_grid": """, s AS (SELECT label, avg(CASE WHEN k > 50 THEN 1.0 WHEN k <= 50 THEN 0.0 END) AS a, avg(CASE WHEN k > 80 THEN 1.0 WHEN k <= 80 THEN 0.0 END) AS b FROM ev GROUP BY label),
      q AS (SELECT label, 'a' AS which, CAST(a AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS x, 0 AS step FROM s UNION ALL SELECT label, 'b', b, 0.0, 0 FROM s),
      w AS (SELECT * FROM q UNION ALL SELECT label, which, p, x - (0.5 + x / 3000 / sqrt(2 * pi()) * list_sum(list_transform(range(1001), lambda i: (CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(x * i / 1000, 2) / 2))) - p) * sqrt(2 * pi()) * exp(x * x / 2), step + 1 FROM w WHERE step < 40),
      e AS (SELECT label, max(x) FILTER (which = 'a') AS a, max(x) FILTER (which = 'b') AS b FROM w WHERE step = 40 GROUP BY label) SELECT label, round(a, 6) + 0.0 AS at_50, round(b, 6) + 0.0 AS at_80, round((b - a) / 30, 6) + 0.0 AS slope FROM e""",
    "ols_covariates": f""", m AS (SELECT avg(l_extendedprice) AS y, avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_tax) AS c, CAST(count(*) AS DOUBLE) AS n FROM lineitem),
      d AS (SELECT l_extendedprice - m.y AS y, l_quantity - m.a AS a, l_discount - m.b AS b, l_tax - m.c AS c FROM lineitem, m),
      s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc, sum(a * y) AS ay, sum(b * y) AS yb, sum(c * y) AS cy, sum(y * y) AS yy FROM d),
      i AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s),
      j AS (SELECT (bb * cc - bc * bc) / det AS iaa, (ac * bc - ab * cc) / det AS iab, (ab * bc - ac * bb) / det AS iac, (aa * cc - ac * ac) / det AS ibb, (ab * ac - aa * bc) / det AS ibc, (aa * bb - ab * ab) / det AS icc, * FROM i),
      k AS (SELECT iaa * ay + iab * yb + iac * cy AS ka, iab * ay + ibb * yb + ibc * cy AS kb, iac * ay + ibc * yb + icc * cy AS kc, * FROM j),
      v AS (SELECT k.*, m.*, (yy - ka * ay - kb * yb - kc * cy) / (n - 4) AS s2 FROM k, m),
      o AS (SELECT 'intercept' AS term, y - ka * a - kb * b - kc * c AS coef, sqrt(s2 * (1 / n + a * a * iaa + b * b * ibb + c * c * icc + 2 * (a * b * iab + a * c * iac + b * c * ibc))) AS se, n - 4 AS df FROM v
        UNION ALL SELECT 'l_quantity', ka, sqrt(s2 * iaa), n - 4 FROM v UNION ALL SELECT 'l_discount', kb, sqrt(s2 * ibb), n - 4 FROM v UNION ALL SELECT 'l_tax', kc, sqrt(s2 * icc), n - 4 FROM v)
      SELECT term, round(coef, 3) AS coef, round(se, 3) AS se, round(coef / se, 3) AS t, df, CASE WHEN abs(coef / se) > 30 THEN 0.0 ELSE round({p_of_t('coef / se', 'df')}, 6) END AS p FROM o""",
    "group_compare_network_size": f", s AS (SELECT subject, label, sum(value) AS size FROM ev GROUP BY ALL), m AS (SELECT label, {_sides('grp', 'size', A, B)} FROM s JOIN gr USING (subject) WHERE grp IN ('{A}', '{B}') GROUP BY label) SELECT label, n_a, n_b, round(m_a, 6) + 0.0 AS mean_a, round(m_b, 6) + 0.0 AS mean_b, {_WELCH} FROM m",
    "pooled_t_by_label": f", m AS (SELECT label, {_sides('grp', 'value', A, B)} FROM ev JOIN gr USING (subject) WHERE grp IN ('{A}', '{B}') GROUP BY label) SELECT label, n_a, n_b, {_POOLED} FROM m",
    "welch_mass_univariate": f", m AS (SELECT l_partkey, {_sides('l_returnflag', 'l_quantity', 'A', 'N')} FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY l_partkey) SELECT l_partkey, n_a, n_b, CASE WHEN n_a > 1 AND n_b > 1 THEN t END AS t, CASE WHEN n_a > 1 AND n_b > 1 THEN df END AS df FROM (SELECT l_partkey, n_a, n_b, {_WELCH} FROM m)",
    "mann_whitney_u": f""", v AS (SELECT label, grp, value FROM ev JOIN gr USING (subject) WHERE grp IN ('{A}', '{B}') AND value IS NOT NULL),
      r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY value) + (count(*) OVER (PARTITION BY label, value) - 1) / 2 AS rk FROM v),
      t AS (SELECT label, sum(CAST(n AS DOUBLE) * n * n - n) AS ties FROM (SELECT label, value, count(*) AS n FROM v GROUP BY ALL) GROUP BY label),
      s AS (SELECT label, count(*) FILTER (grp = '{A}') AS n_a, count(*) FILTER (grp = '{B}') AS n_b, sum(rk) FILTER (grp = '{A}') AS ra FROM r GROUP BY label),
      u AS (SELECT label, n_a, n_b, ra - n_a * (n_a + 1) / 2 AS ua, CAST(n_a AS DOUBLE) * n_b AS nn, CAST(n_a + n_b AS DOUBLE) AS n, ties FROM s JOIN t USING (label))
      SELECT label, n_a, n_b, round(ua, 6) + 0.0 AS u_a, round(nn - ua, 6) + 0.0 AS u_b, round((greatest(ua, nn - ua) - nn / 2 - 0.5) / sqrt(nn / 12 * (n + 1 - ties / (n * (n - 1)))), 6) + 0.0 AS z FROM u""",
    "normality_k2": """, a AS (SELECT label, avg(k) AS m FROM ev GROUP BY label), b AS (SELECT label, CAST(count(k) AS DOUBLE) AS n, avg(pow(k - m, 2)) AS m2, avg(pow(k - m, 3)) AS m3, avg(pow(k - m, 4)) AS m4 FROM ev JOIN a USING (label) GROUP BY label),
      c AS (SELECT label, n, m3 / pow(m2, 1.5) * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
        (m4 / (m2 * m2) - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x2, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS root FROM b),
      e AS (SELECT label, n, x2, sqrt(2 * (beta2 - 1)) - 1 AS w2, y, 6 + 8 / root * (2 / root + sqrt(1 + 4 / (root * root))) AS a FROM c),
      f AS (SELECT label, n, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x2 * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM e)
      SELECT label, CAST(n AS BIGINT) AS n, round(z1 * z1 + z2 * z2, 6) + 0.0 AS k2, round(exp(-(z1 * z1 + z2 * z2) / 2), 6) + 0.0 AS p FROM f""",
    "adaptive_test": f""", v AS (SELECT label, grp, k FROM ev JOIN gr USING (subject) WHERE grp IN ('{A}', '{B}') AND k IS NOT NULL),
      a AS (SELECT label, avg(k) AS m FROM v GROUP BY label), b AS (SELECT label, CAST(count(k) AS DOUBLE) AS n, avg(pow(k - m, 2)) AS m2, avg(pow(k - m, 3)) AS m3, avg(pow(k - m, 4)) AS m4 FROM v JOIN a USING (label) GROUP BY label),
      c AS (SELECT label, n, m3 / pow(m2, 1.5) * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
        (m4 / (m2 * m2) - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x2, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS root FROM b WHERE n >= 8 AND m2 > 0),
      e AS (SELECT label, x2, sqrt(2 * (beta2 - 1)) - 1 AS w2, y, 6 + 8 / root * (2 / root + sqrt(1 + 4 / (root * root))) AS a FROM c),
      f AS (SELECT label, exp(-(pow(asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)), 2) + pow((1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x2 * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)), 2)) / 2) > 0.05 AS normal FROM e),
      r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY k) + (count(*) OVER (PARTITION BY label, k) - 1) / 2 AS rk FROM v),
      h AS (SELECT label, sum(CAST(n AS DOUBLE) * n * n - n) AS ties FROM (SELECT label, k, count(*) AS n FROM v GROUP BY ALL) GROUP BY label),
      s AS (SELECT label, count(*) FILTER (grp = '{A}') AS n_a, count(*) FILTER (grp = '{B}') AS n_b, sum(rk) FILTER (grp = '{A}') AS ra, avg(k) FILTER (grp = '{A}') AS m_a, avg(k) FILTER (grp = '{B}') AS m_b, var_samp(k) FILTER (grp = '{A}') AS v_a, var_samp(k) FILTER (grp = '{B}') AS v_b FROM r GROUP BY label),
      u AS (SELECT *, ra - n_a * (n_a + 1) / 2 AS ua, CAST(n_a AS DOUBLE) * n_b AS nn, CAST(n_a + n_b AS DOUBLE) AS n, n_a + n_b - 2 AS df, (m_a - m_b) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2) * (1 / n_a + 1 / n_b)) AS t, coalesce(normal, false) AS is_normal FROM s JOIN h USING (label) LEFT JOIN f USING (label)),
      z AS (SELECT *, (greatest(ua, nn - ua) - nn / 2 - 0.5) / sqrt(nn / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM u)
      SELECT label, is_normal AS normal, round(CASE WHEN is_normal THEN t ELSE ua END, 6) + 0.0 AS statistic,
        round(CASE WHEN is_normal THEN {p_of_t('t', 'df')} WHEN z <= 0 THEN 1 ELSE greatest(0, 1 - z / 1500 * list_sum(list_transform(range(1001), lambda i: (CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(z * i / 1000, 2) / 2))) / sqrt(2 * pi())) END, 6) + 0.0 AS p,
        CASE WHEN is_normal THEN 't(' || df || ')' ELSE 'U(' || n_a || ', ' || n_b || ')' END AS test FROM z""",
    "pearson_by_label": ", a AS (SELECT label, count(*) AS n, corr(value, k) AS r FROM ev WHERE value IS NOT NULL AND k IS NOT NULL GROUP BY label) SELECT label, n, round(r, 6) + 0.0 AS r, round(r * sqrt((n - 2) / (1 - r * r)), 6) + 0.0 AS t FROM a",
    "spearman_by_label": """, b AS (SELECT label, rank() OVER (PARTITION BY label ORDER BY value) + (count(*) OVER (PARTITION BY label, value) - 1) / 2 AS x, rank() OVER (PARTITION BY label ORDER BY k) + (count(*) OVER (PARTITION BY label, k) - 1) / 2 AS y FROM ev WHERE value IS NOT NULL AND k IS NOT NULL),
      a AS (SELECT label, count(*) AS n, corr(x, y) AS r FROM b GROUP BY label) SELECT label, n, round(r, 6) + 0.0 AS r, round(r * sqrt((n - 2) / (1 - r * r)), 6) + 0.0 AS t FROM a""",
    "bonferroni": f", {_PV} SELECT c_custkey, c_nationkey, round(least(1.0, p * count(p) OVER (PARTITION BY c_nationkey)), 6) + 0.0 AS p_bonferroni FROM pv WHERE p IS NOT NULL UNION ALL SELECT c_custkey, c_nationkey, NULL FROM pv WHERE p IS NULL",
    "bh_fdr": f""", {_PV}, r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY p, c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS m FROM pv WHERE p IS NOT NULL)
      SELECT c_custkey, c_nationkey, round(least(1.0, min(p * m / r) OVER (PARTITION BY c_nationkey ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) + 0.0 AS p_fdr FROM r UNION ALL SELECT c_custkey, c_nationkey, NULL FROM pv WHERE p IS NULL""",
    "regression_residuals": ", f AS (SELECT label, regr_slope(value, k) AS s, regr_intercept(value, k) AS i FROM ev GROUP BY label) SELECT event_id, round(s, 6) + 0.0 AS slope, round(i, 6) + 0.0 AS intercept, round(value - i - s * k, 6) + 0.0 AS residual FROM ev JOIN f USING (label)",
    "ols_single": "SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 6) + 0.0 AS coef FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 6) + 0.0 FROM lineitem",
    "mixed_anova": """, c AS (SELECT subject, grp, label, avg(value) AS y FROM ev JOIN gr USING (subject) WHERE value IS NOT NULL GROUP BY ALL),
      s AS (SELECT subject, avg(y) AS ys FROM c GROUP BY subject HAVING count(*) = (SELECT count(DISTINCT label) FROM c)), d AS (SELECT * FROM c JOIN s USING (subject)),
      e AS (SELECT *, avg(y) OVER (PARTITION BY grp) AS yg, avg(y) OVER (PARTITION BY label) AS yt, avg(y) OVER (PARTITION BY grp, label) AS yi, avg(y) OVER () AS ym FROM d),
      q AS (SELECT sum(pow(yg - ym, 2)) AS b, sum(pow(ys - yg, 2)) AS sb, sum(pow(yt - ym, 2)) AS w, sum(pow(yi - yg - yt + ym, 2)) AS bw, sum(pow(y - yi - ys + yg, 2)) AS e, CAST(count(DISTINCT subject) AS DOUBLE) AS n, CAST(count(DISTINCT grp) AS DOUBLE) AS g, CAST(count(DISTINCT label) AS DOUBLE) AS t FROM e),
      r AS (SELECT 'between' AS effect, b AS ss, g - 1 AS df1, sb AS ss_error, n - g AS df2 FROM q UNION ALL SELECT 'within', w, t - 1, e, (n - g) * (t - 1) FROM q UNION ALL SELECT 'interaction', bw, (g - 1) * (t - 1), e, (n - g) * (t - 1) FROM q)
      SELECT effect, round(ss, 6) + 0.0 AS ss, df1, round(ss_error, 6) + 0.0 AS ss_error, df2, round(ss / df1 / (ss_error / df2), 6) + 0.0 AS f FROM r""",
    "zscore_outliers": ", m AS (SELECT label, avg(value) AS m, stddev_pop(value) AS s FROM ev GROUP BY label) SELECT event_id, round((value - m) / nullif(s, 0), 6) + 0.0 AS zscore, coalesce(abs((value - m) / nullif(s, 0)) > 3, false) AS outlier FROM ev JOIN m USING (label)",
    "column_correlations": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, " + ("0.0 AS r" if a == b else f"round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem") for a, b in _PAIRS),
    "dispersion_1d": _dispersion(["g1"], "median", "pow(g1 - c_g1, 2)"),
    "dispersion_2d": _dispersion(["g1", "g2"], "median", "pow(g1 - c_g1, 2) + pow(g2 - c_g2, 2)"),
    "dispersion_2d_mean": _dispersion(["g1", "g2"], "avg", "pow(g1 - c_g1, 2) + pow(g2 - c_g2, 2)"),
    "deviation_within": _dispersion(["g1"], "avg", "abs(g1 - c_g1)"),
    "network_centroids": "SELECT hemi, label, round(median(g1), 6) + 0.0 AS g1, round(median(g2), 6) + 0.0 AS g2 FROM gd GROUP BY ALL",
    "between_net_distance": f", c AS ({_CENTRES}) SELECT a.hemi, a.label AS label_a, b.label AS label_b, round(sqrt(pow(a.g1 - b.g1, 2) + pow(a.g2 - b.g2, 2)), 6) + 0.0 AS distance FROM c a JOIN c b ON a.hemi = b.hemi AND a.label < b.label",
    "eccentricity": "SELECT label, round(avg(sqrt(g1 * g1 + g2 * g2 + g3 * g3)), 6) + 0.0 AS eccentricity FROM gd GROUP BY label",
}.items()}
