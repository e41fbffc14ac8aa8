"""Queries of models for many keys at once: regressions with contrasts, event responses, exact rank tests, smoothing on a grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import glm, stats, timeseries as ts, voxels
from .tables import CTE, events, p_of_t, read, rounded

CONTRASTS = {"discount": {"l_discount": 1.0}, "discount_over_tax": {"l_discount": 1.0, "l_tax": -1.0}, "with_level": {"intercept": 0.01, "l_discount": 1.0}}


def glm_contrasts(spark, d):
    """Quantity on discount and tax, for each part: contrasts with t, p, z, and z where p is below 0.1."""
    found = glm.mass_glm(read(spark, d, "lineitem"), ["l_partkey"], "l_quantity", ["l_discount", "l_tax"], CONTRASTS)
    return rounded(glm.thresholded(found, 0.1))


def glm_fdr(spark, d):
    """The number of parts whose contrasts stay significant over all parts, by two corrections."""
    found = glm.mass_glm(read(spark, d, "lineitem"), ["l_partkey"], "l_quantity", ["l_discount", "l_tax"], CONTRASTS)
    kinds = [glm.thresholded(found, 0.1, control, "t").select("contrast", F.lit(control).alias("control"), F.col("t_kept")) for control in ("fpr", "fdr", "bonferroni")]
    every = kinds[0].union(kinds[1]).union(kinds[2])
    return rounded(every.groupBy("contrast", "control").agg(F.count_if(F.col("t_kept") != 0).alias("n"), F.max(F.abs("t_kept")).alias("largest")))


TR, N_FRAMES = 2.3, 37_566


def response_columns(spark, d):
    """What events evoke in the frames after them: the response, its derivatives, and those weighed by the events' values."""
    found = ts.response_columns(events(spark, d), ["subject", "day"], "label", "onset", TR, N_FRAMES, modulation="value")
    return rounded(found.select("subject", "day", "label", "frame", "response", "derivative", "dispersion", "response_mod", "derivative_mod"))


def response_totals(spark, d):
    """The same for events of a duration, with the modulated column orthogonal to the plain one."""
    rows = events(spark, d).withColumn("duration", F.pmod("event_id", F.lit(4)) * 1.5)
    keys = ["subject", "day", "label"]
    found = ts.response_columns(rows, ["subject", "day"], "label", "onset", TR, N_FRAMES, "duration", "value", oversampling=4)
    found = ts.orthogonalised(found, keys, "response_mod", "response")
    out = found.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("response").alias("total"), F.sum(F.col("response_mod") * F.col("frame") / N_FRAMES).alias("mod_moment"), F.sum(F.col("response") * F.col("response_mod")).alias("both"))
    return rounded(out)


def mann_whitney_exact(spark, d):
    """Order totals of each customer, finished against open ones, with exact p for few orders."""
    rows = read(spark, d, "orders")
    return rounded(stats.mann_whitney(rows, ["o_custkey"], "o_orderstatus", "o_totalprice", "F", "O").where("least(n_a, n_b) between 1 and 8").select("o_custkey", "n_a", "n_b", "u_a", "p"))


SIGMA = voxels.sigma_of(5.0, 2.5)


def _moments(spark, d):
    k = F.col("l_partkey")
    rows = read(spark, d, "lineitem").groupBy(F.pmod(k, F.lit(17)).alias("x"), F.pmod(F.floor(k / 17), F.lit(13)).alias("y"), F.floor(k / 221).alias("z"))
    return rows.agg(F.avg("l_quantity").alias("mean"), F.stddev_pop("l_quantity").alias("sd"))


def smoothed_voxels(spark, d):
    """Parts as voxels of a grid: the Gaussian mean of their mean quantities over the grid's filled places."""
    return rounded(voxels.smoothed(_moments(spark, d), ["mean"], SIGMA, edge=8))


def noisy_voxels(spark, d):
    """Voxels whose spread stands out from their smoothed neighbourhood."""
    return rounded(voxels.noisy_voxels(_moments(spark, d), SIGMA))


QUERIES = {f.__name__: f for f in (glm_contrasts, glm_fdr, response_columns, response_totals, mann_whitney_exact, smoothed_voxels, noisy_voxels)}

_GLM = f"""c AS (SELECT l_partkey, count(*) AS n, avg(l_quantity) AS my, avg(l_discount) AS m1, avg(l_tax) AS m2, regr_sxx(l_discount, l_discount) AS s11, regr_sxx(l_tax, l_tax) AS s22, regr_sxy(l_discount, l_tax) AS s12,
      regr_sxy(l_quantity, l_discount) AS s1y, regr_sxy(l_quantity, l_tax) AS s2y, regr_sxx(l_quantity, l_quantity) AS syy FROM lineitem GROUP BY l_partkey),
    b AS (SELECT *, s11 * s22 - s12 * s12 AS dt, (s22 * s1y - s12 * s2y) / dt AS b1, (s11 * s2y - s12 * s1y) / dt AS b2, n - 3 AS df, (syy - b1 * s1y - b2 * s2y) / nullif(n - 3, 0) AS s2 FROM c),
    k AS (SELECT unnest(['discount', 'discount_over_tax', 'with_level']) AS contrast, unnest([0, 0, 0.01]::DOUBLE[]) AS c0, unnest([1, 1, 1]::DOUBLE[]) AS c1, unnest([0, -1, 0]::DOUBLE[]) AS c2),
    e AS (SELECT l_partkey, contrast, CAST(df AS DOUBLE) AS df, c0 * (my - b1 * m1 - b2 * m2) + c1 * b1 + c2 * b2 AS effect,
      sqrt(s2 * (c0 * c0 / n + (pow(c1 - c0 * m1, 2) * s22 + pow(c2 - c0 * m2, 2) * s11 - 2 * (c1 - c0 * m1) * (c2 - c0 * m2) * s12) / dt)) AS se FROM b, k),
    t AS (SELECT *, effect / se AS t, {p_of_t('(effect / se)', 'df')} AS p FROM e)"""

#: h(t) of the response, with the width of its first gamma.
_H = lambda t, d: f"CASE WHEN ({t}) > 0 AND ({t}) <= 32 THEN pow(({t}) / {d}, 6 / {d} - 1) * exp(-({t}) / {d}) / gamma(6 / {d}) / {d} - pow({t}, 15) * exp(-({t})) / gamma(16) / 6 ELSE 0 END"
_LAG = f"((frame + 0.5) * {TR} - o)"


def _seen(step: float, more: str = "") -> str:
    """SQL of the responses of every event in every frame that it reaches; ``o`` is its place on the grid."""
    return f"""gm AS (SELECT *, value - avg(value) OVER (PARTITION BY subject, day, label) AS m, round(onset / {step}) AS s0 FROM ev),
    gr2 AS (SELECT *, {more or "1.0 AS wt, s0 AS s"} FROM gm), og AS (SELECT *, s * CAST({step} AS DOUBLE) AS o FROM gr2),
    fr AS (SELECT *, unnest(range(CAST(greatest(0, ceil(o / {TR} - 0.5)) AS BIGINT), CAST(least({N_FRAMES - 1}, floor((o + 32.1) / {TR} - 0.5)) + 1 AS BIGINT))) AS frame FROM og),
    hh AS (SELECT subject, day, label, frame, wt, coalesce(m, 0) AS m, {_H(_LAG, '1.0')} AS h, {_H(f'{_LAG} - 0.1', '1.0')} AS hl, {_H(_LAG, '1.01')} AS hw FROM fr)"""


_VOX = f"""mo AS (SELECT l_partkey % 17 AS x, (l_partkey // 17) % 13 AS y, l_partkey // 221 AS z, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS sd FROM lineitem GROUP BY ALL),
    vx AS (SELECT *, sd / greatest(abs(mean), 1e-6) AS cov FROM mo),
    nb AS (SELECT a.x, a.y, a.z, exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) / 2 / {SIGMA * SIGMA!r}) AS w, b.mean, b.cov FROM vx a JOIN vx b ON abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 AND abs(a.z - b.z) <= 3)"""

SQL = {name: f"WITH RECURSIVE {CTE.strip()}, {body}" for name, body in {
    "glm_contrasts": f"""{_GLM}, z AS (SELECT *, CASE WHEN t IS NULL THEN NULL ELSE sign(t) * list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(25), lambda i: p / 2)), lambda z, h: z + (0.5 - z / 2400 * list_sum(list_transform(range(801), lambda s: (CASE WHEN s IN (0, 800) THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(z * s / 800, 2) / 2))) / sqrt(2 * pi()) - h) * sqrt(2 * pi()) * exp(z * z / 2)) END AS z FROM t)
      SELECT l_partkey, contrast, df, round(effect, 6) + 0.0 AS effect, round(se, 6) + 0.0 AS se, round(t, 6) + 0.0 AS t, round(p, 6) + 0.0 AS p, round(z, 6) + 0.0 AS z, round(CASE WHEN p < 0.1 THEN z ELSE 0 END, 6) + 0.0 AS z_kept FROM z""",
    "glm_fdr": f"""{_GLM}, r AS (SELECT *, count(p) OVER f AS m, row_number() OVER (PARTITION BY contrast ORDER BY p) AS k FROM t WHERE p IS NOT NULL WINDOW f AS (PARTITION BY contrast)),
      q AS (SELECT *, min(p * m / k) OVER (PARTITION BY contrast ORDER BY p DESC, k DESC) AS q FROM r), u AS (SELECT contrast, t, unnest(['fpr', 'fdr', 'bonferroni']) AS control, unnest([p, q, least(1, p * m)]) AS p FROM q)
      SELECT contrast, control, count(*) FILTER (p < 0.1) AS n, round(max(CASE WHEN p < 0.1 THEN abs(t) ELSE 0 END), 6) + 0.0 AS largest FROM u GROUP BY ALL""",
    "response_columns": f"""{_seen(TR / 10)} SELECT subject, day, label, frame, round(sum(h), 6) + 0.0 AS response, round(sum((h - hl) / 0.1), 6) + 0.0 AS derivative, round(sum((h - hw) / 0.01), 6) + 0.0 AS dispersion,
      round(sum(h * m), 6) + 0.0 AS response_mod, round(sum((h - hl) / 0.1 * m), 6) + 0.0 AS derivative_mod FROM hh GROUP BY ALL""",
    "response_totals": f"""{_seen(TR / 4, f"CASE WHEN event_id % 4 > 0 THEN {TR / 4!r} ELSE 1.0 END AS wt, s0 + unnest(range(greatest(1, CAST(round(event_id % 4 * 1.5 / {TR / 4!r}) AS BIGINT)))) AS s")},
      fs AS (SELECT subject, day, label, frame, sum(h * wt) AS r, sum(h * wt * m) AS v FROM hh GROUP BY ALL), bt AS (SELECT subject, day, label, sum(r * v) / nullif(sum(r * r), 0) AS b FROM fs GROUP BY ALL)
      SELECT subject, day, label, count(*) AS n, round(sum(r), 6) + 0.0 AS total, round(sum((v - coalesce(b, 0) * r) * frame / {N_FRAMES}), 6) + 0.0 AS mod_moment, round(sum(r * (v - coalesce(b, 0) * r)), 6) + 0.0 AS "both" FROM fs JOIN bt USING (subject, day, label) GROUP BY ALL""",
    "mann_whitney_exact": """o AS (SELECT o_custkey, o_orderstatus = 'F' AS a, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_custkey, o_totalprice) - 1) / 2 AS r, count(*) OVER (PARTITION BY o_custkey, o_totalprice) AS same FROM orders WHERE o_orderstatus IN ('F', 'O')),
      s AS (SELECT o_custkey, count(*) FILTER (a) AS n_a, count(*) FILTER (NOT a) AS n_b, sum(r) FILTER (a) - count(*) FILTER (a) * (count(*) FILTER (a) + 1) / 2 AS u, max(same) AS same FROM o GROUP BY ALL),
      w AS (SELECT 0 AS n, 0 AS k, 0 AS total, 1.0::DOUBLE AS c UNION ALL SELECT n, k, total, sum(c) FROM (SELECT n + 1 AS n, k + j AS k, total + j * (n + 1) AS total, c FROM w, (SELECT unnest([0, 1]) AS j) WHERE n < (SELECT max(n_a + n_b) FROM s WHERE least(n_a, n_b) BETWEEN 1 AND 8)) GROUP BY n, k, total),
      d AS (SELECT n, k, total - k * (k + 1) // 2 AS u, c, sum(c) OVER (PARTITION BY n, k) AS every FROM w),
      e AS (SELECT o_custkey, least(1, 2 * sum(c) FILTER (d.u >= greatest(s.u, n_a * n_b - s.u)) / any_value(every)) AS p FROM s JOIN d ON n = n_a + n_b AND k = n_a WHERE same = 1 AND least(n_a, n_b) BETWEEN 1 AND 8 GROUP BY ALL)
      SELECT o_custkey, n_a, n_b, round(u, 6) + 0.0 AS u_a, round(e.p, 6) + 0.0 AS p FROM s LEFT JOIN e USING (o_custkey) WHERE least(n_a, n_b) BETWEEN 1 AND 8""",
    "smoothed_voxels": f"{_VOX} SELECT x, y, z, round(sum(w * mean) / sum(w), 6) + 0.0 AS mean FROM nb GROUP BY ALL",
    "noisy_voxels": f"""{_VOX}, lm AS (SELECT x, y, z, sum(w * cov) / sum(w) AS m, sum(w * cov * cov) / sum(w) AS q FROM nb GROUP BY ALL)
      SELECT x, y, z, round(cov, 6) + 0.0 AS cov, cov > m + 0.5 * sqrt(greatest(0, q - m * m)) AS noisy FROM vx JOIN lm USING (x, y, z)""",
}.items()}
