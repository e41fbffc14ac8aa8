"""Two-group tests, correlations, regression and corrections for many comparisons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.distributions import exact_u_pvalue, f_pvalue, normal_pvalue, t_pvalue
from .windows import by_part, ranged, sum_below


def group_moments(df: DataFrame, keys: list[str], group: str, value: str, a, b) -> DataFrame:
    """n, mean and sample variance of both groups for each combination of keys, in one pass."""
    sides = {"a": F.when(F.col(group) == a, F.col(value)), "b": F.when(F.col(group) == b, F.col(value))}
    sums = [f(x).alias(f"{name}_{s}") for s, x in sides.items() for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    return df.where(F.col(group).isin(a, b)).groupBy(*keys).agg(*sums)


def t_test(df: DataFrame, keys: list[str], group: str, value: str, a, b, pooled: bool = False, p: bool = True) -> DataFrame:
    """t and df (and p) per key: Welch's, or Student's with ``pooled``; null unless both groups have two values."""
    m = group_moments(df, keys, group, value, a, b)
    n1, n2, v1, v2 = (F.col(c) for c in ("n_a", "n_b", "var_a", "var_b"))
    enough = (n1 > 1) & (n2 > 1)
    if pooled:
        dof = (n1 + n2 - 2).cast("double")
        se2 = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, dof) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))
    else:
        q1, q2 = F.try_divide(v1, n1), F.try_divide(v2, n2)
        se2 = q1 + q2
        dof = F.try_divide(se2 * se2, F.try_divide(q1 * q1, n1 - 1) + F.try_divide(q2 * q2, n2 - 1))
    out = m.withColumn("t", F.when(enough, F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(se2)))).withColumn("df", F.when(enough, dof))
    return out.withColumn("p", t_pvalue(F.col("t"), F.col("df"))) if p else out


def masked(df: DataFrame, value: str, alpha: float, p: str = "p") -> DataFrame:
    """``<value>_masked``: the statistic where its p is below ``alpha``, 0 elsewhere."""
    return df.withColumn(f"{value}_masked", F.when(F.coalesce(F.col(p) < alpha, F.lit(False)), F.col(value)).otherwise(0.0))


def average_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rank_avg``: rank of the value within its keys, ties sharing their mean rank; rows with a null have none and go."""
    known = df.where(F.col(value).isNotNull())
    counts = sum_below(known.groupBy(*keys, value).agg(F.count("*").alias("__k")), keys, value, "__k", "__below")
    ranks = counts.select(*keys, value, (F.col("__below") + (F.col("__k") + 1) / 2.0).alias("rank_avg"))
    return known.join(ranks, [*keys, value])


def mann_whitney(df: DataFrame, keys: list[str], group: str, value: str, a, b, p: bool = True, exact_up_to: int = 8) -> DataFrame:
    """u_a, u_b and the tie-corrected z with continuity correction (and p) per key.

    p is exact where no values are tied and the smaller group has up to
    ``exact_up_to`` of them, else that of the normal z.

    Values are counted first, so that the ranking windows hold a row for each
    distinct value of a key and not one for each observation.
    """
    of = [F.count_if(F.col(group) == g).alias(c) for g, c in ((a, "__k_a"), (b, "__k_b"))]
    counts = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(*keys, value).agg(*of)
    counts = sum_below(counts.withColumn("__k", F.col("__k_a") + F.col("__k_b")), keys, value, "__k", "__below")
    ranked = counts.withColumn("__rank", F.col("__below") + (F.col("__k") + 1) / 2.0)
    s = ranked.groupBy(*keys).agg(F.sum("__k_a").alias("n_a"), F.sum("__k_b").alias("n_b"), F.sum(F.col("__rank") * F.col("__k_a")).alias("__r_a"), F.sum(F.pow(F.col("__k").cast("double"), 3) - F.col("__k")).alias("__ties"))
    n1, n2 = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n, u = n1 + n2, F.col("__r_a") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("__ties"), n * (n - 1))))
    out = s.select(*keys, "n_a", "n_b", u.alias("u_a"), (n1 * n2 - u).alias("u_b"), F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, sd).alias("z"), "__ties")
    if not p:
        return out.drop("__ties")
    few = (F.col("__ties") == 0) & (F.least("n_a", "n_b") > 0) & (F.least("n_a", "n_b") <= exact_up_to)
    exact = exact_u_pvalue(F.when(few, F.greatest("u_a", "u_b")), F.col("n_a"), F.col("n_b"))
    return out.withColumn("p", F.coalesce(exact, F.when(F.col("z") <= 0, 1.0).otherwise(normal_pvalue(F.col("z"))))).drop("__ties")


def normality(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """D'Agostino's K2 from raw moments, with its exact p (chi-squared, two degrees of freedom); n of 8 or more."""
    x = F.col(value)
    mean = df.groupBy(*keys).agg(F.avg(x).alias("__m")) if keys else df.agg(F.avg(x).alias("__m"))
    centred = (df.join(mean, keys) if keys else df.crossJoin(F.broadcast(mean))).withColumn("__d", x - F.col("__m"))
    d = F.col("__d")
    every = centred.groupBy(*keys).agg(F.count(x).cast("double").alias("__n"), F.avg(d * d).alias("__m2"), F.avg(d * d * d).alias("__m3"), F.avg(d * d * d * d).alias("__m4"))
    s, small = every.where("__n >= 8 and __m2 > 0"), every.where("not coalesce(__n >= 8 and __m2 > 0, false)")
    c = F.col
    n, root = c("__n"), c("__root")
    s = s.withColumn("__g1", F.try_divide(c("__m3"), F.pow("__m2", F.lit(1.5)))).withColumn("__b2", F.try_divide(c("__m4"), c("__m2") * c("__m2")))
    # Skewness, made normal by Johnson's SU curve.
    s = s.withColumn("__w2", F.sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1)
    s = s.withColumn("__y", c("__g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2))) / F.sqrt(2 / (c("__w2") - 1)))
    s = s.withColumn("__z1", F.asinh("__y") / F.sqrt(0.5 * F.log("__w2")))
    # Kurtosis, by a cube root of a chi-squared variable.
    s = s.withColumn("__x2", (c("__b2") - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))))
    s = s.withColumn("__root", 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))))
    s = s.withColumn("__a", 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root))))
    s = s.withColumn("__z2", (1 - 2 / (9 * c("__a")) - F.cbrt((1 - 2 / c("__a")) / (1 + c("__x2") * F.sqrt(2 / (c("__a") - 4))))) / F.sqrt(2 / (9 * c("__a"))))
    known = s.select(*keys, n.cast("long").alias("n"), (c("__z1") * c("__z1") + c("__z2") * c("__z2")).alias("k2"))
    few = small.select(*keys, c("__n").cast("long").alias("n"), F.lit(None).cast("double").alias("k2"))
    return known.unionByName(few).withColumn("p", F.exp(-F.col("k2") / 2))


def adaptive_test(df: DataFrame, keys: list[str], group: str, value: str, a, b, alpha: float = 0.05) -> DataFrame:
    """Pooled t where the values of both groups together look normal (p > alpha), else Mann-Whitney; with a label of the test."""
    known = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    normal = normality(known, keys, value).select(*keys, F.coalesce(F.col("p") > alpha, F.lit(False)).alias("normal"))
    t = t_test(known, keys, group, value, a, b, pooled=True).select(*keys, "n_a", "n_b", "t", "df", F.col("p").alias("p_t"))
    u = mann_whitney(known, keys, group, value, a, b).select(*keys, "u_a", F.col("p").alias("p_u"))
    out = normal.join(t, keys).join(u, keys)
    label = F.when(F.col("normal"), F.format_string("t(%d)", F.col("df").cast("long"))).otherwise(F.format_string("U(%d, %d)", "n_a", "n_b"))
    return out.select(*keys, "normal", F.when(F.col("normal"), F.col("t")).otherwise(F.col("u_a")).alias("statistic"), F.when(F.col("normal"), F.col("p_t")).otherwise(F.col("p_u")).alias("p"), label.alias("test"))


def pearson(df: DataFrame, keys: list[str], x: str, y: str, p: bool = True) -> DataFrame:
    """n, r, t (and p) over rows where both are known."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = both.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))
    r, n = F.col("r"), F.col("n")
    out = out.withColumn("t", F.when(n > 2, r * F.sqrt(F.try_divide(n - 2, 1 - r * r))))
    return out.withColumn("p", t_pvalue(F.col("t"), (n - 2).cast("double"))) if p else out


def spearman(df: DataFrame, keys: list[str], x: str, y: str, p: bool = True) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(both, keys, x).withColumnRenamed("rank_avg", "__x"), keys, y).withColumnRenamed("rank_avg", "__y")
    return pearson(ranked, keys, "__x", "__y", p)


def shepherd_pi(df: DataFrame, x: str, y: str, key: str, draws: int = 200, limit: float = 6.0, seed: int = 1, p: bool = True) -> DataFrame:
    """Spearman's correlation without bivariate outliers: rows whose Mahalanobis distance, averaged over bootstraps, is ``limit`` or more.

    A bootstrap weighs each row by a Poisson count drawn from a hash of its key,
    so all bootstraps' moments come from one grouped sum. p is doubled, as
    taking outliers away makes it too small.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.col(x).cast("double").alias("__p"), F.col(y).cast("double").alias("__q"))
    rows = known.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = (F.pmod(F.xxhash64(key, "draw", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    cumulative, term, count = 0.0, np.exp(-1.0), F.lit(0)
    for k in range(1, 8):  # the count is how many of the Poisson law's first sums lie below u
        cumulative += term
        count = count + F.when(u > float(cumulative), 1).otherwise(0)
        term /= k
    w, a, b = F.col("__w"), F.col("__p"), F.col("__q")
    rows = rows.withColumn("__w", count.cast("double"))
    m = rows.groupBy("draw").agg(*(F.sum(e).alias(n) for n, e in (("n", w), ("sx", w * a), ("sy", w * b), ("sxx", w * a * a), ("syy", w * b * b), ("sxy", w * a * b))))
    c = F.col
    m = m.where("n > 2").select("draw", (c("sx") / c("n")).alias("mx"), (c("sy") / c("n")).alias("my"), *(((c(f"s{i}{j}") - c(f"s{i}") * c(f"s{j}") / c("n")) / (c("n") - 1)).alias(f"v{i}{j}") for i, j in ("xx", "yy", "xy")))
    d, e = a - c("mx"), b - c("my")
    distance = F.try_divide(c("vyy") * d * d - 2 * c("vxy") * d * e + c("vxx") * e * e, c("vxx") * c("vyy") - c("vxy") * c("vxy"))
    far = known.crossJoin(F.broadcast(m)).groupBy(key).agg(F.avg(distance).alias("__d")).where(F.col("__d") >= limit)
    out = spearman(known.join(far, key, "left_anti"), [], "__p", "__q", p)
    return out.withColumn("p", F.least(F.lit(1.0), 2 * F.col("p"))) if p else out


def bonferroni(df: DataFrame, p: str = "p", family: list[str] = ()) -> DataFrame:
    """``p_bonferroni``: p times the number of known p of its family, at most 1."""
    m = F.count(p).over(Window.partitionBy(*family)) if family else F.lit(df.where(F.col(p).isNotNull()).count())
    return df.withColumn("p_bonferroni", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * m)))


def benjamini_hochberg(df: DataFrame, p: str = "p", family: list[str] = (), ties: list[str] = ()) -> DataFrame:
    """``p_fdr``: the smallest p * m / rank among p that are no smaller; null p stay null.

    Without a family all p are one, however many edges or vertices they come
    from: they are ranked in ranges, and only one number for each range is
    carried to the next.
    """
    known, unknown = df.where(F.col(p).isNotNull()), df.where(F.col(p).isNull()).withColumn("p_fdr", F.lit(None).cast("double"))
    parts = list(family) or ["__part"]
    over = Window.partitionBy(*parts)
    if family:
        ranked = known.withColumn("__r", F.row_number().over(over.orderBy(F.col(p), *ties))).withColumn("__m", F.count("*").over(over))
    else:
        rows = ranged(known, [p, *ties])
        carry = by_part(rows, F.count("*"), 0.0, lambda a, b: a + b)
        ranked = rows.withColumn("__r", F.row_number().over(over.orderBy(F.col(p), *ties))).join(F.broadcast(carry), "__part")
        ranked = ranked.withColumn("__r", F.col("__r") + F.col("__carry")).drop("__carry").withColumn("__m", F.lit(rows.count()))
    ranked = ranked.withColumn("__q", F.col(p) * F.col("__m") / F.col("__r"))
    best = ranked.withColumn("p_fdr", F.least(F.lit(1.0), F.min("__q").over(over.orderBy(F.col("__r").desc()).rowsBetween(Window.unboundedPreceding, 0))))
    if not family:
        behind = by_part(ranked, F.min("__q"), 1.0, min, backwards=True)
        best = best.join(F.broadcast(behind), "__part").withColumn("p_fdr", F.least("p_fdr", "__carry")).drop("__carry", "__part")
    return best.drop("__r", "__q", "__m").unionByName(unknown)


def ols(df: DataFrame, y: str, terms: list[str], p: bool = True) -> DataFrame:
    """term, coef, se, t (and p): least squares with an intercept, from sums of products alone; rows with a null are left out."""
    names = ["intercept", *terms]
    known = df.select(F.lit(1.0).alias("intercept"), *(F.col(c).cast("double") for c in [*terms, y])).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = [F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs] + [F.sum(F.col(c) * F.col(y)) for c in names] + [F.sum(F.col(y) * F.col(y))]
    row = np.array([x if x is not None else 0.0 for x in known.agg(*sums).first()], float)
    k = len(names)
    xx, xy, yy = np.zeros((k, k)), row[len(pairs) : -1], row[-1]
    for (i, j), v in zip(pairs, row, strict=False):
        xx[i, j] = xx[j, i] = v
    inverse = np.linalg.pinv(xx)
    coef, n = inverse @ xy, xx[0, 0]
    dof = n - k
    se = np.sqrt(np.maximum(0, np.diag(inverse) * (yy - coef @ xy) / dof)) if dof > 0 else np.full(k, np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        rows = [(name, *(float(v) if np.isfinite(v) else None for v in (c, s, c / s)), float(dof)) for name, c, s in zip(names, coef, se, strict=True)]
    out = df.sparkSession.createDataFrame(rows, "term string, coef double, se double, t double, df double")
    return out.withColumn("p", t_pvalue(F.col("t"), F.col("df"))) if p else out


def residuals(df: DataFrame, y: str, x: str, keys: list[str] = ()) -> DataFrame:
    """``residual`` of y on x within keys."""
    fit = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    joined = df.join(fit, list(keys)) if keys else df.crossJoin(F.broadcast(fit))
    return joined.withColumn("residual", F.col(y) - F.col("intercept") - F.col("slope") * F.col(x))


def mixed_anova(df: DataFrame, subject: str, between: str, within: str, value: str, p: bool = True) -> DataFrame:
    """Sums of squares and F of the between factor, the within factor and their interaction.

    Subjects without every level of the within factor are left out, as are
    null values; a subject's repeated values of a level are averaged.
    """
    cells = df.where(F.col(value).isNotNull()).groupBy(subject, between, within).agg(F.avg(value).alias("y"))
    levels = cells.select(within).distinct().count()
    full = cells.groupBy(subject, between).agg(F.avg("y").alias("ys"), F.count("*").alias("k")).where(F.col("k") == levels)
    cells = cells.join(full.select(subject, between, "ys"), [subject, between])
    groups = cells.groupBy(between).agg(F.avg("y").alias("yg"), F.countDistinct(subject).alias("n"))
    times = cells.groupBy(within).agg(F.avg("y").alias("yt"))
    mix = cells.groupBy(between, within).agg(F.avg("y").alias("yi"))
    whole = cells.agg(F.avg("y").alias("ym"))
    rows = cells.join(groups, between).join(times, within).join(mix, [between, within]).crossJoin(F.broadcast(whole))
    square = lambda x: F.sum((x) * (x))
    c = F.col
    s = rows.agg(
        square(c("yg") - c("ym")).alias("b"),
        square(c("ys") - c("yg")).alias("sb"),
        square(c("yt") - c("ym")).alias("w"),
        square(c("yi") - c("yg") - c("yt") + c("ym")).alias("bw"),
        square(c("y") - c("yi") - c("ys") + c("yg")).alias("e"),
        F.countDistinct(subject).alias("n"),
        F.countDistinct(between).alias("g"),
    )
    t, n, g = F.lit(float(levels)), c("n").cast("double"), c("g").cast("double")
    effects = [("between", c("b"), g - 1, c("sb"), n - g), ("within", c("w"), t - 1, c("e"), (n - g) * (t - 1)), ("interaction", c("bw"), (g - 1) * (t - 1), c("e"), (n - g) * (t - 1))]
    table = s.select(F.inline(F.array(*(F.struct(F.lit(name).alias("effect"), ss.alias("ss"), d1.alias("df1"), sse.alias("ss_error"), d2.alias("df2")) for name, ss, d1, sse, d2 in effects))))
    out = table.withColumn("f", F.try_divide(F.try_divide(c("ss"), c("df1")), F.try_divide(c("ss_error"), c("df2"))))
    return out.withColumn("p", f_pvalue(c("f"), c("df1"), c("df2"))) if p else out


def outliers(df: DataFrame, value: str, keys: list[str] = (), limit: float = 3.0) -> DataFrame:
    """``zscore`` (by the population deviation) and ``outlier`` flag within keys."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    joined = df.join(s, list(keys)) if keys else df.crossJoin(F.broadcast(s))
    z = F.try_divide(F.col(value) - F.col("__m"), F.col("__s"))
    return joined.withColumn("zscore", z).withColumn("outlier", F.coalesce(F.abs(z) > limit, F.lit(False))).drop("__m", "__s")


def column_correlations(df: DataFrame, key: str, columns: list[str], zero_diagonal: bool = True) -> DataFrame:
    """a, b, r of every ordered pair of columns, over rows where both are known."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))

    def entry(a: str, b: str, r: Column) -> Column:
        return F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r"))

    cells = [entry(*ab, F.lit(0.0) if a == b and zero_diagonal else F.col(f"r{i}")) for i, (a, b) in enumerate(pairs) for ab in {(a, b), (b, a)}]
    return wide.select(F.inline(F.array(*cells)))
