"""Assignment of communities to reference networks, and label maps against one another."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.shared import stored


def overlaps(subject: DataFrame, target: DataFrame, keys: list[str] = (), node: str = "node") -> DataFrame:
    """module, network, common, jaccard: contingency of two labellings; module -1 and networks below 1 do not count."""
    modules = subject.where("module <> -1").select(*keys, F.col(node), "module")
    networks = target.select(F.col(node), F.col("label").alias("network"))
    common = modules.join(networks.where("network > 0"), node).groupBy(*keys, "module", "network").agg(F.count("*").alias("common"))
    n_module = modules.groupBy(*keys, "module").agg(F.count("*").alias("n_module"))
    n_network = networks.where("network > 0").groupBy("network").agg(F.count("*").alias("n_network"))
    joined = common.join(n_module, [*keys, "module"]).join(n_network, "network")
    return joined.select(*keys, "module", "network", "common", (F.col("common") / (F.col("n_module") + F.col("n_network") - F.col("common"))).alias("jaccard"))


def jaccard_assignment(subject: DataFrame, target: DataFrame, threshold: float = 0.1, keys: list[str] = ()) -> DataFrame:
    """module, network, jaccard: each community's best network above the threshold, the lowest of equals."""
    best = overlaps(subject, target, keys).groupBy(*keys, "module").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "network")).alias("b"))
    return best.select(*keys, "module", F.col("b.network").alias("network"), (-F.col("b.j")).alias("jaccard")).where(F.col("jaccard") > threshold)


def greedy_assignment(subject: DataFrame, target: DataFrame, priority: list[int], threshold: float = 0.1) -> DataFrame:
    """One community to each network at most, networks choosing in order of priority.

    The choices depend on one another, so they are made over the contingency
    table of communities and networks, whose size is that of the two label
    sets.
    """
    rows = sorted(overlaps(subject, target).where(F.col("jaccard") > threshold).collect(), key=lambda r: (-r["jaccard"], r["module"]))
    taken: dict[int, tuple] = {}
    for network in priority:
        best = next((r for r in rows if r["network"] == network and r["module"] not in taken), None)
        if best:
            taken[best["module"]] = (best["module"], network, best["jaccard"])
    return subject.sparkSession.createDataFrame(list(taken.values()), "module long, network long, jaccard double")


def informative_thresholds(labels: DataFrame, least: int = 5, above: float = 0.09) -> DataFrame:
    """Rows of thresholds with more than ``least`` labels, or beyond a density that is kept in any case."""
    kept = labels.groupBy("threshold").agg(F.countDistinct("label").alias("k")).where((F.col("k") > least) | (F.col("threshold") > above))
    return labels.join(F.broadcast(kept.select("threshold")), "threshold", "left_semi")


#: Template values up to which every task holds all of them.
TEMPLATE_VALUES = 2_000_000


def eta_squared(rows: DataFrame, templates: DataFrame, least: float | None = None, skipped: tuple[int, ...] = (), held: int = TEMPLATE_VALUES) -> DataFrame:
    """node, template, eta2: likeness of each node's map (node, target, w) to each template (template, target, w).

    Template values at or below ``least`` are left out, as are skipped templates
    and null values. Of both maps over the targets that they share only the sums
    of a, a², b, b² and a·b are needed. A node's map is compared with all
    templates at once, as a product with their matrix, where that is small
    enough for every task; else template by template in a join.
    """
    t = templates.where(~F.col("template").isin(*skipped)) if skipped else templates
    t = t if least is None else t.where(F.col("w") > least)
    t = stored(t.select("template", F.col("target").cast("long").alias("target"), F.col("w").cast("double").alias("w")).where("w is not null and target is not null").groupBy("template", "target").agg(F.avg("w").alias("w")))
    maps = rows.select("node", F.col("target").cast("long").alias("target"), F.col("w").cast("double").alias("w")).where("w is not null")
    if t.count() > held:
        both = maps.withColumnRenamed("w", "a").join(t.withColumnRenamed("w", "b"), "target")
        products = {"sa": F.col("a"), "sb": F.col("b"), "aa": F.col("a") * F.col("a"), "bb": F.col("b") * F.col("b"), "ab": F.col("a") * F.col("b")}
        s = both.groupBy("node", "template").agg(F.count("*").alias("n"), *(F.sum(v).alias(k) for k, v in products.items()))
        squares, grand = F.col("aa") + F.col("bb"), (F.col("sa") + F.col("sb")) / 2 / F.col("n")
        return s.select("node", "template", (1 - F.try_divide(squares / 2 - F.col("ab"), squares - 2 * F.col("n") * grand * grand)).alias("eta2"))
    kinds = dict(rows.dtypes) | {"template": dict(t.dtypes)["template"]}
    table = t.toPandas()  # at most ``held`` values
    names, targets = sorted(table["template"].unique()), np.sort(table["target"].unique())
    matrix = np.full((len(targets), len(names)), np.nan)
    matrix[np.searchsorted(targets, table["target"]), np.searchsorted(names, table["template"])] = table["w"]
    shared = rows.sparkSession.sparkContext.broadcast((names, targets, matrix))

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        names, targets, matrix = shared.value
        target, a = group["target"].to_numpy(), group["w"].to_numpy(float)
        known = np.isin(target, targets)
        a, b = a[known], matrix[np.searchsorted(targets, target[known])]
        there = ~np.isnan(b)
        b = np.where(there, b, 0)
        n, sa, aa = there.sum(axis=0), a @ there, (a * a) @ there
        squares, grand = aa + (b * b).sum(axis=0), (sa + b.sum(axis=0)) / 2 / np.maximum(1, n)
        total = squares - 2 * n * grand * grand
        with np.errstate(divide="ignore", invalid="ignore"):
            eta = np.where(total != 0, 1 - (squares / 2 - a @ b) / total, np.nan)
        shares = np.flatnonzero(n)
        return pd.DataFrame({"node": group["node"].iloc[0], "template": [names[k] for k in shares], "eta2": eta[shares]})

    found = maps.groupBy("node").applyInPandas(compared, f"node {kinds['node']}, template {kinds['template']}, eta2 double")
    return found.withColumn("eta2", F.nanvl("eta2", F.lit(None)))


def winner(eta: DataFrame) -> DataFrame:
    """node, template, eta2 of the best template, the lowest of equals."""
    best = eta.where("eta2 is not null").groupBy("node").agg(F.min(F.struct((-F.col("eta2")).alias("e"), "template")).alias("b"))
    return best.select("node", F.col("b.template").alias("template"), (-F.col("b.e")).alias("eta2"))


def second_pass(rows: DataFrame, templates: DataFrame, first: float, again: float, motor: tuple[int, ...], skipped: tuple[int, ...] = ()) -> DataFrame:
    """Winners at one template limit; nodes won by motor templates are matched anew at a higher one, among those."""
    won = winner(eta_squared(rows, templates, first, skipped))
    redo = won.where(F.col("template").isin(*motor)).select("node")
    once = winner(eta_squared(rows.join(redo, "node", "left_semi"), templates.where(F.col("template").isin(*motor)), again))
    return won.join(redo, "node", "left_anti").unionByName(once)


def overlapping(eta: DataFrame, limits: DataFrame) -> DataFrame:
    """node, template: every template whose own limit (template, least) the node exceeds."""
    return eta.join(F.broadcast(limits), "template").where(F.col("eta2") > F.col("least")).select("node", "template", "eta2")


def restricted(values: DataFrame, labels: DataFrame, label: int, node: str = "node") -> DataFrame:
    """Rows of nodes that another map gives a label."""
    return values.join(labels.where(F.col("label") == label).select(node), node, "left_semi")
