"""Regression, classification and trees."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.operators.ordered import add_sequence
from rowmill.operators.rows import case_chain


def gram(df: DataFrame, xs: list[str], y: str) -> tuple[int, np.ndarray]:
    """(n, cross products of 1, xs and y) over the rows without a missing value, in one aggregate."""
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in [*xs, y])]
    full = df.dropna(subset=[*xs, y])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = full.agg(*(F.coalesce(F.sum(cols[i] * cols[j]), F.lit(0.0)).alias(f"_{i}_{j}") for i, j in pairs)).head()
    g = np.zeros((len(cols), len(cols)))
    for (i, j), v in zip(pairs, row, strict=True):
        g[i, j] = g[j, i] = v
    return int(g[0, 0]), g


def _t_tail(t: float, df: float) -> float:
    """Two-sided p-value of t, by Simpson's rule on the angle form of the t law."""
    a, n = math.atan(abs(t) / math.sqrt(df)), 2000
    f = lambda x: math.cos(x) ** (df - 1)
    s = sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(a + (math.pi / 2 - a) * i / n) for i in range(n + 1)) * (math.pi / 2 - a) / n / 3
    return min(1.0, 2 * s * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi))


def solve(n: int, g: np.ndarray, use: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, p-values, residual sum of squares) on columns 0 (the intercept) and ``use``."""
    k = [0, *use]
    a, b = g[np.ix_(k, k)], g[k, -1]
    coef = np.linalg.solve(a, b)
    rss = max(float(g[-1, -1] - coef @ b), 0.0)
    dof = n - len(k)
    se = np.sqrt(np.maximum(rss / max(dof, 1) * np.diag(np.linalg.inv(a)), 1e-300))
    return coef, np.array([_t_tail(c / s, dof) for c, s in zip(coef, se, strict=True)]), rss


def stepwise(df: DataFrame, y: str, xs: list[str], enter: float = 0.15, stay: float = 0.15) -> DataFrame:
    """(term, coefficient, p_value): variables enter by smallest p-value below ``enter``; after each, those
    above ``stay`` leave.  All sums come from one pass over the rows."""
    n, g = gram(df, xs, y)
    used: list[int] = []
    for _ in range(4 * len(xs)):
        tries = []
        for i in (i for i in range(1, len(xs) + 1) if i not in used):
            try:
                tries.append((float(solve(n, g, [*used, i])[1][-1]), i))
            except np.linalg.LinAlgError:
                continue
        if not tries or min(tries)[0] >= enter:
            break
        added = min(tries)[1]
        used.append(added)
        p = solve(n, g, used)[1][1:]
        out = {used[i] for i in range(len(used)) if p[i] > stay}
        used = [i for i in used if i not in out]
        if added in out:
            break
    coef, p, _ = solve(n, g, used)
    names = ["intercept", *(xs[i - 1] for i in used)]
    return df.sparkSession.createDataFrame([(t, float(c), float(v)) for t, c, v in zip(names, coef, p, strict=True)], "term string, coefficient double, p_value double")


def ancova(df: DataFrame, y: str, group: str, covariates: list[str], max_groups: int = 50) -> DataFrame:
    """(group, n, mean, adjusted): means by group, and those at the covariates' overall means."""
    levels = sorted(r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().limit(max_groups + 1).collect())
    if len(levels) > max_groups:
        raise ValueError(f"{group} has more than {max_groups} levels")
    full = df.dropna(subset=[y, group, *covariates])
    flags = [(f"_g{i}", F.when(F.col(group) == v, 1.0).otherwise(0.0)) for i, v in enumerate(levels[1:])]
    n, g = gram(full.withColumns(dict(flags)) if flags else full, [*(k for k, _ in flags), *covariates], y)
    use = list(range(1, len(flags) + len(covariates) + 1))
    coef, _, _ = solve(n, g, use)
    at = sum(coef[1 + len(flags) + i] * g[0, 1 + len(flags) + i] / n for i in range(len(covariates)))
    adjusted = [(v, float(coef[0] + at + (coef[i] if i else 0.0))) for i, v in enumerate(levels)]
    made = df.sparkSession.createDataFrame(adjusted, f"`{group}` {dict(df.dtypes)[group]}, adjusted double")
    return full.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean")).join(made, group)


def _assembled(df: DataFrame, xs: list[str], classes: list[str], y: Column):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    rows = df.withColumn("label", y.cast("double")).dropna(subset=[*xs, "label"])
    steps = [StringIndexer(inputCols=classes, outputCols=[f"{c}_i" for c in classes], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_i" for c in classes], outputCols=[f"{c}_v" for c in classes])] if classes else []
    return Pipeline(stages=[*steps, VectorAssembler(inputCols=[*xs, *(f"{c}_v" for c in classes)], outputCol="features")]).fit(rows).transform(rows)


def proc_logistic(df: DataFrame, y: Column, xs: list[str], classes: list[str]) -> DataFrame:
    """(variable, odds_ratio, c): odds ratios of the numeric variables, and the area under the curve."""
    from pyspark.ml.classification import LogisticRegression

    rows = _assembled(df, xs, classes, y)
    model = LogisticRegression(maxIter=50).fit(rows)
    area = model.summary.areaUnderROC
    return df.sparkSession.createDataFrame([(x, float(math.exp(b)), float(area)) for x, b in zip(xs, model.coefficients.toArray(), strict=False)], "variable string, odds_ratio double, c double")


def proc_tree(df: DataFrame, y: Column, xs: list[str], classes: list[str], depth: int = 6) -> DataFrame:
    """One row: nodes, depth and accuracy of an entropy tree."""
    from pyspark.ml.classification import DecisionTreeClassifier

    rows = _assembled(df, xs, classes, y)
    model = DecisionTreeClassifier(impurity="entropy", maxDepth=depth, seed=1).fit(rows)
    return model.transform(rows).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")).withColumns({"n_nodes": F.lit(model.numNodes), "depth": F.lit(model.depth)})


def platt(df: DataFrame, score: str, y: Column) -> tuple[float, float]:
    """Intercept and slope of the logistic curve of one score."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=[score], outputCol="features").transform(df.withColumn("label", y.cast("double")))
    m = LogisticRegression(maxIter=50).fit(rows)
    return float(m.intercept), float(m.coefficients[0])


def calibrated(df: DataFrame, score: str, y: Column) -> DataFrame:
    """``df`` with Platt's probability for a score: a logistic curve of one variable."""
    a, b = platt(df, score, y)
    return df.withColumn("probability", 1 / (1 + F.exp(-(F.lit(a) + b * F.col(score)))))


def macro(fn: Callable[..., DataFrame], **fixed) -> Callable[[DataFrame], DataFrame]:
    """A table transform with its parameters filled in, for ``df.transform``."""
    return lambda df: fn(df, **fixed)


def mixture_fit(df: DataFrame, vec: str, ks: list[int], dims: int | None = None, seed: int = 1) -> DataFrame:
    """(k, log_likelihood, bic) of Gaussian mixtures with so many parts, two at least: the least criterion is
    the best fit.  With ``dims`` the vectors go by so many principal components first."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(vec).isNotNull()).select(array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("features"), F.size(vec).alias("_d"))
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.max("_d").alias("d")).head()
    d = dims or row.d
    if dims:
        rows = PCA(k=dims, inputCol="features", outputCol="_f").fit(rows).transform(rows).select(F.col("_f").alias("features"))
    made = []
    for k in ks:
        like = float(GaussianMixture(k=k, seed=seed, maxIter=20).fit(rows).summary.logLikelihood)
        # weights, means and the upper triangles of the covariances
        free = k - 1 + k * d + k * d * (d + 1) / 2
        made.append((k, like, free * math.log(row.n) - 2 * like))
    return df.sparkSession.createDataFrame(made, "k int, log_likelihood double, bic double")


def stratified_split(df: DataFrame, key: str, label: str, percent: int, seed: int = 0, out: str = "part") -> DataFrame:
    """TRAIN for ``percent`` of the rows of each label (rounded up), VALID for the rest, in the order of a hash of key and seed.

    Places within a label come from numbers over all rows in order of label and hash, so no task holds a label."""
    mixed = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    rows = add_sequence(df.withColumn("_h", mixed), [label, "_h", key], "_at", start=0)
    sizes = rows.groupBy(F.col(label).alias("_l")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    place = rows.join(sizes, F.col(label).eqNullSafe(F.col("_l")))
    train = F.col("_at") - F.col("_first") < F.ceil(F.col("_n") * percent / 100)
    return place.withColumn(out, F.when(train, "TRAIN").otherwise("VALID")).drop("_h", "_at", "_l", "_first", "_n")


def risk_model(df: DataFrame, key: str, label: str, xs: list[str], percent: int = 80, bins: int = 10) -> DataFrame:
    """(part, n, accuracy, ece): a logistic model of a risk label that weighs classes alike, calibrated one
    class against the rest, on the rows it learned from and on those held out.

    Rows are dealt within each label, ``percent`` of a label's rows (rounded up) to learn from.  Labels are few; rows
    with a missing feature or label are left out."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    full = stratified_split(df.dropna(subset=[key, label, *xs]), key, label, percent, 5)
    rows = VectorAssembler(inputCols=xs, outputCol="features").transform(full)
    names = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    rows = names.transform(rows)
    seen = {r["label"]: r["n"] for r in rows.where("part = 'TRAIN'").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = case_chain([(F.col("label") == c, sum(seen.values()) / (len(seen) * n)) for c, n in sorted(seen.items())], 1.0)
    rows = rows.withColumn("_w", weight.cast("double"))
    model = LogisticRegression(weightCol="_w", maxIter=50).fit(rows.where("part = 'TRAIN'"))
    scored = model.transform(rows).withColumn("_p", vector_to_array("probability"))
    curves = []
    for i in range(len(names.labels)):
        one = scored.where("part = 'TRAIN'").select(F.col("_p")[i].alias("_s"), (F.col("label") == i).alias("_y"))
        m = platt(one, "_s", F.col("_y"))
        curves.append(1 / (1 + F.exp(-(m[0] + m[1] * F.col("_p")[i]))))
    each = scored.select("part", "label", F.array(*curves).alias("_c"))
    best = F.array_position("_c", F.array_max("_c")) - 1
    accuracy = each.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg((best == F.col("label")).cast("double")).alias("accuracy"))
    flat = each.select("part", "label", F.posexplode("_c").alias("_i", "_q")).groupBy("part", F.least(F.floor(F.col("_q") * bins), F.lit(bins - 1)).alias("_b"))
    gaps = flat.agg(F.count(F.lit(1)).alias("_m"), F.abs(F.avg("_q") - F.avg((F.col("_i") == F.col("label")).cast("double"))).alias("_g"))
    return accuracy.join(gaps.groupBy("part").agg((F.sum(F.col("_m") * F.col("_g")) / F.sum("_m")).alias("ece")), "part")
