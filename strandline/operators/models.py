"""Trained models as DataFrame transforms: feature columns and a 0/1 label in, one score column out.

Rows with a null feature or label are not learnt from; a row with a null feature
gets a null score. Fits run in Spark's own ML library; nothing is collected but
the counts of the two classes and the fitted parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import exact_levels

#: Scores are kept this far from 0 and 1 before their logit is taken.
LOGIT_MARGIN = 1e-6


def _complete(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in cols))


def balanced_weight(df: DataFrame, label: str) -> Column:
    """Half the rows over the rows of the row's class, so that both classes weigh the same."""
    n = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("int")).count().collect()}
    if not set(n) <= {0, 1}:
        raise ValueError(f"{label} must be 0 or 1")
    total = sum(n.values())
    return F.when(F.col(label) == 1, F.lit(total / (2 * n.get(1, 1)))).otherwise(F.lit(total / (2 * n.get(0, 1))))


def fit(df: DataFrame, features: list[str], label: str, kind: str = "logistic", seed: int = 2317) -> PipelineModel:
    """Fits ``logistic``, ``boosted`` (trees) or ``mlp``; the first two weigh classes equally."""
    estimators = {
        "logistic": lambda: LogisticRegression(labelCol="_sl_y", featuresCol="_sl_x", weightCol="_sl_w", maxIter=100),
        "boosted": lambda: GBTClassifier(labelCol="_sl_y", featuresCol="_sl_x", weightCol="_sl_w", maxIter=20, maxDepth=4, seed=seed),
        "mlp": lambda: MultilayerPerceptronClassifier(labelCol="_sl_y", featuresCol="_sl_x", layers=[len(features), 8, 2], maxIter=60, seed=seed),
    }
    if kind not in estimators:
        raise KeyError(f"no model {kind!r}; there are {sorted(estimators)}")
    train = df.where(_complete([*features, label])).select(
        *[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("_sl_y"), balanced_weight(df.where(_complete(features)), label).alias("_sl_w")
    )
    steps = [
        VectorAssembler(inputCols=features, outputCol="_sl_raw"),
        StandardScaler(inputCol="_sl_raw", outputCol="_sl_x", withMean=True),
        estimators[kind]().setProbabilityCol("_sl_p").setRawPredictionCol("_sl_r").setPredictionCol("_sl_c"),
    ]
    return Pipeline(stages=steps).fit(train)


def score(df: DataFrame, model: PipelineModel, features: list[str], name: str = "score") -> DataFrame:
    """df with the probability of label 1 in ``name``."""
    keep = [c for c in df.columns if c != name]
    row = df.select(*keep, *[F.col(c).alias(f"_sl_f_{c}") for c in features])
    filled = row.withColumns({c: F.coalesce(F.col(f"_sl_f_{c}").cast("double"), F.lit(0.0)) for c in features})
    out = model.transform(filled).withColumn("_sl_s", vector_to_array("_sl_p")[1])
    back = [F.col(f"_sl_f_{c}").alias(c) if c in features else F.col(c) for c in keep]
    return out.select(*back, F.when(_complete([f"_sl_f_{c}" for c in features]), F.col("_sl_s")).alias(name))


def fold_of(group: str, folds: int, seed: int = 2317) -> Column:
    """Fold by the hash of the group, so that a group lies in one fold and no row moves."""
    return F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(folds)).cast("int")


def cross_fit(df: DataFrame, features: list[str], label: str, group: str, folds: int = 2, kind: str = "logistic", seed: int = 2317, name: str = "score") -> DataFrame:
    """df with ``_fold`` and a score of each row from a model that saw none of its group."""
    dealt = df.withColumn("_fold", fold_of(group, folds, seed))
    parts = []
    for k in range(folds):
        model = fit(dealt.where(F.col("_fold") != k), features, label, kind, seed)
        parts.append(score(dealt.where(F.col("_fold") == k), model, features, name))
    return reduce(DataFrame.unionByName, parts)


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(LOGIT_MARGIN)), F.lit(1 - LOGIT_MARGIN))
    return F.log(q / (1 - q))


def platt(held_out: DataFrame, raw: str, label: str) -> tuple[float, float]:
    """(slope, intercept) of a logistic fit of the label on the raw score's logit; refuses a slope that reverses order."""
    rows = held_out.where(_complete([raw, label])).select(logit(F.col(raw)).alias("_sl_l"), F.col(label).cast("double").alias("_sl_y"))
    steps = [VectorAssembler(inputCols=["_sl_l"], outputCol="_sl_x"), LogisticRegression(labelCol="_sl_y", featuresCol="_sl_x", standardization=False)]
    line = Pipeline(stages=steps).fit(rows).stages[-1]
    slope = float(line.coefficients[0])
    if slope <= 0:
        raise ValueError(f"calibration slope {slope} is not positive")
    return slope, float(line.intercept)


def calibrated(df: DataFrame, features: list[str], label: str, group: str, folds: int = 3, kind: str = "boosted", name: str = "score") -> DataFrame:
    """df scored by a model of all rows whose scores are calibrated on group-held-out ones; order within the raw score stays."""
    slope, intercept = platt(cross_fit(df, features, label, group, folds, kind, name="_sl_raw_score"), "_sl_raw_score", label)
    raw = score(df, fit(df, features, label, kind), features, "_sl_raw_score")
    return raw.withColumn(name, 1 / (1 + F.exp(-(slope * logit(F.col("_sl_raw_score")) + intercept)))).drop("_sl_raw_score")


def cross_source_rows(a: DataFrame, b: DataFrame, key: str, label: str, both: bool = False) -> DataFrame:
    """Training rows of two sources with equal columns, each key weighing 1 in all.

    A key of one source gives its row. A key of both gives two rows at 1/2, or with
    ``both`` four rows at 1/4: the features of either source with the label of either.
    """
    other = (b.select(key, F.col(label).alias("_sl_o")), a.select(key, F.col(label).alias("_sl_o")))
    parts = []
    for name, mine, theirs in (("a", a, other[0]), ("b", b, other[1])):
        j = mine.join(theirs.withColumn("_sl_in", F.lit(True)), key, "left")
        shared = F.coalesce(F.col("_sl_in"), F.lit(False))
        one = F.array(F.col(label))
        labels = F.when(shared, F.array(F.col(label), F.col("_sl_o"))).otherwise(one) if both else one
        rest = [c for c in mine.columns if c != label]
        row = j.select(*rest, F.lit(name).alias("origin"), F.when(shared, 0.25 if both else 0.5).otherwise(1.0).alias("weight"), labels.alias("_sl_labels"))
        parts.append(row.withColumn(label, F.explode("_sl_labels")).drop("_sl_labels"))
    return parts[0].unionByName(parts[1])


def partial_dependence(df: DataFrame, inputs: list[str], varied: str, scorer: Callable[[dict[str, np.ndarray]], np.ndarray], levels: list[float], raise_to: str | None = None) -> DataFrame:
    """(step, level, value, mean): the mean score of all rows with one input set to each of its quantiles.

    ``scorer`` takes arrays by input name and gives a score each. The grid runs inside it, batch by batch, so the table
    is read twice (once for the quantiles) and never multiplied. ``raise_to`` names an input that is never below the varied one.
    Rows with a null input are left out; an empty table gives no row.
    """
    rows = df.where(_complete(inputs)).select(*[F.col(c).cast("double").alias(c) for c in inputs])
    found = exact_levels(rows, varied, levels).first()["levels"]  # a number for each level
    grid = [float(v) for v in found or []]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(grid)), 0
        for b in batches:
            x = {c: b.column(c).to_numpy() for c in inputs}
            for i, v in enumerate(grid):
                changed = x | {varied: np.full(b.num_rows, v)}
                if raise_to is not None:
                    changed[raise_to] = np.maximum(x[raise_to], v)
                total[i] += float(np.sum(scorer(changed)))
            n += b.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"step": np.arange(len(grid), dtype=np.int32), "total": total, "n": np.full(len(grid), n)})

    sums = rows.mapInArrow(run, "step int, total double, n long").groupBy("step").agg((F.sum("total") / F.sum("n")).alias("mean"))
    steps = F.array(*[F.struct(F.lit(i).alias("_s"), F.lit(float(q)).alias("level"), F.lit(v).alias("value")) for i, (q, v) in enumerate(zip(levels, grid, strict=False))]) if grid else None
    if steps is None:
        return sums.select("step", F.lit(0.0).alias("level"), F.lit(0.0).alias("value"), "mean")
    at = F.element_at(steps, F.col("step") + 1)
    return sums.select("step", at["level"].alias("level"), at["value"].alias("value"), "mean")


def average_linkage(distances: dict[tuple[str, str], float]) -> list[str]:
    """Names in the order in which average linkage joins them: each merge puts the earlier made cluster first.

    For the few names of a correlation table; distances between clusters are the means over their members.
    """
    names = sorted({n for pair in distances for n in pair})
    d = {frozenset((i, j)): distances.get((a, b), distances.get((b, a))) for i, a in enumerate(names) for j, b in enumerate(names) if i < j}
    members = {i: [i] for i in range(len(names))}
    made = len(names)
    while len(members) > 1:
        apart = min(((d[frozenset((i, j))], i, j) for i in members for j in members if i < j))
        _, i, j = apart
        a, b = members.pop(i), members.pop(j)
        for k in members:
            d[frozenset((k, made))] = (len(a) * d[frozenset((k, i))] + len(b) * d[frozenset((k, j))]) / (len(a) + len(b))
        members[made] = a + b
        made += 1
    return [names[i] for m in members.values() for i in m]
