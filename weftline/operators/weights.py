"""Edge weights from the edges themselves: informativeness, or a self-supervised fit."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.config import SIGNALS, EdgeWeights
from weftline.operators.graph import minmax

#: Smallest weight of a signal that has edges.
FLOOR = 0.01
#: Signals that serve as labels of the fit, and so keep their fixed weights.
LABELS = ("adjacency", "section")


def informativeness(raw: DataFrame) -> DataFrame:
    """Rows (signal, pairs, importance): square root of the number of distinct pairs times their scores' deviation."""
    best = raw.groupBy("signal", "i", "j").agg(F.max("score").alias("score"))
    stats = best.groupBy("signal").agg(F.count(F.lit(1)).alias("pairs"), F.stddev_pop("score").alias("dev"))
    return stats.select("signal", "pairs", F.when(F.col("pairs") < 2, 0.0).otherwise(F.sqrt("pairs") * F.col("dev")).alias("importance"))


def _spread(scores: dict[str, float], live: list[str], budget: float) -> dict[str, float]:
    """Shares of the budget in proportion to scores, none below the floor."""
    total = sum(scores[s] for s in live)
    share = {s: max(FLOOR, budget * scores[s] / total if total > 0 else budget / len(live)) for s in live}
    scale = budget / sum(share.values())
    return {s: v * scale for s, v in share.items()}


def calibrate(raw: DataFrame, prior: EdgeWeights | None = None) -> EdgeWeights:
    """Weights in proportion to informativeness; signals without any keep nothing, all keep the prior if none has any."""
    prior = prior or EdgeWeights()
    score = {r["signal"]: float(r["importance"] or 0) for r in informativeness(raw).collect()}  # six rows at most
    live = [s for s in SIGNALS if score.get(s, 0) > 0]
    if not live:
        return prior
    got = _spread(score, live, 1.0)
    return EdgeWeights(**{s: got.get(s, 0.0) for s in SIGNALS})


def _smallest(pairs: DataFrame, n: int) -> DataFrame:
    """The n distinct pairs with the smallest hashes. Only those of one part in 4,096 are sorted, not all in one task."""
    hashed = pairs.withColumn("h", F.xxhash64("i", "j")).withColumn("part", F.shiftright("h", 52))
    cut, below = None, 0
    for r in sorted(hashed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):  # 4,096 rows at most
        if below + r["n"] > n:
            cut = r["part"]
            break
        below += r["n"]
    if cut is None:
        return pairs
    rest = hashed.where(F.col("part") == cut).orderBy("h", "i", "j").limit(n - below)
    return hashed.where(F.col("part") < cut).unionByName(rest).select("i", "j")


def fit(raw: DataFrame, nodes: DataFrame, prior: EdgeWeights | None = None, seed: int = 42, max_iter: int = 100) -> tuple[EdgeWeights, float]:
    """Logistic regression of "linked by reading order or section" on the other signals; weights and held-out AUC.

    Negatives are random pairs, as many as positives, that no label signal links; the split is by the pair's
    hash. Negative coefficients count as zero.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    prior = prior or EdgeWeights()
    norm = minmax(raw)
    wide = norm.groupBy("i", "j").agg(*(F.coalesce(F.max(F.when(F.col("signal") == s, F.col("norm"))), F.lit(0.0)).alias(s) for s in SIGNALS))
    positive = norm.where(F.col("signal").isin(*LABELS)).select("i", "j").distinct()
    n = positive.count()
    free = [s for s in SIGNALS if s not in LABELS]
    if n < 10:
        return prior, float("nan")
    # Random pairs by two independent orders of the nodes' hashes: each is one row of a join on the place.
    from pyspark.sql import Window

    numbered = lambda salt, name: nodes.select(F.col("id").alias(name), F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(64))).orderBy(F.xxhash64("id", F.lit(salt + 1)))).alias("place"), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(64)).alias("part"))
    negative = None
    for k in range(4):
        pairs = numbered(seed + 10 * k, "a").join(numbered(seed + 10 * k + 5, "b"), ["place", "part"]).where("a <> b").select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
        negative = pairs if negative is None else negative.unionByName(pairs)
    negative = _smallest(negative.distinct().join(positive, ["i", "j"], "left_anti"), n)
    rows = positive.withColumn("label", F.lit(1.0)).unionByName(negative.withColumn("label", F.lit(0.0))).join(wide, ["i", "j"], "left").fillna(0.0)
    data = VectorAssembler(inputCols=free, outputCol="features").transform(rows).select("features", "label", (F.pmod(F.xxhash64("i", "j", F.lit(seed)), F.lit(5)) == 0).alias("test"))
    data = data.persist(StorageLevel.DISK_ONLY)  # read by the fit, the evaluation and a count
    train, test = data.where("not test"), data.where("test")
    model = LogisticRegression(standardization=False, regParam=1.0 / max(train.count(), 1), maxIter=max_iter).fit(train)
    auc = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction").evaluate(model.transform(test))
    data.unpersist()
    score = {s: max(0.0, float(c)) for s, c in zip(free, model.coefficients, strict=True)}
    live = [s for s in free if score[s] > 0]
    if not live:
        return prior, auc
    budget = 1 - sum(prior.as_dict()[s] for s in LABELS)
    got = _spread(score, live, budget)
    out = {s: prior.as_dict()[s] if s in LABELS else got.get(s, 0.0) for s in SIGNALS}
    scale = 1 / math.fsum(out.values())
    return EdgeWeights(**{s: v * scale for s, v in out.items()}), auc
