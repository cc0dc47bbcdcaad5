"""Training losses as aggregates over similarity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.operators.blocks import LogSumExp, grid


def info_nce(pairs: DataFrame, temperature: float = 0.05, hard_weight: float = 0.0) -> DataFrame:
    """``(anchor, loss)`` from ``(anchor, other, sim, kind)``: kind ``pos`` is the anchor's own positive, ``hard`` its own
    hard negative, whose logit gets the weight, ``other`` all the rest; cross-entropy of the positive among all."""
    logit = F.col("sim") / temperature + F.when(F.col("kind") == "hard", hard_weight).otherwise(0.0)
    rows = pairs.withColumn("logit", logit)
    top = rows.groupBy("anchor").agg(F.max("logit").alias("top"))
    rows = rows.join(top, "anchor")
    own = F.max(F.when(F.col("kind") == "pos", F.col("logit")))
    return rows.groupBy("anchor").agg((F.log(F.sum(F.exp(F.col("logit") - F.col("top")))) + F.max("top") - own).alias("loss"))


def in_batch_loss(anchors: DataFrame, positives: DataFrame, hard: DataFrame | None = None, temperature: float = 0.05, hard_weight: float = 0.0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(anchor, loss)`` of anchors among all positives and hard negatives of the batch; rows of one id belong together.

    Blocks hand on the largest logit of each anchor and the sum of the exponentials over it; such states add up, so no
    pair leaves a task.
    """
    state = lambda side, weight: grid(anchors, side, lambda: LogSumExp(temperature, weight), id_col, vector)
    parts = state(positives, 0.0).withColumn("pos", F.col("own"))
    if hard is not None:
        parts = parts.unionByName(state(hard, hard_weight).withColumn("pos", F.lit(None).cast("double")))
    parts = parts.where("total > 0")
    whole = parts.groupBy("q").agg(F.max("top").alias("top"), F.collect_list(F.struct("top", "total")).alias("s"), F.max("pos").alias("pos"))  # one for each group of blocks
    total = F.aggregate("s", F.lit(0.0), lambda t, x: t + x["total"] * F.exp(x["top"] - F.col("top")))
    return whole.select(F.col("q").alias("anchor"), (F.log(total) + F.col("top") - F.col("pos")).alias("loss"))


def masked_cross_entropy(logits: Column, labels: Column) -> Column:
    """Per row the summed cross-entropy and the number of the masked tokens: ``logits`` has an array over the vocabulary for
    each token, ``labels`` the right place in it, null where a token isn't masked."""
    def entropy(z: Column, label: Column) -> Column:
        top = F.array_max(z).cast("double")
        total = F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
        return F.when(label.isNotNull(), F.log(total) + top - F.get(z, label).cast("double"))

    each = F.array_compact(F.zip_with(logits, labels, entropy))
    return F.struct(F.aggregate(each, F.lit(0.0), lambda s, x: s + x).alias("total"), F.size(each).cast("long").alias("n"))


def with_masked_loss(contrastive: Column, masked: Column, weight: float = 0.1) -> Column:
    """The contrastive loss plus the weighted mean cross-entropy of all masked tokens (sums of ``masked_cross_entropy``)."""
    return contrastive + weight * F.coalesce(F.try_divide(masked["total"], masked["n"]), F.lit(0.0))


def scaled_squares(sim: Column, label: Column, negative_scale: Column) -> Column:
    """Mean squared error against 1 for positives and 0 for negatives, the latter scaled."""
    return F.avg(F.when(label == 1, (sim - 1) * (sim - 1)).otherwise(negative_scale * sim * sim))


def hinge(pos: Column, neg: Column, margin: float = 0.2) -> Column:
    return F.greatest(F.lit(0.0), margin - pos + neg)


def cosine_embedding(sim: Column, label: Column) -> Column:
    """1 - sim for label 1, the positive part of sim for label -1."""
    return F.when(label == 1, 1 - sim).otherwise(F.greatest(F.lit(0.0), sim))


def probe_accuracy(features: DataFrame, label: str, vector: str, fold: str, grid: tuple[float, ...] = (0.0, 0.01, 0.1)) -> DataFrame:
    """``(reg, dev)``: mean accuracy in percent, over held-out folds, of logistic regression with each penalty."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = features.select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"), fold).cache()
    folds = [r[0] for r in data.select(fold).distinct().orderBy(fold).collect()]
    out = None
    for reg in grid:
        for f in folds:
            model = LogisticRegression(regParam=reg, maxIter=30).fit(data.where(F.col(fold) != f))
            right = model.transform(data.where(F.col(fold) == f)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")).select(F.lit(reg).alias("reg"), "accuracy")
            out = right if out is None else out.unionByName(right)
    return out.groupBy("reg").agg(F.round(100 * F.avg("accuracy"), 2).alias("dev"))


def nested_probe(features: DataFrame, label: str, vector: str, fold: str, grid: tuple[float, ...] = (0.0, 0.01, 0.1), hidden: int = 0) -> DataFrame:
    """``(fold, reg, accuracy)`` in percent of nested folds: each fold is tested once, with the penalty that does best, the
    first of equals, in cross-validation over the other folds.

    With ``hidden`` units the classifier is a network with one hidden layer, and ``grid`` holds its step sizes.
    """
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.storagelevel import StorageLevel

    names = features.select(F.col(label).alias("__name")).distinct().orderBy("__name")
    ids = features.sparkSession.createDataFrame([(r[0], float(k)) for k, r in enumerate(names.collect())], names.schema.add("__label", "double"))  # labels are few
    rows = features.join(F.broadcast(ids), F.col(label).eqNullSafe(F.col("__name")))
    data = rows.select(F.col("__label").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(fold).alias("fold")).persist(StorageLevel.DISK_ONLY)
    folds = [r[0] for r in data.select("fold").distinct().orderBy("fold").collect()]
    classes, width = ids.count(), data.first().features.size if folds else 0

    def accuracy(train: DataFrame, test: DataFrame, reg: float) -> float:
        if hidden:
            learner = MultilayerPerceptronClassifier(layers=[width, hidden, classes], stepSize=reg or 0.03, maxIter=60, seed=1)
        else:
            learner = LogisticRegression(regParam=reg, maxIter=30)
        right = learner.fit(train).transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")))
        return 100 * (right.first()[0] or 0.0)

    out = []
    for f in folds:
        rest, inner = data.where(F.col("fold") != f), [g for g in folds if g != f]
        mean = lambda reg: sum(accuracy(rest.where(F.col("fold") != g), rest.where(F.col("fold") == g), reg) for g in inner) / len(inner)  # noqa: B023, E731
        best = max(grid, key=mean) if len(grid) > 1 else grid[0]
        out.append((f, float(best), round(accuracy(rest, data.where(F.col("fold") == f), best), 2)))
    schema = data.select("fold").schema.add("reg", "double").add("accuracy", "double")
    data.unpersist()
    return features.sparkSession.createDataFrame(out, schema)
