"""Success prediction: calibrator training and scoring."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.grading import training_label
from ..functions.scores import clamp, clamp01, first_truthy

# Defaults of both calibrator forms.
DEFAULT_THRESHOLDS = {"dense_real_min_score": 0.67, "approx_surface_min_score": 0.46}
DEFAULT_COEFFICIENTS = {
    "bias_dense": -1.2, "w_readiness_dense": 2.7, "w_angular_dense": 1.1, "w_variety_dense": 0.8,
    "w_usable_dense": 1.2, "w_features_dense": 0.9, "w_images_dense": 0.9,
    "bias_surface": -0.8, "w_readiness_surface": 2.2, "w_angular_surface": 0.9, "w_variety_surface": 0.7,
    "w_usable_surface": 0.9, "w_features_surface": 0.8, "w_images_surface": 0.8,
}
FEATURES = ("readiness", "angular", "variety", "features", "usable", "images")
HEURISTIC = "heuristic_thresholds"
LOGISTIC = "sklearn_logreg"


def train_thresholds(history: DataFrame) -> DataFrame:
    """Midpoints between the class means of the readiness score, one row."""
    label = training_label(F.col("final_success_level"), F.col("quality_classification"))
    score = F.coalesce(F.col("mesh_readiness_score"), F.lit(0.0))

    def mean(name: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col("_label") == name, F.col("_score"))), F.lit(0.0))

    means = history.select(label.alias("_label"), score.alias("_score")).agg(
        F.count(F.lit(1)).alias("sample_count"),
        mean("sparse_only").alias("_sparse"), mean("approx_surface").alias("_surface"), mean("dense_real").alias("_dense"),
    )
    dense = F.when(F.col("_dense") > 0, (F.col("_surface") + F.col("_dense")) / 2).otherwise(0.67)
    surface = F.when(F.col("_surface") > 0, (F.col("_sparse") + F.col("_surface")) / 2).otherwise(0.46)
    return means.select(
        F.lit(HEURISTIC).alias("method"), "sample_count",
        F.round(clamp(surface, 0.25, 0.8), 6).alias("approx_surface_min_score"),
        F.round(clamp(dense, 0.45, 0.9), 6).alias("dense_real_min_score"),
    )


def _inputs(features_scale: float | None, images_scale: float | None) -> list[Column]:
    """Model inputs; the counts are either raw or on the scale used when scoring."""
    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    def scaled(name: str, scale: float | None) -> Column:
        return number(name) if scale is None else F.least(number(name) / scale, F.lit(1.2))

    return [
        number("mesh_readiness_score").alias("readiness"), number("angular_coverage_score").alias("angular"),
        number("visual_variety_score").alias("variety"),
        scaled("average_feature_points", features_scale).alias("features"),
        number("usable_images_ratio").alias("usable"), scaled("image_count", images_scale).alias("images"),
    ]


def train_calibrator(history: DataFrame, compat_raw: bool = False) -> DataFrame:
    """Two one-against-rest logistic models, or thresholds for a short history.

    The models see the counts on the scale that scoring uses; ``compat_raw``
    trains on the raw counts instead. One row comes back, always small.
    """
    label = training_label(F.col("final_success_level"), F.col("quality_classification"))
    sizes = history.select(label.alias("_l")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_l") == "dense_real").alias("dense"),
        F.count_if(F.col("_l") == "approx_surface").alias("surface"),
    ).first()
    n = sizes["n"]
    if n < 35 or sizes["dense"] in (0, n) or sizes["surface"] in (0, n):
        return train_thresholds(history)

    weights: dict[str, float] = {}
    for target, value, f_scale, i_scale in (
        ("dense", "dense_real", 200.0, 60.0), ("surface", "approx_surface", 180.0, 50.0),
    ):
        scales = (None, None) if compat_raw else (f_scale, i_scale)
        rows = history.select(*_inputs(*scales), (label == value).cast("double").alias("y"))
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows).select("x", "y")
        model = LogisticRegression(
            featuresCol="x", labelCol="y", maxIter=500, regParam=1.0 / n, standardization=False, tol=1e-6,
        ).fit(vectors)
        weights[f"bias_{target}"] = float(model.intercept)
        for name, w in zip(FEATURES, model.coefficients.toArray()):
            weights[f"w_{name}_{target}"] = float(w)
    return history.sparkSession.range(1).select(
        F.lit(LOGISTIC).alias("method"), F.lit(n).cast("bigint").alias("sample_count"),
        *[F.lit(weights[k]).alias(k) for k in DEFAULT_COEFFICIENTS],
    )


def predict_success(datasets: DataFrame, calibrator: DataFrame | Row | None = None) -> DataFrame:
    """Probabilities of the three outcomes, the likeliest, a profile and a run flag.

    ``calibrator`` is the one-row table that training returns, or its row.
    """
    own = list(datasets.columns)
    row = calibrator.first() if isinstance(calibrator, DataFrame) else calibrator
    document = {**DEFAULT_THRESHOLDS, **DEFAULT_COEFFICIENTS, "method": HEURISTIC}
    document.update({k: v for k, v in (row.asDict() if row else {}).items() if v is not None})
    df = datasets

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    def cal(name: str) -> Column:
        return F.lit(document[name])

    readiness, angular = number("mesh_readiness_score"), number("angular_coverage_score")
    variety, features = number("visual_variety_score"), number("average_feature_points")
    usable = number("usable_images_ratio")
    images = first_truthy(F.col("image_count_valid"), F.col("image_count_total"), default=0).cast("double")

    def logistic(target: str, f_scale: float, i_scale: float) -> Column:
        z = (
            cal(f"bias_{target}") + readiness * cal(f"w_readiness_{target}") + angular * cal(f"w_angular_{target}")
            + variety * cal(f"w_variety_{target}") + usable * cal(f"w_usable_{target}")
            + F.least(features / f_scale, F.lit(1.2)) * cal(f"w_features_{target}")
            + F.least(images / i_scale, F.lit(1.2)) * cal(f"w_images_{target}")
        )
        return 1.0 / (1.0 + F.pow(F.lit(2.718281828), -z))

    learned = F.lit(document["method"] == LOGISTIC)
    dense_rule = clamp01((readiness - cal("dense_real_min_score") + 0.22) * 1.3 + angular * 0.15 + usable * 0.15)
    surface_rule = clamp01((readiness - cal("approx_surface_min_score") + 0.28) * 1.2 + variety * 0.12
                           + F.least(features / 220.0, F.lit(1.0)) * 0.12)
    df = df.withColumn("_dense", F.when(learned, logistic("dense", 200.0, 60.0)).otherwise(dense_rule))
    dense = F.col("_dense")
    df = df.withColumn("_surface", F.when(
        learned, clamp01(logistic("surface", 180.0, 50.0) * (1.0 - dense * 0.6))
    ).otherwise(F.when(dense > 0.45, surface_rule * 0.75).otherwise(surface_rule)))
    surface = F.col("_surface")
    df = df.withColumn("_sparse", F.when(learned, clamp01(1.0 - dense - surface)).otherwise(
        clamp01(1.0 - F.greatest(dense, surface) * 0.75)))
    total = F.greatest(F.lit(1e-9), dense + surface + F.col("_sparse"))
    df = df.withColumns({
        "prob_sparse": F.round(F.col("_sparse") / total, 6),
        "prob_approx_surface": F.round(surface / total, 6),
        "prob_dense_real": F.round(dense / total, 6),
    })
    s, a, d = F.col("prob_sparse"), F.col("prob_approx_surface"), F.col("prob_dense_real")
    return df.select(
        *own, "prob_sparse", "prob_approx_surface", "prob_dense_real",
        F.when((s >= a) & (s >= d), "sparse").when(a >= d, "approx_surface").otherwise("dense_real")
        .alias("predicted_success_level"),
        F.when((d >= 0.3) | (a >= 0.45), "quality").otherwise("balanced").alias("recommended_profile"),
        ((d >= 0.2) | (a >= 0.35) | (s >= 0.5)).alias("should_run"),
    )
