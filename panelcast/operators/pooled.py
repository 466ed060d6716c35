"""Models pooled over all series with spark.ml: multi-horizon regression and a boosted imputer."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, functions as F

from panelcast.operators.features import group_folds, supervised
from panelcast.operators.impute import with_neighbors
from panelcast.operators.score import smape_loss
from panelcast.session import write_and_read
from panelcast.spec import PanelSpec


def horizon_rows(
    rows: DataFrame, spec: PanelSpec, windows: Sequence[int], median_shifts: int, lag_days: int, horizon: int
) -> DataFrame:
    """Training-set rows spread over the horizon: one row per step with the features of that step.

    Features: the last ``lag_days`` readings of the step's season, the medians of that season per
    shift and window, the last reading, the mean of the last day, the step and the indicators.
    ``x`` must be imputed; a remaining gap counts as 0.
    """
    season, steps = F.col("horizon") % spec.seasons, spec.seasons
    n_medians = len(windows) * median_shifts

    def at(array: str, index):
        return F.coalesce(F.get(F.col(array), index.cast("int")), F.lit(0.0))

    lags = [at("x", F.size("x") - steps * (k + 1) + season) for k in range(lag_days)]
    medians = [at("med", F.lit(k * steps) + season) for k in range(n_medians)]
    last_day = F.slice("x", F.size("x") - steps + 1, steps)
    mean = F.aggregate(last_day, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))) / steps
    flags = [F.col(f"is_{m}").cast("double") for m in spec.measures]
    if "is_group" in rows.columns:
        flags.append(F.col("is_group").cast("double"))
    features = F.array(*lags, *medians, at("x", F.size("x") - 1), mean, F.col("horizon").cast("double"), *flags)
    has_label = "y" in rows.columns
    spread = rows.withColumn("horizon", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    label = F.get("y", F.col("horizon")).alias("label") if has_label else F.lit(None).cast("double").alias("label")
    return spread.select(
        spec.station, "measure", "split_day", "horizon", label, array_to_vector(features).alias("features")
    )


def pooled_forecast(
    train: DataFrame, test: DataFrame, spec: PanelSpec, k: int = 5, estimator: Estimator | None = None
) -> tuple[DataFrame, DataFrame]:
    """Grouped-fold ensemble: one model per fold trained without its stations, predictions averaged.

    ``train`` and ``test`` come from ``horizon_rows``. Returns the forecasts (station, measure,
    split_day, horizon, value) and the folds' scores on their held-out stations.
    """
    estimator = estimator or LinearRegression(regParam=0.01)
    rows = write_and_read(train.where("label IS NOT NULL"), "rows")
    known = write_and_read(rows.join(group_folds(rows, spec.station, k), spec.station), "training")
    predictions, scores = [], []
    for fold in range(k):
        model = estimator.fit(known.where(F.col("fold") != fold))
        predictions.append(model.transform(test))
        held_out = model.transform(known.where(F.col("fold") == fold))
        score = smape_loss(F.col("label"), F.col("prediction")).alias("score")
        scores.append(held_out.agg(score).withColumn("fold", F.lit(fold)))
    keys = [spec.station, "measure", "split_day", "horizon"]
    return ensemble(predictions, keys, ["prediction"]).withColumnRenamed("prediction", "value"), reduce(DataFrame.unionByName, scores)


def ensemble(forecasts: Sequence[DataFrame], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean of the folds' forecasts per key; a fold without a value for a key has no say there."""
    every = reduce(DataFrame.unionByName, [f.select(*keys, *values) for f in forecasts])
    return every.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def fold_spread(scores: DataFrame) -> DataFrame:
    """One row from the folds' scores: mean, population deviation and least."""
    return scores.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("least"))


def pooled_panel_forecast(
    df: DataFrame,
    spec: PanelSpec,
    split,
    train_splits: Sequence,
    history_days: int,
    windows: Sequence[int],
    median_shifts: int = 2,
    lag_days: int = 3,
    k: int = 5,
    estimator: Estimator | None = None,
    exclude: Sequence[str] = (),
    horizon: int = 48,
) -> tuple[DataFrame, DataFrame]:
    """From an imputed panel to the pooled forecast of ``split``.

    ``exclude`` names stations left out of training; they are still forecast. The panel and the
    test rows are stored once, as training set, test set and every fold read them again.
    """
    df = write_and_read(df.select(*spec.columns), "panel")
    source = df.where(~F.col(spec.station).isin(list(exclude))) if exclude else df
    shape = (spec, windows, median_shifts, lag_days, horizon)
    train = supervised(source, spec, train_splits, history_days, windows, median_shifts, horizon=horizon)
    test = supervised(df, spec, [split], history_days, windows, median_shifts, horizon=horizon, labels=False)
    test = write_and_read(horizon_rows(test, *shape), "test")
    return pooled_forecast(horizon_rows(train, *shape), test, spec, k, estimator)


def neighbor_features(df: DataFrame, spec: PanelSpec, measure: str, within: Sequence[str] = ()) -> DataFrame:
    """What is known of a cell from around it: others' mean, how many miss, own mean, season.

    Cells without any reporting neighbour get the own mean and a flag, as vectors hold no gaps.
    """
    viewed = with_neighbors(df, spec, within)
    own = df.groupBy(spec.station).agg(F.coalesce(F.avg(measure), F.lit(0.0)).alias("own_mean"))
    others, lonely = F.col(f"{measure}_others"), F.col(f"{measure}_others").isNull()
    columns = {
        "others": F.coalesce(others, F.col("own_mean")),
        "lonely": lonely.cast("double"),
        "missing": F.col(f"{measure}_missing") / F.col(f"{measure}_stations"),
        "season": spec.season().cast("double"),
    }
    return viewed.join(own, spec.station).withColumns(columns)


NEIGHBOR_FEATURES = ["others", "lonely", "missing", "own_mean", "season"]


def fit_neighbor_trees(
    df: DataFrame,
    spec: PanelSpec,
    within: Sequence[str] = (),
    grid: Sequence[dict] | None = None,
    folds: int = 5,
    parallelism: int = 2,
    **trees,
) -> dict:
    """One boosted model per measure, pooled over its stations.

    ``grid`` is a list of parameter maps (``GBTRegressor`` parameters by name); with more than one,
    cross-validation picks the one of least mean absolute error and refits it.
    """
    assembler = VectorAssembler(inputCols=NEIGHBOR_FEATURES, outputCol="features")
    models = {}
    for m in spec.measures:
        gbt = GBTRegressor(labelCol=m, seed=0, **trees)
        pipeline = Pipeline(stages=[assembler, gbt])
        known = neighbor_features(df, spec, m, within).where(F.col(m).isNotNull())
        known = write_and_read(known.select(m, *NEIGHBOR_FEATURES), "neighbors")
        if grid and len(grid) > 1:
            maps = [{gbt.getParam(name): value for name, value in g.items()} for g in grid]
            search = CrossValidator(
                estimator=pipeline,
                estimatorParamMaps=maps,
                evaluator=RegressionEvaluator(labelCol=m, metricName="mae"),
                numFolds=folds,
                parallelism=parallelism,
                seed=0,
            )
            models[m] = search.fit(known).bestModel
        else:
            chosen = {gbt.getParam(name): value for name, value in (grid or [{}])[0].items()}
            models[m] = pipeline.fit(known, chosen)
    return models


def fill_from_trees(
    df: DataFrame, spec: PanelSpec, models: dict, max_missing: float, within: Sequence[str] = ()
) -> DataFrame:
    """Fill gated missing cells by the boosted models; values used are those before imputation."""
    filled = df
    for m, model in models.items():
        viewed = neighbor_features(df, spec, m, within)
        gaps = viewed.where(
            F.col(m).isNull() & spec.reports(m)
            & (F.col(f"{m}_missing") < (F.col(f"{m}_stations") * max_missing if max_missing < 1 else F.lit(max_missing)))
        )
        guesses = model.transform(gaps).select(*spec.keys, F.col("prediction").alias("_guess"))
        filled = (
            filled.join(guesses, spec.keys, "left").withColumn(m, F.coalesce(F.col(m), F.col("_guess"))).drop("_guess")
        )
    return filled.select(*df.columns)


def save_models(models: dict, path: str) -> None:
    """Store one model per measure under ``path``."""
    for measure, model in models.items():
        model.write().overwrite().save(f"{path}/{measure}")


def load_models(path: str, spec: PanelSpec) -> dict:
    return {m: PipelineModel.load(f"{path}/{m}") for m in spec.measures}
