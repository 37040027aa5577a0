"""Baselines, metrics, gates and the life of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_rows(clean: DataFrame) -> DataFrame:
    """One row per reading: what a delay is foretold from, and the delay."""
    return clean.select("id", "train_id", "station_code", "service_day", "direction", F.hour("local_ts").alias("hour"), F.weekday("service_day").alias("weekday"), F.col("delay_minutes").alias("label"))


def refuse_short_span(rows: DataFrame, test_days: int = 7, valid_days: int = 7) -> None:
    """Fails where the days of ``rows`` leave none to train on beside those held out."""
    days = rows.agg(F.datediff(F.max("service_day"), F.min("service_day")).alias("n")).first()["n"]
    if days is None:
        raise ValueError("no usable readings to train on")
    if days + 1 <= test_days + valid_days:
        raise ValueError(f"only {days + 1} days of data: more than {test_days + valid_days} are needed to hold out validation and test")


def refuse_synthetic(obs: DataFrame) -> None:
    """Fails where a synthetic reading is among ``obs``: a model for real trains learns from real readings only."""
    if obs.filter("source = 'synthetic'").limit(1).count():
        raise ValueError("synthetic readings are among these")


def time_split(rows: DataFrame, test_days: int = 7, valid_days: int = 7) -> DataFrame:
    """The last days test, those before validate, the rest train. ``refuse_short_span`` tells whether there is a rest."""
    last = rows.agg(F.max("service_day").alias("last_day"))
    age = F.datediff("last_day", "service_day")
    return rows.crossJoin(F.broadcast(last)).withColumn("split", F.when(age < test_days, "test").when(age < test_days + valid_days, "valid").otherwise("train")).drop("last_day")


def fit_baselines(train: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = lambda *keys: train.groupBy(*keys).agg(F.median("label").alias("median"))
    return m(), m("train_id", "station_code"), m("hour", "weekday", "direction")


def predict_baselines(rows: DataFrame, tables: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """Three forecasts per row; a missing cell falls back to the next coarser one."""
    overall, place, clock = tables
    out = rows.crossJoin(F.broadcast(overall.withColumnRenamed("median", "m0"))).join(place.withColumnRenamed("median", "m1"), ["train_id", "station_code"], "left").join(clock.withColumnRenamed("median", "m2"), ["hour", "weekday", "direction"], "left")
    return out.select("id", "direction", "label", F.lit(0.0).alias("zero"), F.coalesce("m1", "m2", "m0").alias("train_station"), F.coalesce("m2", "m0").alias("hour_weekday"))


def evaluate(predictions: DataFrame, columns: tuple[str, ...] = ("zero", "train_station", "hour_weekday")) -> DataFrame:
    """Error of each forecast, overall and by direction; shares use forecasts in whole minutes."""
    long = predictions.select("direction", "label", F.explode(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).alias("p")) for c in columns])).alias("x")).select("direction", "label", "x.*")
    off = F.abs(F.col("label") - F.bround("p", 0))
    pin = lambda q: F.avg(F.when(F.col("label") >= F.col("p"), q * (F.col("label") - F.col("p"))).otherwise((1 - q) * (F.col("p") - F.col("label"))))
    return long.groupingSets([["model"], ["model", "direction"]], "model", "direction").agg(F.count("*").alias("rows"), F.avg(F.abs(F.col("label") - F.col("p"))).alias("mae"), F.avg((off <= 2).cast("double")).alias("within_2"), F.avg((off <= 5).cast("double")).alias("within_5"), pin(0.1).alias("pinball_10"), pin(0.9).alias("pinball_90"))


def range_metrics(predictions: DataFrame) -> DataFrame:
    """Coverage, misses and width of forecasts with ``low`` and ``high``."""
    y, lo, hi = F.col("label"), F.col("low"), F.col("high")
    return predictions.agg(F.count("*").alias("rows"), F.avg(y.between(lo, hi).cast("double")).alias("coverage"), F.avg((y < lo).cast("double")).alias("below"), F.avg((y > hi).cast("double")).alias("above"), F.avg(hi - lo).alias("width"))


def readiness_gates(clean: DataFrame, days: int = 28, usable: int = 5000, station: int = 300, test: int = 500, test_days: int = 7) -> DataFrame:
    """Whether there is data enough to train: one row per gate."""
    real = clean.filter("source <> 'synthetic'")
    best = real.groupBy("station_code").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("station"))
    split = time_split(real.select("id", "service_day"), test_days).agg(F.count_if(F.col("split") == "test").alias("test"))
    have = real.agg(F.countDistinct("service_day").alias("days"), F.count("*").alias("usable")).crossJoin(best).crossJoin(split)
    return have.select(F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).cast("long").alias("have"), F.lit(v).cast("long").alias("need")) for k, v in (("days", days), ("usable", usable), ("station", station), ("test", test))])).alias("g")).select("g.*", (F.col("g.have") >= F.col("g.need")).alias("passed"))


def readiness_counts(clean: DataFrame, station: int = 300) -> DataFrame:
    """Usable real readings by station and by source: grain, value, readings, and for stations whether a model covers them."""
    real = clean.filter("source <> 'synthetic'")
    grain = F.when(F.grouping("station_code") == 0, "station").otherwise("source")
    out = real.groupingSets([["station_code"], ["source"]], "station_code", "source").agg(grain.alias("grain"), F.count("*").alias("readings"))
    return out.select("grain", F.coalesce("station_code", "source").alias("value"), "readings", F.when(F.col("grain") == "station", F.col("readings") >= station).alias("covered"))


def promotion_decision(metrics: DataFrame, model: str, coverage: float, low: float = 0.7, high: float = 0.9) -> DataFrame:
    """Promote a model that beats the best other forecast and whose range holds about as often as it should."""
    overall = metrics.filter("direction IS NULL")
    own = overall.filter(F.col("model") == model).select(F.col("mae").alias("model_mae"))
    best = overall.filter(F.col("model") != model).agg(F.min(F.struct("mae", "model")).alias("b")).select(F.col("b.model").alias("best_baseline"), F.col("b.mae").alias("baseline_mae"))
    reason = F.when(F.col("model_mae") >= F.col("baseline_mae"), "not better than the best baseline").when(~F.lit(coverage).between(low, high), "range coverage out of bounds").otherwise("promoted")
    return own.crossJoin(best).withColumn("reason", reason).withColumn("promote", F.col("reason") == "promoted")


def update_registry(registry: DataFrame, entry: DataFrame) -> DataFrame:
    """The registry with a new version; a promoted one supersedes the one promoted before."""
    old = registry.crossJoin(F.broadcast(entry.agg(F.max(F.col("status") == "promoted").alias("new_"))))
    old = old.withColumn("status", F.when((F.col("status") == "promoted") & F.col("new_"), "superseded").otherwise(F.col("status"))).drop("new_")
    return old.join(entry.select("version"), "version", "left_anti").unionByName(entry)


def encode_categories(rows: DataFrame, train: DataFrame, columns: tuple[str, ...], most: int = 100_000) -> DataFrame:
    """Category codes by order of the training values; values it hasn't seen are -1. A column with more than ``most`` values is no category."""
    for c in columns:
        values = train.select(c).distinct()
        if values.limit(most + 1).count() > most:
            raise ValueError(f"{c} has more than {most} values")
        dim = values.withColumn(f"{c}_code", F.row_number().over(Window.orderBy(c)) - 1)
        rows = rows.join(dim, c, "left").withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1)))
    return rows


def evaluate_segments(predictions: DataFrame, model: str, segments: tuple[str, ...]) -> DataFrame:
    """Error of one forecast over all rows and within each value of each segment column, in one pass: segment, value, rows, mae, within_2, within_5, bias.

    Segments are columns such as station, direction, or whether a live reading
    of the run was known; a null value counts as a value of its own.
    """
    parts = [F.struct(F.lit("all").alias("segment"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("segment"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in segments]]
    long = predictions.select("label", F.col(model).alias("p"), F.explode(F.array(*parts)).alias("x"))
    off = F.abs(F.col("label") - F.bround("p", 0))
    return long.groupBy("x.segment", "x.value").agg(F.count("*").alias("rows"), F.avg(F.abs(F.col("label") - F.col("p"))).alias("mae"), F.avg((off <= 2).cast("double")).alias("within_2"), F.avg((off <= 5).cast("double")).alias("within_5"), F.avg(F.col("label") - F.col("p")).alias("bias"))


def train_delay_model(train: DataFrame, features: list[str], label: str = "label", iterations: int = 20, seed: int = 3):
    """Gradient-boosted trees with absolute loss, and the spread of residuals as the forecast's range: (model, low, high)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), GBTRegressor(labelCol=label, lossType="absolute", maxIter=iterations, maxDepth=4, seed=seed)]
    model = Pipeline(stages=stages).fit(train)
    spread = model.transform(train).agg(F.percentile(F.col(label) - F.col("prediction"), F.array(F.lit(0.1), F.lit(0.9))).alias("q")).first()["q"]
    return model, min(0.0, spread[0]), max(0.0, spread[1])


def predict_delay(model, low: float, high: float, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("low", F.col("prediction") + low).withColumn("high", F.col("prediction") + high).drop("features")


def predict_targets(model, low: float, high: float, asked: DataFrame, features: DataFrame) -> DataFrame:
    """``asked(target_id, ...)`` with delay, low and high; nulls where the train doesn't serve the station, so that it has no features."""
    p = predict_delay(model, low, high, features).select(F.col("id").alias("target_id"), F.col("prediction").alias("delay"), "low", "high")
    return asked.join(p, "target_id", "left")


def ablate_features(train: DataFrame, test: DataFrame, features: list[str], extra: list[str], iterations: int = 20) -> DataFrame:
    """Test metrics of a model without and with the inputs ``extra``, trained on the same rows: one row each. One split is no finding."""
    out = None
    for name, used in (("without", features), ("with", [*features, *extra])):
        model, low, high = train_delay_model(train, used, iterations=iterations)
        p = predict_delay(model, low, high, test)
        errors = p.agg(F.avg(F.abs(F.col("label") - F.col("prediction"))).alias("mae"), F.avg((F.abs(F.col("label") - F.bround("prediction", 0)) <= 2).cast("double")).alias("within_2"))
        row = range_metrics(p).crossJoin(errors).select(F.lit(name).alias("inputs"), "rows", "mae", "within_2", "coverage", "width")
        out = row if out is None else out.unionByName(row)
    return out


def residual_ranges(model, train: DataFrame, by: list[str], label: str = "label", few: int = 30) -> DataFrame:
    """Spread of a model's residuals within each value of ``by`` (live or cold, station, ...): ``by``, low, high.

    A value with fewer than ``few`` rows takes the spread of all rows, which is
    also there once with all of ``by`` null, for values not seen.
    """
    rest = model.transform(train).withColumn("rest_", F.col(label) - F.col("prediction"))
    q = F.percentile("rest_", F.array(F.lit(0.1), F.lit(0.9)))
    all_ = rest.agg(q.alias("all_"))
    own = rest.groupBy(*by).agg(q.alias("own_"), F.count("*").alias("n_")).crossJoin(all_)
    use = F.when(F.col("n_") >= few, F.col("own_")).otherwise(F.col("all_"))
    ends = lambda x: (F.least(F.lit(0.0), x[0]).alias("low"), F.greatest(F.lit(0.0), x[1]).alias("high"))
    seen = own.filter(" AND ".join(f"{c} IS NOT NULL" for c in by)).select(*by, *ends(use))
    return seen.unionByName(all_.select(*[F.lit(None).cast(train.schema[c].dataType).alias(c) for c in by], *ends(F.col("all_"))))


def predict_ranges(model, ranges: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """Forecasts with the range of their own segment, or of all rows where theirs wasn't seen."""
    none = " AND ".join(f"{c} IS NULL" for c in by)
    every = ranges.filter(none).select(F.col("low").alias("low_"), F.col("high").alias("high_"))
    out = model.transform(rows).join(ranges.filter(f"NOT ({none})"), by, "left").crossJoin(every)
    return out.withColumn("low", F.col("prediction") + F.coalesce("low", "low_")).withColumn("high", F.col("prediction") + F.coalesce("high", "high_")).drop("features", "low_", "high_")
