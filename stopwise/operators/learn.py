"""Spark ML models of the change of delay, and the frozen scorer."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopwise.sources.shared import stored

#: Penalties tried, as multiples of a row's weight.
PENALTIES = (0.1, 1.0, 10.0, 100.0, 1000.0, 10_000.0, 100_000.0)


def flagged(df: DataFrame, numbers: list[str]) -> DataFrame:
    """Numbers as doubles, and a 0/1 column for each that is missing."""
    kept = [F.col(c).cast("double").alias(c) if c in numbers else F.col(c) for c in df.columns]
    return df.select(*kept, *[F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in numbers])


def common_names(df: DataFrame, names: list[str], least: int = 100) -> dict[str, list[str]]:
    """Of each category the values with ``least`` rows or more; all others count as one."""
    counts = df.select(*[F.col(c).cast("string").alias(c) for c in names]).unpivot([], names, "name", "value").groupBy("name", "value").count()
    kept = counts.where((F.col("count") >= least) & F.col("value").isNotNull()).orderBy("name", "value").collect()
    return {c: [r["value"] for r in kept if r["name"] == c] for c in names}


def folded(df: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """Rare values of each category as ``infrequent``; null stays null, which the models take as unknown."""
    return df.withColumns({c: F.when(F.col(c).cast("string").isin(v), F.col(c).cast("string")).when(F.col(c).isNotNull(), "infrequent") for c, v in common.items()})


def number_stats(df: DataFrame, numbers: list[str]) -> DataFrame:
    """``(name, median, std)`` of each number over the rows where it is known; a deviation of 0 counts as 1."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in numbers]).unpivot([], numbers, "name", "v")
    std = F.stddev_pop("v")
    return long.groupBy("name").agg(F.median("v").alias("median"), F.when(std > 0, std).otherwise(1.0).alias("std"))


def category_codes(df: DataFrame, names: list[str]) -> DataFrame:
    """``(name, value, code)``: the values of each category numbered from 1 by their order; 0 is left for unknown ones."""
    values = df.select(*[F.col(c).cast("string").alias(c) for c in names]).unpivot([], names, "name", "value").where("value is not null").distinct()
    return values.withColumn("code", F.dense_rank().over(Window.partitionBy("name").orderBy("value")))


def coded(df: DataFrame, stats: DataFrame, codes: DataFrame, numbers: list[str], names: list[str], clip: float = 10.0) -> DataFrame:
    """Numbers as clipped distances from the median in deviations, 0 where missing, and categories as codes. Both tables have a row a feature or value."""
    s = {r["name"]: (r["median"], r["std"]) for r in stats.collect()}
    maps = {r["name"]: r["m"] for r in codes.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("value", "code"))).alias("m")).collect()}
    z = {c: F.coalesce(F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(c) - s[c][0]) / s[c][1])), F.lit(0.0)) if c in s and s[c][0] is not None else F.lit(0.0) for c in numbers}
    n = {c: F.coalesce(F.create_map(*[F.lit(x) for kv in maps.get(c, {"": 0}).items() for x in kv])[F.col(c).cast("string")], F.lit(0)) for c in names}
    return df.withColumns(z | n)


def preparation(numbers: list[str], names: list[str], scale: bool) -> list:
    """Stages: medians for missing numbers with flags, categories indexed with unknowns kept, scaled and one-hot for linear models."""
    filled, flags = [f"{c}_filled" for c in numbers], [f"{c}_missing" for c in numbers]
    stages = [Imputer(strategy="median", inputCols=numbers, outputCols=filled)]
    if names:
        stages.append(StringIndexer(inputCols=names, outputCols=[f"{c}_ix" for c in names], handleInvalid="keep", stringOrderType="alphabetAsc"))
    if not scale:
        return [*stages, VectorAssembler(inputCols=[*filled, *flags, *[f"{c}_ix" for c in names]], outputCol="features")]
    if names:
        stages.append(OneHotEncoder(inputCols=[f"{c}_ix" for c in names], outputCols=[f"{c}_hot" for c in names], handleInvalid="keep"))
    return [
        *stages, VectorAssembler(inputCols=filled, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), VectorAssembler(inputCols=["scaled", *flags, *[f"{c}_hot" for c in names]], outputCol="features"),
    ]


def mae(df: DataFrame, y: str) -> float:
    return df.agg(F.avg(F.abs(F.col(y) - F.col("prediction")))).first()[0]


def fit_ridge(train: DataFrame, tune: DataFrame, y: str, numbers: list[str], names: list[str], penalties: tuple[float, ...] = PENALTIES) -> tuple[PipelineModel, float]:
    """Ridge with the penalty of least error on the tuning rows, fitted again on both.

    The rows given are read once, into a stored table of what the model sees of them. The preparation is
    learned once for all penalties, and prepared rows are stored too, as each fit reads them twice;
    a single penalty is not tried.
    """
    seen = [y, *numbers, *names]
    both = train.select(*seen, F.lit(True).alias("_train")).unionByName(tune.select(*seen, F.lit(False).alias("_train")))
    both = stored(flagged(both, numbers), "ridge-rows")
    a, b = both.where("_train"), both.where("not _train")
    n = a.count()
    line, best = LinearRegression(labelCol=y, elasticNetParam=0.0), penalties[0]
    learned = lambda rows: Pipeline(stages=preparation(numbers, names, True)).fit(rows)
    if len(penalties) > 1:
        ready = learned(a)
        tried, told = stored(ready.transform(a).select(y, "features"), "ridge-vectors"), ready.transform(b).select(y, "features")
        for i, p in enumerate(penalties):
            told = line.copy({line.regParam: p / n, line.predictionCol: f"prediction_{i}"}).fit(tried).transform(told)
        errors = told.agg(*[F.avg(F.abs(F.col(y) - F.col(f"prediction_{i}"))) for i in range(len(penalties))]).first()
        best = min(zip(errors, penalties, strict=True), key=lambda e: e[0])[1]
    ready = learned(both)
    last = line.copy({line.regParam: best / n}).fit(stored(ready.transform(both).select(y, "features"), "ridge-vectors"))
    return PipelineModel([*ready.stages, last]), best


def fit_leaf_quantiles(train: DataFrame, y: str, numbers: list[str], names: list[str], depth: int = 5, least: int = 50) -> tuple[PipelineModel, DataFrame]:
    """A tree and the 10th and 90th percentile of each of its leaves; small leaves take those of all rows."""
    a = flagged(train, numbers)
    tree = DecisionTreeRegressor(labelCol=y, maxDepth=depth, minInstancesPerNode=least, leafCol="leaf", maxBins=64, seed=1)
    model = Pipeline(stages=[*preparation(numbers, names, False), tree]).fit(a)
    q = F.percentile(y, F.array(F.lit(0.1), F.lit(0.9)))
    leaves = model.transform(a).groupBy("leaf").agg(F.count("*").alias("n"), q.alias("q")).join(F.broadcast(a.agg(q.alias("all"))))
    use = F.when(F.col("n") >= least, F.col("q")).otherwise(F.col("all"))
    return model, leaves.select("leaf", F.get(use, F.lit(0)).alias("q10"), F.get(use, F.lit(1)).alias("q90"))


def bounded(df: DataFrame, offsets: DataFrame) -> DataFrame:
    """``df`` with p50, q10 and q90, and its calibrated bounds ``lo`` and ``hi``, which never cross the median."""
    x = df.join(F.broadcast(offsets.select("horizon_min", "offset")), "horizon_min", "left").withColumn("_o", F.coalesce("offset", F.lit(0.0)))
    return x.select(*df.columns, F.least(F.col("q10") - F.col("_o"), "p50").alias("lo"), F.greatest(F.col("q90") + F.col("_o"), "p50").alias("hi"))


def verify_reload(model: PipelineModel, path: str, df: DataFrame, numbers: list[str]) -> float:
    """Save, load, and the largest difference of predictions, of which each row gets both in one pass."""
    model.write().overwrite().save(path)
    x = flagged(df, numbers)
    before = model.transform(x).select(*x.columns, F.col("prediction").alias("_saved"))
    return PipelineModel.load(path).transform(before).agg(F.max(F.abs(F.col("_saved") - F.col("prediction")))).first()[0]


def predict_requests(requests: DataFrame, scored: DataFrame, needed: list[str], horizons: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """The batch contract: rows that may be scored joined with their predictions and the delay at the target, and rejected rows with the reason."""
    missing = sorted(set(needed) - set(requests.columns))
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    reason = F.when(~F.coalesce(F.col("horizon_min").isin(*horizons), F.lit(False)), "unknown horizon").when(F.col("d0_min").isNull(), "no delay")
    checked = requests.withColumn("reason", reason)
    keys = ["trip_key", "stop_seq", "horizon_min"]
    good = checked.where("reason is null").drop("reason").join(scored.select(*keys, "p50", "lo", "hi"), keys)
    return good.select(*keys, "p50", "lo", "hi", (F.col("d0_min") + F.col("p50")).alias("delay_at_target_min")), checked.where("reason is not null")


