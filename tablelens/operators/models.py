"""Models on tables: target choice, preprocessing, tournaments, scoring, storage.

Preprocessing statistics come from exact aggregates and are written into one
SQL projection, so a stored model scores any table in a single JVM pass.
"""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import IndexToString, OneHotEncoder, OneHotEncoderModel, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tablelens.functions.semantics import col, half_up
from tablelens.operators.features import label_codes, most_frequent
from tablelens.operators.foldtrees import GrownTrees, blocks_of, boosting_scores, fit_boosted, fit_forest, forest_scores
from tablelens.operators.profile import Profile
from tablelens.operators.ranks import at_or_after, exact_quantiles, order_cutoffs, text_keys
from tablelens.session import durable, scratch_path

# Limits of target choice and preprocessing.
NEAR_UNIQUE = 0.95
MAX_NULL_PCT = 50.0
ONE_HOT_VALUES = 20
SEED = 42
# Rows of one label that are numbered together.
SLICE = 100_000
# Rows of all folds that are trained side by side: a forest holds some 1 kB a row (draws and nodes of 100 trees).
SIDE_ROWS = 6_000_000
# Above so many rows the trees of all folds grow in shared passes.
SHARED_ROWS = 100_000


class BadTarget(ValueError):
    """The column cannot be predicted."""


def target_candidates(p: Profile, n: int = 3) -> list[dict]:
    """Columns worth predicting, best first."""
    out = []
    for name, f in p.facts.items():
        if f.ratio > NEAR_UNIQUE or f.null_pct > MAX_NULL_PCT:
            continue
        kind, score = p.categories[name], 0.0
        if p.primary["metric"] == name:
            score += 0.5
        if kind == "numeric" and f.filled:
            variation = abs((f.measures["std"] or 0.0) / (f.measures["mean"] + 1e-6))
            score += min(0.3 * variation, 0.4) + 0.3 if variation > 0.01 else 0.0
        elif kind in ("categorical", "boolean"):
            score += 0.6 if 2 <= f.cardinality <= 20 else 0.2 if f.cardinality > 20 else 0.0
        if score > 0:
            out.append(
                {
                    "column": name,
                    "score": half_up(score, 3),
                    "dtype_category": kind,
                    "role": p.roles[name],
                    "cardinality": f.cardinality,
                }
            )
    return sorted(out, key=lambda c: -c["score"])[:n]


def task_type(p: Profile, target: str, requested: str = "auto") -> str:
    """forecasting, classification or regression; raises for constant or empty targets."""
    if requested not in ("auto", "auto_detect"):
        return requested
    f = p.facts[target]
    values = f.cardinality - (1 if f.nulls else 0)
    if f.filled == 0 or f.nulls / f.rows > NEAR_UNIQUE:
        raise BadTarget(f"{target}: more than 95% missing")
    if values <= 1:
        raise BadTarget(f"{target}: all values are identical")
    kind = p.categories[target]
    timed = any(n != target and (p.roles[n] == "temporal" or p.categories[n] == "datetime") for n in p.facts)
    if timed and kind == "numeric":
        return "forecasting"
    if kind in ("categorical", "boolean") or (kind == "numeric" and values <= 10 and values / f.rows < 0.05):
        return "classification"
    return "regression" if kind == "numeric" else "classification"


@dataclass
class Features:
    """Columns by treatment."""

    numbers: list[str]
    one_hot: list[str]
    coded: list[str]
    dates: list[str]

    @property
    def names(self) -> list[str]:
        return [*self.numbers, *self.one_hot, *self.coded, *self.dates]


def choose_features(p: Profile, target: str | None) -> Features:
    out = Features([], [], [], [])
    for name, f in p.facts.items():
        if name == target or f.ratio > NEAR_UNIQUE or f.null_pct > MAX_NULL_PCT:
            continue
        kind = p.categories[name]
        if kind == "datetime" or p.roles[name] == "temporal":
            out.dates.append(name)
        elif kind in ("categorical", "boolean", "text"):
            (out.one_hot if f.cardinality <= ONE_HOT_VALUES else out.coded).append(name)
        elif kind == "numeric":
            out.numbers.append(name)
    return out


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


class CodeTable(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the code of a label from a stored (label, code) table; labels it lacks get -1."""

    table = Param(Params._dummy(), "table", "folder of the (label, code) table", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, table=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        codes = dataset.sparkSession.read.parquet(self.getOrDefault(self.table))
        lookup = codes.select(F.col("label").alias("__code_label"), F.col("code").cast("double").alias("__code"))
        met = dataset.join(lookup, col(self.getInputCol()) == F.col("__code_label"), "left")
        return met.withColumn(self.getOutputCol(), F.coalesce("__code", F.lit(-1.0))).drop("__code_label", "__code")


class CodeIndexer(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Numbers the distinct labels of a column in sorted order and stores them; none pass the driver."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CodeTable:
        path = scratch_path(dataset.sparkSession, "codes")
        label_codes(dataset, self.getInputCol()).write.parquet(path)
        return CodeTable(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), table=path)


def slot_sources(fitted: PipelineModel, inputs: list[tuple[str, str]]) -> list[str]:
    """The source column of every slot of the features vector."""
    sizes = {}
    for stage in fitted.stages:
        if isinstance(stage, OneHotEncoderModel):
            sizes |= dict(zip(stage.getOutputCols(), stage.categorySizes))
    return [source for name, source in inputs for _ in range(sizes.get(name, 1))]


def build_preprocessor(p: Profile, features: Features) -> tuple[Pipeline, list[tuple[str, str]]]:
    """Pipeline to a ``features`` vector, and (input, source column) of each assembled input.

    Numbers: median and standard scaling.  Up to 20 values: most frequent value
    and one-hot.  Above: sorted code from a table that is joined on, unknown -1.
    Dates: date parts.
    """
    df, rows = p.df, p.rows
    medians = exact_quantiles(df, {c: [0.5] for c in features.numbers}, rows)
    exprs: list[str] = []
    inputs: list[tuple[str, str]] = []  # (vector input, source column)
    numbers = [c for c in features.numbers if medians[c][0] is not None]
    if numbers:
        filled = {c: F.coalesce(col(c).cast("double"), F.lit(float(medians[c][0]))) for c in numbers}
        stats = df.agg(*[e for i, c in enumerate(numbers) for e in (F.avg(filled[c]).alias(f"m{i}"), F.stddev_pop(filled[c]).alias(f"s{i}"))]).first()
        for i, c in enumerate(numbers):
            mean, std = stats[f"m{i}"], stats[f"s{i}"] or 1.0
            exprs.append(f"(coalesce(CAST({_name(c)} AS DOUBLE), {float(medians[c][0])!r}D) - {mean!r}D) / {std!r}D AS {_name('num__' + c)}")
            inputs.append((f"num__{c}", c))
    modes = most_frequent(df, features.one_hot + features.coded)
    stages: list = []
    hot, coded = features.one_hot, features.coded
    for c in hot + coded:
        exprs.append(f"coalesce(CAST({_name(c)} AS STRING), {_text(modes.get(c, ''))}) AS {_name('txt__' + c)}")
    for c in features.dates:
        dtype = df.schema[c].dataType
        moment = f"CAST({_name(c)} AS DATE)" if not isinstance(dtype, T.StringType) else f"CAST(try_to_timestamp({_name(c)}) AS DATE)"
        parts = {
            "year": f"coalesce(year({moment}), 2000)",
            "month": f"coalesce(month({moment}), 1)",
            "day": f"coalesce(day({moment}), 1)",
            "dayofweek": f"coalesce(weekday({moment}), 0)",
            "is_weekend": f"coalesce(CAST(weekday({moment}) >= 5 AS INT), 0)",
        }
        for k, e in parts.items():
            exprs.append(f"CAST({e} AS DOUBLE) AS {_name(f'date__{c}_{k}')}")
            inputs.append((f"date__{c}_{k}", c))
    stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(exprs) + " FROM __THIS__" if exprs else "SELECT * FROM __THIS__"))
    if hot:  # at most ONE_HOT_VALUES labels a column
        stages.append(
            StringIndexer(
                inputCols=[f"txt__{c}" for c in hot],
                outputCols=[f"idx__{c}" for c in hot],
                stringOrderType="alphabetAsc",
                handleInvalid="keep",
            )
        )
        stages.append(OneHotEncoder(inputCols=[f"idx__{c}" for c in hot], outputCols=[f"hot__{c}" for c in hot], dropLast=True, handleInvalid="keep"))
        inputs += [(f"hot__{c}", c) for c in hot]
    for c in coded:
        stages.append(CodeIndexer(inputCol=f"txt__{c}", outputCol=f"code__{c}"))
        inputs.append((f"code__{c}", c))
    stages.append(VectorAssembler(inputCols=[i for i, _ in inputs], outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages), inputs


def fold_of(df: DataFrame, folds: int) -> Column:
    """Fold number by a hash of the row: the same on every run and partitioning."""
    return F.pmod(_row_hash(df), F.lit(folds)).cast("int")


def _row_hash(df: DataFrame, seed: int = SEED) -> Column:
    return F.xxhash64(F.lit(seed), *[col(c) for c in df.columns])


def stratified(rows: DataFrame, label: str, row_hash: str, folds: int, count: int) -> DataFrame:
    """``rows`` with a ``fold``: the distinct rows of every label are dealt out in turn, in hash order.

    Labels are cut into hash ranges of about SLICE rows, which are numbered
    apart and then shifted by what lies before them, so a label with a third
    of all rows is no window of its own.  Equal rows share a fold.
    """
    pieces = max(1, -(-count // SLICE))
    cut = rows.withColumn("__piece", F.pmod(F.col(row_hash), F.lit(pieces)))
    sizes = cut.select(label, "__piece", row_hash).distinct().groupBy(label, "__piece").count()
    before = F.sum("count").over(Window.partitionBy(label).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(label, "__piece", F.coalesce(before, F.lit(0)).alias("__start"))
    place = F.dense_rank().over(Window.partitionBy(label, "__piece").orderBy(row_hash))
    numbered = cut.withColumn("__place", place).join(starts, [label, "__piece"])
    fold = F.pmod(F.col("__start") + F.col("__place") - 1, F.lit(folds)).cast("int")
    return numbered.withColumn("fold", fold).drop("__piece", "__place", "__start")


def prepare(p: Profile, target: str, folds: int, rows: DataFrame, by_class: bool = False) -> tuple[PipelineModel, DataFrame, list[str]]:
    """Fitted preprocessing and the (features, label, fold, draw) table, written once to the shared folder.

    ``rows`` are the table's rows with a target and their ``__label``; ``draw`` is a number from
    0 to 1 by another hash of the row.  ``by_class`` spreads every label evenly over the folds.
    """
    pipeline, inputs = build_preprocessor(p, choose_features(p, target))
    fitted = pipeline.fit(rows)
    draw = F.shiftrightunsigned(_row_hash(p.df, SEED + 1), 11).cast("double") / float(1 << 53)
    base = ["features", F.col("__label").alias("label"), draw.alias("draw")]
    if by_class:
        ready = fitted.transform(rows).select(*base, _row_hash(p.df).alias("__hash"))
        ready = stratified(ready, "label", "__hash", folds, p.rows).select("features", "label", "fold", "draw")
    else:
        ready = fitted.transform(rows).select(*base, fold_of(p.df, folds).alias("fold"))
    return fitted, durable(ready), slot_sources(fitted, inputs)


def regression_models(rows: int, trees: int, depth: int, boosts: int) -> dict:
    return {
        "LinearRegression": LinearRegression(solver="auto"),
        # The penalty of a sum of squares, restated for Spark's mean of squares.
        "Ridge": LinearRegression(regParam=1.0 / max(rows, 1), standardization=False, solver="auto"),
        # Each row keeps its node of every tree, so a level does not walk all trees from their roots again.
        "RandomForestRegressor": RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=SEED, cacheNodeIds=True),
        "GradientBoostingRegressor": GBTRegressor(maxIter=boosts, maxDepth=min(5, depth), seed=SEED),
    }


def classification_models(trees: int, depth: int) -> dict:
    return {
        "LogisticRegression": LogisticRegression(maxIter=1000),
        "RandomForestClassifier": RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, cacheNodeIds=True),
        "GaussianNB": NaiveBayes(modelType="gaussian"),
    }


def _improvement(best: float, baseline: float) -> float:
    return half_up((best - baseline) / max(abs(baseline), 1e-6) * 100, 2)


@dataclass
class Tournament:
    """Result of a model competition."""

    task: str
    target: str
    champion: str
    baseline: float
    best: float
    leaderboard: list[tuple]
    model: PipelineModel
    importances: list[tuple[str, float]]

    @property
    def improvement(self) -> float:
        return _improvement(self.best, self.baseline)

    def leaderboard_df(self, spark: SparkSession) -> DataFrame:
        rows = [(self.task, self.target, m, s, e, m == self.champion) for m, s, e in self.leaderboard]
        return spark.createDataFrame(rows, "task string, target string, model string, score double, second double, champion boolean")


def _folds(rows: int) -> int:
    return 5 if rows >= 200 else 3


def _cross_validate(ready: DataFrame, predict, evaluators) -> tuple[float, ...]:
    """Mean scores over the folds that hold rows; the folds are independent jobs and run side by side, fewer for large tables.

    Equal rows share a fold.  Where all rows are in one fold, it is scored with a model of itself.
    """
    counts = ready.groupBy("fold").count().collect()
    folds = sorted(r["fold"] for r in counts)
    together = min(len(folds), max(1, SIDE_ROWS // max(1, sum(r["count"] for r in counts))))

    def one(fold: int) -> list[float]:
        test = ready.filter(F.col("fold") == fold)
        train = ready.filter(F.col("fold") != fold) if len(folds) > 1 else test
        scored = predict(train, test)
        return [e.evaluate(scored) for e in evaluators]

    with ThreadPoolExecutor(max(1, together)) as pool:
        # One wrapper per fold: each carries its own copy of the session's job properties.
        jobs = [pool.submit(inheritable_thread_target(ready.sparkSession)(one), fold) for fold in folds]
        found = [j.result() for j in jobs]
    return tuple(sum(column) / len(folds) for column in zip(*found))


def regression_tournament(p: Profile, target: str, trees: int = 100, depth: int = 10, boosts: int = 100) -> Tournament:
    """Cross-validated R2 and RMSE; the best R2 is refitted on all rows."""
    k = _folds(p.rows)
    fitted, ready, sources = prepare(p, target, k, p.df.filter(col(target).isNotNull()).withColumn("__label", col(target).cast("double")))
    r2 = RegressionEvaluator(metricName="r2")
    rmse = RegressionEvaluator(metricName="rmse")

    def judge(predict) -> tuple[float, float]:
        return _cross_validate(ready, predict, (r2, rmse))

    def by_mean(train: DataFrame, test: DataFrame) -> DataFrame:
        return test.withColumn("prediction", F.lit(train.agg(F.avg("label")).first()[0]))

    base = judge(by_mean)
    board, models = [("Baseline", *base)], regression_models(p.rows, trees, depth, boosts)
    blocks = blocks_of(ready) if p.rows > SHARED_ROWS else None
    for name, model in models.items():
        if blocks and name == "RandomForestRegressor":
            board.append((name, *forest_scores(blocks, trees, depth)))
        elif blocks and name == "GradientBoostingRegressor":
            board.append((name, *boosting_scores(blocks, boosts, min(5, depth))))
        else:
            board.append((name, *judge(lambda train, test, m=model: m.fit(train).transform(test))))
    champion, best, _ = max(board[1:], key=lambda b: b[1])
    if blocks and champion == "RandomForestRegressor":
        final = fit_forest(blocks, trees, depth)
    elif blocks and champion == "GradientBoostingRegressor":
        final = fit_boosted(blocks, boosts, min(5, depth))
    else:
        final = models[champion].fit(ready)
    if blocks:
        blocks.rdd.unpersist()
    return Tournament("regression", target, champion, base[0], best, board, _joined(fitted, final), importances(final, sources))


def draw_classes(train: DataFrame, test: DataFrame) -> DataFrame:
    """Predict classes drawn with the frequencies of the training rows; one count per class is collected."""
    seen = train.groupBy("label").count().orderBy("label").collect()
    total, ends, so_far = sum(r["count"] for r in seen), [], 0
    for r in seen:
        so_far += r["count"]
        ends.append((so_far / total, r["label"]))
    passed = F.size(F.filter(F.lit([e for e, _ in ends[:-1]]).cast("array<double>"), lambda e: e <= F.col("draw")))
    return test.withColumn("prediction", F.element_at(F.lit([c for _, c in ends]), passed + 1))


def classification_tournament(p: Profile, target: str, trees: int = 100, depth: int = 10) -> Tournament:
    """Cross-validated weighted F1 and accuracy; the best F1 is refitted on all rows."""
    k = _folds(p.rows)
    labels = StringIndexer(inputCol="__target", outputCol="__label", stringOrderType="alphabetAsc")
    named = p.df.filter(col(target).isNotNull()).withColumn("__target", col(target).cast("string"))
    index = labels.fit(named.select("__target"))
    fitted, ready, sources = prepare(p, target, k, index.transform(named), by_class=True)
    f1 = MulticlassClassificationEvaluator(metricName="f1")
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy")

    def judge(predict) -> tuple[float, float]:
        return _cross_validate(ready, predict, (f1, accuracy))

    base = judge(draw_classes)
    board, models = [("Baseline", *base)], classification_models(trees, depth)
    for name, model in models.items():
        board.append((name, *judge(lambda train, test, m=model: m.fit(train).transform(test))))
    champion, best, _ = max(board[1:], key=lambda b: b[1])
    final = models[champion].fit(ready)
    return Tournament("classification", target, champion, base[0], best, board, _joined(fitted, final, IndexToString(inputCol="prediction", outputCol="predicted_class", labels=index.labels)), importances(final, sources))


def holdout_forecast(p: Profile, target: str, order_by: list[str]) -> Tournament:
    """First 80 % of the rows in order against the last 20 %: ridge and repeating the last value.

    Both are compared by RMSE, so the improvement compares like with like.
    """
    df = p.df.filter(col(target).isNotNull())
    rows = df.count()
    order_by = text_keys(df, order_by)
    split = int(rows * 0.8)
    edge, last = order_cutoffs(df, order_by, [split, split - 1], rows)
    pipeline, inputs = build_preprocessor(p, choose_features(p, target))
    fitted = pipeline.fit(df)
    late = at_or_after(df, order_by, edge)
    ready = durable(fitted.transform(df.withColumn("__late", late)).select("features", col(target).cast("double").alias("label"), "__late"))
    final_train = df.filter(at_or_after(df, order_by, last) & ~late).select(col(target).cast("double")).first()[0]
    model = LinearRegression(regParam=1.0 / max(split, 1), standardization=False, solver="auto")
    test = ready.filter("__late")
    scored = model.fit(ready.filter(~F.col("__late"))).transform(test)
    rmse = RegressionEvaluator(metricName="rmse")
    naive = rmse.evaluate(test.withColumn("prediction", F.lit(final_train)))
    ridge = rmse.evaluate(scored)
    r2 = RegressionEvaluator(metricName="r2").evaluate(scored)
    board = [("Naive Baseline", -naive, naive), ("Ridge Trend Forecaster", r2, ridge)]
    final = model.fit(ready)
    return Tournament("forecasting", target, "Ridge Trend Forecaster", -naive, -ridge, board, _joined(fitted, final), importances(final, slot_sources(fitted, inputs)))


def _joined(fitted: PipelineModel, *final) -> PipelineModel:
    return PipelineModel(stages=[*fitted.stages, *final])


def importances(model, sources: list[str], n: int = 10) -> list[tuple[str, float]]:
    """Importances or absolute coefficients summed per source column of the slots, shares of 1, top n."""
    if hasattr(model, "featureImportances"):
        weights = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        weights = abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(model, "coefficients"):
        weights = abs(model.coefficients.toArray())
    else:
        weights = [1.0] * len(sources)
    totals = dict.fromkeys(sources, 0.0)
    for source, weight in zip(sources, weights, strict=True):
        totals[source] += float(weight)
    whole = sum(totals.values())
    shares = [(s, half_up(v / whole, 4) if whole else 0.0) for s, v in totals.items()]
    return sorted(shares, key=lambda x: -x[1])[:n]


def train(p: Profile, order_by: list[str], task: str = "auto", target: str | None = None) -> Tournament:
    """The tournament that fits the table: best target candidate and inferred task unless given."""
    if target is None:
        found = target_candidates(p, 1)
        if not found:
            raise BadTarget("no column is worth predicting")
        target = found[0]["column"]
    task = task_type(p, target, task)
    if task == "forecasting":
        return holdout_forecast(p, target, order_by)
    if task == "classification":
        return classification_tournament(p, target)
    return regression_tournament(p, target)


# -- storage and scoring -----------------------------------------------------


def save_model(spark: SparkSession, t: Tournament, root: str, dataset: str, at: dt.datetime | None = None) -> str:
    """Write the fitted pipeline under a new version and append a line to the run history."""
    stamp = (at or dt.datetime.now(dt.timezone.utc)).strftime("%Y%m%dT%H%M%S%f")
    path = f"{root.rstrip('/')}/{dataset}/{t.task}/v={stamp}"
    stages = []
    for i, stage in enumerate(t.model.stages):
        if isinstance(stage, (CodeTable, GrownTrees)):  # the stored model owns its tables
            own = f"{path}-codes/{i}"
            spark.read.parquet(stage.getOrDefault("table")).write.parquet(own)
            stage = stage.copy({stage.table: own})
        stages.append(stage)
    PipelineModel(stages=stages).write().save(path)
    line = [(dataset, t.task, stamp, t.target, t.champion, t.baseline, t.best, t.improvement, path)]
    schema = "dataset string, task string, version string, target string, champion string, baseline double, best double, improvement double, path string"
    spark.createDataFrame(line, schema).coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/history")
    return path


def run_history(spark: SparkSession, root: str, dataset: str | None = None, task: str | None = None) -> DataFrame:
    runs = spark.read.parquet(f"{root.rstrip('/')}/history")
    if dataset is not None:
        runs = runs.filter(F.col("dataset") == dataset)
    if task is not None:
        runs = runs.filter(F.col("task") == task)
    return runs.orderBy("version")


def batch_score(model: PipelineModel, df: DataFrame, task: str, needed: list[str]) -> DataFrame:
    """Predictions (class names for classes) for a whole table; feature columns it lacks count as null."""
    missing = [c for c in needed if c not in df.columns]
    full = df.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else df
    scored = model.transform(full)
    keep = [col(c) for c in df.columns]
    if task == "classification":
        return scored.select(*keep, F.col("predicted_class").alias("prediction"), F.array_max(vector_to_array("probability")).alias("confidence"))
    return scored.select(*keep, "prediction")


def segments(p: Profile, sizes: tuple[int, ...] = (2, 3, 4, 5, 6)) -> tuple[PipelineModel, DataFrame, int]:
    """K-means on the preprocessed columns; the number of clusters with the best silhouette wins."""
    pipeline, _ = build_preprocessor(p, choose_features(p, None))
    fitted = pipeline.fit(p.df)
    ready = durable(fitted.transform(p.df).select(*[col(c) for c in p.df.columns], "features"))
    judge = ClusteringEvaluator(metricName="silhouette")
    tried = []
    for k in sizes:
        model = KMeans(k=k, seed=SEED).fit(ready)
        tried.append((judge.evaluate(model.transform(ready)), k, model))
    _, k, best = max(tried, key=lambda t: t[0])
    return _joined(fitted, best), best.transform(ready).withColumnRenamed("prediction", "segment"), k
