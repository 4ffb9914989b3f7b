"""Linear and logistic regressions by formula, scoring, error measures and model comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import RFormula
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from houselights.functions.arrays import total
from houselights.functions.tails import chi_square_tail, t_tail
from houselights.models.sweep import swept
from houselights.session import materialise


def formula(response: str, predictors: Sequence[str]) -> str:
    return f"{response} ~ {' + '.join(predictors)}"


def all_but(df: DataFrame, response: str, excluded: Sequence[str] = ()) -> str:
    """Every other column as a predictor, except the named ones."""
    return formula(response, [name for name in df.columns if name != response and name not in excluded])


def as_categories(df: DataFrame, *columns: str) -> DataFrame:
    """Text columns are encoded as categories when the model is fitted, and reused when it scores."""
    return df.withColumns({name: F.col(name).cast("string") for name in columns})


def _encoder(model_formula: str) -> RFormula:
    """Categories become indicator columns against their first level in alphabetical order."""
    return RFormula(formula=model_formula, featuresCol="features", labelCol="label", stringIndexerOrderType="alphabetDesc")


def fit_linear(df: DataFrame, model_formula: str) -> PipelineModel:
    """Ordinary least squares in closed form: one distributed pass for the cross products.

    Category levels and the summary read the rows again, so they are written out first.
    """
    return Pipeline(stages=[_encoder(model_formula), LinearRegression(solver="normal")]).fit(materialise(df))


def fit_logistic(df: DataFrame, model_formula: str) -> PipelineModel:
    """Binomial model by iteratively reweighted least squares; the rows are read once per iteration, so they are
    written out first."""
    glm = GeneralizedLinearRegression(family="binomial", link="logit", tol=1e-10, maxIter=50)
    return Pipeline(stages=[_encoder(model_formula), glm]).fit(materialise(df))


def feature_names(model: PipelineModel, sample: DataFrame) -> list[str]:
    """Names of the encoded predictors, in coefficient order."""
    groups = model.stages[0].transform(sample).schema["features"].metadata["ml_attr"]["attrs"]
    attributes = sorted((a for group in groups.values() for a in group), key=lambda a: a["idx"])
    return [a["name"] for a in attributes]


def coefficients(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Coefficient table. Terms that follow from those before them have no estimate, as in `coefficient_table`."""
    fitted = model.stages[-1]
    names = [*feature_names(model, df), "(Intercept)"]
    values = [*[float(v) for v in fitted.coefficients], float(fitted.intercept)]
    try:
        errors, p_values = list(fitted.summary.coefficientStandardErrors), list(fitted.summary.pValues)
    except UnsupportedOperationException:  # the summary of a singular design has none
        return coefficient_table(model, df)
    rows = [(n, v, float(e), float(p)) for n, v, e, p in zip(names, values, errors, p_values)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, p_value double")


def coefficient_table(model: PipelineModel, df: DataFrame) -> DataFrame:
    """term, estimate, std_error and p_value of least squares on the encoded predictors, whatever their rank.

    Two passes over the rows: means and spreads, then the cross products of the standardised predictors, which partitions
    add up. The matrix, one number for each pair of predictors, is swept in the order of the formula; a predictor that
    those before it determine (or a constant one) is aliased: it is named, with NULL estimate and error.
    """
    names = feature_names(model, df)
    p = len(names)
    rows = materialise(model.stages[0].transform(df).select(
        vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")))
    at = [F.get("x", F.lit(k)) for k in range(p)]
    first = rows.agg(F.count(F.lit(1)), F.avg("y"), F.array(*map(F.avg, at)), F.array(*map(F.stddev_pop, at))).first()
    n, centre, means, spreads = first
    if not n:
        raise ValueError("no rows to fit")
    spreads = [x or 1.0 for x in spreads]
    z = [*[(x - m) / d for x, m, d in zip(at, means, spreads)], F.col("y") - centre]
    cells = {(i, j): F.sum(z[i] * z[j]) for i in range(p + 1) for j in range(i, p + 1)}
    # Many sums in one pass: each is a column of its own, put in place afterwards.
    sums = rows.agg(*[cell.alias(f"c{i}_{j}") for (i, j), cell in cells.items()])
    matrix = F.array(*[F.col(f"c{min(i, j)}_{max(i, j)}") for i in range(p + 1) for j in range(p + 1)])
    one = sums.select(swept(matrix, p + 1, F.array(*[F.lit(k) for k in range(p)])).alias("s"))
    freedom = F.lit(n) - F.size("s.done") - 1
    one = one.withColumn("variance", F.try_divide(F.get("s.a", F.lit((p + 1) ** 2 - 1)), F.when(freedom > 0, freedom)))

    def used(k: int) -> Column:
        return F.array_contains("s.done", F.lit(k))

    def cell(i: int, j: int) -> Column:
        return F.get("s.a", F.lit(i * (p + 1) + j))

    estimates = [F.when(used(k), cell(k, p) / spreads[k]) for k in range(p)]
    errors = [F.when(used(k), F.sqrt(F.col("variance") * cell(k, k)) / spreads[k]) for k in range(p)]
    intercept = F.lit(centre) - sum((F.coalesce(e, F.lit(0.0)) * m for e, m in zip(estimates, means)), F.lit(0.0))
    # (m / s)' inverse (m / s) over the swept predictors.
    ratios = F.array(*[F.when(used(k), F.lit(m / d)).otherwise(0.0) for k, (m, d) in enumerate(zip(means, spreads))])
    square = total(F.transform(ratios, lambda a, i: a * total(F.transform(
        ratios, lambda b, j: b * F.when(b == 0, 0.0).otherwise(F.get("s.a", i * (p + 1) + j))))))
    terms = [F.struct(F.lit("(Intercept)").alias("term"), intercept.alias("estimate"),
                      F.sqrt(F.col("variance") * (F.lit(1.0 / n) + square)).alias("std_error"))]
    terms += [F.struct(F.lit(name).alias("term"), e.alias("estimate"), d.alias("std_error"))
              for name, e, d in zip(names, estimates, errors)]
    return one.select(freedom.alias("freedom"), F.explode(F.array(*terms)).alias("t")).select("t.*", t_tail(
        F.try_divide(F.col("t.estimate"), F.col("t.std_error")), F.col("freedom")).alias("p_value"))


def quality(model: PipelineModel, df: DataFrame) -> DataFrame:
    summary = model.stages[-1].summary
    row = (float(summary.r2), float(summary.r2adj), float(summary.rootMeanSquaredError), int(summary.numInstances))
    return df.sparkSession.createDataFrame([row], "r2 double, adjusted_r2 double, rmse double, n bigint")


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The input rows with a `prediction` column; no key or row number is needed to line them up."""
    return model.transform(df).drop("features", "label")


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg(F.pow(actual - predicted, 2)))


def mape(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(F.try_divide(actual - predicted, actual))) * 100


def forecast_errors(scored: DataFrame, actual: str = "revenue", goal: str = "goal") -> DataFrame:
    """Model against human goal: RMSE and MAPE of each."""
    return scored.agg(rmse(F.col(actual), F.col("prediction")).alias("rmse_prediction"),
                      rmse(F.col(actual), F.col(goal)).alias("rmse_goal"),
                      mape(F.col(actual), F.col("prediction")).alias("mape_prediction"),
                      mape(F.col(actual), F.col(goal)).alias("mape_goal"))


def projection_difference(scored: DataFrame, projected: str = "projected") -> DataFrame:
    return scored.withColumn("difference", F.col("prediction") - F.col(projected))


# --- logistic ------------------------------------------------------------------------------------------------


def log_likelihood(outcome: Column, probability: Column) -> Column:
    """Aggregate: sum of the logs of the probability given to what happened."""
    return F.sum(F.ln(F.when(outcome == 1, probability).otherwise(1 - probability)))


def deviance(scored: DataFrame, outcome: str) -> DataFrame:
    likelihood = log_likelihood(F.col(outcome), F.col("prediction"))
    return scored.agg(likelihood.alias("log_likelihood"), (likelihood * -2).alias("deviance"))


def likelihood_ratio(small: PipelineModel, large: PipelineModel, df: DataFrame) -> DataFrame:
    """Did the additional predictors reduce the deviance by more than chance?"""
    a, b = small.stages[-1], large.stages[-1]
    statistic = float(a.summary.deviance - b.summary.deviance)
    degrees = len(b.coefficients) - len(a.coefficients)
    row = (float(a.summary.deviance), float(b.summary.deviance), statistic, degrees)
    return df.sparkSession.createDataFrame(
        [row], "deviance_small double, deviance_large double, chi_square double, df int").withColumn(
        "p_value", chi_square_tail(F.col("chi_square"), F.col("df")))


def tail_rates(ranked: DataFrame, outcome: str = "buy", tiles: int = 5) -> DataFrame:
    """Outcome rate in the lowest and highest fifth by score."""
    tile = F.col("tile")
    return (ranked.where(tile.isin(1, tiles))
            .groupBy(F.when(tile == 1, "lowest").otherwise("highest").alias("part"))
            .agg(F.count("*").alias("n"), F.avg(outcome).alias("rate")))
