"""Models on the pair, price and panel frames (group K, J9, J12, I23): boosted trees and MLlib's linear ones."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.scalar import case, flag, safe_div
from shelfwise.operators.boosting import LABEL_GAIN, Boosted, Lambda, Logistic, Pinball, Squared, explain, fit, predict
from shelfwise.operators.evaluate import hash_unit, row_key, wmape
from shelfwise.operators.transfer import TRANSFER_FEATURES
from shelfwise.scale import exact_quantiles, written
from shelfwise.schema import MARKET_KEYS, SERIES_KEYS

#: Features of the event classifier and of the price response.
EVENT_FEATURES = ["donor_base_units_pct_chg", "donor_velocity_spm_pct_chg", "pack_distance",
                  "relationship_distance", "focal_post_promo_weeks", "promo_confounded"]
PRICE_FEATURES = ["log_price_change", "pre_13w_avg_price_per_unit", "pre_13w_velocity_spm",
                  "pre_13w_weeks_count", "post_13w_weeks_count", "pack_count", "promo_confounded"]
#: Panel features that are known before the week they predict.
PANEL_FEATURES = ["lag1", "lag4", "lag13", "lag52", "week_sin", "week_cos"]


def numeric(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as double with 0 for missing values."""
    fixed = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features}
    return df.withColumns({f"x_{c}": v for c, v in fixed.items()})


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=[f"x_{c}" for c in features], outputCol="features")


def hash_split(df: DataFrame, key: Column, share: float = 0.8, salt: str = "split") -> DataFrame:
    """A repeatable train flag. Drawn per row key, so every class is split in the same proportion."""
    return df.withColumn("is_train", hash_unit(key, salt) < share)


def pair_key() -> Column:
    return F.concat_ws("|", "focal_upc", "donor_upc", *MARKET_KEYS)


# ---------------------------------------------------------------- K1-K4

#: Most rounds of the classifiers and of the other pair models; training stops earlier.
TRANSFER_ROUNDS, PAIR_ROUNDS = 500, 300


def _sigmoid(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def _event_key() -> Column:
    return F.concat_ws("|", pair_key(), F.lit("event"))


def fit_transfer(pairs: DataFrame, iterations: int = TRANSFER_ROUNDS, depth: int = 4) -> tuple[Boosted, DataFrame]:
    """K1: demand-transfer classifier on labelled pairs; validation AUC and the round kept, a row per side of the split.

    A fifth of the pairs, by key, only tells when to stop.
    """
    rows = pairs.where(F.col("label_deterministic") != "NEUTRAL").withColumn(
        "label", flag(F.col("label_deterministic") == "CANNIBALIZING").cast("double"))
    rows = hash_split(rows, pair_key())
    model = fit(rows, TRANSFER_FEATURES, "label", Logistic(), iterations=iterations, depth=depth)
    scored = rows.where(~F.col("is_train")).select("label", predict(model)[0].alias("margin"))
    auc = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="margin", metricName="areaUnderROC").evaluate(scored)
    metrics = rows.groupBy("is_train").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives")).withColumns({
        "auc": F.when(~F.col("is_train"), F.lit(float(auc))), "rounds": F.lit(model.rounds[0])})
    return model, metrics


def score_pairs(model: Boosted, pairs: DataFrame) -> DataFrame:
    """Probability of demand transfer for every pair."""
    return pairs.withColumn("transfer_prob", _sigmoid(predict(model)[0]))


def fit_ranker(frame: DataFrame, features: Sequence[str] = TRANSFER_FEATURES, iterations: int = PAIR_ROUNDS, depth: int = 4) -> Boosted:
    """K2: donor ranking by list-wise gradients of NDCG within each focal product and market.

    A fifth of the lists, by focal product and market, only tells when to stop.
    """
    group = ["focal_upc", *MARKET_KEYS]
    rows = hash_split(frame, F.concat_ws("|", *group), salt="rank")
    return fit(rows, features, "relevance", Lambda(gains=LABEL_GAIN), group=group, iterations=iterations, depth=depth, min_rows=5)


def rank_scores(model: Boosted, frame: DataFrame) -> DataFrame:
    return frame.withColumn("rank_score", predict(model)[0])


def ndcg(ranked: DataFrame, k: int = 10, score: str = "rank_score") -> DataFrame:
    """Normalised discounted gain per focal product and market (donor lists are catalogue-sized)."""
    group = Window.partitionBy("focal_upc", *MARKET_KEYS)
    gain = case([(F.col("relevance") == i, g) for i, g in enumerate(LABEL_GAIN)], 0.0)

    def dcg(order: Column) -> Column:
        pos = F.row_number().over(group.orderBy(order, "donor_upc"))
        return F.when(pos <= k, gain / F.log2(pos + 1)).otherwise(0.0)

    g = ranked.select("focal_upc", *MARKET_KEYS, dcg(F.desc(score)).alias("_d"), dcg(F.desc("relevance")).alias("_i"))
    return g.groupBy("focal_upc", *MARKET_KEYS).agg(safe_div(F.sum("_d"), F.sum("_i")).alias("ndcg"))


def fit_event(frame: DataFrame, iterations: int = PAIR_ROUNDS, depth: int = 4) -> Boosted:
    """K3: event significance classifier; unit changes are clipped to +-500 percent."""
    rows = hash_split(clip_outliers(frame), _event_key())
    return fit(rows, EVENT_FEATURES, "event_significant", Logistic(), iterations=iterations, depth=depth)


def clip_outliers(frame: DataFrame, limit: float = 5.0) -> DataFrame:
    cols = ("donor_base_units_pct_chg", "donor_velocity_spm_pct_chg")
    return frame.withColumns({c: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col(c))) for c in cols})


def score_events(model: Boosted, frame: DataFrame) -> DataFrame:
    out = clip_outliers(frame).select(F.struct(*frame.columns).alias("_clipped"), *EVENT_FEATURES, _event_key().alias("_k"))
    scored = out.select("_clipped", _sigmoid(predict(model)[0]).alias("event_prob"))
    return scored.select("_clipped.*", "event_prob")


def fit_price(frame: DataFrame, iterations: int = PAIR_ROUNDS, depth: int = 4) -> Boosted:
    """K4: own-price response on real price moves; a fifth of the rows, by key, only tells when to stop.

    The naive elasticity is left out: it is built from the target.
    """
    rows = hash_split(frame.where("real_price_move"), row_key(), salt="price")
    return fit(rows, PRICE_FEATURES, "log_unit_change", Squared(), iterations=iterations, depth=depth)


def score_price(model: Boosted, frame: DataFrame) -> DataFrame:
    return frame.withColumn("predicted_log_unit_change", predict(model)[0])


# ---------------------------------------------------------------- K5-K7


def fit_linear(frame: DataFrame, features: Sequence[str], label: str, alpha: float = 0.0, l1: float = 0.0) -> PipelineModel:
    """K5: least squares (alpha 0), ridge (l1 0) or lasso (l1 1)."""
    lr = LinearRegression(featuresCol="features", labelCol="_y", regParam=alpha, elasticNetParam=l1, maxIter=50)
    rows = numeric(frame, features).withColumn("_y", F.col(label).cast("double")).where("_y is not null")
    return Pipeline(stages=[_assembler(features), lr]).fit(rows)


def predict_linear(model: PipelineModel, frame: DataFrame, features: Sequence[str]) -> DataFrame:
    return model.transform(numeric(frame, features)).select(*frame.columns, "prediction")


def top_drivers(frame: DataFrame, model: Boosted, n: int = 3) -> DataFrame:
    """K6: the n features that move a row's margin most, along the paths of the fitted trees.

    Adds `margin`, `driver_base` and `drivers`: (feature, contribution), largest size first. The base
    and the contributions of all features add up to the margin.
    """
    rows = frame.withColumns({"margin": predict(model)[0], "_parts": explain(model)})
    parts = F.array(*[
        F.struct(F.abs(F.col("_parts")[i + 1]).alias("size"), F.lit(c).alias("feature"), F.col("_parts")[i + 1].alias("contribution"))
        for i, c in enumerate(model.features)])
    ordered = F.slice(F.reverse(F.array_sort(parts)), 1, n)
    return rows.select(
        *frame.columns, "margin", F.col("_parts")[0].alias("driver_base"), "_parts",
        F.transform(ordered, lambda d: F.struct(d["feature"].alias("feature"), d["contribution"].alias("contribution"))).alias("drivers"))


def importance(model: Boosted, frame: DataFrame) -> DataFrame:
    """K7: features by mean absolute contribution over `frame`; as many rows as the model has inputs."""
    rows = frame.select(explain(model).alias("_parts"))
    sizes = rows.agg(*[F.avg(F.abs(F.col("_parts")[i + 1])).alias(c) for i, c in enumerate(model.features)])
    return sizes.unpivot([], list(model.features), "feature", "importance").orderBy(F.desc("importance"), "feature")


# ---------------------------------------------------------------- panel models


def lag_frame(panel: DataFrame, target: str = "base_units", lags: Sequence[int] = (1, 4, 13, 52)) -> DataFrame:
    """Rows with the lags a forecaster will see; the target is on the log scale."""
    from shelfwise.operators.windows import fourier, series

    sin, cos = fourier()
    return panel.select(
        "week", *SERIES_KEYS, F.col(target).cast("double").alias("actual"), F.log1p(target).alias("log_target"),
        *[F.log1p(F.lag(target, n).over(series())).alias(f"lag{n}") for n in lags],
        sin.alias("week_sin"), cos.alias("week_cos"),
        *[c for c in ("weeks_since_launch", "pack_count", "arp_pct_change") if c in panel.columns],
    ).where(F.col("lag1").isNotNull())


def temporal_split(frame: DataFrame, weeks: int = 13) -> DataFrame:
    """The newest weeks of the data are the validation set."""
    newest = frame.agg(F.max("week").alias("w")).scalar()
    return frame.withColumn("_newest", newest).withColumn(
        "is_train", F.col("week") <= F.date_sub("_newest", 7 * weeks)).drop("_newest")


#: Quantiles of low, base and high; most rounds of the panel models.
QUANTILES = {"low": 0.1, "base": 0.5, "high": 0.9}
PANEL_ROUNDS = 300


def _held_part(share: float) -> Column:
    """The held-out rows that stop the training and set the offsets."""
    return ~F.col("is_train") & (hash_unit(row_key(), "bands") < share)


def fit_quantiles(
    panel: DataFrame, iterations: int = PANEL_ROUNDS, depth: int = 4, target: str = "base_units", share: float = 1.0,
    lags: Sequence[int] = (1, 4, 13, 52), log: bool = True, rate: float = 0.3, patience: int = 3,
) -> tuple[Boosted, DataFrame]:
    """Boosted trees on the pinball loss, one model per quantile, with offsets per channel.

    The newest 13 weeks are held out. Part of them (`share`, by row key) says when each quantile's training
    stops, and how far its model must move in a channel to cover what it claims there; `unseen_rows`
    returns the others, which can tell how often the bands hold.
    """
    frame = temporal_split(lag_frame(panel, target, lags) if log else _raw_lags(panel, target, lags))
    features = [*(f"lag{n}" for n in lags), "week_sin", "week_cos"]
    label = "log_target" if log else "actual"
    frame = written(frame.where(F.col("is_train") | _held_part(share)))
    model = fit(frame, features, label, Pinball(tuple(QUANTILES.values())), iterations=iterations, depth=depth, rate=rate, patience=patience)
    held = frame.where(_held_part(share)).withColumn("_s", predict(model))
    offsets = None
    for i, (name, q) in enumerate(QUANTILES.items()):
        part = exact_quantiles(held.withColumn("_r", F.col(label) - F.col("_s")[i]), ["channel_outlet"], "_r", {f"off_{name}": q})
        offsets = part if offsets is None else offsets.join(part, "channel_outlet")
    return model, offsets


def unseen_rows(panel: DataFrame, share: float, target: str = "base_units") -> DataFrame:
    """Held-out rows of `fit_quantiles` that neither the trees nor the offsets have seen."""
    frame = temporal_split(lag_frame(panel, target))
    return frame.where(~F.col("is_train") & ~_held_part(share))


def quantile_predictions(
    model: Boosted, offsets: DataFrame, frame: DataFrame, log: bool = True, ceiling: float | None = None
) -> DataFrame:
    """Low, base and high for rows with lags (on the log scale, if `log`); in order, and not below zero."""
    p = frame.withColumn("_s", predict(model)).join(offsets, "channel_outlet", "left")
    moved = F.array_sort(F.array(*[F.col("_s")[i] + F.coalesce(F.col(f"off_{n}"), F.lit(0.0)) for i, n in enumerate(QUANTILES)]))

    def units(x: Column) -> Column:
        x = F.greatest(F.expm1(x) if log else x, F.lit(0.0))
        return x if ceiling is None else F.least(x, F.lit(ceiling))

    return p.withColumn("_q", moved).select(*frame.columns, *[units(F.col("_q")[i]).alias(n) for i, n in enumerate(QUANTILES)])


def step_predictor(model: Boosted, offsets: DataFrame, log: bool = True, ceiling: float | None = None):
    """Adapter of fitted quantile models to the recursive forecast (its lags arrive in units)."""
    lags = [c for c in model.features if c.startswith("lag")]

    def predict_step(df: DataFrame) -> DataFrame:
        logged = df.withColumns({c: F.log1p(c) for c in lags}) if log else df
        out = quantile_predictions(model, offsets, logged, log, ceiling)
        return out.withColumns({c: F.expm1(c) for c in lags}) if log else out

    return predict_step


def _raw_lags(panel: DataFrame, target: str, lags: Sequence[int]) -> DataFrame:
    from shelfwise.operators.windows import fourier, series

    sin, cos = fourier()
    return panel.select("week", *SERIES_KEYS, F.col(target).cast("double").alias("actual"),
                        *[F.lag(target, n).over(series()).alias(f"lag{n}") for n in lags],
                        sin.alias("week_sin"), cos.alias("week_cos")).where(F.col("lag1").isNotNull())


def _split_error(frame: DataFrame, features: Sequence[str], alpha: float, l1: float) -> DataFrame:
    model = fit_linear(frame.where("is_train"), features, "log_target", alpha, l1)
    out = predict_linear(model, frame.where(~F.col("is_train")), features)
    return out.withColumn("pred", F.expm1(F.greatest("prediction", F.lit(0.0))))


def ablate(panel: DataFrame, feature_sets: dict[str, Sequence[str]], base: str, promote: float = 0.03) -> DataFrame:
    """K8: error of feature sets against a base set; a set is promoted for a lower error."""
    frame = written(temporal_split(lag_frame(panel)))
    out = None
    for name, feats in feature_sets.items():
        m = _split_error(frame, feats, 1e-3, 0.0).agg(F.lit(name).alias("variant"), wmape("actual", "pred").alias("wmape"))
        out = m if out is None else out.unionByName(m)
    ref = out.where(F.col("variant") == base).select("wmape").scalar()
    d = out.withColumn("_ref", ref).withColumn("delta_pp", F.col("wmape") - F.col("_ref"))
    return d.select("variant", "wmape", "delta_pp", (F.col("delta_pp") <= -promote).alias("promote"))


def grid_cv(panel: DataFrame, alphas: Sequence[float], l1s: Sequence[float], cutpoints: Sequence[date]) -> DataFrame:
    """K9: regularisation grid on temporal folds; mean error per setting, best first."""
    frame = written(lag_frame(panel))
    out = None
    for cut in cutpoints:
        inside = frame.where(F.col("week") < F.date_add(F.lit(cut), 91)).withColumn("is_train", F.col("week") < F.lit(cut))
        for a in alphas:
            for l1 in l1s:
                m = _split_error(inside, PANEL_FEATURES, a, l1).agg(
                    F.lit(a).alias("alpha"), F.lit(l1).alias("l1"), F.lit(cut).alias("cutpoint"),
                    wmape("actual", "pred").alias("wmape"))
                out = m if out is None else out.unionByName(m)
    return out.groupBy("alpha", "l1").agg(F.avg("wmape").alias("mean_wmape"), F.count(F.lit(1)).alias("folds")).orderBy("mean_wmape", "alpha", "l1")


# ---------------------------------------------------------------- effects


def segment_effect(rows: DataFrame, segment: str, y: str, t: str, controls: Sequence[str], folds: int = 2) -> DataFrame:
    """Price effect per segment with outcome and treatment residualised out of fold.

    Each fold's nuisance models are fitted on the other folds; the effect is the slope of residual
    on residual, with a 90 percent interval.
    """
    key = row_key()
    base = rows.select("*", F.floor(hash_unit(key, "fold") * folds).cast("int").alias("_fold")).where(
        F.col(y).isNotNull() & F.col(t).isNotNull() & F.col(segment).isNotNull())
    resid = None
    for i in range(folds):
        train, test = base.where(F.col("_fold") != i), base.where(F.col("_fold") == i)
        my = fit_linear(train, controls, y, alpha=1e-3)
        mt = fit_linear(train, controls, t, alpha=1e-3)
        part = predict_linear(my, test, controls).withColumn("_ry", F.col(y) - F.col("prediction")).drop("prediction")
        part = predict_linear(mt, part, controls).withColumn("_rt", F.col(t) - F.col("prediction"))
        part = part.select(F.col(segment).alias("label"), "_ry", "_rt")
        resid = part if resid is None else resid.unionByName(part)
    s = resid.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop("_ry", "_rt").alias("_c"), F.var_pop("_rt").alias("_v"), F.var_pop("_ry").alias("_w"))
    s = s.withColumn("effect", F.when(F.col("_v") > 0, F.try_divide("_c", "_v")))
    se = F.sqrt(F.greatest(F.col("_w") - F.col("effect") * F.col("_c"), F.lit(0.0)) / (F.col("n") - 2) / F.col("_v"))
    s = s.where((F.col("n") > 2) & (F.col("_v") > 0)).withColumn("_se", se)
    return s.select("label", "n", "effect", (F.col("effect") - 1.645 * F.col("_se")).alias("ci_low"),
                    (F.col("effect") + 1.645 * F.col("_se")).alias("ci_high"))


def ipw(rows: DataFrame, y: str, t: str, controls: Sequence[str], clip: float = 0.02) -> DataFrame:
    """Effect of an above-median treatment with inverse-propensity weights, one row."""
    med = exact_quantiles(rows, [], t, {"m": 0.5}).select("m").scalar()
    base = numeric(rows.withColumn("_m", med), controls).withColumn("label", flag(F.col(t) > F.col("_m")).cast("double"))
    lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=1e-3, maxIter=30)
    model = Pipeline(stages=[_assembler(controls), lr]).fit(base)
    e = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), vector_to_array("probability")[1]))
    w = model.transform(base).withColumn("_e", e)
    one, zero = F.col("label") / F.col("_e"), (1 - F.col("label")) / (1 - F.col("_e"))
    s = w.agg(
        F.count(F.lit(1)).alias("n"), F.avg("label").alias("treated_share"),
        (F.sum(one * F.col(y)) / F.sum(one)).alias("_y1"), (F.sum(zero * F.col(y)) / F.sum(zero)).alias("_y0"),
        (F.sum(one * F.col(t)) / F.sum(one)).alias("_t1"), (F.sum(zero * F.col(t)) / F.sum(zero)).alias("_t0"))
    ate = F.col("_y1") - F.col("_y0")
    return s.select("n", "treated_share", ate.alias("ate"), safe_div(ate, F.col("_t1") - F.col("_t0")).alias("effect_per_unit"))
