"""Baselines, recursion, seasonal tools, decomposition and portfolio constraint (group J)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise import config as k
from shelfwise.functions.scalar import case, clamp, safe_div
from shelfwise.operators import windows as w
from shelfwise.scale import durable
from shelfwise.schema import MARKET_KEYS, SERIES_KEYS

# ---------------------------------------------------------------- baselines and fallbacks


def baselines(panel: DataFrame, c: str = "base_units") -> DataFrame:
    """Last value, mean of 4 and 13 rows, value 52 rows back; all from one reverse rank."""
    r, x = F.col("rows_back"), F.col(c)
    return w.with_age(panel).where(r <= 52).groupBy(*SERIES_KEYS).agg(
        F.max(F.when(r == 1, x)).alias("last_value"),
        F.avg(F.when(r <= 4, x)).alias("ma4"),
        F.avg(F.when(r <= 13, x)).alias("ma13"),
        F.max(F.when(r == 52, x)).alias("seasonal_naive"),
    )


def history_arrays(panel: DataFrame, c: str = "base_units", keep: int | None = None) -> DataFrame:
    """One array per series, oldest first. At most one entry per week, so bounded by the calendar."""
    rows = panel if keep is None else w.tail_n(panel, keep)
    packed = rows.groupBy(*SERIES_KEYS).agg(
        F.sort_array(F.collect_list(F.struct("week", F.col(c).cast("double").alias("v")))).alias("_h"),
        F.max("week").alias("anchor_week"),
    )
    return packed.select(*SERIES_KEYS, "anchor_week", F.col("_h.v").alias("history"))


def _holt(history: Column, alpha: Column, beta: Column) -> Column:
    """Fold level, trend and squared one-step error over a series (needs two values)."""
    start = F.struct(
        F.element_at(history, 1).alias("l"),
        (F.element_at(history, 2) - F.element_at(history, 1)).alias("b"),
        F.lit(0.0).alias("sse"),
    )

    def step(s: Column, y: Column) -> Column:
        pred = s["l"] + s["b"]
        level = alpha * y + (1 - alpha) * pred
        return F.struct(
            level.alias("l"),
            (beta * (level - s["l"]) + (1 - beta) * s["b"]).alias("b"),
            (s["sse"] + (y - pred) * (y - pred)).alias("sse"),
        )

    return F.aggregate(F.slice(history, F.lit(2), F.size(history)), start, step)


def holt_forecast(
    panel: DataFrame, horizon: int = k.HORIZON, grid: Sequence[float] = (0.1, 0.3, 0.5, 0.8),
    min_rows: int = 4, c: str = "base_units",
) -> DataFrame:
    """Linear-trend smoothing per series; the (alpha, beta) grid is scored inside the row."""
    series = history_arrays(panel, c).where(F.size("history") >= min_rows)
    fits = F.array(*[
        F.struct(_holt(F.col("history"), F.lit(a), F.lit(b)).alias("s"),
                 F.lit(a).alias("alpha"), F.lit(b).alias("beta"))
        for a in grid for b in grid
    ])
    best = series.withColumn("_fits", fits).select(
        *SERIES_KEYS, "anchor_week",
        F.array_min(F.transform("_fits", lambda f: F.struct(
            f["s"]["sse"].alias("sse"), f["alpha"].alias("alpha"), f["beta"].alias("beta"),
            f["s"]["l"].alias("level"), f["s"]["b"].alias("trend")))).alias("m"),
    )
    return best.select(
        *SERIES_KEYS, "anchor_week", F.col("m.alpha").alias("alpha"), F.col("m.beta").alias("beta"),
        F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("forecast_week_number"),
        F.col("m.level").alias("_l"), F.col("m.trend").alias("_b"),
    ).select(
        *SERIES_KEYS, "alpha", "beta", "forecast_week_number",
        F.date_add("anchor_week", F.col("forecast_week_number") * 7).alias("week"),
        F.greatest(F.col("_l") + F.col("_b") * F.col("forecast_week_number"), F.lit(0.0)).alias(
            "holt_units"),
    )


def with_history(forecast: DataFrame, panel: DataFrame, min_rows: int = 52) -> DataFrame:
    """Forecasts of series with enough rows for the model, by default its longest lag."""
    enough = panel.groupBy(*SERIES_KEYS).count().where(F.col("count") >= min_rows)
    return forecast.join(enough, SERIES_KEYS, "left_semi")


def forecast_ladder(model: DataFrame, holt: DataFrame, base: DataFrame) -> DataFrame:
    """Model forecast, else trend smoothing, else recent mean, else nothing.

    `base` lists every series (with ma13); the others carry forecast_week_number.
    """
    keys = [*SERIES_KEYS, "forecast_week_number"]
    frame = base.select(
        *SERIES_KEYS, "ma13",
        F.explode(F.sequence(F.lit(1), F.lit(k.HORIZON))).alias("forecast_week_number"))
    j = frame.join(model.select(*keys, "forecast_units_base"), keys, "left").join(
        holt.select(*keys, "holt_units"), keys, "left")
    return j.select(
        *keys,
        F.coalesce("forecast_units_base", "holt_units", "ma13").alias("forecast_units"),
        case(
            [(F.col("forecast_units_base").isNotNull(), "model"),
             (F.col("holt_units").isNotNull(), "ets"), (F.col("ma13").isNotNull(), "actuals")],
            "none",
        ).alias("forecast_source"),
    )


def ensemble_route(test: DataFrame, meta: DataFrame, margin: float = 5.0) -> DataFrame:
    """Per series the better of model and trend smoothing, with its growth stage.

    `test`: series keys, actual, pred_model, pred_ets. `meta`: series keys, max_wsl, growth columns.
    """
    def wm(p: str) -> Column:
        return 100 * safe_div(F.sum(F.abs(F.col("actual") - F.col(p))), F.sum("actual"))

    s = test.groupBy(*SERIES_KEYS).agg(
        wm("pred_model").alias("wmape_model"), wm("pred_ets").alias("wmape_ets"),
        F.sum("actual").alias("total_actual"))
    ets = F.col("wmape_ets") < F.col("wmape_model") - margin
    mod = F.col("wmape_model") < F.col("wmape_ets") - margin
    stage = case([(F.col("max_wsl") <= 26, "New / Cold-start"),
                  (F.col("max_wsl") <= 52, "Expanding / Growth")], "Mature / Stable")
    return s.join(meta, SERIES_KEYS, "left").select(
        "*", case([(ets, "ets"), (mod, "model")], "tied").alias("winner"),
        F.when(ets, "ets").otherwise("model").alias("route"), stage.alias("stage"))


# ---------------------------------------------------------------- recursion

#: Named columns of one step (lag1, lag4, ..., lag52, week_sin, week_cos, week_of_year, step and the
#: static columns) -> (low, base, high).
Rule = Callable[[dict[str, Column]], tuple[Column, Column, Column]]

_STATIC = ("arp", "tdp", "weeks_since_launch", "pack_count", "max_donor_prob", "donor_count")
_STEP = "struct<step:int,low:double,base:double,high:double>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _seed(
    panel: DataFrame, target: str, seasonal: DataFrame | None, lags: Sequence[int], horizon: int
) -> tuple[DataFrame, list[str]]:
    """One row per series: the values that the lags reach, static columns and the year-on-year level."""
    static = [c for c in _STATIC if c in panel.columns]
    frame = history_arrays(panel, target, keep=max(*lags, 52) + horizon)
    if static:
        newest = panel.groupBy(*SERIES_KEYS).agg(*[F.max_by(c, "week").alias(c) for c in static])
        frame = frame.join(newest, SERIES_KEYS)
    h = F.col("history")
    year_ago = F.when(F.size(h) >= 52, F.element_at(h, -52))
    season = F.lit(None).cast("map<int,double>")
    if seasonal is not None:
        # 53 entries at most
        season = seasonal.agg(F.map_from_entries(F.collect_list(
            F.struct("week_of_year", "seasonal_index"))).alias("m")).scalar()
    return frame.select(
        "*", F.element_at(h, -1).alias("anchor_value"), F.size(h).alias("n_actual"),
        F.when(year_ago > 0, clamp(F.element_at(h, -1) / year_ago, *k.YOY_CLIP)).alias("yoy"),
        season.alias("season"),
    ), static


def _features(history: Column, step: Column, lags: Sequence[int], static: Sequence[str]) -> dict[str, Column]:
    week = F.date_add(F.col("anchor_week"), (step * 7).cast("int"))
    sin, cos = w.fourier(F.weekofyear(week))
    out = {f"lag{n}": F.when(F.size(history) >= n, F.element_at(history, -n)) for n in lags}
    # the year-ago value is always an actual: the history only grows at its end
    out["lag52"] = F.when(
        F.col("n_actual") >= 53 - step,
        F.element_at(history, (F.col("n_actual") - 52 + step).cast("int")))
    out |= {"week_sin": sin, "week_cos": cos, "week_of_year": F.weekofyear(week), "step": step}
    return out | {c: F.col(c) for c in static}


def _blend(made: Column, lag52: Column, woy: Column, step: Column, share: float, high_factor: float,
           clip: tuple[float, float | None]) -> Column:
    """Bend a prediction toward last year's value at the current level, else by the season index."""
    base = made["base"]
    by_year = ((1 - share) * base + share * lag52 * F.col("yoy")) / base
    index = F.coalesce(F.try_element_at("season", woy), F.lit(0.0))
    mult = (
        F.when(F.col("yoy").isNotNull() & (lag52 > 0) & (base > 0), by_year)
        .when(index != 0, F.greatest(F.lit(0.1), 1 + index)).otherwise(1.0)
    )

    def bound(c: Column) -> Column:
        c = F.greatest(c, F.lit(float(clip[0])))
        return c if clip[1] is None else F.least(c, F.lit(float(clip[1])))

    return _let(mult, lambda m: F.struct(
        step.cast("int").alias("step"), bound(made["low"] * m).alias("low"),
        bound(base * m).alias("base"), bound(made["high"] * m * high_factor).alias("high")))


def _forecast_rows(frame: DataFrame, static: Sequence[str]) -> DataFrame:
    rows = frame.select(*SERIES_KEYS, "anchor_week", "anchor_value", *static, F.explode("out").alias("o"))
    moved = [(F.col("weeks_since_launch") + F.col("o.step")).alias("weeks_since_launch")]
    return rows.select(
        F.date_add("anchor_week", F.col("o.step") * 7).alias("week"), *SERIES_KEYS,
        F.col("o.step").alias("forecast_week_number"), "anchor_week", "anchor_value",
        *[c for c in static if c != "weeks_since_launch"],
        *(moved if "weeks_since_launch" in static else []),
        *[F.col(f"o.{q}").alias(f"forecast_units_{q}") for q in ("low", "base", "high")],
    )


def recursive_forecast(
    panel: DataFrame, rule: Rule, horizon: int = k.HORIZON, target: str = "base_units",
    seasonal: DataFrame | None = None, high_factor: float = 1.0, lags: Sequence[int] = (1, 4, 13),
    clip: tuple[float, float | None] = (0.0, None), blend: float = k.SEASONAL_BLEND,
) -> DataFrame:
    """Recursion of a closed-form rule, folded inside each series' row.

    Every step predicts, bends the result toward the year-ago value, and appends the base forecast
    to the history array. One pass over the series, no shuffle between steps.
    """
    frame, static = _seed(panel, target, seasonal, lags, horizon)
    start = F.struct(F.col("history").alias("h"), F.array().cast(f"array<{_STEP}>").alias("out"))

    def advance(acc: Column, step: Column) -> Column:
        f = _features(acc["h"], step, lags, static)
        low, base, high = rule(f)
        made = F.struct(low.alias("low"), base.alias("base"), high.alias("high"))
        bent = _let(made, lambda m: _blend(
            m, f["lag52"], f["week_of_year"], step, blend, high_factor, clip))
        return _let(bent, lambda b: F.struct(
            F.array_append(acc["h"], b["base"]).alias("h"),
            F.array_append(acc["out"], b).alias("out")))

    folded = frame.withColumn(
        "out", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, advance)["out"])
    return _forecast_rows(folded, static)


def recursive_model_forecast(
    panel: DataFrame, predict: Callable[[DataFrame], DataFrame], horizon: int = k.HORIZON,
    target: str = "base_units", seasonal: DataFrame | None = None, high_factor: float = 1.0,
    lags: Sequence[int] = (1, 4, 13), clip: tuple[float, float | None] = (0.0, None),
    blend: float = k.SEASONAL_BLEND,
) -> DataFrame:
    """J11, J12 with a fitted model: 13 set-based steps over all series at once.

    `predict` adds low, base and high to a frame of step features. The frame (one row per series)
    is checkpointed after each step: the steps nest, and an unbroken plan would grow with them.
    """
    frame, static = _seed(panel, target, seasonal, lags, horizon)
    frame = frame.withColumn("out", F.array().cast(f"array<{_STEP}>"))
    kept = frame.columns
    for i in range(1, horizon + 1):
        step = F.lit(i)
        f = {n: c for n, c in _features(F.col("history"), step, lags, static).items() if n not in kept}
        p = predict(frame.select("*", *[c.alias(n) for n, c in f.items()]))
        p = p.withColumn("_m", F.struct("low", "base", "high")).withColumn("_b", _blend(
            F.col("_m"), F.col("lag52"), F.col("week_of_year"), step, blend, high_factor, clip))
        frame = durable(p.select(
            *[c for c in kept if c not in ("history", "out")],
            F.array_append("history", F.col("_b.base")).alias("history"),
            F.array_append("out", F.col("_b")).alias("out"),
        ))
    return _forecast_rows(frame, static)


def lag_rule(weights: dict[int, float], width: float = 0.2) -> Rule:
    """A fixed weighted mean of lags with a symmetric band; missing lags drop out."""

    def rule(f: dict[str, Column]) -> tuple[Column, Column, Column]:
        num, den = F.lit(0.0), F.lit(0.0)
        for n, wt in weights.items():
            num = num + F.coalesce(f[f"lag{n}"] * wt, F.lit(0.0))
            den = den + F.when(f[f"lag{n}"].isNotNull(), wt).otherwise(0.0)
        base = num / den
        return base * (1 - width), base, base * (1 + width)

    return rule


def coherent_total(base: DataFrame, total: DataFrame) -> DataFrame:
    """Total units are never below base units, quantile by quantile; dollars at the anchor price."""
    keys = ["week", *SERIES_KEYS, "forecast_week_number"]
    q = ("low", "base", "high")
    t = total.select(*keys, *[F.col(f"forecast_units_{x}").alias(f"_t_{x}") for x in q])
    return base.join(t, keys).select(
        *base.columns,
        *[F.greatest(f"_t_{x}", f"forecast_units_{x}").alias(f"forecast_total_units_{x}") for x in q],
        *[F.round(F.col(f"forecast_units_{x}") * F.col("arp"), 2).alias(f"forecast_dollars_{x}") for x in q],
    )


# ---------------------------------------------------------------- season, spine, change points


def monthly_index(panel: DataFrame, min_weeks: int = 26, c: str = "base_units") -> DataFrame:
    """Mean deviation of each month from the series' own level, centred on zero.

    `demand_index` is the same as a factor around one.
    """
    enough = panel.groupBy(*SERIES_KEYS).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_weeks)
    per = panel.join(enough, SERIES_KEYS, "left_semi").groupBy(
        *SERIES_KEYS, F.month("week").alias("month")).agg(F.avg(c).alias("_m"))
    level = per.groupBy(*SERIES_KEYS).agg(F.avg("_m").alias("_l")).where(F.col("_l") > 0)
    dev = per.join(level, SERIES_KEYS).groupBy("month").agg(
        F.avg(F.col("_m") / F.col("_l") - 1).alias("_d"))
    # twelve rows from here on
    centre = dev.agg(F.avg("_d").alias("c")).scalar()
    return dev.select("month", (F.col("_d") - centre).alias("seasonal_index"),
                      (1 + F.col("_d") - centre).alias("demand_index"))


def seasonal_index(panel: DataFrame, keys: Sequence[str] = ("channel_outlet",), half: int = 26,
                   c: str = "base_units") -> DataFrame:
    """Week-of-year index as the median ratio to a centred moving average.

    Works on weekly totals per key, one row per week, so windows are bounded by the calendar.
    """
    total = panel.groupBy(*keys, "week").agg(F.sum(c).alias("_u"))
    around = Window.partitionBy(*keys).orderBy("week").rowsBetween(-half, half)
    ratio = total.select(
        *keys, week_no(), F.col("_u"), F.avg("_u").over(around).alias("_ma"),
        F.count("_u").over(around).alias("_n"),
    ).where(F.col("_n") >= half)
    med = ratio.groupBy("week_of_year").agg(F.median(F.col("_u") / F.col("_ma") - 1).alias("_i"))
    centre = med.agg(F.avg("_i").alias("c")).scalar()
    return med.select("week_of_year", (F.col("_i") - centre).alias("seasonal_index"))


def week_no() -> Column:
    return F.weekofyear("week").alias("week_of_year")


def weekly_spine(panel: DataFrame, columns: Sequence[str], fill: str = "forward") -> DataFrame:
    """Every week between the first and last row of a series; gaps carried forward or zero."""
    span = panel.groupBy(*SERIES_KEYS).agg(F.min("week").alias("_a"), F.max("week").alias("_b"))
    spine = span.select(*SERIES_KEYS, F.explode(F.sequence("_a", "_b", F.expr("interval 7 days"))).alias("week"))
    j = spine.join(panel.select("week", *SERIES_KEYS, *columns), ["week", *SERIES_KEYS], "left")
    seen = F.col(columns[0]).isNotNull()
    if fill == "zero":
        return j.select("week", *SERIES_KEYS, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns],
                        (~seen).alias("is_filled"))
    carry = w.series().rowsBetween(Window.unboundedPreceding, 0)
    return j.select("week", *SERIES_KEYS,
                    *[F.last(c, ignorenulls=True).over(carry).alias(c) for c in columns],
                    (~seen).alias("is_filled"))


def change_points(panel: DataFrame, span: int = 8, threshold: float = 3.0, c: str = "base_units") -> DataFrame:
    """Weeks where the level shifts: two-sided mean-shift t, local maxima only."""
    before, after = w.prior_rows(span), w.series().rowsBetween(0, span - 1)
    pooled = F.sqrt(
        F.var_samp(c).over(before) / F.count(c).over(before)
        + F.var_samp(c).over(after) / F.count(c).over(after))
    full = (F.count(c).over(before) == span) & (F.count(c).over(after) == span)
    t = F.when(full & (pooled > 0), (F.avg(c).over(after) - F.avg(c).over(before)) / pooled)
    scored = panel.select("week", *SERIES_KEYS, t.alias("shift_t"))
    near = w.series().rowsBetween(-span // 2, span // 2)
    top = F.max(F.abs("shift_t")).over(near)
    return scored.withColumn("_top", top).where(
        (F.abs("shift_t") >= threshold) & (F.abs("shift_t") == F.col("_top"))).drop("_top")


# ---------------------------------------------------------------- decomposition and constraint


def tdp_velocity(panel: DataFrame, forecast: DataFrame | None = None, min_rows: int = 26,
                 full_rows: int = 65, floor: float = 0.1, noise: float = 5.0,
                 dominant: float = 0.60) -> DataFrame:
    """Split a change in units into reach and productivity (midpoint weights).

    History compares the newest 13 rows with those a year before, or the two ends of a short
    history. With a forecast the forward change uses reach moved along its 4-row momentum.
    """
    rb, n, win = F.col("rows_back"), F.col("_n"), F.least(F.lit(13), F.floor(F.col("_n") / 2))
    whole = Window.partitionBy(*SERIES_KEYS)
    t = F.greatest("tdp", F.lit(floor))
    rows = w.with_age(panel).select(
        "*", t.alias("_t"), (F.col("base_units") / t).alias("_v"),
        F.count(F.lit(1)).over(whole).alias("_n"),
        (F.col("tdp") - F.lag("tdp", 4).over(w.series())).alias("_mom"),
    ).where(n >= min_rows)
    now = rb <= win
    ago = F.when(n >= full_rows, rb.between(53, 65)).otherwise(rb > n - win)
    s = rows.groupBy(*SERIES_KEYS).agg(
        *[F.avg(F.when(cond, F.col(c))).alias(f"{a}_{b}")
          for b, cond in (("now", now), ("ago", ago))
          for a, c in (("t", "_t"), ("v", "_v"), ("u", "base_units"))],
        F.count(F.when(ago, 1)).alias("_na"),
        F.max(F.when(rb == 1, F.col("_mom"))).alias("_mom"),
    ).where(F.col("_na") >= 4)

    def parts(t1: Column, v1: Column, t0: Column, v0: Column) -> tuple[Column, Column]:
        return (t1 - t0) * (v1 + v0) / 2, (v1 - v0) * (t1 + t0) / 2

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(100 * F.try_divide(a, F.abs(a) + F.abs(b)), F.lit(0.0))

    ht, hv = parts(F.col("t_now"), F.col("v_now"), F.col("t_ago"), F.col("v_ago"))
    if forecast is None:
        s = s.select("*", F.lit(None).cast("double").alias("_fc"), F.lit(None).cast("double").alias("_anchor"))
    else:
        f = forecast.groupBy(*SERIES_KEYS).agg(
            F.avg("forecast_units_base").alias("_fc"), F.max("anchor_value").alias("_anchor"))
        s = s.join(f, SERIES_KEYS, "left")
    t_fwd = F.greatest(F.lit(floor), F.col("t_now") + 7 * F.coalesce("_mom", F.lit(0.0)) / 4)
    v_fwd = F.col("_fc") / t_fwd
    ft, fv = parts(t_fwd, v_fwd, F.col("t_now"), F.col("v_now"))
    s = s.select(
        "*", (F.col("u_now") - F.col("u_ago")).alias("hist_delta_units"),
        ht.alias("hist_tdp_contrib"), hv.alias("hist_vel_contrib"),
        F.coalesce(F.col("_fc") - F.coalesce("_anchor", "u_now"), F.lit(0.0)).alias("fwd_delta_units"),
        F.coalesce(ft, F.lit(0.0)).alias("fwd_tdp_contrib"),
        F.coalesce(fv, F.lit(0.0)).alias("fwd_vel_contrib"),
    )
    s = s.select(
        "*",
        share(F.col("hist_tdp_contrib"), F.col("hist_vel_contrib")).alias("hist_tdp_contrib_pct"),
        share(F.col("hist_vel_contrib"), F.col("hist_tdp_contrib")).alias("hist_vel_contrib_pct"),
        share(F.col("fwd_tdp_contrib"), F.col("fwd_vel_contrib")).alias("fwd_tdp_contrib_pct"),
        share(F.col("fwd_vel_contrib"), F.col("fwd_tdp_contrib")).alias("fwd_vel_contrib_pct"),
    )
    ahead = F.abs("fwd_delta_units") > noise
    d = F.when(ahead, F.col("fwd_delta_units")).otherwise(F.col("hist_delta_units"))
    pt = F.abs(F.when(ahead, F.col("fwd_tdp_contrib_pct")).otherwise(F.col("hist_tdp_contrib_pct")))
    pv = F.abs(F.when(ahead, F.col("fwd_vel_contrib_pct")).otherwise(F.col("hist_vel_contrib_pct")))
    lead = 100 * dominant
    driver = case(
        [
            (F.abs(d) <= noise, "STABLE"),
            ((d > 0) & (pt >= lead), "TDP_EXPANSION"), ((d > 0) & (pv >= lead), "VELOCITY_GROWTH"),
            (d > 0, "MIXED_GROWTH"),
            (pt >= lead, "DISTRIBUTION_LOSS"), (pv >= lead, "VELOCITY_EROSION"),
        ],
        "MIXED_DECLINE",
    )
    return s.select(
        *SERIES_KEYS, "hist_delta_units", "hist_tdp_contrib", "hist_vel_contrib",
        "hist_tdp_contrib_pct", "hist_vel_contrib_pct", "fwd_delta_units", "fwd_tdp_contrib",
        "fwd_vel_contrib", "fwd_tdp_contrib_pct", "fwd_vel_contrib_pct",
        driver.alias("growth_driver"),
        F.col("t_now").alias("hist_tdp_last13w_avg"), F.col("v_now").alias("hist_vel_last13w_avg"),
    )


def transfers(forecast: DataFrame, pairs: DataFrame, launch_window: int = k.LAUNCH_WINDOW) -> DataFrame:
    """Capped unit transfers from sibling donors to launching products, per forecast week.

    Claims on a donor are served by probability (ties by focal UPC) until 20 percent of its
    forecast is spent; a receiver then accepts by probability (ties by donor UPC) up to half of
    its own forecast. Both running sums are per product, market and week, so a group holds at
    most the own catalogue.
    """
    key = [*MARKET_KEYS, "forecast_week_number"]
    focal = forecast.where(
        (F.col("weeks_since_launch") <= launch_window)
        & (F.col("forecast_units_base") >= k.MIN_FOCAL_UNITS)
    ).select(
        F.col("upc").alias("focal_upc"), *key, F.col("forecast_units_base").alias("_f"),
        F.greatest(F.lit(0.0), 1 - F.col("weeks_since_launch") / launch_window).alias("_decay"))
    donor = forecast.where(F.col("forecast_units_base") > 0).select(
        F.col("upc").alias("donor_upc"), *key, F.col("forecast_units_base").alias("_d"))
    claims = pairs.where(F.col("transfer_prob") >= k.TRANSFER_MIN_PROB).select(
        "focal_upc", "donor_upc", *MARKET_KEYS, "transfer_prob").dropDuplicates(
        ["focal_upc", "donor_upc", *MARKET_KEYS])
    j = claims.join(focal, ["focal_upc", *MARKET_KEYS]).join(donor, ["donor_upc", *key]).withColumn(
        "_raw", F.col("transfer_prob") * F.col("_d") * F.col("_decay"))

    def capped(amount: str, cap: Column, group: str, tie: str) -> Column:
        run = F.sum(amount).over(
            Window.partitionBy(group, *key).orderBy(F.desc("transfer_prob"), tie).rowsBetween(
                Window.unboundedPreceding, 0))
        return F.least(F.col(amount), F.greatest(F.lit(0.0), cap - (run - F.col(amount))))

    j = j.withColumn("_given", capped("_raw", k.DONOR_CAP * F.col("_d"), "donor_upc", "focal_upc"))
    j = j.withColumn("transfer_units",
                     capped("_given", k.RECEIVER_CAP * F.col("_f"), "focal_upc", "donor_upc"))
    return j.where(F.col("transfer_units") > 1e-6).select(
        "focal_upc", "donor_upc", *key, "transfer_prob", "transfer_units")


def portfolio_constraint(forecast: DataFrame, pairs: DataFrame, launch_window: int = k.LAUNCH_WINDOW) -> DataFrame:
    """Move units from donors to launching products; the sum over the portfolio is unchanged."""
    key = ["upc", *MARKET_KEYS, "forecast_week_number"]
    moved = transfers(forecast, pairs, launch_window)
    side = moved.select(
        F.explode(F.array(
            F.struct(F.col("focal_upc").alias("upc"), F.col("transfer_units").alias("d"), F.lit("FOCAL_LAUNCH").alias("t")),
            F.struct(F.col("donor_upc").alias("upc"), (-F.col("transfer_units")).alias("d"), F.lit("DONOR").alias("t")),
        )).alias("s"), *MARKET_KEYS, "forecast_week_number",
    ).select("s.upc", *MARKET_KEYS, "forecast_week_number", "s.d", "s.t")
    net = side.groupBy(*key).agg(
        F.sum("d").alias("portfolio_adj_delta"),
        F.when(F.max("t") == F.min("t"), F.max("t")).otherwise("BOTH").alias("portfolio_adj_type"))
    return forecast.join(net, key, "left").select(
        *[c for c in forecast.columns if c != "forecast_units_base"],
        F.col("forecast_units_base").alias("forecast_units_raw"),
        (F.col("forecast_units_base") + F.coalesce("portfolio_adj_delta", F.lit(0.0))).alias(
            "forecast_units_base"),
        F.coalesce("portfolio_adj_delta", F.lit(0.0)).alias("portfolio_adj_delta"),
        F.coalesce("portfolio_adj_type", F.lit("NONE")).alias("portfolio_adj_type"),
    )


def portfolio_summary(adjusted: DataFrame) -> DataFrame:
    """13-week totals of each series before and after the constraint."""
    s = adjusted.groupBy(*SERIES_KEYS).agg(
        F.sum("forecast_units_raw").alias("raw_13w_units"),
        F.sum("forecast_units_base").alias("adj_13w_units"),
        F.sum("portfolio_adj_delta").alias("total_adj_delta"),
        F.min("weeks_since_launch").alias("wsl_anchor"),
        F.max(F.when(F.col("portfolio_adj_type") != "NONE", F.col("portfolio_adj_type"))).alias("_t"),
    )
    return s.select(
        *SERIES_KEYS, "raw_13w_units", "adj_13w_units", "total_adj_delta", "wsl_anchor",
        F.coalesce("_t", F.lit("NONE")).alias("portfolio_adj_type"),
        (100 * F.col("total_adj_delta") / F.greatest("raw_13w_units", F.lit(0.01))).alias("adj_pct"))


# ---------------------------------------------------------------- scenarios


def scenario_totals(forecast: DataFrame, actual: DataFrame | None = None) -> DataFrame:
    """13-week totals per quantile in units and revenue, band width and coverage."""
    f = forecast
    q = {"p10": "forecast_units_low", "p50": "forecast_units_base", "p90": "forecast_units_high"}
    aggs = [F.sum(c).alias(f"{n}_units_total") for n, c in q.items()]
    aggs.append((100 * F.avg((F.col(q["p90"]) - F.col(q["p10"])) / F.greatest(q["p50"], F.lit(1.0)))).alias("interval_width_pct"))
    if actual is not None:
        f = f.join(actual.select("week", *SERIES_KEYS, F.col("base_units").alias("_a")), ["week", *SERIES_KEYS], "left")
        aggs.append(F.avg(F.when(F.col("_a").isNotNull(), F.col("_a").between(F.col(q["p10"]), F.col(q["p90"])).cast("double"))).alias("coverage_rate"))
    s = f.groupBy(*SERIES_KEYS).agg(*aggs, F.avg("arp").alias("_arp"))
    return s.select(*[c for c in s.columns if c != "_arp"],
                    *[(F.col(f"{n}_units_total") * F.col("_arp")).alias(f"{n}_rev_total") for n in q])


#: Planning scenarios (id, reach change, price change, promo depth).
PLANNING = [("expand_reach", 0.10, 0.0, 0.0), ("price_cut", 0.0, -0.05, 0.0),
            ("promo", 0.0, 0.0, 0.15), ("hold", 0.0, 0.0, 0.0)]


def scenario_records(forecast: DataFrame, rates: DataFrame, elasticity: float = -1.0,
                     lift_per_depth: float = 1.5) -> DataFrame:
    """Focal gain, donor loss and net result of planning scenarios per series.

    `rates`: series keys and cannibalization_rate (share of the focal gain taken from donors).
    """
    totals = forecast.groupBy(*SERIES_KEYS).agg(
        *[F.sum(f"forecast_units_{q}").alias(q) for q in ("low", "base", "high")])
    scen = F.explode(F.array(*[
        F.struct(F.lit(i).alias("id"), F.lit(t).alias("tdp"), F.lit(p).alias("price"), F.lit(d).alias("promo"))
        for i, t, p, d in PLANNING]))
    j = totals.join(rates, SERIES_KEYS, "left").select("*", scen.alias("s"))
    factor = (1 + F.col("s.tdp")) * (1 + elasticity * F.col("s.price")) * (1 + lift_per_depth * F.col("s.promo"))
    rate = F.coalesce("cannibalization_rate", F.lit(0.0))
    out = j.select("*", factor.alias("_x"), rate.alias("_r"))
    cols = []
    for q, n in (("low", "low"), ("base", "mid"), ("high", "high")):
        gain = F.col(q) * (F.col("_x") - 1)
        cols += [(F.col(q) * F.col("_x")).alias(f"forecast_focal_units_{n}"),
                 (F.greatest(gain, F.lit(0.0)) * F.col("_r")).alias(f"forecast_donor_units_loss_{n}"),
                 (gain - F.greatest(gain, F.lit(0.0)) * F.col("_r")).alias(f"forecast_net_incremental_units_{n}")]
    return out.select(
        F.col("s.id").alias("scenario_id"), *SERIES_KEYS, F.col("s.tdp").alias("scenario_tdp_change"),
        F.col("s.price").alias("scenario_price_change"), F.col("s.promo").alias("scenario_promo_depth"),
        *cols, (1 - F.col("_r")).alias("forecast_incremental_share"))


def donor_exposure(pairs: DataFrame, assoc: DataFrame) -> DataFrame:
    """How exposed each donor is under a scenario, and its attribution weight per focal."""
    a = assoc.select("focal_upc", F.col("comparison_upc").alias("donor_upc"), *MARKET_KEYS,
                     "opposition_rate", "co_win_rate")
    closeness = 1 / F.col("relationship_distance")
    price = 1 / (1 + F.abs(F.col("focal_price_per_unit") - F.col("donor_price_per_unit")))
    score = (
        0.4 * closeness + 0.2 * F.coalesce(price, F.lit(0.0))
        + 0.3 * F.coalesce("opposition_rate", F.lit(0.0))
        + 0.1 * (1 - F.coalesce("co_win_rate", F.lit(0.0)))
    )
    s = pairs.join(a, ["focal_upc", "donor_upc", *MARKET_KEYS], "left").withColumn("exposure_score", score)
    focal = Window.partitionBy("focal_upc", *MARKET_KEYS)
    return s.select(
        "focal_upc", "donor_upc", *MARKET_KEYS, "exposure_score",
        safe_div("exposure_score", F.sum("exposure_score").over(focal)).alias("donor_attribution_weight"),
        F.row_number().over(focal.orderBy(F.desc("exposure_score"), "donor_upc")).alias("donor_rank"))


def rank_markets(scenarios: DataFrame) -> DataFrame:
    """Markets of a product by expected net units under each scenario."""
    m = scenarios.groupBy("scenario_id", "upc", *MARKET_KEYS).agg(
        F.sum("forecast_net_incremental_units_mid").alias("net_units"))
    order = Window.partitionBy("scenario_id", "upc").orderBy(F.desc("net_units"), *MARKET_KEYS)
    act = case([(F.col("net_units") > 0, "EXPAND"), (F.col("net_units") < 0, "HOLD")], "NEEDS_DATA")
    return m.select("*", F.row_number().over(order).alias("market_rank"), act.alias("recommended_action"))
