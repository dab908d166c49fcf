"""Control selection, event impact, synthetic control and difference in differences (group M)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfwise.functions.scalar import case, flag, safe_div
from shelfwise.functions.stats import normal_sf2, student_sf2
from shelfwise.operators.windows import day_number
from shelfwise.scale import MAX_BROADCAST_ROWS, durable, growing, written
from shelfwise.schema import SERIES_KEYS

EVENT_KEYS = [*SERIES_KEYS, "event_week"]

#: Correlation floors and price tolerances of the sensitivity grid; the middle one is
#: the baseline.
PEARSON_GRID = (0.30, 0.40, 0.50)
PRICE_GRID = (0.10, 0.05, 0.03)
BASELINE = (0.40, 0.05)
SENSITIVITY = [(a, b) for a in PEARSON_GRID for b in PRICE_GRID]
TOP_CONTROLS = 3

#: Controls and events that meet in one task at a time, and pairs where all of them are returned.
TILE_CONTROLS, TILE_EVENTS, TILE_PAIRS = 512, 8192, 512 * 512


def price_event_windows(windows: DataFrame, min_move: float = 0.05) -> DataFrame:
    """Largest price move per series as an event: its week, move and window lengths."""
    moved = windows.where(F.abs("price_pct_chg") >= min_move)
    order = Window.partitionBy(*SERIES_KEYS).orderBy(F.desc(F.abs("price_pct_chg")), "week")
    return moved.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(
        *SERIES_KEYS, F.col("week").alias("event_week"), "price_pct_chg",
        F.col("pre_13w_weeks_count").cast("int").alias("pre_weeks"),
        F.col("post_13w_weeks_count").cast("int").alias("post_weeks"))


def _week_series(panel: DataFrame) -> DataFrame:
    """Units and price of a series by day number; one entry per week, so bounded by the calendar."""
    values = F.struct(F.col("base_units").cast("double").alias("u"), F.col("arp").cast("double").alias("p"))
    return panel.groupBy(*SERIES_KEYS).agg(
        F.map_from_entries(F.collect_list(F.struct(day_number().alias("d"), values.alias("v")))).alias("_weeks"))


def _at(m: str | Column, days: Column) -> Column:
    """Values of a week map at an array of days (NULL where absent)."""
    m = F.col(m) if isinstance(m, str) else m
    return F.transform(days, lambda d: F.try_element_at(m, d))


def _moments(xs: Column, ys: Column) -> Column:
    """n, means and centred sums of the positions where both arrays have a value."""
    pairs = F.filter(F.arrays_zip(xs.alias("x"), ys.alias("y")), lambda p: p["x"].isNotNull() & p["y"].isNotNull())

    def total(arr: Column, f) -> Column:
        return F.aggregate(arr, F.lit(0.0), lambda a, p: a + f(p))

    def let(v: Column, body) -> Column:
        return F.element_at(F.transform(F.array(v), body), 1)

    def with_means(s: Column) -> Column:
        return F.struct(
            F.size(s["pairs"]).alias("n"), s["mx"].alias("mx"), s["my"].alias("my"),
            total(s["pairs"], lambda p: (p["x"] - s["mx"]) * (p["x"] - s["mx"])).alias("sxx"),
            total(s["pairs"], lambda p: (p["y"] - s["my"]) * (p["y"] - s["my"])).alias("syy"),
            total(s["pairs"], lambda p: (p["x"] - s["mx"]) * (p["y"] - s["my"])).alias("sxy"))

    means = let(pairs, lambda ps: F.struct(
        ps.alias("pairs"),
        F.try_divide(total(ps, lambda p: p["x"]), F.size(ps)).alias("mx"),
        F.try_divide(total(ps, lambda p: p["y"]), F.size(ps)).alias("my")))
    return let(means, with_means)


def _price_drift(prices: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Relative change from the first to the last known price of each column."""
    each, last = np.arange(prices.shape[1]), len(prices) - 1
    a = prices[known.argmax(axis=0), each]
    b = prices[last - known[::-1].argmax(axis=0), each]
    return np.abs((b - a) / np.maximum(a, 0.01))


def _correlations(x: np.ndarray, ys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlation of `x` with each column of `ys` where it is known, and whether there is one.

    Adds row by row, as the fold over a week array does, so the sums are the same to the last bit.
    """
    n = known.sum(axis=0)

    def total(terms: np.ndarray) -> np.ndarray:
        out = np.zeros(terms.shape[1])
        for row in terms:
            out += row
        return out

    with np.errstate(all="ignore"):
        dx = np.where(known, x[:, None] - total(np.where(known, x[:, None], 0.0)) / n, 0.0)
        dy = np.where(known, ys - total(np.where(known, ys, 0.0)) / n, 0.0)
        spread = np.sqrt(total(dx * dx) * total(dy * dy))
        return total(dx * dy) / spread, spread != 0


def _judge(events: pa.Table, controls: pa.Table, min_weeks: int, rules: Sequence[tuple[float, float]] | None, top: int):
    """Pairs of one tile: positions in `events` and `controls`, correlation, drift, control units before and after."""
    account, geography = (controls[c].to_pylist() for c in ("control_account", "control_geography"))
    order = sorted(range(len(account)), key=lambda i: (account[i], geography[i] is not None, geography[i] or ""))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    days = controls["_days"].combine_chunks()
    calendar, day = np.unique(days.flatten().to_numpy(), return_inverse=True)
    rows = {d: i for i, d in enumerate(calendar.tolist())}
    series = np.repeat(place, days.value_lengths().to_numpy())

    def grid(name: str) -> tuple[np.ndarray, np.ndarray]:
        """Values by day and series and where there are any; the last row stands for days that no series has."""
        flat = controls[name].combine_chunks().flatten()
        values, known = np.zeros((len(rows) + 1, len(order))), np.zeros((len(rows) + 1, len(order)), dtype=bool)
        known[day, series] = flat.is_valid().to_numpy(zero_copy_only=False)
        values[day, series] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
        return values, known

    (units, units_known), (prices, prices_known) = grid("_units"), grid("_prices")
    codes = {a: i for i, a in enumerate(dict.fromkeys(account))}
    code = np.array([codes[account[i]] for i in order])
    # the least correlation by price tolerance: what another rule of the same tolerance takes comes first here too
    floors = {} if rules is None else {t: min(r for r, u in rules if u == t) for _, t in rules}

    wanted = list(zip(*(events[c].to_pylist() for c in ("_pre", "_post", "_y0", "retail_account"))))
    window, found = None, []
    for i in sorted(range(len(wanted)), key=lambda i: wanted[i][:2]):
        pre, post, y, own = wanted[i]
        if (pre, post) != window:
            # events of one window share the drift of the controls, which has nothing to do with the focal
            window = (pre, post)
            before, after = ([rows.get(d, -1) for d in w] for w in window)
            drift = _price_drift(prices[before + after], prices_known[before + after])
            usable = prices_known[before + after].sum(axis=0) >= 2
            if rules is not None:
                usable &= drift < max(floors)
            usable = np.flatnonzero(usable)
            near, near_known = units[before][:, usable], units_known[before][:, usable]
        seen = [k for k, v in enumerate(y) if v is not None]
        if len(seen) < min_weeks or not len(usable):
            continue
        at = np.flatnonzero((near_known[seen].sum(axis=0) >= min_weeks) & (code[usable] != codes.get(own, -1)))
        if not len(at):
            continue
        r, has = _correlations(np.array([y[k] for k in seen], dtype=float), near[seen][:, at], near_known[seen][:, at])
        moved = drift[usable[at]]
        if rules is None:
            kept = np.arange(len(at))
        else:
            # Spark orders NaN above all numbers; ties go by account and geography, the order of the columns
            ranked = np.argsort(-np.where(np.isnan(r), np.inf, r), kind="stable")
            ranked = ranked[has[ranked]]
            kept = np.unique(np.concatenate(
                [ranked[(moved[ranked] < t) & ~(r[ranked] < floor)][:top] for t, floor in floors.items()]))
        if len(kept):
            c = usable[at[kept]]
            found.append((np.full(len(c), i), np.array(order)[c], r[kept], has[kept], moved[kept],
                          *((units[w][:, c], units_known[w][:, c]) for w in (before, after))))
    return found


def _values(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    """One list per column of each part, in order."""
    lengths = np.concatenate([np.full(v.shape[1], v.shape[0]) for v, _ in parts])
    values = pa.array(np.concatenate([v.T.ravel() for v, _ in parts]), mask=~np.concatenate([k.T.ravel() for _, k in parts]))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), values)


def control_pairs(panel: DataFrame, events: DataFrame, min_weeks: int = 8,
                  rules: Sequence[tuple[float, float]] | None = None, top: int = TOP_CONTROLS) -> DataFrame:
    """M1: every usable control of an event with its pre-period correlation and price drift.

    Controls sell the same product in the same channel at another account. All pairs of a product
    and channel are judged, in tiles of bounded size: a tile holds the weeks of some controls as
    arrays and passes each of its events over all of them at once. Of the focal only the weeks of
    the event's window travel.

    `rules` lists correlation floors and price tolerances of a choice that follows. Then a tile
    returns the `top` controls of an event by each rule, in the order of `select_controls`; no
    other pair can be chosen. Without them all usable pairs are returned.
    """
    weeks = written(_week_series(panel))
    end = day_number("event_week")
    post_start = end - 7 * F.col("post_weeks")
    pre_start = post_start - 7 - 7 * F.col("pre_weeks")
    seen = lambda days: F.transform(_at("_weeks", F.col(days)), lambda v: v["u"])
    focal = written(
        growing(events).join(growing(weeks), SERIES_KEYS).select(
            *EVENT_KEYS, "price_pct_chg", "_weeks",
            F.sequence(pre_start, post_start - 7, F.lit(7)).alias("_pre"),
            F.sequence(post_start, end, F.lit(7)).alias("_post"))
        .select(*EVENT_KEYS, "price_pct_chg", "_pre", "_post", seen("_pre").alias("_y0"), seen("_post").alias("_y1"))
        # a pair has at most the focal's own weeks
        .where(F.size(F.filter("_y0", lambda v: v.isNotNull())) >= min_weeks))
    cand = weeks.select(
        "upc", "channel_outlet", F.col("retail_account").alias("control_account"),
        F.col("geography_raw").alias("control_geography"), F.map_keys("_weeks").alias("_days"),
        F.map_values("_weeks")["u"].alias("_units"), F.map_values("_weeks")["p"].alias("_prices"),
    ).where(F.col("control_account").isNotNull())
    group = ["upc", "channel_outlet"]
    per_tile = TILE_PAIRS if rules is None else TILE_EVENTS * TILE_CONTROLS
    many = lambda df, size: df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_n"))
    # one row for each product and channel with an event
    tiles = written(many(focal, per_tile // TILE_CONTROLS).withColumnRenamed("_n", "_events").join(
        many(cand, TILE_CONTROLS).withColumnRenamed("_n", "_controls"), group))
    tiles = F.broadcast(tiles) if tiles.count() <= MAX_BROADCAST_ROWS else growing(tiles)
    deal = [*group, "_e", "_c"]
    n_tasks = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, own: str, n_own: str, other: str, n_other: str, by: Sequence[str]) -> DataFrame:
        """Each row once for every tile of the other side. Tiles cost time, not bytes: their tasks are never merged."""
        return df.join(tiles, group).withColumn(own, F.pmod(F.xxhash64(*by), n_own).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop("_events", "_controls").repartition(n_tasks, *deal)

    left = dealt(focal, "_e", "_events", "_c", "_controls", ["retail_account", "geography_raw", "event_week"])
    right = dealt(cand, "_c", "_controls", "_e", "_events", ["control_account", "control_geography"])
    lists = T.ArrayType(T.DoubleType())
    own = [*EVENT_KEYS, "price_pct_chg"]
    out = T.StructType([focal.schema[c] for c in own] + [
        T.StructField("control_account", T.StringType()), T.StructField("control_geography", T.StringType()),
        T.StructField("pre_corr", T.DoubleType()), T.StructField("control_price_drift", T.DoubleType()),
        *[T.StructField(c, lists) for c in ("_y0", "_y1", "_c0", "_c1")]])
    arrow = to_arrow_schema(out)

    def judge(events: pa.Table, controls: pa.Table) -> pa.Table:
        found = _judge(events, controls, min_weeks, rules, top) if events.num_rows and controls.num_rows else []
        if not found:
            return arrow.empty_table()
        e, c, r, has, drift, before, after = zip(*found)
        mine, theirs = events.take(np.concatenate(e)), controls.take(np.concatenate(c))
        columns = {n: mine[n] for n in (*own, "_y0", "_y1")} | {n: theirs[n] for n in ("control_account", "control_geography")}
        columns |= {"pre_corr": pa.array(np.concatenate(r), mask=~np.concatenate(has)),
                    "control_price_drift": pa.array(np.concatenate(drift)), "_c0": _values(before), "_c1": _values(after)}
        return pa.table({n: columns[n] for n in arrow.names}).cast(arrow)

    return left.groupBy(*deal).cogroup(right.groupBy(*deal)).applyInArrow(judge, out)


def select_controls(pairs: DataFrame, pearson: float = BASELINE[0], price_tol: float = BASELINE[1], top: int = TOP_CONTROLS) -> DataFrame:
    """M1: the best-correlated controls with a stable price."""
    ok = pairs.where((F.col("pre_corr") >= pearson) & (F.col("control_price_drift") < price_tol))
    order = Window.partitionBy(*EVENT_KEYS).orderBy(F.desc("pre_corr"), "control_account", "control_geography")
    return ok.withColumn("control_rank", F.row_number().over(order)).where(F.col("control_rank") <= top)


def _impact(chosen: DataFrame, keys: Sequence[str], min_pre: int, min_post: int) -> DataFrame:
    """Counterfactual from the pre-period regression on the mean of the chosen controls."""
    g = chosen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_control_series"),
        F.array_join(F.sort_array(F.collect_list("control_account")), "|").alias("control_accounts"),
        F.collect_list("_c0").alias("_c0s"), F.collect_list("_c1").alias("_c1s"), F.first("_y0").alias("_y0"),
        F.first("_y1").alias("_y1"), F.first("price_pct_chg").alias("price_pct_chg"))

    def mean_of(lists: str) -> Column:
        def one(_, i: Column) -> Column:
            vals = F.transform(lists, lambda v: F.get(v, i))
            whole = F.forall(vals, lambda v: v.isNotNull())
            return F.when(whole, F.aggregate(vals, F.lit(0.0), lambda a, v: a + v) / F.size(vals))

        # the lists of an event have an entry for each week of its window
        return F.transform(F.get(lists, F.lit(0)), one)

    g = g.select("*", mean_of("_c0s").alias("_c0"), mean_of("_c1s").alias("_c1"))
    g = g.withColumn("_m", _moments(F.col("_c0"), F.col("_y0")))
    slope = F.coalesce(safe_div("_m.sxy", "_m.sxx"), F.lit(0.0))
    g = g.select("*", slope.alias("_b"))
    post = F.filter(F.arrays_zip(F.col("_c1").alias("x"), F.col("_y1").alias("y")),
                    lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    g = g.withColumn("_post_pairs", post)
    pred = F.aggregate("_post_pairs", F.lit(0.0), lambda a, p: a + F.col("_m.my") + F.col("_b") * (p["x"] - F.col("_m.mx")))
    seen = F.aggregate("_post_pairs", F.lit(0.0), lambda a, p: a + p["y"])
    shift = F.aggregate("_post_pairs", F.lit(0.0), lambda a, p: a + p["x"] - F.col("_m.mx"))
    n0, n1 = F.col("_m.n"), F.size("_post_pairs")
    g = g.select(
        *keys, "price_pct_chg", "n_control_series", "control_accounts", n0.alias("pre_weeks_used"),
        n1.alias("post_weeks_used"), seen.alias("_a"), pred.alias("_p"), shift.alias("_sh"),
        F.greatest(F.col("_m.syy") - F.col("_b") * F.col("_m.sxy"), F.lit(0.0)).alias("_rss"),
        F.col("_m.sxx").alias("_sxx"),
    ).where((F.col("pre_weeks_used") >= min_pre) & (F.col("post_weeks_used") >= min_post))
    s2 = F.col("_rss") / F.greatest(F.col("pre_weeks_used") - 2, F.lit(1))
    n1 = F.col("post_weeks_used")
    # noise of the post weeks plus that of the fitted level and slope
    var = s2 * (n1 + n1 * n1 / F.col("pre_weeks_used") + F.coalesce(safe_div(F.col("_sh") * F.col("_sh"), "_sxx"), F.lit(0.0)))
    effect = F.col("_a") - F.col("_p")
    g = g.select("*", effect.alias("impact_units"), F.sqrt(var).alias("_se"))
    p = F.when(F.col("_se") > 0, normal_sf2(F.col("impact_units") / F.col("_se"))).otherwise(1.0)
    g = g.withColumn("p_value", p)
    return g.select(
        *keys, "price_pct_chg", "n_control_series", "control_accounts", "pre_weeks_used", "post_weeks_used",
        (100 * F.col("impact_units") / F.greatest(F.abs("_p"), F.lit(1.0))).alias("causal_impact_pct"),
        "impact_units", (F.col("impact_units") - 1.96 * F.col("_se")).alias("impact_low"),
        (F.col("impact_units") + 1.96 * F.col("_se")).alias("impact_high"), "p_value",
        case([(F.col("p_value") < 0.05, "SIGNIFICANT"), (F.col("p_value") < 0.10, "MARGINAL")], "INCONCLUSIVE").alias("causal_verdict"),
    )


def event_impact(pairs: DataFrame, pearson: float = BASELINE[0], price_tol: float = BASELINE[1],
                 min_pre: int = 8, min_post: int = 4) -> DataFrame:
    """M2: effect of a price event against its controls, with interval and verdict."""
    return _impact(select_controls(pairs, pearson, price_tol), EVENT_KEYS, min_pre, min_post)


def impact_sensitivity(pairs: DataFrame, min_pre: int = 8, min_post: int = 4, top: int = TOP_CONTROLS) -> DataFrame:
    """M3: the nine control rules at once; how often the baseline finding holds, in words.

    Pairs are judged once; the grid is a column of the same frame.
    """
    grid = SENSITIVITY
    variants = F.explode(F.array(*[
        F.struct(F.lit(i).alias("variant"), F.lit(a).alias("pearson"), F.lit(b).alias("tol"))
        for i, (a, b) in enumerate(grid)]))
    v = pairs.select("*", variants.alias("_v")).where(
        (F.col("pre_corr") >= F.col("_v.pearson")) & (F.col("control_price_drift") < F.col("_v.tol"))
    ).withColumn("variant", F.col("_v.variant"))
    keys = [*EVENT_KEYS, "variant"]
    order = Window.partitionBy(*keys).orderBy(F.desc("pre_corr"), "control_account", "control_geography")
    v = v.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    each = _impact(v, keys, min_pre, min_post)
    base = F.max(F.when(F.col("variant") == grid.index(BASELINE), F.col("causal_impact_pct")))
    detail = F.sort_array(F.collect_list(F.struct("variant", "causal_impact_pct", "p_value", "causal_verdict")))
    s = each.groupBy(*EVENT_KEYS).agg(
        F.max("price_pct_chg").alias("price_pct_chg"), base.alias("causal_impact_pct"),
        F.count(F.lit(1)).alias("n_variants_run"), detail.alias("_detail"),
        F.max(F.when(F.col("variant") == grid.index(BASELINE), F.col("n_control_series"))).alias("n_control_series"))
    s = s.where(F.col("causal_impact_pct").isNotNull())
    sign = F.signum("causal_impact_pct")
    score = F.size(F.filter("_detail", lambda d: (d["causal_verdict"] == "SIGNIFICANT") & (F.signum(d["causal_impact_pct"]) == sign)))
    s = s.withColumn("stability_score", score)
    opposed = F.signum("price_pct_chg") * sign < 0
    move = F.concat(F.format_string("%+.1f", F.col("price_pct_chg") * 100), F.lit("% price "),
                    F.when(F.col("price_pct_chg") < 0, "cut").otherwise("increase"))
    held = case(
        [(F.col("stability_score") == F.col("n_variants_run"),
          F.concat(F.lit("The result held in all "), F.col("n_variants_run").cast("string"), F.lit(" runnable tests."))),
         (F.col("stability_score") == 0,
          F.concat(F.lit("The result did not hold in any of the "), F.col("n_variants_run").cast("string"), F.lit(" runnable tests.")))],
        F.concat(F.lit("The result held in "), F.col("stability_score").cast("string"), F.lit(" of "),
                 F.col("n_variants_run").cast("string"), F.lit(" runnable tests.")))
    odd = F.when(opposed, F.lit("")).otherwise(" Note: price and demand moved the same way; look for another cause first.")
    return s.select(
        *EVENT_KEYS, "price_pct_chg", "causal_impact_pct", "stability_score", "n_variants_run",
        case([(F.col("stability_score") >= 7, "ROBUST"), (F.col("stability_score") >= 4, "MODERATE")], "FRAGILE").alias("robust_verdict"),
        opposed.alias("direction_consistent"),
        F.concat(F.col("upc"), F.lit(" at "), F.col("retail_account"), F.lit(": "), move, F.lit(" → estimated "),
                 F.format_string("%+.1f", "causal_impact_pct"), F.lit("% demand (based on "),
                 F.col("n_control_series").cast("string"), F.lit(" comparison accounts). "), held, odd).alias("narrative"),
        F.to_json("_detail").alias("variant_detail"),
    )


# ---------------------------------------------------------------- one treated series


def treated_panel(panel: DataFrame, treated: dict[str, str], pre_start: date, intervention: date, post_end: date) -> tuple[DataFrame, DataFrame]:
    """Weekly units of the treated selection, and the weekly rows of all other series."""
    inside = panel.where((F.col("week") >= F.lit(pre_start)) & (F.col("week") <= F.lit(post_end)))
    mine = F.lit(True)
    for c, v in treated.items():
        mine = mine & (F.col(c) == v)
    focal = inside.where(mine).groupBy("week").agg(F.sum("base_units").alias("y"))
    return focal.withColumn("post", flag(F.col("week") >= F.lit(intervention))), inside.where(~mine)


def donor_pool(others: DataFrame, focal: DataFrame, min_coverage: float = 0.75, max_price_cv: float = 0.08,
               min_corr: float = 0.4, min_donors: int = 5, top: int = 30) -> DataFrame:
    """M4: series that cover the pre-period with a stable price and move with the treated series.

    When fewer than `min_donors` correlate, the `top` largest by pre-period units are used.
    """
    pre = focal.where("post = 0")
    n_pre = pre.agg(F.count(F.lit(1)).alias("n")).scalar()
    # weeks of the pre-period: one row each
    j = others.join(F.broadcast(pre.select("week", "y")), "week")
    s = j.groupBy(*SERIES_KEYS).agg(
        F.count(F.lit(1)).alias("n_weeks"), F.sum("base_units").alias("pre_units"),
        safe_div(F.stddev_samp("arp"), F.avg("arp")).alias("price_cv"),
        F.try_divide(F.covar_samp("base_units", "y"), F.stddev_samp("base_units") * F.stddev_samp("y")).alias("pre_corr"),
    ).withColumn("_need", n_pre).where(
        (F.col("n_weeks") >= F.floor(F.col("_need") * min_coverage)) & (F.col("pre_units") > 0)
        & ((F.col("n_weeks") <= 3) | F.coalesce(F.col("price_cv") <= max_price_cv, F.lit(True)))).drop("_need")
    good = s.agg(F.count_if(F.col("pre_corr") > min_corr).alias("c")).scalar()
    largest = s.orderBy(F.desc("pre_units"), *SERIES_KEYS).limit(top).select(*SERIES_KEYS, F.lit(True).alias("_big"))
    return s.join(largest, SERIES_KEYS, "left").withColumn("_good", good).where(
        F.when(F.col("_good") >= min_donors, F.col("pre_corr") > min_corr).otherwise(F.coalesce("_big", F.lit(False)))
    ).select(*SERIES_KEYS, "n_weeks", "pre_units", "price_cv", "pre_corr")


def simplex_weights(x: np.ndarray, y: np.ndarray, start: np.ndarray, gap: float) -> np.ndarray:
    """Weights (at least 0, sum 1) of the rows of `x` that come closest to `y`.

    Weight moves from the worst row that has some to the best one, until that gains less than `gap`.
    """
    weight = start.copy()
    while True:
        slope = x @ (weight @ x - y)
        held = np.flatnonzero(weight)
        to, source = int(slope.argmin()), int(held[slope[held].argmax()])
        if slope[source] - slope[to] <= gap:
            return weight
        d = x[to] - x[source]
        move = min(weight[source], (slope[source] - slope[to]) / float(d @ d))
        rest = weight[source] - move
        if move <= 0 or weight[to] + move == weight[to]:  # no progress left in doubles
            return weight
        weight[to], weight[source] = weight[to] + move, max(rest, 0.0)


def synthetic_control(others: DataFrame, focal: DataFrame, donors: DataFrame, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """M5: donor weights on the simplex and the lift against the weighted donors.

    Every step scores all donors in parallel against the current residual, adds the best one and
    fits the weights of those chosen so far anew. It ends when no donor is left that could lower
    the squared pre-period error by more than `tolerance` of the squared series. The driver holds
    one number per pre-period week for the chosen donors, about as many as weigh something; the
    donor matrix stays distributed.
    """
    pre = [(r.week, float(r.y)) for r in focal.where("post = 0").orderBy("week").collect()]
    weeks, y = [w for w, _ in pre], [v for _, v in pre]
    chosen = others.join(donors.select(*SERIES_KEYS), SERIES_KEYS, "left_semi")
    by_week = chosen.where(F.col("week").isin(weeks)).groupBy(*SERIES_KEYS).agg(
        F.map_from_entries(F.collect_list(F.struct("week", F.col("base_units").cast("double").alias("u")))).alias("m"))
    x = F.array(*[F.coalesce(F.try_element_at("m", F.lit(d)), F.lit(0.0)) for d in weeks])
    matrix = durable(by_week.select(*SERIES_KEYS, x.alias("x")))
    goal = np.array(y)
    limit = tolerance * max(float(goal @ goal), 1.0)
    synth, weights, rows = np.zeros(len(y)), {}, np.zeros((0, len(y)))
    while True:
        resid = [float(v) for v in synth - goal]
        grad = F.aggregate(
            F.zip_with("x", F.array(*[F.lit(r) for r in resid]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        best = matrix.select(*SERIES_KEYS, "x", grad.alias("g")).agg(
            F.min_by(F.struct(*SERIES_KEYS, "x"), F.struct("g", *SERIES_KEYS)).alias("b")).first().b
        if best is None:
            break
        key, x_best = tuple(best[c] for c in SERIES_KEYS), np.array(best.x)
        if key in weights or (weights and float((synth - x_best) @ (synth - goal)) <= limit):
            break
        rows = np.vstack([rows, x_best])
        start = np.array([*weights.values(), 0.0 if weights else 1.0])
        fitted = simplex_weights(rows, goal, start, limit / 10)
        used = np.flatnonzero(fitted)
        weights = {k: float(fitted[i]) for i, k in enumerate([*weights, key]) if fitted[i]}
        rows = rows[used]
        synth = fitted[used] @ rows
    spark = others.sparkSession
    w = spark.createDataFrame(
        [(*key, wt) for key, wt in weights.items()], ", ".join(f"{c} string" for c in SERIES_KEYS) + ", weight double")
    weekly = others.join(F.broadcast(w), SERIES_KEYS).groupBy("week").agg(
        F.sum(F.col("weight") * F.col("base_units")).alias("synthetic"))
    j = focal.join(weekly, "week", "left").withColumn("synthetic", F.coalesce("synthetic", F.lit(0.0)))
    lift = j.agg(
        F.sum(F.when(F.col("post") == 1, F.col("y"))).alias("actual_units"),
        F.sum(F.when(F.col("post") == 1, F.col("synthetic"))).alias("counterfactual_units"),
        F.sqrt(F.avg(F.when(F.col("post") == 0, (F.col("y") - F.col("synthetic")) ** 2))).alias("pre_rmse"),
        F.count_if(F.col("post") == 1).alias("n_post_weeks"))
    incr = F.col("actual_units") - F.col("counterfactual_units")
    return w, lift.select("*", incr.alias("incremental_units"),
                          (100 * incr / (F.col("counterfactual_units") + 1e-9)).alias("pct_lift"))


def did(focal: DataFrame, control: DataFrame) -> DataFrame:
    """M6: two-by-two difference in differences with the pooled standard error and pre-trends.

    Both inputs: week, y, post. One result row.
    """
    rows = focal.select("week", "y", "post", F.lit(1).alias("t")).unionByName(
        control.select("week", "y", "post", F.lit(0).alias("t")))
    x = F.datediff("week", F.lit("1970-01-05").cast("date")) / 7.0
    aggs = []
    for t, name in ((1, "treated"), (0, "control")):
        for p, side in ((0, "pre"), (1, "post")):
            v = F.when((F.col("t") == t) & (F.col("post") == p), F.col("y"))
            aggs += [F.avg(v).alias(f"{name}_{side}"), F.count(v).alias(f"_n{t}{p}"), (F.var_pop(v) * F.count(v)).alias(f"_s{t}{p}")]
        v = F.when((F.col("t") == t) & (F.col("post") == 0), F.col("y"))
        aggs.append(F.regr_slope(v, x).alias(f"{name}_pre_slope"))
    s = rows.agg(*aggs)
    cells = ["11", "10", "01", "00"]
    n = sum((F.col(f"_n{c}") for c in cells), F.lit(0))
    sse = sum((F.col(f"_s{c}") for c in cells), F.lit(0.0))
    inv = sum((1 / F.col(f"_n{c}") for c in cells), F.lit(0.0))
    est = (F.col("treated_post") - F.col("treated_pre")) - (F.col("control_post") - F.col("control_pre"))
    s = s.select("*", est.alias("did_estimate"), F.sqrt(sse / (n - 4) * inv).alias("did_se"), (n - 4).cast("double").alias("_df"))
    return s.select(
        "treated_pre", "treated_post", "control_pre", "control_post", "did_estimate", "did_se",
        student_sf2(F.col("did_estimate") / F.col("did_se"), "_df").alias("did_pvalue"),
        "treated_pre_slope", "control_pre_slope",
        (100 * F.col("did_estimate") / (F.col("treated_pre") + 1e-9)).alias("pct_lift"))


def event_overview(panel: DataFrame, groups: dict[str, dict[str, str]], pre_start: date, intervention: date, post_end: date) -> DataFrame:
    """M7: mean weekly units and price of named selections before and after one date."""
    inside = panel.where((F.col("week") >= F.lit(pre_start)) & (F.col("week") <= F.lit(post_end)))
    out = None
    for name, sel in groups.items():
        rows = inside
        for c, v in sel.items():
            rows = rows.where(F.col(c) == v)
        weekly = rows.groupBy("week").agg(F.sum("base_units").alias("u"), F.avg("arp").alias("p"))
        after = F.col("week") >= F.lit(intervention)
        part = weekly.agg(
            F.lit(name).alias("series"),
            *[F.avg(F.when(~after if side == "pre" else after, F.col(c))).alias(f"{side}_{n}")
              for side in ("pre", "post") for c, n in (("u", "units"), ("p", "price"))])
        out = part if out is None else out.unionByName(part)
    return out.withColumn("units_change_pct", 100 * (safe_div("post_units", "pre_units") - 1))
