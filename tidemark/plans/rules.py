"""Screening rules. One plan evaluates every series of a rule at once.

Input is the current (or a vintage of the) observation table: series_id, obs_start, obs_end, value,
version_id. Output rows share one shape, so rules can be united and stored.
"""
from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FORMULAS, INVENTORY, PRICE_DAILY, PRICE_DAILY_MIN_PCT, PRICE_WEEKLY, ROBUST_Z_THRESHOLD, SHIPPING, SHIPPING_BASELINE
from ..functions.robust import with_robust_z
from ..operators.findings import mark_unscreened, store_findings
from ..operators.regress import lag_findings, lag_residuals
from ..operators.timeline import densify_daily, first_differences, interval_mean, last_rows, log_returns, seasonal_baseline
from ..operators.versioned import observations
from ..session import cut_lineage

FINDING = ["rule_id", "series_id", "obs_start", "obs_end", "value", "fired", "evaluation", "method", "z", "stats",
           "thresholds", "input_version_ids", "explanation", "severity_rank", "formula_version"]


def _numbers(**named: Column) -> Column:
    """map<string,double> of the non-null statistics."""
    pairs = [x for k, v in named.items() for x in (F.lit(k), v.cast("double"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def _finish(df: DataFrame, rule: str, **cols: Column) -> DataFrame:
    return df.withColumns({**cols, "rule_id": F.lit(rule), "formula_version": F.lit(FORMULAS[rule])}).select(*FINDING)


def trailing_arrays(df: DataFrame, key: str, day: str, value: str, window: int) -> DataFrame:
    """Add ``_base``, the values of the previous ``window`` rows, and ``_from``, the day they begin.

    Scoring a long history is the expensive part, and a few series would keep it on a few cores. A frame
    only looks ``window`` rows back, so each series is cut into chunks that carry the rows before them
    along, and the chunks are spread over all tasks.
    """
    size = 4 * window
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(day)) - 1)
    own = F.floor(F.col("_i") / size)
    lead_in = F.when(F.col("_i") % size >= size - window, own + 1)
    d = d.withColumn("_chunk", F.explode(F.array_compact(F.array(own, lead_in)))).repartition(tasks, key, "_chunk")
    past = Window.partitionBy(key, "_chunk").orderBy(day).rowsBetween(-window, -1)
    d = d.withColumns({"_base": F.collect_list(value).over(past), "_from": F.first(day).over(past)})
    return d.where(F.floor(F.col("_i") / size) == F.col("_chunk")).drop("_i", "_chunk")


def price_points(obs: DataFrame, cfg: Mapping = PRICE_DAILY, min_pct: Column | None = None,
                 z_threshold: float = ROBUST_Z_THRESHOLD) -> DataFrame:
    """Every evaluated price point with its return, robust z against the previous window, and verdict.

    The point itself never enters its baseline. Only the rows the last ``last_n`` points can see are kept.
    """
    window, last_n = cfg["window"], cfg.get("last_n")
    d = obs.where(F.col("value") > 0)
    if last_n is not None:
        d = last_rows(d, ["series_id"], "obs_start", last_n + window + 1)
    d = log_returns(d, ["series_id"], "obs_start", "value", cfg["max_gap_days"])
    order = Window.partitionBy("series_id").orderBy("obs_start")
    d = d.withColumn("_prev_id", F.lag("version_id").over(order))
    if last_n is None:
        d = trailing_arrays(d, "series_id", "obs_start", "ret", window)
    else:
        past = order.rowsBetween(-window, -1)
        d = d.withColumns({"_base": F.collect_list("ret").over(past), "_from": F.first("obs_start").over(past)})
        d = last_rows(d, ["series_id"], "obs_start", last_n)
    d = d.where("ret IS NOT NULL")
    d = with_robust_z(d, "ret", "_base", cfg["min_history"])
    limit = min_pct if min_pct is not None else F.lit(float(cfg["min_abs_pct"]))
    d = d.withColumns({"pct_change": (F.exp("ret") - 1) * 100, "min_abs_pct": limit})
    fired = (F.abs("z") >= z_threshold) & (F.abs("pct_change") >= F.col("min_abs_pct"))
    d = d.withColumn("fired", F.coalesce(fired, F.lit(False)))
    severity = (F.least(F.abs(F.coalesce("z", F.lit(0.0))) / z_threshold, F.lit(3.0))
                + F.least(F.abs("pct_change") / F.greatest("min_abs_pct", F.lit(1e-9)), F.lit(3.0)))
    return d.withColumn("severity_rank", severity).drop("_base")


def price_rule(obs: DataFrame, cfg: Mapping = PRICE_DAILY, min_pct: Column | None = None,
               z_threshold: float = ROBUST_Z_THRESHOLD) -> DataFrame:
    d = price_points(obs, cfg, min_pct, z_threshold)
    head = F.when(F.col("fired"), "FIRED").otherwise("not fired")
    z_text = F.when(F.col("z").isNotNull(), F.format_string("robust z %+.2f (%s, n=%d); ", "z", "method", "n_baseline")
                    ).otherwise(F.concat(F.lit("z suppressed: "), F.col("reason"), F.lit("; ")))
    text = F.concat(head, F.format_string(": change %+.2f%% (log return %+.4f); ", "pct_change", "ret"), z_text,
                    F.format_string(f"thresholds |z|>={z_threshold} AND |change|>=%s%%", F.col("min_abs_pct").cast("string")))
    return _finish(
        d, cfg["rule_id"], obs_end=F.col("obs_start"),
        evaluation=F.when(F.col("z").isNull(), "suppressed").otherwise("evaluated"),
        stats=_numbers(baseline_median=F.col("baseline_median"), scale=F.col("scale"), n_baseline=F.col("n_baseline"),
                       log_return=F.col("ret"), pct_change=F.col("pct_change"), z=F.col("z"),
                       previous_value=F.col("previous_value")),
        thresholds=_numbers(robust_z=F.lit(z_threshold), min_abs_pct=F.col("min_abs_pct"), window=F.lit(cfg["window"]),
                            min_history=F.lit(cfg["min_history"])),
        input_version_ids=F.array_sort(F.array_distinct(F.array_compact(F.array("version_id", "_prev_id")))),
        explanation=text)


def inventory_points(obs: DataFrame, cfg: Mapping = INVENTORY, z_threshold: float = ROBUST_Z_THRESHOLD,
                     min_abs: Column | None = None) -> DataFrame:
    """Weekly changes against the same ISO weeks of earlier years. obs may carry ``unit``."""
    d = obs.withColumn("obs_end", F.coalesce("obs_end", "obs_start")) if "obs_end" in obs.columns else (
        obs.withColumn("obs_end", F.col("obs_start")))
    d = first_differences(d, ["series_id"], "obs_end", "value", cfg["max_gap_days"])
    order = Window.partitionBy("series_id").orderBy("obs_end")
    d = d.withColumn("_prev_id", F.lag("version_id").over(order))
    targets = last_rows(d, ["series_id"], "obs_end", cfg["last_n"]) if cfg.get("last_n") is not None else d
    targets = targets.where("change IS NOT NULL")
    base = seasonal_baseline(d, "series_id", "obs_end", "change", targets, cfg["years"], cfg["week_halfwidth"])
    t = targets.join(base, ["series_id", "obs_end"], "left").withColumn(
        "baseline", F.coalesce("baseline", F.array().cast("array<double>")))
    t = with_robust_z(t, "change", "baseline", cfg["min_history"])
    if min_abs is None:
        min_abs = F.lit(0.0)
        if "unit" in t.columns:
            for unit, limit in cfg["min_abs_change"].items():
                min_abs = F.when(F.col("unit") == unit, limit).otherwise(min_abs)
    fired = (F.abs("z") >= z_threshold) & (F.abs("change") >= F.col("min_abs_change"))
    return t.withColumn("min_abs_change", min_abs).withColumns({
        "fired": F.coalesce(fired, F.lit(False)),
        "level_vs_seasonal_median": F.col("value") - F.col("seasonal_level_median"),
        "severity_rank": F.least(F.abs(F.coalesce("z", F.lit(0.0))) / z_threshold, F.lit(3.0))}).drop("baseline")


def inventory_rule(obs: DataFrame, cfg: Mapping = INVENTORY, z_threshold: float = ROBUST_Z_THRESHOLD) -> DataFrame:
    t = inventory_points(obs, cfg, z_threshold)
    text = F.concat(
        F.when(F.col("fired"), "FIRED").otherwise("not fired"),
        F.format_string(f": weekly change %+,.1f; same ISO weeks of {cfg['years']} earlier years (n=%d); ",
                        "change", "n_baseline"),
        F.when(F.col("z").isNotNull(), F.format_string("robust z %+.2f (%s)", "z", "method"))
        .otherwise(F.concat(F.lit("z suppressed: "), F.col("reason"))),
        F.format_string(f"; thresholds |z|>={z_threshold} AND |change|>=%,.0f", "min_abs_change"))
    return _finish(
        t, "inventory_week", evaluation=F.when(F.col("z").isNull(), "suppressed").otherwise("evaluated"),
        stats=_numbers(baseline_median=F.col("baseline_median"), scale=F.col("scale"), n_baseline=F.col("n_baseline"),
                       change=F.col("change"), previous_value=F.col("previous_value"), z=F.col("z"),
                       seasonal_level_median=F.col("seasonal_level_median"),
                       level_vs_seasonal_median=F.col("level_vs_seasonal_median")),
        thresholds=_numbers(robust_z=F.lit(z_threshold), min_abs_change=F.col("min_abs_change")),
        input_version_ids=F.array_sort(F.array_distinct(F.array_compact(F.array("version_id", "_prev_id")))),
        explanation=text)


def shipping_points(obs: DataFrame, cfg: Mapping = SHIPPING, baseline: Mapping = SHIPPING_BASELINE) -> DataFrame:
    """7-day means on the dense calendar against fixed-window quantiles, with persistence.

    Everything is one shuffle on series_id; the windows below only re-sort within it.
    """
    k, last_n, min_days = cfg["persistence_days"], cfg.get("last_n"), cfg["min_days_in_7d"]
    d = densify_daily(obs.select("series_id", "obs_start", "value", "version_id"), ["series_id"], "obs_start")
    s = Window.partitionBy("series_id")
    week = s.orderBy("obs_start").rowsBetween(-6, 0)
    b0, b1 = F.lit(baseline["start"]).cast("date"), F.lit(baseline["end"]).cast("date")
    d = d.withColumn("in_base", F.col("obs_start").between(b0, b1))
    d = d.withColumns({
        "n_days_present": F.count("value").over(week),
        "_avg": F.avg("value").over(week), "_sum": F.sum("value").over(week),
        "inputs": F.collect_list("version_id").over(week),
        "_weekday_mean": F.avg(F.when(F.col("in_base"), F.col("value"))).over(
            Window.partitionBy("series_id", F.weekday("obs_start")))})
    d = d.withColumn("mean_7d", F.when(F.col("n_days_present") >= min_days, F.col("_avg")))
    d = d.withColumn("_bm", F.when(F.col("in_base"), F.col("mean_7d")))
    probs = F.array(F.lit(float(cfg["low_quantile"])), F.lit(0.5), F.lit(float(cfg["high_quantile"])))
    d = d.withColumns({
        "_q": F.percentile("_bm", probs).over(s), "n_baseline_windows": F.count("_bm").over(s),
        "_le": F.count("_bm").over(s.orderBy("mean_7d").rangeBetween(Window.unboundedPreceding, 0)),
        "_expected": F.sum(F.when(F.col("value").isNotNull(), F.col("_weekday_mean"))).over(week),
        "_known_expected": F.count(F.when(F.col("value").isNotNull(), F.col("_weekday_mean"))).over(week)})
    last_year = d.select("series_id", F.col("obs_start").alias("_ly"), F.col("mean_7d").alias("last_year_7d"))
    if last_n is not None:
        d = last_rows(d, ["series_id"], "obs_start", last_n)
    d = d.withColumn("_ly", F.add_months("obs_start", -12)).join(last_year, ["series_id", "_ly"], "left")
    d = d.withColumns({
        "q_low": F.col("_q")[0], "baseline_median": F.col("_q")[1], "q_high": F.col("_q")[2],
        "evaluation": F.when(F.col("value").isNull(), "suppressed: no observation for this day")
        .when(F.col("mean_7d").isNull(), "suppressed: too few observed days")
        .when(F.col("n_baseline_windows") == 0, "not evaluated: baseline window empty")
        .when(F.col("in_base"), "not evaluated: inside the baseline window").otherwise("evaluated")})
    done = F.col("evaluation") == "evaluated"
    outside = (F.col("mean_7d") < F.col("q_low")) | (F.col("mean_7d") > F.col("q_high"))
    far = F.abs(F.col("mean_7d") - F.col("baseline_median")) >= cfg["min_abs_change"]
    d = d.withColumn("condition", F.coalesce(done & outside & far, F.lit(False)))
    run = s.orderBy("obs_start").rowsBetween(-(k - 1), 0)
    d = d.withColumn("fired", (F.min(F.col("condition").cast("int")).over(run) == 1) & (F.count("*").over(run) == k)
                     & F.col("condition"))
    return d.withColumns({
        "empirical_position": F.when(done, F.col("_le") / F.col("n_baseline_windows")),
        "weekday_adjusted_ratio": F.when(done & (F.col("_expected") > 0)
                                         & (F.col("_known_expected") == F.col("n_days_present")),
                                         F.col("_sum") / F.col("_expected")),
        "severity_rank": F.when(done, F.abs(F.col("mean_7d") - F.col("baseline_median"))
                                / F.greatest("baseline_median", F.lit(1.0))).otherwise(F.lit(0.0)),
    }).drop("_q", "_avg", "_sum", "_bm", "_le", "_expected", "_known_expected", "_weekday_mean", "_ly")


def shipping_rule(obs: DataFrame, cfg: Mapping = SHIPPING, baseline: Mapping = SHIPPING_BASELINE) -> DataFrame:
    d = shipping_points(obs, cfg, baseline)
    done = F.col("evaluation") == "evaluated"
    text = F.when(done, F.concat(
        F.when(F.col("fired"), "FIRED").otherwise("not fired"),
        F.format_string(f": 7-day mean %.1f/day vs fixed baseline {baseline['start']}..{baseline['end']} median %.1f "
                        "(low %.1f, high %.1f); position %.2f", "mean_7d", "baseline_median", "q_low", "q_high",
                        "empirical_position"))).otherwise(F.col("evaluation"))
    return _finish(
        d.withColumn("obs_end", F.col("obs_start")).withColumn("obs_start", F.date_sub("obs_start", 6))
        .withColumn("_latest", F.col("value")), "shipping_7d",
        value=F.when(F.col("evaluation").startswith("suppressed"), None).otherwise(F.col("mean_7d")),
        method=F.lit(None).cast("string"), z=F.lit(None).cast("double"),
        evaluation=F.element_at(F.split("evaluation", ":"), 1),
        stats=_numbers(n_days_present=F.col("n_days_present"), baseline_median=F.when(done, F.col("baseline_median")),
                       q_low=F.when(done, F.col("q_low")), q_high=F.when(done, F.col("q_high")),
                       empirical_position=F.col("empirical_position"),
                       weekday_adjusted_ratio=F.col("weekday_adjusted_ratio"), last_year_7d=F.col("last_year_7d"),
                       latest_daily=F.col("_latest"), n_baseline_windows=F.col("n_baseline_windows")),
        thresholds=_numbers(min_days=F.lit(cfg["min_days_in_7d"]), low_quantile=F.lit(cfg["low_quantile"]),
                            high_quantile=F.lit(cfg["high_quantile"]), min_abs_change=F.lit(cfg["min_abs_change"]),
                            persistence_days=F.lit(cfg["persistence_days"])),
        input_version_ids=F.array_sort(F.array_distinct("inputs")), explanation=text)


def lag_rule(fits: DataFrame) -> DataFrame:
    """Findings of the distributed-lag model (see operators.regress.lag_residuals / lag_findings)."""
    text = F.when(F.col("suppressed"), F.format_string("suppressed: insufficient history (%d weeks)", "n_train")).otherwise(
        F.concat(F.when(F.col("fired"), "FIRED").otherwise("not fired"), F.format_string(
            ": weekly change %+.1f ct/L vs predicted %+.1f ct/L, residual %+.1f ct/L; exploratory, not causal",
            F.col("actual_change") * 100, F.col("predicted_change") * 100, F.col("residual") * 100)))
    return _finish(
        fits, "fuel_lag_resid", obs_end=F.col("obs_start"), value=F.col("actual_change"),
        evaluation=F.when(F.col("z").isNull(), "suppressed").otherwise("evaluated"),
        stats=_numbers(n_train=F.col("n_train"), residual=F.col("residual"), predicted_change=F.col("predicted_change"),
                       actual_change=F.col("actual_change"), z=F.col("z"), baseline_median=F.col("baseline_median")),
        thresholds=_numbers(robust_z=F.lit(ROBUST_Z_THRESHOLD)),
        input_version_ids=F.array(F.concat_ws("@", "series_id", F.col("obs_start").cast("string"))), explanation=text)


def lag_pairs(retail: DataFrame, crude_litre: DataFrame) -> DataFrame:
    """series_id, obs_start, value and ``crude``: the mean crude cost per litre over the days D-7..D-3 before each bulletin date;
    dates without a crude day in that window fall out. The mean is made once per date, however many series share it."""
    one = F.lit(0).alias("all")
    facts = crude_litre.select(one, F.col("obs_start").alias("day"), F.col("value").alias("cost"))
    means = interval_mean(retail.select(one, "obs_start").distinct(), facts, ["all"], "obs_start", "day", "cost", 3, 7)
    return retail.select("series_id", "obs_start", "value").join(means.where("n_days > 0").select("obs_start", F.col("mean_value").alias("crude")), "obs_start")


def run_rules(obs: DataFrame, series: DataFrame, screened_groups: list[str] | None = None, crude_litre: str = "derived.brent_eur_per_litre") -> DataFrame:
    """All rules on one vintage: series are routed to rules by source and frequency, findings united."""
    s = series.select("series_id", "source", "frequency", "unit")
    d = obs.join(s, "series_id")
    shipping = d.where(F.col("source") == "IMF PortWatch")
    if screened_groups is not None:
        group = F.element_at(F.split("series_id", r"\."), 2)
        shipping = shipping.where(F.col("series_id").startswith("portwatch.port.") | group.isin(screened_groups))
    daily_limit = F
    for sid, pct in PRICE_DAILY_MIN_PCT.items():
        daily_limit = daily_limit.when(F.col("series_id") == sid, pct)
    daily = d.where(F.col("series_id").isin(list(PRICE_DAILY_MIN_PCT)))
    bulletin = d.where(F.col("source") == "EU Oil Bulletin")
    retail = bulletin.where(F.col("series_id").rlike(r"\.(diesel|euro95)\..*without_tax$"))
    parts = [
        price_rule(daily, PRICE_DAILY, daily_limit.otherwise(PRICE_DAILY["min_abs_pct"])),
        price_rule(bulletin, PRICE_WEEKLY),
        inventory_rule(d.where((F.col("source") == "EIA") & (F.col("frequency") == "weekly"))),
        shipping_rule(shipping.where(F.col("series_id").rlike(r"\.n_tanker$|\.n_total$|^portwatch\.port\."))),
        lag_rule(lag_findings(lag_residuals(lag_pairs(retail, obs.where(F.col("series_id") == crude_litre))))),
    ]
    return reduce(DataFrame.unionByName, parts)


def screen(stored: DataFrame, versions: DataFrame, series: DataFrame, now: Column, screened_groups: list[str], as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """One rule run: the next finding table, and how many findings were evaluated and fired.

    The rules see the vintage known at ``as_of`` (now, if none is given). Findings on the same inputs change nothing, new inputs
    supersede; passages that are no longer screened keep their findings under another status. A replay of an older vintage is
    stored beside and touches nothing.
    """
    findings = cut_lineage(run_rules(observations(versions, as_of), series, screened_groups))       # stored and counted: computed once
    table = store_findings(stored, findings, now, as_of)
    if as_of is None:
        passage = F.when(F.col("series_id").startswith("portwatch.") & ~F.col("series_id").startswith("portwatch.port."), F.element_at(F.split("series_id", r"\."), 2))
        screened = stored.sparkSession.createDataFrame([(g,) for g in screened_groups], "group_key string")
        table = mark_unscreened(table, screened, passage, now)
    return table, findings.agg(F.count(F.lit(1)).alias("evaluated"), F.count_if("fired").alias("fired"))


def backtest(findings: DataFrame, start: str, end: str) -> DataFrame:
    """Alert rate per rule and series over a period. Only rows with a status 'evaluated' count."""
    d = findings.where(F.col("obs_start").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    ok = F.col("evaluation") == "evaluated"
    return d.groupBy("rule_id", "series_id").agg(
        F.count_if(ok).alias("evaluated"), F.count_if("fired").alias("fired"),
        F.array_sort(F.collect_list(F.when(F.col("fired"), F.col("obs_end")))).alias("fired_dates"),
    ).withColumn("alert_rate", F.try_divide("fired", "evaluated"))
