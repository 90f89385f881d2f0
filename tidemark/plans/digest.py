"""Ranked leads from stored findings and cards."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXCLUDED_SERIES = r"\.(?:AT|BE|ES|FR|IT|NL|PL)\.|jebel_ali|kharg"


def family(name: Column) -> Column:
    """Series that tell one story share a family: tax basis and currency wording is dropped."""
    s = name
    for old, new in ((" incl. taxes", ""), (" excl. taxes", ""), (" in euros", ""), (" FOB", ""),
                     ("Brent spot price", "Brent spot")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return F.element_at(F.split(s, ":"), 1)


def rank_alerts(findings: DataFrame, series: DataFrame, cutoff: Column, exclude: str = EXCLUDED_SERIES, per_rule: int = 4,
                limit: int = 6, bonus: Column | None = None) -> DataFrame:
    """Latest fired reading per series and rule, scored; one per family, at most four per rule, six in all.

    The walk by falling score skips a family already seen, and a rule that has had its four. A family
    skipped only because its rule was full may still appear through another rule, so families are
    decided among rows that fit, not before: each (family, rule) offers its best row, rules keep their
    order, and the few survivors are walked in rank order.
    """
    latest = (findings.where(F.col("fired") & (F.col("obs_end") >= cutoff) & ~F.col("series_id").rlike(exclude))
              .groupBy("series_id", "rule_id").agg(
                  F.max_by(F.struct("obs_end", "value", "z", "stats"), "obs_end").alias("_r"))
              .select("series_id", "rule_id", "_r.*"))
    med = F.coalesce(F.try_element_at("stats", F.lit("baseline_median")), F.lit(0.0))
    ship = F.when(med != 0, 10 * F.least(F.lit(1.0), F.abs(F.coalesce("value", F.lit(0.0)) - med) / med)).otherwise(0.0)
    score = F.when(F.col("rule_id") == "shipping_7d", ship).otherwise(
        F.least(F.lit(10.0), F.abs(F.coalesce("z", F.lit(0.0)))))
    sid = F.col("series_id")
    extra = bonus if bonus is not None else (
        F.when(sid.startswith("portwatch.hormuz"), 1.0)
        .when(sid.contains("yanbu") | sid.contains("fujairah"), 0.5).otherwise(0.0))
    cand = latest.join(series.select("series_id", "name"), "series_id").withColumns(
        {"score": score + extra, "family": family(F.col("name"))})
    return greedy_pick(cand, per_rule, limit)


def greedy_pick(cand: DataFrame, per_rule: int, limit: int) -> DataFrame:
    """Exact greedy selection in ``limit`` steps: each takes the best row whose family and rule are still open.

    Only rows that can still win travel: per rule the best of each family, of those the first
    ``limit`` + ``per_rule`` (at most that many families can be taken before them).
    """
    order = [F.col("score").desc(), F.col("series_id"), F.col("rule_id")]
    best = Window.partitionBy("rule_id", "family").orderBy(*order)
    front = Window.partitionBy("rule_id").orderBy(*order)
    few = cand.withColumn("_f", F.row_number().over(best)).where("_f = 1")
    few = few.withColumn("_g", F.row_number().over(front)).where(F.col("_g") <= limit + per_rule).drop("_f", "_g")
    item = F.struct((-F.col("score")).alias("neg"), F.col("series_id"), F.col("rule_id"), F.col("family"), F.col("score"))
    packed = few.agg(F.sort_array(F.collect_list(item)).alias("items"))

    def take(acc: Column, x: Column) -> Column:
        seen = F.exists(acc, lambda a: a["family"] == x["family"])
        full = F.size(F.filter(acc, lambda a: a["rule_id"] == x["rule_id"])) >= per_rule
        return F.when(seen | full | (F.size(acc) >= limit), acc).otherwise(F.concat(acc, F.array(x)))

    kind = packed.schema["items"].dataType
    picked = packed.select(F.aggregate("items", F.array().cast(kind), take).alias("p"))
    return picked.select(F.posexplode("p").alias("_pos", "_x")).select(
        (F.col("_pos") + 1).alias("position"), "_x.series_id", "_x.rule_id", "_x.family", "_x.score")


def alert_line(name: Column, rule: Column, value: Column, stats: Column, obs_end: Column) -> Column:
    """struct<title, detail> in the wording of the digest."""
    def s(k: str) -> Column:
        return F.try_element_at(stats, F.lit(k))

    def one(v: Column, d: int = 1) -> Column:
        return F.coalesce(F.format_string(f"%,.{d}f", v), F.lit("–"))
    export = name.contains("export volume")
    k = F.when(export, 1000.0).otherwise(1.0)
    u = F.when(export, "thousand t/day").otherwise("per day")
    day = obs_end.cast("string")
    ship = F.struct(
        F.concat(name, F.lit(": "), one(value / k), F.lit(" "), u, F.lit(" (7-day mean)")).alias("title"),
        F.concat(F.lit("Baseline: median "), one(s("baseline_median") / k), F.lit(" "), u, F.lit(", usual range "),
                 one(s("q_low") / k), F.lit("–"), one(s("q_high") / k), F.lit(". Through "), day, F.lit(".")).alias("detail"))
    price = F.struct(
        F.concat(name, F.lit(": "), F.format_string("%+.1f%%", F.coalesce(s("pct_change"), F.lit(0.0))), F.lit(" in one "),
                 F.when(rule == "price_daily", "day").otherwise("week")).alias("title"),
        F.concat(F.lit("Now "), one(value, 2), F.lit("; robust z "), one(s("z")),
                 F.lit(" against its own history. Observation "), day, F.lit(".")).alias("detail"))
    stock = F.struct(
        F.concat(name, F.lit(": weekly change "), one(s("change"), 0)).alias("title"),
        F.concat(F.lit("Outside the usual range for this time of year. Week ending "), day, F.lit(".")).alias("detail"))
    lag = F.struct(
        F.concat(name, F.lit(": moved "), one(F.coalesce(s("residual"), F.lit(0.0)) * 100),
                 F.lit(" ct/L differently than crude costs predict")).alias("title"),
        F.concat(F.lit("Exploratory model residual, week of "), day,
                 F.lit(". Check taxes, refinery issues or local factors.")).alias("detail"))
    other = F.struct(F.concat(name, F.lit(": unusual reading")).alias("title"),
                     F.concat(F.lit("Rule "), rule, F.lit(", "), day, F.lit(".")).alias("detail"))
    return (F.when(rule == "shipping_7d", ship).when(rule.isin("price_daily", "price_weekly"), price)
            .when(rule == "inventory_week", stock).when(rule == "fuel_lag_resid", lag).otherwise(other))


def build_digest(alerts: DataFrame, cards: DataFrame, context: DataFrame | None = None, max_items: int = 14) -> DataFrame:
    """One ranked list. alerts: title, detail, ref, score; cards: headline cards; context: title, detail, rank."""
    a = alerts.select(F.lit("unusual").alias("kind"), "title", "detail", "ref", (F.lit(100.0) + F.col("score")).alias("rank"))
    told = cards.where(F.col("relationship").isin("supports", "complicates")).select(
        F.when(F.col("relationship") == "supports", "supported").otherwise("contradicted").alias("kind"),
        "title", F.concat_ws(": ", "publisher", "relationship_reason").alias("detail"), F.col("card_id").alias("ref"),
        F.when(F.col("relationship") == "complicates", 80.0).otherwise(70.0).alias("rank"))
    waiting = cards.where(F.col("relationship") == "insufficient_evidence").orderBy(
        F.col("discovered_at").desc(), "card_id").limit(3)
    pending = waiting.agg(F.count("*").alias("n"), F.min_by("title", F.struct(F.lit(0), "card_id")).alias("t")).where(
        "n > 0").select(F.lit("pending").alias("kind"), F.concat(
            F.col("n").cast("string"), F.lit(" recent headlines cannot be tested yet")).alias("title"), F.concat(
            F.lit("The newest observations predate them. E.g. "), F.col("t")).alias("detail"),
        F.lit(None).cast("string").alias("ref"), F.lit(60.0).alias("rank"))
    out = a.unionByName(told).unionByName(pending)
    if context is not None:
        out = out.unionByName(context.select(F.lit("context").alias("kind"), "title", "detail",
                                             F.lit(None).cast("string").alias("ref"), "rank"))
    return out.orderBy(F.col("rank").desc(), "kind", "title").limit(max_items)


def digest_markdown(items: DataFrame, generated: str) -> DataFrame:
    """The digest as one text row; it holds at most the digest's own limit of items."""
    label = F.create_map(*[F.lit(x) for kv in {
        "unusual": "UNUSUAL", "contradicted": "DATA CONTRADICT", "supported": "DATA SUPPORT", "pending": "WAITING",
        "context": "CONTEXT"}.items() for x in kv])
    line = F.concat(F.lit("- **["), F.try_element_at(label, F.col("kind")), F.lit("] "), F.col("title"), F.lit("**  \n  "),
                    F.col("detail"))
    rows = items.agg(F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("r"), line.alias("t")))).alias("l"))
    head = f"# Story finder — {generated} UTC\n\nLeads to check, not conclusions.\n\n"
    return rows.select(F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["t"]), "\n"), F.lit("\n")).alias("value"))
