"""Files for readers: CSV, method notes, card texts, payloads, ledgers.

Everything is written by Spark; one output row per card, series or export keeps each text small.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.numbers import number_text, number_text_digits
from ..functions.text import dash_slug, short_hash
from ..operators.guards import require_none, unit_mix_violations
from ..plans.scenes import SNAPSHOT_UNIT

SERIES_CSV = ["series_id", "series_name", "unit", "obs_start", "obs_end", "value", "status", "revision_no", "version_id",
              "first_seen_at", "retrieved_at", "source_published_at", "raw_sha256"]


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite").option("header", True).option("nullValue", "")
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def real_price_table(prices: DataFrame, columns: dict[str, str], base_year: int) -> DataFrame:
    """Index to four digits, then nominal and real price of each component side by side, two digits.

    columns: column of ``prices`` -> label; ``prices`` carries year, price_index, <column>, real_<column>.
    """
    cols = [F.col("year").alias("Jahr"), F.round("price_index", 4).alias("Preisindex")]
    for c, label in columns.items():
        cols += [F.round(c, 2).alias(f"{label} (nominal)"), F.round("real_" + c, 2).alias(f"{label} (real {base_year})")]
    return prices.select(*cols).orderBy("Jahr")


def series_export(versions: DataFrame, series: DataFrame, ids: Sequence[str], start: str | None = None,
                  end: str | None = None) -> DataFrame:
    """Exactly the observations a chart shows, with the ids and hashes to reproduce it."""
    d = versions.where(F.col("series_id").isin(list(ids)) & F.col("is_current"))
    if start:
        d = d.where(F.col("obs_end") >= F.lit(start).cast("date"))
    if end:
        d = d.where(F.col("obs_end") <= F.lit(end).cast("date"))
    info = series.select("series_id", F.col("name").alias("series_name"), "unit")
    out = d.join(info, "series_id")
    require_none(unit_mix_violations(out.select(F.lit("export").alias("export"), "unit").distinct(), "export", "unit"),
                 "snapshot counts cannot share an export with daily units")
    return out.select(*SERIES_CSV)


def method_note(export: DataFrame, title: str, baseline: tuple[str, str] | None = None, event: str | None = None,
                synthetic: bool = False) -> DataFrame:
    """One text row: series, dates, baseline, at most twenty file hashes and how many more there are."""
    names = F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("`"), F.col("series_id"), F.lit("` — "), F.col("series_name"),
                                                             F.lit(" ["), F.col("unit"), F.lit("]")))), "; ")
    first = export.where("raw_sha256 IS NOT NULL").select(F.substring("raw_sha256", 1, 16).alias("x")).distinct().orderBy("x").limit(21)
    hashes = first.agg(F.array_sort(F.collect_list("x"))).scalar()
    g = export.agg(names.alias("n"), F.min("obs_end").alias("a"), F.max("obs_end").alias("b"), F.max("retrieved_at").alias("r"))
    g = g.withColumn("h", hashes)
    lines = [F.lit(f"# {title}")]
    if synthetic:
        lines.append(F.lit("**SYNTHETIC DEMO DATA — NOT LIVE.**"))
    lines += [
        F.concat(F.lit("- Series: "), F.col("n")),
        F.concat(F.lit("- Observation dates: "), F.col("a").cast("string"), F.lit(" to "), F.col("b").cast("string")),
        F.concat(F.lit("- Retrieved (UTC): up to "), F.coalesce(F.date_format("r", "yyyy-MM-dd HH:mm"), F.lit("unknown"))),
        F.lit(f"- Baseline: {baseline[0]} to {baseline[1]}" if baseline else "- Baseline: none shown"),
        F.lit(f"- Event marker: {event or 'none'}"),
        F.concat(F.lit("- Raw evidence files (sha256): "), F.array_join(F.slice("h", 1, 20), ", "),
                 F.when(F.size("h") > 20, " …").otherwise("")),
        F.lit("- Method: values as published (current vintage); missing observations shown as gaps.")]
    return g.select(F.concat_ws("\n", *lines).alias("value"))


def card_markdown(cards: DataFrame) -> DataFrame:
    """card_id and its text. cards: the output of plans.cards.headline_cards plus ``version``."""
    def row(m: Column) -> Column:
        ctx = F.when(m["ctx_n"] > 0, F.concat(F.lit("n="), m["ctx_n"].cast("string"), F.lit(", median "),
                                              number_text_digits(m["ctx_median"], m["digits"]))).otherwise("")
        rule = F.coalesce(F.concat(m["finding"]["rule_id"], F.when(m["finding"]["fired"], ": FIRED").otherwise(": not fired")), F.lit("n/a"))
        cells = [F.concat(m["name"], F.lit(" ["), m["unit"], F.lit("]")),
                 F.concat(number_text_digits(m["latest_value"], m["digits"]), F.lit(" ("), m["latest_date"].cast("string"), F.lit(")")),
                 F.concat(number_text_digits(m["previous_value"], m["digits"]), F.lit(" ("), F.coalesce(m["previous_date"].cast("string"), F.lit("–")), F.lit(")")),
                 number_text_digits(m["abs_change"], m["digits"], signed=True), number_text(m["pct_change"], 1, signed=True, missing="–"), ctx, rule]
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    def bullets(c: str, none: str) -> Column:
        return F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(f"- {none}")

    text = F.concat_ws(
        "\n", F.concat(F.lit("# Evidence card `"), F.col("card_id"), F.lit("` (v"), F.col("version").cast("string"), F.lit(", "), F.col("kind"), F.lit(")")),
        F.concat(F.lit("**Headline:** "), F.col("title")), F.concat(F.lit("\n**Question tested:** "), F.col("question")),
        F.concat(F.lit("\n**Relationship:** `"), F.col("relationship"), F.lit("` — "), F.coalesce("relationship_reason", F.lit(""))),
        F.concat(F.lit("\n> "), F.col("temporal_note")), F.lit("\n## Measurements\n"),
        F.lit("| Series | Latest | Previous | Change | % | Context window | Screening |"), F.lit("|---|---|---|---|---|---|---|"),
        F.array_join(F.transform("measurements", row), "\n"), F.lit("\n## Contrary / normal observations\n"), bullets("contrary_observations", "none recorded"),
        F.lit("\n## Alternative explanations\n"), bullets("alternatives", "none listed"),
        F.concat(F.lit("\n## Assessment dimensions\n\n- Evidence quality: **"), F.col("evidence_quality"), F.lit("**\n- Freshness: **"), F.col("freshness"),
                 F.lit("**\n- Editorial relevance: **"), F.col("editorial_relevance"), F.lit("**\n- Signal strength: **"), F.col("signal_strength"), F.lit("**")),
        F.concat(F.lit("\n## Follow-up question\n\n"), F.col("follow_up")), F.concat(F.lit("\n## Draft research note\n\n"), F.col("narrative")),
        F.concat(F.lit("\n> REVIEW NEEDED: "), F.col("review_flag")),
        F.concat(F.lit("\n## Input observation versions\n\n"), F.array_join("input_version_ids", ", ")))
    return cards.select("card_id", text.alias("value"))


def card_json(cards: DataFrame) -> DataFrame:
    return cards.select("card_id", F.to_json(F.struct(*cards.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_texts(texts: DataFrame, path: str, key: str) -> None:
    """One folder per key, named by a safe form of it; where that loses anything, a hash keeps two keys apart."""
    slug = dash_slug(F.col(key))
    item = F.when(slug == F.col(key), slug).otherwise(F.concat(slug, F.lit("-"), short_hash(10, F.col(key))))
    texts.select(item.alias("item"), "value").write.mode("overwrite").partitionBy("item").text(path)


def snapshot_export(counts: DataFrame, unit: str = SNAPSHOT_UNIT) -> DataFrame:
    """Snapshot counts with their unit; a per-day or transit label is refused."""
    named = unit if "snapshot" in unit.lower() else unit + " snapshot"
    label = counts.sparkSession.createDataFrame([("export", named)], "export string, unit string")
    require_none(unit_mix_violations(label, "export", "unit"), "snapshot counts cannot carry daily units")
    return counts.withColumn("unit", F.lit(unit))


def ledger_row(run_id: str, source: str, status: str, started: Column, finished: Column, counts: DataFrame, latest: DataFrame,
               error: str | None = None) -> DataFrame:
    """One row of the run ledger from merge counts and the newest observation."""
    c = counts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("n_new", "n_revised", "n_unchanged")])
    newest = latest.agg(F.max("obs_end").alias("latest_observation"))
    return c.withColumns({"run_id": F.lit(run_id), "source": F.lit(source), "status": F.lit(status), "started_at": started,
                          "finished_at": finished, "error": F.lit(error).cast("string"), "latest_observation": newest.scalar()})


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows with a row counter and the newest period attached; read them after the write."""
    o = Observation(name)
    return df.observe(o, F.count("*").alias("n_rows"), F.max("obs_end").alias("latest_observation")), o


def vessel_dump(snapshot: DataFrame, path: str, taken_at: str) -> None:
    snapshot.withColumn("taken_at", F.lit(taken_at)).write.mode("overwrite").partitionBy("taken_at").json(path)
