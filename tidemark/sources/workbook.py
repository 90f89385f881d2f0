"""Price workbooks: cells from XLSX files, and the three sheet layouts as joins on cells.

A cell is a row (path, sheet, row, col, text), read by the workbook source; finding headers, carrying
country labels down and melting columns are joins and windows on cells.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EU_ALIASES, PLAUSIBLE_PER_1000L, PLAUSIBLE_PER_L, UNIT_PER_1000L, UNIT_PER_L
from ..functions.codes import country_code, product_of, tax_basis
from ..functions.dates import any_date
from ..operators.guards import SourceChanged, magnitude_violations, require_none
from .archives import MAX_BYTES, WorkbookCells, source_reader

def read_cells(spark: SparkSession, path: str, sheets: str = "*", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Cells of XLSX files whose sheet name fits the pattern; every sheet is a task of its own."""
    return source_reader(spark, WorkbookCells, sheets, max_bytes).load(path)


WIDE = r"(?i)^([A-Z]{2}|EU|EUR|EU27|EU_27|EA)_price_(with|wo|without)_tax(?:es)?_([a-z0-9_]+)$"
SHEET = ["path", "sheet"]


def _number(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit(","), F.lit(""))).try_cast("double")


def sheet_units(cells: DataFrame, rows: int = 15) -> DataFrame:
    """Unit stated in the top rows of each sheet: EUR/1000L, EUR/L or null."""
    top = cells.where(F.col("row") <= rows)
    # A phrase may be spread over neighbouring cells of a row.
    line = top.groupBy(*SHEET, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]), " ").alias("t"))
    return line.groupBy(*SHEET).agg(F.when(F.bool_or(F.col("t").rlike(UNIT_PER_1000L)), "EUR/1000L").when(F.bool_or(F.col("t").rlike(UNIT_PER_L)), "EUR/L").alias("unit"))


def wide_prices(cells: DataFrame) -> DataFrame:
    """Sheets with one column per country, tax basis and product: header row within the first ten."""
    heads = cells.where((F.col("row") <= 10) & F.trim("text").rlike(WIDE))
    hdr = heads.groupBy(*SHEET, "row").agg(F.count("*").alias("n")).where("n >= 3").groupBy(*SHEET).agg(F.min("row").alias("hdr"))
    at = cells.join(hdr, SHEET)
    h = at.where(F.col("row") == F.col("hdr")).withColumn("t", F.trim("text"))
    prod = F.lower(F.regexp_extract("t", WIDE, 3))
    prod = F.when(prod == "heatingoil", "heating_oil").when(prod.isin("euro95", "diesel", "heating_oil"), prod)
    cols = h.where(F.col("t").rlike(WIDE)).select(
        *SHEET, "col", F.upper(F.regexp_extract("t", WIDE, 1)).alias("country"), prod.alias("product"),
        F.when(F.lower(F.regexp_extract("t", WIDE, 2)) == "with", "with_tax").otherwise("without_tax").alias("tax")).where("product IS NOT NULL")
    date_col = h.where(F.col("t").rlike("(?i)date|in force")).groupBy(*SHEET).agg(F.min("col").alias("dc"))
    body = at.where(F.col("row") > F.col("hdr"))
    days = body.join(hdr.join(date_col, SHEET, "left").select(*SHEET, F.coalesce("dc", F.lit(1)).alias("dc")), SHEET).where(
        F.col("col") == F.col("dc")).select(*SHEET, "row", any_date(F.col("text")).alias("obs_date")).where("obs_date IS NOT NULL")
    grid = days.join(cols, SHEET)
    values = body.select(*SHEET, "row", "col", _number(F.col("text")).alias("raw_value"))
    return grid.join(values, SHEET + ["row", "col"], "left").select(*SHEET, "country", "product", "tax", "obs_date", "raw_value")


def _product_header(cells: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    named = cells.where(F.col("row") <= rows).withColumn("product", product_of(F.col("text"))).where("product IS NOT NULL")
    hdr = named.groupBy(*SHEET, "row").agg(F.count("*").alias("n")).where("n >= 2").groupBy(*SHEET).agg(F.min("row").alias("hdr"))
    cols = named.join(hdr, SHEET).where(F.col("row") == F.col("hdr")).groupBy(*SHEET, "product").agg(F.min("col").alias("col"))
    return hdr, cols


def block_prices(cells: DataFrame) -> DataFrame:
    """Sheets where a country label applies to the dated rows below it; the tax basis is in the sheet name."""
    hdr, cols = _product_header(cells, 40)
    body = cells.join(hdr, SHEET).where(F.col("row") > F.col("hdr"))
    first = body.where(F.col("col") == 1).select(*SHEET, "row", F.trim("text").alias("label"), any_date(F.col("text")).alias("obs_date"))
    label = F.when(F.col("obs_date").isNull(), country_code(F.col("label")))
    # A sheet has at most 1,048,576 rows, which bounds this window.
    w = Window.partitionBy(*SHEET).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    dated = first.withColumn("country", F.last(label, ignorenulls=True).over(w)).where("obs_date IS NOT NULL AND country IS NOT NULL")
    grid = dated.join(cols, SHEET)
    values = body.select(*SHEET, "row", "col", _number(F.col("text")).alias("raw_value"))
    return grid.join(values, SHEET + ["row", "col"], "left").select(
        *SHEET, "country", "product", tax_basis(F.col("sheet")).alias("tax"), "obs_date", "raw_value").where("tax IS NOT NULL")


def weekly_prices(cells: DataFrame) -> DataFrame:
    """Single-week sheets: the date stands in the text of the top rows, countries in the first column."""
    hdr, cols = _product_header(cells, 25)
    top = cells.where(F.col("row") <= 12).groupBy(*SHEET).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("row", "col", "text"))), lambda c: c["text"]), " ").alias("t"))
    day = any_date(F.translate(F.regexp_extract("t", r"(\d{1,2}[/.]\d{1,2}[/.]\d{4}|\d{4}-\d{2}-\d{2})", 1), ".", "/"))
    meta = top.select(*SHEET, day.alias("obs_date"), F.coalesce(tax_basis(F.col("sheet")), tax_basis(F.col("t"))).alias("tax")).where(
        "obs_date IS NOT NULL AND tax IS NOT NULL")
    body = cells.join(hdr, SHEET).where(F.col("row") > F.col("hdr"))
    rows = body.where(F.col("col") == 1).select(*SHEET, "row", country_code(F.col("text")).alias("country")).where("country IS NOT NULL")
    values = body.select(*SHEET, "row", "col", _number(F.col("text")).alias("raw_value"))
    return rows.join(meta, SHEET).join(cols, SHEET).join(values, SHEET + ["row", "col"], "left").select(
        *SHEET, "country", "product", "tax", "obs_date", "raw_value")


def in_euro_per_litre(prices: DataFrame, units: DataFrame) -> DataFrame:
    """Apply the stated unit; unstated is taken as EUR per 1000 litres only where magnitudes agree."""
    d = prices.join(units, SHEET, "left")
    lo, hi = PLAUSIBLE_PER_1000L
    require_none(magnitude_violations(d.where("unit IS NULL"), SHEET, "raw_value", lo, hi), "unit not stated and magnitude unlike EUR per 1000 litres")
    return d.withColumns({
        "value": F.when(F.col("unit") == "EUR/L", F.col("raw_value")).otherwise(F.col("raw_value") / 1000.0),
        "unit_source": F.when(F.col("unit") == "EUR/L", "sheet text: EUR per litre").when(F.col("unit") == "EUR/1000L", "sheet text: EUR per 1000 litres")
        .otherwise("INFERRED: no unit text in sheet")})


def history_prices(cells: DataFrame, countries: Sequence[str], products: Sequence[str], since: str | None = None) -> DataFrame:
    """Wide sheets as such, all other sheets as blocks; sheets without a tax marker in the name are skipped."""
    cells = cells.where(tax_basis(F.col("sheet")).isNotNull())
    wide_sheets = cells.where((F.col("row") <= 10) & F.trim("text").rlike(WIDE)).groupBy(*SHEET, "row").agg(
        F.count("*").alias("n")).where("n >= 3").select(*SHEET).distinct()
    rest = cells.join(wide_sheets, SHEET, "left_anti")
    long = in_euro_per_litre(wide_prices(cells).unionByName(block_prices(rest)), sheet_units(cells))
    return finish_prices(long, countries, products, since)


def finish_prices(long: DataFrame, countries: Sequence[str], products: Sequence[str], since: str | None = None) -> DataFrame:
    """EU aliases joined, asked rows kept, plausibility checked, one row per key (the last sheet wins)."""
    d = long.withColumn("country", F.when(F.col("country").isin(EU_ALIASES), "EU").otherwise(F.col("country")))
    d = d.where(F.col("country").isin(list(countries)) & F.col("product").isin(list(products)))
    if since:
        d = d.where(F.col("obs_date") >= F.lit(since).cast("date"))
    if not d.limit(1).count():
        raise SourceChanged("workbook layout not recognised or no configured rows found")
    require_none(magnitude_violations(d, ["product", "tax"], "value", *PLAUSIBLE_PER_L), "implausible median price per litre")
    key = ["country", "product", "tax", "obs_date"]
    return d.groupBy(*key).agg(F.max_by(F.struct("raw_value", "value", "unit_source"), F.struct("path", "sheet")).alias("r")).select(*key, "r.*")
