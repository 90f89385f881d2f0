"""Link discovery in landed HTML pages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.guards import assert_each


def links(pages: DataFrame, id_col: str, html: str, base: Column | None = None) -> DataFrame:
    """One row per anchor: address (absolute where a base is given), label text and position."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)(<a\b[^>]*\bhref\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>)"), 1)
    d = pages.select(id_col, *([base.alias("_base")] if base is not None else []), F.posexplode(anchors).alias("position", "_a"))
    href = F.replace(F.regexp_extract("_a", r"(?is)\bhref\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit("&amp;"), F.lit("&"))
    label = F.trim(F.regexp_replace(F.regexp_replace("_a", "<[^>]+>", " "), r"\s+", " "))
    if base is not None:
        root = F.regexp_extract("_base", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
        folder = F.regexp_extract("_base", r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
        href = (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
                .when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href)))
    return d.select(id_col, "position", href.alias("href"), label.alias("label"))


def workbook_links(found: DataFrame) -> DataFrame:
    """Download links with their kind: history, latest with or without taxes, other."""
    d = found.where(F.col("href").contains("/document/download/"))
    name = F.url_decode(F.regexp_extract("href", r"[?&]filename=([^&#]*)", 1))
    blob = F.lower(F.concat_ws(" ", name, "label"))
    kind = (F.when(blob.contains("history") | blob.contains("historical"), "history")
            .when(blob.rlike("without tax|wo tax|without_tax"), "latest_without_taxes")
            .when(blob.rlike("with tax|with_tax"), "latest_with_taxes").otherwise("other"))
    return d.withColumns({"filename": name, "kind": kind}).where(blob.contains("xlsx"))


def page_workbooks(pages: DataFrame, id_col: str, html: str, base: Column | None = None) -> DataFrame:
    """The workbook links of every page; a page without any fails the query that reads the rows: its layout has changed."""
    found = pages.select(id_col).join(workbook_links(links(pages, id_col, html, base)), id_col, "left")
    return assert_each(found, F.col("href").isNotNull(), F.concat(F.lit("no workbook link on page "), F.col(id_col).cast("string")))


def yearly_csv_links(found: DataFrame, kind: str = "primary") -> DataFrame:
    """Yearly CSV files with their year; the last link of a year counts."""
    year = F.regexp_extract("href", rf"/annual-csv/{kind}/[a-z]*?(\d{{4}})\.csv$", 1)
    d = found.withColumn("year", year.try_cast("int")).where("year IS NOT NULL")
    return d.groupBy("year").agg(F.max_by("href", "position").alias("href"))


def years_to_read(yearly: DataFrame, mode: str, since_year: int) -> DataFrame:
    """A refresh reads the last two years, a backfill everything since the start."""
    d = yearly.where(F.col("year") >= since_year)
    return d if mode == "backfill" else d.orderBy(F.col("year").desc()).limit(2)


def archive_links(found: DataFrame) -> DataFrame:
    """World primary/secondary CSV archives; the first link of each kind counts."""
    h = F.lower("href")
    kind = F.when(h.contains("primary"), "primary").when(h.contains("secondary"), "secondary")
    d = found.where(h.endswith(".zip") & h.contains("csv") & h.contains("world")).withColumn("kind", kind)
    return d.where("kind IS NOT NULL").groupBy("kind").agg(F.min_by("href", "position").alias("href"))
