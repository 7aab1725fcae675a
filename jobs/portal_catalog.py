"""Keeps a catalogue of a data portal's landing pages up to date from harvested pages that keep arriving.

Harvested pages (page_id, url, html; later harvests have higher page_id) are files in a
folder. A run takes the files that no run has taken before (file stream, availableNow,
checkpoint), parses them, and appends what it finds to `<output>/pages`, a table that only
grows. Then it renews those parts of `<output>/catalog` whose pages have become more: one
row for each version (digest of the page) of each data object (the address without
scheme, `www.` or `m.`, query and fragment), with the object's name as it may stand in a
query for the portal, and whether the version is the object's current one.

A run that breaks while it appends is continued by the next (the stream's checkpoint and
sink); one that breaks while it renews leaves parts whose numbers of pages differ, which the
next run renews. Without new pages nothing is written.

A null url or html counts as an empty one; pages repeated in any way are counted in n_pages;
of versions with the same last page the one with the greatest digest is current.
"""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import given
from plumeline.functions import text
from plumeline.sources import shared

log = logging.getLogger("plumeline.jobs.portal_catalog")

HARVEST = "page_id long, url string, html string"
PAGES = "object string, version string, page_id long, title string, name string, lang string, n_links long, n_chars long, part string"
CATALOG = "object string, version string, title string, name string, lang string, n_links long, n_chars long, first_page long, last_page long, n_pages long, current boolean, part string"

DESCRIBED = [c.split()[0] for c in CATALOG.split(", ")[:-2]]

#: What stands before an object's address, and after it.
BEFORE, AFTER = r"^[A-Za-z][A-Za-z0-9+.-]*://(www\.|m\.)?", r"(?s)[?#].*$"
TITLE, LANG, LINK = r"(?is)<title[^>]*>(.*?)</title>", r"(?i)<html[^>]*\slang=\"([^\"]*)\"", r"(?i)<a\s[^>]*href="


def parsed(harvest: DataFrame, digits: int = 1) -> DataFrame:
    """What each page says of its object. Parts are named after the first hexadecimal digits of the object's digest."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    at = harvest.select("page_id", html.alias("html"), F.regexp_replace(F.regexp_replace(url, BEFORE, ""), AFTER, "").alias("object"))
    title = F.regexp_extract("html", TITLE, 1)
    return at.select(
        "object", F.sha2("html", 256).alias("version"), "page_id", title.alias("title"), text.plain(title).alias("name"), F.regexp_extract("html", LANG, 1).alias("lang"),
        F.regexp_count("html", F.lit(LINK)).cast("long").alias("n_links"), F.length("html").cast("long").alias("n_chars"), F.concat(F.lit("p"), F.substring(F.sha2("object", 256), 1, digits)).alias("part"),
    )


def appended(spark: SparkSession, source: str, output: str, checkpoint: str, files_per_batch: int, digits: int) -> int:
    """Appends what new files have to the pages, and gives the number of rows read."""
    harvest = spark.readStream.schema(HARVEST).option("maxFilesPerTrigger", files_per_batch).parquet(shared.watched(source))
    stream = parsed(harvest, digits).writeStream.format("parquet").partitionBy("part").option("path", f"{output}/pages").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
    finally:
        stream.stop()
    return sum(p["numInputRows"] for p in stream.recentProgress)


def versions(pages: DataFrame) -> DataFrame:
    """One row for each version of each object."""
    found = pages.groupBy("part", "object", "version").agg(*(F.any_value(c).alias(c) for c in DESCRIBED[2:7]), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"), F.count(F.lit(1)).alias("n_pages"))
    order = F.struct("last_page", "version")
    last = found.groupBy("part", "object").agg(F.max(order).alias("last"))
    return found.join(last, ["part", "object"]).select(*DESCRIBED, (F.col("last.version") == F.col("version")).alias("current"), "part")


def renewed(spark: SparkSession, output: str) -> list[str]:
    """Renews the parts of the catalogue that don't have all pages, and gives their names; there are 16 parts for each digit more."""
    pages, catalog = shared.read_or_empty(spark, f"{output}/pages", PAGES), shared.read_or_empty(spark, f"{output}/catalog", CATALOG)
    there = pages.groupBy("part").agg(F.count(F.lit(1)).alias("there"))
    known = catalog.groupBy("part").agg(F.sum("n_pages").alias("known"))
    behind = there.join(known, "part", "left").filter(F.coalesce("known", F.lit(0)) != F.col("there"))
    parts = sorted(r["part"] for r in behind.select("part").collect())
    if parts:
        rows = versions(pages.filter(F.col("part").isin(parts))).hint("rebalance", "part")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{output}/catalog")
    return parts


def catalog(spark: SparkSession, output: str) -> DataFrame:
    return shared.read_or_empty(spark, f"{output}/catalog", CATALOG)


def run(spark: SparkSession, source: str, output: str, checkpoint: str, files_per_batch: int = 200, digits: int = 1) -> dict:
    """Takes what is new in `source` into `<output>/pages` and `<output>/catalog`."""
    read = appended(spark, source, output, checkpoint, files_per_batch, digits)
    log.info("read %d new pages of %s, appended to %s/pages", read, source, output)
    parts = renewed(spark, output)
    log.info("renewed %d parts of %s/catalog: %s", len(parts), output, " ".join(parts))
    return {"read": read, "renewed": parts}


def main(args: list[str] | None = None) -> int:
    settings = given(__doc__, os.path.join(os.path.dirname(os.path.abspath(__file__)), "portal_catalog.json"), args)
    spark = SparkSession.builder.appName("portal_catalog").getOrCreate()
    try:
        run(spark, **settings)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
