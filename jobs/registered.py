"""The jobs as queries: each runs twice into one new folder of the shared one, which stays, and gives what is there then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import flux_archive, portal_catalog
from plumeline.sources.fixtures import with_views
from plumeline.sources.shared import new_path

#: Combined categories of the archive.
COMBINED = {"anthrop": "fossil + 0.4*fires", "net": "fossil - biosphere"}


def job1_portal_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = new_path(spark, "portal-catalog")
    for _ in range(2):
        portal_catalog.run(spark, f"{sf_dir}/pages.parquet", output, f"{output}/checkpoint")
    return portal_catalog.catalog(spark, output).drop("part")


def job2_flux_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = new_path(spark, "flux-archive")
    for _ in range(2):
        flux_archive.run(spark, sf_dir, output, combined=COMBINED)
    got = flux_archive.archived(spark, output)
    rounded = {c: F.round(F.col(c) * scale, 7) + F.lit(0.0) for c, scale in (("flux", 1e12), ("amount", 1.0))}
    return got.select("tracer", "category", "year", "month", "ilat", "ilon", *(v.alias(k) for k, v in rounded.items()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_portal_catalog, job2_flux_archive)}


def oracle_sql() -> dict[str, str]:
    catalog = r"""WITH p AS (SELECT page_id, coalesce(html, '') AS html,
  regexp_replace(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(www\.|m\.)?', ''), '(?s)[?#].*$', '') AS object FROM pages),
d AS (SELECT object, sha256(html) AS version, page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
  regexp_extract(html, '(?i)<html[^>]*\slang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '(?i)<a\s[^>]*href=')) AS n_links, length(html) AS n_chars FROM p),
v AS (SELECT object, version, any_value(title) AS title, any_value(lang) AS lang, any_value(n_links) AS n_links, any_value(n_chars) AS n_chars,
  min(page_id) AS first_page, max(page_id) AS last_page, count(*) AS n_pages FROM d GROUP BY 1, 2)
SELECT object, version, title, regexp_replace(title, '[^\x2D-\x7A]|[\[\]]', '', 'g') AS name, lang, CAST(n_links AS BIGINT) AS n_links, CAST(n_chars AS BIGINT) AS n_chars, first_page, last_page, n_pages,
  row_number() OVER (PARTITION BY object ORDER BY last_page DESC NULLS LAST, version DESC) = 1 AS current FROM v"""
    archive = with_views("""WITH terms AS (SELECT '_anthrop' AS meta, 'fossil' AS category, CAST(1 AS DOUBLE) AS coeff UNION ALL SELECT '_anthrop', 'fires', CAST(2 AS DOUBLE) / 5
  UNION ALL SELECT '_net', 'fossil', CAST(1 AS DOUBLE) UNION ALL SELECT '_net', 'biosphere', CAST(-1 AS DOUBLE)),
amounts AS (SELECT tracer, category, itim, ilat, ilon, flux FROM fx_flux
  UNION ALL SELECT x.tracer, t.meta, x.itim, x.ilat, x.ilon, sum(t.coeff * x.flux) FROM fx_flux x JOIN terms t ON t.category = x.category GROUP BY 1, 2, 3, 4, 5),
named AS (SELECT a.*, year(t.t0) AS year, month(t.t0) AS month, t.dt, c.area FROM amounts a JOIN fx_time t ON t.itim = a.itim JOIN fx_cell c ON c.ilat = a.ilat AND c.ilon = a.ilon),
budgets AS (SELECT tracer, category, year, month, sum(flux) AS amount FROM named GROUP BY 1, 2, 3, 4)
SELECT n.tracer, n.category, CAST(n.year AS INT) AS year, CAST(n.month AS INT) AS month, n.ilat, n.ilon,
  round(n.flux / n.area / n.dt * CAST(1000000000000 AS DOUBLE), 7) + CAST(0 AS DOUBLE) AS flux, round(b.amount, 7) + CAST(0 AS DOUBLE) AS amount
FROM named n JOIN budgets b ON b.tracer = n.tracer AND b.category = n.category AND b.year = n.year AND b.month = n.month""")
    return {"job1_portal_catalog": catalog, "job2_flux_archive": archive}
