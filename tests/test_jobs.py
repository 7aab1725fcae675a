"""The jobs over growing and repeated input, on copies, and after runs that broke."""

import glob
import hashlib
import json
import os
import re
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from jobs import flux_archive, portal_catalog, registered, settings
from plumeline.sources import archive, shared
from tests.test_queries import DATA, duck, rows  # noqa: F401

PAGE = "page_id long, url string, html string"


def page(title, lang="en", links=1):
    return f'<html lang="{lang}"><head><title>{title}</title></head>' + '<a class="x" href="/y">' * links + "</html>"


FIRST = [
    (1, "https://www.portal.org/objects/a.nc?x=1", page("Flux [2018] é a.nc")),
    (2, "http://portal.org/objects/b.nc#top", page("b.nc", "fr", 2)),
    (3, "https://m.portal.org/objects/a.nc", page("Flux [2018] é a.nc")),
    (3, "https://m.portal.org/objects/a.nc", page("Flux [2018] é a.nc")),
    (4, None, None),
]
SECOND = [
    (7, "https://portal.org/objects/a.nc", page("newer a.nc")),
    (5, "https://portal.org/objects/a.nc", page("older a.nc")),
    (None, "https://portal.org/objects/c.nc", "no markup <TITLE>C\n.nc</TITLE>"),
    (8, "https://portal.org/objects/b.nc", page("b.nc", "fr", 2)),
]


def expected(pages):
    """The catalogue by plain Python."""
    versions = {}
    for n, url, html in pages:
        at = re.sub(r"(?s)[?#].*$", "", re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://(www\.|m\.)?", "", url or ""))
        html = html or ""
        title = (re.findall(r"(?is)<title[^>]*>(.*?)</title>", html) or [""])[0]
        row = versions.setdefault((at, hashlib.sha256(html.encode()).hexdigest()), [title, "".join(c for c in title if "-" <= c <= "z" and c not in "[]"), (re.findall(r'<html[^>]*\slang="([^"]*)"', html) or [""])[0], html.count("<a "), len(html), []])
        row[5].append(n)
    number = lambda ids: [i for i in ids if i is not None]
    out = []
    for (at, sha), (*said, ids) in versions.items():
        rank = lambda key: (max(number(versions[key][5]), default=-1), key[1])
        current = max((k for k in versions if k[0] == at), key=rank) == (at, sha)
        out.append((at, sha, *said, min(number(ids), default=None), max(number(ids), default=None), len(ids), current))
    return sorted(out, key=repr)


@pytest.fixture
def portal(spark, tmp_path):
    """A folder to which harvests are added, and a run of the job."""

    class Portal:
        source, output, checkpoint = f"{tmp_path}/harvest", f"{tmp_path}/out", f"{tmp_path}/checkpoint"

        def add(self, pages):
            spark.createDataFrame(pages, PAGE).coalesce(1).write.mode("append").parquet(self.source)

        def run(self):
            return portal_catalog.run(spark, self.source, self.output, self.checkpoint)

        def catalog(self):
            return sorted((tuple(r)[:-1] for r in portal_catalog.catalog(spark, self.output).collect()), key=repr)

    return Portal()


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_growing_harvest(portal):
    portal.add(FIRST)
    assert portal.run()["read"] == len(FIRST)
    assert portal.catalog() == expected(FIRST)
    before = files(portal.output)
    assert portal.run() == {"read": 0, "renewed": []} and files(portal.output) == before
    portal.add(SECOND)
    again = portal.run()
    assert again["read"] == len(SECOND) and 0 < len(again["renewed"]) <= 3
    assert portal.catalog() == expected(FIRST + SECOND)
    current = {r[0]: r[2] for r in portal.catalog() if r[-1]}
    assert current["portal.org/objects/a.nc"] == "newer a.nc"


def test_catalog_after_broken_runs(portal, spark, monkeypatch):
    """A run that breaks before or while it renews is made good by the next; so is a part that is lost."""
    portal.add(FIRST)
    monkeypatch.setattr(portal_catalog, "renewed", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        portal.run()
    monkeypatch.undo()
    assert portal.catalog() == []
    portal.add(SECOND)
    assert portal.run()["read"] == len(SECOND)
    assert portal.catalog() == expected(FIRST + SECOND)
    lost = glob.glob(f"{portal.output}/catalog/part=*")[0]
    os.rename(lost, f"{portal.output}-lost")
    assert portal.run() == {"read": 0, "renewed": [lost.rpartition("=")[2]]}
    assert portal.catalog() == expected(FIRST + SECOND)


def test_order_of_harvests(portal):
    portal.add(SECOND)
    portal.run()
    portal.add(FIRST)
    portal.run()
    assert portal.catalog() == expected(FIRST + SECOND)


def test_no_harvest(portal, spark):
    spark.createDataFrame([], PAGE).write.parquet(portal.source)
    assert portal.run() == {"read": 0, "renewed": []} and portal.catalog() == []


def cube(spark, output):
    """Rows of an archive; sums may differ in their last bit."""
    return sorted((*r[:3], f"{r[3]:.12g}", *r[4:]) for r in archive.rows(spark, f"{output}/fluxes").collect())


def test_archive_a_year_at_a_time(spark, tmp_path):
    """Runs by year give what one run gives; a repeated one changes nothing."""
    whole, parts = f"{tmp_path}/whole", f"{tmp_path}/parts"
    counts = flux_archive.run(spark, DATA, whole, combined=registered.COMBINED)
    assert counts["read"] == counts["archived"] > counts["budgets"] > 0
    for start, end in ((None, "1994-01"), ("1994-01", "1996-07"), ("1996-07", None), ("1994-01", "1996-07")):
        flux_archive.run(spark, DATA, parts, start, end, registered.COMBINED)
    assert cube(spark, whole) == cube(spark, parts)
    amounts = lambda out: sorted(map(tuple, flux_archive.archived(spark, out).selectExpr("tracer", "category", "year", "month", "round(amount, 6)").distinct().collect()))
    assert amounts(whole) == amounts(parts)


def test_archive_of_no_month(spark, tmp_path):
    counts = flux_archive.run(spark, DATA, f"{tmp_path}/out", "2030-01", "2031-01")
    assert counts["read"] == counts["archived"] == counts["budgets"] == 0


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_registered(spark, duck, name):  # noqa: F811
    kept = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    assert rows(registered.QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(registered.oracle_sql()[name]).df())
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == kept
    assert name in __spark_entry__.queries() and name in __spark_entry__.oracle_sql()


def test_settings(tmp_path):
    path = f"{tmp_path}/job.json"
    with open(path, "w") as f:
        json.dump({"source": "a", "start": None, "digits": 1, "combined": {"x": "y"}}, f)
    assert settings.given("Doc", path, []) == {"source": "a", "start": None, "digits": 1, "combined": {"x": "y"}}
    assert settings.given("Doc", "none", ["--config", path, "--start", "1995-01", "--digits", "2", "--combined", "{}"]) == {"source": "a", "start": "1995-01", "digits": 2, "combined": {}}


def test_command_line(tmp_path):
    """A job from its command line, in a process of its own."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    told = subprocess.run(
        [sys.executable, "-m", "jobs.portal_catalog", "--source", f"{DATA}/pages.parquet", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/checkpoint"],
        cwd=root, capture_output=True, text=True, timeout=300, check=True,
    )
    n = duckdb.sql(f"select count(*) from '{DATA}/pages.parquet'").fetchall()[0][0]
    assert f"read {n} new pages" in told.stderr and glob.glob(f"{tmp_path}/out/catalog/part=*/*.parquet")


def test_jobs_need_no_corpus_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for f in [*glob.glob(f"{root}/jobs/*.py"), __file__]:
        with open(f) as source:
            assert not re.search(r"^\s*(from|import) .*(\bllm\b|corpus_pipeline)", source.read(), re.MULTILINE)


def test_watched():
    assert shared.watched("/a/b.parquet") == "/a/b.parque[t]" and shared.watched("/a/b/") == "/a/b/"
