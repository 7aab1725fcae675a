"""Reading and writing observations, fluxes and state: CSV in a tar file, and Parquet."""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import tarfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIME_FORMAT = "yyyyMMddHHmmss"


def observations_from_tar(spark: SparkSession, path: str, obs_schema: str, site_schema: str) -> tuple[DataFrame, DataFrame]:
    """observations.csv and sites.csv of a tar.gz file, whose times are digits only. The archive is opened on the driver."""
    out = []
    with tarfile.open(path, "r:gz") as archive:
        for name, schema in (("observations.csv", obs_schema), ("sites.csv", site_schema)):
            lines = archive.extractfile(name).read().decode("utf-8").splitlines()
            rows = spark.createDataFrame([(line,) for line in lines[1:]], "value string")
            parsed = rows.select(F.from_csv("value", F.lit(schema), {"timestampFormat": TIME_FORMAT}).alias("r")).select("r.*")
            out.append(parsed)
    return out[0], out[1]


def observations_to_tar(obs: DataFrame, sites: DataFrame, path: str) -> None:
    """Both tables as CSV in one tar.gz file. It is one file by its nature: rows come to the driver a partition at a time."""
    with tarfile.open(path, "w:gz") as archive:
        for name, table in (("observations.csv", obs), ("sites.csv", sites)):
            text = io.StringIO()
            writer = csv.writer(text)
            writer.writerow(table.columns)
            kinds = dict(table.dtypes)
            shown = table.select(*[F.date_format(c, TIME_FORMAT).alias(c) if kinds[c].startswith("timestamp") else c for c in table.columns])
            for row in shown.toLocalIterator():
                writer.writerow(["" if v is None else v for v in row])
            data = text.getvalue().encode("utf-8")
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))


def without_nan(table: DataFrame) -> DataFrame:
    """Null in place of not-a-number in all columns of floating point."""
    kinds = dict(table.dtypes)
    return table.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in table.columns if kinds[c] in ("float", "double")})


def write_flux(flux: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A flux cube by tracer and category, so that readers prune what they don't ask for."""
    flux.write.mode(mode).partitionBy("tracer", "category").parquet(path)


def read_flux(spark: SparkSession, path: str, tracers: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    if tracers is not None:
        rows = rows.filter(F.col("tracer").isin(tracers))
    if categories is not None:
        rows = rows.filter(F.col("category").isin(categories))
    return rows


def files_for_months(names: Iterable[str], prefix: str, months: list[str]) -> list[str]:
    """For each month (`2018-01`) the monthly file of a prefix, else the yearly, else the static one; each file once, in order."""
    names = list(names)
    out: list[str] = []
    for month in months:
        for tag in (f"{month}", month[:4], ""):
            found = sorted(fnmatch.filter(names, f"{prefix}{tag}.*" if tag else f"{prefix[:-1] if prefix.endswith('.') else prefix}.*"))
            found = [f for f in found if tag or "." not in f[len(prefix) :].lstrip(".")]
            if found:
                out += [f for f in found if f not in out]
                break
        else:
            raise FileNotFoundError(f"no file of {prefix} for {month}")
    return out


def flux_from_parts(spark: SparkSession, parts: list[dict]) -> DataFrame:
    """One cube of many tables: each part has path, tracer, category and the name of its value column."""
    out = None
    for p in parts:
        rows = spark.read.parquet(p["path"]).select(F.lit(p["tracer"]).alias("tracer"), F.lit(p["category"]).alias("category"), "itim", "ilat", "ilon", F.col(p.get("field", "flux")).alias("flux"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no parts")
    return out


def write_by(table: DataFrame, path: str, *columns: str, mode: str = "errorifexists") -> None:
    table.write.mode(mode).partitionBy(*columns).parquet(path)


class Bucketed:
    """Tables written by buckets of a column into a new folder, under names of their own; joins and sums by that column need no exchange of them.

    Names and files go when it is closed; a reader may also take the files by their path, without the buckets.
    """

    def __init__(self, spark: SparkSession, folder: str, column: str, buckets: int):
        self.spark, self.folder, self.column, self.buckets, self.names = spark, folder, column, buckets, []

    def __call__(self, table: DataFrame) -> DataFrame:
        name = f"bucketed_{uuid.uuid4().hex}"
        # each task has the rows of whole buckets, so there is one file a bucket
        dealt = table.repartition(self.buckets, self.column)
        dealt.write.bucketBy(self.buckets, self.column).sortBy(self.column).option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def __enter__(self) -> Bucketed:
        return self

    def __exit__(self, *error: object) -> None:
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        root.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(root, True)


def attributes_to_text(attributes: dict) -> str:
    """Metadata with its types: truth values, nothing and numbers stay what they are."""
    return json.dumps(attributes, sort_keys=True)


def attributes_from_text(text: str) -> dict:
    return json.loads(text)


def append_states(spark: SparkSession, path: str, iteration: int, kind: str, values: Iterable[float]) -> None:
    """One more vector of a minimiser's history."""
    spark.createDataFrame([(iteration, kind, [float(v) for v in values])], "iteration int, kind string, vec array<double>").write.mode("append").parquet(path)


def states(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The history, or what came before an iteration from which it is to go on."""
    rows = spark.read.parquet(path)
    return rows if before is None else rows.filter(F.col("iteration") < before)
