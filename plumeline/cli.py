"""Transport from the command line, over Parquet tables: forward, adjoint and their test."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from plumeline.operators import footprints, transport
from plumeline.session import session


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="plumeline")
    out.add_argument("-f", "--forward", action="store_true")
    out.add_argument("-a", "--adjoint", action="store_true")
    out.add_argument("-t", "--adjtest", action="store_true")
    out.add_argument("--check-footprints", action="store_true", help="leave out observations without a footprint")
    out.add_argument("--max-footprint-length", type=int, help="steps of a footprint to keep")
    out.add_argument("--obs", required=True)
    out.add_argument("--emis", required=True)
    out.add_argument("--footprints", required=True)
    out.add_argument("--out", help="where results are written")
    return out


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = session()
    obs, flux, fp = (spark.read.parquet(p) for p in (a.obs, a.emis, a.footprints))
    fp = transport.unique_footprints(fp)
    if a.max_footprint_length is not None:
        fp = footprints.trimmed(fp, a.max_footprint_length)
    if a.check_footprints:
        obs = obs.join(fp.select("obsid"), "obsid", "left_semi")
    if a.forward:
        transport.total(obs, transport.forward(obs, fp, flux)).write.mode("overwrite").parquet(f"{a.out}/observations")
    if a.adjoint:
        categories = flux.select("tracer", "category").distinct()
        transport.adjoint_by_category(obs.select("obsid", "tracer", "dy"), fp, categories).write.mode("overwrite").parquet(f"{a.out}/adjoint")
    if a.adjtest:
        found = transport.adjoint_test(obs, fp, flux).select(F.col("difference")).first()
        print(f"adjoint test: {found['difference']:.3g}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
