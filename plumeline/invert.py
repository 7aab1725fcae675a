"""An inversion from the command line: settings, the section of the machine, and another period."""

from __future__ import annotations

import argparse

from plumeline.functions import timing
from plumeline.plans import configured
from plumeline.session import session
from plumeline.sources import config


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="plumeline.invert")
    out.add_argument("config", help="settings (JSON)")
    out.add_argument("-m", "--machine", help="section that `machine` refers to")
    out.add_argument("-v", "--verbosity", default="WARN", choices=["ALL", "TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "OFF"])
    for name in ("start", "end", "spinup", "spindown"):
        out.add_argument(f"--{name}", help=f"in place of run.{name}")
    return out


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = session()
    spark.sparkContext.setLogLevel(a.verbosity)
    timing.level({"ALL": "DEBUG", "TRACE": "DEBUG", "WARN": "WARNING", "FATAL": "CRITICAL", "OFF": "CRITICAL"}.get(a.verbosity, a.verbosity))
    settings = config.read(a.config, a.machine, run__start=a.start, run__end=a.end, run__spinup=a.spinup, run__spindown=a.spindown)
    run = settings["run"]
    run["tag"] = f"{run.get('tag', 'inversion')}/{run['start'][:10].replace('-', '')}-{run['end'][:10].replace('-', '')}"
    configured.solve(spark, settings)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
