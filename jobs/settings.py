"""Settings of a job: a JSON file, over which options of the command line win."""

from __future__ import annotations

import argparse
import json
import logging


def given(doc: str, defaults: str, args: list[str] | None) -> dict:
    """The settings of the file that --config names (else `defaults`), with those given as --name value in their place."""
    first = argparse.ArgumentParser(add_help=False)
    first.add_argument("--config", default=defaults)
    config, rest = first.parse_known_args(args)
    with open(config.config, encoding="utf-8") as f:
        settings = json.load(f)
    parser = argparse.ArgumentParser(description=doc.strip().splitlines()[0], parents=[first], formatter_class=argparse.RawDescriptionHelpFormatter, epilog=doc)
    for name, value in settings.items():
        kind = json.loads if isinstance(value, (dict, list)) else str if value is None else type(value)
        parser.add_argument(f"--{name.replace('_', '-')}", type=kind, default=value)
    logging.basicConfig(format="%(asctime)s %(levelname)s %(name)s: %(message)s", level=logging.INFO)
    out = vars(parser.parse_args(rest))
    out.pop("config")
    return out
