"""Linear combinations of categories: `fossil + 0.4*fires - ocean`."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<sign>[+-])|(?P<times>\*))")


def terms(text: str) -> dict[str, float]:
    """Coefficients by category; signs, exponents, `2*a`, `a*2` and repeated categories are allowed."""
    out: dict[str, float] = {}
    at, sign, factor, name, open_ = 0, 1.0, 1.0, None, True

    def close() -> None:
        nonlocal sign, factor, name
        if name is None:
            raise ValueError(f"a term without category in: {text}")
        out[name] = out.get(name, 0.0) + sign * factor
        sign, factor, name = 1.0, 1.0, None

    text = text.rstrip()
    while at < len(text):
        got = _TOKEN.match(text, at)
        if not got:
            raise ValueError(f"unexpected {text[at:]!r} in: {text}")
        at = got.end()
        if got["sign"]:
            if not open_:
                close()
            sign *= -1.0 if got["sign"] == "-" else 1.0
            open_ = True
        elif got["times"]:
            if open_:
                raise ValueError(f"nothing to multiply in: {text}")
            open_ = True
        else:
            if not open_:
                raise ValueError(f"a sign is missing in: {text}")
            if got["name"]:
                if name is not None:
                    raise ValueError(f"a product of categories in: {text}")
                name = got["name"]
            else:
                factor *= float(got["number"])
            open_ = False
    if open_:
        raise ValueError(f"unfinished: {text!r}")
    close()
    return out


def to_text(coefficients: dict[str, float]) -> str:
    parts = [f"{'-' if c < 0 else '+'} {abs(c):g}*{n}" if abs(c) != 1 else f"{'-' if c < 0 else '+'} {n}" for n, c in coefficients.items()]
    return " ".join(parts).removeprefix("+ ")


def terms_table(spark: SparkSession, definitions: dict[str, str]) -> DataFrame:
    rows = [(meta, category, c) for meta, text in definitions.items() for category, c in terms(text).items()]
    return spark.createDataFrame(rows, "meta string, category string, coeff double")
