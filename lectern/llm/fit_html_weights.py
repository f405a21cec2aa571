"""Fit the weights of the page model to the example pages and write them beside it: ``python -m lectern.llm.fit_html_weights``."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import SparkSession

from lectern.llm import html_extract

#: Smaller weights are left out; they are those of names that only one page or two have.
LEAST_WEIGHT = 0.05


def pages_digest(pages: list[str]) -> str:
    """Tells which pages the weights were fitted to."""
    return hashlib.sha256("\n".join(pages).encode()).hexdigest()


def main() -> None:
    spark = SparkSession.builder.appName("fit-html-weights").config("spark.driver.memory", "4g").getOrCreate()
    model = html_extract.train(html_extract.example_frame(spark))
    own = {str(k): round(float(model.own[k]), 3) for k in np.flatnonzero(np.abs(model.own) >= LEAST_WEIGHT)}
    held = {"pages": pages_digest(html_extract.example_pages()), "pair": model.pair.round(3).tolist(), "own": own}
    html_extract.WEIGHTS.write_text(json.dumps(held, indent=0) + "\n")


if __name__ == "__main__":
    main()
