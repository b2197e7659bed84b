"""Tiles behind a TileJSON address: one request for the description, one a tile from the tasks."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tesselon.plans.tileset import TileJSON
from tesselon.sources.features import coordinates


def fetch(url: str, retries: int = 3, wait: float = 0.5) -> bytes | None:
    """The body, or None where there is nothing; other failures are tried again, then raised."""
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(url, timeout=30) as answer:  # noqa: S310
                return answer.read() or None
        except urllib.error.HTTPError as error:
            if error.code in (204, 404):
                return None
            if attempt == retries or error.code < 500 and error.code != 429:
                raise
        except urllib.error.URLError:
            if attempt == retries:
                raise
        time.sleep(wait * 2**attempt)
    return None


#: Tiles of a frame that a task hands on.
FRAME_TILES = 256


def read_tilejson(spark: SparkSession, url: str, max_retries: int = 3, tasks: int = 4) -> tuple[DataFrame, TileJSON]:
    """Tiles of the address within the described bounds and levels. tasks bounds the requests at once."""
    text = json.loads(fetch(url, max_retries))
    bounds = tuple(text.get("bounds") or (-180.0, -85.05112877980659, 180.0, 85.05112877980659))
    levels = range(text.get("minzoom", 0), text.get("maxzoom", 22) + 1)
    template = text["tiles"][0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for z, x, y in batch[["z", "x", "y"]].itertuples(index=False):
                data = fetch(template.replace("{z}", str(z)).replace("{x}", str(x)).replace("{y}", str(y)), max_retries)
                if data is not None:
                    rows.append((z, x, y, data))
                if len(rows) == FRAME_TILES:
                    yield pd.DataFrame(rows, columns=["z", "x", "y", "data"])
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["z", "x", "y", "data"])

    keys = coordinates(spark, levels, bounds).repartition(tasks)
    return keys.mapInPandas(run, "z long, x long, y long, data binary"), replace(TileJSON.from_dict(text), bounds=bounds, minzoom=levels.start, maxzoom=levels.stop - 1)
