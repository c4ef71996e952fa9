"""Indicators over HTTP, and files that are fetched once."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from cadastra.sources.tables import macro_table, read_indicator_json

# The service, and the indicators' codes by column.
INDICATOR_URL = "https://api.worldbank.org/v2/country/{country}/indicator/{code}?{query}"
INDICATORS = {"gdp_current_lcu": "NY.GDP.MKTP.CN", "population_total": "SP.POP.TOTL"}


def indicator_url(code: str, first: int, last: int, country: str = "CHN") -> str:
    query = urllib.parse.urlencode({"format": "json", "per_page": 200, "date": f"{first}:{last}"})
    return INDICATOR_URL.format(country=country, code=code, query=query)


def fetch(url: str, timeout: float = 30, tries: int = 3, wait: Callable[[float], None] = time.sleep) -> bytes:
    """A URL's content; after a failure it is tried again, later each time. Raises RuntimeError in the end."""
    for k in range(1, tries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json"}), timeout=timeout) as answer:
                return answer.read()
        except OSError as error:
            if k == tries:
                raise RuntimeError(f"{url} can't be had: {error}") from error
            wait(2 * k)
    raise ValueError("tries must be at least 1")


def read_indicators(spark: SparkSession, first: int, last: int, get: Callable[[str], bytes] = fetch, indicators: dict[str, str] = INDICATORS) -> DataFrame:
    """The macro table of a range of years, from one answer per indicator (a few hundred numbers)."""
    parts = []
    for name, code in indicators.items():
        text = get(indicator_url(code, first, last)).decode()
        answer = json.loads(text)
        if not isinstance(answer, list) or len(answer) < 2 or not isinstance(answer[1], list):
            raise RuntimeError(f"unexpected answer for {code}")
        parts.append(read_indicator_json(spark.createDataFrame([(text,)], "payload string"), "payload", name))
    return macro_table(spark, parts, first, last)


def fetch_once(url: str, path: str, least: int = 0, again: bool = False, get: Callable[[str], bytes] = fetch) -> Path:
    """A file with a URL's content, fetched where it isn't there with ``least`` bytes."""
    file = Path(path)
    if again or not file.exists() or file.stat().st_size < least:
        file.parent.mkdir(parents=True, exist_ok=True)
        part = file.with_name(file.name + ".part")
        part.write_bytes(get(url))
        part.replace(file)
    return file


def extract_first(archive: str, ending: str, folder: str) -> Path:
    """The first file of an archive whose name has an ending, unpacked into a folder."""
    with zipfile.ZipFile(archive) as z:
        name = next((n for n in sorted(z.namelist()) if n.lower().endswith(ending)), None)
        if name is None:
            raise ValueError(f"{archive} has no {ending} file")
        out = Path(folder) / Path(name).name
        out.parent.mkdir(parents=True, exist_ok=True)
        out.write_bytes(z.read(name))
        return out
