"""Pages from the web, from files and from tables.

Offline sources are plain Spark readers.  ``fetch`` gets URLs inside tasks: rows are spread by host,
each task keeps one opener, waits between requests to a host, and retries what timed out but not
what the server refused.  Failures are rows with an error.
"""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.urls import netloc

AGENT = "Mozilla/5.0 (compatible; newsloom)"


@dataclass(frozen=True)
class FetchConfig:
    timeout: float = 15.0
    retries: int = 2
    retry_delay: float = 1.0
    delay: tuple[float, float] = (1.0, 2.0)
    headers: dict[str, str] = field(default_factory=dict)
    tasks: int = 64


def open_url(url: str, config: FetchConfig) -> tuple[bytes | None, str | None]:
    """(body, content type) of one request; raises what urllib raises."""
    headers = {"User-Agent": AGENT, "Accept": "text/html,*/*;q=0.8", "Accept-Language": "en;q=0.8,*;q=0.5"} | config.headers
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=config.timeout) as response:
        return response.read(), response.headers.get("Content-Type")


def attempt(url: str, config: FetchConfig, opener: Callable = open_url) -> tuple[bytes | None, str | None, str | None]:
    """(body, content type, error) after up to ``retries`` further attempts; HTTP statuses are not retried."""
    error = None
    for k in range(config.retries + 1):
        try:
            body, kind = opener(url, config)
            return body, kind, None
        except urllib.error.HTTPError as e:
            return None, None, f"HTTP {e.code}"
        except TimeoutError:
            error = "timeout"
        except (urllib.error.URLError, OSError, ValueError) as e:
            error = f"{type(e).__name__}: {e}"
        if k < config.retries:
            time.sleep(config.retry_delay)
    return None, None, error


def fetch(urls: DataFrame, config: FetchConfig = FetchConfig(), opener: Callable = open_url) -> DataFrame:
    """(url, body, content_type, error) of each row of ``urls``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, bool] = {}
        for batch in batches:
            rows = []
            for url, host in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if last.get(host):
                    time.sleep(random.uniform(*config.delay))
                last[host] = True
                rows.append(attempt(url, config, opener))
            body, kind, error = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(body, pa.binary()), pa.array(kind, pa.string()), pa.array(error, pa.string())], ["url", "body", "content_type", "error"])

    spread = urls.select("url", netloc(F.col("url")).alias("host")).repartition(config.tasks, "host")
    return spread.mapInArrow(run, "url string, body binary, content_type string, error string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, body) of saved pages: their paths and bytes."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), F.col("content").alias("body"))


def as_json(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the other columns as one JSON string; ``raw_html`` is left out."""
    fields = [c for c in rows.columns if c not in keys and c != "raw_html"]
    return rows.select(*keys, F.to_json(F.struct(*fields)).alias("json"))
