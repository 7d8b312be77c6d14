"""One UTC second per record from times written in mixed formats and zones.

Each source writes its all-numeric dates in a mixture of orders (day-month-year, month-day-year,
year-month-day).  A value counts for every order under which it is an existing date; how long
before the crawl that date would lie is its likelihood.  Expectation-maximisation per source over
the counts of such patterns gives the weights of the orders (with the order that the source is
known for as prior), and the posterior of each value chooses its reading.  A value whose best
posterior stays under ``certain`` is marked ambiguous.

Only counts per source and pattern are shuffled: at most a few hundred rows a source, whatever
the number of records, so a source with a third of all rows costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.urls import site_host
from newsloom.session import checkpointed
from newsloom.timestamps.parse import ORDERS, epoch_seconds, read

#: Likelihood of the lag between a stated time and its crawl: later than the crawl by over a day,
#: up to two days before it, up to forty days, longer.
LAGS = (0.001, 0.6, 0.3, 0.1)
#: Prior counts of the order that a source is known for, and of each other order.
PRIOR_KNOWN, PRIOR_OTHER = 8.0, 0.1
#: Sources up to which their weights are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Rows that can have more than one reading: two or three one- or two-digit numbers with separators.
NUMERIC = r"(?<![0-9０-９])[0-9０-９]{1,2}\s?[-/.／．－]\s?[0-9０-９]{1,2}(?![0-9０-９])"


def utc_second(column: str, kind: str) -> Column:
    """Whole UTC seconds of a timestamp (with or without zone; without means UTC) or an ISO string."""
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")
    return F.expr(f"cast(floor(unix_micros(try_cast(`{column}` as timestamp)) / 1000000) as bigint)")


def readings(text: str | None, tz: str | None, lang: str | None, crawl: int) -> dict[str, int] | None:
    """``read`` where an unknown zone counts as UTC and a time beyond the calendar as none."""
    try:
        return read(text, tz or "UTC", lang, crawl)
    except KeyError:  # no such zone
        return read(text, "UTC", lang, crawl)
    except (OverflowError, ValueError, OSError):
        return None


def lag_bin(seconds: int) -> int:
    days = seconds / 86400
    return 0 if days < -1 else 1 if days <= 2 else 2 if days <= 40 else 3


def fit_source(bins: np.ndarray, counts: np.ndarray, known: str | None, rounds: int = 60) -> np.ndarray:
    """Weights of ORDERS from patterns of lag bins (one row a pattern, -1: no valid date)."""
    like = np.where(bins >= 0, np.array(LAGS)[np.maximum(bins, 0)], 0.0)
    prior = np.array([PRIOR_KNOWN if o == known else PRIOR_OTHER for o in ORDERS])
    weights = prior / prior.sum()
    for _ in range(rounds):
        joint = like * weights
        total = joint.sum(1, keepdims=True)
        share = np.divide(joint, total, out=np.zeros_like(joint), where=total > 0)
        new = (share * counts[:, None]).sum(0) + prior
        new /= new.sum()
        if np.abs(new - weights).max() < 1e-9:
            break
        weights = new
    return weights


def choose(readings: dict[str, int], weights: list[float], crawl: int) -> tuple[int, str, float]:
    """Second, order and posterior of the likeliest reading."""
    if "" in readings:
        return readings[""], "", 1.0
    joint = {o: weights[k] * LAGS[lag_bin(crawl - readings[o])] for k, o in enumerate(ORDERS) if o in readings}
    best = max(joint, key=joint.get)
    same = sum(v for o, v in joint.items() if readings[o] == readings[best])
    return readings[best], best, same / (sum(joint.values()) or 1.0)


def source_weights(records: DataFrame, known_orders: bool = True) -> DataFrame:
    """``(source_key, weights)`` by expectation-maximisation over the counts of patterns, with the known order as prior."""

    def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, tz, lang, known, text, crawl in pdf.itertuples(index=False):
                found = readings(text, tz, lang, int(crawl))
                if found and "" not in found:
                    rows.append((key, known, *(lag_bin(int(crawl) - found[o]) if o in found else -1 for o in ORDERS)))
            yield pd.DataFrame(rows, columns=["source_key", "known", *ORDERS])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        weights = fit_source(pdf[list(ORDERS)].to_numpy(), pdf["n"].to_numpy(float), pdf["known"].iloc[0] if known_orders else None)
        return pd.DataFrame({"source_key": [pdf["source_key"].iloc[0]], "weights": [weights.tolist()]})

    numeric = records.filter(F.col("stated").rlike(NUMERIC) & F.col("crawl").isNotNull())
    counted = (
        numeric.select("source_key", "tz", "lang", "known", "stated", "crawl")
        .mapInPandas(patterns, "source_key string, known string, dmy int, mdy int, ymd int")
        .groupBy("source_key", "known", *ORDERS)
        .agg(F.count("*").alias("n"))
    )
    return counted.groupBy("source_key").applyInPandas(fit, "source_key string, weights array<double>")


def normalize_times(records: DataFrame, sites: DataFrame, certain: float = 0.9, known_orders: bool = True) -> DataFrame:
    """One row for each record that states an instant.  Without ``known_orders``, the orders that sites declare are not used:
    the records alone tell the order of their source.

    ``records``: record_kind, record_id, url, stated (string), counted (bigint), crawl (UTC second).
    ``sites``: host, tz, lang, date_order; one row a host.
    Result: record_kind, record_id, utc_second, basis ('stated' or 'counted'), date_order (null
    where it does not matter), posterior, ambiguous.

    Defined cases: a null, blank or impossible ``stated`` falls back on ``counted``; neither gives
    no row; a host without a site is read in UTC and marked ambiguous if a zone was needed; a
    null ``crawl`` allows only readings that need none; repeated records give repeated rows; an
    empty table gives an empty result; very long strings are read like any other.
    """
    hosts = sites.select(F.col("host").alias("source_key"), F.col("tz"), F.col("lang"), F.col("date_order").alias("known")).dropDuplicates(["source_key"])
    small = sites.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    bounded = F.broadcast if small else (lambda df: df)
    keyed = records.select("record_kind", "record_id", "stated", "counted", "crawl", site_host(F.col("url")).alias("source_key")).join(bounded(hosts), "source_key", "left")
    # one row a host with all-numeric dates, of which there can be more than sites
    weights = checkpointed(source_weights(keyed, known_orders))
    few = weights.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    ready = keyed.join(F.broadcast(weights) if few else weights, "source_key", "left")
    schema = "record_kind string, record_id bigint, utc_second bigint, basis string, date_order string, posterior double, ambiguous boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for kind, rid, text, count, crawl, tz, lang, known, weights in zip(*columns, strict=True):
                found = readings(text, tz, lang, crawl if crawl is not None else 0)
                if found is not None:
                    if weights is None:
                        weights = fit_source(np.full((1, 3), -1), np.zeros(1), known if known_orders else None).tolist()
                    second, order, sure = choose(found, weights, crawl or 0)
                    out.append((kind, rid, second, "stated", order or None, sure, sure < certain or tz is None))
                elif (second := epoch_seconds(count)) is not None:
                    out.append((kind, rid, second, "counted", None, 1.0, False))
            names = ["record_kind", "record_id", "utc_second", "basis", "date_order", "posterior", "ambiguous"]
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_()]
            cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return ready.select("record_kind", "record_id", "stated", "counted", "crawl", "tz", "lang", "known", "weights").mapInArrow(run, schema)


def publication_times(items: DataFrame, articles: DataFrame, sites: DataFrame, known_orders: bool = True) -> DataFrame:
    """``normalize_times`` over news items and articles."""
    a = items.select(
        F.lit("item").alias("record_kind"), F.col("item_id").alias("record_id"), "url", F.col("publish_time").alias("stated"),
        F.col("timestamp").alias("counted"), utc_second("seen_at", items.schema["seen_at"].dataType.simpleString()).alias("crawl"),
    )
    b = articles.select(
        F.lit("article").alias("record_kind"), F.col("article_id").alias("record_id"), "url", F.col("publish_time").alias("stated"),
        F.lit(None).cast("bigint").alias("counted"), utc_second("crawled_at", articles.schema["crawled_at"].dataType.simpleString()).alias("crawl"),
    )
    return normalize_times(a.unionByName(b), sites, known_orders=known_orders)
