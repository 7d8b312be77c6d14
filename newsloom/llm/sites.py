"""What several operators need to know of a record's site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import checkpointed

#: Sites up to which the table of sites is broadcast; beyond, it is joined by shuffle.
BROADCAST_SITES = 20_000


def small_side(of_sites: DataFrame) -> DataFrame:
    """A relation of one bounded row a site, written once; broadcast if there are at most BROADCAST_SITES of them."""
    written = checkpointed(of_sites)
    return F.broadcast(written) if written.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES else written


def url_host(url: Column) -> Column:
    """Host of a URL in lower case, without port, user and a leading ``www.`` or ``m.``."""
    host = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]+)", 1))
    return F.regexp_replace(host, r"^(?:www|m)\.", "")


def with_site(records: DataFrame, sites: DataFrame, columns: tuple[str, ...] = ("lang",), url: str = "url") -> DataFrame:
    """Records with ``site_key`` (the URL's host) and ``site_<column>`` of the site with that host."""
    small = sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES
    known = sites.select(F.col("host").alias("site_key"), *(F.col(c).alias(f"site_{c}") for c in columns)).dropDuplicates(["site_key"])
    return records.withColumn("site_key", url_host(F.col(url))).join(F.broadcast(known) if small else known, "site_key", "left")


def sample_texts(articles: DataFrame, sites: DataFrame, rows: int) -> list[tuple[str, str | None, str]]:
    """(site language, label, content) of a bounded sample of labelled articles, the same for the same table.

    The sample is the ``rows`` articles with the smallest hash of their id.  A threshold on the hash
    keeps about three times as many for the top-k, so what is gathered does not grow with the table.
    """
    space = 1 << 30
    below = min(space, 3 * rows * space // max(articles.count(), 1) + 1)
    articles = articles.filter(F.pmod(F.xxhash64("article_id"), F.lit(space)) < below)
    picked = articles.filter(F.length("content") >= 200).select("article_id", "url", "language", F.concat_ws("\n", "title", "content").alias("content")).orderBy(F.pmod(F.xxhash64("article_id"), F.lit(1 << 30)), "article_id").limit(rows)
    return [(r["site_lang"], r["language"], r["content"]) for r in with_site(picked, sites).select("site_lang", "language", "content").collect() if r["site_lang"]]
