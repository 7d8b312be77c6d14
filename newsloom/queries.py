"""Queries of the core operators; their SQL is in ``newsloom.oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import oracles
from newsloom.functions import encoding, times, titles, urls
from newsloom.operators import clustering, links, patterns, similarity, zones
from newsloom.plans.article import is_valid, parse_articles
from newsloom.plans.collect import collect, list_results as page_results, page_counts, success_counts as counts_of, timed_items, with_articles
from newsloom.samples import BODIES, FETCHED, LISTS, NAMES, NODES, PAIRS, SIMILAR_ROWS, STORIES, TEMPLATES, TIMES, TITLES, URLS
from newsloom.session import checkpointed, table
from newsloom.sources.dom import dom_nodes
from newsloom.sources.web import as_json
from newsloom.timestamps.mixture import publication_times

Query = Callable[[SparkSession, str], DataFrame]


def literal(spark: SparkSession, rows: list, names: list[str]) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ", ".join(f"{n} string" for n in names))


def all_urls(spark: SparkSession, sf: str) -> DataFrame:
    parts = [table(spark, sf, t).select("url") for t in ("news_items", "articles", "pages_in", "seeds")]
    out = literal(spark, URLS, ["url"])
    for p in parts:
        out = out.unionByName(p)
    return out.filter(F.col("url").isNotNull()).distinct()


def all_pairs(spark: SparkSession, sf: str) -> DataFrame:
    items, pages = table(spark, sf, "news_items"), table(spark, sf, "pages_in")
    found = items.select("page_id", "url").join(pages.select("page_id", F.col("base_url").alias("base")), "page_id").select("url", "base")
    return found.unionByName(literal(spark, PAIRS, ["url", "base"])).distinct()


def domains(spark: SparkSession, sf: str) -> DataFrame:
    return all_urls(spark, sf).select(urls.netloc(F.col("url")).alias("domain")).distinct()


def item_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "news_items").filter(F.col("url").isNotNull()).select("page_id", "url").distinct()


def host_urls(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = table(spark, sf, name).filter(F.col("url").isNotNull())
    return rows.select(urls.site_host(F.col("url")).alias("host"), "url").distinct()


def of_urls(columns: Callable[[], list]) -> Query:
    return lambda spark, sf: all_urls(spark, sf).select("url", *columns())


def of_pairs(columns: Callable[[], list]) -> Query:
    return lambda spark, sf: all_pairs(spark, sf).select("url", "base", *columns())


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of the pages kept as text alone, which is what SQL can state; all pages: ``all_page_links``."""
    return links.scan_links(table(spark, sf, "pages_in").filter(F.col("html").isNotNull()))


def title_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "news_items").select("title").unionByName(literal(spark, TITLES, ["title"])).filter(F.col("title").isNotNull()).distinct()


def time_texts(spark: SparkSession, sf: str) -> DataFrame:
    found = [table(spark, sf, t).select(F.col("publish_time").alias("text")) for t in ("news_items", "articles")]
    return literal(spark, TIMES, ["text"]).unionByName(found[0]).unionByName(found[1]).filter(F.col("text").isNotNull()).distinct()


def of_titles(columns: Callable[[], list]) -> Query:
    return lambda spark, sf: title_texts(spark, sf).select("title", *columns())


def of_times(columns: Callable[[], list]) -> Query:
    return lambda spark, sf: time_texts(spark, sf).select("text", *columns())


def components(spark: SparkSession, sf: str) -> DataFrame:
    return all_urls(spark, sf).select("url", urls.url_components(F.col("url")).alias("c"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found = publication_times(*(table(spark, sf, t) for t in ("news_items", "articles", "sites")))
    return found.select("record_kind", "record_id", "utc_second")


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.anchor_urls(item_urls(spark, sf), ["page_id"])


def similar(spark: SparkSession, sf: str) -> DataFrame:
    everything, samples = item_urls(spark, sf), checkpointed(anchors(spark, sf))
    found = similarity.similar_urls(samples, everything.join(samples, ["page_id", "url"], "left_anti"), ["page_id"])
    return found.withColumn("score", F.round("score", 6))


def url_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Score of each pair of literal URLs of one site."""
    c = literal(spark, URLS, ["url"]).select("url", urls.url_components(F.col("url")).alias("c")).withColumn("root", urls.root_key(F.col("c.domain")))
    a, b = c.select("root", F.col("url").alias("url_a"), F.col("c").alias("a")), c.select("root", F.col("url").alias("url_b"), F.col("c").alias("b"))
    return a.join(b, "root").select("url_a", "url_b", F.round(similarity.similarity(F.col("a"), F.col("b")), 6).alias("score"))


def site_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.learn_patterns(host_urls(spark, sf, "articles"), ["host"])


def contained(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "news_items").withColumn("container", F.col("pos") % 3)


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return links.merge_lists(contained(spark, sf), ties=("item_id",)).select("item_id", "page_id", "url")


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Items with the article of their URL: the article's fields, else the item's."""
    items, articles = table(spark, sf, "news_items"), table(spark, sf, "articles")
    joined = with_articles(items.select("item_id", "url", "title", "publish_time"), articles.select("article_id", "url", "title", "publish_time", "content", "success"), ["article_id"])
    return joined.select("item_id", "article_id", "title", "publish_time", "fetched")


def success_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counts_of(table(spark, sf, "articles"), "source")


def list_results(spark: SparkSession, sf: str) -> DataFrame:
    return page_counts(table(spark, sf, "pages_in"), table(spark, sf, "news_items"))


def set_operation(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        a, b = (table(spark, sf, t).filter(F.col("url").isNotNull()).select("url") for t in ("news_items", "articles"))
        return {"union": lambda: a.union(b).distinct(), "intersect": lambda: a.intersect(b), "except": lambda: a.subtract(b)}[name]()

    return run


def decoded(spark: SparkSession, sf: str) -> DataFrame:
    """List pages with their text, decoded where only bytes are kept."""
    pages = table(spark, sf, "pages_in")
    page = encoding.decoded_page(F.col("html"), F.col("body"), F.col("content_type"))
    return pages.select("page_id", "url", "base_url", "fetched_at", page["text"].alias("html"))


def all_page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of all list pages, those kept as bytes included."""
    return links.scan_links(decoded(spark, sf))


def lit_links(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the links whose URL is an anchor of its page: (page_id, node, path)."""
    pages = decoded(spark, sf)
    nodes = dom_nodes(pages).filter("tag = 'a' and href is not null")
    full = nodes.join(pages.select("page_id", "base_url"), "page_id").select("page_id", "node", "path", urls.absolute(F.col("href"), F.col("base_url")).alias("url"), "base_url")
    # written once: every later rule refers to the absolute URL, and a page is shredded once
    found = checkpointed(checkpointed(full).filter(urls.news_candidate(F.col("url"), F.col("base_url"))).select("page_id", "node", "path", "url"))
    return found.join(clustering.anchor_urls(found, ["page_id"]), ["page_id", "url"], "left_semi").select("page_id", "node", "path")


def article_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "articles").filter(F.col("raw_html").isNotNull()).select("article_id", "url", F.col("raw_html").alias("html"))


def collect_report(spark: SparkSession, sf: str) -> DataFrame:
    return collect(decoded(spark, sf), article_pages(spark, sf))[1]


def collected_articles(spark: SparkSession, sf: str) -> DataFrame:
    return collect(decoded(spark, sf), article_pages(spark, sf))[0]


def items_as_json(spark: SparkSession, sf: str) -> DataFrame:
    return as_json(table(spark, sf, "news_items").select("item_id", "title", "url", "publish_time", "timestamp"), ["item_id"]).withColumnRenamed("json", "item")


def literal_nodes(spark: SparkSession) -> DataFrame:
    """The literal nodes with their paths from the root: (page_id, node, path, lit)."""
    parents = {(page, n): p for page, n, p, _ in NODES}

    def path(page: int, n: int) -> list[int]:
        return [*path(page, parents[page, n]), n] if n else []

    return spark.createDataFrame([(page, n, path(page, n), lit) for page, n, _, lit in NODES], "page_id bigint, node int, path array<int>, lit boolean")


def literal_lit(spark: SparkSession) -> DataFrame:
    return literal_nodes(spark).filter("lit").select("page_id", "node", "path")


def literal_lists(spark: SparkSession) -> DataFrame:
    pages = spark.createDataFrame(LISTS, "page_id bigint, url string, html string")
    return pages.select("page_id", "url", F.col("url").alias("base_url"), "html", F.timestamp_seconds(F.lit(FETCHED)).alias("fetched_at"))


def literal_collected(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return collect(literal_lists(spark), spark.createDataFrame(STORIES, "url string, html string"))


def literal_similar(spark: SparkSession, sf: str) -> DataFrame:
    """Similar URLs of literal samples and candidates."""
    rows = spark.createDataFrame(SIMILAR_ROWS, "page_id bigint, sample string, url string")
    found = similarity.similar_urls(rows.filter("sample = '1'"), rows.filter("sample = '0'"), ["page_id"])
    return found.withColumn("score", F.round("score", 6))


def literal_decoded(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(BODIES, "id bigint, body string, content_type string").withColumn("body", F.unhex("body"))
    return rows.select("id", encoding.decoded_page(F.lit(None).cast("string"), F.col("body"), F.col("content_type")).alias("p")).select("id", "p.text", "p.encoding")


def queries() -> dict[str, Query]:
    u = lambda: F.col("url")
    b = lambda: F.col("base")
    item_ids = lambda spark, sf: table(spark, sf, "news_items")
    return {
        "links_scan": lambda s, d: page_links(s, d).select("page_id", "pos", "href", "url", "text"),
        "links_scan_decoded": lambda s, d: all_page_links(s, d).select("page_id", "pos", "href", "url", "text"),
        "base_url": of_urls(lambda: [urls.base_url(u()).alias("base_url")]),
        "root_domain": lambda s, d: domains(s, d).select("domain", urls.root_domain(F.col("domain")).alias("root_domain")),
        "domain_name": lambda s, d: domains(s, d).select("domain", urls.domain_name(F.col("domain")).alias("domain_name")),
        "same_site": of_pairs(lambda: [urls.same_site(u(), b()).alias("same_site")]),
        "external_service": of_urls(lambda: [urls.external_service(u()).alias("external")]),
        "non_news_filter": of_urls(lambda: [urls.not_news(u()).alias("not_news")]),
        "pagination_filter": of_urls(lambda: [urls.pagination(u()).alias("pagination")]),
        "news_candidates": lambda s, d: all_pairs(s, d).filter(urls.news_candidate(u(), b())),
        "same_site_urls": lambda s, d: item_ids(s, d)
        .join(table(s, d, "pages_in").select("page_id", F.col("base_url").alias("base")), "page_id")
        .filter(urls.news_candidate(u(), b()))
        .select("item_id", urls.absolute(u(), b()).alias("url")),
        "valid_news_url": lambda s, d: all_pairs(s, d).filter(urls.valid_news_url(u(), b())),
        "confident_items": lambda s, d: item_ids(s, d).filter(urls.confident_item(F.col("title"), u())).select("item_id"),
        "classify_url": of_urls(lambda: [urls.classify_url(u())[k].alias(k) for k in ("page_type", "confidence")]),
        "article_index_flags": of_urls(
            lambda: [((urls.classify_url(u())["page_type"] == t) & (urls.classify_url(u())["confidence"] >= 0.6)).alias(f"is_{t}") for t in ("article", "index")]
        ),
        "url_components": lambda s, d: components(s, d).select(
            "url", "c.domain", F.array_join("c.path_segments", "|").alias("path_segments"), F.array_join("c.segment_types", "|").alias("segment_types"), "c.extension", "c.prefix_pattern", "c.has_date_segment"
        ),
        "segment_types": lambda s, d: components(s, d)
        .select(F.explode("c.path_segments").alias("segment")).groupBy("segment").agg(F.count("*").alias("n"))
        .select("segment", urls.segment_type(F.col("segment")).alias("segment_type"), "n"),
        "detail_topic_pages": lambda s, d: components(s, d).select("url", urls.likely_detail(F.col("c")).alias("likely_detail"), urls.likely_topic(F.col("c")).alias("likely_topic")),
        "high_confidence_url": of_urls(lambda: [urls.confident_detail(u()).alias("confident")]),
        "same_root_domain": of_pairs(lambda: [urls.same_root(urls.netloc(u()), urls.netloc(b())).alias("same_root")]),
        "structure_clusters": lambda s, d: clustering.structure_clusters(item_urls(s, d), ["page_id"]),
        "semi_main_cluster": lambda s, d: clustering.main_structure_urls(item_urls(s, d), ["page_id"]),
        "anchor_urls": anchors,
        "anti_candidates": lambda s, d: item_urls(s, d).join(anchors(s, d), ["page_id", "url"], "left_anti"),
        "templates_similar": lambda s, d: literal(s, TEMPLATES, ["t1", "t2"]).select("t1", "t2", clustering.templates_similar(F.col("t1"), F.col("t2")).alias("similar")),
        "learned_static": lambda s, d: clustering.learned_static(item_urls(s, d), ["page_id"]).select("page_id", F.explode("learned").alias("segment")),
        "similar_urls": similar,
        "url_similarity": url_similarity,
        "url_patterns": lambda s, d: site_patterns(s, d).withColumn("confidence", F.round("confidence", 6)),
        "pattern_match": lambda s, d: patterns.match_patterns(host_urls(s, d, "news_items"), site_patterns(s, d), ["host"]).withColumn("confidence", F.round("confidence", 6)),
        "enhance_urls": lambda s, d: patterns.enhance_urls(host_urls(s, d, "articles"), host_urls(s, d, "news_items"), ["host"]),
        "clean_title": of_titles(lambda: [titles.clean_title(F.col("title")).alias("cleaned")]),
        "clean_link_text": of_titles(lambda: [titles.clean_link_text(F.col("title")).alias("cleaned")]),
        "clean_text": of_titles(lambda: [titles.clean_text(F.col("title")).alias("cleaned")]),
        "valid_title": of_titles(lambda: [titles.valid_title(F.col("title")).alias("valid")]),
        "extract_time": of_times(lambda: [times.find_time(F.col("text")).alias("found")]),
        "short_time_text": of_times(lambda: [times.short_time_text(F.col("text")).alias("could_be")]),
        "normalize_time": of_times(lambda: [times.to_epoch(F.col("text")).alias("epoch")]),
        "normalize_time_relative": of_times(lambda: [times.to_epoch(F.col("text"), F.lit(FETCHED)).alias("epoch")]),
        "normalize_encoding": lambda s, d: literal(s, NAMES, ["name"]).select("name", encoding.normalize_encoding(F.col("name")).alias("encoding")),
        "charset_content_type": lambda s, d: table(s, d, "pages_in").select("page_id", encoding.charset_of_content_type(F.col("content_type")).alias("charset")),
        "charset_html": lambda s, d: table(s, d, "pages_in").filter(F.col("body").isNotNull()).select("page_id", encoding.charset_of_html(F.col("body")).alias("charset")),
        "misread_gate": lambda s, d: item_ids(s, d).filter(encoding.looks_misread(F.col("title"))).select("item_id"),
        "decoded_pages": lambda s, d: table(s, d, "pages_in").select("page_id", encoding.decoded_page(F.col("html"), F.col("body"), F.col("content_type")).alias("p")).select("page_id", "p.text", "p.encoding"),
        "dedup_first": lambda s, d: links.keep_first(item_ids(s, d), ["page_id", "url"], ["pos", "item_id"]).select("item_id", "page_id", "url"),
        "topk_per_page": lambda s, d: links.top_k(item_ids(s, d), ["page_id"], ["pos", "item_id"], 5).select("item_id", "page_id", "pos"),
        "neighbour_times": lambda s, d: item_ids(s, d).select("item_id", links.neighbour_value("publish_time", ["page_id"], ["pos", "item_id"]).alias("neighbour")),
        "url_map": lambda s, d: links.url_map(page_links(s, d)),
        "longest_link_text": lambda s, d: links.longest_text_link(page_links(s, d)),
        "url_map_decoded": lambda s, d: links.url_map(all_page_links(s, d)),
        "longest_link_text_decoded": lambda s, d: links.longest_text_link(all_page_links(s, d)),
        "score_items": lambda s, d: links.score_items(item_ids(s, d), ["page_id"]).withColumn("score", F.round("score", 6)),
        "merge_lists": merged,
        "item_article_join": enriched,
        "success_counts": success_counts,
        "list_results": list_results,
        "valid_articles": lambda s, d: table(s, d, "articles").filter(is_valid(F.col("success"), F.col("content"))).select("article_id"),
        "url_operators_union": set_operation("union"),
        "url_operators_intersect": set_operation("intersect"),
        "url_operators_except": set_operation("except"),
        "items_as_json": items_as_json,
        "dom_nodes": lambda s, d: dom_nodes(decoded(s, d)),
        "heat_map": lambda s, d: zones.heat_map(lit_links(s, d)),
        "hot_zones": lambda s, d: zones.hot_zones(lit_links(s, d)).select("page_id", "node", "zone", "zone_size", "zone_root"),
        "boundaries": lambda s, d: zones.boundaries(zones.hot_zones(lit_links(s, d))),
        "heat_map_literal": lambda s, d: zones.heat_map(literal_lit(s)),
        "hot_zones_literal": lambda s, d: zones.hot_zones(literal_lit(s)).select("page_id", "node", "zone", "zone_size", "zone_root"),
        "boundaries_literal": lambda s, d: zones.boundaries(zones.hot_zones(literal_lit(s))),
        "subtrees_literal": lambda s, d: zones.within(literal_nodes(s).select("page_id", "node", "path"), zones.hot_zones(literal_lit(s)).select("page_id", F.col("zone").alias("root")).distinct(), "root").select("page_id", "root", "node"),
        "similar_urls_literal": literal_similar,
        "decoded_literal": literal_decoded,
        "list_items_literal": lambda s, d: timed_items(literal_lists(s)),
        "collect_report_literal": lambda s, d: literal_collected(s)[1],
        "collected_articles_literal": lambda s, d: literal_collected(s)[0].select("page_id", "pos", "url", "title", "publish_time", "content", "author", "language", "success", "error"),
        "cluster_ranking": lambda s, d: links.ranked(clustering.structure_clusters(item_urls(s, d), ["page_id"]), ["page_id"], [F.desc("size"), "template", "depth", "has_date"]).select("page_id", "rank", "template", "depth", "has_date", "size", "kept"),
        "pattern_ranking": lambda s, d: links.ranked(patterns.match_patterns(host_urls(s, d, "news_items"), site_patterns(s, d), ["host"]).withColumn("confidence", F.round("confidence", 6)), ["host"], [F.desc("confidence"), "url"]).select("host", "rank", "url", "confidence", "n_patterns"),
        "list_items": lambda s, d: timed_items(decoded(s, d)),
        "page_results": lambda s, d: page_results(decoded(s, d)),
        "article_extract": lambda s, d: parse_articles(article_pages(s, d), ("article_id", "url")),
        "articles_as_json": lambda s, d: as_json(table(s, d, "articles"), ["article_id"]),
        "collect_report": collect_report,
        "collected_articles": collected_articles,
        "p1_found": p1_found,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
