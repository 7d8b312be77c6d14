"""Learning URL patterns from samples of a group, and matching other URLs of it against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.urls import netloc, path, segments

LEAST_RATIO, LEAST_SAMPLES, LEAST_MATCHES, LEAST_CONFIDENCE = 0.3, 2, 1, 0.3


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.^$*+?()\[\]{}|\-])", r"\\$1")


def abstract_path(url: Column) -> Column:
    """Path with its numbers replaced by what they look like."""
    p = path(url)
    for shape, name in ((r"[0-9]{4}(?=[-/])", "{year}"), (r"[0-9]{1,2}(?=[-/])", "{month}"), (r"[0-9]{8}", "{date}"), (r"[0-9]{6,}", "{long_id}"), (r"[0-9]{3,5}", "{id}")):
        p = F.regexp_replace(p, shape, name)
    return p


def _path_regex(structure: Column) -> Column:
    r = escaped(structure)
    for name, shape in (("year", "[0-9]{4}"), ("month", "[0-9]{1,2}"), ("date", "[0-9]{8}"), ("long_id", "[0-9]{6,}"), ("id", "[0-9]{3,}")):
        r = F.replace(r, F.lit("\\{" + name + "\\}"), F.lit(shape))
    return r


def learn_patterns(samples: DataFrame, group: list[str]) -> DataFrame:
    """(group, pattern_type, pattern, confidence, sample_count, description).

    One pass: each sample gives its evidence of every type, evidence is counted once per group
    and value.  Counts are per occurrence, so a ratio can exceed 1.
    """
    url, p = F.col("url"), path(F.col("url"))
    s = segments(p)
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    named = F.filter(s, lambda x: ~x.rlike(r"^\p{Nd}+$") & ~x.contains(".") & (F.length(x) <= 50))
    numbers = F.filter(F.regexp_extract_all(url, F.lit("([0-9]+)"), 1), lambda x: F.length(x) >= 4)
    extension = F.lower(F.regexp_extract(p, r"\.([^.]*)$", 1))
    ext_value = F.when(~p.contains("."), "NO_EXT").when(extension.rlike(r"^[\p{L}\p{N}]{1,10}$"), extension)
    evidence = F.concat(
        F.array(one("path_structure", abstract_path(url))),
        F.transform(named, lambda x: one("path_segment", x)),
        F.transform(numbers, lambda x: one("id_pattern", F.length(x).cast("string"))),
        F.filter(F.array(one("extension", ext_value)), lambda x: x["value"].isNotNull()),
        F.when(F.size(s) >= 1, F.array(one("domain_path", F.concat(netloc(url), F.lit("/"), F.element_at(s, 1))))).otherwise(F.array().cast("array<struct<kind:string,value:string>>")),
    )
    total = samples.groupBy(*group).agg(F.count("*").alias("total"))
    counted = samples.select(*group, F.explode(evidence).alias("e")).groupBy(*group, "e.kind", "e.value").agg(F.count("*").alias("sample_count")).join(total, group)
    ratio = F.col("sample_count") / F.col("total")
    kind, value = F.col("kind"), F.col("value")
    enough = F.when(kind == "domain_path", ratio >= 0.5).otherwise((F.col("sample_count") >= LEAST_SAMPLES) & (ratio >= LEAST_RATIO))
    pattern = (
        F.when(kind == "path_structure", _path_regex(value))
        .when(kind == "path_segment", F.concat(F.lit("/"), escaped(value), F.lit("/")))
        .when(kind == "id_pattern", F.concat(F.lit("[0-9]{"), value, F.lit("}")))
        .when((kind == "extension") & (value == "NO_EXT"), F.lit("NO_EXT"))
        .when(kind == "extension", F.concat(F.lit(r"\."), value, F.lit("$")))
        .otherwise(F.concat(F.lit("^https?://"), escaped(value)))
    )
    return counted.filter(enough).select(
        *group, kind.alias("pattern_type"), pattern.alias("pattern"), F.when(kind == "domain_path", F.least(ratio + 0.2, F.lit(1.0))).otherwise(ratio).alias("confidence"), "sample_count",
        F.concat(kind, F.lit(": "), value).alias("description"),
    )


def match_patterns(urls: DataFrame, patterns: DataFrame, group: list[str], least_matches: int = LEAST_MATCHES, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """(group, url, confidence, n_patterns) of the URLs that match their group's patterns.

    Equi join on the group with the regular expression as residual condition; a group has few
    patterns.  Where a group has domain patterns, a URL has to match one.  The pattern for no
    extension is learned but never matches.
    """
    usable = patterns.filter(F.col("pattern") != "NO_EXT").withColumn("needs_domain", F.bool_or(F.col("pattern_type") == "domain_path").over(Window.partitionBy(*group)))
    hits = urls.select(*group, "url").join(usable, group).filter(F.expr("rlike(url, pattern)"))
    found = hits.groupBy(*group, "url").agg(
        F.avg("confidence").alias("confidence"), F.count("*").alias("n_patterns"), F.bool_or(F.col("pattern_type") == "domain_path").alias("domain"), F.first("needs_domain").alias("needs_domain")
    )
    return found.filter((~F.col("needs_domain") | F.col("domain")) & (F.col("n_patterns") >= least_matches) & (F.col("confidence") >= least_confidence)).select(*group, "url", "confidence", "n_patterns")


def enhance_urls(initial: DataFrame, everything: DataFrame, group: list[str]) -> DataFrame:
    """The initial URLs of each group, and the others of it that match what they teach: (group, url, found)."""
    known = initial.select(*group, "url").distinct()
    others = everything.select(*group, "url").distinct().join(known, [*group, "url"], "left_anti")
    matched = match_patterns(others, learn_patterns(known, group), group)
    return known.withColumn("found", F.lit("initial")).unionByName(matched.select(*group, "url").withColumn("found", F.lit("matched")))
