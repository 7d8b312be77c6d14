"""Queries of the training-text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import language, mojibake
from newsloom.llm.leakage import find_leaks
from newsloom.llm.mainbody import foreign_lines
from newsloom.llm.neardup import expanded, near_duplicates
from newsloom.llm.repeated import repeated_lines
from newsloom.llm.residue import residue
from newsloom.llm.sentences import split_sentences
from newsloom.llm.sites import sample_texts
from newsloom.llm.tokenize import encode_corpus
from newsloom.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "articles")
    pairs, members, texts = near_duplicates(articles.filter(F.length("content") >= 200))
    # contents that are garbled are left out; only those with a near-duplicate or a copy need a look
    garbled = mojibake.garbled_fields(mojibake.text_fields(None, texts, ("content",)), mojibake.fit(articles, table(spark, sf_dir, "sites")))
    bad = garbled.select(F.col("record_id").alias("rep")).distinct()
    kept = members.join(bad, "rep", "left_anti")
    return expanded(pairs, kept)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "articles")
    model = mojibake.fit(articles, table(spark, sf_dir, "sites"))
    return mojibake.garbled_fields(mojibake.text_fields(table(spark, sf_dir, "news_items"), articles), model).select("record_kind", "record_id", "field")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles, sites = table(spark, sf_dir, "articles"), table(spark, sf_dir, "sites")
    sample = sample_texts(articles, sites, language.SAMPLE_ROWS)
    repair = mojibake.train([(lang, content) for lang, _, content in sample])
    model = language.train(sample)
    return language.mislabelled(articles, language.document_languages(articles, sites, model, repair))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foreign_lines(table(spark, sf_dir, "articles"), table(spark, sf_dir, "sites"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "articles")).select("article_id", "line_no")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "news_items"), table(spark, sf_dir, "articles"), table(spark, sf_dir, "sites")).select("record_kind", "record_id", "field")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found}


_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_P6_SQL = rf"""
WITH pages AS (SELECT article_id, url, regexp_replace(lower(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]+)', 1)), '^(www|m)\.', '') AS host, content FROM articles WHERE content <> ''),
 split AS (SELECT article_id, url, host, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM pages WHERE host <> ''),
 lines AS (SELECT article_id, url, host, line_no, regexp_replace(regexp_replace(lower(regexp_replace(line, '[0-9]', '', 'g')), '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g') AS line FROM split),
 totals AS (SELECT host, count(DISTINCT url) AS all_urls FROM pages GROUP BY host),
 often AS (SELECT host, line FROM lines JOIN totals USING (host) WHERE line <> '' GROUP BY host, line, all_urls HAVING count(DISTINCT url) >= 3 AND count(DISTINCT url) >= 0.1 * all_urls)
SELECT article_id, line_no FROM lines JOIN often USING (host, line)"""


def oracle_sql() -> dict[str, str]:
    """The one of these queries that SQL can state: lines repeated within a site."""
    return {"p6_found": _P6_SQL}
