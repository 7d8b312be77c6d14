"""SQL for DuckDB that states the core queries a second time."""

from __future__ import annotations

from newsloom.functions.encoding import ALIASES
from newsloom.functions.urls import INDEX_WORDS, SECOND_LEVEL, SERVICE_HOSTS, STATIC_WORDS, STORY_PREFIXES, STORY_WORDS, TOP_LEVEL, TOPIC_PREFIXES
from newsloom.samples import FETCHED, NAMES, NODES, PAIRS, SIMILAR_ROWS, TEMPLATES, TIMES, TITLES, URLS

_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _values(rows: list) -> str:
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r if isinstance(r, tuple) else (r,))) + ")" for r in rows)


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def scheme(u: str) -> str:
    return rf"lower(regexp_extract({u}, '^\s*([A-Za-z][A-Za-z0-9+.\-]*):', 1))"


def netloc(u: str) -> str:
    return rf"regexp_extract({u}, '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)"


def path(u: str) -> str:
    return rf"regexp_replace(regexp_extract({u}, '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"


def segs(p: str) -> str:
    return f"list_filter(string_split({p}, '/'), lambda s: s <> '')"


def root(d: str) -> str:
    parts = f"string_split(lower({d}), '.')"
    return f"CASE WHEN {d} = '' THEN '' WHEN len({parts}) >= 3 AND {parts}[-2] IN {_in(SECOND_LEVEL)} THEN array_to_string({parts}[-3:], '.') WHEN len({parts}) >= 2 THEN array_to_string({parts}[-2:], '.') ELSE {d} END"


def name(d: str) -> str:
    parts = f"string_split(lower({d}), '.')"
    known = _in(sorted({*TOP_LEVEL, *SECOND_LEVEL}))
    return f"CASE WHEN {d} = '' THEN '' ELSE coalesce(list_filter({parts}, lambda x: x NOT IN {known})[-1], {parts}[1]) END"


def same_site(a: str, b: str) -> str:
    x, y = f"lower({netloc(a)})", f"lower({netloc(b)})"
    return f"coalesce({x} <> '' AND {y} <> '' AND ({x} = {y} OR ({root(x)}) = ({root(y)}) OR (({name(x)}) <> '' AND ({name(x)}) = ({name(y)}))), false)"


def external(u: str) -> str:
    d = f"lower({netloc(u)})"
    return f"coalesce({d} IN {_in(SERVICE_HOSTS)} OR ({root(d)}) IN {_in(SERVICE_HOSTS)}, false)"


def not_news(u: str) -> str:
    return rf"coalesce(regexp_matches({u}, '(?i)^mailto:|^tel:|^javascript:|^data:|^#|/cdn-cgi/|/wp-content/uploads/|/wp-admin/|\.(jpg|jpeg|png|gif|svg|webp|ico|pdf|zip|rar|exe|mp3|mp4|avi)$'), false)"


def pagination(u: str) -> str:
    return (
        rf"coalesce(regexp_matches({u}, '/[0-9]+#[0-9A-Za-z_]+$') OR regexp_matches({u}, '(?i)[?&](page|p|pageNum|pn)=[0-9]+$')"
        rf" OR regexp_matches({u}, '(?i)/page/[0-9]+/?$') OR regexp_matches({u}, '(?i)/[^/]+_([2-9]|[1-9][0-9])\.(s?html|s?htm|asp|php|jsp)$'), false)"
    )


def candidate(u: str, b: str) -> str:
    """Only for absolute URLs."""
    return f"coalesce({u} <> '' AND NOT {not_news(u)} AND NOT {pagination(u)} AND NOT {external(u)} AND {same_site(u, b)}, false)"


def valid(u: str, b: str) -> str:
    p = f"lower({path(u)})"
    return rf"({candidate(u, b)} AND NOT regexp_matches({p}, '\.(jpg|png|gif|css|js|pdf|zip)$') AND NOT regexp_matches({p}, '/login|/register|/contact|/lien-he|/about|/search|/tag/'))"


ALL_URLS = f"(SELECT DISTINCT url FROM (SELECT url FROM news_items UNION ALL SELECT url FROM articles UNION ALL SELECT url FROM pages_in UNION ALL SELECT url FROM seeds UNION ALL SELECT url FROM (VALUES {_values(URLS)}) v(url)) WHERE url IS NOT NULL)"
ALL_PAIRS = f"(SELECT DISTINCT url, base FROM (SELECT i.url, p.base_url AS base FROM news_items i JOIN pages_in p USING (page_id) UNION ALL SELECT url, base FROM (VALUES {_values(PAIRS)}) v(url, base)))"
DOMAINS = f"(SELECT DISTINCT {netloc('url')} AS domain FROM {ALL_URLS} u)"

# classify: one CTE with the path's segments, then the cascade
CLASSIFIED = rf"""
(SELECT url, CASE WHEN n = 0 THEN 'index' WHEN last_seg IN {_in(INDEX_WORDS)} THEN 'index' WHEN regexp_matches(last_seg, '^[0-9]{{5,}}$') THEN 'article'
  WHEN regexp_matches(joined, '(^|/)[0-9]{{4}}/[0-9]{{1,2}}/') THEN 'article' WHEN length(last_seg) > 15 AND regexp_matches(last_seg, '-.*-') THEN 'article'
  WHEN regexp_matches(last_seg, '^[^_]*_[0-9]{{5,}}$') THEN 'article' WHEN n >= 3 AND last_seg NOT IN {_in(STORY_WORDS)} THEN 'article'
  WHEN len(list_filter(s[1:n - 1], lambda x: x IN {_in(STORY_WORDS)})) > 0 THEN 'article' ELSE 'unknown' END AS page_type,
 CASE WHEN n = 0 THEN 0.8 WHEN last_seg IN {_in(INDEX_WORDS)} THEN 0.85 WHEN regexp_matches(last_seg, '^[0-9]{{5,}}$') THEN 0.9
  WHEN regexp_matches(joined, '(^|/)[0-9]{{4}}/[0-9]{{1,2}}/') THEN 0.85 WHEN length(last_seg) > 15 AND regexp_matches(last_seg, '-.*-') THEN 0.8
  WHEN regexp_matches(last_seg, '^[^_]*_[0-9]{{5,}}$') THEN 0.85 WHEN n >= 3 AND last_seg NOT IN {_in(STORY_WORDS)} THEN 0.6
  WHEN len(list_filter(s[1:n - 1], lambda x: x IN {_in(STORY_WORDS)})) > 0 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence
 FROM (SELECT url, s, len(s) AS n, coalesce(s[-1], '') AS last_seg, array_to_string(s, '/') AS joined
  FROM (SELECT url, {segs(r"regexp_replace(lower(" + path("url") + r"), '\.[^.]*$', '')")} AS s FROM {ALL_URLS} u)))"""


def seg_type(x: str, learned: str = "") -> str:
    letters = rf"(length({x}) - length(regexp_replace({x}, '\p{{L}}', '', 'g')))"
    bare = f"regexp_replace({x}, '[-_]', '', 'g')"
    digits = f"(length({bare}) - length(regexp_replace({bare}, '[0-9]', '', 'g')))"
    more = f" OR list_contains({learned}, lower({x}))" if learned else ""
    return (
        rf"CASE WHEN {x} = '' THEN 'empty' WHEN regexp_matches({x}, '^\p{{Nd}}+$') THEN 'number' WHEN regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?$') THEN 'date'"
        rf" WHEN lower({x}) IN {_in(STATIC_WORDS)}{more} THEN 'static' WHEN contains({x}, '-') AND {letters} / length({x}) > 0.5 AND length({x}) > 5 THEN 'slug'"
        rf" WHEN regexp_matches({x}, '\p{{Nd}}') AND regexp_matches({x}, '\p{{L}}') AND regexp_matches({bare}, '(?i)^[a-z0-9]{{8,}}$') AND {digits} / length({bare}) BETWEEN 0.2 AND 0.8 THEN 'hash'"
        rf" WHEN regexp_matches({x}, '^\p{{L}}+$') AND length({x}) < 15 THEN 'static' ELSE 'mixed' END"
    )


def comps(source: str, extra: str = "", learned: str = "") -> str:
    """A relation with domain, path_segments, segment_types, extension, prefix_pattern, has_date_segment added."""
    return rf"""
(SELECT *, coalesce(list_contains(segment_types, 'date'), false) AS has_date_segment FROM
 (SELECT *, list_transform(path_segments, lambda x: {seg_type("x", learned)}) AS segment_types,
   nullif(lower(regexp_extract(coalesce(list_filter(path_segments, lambda x: regexp_matches(x, '^[A-Za-z]+_[0-9]'))[1], ''), '^([A-Za-z]+_)[0-9]', 1)), '') AS prefix_pattern FROM
  (SELECT {extra}url, {netloc("url")} AS domain, {segs(r"regexp_replace(" + path("url") + r", '\.[^./]*$', '')")} AS path_segments,
    lower(regexp_extract({path("url")}, '\.([^./]*)$', 1)) AS extension{", " + learned if learned else ""} FROM {source} src)))"""


CONFIDENT = rf"""CASE WHEN confidence >= 0.7 THEN page_type = 'article' ELSE coalesce(len(path_segments) >= 2 AND coalesce(prefix_pattern NOT IN {_in(TOPIC_PREFIXES)}, true)
 AND lower(path_segments[-1]) NOT IN ('index', 'default', 'home', 'main', 'list')
 AND (has_date_segment OR coalesce(prefix_pattern IN {_in(STORY_PREFIXES)}, false)
  OR len(list_filter(list_zip(path_segments, segment_types), lambda z: (z[2] = 'number' AND length(z[1]) >= 5) OR z[2] = 'hash' OR (z[2] = 'mixed' AND regexp_matches(z[1], '[0-9]{{6,}}')))) > 0
  OR (len(path_segments) >= 3 AND segment_types[-1] = 'slug')), false) END"""
TEMPLATE = "array_to_string(list_transform(list_zip(path_segments, segment_types), lambda z: CASE WHEN z[2] = 'static' THEN lower(z[1]) ELSE '<' || z[2] || '>' END), '/')"
SIMILAR = """(NOT (NOT starts_with(a[1], '<') AND NOT starts_with(b[1], '<') AND a[1] <> b[1]) AND abs(len(a) - len(b)) <= 1
 AND list_sum(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: CASE WHEN a[i] = b[i] THEN 1.0 WHEN starts_with(a[i], '<') AND starts_with(b[i], '<') THEN 0.5 ELSE 0.0 END)) / least(len(a), len(b)) >= 0.7)"""
ITEM_URLS = "(SELECT DISTINCT page_id, url FROM news_items WHERE url IS NOT NULL)"
SHAPED = f"(SELECT c.*, {TEMPLATE} AS template, len(path_segments) AS depth, {CONFIDENT} AS sure FROM {comps(ITEM_URLS, 'page_id, ')} c JOIN {CLASSIFIED} k USING (url))"


def clusters(shaped: str) -> str:
    return f"""
(SELECT c.*, (total < 3 OR main < 2 OR (size >= least_size AND confident)
   OR (size < least_size AND EXISTS (SELECT 1 FROM unnest(accepted) t(other), (SELECT string_split(c.template, '/') AS a, string_split(other, '/') AS b) ab WHERE {SIMILAR}))) AS kept FROM
 (SELECT *, list(CASE WHEN size >= least_size AND confident THEN template END) FILTER (WHERE size >= least_size AND confident) OVER (PARTITION BY page_id) AS accepted FROM
  (SELECT *, max(size) OVER (PARTITION BY page_id) AS main, sum(size) OVER (PARTITION BY page_id) AS total, greatest(3, floor(max(size) OVER (PARTITION BY page_id) * 0.1)) AS least_size FROM
   (SELECT page_id, template, depth, has_date_segment AS has_date, count(*) AS size, bool_or(sure) AS confident FROM {shaped} s GROUP BY ALL))) c)"""


def kept_urls(shaped: str) -> str:
    return f"(SELECT s.page_id, s.url FROM {shaped} s JOIN {clusters(shaped)} k ON s.page_id = k.page_id AND s.template = k.template AND s.depth = k.depth AND s.has_date_segment = k.has_date WHERE k.kept)"


ANCHORS = f"""
(WITH shaped AS MATERIALIZED (SELECT * FROM {SHAPED}), n AS (SELECT page_id, count(*) FILTER (WHERE sure) AS n_sure FROM shaped GROUP BY page_id),
 sure_rows AS MATERIALIZED (SELECT s.* FROM shaped s JOIN n USING (page_id) WHERE n_sure >= 2 AND sure), unsure_rows AS MATERIALIZED (SELECT s.* FROM shaped s JOIN n USING (page_id) WHERE n_sure < 2),
 kept AS MATERIALIZED (SELECT * FROM {kept_urls("sure_rows")}), enough AS (SELECT page_id FROM kept GROUP BY page_id HAVING count(*) >= 2)
 SELECT page_id, url FROM kept WHERE page_id IN (SELECT page_id FROM enough) UNION ALL SELECT page_id, url FROM sure_rows WHERE page_id NOT IN (SELECT page_id FROM enough)
 UNION ALL SELECT page_id, url FROM {kept_urls("unsure_rows")})"""

STATICS = "list_distinct(list_transform(list_filter(list_zip({c}.path_segments, {c}.segment_types), lambda z: z[2] = 'static'), lambda z: lower(z[1])))"
_n = "least(len(s.segment_types), len(c.segment_types))"
_both = f"list_filter(range(1, {_n} + 1), lambda i: s.segment_types[i] = 'static' AND c.segment_types[i] = 'static')[1]"
STRUCTURE = f"""CASE WHEN len(s.segment_types) = 0 AND len(c.segment_types) = 0 THEN 1.0 WHEN len(s.segment_types) = 0 OR len(c.segment_types) = 0 THEN 0.0
 WHEN {_both} IS NOT NULL AND lower(s.path_segments[{_both}]) <> lower(c.path_segments[{_both}]) THEN 0.0
 ELSE list_sum(list_transform(range(1, {_n} + 1), lambda i: CASE WHEN s.segment_types[i] = c.segment_types[i] THEN CASE WHEN s.segment_types[i] <> 'static' OR lower(s.path_segments[i]) = lower(c.path_segments[i]) THEN 1.0 ELSE 0.0 END
   WHEN s.segment_types[i] IN ('slug', 'mixed') AND c.segment_types[i] IN ('slug', 'mixed') THEN 0.5 WHEN s.segment_types[i] IN ('number', 'mixed') AND c.segment_types[i] IN ('number', 'mixed') THEN 0.3 ELSE 0.0 END))
   / greatest(len(s.segment_types), len(c.segment_types)) END"""
_x, _y = STATICS.format(c="s"), STATICS.format(c="c")
CONTENT = f"""CASE WHEN len({_x}) = 0 AND len({_y}) = 0 THEN CASE WHEN s.prefix_pattern IS NOT NULL AND c.prefix_pattern IS NOT NULL THEN CASE WHEN s.prefix_pattern = c.prefix_pattern THEN 1.0 ELSE 0.0 END
 WHEN s.has_date_segment AND c.has_date_segment THEN 0.8 ELSE 0.5 END ELSE len(list_intersect({_x}, {_y})) / len(list_distinct(list_concat({_x}, {_y}))) END"""
_detail = "(len({c}.path_segments) >= 2 AND ({c}.has_date_segment OR coalesce({c}.prefix_pattern IN " + _in(STORY_PREFIXES) + ", false)))"
_topic = "(len({c}.path_segments) = 1 AND coalesce({c}.prefix_pattern IN " + _in(TOPIC_PREFIXES) + ", false))"
_root2 = lambda c: f"CASE WHEN len(string_split({c}.domain, '.')) >= 2 THEN array_to_string(string_split({c}.domain, '.')[-2:], '.') ELSE {c}.domain END"
SIMILAR_URLS = f"""
WITH anchors AS MATERIALIZED (SELECT * FROM {ANCHORS}),
 learned AS MATERIALIZED (SELECT page_id, list(segment) AS learned FROM (SELECT page_id, segment FROM (SELECT page_id, unnest({segs(path("url"))}) AS segment FROM anchors) GROUP BY ALL HAVING count(*) >= 2) GROUP BY page_id),
 src AS MATERIALIZED (SELECT i.page_id, i.url, coalesce(l.learned, []) AS learned, a.url IS NOT NULL AS is_sample FROM {ITEM_URLS} i LEFT JOIN anchors a ON a.page_id = i.page_id AND a.url = i.url LEFT JOIN learned l ON l.page_id = i.page_id),
 parsed AS MATERIALIZED (SELECT * FROM {comps("src", "page_id, is_sample, ", "learned")})
SELECT c.page_id, c.url, round(max(({STRUCTURE}) * (CASE WHEN s.extension = c.extension THEN 1.0 ELSE 0.8 END) * 0.8 + ({CONTENT}) * 0.2), 6)::DOUBLE AS score
FROM parsed c JOIN parsed s ON s.page_id = c.page_id AND s.is_sample AND NOT c.is_sample
WHERE ({_root2("s")}) = ({_root2("c")}) AND abs(len(s.path_segments) - len(c.path_segments)) <= 1 AND NOT ({_detail.format(c="s")} AND {_topic.format(c="c")}) AND NOT ({_topic.format(c="s")} AND {_detail.format(c="c")})
 AND coalesce(s.prefix_pattern = c.prefix_pattern, true)
GROUP BY c.page_id, c.url HAVING max(({STRUCTURE}) * (CASE WHEN s.extension = c.extension THEN 1.0 ELSE 0.8 END) * 0.8 + ({CONTENT}) * 0.2) >= 0.65"""

_literals = f"(SELECT url FROM (VALUES {_values(URLS)}) v(url))"
_comparable = f"""({_root2("s")}) = ({_root2("c")}) AND abs(len(s.path_segments) - len(c.path_segments)) <= 1 AND NOT ({_detail.format(c="s")} AND {_topic.format(c="c")}) AND NOT ({_topic.format(c="s")} AND {_detail.format(c="c")})
 AND coalesce(s.prefix_pattern = c.prefix_pattern, true)"""
URL_SIMILARITY = f"""
WITH parsed AS MATERIALIZED (SELECT * FROM {comps(_literals)})
SELECT s.url AS url_a, c.url AS url_b, round(CASE WHEN {_comparable} THEN ({STRUCTURE}) * (CASE WHEN s.extension = c.extension THEN 1.0 ELSE 0.8 END) * 0.8 + ({CONTENT}) * 0.2 ELSE 0.0 END, 6)::DOUBLE AS score
FROM parsed s JOIN parsed c ON ({_root2("s")}) = ({_root2("c")})"""

ESC = r"regexp_replace({x}, '([\\.^$*+?()\[\]{{}}|\-])', '\\\1', 'g')"
HOST_URLS = rf"(SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]+)', 1)), '^(www|m)\.', '') AS host, url FROM articles WHERE url IS NOT NULL)"
_abs = path("url")
for _shape, _name in ((r"[0-9]{4}([-/])", r"{year}\1"), (r"[0-9]{1,2}([-/])", r"{month}\1"), (r"[0-9]{8}", "{date}"), (r"[0-9]{6,}", "{long_id}"), (r"[0-9]{3,5}", "{id}")):
    _abs = f"regexp_replace({_abs}, '{_shape}', '{_name}', 'g')"
_rx = ESC.format(x="value")
for _name, _shape in (("year", "[0-9]{4}"), ("month", "[0-9]{1,2}"), ("date", "[0-9]{8}"), ("long_id", "[0-9]{6,}"), ("id", "[0-9]{3,}")):
    _rx = rf"replace({_rx}, '\{{{_name}\}}', '{_shape}')"
PATTERNS = rf"""
(SELECT host, kind AS pattern_type, CASE kind WHEN 'path_structure' THEN {_rx} WHEN 'path_segment' THEN '/' || {ESC.format(x="value")} || '/' WHEN 'id_pattern' THEN '[0-9]{{' || value || '}}'
  WHEN 'extension' THEN CASE WHEN value = 'NO_EXT' THEN 'NO_EXT' ELSE '\.' || value || '$' END ELSE '^https?://' || {ESC.format(x="value")} END AS pattern,
  CASE WHEN kind = 'domain_path' THEN least(sample_count / total + 0.2, 1.0) ELSE sample_count / total END AS confidence, sample_count, kind || ': ' || value AS description FROM
 (SELECT host, kind, value, count(*) AS sample_count FROM
  (SELECT host, 'path_structure' AS kind, {_abs} AS value FROM {HOST_URLS} u
   UNION ALL SELECT host, 'path_segment', unnest(list_filter({segs(path("url"))}, lambda x: NOT regexp_matches(x, '^\p{{Nd}}+$') AND NOT contains(x, '.') AND length(x) <= 50)) FROM {HOST_URLS} u
   UNION ALL SELECT host, 'id_pattern', unnest(list_transform(list_filter(regexp_extract_all(url, '[0-9]+'), lambda x: length(x) >= 4), lambda x: length(x)::VARCHAR)) FROM {HOST_URLS} u
   UNION ALL SELECT host, 'extension', CASE WHEN NOT contains({path("url")}, '.') THEN 'NO_EXT' ELSE lower(regexp_extract({path("url")}, '\.([^.]*)$', 1)) END FROM {HOST_URLS} u
     WHERE NOT contains({path("url")}, '.') OR regexp_matches(lower(regexp_extract({path("url")}, '\.([^.]*)$', 1)), '^[\p{{L}}\p{{N}}]{{1,10}}$')
   UNION ALL SELECT host, 'domain_path', {netloc("url")} || '/' || {segs(path("url"))}[1] FROM {HOST_URLS} u WHERE len({segs(path("url"))}) >= 1) GROUP BY ALL) e
 JOIN (SELECT host, count(*) AS total FROM {HOST_URLS} u GROUP BY host) t USING (host)
 WHERE CASE WHEN kind = 'domain_path' THEN sample_count / total >= 0.5 ELSE sample_count >= 2 AND sample_count / total >= 0.3 END)"""
ITEM_HOSTS = rf"(SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]+)', 1)), '^(www|m)\.', '') AS host, url FROM news_items WHERE url IS NOT NULL)"


def matched(urls: str) -> str:
    return f"""
(SELECT host, url, confidence, n_patterns FROM (SELECT u.host, u.url, avg(p.confidence) AS confidence, count(*) AS n_patterns, bool_or(p.pattern_type = 'domain_path') AS domain, bool_or(p.needs) AS needs
  FROM {urls} u JOIN (SELECT *, bool_or(pattern_type = 'domain_path') OVER (PARTITION BY host) AS needs FROM {PATTERNS} WHERE pattern <> 'NO_EXT') p ON p.host = u.host AND regexp_matches(u.url, p.pattern) GROUP BY u.host, u.url)
 WHERE (NOT needs OR domain) AND confidence >= 0.3)"""


def ws(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"


_title_src = f"(SELECT DISTINCT title FROM (SELECT title FROM news_items UNION ALL SELECT title FROM (VALUES {_values(TITLES)}) v(title)) WHERE title IS NOT NULL)"
_bul = f"'^[·•\\-*》►▶→]+{_WS}*'"
_num = f"'^[(\\[【]?[0-9]{{1,3}}[)\\]】]?[.、)）]?{_WS}*'"
_tail = f"'{_WS}+[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}({_WS}+[0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?)?$'"
_age = f"'(?i)^[0-9]+{_WS}+(?:hrs?|hours?|mins?|minutes?|days?){_WS}+(?:ago{_WS}+)?([A-Z])'"
_link_text = ws(f"regexp_replace(regexp_replace(regexp_replace({ws('title')}, {_bul}, ''), {_num}, ''), {_tail}, '')")
_text = ws(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({ws('title')}, {_bul}, ''), {_num}, ''), {_age}, '\1'), {_tail}, '')")
_time_src = f"(SELECT DISTINCT t FROM (SELECT publish_time AS t FROM news_items UNION ALL SELECT publish_time FROM articles UNION ALL SELECT t FROM (VALUES {_values(TIMES)}) v(t)) WHERE t IS NOT NULL)"
_forms = [
    r"([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}(?:\s+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)?)", r"([0-9]{1,2}[-/][0-9]{1,2})(?:[^0-9]|$)", r"([0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日)", r"([0-9]{1,2}月[0-9]{1,2}日)",
    r"([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)", r"([0-9]+\s*(?:分钟|分鐘|小时|小時|天|周|週|秒)\s*前)(?:\s|$|[，,。.!！?？\])）])",
    r"(?i)([0-9]+\s*(?:seconds?|minutes?|mins?|hours?|hrs?|days?|weeks?|months?)\s*ago)\b", r"(?i)(刚刚|剛 剛|今天|昨天|前天|just now|today|yesterday)",
]
_find = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(t, '{f}', 1)), '')" for f in _forms) + ")"
_pre = r"'(?i)^(发布于|发表于|更新于|time:|date:|Updated:|Posted:)\s*'"
_plain = rf"replace(regexp_replace(regexp_replace(regexp_replace(trim(t), {_pre}, ''), {_pre}, ''), '^([0-9]{{4}})年([0-9]{{1,2}})月([0-9]{{1,2}})日', '\1-\2-\3'), '/', '-')"
_wall = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(p, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}{s}$') THEN try_strptime(p, '{f}') END" for s, f in ((" [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}", "%Y-%m-%d %H:%M:%S"), (" [0-9]{1,2}:[0-9]{1,2}", "%Y-%m-%d %H:%M"), ("", "%Y-%m-%d"))) + ")"
_names = f"(SELECT * FROM (VALUES {_values(NAMES)}) v(name))"


def _alias(x: str) -> str:
    bare = rf"regexp_replace(lower(trim({x})), '^[\"'']+|[\"'']+$', '', 'g')"
    return f"CASE WHEN coalesce({x}, '') = '' THEN 'utf-8' ELSE CASE {bare} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items()) + f" ELSE {bare} END END"


_links = """(SELECT page_id, base_url, (generate_subscripts(h, 1) - 1)::INT AS pos, unnest(h) AS href, trim(unnest(t)) AS text FROM
 (SELECT page_id, base_url, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS h, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages_in WHERE html IS NOT NULL))"""
_abs_href = rf"CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN {scheme('base_url')} || '://' || {netloc('base_url')} || href WHEN starts_with(href, '?') THEN regexp_replace(base_url, '[?#].*$', '') || href ELSE href END"
LINKS = f"(SELECT page_id, base_url, pos, href, {_abs_href} AS url, {ws('text')} AS text FROM {_links})"
_score = f"""greatest(least(n, 20) * 1.5 + CASE WHEN mean BETWEEN 15 AND 50 THEN 20 WHEN mean > 50 THEN 10 ELSE 0 END + timed / n * 30 + CASE WHEN depths = 1 THEN 20 ELSE 0 END
 - CASE WHEN shallow / n > 0.5 THEN 100 ELSE 0 END - CASE WHEN short > n * 0.3 THEN 30 ELSE 0 END, 0)"""


def scored(source: str, by: str) -> str:
    return f"""
(SELECT {by}, n, {_score} AS score FROM (SELECT {by}, count(*) AS n, avg(length(title)) AS mean, count(*) FILTER (WHERE coalesce(publish_time, '') <> '') AS timed, count(DISTINCT len(string_split({path("url")}, '/'))) AS depths,
  count(*) FILTER (WHERE len({segs(path("url"))}) <= 1) AS shallow, count(*) FILTER (WHERE length(title) < 10) AS short FROM {source} GROUP BY {by}))"""


# Literal node tables: trees are walked by recursion, and every rule is stated as it reads.
_nodes = ", ".join(f"({p}::BIGINT, {n}::INT, {q}::INT, {str(lit).lower()})" for p, n, q, lit in NODES)
TREES = f"""WITH RECURSIVE nodes(page_id, node, parent, lit) AS (VALUES {_nodes}),
 deep(page_id, node, depth) AS (SELECT page_id, node, 1 FROM nodes WHERE parent = 0 UNION ALL SELECT n.page_id, n.node, d.depth + 1 FROM nodes n JOIN deep d ON n.page_id = d.page_id AND n.parent = d.node),
 above(page_id, node, up) AS (SELECT page_id, node, node FROM nodes UNION ALL SELECT a.page_id, a.node, n.parent FROM above a JOIN nodes n ON n.page_id = a.page_id AND n.node = a.up WHERE n.parent <> 0),
 links AS (SELECT page_id, node FROM nodes WHERE lit), pages AS (SELECT page_id, count(*) AS n FROM links GROUP BY page_id HAVING count(*) >= 2),
 common AS (SELECT page_id, arg_max(up, depth) AS up, max(depth) AS depth FROM (SELECT a.page_id, a.up, d.depth FROM above a JOIN links l USING (page_id, node) JOIN deep d ON d.page_id = a.page_id AND d.node = a.up JOIN pages p ON p.page_id = a.page_id GROUP BY a.page_id, a.up, d.depth, p.n HAVING count(*) = p.n) GROUP BY page_id),
 zoned AS (SELECT l.page_id, l.node, coalesce((SELECT a.up FROM above a JOIN deep d ON d.page_id = a.page_id AND d.node = a.up WHERE a.page_id = l.page_id AND a.node = l.node AND d.depth = c.depth + 1), l.node) AS zone FROM links l JOIN common c USING (page_id))"""
_reaches = f"SELECT z.page_id, z.node, z.zone, d.depth, a.up, u.depth AS up_depth, (SELECT count(*) FROM zoned o JOIN above x ON x.page_id = o.page_id AND x.node = o.node WHERE o.page_id = z.page_id AND o.zone = z.zone AND x.up = a.up) AS held FROM zoned z JOIN deep d ON d.page_id = z.page_id AND d.node = z.node JOIN above a ON a.page_id = z.page_id AND a.node = z.node JOIN deep u ON u.page_id = a.page_id AND u.node = a.up"
_similar = f"(SELECT page_id::BIGINT AS page_id, sample, url FROM (VALUES {', '.join(f"({p}, '{s}', '{u}')" for p, s, u in SIMILAR_ROWS)}) v(page_id, sample, url))"
#: What the literal pages hold, by hand.
_stories = [
    (0, "Ferry operator & union agree on a new timetable", "/2024/0102/100002.html", "2 hours ago", FETCHED - 7200), (1, "School board measures the noise near the market", "/2024/0101/100003.html", "yesterday", FETCHED - 86400),
    (2, "Orchard trust replaces its offer without a quorum", "/2024/0101/100004.html", "2024-01-01", 1704038400), (3, "Allotment owners archive a notice from the water board", "/2023/1231/100005.html", "2023-12-31 08:00:00", 1703980800),
    (4, "Harbour council opens the second footbridge again", "/2024/0102/100001.html", "2024-01-02 10:30", 1704162600),
]
_listed = ", ".join(f"({k}, '{t}', 'https://kel.example/news{u}', '{w}', {e})" for k, t, u, w, e in _stories)
_decoded = "(1, 'café', 'utf-8'), (2, 'café', 'latin-1'), (3, '中国', 'gbk'), (4, '中国', 'gbk'), (5, '<meta charset=gbk>中国', 'gbk'), (6, '', 'utf-8'), (7, NULL, NULL), (8, '中国', 'utf8')"
_opened = "The council opened the footbridge on Tuesday, a year later than planned, after two rounds of repairs.\nOwners of the allotments had asked for it since the ferry was cut."
_moment = f"to_timestamp({FETCHED}) AT TIME ZONE 'UTC' + INTERVAL 8 HOUR"
_back = lambda wall: f"(epoch({wall}) - 28800)::BIGINT"
_count = "nullif(regexp_extract(r, '^([0-9]+)', 1), '')::BIGINT"
_r = rf"regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(trim(t), {_pre}, ''), {_pre}, ''), '小時', '小时'), '分鐘', '分钟'), '週', '周'), '^\s+|\s+$', '', 'g')"
RELATIVE = rf"""SELECT t AS text, coalesce({_back(_wall)},
 CASE WHEN regexp_matches(r, '(?i)^[0-9]+\s*months?\s*ago$') THEN {_back(f"{_moment} - to_months({_count}::INT)")}
  WHEN regexp_matches(r, '(?i)前$|ago$') THEN {FETCHED} - {_count} * CASE WHEN regexp_matches(r, '(?i)^[0-9]+\s*(?:秒|seconds?)') THEN 1 WHEN regexp_matches(r, '(?i)^[0-9]+\s*(?:分钟|minutes?|mins?)') THEN 60
   WHEN regexp_matches(r, '(?i)^[0-9]+\s*(?:小时|hours?|hrs?)') THEN 3600 WHEN regexp_matches(r, '(?i)^[0-9]+\s*(?:天|days?)') THEN 86400 WHEN regexp_matches(r, '(?i)^[0-9]+\s*(?:周|weeks?)') THEN 604800 END
  WHEN regexp_matches(r, '(?i)^(?:刚刚|剛 剛|今天|just now|today)$') THEN {FETCHED} WHEN regexp_matches(r, '(?i)^(?:昨天|yesterday)$') THEN {FETCHED - 86400} WHEN r = '前天' THEN {FETCHED - 172800} END,
 CASE WHEN regexp_matches(r, '^[0-9]{{1,2}}([-/][0-9]{{1,2}}|月[0-9]{{1,2}}日)$') THEN {_back(rf"try_strptime('2024-' || regexp_extract(r, '^([0-9]+)', 1) || '-' || regexp_extract(r, '([0-9]+)日?$', 1), '%Y-%m-%d')")} END,
 CASE WHEN regexp_matches(r, '^[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}$') THEN {_back("try_strptime('2024-01-02 ' || r, '%Y-%m-%d %H:%M:%S')")} WHEN regexp_matches(r, '^[0-9]{{1,2}}:[0-9]{{2}}$') THEN {_back("try_strptime('2024-01-02 ' || r, '%Y-%m-%d %H:%M')")} END)::BIGINT AS epoch
 FROM (SELECT t, {_plain} AS p, {_r} AS r FROM {_time_src} s)"""


def _json(pairs: list[tuple[str, str]]) -> str:
    """A JSON object as text, without its nulls."""
    parts = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '\"{c}\":' || {v} END" for c, v in pairs)
    return f"'{{' || array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ',') || '}}'"


_contained = "(SELECT item_id, page_id, pos, title, url, publish_time, pos % 3 AS container FROM news_items)"
ORACLES = {
    "links_scan": f"SELECT page_id, pos, href, url, text FROM {LINKS}",
    "base_url": f"SELECT url, CASE WHEN url = '' THEN '' ELSE {scheme('url')} || '://' || {netloc('url')} END AS base_url FROM {ALL_URLS} u",
    "root_domain": f"SELECT domain, {root('domain')} AS root_domain FROM {DOMAINS} d",
    "domain_name": f"SELECT domain, {name('domain')} AS domain_name FROM {DOMAINS} d",
    "same_site": f"SELECT url, base, {same_site('url', 'base')} AS same_site FROM {ALL_PAIRS} p",
    "external_service": f"SELECT url, {external('url')} AS external FROM {ALL_URLS} u",
    "non_news_filter": f"SELECT url, {not_news('url')} AS not_news FROM {ALL_URLS} u",
    "pagination_filter": f"SELECT url, {pagination('url')} AS pagination FROM {ALL_URLS} u",
    "news_candidates": f"SELECT url, base FROM {ALL_PAIRS} p WHERE {candidate('url', 'base')}",
    "same_site_urls": f"SELECT item_id, i.url FROM news_items i JOIN pages_in p USING (page_id) WHERE {candidate('i.url', 'p.base_url')}",
    "valid_news_url": f"SELECT url, base FROM {ALL_PAIRS} p WHERE {valid('url', 'base')}",
    "confident_items": f"SELECT item_id FROM news_items WHERE length(title) >= 15 AND len({segs(path('url'))}) >= 2 AND regexp_matches(lower({path('url')}), '/article|/news|/story|/post|/detail|/chi-tiet|/tin-|/bai-viet|/a/|/p/|/n/|/[0-9]{{4,}}|/[0-9]{{4}}/[0-9]{{1,2}}')",
    "classify_url": f"SELECT url, page_type, confidence FROM {CLASSIFIED} c",
    "article_index_flags": f"SELECT url, page_type = 'article' AND confidence >= 0.6 AS is_article, page_type = 'index' AND confidence >= 0.6 AS is_index FROM {CLASSIFIED} c",
    "url_components": f"SELECT url, domain, array_to_string(path_segments, '|') AS path_segments, array_to_string(segment_types, '|') AS segment_types, extension, prefix_pattern, has_date_segment FROM {comps(ALL_URLS)} c",
    "segment_types": f"SELECT segment, {seg_type('segment')} AS segment_type, n FROM (SELECT segment, count(*) AS n FROM (SELECT unnest(path_segments) AS segment FROM {comps(ALL_URLS)} c) GROUP BY segment)",
    "detail_topic_pages": f"SELECT url, {_detail.format(c='c')} AS likely_detail, {_topic.format(c='c')} AS likely_topic FROM {comps(ALL_URLS)} c",
    "high_confidence_url": f"SELECT url, {CONFIDENT} AS confident FROM {comps(ALL_URLS)} c JOIN {CLASSIFIED} k USING (url)",
    "same_root_domain": f"SELECT url, base, ({_root2('a').replace('a.domain', netloc('url'))}) = ({_root2('a').replace('a.domain', netloc('base'))}) AS same_root FROM {ALL_PAIRS} p",
    "structure_clusters": f"WITH shaped AS MATERIALIZED (SELECT * FROM {SHAPED}) SELECT page_id, template, depth::INT AS depth, has_date, size, kept FROM {clusters('shaped')}",
    "semi_main_cluster": f"WITH shaped AS MATERIALIZED (SELECT * FROM {SHAPED}) SELECT page_id, url FROM {kept_urls('shaped')}",
    "anchor_urls": f"SELECT page_id, url FROM {ANCHORS}",
    "anti_candidates": f"SELECT i.page_id, i.url FROM {ITEM_URLS} i WHERE NOT EXISTS (SELECT 1 FROM {ANCHORS} a WHERE a.page_id = i.page_id AND a.url = i.url)",
    "templates_similar": f"SELECT t1, t2, {SIMILAR} AS similar FROM (SELECT t1, t2, string_split(t1, '/') AS a, string_split(t2, '/') AS b FROM (VALUES {_values(TEMPLATES)}) v(t1, t2))",
    "learned_static": f"SELECT page_id, segment FROM (SELECT page_id, unnest({segs(path('url'))}) AS segment FROM {ITEM_URLS} i) GROUP BY ALL HAVING count(*) >= 2",
    "similar_urls": SIMILAR_URLS,
    "url_similarity": URL_SIMILARITY,
    "url_patterns": f"SELECT host, pattern_type, pattern, round(confidence, 6)::DOUBLE AS confidence, sample_count, description FROM {PATTERNS}",
    "pattern_match": f"SELECT host, url, round(confidence, 6)::DOUBLE AS confidence, n_patterns FROM {matched(ITEM_HOSTS)}",
    "enhance_urls": f"SELECT host, url, 'initial' AS found FROM {HOST_URLS} u UNION ALL SELECT host, url, 'matched' FROM {matched(f'(SELECT * FROM {ITEM_HOSTS} i WHERE NOT EXISTS (SELECT 1 FROM {HOST_URLS} h WHERE h.host = i.host AND h.url = i.url))')}",
    "clean_title": f"SELECT title, {ws(f'''regexp_replace({ws('title')}, '^[\\[\\]【】()（）·•\\-]+{_WS}*', '')''')} AS cleaned FROM {_title_src} t",
    "clean_link_text": f"SELECT title, {_link_text} AS cleaned FROM {_title_src} t",
    "clean_text": f"SELECT title, nullif({_text}, '') AS cleaned FROM {_title_src} t",
    "valid_title": rf"SELECT title, coalesce(length({ws('title')}) >= 0 AND length(regexp_replace(title, '^{_WS}+|{_WS}+$', '', 'g')) >= 5 AND NOT regexp_matches(regexp_replace(title, '^{_WS}+|{_WS}+$', '', 'g'), '\{{\{{.*\}}\}}|\$\{{.*\}}|<%.*%>|\{{%.*%\}}|^(?i:null|undefined|N/A|loading\.{{0,3}})$'), false) AS valid FROM {_title_src} t",
    "extract_time": f"SELECT t AS text, {_find} AS found FROM {_time_src} s",
    "short_time_text": f"SELECT t AS text, length(trim(t)) > 5 AND length(trim(t)) < 25 AND regexp_matches(t, '[0-9]') AND regexp_matches(t, '[-/:年月日]') AS could_be FROM {_time_src} s",
    "normalize_time": f"SELECT t AS text, (epoch({_wall}) - 28800)::BIGINT AS epoch FROM (SELECT t, {_plain} AS p FROM {_time_src} s)",
    "normalize_encoding": f"SELECT name, {_alias('name')} AS encoding FROM {_names} n",
    "charset_content_type": rf"SELECT page_id, CASE WHEN c <> '' THEN {_alias('c')} END AS charset FROM (SELECT page_id, regexp_extract(content_type, '(?i)charset\s*=\s*([^\s;,]+)', 1) AS c FROM pages_in)",
    "charset_html": rf"SELECT page_id, CASE WHEN c <> '' THEN {_alias('c')} END AS charset FROM (SELECT page_id, regexp_extract(CAST(body[1:2048] AS VARCHAR), '(?i)<meta[^>]+charset\s*=\s*[\"'']?([^\"''\s>]+)', 1) AS c FROM pages_in WHERE body IS NOT NULL)",
    "misread_gate": "SELECT item_id FROM news_items WHERE regexp_matches(title, '[À-ß][\\x{80}-\\x{BF}]|[à-ï][\\x{80}-\\x{BF}]{2}') OR contains(title, '�')",
    "dedup_first": "SELECT item_id, page_id, url FROM (SELECT item_id, page_id, url, row_number() OVER (PARTITION BY page_id, url ORDER BY pos, item_id) AS r FROM news_items) WHERE r = 1",
    "topk_per_page": "SELECT item_id, page_id, pos FROM (SELECT item_id, page_id, pos, row_number() OVER (PARTITION BY page_id ORDER BY pos, item_id) AS r FROM news_items) WHERE r <= 5",
    "neighbour_times": "SELECT item_id, coalesce(lead(publish_time, 1) OVER w, lead(publish_time, 2) OVER w, lag(publish_time, 1) OVER w, lag(publish_time, 2) OVER w) AS neighbour FROM news_items WINDOW w AS (PARTITION BY page_id ORDER BY pos, item_id)",
    "url_map": f"SELECT page_id, url, count(*) AS n_links, min(pos) AS first_pos FROM {LINKS} GROUP BY page_id, url",
    "longest_link_text": f"""SELECT page_id, url, CASE WHEN longer THEN pos ELSE first_pos END AS pos, CASE WHEN longer THEN text ELSE first_text END AS text FROM
 (SELECT *, length(text) > length(first_text) AND length(text) >= 5 AS longer FROM (SELECT *, first_value(pos) OVER (PARTITION BY page_id, url ORDER BY pos) AS first_pos, first_value(text) OVER (PARTITION BY page_id, url ORDER BY pos) AS first_text,
  row_number() OVER (PARTITION BY page_id, url ORDER BY CASE WHEN length(text) >= 5 THEN length(text) ELSE 0 END DESC, pos) AS r FROM {LINKS})) WHERE r = 1""",
    "score_items": f"SELECT page_id, n AS n_items, round(score, 6)::DOUBLE AS score FROM {scored('news_items', 'page_id')}",
    "merge_lists": f"""SELECT item_id, page_id, url FROM (SELECT i.item_id, i.page_id, i.url, row_number() OVER (PARTITION BY i.page_id, i.url ORDER BY s.score DESC, i.container, i.pos, i.item_id) AS r
 FROM {_contained} i JOIN (SELECT *, max(score) OVER (PARTITION BY page_id) AS best FROM {scored(_contained, 'page_id, container')}) s USING (page_id, container) WHERE s.score >= 0.6 * best) WHERE r = 1""",
    "item_article_join": """SELECT i.item_id, a.article_id, coalesce(nullif(a.title, ''), i.title) AS title, coalesce(nullif(a.publish_time, ''), i.publish_time) AS publish_time, coalesce(a.success AND coalesce(a.content, '') <> '', false) AS fetched
 FROM news_items i LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY article_id) AS r FROM articles) WHERE r = 1) a ON a.url = i.url""",
    "success_counts": "SELECT source, count(*) FILTER (WHERE success AND coalesce(content, '') <> '') AS success_count, count(*) FILTER (WHERE NOT (success AND coalesce(content, '') <> '')) AS failed_count FROM articles GROUP BY source",
    "list_results": "SELECT p.page_id, p.url, count(i.item_id) AS total_count, count(i.item_id) > 0 AS success FROM pages_in p LEFT JOIN news_items i USING (page_id) GROUP BY p.page_id, p.url",
    "valid_articles": "SELECT article_id FROM articles WHERE success AND content IS NOT NULL AND length(content) > 50",
    "url_operators_union": f"SELECT url FROM (SELECT DISTINCT url FROM news_items UNION SELECT DISTINCT url FROM articles) WHERE url IS NOT NULL",
    "url_operators_intersect": "SELECT url FROM news_items WHERE url IS NOT NULL INTERSECT SELECT url FROM articles",
    "url_operators_except": "SELECT url FROM news_items WHERE url IS NOT NULL EXCEPT SELECT url FROM articles",
    "heat_map_literal": f"{TREES} SELECT a.page_id, a.up AS node, count(*) AS heat FROM above a JOIN links l USING (page_id, node) GROUP BY a.page_id, a.up",
    "hot_zones_literal": f"{TREES} SELECT page_id, node, zone, zone_size, CASE WHEN zone_size = 1 THEN node ELSE zone END AS zone_root FROM (SELECT *, count(*) OVER (PARTITION BY page_id, zone) AS zone_size FROM zoned)",
    "boundaries_literal": f"{TREES} SELECT page_id, node, zone, arg_min(up, up_depth) AS boundary FROM ({_reaches}) WHERE held = 1 AND depth - up_depth <= 10 GROUP BY page_id, node, zone",
    "subtrees_literal": f"{TREES} SELECT DISTINCT a.page_id, a.up AS root, a.node FROM above a JOIN zoned z ON z.page_id = a.page_id AND z.zone = a.up",
    "similar_urls_literal": SIMILAR_URLS.replace(ANCHORS, f"(SELECT page_id, url FROM {_similar} WHERE sample = '1')").replace(ITEM_URLS, _similar),
    "decoded_literal": f"SELECT id::BIGINT AS id, text, encoding FROM (VALUES {_decoded}) v(id, text, encoding)",
    "list_items_literal": f"SELECT 1::BIGINT AS page_id, pos::INT AS pos, title, url, publish_time, epoch::BIGINT AS timestamp FROM (VALUES {_listed}) v(pos, title, url, publish_time, epoch)",
    "collect_report_literal": "SELECT page_id::BIGINT AS page_id, a::BIGINT AS success_count, b::BIGINT AS failed_count, c::BIGINT AS total_count FROM (VALUES (1, 1, 4, 5), (2, 0, 0, 0), (3, 0, 0, 0)) v(page_id, a, b, c)",
    "collected_articles_literal": f"""SELECT 1::BIGINT AS page_id, pos::INT AS pos, url, CASE WHEN pos = 4 THEN 'Footbridge opens' ELSE title END AS title, publish_time, CASE WHEN pos = 4 THEN '{_opened}' END AS content,
 CASE WHEN pos = 4 THEN 'N. Brawen' END AS author, CASE WHEN pos = 4 THEN 'en' END AS language, pos = 4 AS success, CASE pos WHEN 4 THEN NULL WHEN 2 THEN 'no text found' ELSE 'not fetched' END AS error FROM (VALUES {_listed}) v(pos, title, url, publish_time, epoch)""",
    "normalize_time_relative": RELATIVE,
    "cluster_ranking": f"WITH shaped AS MATERIALIZED (SELECT * FROM {SHAPED}) SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY size DESC, template, depth, has_date))::INT AS rank, template, depth::INT AS depth, has_date, size, kept FROM {clusters('shaped')}",
    "pattern_ranking": f"SELECT host, (row_number() OVER (PARTITION BY host ORDER BY confidence DESC, url))::INT AS rank, url, confidence, n_patterns FROM (SELECT host, url, round(confidence, 6)::DOUBLE AS confidence, n_patterns FROM {matched(ITEM_HOSTS)})",
    "items_as_json": f"SELECT item_id, {_json([('title', 'to_json(title)'), ('url', 'to_json(url)'), ('publish_time', 'to_json(publish_time)'), ('timestamp', 'timestamp::VARCHAR')])} AS item FROM news_items",
}
