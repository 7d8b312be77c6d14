"""URL rules as column expressions.  Nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts of services that are never news of the site.
SERVICE_HOSTS = (
    "facebook.com www.facebook.com m.facebook.com twitter.com www.twitter.com x.com instagram.com www.instagram.com "
    "linkedin.com www.linkedin.com youtube.com www.youtube.com m.youtube.com tiktok.com www.tiktok.com weibo.com www.weibo.com "
    "telegram.org t.me web.telegram.org whatsapp.com wa.me pinterest.com www.pinterest.com reddit.com www.reddit.com threads.net www.threads.net "
    "play.google.com apps.apple.com itunes.apple.com microsoft.com www.microsoft.com mail.google.com outlook.com mail.yahoo.com "
    "google.com www.google.com bing.com www.bing.com baidu.com www.baidu.com"
).split()
# What cannot be news by its address, pagination, and second-level labels under country codes.
NOT_NEWS = r"(?i)^(?:mailto|tel|javascript|data):|^#|/cdn-cgi/|/wp-content/uploads/|/wp-admin/|\.(?:jpg|jpeg|png|gif|svg|webp|ico|pdf|zip|rar|exe|mp3|mp4|avi)$"
PAGINATION = (r"/[0-9]+#\w+$", r"(?i)[?&](?:page|p|pagenum|pn)=[0-9]+$", r"(?i)/page/[0-9]+/?$", r"(?i)/[^/]+_(?:[2-9]|[1-9][0-9])\.(?:s?html?|asp|php|jsp)$")
SECOND_LEVEL = "com co org net edu gov ac or".split()
TOP_LEVEL = "com net org edu gov cn uk jp kr hk tw io co me info biz".split()
ASSETS = r"\.(?:jpg|png|gif|css|js|pdf|zip)$"
NOT_STORIES = r"/login|/register|/contact|/lien-he|/about|/search|/tag/"
STORY_PATHS = r"/article|/news|/story|/post|/detail|/chi-tiet|/tin-chi-tiet|/tin-|/bai-viet|/a/|/p/|/n/"
# Words of paths that make an index page or a story.
INDEX_WORDS = "index list category tag tags archive archives page pages topic topics channel section sections browse search results all latest newest popular hot trending top featured home main default".split()
STORY_WORDS = "article articles news story stories post posts detail details content view read show item entry blog p a n id".split()
# Path segments that are always static, and prefixes of story and of topic ids.
STATIC_WORDS = "news article articles story stories post posts blog daily weekly world local topic tag category section archive archives content detail index view show list".split()
STORY_PREFIXES = "content_ article_ news_ post_ story_ detail_ item_ id_ p_ a_ n_".split()
TOPIC_PREFIXES = "node_ topic_ tag_ category_ cat_ list_ index_ page_ channel_".split()

_SCHEME = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):"
_BEFORE_PATH = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?"


def site_host(url: Column) -> Column:
    """Host of a URL in lower case, without port, user and a leading ``www.`` or ``m.``."""
    host = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]+)", 1))
    return F.regexp_replace(host, r"^(?:www|m)\.", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def netloc(url: Column) -> Column:
    """Authority of a URL as written: with port and user."""
    return F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _BEFORE_PATH + r"([^?#]*)", 1), r";[^/]*$", "")


def segments(of_path: Column) -> Column:
    return F.filter(F.split(of_path, "/"), lambda s: s != "")


def base_url(url: Column) -> Column:
    return F.when(url == "", "").otherwise(F.concat(scheme(url), F.lit("://"), netloc(url)))


def _without_dots(of_path: Column) -> Column:
    """Removal of dot segments (RFC 3986) from an absolute path."""
    parts = F.split(of_path, "/")
    climbed = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(s == ".", kept).otherwise(F.concat(kept, F.array(s))),
    )
    last = F.element_at(parts, -1)
    return F.concat(F.array_join(climbed, "/"), F.when(last.isin(".", "..") & (F.element_at(climbed, -1) != ""), "/").otherwise(""))


def join_url(base: Column, href: Column) -> Column:
    """Absolute form of a reference found on a page with that base; the reference itself if there is no base."""
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    href_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    base_path = F.regexp_extract(base, _BEFORE_PATH + r"([^?#]*)", 1)
    folder = F.when(base_path == "", "/").otherwise(F.regexp_replace(base_path, r"[^/]*$", ""))
    return (
        F.when(F.coalesce(base, F.lit("")) == "", href)
        .when(href == "", base)
        .when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, _without_dots(href_path), tail))
        .when(href.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, href_path)), tail))
    )


def root_domain(domain: Column) -> Column:
    parts = F.split(F.lower(domain), r"\.")
    n = F.size(parts)
    return (
        F.when(domain == "", "")
        .when((n >= 3) & F.try_element_at(parts, F.lit(-2)).isin(SECOND_LEVEL), F.array_join(F.slice(parts, -3, 3), "."))
        .when(n >= 2, F.array_join(F.slice(parts, -2, 2), "."))
        .otherwise(domain)
    )


def domain_name(domain: Column) -> Column:
    """The label that names the organisation: the last one that is no public suffix, else the first."""
    parts = F.split(F.lower(domain), r"\.")
    named = F.filter(parts, lambda p: ~p.isin(sorted({*TOP_LEVEL, *SECOND_LEVEL})))
    return F.when(domain == "", "").otherwise(F.coalesce(F.try_element_at(named, F.lit(-1)), F.try_element_at(parts, F.lit(1))))


def same_site(url: Column, base: Column) -> Column:
    a, b = F.lower(netloc(url)), F.lower(netloc(base))
    named = (domain_name(a) != "") & (domain_name(a) == domain_name(b))
    return F.coalesce((a != "") & (b != "") & ((a == b) | (root_domain(a) == root_domain(b)) | named), F.lit(False))


def external_service(url: Column) -> Column:
    domain = F.lower(netloc(url))
    return F.coalesce(domain.isin(SERVICE_HOSTS) | root_domain(domain).isin(SERVICE_HOSTS), F.lit(False))


def not_news(url: Column) -> Column:
    return F.coalesce(url.rlike(NOT_NEWS), F.lit(False))


def pagination(url: Column) -> Column:
    found = F.lit(False)
    for pattern in PAGINATION:
        found = found | url.rlike(pattern)
    return F.coalesce(found, F.lit(False))


def absolute(url: Column, base: Column) -> Column:
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(join_url(base, url))


def news_candidate(url: Column, base: Column) -> Column:
    is_absolute = url.startswith("http://") | url.startswith("https://")
    full = absolute(url, base)
    ok = (url != "") & ~not_news(url) & ~pagination(url) & (is_absolute | (base != "")) & ~external_service(full) & same_site(full, base)
    return F.coalesce(ok, F.lit(False))


def valid_news_url(url: Column, base: Column) -> Column:
    p = F.lower(path(url))
    return news_candidate(url, base) & F.coalesce(~p.rlike(ASSETS) & ~p.rlike(NOT_STORIES), F.lit(False))


def confident_item(title: Column, url: Column) -> Column:
    """A long title with an address that looks like a story's."""
    p = F.lower(path(url))
    ok = (F.length(title) >= 15) & (F.size(segments(path(url))) >= 2) & p.rlike(STORY_PATHS + r"|/[0-9]{4,}|/[0-9]{4}/[0-9]{1,2}")
    return F.coalesce(ok, F.lit(False))


def classify_url(url: Column) -> Column:
    """struct(page_type, confidence, reason) by the first rule that holds."""
    p = F.lower(path(url))
    s = segments(F.when(p.contains("."), F.regexp_replace(p, r"\.[^.]*$", "")).otherwise(p))
    n, last = F.size(s), F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(""))
    joined = F.array_join(s, "/")
    before = F.when(n >= 2, F.slice(s, 1, n - 1)).otherwise(F.array().cast("array<string>"))
    kind = lambda t, c, r: F.struct(F.lit(t).alias("page_type"), F.lit(c).alias("confidence"), F.lit(r).alias("reason"))
    return (
        F.when(n == 0, kind("index", 0.8, "root"))
        .when(last.isin(INDEX_WORDS), kind("index", 0.85, "index word"))
        .when(last.rlike(r"^[0-9]{5,}$"), kind("article", 0.9, "long number"))
        .when(joined.rlike(r"(?:^|/)[0-9]{4}/[0-9]{1,2}/"), kind("article", 0.85, "date path"))
        .when((F.length(last) > 15) & last.rlike(r"-.*-"), kind("article", 0.8, "slug"))
        .when(last.rlike(r"^[^_]*_[0-9]{5,}$"), kind("article", 0.85, "prefixed number"))
        .when((n >= 3) & ~last.isin(STORY_WORDS), kind("article", 0.6, "deep path"))
        .when(F.arrays_overlap(before, F.array(*map(F.lit, STORY_WORDS))), kind("article", 0.7, "story word"))
        .otherwise(kind("unknown", 0.5, "nothing telling"))
    )


def segment_type(s: Column, learned: Column | None = None) -> Column:
    """Kind of a path segment; ``learned``: further static segments (compared with the segment in lower case)."""
    static = F.lower(s).isin(STATIC_WORDS)
    if learned is not None:
        static = static | F.array_contains(learned, F.lower(s))
    length = F.length(s)
    letters = length - F.length(F.regexp_replace(s, r"\p{L}", ""))
    bare = F.regexp_replace(s, "[-_]", "")
    digits = F.length(bare) - F.length(F.regexp_replace(bare, r"[0-9]", ""))
    return (
        F.when(s == "", "empty")
        .when(s.rlike(r"^\p{Nd}+$"), "number")
        .when(s.rlike(r"^[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?$"), "date")
        .when(static, "static")
        .when(s.contains("-") & (letters / length > 0.5) & (length > 5), "slug")
        .when(s.rlike(r"\p{Nd}") & s.rlike(r"\p{L}") & bare.rlike(r"(?i)^[a-z0-9]{8,}$") & (digits / F.length(bare)).between(0.2, 0.8), "hash")
        .when(s.rlike(r"^\p{L}+$") & (length < 15), "static")
        .otherwise("mixed")
    )


def url_components(url: Column, learned: Column | None = None) -> Column:
    """struct(domain, path_segments, segment_types, extension, prefix_pattern, has_date_segment)."""
    p = path(url)
    extension = F.lower(F.regexp_extract(p, r"\.([^./]*)$", 1))
    s = segments(F.regexp_replace(p, r"\.[^./]*$", ""))
    types = F.transform(s, lambda x: segment_type(x, learned))
    prefixed = F.filter(s, lambda x: x.rlike(r"^[A-Za-z]+_[0-9]"))
    prefix = F.nullif(F.lower(F.regexp_extract(F.coalesce(F.try_element_at(prefixed, F.lit(1)), F.lit("")), r"^([A-Za-z]+_)[0-9]", 1)), F.lit(""))
    return F.struct(
        netloc(url).alias("domain"), s.alias("path_segments"), types.alias("segment_types"), extension.alias("extension"),
        prefix.alias("prefix_pattern"), F.array_contains(types, "date").alias("has_date_segment"),
    )


def likely_detail(c: Column) -> Column:
    return (F.size(c["path_segments"]) >= 2) & (c["has_date_segment"] | F.coalesce(c["prefix_pattern"].isin(STORY_PREFIXES), F.lit(False)))


def likely_topic(c: Column) -> Column:
    return (F.size(c["path_segments"]) == 1) & F.coalesce(c["prefix_pattern"].isin(TOPIC_PREFIXES), F.lit(False))


def confident_detail(url: Column, c: Column | None = None, kind: Column | None = None) -> Column:
    """Is the URL with high confidence that of a story?  ``c``, ``kind``: its components and class, if they are at hand."""
    c = url_components(url) if c is None else c
    kind = classify_url(url) if kind is None else kind
    s, types = c["path_segments"], c["segment_types"]
    telling = F.arrays_zip(s.alias("s"), types.alias("t"))
    feature = F.exists(
        telling,
        lambda x: ((x["t"] == "number") & (F.length(x["s"]) >= 5)) | (x["t"] == "hash") | ((x["t"] == "mixed") & x["s"].rlike(r"[0-9]{6,}")),
    )
    slug = (F.size(s) >= 3) & (F.try_element_at(types, F.lit(-1)) == "slug")
    by_structure = (
        (F.size(s) >= 2)
        & ~F.coalesce(c["prefix_pattern"].isin(TOPIC_PREFIXES), F.lit(False))
        & ~F.lower(F.try_element_at(s, F.lit(-1))).isin("index", "default", "home", "main", "list")
        & (c["has_date_segment"] | F.coalesce(c["prefix_pattern"].isin(STORY_PREFIXES), F.lit(False)) | feature | F.coalesce(slug, F.lit(False)))
    )
    return F.when(kind["confidence"] >= 0.7, kind["page_type"] == "article").otherwise(F.coalesce(by_structure, F.lit(False)))


def same_root(d1: Column, d2: Column) -> Column:
    """Equal last two labels; plain equality where one has fewer."""
    a, b = F.split(d1, r"\."), F.split(d2, r"\.")
    return F.when((F.size(a) >= 2) & (F.size(b) >= 2), F.slice(a, -2, 2) == F.slice(b, -2, 2)).otherwise(d1 == d2)


def root_key(domain: Column) -> Column:
    """Equi-join key of ``same_root``."""
    a = F.split(domain, r"\.")
    return F.when(F.size(a) >= 2, F.array_join(F.slice(a, -2, 2), ".")).otherwise(domain)
