"""Addresses and names as Spark columns."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def clean(url: Column) -> Column:
    """Undo script escapes (fixed values) and percent signs (a plus stays a plus); // begins an https address."""
    plain = F.replace(F.replace(F.replace(url, F.lit("\\u003d"), F.lit("=")), F.lit("\\u0026"), F.lit("&")), F.lit("\\/"), F.lit("/"))
    decoded = F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)
    return F.when(decoded.startswith("//"), F.concat(F.lit("https:"), decoded)).otherwise(decoded)


def unwrap(url: Column) -> Column:
    """The address inside a search host's image redirect, if it is one."""
    redirect = host(url).contains("google.") & F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")).startswith("/imgres")
    inner = F.nullif(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("imgurl"))), F.lit(""))
    return F.when(redirect & inner.isNotNull(), clean(inner)).otherwise(url)


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """HTML character references as characters; Spark has no function for them."""
    return text.map(lambda t: None if t is None else html.unescape(t))


def joined(base: Column, url: Column) -> Column:
    """An address relative to a page's: whole, from the scheme, from the host, a query, or beside the page. Dot segments stay."""
    b = F.regexp_replace(base, r"[?#].*$", "")
    root = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    beside = F.when(b == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(b, r"[^/]*$", ""))
    return (
        F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), url))
        .when(url.startswith("/"), F.concat(root, url))
        .when(url.startswith("?"), F.concat(b, url))
        .when(url == "", base)
        .otherwise(F.concat(beside, url))
    )


def with_parameter(url: Column, key: str, value: str) -> Column:
    """The address with a query parameter set: earlier ones of that name and blank ones go, values are encoded anew, the new one stays where the name was first or comes last."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    head, tail = F.regexp_replace(url, r"[?#].*$", ""), F.regexp_extract(url, r"(#.*)$", 1)
    name = lambda p: F.try_url_decode(F.substring_index(p, "=", 1))
    content = lambda p: F.try_url_decode(F.regexp_replace(p, r"^[^=]*=", ""))
    parts = F.filter(F.split(query, "&"), lambda p: p.rlike(r"^[^=]+=."))
    pairs = F.transform(parts, lambda p: F.struct(name(p).alias("k"), content(p).alias("v")))
    first = F.array_position(F.transform(pairs, lambda p: p["k"]), key)
    kept = F.filter(F.transform(pairs, lambda p, i: F.when(i + 1 == first, F.struct(F.lit(key).alias("k"), F.lit(value).alias("v"))).when(p["k"] != key, p)), lambda p: p.isNotNull())
    every = F.when(first > 0, kept).otherwise(F.concat(kept, F.array(F.struct(F.lit(key).alias("k"), F.lit(value).alias("v")))))
    # Values of one name stand together, where the name is first.
    order = F.array_distinct(F.transform(every, lambda p: p["k"]))
    grouped = F.flatten(F.transform(order, lambda k: F.filter(every, lambda p: p["k"] == k)))
    return F.concat(head, F.lit("?"), F.array_join(F.transform(grouped, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&"), tail)


def asks_for_proof(text: Column) -> Column:
    """An answer that wants to know whether a person asks."""
    low = F.lower(text)
    # How such answers are marked.
    return low.contains('"type":"captcha"') | low.contains('"type": "captcha"')


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def provider(url: Column) -> Column:
    h = host(url)
    return F.when(h.contains("yandex."), "yandex").when(h.contains("google."), "google").otherwise("generic")


def page_index(url: Column) -> Column:
    """Number in the first of p, page and pn that the query has."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    get = lambda k: F.nullif(F.regexp_extract(query, rf"(?:^|&){k}=([^&]*)", 1), F.lit(""))
    return F.coalesce(get("p"), get("page"), get("pn")).try_cast("int")


def is_thumbnail(url: Column) -> Column:
    """The marks of a search host's previews."""
    u = F.lower(url)
    return u.startswith("data:") | u.contains("encrypted-tbn0") | (u.contains("gstatic.com/images") & u.contains("tbn")) | (u.contains("googleusercontent.com") & u.contains("tbn"))


def found(text: Column, patterns: list[str]) -> Column:
    """First groups of all matches, by pattern, then position."""
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]))


def image_urls(html: Column) -> Column:
    """Distinct image addresses of a result page, in order of discovery."""
    # Where result pages keep image addresses.
    patterns = [r'(?s)"ou"\s*:\s*"(.*?)"', r'(?s)"imgurl"\s*:\s*"(.*?)"', r'(?s)data-iurl="(.*?)"', r"imgurl=([^&\"'<>]+)"]
    urls = F.transform(found(html, patterns), lambda u: unwrap(clean(u)))
    return F.array_distinct(F.filter(urls, lambda u: (u.startswith("http://") | u.startswith("https://")) & ~is_thumbnail(u)))


def _pictures(urls: Column) -> Column:
    return F.array_distinct(F.filter(urls, lambda u: (u.startswith("http://") | u.startswith("https://")) & ~is_thumbnail(u)))


def escaped_image_urls(html: Column) -> Column:
    """Distinct image addresses of a page that keeps them in escaped attributes, in order of discovery."""
    # Where such pages keep image addresses.
    patterns = [r'"img_url"\s*:\s*"([^"]+)"', r"img_url=([^&\"'<>]+)"]
    return _pictures(F.transform(found(unescaped(html), patterns), clean))


def page_pictures(html: Column, base: Column) -> Column:
    """Distinct pictures of any page: those that its head names for sharing; without any, those of its image tags, each by the first fitting attribute."""
    at = lambda u: joined(base, clean(u))
    quoted = lambda tag, name: F.nullif(F.regexp_extract(tag, f"(?i){name}=[\"\\\\'](.*?)[\"\\\\']", 1), F.lit(""))
    web = lambda u: u.isNotNull() & (u.startswith("http://") | u.startswith("https://")) & ~is_thumbnail(u)
    # Tags, names and attributes under which pages have their pictures.
    tags = lambda name: F.regexp_extract_all(html, F.lit(f"(?i)(<{name}[^>]+>)"), F.lit(1))
    shared = F.filter(tags("meta"), lambda t: F.lower(t).contains("og:image") | F.lower(t).contains("twitter:image"))
    meta = _pictures(F.transform(F.filter(shared, lambda t: quoted(t, "content").isNotNull()), lambda t: at(quoted(t, "content"))))

    def best(tag: Column) -> Column:
        fits = lambda u: web(u) & ~F.lower(u).endswith(".svg")
        return F.coalesce(*[F.when(fits(at(quoted(tag, name))), at(quoted(tag, name))) for name in ("data-src", "data-original", "data-lazy-src", "src")])

    images = F.array_distinct(F.filter(F.transform(tags("img"), best), lambda u: u.isNotNull()))
    return F.when(F.size(meta) > 0, meta).otherwise(images)


def next_page(html: Column, base: Column, current: Column) -> Column:
    """The address of the result page with the smallest number above the current one; the first found among equals; null without any."""
    # Where result pages keep the address of the next one.
    named = [rf'"{k}"\s*:\s*"([^"]+)"' for k in ("moreURL", "moreUrl", "more_url", "nextPage", "next", "url")]
    text = unescaped(html)
    listed = F.filter(F.transform(found(text, named), lambda u: joined(base, clean(u))), lambda u: u.contains("/images/search"))
    loose = F.transform(F.regexp_extract_all(text, F.lit(r"(/images/search\?[^\"'<>\s]+)"), F.lit(1)), lambda u: joined(base, clean(u)))
    loose = F.filter(loose, lambda u: u.contains("p=") | u.contains("page="))
    good = F.filter(F.concat(listed, loose), lambda u: u.contains("text=") & ~u.contains("img_url="))
    known = F.filter(F.transform(good, lambda u, i: F.struct(page_index(u).alias("page"), i.alias("nth"), u.alias("url"))), lambda c: c["page"] > current)
    return F.array_min(known)["url"]


def of_search_host(url: Column) -> Column:
    """The search host's own domains."""
    netloc = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    own = netloc.endswith("google.com")
    for name in ("googleusercontent.com", "gstatic.com", "googleadservices.com"):
        own = own | netloc.endswith(name)
    return own | (netloc == "") | url.contains("webcache.googleusercontent.com")


def _web(urls: Column) -> Column:
    return F.array_distinct(F.filter(urls, lambda u: u.startswith("http://") | u.startswith("https://")))


def result_links(html: Column) -> Column:
    """Distinct pages that a result page links to through redirects, without the search host's own, in order."""
    # Fixed value: how result pages link.
    return F.filter(_web(F.transform(found(html, ['href="/url\\?q=([^&"]+)']), clean)), lambda u: ~of_search_host(u))


def escaped_result_links(html: Column) -> Column:
    """The same for pages that keep them in escaped attributes."""
    # Fixed value: where such pages keep them.
    return _web(F.transform(found(unescaped(html), ['"img_href"\\s*:\\s*"([^"]+)"']), clean))


def picture_answer(status: Column, kind: Column) -> Column:
    """Whether an answer brings a picture: status 200 and a kind of content that says so."""
    return F.coalesce((status == 200) & F.lower(kind).contains("image"), F.lit(False))


def name_part(text: Column, default: str = "video", most: int = 80) -> Column:
    """Letters, digits, dot, dash and underscore; characters beyond ASCII go, others become one underscore a run; no marks at the ends; ``default`` if nothing is left."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x00-\x7F]", "")
    kept = F.regexp_replace(F.regexp_replace(plain, r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.left(F.when(kept == "", F.lit(default)).otherwise(kept), F.lit(most))


def video_name(number: Column, extractor: Column, page: Column, url: Column, users: list[Column]) -> Column:
    """What a video's file is called: its id; with some hosts the first of ``users`` that isn't blank stands before it. ``page`` null: ``url``."""
    own = name_part(number)
    kind, at = F.lower(F.coalesce(extractor, F.lit(""))), F.lower(F.coalesce(page, url, F.lit("")))
    tube = kind.contains("youtube") | at.contains("youtu")
    named = ~tube & (kind.contains("tiktok") | at.contains("tiktok.com"))
    user = F.coalesce(*[F.nullif(F.trim(u), F.lit("")) for u in users], F.lit("u"))
    return F.when(named, F.concat(name_part(user, "u", 40), F.lit("_"), own)).otherwise(own)


def links(html: Column, relative: bool = False) -> Column:
    """Distinct links of a page, in order: web addresses, or all."""
    urls = F.transform(found(html, ['href="([^"]+)"']), lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u))
    return F.array_distinct(urls if relative else F.filter(urls, lambda u: u.startswith("http://") | u.startswith("https://")))


def safe_name(text: Column, most: int = 80) -> Column:
    """Only letters, digits, dot, dash and underscore; none of the marks at the ends."""
    return F.left(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", ""), F.lit(most))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def last_number(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d+)(?!.*\d)", 1).try_cast("long")
