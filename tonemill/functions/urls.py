"""Addresses and page bodies: absolute addresses, cache names, decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the site whose relative addresses calendars print.
SITE = "www.federalreserve.gov"


def absolute_url(url: Column, site: str = SITE) -> Column:
    """The absolute form of a site-relative address; ``.`` and ``..`` in its path are resolved."""
    base = f"https://{site}"
    rooted = F.when(url.startswith("/"), url).otherwise(F.concat(F.lit("/"), url))
    return (
        F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), url).when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url == "", base)
        .otherwise(F.concat(F.lit(base), F.when(url.rlike(r"(^|/)\.\.?(/|$|[?#])"), without_dots(rooted)).otherwise(rooted)))
    )


def without_dots(path: Column) -> Column:
    """A rooted path (and what follows it) without ``.`` and ``..`` steps; steps above the root are dropped."""
    steps = F.split(F.regexp_extract(path, "^([^?#]*)", 1), "/")
    kept = F.aggregate(
        F.slice(steps, 2, F.size(steps)), F.array().cast("array<string>"),
        lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.array_append(a, s)),
    )
    closing = F.when(F.element_at(steps, -1).isin(".", ".."), "/").otherwise("")
    return F.concat(F.lit("/"), F.regexp_replace(F.concat(F.array_join(kept, "/"), closing), "^/$", ""), F.regexp_extract(path, "^[^?#]*(.*)$", 1))


def cache_key(url: Column, site: str = SITE) -> Column:
    """The name under which a page is stored: its path alone, separators and odd characters as underscores, ``index`` if empty."""
    path = F.regexp_extract(absolute_url(url, site), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    key = F.replace(F.btrim(path, F.lit("/")), F.lit("/"), F.lit("_"))
    return F.when(key == "", "index").otherwise(F.regexp_replace(key, "[^A-Za-z0-9._-]", "_"))


#: What Windows-1252 has at 0x80-0x9F (the replacement character where it has nothing).
CP1252_HIGH = "€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ"


def decode_body(body: Column) -> Column:
    """A page body as text: UTF-8 if it is valid, else Windows-1252; no session settings are needed."""
    latin = F.decode(body, "ISO-8859-1")
    return F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")).otherwise(F.translate(latin, "".join(map(chr, range(0x80, 0xA0))), CP1252_HIGH))
