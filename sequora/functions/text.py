"""Text and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_TITLE, MISSING_URL = "__MISSING_TITLE__", "__MISSING_URL__"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def event_text(texts: Column, event_type: Column) -> Column:
    """Non-empty texts joined by a space, trimmed; the type where nothing is left."""
    joined = strip(F.array_join(F.filter(texts, lambda t: t.isNotNull() & (t != "")), " "))
    return F.coalesce(F.nullif(joined, F.lit("")), event_type)


def url_to_domain(c: Column) -> Column:
    """Network location of URL-like text without a leading www.; other text as it is."""
    t = strip(F.coalesce(c, F.lit("")))
    looks = F.contains(t, F.lit("://")) | F.startswith(t, F.lit("www."))
    full = F.when(F.startswith(t, F.lit("http")), t).otherwise(F.concat(F.lit("https://"), t))
    netloc = F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(full, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    host = F.when(netloc != "", netloc).otherwise(F.substring_index(path, "/", 1))
    dotted = F.contains(t, F.lit(".")) & ~F.contains(t, F.lit(" ")) & ~F.contains(t, F.lit("/"))
    bare = lambda x: F.regexp_replace(x, r"^www\.", "")
    return F.when(t == "", "").when(looks, bare(host)).when(dotted, bare(t)).otherwise(t)


def event_text_v2(title: Column, url: Column, event_type: Column) -> Column:
    """Trimmed title and the URL's domain, joined by a space; the type where both are empty."""
    a, b = strip(F.coalesce(title, F.lit(""))), url_to_domain(url)
    both = F.concat_ws(" ", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
    return F.coalesce(F.nullif(both, F.lit("")), event_type, F.lit("UNK"))


def normalize_title(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def normalize_url(c: Column) -> Column:
    """Lower-case host name and decoded path words of 1 to 31 characters, joined by spaces."""
    t = strip(F.coalesce(c, F.lit("")))
    netloc = F.regexp_extract(t, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(netloc, r"^.*@", ""), r":[0-9]*$", ""))
    path = F.regexp_extract(t, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    words = F.filter(F.split(plain, r"[-/\s_]+"), lambda w: F.length(w).between(1, 31))
    return F.concat_ws(" ", F.nullif(host, F.lit("")), F.nullif(F.array_join(words, " "), F.lit("")))


def prompt_text(title: Column, url: Column, style: str = "sep") -> Column:
    """Encoder prompt of a title and a URL."""
    if style == "sep":
        return F.concat(title, F.lit(" [SEP] "), url)
    if style == "labelled":
        return F.concat(F.lit("Title: "), title, F.lit(" </s> URL: "), url)
    raise ValueError(f"unknown prompt style: {style}")


def hash_item_id(text: Column, low: int = 20, high: int = 500_000) -> Column:
    """low + md5 (as a 128-bit number) modulo high - low, by Horner's rule over four 32-bit limbs."""
    digest, n = F.md5(F.encode(text, "utf-8")), high - low
    out = F.lit(0).cast("long")
    for i in (1, 9, 17, 25):
        out = F.pmod(out * F.lit((1 << 32) % n) + F.conv(F.substring(digest, i, 8), 16, 10).cast("long"), F.lit(n))
    return out + F.lit(low)


def hash60(*parts: Column | str | int) -> Column:
    """A reproducible number below 2**60 from parts joined by colons: the first 15 digits of their md5."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(c.cast("string") for c in cols)).cast("binary")), 1, 15), 16, 10).cast("long")


def unit_hash(*parts: Column | str | int) -> Column:
    """hash60 as a fraction of one, in millionths."""
    return (hash60(*parts) % 1_000_000) / 1_000_000.0


def title_year(c: Column) -> tuple[Column, Column]:
    """Year and clean title of "Name (1995)" by fixed places from the end."""
    return F.substring(F.substring(c, -5, 5), 1, 4), F.substr(c, F.lit(1), F.greatest(F.length(c) - 7, F.lit(0)))


def hashed_features(c: Column, separator: str, buckets: int, most: int = 16) -> Column:
    """Ids of up to `most` separated values, hashed into buckets."""
    return F.slice(F.transform(F.split(c, separator), lambda v: F.pmod(hash60(v), F.lit(buckets))), 1, most)


def numbers_to_csv(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


def csv_to_numbers(c: Column, kind: str = "bigint") -> Column:
    return F.transform(F.filter(F.split(c, ","), lambda v: F.trim(v) != ""), lambda v: F.trim(v).cast(kind))


def parse_minute(c: Column) -> Column:
    """Unix seconds (UTC) of 'year-month-day hour:minute', one or two digits each; 0 for anything else."""
    ok = F.rlike(c, F.lit(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}$"))
    d, m = F.substring_index(c, " ", 1), F.substring_index(c, " ", -1)
    part = lambda s, sep, i: F.try_element_at(F.split(s, sep), F.lit(i)).try_cast("int")
    hour, minute = part(m, ":", 1), part(m, ":", 2)
    padded = F.concat_ws("-", F.lpad(F.substring_index(d, "-", 1), 4, "0"), F.lpad(part(d, "-", 2).cast("string"), 2, "0"), F.lpad(part(d, "-", 3).cast("string"), 2, "0"))
    days = F.datediff(padded.try_cast("date"), F.lit("1970-01-01").cast("date"))
    return F.coalesce(F.when(ok & (hour < 24) & (minute < 60), days.cast("long") * 86400 + hour * 3600 + minute * 60), F.lit(0)).cast("long")
