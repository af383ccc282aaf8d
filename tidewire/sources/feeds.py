"""RSS and Atom documents as entry tables, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, collapse, strip_feed_metadata, strip_markup

#: Named character references, case-sensitive.
NAMED = dict(
    lt="<", gt=">", quot='"', apos="'", ldquo="“", rdquo="”", lsquo="‘", rsquo="’", ndash="–", mdash="—", hellip="…", nbsp=" ", ensp=" ", emsp=" ", thinsp=" ",
    copy="©", reg="®", trade="™", deg="°", pound="£", euro="€", yen="¥", cent="¢", sect="§", para="¶", middot="·", bull="•", dagger="†", permil="‰", laquo="«", raquo="»",
    times="×", divide="÷", plusmn="±", micro="µ", frac12="½", frac14="¼", frac34="¾", sup2="²", sup3="³", prime="′", Prime="″",
    szlig="ß", auml="ä", ouml="ö", uuml="ü", Auml="Ä", Ouml="Ö", Uuml="Ü", eacute="é", egrave="è", ecirc="ê", agrave="à", ccedil="ç", ntilde="ñ",
)
#: Forms of dates in feeds; a leading weekday is cut first.
DATE_FORMS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")


def _point(code: Column) -> Column:
    """The character of a code point, NULL where there is none or it is a control or surrogate."""
    ok = (code >= 0x20) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _numeric(text: Column, pattern: str, base: int) -> Column:
    """Each numeric reference replaced by its character, by the distinct references of the text."""

    def put(text: Column, ref: Column) -> Column:
        digits = F.regexp_extract(ref, pattern, 1)
        code = F.when(F.length(digits) <= 7, F.conv(digits, base, 10).cast("long"))
        return F.replace(text, ref, F.coalesce(bound(code, _point), ref))

    refs = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    return bound(text, lambda c: F.when(F.contains(c, F.lit("&#")), F.aggregate(refs(c), c, put)).otherwise(c))


def _named(c: Column) -> Column:
    # One pass over the text: split at references, so that what one gives is not read again.
    known = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    parts = F.regexp_extract_all(c, F.lit(r"&[A-Za-z][A-Za-z0-9]*;|[^&]+|&"), F.lit(0))
    one = lambda p: F.when(p.rlike(r"^&[A-Za-z][A-Za-z0-9]*;$"), F.coalesce(F.try_element_at(known, F.regexp_extract(p, r"^&(\w+);$", 1)), p)).otherwise(p)
    return F.replace(F.array_join(F.transform(parts, one), ""), F.lit("&amp;"), F.lit("&"))


def decode_entities(text: Column) -> Column:
    """CDATA, then hexadecimal, decimal and named references, ``&amp;`` last."""
    c = F.regexp_replace(text, r"<!\[CDATA\[([\s\S]*?)\]\]>", "$1")
    c = _numeric(c, r"&#[xX]([0-9a-fA-F]+);", 16)
    c = _numeric(c, r"&#(\d+);", 10)
    return bound(c, lambda x: F.when(F.contains(x, F.lit("&")), _named(x)).otherwise(x))


def clean(c: Column) -> Column:
    return collapse(decode_entities(c))


def tag(xml: Column, name: str) -> Column:
    """Text of the first element; empty if there is none."""
    return clean(F.regexp_extract(xml, rf"(?i)<{name}(?:\s[^>]*)?>([\s\S]*?)</{name}>", 1))


def elements(xml: Column, name: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?i)<{name}(?:\s[^>]*)?>[\s\S]*?</{name}>"), F.lit(0))


def _first(*options: Column) -> Column:
    return F.coalesce(*[bound(o, lambda x: F.when(x != "", x)) for o in options], F.lit(""))


def atom_link(entry: Column) -> Column:
    href = r"""\bhref=["']([^"']+)["']"""
    alternate = r"""\brel=["']alternate["']"""
    found = [F.regexp_extract(entry, p, 1) for p in (rf"(?i)<link\b[^>]*{alternate}[^>]*{href}", rf"(?i)<link\b[^>]*{href}[^>]*{alternate}", rf"(?i)<link\b[^>]*{href}")]
    return _first(*[clean(x) for x in found], tag(entry, "link"))


def published_at(entry: Column) -> Column:
    """The first date given; the epoch if it is missing or unreadable."""
    raw = F.regexp_replace(_first(*[tag(entry, x) for x in ("pubDate", "dc:date", "published", "updated")]), r"^[A-Za-z]{3,9},\s*", "")
    return bound(raw, lambda x: F.coalesce(*[F.try_to_timestamp(x, F.lit(form)) for form in DATE_FORMS], F.timestamp_seconds(F.lit(0))))


def longest(*texts: Column) -> Column:
    """The longest text; the earlier of equally long ones."""
    return bound(F.array(*texts), lambda all_: F.aggregate(all_, all_[0], lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best)))


def entries(feeds: DataFrame, xml: str = "xml", source: str = "source_id") -> DataFrame:
    """One row per entry: RSS items first, then Atom entries, with their place in the feed."""
    rss = F.transform(elements(F.col(xml), "item"), lambda e: F.struct(F.lit("rss").alias("form"), e.alias("entry")))
    atom = F.transform(elements(F.col(xml), "entry"), lambda e: F.struct(F.lit("atom").alias("form"), e.alias("entry")))
    e = feeds.select(source, F.posexplode(F.concat(rss, atom)).alias("position", "e")).select(source, "position", "e.*")
    entry, is_rss = F.col("entry"), F.col("form") == "rss"
    link = F.when(is_rss, tag(entry, "link")).otherwise(atom_link(entry))
    body = longest(*[strip_markup(tag(entry, x)) for x in ("description", "summary", "content:encoded", "content")])
    return e.select(source, "position", _first(F.when(is_rss, tag(entry, "guid")).otherwise(tag(entry, "id")), link).alias("external_id"), link.alias("url"), strip_markup(tag(entry, "title")).alias("title"), strip_feed_metadata(body).alias("body"), published_at(entry).alias("published_at"))
