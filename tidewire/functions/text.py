"""Text functions as column expressions.

Regular expressions are Java's.  White space is the Unicode kind, lengths that
stand for display limits count UTF-16 units.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

WS = r"[\s   -     　﻿]"
NOT_WS = r"[^\s   -     　﻿]"
SENTENCE_END = rf"(?<=[.!?]){WS}+|\n+"

#: Words that carry no subject.
STOPWORDS = (
    "a an the and or but is are was were be been being has have had do does did will would should could may might must shall can "
    "of in on at to for with by from as this that these those it its he she they them his her their we us our i me my you your yours"
).split()

_NAME = r"[A-Z][A-Za-z’'-]+"
_ROLE = r"(?:[Ww]riter|[Rr]eporter|[Cc]orrespondent|[Ee]ditor|[Cc]hief|[Pp]hotographer|[Cc]olumnist|[Cc]ontributor|[Aa]nchor|[Jj]ournalist|[Aa]nalyst)s?"
_LINE_START = r"(?:^|(?<=[\n\r  ]))"
_LINE_END = r"(?=[\n\r  ]|\z)"
# Java's \b also stands between letters that are not ASCII.
_WORD_OPENS, _WORD_STOPS = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_CREDITED = rf"(?:{_LINE_START}[ ]*|(?<=[.!?][ ]))\b"
#: What feeds put around an article's text, in the order of removal; each is (pattern, replacement, only the first).
FEED_METADATA = (
    (rf"(?i)^{WS}*[^\n]{{0,200}}?doi:{NOT_WS}+{WS}*", "", False),
    (rf"(?i){WS}*Continue reading(?:\.{{2,}}|…)+{WS}*\z", "", False),
    (rf"(?i){WS}*The post{_WORD_STOPS}[\s\S]*?{_WORD_OPENS}first appeared on{_WORD_STOPS}[\s\S]*\z", "", False),
    (rf"(?i){WS}*Missed this morning[^.\n?]*\?{WS}*We forgive you\.{WS}*Read it here{WS}*\.?", "", True),
    (rf"{_LINE_START}{WS}*By[ ]+{_NAME}(?:[ ]+(?:and[ ]+)?{_NAME})*(?:[ ]*,[ ]*(?:[A-Za-z’'-]+[ ]*)*(?:Staff[ ]+)?{_ROLE})?{WS}*{_LINE_END}", "", True),
    (rf"{_CREDITED}(?:[Pp]hotos?|[Pp]hotographs?|[Pp]hotographers?|[Ii]mages?|[Pp]ictures?|[Cc]redits?)(?:[ ]+[Cc]redits?)?(?:[ ]+by|:)[ ]*{_NAME}(?:[ ]+{_NAME})*\.?[ ]*", " ", False),
    (rf"{_CREDITED}[Cc]redits?[ ]+[A-Z][A-Z’'-]+\.?[ ]*", " ", False),
    (rf"(?i)^{WS}*Caption{WS}*:{WS}*[^\n.!?]*[.!?]?{WS}*", "", False),
    (rf"{_WORD_OPENS}[A-Z][A-Za-z ]{{0,24}}:[ \t]*(?:https?:\/\/{NOT_WS}*|\d[\d,.]*)[ \t]*(?:#)?[ \t]*", " ", False),
    (rf"https?:\/\/{NOT_WS}+", " ", False),
)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def collapse(c: Column) -> Column:
    # A single space is left as it is; after this no other white space is there to trim.
    return F.trim(F.regexp_replace(c, rf"{WS}{{2,}}|(?! ){WS}", " "))


def units(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` names it."""
    return F.transform(F.array(c), f)[0]


#: What a text must hold for each pattern of ``FEED_METADATA`` to match; words with a capital as they are, others in any case.
_NEEDED = (("doi:",), ("continue reading",), ("first appeared on",), ("missed this morning",), ("By",), ("photo", "image", "picture", "credit"), ("credit",), ("caption",), (":",), ("http",))


def _holds(c: Column, words: tuple[str, ...]) -> Column:
    exact = [F.contains(c, F.lit(w)) for w in words if w != w.lower()]
    folded = [w for w in words if w == w.lower()]
    if folded:
        exact.append(bound(F.lower(c), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in folded])))
    return reduce(lambda a, b: a | b, exact)


def strip_feed_metadata(c: Column) -> Column:
    def step(needed: tuple[str, ...], pattern: str, to: str, once: bool) -> Callable[[Column], Column]:
        if once:
            # A pattern behind everything before its first match matches once.
            flags, rest = (pattern[:4], pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
            pattern, to = rf"{flags}\A([\s\S]*?)(?:{rest})", f"$1{to}"
        return lambda x: F.when(_holds(x, needed), F.regexp_replace(x, pattern, to)).otherwise(x)

    def all_steps(x: Column) -> Column:
        for rule, needed in zip(FEED_METADATA, _NEEDED, strict=True):
            x = bound(x, step(needed, *rule))
        return x

    return collapse(bound(c, lambda x: F.when(_holds(x, tuple(sorted({w for needed in _NEEDED for w in needed}))), all_steps(x)).otherwise(x)))


def article_text(title: Column, body: Column) -> Column:
    head, rest = trim(F.coalesce(title, F.lit(""))), strip_feed_metadata(F.coalesce(body, F.lit("")))
    return bound(F.struct(head.alias("head"), rest.alias("rest")), lambda p: F.when(p["head"] == "", p["rest"]).when(p["rest"] == "", p["head"]).otherwise(F.concat(p["head"], F.lit("\n"), p["rest"])))


def strip_markup(c: Column) -> Column:
    return collapse(F.regexp_replace(c, "<[^>]*>", " "))


def slugify(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 64)


def title_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(trim(c)), r"[^\p{L}\p{N}]+", " "))


def normalize(c: Column) -> Column:
    """Statements that differ only in case and spacing are the same."""
    return collapse(F.lower(c))


def safe_external_url(c: Column) -> Column:
    """An http or https URL with a host in lower case and a path of at least ``/``; else NULL."""
    c = trim(c)
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(c, r"^[A-Za-z]+:/*([^/?#\s]+)", 1))
    rest = F.regexp_extract(c, r"^[A-Za-z]+:/*[^/?#\s]+([\s\S]*)\z", 1)
    rest = F.regexp_replace(F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)), " ", "%20")
    bare = F.regexp_replace(host, F.when(scheme == "https", ":443$").otherwise(":80$"), "")
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), bare, rest))


def sentences(c: Column) -> Column:
    """Statements of at least 24 units, without feed metadata."""
    return F.filter(F.transform(F.split(c, SENTENCE_END), lambda s: strip_feed_metadata(trim(s))), lambda s: units(s) >= C.LEAST_SENTENCE_UNITS)


def excerpt(c: Column, limit: int = C.EXCERPT_UNITS) -> Column:
    text = collapse(F.coalesce(c, F.lit("")))
    cut = F.substring(text, 1, limit)
    last = F.length(cut) - F.instr(F.reverse(cut), " ")  # place of the last space, from 0
    at_word = (F.instr(cut, " ") > 0) & (last > limit // 2)
    return F.when(units(text) <= limit, text).otherwise(F.concat(F.when(at_word, F.substring(cut, F.lit(1), last)).otherwise(cut), F.lit("…")))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def search_words(c: Column, most: int | None = C.SEARCH_WORDS) -> Column:
    words = F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return words if most is None else F.slice(words, 1, most)


def dropped_words(c: Column) -> Column:
    return F.size(search_words(c)) < F.size(search_words(c, None))


def fts_match(c: Column) -> Column:
    words = search_words(c)
    return F.when(F.size(words) > 0, F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " AND "))


def tokens(c: Column) -> Column:
    """Lower-case ASCII words without stopwords, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z][a-z'-]*"), F.lit(0)), lambda w: ~w.isin(*STOPWORDS))


def sentence_tokens(c: Column) -> Column:
    """The tokens of each sentence, an array of lists."""
    return F.transform(F.split(c, SENTENCE_END), tokens)


def _runs(sentence_tokens: Column, join: Callable[..., Column]) -> Column:
    """Distinct runs of two and three words of each token list, each as ``join`` of its words."""

    def runs(t: Column) -> Column:
        of = lambda k: F.slice(F.transform(t, lambda w, i: join(w, *(F.get(t, i + j) for j in range(1, k)))), F.lit(1), F.greatest(F.size(t) - (k - 1), F.lit(0)))
        return F.concat(of(2), of(3))

    return F.array_distinct(F.flatten(F.transform(sentence_tokens, runs)))


def phrases(sentence_tokens: Column) -> Column:
    """Distinct runs of two and three words of each token list in an array of lists."""
    return _runs(sentence_tokens, lambda w, *more: F.concat(w, *(x for m in more for x in (F.lit(" "), m))))


def words(sentence_tokens: Column) -> Column:
    """Distinct words of an array of token lists, sorted."""
    return F.sort_array(F.array_distinct(F.flatten(sentence_tokens)))


def signature(c: Column) -> Column:
    """struct<words, phrases>, distinct and sorted; phrases never cross a sentence."""
    return bound(sentence_tokens(c), lambda per: F.struct(words(per).alias("words"), F.sort_array(phrases(per)).alias("phrases")))


def hashed_signature(c: Column) -> Column:
    """The same terms as hashes, in no order: to compare texts, runs of words need not be written out."""
    hashed = lambda per: F.transform(F.array_distinct(F.flatten(per)), lambda w: F.xxhash64(w))
    return bound(sentence_tokens(c), lambda per: F.struct(hashed(per).alias("words"), _runs(per, F.xxhash64).alias("phrases")))


def normalize_terms(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.filter(c, lambda w: w.isNotNull()), normalize), lambda w: w != "")))
