"""Scalar functions over the driver's texts, times and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numbers as N
from ..functions import text as T
from ..operators import phrases as P
from ..sources import feeds
from .registry import query

# ---- feeds -----------------------------------------------------------------


def feed_view(t) -> DataFrame:
    """Pages as feeds of one item each."""
    body = F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1)
    xml = F.concat(F.lit("<rss><channel><item><title>"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), F.lit("</title><guid>"), F.col("page_id").cast("string"), F.lit("</guid><link>"), F.col("url"), F.lit("</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate><description><![CDATA["), body, F.lit("]]></description></item></channel></rss>"))
    return t.read("pages").select(F.col("page_id").alias("source_id"), xml.alias("xml"))


@query()
def src_01_02_parse_feeds(t) -> DataFrame:
    return feeds.entries(feed_view(t))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '\\s+', ' ', 'g')) AS first_heading, CAST(len(regexp_extract_all(html, '(?is)<li[^>]*>.*?</li>')) AS BIGINT) AS items FROM pages")
def src_03_extract_tags(t) -> DataFrame:
    return t.read("pages").select("page_id", T.collapse(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("first_heading"), F.size(feeds.elements(F.col("html"), "li")).cast("long").alias("items"))


@query("SELECT page_id, url AS link FROM pages")
def src_04_atom_link(t) -> DataFrame:
    entry = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<entry><link rel="self" href="http://self.example/"/><link rel="alternate" href="'), "url", F.lit('"/></entry>'))).otherwise(F.concat(F.lit("<entry><link>"), "url", F.lit("</link></entry>")))
    return t.read("pages").select("page_id", feeds.atom_link(entry).alias("link"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(epoch_ms(date_trunc('second', ts)) AS BIGINT) END AS published_ms FROM events")
def src_05_published_at(t) -> DataFrame:
    stamp = F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss")
    entry = F.when(F.col("event_id") % 5 == 0, F.lit("<pubDate>soon</pubDate>")).when(F.col("event_id") % 5 == 1, F.concat(F.lit("<published>"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</published>"))).otherwise(F.concat(F.lit("<pubDate>"), stamp, F.lit(" +0000</pubDate>")))
    return t.ev.select("event_id", F.unix_millis(feeds.published_at(entry)).alias("published_ms"))


@query("SELECT doc_id, CASE WHEN length(body) > length(title) THEN 'body' ELSE 'title' END AS chosen FROM texts WHERE title <> body")
def src_06_longest_of(t) -> DataFrame:
    return t.texts.where("title <> body").select("doc_id", F.when(feeds.longest(F.col("title"), F.col("body")) == F.col("body"), "body").otherwise("title").alias("chosen"))


@query(r"SELECT page_id, replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&') AS title FROM pages".replace('\\"', '"'))
def src_07_decode_entities(t) -> DataFrame:
    return t.read("pages").select("page_id", feeds.decode_entities(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR) ELSE url END AS external_id FROM pages")
def src_08_external_id(t) -> DataFrame:
    guid = F.when(F.col("page_id") % 3 == 0, F.col("page_id").cast("string")).otherwise("")
    return t.read("pages").select("page_id", F.coalesce(F.nullif(guid, F.lit("")), F.nullif(F.col("url"), F.lit(""))).alias("external_id"))


# ---- strings ---------------------------------------------------------------


_WS = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_NAME, _ENDS = r"[A-Z][A-Za-z’''-]+", r"[\n\r\x{2028}\x{2029}]"


def _feed_rules() -> str:
    """The removals of feed metadata in DuckDB, one after the other, as views ``feed0`` to ``feed10``.

    Its expressions know no look-behind: what stands before a match is captured and put back, and where removals may
    adjoin, a private character first marks each place at which one may begin.
    """
    w, any_case = f"[{_WS}]*", lambda words: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)
    replace = lambda text, pattern, to, flags="'g'": f"regexp_replace({text}, '{pattern}', {to}, {flags})"

    def credited(text: str, word: str, rest: str) -> str:
        marked = text
        for before, spaces in ((f"^|{_ENDS}", "[ ]*"), ("[.!?][ ]", "")):
            marked = replace(marked, f"({before})({spaces}{word})", "'\\1' || chr(57344) || '\\2'")
        return f"replace({replace(marked, rf'\x{{e000}}[ ]*{word}{rest}', chr(39) + ' ' + chr(39))}, chr(57344), '')"

    role = "(?:[Ww]riter|[Rr]eporter|[Cc]orrespondent|[Ee]ditor|[Cc]hief|[Pp]hotographer|[Cc]olumnist|[Cc]ontributor|[Aa]nchor|[Jj]ournalist|[Aa]nalyst)s?"
    rules = (
        lambda x: replace(x, rf"^{w}[^\n]{{0,200}}?{any_case('doi')}:[^{_WS}]+{w}", "''"),
        lambda x: replace(x, rf"{w}{any_case('continue reading')}(?:\.{{2,}}|…)+{w}$", "''"),
        lambda x: replace(x, rf"{w}{any_case('the post')}\b(?s:.)*?\b{any_case('first appeared on')}\b(?s:.)*$", "''"),
        lambda x: replace(x, rf"{w}{any_case('missed this morning')}[^.\n?]*\?{w}{any_case('we forgive you')}\.{w}{any_case('read it here')}{w}\.?", "''", "''"),
        lambda x: replace(x, rf"(^|{_ENDS}){w}By[ ]+{_NAME}(?:[ ]+(?:and[ ]+)?{_NAME})*(?:[ ]*,[ ]*(?:[A-Za-z’''-]+[ ]*)*(?:Staff[ ]+)?{role})?{w}({_ENDS}|$)", "'\\1\\2'", "''"),
        lambda x: credited(x, "(?:[Pp]hotos?|[Pp]hotographs?|[Pp]hotographers?|[Ii]mages?|[Pp]ictures?|[Cc]redits?)", rf"(?:[ ]+[Cc]redits?)?(?:[ ]+by|:)[ ]*{_NAME}(?:[ ]+{_NAME})*\.?[ ]*"),
        lambda x: credited(x, "[Cc]redits?", r"[ ]+[A-Z][A-Z’''-]+\.?[ ]*"),
        lambda x: replace(x, rf"^{w}{any_case('caption')}{w}:{w}[^\n.!?]*[.!?]?{w}", "''"),
        lambda x: replace(x, rf"\b[A-Z][A-Za-z ]{{0,24}}:[ \t]*(?:https?://[^{_WS}]*|\d[\d,.]*)[ \t]*(?:#)?[ \t]*", "' '"),
        lambda x: replace(x, rf"https?://[^{_WS}]+", "' '"),
    )
    views = ["feed0 AS (SELECT doc_id, body FROM texts)"]
    return ", ".join(views + [f"feed{i + 1} AS (SELECT doc_id, {rule('body')} AS body FROM feed{i})" for i, rule in enumerate(rules)])


@query(f"SELECT doc_id, trim(regexp_replace(body, '[{_WS}]+', ' ', 'g'), ' ') AS body FROM feed10", _feed_rules())
def str_01_strip_feed_metadata(t) -> DataFrame:
    return t.texts.select("doc_id", T.strip_feed_metadata(F.col("body")).alias("body"))


@query()
def str_02_article_text(t) -> DataFrame:
    return t.texts.select("doc_id", T.article_text(F.col("title"), F.col("body")).alias("article"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM pages")
def str_03_strip_markup(t) -> DataFrame:
    return t.read("pages").select("page_id", T.strip_markup(F.col("html")).alias("plain"))


@query("SELECT doc_id, substr(regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64) AS slug FROM texts")
def str_04_slugify(t) -> DataFrame:
    return t.texts.select("doc_id", T.slugify(F.col("title")).alias("slug"))


@query("SELECT doc_id, trim(regexp_replace(lower(trim(title)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS title_key FROM texts")
def str_05_title_key(t) -> DataFrame:
    return t.texts.select("doc_id", T.title_key(F.col("title")).alias("title_key"))


@query("SELECT page_id, url AS safe FROM pages WHERE regexp_matches(url, '^https?://[^/]+/')")
def str_06_safe_url(t) -> DataFrame:
    return t.read("pages").where(F.col("url").rlike("^https?://[^/]+/")).select("page_id", T.safe_external_url(F.col("url")).alias("safe"))


@query()
def str_07_sentences(t) -> DataFrame:
    return t.texts.select("doc_id", F.posexplode(T.sentences(F.col("body"))).alias("position", "sentence"))


@query("SELECT doc_id, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS statement FROM texts")
def str_08_normalize(t) -> DataFrame:
    return t.texts.select("doc_id", T.normalize(F.col("title")).alias("statement"))


@query(
    "SELECT doc_id, CASE WHEN length(c) <= 220 THEN c ELSE (CASE WHEN strpos(substr(c, 1, 220), ' ') > 0 AND 220 - strpos(reverse(substr(c, 1, 220)), ' ') > 110 THEN substr(c, 1, 220 - strpos(reverse(substr(c, 1, 220)), ' ')) ELSE substr(c, 1, 220) END) || '…' END AS excerpt FROM x",
    "x AS (SELECT doc_id, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS c FROM texts)",
)
def str_09_excerpt(t) -> DataFrame:
    return t.texts.select("doc_id", T.excerpt(F.col("body")).alias("excerpt"))


@query("SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def str_10_escape_html(t) -> DataFrame:
    return t.read("pages").select("page_id", T.escape_html(F.col("url")).alias("escaped"))


@query("SELECT doc_id, array_to_string(list_filter(string_split_regex(title, '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')[1:8], ' ') AS words, len(list_filter(string_split_regex(title, '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')) > 8 AS dropped FROM texts")
def str_11_12_search_words(t) -> DataFrame:
    return t.texts.select("doc_id", F.array_join(T.search_words(F.col("title")), " ").alias("words"), T.dropped_words(F.col("title")).alias("dropped"))


@query("SELECT doc_id, array_to_string(list_transform(list_filter(string_split_regex(title, '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')[1:8], lambda w: '\"' || w || '\"'), ' AND ') AS fts FROM texts WHERE len(list_filter(string_split_regex(title, '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')) > 0")
def str_13_fts_match(t) -> DataFrame:
    return t.texts.select("doc_id", T.fts_match(F.col("title")).alias("fts")).where("fts IS NOT NULL")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS from_day FROM ev WHERE event_id % 3 = 0")
def str_14_parse_archive_query(t) -> DataFrame:
    given = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, "2024-02-30").otherwise("yesterday")
    return t.ev.select("event_id", F.date_format(D.iso_day(given), "yyyy-MM-dd").alias("from_day")).where("from_day IS NOT NULL")


@query("SELECT DISTINCT printf('%.2f/%.2f/%.2f', 0.45, 0.04, k / 100.0) AS label FROM ev")
def str_15_threshold_label(t) -> DataFrame:
    return t.ev.select(F.format_string("%.2f/%.2f/%.2f", F.lit(0.45), F.lit(0.04), F.col("k") / 100.0).alias("label")).distinct()


# ---- dates -----------------------------------------------------------------


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS slot FROM ev")
def dat_01_day_key(t) -> DataFrame:
    return t.ev.select("event_id", D.day_key(F.col("ts")).alias("slot"))


@query("SELECT CAST(epoch_ms(now - INTERVAL 7 DAY) AS BIGINT) AS observed_ms, CAST(epoch_ms(now - INTERVAL 37 DAY) AS BIGINT) AS baseline_ms, 7 AS observed_days, 30 AS baseline_days FROM ev_clock")
def dat_02_04_trend_window(t) -> DataFrame:
    now = F.col("now")
    a, b = D.ago(now, 7), D.ago(now, 37)
    return t.ev_clock.select(F.unix_millis(a).alias("observed_ms"), F.unix_millis(b).alias("baseline_ms"), D.window_days(a, now).alias("observed_days"), D.window_days(b, a).alias("baseline_days"))


@query("SELECT strftime(unnest(generate_series(CAST(now - INTERVAL 37 DAY AS DATE), CAST(now AS DATE), INTERVAL 1 DAY)), '%Y-%m-%d') AS slot FROM ev_clock")
def dat_03_day_axis(t) -> DataFrame:
    return t.ev_clock.select(F.explode(D.day_axis(D.ago(F.col("now"), 37), F.col("now"))).alias("slot"))


@query("SELECT event_id, CAST(least(30, greatest(1, floor(value / 10 + 0.5))) AS BIGINT) AS days FROM ev")
def dat_05_clamp_window(t) -> DataFrame:
    return t.ev.select("event_id", D.clamp_window(F.col("value") / 10).cast("long").alias("days"))


ZONES = ("Europe/London", "America/New_York", "Pacific/Auckland", "Asia/Kolkata", "UTC")


def settings(t) -> DataFrame:
    zone = F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.col("user_id") % 5 + 1).cast("int"))
    weekday = F.element_at(F.array(*[F.lit(w) for w in D.WEEKDAYS]), (F.col("user_id") % 7 + 1).cast("int"))
    cadence = F.when(F.col("user_id") % 4 == 0, "weekly").when(F.col("user_id") % 4 == 3, "never").otherwise("daily")
    return t.ev.groupBy("user_id").agg(F.min("ts").alias("recorded"), F.max("ts").alias("now")).select("user_id", "recorded", "now", (F.col("user_id") % 24).cast("int").alias("hour"), (F.col("user_id") * 7 % 60).cast("int").alias("minute"), zone.alias("zone"), cadence.alias("cadence"), weekday.alias("weekday"))


_ARGS = ("hour", "minute", "zone")


@query("SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M') AS wall FROM ev")
def dat_06_local_parts(t) -> DataFrame:
    return t.ev.select("event_id", F.date_format(D.local(F.col("ts"), F.lit("Asia/Kolkata")), "yyyy-MM-dd HH:mm").alias("wall"))


@query("SELECT user_id, CAST(epoch_ms(date_trunc('day', min(ts)) + to_hours(CAST(user_id % 24 AS INTEGER)) - INTERVAL 330 MINUTE) AS BIGINT) AS instant_ms FROM ev GROUP BY user_id")
def dat_07_local_to_utc(t) -> DataFrame:
    s = settings(t)
    return s.select("user_id", F.unix_millis(D.to_instant(F.to_date("recorded"), F.col("hour"), F.lit(0), F.lit("Asia/Kolkata"))).alias("instant_ms"))


@query()
def dat_08_first_brief_at(t) -> DataFrame:
    return settings(t).select("user_id", F.unix_millis(D.first_brief_at(F.col("now"), *map(F.col, _ARGS))).alias("first_ms"))


@query("SELECT user_id, CAST(epoch_ms(CASE WHEN s <= now THEN s ELSE s - INTERVAL 1 DAY END) AS BIGINT) AS slot_ms FROM (SELECT user_id, min(ts) AS recorded, max(ts) AS now, date_trunc('day', max(ts)) + to_hours(CAST(user_id % 24 AS INTEGER)) + to_minutes(CAST(user_id * 7 % 60 AS INTEGER)) AS s FROM ev GROUP BY user_id)")
def dat_09_due_slot(t) -> DataFrame:
    return settings(t).select("user_id", F.unix_millis(D.due_slot(F.col("now"), F.col("recorded"), F.col("hour"), F.col("minute"), F.lit("UTC"))).alias("slot_ms"))


@query()
def dat_10_cadence_slot(t) -> DataFrame:
    s = settings(t)
    args = [F.col(c) for c in ("now", "recorded", *_ARGS, "cadence", "weekday")]
    return s.select("user_id", "cadence", F.unix_millis(D.due_cadence_slot(*args)).alias("slot_ms"), F.unix_millis(D.due_cadence_slot(*args, compat=True)).alias("compat_ms"))


@query("SELECT event_id, CAST(epoch_ms(date_trunc('day', ts) + INTERVAL 86399999 MILLISECOND) AS BIGINT) AS to_ms FROM ev")
def dat_11_iso_day(t) -> DataFrame:
    return t.ev.select("event_id", F.unix_millis(D.iso_day(F.date_format("ts", "yyyy-MM-dd"), "end")).alias("to_ms"))


@query("SELECT CAST(epoch_ms(now - INTERVAL 30 DAY) AS BIGINT) AS since_ms, strftime(now - INTERVAL 2 DAY, '%Y-%m-%d') AS history_from FROM ev_clock")
def dat_12_cutoffs(t) -> DataFrame:
    return t.ev_clock.select(F.unix_millis(D.ago(F.col("now"), 30)).alias("since_ms"), D.day_key(D.ago(F.col("now"), 2)).alias("history_from"))


@query("SELECT k, CAST(least(21600000.0, 60000 * pow(2, least(6, greatest(0, k - 1)))) AS BIGINT) AS delay_ms FROM (SELECT DISTINCT k FROM ev)")
def dat_13_backoff(t) -> DataFrame:
    return t.ev.select("k").distinct().select("k", D.backoff(F.col("k"), 60_000, 21_600_000).alias("delay_ms"))


@query("SELECT topic, least(min(CAST(epoch_ms(ts) AS BIGINT)), (SELECT CAST(epoch_ms(now) AS BIGINT) + 21600000 FROM ev_clock)) AS due_ms FROM ev GROUP BY topic")
def dat_14_next_due(t) -> DataFrame:
    by = t.ev.groupBy("topic").agg(F.min(F.unix_millis("ts")).alias("next"))
    return by.join(F.broadcast(t.ev_clock)).select("topic", F.least("next", F.unix_millis("now") + 21_600_000).alias("due_ms"))


# ---- numbers, arrays, stored forms -----------------------------------------


@query("SELECT user_id, round(CASE WHEN b > 0 THEN least(999.0, (o / 7.0) / (b / 30.0)) WHEN o > 0 THEN 999.0 ELSE 0.0 END, 6) AS lift FROM (SELECT user_id, count(*) FILTER (WHERE topic = 'click') AS o, count(*) FILTER (WHERE topic = 'view') AS b FROM ev GROUP BY 1)")
def mat_01_lift(t) -> DataFrame:
    by = t.ev.groupBy("user_id").agg(F.count_if(F.col("topic") == "click").alias("o"), F.count_if(F.col("topic") == "view").alias("b"))
    return by.select("user_id", F.round(N.lift(F.col("o"), 7, F.col("b"), 30), 6).alias("lift"))


@query("SELECT k, round(ln(1 + 10000.0 / count(*)), 6) AS idf FROM ev GROUP BY k")
def mat_02_idf(t) -> DataFrame:
    return t.ev.groupBy("k").agg(F.round(F.log(1 + 10000.0 / F.count("*")), 6).alias("idf"))


@query(
    "SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * b.embedding[i])) / sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * x)) * list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def mat_03_cosine(t) -> DataFrame:
    from ..functions.similarity import cosine

    e = t.read("embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select(F.col("vec_id").alias("left_id"), (F.col("vec_id") + 1).alias("right_id"), F.round(cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


@query("SELECT k, CASE WHEN x <= 1 THEN 1.0 WHEN x <= 2 THEN 2.0 WHEN x <= 5 THEN 5.0 ELSE 10.0 END * m AS step FROM (SELECT k, v, pow(10, floor(log10(v))) AS m, v / pow(10, floor(log10(v))) AS x FROM (SELECT k, round(max(value), 2) / 4 AS v FROM ev GROUP BY k))")
def mat_04_nice_step(t) -> DataFrame:
    return t.ev.groupBy("k").agg((F.round(F.max("value"), 2) / 4).alias("v")).select("k", N.nice_step(F.col("v")).alias("step"))


@query("SELECT topic, printf('%.1f%%', 100.0 * count(*) FILTER (WHERE value > 20) / count(*)) AS share FROM ev GROUP BY topic")
def mat_05_percentage(t) -> DataFrame:
    return t.ev.groupBy("topic").agg(F.format_string("%.1f%%", 100.0 * F.count_if(F.col("value") > 20) / F.count("*")).alias("share"))


@query("SELECT user_id, string_agg(DISTINCT CAST(k AS VARCHAR), ',' ORDER BY CAST(k AS VARCHAR)) AS ids FROM ev GROUP BY 1")
def arr_01_02_distinct_sorted(t) -> DataFrame:
    comma = t.ev.groupBy("user_id").agg(F.array_join(F.collect_list(F.col("k").cast("string")), ",").alias("raw"))
    return comma.select("user_id", F.array_join(F.array_sort(F.array_distinct(F.filter(F.split("raw", ","), lambda x: x != ""))), ",").alias("ids"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
#: Words of each sentence without stopwords; a sentence ends after a full stop, exclamation or question mark before space, or at a line feed.
_SENTENCES = rf"sents AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))) AS s FROM texts), toks AS (SELECT doc_id, list_filter(regexp_extract_all(lower(s), '[a-z][a-z''-]*'), lambda w: w NOT IN ({_STOP})) AS w FROM sents), runs AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS phrase FROM toks)"


@query("SELECT phrase, count(DISTINCT doc_id) AS documents FROM runs GROUP BY 1", _SENTENCES)
def arr_03_phrases(t) -> DataFrame:
    return P.documents(t.texts, T.sentence_tokens(F.col("text")))


@query("SELECT CAST(vec_id AS BIGINT) AS vec_id, 64 AS width, round(CAST(embedding[1] AS DOUBLE), 5) AS first_value FROM embeddings")
def arr_04_vector_codec(t) -> DataFrame:
    back = t.read("embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), N.decode_vector(N.encode_vector("embedding")).alias("v"))
    return back.select("vec_id", F.size("v").alias("width"), F.round(F.col("v")[0].cast("double"), 5).alias("first_value"))


@query("SELECT user_id, k, min(event_id) AS event_id FROM ev GROUP BY 1, 2")
def arr_05_first_by_index(t) -> DataFrame:
    return t.ev.groupBy("user_id", "k").agg(F.min("event_id").alias("event_id"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 2 END AS words FROM documents")
def jsn_01_signature(t) -> DataFrame:
    stored = F.when(F.col("doc_id") % 7 == 0, F.lit("{not json")).otherwise(F.lit('{"words": ["b ", "A", "a"], "phrases": ["x  y"]}'))
    return t.read("documents").select("doc_id", F.size(N.signature_from_json(stored)["words"]).alias("words"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN k ELSE NULL END AS n FROM ev")
def jsn_02_series(t) -> DataFrame:
    stored = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('[{"date":"2024-01-01","articles":'), F.col("k").cast("string"), F.lit("}]"))).otherwise("oops")
    series = F.coalesce(F.from_json(stored, "array<struct<date:string,articles:bigint>>"), F.array().cast("array<struct<date:string,articles:bigint>>"))
    return t.ev.select("event_id", F.try_element_at(series, F.lit(1))["articles"].alias("n"))


@query("SELECT user_id, count(DISTINCT topic) AS kept FROM ev GROUP BY 1")
def jsn_03_kept_ids(t) -> DataFrame:
    stored = t.ev.groupBy("user_id").agg(F.to_json(F.collect_set("topic")).alias("ids"))
    return stored.select("user_id", F.size(N.ids_from_json(F.col("ids"))).cast("long").alias("kept"))
