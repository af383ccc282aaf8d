"""Word lists that names are read by.

Fixed values: the lists of this module must hold these words for names to be
found, classed and folded as expected.  Open-ended lists (given names, demonyms,
publishers, words that are capitalised without being names) are the user's: they
come as a table, see :meth:`tidewire.functions.entities.Lexicon.from_table`.
"""

CONNECTORS = ("of", "the", "de", "del", "da", "das", "dos", "du", "di", "van", "von", "der", "den", "la", "le")
INNER_WORDS = (*CONNECTORS, "for")
LEGAL_SUFFIXES = (
    "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "llp", "plc", "gmbh",
    "ag", "sa", "nv", "bv", "ab", "asa", "oy", "srl", "se", "holdings", "group",
)
PERSON_CUES = (
    "mr", "mrs", "ms", "miss", "dr", "prof", "professor", "sir", "dame", "lord", "lady", "president", "vice-president",
    "chairman", "chairwoman", "chairperson", "chief", "executive", "ceo", "cfo", "coo", "spokesman", "spokeswoman",
    "spokesperson", "director", "governor", "mayor", "minister", "secretary", "senator", "manager", "coach", "judge",
)
ORG_MARKERS = (
    "agency", "association", "authority", "bank", "board", "club", "commission", "committee", "council", "court",
    "department", "federation", "foundation", "institute", "institution", "ministry", "office", "organisation",
    "organization", "party", "society", "university", "union",
)
ORG_CUES = ("acquisition of", "buyout of", "merger with", "takeover of")
INSTITUTIONS = (
    "central bank", "commercial bank", "emergency service", "finance ministry", "foreign ministry", "health ministry",
    "investment bank", "police force", "prime minister", "research institute",
)
LOCATIVES = ("across", "around", "at", "from", "in", "near", "outside", "to", "toward", "towards")
PLACE_MARKERS = (
    "avenue", "bay", "city", "county", "district", "island", "kingdom", "lake", "mount", "mountain", "ocean",
    "province", "region", "republic", "river", "sea", "state", "street", "valley",
)
PRODUCT_NOUNS = (
    "app", "application", "assistant", "browser", "car", "chip", "console", "database", "device", "earbud", "game",
    "headset", "laptop", "model", "phone", "platform", "product", "robot", "service", "software", "system", "tablet",
    "tool", "toy", "vehicle", "watch",
)
LAUNCH_VERBS = (
    "announced", "announces", "bought", "brought", "buys", "called", "debuted", "debuts", "introduced", "introduces",
    "launch", "launched", "launches", "named", "names", "put", "puts", "relaunched", "released", "releases", "rolled",
    "sell", "sells", "selling", "sold", "unveiled", "unveils",
)
SALE_PHRASES = ("on sale",)
LAUNCH_PHRASES = ("going on sale", "put on sale", "pushed out", "rolled out")
DETERMINERS = ("a", "an", "first", "her", "his", "its", "new", "our", "own", "second", "that", "the", "their", "these", "this")
NOISE_ACRONYMS = ("ai", "am", "api", "ceo", "cfo", "coo", "cto", "eu", "gdp", "id", "iot", "ipo", "it", "pm", "saas", "tv", "uk", "un", "us", "usa")
LEADING_QUALIFIERS = (
    "acquires", "acquired", "acquiring", "banned", "bans", "blocked", "blocks", "boots", "bought", "buys", "exits",
    "fired", "fires", "firing", "hired", "hires", "hiring", "joins", "ousted", "ousts", "poached", "poaches", "quits",
    "sacked", "sacks", "sold", "sells", "suing", "sues", "sued", "unveiled", "unveils",
    "analysis", "briefing", "breaking", "commentary", "editorial", "exclusive", "explainer", "interview", "opinion",
    "update", "updates", "former",
)
FURNITURE = (
    "advertisement", "article", "comments", "comment", "daily briefing", "feed", "hn", "permalink", "points", "rss",
    "sponsored", "submitted", "thread", "url", "urls",
)
HEAD_NOUNS = (
    "academy", "agency", "airport", "association", "avenue", "bank", "board", "briefing", "bridge", "bureau", "campus",
    "centre", "center", "church", "city", "college", "commission", "committee", "company", "corporation", "council",
    "county", "court", "department", "district", "foundation", "federation", "group", "hospital", "institute",
    "institution", "laboratory", "library", "ministry", "museum", "office", "organisation", "organization", "party",
    "place", "prime", "province", "region", "republic", "school", "society", "square", "station", "street", "team",
    "trust", "union", "university",
)

#: Defaults of the open-ended lists; small, and meant to be replaced.
GIVEN_NAMES = ("alice", "anna", "david", "elena", "jane", "john", "karl", "maria", "mary", "michael", "olga", "peter", "sarah")
DEMONYMS = {"american": "america", "british": "britain", "french": "france", "german": "germany", "spanish": "spain"}
NOISE_WORDS = (
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april",
    "may", "june", "july", "august", "september", "october", "november", "december",
)
