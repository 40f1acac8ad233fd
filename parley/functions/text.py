"""Text features as Column expressions (JVM side, no Python rows)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters exports inject, which break matching.
INVISIBLE = "\u200e\u200f\u2066\u2067\u2068\u2069\ufeff"
WIDE_SPACES = "\u202f\u00a0"

# White space of all scripts, as characters and as the inside of a class.
# An explicit class is much faster in Java than the Unicode flavour of \\s.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE_CLASS = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{SPACE_CLASS}]"
ASCII_WS = r"[\x09-\x0d\x1c-\x20]"
UNTIDY = f"{WS}{{2}}|[{SPACE_CLASS}&&[^ ]]"

# Openers that make a text a question.
QUESTION_OPENERS = [
    "who", "what", "when", "where", "why", "how", "which",
    "can", "could", "should", "would", "is", "are", "do", "does",
    "did", "will", "any", "anyone",
]

# What counts as an emoji and as a link.
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2764}\x{2B50}\x{2B55}\x{1F000}-\x{1F0FF}\p{So}]"
URL = f"(?:https?://|www\\.)[^{SPACE_CLASS}]"

# Vocabularies of the scored moments.
LAUGH = [
    "😂", "🤣", "😹", "😆", "😅", "🥲", "lmao", "lmfao", "rofl",
    "haha", "hahaha", "hehe", "hehehe", "lol", "lel", "xd",
    "hasi", "mazak", "😭",
]
ARGUMENT = [
    "wtf", "seriously", "shut up", "stop it", "enough", "whatever",
    "bakwas", "bakwaas", "pagal", "chup", "galat", "jhagda", "ladai",
    "gussa", "bezzati", "tameez", "attitude", "blame", "fault",
    "बकवास", "पागल", "गलत", "झगड़ा", "गुस्सा",
]
APOLOGY = [
    "sorry", "sry", "maaf", "galti", "my bad", "apologies", "मुझे माफ",
    "माफ", "गलती", "chill", "shant", "shaant", "peace", "sorted",
]
DEEP = [
    "life", "future", "career", "scared", "afraid", "honestly", "truth",
    "feel", "feeling", "lonely", "depress", "anxiety", "family", "parents",
    "love", "trust", "regret", "dream", "believe", "think about",
    "zindagi", "sach", "dar", "akela", "tension", "soch", "pyaar",
    "जिंदगी", "सच", "डर", "अकेला", "सोच",
]
PLAN = [
    "plan", "meet", "tomorrow", "tonight", "book", "ticket", "trip",
    "party", "kal", "aaj", "chalo", "chalte", "milte", "jaana", "jayenge",
    "reach", "leaving", "time kya", "kitne baje",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_ascii(c) -> Column:
    """As many bytes as characters: a native test that spares most texts the Unicode classes."""
    return F.octet_length(_col(c)) == F.length(_col(c))


def strip(c) -> Column:
    return F.btrim(_col(c), F.lit(SPACES))


def collapse_spaces(c) -> Column:
    # Most chat texts are tidy already; a test is cheaper than a replacement.
    t = _col(c)
    tidy = (
        F.when(~t.rlike(UNTIDY), t).when(is_ascii(t), F.regexp_replace(t, f"{ASCII_WS}+", " "))
        .otherwise(F.regexp_replace(t, f"{WS}+", " "))
    )
    return F.btrim(tidy)


def clean_line(c) -> Column:
    """Drop invisible marks, make odd spaces plain, cut trailing line ends."""
    t = _col(c)
    plain = F.when(is_ascii(t), t).otherwise(F.translate(t, WIDE_SPACES + INVISIBLE, "  "))
    return F.when(t.endswith("\n") | t.endswith("\r"), F.rtrim(plain, F.lit("\r\n"))).otherwise(plain)


def char_count(c) -> Column:
    return F.length(_col(c))


def word_count(c) -> Column:
    t = strip(c)
    words = F.when(is_ascii(t), F.size(F.split(t, f"{ASCII_WS}+"))).otherwise(F.size(F.split(t, f"{WS}+")))
    return F.when(t == "", 0).otherwise(words)


def emoji_count(c) -> Column:
    return F.when(is_ascii(c), 0).otherwise(F.regexp_count(_col(c), F.lit(EMOJI)))


def has_url(c) -> Column:
    t = _col(c)
    return (t.contains("http") | t.contains("www.")) & t.rlike(URL)


def is_question(c) -> Column:
    bare = strip(c)
    opener = F.lower(F.substring_index(bare, " ", 1))
    return bare.contains("?") | opener.isin(QUESTION_OPENERS)


def contains_any(c, words: list[str]) -> Column:
    """True when the lower-cased text holds any of the words, anywhere.

    Plain searches beat one long alternation by far. The one-element array lowers the text once.
    """
    def any_of(text):
        test = F.lit(False)
        for w in words:
            test = test | text.contains(w.lower())
        return test

    return F.exists(F.array(F.lower(_col(c))), any_of)


def text_fingerprint(c) -> Column:
    return F.substring(F.sha1(F.lower(collapse_spaces(F.coalesce(_col(c), F.lit("")))).cast("binary")), 1, 16)


def body_hash(c) -> Column:
    return F.sha2(_col(c).cast("binary"), 256)


def tokens(c) -> Column:
    """Lower-cased runs of letters, marks and digits of any script."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1)


def display_date(c) -> Column:
    """Like ``Monday, 09 February 2026``."""
    return F.date_format(_col(c), "EEEE, dd MMMM yyyy")
