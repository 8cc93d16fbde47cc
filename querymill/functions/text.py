"""Text expressions. All are built-in expressions; strings are counted in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: search operators, counted case-sensitively; the last two with their blanks
OPERATORS = ["site:", "filetype:", "intitle:", "allinurl:", "allintitle:", "intext:", "allintext:", "related:", "define:", "cache:", "around(", " OR ", " AND "]
REPLACEMENT = "�"
# fixed values: patterns of addresses
EMAIL = r"[\p{L}\p{N}_-]+@[\p{L}\p{N}_-]+\.[a-z.]+"
URL = r"(https?://)?[\p{L}\p{N}_-]+\.[a-z.]+"
URLISH = r"http|www\.|\.com|\.net|\.org|\.int|\.edu"
TOKEN = r"'(?:s|ll|re|ve|d|m|t)|[\p{L}\p{N}]+|[^\p{Z}\p{C}\p{L}\p{M}\p{N}\p{P}]"
PROPER = r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*"


def char_count(text: Column) -> Column:
    return F.length(text).cast("long")


def whitespace_word_count(text: Column) -> Column:
    """Number of runs between blanks of any kind, also those outside ASCII."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")).cast("long")


def tokens(text: Column) -> Column:
    """Words, clitics and symbols, without punctuation."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def characters(text: Column) -> Column:
    """Code points without U+0020."""
    return F.filter(F.split(F.replace(text, F.lit(" "), F.lit("")), ""), lambda c: c != "")


def operators_present(text: Column) -> Column:
    return F.filter(F.array(*[F.lit(o) for o in OPERATORS]), lambda o: F.contains(text, o))


def operator_count(text: Column) -> Column:
    """Occurrences of all operators; one inside another (allintitle: holds intitle:) counts for both."""
    total = F.lit(0)
    for o in OPERATORS:
        total = total + (F.length(text) - F.length(F.replace(text, F.lit(o), F.lit("")))) / F.lit(len(o))
    return total.cast("long")


def has_replacement(text: Column) -> Column:
    return F.contains(text, F.lit(REPLACEMENT))


def has_email(text: Column) -> Column:
    return text.rlike(EMAIL)


def has_url(text: Column) -> Column:
    return text.rlike(URL)


def entities(text: Column) -> Column:
    """(entity, label) by rule, not by a model: runs of capitalised words, and years."""
    names = F.transform(F.regexp_extract_all(text, F.lit(PROPER), F.lit(0)), lambda x: F.struct(x.alias("entity"), F.lit("PROPER-Capitalised words").alias("entity_label")))
    years = F.transform(F.filter(tokens(text), lambda x: x.rlike("^(19|20)[0-9]{2}$")), lambda x: F.struct(x.alias("entity"), F.lit("DATE-Years").alias("entity_label")))
    return F.concat(names, years)


# fixed values: recognisers of the rule backend for personal data, with their scores
RECOGNISERS = [
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 1.0),
    ("IP_ADDRESS", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0.95),
    ("PHONE_NUMBER", r"[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}", 0.75),
    ("US_SSN", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.85),
    ("URL", r"[a-z0-9-]+\.(?:com|org|net|example|test|invalid)", 0.6),
]


def pii_hits(text: Column, least: float = 0.0) -> Column:
    """(entity, entity_label) of every place that a recogniser with at least the given score matches."""
    hits = lambda n, p: F.transform(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)), lambda x: F.struct(x.alias("entity"), F.lit(n).alias("entity_label")))
    return F.concat(*[hits(n, p) for n, p, s in RECOGNISERS if s >= least])


def pii_labels(text: Column, least: float = 0.7) -> Column:
    """Labels of all hits of the recognisers with at least the given score, one for each hit."""
    return F.transform(pii_hits(text, least), lambda h: h["entity_label"])


# fixed values: words of the rule backend for intent
TRANSACTIONAL = r"(^|[^\p{L}])(buy|price|cheap|coupon|order|sale|shop|download|free|kaufen|billig|kopen|goedkoop|prezzo)($|[^\p{L}])"
NAVIGATIONAL = r"(^|[^\p{L}])(login|www|homepage|website)($|[^\p{L}])"


def intent(text: Column) -> Column:
    """Navigational, Transactional or Informational by word lists; a stand-in for a trained classifier."""
    low = F.lower(text)
    return F.when(has_url(low) | low.rlike(NAVIGATIONAL), "Navigational").when(low.rlike(TRANSACTIONAL), "Transactional").otherwise("Informational")


def embedding(text: Column, dim: int = 64) -> Column:
    """Hashed bag of tokens and of their first four letters; a stand-in for a sentence encoder."""
    low = tokens(F.lower(text))
    parts = F.concat(low, F.transform(low, lambda t: F.concat(F.lit("^"), F.substring(t, 1, 4))))
    spots = F.transform(parts, lambda t: F.xxhash64(t))
    sign = lambda h: F.when(h.bitwiseAND(F.lit(1 << 40)) == 0, 1.0).otherwise(-1.0)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(spots, lambda h: F.pmod(h, F.lit(dim)) == i), F.lit(0.0), lambda a, h: a + sign(h)).cast("float"))
