"""Question rules as expressions: no Python runs for any row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: word lists of the rules
INTERROGATIVES = ["which", "what", "whose", "who", "whom", "where", "when", "how", "why", "whether"]
HELPERS = ["in", "for", "at", "on", "after", "as", "with", "if"]
AUXILIARIES = ["am", "are", "is", "was", "were", "do", "does", "did", "can", "could", "have", "has", "had", "may", "might", "must", "need", "shall", "should", "will", "would"]
# the stand-in for a part-of-speech tagger: frequent verbs
VERBS = ["be", "get", "make", "go", "know", "take", "see", "come", "think", "look", "want", "give", "use", "find", "tell", "ask", "work", "seem", "feel", "try", "leave", "call", "buy", "play", "run", "move", "live", "bring", "happen", "write", "sit", "stand", "lose", "pay", "meet", "build", "built", "cost", "clean", "carry", "replace", "fell", "open", "came", "mean", "means", "lives", "owns", "made", "said"]

_HELPER = "|".join(HELPERS)
#: a helping phrase up to its comma, again and again
PHRASES = rf"^(?:\s*(?:{_HELPER})(?:[^\p{{L}}\p{{N}},][^,]*)?,)+"
ONE_HELPER = rf"^\s*(?:{_HELPER})\s+"
FIRST = r"^\s*([\p{L}']+)"
VERB = r"(?:^|[^\p{L}])(?:" + "|".join(AUXILIARIES + VERBS) + r")(?:n't|'[a-z]+)?(?:$|[^\p{L}'])"
SENTENCE_END = r"[.?!]\s+"


def _first_word(text: Column) -> Column:
    word = F.regexp_extract(text, FIRST, 1)
    return F.regexp_replace(F.regexp_replace(word, "n't$", ""), "'(s|re|ll|ve|d|m)?$", "")


def _rest(sentence: Column) -> Column:
    return F.regexp_replace(F.lower(sentence), PHRASES, "")


def starts_with_interrogative(sentence: Column) -> Column:
    word = _first_word(F.regexp_replace(_rest(sentence), ONE_HELPER, ""))
    return F.regexp_replace(F.regexp_replace(word, "ever$", ""), "so$", "").isin(INTERROGATIVES)


def starts_with_auxiliary(sentence: Column) -> Column:
    return _first_word(_rest(sentence)).isin(AUXILIARIES)


def contains_verb(sentence: Column) -> Column:
    return F.lower(sentence).rlike(VERB)


def _one(sentence: Column) -> Column:
    return contains_verb(sentence) & (starts_with_interrogative(sentence) | (sentence.endswith("?") & starts_with_auxiliary(sentence)))


def _closed(sentence: Column) -> Column:
    return sentence.endswith("?") & contains_verb(sentence) & ~starts_with_interrogative(sentence) & starts_with_auxiliary(sentence)


def _any(text: Column, test) -> Column:
    """Of the whole text or any of its sentences; a sentence keeps its end mark."""
    marked = F.split(F.regexp_replace(text, r"([.?!])\s+", "$1\u0001"), "\u0001")
    return F.exists(F.concat(F.array(text), marked), test)


def is_question(text: Column) -> Column:
    return _any(text, _one)


def is_closed_question(text: Column) -> Column:
    return _any(text, _closed)
