"""Text functions over columns, all in the JVM.

Word characters are letters and digits of any script, and the underscore, so `[^\\p{L}\\p{N}_]+` stands for runs of marks and
white space together: replacing them by one blank and trimming is the whole normalisation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import constants as C

WORD_CHARS = r"\p{L}\p{N}_"
NON_WORD = rf"[^{WORD_CHARS}]+"
SPACE_ENDS = r"^\s+|\s+$"


def _words(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def normalize(text: Column) -> Column:
    """Lower case, marks as blanks, single blanks. Null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), NON_WORD, " "))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, SPACE_ENDS, "")


def tokens(text: Column) -> Column:
    """Words of the normalised text; null and empty text have none."""
    return F.filter(F.split(F.coalesce(normalize(text), F.lit("")), " "), lambda t: t != "")


def white_tokens(text: Column) -> Column:
    """Runs of characters that are no white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def content(text: Column) -> Column:
    """Tokens that are no stopwords and longer than two characters, in order, with repeats."""
    return F.filter(tokens(text), lambda t: ~t.isin(*C.STOPWORDS) & (F.char_length(t) > 2))


def stem(token: Column) -> Column:
    """The first suffix that leaves three characters goes."""
    out = F.when(F.lit(False), token)
    for suffix, end in C.SUFFIXES:
        keep = F.char_length(token) - len(suffix)
        out = out.when(token.endswith(suffix) & (keep >= 3), F.concat(F.left(token, keep), F.lit(end)))
    return out.otherwise(token)


def stems(text: Column) -> Column:
    """Distinct stems of the content, in order."""
    return F.array_distinct(F.transform(content(text), stem))


def ordinary_speech(text: Column) -> Column:
    """Whether there are words and all are common ones."""
    words = tokens(text)
    return (F.size(words) > 0) & F.forall(words, lambda t: t.isin(*C.COMMON_WORDS))


def strip_edges(text: Column) -> Column:
    return F.btrim(text, F.lit(C.EDGE_MARKS))


def sentences(text: Column) -> Column:
    """Parts that end with `.`, `?` or `!` before white space."""
    return F.filter(F.split(strip(text), r"(?<=[.?!])\s+"), lambda s: s != "")


def named(text: Column) -> Column:
    """Whether a capitalised word may be a name, as far as word lists tell."""
    return ~F.lower(text).isin(*C.DISCOURSE) & ~F.lower(text).isin(*C.COMMON_WORDS)


def vocative_candidates(sentence: Column) -> Column:
    """A leading "Xxx, y", then a trailing ", Xxx?"; what is absent is an empty string."""
    return F.array(F.regexp_extract(sentence, C.LEADING_NAME, 1), F.regexp_extract(sentence, C.TRAILING_NAME, 1))


def is_request(sentence: Column) -> Column:
    return sentence.rlike(C.REQUEST)


def introductions(sentence: Column) -> Column:
    """Names given by "I'm Xxx" and the like anywhere, or by "This is Xxx" as the whole sentence."""
    anywhere = F.regexp_extract_all(sentence, F.lit(C.INTRODUCTION), F.lit(1))
    whole = F.regexp_extract(sentence, C.INTRODUCTION_ALONE, 1)
    return F.filter(F.concat(anywhere, F.array(whole)), lambda n: n != "")


def opens_reply(sentence: Column) -> Column:
    return sentence.rlike(C.REPLY_OPENER)


def first_person(text: Column) -> Column:
    return text.rlike(C.FIRST_PERSON)


def speaker_label(text: Column) -> Column:
    """The `Speaker N` that a text begins with, else null."""
    return F.nullif(F.regexp_extract(text, C.SPEAKER_LABEL, 1), F.lit(""))


def clean_null(text: Column) -> Column:
    """Trimmed, or null where it says that there is nothing."""
    value = strip(text)
    return F.when(~F.lower(value).isin(*C.NULL_SPELLINGS), value)


def token_estimate(text: Column) -> Column:
    return F.floor(F.size(white_tokens(text)) * C.TOKENS_A_WORD).cast("int") + C.PROMPT_TOKENS


def numeric_content(text: Column) -> Column:
    """Digits, number words and ordinals, in order."""
    return F.filter(tokens(text), lambda t: t.rlike(r"^\d+(st|nd|rd|th)?$") | t.isin(*C.NUMBER_WORDS))


def digit_runs(text: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)))


def negations(text: Column) -> Column:
    """The negations in a text, sorted. Apostrophes go before marks become blanks, so contractions count."""
    return F.array_sort(F.array_distinct(F.filter(tokens(F.regexp_replace(text, "['’]", "")), lambda t: t.isin(*C.NEGATIONS))))


def declines(text: Column) -> Column:
    return text.rlike(C.DECLINES)


def contains_idea(text: Column, phrase: Column, threshold: float = 0.6) -> Column:
    """Whether the share of the phrase's stemmed words of over three letters that the text holds reaches the threshold."""
    want = F.transform(F.filter(tokens(phrase), lambda t: F.char_length(t) > 3), stem)
    have = F.transform(tokens(text), stem)
    found = F.size(F.filter(want, lambda t: F.array_contains(have, t)))
    return F.when(F.size(want) > 0, found / F.size(want) >= threshold).otherwise(F.lit(False))


def stutter(text: Column) -> Column:
    """One word said over and over."""
    return strip(text).rlike(rf"(?i)^([{WORD_CHARS}]+)(\s+\1)+$")


def clock(seconds: Column) -> Column:
    """m:ss, cut to whole seconds; null counts as 0."""
    whole = F.coalesce(seconds, F.lit(0)).cast("long")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def quoted(text: Column) -> Column:
    """In single quotes, or in double ones where it holds single ones only."""
    single = F.contains(text, F.lit("'"))
    double = F.contains(text, F.lit('"'))
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.when(single & ~double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def literal_pattern(text: Column) -> Column:
    """A pattern for the text itself between word bounds of any script."""
    body = F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit(rf"(?<![{WORD_CHARS}])\Q"), body, F.lit(rf"\E(?![{WORD_CHARS}])"))


def literal_replacement(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def json_object(reply: Column, schema: str) -> Column:
    """A model's reply as a struct: without code fence, else from the outermost braces, else null (no error)."""
    raw = strip(reply)
    fenced = F.regexp_replace(F.element_at(F.split(raw, "```"), 2), "(?i)^json", "")
    raw = F.when(raw.startswith("```"), fenced).otherwise(raw)
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    valid = F.try_parse_json(body).isNotNull()
    return F.when((body != "") & valid, F.from_json(body, schema, {"mode": "PERMISSIVE"}))
