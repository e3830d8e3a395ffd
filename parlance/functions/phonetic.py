"""Double Metaphone (Lawrence Philips' published rules) of phrases, for distinct phrases in Arrow batches.

The rules are stated as tests on the letters around a position. Codes are of full length; the second is empty where it
would equal the first.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = "AEIOUY"


def _plain(text: str) -> str:
    """Upper case without accents but those of Ç and Ñ."""
    if text.isascii():
        return text.upper()
    plain = "".join(c for c in unicodedata.normalize("NFD", text.upper().replace("Ç", "\1").replace("Ñ", "\2")) if unicodedata.category(c) != "Mn")
    return plain.replace("\1", "Ç").replace("\2", "Ñ")


class _Word:
    def __init__(self, text: str):
        self.s = _plain(text)
        self.n = len(self.s)
        self.slavo = bool(re.search("W|K|CZ|WITZ", self.s))

    def at(self, start: int, *options: str) -> bool:
        """Whether one of the options stands at `start`; nothing stands in front of the word."""
        return start >= 0 and any(self.s.startswith(o, start) for o in options)

    def char(self, i: int) -> str:
        return self.s[i] if 0 <= i < self.n else ""

    def vowel(self, i: int) -> bool:
        return self.char(i) != "" and self.char(i) in VOWELS

    def begins(self, *options: str) -> bool:
        return self.s.startswith(options)

    def ends_at(self, i: int) -> bool:
        return i == self.n - 1


def _c(w: _Word, i: int) -> tuple[str, str, int]:
    if i > 1 and not w.vowel(i - 2) and w.at(i - 1, "ACH") and w.char(i + 2) != "I" and (w.char(i + 2) != "E" or w.at(i - 2, "BACHER", "MACHER")):
        return "K", "K", 2
    if i == 0 and w.at(0, "CAESAR"):
        return "S", "S", 2
    if w.at(i, "CHIA"):
        return "K", "K", 2
    if w.at(i, "CH"):
        if i > 0 and w.at(i, "CHAE"):
            return "K", "X", 2
        if i == 0 and w.at(1, "HARAC", "HARIS", "HOR", "HYM", "HIA", "HEM") and not w.at(0, "CHORE"):
            return "K", "K", 2
        germanic = w.begins("VAN ", "VON ", "SCH")
        if germanic or w.at(i - 2, "ORCHES", "ARCHIT", "ORCHID") or w.at(i + 2, "T", "S") or ((i == 0 or w.at(i - 1, "A", "O", "U", "E")) and (i + 2 >= w.n or w.at(i + 2, "L", "R", "N", "M", "B", "H", "F", "V", "W", " "))):
            return "K", "K", 2
        if i > 0:
            return ("K", "K", 2) if w.begins("MC") else ("X", "K", 2)
        return "X", "X", 2
    if w.at(i, "CZ") and not w.at(i - 2, "WICZ"):
        return "S", "X", 2
    if w.at(i + 1, "CIA"):
        return "X", "X", 3
    if w.at(i, "CC") and not (i == 1 and w.char(0) == "M"):
        if w.at(i + 2, "I", "E", "H") and not w.at(i + 2, "HU"):
            return ("KS", "KS", 3) if (i == 1 and w.char(0) == "A") or w.at(i - 1, "UCCEE", "UCCES") else ("X", "X", 3)
        return "K", "K", 2
    if w.at(i, "CK", "CG", "CQ"):
        return "K", "K", 2
    if w.at(i, "CI", "CE", "CY"):
        return ("S", "X", 2) if w.at(i, "CIO", "CIE", "CIA") else ("S", "S", 2)
    if w.at(i + 1, " C", " Q", " G"):
        return "K", "K", 3
    if w.at(i + 1, "C", "K", "Q") and not w.at(i + 1, "CE", "CI"):
        return "K", "K", 2
    return "K", "K", 1


def _g(w: _Word, i: int) -> tuple[str, str, int]:
    if w.char(i + 1) == "H":
        if i > 0 and not w.vowel(i - 1):
            return "K", "K", 2
        if i == 0:
            return ("J", "J", 2) if w.char(2) == "I" else ("K", "K", 2)
        if (i > 1 and w.at(i - 2, "B", "H", "D")) or (i > 2 and w.at(i - 3, "B", "H", "D")) or (i > 3 and w.at(i - 4, "B", "H")):
            return "", "", 2
        if i > 2 and w.char(i - 1) == "U" and w.at(i - 3, "C", "G", "L", "R", "T"):
            return "F", "F", 2
        return ("K", "K", 2) if w.char(i - 1) != "I" else ("", "", 2)
    if w.char(i + 1) == "N":
        if i == 1 and w.vowel(0) and not w.slavo:
            return "KN", "N", 2
        if not w.at(i + 2, "EY") and w.char(i + 1) != "Y" and not w.slavo:
            return "N", "KN", 2
        return "KN", "KN", 2
    if w.at(i + 1, "LI") and not w.slavo:
        return "KL", "L", 2
    if i == 0 and (w.char(1) == "Y" or w.at(1, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
        return "K", "J", 2
    if (w.at(i + 1, "ER") or w.char(i + 1) == "Y") and not w.begins("DANGER", "RANGER", "MANGER") and not w.at(i - 1, "E", "I") and not w.at(i - 1, "RGY", "OGY"):
        return "K", "J", 2
    if w.at(i + 1, "E", "I", "Y") or w.at(i - 1, "AGGI", "OGGI"):
        if w.begins("VAN ", "VON ", "SCH") or w.at(i + 1, "ET"):
            return "K", "K", 2
        return ("J", "J", 2) if w.at(i + 1, "IER") and i + 4 >= w.n else ("J", "K", 2)
    return "K", "K", 2 if w.char(i + 1) == "G" else 1


def _j(w: _Word, i: int) -> tuple[str, str, int]:
    step = 2 if w.char(i + 1) == "J" else 1
    if w.at(i, "JOSE") or w.begins("SAN "):
        return ("H", "H", step) if (i == 0 and w.char(4) in ("", " ")) or w.begins("SAN ") else ("J", "H", step)
    if i == 0:
        return "J", "A", step
    if w.vowel(i - 1) and not w.slavo and w.char(i + 1) in ("A", "O"):
        return "J", "H", step
    if w.ends_at(i):
        return "J", "", step
    if not w.at(i + 1, "L", "T", "K", "S", "N", "M", "B", "Z") and not w.at(i - 1, "S", "K", "L"):
        return "J", "J", step
    return "", "", step


def _s(w: _Word, i: int) -> tuple[str, str, int]:
    if w.at(i - 1, "ISL", "YSL"):
        return "", "", 1
    if i == 0 and w.at(0, "SUGAR"):
        return "X", "S", 1
    if w.at(i, "SH"):
        return ("S", "S", 2) if w.at(i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else ("X", "X", 2)
    if w.at(i, "SIO", "SIA"):
        return ("S", "X", 3) if not w.slavo else ("S", "S", 3)
    if (i == 0 and w.at(1, "M", "N", "L", "W")) or w.char(i + 1) == "Z":
        return "S", "X", 2 if w.char(i + 1) == "Z" else 1
    if w.at(i, "SC"):
        if w.char(i + 2) == "H":
            if w.at(i + 3, "OO", "ER", "EN", "UY", "ED", "EM"):
                return ("X", "SK", 3) if w.at(i + 3, "ER", "EN") else ("SK", "SK", 3)
            return ("X", "S", 3) if i == 0 and not w.vowel(3) and w.char(3) != "W" else ("X", "X", 3)
        return ("S", "S", 3) if w.at(i + 2, "I", "E", "Y") else ("SK", "SK", 3)
    step = 2 if w.char(i + 1) in ("S", "Z") and w.char(i + 1) else 1
    return ("", "S", step) if w.ends_at(i) and w.at(i - 2, "AI", "OI") else ("S", "S", step)


def _t(w: _Word, i: int) -> tuple[str, str, int]:
    if w.at(i, "TION", "TIA", "TCH"):
        return "X", "X", 3
    if w.at(i, "TH", "TTH"):
        return ("T", "T", 2) if w.at(i + 2, "OM", "AM") or w.begins("VAN ", "VON ", "SCH") else ("0", "T", 2)
    return "T", "T", 2 if w.at(i + 1, "T", "D") else 1


def _w(w: _Word, i: int) -> tuple[str, str, int]:
    if w.at(i, "WR"):
        return "R", "R", 2
    first, second = "", ""
    if i == 0 and (w.vowel(1) or w.at(0, "WH")):
        first, second = ("A", "F") if w.vowel(1) else ("A", "A")
    if (w.ends_at(i) and w.vowel(i - 1)) or w.at(i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or w.begins("SCH"):
        return first, second + "F", 1
    if w.at(i, "WICZ", "WITZ"):
        return first + "TS", second + "FX", 4
    return first, second, 1


def _step(w: _Word, i: int) -> tuple[str, str, int]:
    """What the letter at i adds to both codes, and how many letters it takes."""
    c, after = w.char(i), w.char(i + 1)
    twice = 2 if after == c else 1
    if c in VOWELS:
        return ("A", "A", 1) if i == 0 else ("", "", 1)
    if c == "B":
        return "P", "P", twice
    if c == "C":
        return _c(w, i)
    if c == "Ç":
        return "S", "S", 1
    if c == "D":
        if w.at(i, "DG"):
            return ("J", "J", 3) if w.at(i + 2, "I", "E", "Y") else ("TK", "TK", 2)
        return "T", "T", 2 if w.at(i, "DT", "DD") else 1
    if c == "G":
        return _g(w, i)
    if c == "H":
        return ("H", "H", 2) if (i == 0 or w.vowel(i - 1)) and w.vowel(i + 1) else ("", "", 1)
    if c == "J":
        return _j(w, i)
    if c == "L":
        if after == "L":
            spanish = (i == w.n - 3 and w.at(i - 1, "ILLO", "ILLA", "ALLE")) or ((w.s.endswith(("AS", "OS")) or w.s.endswith(("A", "O"))) and w.at(i - 1, "ALLE"))
            return ("L", "", 2) if spanish else ("L", "L", 2)
        return "L", "L", 1
    if c == "M":
        return "M", "M", 2 if (w.at(i - 1, "UMB") and (i + 1 == w.n - 1 or w.at(i + 2, "ER"))) or after == "M" else 1
    if c == "P":
        return ("F", "F", 2) if after == "H" else ("P", "P", 2 if after in ("P", "B") and after else 1)
    if c == "R":
        silent = w.ends_at(i) and not w.slavo and w.at(i - 2, "IE") and not w.at(i - 4, "ME", "MA")
        return ("", "R", twice) if silent else ("R", "R", twice)
    if c == "S":
        return _s(w, i)
    if c == "T":
        return _t(w, i)
    if c == "W":
        return _w(w, i)
    if c == "X":
        if i == 0:
            return "S", "S", 1
        french = w.ends_at(i) and (w.at(i - 3, "IAU", "EAU") or w.at(i - 2, "AU", "OU"))
        return ("", "", 1) if french else ("KS", "KS", 2 if after in ("C", "X") and after else 1)
    if c == "Z":
        if after == "H":
            return "J", "J", 2
        foreign = w.at(i + 1, "ZO", "ZI", "ZA") or (w.slavo and i > 0 and w.char(i - 1) != "T")
        return ("S", "TS", twice) if foreign else ("S", "S", twice)
    simple = {"F": "F", "K": "K", "N": "N", "Ñ": "N", "Q": "K", "V": "F"}.get(c)
    return (simple, simple, twice if c != "Ñ" else 1) if simple else ("", "", 1)


def double_metaphone(text: str | None) -> tuple[str, str]:
    """Primary and secondary code of a word."""
    if not text:
        return "", ""
    w = _Word(text)
    i = 1 if w.begins("GN", "KN", "PN", "WR", "PS") else 0
    first = second = ""
    while i < w.n:
        a, b, step = _step(w, i)
        first, second, i = first + a, second + b, i + step
    return first, "" if second == first else second


def _bare(text: str | None) -> str:
    return re.sub(r"[\W]+", "", (text or "").lower())


def phrase_codes(text: str | None) -> list[str]:
    """Non-empty codes of a phrase, as one word without blanks and marks."""
    return [c for c in double_metaphone(_bare(text)) if c]


#: No rule looks more than 7 letters ahead, so the first 12 letters of a longer phrase settle the steps at its first 5.
_HEAD, _AHEAD = 12, 7


class Wanted:
    """The phrases whose codes are among the wanted ones: coding ends where neither code begins one of them."""

    def __init__(self, codes: list[str]):
        self.codes = frozenset(codes)
        self.starts = frozenset(c[:i] for c in codes for i in range(len(c) + 1))
        self.plain = lru_cache(1 << 17)(lambda word: _plain(_bare(word)))
        self.codes_of = lru_cache(1 << 16)(self._codes_of)
        self.never = lru_cache(1 << 17)(lambda head: self._never(head, False) and self._never(head, True))

    def _codes_of(self, plain: str) -> list[str]:
        """All codes of the phrase if one is wanted, else none."""
        w = _Word(plain)
        i = 1 if w.begins("GN", "KN", "PN", "WR", "PS") else 0
        first = second = ""
        while i < w.n:
            a, b, step = _step(w, i)
            first, second, i = first + a, second + b, i + step
            if first not in self.starts and second not in self.starts:
                return []
        codes = [c for c in (first, "" if second == first else second) if c]
        return codes if not self.codes.isdisjoint(codes) else []

    def _never(self, head: str, slavo: bool) -> bool:
        """Whether no phrase that begins with the head's letters has a wanted code. False where the phrase's end decides."""
        w = _Word(head)
        w.slavo = slavo
        i = 1 if w.begins("GN", "KN", "PN", "WR", "PS") else 0
        first = second = ""
        while i + _AHEAD < _HEAD:
            if w.at(i, "LL") and w.at(i - 1, "ALLE"):
                return False
            a, b, step = _step(w, i)
            first, second, i = first + a, second + b, i + step
            if first not in self.starts and second not in self.starts:
                return True
        return False

    def spans(self, words: list, unsure: list, ends: list, longest: int) -> list[dict]:
        """(n, i, codes) of the phrases of 1 to `longest` words with an unsure word, none across a sentence's end, that have a
        wanted code. What is null in `ends` is taken for an end, in `unsure` for a sure word."""
        plain, found = [self.plain(x) for x in words], []
        for i in range(len(words)):
            text, doubt = "", False
            for k in range(i, min(i + longest, len(words))):
                if k > i and ends[k - 1] is not False:
                    break
                text, doubt = text + plain[k], doubt or unsure[k] is True
                if len(text) >= _HEAD and self.never(text[:_HEAD]):
                    break
                if doubt and (codes := self.codes_of(text)):
                    found.append({"n": k - i + 1, "i": i, "codes": codes})
        return found


@lru_cache(4)
def _wanted(codes: str) -> Wanted:
    return Wanted(codes.split())


def sounding_spans(words: Column, unsure: Column, ends: Column, codes: Column, longest: int) -> Column:
    """`Wanted.spans` of each list of words, by itself; `codes` are the wanted ones, parted by blanks, the same in all rows."""

    @F.arrow_udf("array<struct<n:int,i:int,codes:array<string>>>")
    def spans(words: pa.Array, unsure: pa.Array, ends: pa.Array, codes: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(words), 256):
            lists = (x.slice(at, 256).to_pylist() for x in (words, unsure, ends))
            out += [_wanted(codes[at].as_py()).spans(*x, longest) for x in zip(*lists, strict=True)]
        return pa.array(out, pa.list_(pa.struct([("n", pa.int32()), ("i", pa.int32()), ("codes", pa.list_(pa.string()))])))

    return spans(words, unsure, ends, codes)


@F.pandas_udf(T.ArrayType(T.StringType()))
def phonetic_codes(text: pd.Series) -> pd.Series:
    """Codes of each phrase; use it on distinct phrases."""
    return text.map(phrase_codes)


def with_codes(rows: DataFrame, *columns: str) -> DataFrame:
    """Adds `<column>_codes`: each distinct phrase of the columns is coded once and joined back by the phrase."""
    for column in columns:
        phrases = rows.select(F.col(column).alias("pc__text")).where(F.col("pc__text").isNotNull()).distinct()
        codes = phrases.withColumn("pc__codes", phonetic_codes("pc__text"))
        rows = rows.join(codes, rows[column] == F.col("pc__text"), "left").drop("pc__text").withColumnRenamed("pc__codes", f"{column}_codes")
    return rows


def sounds_alike(a_codes: Column, b_codes: Column) -> Column:
    return F.arrays_overlap(F.coalesce(a_codes, F.array().cast("array<string>")), F.coalesce(b_codes, F.array().cast("array<string>")))
