"""Text as tokens: folding, phrases, BM25 terms and character trigrams.

A folded text is its tokens joined by single blanks with one blank around it, so
a phrase is a substring ``' a b '``. Counting with a zero-width lookahead keeps
overlapping occurrences and stays one JVM expression over the whole text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_GAP = r"[^\p{L}\p{N}\p{Co}]+"


def _diacritic_table() -> tuple[str, str]:
    """Precomposed Latin, Greek and Cyrillic letters and their base letters."""
    blocks = [(0x00C0, 0x0250), (0x0370, 0x0530), (0x1E00, 0x2000)]
    source, target = [], []
    for start, stop in blocks:
        for code in range(start, stop):
            char = chr(code)
            base = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))
            if len(base) == 1 and base != char:
                source.append(char)
                target.append(base)
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _diacritic_table()


def fold(col: Column) -> Column:
    """Case-folded text without diacritics; plain ASCII text skips the table."""
    low = F.lower(col)
    bare = F.regexp_replace(F.translate(low, ACCENTED, PLAIN), r"\p{M}+", "")
    return F.when(F.length(col) == F.octet_length(col), low).otherwise(bare)


def folded_tokens_text(col: Column) -> Column:
    """``' tok tok tok '``; a text without tokens gives ``' '``."""
    return F.regexp_replace(F.concat(F.lit(" "), fold(col), F.lit(" ")), TOKEN_GAP, " ")


def folded_test(col: Column, test: Callable[[Column], Column]) -> Column:
    """``test`` of the folded text. A filter would fold again for every use of the folded
    column; as the one item of an array it is folded once."""
    return F.exists(F.array(folded_tokens_text(col)), test)


def tokens(col: Column) -> Column:
    return F.filter(F.split(fold(col), TOKEN_GAP), lambda t: t != "")


#: Fixed value: endings that a stem of at least three letters drops.
ENDING = r"^(.{3,}?)(ings|ing|edly|ed|ly|es|s)$"


def light_stem(token: Column) -> Column:
    """The token without its ending."""
    return F.regexp_replace(token, ENDING, "$1")


def light_stem_of(token: str) -> str:
    """The same for a query word."""
    return re.sub(ENDING, r"\1", token)


def token_count(folded: Column) -> Column:
    return F.length(folded) - F.length(F.replace(folded, F.lit(" "), F.lit(""))) - 1


#: A token in a text that is not folded: folding drops marks, which neither begin nor end a token.
TOKEN = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{M}]*+"


def count_tokens(col: Column) -> Column:
    """Number of tokens of a text, without folding it."""
    return F.regexp_count(col, F.lit(TOKEN))


def may_hold(col: Column, terms: list[str]) -> Column:
    """False where an ASCII text surely lacks a term; other texts must be folded to know."""
    low = F.lower(col)
    inside = F.lit(True)
    for term in dict.fromkeys(terms):
        inside = inside & F.contains(low, F.lit(term))
    return F.when(F.length(col) == F.octet_length(col), inside).otherwise(F.lit(True))


def query_tokens(text: str) -> list[str]:
    """The same folding for a query literal."""
    low = unicodedata.normalize("NFD", text.lower())
    low = "".join(c for c in low if not unicodedata.combining(c))
    return [
        t
        for t in re.split(r"[^\w]+|_+", low, flags=re.UNICODE)
        if t
    ]


def phrase_frequency(folded: Column, terms: list[str]) -> Column:
    """Occurrences of the token sequence, overlaps included."""
    if not terms:
        return F.lit(0)
    needle = " " + " ".join(terms) + " "
    found = F.contains(folded, F.lit(needle))
    return F.when(found, F.regexp_count(folded, F.lit(f"(?={needle})"))).otherwise(F.lit(0))


def bm25_weight(freq: Column, length: Column, average: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return freq * (k1 + 1) / (freq + k1 * (1 - b + b * length / average))


def idf(rows: Column, hits: Column) -> Column:
    return F.greatest(F.ln((rows - hits + 0.5) / (hits + 0.5)), F.lit(1e-6))


def trigrams(col: Column) -> Column:
    """Distinct 3-grams of each word padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(
            F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))
        )

    return F.array_distinct(F.flatten(F.transform(F.array_distinct(words), grams)))


def trigram_set(text: str) -> list[str]:
    out: dict[str, None] = {}
    for word in re.findall(r"[^\W_]+", text.lower()):
        padded = f"  {word} "
        for i in range(len(padded) - 2):
            out[padded[i : i + 3]] = None
    return list(out)


def trigram_similarity(col: Column, text: str) -> Column:
    """Shared over united 3-grams; the query side is a literal array."""
    wanted = trigram_set(text)
    own = trigrams(col)
    literal = F.array(*[F.lit(g) for g in wanted])
    shared = F.size(F.array_intersect(own, literal))
    total = F.size(own) + len(wanted) - shared
    return F.when(total > 0, shared / total).otherwise(F.lit(0.0))


def logistic_score(score: Column, k: float = 0.5, threshold: float = 0.0) -> Column:
    value = 1.0 / (1.0 + F.exp(-k * (score - threshold)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
