"""Text primitives as Column expressions: folding, tokens, words, stable ids."""

from __future__ import annotations

import string
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that do not make a query informative.
QUERY_STOP_WORDS = (
    "a an and are as at au aux avec be by ce ces dans de des do does du en est et for from how in is it la le les of on or ou par pour "
    "que quel quelle quelles quels qui sur that the their to un une what when where which who why with"
).split()
#: Words that do not make a concept.
CONCEPT_STOP_WORDS = "a an and are as at be by for from in is of on or the to with shall should must".split()


#: What tokens are made of.
TOKEN = string.ascii_lowercase + string.digits


def _folded(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))


def _composed(c: str) -> str:
    return unicodedata.normalize("NFKC", c).casefold()


def _beyond_ascii(text: Column, form: Callable[[str], str]) -> Column:
    """form of texts with characters beyond ASCII; the others are lower-cased without going through Python."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else form(t) for t in texts.to_pylist()], pa.string())

    return F.coalesce(F.arrow_udf(run, StringType())(F.when(text.rlike(r"[^\x00-\x7F]"), text)), F.lower(text))


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str, str]:
    """(characters, what each becomes: shorter, as the rest becomes nothing; characters that become several of which some count).

    Of all code points those that fold to a letter a to z or a digit, or to nothing; whatever else ends a token as it is.
    """
    one, to, none, several = [], [], [], []
    for code in chain(range(ord("A"), ord("Z") + 1), range(0x80, 0xD800), range(0xE000, sys.maxunicode + 1)):
        c = chr(code)
        f = _folded(c)
        if f == c:
            continue
        if not f:
            none.append(c)
        elif any(x in TOKEN for x in f):
            if len(f) == 1:
                one.append(c)
                to.append(f)
            else:
                several.append(c)
    return "".join(one + none), "".join(to), "".join(several)


def _ranges(characters: str) -> str:
    """The inside of a character class."""
    codes, out = sorted(map(ord, characters)), []
    for code in codes:
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


def fold(text: Column) -> Column:
    """Case folded, compatibility decomposed, without combining marks, as far as letters a to z and digits go.

    Plain ASCII is lower-cased; other texts are translated character by character, and only those with a character that becomes
    several (but for sharp s, a common one) go through Python.
    """
    given, become, several = fold_table()
    common = F.translate(F.replace(F.replace(text, F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("ss")), given, become)
    beyond = text.rlike(r"[^\x00-\x7F]")
    # few ranges, and none of them looked at for a character below the first: a class of single characters is slow
    rare = beyond & text.rlike(f"[\\x{{{ord(min(several)):x}}}-\\x{{10FFFF}}&&[{_ranges(several.replace('ß', '').replace('ẞ', ''))}]]")

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _folded(t) for t in texts.to_pylist()], pa.string())

    slow = F.arrow_udf(run, StringType())(F.when(rare, text))
    return F.when(~beyond, F.lower(text)).otherwise(F.coalesce(slow, common))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0))


def normalise(text: Column | str) -> Column:
    """Compatibility composed (NFKC), case folded, white space runs as one space, trimmed."""
    folded = _beyond_ascii(F.col(text) if isinstance(text, str) else text, _composed)
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def words_of(normalised: Column | str) -> Column:
    """Words of a text that is normalised already; hyphens and apostrophes join."""
    return F.regexp_extract_all(normalised, F.lit(r"(?U)\b[\w'-]+\b"), F.lit(0))


def words(text: Column) -> Column:
    """Words of normalised text; hyphens and apostrophes join."""
    return words_of(normalise(text))


def concepts(text: Column) -> Column:
    """Distinct words of over two characters that are not stop words."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)\b[\w'-]{3,}\b"), F.lit(0))
    sharp = F.contains(text, F.lit("ß")) | F.contains(text, F.lit("ẞ"))
    lowered = F.when(sharp, F.transform(found, lambda w: F.replace(F.lower(w), F.lit("ß"), F.lit("ss")))).otherwise(F.transform(found, F.lower))
    return F.array_distinct(F.filter(lowered, lambda w: ~w.isin(CONCEPT_STOP_WORDS)))


def digest(size: int, separator: str, *parts: Column) -> Column:
    """First size hex digits of the SHA-256 of the parts; a null part counts as empty."""
    return F.substring(F.sha2(F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, size)


def stable_id(*parts: Column) -> Column:
    return digest(20, "\u001f", *parts)
