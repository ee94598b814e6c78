"""Text normalisation in separate layers, and edit-distance measures.

Spark has no NFKC or case folding, so texts with other than ASCII characters go
through an Arrow-batched function; ASCII texts, and the measures themselves,
stay in native expressions.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: characters that decorate lyrics and are dropped from display text
DECORATION = frozenset("♪♫♬♩★☆♥♡◆◇●○■□▲△")
APOSTROPHES = {ord(c): "'" for c in "‘’ʼ"}
#: what the match layer keeps of punctuation, and the evaluation layer of punctuation and symbols
MATCH_KEEPS, EVALUATION_KEEPS = frozenset("&'"), frozenset("&'’+#")


@lru_cache
def _classes() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """What display, match and evaluation texts drop, as patterns over all of Unicode."""

    def pattern(dropped) -> re.Pattern:
        codes = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and dropped(chr(c))]
        parts, i = [], 0
        while i < len(codes):
            j = i
            while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
                j += 1
            parts.append(f"\\U{codes[i]:08x}-\\U{codes[j]:08x}")
            i = j + 1
        return re.compile(f"[{''.join(parts)}]+")

    kind = unicodedata.category
    return (
        pattern(lambda c: c in DECORATION or not c.isspace() and kind(c) in ("Cf", "Cc")),
        pattern(lambda c: c.isspace() or c not in MATCH_KEEPS and kind(c)[0] == "P"),
        pattern(lambda c: c.isspace() or c not in EVALUATION_KEEPS and kind(c)[0] in "PS"),
    )


def display_text(text: str | None) -> str:
    """NFKC; decoration dropped; white space to single blanks; then format and control characters dropped; trimmed."""
    if text is None:
        return ""
    return " ".join(_classes()[0].sub("", unicodedata.normalize("NFKC", str(text))).split())


def _folded(shown: str) -> str:
    """The match text of display text."""
    return _classes()[1].sub("", shown.translate(APOSTROPHES).casefold())


def match_text(text: str | None) -> str:
    """The compact form for comparison: case-folded display text without blanks and punctuation but & and '."""
    return _folded(display_text(text))


def evaluation_text(text: str | None) -> str:
    """The form that accuracy is measured on: also without symbols, control characters kept."""
    return _classes()[2].sub("", unicodedata.normalize("NFKC", text or "").casefold()).replace("’", "'")


def _layer(function):
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else function(t))

    return run


_display, _match, _evaluation = map(_layer, (display_text, match_text, evaluation_text))
_ASCII = "^[\\x00-\\x7f]*$"
_PUNCTUATION = "[\\x00-\\x20\\x7f!\"#%()*,\\-./:;?@\\[\\\\\\]_{}]"


def _with_fast_path(text: Column, native: Column, function) -> Column:
    plain = text.rlike(_ASCII)
    return F.coalesce(F.when(text.isNull(), F.lit("")), F.when(plain, native), function(F.when(~plain, text)))


def display(text: Column) -> Column:
    native = F.regexp_replace(F.regexp_replace(text, "[\\x00-\\x08\\x0e-\\x1b\\x7f]", ""), "[\\x09-\\x0d\\x1c-\\x20]+", " ")
    return _with_fast_path(text, F.trim(native), _display)


def match(text: Column) -> Column:
    return _with_fast_path(text, F.regexp_replace(F.lower(text), _PUNCTUATION, ""), _match)


def evaluation(text: Column) -> Column:
    native = F.regexp_replace(F.lower(text), "[\\x09-\\x0d\\x1c-\\x20!\"$%()*,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]", "")
    return _with_fast_path(text, native, _evaluation)


def variants(text: Column) -> Column:
    """raw, display and match text of one observation."""
    return F.struct(F.coalesce(text, F.lit("")).alias("raw_text"), display(text).alias("display_text"), match(text).alias("match_text"))


def similarity_percent(left: Column, right: Column, distance: Column | None = None) -> Column:
    """0 to 100 by edit distance over the longer text; two empty texts are alike.
    A distance that is at hand already need not be computed again."""
    return 100.0 * similarity(left, right, distance)


def similarity(left: Column, right: Column, distance: Column | None = None) -> Column:
    """0 to 1 by edit distance over the longer text; two empty texts are alike."""
    longest = F.greatest(F.length(left), F.length(right))
    distance = F.levenshtein(left, right) if distance is None else distance
    return F.when(longest == 0, 1.0).otherwise(1 - distance / longest)


def character_error_rate(reference: Column, candidate: Column, distance: Column | None = None) -> Column:
    """Edits per reference character; may pass 1.  Against an empty reference 0 if the candidate is empty, else 1."""
    distance = F.levenshtein(reference, candidate) if distance is None else distance
    return F.when(F.length(reference) == 0, F.when(F.length(candidate) == 0, 0.0).otherwise(1.0)).otherwise(distance / F.length(reference))


@lru_cache(maxsize=65536)
def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance in code points, for the state machine; bit-parallel over the shorter text."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    peq: dict[str, int] = {}
    for i, c in enumerate(b):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << len(b)) - 1, 1 << len(b) - 1
    plus, minus, score = full, 0, len(b)
    for c in a:
        eq = peq.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus) & full, plus & xh
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | ~(xv | up) & full, up & xv
    return score


def space_boundaries(text: str, whole: str) -> set[int]:
    """Places in the match text where the display text has a blank; none if the parts do not make it up."""
    parts = [_folded(p) for p in display_text(text).split(" ")]
    return _ends(parts, whole, 1) if all(parts) else set()


def fragment_boundaries(fragments: list[str] | None, whole: str) -> set[int]:
    """Places in the match text where recognition split the row, two characters from each end at least."""
    return _ends([p for p in map(match_text, fragments or ()) if p], whole, 2)


def _ends(parts: list[str], whole: str, margin: int) -> set[int]:
    if len(parts) < 2 or "".join(parts) != whole:
        return set()
    out, at = set(), 0
    for part in parts[:-1]:
        at += len(part)
        if margin <= at <= len(whole) - margin:
            out.add(at)
    return out


def boundaries(text: str, fragments: list[str] | None = None) -> list[int]:
    whole = match_text(text)
    return sorted(space_boundaries(text, whole) | fragment_boundaries(fragments, whole))


def insert_spaces(text: str, places: list[int]) -> str:
    """Display text with blanks at places of its match text, none doubled."""
    out: list[str] = []
    at, due, wanted = 0, False, set(places)
    for c in text:
        if c.isspace():
            out.append(" ")
            due = False
            continue
        adds = len(match_text(c))
        if adds:
            out.append(" " if due else "")
            due = False
        out.append(c)
        at += adds
        due = due or at in wanted
    return re.sub(" +", " ", "".join(out)).strip()


def fragments_joined(fragments: Column) -> Column:
    """Fragments of a row; a blank only between two ASCII letters or digits."""
    glue = lambda out, x: F.when(out.rlike("[0-9A-Za-z]$") & x.rlike("^[0-9A-Za-z]"), F.concat(out, F.lit(" "), x)).otherwise(F.concat(out, x))
    return F.aggregate(fragments, F.lit(""), glue)
