"""Text normalisation and term matching as native column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Precomposed syllables of U+AC00 on decompose by arithmetic into 19 leads, 21 vowels and 27 tails; nothing decomposes beyond ``_LAST``.
_SYLLABLES, _LEADS, _VOWELS, _TAILS, _LAST = (0xAC00, 0xD7A3), (0x1100, 19), (0x1161, 21), (0x11A8, 27), 0x30000
#: Below this point letters are looked up in a small table; texts with others take the whole one.
_LATIN_END = 0x250


def strip_py(text: str) -> str:
    """Compatibility decomposition without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@cache
def _decompositions() -> dict[str, str]:
    """What each character becomes, if not itself; precomposed syllables are left out."""
    codes = (c for c in range(0x80, _LAST) if not (_SYLLABLES[0] <= c <= _SYLLABLES[1] or 0xD800 <= c <= 0xDFFF))
    return {chr(c): base for c in codes if (unicodedata.decomposition(chr(c)) or unicodedata.combining(chr(c))) and (base := strip_py(chr(c))) != chr(c)}


@cache
def _letters(end: int = _LAST) -> tuple[str, str]:
    """Characters that become a single one, followed by those that vanish, and the former's replacements."""
    found = {c: base for c, base in _decompositions().items() if len(base) < 2 and ord(c) < end}
    ordered = sorted(found, key=lambda c: (not found[c], c))
    return "".join(ordered), "".join(found[c] for c in ordered)


def _ranges(codes: Iterable[int]) -> str:
    """Inside of a character class."""
    out: list[list[int]] = []
    for c in sorted(codes):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


@cache
def _classes() -> tuple[str, str, str]:
    """Patterns of what the small table can't do, of what becomes several characters, and of one such or a run of others; ASCII is tested first."""
    several = [ord(c) for c, base in _decompositions().items() if len(base) > 1]
    beyond = _ranges([c for c in several if c < _LATIN_END]) + f"\\x{{{_LATIN_END:x}}}-\\x{{10ffff}}"
    longer = _ranges([*several, *range(_SYLLABLES[0], _SYLLABLES[1] + 1)])
    return f"[{beyond}]", f"[\\x{{80}}-\\x{{10ffff}}&&[{longer}]]", f"[\\x00-\\x7f[^{longer}]]+|[{longer}]"


@cache
def _pages() -> tuple[str, str]:
    """What becomes several characters, in pages of 256 code points: the number of each page, and the strings of all pages."""
    several = {ord(c): base for c, base in _decompositions().items() if len(base) > 1}
    used = sorted({c >> 8 for c in several})
    numbers = [str(used.index(p)) if p in used else "-1" for p in range(_LAST >> 8)]
    return ",".join(numbers), "\x01".join(several.get((p << 8) + k, "") for p in used for k in range(256))


def _expanded(text: Column) -> Column:
    """Each character that becomes several, replaced; what lies between two of them is one piece."""
    numbers, strings = (F.lit(x) for x in _pages())
    run = lambda first, n: F.lit("".join(chr(first + k) for k in range(n)))

    def syllable(code: Column) -> Column:
        s = code - _SYLLABLES[0]
        at = lambda table, k: F.substr(run(*table), k.cast("int") + 1, F.lit(1))
        tail = F.when(s % 28 > 0, at(_TAILS, s % 28 - 1)).otherwise("")
        return F.concat(at(_LEADS, F.floor(s / 588)), at(_VOWELS, F.floor(s % 588 / 28)), tail)

    def piece(c: Column) -> Column:
        code = F.ascii(c)
        page = F.get(F.split(numbers, ",").cast("array<int>"), F.shiftright(code, 8))
        found = F.nullif(F.get(F.split(strings, "\x01"), page * 256 + code.bitwiseAND(F.lit(255))), F.lit(""))
        return F.when(code < 0x80, c).when(code.between(*_SYLLABLES), syllable(code)).otherwise(F.coalesce(found, c))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_classes()[2]), F.lit(0)), piece), "")


def strip_accents(col: Column) -> Column:
    """Compatibility decomposition without combining marks, of any text; ASCII stays, Latin letters take a small table."""

    def whole(x: Column) -> Column:
        return let(F.translate(x, *_letters()), lambda y: F.when(y.rlike(_classes()[1]), _expanded(y)).otherwise(y))

    return let(col, lambda x: F.when(is_ascii(x), x).when(~x.rlike(_classes()[0]), F.translate(x, *_letters(_LATIN_END))).otherwise(whole(x)))


def fold_py(text: str) -> str:
    return strip_py(text).lower()


def tokens_py(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", fold_py(text)).strip()


def clean_name(name: object) -> str:
    """Header as an identifier: folded, other characters as single underscores, ``columna`` if nothing is left."""
    return re.sub(r"[^a-z0-9]+", "_", fold_py(str(name))).strip("_") or "columna"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_ascii(col: Column) -> Column:
    return F.octet_length(col) == F.length(col)


def fold(col: Column) -> Column:
    """Lower case without accents; null as empty."""
    return F.lower(strip_accents(F.coalesce(col, F.lit(""))))


def normalize(col: Column) -> Column:
    """Folded, runs of (Unicode) white space as one space, trimmed; punctuation stays."""
    return let(fold(col), lambda x: F.trim(F.when(is_ascii(x), F.regexp_replace(x, r"\s+", " ")).otherwise(F.regexp_replace(x, r"(?U)\s+", " "))))


def tokens(col: Column) -> Column:
    """Folded, everything but a-z and 0-9 as single spaces, trimmed."""
    return F.trim(F.regexp_replace(fold(col), "[^a-z0-9]+", " "))


def slug(col: Column, default: str = "") -> Column:
    found = F.regexp_replace(F.regexp_replace(fold(col), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(found == "", F.lit(default)).otherwise(found) if default else found


def padded(text: Column) -> Column:
    """A token text with a border on both sides.  Tests of many terms want it stored, not as an expression."""
    return F.concat(F.lit(" "), text, F.lit(" "))


def holds(padded_text: Column, term: str) -> Column:
    return padded_text.contains(f" {tokens_py(term)} ")


def has_term(text: Column, term: str) -> Column:
    """Whether a token text holds a term between token borders."""
    return holds(padded(text), term)


def has_any(text: Column, terms: Iterable[str]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | has_term(text, term)
    return out


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """Substring test, not bound to tokens."""
    out = F.lit(False)
    for term in terms:
        out = out | text.contains(term)
    return out


def terms_found(text: Column, terms: Iterable[str], words: Column | None = None, ordered: bool = True) -> Column:
    """Terms that a token text holds: by length, then text, or in the catalogue's order.

    With ``words``, those of one word are looked up in that array, and ``text`` is a padded one.
    """
    terms = sorted(set(terms), key=lambda t: (len(t), t)) if ordered else list(terms)

    def found(term: str) -> Column:
        if words is None:
            return has_term(text, term)
        return holds(text, term) if " " in tokens_py(term) else F.array_contains(words, tokens_py(term))

    return F.array_compact(F.array(*(F.when(found(t), F.lit(t)) for t in terms)))


def substring_list(text: Column, terms: Iterable[str]) -> Column:
    """Distinct leftmost non-overlapping substring matches, longest term first, sorted and joined by ``; ``."""
    terms = sorted(terms, key=len, reverse=True)
    # The class of first letters lets the engine pass over most places with one test.
    first, any_term = re.escape("".join(sorted({t[0] for t in terms}))), "|".join(map(re.escape, terms))
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=[{first}])({any_term})"), F.lit(1)))), "; ")


def search_text(*cols: Column) -> Column:
    return normalize(F.concat_ws(" ", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)))


def relevant_text(*cols: Column) -> Column:
    """Token text of all columns; a null becomes the token ``nan``."""
    return tokens(F.concat_ws(" ", *(F.coalesce(c.cast("string"), F.lit("nan")) for c in cols)))


def first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in cols), F.lit(""))


def default_label(col: Column, label: str) -> Column:
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(label))


def html_escape(col: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(raw), F.lit(safe))
    return col


def joined_once(parts: list[Column], suffix: Column) -> Column:
    """Parts without blanks and without those whose token text came before, then a suffix."""
    keyed = F.filter(F.transform(F.array(*parts), lambda p: F.struct(F.trim(p).alias("part"), tokens(p).alias("key"))), lambda e: e["part"] != "")
    first = lambda all_parts: F.filter(all_parts, lambda e, k: ~F.exists(F.slice(all_parts, F.lit(1), k), lambda q: q["key"] == e["key"]))
    kept = F.transform(let(keyed, first), lambda e: e["part"])
    return F.trim(F.concat_ws(" ", kept, suffix))
