"""Name and text functions as Column expressions; no Python runs on executors."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterable
from html import entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from hustings.config import ELECTION_KEYWORDS, NUANCE_BLOCS, OTHER_BLOC

#: White space as free text has it: Java's ``\s`` knows ASCII only.
SPACE = r"[\s\x1c-\x1f\u0085   -     　]"


def _fold_table() -> tuple[str, str, str]:
    """(letters that decompose to one letter and marks, those letters, marks): derived from Unicode's decompositions."""
    src, dst, marks = [], [], []
    for char in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]):
        if unicodedata.category(char) == "Mn":
            marks.append(char)
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != char:
            src.append(char)
            dst.append(base)
    return "".join(src), "".join(dst), "".join(marks)


#: ``translate`` drops what has no partner: combining marks vanish.
FOLD_FROM, FOLD_TO, MARKS = _fold_table()


def strip(c: Column | str) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def deaccent(c: Column | str) -> Column:
    """Letters without their marks; letters that don't decompose stay."""
    return F.translate(c, FOLD_FROM + MARKS, FOLD_TO)


def normalize_name(c: Column | str) -> Column:
    """Upper-case ASCII name with single spaces: joiners become spaces, other foreign characters vanish, null is empty."""
    c = F.col(c) if isinstance(c, str) else c
    spaced = F.translate(F.upper(strip(F.coalesce(c, F.lit("")))), "-'’", "   ")
    plain = F.regexp_replace(deaccent(spaced), r"[^\x00-\x7F]", "")
    return strip(F.regexp_replace(plain, r"[\s\x1c-\x1f]+", " "))


def normalize_nuance(c: Column | str) -> Column:
    """List code without its leading L, unless it is that letter alone."""
    c = F.col(c) if isinstance(c, str) else c
    code = F.upper(strip(F.coalesce(c, F.lit(""))))
    return F.when(code.startswith("L") & (F.length(code) > 1), F.substring(code, 2, 1 << 20)).otherwise(code)


def nuance_bloc(c: Column | str) -> Column:
    """Bloc of a list code; unknown codes are the other bloc."""
    table = F.create_map(*[F.lit(x) for pair in NUANCE_BLOCS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, normalize_nuance(c)), F.lit(OTHER_BLOC))


def normalize_match(c: Column | str) -> Column:
    """Lower-case ASCII words with single spaces, for matching; null is empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(deaccent(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " "))


def full_name(family: Column, given: Column, existing: Column | None = None) -> Column:
    """Family and given name with one space between, trimmed; an existing name wins."""
    built = F.trim(F.concat(F.coalesce(family, F.lit("")), F.lit(" "), F.coalesce(given, F.lit(""))))
    return built if existing is None else F.coalesce(existing, built)


def words(c: Column | str) -> Column:
    """Parts between white space, none of them empty."""
    return F.filter(F.split(strip(c), f"{SPACE}+"), lambda x: x != "")


def family_given(c: Column | str) -> tuple[Column, Column]:
    """(family, given): the last word is the given name unless it is the only one."""
    parts = words(c)
    family = F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " "))
    return F.coalesce(family, F.lit("")), F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 1)).otherwise("")


def title_case(c: Column | str) -> Column:
    """Each run of letters capitalised, whatever stands before it."""
    runs = F.regexp_extract_all(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 20)))), "")


def match_tokens(c: Column | str) -> Column:
    """Words of at least three characters of the text for matching."""
    return F.filter(F.split(normalize_match(c), " "), lambda x: F.length(x) >= 3)


def any_token(text: Column, tokens: Column) -> Column:
    """Whether one of the tokens stands anywhere in the text, inside of words too."""
    return F.exists(tokens, lambda t: F.contains(text, t))


def aliases(name: Column | str) -> dict[str, Column]:
    """Ways to write a candidate's name."""
    name = F.col(name) if isinstance(name, str) else name
    family, given = family_given(name)
    accented = F.trim(F.concat_ws(" ", given, title_case(family)))
    plain = deaccent(accented)
    return {"official": name, "natural_accented": accented, "natural_deaccented": plain, "normalized": F.array_join(words(F.translate(plain, "-'", "  ")), " ")}


def precise_query(name: Column | str, commune: Column | str) -> Column:
    return F.format_string('"%s" AND "%s" AND (' + " OR ".join(ELECTION_KEYWORDS) + ")", aliases(name)["natural_accented"], commune)


def relaxed_query(name: Column | str, commune: Column | str) -> Column:
    return F.format_string('"%s" AND "%s"', aliases(name)["natural_deaccented"], commune)


def event_query(name: Column | str, commune: Column | str, mode: str = "precise") -> Column:
    """Full-text query of the event provider; modes precise and relaxed."""
    if mode not in ("precise", "relaxed"):
        raise ValueError(f"Unknown query mode: {mode!r}. Must be 'precise' or 'relaxed'.")
    return precise_query(name, commune) if mode == "precise" else relaxed_query(name, commune)


def generic_query(name: Column | str, commune: Column | str) -> Column:
    return F.format_string('"%s" "%s" (' + " OR ".join(ELECTION_KEYWORDS) + ")", aliases(name)["natural_accented"], commune)


#: A character reference as HTML has it: a number, or a name that may lack its semicolon.
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _numbered() -> dict[int, str]:
    """Numbers that stand for another character than their own, by the library's rules."""
    return {n: html.unescape(f"&#{n};") for n in range(256) if html.unescape(f"&#{n};") != chr(n)}


def _names() -> tuple[Column, Column, str]:
    """(characters by name, those of names that need no semicolon, a pattern of the latter, long ones first)."""
    bare = {k: v for k, v in entities.html5.items() if not k.endswith(";")}
    table = lambda names: F.map_from_arrays(F.split(F.lit("\n".join(names)), "\n"), F.split(F.lit("\x00".join(names.values())), "\x00"))
    return table({k: v for k, v in entities.html5.items() if v != "\n"}), table(bare), "^(" + "|".join(sorted(bare, key=len, reverse=True)) + ")"


def unescape_html(c: Column | str) -> Column:
    """Character references resolved once, as browsers do: all names, numbers, and old names without a semicolon."""
    c = F.col(c) if isinstance(c, str) else c
    every, bare, pattern = _names()
    other = F.create_map(*[x for n, v in _numbered().items() for x in (F.lit(n), F.lit(v))])

    def number(ref: Column) -> Column:
        hexed = F.lower(F.substring(ref, 2, 1)) == "x"
        digits = F.regexp_replace(F.regexp_replace(ref, "^#[xX]?0*|;$", ""), "^$", "0")
        n = F.when(F.length(digits) > 7, 0x110000).otherwise(F.conv(digits, 10, 10).cast("int"))
        n = F.when(hexed, F.when(F.length(digits) > 6, 0x110000).otherwise(F.conv(digits, 16, 10).cast("int"))).otherwise(n)
        no_character = (n.between(0xFDD0, 0xFDEF)) | ((n >= 0xFFFE) & (n % 0x10000 >= 0xFFFE)) | (n == 0xB) | n.between(0xE, 0x1F) | n.between(0x7F, 0x9F) | n.between(1, 8)
        char = F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32")
        return F.when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd").otherwise(F.coalesce(F.try_element_at(other, n), F.when(no_character, "").otherwise(char)))

    def named(ref: Column) -> Column:
        old = F.regexp_extract(ref, pattern, 1)
        short = F.when(old != "", F.concat(F.try_element_at(bare, old), F.substring(ref, F.length(old) + 1, F.lit(40))))
        return F.coalesce(F.when(ref == "NewLine;", "\n"), F.try_element_at(every, ref), short, F.concat(F.lit("&"), ref))

    refs = F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(1))
    gaps = F.split(c, REFERENCE, -1)
    resolved = F.transform(refs, lambda r: F.when(r.startswith("#"), number(r)).otherwise(named(r)))
    whole = F.concat(F.array_join(F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(refs)).alias("gap"), resolved.alias("char")), lambda x: F.concat(x["gap"], x["char"])), ""), F.element_at(gaps, -1))
    return F.when(F.contains(c, F.lit("&")) & (F.size(refs) > 0), whole).otherwise(c)


def strip_html(c: Column | str, unescape: bool = True) -> Column:
    """Text for matching: scripts and styles dropped, tags as spaces, character references resolved."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    c = F.regexp_replace(c, "<[^>]+>", " ")
    return unescape_html(c) if unescape else c


def path_token(c: Column | str, most: int) -> Column:
    """Lower-case token for paths: other characters are one underscore, none at the ends; 'unknown' if nothing stays."""
    token = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), "[^0-9a-z]+", "_"), "^_+|_+$", ""), 1, most)
    return F.when(token == "", "unknown").otherwise(token)


def split_list(c: Column | str) -> Column:
    """Trimmed parts between commas, none of them empty."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def outlet_from_domain(c: Column | str, otherwise: str = "") -> Column:
    """Lower-case domain without a leading www., or another key where there is none."""
    bare = F.regexp_replace(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), r"^www\.", "")
    return F.when(bare == "", F.lit(otherwise)).otherwise(bare)


def missing_fields(row: dict[str, Column]) -> Column:
    """Sorted names of required fields that are null or blank."""
    return F.array_compact(F.array(*[F.when(F.coalesce(strip(c.cast("string")), F.lit("")) == "", F.lit(n)) for n, c in sorted(row.items())]))


def all_of(columns: Iterable[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out
