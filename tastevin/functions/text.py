"""Text normalisation and token predicates as Column expressions (JVM-side, no UDFs)."""

from __future__ import annotations

import re
import unicodedata
from functools import cache
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(char: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", char.casefold()) if not unicodedata.combining(c))


@cache
def _fold_maps() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one (for translate), to none, and to several."""
    source, target, gone, several = [], [], [], {}
    for block in (range(0xA0, 0x250), range(0x300, 0x370), range(0x1E00, 0x2000), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F)):
        for code in block:
            char = chr(code)
            plain = _plain(char)
            if plain == char or not unicodedata.name(char, ""):
                continue
            if len(plain) == 1:
                source.append(char)
                target.append(plain)
            elif not plain:
                gone.append(char)
            else:
                several[char] = plain
    return "".join(source + gone), "".join(target), several


def fold_py(value: str | None) -> str:
    """Case and accents off, for query strings on the driver."""
    return "".join(c for c in unicodedata.normalize("NFKD", (value or "").casefold()) if not unicodedata.combining(c))


def fold(column: Column | str) -> Column:
    """Case and accents off: one translate over a generated map, and replacements of the few that grow."""
    source, target, several = _fold_maps()
    out = F.translate(F.lower(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))), source, target)
    for char in ("ß", "æ", "ﬁ", "ﬂ", "½"):
        if char in several:
            out = F.replace(out, F.lit(char), F.lit(several[char]))
    return out


def ascii_fold(column: Column | str) -> Column:
    return F.regexp_replace(fold(column), "[^\\x00-\\x7F]", "")


def search_tokens(query: str | None, least: int = 2) -> list[str]:
    """Word tokens of a folded query, on the driver."""
    return [t for t in re.findall(r"\w+", fold_py(query)) if len(t) >= least]


def words_of(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit("(?U)(\\w+)"), F.lit(1))


def transpositions(token: str) -> list[str]:
    """The token and, from five letters on, its spellings with one pair of neighbours swapped."""
    swapped = [token[:k] + token[k + 1] + token[k] + token[k + 2 :] for k in range(len(token) - 1)] if len(token) >= 5 else []
    return list(dict.fromkeys([token, *swapped]))


_GAP = "[^\\p{L}\\p{N}_]+"


def _whole_words(forms: list[str]) -> str:
    return f"(?<![\\p{{L}}\\p{{N}}_])(?:{'|'.join(forms)})(?![\\p{{L}}\\p{{N}}_])"


def run_patterns(token: str) -> tuple[str, str]:
    """Patterns of the token (or it with a swap of neighbours) written as a run of whole words, of any number of them: one that fails
    early on most texts, one that captures the run at each place, overlapping ones too. They grow with the square of the token's length."""
    forms = [f"(?:{_GAP})?".join(map(re.escape, word)) for word in transpositions(token)]
    whole = _whole_words(forms)
    before, rest = whole[: whole.index("(?:")], whole[whole.index("(?:") :]
    return whole, f"{before}(?=({rest}))"


#: From this length on a token may be divided or have a swap of neighbours.
LOOSE = 5


def joined_runs(words: Column, least: int = LOOSE) -> Column:
    """Distinct runs of two and three neighbouring words, joined, of so many letters or more."""
    join = lambda a, b: F.concat(a, b)
    n = F.size(words)
    two = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), join)
    three = F.zip_with(F.slice(two, F.lit(1), F.greatest(n - 2, F.lit(0))), F.slice(words, F.lit(3), F.greatest(n - 2, F.lit(0))), join)
    return F.filter(F.array_distinct(F.concat(two, three)), lambda r: F.length(r) >= least)


def matches_all(tokens: list[str], folded: Column) -> Column:
    """Every token is a substring, or (five letters on) is a run of up to three words but for one swap of neighbours.

    A run is found by its letters with gaps of any number between them; those of up to two gaps count. No list of a text's word runs
    is made."""
    out = F.lit(True)
    for token in tokens:
        one = folded.contains(token)
        if len(token) >= 5:
            loose, each = run_patterns(token)
            few = F.exists(F.regexp_extract_all(folded, F.lit(each), F.lit(1)), lambda run: F.regexp_count(run, F.lit(_GAP)) <= 2)
            one = one | F.when(folded.rlike(loose), few).otherwise(False)
        out = out & one
    return out


def matches_stripped(tokens: list[str], folded: Column) -> Column:
    """Every token is a substring of the text without separators: the plain way where there is no index."""
    bare = F.regexp_replace(folded, "[^\\p{L}\\p{N}]+", "")
    out = F.lit(True)
    for token in tokens:
        out = out & F.concat_ws(" ", bare, folded).contains(token)
    return out


def word_pattern(words: list[str], loose_hyphens: bool = True) -> str:
    """Pattern of any of the words (whole ones), longest first. A blank is any white space; a hyphen may be a blank or nothing."""
    written = (re.escape(w).replace("\\ ", "\\s+") for w in sorted(set(words), key=lambda w: (-len(w), w)))
    return "\\b(?:" + "|".join(w.replace("\\-", "[-\\s]?") if loose_hyphens else w for w in written) + ")\\b"


def has_word(column: Column, words: list[str]) -> Column:
    """Any of the words, whole, in a lower-case text."""
    return column.rlike(word_pattern(words, loose_hyphens=False))


def part_pattern(parts: list[str]) -> str:
    return "|".join(map(re.escape, parts))


def normalize_name(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def target_key(name: Column | str, city: Column | str, country: Column | str) -> Column:
    return F.concat_ws("|", normalize_name(name), normalize_name(city), normalize_name(country))


def slugify(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    out = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit("unknown"))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("unknown"))


#: Character of every named entity of HTML 4, as the standard library has them.
_ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}


def unescaped(column: Column) -> Column:
    """Entities resolved, named and numeric ones, each once; what is none stays."""
    named = F.create_map(*(F.lit(x) for pair in sorted(_ENTITIES.items()) for x in pair))

    def one(part: Column) -> Column:
        name, rest = F.regexp_extract(part, "^(#?\\w{1,8});", 1), F.regexp_extract(part, "(?s)^#?\\w{1,8};(.*)$", 1)
        code = F.when(name.rlike("^#\\d{1,7}$"), F.substring(name, 2, 8).try_cast("int")).when(name.rlike("^#[xX][0-9a-fA-F]{1,6}$"), F.conv(F.substring(name, 3, 8), 16, 10).try_cast("int"))
        fine = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.coalesce(F.when(fine, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")), F.try_element_at(named, name))
        return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), part))

    parts = F.split(column, "&", -1)
    found = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))
    return F.when(column.contains("&"), found).otherwise(column)


def clean_text(column: Column | str) -> Column:
    """Entities resolved, white space (no-break blanks too) collapsed."""
    out = unescaped(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")))
    return F.trim(F.regexp_replace(out, "(?U)\\s+", " "))


def non_empty(*columns: Column) -> Column:
    """First that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in columns))


def clean_venue_name(column: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), "^[\\s\\u00d7\\u2715\\u2716\\u2717\\u2718\\u274c]+", ""))


def venue_needs_review(column: Column) -> Column:
    return F.coalesce(column.rlike("^[\\s\\u00d7\\u2715\\u2716\\u2717\\u2718\\u274c]+"), F.lit(False))


def repeated_phrase_removed(column: Column) -> Column:
    """Blanks between digits and letters; a phrase of 3 to 80 characters that is said twice in a row, once."""
    spaced = F.regexp_replace(F.regexp_replace(column, "(?<=\\d)(?=\\p{L})", " "), "(?<=\\p{L})(?=\\d)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, "(?iuU)\\b(.{3,80}?)\\1\\b", "$1"), "\\s+", " "))
