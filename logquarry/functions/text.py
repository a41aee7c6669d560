"""Full-text tokens, phrase predicates and word features."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_CHARS = r"\p{L}\p{N}\p{Co}"
TOKEN = f"[{TOKEN_CHARS}]+"

# Characters that separate words: Unicode white space plus the four information separators. The
# single characters come first because the regular expression engine keeps them in a bit set.
SPACES = r"[ \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\p{Z}]+"

# Keyword features look for these as substrings.
ERROR_KEYWORDS = ("error", "exception", "failed", "timeout", "crash")
WARNING_KEYWORDS = ("warn", "warning", "deprecated", "slow")


def _fold_table() -> tuple[str, str]:
    """Arguments of ``translate`` that drop diacritics.

    A precomposed Latin letter folds when its decomposition is one ASCII letter and one mark;
    letters with two marks and letters without a decomposition stay. Combining marks go last with
    no counterpart, so ``translate`` deletes them.
    """
    plain = {}
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        letter = chr(code).lower()
        parts = unicodedata.normalize("NFD", letter)
        if len(letter) == 1 and len(parts) == 2 and parts[0].isascii():
            plain[letter] = parts[0]
    marks = "".join(chr(code) for code in range(0x0300, 0x0370))
    return "".join(plain) + marks, "".join(plain.values())


_ACCENTED, _PLAIN = _fold_table()
_FOLD = {
    ord(letter): _PLAIN[i] if i < len(_PLAIN) else None for i, letter in enumerate(_ACCENTED)
}


def ascii_lower(text: Column) -> Column:
    """Lower case for A to Z only, as in a case-insensitive LIKE."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def fold(text: Column) -> Column:
    """Lower case without Latin diacritics; a text of single bytes has none."""
    lowered = F.lower(text)
    return F.when(F.octet_length(text) == F.length(text), lowered).otherwise(F.translate(lowered, _ACCENTED, _PLAIN))


def tokens(text: Column) -> Column:
    """Folded runs of letters, digits and private-use characters, in order."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), 0)


def token_line(text: Column) -> Column:
    """All tokens as one line with a space on both sides of each; stored beside the log."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def phrase_tokens(phrase: str) -> list[str]:
    """Tokens of a search phrase (one short driver-side string)."""
    kept = "".join(
        ch if unicodedata.category(ch)[0] in "LN" or unicodedata.category(ch) == "Co" else " "
        for ch in phrase.lower().translate(_FOLD)
    )
    return kept.split()


def has_phrase(text: Column, words: list[str]) -> Column:
    """True when ``words`` occur as consecutive tokens of ``text``.

    A substring test on the longest word rejects most rows before the regular expression runs.
    """
    folded = fold(text)
    gap = f"[^{TOKEN_CHARS}]+"
    pattern = f"(?<![{TOKEN_CHARS}]){gap.join(words)}(?![{TOKEN_CHARS}])"
    return folded.contains(max(words, key=len)) & folded.rlike(pattern)


def line_has_phrase(line: Column, words: list[str]) -> Column:
    """The same test on a stored token line."""
    return line.contains(f" {' '.join(words)} ")


def words(lowered: Column) -> Column:
    """Words between runs of white space, of a text that is lower case already; blank has none."""
    return F.array_remove(F.split(lowered, SPACES), "")


def has_any(lowered: Column, keywords: tuple[str, ...]) -> Column:
    """True when any keyword occurs inside a text that is lower case already."""
    hit = F.lit(False)
    for keyword in keywords:
        hit = hit | lowered.contains(keyword)
    return hit
