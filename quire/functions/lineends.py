"""Words and dashes at line ends, and scannos between spaces and punctuation; nothing here minds case.

A word broken at a line's end is put together on the first line, and what follows it starts the next.  Each rule is one
replacement: the broken word's second part, one of the common endings, and punctuation with what hangs on it may each
follow.  The same holds for words kept with their hyphen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as punctuation, and endings that any second part may have.
PUNCTUATION = r"[,;:!?.\"'\-()]"
ENDINGS = ("s", "d", "r", "er", "ed", "ing", "ly")
#: Scanned signs that stand for words when they stand alone; patterns and replacements.
ALONE = ((r"(?<!\w)IJ(?!\w)", "I"), ("1n", "in"), ("1s", "is"), ("1t", "it"), (r"I\]", "I"), ("([Tt])oa", "$1o a"), ("([Aa])ta", "$1t a"), (r"(?<!\w)J(?!\w)", "I"), (r"(?<!\w)\[(?!\w)", "I"), (r"(?<!\w)\|(?!\w)", "I"), (r"(?<!\w)1(?!\w)", "I"), (r"\[am", "I am"))


def _any(parts: Iterable[str]) -> str:
    return "(?:" + "|".join(parts) + ")"


def _second(parts: Iterable[str]) -> str:
    """A second part with what may follow it, and the space or line end behind."""
    return rf"({_any(parts)}{_any(ENDINGS)}?(?:{PUNCTUATION}{{1,4}}\S*)?)[\n ]"


def join_endings(text: Column, endings: Iterable[str]) -> Column:
    """Broken words whose second part is one of ``endings``, whatever the first is."""
    return F.regexp_replace(text, rf"(?i)-\n{_second(endings)}", "$1\n")


def join_beginnings(text: Column, beginnings: Iterable[str]) -> Column:
    """Broken words whose first part is one of ``beginnings``, whatever the second is."""
    return F.regexp_replace(text, rf"(?i)(?<=\W)({_any(beginnings)})-\n(\S+)[\n ]", "$1$2\n")


def join_words(text: Column, words: Mapping[str, Iterable[str]]) -> Column:
    """Broken words of a first part and one of its second parts."""
    for first, second in words.items():
        text = F.regexp_replace(text, rf"(?i)(?<=\W)({first})-\n{_second(second)}", "$1$2\n")
    return text


def join_words_by_end(text: Column, words: Mapping[str, Iterable[str]]) -> Column:
    """Broken words of a second part and one of its first parts."""
    for second, first in words.items():
        text = F.regexp_replace(text, rf"(?i)(?<=\W)({_any(first)})-\n{_second([second])}", "$1$2\n")
    return text


def keep_hyphens(text: Column, words: Mapping[str, Iterable[str]]) -> Column:
    """Words of a first part and one of its second parts that are written with a hyphen, put on one line."""
    for first, second in words.items():
        text = F.regexp_replace(text, rf"(?i)(?<=\W)({first}-)\n{_second(second)}", "$1$2\n")
    return text


def close_up(text: Column) -> Column:
    """No space before signs that close."""
    return F.regexp_replace(text, " ([:;!?])", "$1")


def tidy_dashes(text: Column) -> Column:
    """Dashes as two hyphens without spaces; a word after a dash at a line's end comes up to it, and so does a dash that starts a line."""
    text = F.regexp_replace(F.regexp_replace(text, " *— *", "--"), " *--{1,2} *", "--")
    text = F.regexp_replace(text, r"(?<!\n)--\n *(\S*) ", "--$1\n")
    return F.regexp_replace(text, r"(?<!\n)\n(--\S*) ", "$1\n")


def replace_alone(text: Column, pairs: Iterable[tuple[str, str]] = ALONE) -> Column:
    """Replacements, one after the other, of what stands between white space or punctuation on both sides."""
    for pattern, replacement in pairs:
        text = F.regexp_replace(text, rf"(?i)(?<=\s|{PUNCTUATION}){pattern}(?=\s|{PUNCTUATION})", replacement)
    return text
