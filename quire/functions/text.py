"""Text functions on columns: typography, scannos, hyphens, numerals, names.

A word character is ``[\\p{L}\\p{N}_]`` everywhere: Java's bare ``\\w`` knows ASCII only.  Places are counted in
code points.  All functions give null for null unless they say otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"[\p{L}\p{N}_]"
#: The same in a lookbehind: Java looks back by whole code points only where the pattern has one beyond U+FFFF, so it names such a letter.
BEHIND = r"[\p{L}\p{N}_𝒜]"
TOKEN = rf"{W}+(?:[-']{W}+)*"
#: Where a word is broken at a line end; what has to match comes first, so that other places are passed over fast.
BREAK = rf"-\n(?<={BEHIND}-\n)(?={W})"
#: Curly quotes and the straight ones they become.
CURLY = "‘’‚‛“”„‟"
STRAIGHT = "''''\"\"\"\""
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def straight_quotes(text: Column) -> Column:
    return F.translate(text, CURLY, STRAIGHT)


def plain_dashes(text: Column) -> Column:
    return F.replace(text, F.lit("—"), F.lit("--"))


def fold_long_s(text: Column) -> Column:
    return F.replace(text, F.lit("ſ"), F.lit("s"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def rewrite(text: Column, pattern: str, each: Callable[[Column], Column]) -> Column:
    """``text`` with every match of ``pattern`` replaced by ``each(match)``."""

    def rewritten(t: Column) -> Column:
        gaps, found = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), 0)
        pieces = F.zip_with(gaps, found, lambda gap, m: F.concat(F.coalesce(gap, F.lit("")), F.when(m.isNotNull(), each(m)).otherwise("")))
        return F.when(t.rlike(pattern), F.array_join(pieces, "")).otherwise(t)

    return let(text, rewritten)


def _is_token(word: str) -> bool:
    return all(part and all(c == "_" or unicodedata.category(c)[0] in "LN" for c in part) for part in re.split("[-']", word))


def _any_of(words: Iterable[str]) -> str:
    """A pattern of ``words`` as a tree of their letters: what is tried at a place doesn't grow with the list."""
    after: dict[str, list[str]] = {}
    for word in (words := list(words)):
        if word:
            after.setdefault(word[0], []).append(word[1:])
    if not after:
        return ""
    return "(?:" + "|".join(re.escape(c) + _any_of(rest) for c, rest in after.items()) + ")" + ("?" if "" in words else "")


def replace_scannos(text: Column, scannos: Mapping[str, str]) -> Column:
    """Whole tokens found in ``scannos``, case-sensitive, are replaced.

    Only the tokens listed are looked at, one pattern finds them, so the cost doesn't grow with the list.
    """
    scannos = {x: y for x, y in scannos.items() if _is_token(x)}
    if not scannos:
        return text
    first = "".join(re.escape(c) for c in sorted({x[0] for x in scannos}))
    pattern = rf"(?=[{first}])(?<!{BEHIND})(?<!{BEHIND}[-']){_any_of(scannos)}(?![-']?{W})"
    if len(set(scannos.values())) == 1:
        return F.regexp_replace(text, pattern, next(iter(scannos.values())).replace("\\", r"\\").replace("$", r"\$"))
    known = F.create_map(*[F.lit(x) for pair in scannos.items() for x in pair])
    return rewrite(text, pattern, lambda m: F.try_element_at(known, m))


def _breaks(pieces: Column) -> Column:
    """(prefix, suffix, char_offset) of the word broken between each two ``pieces`` of a text cut at ``BREAK``.

    Null where the first part is already the second part of the word broken before: a word is broken once.
    """
    kind = "array<struct<prefix:string,suffix:string,char_offset:int>>"
    none = F.struct(F.lit(0).alias("at"), F.lit(False).alias("taken"), F.array().cast(kind).alias("out"))

    def parts(left: Column, right: Column) -> Column:
        # The last word has no space in it, so that only the end of a piece is looked at.
        prefix = F.regexp_extract(F.substring_index(left, " ", -1), rf"(?<!{BEHIND}){W}++\z", 0)
        return F.struct(F.length(left).alias("n"), prefix.alias("prefix"), F.regexp_extract(right, rf"\A{W}++", 0).alias("suffix"))

    def step(a: Column, x: Column) -> Column:
        length = F.length(x["prefix"])
        free = ~(a["taken"] & (length == x["n"]))
        one = F.when(free, F.struct(x["prefix"].alias("prefix"), x["suffix"].alias("suffix"), (a["at"] + x["n"] - length).alias("char_offset")))
        return F.struct((a["at"] + x["n"] + F.lit(2)).alias("at"), free.alias("taken"), F.concat(a["out"], F.array(one)).alias("out"))

    n = F.size(pieces) - 1
    return F.aggregate(F.zip_with(F.slice(pieces, F.lit(1), n), F.slice(pieces, F.lit(2), n), parts), none, step)["out"]


def _joined(text: Column, join: Callable[[Column], Column]) -> Column:
    """``text`` with the broken words put together for which ``join`` of (prefix, suffix, char_offset) holds."""

    def put(pieces: Column) -> Column:
        joins = F.transform(_breaks(pieces), lambda x: F.coalesce(join(x), F.lit(False)))
        return F.array_join(F.zip_with(pieces, joins, lambda p, j: F.concat(p, F.when(j.isNull() | j, "").otherwise("-\n"))), "")

    return F.when(F.contains(text, F.lit("-\n")), let(F.split(text, BREAK, -1), put)).otherwise(text)


def join_hyphens(text: Column, allowed: Sequence[str]) -> Column:
    """Joins words broken at a line end whose first part, lower-cased, is allowed."""
    if not allowed:
        return text
    parts = [x.rstrip("-").lower() for x in allowed]
    return let(text, lambda t: _joined(t, lambda x: F.lower(x["prefix"]).isin(parts)))


def regex_passes(text: Column, passes: Sequence[tuple[str, str]]) -> Column:
    """Replacements one after the other; patterns and replacements in Java's dialect."""
    for pattern, replacement in passes:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def post_process(text: Column, system: Mapping[str, str], project: Mapping[str, str], allowed: Sequence[str], passes: Sequence[tuple[str, str]]) -> Column:
    """Quotes, dashes, hyphens, the system's and the project's scannos, then the project's own passes."""
    text = join_hyphens(plain_dashes(straight_quotes(text)), allowed)
    return regex_passes(replace_scannos(replace_scannos(text, system), project), passes)


def hyphen_candidates(text: Column) -> Column:
    """Array of (prefix, suffix, char_offset, match, candidate_id) of words broken at a line end."""
    kind = "array<struct<prefix:string,suffix:string,char_offset:int,match:string,candidate_id:string>>"

    def whole(x: Column) -> Column:
        match = F.concat(x["prefix"], F.lit("-\n"), x["suffix"])
        return F.struct(*(x[c].alias(c) for c in ("prefix", "suffix", "char_offset")), match.alias("match"), candidate_id(x["prefix"], x["suffix"], x["char_offset"]).alias("candidate_id"))

    def found(t: Column) -> Column:
        out = let(F.split(t, BREAK, -1), lambda pieces: F.transform(F.array_compact(_breaks(pieces)), whole))
        return F.when(F.contains(t, F.lit("-\n")), out).otherwise(F.array().cast(kind))

    return let(text, found)


def candidate_id(prefix: Column, suffix: Column, offset: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\x00", prefix, suffix, offset.cast("string")).cast("binary")), 1, 16)


def apply_joins(text: Column, joined: Column) -> Column:
    """Joins the candidates whose ids are in the array ``joined``, each at its own place."""
    put = _joined(text, lambda x: F.array_contains(joined, candidate_id(x["prefix"], x["suffix"], x["char_offset"])))
    return F.when(joined.isNotNull(), put).otherwise(text)


def roman(n: Column) -> Column:
    """Lower-case numeral; numbers below 1 stay in digits."""
    rest, out = n, F.lit("")
    for value, letters in ROMAN:
        out = F.concat(out, F.repeat(F.lit(letters), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when(n >= 1, out).otherwise(n.cast("string"))


def alphabetic(n: Column) -> Column:
    """A to Z, other numbers in digits."""
    return F.when(n.between(1, 26), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n.cast("int"), F.lit(1))).otherwise(n.cast("string"))


def safe_slug(name: Column, fallback: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(name, r"[\\/]", "_"), r"[^a-zA-Z0-9\-._() ]", "")
    out = F.btrim(F.regexp_replace(out, r"\.{2,}", "."), F.lit(". _"))
    return F.coalesce(F.nullif(out, F.lit("")), fallback)


def file_stem(path: Column) -> Column:
    """Last segment of a path without its extension."""
    return F.regexp_replace(F.regexp_extract(F.translate(path, "\\", "/"), r"[^/]*$", 0), r"(?s)\.[^.]*$", "")


def flat_stem(path: Column) -> Column:
    """A whole path without extension, its separators doubled underscores."""
    path = F.translate(path, "\\", "/")
    return F.replace(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("/"), F.lit("__"))


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^.]*$", 0)).isin(".png", ".jpg", ".jpeg", ".jp2", ".tif", ".tiff")


def name_errors(stem: Column, ext: Column) -> Column:
    """Codes of the naming rules that a file breaks, in their fixed order."""
    return F.array_compact(
        F.array(
            F.when(F.length(stem) > 8, "basename_too_long"),
            F.when(~stem.rlike(r"\A[A-Za-z0-9_-]+\z"), "invalid_chars"),
            F.when(ext != F.lower(ext), "uppercase_ext"),
            F.when(~F.lower(ext).isin(".png", ".txt", ".jpg"), "disallowed_ext"),
            F.when(F.contains(F.lower(stem), F.lit("ad")), "ad_substring"),
        )
    )


def page_id(idx0: Column) -> Column:
    return F.format_string("%04d", idx0)
