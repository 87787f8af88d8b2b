"""Column functions over message text; all stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode white space; "\\s" alone means ASCII in Java.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + (
    "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE = r"\s\x1C-\x1F"
_LINK = rf"(?U)http[^{_SPACE}]+|www[^{_SPACE}]+"
# Every run of white space except a single blank, which would be replaced by itself.
_UNEVEN = rf"(?U)[{_SPACE}&&[^ ]][{_SPACE}]*| [{_SPACE}]+"
WORD = r"[\p{L}\p{N}_]"
TOKEN = WORD + "{2,}"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


def clean_text(col: Column) -> Column:
    """Drop links, collapse white space; null becomes the empty string.

    Texts without a link skip the link pattern: a substring test is far cheaper.
    """
    text = F.coalesce(col, F.lit(""))
    linked = F.contains(text, F.lit("http")) | F.contains(text, F.lit("www"))
    unlinked = F.when(linked, F.regexp_replace(text, _LINK, "")).otherwise(text)
    return F.trim(F.regexp_replace(unlinked, _UNEVEN, " "))


def with_clean_text(df: DataFrame, source: str, name: str) -> DataFrame:
    """Add the cleaned text as a column that is computed once.

    A filter on a projected column gets a copy of its expression, which would clean every
    text twice. A row of an exploded one-element array is no expression to copy.
    """
    return df.select("*", F.explode(F.array(clean_text(F.col(source)))).alias(name))


def word_count(cleaned: Column) -> Column:
    """Words of a text that went through :func:`clean_text`."""
    return F.when(cleaned == "", 0).otherwise(F.size(F.split(cleaned, " ")))


def rewrite_shortlinks(col: Column, domains: Sequence[str], target: str) -> Column:
    hosts = "|".join(d.replace(".", r"\.") for d in domains)
    return F.regexp_replace(col, rf"(?U)https?://(?:{hosts})/[^{_SPACE}]+", target)


def straighten_quotes(col: Column) -> Column:
    return F.translate(col, "‘’“”", "''\"\"")


def split_ids(col: Column) -> Column:
    """Comma list of ids to an array of trimmed, non-empty ids."""
    parts = F.transform(F.split(col, ","), lambda part: strip(part))
    return F.filter(parts, lambda part: part != "")


def first_id(col: Column) -> Column:
    return F.nullif(strip(F.split_part(col, F.lit(","), F.lit(1))), F.lit(""))


def is_blank(col: Column) -> Column:
    """Null, white space only, or the text ``nan`` left behind by a CSV round trip."""
    text = strip(F.coalesce(col.cast("string"), F.lit("")))
    return (text == "") | (text == "nan")


def parse_flag(col: Column) -> Column:
    """Text to boolean; anything but true/false/1/0 is null."""
    text = F.lower(strip(col.cast("string")))
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


def contains_any(lowered: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(lowered, F.lit(word))
    return hit


def keyword_hits(lowered: Column, words: Sequence[str]) -> Column:
    """Words found in the text, in list order.

    Written as one flat array so that generated code lowers the text once.
    """
    return F.array_compact(
        F.array(*[F.when(F.contains(lowered, F.lit(w)), F.lit(w)) for w in words])
    )


def _is_whole_word(pattern: str) -> bool:
    """Bounded by word boundaries on both sides, with no alternative outside brackets."""
    depth = 0
    plain = re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]])*\]", "", pattern, flags=re.DOTALL)  # no escapes, no classes
    for char in plain:
        depth += {"(": 1, ")": -1}.get(char, 0)
        if char == "|" and depth == 0:
            return False
    return pattern.startswith(r"\b") and pattern.endswith(r"\b")


def _first_letters(words: Sequence[str]) -> str:
    """Lookahead for the letter each pattern must begin with; empty if one has no such letter."""
    if all(w[:1].isalnum() and w[1:2] not in ("?", "*", "{") for w in words):
        return f"(?=[{''.join(sorted({w[0] for w in words}))}])"
    return ""


def matches_any(lowered: Column, patterns: Sequence[str]) -> Column:
    """One regex pass for all patterns that lead to the same outcome.

    Only a line feed ends a line for ``.``. Patterns of whole words share one test of the
    word boundary, which is spelled out because what ``\\b`` means depends on the JVM. Most
    places in a text are ruled out by their letter alone.
    """
    if all(_is_whole_word(p) for p in patterns):
        words = [p.removeprefix(r"\b").removesuffix(r"\b") for p in patterns]
        start = f"{_first_letters(words)}(?<!{WORD})"
        return lowered.rlike(rf"(?d){start}(?:{'|'.join(words)})(?!{WORD})")
    return lowered.rlike("(?Ud)" + "|".join(f"(?:{p})" for p in patterns))


def tokens(col: Column) -> Column:
    """Lower-cased words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(TOKEN), F.lit(0))


def decimals(col: Column, digits: int = 2) -> Column:
    """A number as text with fixed decimals, rounded half up on its decimal value."""
    return F.round(col.cast("decimal(20,6)"), digits).cast("string")
