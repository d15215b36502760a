"""String columns with Python's notions of lines, white space, letters and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and line ends as str.isspace and str.splitlines see them, as contents of a Java character class.
BLANK = r"\t\x0b\f\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = BLANK + r"\n"
BREAKS = r"\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029"
LINE_END = rf"\r\n|[{BREAKS}]"
#: White space that doesn't end a line.
INNER = r"\t\x1f\x20\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
WORD_CHAR = r"\p{L}\p{N}_"
#: Nd, and the superscript and subscript digits that str.isdigit counts as well.
DIGIT = r"\p{Nd}\u00b2\u00b3\u00b9\u2070\u2074-\u2079\u2080-\u2089"


def quote(text: str) -> str:
    """A regular expression for exactly this text, valid for Java and RE2."""
    return "".join(c if c.isalnum() or c in "_ " else f"\\x{{{ord(c):x}}}" for c in text)


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def unescape_newlines(text: Column) -> Column:
    r"""Literal \r\n and \n, and real CR LF, become line feeds."""
    for old in ("\\r\\n", "\\n", "\r\n"):
        text = F.replace(text, F.lit(old), F.lit("\n"))
    return text


def escape_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACES}]+", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{SPACES}]++\z", "")


def split_lines(text: Column) -> Column:
    """The lines of a text; none for the empty one, and none after a final line end."""
    even = F.regexp_replace(text, LINE_END, "\n")
    return F.when(even == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(even, r"\n\z", ""), "\n"))


def count_chars(text: Column, contents: str) -> Column:
    """How many characters of a character class a text has."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{contents}]++", ""))


def count_substring(text: Column, token: str) -> Column:
    """Non-overlapping occurrences, from the left."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("long")


def has_word(text: Column, word: str, ascii_only: bool = False) -> Column:
    """Whether the word occurs with no letter, digit or underscore next to it; the literal is searched before its neighbours are looked at."""
    near = "A-Za-z0-9_" if ascii_only else WORD_CHAR
    if not word:
        return F.lit(False)
    w = quote(word)
    return F.contains(text, F.lit(word)) & text.rlike(f"{w}(?![{near}])(?<![{near}]{w})")


def has_regex(text: Column, pattern: str, ascii_only: bool = False) -> Column:
    """Search with Python's multi-line, Unicode meaning, or with a browser's, whose words are ASCII and whose lines end at carriage returns too."""
    return text.rlike(f"(?{'m' if ascii_only else 'dmU'}){pattern}")


def line_starts_with(text: Column, prefix: str) -> Column:
    """A line that starts so after its indent; blank lines before it may be skipped along with the indent."""
    return F.contains(text, F.lit(prefix)) & text.rlike(rf"(?:\A|[{BREAKS}])[{SPACES}]*+{quote(prefix)}")


def has_indent_colon(text: Column) -> Column:
    """A line that ends in a colon once its comment and trailing space are gone."""
    return text.rlike(rf"(?:\A|[{BREAKS}])[^#{BREAKS}]*:[{INNER}]*(?:#|\z|[{BREAKS}])")


def has_leading_indent(text: Column, width: int) -> Column:
    if width <= 0:
        return F.lit(False)
    return text.rlike(rf"(?:\A|[{BREAKS}]) {{{width}}}[{INNER}]*+[^{SPACES}]")


def yaml_key_value(text: Column) -> Column:
    """A line `key: ` whose key is letters and digits besides - and _."""
    return text.rlike(rf"(?:\A|[{BREAKS}])[{SPACES}]*+[\p{{L}}\p{{N}}_-]*[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_-]*: ")


def word_tokens(text: Column, longer_than: int = 4) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit("([A-Za-z_]+)"), F.lit(1)), lambda x: F.length(x) > longer_than)


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """ASCII substrings of low to high characters that neither start nor end with white space, in one linear scan a length."""
    edge, every = r"[\x00-\x08\x0e-\x1b\x21-\x7f]", r"[\x00-\x7f]"
    shapes = [edge if n == 1 else f"{edge}{every}{{{n - 2}}}{edge}" for n in range(low, high + 1)]
    return F.concat(*[F.regexp_extract_all(text, F.lit(f"(?=({shape}))"), F.lit(1)) for shape in shapes])


def preview(text: Column, lines: int = 2) -> Column:
    return F.array_join(F.slice(split_lines(unescape_newlines(text)), 1, lines), "\n")


def signature_window(text: Column, lines: int = 8) -> Column:
    """The lines from the first function definition on."""
    every = split_lines(text)
    defs = F.transform(every, lambda x: x.rlike(r"(?dU)^\s*(?:async\s+def|def)\s+\S+"))
    return F.array_join(F.slice(every, F.greatest(F.array_position(defs, True), F.lit(1)).cast("int"), lines), "\n")
