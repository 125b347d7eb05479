"""Text expressions: cleaning, embedding preparation, token estimates, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space class of ECMAScript regular expressions.
WHITE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WHITE_CHARS = "\t\n\x0b\f\r \xa0" + "".join(
    chr(c) for c in [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
)
# Control characters removed from stored text (tab, LF and CR stay).
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
# Four characters count as one token, 8000 tokens are the model's limit.
CHARS_PER_TOKEN = 4
MAX_TOKENS = 8000


def sanitize(text: Column) -> Column:
    """Drop NUL and other control characters that text stores refuse."""
    return F.regexp_replace(text, CONTROL, "")


def is_blank(text: Column) -> Column:
    """True for text of white space only (null stays null)."""
    return text.rlike(rf"\A[{WHITE}]*\z")


def embed_prep(text: Column) -> Column:
    """Text as sent to the embedder.

    Runs of white space at both ends vanish and inner line feeds turn into
    blanks. A lone line feed at either end turns into a blank too. Trimming by
    a set of characters looks at the ends only, unlike a regular expression.
    """
    no_head = F.ltrim(text, F.lit(WHITE_CHARS))
    body = F.rtrim(no_head, F.lit(WHITE_CHARS))
    lone_head = text.startswith("\n") & (F.length(text) - F.length(no_head) == 1)
    lone_tail = no_head.endswith("\n") & (F.length(no_head) - F.length(body) == 1)

    def blank(lone: Column) -> Column:
        return F.when(lone, " ").otherwise("")

    return F.concat(blank(lone_head), F.replace(body, F.lit("\n"), F.lit(" ")), blank(lone_tail))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("long")


def truncate_tokens(text: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """The embedder's own input limit: longer text is cut to the limit's characters.

    Text within the limit has no more characters than that, so one cut serves both.
    """
    return F.substring(text, 1, max_tokens * CHARS_PER_TOKEN)


def split_lines(text: Column) -> Column:
    """Lines without the empty ones."""
    return F.filter(F.split(text, "\n"), lambda line: line != "")


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def preview(text: Column, chars: int = 80) -> Column:
    return F.substring(text, 1, chars)
