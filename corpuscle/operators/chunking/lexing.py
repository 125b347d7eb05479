"""Masking of comments and strings, and splitting of a file into units.

Everything is an expression on the file's own row. Masks keep the number of
bytes, so unit lengths add up to byte offsets into the original text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMMENT, STRING, FENCE, NEWLINE = "\x01", "\x02", "\x03", "\x04"

_BLOCK_COMMENT = r"/\*.*?(?:\*/|\z)"
_LINE_COMMENT = r"//[^\n]*+"
_HASH_COMMENT = r"#[^\n]*+"
_DOUBLE = r'"(?:[^"\\]++|\\.)*+(?:"|\z)'
_DOUBLE_LINE = r'"(?:[^"\\\n]++|\\.)*+"?'
_SINGLE = r"'(?:[^'\\\n]++|\\.)*+'?"
_CHAR = r"'(?:\\[^\n]{1,9}?|[^'\\\n])'"
_BACKTICK = r"`(?:[^`\\]++|\\.)*+(?:`|\z)"

# style -> (comments, strings, characters that may start either)
STYLES: dict[str, tuple[list[str], list[str], str]] = {
    "c": ([_BLOCK_COMMENT, _LINE_COMMENT], [r'"""(?:[^"]++|"(?!""))*+(?:"""|\z)', _DOUBLE_LINE, _CHAR, _BACKTICK], "\"'`/"),
    "rust": ([_BLOCK_COMMENT, _LINE_COMMENT], [_DOUBLE, _CHAR], "\"'/"),
    "script": ([_BLOCK_COMMENT, _LINE_COMMENT], [_DOUBLE_LINE, _SINGLE, _BACKTICK], "\"'`/"),
    "css": ([_BLOCK_COMMENT], [_DOUBLE_LINE, _SINGLE], "\"'/"),
    "python": (
        [_HASH_COMMENT],
        [r'"""(?:[^"\\]++|\\.|"(?!""))*+(?:"""|\z)', r"'''(?:[^'\\]++|\\.|'(?!''))*+(?:'''|\z)", _DOUBLE_LINE, _SINGLE],
        "\"'#",
    ),
    "shell": ([r"(?<![\w$\{])#[^\n]*+"], [_DOUBLE, r"'[^']*+'?"], "\"'#"),
    "yaml": ([r"(?<!\S)#[^\n]*+"], [r"(?<![\w])" + _DOUBLE_LINE, r"(?<![\w])'[^'\n]*+'"], "\"'#"),
    "lua": ([r"--\[\[.*?(?:\]\]|\z)", r"--[^\n]*+"], [r"\[\[.*?(?:\]\]|\z)", _DOUBLE_LINE, _SINGLE], "\"'\\-\\["),
    "ocaml": ([r"\(\*.*?(?:\*\)|\z)"], [_DOUBLE, _CHAR], "\"'("),
    "tla": ([r"\(\*.*?(?:\*\)|\z)", r"\\\*[^\n]*+"], [_DOUBLE_LINE], "\"(\\\\"),
    "lisp": ([r";[^\n]*+"], [_DOUBLE, r"\?\\?."], "\";?"),
    "json": ([_BLOCK_COMMENT, _LINE_COMMENT], [_DOUBLE_LINE], "\"/"),
    "markdown": ([], [r"(?m)^[ ]{0,3}(?:```[^\n]*\n.*?(?:^[ ]{0,3}```[^\n]*+|\z)|~~~[^\n]*\n.*?(?:^[ ]{0,3}~~~[^\n]*+|\z))"], "`~ "),
}

_TOKENS = {
    "html": r"(?si)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>?|[^<]++",
    "template": r"(?s)<%.*?(?:%>|\z)|(?:(?!<%).)++",
}

# Most places fail at the first look behind
_CONTINUED = r"(?<=[{};\n])(?:(?<=[{};])|(?<![,(\[=|&?>.\\]\n)(?!\s*(?:[{)\].|&?+=,]|:(?!:)|(?:extends|implements|throws|where|permits|with)\b)))"
SPLITS = {
    "brace": _CONTINUED,
    "keyword": r"(?<=[\n;])",
    "indent": r"(?<=\n)(?<![,(\[{\\]\n)(?!\s*[)\]}])",
    "yaml": r"(?<=\n)",
    "heading": r"(?<=\n)",
    "paren": r"(?=\()|(?<=[)\n])",
    "json": r"(?<=[{}\[\],])",
}
PLAIN_SPLITS = [r"(?<=[\n;])", r"(?<=\n)", r"(?<=[{}\[\],])", r"(?<=[{};])", r"(?<=[{};\n])"]


def matches(text: Column, pattern: Column) -> Column:
    """Whether a pattern that comes from a column is found.

    ``rlike`` compiles such a pattern for every row, this expression only when
    it differs from the one before.
    """
    return F.regexp_instr(text, pattern) > 0


def _blot(token: Column, mark: str) -> Column:
    """The token as marks, byte for byte, with its line feeds as :data:`NEWLINE`."""
    pieces = F.transform(F.split(token, "\n"), lambda piece: F.repeat(F.lit(mark), F.octet_length(piece)))
    return F.array_join(pieces, NEWLINE)


def _unanchored(pattern: str) -> str:
    """The pattern without what it demands of the text before the token."""
    for behind in (r"(?<![\w$\{])", r"(?<!\S)", r"(?<![\w])"):
        pattern = pattern.removeprefix(behind)
    return pattern


def _whole(patterns: list[str]) -> str:
    return rf"(?s)\A(?:{'|'.join(_unanchored(p) for p in patterns)})\z" if patterns else r"\A\z"


def patterns(style: str) -> dict[str, str]:
    """Patterns of a style: all tokens, and which tokens are comments or strings."""
    if style in _TOKENS:
        return {"lex": _TOKENS[style], "comment": r"\A<!--", "string": r"\A\z"}
    comments, strings, starts = STYLES[style]
    run = rf"[^{starts}]++" if style != "markdown" else r"(?:(?!^[ ]{0,3}(?:```|~~~))[^\n]*+\n)++|[^\n]++"
    prefix = "(?sm)" if style == "markdown" else "(?s)"
    return {
        "lex": prefix + "|".join([*comments, *strings, run, "."]),
        "comment": _whole(comments),
        "string": _whole(strings) if style != "markdown" else r"\A[ ]{0,3}(?:```|~~~)[^\n]*\n",
    }


def masked(content: Column, lex: Column, comment: Column, string: Column, split: Column, mark: Column) -> Column:
    """The text with comments and strings as marks, byte for byte; null without a ``split`` pattern.

    ``mark`` is the first mark of a masked string.
    """

    def hide(token: Column) -> Column:
        text = F.concat(mark, F.substring(_blot(token, STRING), 2, 1 << 30))
        long = F.length(token) > 1
        return (
            F.when(long & matches(token, comment), _blot(token, COMMENT))
            .when(long & matches(token, string), text)
            .otherwise(token)
        )

    found = F.regexp_extract_all(content, lex, F.lit(0))
    return F.when(split.isNotNull(), F.array_join(F.transform(found, hide), ""))


def units(content: Column, lex: Column, masked: Column, split: Column) -> Column:
    """Units in order; their lengths in bytes add up to the file's. Without a ``split`` pattern the tokens are the units.

    Where every one of some characters ends a unit, whole units are matched: a split looks behind at each character.
    """
    plain = F.regexp_extract_all(content, lex, F.lit(0))
    found = F.when(split.isNull(), plain)
    for pattern in PLAIN_SPLITS:
        ends = pattern[4:-1] if pattern[4] == "\\" else pattern[5:-2]
        whole = rf"[^{ends}]*+[{ends}]|[^{ends}]++|(?<![^{ends}])\z"
        found = found.when(split == pattern, F.regexp_extract_all(masked, F.lit(whole), F.lit(0)))
    return found.otherwise(F.split(masked, split))


def newlines(unit: Column) -> Column:
    without = F.replace(F.replace(unit, F.lit("\n"), F.lit("")), F.lit(NEWLINE), F.lit(""))
    return F.octet_length(unit) - F.octet_length(without)


def idle(unit: Column) -> Column:
    """Whether a unit holds blanks and masked comments only; the first character mostly tells."""
    return (F.ascii(unit) <= 32) & F.regexp_like(unit, F.lit(r"\A[\s\x01\x04]*\z"))
