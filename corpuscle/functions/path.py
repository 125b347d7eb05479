"""Path expressions and the extension rules built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that are never read as text.
BINARY_EXTENSIONS = """
.png .jpg .jpeg .gif .bmp .ico .svg .webp .tiff
.mp4 .avi .mov .wmv .flv .mkv
.mp3 .wav .ogg .flac .aac
.zip .tar .gz .rar .7z .bz2
.exe .dll .so .dylib .bin .class .pyc .o .a
.pdf .doc .docx .xls .xlsx .ppt .pptx
.ttf .otf .woff .woff2 .eot
.db .sqlite .sqlite3
.wasm .lock
""".split()


def file_type(path: Column) -> Column:
    """Extension of the base name, case kept; '' for dot files and names without a dot."""
    base = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_extract(base, r"^.+(\.[^.]*)$", 1)


def extname_lower(path: Column) -> Column:
    return F.lower(file_type(path))


def last_dot_suffix(path: Column) -> Column:
    """Lower-cased text from the last dot of the whole path; all of it without a dot."""
    lowered = F.lower(path)
    return F.when(lowered.contains("."), F.regexp_extract(lowered, r"(\.[^.]*)\z", 1)).otherwise(lowered)


def is_binary_path(path: Column) -> Column:
    return last_dot_suffix(path).isin(BINARY_EXTENSIONS)
