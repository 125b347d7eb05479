"""Languages and their file extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import path as P

# Language -> extensions that select it.
EXTENSIONS = {
    "typescript": [".ts", ".mts", ".cts"],
    "tsx": [".tsx"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "python": [".py", ".pyw", ".pyi"],
    "java": [".java"],
    "kotlin": [".kt", ".kts"],
    "scala": [".scala", ".sc"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hxx", ".hh", ".c++", ".h++"],
    "csharp": [".cs"],
    "objc": [".m", ".mm"],
    "go": [".go"],
    "rust": [".rs"],
    "zig": [".zig"],
    "swift": [".swift"],
    "dart": [".dart"],
    "ruby": [".rb", ".rake", ".gemspec"],
    "php": [".php", ".phtml", ".php5", ".php7"],
    "lua": [".lua"],
    "elixir": [".ex", ".exs"],
    "ocaml": [".ml", ".mli"],
    "rescript": [".res", ".resi"],
    "solidity": [".sol"],
    "html": [".html", ".htm", ".xhtml"],
    "css": [".css"],
    "vue": [".vue"],
    "embedded_template": [".erb", ".ejs", ".eta"],
    "json": [".json", ".jsonc"],
    "yaml": [".yml", ".yaml"],
    "toml": [".toml"],
    "markdown": [".md", ".markdown", ".mdx"],
    "bash": [".sh", ".bash", ".zsh", ".fish"],
    "elisp": [".el", ".elc"],
    "tlaplus": [".tla"],
    "systemrdl": [".rdl"],
}


def dimension(spark: SparkSession) -> DataFrame:
    """``(ext, language)``; an extension listed twice belongs to the first language."""
    first: dict[str, str] = {}
    for language, extensions in EXTENSIONS.items():
        for ext in extensions:
            first.setdefault(ext, language)
    return spark.createDataFrame(list(first.items()), "ext string, language string")


def detect(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with ``ext`` and ``language``, null where no language serves the extension.

    The dimension is a fixed list of a few dozen rows, so it is always broadcast.
    """
    with_ext = files.withColumn("ext", P.extname_lower(F.col(path)))
    return with_ext.join(F.broadcast(dimension(files.sparkSession)), "ext", "left")


def supported(files: DataFrame, path: str = "path") -> DataFrame:
    return detect(files, path).where(F.col("language").isNotNull())


def by_language(spark: SparkSession) -> DataFrame:
    """Number of extensions per language."""
    return dimension(spark).groupBy("language").agg(F.count(F.lit(1)).alias("extensions"))
