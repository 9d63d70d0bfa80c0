"""The language table, and the frontends registered for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Extensions of each language (fixed values).
LANGUAGES: dict[str, tuple[str, ...]] = {
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".h++"),
    "csharp": (".cs",),
    "go": (".go",),
    "java": (".java",),
    "javascript": (".cjs", ".js", ".jsx", ".mjs"),
    "python": (".py",),
    "rust": (".rs",),
    "tsx": (".tsx",),
    "typescript": (".cts", ".mts", ".ts"),
}
FRONTENDS: dict[str, Callable] = {}


def register(language: str, frontend: Callable, extensions: tuple[str, ...] = ()) -> None:
    """Adds a frontend; a language or an extension that is taken is an error."""
    if language in FRONTENDS:
        raise ValueError(f"language {language!r} is registered already")
    taken = {e for k, v in LANGUAGES.items() if k != language for e in v}
    if clash := taken & {e.lower() for e in extensions}:
        raise ValueError(f"extensions {sorted(clash)} are registered already")
    FRONTENDS[language] = frontend
    if extensions:
        LANGUAGES[language] = tuple(e.lower() for e in extensions)


def language_of(path: str) -> str | None:
    dot = path.rsplit("/", 1)[-1].rfind(".")
    ext = path.rsplit("/", 1)[-1][dot:].lower() if dot >= 0 else ""
    return next((k for k, v in LANGUAGES.items() if ext in v), None)


def languages(spark: SparkSession) -> DataFrame:
    """(language, extension), small enough to broadcast."""
    return spark.createDataFrame([(k, e) for k, v in sorted(LANGUAGES.items()) for e in v], "language string, extension string")
