"""Discovery of source files below workspace roots, their snapshots, and the driver-side rules about roots and paths."""

from __future__ import annotations

import os
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import excluded, extension
from tessera.sources.languages import languages

#: Exclusions of every workspace (fixed values).
EXCLUSIONS = ["node_modules", ".git", "dist", "build", "coverage", ".next", ".turbo", "out", "vendor", "vendors", "generated", "__generated__", "__pycache__", ".venv", "venv"]
FILES = "root string, path string, mtime double, size long, content string"


class RequestError(ValueError):
    """A request that cannot be answered; code is one of the diagnostics' codes."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def absolute(root: str) -> str:
    return root.rstrip("/") if "://" in root else os.path.abspath(root)


def resolve_roots(root: str | None = None, roots: list[str] | None = None) -> list[str]:
    """Absolute roots in order, once each; one that is no folder is an error. URIs of stores stay as they are."""
    out = list(dict.fromkeys(absolute(r) for r in ([root] if root else []) + list(roots or [])))
    if not out:
        raise RequestError("workspace_root_invalid", "a workspace needs a root")
    for r in out:
        if "://" not in r and not os.path.isdir(r):
            raise RequestError("workspace_root_invalid", f"{r} is no folder")
    return out


def inside(root: str, path: str) -> str:
    """path relative to root, with forward slashes; one outside is an error."""
    path = path.replace("\\", "/")
    rel = os.path.relpath(path, root).replace(os.sep, "/") if posixpath.isabs(path) else posixpath.normpath(path)
    if rel == ".." or rel.startswith("../"):
        raise RequestError("workspace_path_out_of_scope", f"{path} lies outside {root}")
    return rel


def prefix_of(prefix: str | None, roots: list[str]) -> str | None:
    """A path prefix relative to the root that owns it (relative ones: the first root); none for the root itself."""
    if not prefix or not prefix.strip():
        return None
    prefix = prefix.strip().replace("\\", "/")
    owner = roots[0]
    if posixpath.isabs(prefix):
        owners = [r for r in roots if prefix == r or prefix.startswith(r.rstrip("/") + "/")]
        owner = max(owners, key=len, default=roots[0])
    rel = inside(owner, prefix)
    return None if rel == "." else rel


def chosen_roots(wanted: list[str] | None, roots: list[str]) -> list[str]:
    """Roots of a request, checked against the workspace; none means all."""
    out = list(dict.fromkeys(absolute(r) for r in wanted or [] if r.strip()))
    for r in out:
        if r not in roots:
            raise RequestError("workspace_root_invalid", f"{r} is no root of this workspace")
    return out


def listed(root: str, exclusions: list[str]) -> list[tuple[str, str, float, int]]:
    """Files below a root; excluded folders are not entered, links are not followed."""
    words, paths = {p for p in exclusions if "/" not in p}, [p.strip("/") for p in exclusions if "/" in p]
    gone = lambda rel: any(s in words for s in rel.split("/")) or any(rel == p or rel.startswith(p + "/") or f"/{p}/" in f"/{rel}/" for p in paths)
    out = []
    for top, folders, names in os.walk(root):  # sorted by relative path below
        at = os.path.relpath(top, root).replace(os.sep, "/")
        join = lambda name, at=at: name if at == "." else f"{at}/{name}"
        folders[:] = sorted(f for f in folders if not gone(join(f)) and not os.path.islink(os.path.join(top, f)))
        for name in sorted(names):
            full = os.path.join(top, name)
            if not gone(join(name)) and os.path.isfile(full) and not os.path.islink(full):
                stat = os.stat(full)
                out.append((root, join(name), stat.st_mtime * 1000, stat.st_size))
    return sorted(out, key=lambda x: x[1])


def discover(spark: SparkSession, roots: list[str], exclusions: list[str] | None = None) -> DataFrame:
    """Files of all roots: root, path, mtime, size, content (null: a local file, read where it is parsed), language
    (null: unsupported) and reason."""
    skip = [*EXCLUSIONS, *(exclusions or [])]
    out = spark.createDataFrame([(*x, None) for r in roots if "://" not in r for x in listed(r, skip)], FILES)
    for uri in (r for r in roots if "://" in r):
        out = out.unionByName(stored(spark, uri, skip))
    return with_language(out)


def stored(spark: SparkSession, uri: str, exclusions: list[str]) -> DataFrame:
    """Files of a store that only Spark reads, with their contents; listing, reading and filter are distributed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri)
    path = F.regexp_replace(F.element_at(F.split("path", "://?/?"), -1), "^/+", "")
    below = F.substring(path, F.lit(len(uri.split("://", 1)[1].strip("/")) + 2), F.length(path))
    rows = found.select(F.lit(uri).alias("root"), below.alias("path"), (F.unix_micros("modificationTime") / 1000).alias("mtime"), F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return rows.filter(~excluded(F.col("path"), exclusions))


def with_language(files: DataFrame) -> DataFrame:
    known = F.broadcast(languages(files.sparkSession))
    out = files.withColumn("extension", extension(F.col("path"))).join(known, "extension", "left")
    return out.withColumn("reason", F.when(F.col("language").isNull(), F.concat(F.lit("no language has the extension '"), "extension", F.lit("'"))))
