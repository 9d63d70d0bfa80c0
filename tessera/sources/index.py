"""The index: files read and parsed into three tables, kept as Parquet, refreshed by snapshot.

One row a file holds its definitions, references and call sites as arrays; the child tables are
views that explode them. A build parses files in parallel tasks; a refresh parses only files that changed. A file that
cannot be read where it is parsed, or not be parsed, has a failure and no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import content_hash
from tessera.operators.refresh import classify
from tessera.plans.shared import delete, ship, written
from tessera.sources import frontends  # noqa: F401  (registers the frontends)
from tessera.sources.languages import FRONTENDS

VERSION = "2"
UNREADABLE = "the file cannot be read here"
S, L = T.StringType(), T.LongType()


def _struct(strings: str, longs: str, *more: tuple[str, T.DataType]) -> T.ArrayType:
    return T.ArrayType(T.StructType([*(T.StructField(c, S) for c in strings.split()), *(T.StructField(c, L) for c in longs.split()), *(T.StructField(c, k) for c, k in more)]))


CHILDREN = {
    "definitions": _struct("kind name container params returns base implements snippet", "start stop sel_start sel_stop line column"),
    "references": _struct("ref_kind name container encl_name encl_kind context", "start stop sel_start sel_stop line column"),
    "calls": _struct("callee function_name snippet", "start stop line column", ("chain", T.ArrayType(S))),
}
RECORD = T.StructType([T.StructField(c, S) for c in ("root", "path", "language", "hash", "failure")] + [T.StructField("mtime", T.DoubleType()), *(T.StructField(c, L) for c in ("size", "failure_start", "failure_line", "failure_column"))] + [T.StructField(c, k) for c, k in CHILDREN.items()])
NODE = T.StructType([*(T.StructField(c, S) for c in ("root", "path", "language", "name")), *(T.StructField(c, L) for c in ("start", "stop", "depth", "line")), *(T.StructField(c, T.BooleanType()) for c in ("is_branch", "is_statement"))])


def read_text(root: str, path: str) -> str | None:
    """A local file's text; none if it cannot be read here."""
    try:
        with open(f"{root}/{path}", "rb") as f:
            return f.read().decode(errors="replace")
    except OSError:
        return None


def digest(text: str | None) -> str | None:
    return None if text is None else hashlib.sha1(text.encode(errors="replace")).hexdigest()


def parse(files: DataFrame) -> DataFrame:
    """Records of files (root, path, language, mtime, size, content; null content: a local file to read). A file that
    cannot be read or parsed has a failure and no rows; none fails the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.to_dict("records"):
                text = f["content"] if f["content"] is not None else read_text(f["root"], f["path"])
                out = frontends.Parsed(failure=UNREADABLE)
                if text is not None:
                    try:
                        out = FRONTENDS[f["language"]](text)
                    except Exception as e:  # noqa: BLE001  one file must not stop the others
                        out = frontends.Parsed(failure=f"{type(e).__name__}: {e}")
                row = {c: f[c] for c in ("root", "path", "language", "mtime", "size")} | {"hash": digest(text), "failure": out.failure, "failure_start": out.at, "failure_line": out.line, "failure_column": out.column}
                rows.append(row | {c: getattr(out, c) if out.failure is None else [] for c in CHILDREN})
            yield pd.DataFrame(rows, columns=RECORD.names)

    ship(files.sparkSession)
    return files.filter("language IS NOT NULL").select("root", "path", "language", "mtime", "size", "content").mapInPandas(run, RECORD)


def nodes(files: DataFrame) -> DataFrame:
    """The nodes that the metrics of functions count, of files parsed now; they are not kept in the index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.to_dict("records"):
                text = f["content"] if f["content"] is not None else read_text(f["root"], f["path"])
                found = FRONTENDS[f["language"]](text).nodes if text is not None else []
                yield pd.DataFrame([{c: f[c] for c in ("root", "path", "language")} | n for n in found], columns=NODE.names)

    ship(files.sparkSession)
    return files.filter("language IS NOT NULL").select("root", "path", "language", "content").mapInPandas(run, NODE)


def child(records: DataFrame, name: str) -> DataFrame:
    """definitions, references or calls of all records, a row each."""
    return records.select("root", "path", "language", F.explode(name).alias("_x")).select("root", "path", "language", "_x.*")


def diagnostics(records: DataFrame) -> DataFrame:
    code = F.when(F.col("failure") == UNREADABLE, "file_unreadable").otherwise("parse_failed")
    return records.filter("failure IS NOT NULL").select(code.alias("code"), F.lit("warning").alias("severity"), F.col("failure").alias("message"), "root", "path", "language", F.col("failure_start").alias("start"), F.col("failure_line").alias("line"), F.col("failure_column").alias("column"))


def workspace_fingerprint(root: str, exclusions: list[str]) -> str:
    return hashlib.sha1(json.dumps({"root": root, "exclusions": sorted(set(exclusions)), "version": VERSION}, separators=(",", ":")).encode()).hexdigest()


def aggregate_fingerprint(fingerprints: list[str]) -> str | None:
    """Of several roots: a fingerprint of theirs, in order; of one, its own."""
    if len(fingerprints) < 2:
        return fingerprints[0] if fingerprints else None
    return hashlib.sha1(json.dumps(fingerprints, separators=(",", ":")).encode()).hexdigest()


class Store:
    """Records of workspaces below one folder; each save is a new generation, and the newest manifest names the current one.
    The generation before stays, as answers may still read it; older ones, and those of another version or with another
    number of rows than their manifest says, are deleted."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.last: dict = {"status": "missing"}

    def manifest(self, fingerprint: str) -> dict | None:
        """The newest manifest, whatever its version; none if there is none."""
        try:
            rows = self.spark.read.json(f"{self.folder}/manifests/fingerprint={fingerprint}").orderBy(F.desc("generation")).limit(1).collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
                return None
            raise
        return rows[0].asDict() if rows else None

    def clear(self, fingerprint: str) -> None:
        delete(self.spark, f"{self.folder}/manifests/fingerprint={fingerprint}")
        delete(self.spark, f"{self.folder}/records/{fingerprint}")

    def load(self, fingerprint: str) -> DataFrame | None:
        """The records, or none; `last` says how it went: loaded, missing, schema_mismatch or invalid."""
        m = self.manifest(fingerprint)
        if m is None:
            self.last = {"status": "missing"}
            return None
        if m["version"] != VERSION:
            self.clear(fingerprint)
            self.last = {"status": "schema_mismatch", "expected": VERSION, "actual": m["version"]}
            return None
        try:
            records = self.spark.read.schema(RECORD).parquet(f"{self.folder}/records/{fingerprint}/{m['generation']}")
            found = records.count()
        except Exception as e:  # noqa: BLE001  whatever is wrong with the files, the index is built anew
            found = str(e)
        if found != m["files"]:
            self.clear(fingerprint)
            self.last = {"status": "invalid", "reason": f"the manifest has {m['files']} records, the files {found}"}
            return None
        self.last = {"status": "loaded"}
        return records

    def save(self, fingerprint: str, records: DataFrame, state: str, now: str | None = None) -> DataFrame:
        generation = ((self.manifest(fingerprint) or {}).get("generation") or 0) + 1
        path = f"{self.folder}/records/{fingerprint}/{generation}"
        records.write.mode("overwrite").parquet(path)
        saved = self.spark.read.schema(RECORD).parquet(path)
        facts = [(VERSION, generation, state, now or datetime.now(UTC).isoformat(), saved.count())]
        self.spark.createDataFrame(facts, "version string, generation long, state string, saved_at string, files long").coalesce(1).write.mode("append").json(f"{self.folder}/manifests/fingerprint={fingerprint}")
        if generation > 2:
            delete(self.spark, f"{self.folder}/records/{fingerprint}/{generation - 2}")
        return saved


def hashed(files: DataFrame) -> DataFrame:
    """root, path, mtime, size and the SHA-1 of the content of files; null for what cannot be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(hash=[digest(read_text(r, p)) for r, p in zip(batch["root"], batch["path"], strict=True)])

    ship(files.sparkSession)
    held = files.filter("content IS NOT NULL").select("root", "path", "mtime", "size", content_hash(F.col("content")).alias("hash"))
    local = files.filter("content IS NULL").select("root", "path", "mtime", "size")
    return local.mapInPandas(run, "root string, path string, mtime double, size long, hash string").unionByName(held)


def snapshots(files: DataFrame, old: DataFrame, stat_only: bool) -> DataFrame:
    """root, path, mtime, size and hash of files now. With stat_only, those whose time and size have not changed are not
    read: their hash counts as what it was."""
    if not stat_only:
        return hashed(files)
    known = old.select("root", "path", F.struct("mtime", "size").alias("was"), F.col("hash").alias("known"))
    both = files.join(known, ["root", "path"], "left")
    same = F.coalesce(F.col("was") == F.struct("mtime", "size"), F.lit(False))
    return both.filter(same).select("root", "path", "mtime", "size", F.col("known").alias("hash")).unionByName(hashed(both.filter(~same)))


def refresh(store: Store, fingerprint: str, files: DataFrame, stat_only: bool = False) -> tuple[DataFrame, DataFrame | None, str]:
    """Records that are up to date, what changed (root, path, status; none for a first build) and the freshness state.

    A file is unchanged if time, size and hash are equal; the others are parsed anew, removed ones leave.
    """
    old = store.load(fingerprint)
    worse = lambda records, state: "degraded" if not records.filter("failure IS NOT NULL").isEmpty() else state
    if old is None:
        built = store.save(fingerprint, parse(files), "fresh")
        return built, None, worse(built, "fresh")
    known = files.filter("language IS NOT NULL")
    changes = written(classify(old.select("root", "path", "mtime", "size", "hash"), snapshots(known, old, stat_only)).filter("status <> 'unchanged'"), "changes")
    if changes.isEmpty():
        return old, changes, worse(old, "fresh")
    parsed = parse(known.join(changes.filter("status <> 'removed'"), ["root", "path"], "left_semi"))
    kept = old.join(changes, ["root", "path"], "left_anti")
    saved = store.save(fingerprint, kept.select(*RECORD.names).unionByName(parsed), "refreshed")
    return saved, changes, worse(saved, "refreshed")
