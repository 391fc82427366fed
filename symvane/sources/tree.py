"""Scans of source trees: ignore rules on the driver, contents on the executors."""

from __future__ import annotations

import fnmatch
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Directories never scanned, and languages by file ending.
SKIPPED = {"node_modules", "target", "dist", "build", "vendor", ".git"}
LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "lua": "lua", "sh": "shell", "sql": "sql", "ex": "elixir", "hs": "haskell", "zig": "zig", "r": "r", "clj": "clojure", "kt": "kotlin", "swift": "swift", "scala": "scala"}
#: Largest file read, and longest first line of one not taken for minified.
MOST_BYTES, LONGEST_LINE = 2_000_000, 2_000


class Ignore:
    """Rules of one ignore file, the last that matches decides."""

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep, only_dirs = line.startswith("!"), line.endswith("/")
            body = line.lstrip("!").strip("/")
            anchored = "/" in line.lstrip("!").rstrip("/")
            form = "".join("(?:.*/)?" if p == "**/" else ".*" if p == "**" else "[^/]*" if p == "*" else "[^/]" if p == "?" else re.escape(p) for p in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", body))
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + form + r"(?:/.*)?$"), keep, only_dirs))

    def ignores(self, path: str, is_dir: bool) -> bool:
        out = False
        for pattern, keep, only_dirs in self.rules:
            if pattern.match(path) and (is_dir or not only_dirs or "/" in path and pattern.match(os.path.dirname(path))):
                out = not keep
        return out


def walk(root: str) -> list[tuple[str, int]]:
    """Relative paths and sizes of the files of a tree, sorted: no hidden files or links, nothing ignored."""
    rules, out = [], []
    for here, dirs, names in os.walk(root):
        rel = os.path.relpath(here, root).replace(os.sep, "/")
        prefix = "" if rel == "." else rel + "/"
        ignore = os.path.join(here, ".gitignore")
        if os.path.isfile(ignore):
            rules.append((prefix, Ignore(open(ignore, encoding="utf-8", errors="replace").read())))
        mine = [(p, r) for p, r in rules if prefix.startswith(p)]
        dropped = lambda name, is_dir: any(r.ignores((prefix + name)[len(p) :], is_dir) for p, r in mine)
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d not in SKIPPED and not os.path.islink(os.path.join(here, d)) and not dropped(d, True))
        for name in names:
            full = os.path.join(here, name)
            if not name.startswith(".") and not os.path.islink(full) and not dropped(name, False) and not fnmatch.fnmatch(name, "*.min.js"):
                size = os.path.getsize(full)
                if size <= MOST_BYTES:
                    out.append((prefix + name, size))
    return sorted(out)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, language) of a tree."""
    language = lambda p: LANGUAGES.get(p.rsplit(".", 1)[-1].lower(), "text")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("language", T.StringType())])
    return spark.createDataFrame([(p, n, language(p)) for p, n in walk(root)], schema)


def read_files(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Contents as (path, text) and, beside them, (path, reason) of files that are no text or look minified."""
    base = os.path.abspath(root).rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace(F.col("path"), "^file:/*" + re.escape(base.lstrip("/")) + "/", "")
    held = raw.select(F.url_decode(rel).alias("path"), "content").join(list_files(spark, root).select("path"), "path", "left_semi")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    told = held.select("path", text.alias("text"))
    first = F.substring_index("text", "\n", 1)
    reason = F.when(F.col("text").isNull() | F.contains(F.coalesce("text", F.lit("")), F.lit("\0")), "not text").when(F.length(first) > LONGEST_LINE, "minified")
    judged = told.withColumn("reason", reason)
    return judged.filter("reason IS NULL").select("path", "text"), judged.filter("reason IS NOT NULL").select("path", "reason")


def slices(symbols: DataFrame, files: DataFrame, contents: DataFrame) -> DataFrame:
    """Source of symbols by byte offsets: (id, source), only where the content still has the stored hash.

    Offsets that cut a character in two give no row.

    symbols: (id, file_id, start_byte, end_byte); files: (file_id, path, hash); contents: (path, content, hash).
    """
    fresh = files.join(contents, ["path", "hash"])
    cut = F.substring(F.col("content").cast("binary"), F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte"))
    return symbols.join(fresh, "file_id").select("id", F.try_validate_utf8(cut.cast("string")).alias("source")).filter("source IS NOT NULL")


def write_atomically(path: str, text: str) -> None:
    """Write a file whole or not at all."""
    part = f"{path}.part-{os.getpid()}"
    with open(part, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
