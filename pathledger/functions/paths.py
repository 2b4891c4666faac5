"""Path expressions: every function maps Columns to a Column and stays in the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Folder names whose content is rebuilt, never stored.
DERIVED_NAMES = ["node_modules", "target", ".next", "venv", ".venv"]
# Names the desktop writes by itself.
JUNK_NAMES = [".DS_Store", "Thumbs.db", "desktop.ini"]
# Extensions of large binary content.
LARGE_BINARY_EXTENSIONS = [
    "7z", "avi", "bin", "bmp", "bz2", "db", "docx", "flac", "gif", "gz", "ico", "jpeg", "jpg",
    "mkv", "mov", "mp3", "mp4", "ogg", "parquet", "pdf", "png", "pptx", "rar", "sqlite", "sqlite3",
    "tar", "tiff", "wav", "webm", "webp", "xlsx", "xz", "zip", "zst",
]
LARGE_BINARY_BYTES = 1 << 20


def parts(p: Column) -> Column:
    return F.split(p, "/")


def depth(p: Column) -> Column:
    return F.size(F.filter(parts(p), lambda c: c != ""))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.astype(object).str.normalize("NFC") if s.notna().any() else s


def casefold_key(p: Column) -> Column:
    """lower(NFC(p)). ASCII paths are in that form already and reach the Python worker as nulls."""
    return F.lower(F.coalesce(nfc(F.when(F.octet_length(p) != F.length(p), p)), p))


def canonicalize(p: Column) -> Column:
    """Lexical normal form below the root; null if the path climbs above it or is absolute."""
    steps = F.filter(parts(F.translate(p, "\\", "/")), lambda c: (c != "") & (c != "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("escaped"))
    folded = F.aggregate(
        steps,
        start,
        lambda acc, c: F.when(c != "..", F.struct(F.concat(acc["kept"], F.array(c)).alias("kept"), acc["escaped"].alias("escaped"))).otherwise(
            F.struct(
                F.slice(acc["kept"], F.lit(1), F.greatest(F.size(acc["kept"]) - 1, F.lit(0))).alias("kept"),
                (acc["escaped"] | (F.size(acc["kept"]) == 0)).alias("escaped"),
            )
        ),
    )
    return F.when(~folded["escaped"] & ~p.startswith("/"), F.array_join(folded["kept"], "/"))


def is_trusted(p: Column) -> Column:
    """Non-empty, relative, no NUL and no empty, `.` or `..` component."""
    bad = F.exists(parts(p), lambda c: c.isin("", ".", ".."))
    return (p != "") & ~p.startswith("/") & (F.instr(p, "\0") == 0) & ~bad


def is_unsyncable(p: Column) -> Column:
    """A component that another system cannot hold: a backslash, or a drive-like second byte."""
    return F.exists(parts(p), lambda c: c.contains("\\") | (F.substring(c, 2, 1) == ":"))


def symlink_target_ok(p: Column, target: Column) -> Column:
    """The target is relative and, walked from the link's folder, never leaves the root."""
    start = F.struct(depth(p).cast("int").alias("d"), F.lit(False).alias("out")).withField("d", (depth(p) - 1).cast("int"))
    walked = F.aggregate(
        F.filter(parts(target), lambda c: ~c.isin("", ".")),
        start,
        lambda acc, c: F.struct(
            (acc["d"] + F.when(c == "..", -1).otherwise(1)).cast("int").alias("d"),
            (acc["out"] | ((c == "..") & (acc["d"] <= 0))).alias("out"),
        ),
    )
    drive = F.substring(target, 2, 1) == ":"
    return (target != "") & ~target.startswith("/") & ~drive & (F.instr(target, "\0") == 0) & ~walked["out"]


def symlink_policy(p: Column, target: Column) -> Column:
    return F.when(symlink_target_ok(p, target), "preserve").otherwise("local_only")


def is_derived(p: Column) -> Column:
    return F.arrays_overlap(parts(p), F.array(*map(F.lit, DERIVED_NAMES)))


def classify(p: Column, is_symlink: Column, is_dir: Column) -> Column:
    return F.when(is_derived(p), 2).when(is_symlink, 1).when(is_dir, 3).otherwise(0).cast("tinyint")


def base_name(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def is_junk(p: Column) -> Column:
    return base_name(p).isin(JUNK_NAMES) | base_name(p).rlike(r"^\..+\.ft-tmp$")


def under_prefix(p: Column, q: Column) -> Column:
    return (p == q) | p.startswith(F.concat(q, F.lit("/")))


def ancestors(p: Column) -> Column:
    """The path itself and every folder above it: turns a prefix join into an equi-join."""
    return F.transform(F.sequence(F.lit(1), F.size(parts(p))), lambda i: F.array_join(F.slice(parts(p), F.lit(1), i), "/"))


def is_large_binary(p: Column, size: Column) -> Column:
    ext = F.lower(F.regexp_extract(base_name(p), r"\.([^.]*)$", 1))
    return (size >= LARGE_BINARY_BYTES) & ext.isin(LARGE_BINARY_EXTENSIONS)


def valid_object_key(k: Column) -> Column:
    bad = F.exists(parts(k), lambda c: c.isin("", ".", "..") | c.startswith(".ft-tmp-"))
    return (k != "") & ~k.contains("\\") & ~k.startswith("/") & (F.instr(k, "\0") == 0) & (F.substring(k, 2, 1) != ":") & ~bad


def object_key(prefix: str, cid: Column) -> Column:
    """prefix/aa/hex: the first two digits fan the keys out."""
    return F.concat_ws("/", F.lit(prefix), F.substring(cid, 1, 2), cid)


def parse_object_key(k: Column) -> Column:
    """Family and id of a well-formed object key, else null: the shard must be the id's first two digits."""
    family = F.regexp_extract(k, r"^(blocks|manifest|blocklists)/([0-9a-f]{2})/([0-9a-f]{64})$", 1)
    shard, cid = (F.regexp_extract(k, r"^(?:blocks|manifest|blocklists)/([0-9a-f]{2})/([0-9a-f]{64})$", i) for i in (1, 2))
    return F.when((family != "") & (shard == F.substring(cid, 1, 2)), F.struct(family.alias("family"), cid.alias("cid")))


def ignore_regex(pattern: str) -> tuple[str, list[str]]:
    """A Java regex for one ignore line, and warnings for syntax that has no meaning here.

    `*` stays inside a component. One component without a leading slash matches at any depth;
    else the pattern hangs on the root. A trailing slash asks for a folder. What lies below a match goes too.
    """
    warnings = [f"unsupported syntax {s!r} in {pattern!r}" for s in ("!", "**", "?", "[") if s in pattern]
    only_dir, body = pattern.endswith("/"), pattern.strip("/")
    anchored = pattern.startswith("/") or "/" in body
    glob = "[^/]*".join(re.escape(x) for x in body.split("*"))
    return ("^" if anchored else "(^|/)") + glob + ("/" if only_dir else "(/|$)"), warnings


def is_ignored(p: Column, is_dir: Column, patterns: list[str]) -> Column:
    """Patterns are few and known to the driver; each becomes one regex over the path."""
    probe = F.when(is_dir, F.concat(p, F.lit("/"))).otherwise(p)
    out = F.lit(False)
    for x in patterns:
        line = x.strip()
        if line and not line.startswith("#"):
            out = out | probe.rlike(ignore_regex(line)[0])
    return out


# Fixed value: the mark of a conflict copy, current and legacy (without `, seq`).
COPY_MARK = r"\(conflicto [^)]* \d+\)"
STEM_AND_EXTENSION = r"(?s)^(\.*(?:[^.].*?)?)(\.[^.]+)?$"


def clean_label(label: Column) -> Column:
    return F.regexp_replace(label, "[/()]", "_")


def conflict_copy_name(p: Column, label: Column, seq: Column) -> Column:
    """` (conflicto <label>, seq <n>)` goes before the last extension; leading dots start no extension."""
    folder = F.regexp_extract(p, r"(?s)^(.*/)?[^/]*$", 1)
    stem, ext = (F.regexp_extract(base_name(p), STEM_AND_EXTENSION, i) for i in (1, 2))
    return F.concat(folder, stem, F.lit(" (conflicto "), clean_label(label), F.lit(", seq "), seq.cast("string"), F.lit(")"), ext)


def is_conflict_copy(p: Column) -> Column:
    return base_name(p).rlike(COPY_MARK)


def conflict_origin(p: Column) -> Column:
    return F.when(is_conflict_copy(p), F.regexp_replace(p, " ?" + COPY_MARK + "(?=[^/]*$)", ""))


def humanize_seconds(s: Column) -> Column:
    """The two largest units, the smaller one only if it isn't zero: `1h 3m`, `2m`, `9s`."""

    def two(big: int, x: str, small: int, y: str) -> Column:
        rest = F.floor((s % big) / small)
        return F.concat(F.floor(s / big).cast("string"), F.lit(x), F.when(rest == 0, "").otherwise(F.concat(F.lit(" "), rest.cast("string"), F.lit(y))))

    return (
        F.when(s >= 86400, two(86400, "d", 3600, "h")).when(s >= 3600, two(3600, "h", 60, "m")).when(s >= 60, two(60, "m", 1, "s"))
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )
