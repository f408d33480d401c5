"""Checks of uploaded files: kind, size, first and last bytes, and what archives hold."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits, kinds of files, how each begins, and members of archives that don't belong there.
MOST_BYTES, MOST_MEMBERS, MOST_UNPACKED, MOST_MEMBER, MOST_RATIO = 50 << 20, 10_000, 250 << 20, 100 << 20, 100
ARCHIVES = {".docx": "word/document.xml", ".xlsx": "xl/workbook.xml", ".xlsm": "xl/workbook.xml"}
TEXTS, IMAGES = (".txt", ".md", ".csv"), (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff")
RUNNABLE = (".exe", ".dll", ".com", ".scr", ".bat", ".cmd", ".ps1", ".js", ".jse", ".vbs", ".vbe", ".msi", ".jar", ".lnk")
MIMES = {
    ".pdf": ("application/pdf",), ".png": ("image/png",), ".jpg": ("image/jpeg",), ".jpeg": ("image/jpeg",), ".webp": ("image/webp",), ".bmp": ("image/bmp", "image/x-ms-bmp"), ".tif": ("image/tiff",), ".tiff": ("image/tiff",),
    ".docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/zip"), ".xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/zip"), ".xlsm": ("application/vnd.ms-excel.sheet.macroenabled.12", "application/zip"),
    ".txt": ("text/plain",), ".md": ("text/plain", "text/markdown"), ".csv": ("text/plain", "text/csv", "application/csv", "application/vnd.ms-excel"),
}
TEST_VIRUS = b"X5O!P%@AP[4\\PZX54(P^)7CC)7}$EICAR-STANDARD-ANTIVIRUS-TEST-FILE!$H+H*"
MEMBER = "struct<name: string, size: long, packed: long, flags: int, mode: int>"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, extension, length, content) of the files under a path; content is read only where it is used.

    Spark's scan doesn't list empty files.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return found.select("path", name.alias("name"), extension(name).alias("extension"), "length", "content")


def extension(name: Column) -> Column:
    """The extension in lower case, with its dot; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^.](\.[^.]+)$", 1))


def route(kind: Column) -> Column:
    """What reads a file of an extension: text, image, both (pages of either), spreadsheet or unknown."""
    return F.when(kind.isin(*TEXTS, ".docx"), "text").when(kind.isin(*IMAGES), "image").when(kind == ".pdf", "both").when(kind.isin(".xlsx", ".xlsm"), "spreadsheet").otherwise("unknown")


def _begins(content: Column, *starts: bytes) -> Column:
    found = F.lit(False)
    for start in starts:
        found |= F.substring(content, 1, len(start)) == F.lit(start)
    return found


def signed(kind: Column, content: Column) -> Column:
    """Whether a file's bytes are those of its kind; true for kinds without a mark."""
    tail = lambda n: F.substring(content, -n, n)
    trimmed = F.regexp_replace(F.hex(tail(64)), "(?:09|0A|0B|0C|0D|20)+$", "")
    return (
        F.when(kind == ".pdf", _begins(content, b"%PDF-") & F.contains(tail(4096), F.lit(b"%%EOF")))
        .when(kind == ".png", _begins(content, b"\x89PNG\r\n\x1a\n") & F.contains(tail(32), F.lit(b"IEND")))
        .when(kind.isin(".jpg", ".jpeg"), _begins(content, b"\xff\xd8\xff") & F.endswith(trimmed, F.lit("FFD9")))
        .when(kind == ".webp", _begins(content, b"RIFF") & (F.substring(content, 9, 4) == F.lit(b"WEBP")))
        .when(kind == ".bmp", _begins(content, b"BM"))
        .when(kind.isin(".tif", ".tiff"), _begins(content, b"II*\x00", b"MM\x00*"))
        .otherwise(True)
    )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, members, broken): what archives list; members are unpacked one by one, and only those of bounded size, to check them."""
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    listed = archive.infolist()
                    small = len(listed) <= MOST_MEMBERS and sum(i.file_size for i in listed) <= MOST_UNPACKED and not any(i.flag_bits & 1 for i in listed)
                    broken = bool(small and archive.testzip())
                    rows.append((path, [{"name": i.filename, "size": i.file_size, "packed": i.compress_size, "flags": i.flag_bits, "mode": i.external_attr >> 16} for i in listed], broken))
            except (zipfile.BadZipFile, zipfile.LargeZipFile, NotImplementedError, EOFError, OSError, ValueError):
                rows.append((path, None, True))
        kind = pa.list_(pa.struct([("name", pa.string()), ("size", pa.int64()), ("packed", pa.int64()), ("flags", pa.int32()), ("mode", pa.int32())]))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.bool_())], names=["path", "members", "broken"])


def archive_fault(kind: Column, members: Column, broken: Column) -> Column:
    """Why an archive is refused; null for sound ones.  A file that isn't an archive has no members."""
    names = F.transform(members, lambda m: F.lower(m["name"]))
    some = lambda rule: F.exists(members, rule)
    parts = lambda m: F.split(F.replace(m["name"], F.lit("\\"), F.lit("/")), "/")
    required = F.coalesce(*[F.when(kind == k, F.lit(r)) for k, r in ARCHIVES.items()])
    macro = lambda m: F.contains(F.lower(m["name"]), F.lit("vbaproject.bin")) | (F.endswith(F.lower(m["name"]), F.lit(".bin")) & F.contains(F.lower(m["name"]), F.lit("embeddings/")))
    return (
        F.when(members.isNull(), "NOT_AN_ARCHIVE")
        .when(F.size(members) > MOST_MEMBERS, "TOO_MANY_MEMBERS")
        .when(some(lambda m: F.array_contains(parts(m), "..") | F.startswith(F.replace(m["name"], F.lit("\\"), F.lit("/")), F.lit("/"))), "UNSAFE_PATH")
        .when(some(lambda m: m["flags"].bitwiseAND(1) == 1), "ENCRYPTED")
        .when(some(lambda m: m["mode"].bitwiseAND(0o170000) == 0o120000), "SYMBOLIC_LINK")
        .when(some(lambda m: extension(m["name"]).isin(*RUNNABLE)), "RUNNABLE_MEMBER")
        .when(some(macro), "MACRO")
        .when(some(lambda m: m["size"] > MOST_MEMBER), "MEMBER_TOO_LARGE")
        .when(F.aggregate(members, F.lit(0).cast("long"), lambda s, m: s + m["size"]) > MOST_UNPACKED, "UNPACKS_TOO_LARGE")
        .when(some(lambda m: (m["size"] > 0) & (m["size"] / F.greatest(F.lit(1), m["packed"]) > MOST_RATIO)), "PACKED_TOO_WELL")
        .when(~F.array_contains(names, "[content_types].xml") | ~F.array_contains(names, required), "OTHER_KIND")
        .when(broken, "BROKEN")
    )


def file_faults(uploads: DataFrame) -> DataFrame:
    """(path, route, fault) of uploads (path, name, mime, content): why each is refused, null for sound ones.

    A type that the sender states must fit the extension, unless it is that of any bytes; the bytes must be
    those of the kind.  Only archives go through Python, one at a time; a file over the limit isn't opened.
    """
    step = uploads.select("path", extension(F.col("name")).alias("kind"), F.trim(F.lower(F.split_part(F.coalesce("mime", F.lit("")), F.lit(";"), F.lit(1)))).alias("_mime"), F.coalesce("content", F.lit(b"")).alias("content"))
    fits = F.lit(False)
    for kind, mimes in MIMES.items():
        fits |= (F.col("kind") == kind) & F.col("_mime").isin(*mimes)
    early = (
        F.when(~F.col("kind").isin(*MIMES), "UNKNOWN_KIND")
        .when(F.octet_length("content") == 0, "EMPTY")
        .when(F.octet_length("content") > MOST_BYTES, "TOO_LARGE")
        .when(~F.col("_mime").isin("", "application/octet-stream") & ~fits, "MIME_CLASH")
        .when(~signed(F.col("kind"), F.col("content")), "WRONG_SIGNATURE")
        .when(F.col("kind").isin(*TEXTS) & F.contains(F.col("content"), F.lit(b"\x00")), "BINARY_TEXT")
    )
    step = step.select("path", "kind", early.alias("_early"), F.contains(F.col("content"), F.lit(TEST_VIRUS)).alias("_virus"), "content")
    archives = step.where(F.col("_early").isNull() & F.col("kind").isin(*ARCHIVES)).select("path", "content").mapInArrow(_members, f"path string, members array<{MEMBER}>, broken boolean")
    held = step.drop("content").join(archives, "path", "left")
    late = F.when(F.col("kind").isin(*ARCHIVES) & F.col("_early").isNull(), archive_fault(F.col("kind"), F.col("members"), F.col("broken")))
    return held.select("path", route(F.col("kind")).alias("route"), F.coalesce("_early", late, F.when(F.col("_virus"), "VIRUS")).alias("fault"))
