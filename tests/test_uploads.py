"""Uploaded files, staged tables and subscriptions."""

from __future__ import annotations

import io
import tempfile
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.operators import uploads as U
from quillspark.operators.records import subscriptions
from quillspark.sources.staged import StagedTable


def packed(kind, *extra, stored=True, encrypted=False, links=(), without=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as archive:
        for name in ["[Content_Types].xml", U.ARCHIVES.get(kind, "x"), *extra]:
            if name not in without:
                archive.writestr(name, b"0" * 50 if stored else b"0" * 200_000)
        for name in links:
            info = zipfile.ZipInfo(name)
            info.external_attr = 0o120777 << 16
            archive.writestr(info, b"target")
    body = bytearray(out.getvalue())
    if encrypted:
        at = body.find(b"PK\x01\x02")
        body[at + 8] |= 1
    return bytes(body)


PNG, JPG = b"\x89PNG\r\n\x1a\n" + b"0" * 40 + b"IEND\xaeB`\x82", b"\xff\xd8\xff" + b"0" * 40 + b"\xff\xd9"
DOCX = packed(".docx")
FILES = {
    "a.pdf": (b"%PDF-1.7 " + b"x" * 5000 + b"%%EOF\n", "both", None), "cut.pdf": (b"%PDF-1.7 " + b"x" * 5000, "both", "WRONG_SIGNATURE"), "a.PNG": (PNG, "image", None), "b.png": (PNG[:-12], "image", "WRONG_SIGNATURE"), "a.jpg": (JPG + b" \r\n", "image", None), "b.jpeg": (PNG, "image", "WRONG_SIGNATURE"),
    "a.webp": (b"RIFF1234WEBP", "image", None), "b.webp": (b"RIFF", "image", "WRONG_SIGNATURE"), "a.bmp": (b"BM1", "image", None), "a.tif": (b"MM\x00*1", "image", None), "b.tiff": (b"MM*", "image", "WRONG_SIGNATURE"),
    "a.txt": ("말".encode(), "text", None), "b.csv": (b"a\x00b", "text", "BINARY_TEXT"), "c.md": (U.TEST_VIRUS, "text", "VIRUS"), "a.exe": (b"MZ", "unknown", "UNKNOWN_KIND"), "noext": (b"x", "unknown", "UNKNOWN_KIND"), "empty.txt": (b"", "text", "EMPTY"),
    "a.docx": (DOCX, "text", None), "a.xlsx": (packed(".xlsx"), "spreadsheet", None), "b.xlsx": (DOCX, "spreadsheet", "OTHER_KIND"), "c.docx": (b"PK no", "text", "NOT_AN_ARCHIVE"), "d.docx": (packed(".docx", "../up"), "text", "UNSAFE_PATH"), "d2.docx": (packed(".docx", "/abs"), "text", "UNSAFE_PATH"),
    "e.docx": (packed(".docx", "a/run.EXE"), "text", "RUNNABLE_MEMBER"), "f.xlsm": (packed(".xlsm", "xl/vbaProject.bin"), "spreadsheet", "MACRO"), "f2.docx": (packed(".docx", "word/embeddings/o.bin"), "text", "MACRO"), "g.docx": (packed(".docx", stored=False), "text", "PACKED_TOO_WELL"), "h.docx": (packed(".docx", encrypted=True), "text", "ENCRYPTED"),
    "i.docx": (packed(".docx", links=["l"]), "text", "SYMBOLIC_LINK"), "j.docx": (packed(".docx", without=["[Content_Types].xml"]), "text", "OTHER_KIND"), "k.docx": (packed(".docx", *[str(i) for i in range(10_001)]), "text", "TOO_MANY_MEMBERS"), "l.docx": (DOCX.replace(b"0" * 50, b"1" + b"0" * 49, 1), "text", "BROKEN"),
}


def test_files_that_were_written(spark):
    folder = tempfile.mkdtemp(prefix="spark-uploads-")
    for name, (content, _, _) in FILES.items():
        with open(f"{folder}/{name}", "wb") as out:
            out.write(content)
    found = U.files(spark, folder).withColumn("mime", F.lit(None).cast("string"))
    got = {r["path"].rsplit("/", 1)[1]: (r["route"], r["fault"]) for r in U.file_faults(found).collect()}
    assert got == {name: (route, fault) for name, (content, route, fault) in FILES.items() if content}


def test_stated_types(spark):
    rows = [("1", "a.png", "image/png; q=1", PNG), ("2", "a.png", "image/jpeg", PNG), ("3", "a.png", "application/octet-stream", PNG), ("4", "a.xlsm", "application/vnd.ms-excel.sheet.macroEnabled.12", packed(".xlsm")), ("5", None, None, None), ("6", "a.txt", None, None)]
    got = {r["path"]: r["fault"] for r in U.file_faults(spark.createDataFrame(rows, "path string, name string, mime string, content binary")).collect()}
    assert got == {"1": None, "2": "MIME_CLASH", "3": None, "4": None, "5": "UNKNOWN_KIND", "6": "EMPTY"}


def test_a_broken_diff_leaves_the_old_table(spark):
    staged = StagedTable(spark, tempfile.mkdtemp(prefix="spark-staged-"))
    assert staged.rows() is None and staged.version() is None
    first = staged.stage(spark.range(5))
    assert staged.rows() is None
    staged.publish(first)
    half = staged.stage(spark.range(2))

    def none_lost(old, new):
        lost = old.join(new, "id", "left_anti").count() if old is not None else 0
        return [f"{lost} rows lost"] if lost else []

    with pytest.raises(ValueError, match="3 rows lost"):
        staged.publish(half, none_lost)
    assert staged.rows().count() == 5 and staged.version() == first
    more = staged.stage(staged.rows().union(spark.range(5, 7)))
    staged.publish(more, none_lost)
    assert staged.rows().count() == 7
    staged.roll_back()
    assert staged.rows().count() == 5 and staged.log().count() == 3
    with pytest.raises(ValueError, match="no version"):
        StagedTable(spark, tempfile.mkdtemp(prefix="spark-staged-")).roll_back()


def test_subscriptions(spark):
    day = lambda d: datetime(2024, 1, d)
    payments = spark.createDataFrame([(1, day(1)), (2, day(1)), (3, day(1)), (3, day(20)), (4, day(25)), (None, day(1)), (5, None)], "user int, paid_at timestamp")
    cancels = spark.createDataFrame([(2, day(2)), (3, day(5)), (4, day(26)), (4, day(2)), (6, day(1)), (None, None)], "user int, asked_at timestamp")
    got = {r["user"]: (r["tier"], r["status"], r["period_end"]) for r in subscriptions(payments, cancels, F.lit(datetime(2024, 1, 31))).collect()}
    assert got == {1: ("ENTERPRISE", "ACTIVE", day(31)), 2: ("FREE", "CANCELED", day(31)), 3: ("ENTERPRISE", "ACTIVE", datetime(2024, 2, 19)), 4: ("ENTERPRISE", "CANCEL_SCHEDULED", datetime(2024, 2, 24))}
