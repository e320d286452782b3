"""Metadata rows, suggested names and resent uploads on cases where each rule bites."""

import json
import os.path
import random

from quaymark.operators.records import CUT, metadata_rows, resent_uploads, suggested_names


def test_metadata_rows(spark):
    exif = {"groups": [
        {"fields": [
            {"name": "Make", "present": True, "display": " A ", "raw": "B"}, {"name": "Gone", "present": False, "raw": "x"},
            {"name": "Lists", "present": True, "raw": ["a", 2, None]}, {"name": "Null", "present": True, "display": None, "raw": "hidden"},
            {"name": "Blank", "present": True, "display": " \n"}, {"name": "Text", "present": True, "display": '["no list"]'}, {"present": True, "raw": "no name"},
        ], "unknown": [{"name": "0x1", "raw": 7}, {"name": "0x2", "raw": ""}, {"name": "0x3", "raw": None}]},
        {"ns": "x", "fields": [{"name": "Make", "present": True, "raw": "last"}]},
        {"unknown": [{"name": "0x4", "raw": " kept "}]},
    ]}
    xmp = {"namespaces": [{"ns": "dc", "fields": [{"name": "title", "present": True, "display": "ü" * 3000}]}, {"ns": "", "fields": [{"name": "title", "present": True, "display": "t"}]}]}
    rows = [(1, json.dumps(exif), json.dumps(xmp), "clash"), (2, "{not json", None, "x"), (3, None, "{}", "x"), (None, json.dumps({"groups": [{"fields": [{"name": "n", "present": True, "raw": 1}]}]}), None, "x")]
    files = spark.createDataFrame(rows, "file long, exif string, xmp string, rows string")
    found = sorted((r["file"] or 0, r["ns"], r["tag"], r["value"]) for r in metadata_rows(files, "file", {"exif": "exif", "xmp": "xmp"}).collect())
    assert found == [
        (0, "exif", "n", "1"), (1, "exif", "0x1", "7"), (1, "exif", "0x4", " kept "), (1, "exif", "Lists", "a, 2, None"), (1, "exif", "Make", "last"),
        (1, "exif", "Text", '["no list"]'), (1, "xmp", "dc:title", "ü" * CUT), (1, "xmp", "title", "t"),
    ]
    assert metadata_rows(files.limit(0), "file", {"exif": "exif"}).count() == 0


def test_suggested_names(spark):
    rows = [
        (1, 0, True, "ann", 9), (2, 0, True, "zoe", 9), (3, 0, False, "x", 9), (4, 0, None, None, None),  # confirmed, the least name
        (5, 1, False, None, 1), (6, 1, False, "y", 1), (7, 1, False, None, 2), (8, 1, True, "", None),  # borrowed; confirmed stays
        (9, 2, False, "old", 3), (10, -1, False, "out", 1), (11, None, False, None, 1),  # a nameless face, no cluster
        (12, 3, False, None, 2), (13, 3, False, None, 1),  # a tie
    ]
    bodies = spark.createDataFrame(rows, "id long, cluster long, confirmed boolean, name string, face long")
    faces = spark.createDataFrame([(1, "bob"), (2, "amy"), (3, ""), (4, None)], "face long, name string")
    found = {r["id"]: r["name"] for r in suggested_names(bodies, faces).collect()}
    assert found == {1: "ann", 2: "zoe", 3: "ann", 4: "ann", 5: "bob", 6: "bob", 7: "bob", 8: "", 9: "old", 10: "out", 11: None, 12: "amy", 13: "amy"}
    assert suggested_names(bodies.limit(0), faces).count() == 0 and suggested_names(bodies, faces.limit(0)).count() == len(rows)


def _resent(path, origin, raw, stored):
    """The rule as a loop."""
    base, ext = os.path.splitext(path)
    for n in range(999):
        name = path if n == 0 else f"{base}_{n}{ext}"
        if name not in stored:
            return None
        source = (stored[name] or "").strip().lower()
        if (source != "" and source == (origin or "").strip().lower()) if raw else source == "":
            return name
    return None


def test_resent_uploads_equal_the_loop(spark):
    pick = random.Random(3)
    bases = ["a/x", "a/x_2", "b.c/y", ".hid", "z.tar", "a/x_1_1", "n_0", "n_01", "..w"]
    names = [b + s + e for b in bases for s in ["", "_1", "_2", "_3", "_5", "_1_1"] for e in ["", ".jpg", ".JPG"]]
    stored = {n: pick.choice([None, "", "r1.CR2", " R2.nef "]) for n in names if pick.random() < 0.8}
    uploads = [(i, pick.choice(names), pick.choice(["r1.cr2", "R2.NEF", "", None]), pick.random() < 0.6) for i in range(600)]
    many = {f"m{'_' + str(n) if n else ''}.jpg": "q.raw" for n in range(1001)} | {"m_998.jpg": "last.raw", "m_999.jpg": "late.raw"}
    stored |= many
    uploads += [(600, "m.jpg", "last.raw", True), (601, "m.jpg", "late.raw", True), (602, "m.jpg", "x.jpg", False)]
    files = spark.createDataFrame(list(stored.items()) + [(None, "r1.CR2")], "path string, raw_name string")
    asked = spark.createDataFrame([*uploads, (700, None, "r1.cr2", True)], "upload long, path string, origin string, raw boolean")
    found = {r["upload"]: r["path"] for r in resent_uploads(asked, files).collect()}
    wanted = {i: p for i, path, origin, raw in uploads if (p := _resent(path, origin, raw, stored))}
    assert found == wanted and found[600] == "m_998.jpg" and 601 not in found and len(wanted) > 100
    assert resent_uploads(asked, files.limit(0)).count() == 0
