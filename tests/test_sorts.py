"""Named orders against sorting in SQLite, whose rules for null and case they follow."""

import random
import sqlite3

import pytest

from quaymark.functions.sorts import ALBUMS, GROUPS, PAGE, SONGS, sort_columns, sorted_page

SORTS = {"songs": SONGS, "albums": ALBUMS, "groups": GROUPS}


def _sql(column, down):
    name, mark = (column[:-1], column[-1]) if column[-1] in "~0?" else (column, "")
    way = " DESC" if down else ""
    return {"~": f"{name} COLLATE NOCASE{way}", "0": f"COALESCE({name},0){way}", "?": f"({name} IS NULL OR {name}=''), {name}{way}"}.get(mark, f"{name}{way}")


@pytest.mark.parametrize("kind", SORTS)
def test_orders(spark, kind):
    sorts = SORTS[kind]
    marked = {c for pair in sorts.values() for part in pair for c in part.split()}
    texts = {c[:-1] for c in marked if c[-1] == "~"} | {c for c in marked if c == "path"} | ({"year"} if any(c.startswith("year") for c in marked) else set())
    columns = sorted({c.rstrip("~0?") for c in marked})
    pick = random.Random(5)
    rows = [(i, *[pick.choice([None, "", "a", "B", "b", "Ä", "ä"]) if c in texts else pick.choice([None, 0, 1, 2, -1]) for c in columns]) for i in range(120)]
    db = sqlite3.connect(":memory:")
    db.execute(f"CREATE TABLE r (id, {', '.join(columns)})")
    db.executemany(f"INSERT INTO r VALUES ({', '.join('?' * (1 + len(columns)))})", rows)
    frame = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} {'string' if c in texts else 'long'}" for c in columns)).coalesce(1).cache()
    for name in [*sorts, None, "UNKNOWN"]:
        primary, ties = sorts.get((name or "default").lower(), sorts["default"])
        for down in (False, True):
            by = [_sql(c, down) for c in primary.split()] + [_sql(c, False) for c in ties.split()]
            wanted = [r[0] for r in db.execute(f"SELECT id FROM r ORDER BY {', '.join(by)}, id")]
            assert [r["id"] for r in frame.orderBy(*sort_columns(sorts, name, down), "id").collect()] == wanted, (name, down)


def test_page_sizes(spark):
    rows = spark.range(300).selectExpr("id", "id AS tracks", "'n' AS name")
    sizes = {size: sorted_page(rows, GROUPS, "tracks", True, "id", size, most=250).count() for size in (None, 0, -3, 7, 250, 251, 10**9)}
    assert sizes == {None: PAGE, 0: PAGE, -3: PAGE, 7: 7, 250: 250, 251: 250, 10**9: 250}
    assert sorted_page(rows.limit(0), GROUPS, None, False, "id").count() == 0
