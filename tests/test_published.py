"""Batches that are written once, replayed, or die midway."""

import datetime as dt
import threading

import pytest

from barwright.sources import published

SCHEMA = "account string, date date, n long"


def rows(spark, *items):
    return spark.createDataFrame([(a, dt.date(2024, m, d), n) for a, m, d, n in items], SCHEMA)


def read(spark, path):
    return sorted((r.account, r.date.month, r.date.day, r.n) for r in published.read_published(spark, path, SCHEMA).collect())


def test_replays_and_deaths(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert read(spark, path) == []
    assert published.append_once(rows(spark, ("A", 1, 1, 1)), path, "one")
    assert not published.append_once(rows(spark, ("A", 1, 1, 1)), path, "one")

    def die(*args):
        raise RuntimeError("gone")
    real = published.publish
    monkeypatch.setattr(published, "publish", die)
    with pytest.raises(RuntimeError, match="gone"):
        published.append_once(rows(spark, ("B", 1, 1, 2)), path, "two")
    assert read(spark, path) == [("A", 1, 1, 1)]
    monkeypatch.setattr(published, "publish", real)
    assert published.append_once(rows(spark, ("B", 1, 1, 2)), path, "two")
    assert read(spark, path) == [("A", 1, 1, 1), ("B", 1, 1, 2)]


def test_writers_at_once_get_numbers_of_their_own(spark, tmp_path):
    path = str(tmp_path / "t")
    published.append_once(rows(spark, ("A", 1, 1, 0)), path, "first")
    made = []
    jobs = [threading.Thread(target=lambda i=i: made.append(published.append_once(rows(spark, ("A", 1, 2, i)), path, f"b{i % 3}"))) for i in range(6)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    found = published.entries(spark, path)
    assert [e["number"] for e in found] == list(range(len(found))) and len(read(spark, path)) == len(found)


def test_replacement_is_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    write = lambda df, batch, force=False: published.snapshots_once(df, path, batch, SCHEMA, force)
    write(rows(spark, ("A", 1, 1, 1), ("B", 1, 1, 2), ("A", 2, 1, 3)), "a")
    write(rows(spark, ("A", 1, 1, 9), ("A", 1, 2, 4)), "b")
    before = [("A", 1, 1, 1), ("A", 1, 2, 4), ("A", 2, 1, 3), ("B", 1, 1, 2)]
    assert read(spark, path) == before
    real = published.publish
    monkeypatch.setattr(published, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
    with pytest.raises(RuntimeError):
        write(rows(spark, ("A", 1, 1, 7)), "c", True)
    assert read(spark, path) == before
    monkeypatch.setattr(published, "publish", real)
    for _ in range(2):
        write(rows(spark, ("A", 1, 1, 7)), "c", True)
    assert read(spark, path) == [("A", 1, 1, 7), ("A", 1, 2, 4), ("A", 2, 1, 3), ("B", 1, 1, 2)]
    write(rows(spark, ("C", 1, 3, 5)), "d")
    assert ("C", 1, 3, 5) in read(spark, path) and len(read(spark, path)) == 5
