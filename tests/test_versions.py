"""The versioned store: readers see whole commits only."""

import datetime as dt

import pytest

from panelkit.sources import stores as ST
from panelkit.sources.versions import CommitConflict, DatedStore

D = [dt.date(2024, 1, k) for k in range(1, 6)]


def rows(spark, days, tag):
    return spark.createDataFrame([(d, f"{tag}{k}", k) for d in days for k in range(3)], "date date, url string, ord int").repartition(3)


def urls(df):
    return sorted((str(r.date), r.url) for r in df.collect())


def want(*parts):
    return sorted((str(d), f"{tag}{k}") for days, tag in parts for d in days for k in range(3))


def test_versions_and_backups(spark, tmp_path):
    store = DatedStore(spark, str(tmp_path / "s"))
    assert store.read() is None and store.versions() == []
    assert urls(store.append(rows(spark, D[:2], "a"))) == want((D[:2], "a"))
    # a day that is there is not touched
    assert urls(store.append(rows(spark, D[1:4], "b"))) == want((D[:2], "a"), (D[2:4], "b"))
    assert urls(store.write(rows(spark, D[4:], "c"))) == want((D[4:], "c"))
    assert store.versions() == [1, 2, 3]
    assert urls(store.read(1)) == want((D[:2], "a")) and urls(store.read(2)) == want((D[:2], "a"), (D[2:4], "b"))
    with pytest.raises(ValueError):
        store.read(9)
    back = ST.news_snapshot_write(rows(spark, D[:1], "d"), store.root)
    assert urls(back) == want((D[:1], "d")) and store.versions()[-1] == 4


def test_a_commit_stopped_half_way_is_not_seen(spark, tmp_path, monkeypatch):
    store = DatedStore(spark, str(tmp_path / "s"))
    store.write(rows(spark, D[:2], "a"))
    # stopped after the rows and the manifest, before the version
    monkeypatch.setattr(DatedStore, "_point", lambda self, n, c: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.append(rows(spark, D[2:], "b"))
    monkeypatch.undo()
    assert urls(DatedStore(spark, store.root).read()) == want((D[:2], "a")) and store.versions() == [1]
    # stopped within the rows, and within the version file
    rows(spark, D, "x").write.parquet(f"{store.root}/data/commit=halfway")
    (tmp_path / "s" / "versions" / f"{2:010d}").write_text("c0ffee")
    assert urls(store.read()) == want((D[:2], "a")) and store.versions() == [1]
    # and the days can be collected again
    assert urls(store.append(rows(spark, D[2:], "b"))) == want((D[:2], "a"), (D[2:], "b"))
    assert store.versions() == [1, 3]


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    store = DatedStore(spark, str(tmp_path / "s"))
    store.write(rows(spark, D[:1], "a"))
    base = store._base()
    store.append(rows(spark, D[1:2], "b"))
    monkeypatch.setattr(store, "_base", lambda: base)       # it has read the store before the other's commit
    with pytest.raises(CommitConflict):
        store.append(rows(spark, D[1:3], "c"))
    assert urls(DatedStore(spark, store.root).read()) == want((D[:1], "a"), (D[1:2], "b"))


def test_null_days_empty_appends_and_commits(spark, tmp_path):
    store = DatedStore(spark, str(tmp_path / "s"))
    first = spark.createDataFrame([(None, "n", 1), (D[0], "a", 2)], "date date, url string, ord int")
    store.append(first)
    assert store.append(spark.createDataFrame([(None, "again", 1)], first.schema)).count() == 2
    empty = DatedStore(spark, str(tmp_path / "e"))
    assert empty.write(first.limit(0)).columns == first.columns and empty.read().count() == 0
    assert urls(empty.append(rows(spark, D[:1], "a"))) == want((D[:1], "a"))
