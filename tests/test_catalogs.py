"""Uploads of catalogs and their rollback."""

from __future__ import annotations

import pytest
from tallyframe.sources import catalogs


def _catalog(spark, *rows):
    return spark.createDataFrame(list(rows), "code string, product_name string, long_name string")


def state(spark, home):
    now = catalogs.items(spark, home)
    return sorted(tuple(r) for r in now.collect()) if now else None, sorted(tuple(r) for r in catalogs.renames(spark, home).collect())


def test_uploads_and_rollbacks(spark, tmp_path):
    home = str(tmp_path / "catalog")
    assert state(spark, home) == (None, []) and catalogs.rollback(spark, home) == catalogs.Pointer()
    first, second, third = [("1", "a", None), ("2", "b", None)], [("1", "A", None), ("2", "b", None)], [("1", "AA", None), ("2", "B", "long")]
    assert catalogs.upload(spark, home, _catalog(spark, *first))
    assert state(spark, home) == (first, [])
    assert catalogs.upload(spark, home, _catalog(spark, *second))
    after_second = (second, [(1, "1", "a", "A")])
    assert state(spark, home) == after_second
    assert not catalogs.upload(spark, home, _catalog(spark, ("1", "x", None), ("1", "y", None)))
    assert state(spark, home) == after_second
    assert catalogs.upload(spark, home, _catalog(spark, *third))
    assert state(spark, home) == (third, [(1, "1", "a", "A"), (2, "1", "A", "AA"), (3, "2", "b", "B")])
    catalogs.rollback(spark, home)
    assert state(spark, home) == after_second
    assert catalogs.upload(spark, home, _catalog(spark, ("1", "Z", None)))  # numbers go on from the watermark, not from the undone upload
    assert state(spark, home) == ([("1", "Z", None)], [(1, "1", "a", "A"), (2, "1", "A", "Z")])
    for expected in (after_second, (first, []), (None, []), (None, [])):
        catalogs.rollback(spark, home)
        assert state(spark, home) == expected


def test_a_failure_before_the_pointer_moves_leaves_the_old_state(spark, tmp_path, monkeypatch):
    home = str(tmp_path / "catalog")
    catalogs.upload(spark, home, _catalog(spark, ("1", "a", None)))
    before = state(spark, home)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(catalogs, "_point", fail)
        with pytest.raises(OSError):
            catalogs.upload(spark, home, _catalog(spark, ("1", "b", None)))
    assert state(spark, home) == before
    assert catalogs.upload(spark, home, _catalog(spark, ("1", "c", None)))
    assert state(spark, home) == ([("1", "c", None)], [(1, "1", "a", "c")])
