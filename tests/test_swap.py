"""Changes of stored tables, broken off at every step."""

from __future__ import annotations

import pytest

from clickloom.operators import tables
from clickloom.plans import swap

DAY = 86400
ROWS = [(i, 19_700 * DAY + (i % 4) * DAY + i) for i in range(12)]
SCHEMA = "id bigint, ts bigint"


class Stopped(Exception):
    pass


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(2)


def _store(rows, path, layout):
    if layout == "plain":
        rows.write.parquet(path)
    else:
        batch = "a" if "batch" in layout else None
        tables.append_dated(rows, path, batch_id=batch, dated="dated" in layout)


def _load(spark, path, layout):
    parts = (", batch_id string" if "batch" in layout else "") + (", dt date" if "dated" in layout else "")
    return spark.read.schema(SCHEMA + parts).parquet(path)


def _ids(df):
    return sorted(r.id for r in df.select("id").collect())


def _files(path):
    return [p for p in path.rglob("*") if p.is_file() and not p.name.startswith(("_", "."))]


def _breaking(monkeypatch, step, refuse):
    """Let the given number of changing operations pass; from then on all fail, or all renames are refused."""
    done = {"n": 0}

    def wrap(name):
        real = getattr(swap.TableFiles, name)

        def run(self, *args):
            done["n"] += 1
            if done["n"] > step:
                if not refuse:
                    raise Stopped
                if name == "rename":
                    raise OSError("refused")
            return real(self, *args)

        monkeypatch.setattr(swap.TableFiles, name, run)

    for name in ("rename", "delete", "write"):
        wrap(name)


@pytest.mark.parametrize(("layout", "refuse"), [
    ("plain", False), ("dated", False), ("batch", False), ("batch dated", False), ("plain", True), ("batch dated", True)])
def test_no_step_loses_rows(spark, rows, tmp_path, monkeypatch, layout, refuse):
    old, new = [r[0] for r in ROWS], [r[0] for r in ROWS if r[0] not in (1, 3, 7, 11)]
    seen, step = set(), 0
    while True:
        path = tmp_path / f"t{step}"
        _store(rows, str(path), layout)
        split = tables.delete_by_ids(_load(spark, str(path), layout), [1, 3, 7, 11])  # empties no date but cuts two
        with monkeypatch.context() as m:
            _breaking(m, step, refuse)
            try:
                tables.apply_split(split, str(path))
                finished = True
            except (Stopped, OSError):
                finished = False
        if not finished:
            swap.recover(spark, str(path))
        found = _ids(_load(spark, str(path), layout))
        assert found in (old, new), f"step {step}"
        assert not (path / swap.CHANGES).exists()
        seen.add(tuple(found))
        # the repeated job always ends with the new rows, and with files of the table alone
        tables.apply_split(tables.delete_by_ids(_load(spark, str(path), layout), [1, 3, 7, 11]), str(path))
        assert _ids(_load(spark, str(path), layout)) == new
        assert sorted(r[0] for r in spark.read.schema(SCHEMA).parquet(*map(str, _files(path))).select("id").collect()) == new
        if finished:
            break
        step += 1
    assert step > 3 and seen == {tuple(old), tuple(new)}


@pytest.mark.parametrize("layout", ["batch", "batch dated"])
def test_a_batch_is_replaced_as_a_whole(spark, tmp_path, layout):
    path = str(tmp_path / "t")

    def put(batch, *given):
        tables.append_dated(spark.createDataFrame(list(given), SCHEMA), path, batch_id=batch, dated="dated" in layout)

    put("a", (1, 5), (2, DAY + 5))
    put("b", (3, 5))
    put("a", (4, DAY + 6))
    assert _ids(_load(spark, path, layout)) == [3, 4]
    put("a")
    assert _ids(_load(spark, path, layout)) == [3]
    put("a", (5, None))
    assert _ids(_load(spark, path, layout)) == [3, 5]
    assert tables.apply_split(tables.delete_by_ids(_load(spark, path, layout), [5]), path) == 1
    assert _ids(_load(spark, path, layout)) == [3]
    with pytest.raises(ValueError):
        put("../a", (1, 5))


def test_a_broken_append_leaves_the_batch(spark, rows, tmp_path, monkeypatch):
    for step in range(4):
        path = str(tmp_path / f"t{step}")
        tables.append_dated(rows.where("id < 3"), path, batch_id="a")
        with monkeypatch.context() as m:
            _breaking(m, step, False)
            with pytest.raises(Stopped):
                tables.append_dated(rows.where("id = 9"), path, batch_id="a")
        swap.recover(spark, path)
        assert _ids(_load(spark, path, "batch dated")) in ([0, 1, 2], [9])


def test_an_undated_table_is_cut_and_cleared(spark, rows, tmp_path):
    path = tmp_path / "t"
    _store(rows, str(path), "plain")

    def load():
        return _load(spark, str(path), "plain")

    before = set(_files(path))
    assert tables.apply_split(tables.apply_retention(load(), "ts", 1, 19_800 * DAY), str(path)) == 1
    assert load().count() == 0 and not before & set(_files(path))
    assert tables.apply_split(tables.clear(load()), str(path)) == 0
    rows.where("id = 5").write.mode("append").parquet(str(path))
    assert tables.apply_split(tables.delete_by_ids(load(), [99]), str(path)) == 0 and _ids(load()) == [5]


def test_only_partitions_that_lose_rows_are_written(spark, rows, tmp_path):
    path = tmp_path / "t"
    for batch in "ab":
        tables.append_dated(rows, str(path), batch_id=batch)
    before = set(_files(path))
    stored = _load(spark, str(path), "batch dated")
    gone = (stored["batch_id"] == "a") & (stored["id"] == 4)
    assert tables.apply_split(tables.Split(stored.where(~gone), stored.where(gone)), str(path)) == 1
    assert len(before & set(_files(path))) == len(before) - 1
    assert _load(spark, str(path), "batch dated").count() == 23
