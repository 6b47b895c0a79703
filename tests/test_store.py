"""The store: writers that die at any step, commits at once, logs in levels, and merges by bucket."""

import os

import pytest
from pyspark.sql import functions as F

from factmill.sources import store as module
from factmill.sources.store import Conflict, Merge, Store


class Killed(Exception):
    pass


def _rows(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "n long")


def _held(store, name="a"):
    return sorted(r.n for r in store.read(name).collect())


STEPS = ["_written", "_point", "_rename"]


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("how", ["commit", "append", "merge"])
def test_a_writer_killed_at_any_step_changes_nothing_or_all(spark, tmp_path, monkeypatch, step, after, how):
    store = Store(spark, str(tmp_path))
    store.commit(a=_rows(spark, 1), b=_rows(spark, 9))
    if how == "merge":
        store.commit(a=Merge(_rows(spark, 1), "n", _rows(spark, 1)))
    before = store.versions()
    whole = getattr(Store, step)

    def dying(self, *args):
        if not after:
            raise Killed
        whole(self, *args)
        raise Killed

    monkeypatch.setattr(Store, step, dying)
    write = {"commit": lambda s: s.commit(a=_rows(spark, 2)), "append": lambda s: s.append(a=_rows(spark, 2)), "merge": lambda s: s.commit(a=Merge(_rows(spark, 2), "n", _rows(spark, 1)))}[how]
    if how == "merge" and step == "_written":
        monkeypatch.setattr(Store, "_bucketed", dying if not after else lambda self, *a: (_ for _ in ()).throw(Killed()))
    with pytest.raises(Killed):
        write(Store(spark, str(tmp_path)))
    monkeypatch.undo()
    other = Store(spark, str(tmp_path))
    new = [1, 2] if how == "append" else [2]
    stands = after and step in ("_point", "_rename")  # the pointer was there already
    assert _held(other) == (new if stands else [1]) and _held(other, "b") == [9]
    assert len(other.versions()) == len(before) + stands
    other.commit(c=_rows(spark, 3))
    assert other.names() == {"a", "b", "c"} and _held(other) == (new if stands else [1])
    assert write(other) and _held(other) == ([1, 2, 2] if stands and how == "append" else new)


@pytest.mark.parametrize("left", ["", "a\t/x\n", '{"tables": {"a": {"key": null'])
def test_pointers_without_an_end_are_passed_over(spark, tmp_path, left):
    store = Store(spark, str(tmp_path))
    store.commit(a=_rows(spark, 1), b=_rows(spark, 2))
    (tmp_path / "_commits" / "00000002").write_text(left)
    again = Store(spark, str(tmp_path))
    assert _held(again) == [1] and again.versions() == ["00000001"]
    with pytest.raises(ValueError):
        again.read("a", version="00000002")
    assert again.commit(c=_rows(spark, 3)) == "00000003" and again.names() == {"a", "b", "c"}
    assert (tmp_path / "_commits" / "00000002").read_text() == left


def test_commits_at_once(spark, tmp_path, monkeypatch):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    one.commit(a=_rows(spark, 1), log=_rows(spark, 1))
    whole = Store._point
    other = {"name": "b"}

    def overtaken(self, held):  # another commit takes the number after this one has chosen it
        if other:
            name = other.pop("name")
            numbers = self._numbers()
            two.commit(**{name: _rows(spark, 7)})
            monkeypatch.setattr(Store, "_numbers", lambda s: numbers)
            try:
                return whole(self, held)
            finally:
                monkeypatch.setattr(Store, "_numbers", numbers_of)
        return whole(self, held)

    numbers_of = Store._numbers
    monkeypatch.setattr(Store, "_point", overtaken)
    one.commit(a=_rows(spark, 2))
    assert _held(one) == [2] and _held(one, "b") == [7]  # the other table is not lost
    other["name"] = "log"
    one.append(log=_rows(spark, 2))
    assert _held(one, "log") == [2, 7]  # appended to what the other commit left
    other["name"] = "a"
    with pytest.raises(Conflict):
        one.commit(a=_rows(spark, 3))
    assert _held(one) == [7]
    assert not [x for x in os.listdir(tmp_path / "_commits") if x.startswith(".") and not x.endswith(".crc")]


def test_logs_stay_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "FANOUT", 3)
    store = Store(spark, str(tmp_path), keep=2)
    most = 0
    for n in range(28):
        store.append(log=_rows(spark, n), other=_rows(spark, -n)) if n == 5 else store.append(log=_rows(spark, n))
        most = max(most, len(store._tables()["log"].parts))
    assert _held(store, "log") == list(range(28)) and _held(store, "other") == [-5]
    assert most <= 2 * 4 and len(store.versions()) == 2
    assert len(os.listdir(tmp_path / "log")) <= 2 * most
    assert max(p.level for p in store._tables()["log"].parts) == 3


def test_a_merge_writes_the_buckets_it_touches(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = lambda numbers, tag: spark.createDataFrame([(f"f{n}", f"{tag}{i}") for n in numbers for i in range(3)], "file string, x string")
    files = lambda *names: spark.createDataFrame([(n,) for n in names], "file string")
    store.commit(t=Merge(rows(range(200), "a"), "file", files()))
    before = store._tables()["t"]
    first = store.versions()[-1]
    assert len(before.parts) > 40
    store.commit(t=Merge(rows([5], "b"), "file", files("f5", "f7", "gone")))  # one changes, one goes, one never was
    after = store._tables()["t"]
    assert len(set(after.paths) - set(before.paths)) <= 3 and len(set(before.paths) & set(after.paths)) >= len(before.parts) - 3
    got = {(r.file, r.x) for r in store.read("t").collect()}
    assert got == {(f"f{n}", f"{'b' if n == 5 else 'a'}{i}") for n in range(200) if n != 7 for i in range(3)} and store.read("t").count() == 597
    assert store.read("t", version=first).count() == 600  # what was read before is there still
    store.commit(t=Merge(rows([], "c"), "file", files(*(f"f{n}" for n in range(200)))))
    assert store.read("t").count() == 0 and store.read("t").columns == ["file", "x"]
    store.commit(plain=rows([1, 2], "a"))
    store.commit(plain=Merge(rows([2], "b"), "file", files("f2")))  # laid out anew
    assert {r.x for r in store.read("plain").filter(F.col("file") == "f2").collect()} == {"b0", "b1", "b2"} and store.read("plain").count() == 6


def test_sweep_and_vacuum(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for n in range(3):
        store.commit(a=_rows(spark, n), b=Merge(_rows(spark, n), "n", _rows(spark)))
    store._written("a", _rows(spark, 99))  # of a writer that died
    assert store.sweep(hours=1) == 0 and store.sweep(hours=-1) == 1
    assert [_held(store), _held(store, "b")] == [[2], [0, 1, 2]] and store.read("a", version=store.versions()[0]).first().n == 0
    store.vacuum(1)
    assert [_held(store), _held(store, "b")] == [[2], [0, 1, 2]] and len(store.versions()) == 1
    assert store.sweep(hours=-1) >= 0 and _held(store, "b") == [0, 1, 2]
