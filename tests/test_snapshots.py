"""Commits of the snapshot store: a writer that stops or comes second leaves a store that commits again."""

import pytest

from terravane.sources.snapshots import SnapshotStore


def test_a_writer_that_stops_leaves_nothing_in_the_way(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.commit({"t": spark.range(2)}) == 1
    with monkeypatch.context() as m:
        m.setattr(SnapshotStore, "_name", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.commit({"t": spark.range(3)})
    (tmp_path / "s/manifest/.left").write_text("{")
    assert store.read("t").count() == 2
    assert store.commit({"t": spark.range(4)}) == 2 and store.read("t").count() == 4


def test_the_second_of_two_writers_fails_and_can_try_again(spark, tmp_path, monkeypatch):
    one, two = (SnapshotStore(spark, str(tmp_path / "s")) for _ in range(2))
    one.commit({"t": spark.range(1)})
    at = two.current()
    with monkeypatch.context() as m:
        m.setattr(two, "current", lambda: at)
        one.commit({"t": spark.range(5)})
        with pytest.raises(RuntimeError, match="another writer"):
            two.commit({"t": spark.range(9)})
    assert two.read("t").count() == 5
    assert two.commit({"t": spark.range(9)}) == 3 and one.read("t").count() == 9 and one.read("t", 2).count() == 5
