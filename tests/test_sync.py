import random

import pytest

from loam.streaming.sync import SyncedTable

SCHEMA = "k string, at long, n long, v string"


def expected(writes):
    held = {}
    for w in writes:
        if w[0] not in held or (w[1], w[2]) >= held[w[0]][1:3]:
            held[w[0]] = w
    return sorted(map(str, held.values()))


def opened(spark, path, **how):
    return SyncedTable(spark, f"file://{path}", spark.createDataFrame([], SCHEMA).schema, "k", ["at", "n"], **how)


def rows(table):
    return sorted(map(str, map(tuple, table.rows().collect())))


def test_any_order_and_replays(spark, tmp_path):
    """Batches in any order, delivered twice, with a null key and several writes of a key, end in the last writes."""
    draw, writes = random.Random(1), []
    for n in range(120):
        writes.append((draw.choice(["a", "b", "c", None, *map(str, range(20))]), draw.randrange(30), n, f"v{n}"))
    batches = [writes[k : k + 20] for k in range(0, 120, 20)]
    table, done = opened(spark, tmp_path / "t", buckets=5), []
    assert rows(table) == []
    for number, k in enumerate([3, 0, 5, 1, 4, 2]):
        table.upsert(spark.createDataFrame(batches[k], SCHEMA), number)
        done += batches[k]
        assert rows(table) == expected(done)
        table.upsert(spark.createDataFrame([("a", 999, 999, "never")], SCHEMA), number)  # the number is known
        assert rows(table) == expected(done)
    again = opened(spark, tmp_path / "t", buckets=5)
    again.upsert(spark.createDataFrame(batches[0], SCHEMA), 0, stream="another")  # old writes of another stream lose
    assert rows(again) == expected(writes)
    again.tidy()
    assert rows(again) == expected(writes) and len(again._commits()) == 1


def test_only_touched_folders_change(spark, tmp_path):
    table = opened(spark, tmp_path / "t", buckets=8)
    table.upsert(spark.createDataFrame([(str(k), 1, 1, "x") for k in range(50)], SCHEMA), 0)
    before = table.state()["folders"]
    table.upsert(spark.createDataFrame([("7", 2, 1, "y")], SCHEMA), 1)
    after = table.state()["folders"]
    assert len(before) > 4 and sum(before[b] != after[b] for b in before) == 1
    table.upsert(spark.createDataFrame([], SCHEMA), 2)
    assert table.state()["folders"] == after and table.state()["batches"] == {"default": 2}


def test_failure_before_the_commit(spark, tmp_path, monkeypatch):
    """A batch that fails leaves the table as it was, and goes in when it is delivered again; a second writer of a version fails."""
    table = opened(spark, tmp_path / "t")
    table.upsert(spark.createDataFrame([("a", 1, 1, "x")], SCHEMA), 0)
    own = table._commit

    def lost(state):
        raise OSError("lost")

    monkeypatch.setattr(table, "_commit", lost)
    with pytest.raises(OSError, match="lost"):
        table.upsert(spark.createDataFrame([("a", 2, 1, "y")], SCHEMA), 1)
    assert rows(table) == [str(("a", 1, 1, "x"))]
    monkeypatch.setattr(table, "_commit", own)
    table.upsert(spark.createDataFrame([("a", 2, 1, "y")], SCHEMA), 1)
    assert rows(table) == [str(("a", 2, 1, "y"))]
    with pytest.raises(RuntimeError, match="another writer"):
        table._commit(table.state())
