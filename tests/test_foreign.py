"""A foreign table read by two cursors, and a sink that publishes each batch once."""

import os
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq

from loomstone.sources import foreign


def store(path, rows, name="a"):
    path.mkdir(exist_ok=True)
    table = pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    pq.write_table(table, path / f"{name}.parquet", row_group_size=3)


def seen(spark, t, folder):
    rows = foreign.published(spark, f"{folder}/rows", foreign.ForeignRows({"path": str(t)}).schema())
    return Counter((r.id, r._kind) for r in rows.collect())


def test_new_rows_first_then_older_ones_again(spark, tmp_path):
    t, folder = tmp_path / "t", str(tmp_path / "w")
    store(t, [(k, f"row {k}") for k in (5, 1, 9, 3, 7)])
    assert foreign.sweep_once(spark, str(t), "id", folder, 3)["mark"] == 5
    assert seen(spark, t, folder) == Counter({(1, "new"): 1, (3, "new"): 1, (5, "new"): 1})
    at = foreign.sweep_once(spark, str(t), "id", folder, 3)  # two new ones, one read again
    assert (at["mark"], at["lap"], at["cursor"]) == (9, 0, 1)
    store(t, [(11, "late"), (3, "repeated id below the mark")], "b")
    at = foreign.sweep_once(spark, str(t), "id", folder, 3)  # 11 is new, then 3 and 3
    assert (at["mark"], at["cursor"]) == (11, 3)
    got = seen(spark, t, folder)
    assert got[(11, "new")] == 1 and got[(3, "rescan")] == 2 and all(got[(k, "new")] == 1 for k in (1, 3, 5, 7, 9))


def test_a_change_is_seen_when_its_row_is_read_again(spark, tmp_path):
    t, folder = tmp_path / "t", str(tmp_path / "w")
    store(t, [(k, f"row {k}") for k in range(6)] + [(None, "no key")])
    foreign.sweep_once(spark, str(t), "id", folder, 100)
    store(t, [(k, "edited" if k == 4 else f"row {k}") for k in range(6)])
    assert foreign.sweep_once(spark, str(t), "id", folder, 100)["lap"] == 1
    rows = foreign.published(spark, f"{folder}/rows", foreign.ForeignRows({"path": str(t)}).schema())
    assert [tuple(r) for r in foreign.changed(rows, "id", ["text"]).collect()] == [(4, 2)]


def test_a_crash_between_publishing_and_checkpoint_repeats_nothing(spark, tmp_path):
    t, folder = tmp_path / "t", str(tmp_path / "w")
    store(t, [(k, f"row {k}") for k in range(10)])
    foreign.sweep_once(spark, str(t), "id", folder, 4)
    files = set(os.listdir(f"{folder}/rows/data"))
    for name in ("0", ".0.crc"):  # the sink has the batch, the checkpoint doesn't know
        os.remove(f"{folder}/checkpoint/commits/{name}")
    foreign.sweep_once(spark, str(t), "id", folder, 4)  # the run after a crash ends with the repeated batch
    assert files == set(os.listdir(f"{folder}/rows/data")) and seen(spark, t, folder) == Counter({(k, "new"): 1 for k in range(4)})
    while foreign.sweep_once(spark, str(t), "id", folder, 4)["mark"] < 9:
        pass
    got = seen(spark, t, folder)
    assert {k for k, kind in got if kind == "new"} == set(range(10)) and all(got[(k, "new")] == 1 for k in range(10))


def test_a_crash_before_publishing_loses_nothing(spark, tmp_path):
    t, folder = tmp_path / "t", str(tmp_path / "w")
    store(t, [(k, f"row {k}") for k in range(10)])
    foreign.sweep_once(spark, str(t), "id", folder, 4)
    for name in ("0", ".0.crc"):
        os.remove(f"{folder}/checkpoint/commits/{name}")
    (manifest,) = os.listdir(f"{folder}/rows/manifest")
    os.remove(f"{folder}/rows/manifest/{manifest}")
    while foreign.sweep_once(spark, str(t), "id", folder, 4)["mark"] < 9:
        pass
    got = seen(spark, t, folder)
    assert {k for k, kind in got if kind == "new"} == set(range(10)) and all(got[(k, "new")] == 1 for k in range(10))


def test_an_empty_table(spark, tmp_path):
    t, folder = tmp_path / "t", str(tmp_path / "w")
    store(t, [])
    assert foreign.sweep_once(spark, str(t), "id", folder)["mark"] == foreign.FIRST
    assert not seen(spark, t, folder)
