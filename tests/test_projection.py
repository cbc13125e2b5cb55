"""Snapshots plus suffix, and the stream, against a fold of the whole log."""

import random
from datetime import datetime, timedelta

from loomstone.operators.folding import rebuild
from loomstone.streaming import projection as P

LOG = "seq long, ts timestamp_ntz, entity long, predicate long, value long, type string"
TYPES = ["asserted", "asserted", "confirmed", "corrected", "rehearsed", "verified", "contradicted", "retracted", "decayed", "noted"]
DAY = datetime(2024, 1, 1)


def events(n, seed):
    rnd = random.Random(seed)
    return [(i, DAY + timedelta(hours=rnd.randrange(24 * 40)), rnd.randrange(6), rnd.randrange(3), rnd.choice([None, 1, 2, 3, 4]) if i % 50 == 0 else rnd.randrange(9), rnd.choice(TYPES)) for i in range(n)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_random_cuts_equal_a_refold(spark, tmp_path):
    rnd = random.Random(1)
    log = events(300, 2)
    whole = spark.createDataFrame(log, LOG)
    for trial in range(2):
        p = P.Projection.create(spark, str(tmp_path / str(trial)))
        order = rnd.sample(log, len(log))  # every event after the first batch may be late
        cuts = [0, *sorted(rnd.sample(range(1, 300), 3)), 300]
        added = 0
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            batch = order[a:b] + rnd.sample(order[:b], min(b, 20))  # and some come again
            added += p.append(spark.createDataFrame(batch, LOG))
            if k in (0, 2):
                p.snapshot()
            p = P.Projection.open(spark, p.folder)
        assert added == 300
        assert rows(p.read()) == rows(rebuild(whole))
        for at in ("2024-01-10 12:00:00", "2023-01-01 00:00:00", "2025-01-01 00:00:00"):
            assert rows(p.read(at)) == rows(rebuild(whole, at))


def test_a_read_folds_the_suffix_only(spark, tmp_path):
    log = sorted(events(200, 3), key=lambda r: r[1])
    p = P.Projection.create(spark, str(tmp_path / "p"))
    for a, b in ((0, 80), (80, 160), (160, 200)):
        p.append(spark.createDataFrame(log[a:b], LOG))
        if b < 200:
            p.snapshot()
    files = p.read().inputFiles()
    assert any("/snapshot/" in f for f in files) and not any(part.folder in f for part in p.state.parts[:2] for f in files)
    at = log[100][1].strftime("%Y-%m-%d %H:%M:%S")
    assert p.start(at).parts == 1  # the second snapshot has later events
    assert rows(p.read(at)) == rows(rebuild(spark.createDataFrame(log, LOG), at))


def test_nothing_and_repeats(spark, tmp_path):
    p = P.Projection.create(spark, str(tmp_path / "p"))
    assert p.read().count() == 0
    p.snapshot()
    one = spark.createDataFrame([(1, DAY, 1, 1, 5, "asserted"), (1, DAY, 1, 1, 5, "asserted"), (None, DAY, 1, 1, 5, "asserted")], LOG)
    assert [p.append(one), p.append(one), p.append(one.limit(0))] == [1, 0, 0]
    p.snapshot()
    p.snapshot()
    assert len(p.state.snapshots) == 1 and p.read().first().supports == 1


def test_stream_with_late_and_repeated_rows_over_restarts(spark, tmp_path):
    """Each run takes up where the last ended; rows that come again within the watermark's reach count once."""
    log = sorted(events(240, 4), key=lambda r: r[1])
    source, work = str(tmp_path / "source"), str(tmp_path / "work")
    rnd = random.Random(5)
    for k in range(3):
        batch = log[80 * k : 80 * (k + 1)]
        again = [r for r in log[: 80 * k] if r[1] > batch[0][1] - timedelta(days=1)]
        late = batch[:5]
        batch = rnd.sample(batch, len(batch)) + again + late  # late: offered twice in one batch
        spark.createDataFrame(batch, LOG).coalesce(1).write.mode("append").parquet(source)
        got = P.stream_beliefs(spark.readStream.schema(LOG).parquet(source), work)
        assert rows(got) == rows(rebuild(spark.createDataFrame(log[: 80 * (k + 1)], LOG)))
