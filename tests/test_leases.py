"""Leases: no job is held twice, and who slept through a lease can't publish."""

from concurrent.futures import ThreadPoolExecutor

from loomstone.sources.leases import Files, Queue

JOBS = "job long, task string, run_after double, depends_on long"


class Clock:
    now = 1000.0

    def __call__(self):
        return self.now


def queue(spark, folder, rows, **more):
    clock = Clock()
    return Queue(spark.createDataFrame(rows, JOBS), str(folder), clock=clock, **more), clock


def test_a_name_is_put_once(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda k: files.put("a/b", str(k)), range(50))) == 1


def test_concurrent_workers_never_hold_one_job(spark, tmp_path):
    q, _ = queue(spark, tmp_path, [(k, "t", None, None) for k in range(60)])
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda w: [x for x in (q.take(job, f"w{w}") for job in range(60)) if x], range(6)))
    held = [x.job for part in got for x in part]
    assert sorted(held) == list(range(60))
    assert q.ready().count() == 0


def test_lowest_ready_first_and_dependencies(spark, tmp_path):
    rows = [(5, "a", None, None), (2, "b", 2000.0, None), (3, "b", 900.0, 5), (9, "b", None, None), (None, "a", None, None), (7, None, None, None)]
    q, clock = queue(spark, tmp_path, rows)
    assert [x.job for x in q.claim("w", 10, ["b"])] == [9]
    (lease,) = q.claim("w", 1)
    assert lease.job == 5 and q.finish(lease, "w", "ok") and not q.finish(lease, "w")
    assert [x.job for x in q.claim("w", 10)] == [3, 7]
    clock.now = 2000.0
    q.claim("v", 1)
    assert [r.job for r in q.states().where("done").collect()] == [5]


def test_an_expired_holder_is_refused(spark, tmp_path):
    q, clock = queue(spark, tmp_path, [(1, "a", None, None)], lease_seconds=10)
    (old,) = q.claim("slow", 1)
    assert q.claim("other", 1) == []
    clock.now += 11
    assert not q.finish(old, "slow")  # though nobody has claimed it yet
    (new,) = q.claim("other", 1)
    assert new.token == old.token + 1
    assert q.renew(old, "slow") is None and not q.finish(old, "slow")
    assert q.finish(new, "other") and q.claim("third", 1) == []


def test_renewed_leases_hold_and_attempts_run_out(spark, tmp_path):
    q, clock = queue(spark, tmp_path, [(1, "a", None, None)], lease_seconds=10, most_attempts=2)
    (lease,) = q.claim("w", 1)
    clock.now += 8
    lease = q.renew(lease, "w")
    clock.now += 8
    assert q.claim("v", 1) == []  # renewed
    clock.now += 8
    assert len(q.claim("v", 1)) == 1
    clock.now += 11
    assert q.claim("v", 1) == [] and q.ready().count() == 0  # failed after two


def test_a_holder_that_died_while_claiming(spark, tmp_path):
    q, clock = queue(spark, tmp_path, [(1, "a", None, None)], lease_seconds=10)
    q.files.put("tokens/00000000000000000001/000001", "died before its lease was written")
    assert q.claim("w", 1) == []  # from here on it has a lease
    clock.now += 11
    (lease,) = q.claim("w", 1)
    assert lease.token == 2


def test_no_jobs(spark, tmp_path):
    q, _ = queue(spark, tmp_path, [])
    assert q.claim("w", 3) == [] and q.states().count() == 0
