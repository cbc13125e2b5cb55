"""Sweeps that are resumed: what came before is not read again, and state goes on."""

from pyspark.sql import functions as F

from loomstone.streaming import sweeps


def test_a_sweep_is_resumed(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    source, work = f"{tmp_path}/in", f"{tmp_path}/work"

    def run():
        rows = spark.readStream.schema(events.schema).parquet(source)
        plain = sweeps.sweep(rows.where("value > 50").select("event_id"), f"{work}/a").count()
        state = sweeps.newest(sweeps.sweep(sweeps.fold_state(rows), f"{work}/b"))
        return plain, {r.user_id: (r.n, r.last_type) for r in state.collect()}

    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).coalesce(1).write.mode("append").parquet(source)
        got, state = run()
        seen = events.where(F.col("event_id") % 2 <= part)
        assert got == seen.where("value > 50").count()
        want = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("event_type", "event_id").alias("t")).collect()
        assert state == {r.user_id: (r.n, r.t) for r in want}
    assert run() == (got, state)  # nothing new, nothing twice
