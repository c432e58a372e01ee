"""The cooldown as keyed state against a plain walk, for any cut into batches and after restarts."""

import random
from datetime import datetime, timedelta

import pytest

from waitwright.operators import allocate as al
from waitwright.streaming import cooldown as keyed

START = datetime(2024, 3, 1)
SCHEMA = ("site string, run_time timestamp, department string, wait_time double, "
          "queue_length int, utilization double, current_counters int")


def runs_of(seed, sites=4, count=60):
    rng = random.Random(seed)
    return sorted((START + timedelta(minutes=rng.randrange(0, 900), seconds=rng.choice([0, 30])),
                   f"s{rng.randrange(sites)}") for _ in range(count))


def walk(runs, minutes=15):
    last, kept = {}, set()
    for at, site in sorted(set(runs)):
        if site not in last or at - last[site] >= timedelta(minutes=minutes):
            last[site] = at
            kept.add((site, at))
    return kept


def write(spark, folder, runs):
    rows = [(s, at, d, 50.0, 3, 0.5, None if d == "OPD" else 3)
            for at, s in runs for d in ("OPD", "Pharmacy")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, tmp_path):
    feed = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder))
    states = al.department_states(feed, by=("site", "run_time"))
    query = keyed.allocate_keyed(states, str(tmp_path / "h"), str(tmp_path / "c"))
    query.awaitTermination()
    return query


def kept_of(spark, tmp_path):
    rows = spark.read.parquet(str(tmp_path / "h")).collect()
    return rows, {(r.site, r.run_time) for r in rows if r.reasoning != al.COOLING}


@pytest.mark.parametrize("cuts", [[60], [7, 30, 60]])
def test_equals_a_plain_walk_for_any_cut(spark, tmp_path, cuts):
    runs, folder, start = runs_of(5), str(tmp_path / "s"), 0
    for stop in cuts:
        write(spark, folder, runs[start:stop])
        start = stop
    run(spark, folder, tmp_path)
    rows, kept = kept_of(spark, tmp_path)
    assert len(rows) == 2 * len(runs)
    assert kept == walk(runs)


def test_goes_on_after_a_restart_and_forgets_idle_sites(spark, tmp_path):
    runs, folder = runs_of(8), str(tmp_path / "s")
    write(spark, folder, runs[:25])
    run(spark, folder, tmp_path)
    write(spark, folder, [*runs[25:], (START + timedelta(days=2), "late")])
    query = run(spark, folder, tmp_path)
    rows, kept = kept_of(spark, tmp_path)
    assert kept == walk([*runs, (START + timedelta(days=2), "late")])
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(held) == 1 + len({s for _, s in runs}) and held[-1] == 1


def test_rows_without_site_or_time_and_a_run_in_two_batches(spark, tmp_path):
    folder, at = str(tmp_path / "s"), START
    rows = [(None, at, "OPD", 1.0, 1, 0.5, 2), ("a", None, "OPD", 1.0, 1, 0.5, 2),
            ("a", at, "OPD", 50.0, 1, 0.5, 2)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(folder)
    run(spark, folder, tmp_path)
    again = [("a", at, "Pharmacy", 50.0, 1, 0.5, 2)]
    spark.createDataFrame(again, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, tmp_path)
    rows, kept = kept_of(spark, tmp_path)
    assert sorted(r.department for r in rows) == ["OPD", "Pharmacy"] and kept == {("a", at)}


def test_the_session_keeps_its_store(spark, tmp_path):
    before = spark.conf.get(keyed.STORE, None)
    write(spark, str(tmp_path / "s"), runs_of(1)[:3])
    run(spark, str(tmp_path / "s"), tmp_path)
    assert spark.conf.get(keyed.STORE, None) == before
