from datetime import datetime, timedelta
from itertools import product

import numpy as np
import pytest

from waitwright.functions.rules import recommendation_alerts
from waitwright.operators import allocate as al
from waitwright.operators import report
from waitwright.settings import DEPARTMENTS, Department, Thresholds

CURRENT = {"OPD": 4, "Diagnostics": 3, "Pharmacy": 3}
PREDICTION = "snapshot int, department string, predicted_wait double, current_counters int"
STATE = ("snapshot int, department string, wait_time double, queue_length int, "
         "arrival_rate double, utilization double, current_counters int")

GOLDEN = [
    ((28.5, 22.3, 15.1), "linear_programming", (7, 6, 2), (17.1, 16.725, 3.775)),
    ((28.5, 22.3, 15.1), "greedy", (8, 5, 2), (22.8, 11.15, 3.775)),
    ((25.5, 18.3, 12.1), "linear_programming", (7, 6, 2), (15.3, 13.725, 3.025)),
    ((25.5, 18.3, 12.1), "greedy", (8, 5, 2), (20.4, 9.15, 3.025)),
]


def predictions(table, waits, snapshot=1):
    return table(PREDICTION, [(snapshot, d, w, CURRENT[d]) for d, w in zip(CURRENT, waits)])


@pytest.mark.parametrize("waits, method, counters, reductions", GOLDEN)
def test_golden_recommendations(table, waits, method, counters, reductions):
    result = al.recommend(predictions(table, waits), method, ordered=True)
    rows = {r["department"]: r for r in result.collect()}
    assert tuple(rows[d]["recommended_counters"] for d in CURRENT) == counters
    assert [rows[d]["action"] for d in CURRENT] == ["increase", "increase", "decrease"]
    assert [rows[d]["expected_wait_reduction"] for d in CURRENT] == pytest.approx(reductions)
    weights = {d.department: d.priority_weight for d in DEPARTMENTS}
    assert [rows[d]["priority_score"] for d in CURRENT] == pytest.approx(
        [w * weights[d] for d, w in zip(CURRENT, waits)])
    alerts = recommendation_alerts(result).collect()
    assert [(a["department"], a["alert"]) for a in alerts] == [("OPD", "HIGH WAIT")]
    assert [r["department"] for r in result.collect()] == list(CURRENT)


def test_justification_text(table):
    rows = al.recommend(predictions(table, (28.5, 22.3, 15.1))).collect()
    text = {r["department"]: r["justification"] for r in rows}
    assert text["OPD"] == ("High predicted wait time (28.5 min). Increase counters from 4 to 7 "
                           "to reduce congestion.")
    assert text["Pharmacy"] == ("Low predicted wait time (15.1 min). Reduce counters from 3 to 2 "
                                "to optimize staff utilization.")


def test_too_few_staff_keep_minimums(table):
    rows = al.recommend(predictions(table, (28.5, 22.3, 15.1)), staff=5).collect()
    assert {r["recommended_counters"] for r in rows} == {2}
    assert not any(r["feasible"] for r in rows)


def test_unknown_department_or_missing_counters_fail(table):
    for row in [(1, "Annex", 20.0, 3), (1, "OPD", 20.0, None)]:
        with pytest.raises(Exception, match="no (settings|current counters) for department"):
            al.recommend(table(PREDICTION, [row])).collect()


def states(table, rows):
    return al.department_states(table(STATE, rows))


def test_fill_equals_exhaustive_search(table):
    rng = np.random.default_rng(11)
    rows, cases = [], []
    for snapshot in range(60):
        names = rng.permutation([d.department for d in DEPARTMENTS])[: rng.integers(2, 5)]
        for d in sorted(names):
            rows.append((snapshot, str(d), float(rng.uniform(1, 60)), int(rng.integers(0, 25)),
                         1.0, float(rng.uniform(0, 1)), 3))
        cases.append(sorted(map(str, names)))
    settings = {d.department: d for d in DEPARTMENTS}
    limits = Thresholds(total_staff=14)
    result = al.allocate(states(table, rows), "linear_programming", limits=limits).collect()
    for snapshot, names in enumerate(cases):
        got = {r["department"]: r["recommended_counters"] for r in result
               if r["snapshot"] == snapshot}
        ranges = [range(settings[d].min_counters, settings[d].max_counters + 1) for d in names]
        exact = [x for x in product(*ranges) if sum(x) == 14]
        if not exact:
            continue
        value = lambda x: sum(settings[d].priority_weight * c for d, c in zip(names, x))
        assert sum(got.values()) == 14
        assert value([got[d] for d in names]) == pytest.approx(max(map(value, exact)))


def test_greedy_equals_one_at_a_time(table):
    rng = np.random.default_rng(4)
    rows = [(s, d.department, float(rng.uniform(1, 60)), int(rng.integers(0, 25)), 1.0,
             float(rng.uniform(0, 1)), 3) for s in range(40) for d in DEPARTMENTS]
    settings = {d.department: d for d in DEPARTMENTS}
    got = {(r["snapshot"], r["department"]): r["recommended_counters"]
           for r in al.allocate(states(table, rows)).collect()}
    for snapshot in range(40):
        here = [r for r in rows if r[0] == snapshot]
        given = {r[1]: settings[r[1]].min_counters for r in here}
        need = {r[1]: (r[2] / 15 * 0.4 + r[3] / 10 * 0.3 + r[5] * 0.3)
                * settings[r[1]].priority_weight for r in here}
        for _ in range(15 - sum(given.values())):
            open_ = [d for d in given if given[d] < settings[d].max_counters]
            given[max(open_, key=need.get)] += 1
        assert {d: got[(snapshot, d)] for d in given} == given


def test_hybrid_and_fallback(table):
    calm = (1, "OPD", 10.0, 3, 1.0, 0.5, 4), (1, "Pharmacy", 5.0, 2, 1.0, 0.5, 3)
    busy = (2, "OPD", 50.0, 3, 1.0, 0.5, 4), (2, "Emergency", 5.0, 2, 1.0, 0.5, 3)
    rows = al.allocate(states(table, [*calm, *busy]), "hybrid").collect()
    reasons = {r["snapshot"]: r["reasoning"] for r in rows}
    assert reasons[1] != "Optimal LP allocation" and reasons[2] == "Optimal LP allocation"
    # 15 staff cannot be used up by two departments with at most 13 counters: greedy instead.
    rows = al.allocate(states(table, list(calm)), "linear_programming").collect()
    assert {r["department"]: r["recommended_counters"] for r in rows} == {"OPD": 8, "Pharmacy": 5}
    assert all(r["reasoning"].startswith("Increase by") for r in rows)


def test_states_take_defaults(table):
    row = states(table, [(1, "Annex", None, None, None, None, None)]).first()
    assert (row["current_counters"], row["queue_length"], row["predicted_wait_time"],
            row["arrival_rate"], row["utilization"], row["service_rate"]) == (
        2, 0, 0.0, 1.0, 0.5, 7.5)
    assert (row["min_counters"], row["max_counters"], row["priority_weight"]) == (1, 5, 1.0)


def test_separate_current_counters(table):
    given = table("snapshot int, department string, current_counters int", [(1, "OPD", 6)])
    base = table(STATE, [(1, "OPD", 1.0, 1, 1.0, 0.5, 2), (1, "Pharmacy", 1.0, 1, 1.0, 0.5, 3)])
    rows = al.department_states(base, given).collect()
    assert {r["department"]: r["current_counters"] for r in rows} == {"OPD": 6, "Pharmacy": 2}


def needed(wait, queue, rate, current, d=Department("OPD", 2, 8, 15, 1.0)):
    """Plain restatement for one department."""
    capacity = 60 / d.avg_service_time
    need = (current or d.min_counters) if wait <= 15 else int(
        np.ceil((rate + queue / 0.25) / capacity))
    if current:
        load = rate / (current * capacity)
        if load > 0.85:
            need = max(need, int(np.ceil(current * (load / 0.85))))
        elif load < 0.6 and current > d.min_counters:
            need = min(need, max(d.min_counters, current - 1))
    return max(d.min_counters, min(d.max_counters, need))


def test_staff_needed(table):
    cases = [(w, q, r, c) for w in (5.0, 15.0, 16.0, 50.0) for q in (0, 3, 12)
             for r in (0.5, 9.0, 14.0, 40.0) for c in (0, 1, 2, 4, 8)]
    rows = [(i, "OPD", w, q, r, 0.5, c) for i, (w, q, r, c) in enumerate(cases)]
    got = states(table, rows).select("snapshot", al.staff_needed().alias("n")).collect()
    assert {r["snapshot"]: r["n"] for r in got} == {
        i: needed(*case) for i, case in enumerate(cases)}


def runs(table, minutes, site="s"):
    start = datetime(2024, 1, 1)
    return table("site string, run_time timestamp_ntz",
                 [(site, start + timedelta(minutes=m)) for m in minutes])


def kept_minutes(result, site="s"):
    start = datetime(2024, 1, 1)
    return sorted((r["run_time"] - start).total_seconds() / 60 for r in result.collect()
                  if r["kept"] and r["site"] == site)


def test_golden_cooldown(table):
    assert kept_minutes(al.cooldown(runs(table, [0, 5, 14, 15, 16, 29, 31, 40]))) == [0, 15, 31]


@pytest.mark.parametrize("block_rows", [7, 64, 2048])
def test_long_dense_history_with_a_hot_site(table, block_rows):
    rng = np.random.default_rng(8)
    dense = sorted({float(m) for m in np.cumsum(rng.exponential(1.0, 3000)).round(3)})
    other = [0.0, 20.0, 21.0]
    both = runs(table, dense, "hot").unionByName(runs(table, other, "cold"))
    expected, last = [], None
    for m in dense:
        if last is None or m - last >= 15:
            expected.append(m)
            last = m
    result = al.cooldown(both, block_rows=block_rows)
    assert kept_minutes(result, "hot") == pytest.approx(expected)
    assert kept_minutes(result, "cold") == [0, 20]
    assert result.count() == len(dense) + 3


def test_cooldown_of_no_runs_and_of_runs_without_a_site(table):
    assert al.cooldown(runs(table, [])).count() == 0
    loose = runs(table, [0, 5, 15], None).unionByName(runs(table, [1, 2], "s"))
    kept = {(r["site"], r["run_time"].minute): r["kept"] for r in al.cooldown(loose).collect()}
    assert kept == {(None, 0): True, (None, 5): False, (None, 15): True,
                    ("s", 1): True, ("s", 2): False}


def test_cooldown_runs_no_python():
    import inspect
    assert "InPandas" not in inspect.getsource(al) and "mapIn" not in inspect.getsource(al)


def test_held_runs_report_the_current_state(table):
    start = datetime(2024, 1, 1)
    schema = ("site string, run_time timestamp_ntz, department string, wait_time double, "
              "queue_length int, utilization double, current_counters int")
    rows = [("s", start + timedelta(minutes=m), d, 50.0, 3, 0.5, c)
            for m in (0, 5) for d, c in (("OPD", 3), ("Pharmacy", None))]
    ready = al.department_states(table(schema, rows), by=("site", "run_time"))
    got = al.allocate_with_cooldown(ready, al.cooldown(ready)).collect()
    held = {r["department"]: r for r in got if r["run_time"] > start}
    assert held["OPD"]["recommended_counters"] == 3
    assert held["Pharmacy"]["recommended_counters"] == 2
    assert {r["reasoning"] for r in held.values()} == {"Cooldown period active"}
    assert held["OPD"]["alert_level"] == "critical"
    first = {r["department"]: r for r in got if r["run_time"] == start}
    assert first["OPD"]["recommended_counters"] == 8


def test_summary(table):
    result = al.allocate(states(table, [(1, "OPD", 50.0, 3, 1.0, 0.5, 4),
                                        (1, "Pharmacy", 5.25, 2, 1.0, 0.5, 5)]))
    row = report.allocation_summary(result).first()
    assert row["average_wait_time"] == 27.62
    assert row["departments_needing_increase"] == ["OPD"]
    assert row["alerts_critical"] == ["OPD"] and row["alerts_normal"] == ["Pharmacy"]
    assert row["staff_change"] == row["total_staff_recommended"] - row["total_staff_current"]


def test_history_grows_by_runs_and_repeats_replace(spark, table, tmp_path):
    path = str(tmp_path / "h")
    runs = [table("run_time timestamp_ntz, n int", [(datetime(2024, 1, day), n) for n in range(3)])
            for day in (1, 2)]
    for rows in (*runs, runs[0]):
        al.append_history(rows, path)
    assert spark.read.parquet(path).count() == 6
    later = table("run_time timestamp_ntz, n int, job string", [(datetime(2024, 1, 1), 9, "x")])
    for _ in range(2):
        al.append_history(later, path, run="job")
    days = {str(r["run_date"]): r["count"] for r in
            spark.read.parquet(path).groupBy("run_date").count().collect()}
    assert days == {"2024-01-01": 4, "2024-01-02": 3}
