"""Independent SQL for the catalogue's queries, run by another engine to check results.

The statements share no code with the operators and often take another route: allocation
ranks single counters, the cooldown recurses, lags use global windows.
"""

from __future__ import annotations

VISITS = """visits as (
select event_id as patient_id, ts as arrival_time,
  case event_type when 'signup' then 'Diagnostics' when 'purchase' then 'Pharmacy'
                  when 'error' then 'Emergency' else 'OPD' end as department,
  value as waiting_time,
  user_id % 20 as queue_length_at_arrival,
  2 + event_id % 6 as total_counters_available,
  cast(regexp_extract(props, '([0-9]+)', 1) as double) / cast(100 as double) as system_utilization,
  cast(50 + user_id % 50 as double) / cast(100 as double) as doctor_efficiency,
  case when event_type = 'error' then 1 else 0 end as is_emergency,
  count(*) over (partition by event_type, date_trunc('hour', ts)) as arrivals_this_hour,
  cast(5 + event_id % 26 as double) as service_duration_expected,
  case user_id % 3 when 0 then 'low' when 1 then 'medium' else 'high' end as patient_complexity,
  case when cast(ts as date) = date '2024-01-01' then 1 else 0 end as is_holiday
from events)"""

DIRTY = VISITS + """, spoiled as (
select * replace (
  case when patient_id % 17 = 0 then null when patient_id % 101 = 0 then -waiting_time
       else waiting_time end as waiting_time,
  case when patient_id % 23 = 0 then null else department end as department)
from visits), dirty as (
select * from spoiled union all select * from spoiled where patient_id % 50 = 0)"""

FILLED = DIRTY + """, tidy as (select distinct * from dirty), filled as (
select * replace (
  coalesce(waiting_time, (select quantile_cont(waiting_time, 0.5) from tidy)) as waiting_time,
  coalesce(department, (select department from tidy where department is not null
    group by department order by count(*) desc, department limit 1)) as department)
from tidy)"""

FEED = VISITS + """, feed as (
select arrival_time as "timestamp", department, queue_length_at_arrival as queue_length,
  waiting_time as wait_time, arrivals_this_hour as arrivals_per_hour,
  total_counters_available as active_counters, patient_id
from visits), latest as (
select * from feed
qualify row_number() over (partition by department order by "timestamp" desc, patient_id desc) = 1)"""

DAILY = VISITS + """, daily as (
select cast(arrival_time as date) as snapshot, department,
  cast(sum(cast(round(waiting_time * 100) as bigint)) as double) / cast(100 * count(*) as double)
    as wait_time,
  cast(max(queue_length_at_arrival) as integer) as queue_length,
  cast(count(*) as double) / cast(24 as double) as arrival_rate,
  cast(sum(cast(round(system_utilization * 100) as bigint)) as double)
    / cast(100 * count(*) as double) as utilization,
  cast(min(total_counters_available) as integer) as current_counters
from visits group by 1, 2),
settings(department, lo, hi, svc, weight) as (values
  ('OPD', 2, 8, 15.0::double, 1.0::double), ('Diagnostics', 2, 6, 20.0::double, 1.2::double),
  ('Pharmacy', 2, 5, 8.0::double, 0.8::double), ('Emergency', 3, 10, 10.0::double, 2.0::double)),
state as (
select d.*, s.lo, s.hi, s.svc, s.weight,
  (wait_time / 15.0::double * 0.4::double + queue_length / 10.0::double * 0.3::double
   + utilization * 0.3::double) * weight as score,
  wait_time * weight as priority,
  sum(lo) over (partition by snapshot) as lows, sum(hi) over (partition by snapshot) as highs
from daily d join settings s using (department))"""


def _ranked(name: str, key: str) -> str:
    """Counters per department when single extra counters are handed out by descending key."""
    return f""", {name}_units as (
select snapshot, department, lows, row_number() over (
  partition by snapshot order by {key} desc, department, n) as place
from state, lateral (select unnest(range(1, hi - lo + 1)) as n)), {name} as (
select s.snapshot, s.department, cast(s.lo + coalesce(u.extra, 0) as integer) as recommended
from state s left join (
  select snapshot, department, count(*) as extra from {name}_units where place <= 15 - lows
  group by 1, 2) u using (snapshot, department))"""


BY_PRIORITY = DAILY + _ranked("chosen", "priority")
BY_WEIGHT = DAILY + _ranked("chosen", "weight")
BY_SCORE = DAILY + _ranked("chosen", "score")

CHANGE = """case when recommended > current_counters then 'Increase by '
    || (recommended - current_counters) || ' counter(s) to reduce wait time'
  when recommended < current_counters then 'Decrease by ' || (current_counters - recommended)
    || ' counter(s) due to low utilization'
  else 'Maintain current allocation' end"""

LEVEL = """case when {wait} > 45 or {queue} > 22.5 then 'critical'
  when {wait} > 30 or {queue} > 15 then 'warning' else 'normal' end"""

BOTH = (DAILY + _ranked("scored", "score") + _ranked("weighted", "weight") + """, fits as (
select *, lows <= 15 and highs >= 15 as usable,
  max(case when wait_time > 45 or queue_length > 15 then 1 else 0 end)
    over (partition by snapshot) = 1 as urgent
from state)""")


def _either(condition: str) -> str:
    return f""", chosen as (
select f.*, {condition} as exact,
  case when {condition} then w.recommended else s.recommended end as recommended
from fits f join scored s using (snapshot, department)
join weighted w using (snapshot, department))"""


EQUALITY, HYBRID = BOTH + _either("usable"), BOTH + _either("usable and urgent")

RECOMMENDED = BY_WEIGHT + """, advice as (
select s.snapshot, s.department, s.current_counters, c.recommended, s.wait_time, s.priority,
  case when c.recommended > s.current_counters then 'increase'
       when c.recommended < s.current_counters then 'decrease' else 'maintain' end as action,
  abs(s.wait_time * (cast(s.current_counters - c.recommended as double)
    / cast(s.current_counters + 1 as double))) as reduction
from state s join chosen c using (snapshot, department))"""

PERIOD = """case when hour(arrival_time) between 6 and 8 then 'early_morning'
  when hour(arrival_time) between 9 and 11 then 'peak_morning'
  when hour(arrival_time) between 12 and 16 then 'afternoon'
  when hour(arrival_time) between 17 and 19 then 'evening' else 'night' end"""

CALENDAR = f"""cast(hour(arrival_time) as integer) as hour,
  cast(isodow(arrival_time) - 1 as integer) as day_of_week,
  cast(day(arrival_time) as integer) as day_of_month,
  cast(month(arrival_time) as integer) as month,
  cast(week(arrival_time) as integer) as week_of_year,
  cast(isodow(arrival_time) >= 6 as integer) as is_weekend,
  cast(isodow(arrival_time) = 1 as integer) as is_monday,
  {PERIOD} as time_period"""


def _wave(function: str, value: str, period: int, name: str) -> str:
    return f"round({function}(2 * pi() * {value} / {period}::double), 6) + 0.0::double as {name}"


WAVES = ", ".join(
    _wave(f, value, period, f"{prefix}_{f}")
    for value, period, prefix in (("hour(arrival_time)", 24, "hour"),
                                  ("(isodow(arrival_time) - 1)", 7, "day"),
                                  ("month(arrival_time)", 12, "month"))
    for f in ("sin", "cos"))


def _mean(column: str, scale: int, frame: str) -> str:
    return (f"(cast(sum(cast(round({column} * {scale}) as bigint)) over {frame} as double) / "
            f"({scale}.0::double * count({column}) over {frame}))")


ORDER = "order by arrival_time, patient_id"


def _rows(first: str, last: str) -> str:
    return f"({ORDER} rows between {first} and {last})"


def _history(scale: int, source: str) -> str:
    """Lags and trailing means over the whole table in arrival order."""
    head = f"(select waiting_time from {source} {ORDER} limit 1)"
    shifted = {k: _mean("waiting_time", scale, _rows(f"{k} preceding", "1 preceding"))
               for k in (5, 10)}
    current = {k: _mean("queue_length_at_arrival", 1, _rows(f"{k - 1} preceding", "current row"))
               for k in (3, 5)}
    return f"""
  coalesce(lag(waiting_time, 1) over ({ORDER}), {head}) as prev_wait_1,
  coalesce(lag(waiting_time, 2) over ({ORDER}), {head}) as prev_wait_2,
  coalesce({shifted[5]}, {head}) as rolling_wait_5,
  coalesce({shifted[10]}, {head}) as rolling_wait_10,
  {current[3]} as rolling_queue_3, {current[5]} as rolling_queue_5"""


def _ranks(column: str, source: str) -> str:
    return (f"(select {column} as v, row_number() over (order by {column}) - 1 as code "
            f"from (select distinct {column} from {source}))")


def _pearson(source: str, columns: list[str]) -> str:
    cells = [f"select '{a}' as \"row\", '{b}' as \"column\", round(corr({a}, {b}), 6) "
             f"as correlation from {source}" for a in columns for b in columns]
    return " union all ".join(cells)


def _fence(column: str, source: str) -> str:
    low, high = (f"(select quantile_cont({column}, {q}) from {source})" for q in (0.25, 0.75))
    return (f"{column} >= {low} - 1.5::double * ({high} - {low}) and "
            f"{column} <= {high} + 1.5::double * ({high} - {low})")


PRICES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MISSING_TIDY = " + ".join(f"cast({c} is null as integer)" for c in ("waiting_time", "department"))

STATEMENTS: dict[str, str] = {}

# --- cleaning ---------------------------------------------------------------------------------
STATEMENTS["dedupe_visits"] = f"with {DIRTY} select distinct * from dirty"
STATEMENTS["impute_visits"] = (
    f"with {FILLED} select * replace (round(waiting_time, 6) as waiting_time) from filled")
STATEMENTS["carry_calendar"] = f"""with {VISITS}, gaps as (
select patient_id, arrival_time,
  case when patient_id % 5 <> 0 then cast(hour(arrival_time) as integer) end as hour,
  case when patient_id % 7 <> 0 and patient_id > 300
       then cast(isodow(arrival_time) - 1 as integer) end as day_of_week
from visits)
select patient_id, arrival_time,
  coalesce(last_value(hour ignore nulls) over {_rows('unbounded preceding', 'current row')},
    first_value(hour ignore nulls) over {_rows('current row', 'unbounded following')}) as hour,
  coalesce(last_value(day_of_week ignore nulls) over {_rows('unbounded preceding', 'current row')},
    first_value(day_of_week ignore nulls) over {_rows('current row', 'unbounded following')})
    as day_of_week
from gaps"""
STATEMENTS["missing_cells"] = f"""with {DIRTY}, whole as (
select * replace (
  coalesce(waiting_time, (select quantile_cont(waiting_time, 0.5) from dirty)) as waiting_time,
  coalesce(department, (select department from dirty where department is not null
    group by department order by count(*) desc, department limit 1)) as department) from dirty)
select 'before' as step, cast(sum({MISSING_TIDY}) as bigint) as missing_values from dirty
union all select 'after', cast(sum({MISSING_TIDY}) as bigint) from whole"""
STATEMENTS["quality_report"] = f"""with {DIRTY}, counts as (
select count(*) as total_records, cast(sum({MISSING_TIDY}) as bigint) as missing_values,
  count(*) - (select count(*) from (select distinct * from dirty)) as duplicate_rows,
  count(*) filter (where waiting_time < 0) as negative_waiting_times,
  count(*) filter (where arrival_time > timestamp '2024-01-20 00:00:00') as future_dates,
  cast(0 as bigint) as invalid_departments
from dirty)
select *, greatest(0.0::double, 100.0::double - cast(missing_values + duplicate_rows
  + negative_waiting_times + future_dates as double) / cast(total_records as double)
  * 100.0::double) as data_quality_score from counts"""


def _duplicates(source: str, missing: str) -> str:
    return f"""counts as (
select (select count(*) from {source}) as original_size, count(*) as distinct_size,
  cast(sum({missing}) as bigint) as missing_after_dedupe
from (select distinct * from {source}))
select *, original_size - distinct_size as duplicates_removed,
  cast(original_size - distinct_size as double) / cast(original_size as double) * 100.0::double
    as duplicate_percent from counts"""


STATEMENTS["cleaning_stats"] = f"with {DIRTY}, {_duplicates('dirty', MISSING_TIDY)}"
STATEMENTS["outlier_iqr"] = (
    f"with {VISITS} select patient_id, waiting_time from visits "
    f"where {_fence('waiting_time', 'visits')}")
STATEMENTS["outlier_quantile"] = f"""with {VISITS} select patient_id, waiting_time from visits
where waiting_time >= (select quantile_cont(waiting_time, 0.01) from visits)
  and waiting_time <= (select quantile_cont(waiting_time, 0.99) from visits)"""
STATEMENTS["outlier_zscore"] = f"""with {DIRTY} select patient_id, waiting_time from dirty
where abs((waiting_time - (select avg(waiting_time) from dirty))
  / (select stddev_samp(waiting_time) from dirty)) < 3"""
STATEMENTS["lineitem_distinct_prices"] = f"""with prices as (
select {', '.join(PRICES)} from lineitem), {_duplicates('prices', '0')}"""
STATEMENTS["lineitem_fences"] = (
    f"select l_orderkey, l_linenumber, {', '.join(PRICES)} from lineitem where "
    + " and ".join(_fence(c, "lineitem") for c in PRICES))
STATEMENTS["lineitem_quantile_range"] = """select l_orderkey, l_linenumber, l_extendedprice
from lineitem
where l_extendedprice between (select quantile_cont(l_extendedprice, 0.01) from lineitem)
  and (select quantile_cont(l_extendedprice, 0.99) from lineitem)"""
STATEMENTS["lineitem_deviation"] = """select l_orderkey, l_linenumber, l_extendedprice
from lineitem
where abs((l_extendedprice - (select avg(l_extendedprice) from lineitem))
  / (select stddev_samp(l_extendedprice) from lineitem)) < 1.5"""
STATEMENTS["lineitem_correlation"] = _pearson("lineitem", PRICES)
STATEMENTS["cleaned_efficiency"] = f"""with {DIRTY}, tidy as (select distinct * from dirty),
kept as (select * from tidy
where waiting_time >= (select quantile_cont(waiting_time, 0.01) from tidy)
  and waiting_time <= (select quantile_cont(waiting_time, 0.99) from tidy)), means as (
select department,
  cast(sum(cast(round(waiting_time * 100) as bigint)) as double) / (100.0::double * count(*))
    as avg_wait,
  cast(sum(queue_length_at_arrival) as double) / cast(count(*) as double) as avg_queue
from kept group by 1)
select *, greatest(0.0::double, (1.0::double - avg_wait / 60.0::double) * 100.0::double)
  as efficiency from means"""

# --- features ---------------------------------------------------------------------------------
STATEMENTS["feat_temporal"] = (
    f"with {VISITS} select patient_id, arrival_time, {CALENDAR} from visits")
STATEMENTS["feat_cyclical"] = f"with {VISITS} select patient_id, {WAVES} from visits"
LOADS = """queue_length_at_arrival * system_utilization
    / cast(total_counters_available + 1 as double) as workload_index,
  cast(arrivals_this_hour as double) / cast(total_counters_available + 1 as double)
    as arrival_pressure,
  doctor_efficiency - system_utilization as efficiency_gap,
  cast(queue_length_at_arrival as double) / cast(total_counters_available + 1 as double)
    as capacity_ratio,
  system_utilization * arrivals_this_hour as utilization_load"""
STATEMENTS["feat_interaction_a"] = f"with {VISITS} select patient_id, {LOADS} from visits"
STATEMENTS["feat_interaction_b"] = f"""with {VISITS} select patient_id,
  queue_length_at_arrival * system_utilization as queue_pressure,
  cast(total_counters_available as double) / cast(queue_length_at_arrival + 1 as double)
    as counters_per_patient,
  queue_length_at_arrival * system_utilization / cast(total_counters_available + 1 as double)
    as workload_index,
  hour(arrival_time) * queue_length_at_arrival as hour_queue_interaction,
  doctor_efficiency - system_utilization as efficiency_gap from visits"""
LOGS = """round(ln(1 + queue_length_at_arrival::double), 6) as log_queue,
  round(sqrt(arrivals_this_hour::double), 6) as sqrt_arrivals,
  round(ln(1 + service_duration_expected), 6) as log_service_time"""
STATEMENTS["feat_transform"] = f"with {VISITS} select patient_id, {LOGS} from visits"
STATEMENTS["feat_peak_flags"] = f"""with {VISITS} select patient_id,
  cast(hour(arrival_time) as integer) as hour,
  cast(hour(arrival_time) in (9, 10, 11, 12) as integer) as is_peak_hours,
  cast(hour(arrival_time) in (16, 17, 18, 19) as integer) as is_evening from visits"""
STATEMENTS["feat_threshold_flags"] = f"""with {VISITS}, rates as (
select *, cast(arrivals_this_hour as double) / 24.0::double as arrival_rate from visits)
select patient_id,
  cast(arrival_rate > (select quantile_cont(arrival_rate, 0.75) from rates) as integer)
    as high_arrival_rate,
  cast(total_counters_available <= (select quantile_cont(total_counters_available, 0.25)
    from rates) as integer) as low_capacity from rates"""
STATEMENTS["feat_util_onehot"] = f"""with {VISITS} select patient_id, system_utilization,
  system_utilization > 0 and system_utilization <= 0.5 as util_low,
  system_utilization > 0.5 and system_utilization <= 0.75 as util_medium,
  system_utilization > 0.75 and system_utilization <= 0.9 as util_high,
  system_utilization > 0.9 and system_utilization <= 1 as util_critical from visits"""
STATEMENTS["feat_dept_onehot"] = f"""with {VISITS} select patient_id, department,
  department = 'Diagnostics' as "dept_Diagnostics", department = 'Emergency' as "dept_Emergency",
  department = 'OPD' as "dept_OPD", department = 'Pharmacy' as "dept_Pharmacy" from visits"""
STATEMENTS["encode_ordinal"] = f"""with {VISITS}, coded as (
select *, {PERIOD} as time_period from visits)
select patient_id, cast(d.code as integer) as department_enc,
  cast(c.code as integer) as patient_complexity_enc, cast(t.code as integer) as time_period_enc
from coded join {_ranks('department', 'coded')} d on d.v = department
join {_ranks('patient_complexity', 'coded')} c on c.v = patient_complexity
join {_ranks('time_period', 'coded')} t on t.v = time_period"""
STATEMENTS["encode_unseen"] = f"""with {VISITS} select patient_id,
  case department when 'Diagnostics' then 0 when 'OPD' then 1 when 'Pharmacy' then 2 else -1 end
    as department_marked,
  case department when 'OPD' then 1 when 'Pharmacy' then 2 else 0 end as department_first
from visits"""
STATEMENTS["encode_text_columns"] = f"""with {VISITS} select patient_id,
  cast(d.code as integer) as department, cast(c.code as integer) as patient_complexity
from visits join {_ranks('department', 'visits')} d on d.v = visits.department
join {_ranks('patient_complexity', 'visits')} c on c.v = visits.patient_complexity"""
STATEMENTS["standardize"] = f"with {VISITS} select patient_id, " + ", ".join(
    f"round(({c} - (select avg({c}) from visits)) / (select stddev_pop({c}) from visits), 6) "
    f"as {c}" for c in ("queue_length_at_arrival", "system_utilization", "doctor_efficiency")
) + " from visits"
STATEMENTS["align_features"] = f"""with {VISITS} select patient_id, system_utilization,
  cast(0 as integer) as not_recorded, queue_length_at_arrival from visits"""
STATEMENTS["drop_identifiers"] = f"""with {VISITS} select queue_length_at_arrival,
  total_counters_available, cast(arrivals_this_hour as double) / 24.0::double as arrival_rate,
  system_utilization, doctor_efficiency from visits"""
for _name, _columns in {
    "feat_lag": "prev_wait_1, prev_wait_2",
    "feat_rolling_shifted": "rolling_wait_5, rolling_wait_10",
    "feat_rolling_current": "rolling_queue_3, rolling_queue_5",
}.items():
    STATEMENTS[_name] = (f"with {VISITS}, history as (select patient_id, "
                         f"{_history(100, 'visits')} from visits) "
                         f"select patient_id, {_columns} from history")


def _lag_stats() -> str:
    columns = {}
    for k in (1, 2):
        columns[f"prev_wait_{k}"] = f"lag(waiting_time, {k}) over ({ORDER})"
        columns[f"prev_queue_{k}"] = f"lag(queue_length_at_arrival, {k}) over ({ORDER})"
    for k in (5, 10):
        frame = _rows(f"{k - 1} preceding", "current row")
        columns[f"rolling_wait_{k}"] = _mean("waiting_time", 100, frame)
        columns[f"rolling_wait_std_{k}"] = f"stddev_samp(waiting_time) over {frame}"
        columns[f"rolling_queue_{k}"] = _mean("queue_length_at_arrival", 1, frame)
    built = ", ".join(f"{sql} as {name}" for name, sql in columns.items())
    final = ", ".join(
        f"round(coalesce({c}, (select quantile_cont({c}, 0.5) from history))::double, 6) as {c}"
        for c in columns)
    return (f"with {VISITS}, history as (select patient_id, {built} from visits) "
            f"select patient_id, {final} from history")


STATEMENTS["feat_lag_median"] = _lag_stats()
_HISTORY_NAMES = ("prev_wait_1", "prev_wait_2", "rolling_wait_5", "rolling_wait_10",
                  "rolling_queue_3", "rolling_queue_5")
_LOAD_NAMES = ("workload_index", "arrival_pressure", "efficiency_gap", "capacity_ratio",
               "utilization_load")
STATEMENTS["feature_matrix"] = f"""with {FILLED}, kept as (
select * from filled
where waiting_time >= (select quantile_cont(waiting_time, 0.01) from filled)
  and waiting_time <= (select quantile_cont(waiting_time, 0.99) from filled)),
built as (
select *, {CALENDAR}, {WAVES}, {LOADS}, {LOGS}, {_history(1000, 'kept')} from kept)
select patient_id, round(waiting_time, 6) as waiting_time, hour, day_of_week, day_of_month, month,
  week_of_year, is_weekend, is_monday, is_holiday, queue_length_at_arrival, arrivals_this_hour,
  round(system_utilization, 6) as system_utilization, total_counters_available,
  round(doctor_efficiency, 6) as doctor_efficiency, is_emergency, service_duration_expected,
  {', '.join(f'round({c}, 6) as {c}' for c in _HISTORY_NAMES + _LOAD_NAMES)},
  log_queue, sqrt_arrivals, log_service_time, hour_sin, hour_cos, day_sin, day_cos, month_sin,
  month_cos, cast(d.code as integer) as department_enc,
  cast(c.code as integer) as patient_complexity_enc, cast(t.code as integer) as time_period_enc
from built join {_ranks('department', 'built')} d on d.v = department
join {_ranks('patient_complexity', 'built')} c on c.v = patient_complexity
join {_ranks('time_period', 'built')} t on t.v = time_period"""

STATEMENTS["step_stats"] = f"""with {FILLED}, sizes as (
select (select count(*) from dirty) as source, (select count(*) from tidy) as distinct_rows,
  (select count(*) from filled
   where waiting_time >= (select quantile_cont(waiting_time, 0.01) from filled)
     and waiting_time <= (select quantile_cont(waiting_time, 0.99) from filled)) as kept)
select metric, value from sizes, lateral (values ('original_size', source),
  ('duplicates_removed', source - distinct_rows), ('final_size', kept),
  ('waiting_time_outliers_removed', distinct_rows - kept), ('removed_records', source - kept),
  ('missing_values_filled', (select sum({MISSING_TIDY}) from tidy)::bigint),
  ('num_features', 38)) as t(metric, value)"""

# --- files ------------------------------------------------------------------------------------
STATEMENTS["csv_visits"] = f"""with {VISITS} select patient_id,
  case when patient_id % 10 <> 0 then arrival_time end as arrival_time, department,
  case when patient_id % 9 <> 0 then waiting_time end as waiting_time,
  cast(queue_length_at_arrival as integer) as queue_length_at_arrival from visits"""
STATEMENTS["recommendation_csv"] = f"""with {RECOMMENDED} select department as "Department",
  cast(current_counters as varchar) as "Current Counters",
  cast(recommended as varchar) as "Recommended Counters", upper(action) as "Action",
  round(wait_time, 6) as "Predicted Wait (min)" from advice"""
STATEMENTS["encoder_reload"] = STATEMENTS["encode_text_columns"]

# --- reports ----------------------------------------------------------------------------------
STATEMENTS["latest_by_department"] = f"with {FEED} select * from latest"
STATEMENTS["live_kpis"] = f"""with {FEED}, kpi as (
select cast(sum(queue_length) as bigint) as total_queue,
  cast(sum(cast(round(wait_time * 100) as bigint)) as double) / (100.0::double * count(*))
    as avg_wait, cast(sum(active_counters) as bigint) as total_counters from latest),
graded as (select *, greatest(0.0::double, (1.0::double - avg_wait / 60.0::double) * 100.0::double)
  as efficiency from kpi)
select *, case when total_queue < 50 then '✓ Normal' else '⚠ High' end as queue_verdict,
  case when avg_wait < 20 then '✓ Good' else '⚠ Above Target' end as wait_verdict,
  case when efficiency > 70 then '✓ Optimal' else '⚠ Below Target' end as efficiency_verdict
from graded"""
STATEMENTS["dept_efficiency"] = f"""with {FEED}, means as (
select department,
  cast(sum(cast(round(wait_time * 100) as bigint)) as double) / (100.0::double * count(*))
    as avg_wait,
  cast(sum(queue_length) as double) / cast(count(*) as double) as avg_queue
from feed group by 1)
select *, greatest(0.0::double, (1.0::double - avg_wait / 60.0::double) * 100.0::double)
  as efficiency from means"""
STATEMENTS["congestion_pivot"] = f"with {FEED} select department, " + ", ".join(
    f"cast(sum(cast(round(wait_time * 100) as bigint)) filter (where hour(\"timestamp\") = {h}) "
    f"as double) / (100.0::double * count(*) filter (where hour(\"timestamp\") = {h})) as hour_{h}"
    for h in range(24)) + " from feed group by department"
STATEMENTS["wait_correlation"] = f"with {FEED} " + _pearson(
    "feed", ["wait_time", "queue_length", "active_counters", "arrivals_per_hour"])
STATEMENTS["wait_distribution"] = f"""with {FEED} select department, round(min(wait_time), 6) as min,
  round(quantile_cont(wait_time, 0.25), 6) as q1, round(median(wait_time), 6) as median,
  round(quantile_cont(wait_time, 0.75), 6) as q3, round(max(wait_time), 6) as max
from feed group by department"""
STATEMENTS["trend_series"] = f"""with {FEED}
select "timestamp", department, 'wait_time' as series, wait_time as value from feed union all
select "timestamp", department, 'queue_length', cast(queue_length as double) from feed"""
STATEMENTS["target_summary"] = f"""with {VISITS} select count(waiting_time) as count,
  round(avg(waiting_time), 6) as mean, round(stddev_samp(waiting_time), 6) as std,
  round(min(waiting_time), 6) as min, round(max(waiting_time), 6) as max,
  round(quantile_cont(waiting_time, 0.25), 6) as q1, round(median(waiting_time), 6) as median,
  round(quantile_cont(waiting_time, 0.75), 6) as q3 from visits"""
STATEMENTS["distinct_departments"] = f"with {VISITS} select distinct department from visits"

# --- rules ------------------------------------------------------------------------------------
ALERT = """case when wait_time > 30 then 'error' else 'warning' end as level,
  case when wait_time > 30 then 'Critical' else 'Warning' end || ': ' || department || ' - '
    || printf('%.1f', wait_time) || ' min wait' as message"""
STATEMENTS["dept_status"] = f"""with {FEED} select patient_id, department,
  case when wait_time < 15 then 'Normal' when wait_time < 30 then 'Busy' else 'Critical' end
    as status,
  case when wait_time < 15 then 'Low' when wait_time < 30 then 'Medium' else 'High' end as urgency,
  case when wait_time > 25 then 'Action recommended: Consider adding counters or optimizing workflow' else 'Operating normally' end as action_hint
from feed"""
STATEMENTS["threshold_alerts"] = f"""with {FEED}
select department, {ALERT} from latest where wait_time > 20 union all
select null, 'success', 'All systems normal'
where not exists (select 1 from latest where wait_time > 20)"""
STATEMENTS["reading_alerts"] = (
    f"with {FEED} select patient_id, {ALERT} from feed where wait_time > 20")
STATEMENTS["wait_advice"] = f"""with {VISITS} select patient_id, concat_ws(' | ',
  case when waiting_time > 45 then '⚠️  CRITICAL: Wait time exceeds 45 minutes. Immediate counter increase required.'
       when waiting_time > 30 then '⚠️  WARNING: Wait time above acceptable threshold. Consider adding counters.' else '✓  Wait time within acceptable range.' end,
  case when system_utilization > 0.90 then '⚠️  System utilization critical. Staff are overloaded.'
       when system_utilization > 0.85 then '⚠️  High utilization. Monitor closely.' end,
  case when queue_length_at_arrival > 15 then '⚠️  Long queue detected. Consider capacity expansion.' end) as advice,
  concat_ws(' | ', case when waiting_time > 30 then 'High wait time detected. Consider adding more counters.' end,
  case when system_utilization > 0.85 then 'System utilization is critical. Immediate action recommended.' end,
  case when waiting_time <= 15 then 'Wait time is within acceptable range. System running smoothly.' end) as hints from visits"""
STATEMENTS["alert_level"] = f"""with {VISITS} select patient_id,
  {LEVEL.format(wait='waiting_time', queue='queue_length_at_arrival')} as alert_level
from visits"""

# --- allocation -------------------------------------------------------------------------------
_COUNTERS = "select snapshot, department, current_counters, recommended as recommended_counters"
_JOINED = "from state join chosen using (snapshot, department)"
STATEMENTS["alloc_greedy"] = f"with {BY_PRIORITY} {_COUNTERS}, lows <= 15 as feasible {_JOINED}"
STATEMENTS["alloc_weighted"] = f"with {BY_WEIGHT} {_COUNTERS}, lows <= 15 as feasible {_JOINED}"
STATEMENTS["alloc_score_greedy"] = f"with {BY_SCORE} {_COUNTERS}, {CHANGE} as reasoning {_JOINED}"
_REASON = f"case when exact then 'Optimal LP allocation' else {CHANGE} end as reasoning"
STATEMENTS["alloc_equality"] = f"with {EQUALITY} {_COUNTERS}, {_REASON} from chosen"
STATEMENTS["alloc_hybrid"] = f"""with {HYBRID} {_COUNTERS}, {_REASON},
  {LEVEL.format(wait='wait_time', queue='queue_length')} as alert_level from chosen"""
STATEMENTS["alloc_states"] = f"""with {DAILY} select snapshot,
  case when department = 'Pharmacy' then 'Annex' else department end as department, queue_length,
  case when department = 'Emergency' then 3 else current_counters end as current_counters,
  wait_time as predicted_wait_time, arrival_rate,
  60.0::double / case when department = 'Pharmacy' then 8.0::double else svc end as service_rate,
  case when department = 'OPD' then 0.5::double else utilization end as utilization
from state"""
STATEMENTS["alloc_staff_needed"] = f"""with {DAILY}, load as (
select *, arrival_rate / (current_counters * (60.0::double / svc)) as used,
  case when wait_time <= 15 then case when current_counters > 0 then current_counters else lo end
  else ceil((arrival_rate + queue_length / 0.25::double) / (60.0::double / svc)) end as need
from state)
select snapshot, department, current_counters, cast(greatest(lo, least(hi, case
  when current_counters > 0 and used > 0.85
    then greatest(need, ceil(current_counters * (used / 0.85::double)))
  when current_counters > lo and used < 0.60 then least(need, greatest(lo, current_counters - 1))
  else need end)) as integer) as needed from load"""
_REASONED = """case action
  when 'increase' then 'High predicted wait time (' || printf('%.1f', wait_time)
    || ' min). Increase counters from ' || current_counters || ' to ' || recommended
    || ' to reduce congestion.'
  when 'decrease' then 'Low predicted wait time (' || printf('%.1f', wait_time)
    || ' min). Reduce counters from ' || current_counters || ' to ' || recommended
    || ' to optimize staff utilization.'
  else 'Current allocation (' || current_counters
    || ' counters) is optimal for predicted wait time (' || printf('%.1f', wait_time)
    || ' min).' end as justification"""
STATEMENTS["alloc_recommendations"] = f"""with {RECOMMENDED} {_COUNTERS},
  round(wait_time, 6) as predicted_wait_time, round(reduction, 6) as expected_wait_reduction,
  round(priority, 6) as priority_score, action, {_REASONED} from advice"""
STATEMENTS["alloc_alerts"] = f"""with {RECOMMENDED}
select snapshot, department, 'HIGH WAIT' as alert, '[HIGH WAIT ALERT] ' || department
  || ': Predicted wait ' || printf('%.1f', wait_time)
  || ' min. Immediate counter increase recommended.' as message
from advice where action = 'increase' and wait_time > 25 union all
select snapshot, department, 'LOW LOAD', '[LOW LOAD ALERT] ' || department
  || ': Low demand detected. Staff can be reallocated.'
from advice where action = 'decrease' and wait_time < 10"""


def _names(condition: str) -> str:
    return (f"coalesce(string_agg(department, ',' order by department) "
            f"filter (where {condition}), '')")


STATEMENTS["alloc_summary"] = f"""with {HYBRID}, levelled as (
select *, {LEVEL.format(wait='wait_time', queue='queue_length')} as level from chosen)
select snapshot, cast(sum(current_counters) as bigint) as total_staff_current,
  cast(sum(recommended) as bigint) as total_staff_recommended,
  cast(sum(recommended) - sum(current_counters) as bigint) as staff_change,
  round_even(sum(cast(round(wait_time * 1000000) as bigint))::double
    / (1000000.0::double * count(*)) * 100, 0) / 100 as average_wait_time,
  {_names('recommended > current_counters')} as departments_needing_increase,
  {_names('recommended < current_counters')} as departments_can_decrease,
  {_names("level = 'critical'")} as alerts_critical,
  {_names("level = 'warning'")} as alerts_warning,
  {_names("level = 'normal'")} as alerts_normal
from levelled group by snapshot"""
STATEMENTS["alloc_long"] = f"""with {BY_SCORE}
select snapshot, department, 'Current' as series, current_counters as counters {_JOINED} union all
select snapshot, department, 'Recommended', recommended {_JOINED}"""
STATEMENTS["alloc_response"] = f"""with {BY_SCORE} {_COUNTERS},
  cast(printf('%.2f', wait_time) as double) as predicted_wait_time, queue_length,
  cast(printf('%.3f', utilization) as double) as utilization,
  {LEVEL.format(wait='wait_time', queue='queue_length')} as alert_level,
  {CHANGE} as reasoning {_JOINED}"""


def _kept_runs(runs: str) -> str:
    """Follow each site's kept runs one after the other."""
    return f"""runs as ({runs}), hops as (
select site, run_time, min(run_time) over (partition by site order by run_time
  range between interval 15 minute following and unbounded following) as next_time from runs),
kept(site, run_time) as (
select site, min(run_time) from runs group by site union all
select h.site, h.next_time from kept k join hops h using (site, run_time)
where h.next_time is not null),
marked as (select runs.site, runs.run_time, kept.run_time is not null as kept
from runs left join kept using (site, run_time))"""


STATEMENTS["alloc_cooldown"] = f"""with recursive {VISITS}, {_kept_runs(
    "select distinct department as site, date_trunc('minute', arrival_time) as run_time "
    "from visits")} select * from marked"""
STATEMENTS["alloc_with_cooldown"] = f"""with recursive {VISITS}, minutes as (
select 'main' as site, date_trunc('minute', arrival_time) as run_time, department,
  max(waiting_time) as wait_time, cast(max(queue_length_at_arrival) as integer) as queue_length,
  max(system_utilization) as utilization,
  cast(min(total_counters_available) as integer) as current_counters
from visits group by 1, 2, 3),
settings(department, lo, hi, weight) as (values ('OPD', 2, 8, 1.0::double),
  ('Diagnostics', 2, 6, 1.2::double), ('Pharmacy', 2, 5, 0.8::double),
  ('Emergency', 3, 10, 2.0::double)),
{_kept_runs("select distinct site, run_time from minutes")},
state as (
select m.*, kept, lo, hi, (wait_time / 15.0::double * 0.4::double
  + queue_length / 10.0::double * 0.3::double + utilization * 0.3::double) * weight as score,
  sum(lo) over (partition by run_time) as lows
from minutes m join marked using (site, run_time) join settings using (department)),
units as (
select run_time, department, lows,
  row_number() over (partition by run_time order by score desc, department, n) as place
from state, lateral (select unnest(range(1, hi - lo + 1)) as n)),
filled as (
select s.*, cast(case when kept then s.lo + coalesce(u.extra, 0) else current_counters end
  as integer) as recommended
from state s left join (select run_time, department, count(*) as extra from units
  where place <= 15 - lows group by 1, 2) u using (run_time, department))
select site, run_time, department, current_counters, recommended as recommended_counters,
  case when not kept then 'Cooldown period active' else {CHANGE} end as reasoning,
  {LEVEL.format(wait='wait_time', queue='queue_length')} as alert_level from filled"""

# --- scoring ----------------------------------------------------------------------------------
STATEMENTS["score_fallback"] = f"""with {VISITS} select patient_id,
  case when patient_id % 13 = 0 then waiting_time
  else cast(queue_length_at_arrival as double) / cast(total_counters_available as double)
    * 3.5::double end as prediction from visits"""
STATEMENTS["score_intervals"] = f"""with {VISITS}, clamped as (
select patient_id, greatest(waiting_time - 10.0::double, 0.0::double) as p from visits)
select patient_id, p as prediction, p * 0.85::double as lower, p * 1.15::double as upper,
  round_even(p * 0.85::double * 100.0::double, 0) / 100.0::double as shown_lower,
  round_even(p * 1.15::double * 100.0::double, 0) / 100.0::double as shown_upper,
  p * 0.15::double as std_error,
  greatest(p - 1.96::double * (p * 0.15::double), 0.0::double) as confidence_lower,
  p + 1.96::double * (p * 0.15::double) as confidence_upper from clamped"""
REQUESTS = VISITS + """, requests as (
select patient_id as request_id, cast(hour(arrival_time) as integer) as hour,
  queue_length_at_arrival - case when patient_id % 97 = 0 then 30 else 0 end as queue,
  case when patient_id % 89 = 0 then 0 else total_counters_available end as counters,
  system_utilization + case when patient_id % 83 = 0 then 1 else 0 end as used,
  case when patient_id % 7 <> 0 then doctor_efficiency end as grade,
  case when patient_id % 11 <> 0 then department end as department from visits)"""
STATEMENTS["score_contract"] = f"""with {REQUESTS} select request_id,
  coalesce(grade, 0.75::double) as doctor_efficiency, coalesce(department, 'OPD') as department,
  concat_ws(',', case when queue < 0 then 'queue_length_at_arrival' end,
    case when counters < 1 then 'total_counters_available' end,
    case when used > 1 or used < 0 then 'system_utilization' end) as violations from requests"""
STATEMENTS["serving_features"] = f"""with {FEED}, ready as (
select *, case when patient_id % 19 = 0 then 4 else active_counters end as counters from feed)
select patient_id, cast(hour("timestamp") as integer) as hour,
  cast(isodow("timestamp") - 1 as integer) as day_of_week,
  cast(isodow("timestamp") >= 6 as integer) as is_weekend,
  queue_length as queue_length_at_arrival, arrivals_per_hour as arrivals_this_hour,
  0.75::double as system_utilization, counters as total_counters_available,
  0.95::double as doctor_efficiency, cast(0 as integer) as is_emergency,
  cast(queue_length as double) / cast(counters as double) as queue_per_counter,
  0.95::double * arrivals_per_hour as efficiency_load,
  0.75::double * arrivals_per_hour as utilization_load,
  {_wave('sin', 'hour("timestamp")', 24, 'hour_sin')},
  {_wave('cos', 'hour("timestamp")', 24, 'hour_cos')},
  {_wave('sin', '(isodow("timestamp") - 1)', 7, 'day_sin')},
  {_wave('cos', '(isodow("timestamp") - 1)', 7, 'day_cos')},
  round(ln(1 + queue_length::double), 6) as log_queue,
  round(sqrt(arrivals_per_hour::double), 6) as sqrt_arrivals from ready"""
STATEMENTS["request_features"] = f"""with {REQUESTS} select request_id,
  {_wave('sin', 'hour', 24, 'hour_sin')}, {_wave('cos', 'hour', 24, 'hour_cos')},
  round(queue * used / nullif(counters, 0)::double, 6) as workload_index,
  case when queue > -1 then round(ln(1 + queue::double), 6) end as log_queue from requests"""
STATEMENTS["command_features"] = f"""with {REQUESTS}, more as (
select r.*, cast(isodow(arrival_time) - 1 as integer) as dow, month(arrival_time) as month
from requests r join visits on patient_id = request_id)
select request_id, cast(hour between 9 and 12 as integer) as is_peak_hours,
  cast(hour between 16 and 19 as integer) as is_evening, cast(dow >= 5 as integer) as is_weekend,
  queue * used / cast(counters + 1 as double) as workload_index, queue * used as queue_pressure,
  cast(counters as double) / cast(queue + 1 as double) as counters_per_patient,
  grade - used as efficiency_gap,
  {_wave('sin', 'hour', 24, 'hour_sin')}, {_wave('cos', 'hour', 24, 'hour_cos')},
  {_wave('sin', 'dow', 7, 'dow_sin')}, {_wave('cos', 'dow', 7, 'dow_cos')},
  {_wave('sin', 'month', 12, 'month_sin')}, {_wave('cos', 'month', 12, 'month_cos')},
  case when queue > -1 then round(ln(1 + queue::double), 6) end as log_queue from more"""
STATEMENTS["department_predictions"] = f"""with {FEED}, guess as (
select department, cast(queue_length as double) / cast(active_counters as double) * 3.5::double
  as p from latest)
select department, p as prediction,
  greatest(p - 1.96::double * (p * 0.15::double), 0.0::double) as confidence_lower,
  p + 1.96::double * (p * 0.15::double) as confidence_upper, p * 0.15::double as std_error
from guess"""

# --- models -----------------------------------------------------------------------------------
_HASH = "((({key}) % {bits} + {seed}) * 2654435761) % 4294967296"
STATEMENTS["split_hash"] = f"""with {VISITS}, hashed as (
select patient_id,
  {_HASH.format(key='patient_id', bits=2147483648, seed=42)} * 100 // 4294967296 as band,
  {_HASH.format(key='patient_id', bits=2147483648, seed=42)} as first,
  {_HASH.format(key='patient_id * 31 + 17', bits=2147483648, seed=43)} as second from visits)
select patient_id, case when band < 70 then 'train' when band < 85 then 'validation' else 'test' end
  as banded,
  case when first < cast(floor(0.15::double * 4294967296) as bigint) then 'test'
       when second < cast(floor(0.15::double / 0.85::double * 4294967296) as bigint)
       then 'validation' else 'train' end as stepped from hashed"""
STATEMENTS["split_time"] = f"""with {VISITS}, placed as (
select patient_id, arrival_time, row_number() over (order by arrival_time) - 1 as place,
  count(*) over () as n from visits), cuts as (
select max(arrival_time) filter (where place = floor(0.7::double * (n - 1))) as early,
  max(arrival_time) filter (where place = floor(0.85::double * (n - 1))) as late from placed)
select patient_id, case when arrival_time <= early then 'train'
  when arrival_time <= late then 'validation' else 'test' end as split from visits, cuts"""
STATEMENTS["regression_metrics"] = f"""with {VISITS}, scored as (
select waiting_time as y, cast(queue_length_at_arrival as double)
  / cast(total_counters_available as double) * 3.5::double as p from visits)
select count(*) as rows, round(sqrt(avg((y - p) * (y - p))), 6) as rmse,
  round(avg(abs(y - p)), 6) as mae,
  round(1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)), 6) as r2,
  round(avg(abs((y - p) / nullif(y, 0))) * 100, 6) as mape,
  count(*) filter (where y = 0) as zero_labels
from scored, (select avg(y) as m from scored)"""

_PREPARED = {
    "department": "case department when 'Diagnostics' then 0 when 'Emergency' then 1 "
                  "when 'OPD' then 2 else 3 end",
    "queue_length_at_arrival": "queue", "total_counters_available": "counters",
    "arrival_rate": "rate", "system_utilization": "used", "doctor_efficiency": "grade",
    "hour": "hour(arrival_time)", "day_of_week": "isodow(arrival_time) - 1",
    "month": "month(arrival_time)", "day_of_month": "day(arrival_time)",
    "is_weekend": "cast(isodow(arrival_time) > 5 as integer)",
    **{f"{short}_{wave}": f"{wave}(2 * pi() * ({part}) / {span}::double)"
       for short, part, span in (("hour", "hour(arrival_time)", 24),
                                 ("dow", "isodow(arrival_time) - 1", 7),
                                 ("month", "month(arrival_time)", 12))
       for wave in ("sin", "cos")},
    "is_peak_hours": "cast(hour(arrival_time) between 9 and 12 as integer)",
    "is_evening": "cast(hour(arrival_time) between 16 and 19 as integer)",
    **{name: f"coalesce({name}, (select quantile_cont({name}, 0.5) from rates))::double"
       for name in ("prev_wait_1", "prev_queue_1", "prev_wait_2", "prev_queue_2",
                    "rolling_wait_5", "rolling_wait_std_5", "rolling_queue_5",
                    "rolling_wait_10", "rolling_wait_std_10", "rolling_queue_10")},
    "queue_pressure": "queue * used",
    "counters_per_patient": "counters::double / (queue + 1)::double",
    "workload_index": "queue * used / (counters + 1)::double",
    "hour_queue_interaction": "hour(arrival_time) * queue", "efficiency_gap": "grade - used",
    **{f"dept_{name}": f"cast(department = '{name}' as integer)"
       for name in ("Diagnostics", "Emergency", "OPD", "Pharmacy")},
    "log_queue": "ln(1 + queue::double)",
    "high_arrival_rate": "cast(rate > (select quantile_cont(rate, 0.75) from rates) as integer)",
    "low_capacity": "cast(counters <= (select quantile_cont(counters, 0.25) from rates) "
                    "as integer)",
    "util_low": "cast(used > 0 and used <= 0.5 as integer)",
    "util_medium": "cast(used > 0.5 and used <= 0.75 as integer)",
    "util_high": "cast(used > 0.75 and used <= 0.9 as integer)",
    "util_critical": "cast(used > 0.9 and used <= 1 as integer)",
}
_MOMENTS = ", ".join(f'avg("{c}"::double) as "{c}_m", stddev_pop("{c}"::double) as "{c}_s"'
                     for c in _PREPARED)
_STANDARD = ", ".join(
    f'round(("{c}"::double - "{c}_m") / case when "{c}_s" = 0 then 1 else "{c}_s" end, 5) '
    f'+ 0.0::double as "{c}"' for c in _PREPARED)
_WIDE = ", ".join(f'{sql} as "{c}"' for c, sql in _PREPARED.items())
_ROLLING = ", ".join(
    [f"lag(waiting_time, {k}) over ({ORDER}) as prev_wait_{k}, "
     f"lag(queue_length_at_arrival, {k}) over ({ORDER}) as prev_queue_{k}" for k in (1, 2)]
    + [f"{_mean('waiting_time', 100, frame)} as rolling_wait_{k}, "
       f"stddev_samp(waiting_time) over {frame} as rolling_wait_std_{k}, "
       f"{_mean('queue_length_at_arrival', 1, frame)} as rolling_queue_{k}"
       for k, frame in ((k, _rows(f"{k - 1} preceding", "current row")) for k in (5, 10))])
STATEMENTS["prepared_splits"] = f"""with {VISITS}, rates as (
select patient_id, waiting_time, arrival_time, department, queue_length_at_arrival as queue,
  total_counters_available as counters, system_utilization as used, doctor_efficiency as grade,
  cast(arrivals_this_hour as double) / 24.0::double as rate, {_ROLLING} from visits),
wide as (select patient_id, waiting_time, {_WIDE} from rates),
kept as (
select *, {_HASH.format(key='patient_id', bits=2147483648, seed=42)} as first,
  {_HASH.format(key='patient_id * 31 + 17', bits=2147483648, seed=43)} as second from wide
where abs((waiting_time - (select avg(waiting_time) from wide))
  / (select stddev_samp(waiting_time) from wide)) < 3),
divided as (
select *, case when first < cast(floor(0.15::double * 4294967296) as bigint) then 'test'
  when second < cast(floor(0.15::double / 0.85::double * 4294967296) as bigint) then 'validation'
  else 'train' end as split from kept),
moments as (select {_MOMENTS} from divided where split = 'train')
select patient_id, split, waiting_time as wait_time_minutes, {_STANDARD}
from divided, moments"""

# --- facts about fitted models ----------------------------------------------------------------
_TEST_ORDERS = f"""(select count(*) from (select distinct l_orderkey as k from lineitem)
  where floor({_HASH.format(key='k', bits=2147483648, seed=42)} * 100 / 4294967296) >= 85)"""
STATEMENTS["model_compare"] = f"""select 2 as candidates, {_TEST_ORDERS} as scored_rows,
  true as best_has_least_rmse, true as all_beat_mean, true as rounds_within_limits"""
def _level(nodes: str, cells: str) -> str:
    """Best cut of each node: its feature, bin and sides."""
    return f"""sums{nodes} as (select node, f, bin, sum(sum(u)) over w as l,
    sum(count(*)) over w as nl, sum(sum(u)) over (partition by node, f) as t,
    sum(count(*)) over (partition by node, f) as nt from {cells} group by node, f, bin
    window w as (partition by node, f order by bin)),
  cut{nodes} as (select node, f, bin from (select *, row_number() over (partition by node order by
      (l::double * l / nl + (t - l)::double * (t - l) / (nt - nl)) - t::double * t / nt desc, f, bin)
      as place from sums{nodes} where nl >= 20 and nt - nl >= 20) where place = 1),
  side{nodes} as (select x.k, 2 * x.node + 1 + (x.bin > c.bin)::int as node
    from {cells} x join cut{nodes} c using (node, f)),
  cells{nodes} as (select x.k, x.f, x.bin, x.u, s.node from {cells} x join side{nodes} s using (k))"""


STATEMENTS["boost_tree"] = f"""with orders as (select l_orderkey as k, count(*)::double as f0,
    sum(round(l_quantity * 100)::bigint) / 100 as f1, max(l_quantity)::double as f2,
    sum(round(l_discount * 100)::bigint) / 100 / count(*) as f3,
    sum(round(l_extendedprice * 100)::bigint) / 100 as y from lineitem group by l_orderkey
    having floor({_HASH.format(key='l_orderkey', bits=2147483648, seed=42)} * 100 / 4294967296) < 70),
  facts as (select round(avg(y), 6) as base,
    greatest(max(y) - round(avg(y), 6), round(avg(y), 6) - min(y)) / 1048576 as unit from orders),
  long as (select k, round_even((y - base) / unit, 0)::bigint as u, unnest([0, 1, 2, 3]) as f,
    unnest([f0, f1, f2, f3]) as v from orders, facts),
  sorted as (select f, list_sort(list(v)) as vs, count(*) as n from long group by f),
  edges as (select distinct f, vs[1 + floor(i / 63.0 * (n - 1))::bigint] as edge
    from sorted, range(1, 63) as r(i)),
  places as (select f, edge, row_number() over (partition by f order by edge) as bin from edges),
  cells as (select x.k, x.f, x.u, 0 as node, coalesce(p.bin, 64) as bin
    from long x asof left join places p on x.f = p.f and x.v <= p.edge),
  {_level("0", "cells")}, {_level("1", "cells0")},
  cuts as (select * from cut0 union all select * from cut1),
  held as (select node, sum(u) as t, count(*) as n from (select node, u from cells where f = 0
    union all select node, u from cells0 where f = 0 union all
    select node, u from cells1 where f = 0) group by node)
select h.node::int as node, ['lines', 'quantity', 'largest', 'discount'][c.f + 1] as feature,
  p.edge as threshold, h.n::bigint as n,
  case when h.node = 0 then 0.0 else round(0.05 * h.t * unit / h.n, 4) end as value
from held h left join cuts c using (node) left join places p on c.f = p.f and c.bin = p.bin, facts"""
_VALUE_OF = ("case {f} when 'lines' then f0 when 'quantity' then f1 when 'largest' then f2 "
             "else f3 end")
# Every leaf is two cuts deep: a row meets (o) or misses each, r is the share of training rows.
STATEMENTS["boost_contributions"] = f"""with tree as ({STATEMENTS["boost_tree"].replace(
    "round(0.05 * h.t * unit / h.n, 4)", "0.05 * h.t * unit / h.n")}),
  tested as (select l_orderkey as k, count(*)::double as f0,
    sum(round(l_quantity * 100)::bigint) / 100 as f1, max(l_quantity)::double as f2,
    sum(round(l_discount * 100)::bigint) / 100 / count(*) as f3 from lineitem group by l_orderkey
    having floor({_HASH.format(key='l_orderkey', bits=2147483648, seed=42)} * 100 / 4294967296) >= 85),
  leaves as (select l.value as v, r.feature as fa, r.threshold as ta, p.node = 1 as la,
    p.n::double / r.n as ra, p.feature as fb, p.threshold as tb, l.node % 2 = 1 as lb,
    l.n::double / p.n as rb from tree l join tree p on p.node = (l.node - 1) // 2
    join tree r on r.node = 0 where l.node >= 3),
  met as (select *, (({_VALUE_OF.format(f="fa")} <= ta) = la)::int as oa,
    (({_VALUE_OF.format(f="fb")} <= tb) = lb)::int as ob from tested, leaves),
  parts as (select k, fa as feature, case when fa = fb then v * (oa * ob - ra * rb)
      else v * (oa - ra) * (ob + rb) / 2 end as part from met union all
    select k, fb, v * (ob - rb) * (oa + ra) / 2 from met where fa <> fb),
  inputs as (select k, unnest(['lines', 'quantity', 'largest', 'discount']) as feature,
    unnest([f0, f1, f2, f3]) as value from tested),
  totals as (select k, feature, sum(part) as part from parts group by 1, 2)
select k as "order", feature, value, round(coalesce(part, 0.0::double), 3) + 0.0::double
  as contribution from inputs left join totals using (k, feature)"""
STATEMENTS["model_stack"] = f"""select {_TEST_ORDERS} as scored_rows, 4 as bases, 4 as weights,
  true as beats_mean, true as never_negative"""
STATEMENTS["feature_importance"] = """select cast(4 as bigint) as features, 1.0::double as total,
  true as size_is_first"""
STATEMENTS["learning_curve"] = """select cast(15 as bigint) as rounds, true as learn_error_falls,
  true as best_agrees"""
STATEMENTS["score_batch"] = f"""with checked as ({STATEMENTS["score_contract"]})
select request_id, violations, violations = '' as predicted from checked"""
STATEMENTS["score_prepared"] = STATEMENTS["score_batch"]
STATEMENTS["run_reload"] = f"""with {FEED} select distinct department, true as same,
  true as predicted from latest"""
STATEMENTS["training_summary"] = f"""select 'SUCCESS' as status,
  (select count(*) from ({STATEMENTS["feature_matrix"]})) as samples,
  cast(38 as bigint) as features, 'trees' as name, true as has_error,
  (select count(*) from ({STATEMENTS["alloc_recommendations"]})) as recommendations_generated,
  (select count(*) from ({STATEMENTS["alloc_alerts"]})) as alerts_generated"""
STATEMENTS["csv_strict"] = f"""with {VISITS} select patient_id, arrival_time as "timestamp",
  department from visits"""
STATEMENTS["required_columns"] = """select 'whole' as name, true as valid, '' as missing,
  (select count(*) from events) as rows union all
select 'reduced', false, 'department,waiting_time', (select count(*) from events)"""
STATEMENTS["allocation_history"] = f"""with {BY_SCORE} {_COUNTERS}, snapshot as run_date
  {_JOINED}"""
_ASKED = {
    "department": "case coalesce(r.department, 'OPD') when 'Diagnostics' then 0 "
                  "when 'Emergency' then 1 when 'OPD' then 2 else 3 end",
    "dept_OPD": "cast(coalesce(r.department, 'OPD') = 'OPD' as integer)",
    "util_high": "cast(r.used > 0.75 and r.used <= 0.9 as integer)",
    "low_capacity": "cast(r.counters <= (select quantile_cont(counters, 0.25) from rates) "
                    "as integer)",
    "is_weekend": "cast(isodow(arrival_time) > 5 as integer)",
    "log_queue": "case when r.queue > -1 then ln(1 + r.queue::double) else 0 end",
    "workload_index": "r.queue * r.used / (r.counters + 1)::double",
    "hour_sin": "sin(2 * pi() * r.hour / 24::double)",
    "is_peak_hours": "cast(r.hour between 9 and 12 as integer)",
}
_FITTED = STATEMENTS["prepared_splits"].rpartition("select patient_id, split")[0].removeprefix(
    f"with {VISITS}, ")
STATEMENTS["prepared_requests"] = f"""with {REQUESTS}, {_FITTED.rstrip()},
asked as (select request_id, {", ".join(f'{q} as "{c}"' for c, q in _ASKED.items())}
  from requests r join visits on patient_id = request_id)
select request_id, {", ".join(
    f'round(("{c}"::double - "{c}_m") / case when "{c}_s" = 0 then 1 else "{c}_s" end, 5) '
    f'+ 0.0::double as "{c}"' for c in _ASKED)} from asked, moments"""

STATEMENTS["prepared_reload"] = STATEMENTS["prepared_requests"]

# --- moves, drift, folds ----------------------------------------------------------------------
STATEMENTS["alloc_moves"] = f"""with {DAILY}, needs as (
select *, utilization * current_counters as busy from state), raised as (
select *, greatest(lo, least(hi, ceil(round(busy / 0.85::double, 9)))) as up,
  floor(round(busy / 0.6::double, 9)) as enough from needs), bounds as (
select *, case when sum(up) over (partition by snapshot) <= 15 then up else lo end as low
from raised), spare as (
select *, greatest(low, least(hi, enough)) as high, 15 - sum(low) over (partition by snapshot)
  as spare, weight * wait_time * greatest(current_counters, 1)::double as value from bounds),
units as (
select snapshot, department, spare, k, value / (k::double * (k::double - 1))
  - case when k > current_counters then 5.0::double else 0.0::double end as gain
from (select *, unnest(range(low::int + 1, high::int + 1)) as k from spare)), ranked as (
select *, row_number() over (partition by snapshot order by gain desc, department, k) as place
from units where gain > 0), taken as (
select snapshot, department, count(*) as more from ranked where place <= spare group by 1, 2)
select snapshot, department, current_counters,
  (low + coalesce(more, 0))::int as recommended_counters,
  greatest(0, low + coalesce(more, 0) - current_counters)::int as moved,
  greatest(0, low + coalesce(more, 0) - current_counters)::int * 5.0::double as move_minutes,
  round(wait_time, 6) as wait_before,
  round(wait_time * greatest(current_counters, 1)::double / (low + coalesce(more, 0))::double, 6)
    as wait_after, spare >= 0 as feasible
from spare left join taken using (snapshot, department)"""
_ERRORS = f"""{VISITS}, scored as (
select department, cast(arrival_time as date) as day,
  cast(round(waiting_time * 100) as bigint) as y,
  cast(round(waiting_time * 100) as bigint) - cast(round(cast(queue_length_at_arrival as double)
    / cast(total_counters_available as double) * 3.5::double * 100) as bigint) as e from visits
where waiting_time is not null and queue_length_at_arrival is not null)"""
STATEMENTS["drift_retrain"] = f"""with {_ERRORS}, days as (
select department, day, count(*) as n, sum(e * e) as squared from scored group by 1, 2),
base as (
select department, sqrt(sum(squared)::double / sum(n)::double) / 100.0::double as base_rmse
from (select *, min(day) over (partition by department) as first from days)
where day < first + 7 group by 1), looked as (
select department, day, sum(n) over span as n, sum(squared) over span as squared from days
window span as (partition by department order by day
  range between interval 6 days preceding and current row)), judged as (
select department, day, n::bigint as n, sqrt(squared::double / n::double) / 100.0::double as rmse
from looked)
select department, day, n, round(rmse, 6) as rmse, round(base_rmse, 6) as base_rmse,
  n >= 1000 and rmse > 1.05::double * base_rmse as retrain from judged join base using (department)"""
STATEMENTS["drift_span"] = f"""with {_ERRORS}
select department, count(*) as n, round(sqrt(sum(e * e)::double / count(*)) / 100, 6) as rmse,
  round(sum(abs(e))::double / count(*) / 100, 6) as mae,
  round(sum(e)::double / count(*) / 100, 6) as bias,
  round(1 - sum(e * e)::double / (sum(y * y)::double - sum(y)::double * sum(y)::double / count(*)),
    6) as r2
from scored group by department"""
_CUTS = ", ".join(f"max(arrival_time) filter (where place = floor({round(i / 6, 10)}::double * "
                  f"(n - 1))) as b{i}" for i in range(1, 6))
_FOLDS = f"""{VISITS}, placed as (
select arrival_time, row_number() over (order by arrival_time) - 1 as place,
  count(*) over () as n from visits), cuts as (select {_CUTS} from placed), folds as (
select visits.*, {" + ".join(f"(arrival_time >= b{i})::int" for i in range(1, 6))} as fold,
  1 + {" + ".join(f"(arrival_time >= b{i} - interval 60 minutes)::int" for i in range(1, 6))}
    as trains_from from visits, cuts)"""
STATEMENTS["cv_folds"] = f"""with {_FOLDS} select patient_id, fold, trains_from from folds"""
STATEMENTS["cv_metrics"] = f"""with {_FOLDS}, pairs as (
select fold, trains_from, queue_length_at_arrival::double as x, waiting_time as y from folds),
fits as (
select f as fold, avg(x) as mx, avg(y) as my,
  (sum(x * y) - sum(x) * sum(y) / count(*)) / (sum(x * x) - sum(x) * sum(x) / count(*) + 1) as w
from pairs, range(1, 6) t(f) where trains_from <= f and x is not null and y is not null group by f),
errors as (
select fold, y, y - (my + w * (x - mx)) as e from pairs join fits using (fold)
where x is not null and y is not null)
select fold::int as fold, count(*) as rows, round(sqrt(avg(e * e)), 6) as rmse,
  round(avg(abs(e)), 6) as mae, round(1 - avg(e * e) / var_pop(y), 6) as r2
from errors group by fold"""

STATEMENTS["sketched_months"] = """with asked as (
select date_trunc('month', l_shipdate)::date as month, count(*) as rows from lineitem
where l_shipdate is not null and l_extendedprice is not null group by 1)
select month, unnest([0.01, 0.25, 0.5, 0.75, 0.99]::double[]) as prob, rows, rows as n,
  true as close from asked"""

# --- forecast ---------------------------------------------------------------------------------
_PLACE = "(h - h0)::double / greatest(h1 - h0, 1)::double"
_TERMS = ["level", "slope"] + [f"bend_{j}" for j in range(1, 26)] + [
    f"{name}_{part}_{k}" for name, order in (("daily", 4), ("weekly", 3))
    for k in range(1, order + 1) for part in ("sin", "cos")]
_VALUES = ["1.0::double", _PLACE] + [
    f"greatest({_PLACE} - {j} * 0.8::double / 25, 0.0::double)" for j in range(1, 26)] + [
    f"{wave}(2 * pi() * {k} * (h % {period})::double / {period}.0::double)"
    for period, order in ((24, 4), (168, 3)) for k in range(1, order + 1)
    for wave in ("sin", "cos")]
_P = len(_TERMS)
_FORECAST = f"""{VISITS}, cells as (
select department, floor(epoch(arrival_time) / 3600)::bigint as h, count(*) as n,
  sum(round(waiting_time * 1000000)::bigint)::double as u,
  sum(round(waiting_time * 1000000)::hugeint * round(waiting_time * 1000000)::hugeint)::double as q,
  max(abs(round(waiting_time * 1000000)::bigint))::double / 1000000.0::double as top
from visits where arrival_time is not null and waiting_time is not null group by 1, 2), spans as (
select department, min(h) as h0, max(h) as h1, sum(n) as n, max(top) as scale from cells group by 1),
design as (select c.department, c.n, u / (1000000.0::double * scale) as y,
  q / (1000000.0::double * scale * 1000000.0::double * scale) as yy,
  [{", ".join(_VALUES)}] as x from cells c join spans using (department)), entries as (
select department, i, j, sum(n * x[i] * x[j]) as v from design, range(1, {_P + 1}) a(i),
  range(1, {_P + 1}) b(j) group by 1, 2, 3 union all
select department, i, {_P + 1}, sum(x[i] * y) from design, range(1, {_P + 1}) a(i) group by 1, 2),
lines as (select department, i, list(v order by j) as raw,
  list(case when i <> j then v when i <= 2 then v + 0.04::double when i <= 27 then v + 400.0::double
    else v + 0.01::double end order by j) as ridged from entries group by 1, 2), systems as (
select department, list(raw order by i) as raw, list(ridged order by i) as m from lines group by 1),
steps(department, k, m) as (select department, 1, m from systems union all
  select department, k + 1, list_transform(m, lambda r, i: case when i = k
    then list_transform(r, lambda v: v / m[k][k])
    else list_transform(r, lambda v, j: v - r[k] * (m[k][j] / m[k][k])) end)
  from steps where k <= {_P}), solved as (
select department, list_transform(m, lambda r: r[{_P + 1}]) as w from steps where k = {_P + 1})"""
STATEMENTS["forecast_terms"] = f"""with recursive {_FORECAST}
select department, unnest({_TERMS}) as term, round(unnest(w), 6) as weight from solved"""
STATEMENTS["forecast_ahead"] = f"""with recursive {_FORECAST}, errors as (
select department, sqrt(sum(yy - 2 * y * list_dot_product(w, x)
  + n * list_dot_product(w, x) * list_dot_product(w, x)) / sum(n)) as deviation
from design join solved using (department) group by 1), coming as (
select department, h1 + s as h, h0, h1, scale from spans, range(1, 49) t(s)), guessed as (
select department, h, list_dot_product(w, [{", ".join(_VALUES)}]) * scale as forecast,
  1.96::double * deviation * scale as wide
from coming join solved using (department) join errors using (department))
select department, h as hour, timestamp '1970-01-01' + to_hours(h) as hour_start,
  round(forecast, 4) as forecast, round(forecast - wide, 4) as lower,
  round(forecast + wide, 4) as upper from guessed"""

# --- streams ----------------------------------------------------------------------------------
STATEMENTS["stream_latest"] = f"""with {FEED} select "timestamp", department, queue_length,
  wait_time, active_counters, patient_id from latest"""
STATEMENTS["stream_congestion"] = f"""with {FEED} select department,
  date_trunc('hour', "timestamp") as hour_start,
  cast(sum(cast(round(wait_time * 100) as bigint)) as double) / (100.0::double * count(*))
    as avg_wait, count(*) as readings
from feed group by 1, 2"""
STATEMENTS["stream_alerts"] = f"""with {FEED} select "timestamp", department, wait_time,
  case when wait_time < 15 then 'Normal' when wait_time < 30 then 'Busy' else 'Critical' end
    as status, {ALERT} from feed where wait_time > 20"""
STATEMENTS["stream_allocation"] = STATEMENTS["alloc_with_cooldown"]
STATEMENTS["stream_allocation_keyed"] = STATEMENTS["alloc_with_cooldown"]
