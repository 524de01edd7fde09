"""DuckDB statements that state, on the same tables, what each registered query must return."""

from __future__ import annotations

EVENTS_AS_OF = "date '2024-01-31'"
ORDERS_AS_OF = "date '2001-08-01'"
ZONE = "Pacific/Auckland"


def _fee(amount: str, user: str) -> str:
    return f"((cast(round({amount} * 100) as bigint) * (1 + {user} % 7)) // 100) / 100.0"


def _local_day(ts: str) -> str:
    return f"cast(timezone('{ZONE}', timezone('UTC', {ts})) as date)"


def _r2(value: str) -> str:
    return f"(round_even(({value}) * 100, 0) / 100)"


def _total(value: str) -> str:
    """Exact sum of amounts with all their places; only the sum is cut, to what a double holds of it."""
    return f"cast(sum(cast({value} as decimal(38, 15))) as decimal(38, 6))"


EVENT_ROWS = f"""
event_rows as (
  select ts, cast(user_id as varchar) as user_id, value as contribution,
         {_fee("value", "user_id")} as fee,
         cast(json_extract_string(props, '$.k') as integer) as tx,
         event_id as arrival, cast(ts as date) as utc_day
  from events
)"""

ORDER_ROWS = f"""
order_rows as (
  select o_orderdate as ts, cast(o_custkey as varchar) as user_id, o_totalprice as contribution,
         {_fee("o_totalprice", "o_custkey")} as fee,
         cast(left(o_orderpriority, 1) as integer) as tx,
         o_orderkey as arrival, cast(o_orderdate as date) as utc_day, o_orderstatus as status
  from orders
)"""


def _first_per_day(rows: str, name: str) -> str:
    return f"""
{name} as (
  select * from {rows}
  qualify row_number() over (partition by user_id, utc_day order by ts, arrival) = 1
)"""


EVENT_MODEL = EVENT_ROWS + "," + _first_per_day("event_rows", "c")

USERS = """
u as (
  select cast(k.c_custkey as varchar) as id, k.c_name || ' ' || k.c_mktsegment as full_name,
         s.first_day as date_joined, s.last_day as last_contrib
  from customer k
  left join (select user_id, min(utc_day) as first_day, max(utc_day) as last_day
             from order_rows group by user_id) s
    on s.user_id = cast(k.c_custkey as varchar)
)"""

ORDER_MODEL = ORDER_ROWS + "," + _first_per_day("order_rows", "c") + "," + USERS


def _daily(model: str) -> str:
    return f"""{model},
local_rows as (select *, {_local_day("ts")} as d from c),
daily as (
  select d, count(distinct user_id) as users, {_total("contribution")} as contributions,
         {_total("fee")} as fees,
         cast({_total("fee")} as double) / nullif(count(distinct user_id), 0) as arpu
  from local_rows group by d
)"""


_PERIODS = ("today", "yesterday", "this_week", "last_week", "this_month", "last_month", "current_fy", "last_fy")


def _periods(model: str, today: str) -> str:
    week = f"cast(date_trunc('week', {today}) as date)"
    month = f"cast(date_trunc('month', {today}) as date)"
    year = (
        f"make_date(year({today}) - case when month({today}) < 7 then 1 else 0 end, 7, 1)"
    )
    bounds = {
        "today": (today, today, today),
        "yesterday": (f"{today} - 1", f"{today} - 1", f"{today} - 1"),
        "this_week": (week, f"{week} + 6", today),
        "last_week": (f"{week} - 7", f"{week} - 1", f"{week} - 1"),
        "this_month": (month, f"{month} + interval 1 month - interval 1 day", today),
        "last_month": (f"{month} - interval 1 month", f"{month} - 1", f"{month} - 1"),
        "current_fy": (year, f"{year} + interval 1 year - interval 1 day", today),
        "last_fy": (f"{year} - interval 1 year", f"{year} - 1", f"{year} - 1"),
    }
    rows = " union all ".join(
        f"select '{p}', cast({s} as date), cast({e} as date), cast({x} as date)" for p, (s, e, x) in bounds.items()
    )
    return f"""{_daily(model)},
period(name, s, e, upto) as ({rows} union all select 'all_time', null, null, null),
from_rows as (
  select p.name, any_value(p.s) as s, any_value(p.e) as e, any_value(p.upto) as upto,
         count(distinct r.user_id) as users, {_total("r.fee")} as fees
  from period p left join local_rows r on p.s is null or r.d between p.s and p.e
  group by p.name
),
from_days as (
  select p.name, count(x.d) as days, sum(x.users) as user_days, sum(x.contributions) as contributions,
         cast(sum(x.contributions) as double) / nullif(count(x.contributions), 0) as avg_contributions,
         cast(sum(x.fees) as double) / nullif(count(x.fees), 0) as avg_fees,
         avg(x.arpu) as avg_arpu, min(x.d) as first_day, max(x.d) as last_day
  from period p left join daily x on p.s is null or x.d between p.s and p.e
  group by p.name
),
totals as (
  select a.name, a.s, a.e, a.upto, a.users, cast(a.fees as double) as fees,
         b.days, cast(b.user_days as bigint) as user_days, cast(b.contributions as double) as contributions,
         b.avg_contributions, b.avg_fees, b.avg_arpu, b.first_day, b.last_day
  from from_rows a join from_days b using (name)
)"""


def _maxima(table: str = "daily") -> str:
    picks = ", ".join(
        f"(select cast({v} as double) from {table} order by {v} desc nulls last, d desc limit 1) as max_{v}_value, "
        f"(select d from {table} order by {v} desc nulls last, d desc limit 1) as max_{v}_date"
        for v in ("contributions", "fees", "arpu")
    )
    return (
        f"select (select max(users) from {table}) as max_users_value, "
        f"(select d from {table} order by users desc, d desc limit 1) as max_users_date, {picks}"
    )


def _period_totals(model: str, today: str) -> str:
    return f"""with {_periods(model, today)}
select name as period, s as period_start, e as period_end, users, contributions, fees,
       days as days_with_data, {_r2("cast(user_days as double) / nullif(days, 0)")} as avg_daily_users,
       {_r2("avg_contributions")} as avg_daily_contributions, {_r2("avg_fees")} as avg_daily_fees,
       {_r2("avg_arpu")} as avg_daily_arpu, first_day, last_day
from totals"""


def _periodic_stats(model: str, today: str) -> str:
    single = "name in ('today', 'yesterday')"
    day_users = "case when days > 0 then users end"
    mean_users = "((200 * user_days + days) // nullif(2 * days, 0)) / 100.0"
    arpu = "fees / nullif(users, 0)"
    spread = f"{arpu} / (coalesce(upto, last_day) - coalesce(s, first_day) + 1)"
    metrics = {
        "unique_users": (day_users, "users", "users"),
        "daily_avg_users": (day_users, mean_users, None),
        "contributions": (_r2("contributions"), _r2("contributions"), "contributions"),
        "daily_avg_contributions": (_r2("contributions"), _r2("avg_contributions"), None),
        "fees": (_r2("fees"), _r2("fees"), "fees"),
        "daily_avg_fees": (_r2("fees"), _r2("avg_fees"), None),
        "arpu": (_r2(arpu), _r2(arpu), "arpu"),
        "daily_avg_arpu": (_r2(arpu), _r2("avg_arpu"), None),
        "daily_average_user_arpu": (_r2(arpu), _r2(spread), None),
    }
    cells = " union all ".join(
        f"select '{m}' as metric, name, cast(case when {single} then {day} else {other} end as double) as v from totals"
        for m, (day, other, _) in metrics.items()
    )
    columns = ", ".join(f"max(v) filter (where name = '{p}') as {p}" for p in (*_PERIODS, "all_time"))

    def best(suffix: str, kind: str) -> str:
        whens = ""
        for metric, (_, _, top) in metrics.items():
            if top is not None:
                value = f"max_{top}_{suffix}"
                if suffix == "value" and top != "users":
                    value = _r2(value)
                whens += f" when '{metric}' then (select {value} from tops)"
        return f"cast(case metric{whens} end as {kind})"

    return f"""with {_periods(model, today)},
tops as ({_maxima()}),
cells as ({cells})
select metric, {columns}, {best("value", "double")} as max_users_value, {best("date", "date")} as max_users_date
from cells group by metric"""


def _new_returning(model: str) -> str:
    return f"""with {model},
visits as (select user_id, ts, {_local_day("ts")} as d from c),
starts as (select user_id, {_local_day("min(ts)")} as first_day from c group by user_id),
days as (select distinct d from visits),
last_seen as (
  select x.d, v.user_id, max(v.d) as seen from days x join visits v on v.d <= x.d group by x.d, v.user_id
),
idle as (select d, count(*) as n from last_seen where seen <= d - 14 group by d),
known as (select x.d, count(*) as n from days x join starts s on s.first_day <= x.d group by x.d)
select v.d as day,
       count(distinct case when v.d = s.first_day then v.user_id end) as new_users,
       count(distinct case when v.d > s.first_day then v.user_id end) as returning_users,
       count(distinct v.user_id) as total_daily_users,
       coalesce(any_value(k.n), 0) as total_users_all_time,
       coalesce(any_value(i.n), 0) as idle_users,
       coalesce(any_value(k.n), 0) - coalesce(any_value(i.n), 0) as active_users
from visits v join starts s using (user_id) left join idle i on i.d = v.d left join known k on k.d = v.d
group by v.d"""


_DAILY_CUMULATIVE = f"""with {EVENT_MODEL},
sums as (
  select {_local_day("ts")} as "date", {_total("coalesce(contribution, 0)")} as a,
         {_total("coalesce(fee, 0)")} as f, sum(coalesce(tx, 0)) as t
  from c group by 1
),
running as (select x."date", x.a, x.f, x.t, sum(y.a) as ra, sum(y.f) as rf, sum(y.t) as rt
            from sums x join sums y on y."date" <= x."date" group by all)
select "date", cast(a as double) as daily_contributions, cast(f as double) as daily_fees,
       cast(t as double) as daily_transactions, cast(ra as double) as cumulative_contributions,
       cast(ra + 1872.61 as double) as adj_cumulative_contributions, cast(rf as double) as cumulative_fees,
       cast(rf + 187.26 as double) as adj_cumulative_fees, cast(rt as double) as cumulative_transactions,
       cast(rt + 3937 as double) as adj_cumulative_transactions
from running"""

_CUMULATIVE_BY_USER = f"""with {ORDER_MODEL}
select u.id, u.full_name, u.date_joined, cast({_total("c.contribution")} as double) as total_contributions,
       cast({_total("c.fee")} as double) as total_fees, cast(sum(c.tx) as double) as total_transactions,
       count(*) as num_contributions, cast(max(c.ts) as date) - cast(min(c.ts) as date) as lifespan_days
from u, c where c.user_id = u.id group by u.id, u.full_name, u.date_joined"""

_IDLE = f"""with {ORDER_MODEL},
gap as (
  select u.id, u.full_name, max(c.ts) as last_contribution_date,
         {ORDERS_AS_OF} - cast(max(c.ts) as date) as days_since_last_contribution
  from u left join c on c.user_id = u.id group by u.id, u.full_name
)
select * from gap where days_since_last_contribution > 14"""

_RATES = f"""
per_user as (
  select u.id, u.full_name, u.date_joined, coalesce(cast({_total("c.fee")} as double), 0) as f,
         coalesce(cast({_total("c.contribution")} as double), 0) as a,
         {ORDERS_AS_OF} - u.date_joined as age, cast(max(c.ts) as date) as seen,
         {ORDERS_AS_OF} - cast(max(c.ts) as date) as away
  from u left join c on c.user_id = u.id group by u.id, u.full_name, u.date_joined
)"""

_MEDIANS = f"""with {ORDER_MODEL}, {_RATES},
rate as (
  select case when age > 0 then a / age else 0.0 end as x, case when age > 0 then f / age else 0.0 end as y,
         case when a > 0 then f / a else 0.0 end as z
  from per_user where away <= 7
),
mid as (select median(x) as mx, median(y) as my, median(z) as mz from rate)
select mx as median_daily_contribution, my as median_daily_fee, mz as median_of_per_user_fee_percentages,
       case when mx > 0 then my / mx end as percentage_of_medians
from mid"""


def _class(rate: str) -> str:
    return (
        f"case when away is null or away > 7 then 'inactive' "
        f"when {rate} > (select avg({rate}) + stddev_pop({rate}) from rated) then 'whale' "
        f"when {rate} < (select avg({rate}) - stddev_pop({rate}) from rated) then 'minnow' else 'dolphin' end"
    )


_WHALES = f"""with {ORDER_MODEL}, {_RATES},
rated as (
  select *, case when age > 0 then f / age else 0.0 end as df, case when age > 0 then a / age else 0.0 end as da,
         case when age > 0 then f / age * 30.44::double else 0.0 end as mf,
         case when age > 0 then a / age * 30.44::double else 0.0 end as ma
  from per_user
)
select id as user_id, full_name, date_joined, seen as last_contribution_date, away as days_since_last_contribution,
       {_r2("f")} as total_fees, {_r2("a")} as total_contributions, age as days_since_joining,
       {_r2("df")} as daily_average_fee, {_r2("da")} as daily_average_contribution,
       {_r2("mf")} as monthly_average_fee, {_r2("ma")} as monthly_average_contribution,
       {_class("mf")} as user_class_by_fee, {_class("ma")} as user_class_by_contribution
from rated"""

_COHORTS = f"""with {ORDER_MODEL},
cohort as (
  select id, cast(date_trunc('month', date_joined) as date) as m,
         count(*) over (partition by date_trunc('month', date_joined)) as size
  from u where date_joined is not null
),
seen as (select distinct user_id, cast(date_trunc('month', {_local_day("ts")}) as date) as m from c),
kept as (
  select cohort.m, date_diff('month', cohort.m, seen.m) as months, count(distinct seen.user_id) as n,
         any_value(cohort.size) as size
  from cohort join seen on seen.user_id = cohort.id and seen.m >= cohort.m group by all
)
select strftime(m, '%Y-%m') as cohort_month, months as months_since_join, n as active_users, size as cohort_size,
       ((2000 * n + size) // (2 * size)) / 10.0 as pct_retained
from kept"""

_ANNIVERSARY = f"""with {ORDER_MODEL},
years as (
  select u.id, u.full_name, u.date_joined, c.contribution,
         cast(floor((cast(c.ts as date) - u.date_joined) / 365.25) as integer) as y
  from c join u on u.id = c.user_id where u.date_joined is not null
)
select id as user_id, full_name, cast(date_joined + to_years(y) as date) as period_start,
       cast(date_joined + to_years(y + 1) as date) as period_end,
       cast({_total("contribution")} as double) as total_contribution
from years group by id, full_name, date_joined, y having {_total("contribution")} > 970000"""

_WEEKLY = f"""with {EVENT_MODEL}
select a.user_id, cast(a.ts as date) as period_end, cast(sum(b.tx) as bigint) as weekly_transaction_count
from c a join c b on b.user_id = a.user_id and b.ts >= a.ts - interval 6 day and b.ts <= a.ts
group by a.user_id, a.ts having sum(b.tx) > 350"""

_STORED_AND_BATCH = (
    f"with {ORDER_ROWS}, old_rows as (select * from order_rows where status = 'F'), "
    "new_rows as (select * from order_rows where status <> 'F'),"
    + _first_per_day("old_rows", "stored")
    + ","
    + _first_per_day("new_rows", "winners")
    + """,
inserted as (
  select * from winners w
  where not exists (select 1 from stored s where s.user_id = w.user_id and s.utc_day = w.utc_day)
)"""
)

_INCREMENTAL_DATES = f"""{_STORED_AND_BATCH},
grown as (select user_id, utc_day from stored union all select user_id, utc_day from inserted)
select k.id, min(g.utc_day) as date_joined, cast(max(g.utc_day) as timestamp) as last_contrib
from (select distinct user_id as id from order_rows) k left join grown g on g.user_id = k.id
group by k.id"""

_RAW = """
raw as (
  select cast(event_id as varchar) as contribution_id,
         case when k = 99 then '' else cast(user_id as varchar) end as customer_id,
         case when k = 98 and event_type = 'error' then 'n/a' when k = 95 then '1e400' when k = 94 then chr(9) || cast(value as varchar) || chr(9)
              else cast(value as varchar) end as amount,
         case when k = 97 then '1,5' else ' 0.5 ' end as fee_total,
         case when k = 96 then '1.5' else cast(k as varchar) end as transaction_count
  from (select *, cast(json_extract_string(props, '$.k') as integer) as k from events)
),
judged as (
  select contribution_id,
         case when coalesce(not isfinite(try_cast(trim(amount, concat(' ', chr(9))) as double)), true) then 'amount is not a decimal'
              when try_cast(trim(fee_total) as double) is null then 'fee_total is not a decimal'
              when not regexp_full_match(trim(transaction_count), '[+-]?[0-9]+')
                then 'transaction_count is not an integer'
              when customer_id = '' then 'customer_id is empty' end as problem
  from raw
)"""

_KEYS = """
keys as (
  select event_id, event_type, ts,
         'new_contributions/year=' || strftime(ts, '%Y') || '/month=' || strftime(ts, '%m') || '/day='
         || strftime(ts, '%d') || '/' || case event_type
           when 'error' then 'export_' || strftime(ts, '%Y%m%d_%H%M%S') || '.CSV'
           when 'click' then 'part/export_' || strftime(ts, '%Y%m%d_%H%M%S') || '.csv'
           when 'signup' then 'export.csv'
           else 'export_' || strftime(ts, '%Y%m%d_%H%M%S') || '_2.csv' end as key
  from events
)"""

_SPELLED = f"""{EVENT_ROWS},
spelled as (
  select *, case arrival % 4 when 0 then 'Zoë-' || user_id when 1 then 'ZOE-' || user_id
                             when 2 then 'zoe-' || user_id || ' ' else 'zoë-' || user_id end as written
  from event_rows
),
keyed as (select *, rtrim(lower(strip_accents(written))) as id_key from spelled)"""

_COLLATED_DATES = f"""with {_SPELLED},
loads as (select *, if(day(ts) > 15, 0, 1) as load from keyed),
winners as (select * from loads qualify row_number() over (partition by id_key, utc_day order by load, ts, arrival) = 1),
names as (select id_key, arg_min(written, (load, ts, arrival)) as id from loads group by id_key)
select id, min(utc_day) as date_joined, cast(max(utc_day) as timestamp) as last_contrib
from names join winners using (id_key) group by id"""

_COLLATED_TOTALS = f"""with {_SPELLED},
winners as (select * from keyed qualify row_number() over (partition by id_key, utc_day order by ts, arrival) = 1)
select 'ZOË-' || user_id as id, 'u ZOË-' || user_id as full_name, cast(null as date) as date_joined,
       cast(cast({_total("contribution")} as decimal(18, 2)) as double) as total_contributions,
       cast(cast({_total("fee")} as decimal(18, 2)) as double) as total_fees,
       cast(sum(tx) as double) as total_transactions, count(*) as num_contributions,
       date_diff('day', min(utc_day), max(utc_day)) as lifespan_days
from winners group by user_id"""

# Rows of a file share its stamp; in a file lines are in order of event ids.
_HALF_DAYS = f"""{EVENT_ROWS},
landed as (select *, date_trunc('day', ts) + interval 12 hour * (hour(ts) // 12) as stamp from event_rows)"""

_LANDING_LOAD = f"""with {_HALF_DAYS}
select user_id, utc_day as contrib_date, stamp as timestamp, contribution, fee, tx as transaction_count from landed
qualify row_number() over (partition by user_id, utc_day order by stamp, arrival) = 1"""

_LANDING_INCREMENTS = f"""with {_HALF_DAYS},
winners as (select * from landed qualify row_number() over (partition by user_id, utc_day order by stamp desc, arrival) = 1)
select user_id, utc_day as contrib_date, stamp as timestamp, contribution, fee,
       min(utc_day) over (partition by user_id) as date_joined,
       cast(max(utc_day) over (partition by user_id) as timestamp) as last_contrib
from winners"""

ORACLE_SQL: dict[str, str] = {
    "daily_cumulative": _DAILY_CUMULATIVE,
    "cumulative_by_user": _CUMULATIVE_BY_USER,
    "idle_users": _IDLE,
    "medians": _MEDIANS,
    "whales_minnows": _WHALES,
    "cohort_retention": _COHORTS,
    "new_returning_daily": _new_returning(ORDER_MODEL),
    "new_returning_daily_events": _new_returning(EVENT_MODEL),
    "anniversary_totals_over": _ANNIVERSARY,
    "weekly_transactions_over": _WEEKLY,
    "periodic_stats": _periodic_stats(EVENT_MODEL, EVENTS_AS_OF),
    "periodic_stats_orders": _periodic_stats(ORDER_MODEL, ORDERS_AS_OF),
    "period_totals": _period_totals(EVENT_MODEL, EVENTS_AS_OF),
    "period_totals_orders": _period_totals(ORDER_MODEL, ORDERS_AS_OF),
    "daily_stats": f"""with {_daily(EVENT_MODEL)}
select d as day, users as daily_users, cast(contributions as double) as daily_contributions,
       cast(fees as double) as daily_fees, arpu as daily_arpu from daily""",
    "daily_maxima": f"with {_daily(EVENT_MODEL)} {_maxima()}",
    "sums_of_thirds": f"""with {EVENT_ROWS}
select user_id, cast(cast(sum(cast(contribution / 3 as decimal(38, 15))) as decimal(28, 9)) as varchar) as total
from event_rows group by user_id""",
    "derived_columns": f"""with {EVENT_ROWS}
select arrival, contribution + fee as total_with_fee, fee / nullif(contribution, 0) * 100 as fee_percentage,
       utc_day as contrib_date from event_rows""",
    "user_full_names": f"with {ORDER_ROWS}, {USERS} select id, full_name from u",
    "backfill_user_dates": f"""with {ORDER_ROWS}, {USERS}
select id, date_joined, cast(last_contrib as timestamp) as last_contrib from u""",
    "incremental_user_dates": _INCREMENTAL_DATES,
    "new_users": """select distinct cast(o_custkey as varchar) as id from orders
where o_custkey not in (select o_custkey from orders where o_orderdate < timestamp '1996-01-01')""",
    "first_wins": f"""with {EVENT_MODEL}
select user_id, utc_day as contrib_date, ts as "timestamp", contribution, fee, tx as transaction_count, arrival
from c""",
    "insert_or_ignore": f"""{_STORED_AND_BATCH}
select user_id, utc_day as contrib_date, contribution, fee, tx as transaction_count, arrival from inserted""",
    "row_validation": f"""with {_RAW}
select coalesce(problem, 'none') as problem, count(*) as n from judged group by 1""",
    "landing_load": _LANDING_LOAD,
    "landing_increments": _LANDING_INCREMENTS,
    "collated_first_wins": f"""with {_SPELLED}
select written as user_id, utc_day as contrib_date, ts as timestamp, contribution, arrival from keyed
qualify row_number() over (partition by id_key, utc_day order by ts, arrival) = 1""",
    "collated_user_dates": _COLLATED_DATES,
    "collated_totals": _COLLATED_TOTALS,
    "row_rejects": f"with {_RAW} select contribution_id, problem from judged where problem is not null",
    "landing_keys": f"""with {_KEYS}
select event_id, key, case event_type when 'signup' then null
       else strptime(strftime(ts, '%Y%m%d%H%M%S'), '%Y%m%d%H%M%S') end as file_ts
from keys where event_type not in ('error', 'click')""",
}
