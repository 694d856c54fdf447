"""Column and dataset profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import profile as prof
from assay.operators.segments import pick_segment_column, pick_value_column
from assay.operators.validate import missing_shares
from catalog import sqltext as q
from catalog.registry import ORDERS_GAPS, gaps, joined, longs, plain, query, rounded

ORDER_COLUMNS = [
    ("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "text"), ("o_totalprice", "numeric"),
    ("o_orderdate", "datetime"), ("o_orderpriority", "text"),
]
ORDER_PROFILE = q.profile("orders", f"({plain(ORDERS_GAPS)})", ORDER_COLUMNS)
# Three tables as three runs; new names give them a regression, a class and no target.
RUNS = {
    "customer": ("select c_custkey, c_nationkey, c_acctbal, c_mktsegment from customer",
                 [("c_custkey", "numeric"), ("c_nationkey", "numeric"), ("c_acctbal", "numeric"), ("c_mktsegment", "text")]),
    "part": ("select p_partkey, p_brand, p_type, p_size, p_retailprice as retail_price from part",
             [("p_partkey", "numeric"), ("p_brand", "text"), ("p_type", "text"), ("p_size", "numeric"), ("retail_price", "numeric")]),
    "events": ("select event_id, ts, user_id, event_type as event_class, value from events",
               [("event_id", "numeric"), ("ts", "datetime"), ("user_id", "numeric"), ("event_class", "text"), ("value", "numeric")]),
}
RUN_PROFILES = " union all ".join(q.profile(run, f"({text})", cols) for run, (text, cols) in RUNS.items())


def run_profiles(t):
    out = None
    for run, (text, _) in RUNS.items():
        getattr(t, run).createOrReplaceTempView(run)
        one = prof.column_profile(t.spark.sql(text), run)
        out = one if out is None else out.unionByName(one)
    return out


def order_profile(t):
    return prof.column_profile(gaps(t, ORDERS_GAPS), "orders")


EVENT_TEXTS = """
select event_id, case when event_type <> 'error' then {stamp} else 'unknown' end as event_time,
       case when event_type = 'click' then {stamp} else 'n/a' end as other_day, value from events
"""


@query(
    "c1_coerce_datetimes",
    f"""with x as ({EVENT_TEXTS.format(stamp="strftime(ts, '%Y-%m-%d %H:%M:%S')")})
        select event_id, strftime(try_cast(event_time as timestamp), '%Y-%m-%d %H:%M:%S') as event_time, other_day from x""",
)
def _(t):
    t.events.createOrReplaceTempView("events")
    raw = t.spark.sql(EVENT_TEXTS.format(stamp="date_format(ts, 'yyyy-MM-dd HH:mm:ss')"))
    out = prof.coerce_datetimes(raw)
    return out.select("event_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "other_day")


@query("c2_classify_columns", f"select name, role, position from ({ORDER_PROFILE})")
def _(t):
    return order_profile(t).select("name", "role", "position")


@query(
    "c3_null_counts",
    f"select name, null_count, null_pct from ({ORDER_PROFILE})",
)
def _(t):
    m = missing_shares(gaps(t, ORDERS_GAPS))
    return m.select("name", "null_count", F.round("null_share", 4).alias("null_pct"))


@query("c4_distinct_counts", f"select name, distinct_count from ({ORDER_PROFILE})")
def _(t):
    df = gaps(t, ORDERS_GAPS)
    return prof.distinct_counts(df, df.columns).select("name", "distinct_count")


@query(
    "c5_numeric_summary",
    f"""select name, round(min, 4) as min, round(max, 4) as max, round(mean, 4) as mean, round(median, 4) as median,
               round(std, 4) as std from ({ORDER_PROFILE}) where role = 'numeric'""",
)
def _(t):
    p = order_profile(t).where("role = 'numeric'").select("name", "min", "max", "mean", "median", "std")
    return rounded(p, 4, "min", "max", "mean", "median", "std")


@query("c6_skewness", f"select name, round(skew, 6) as skew from ({ORDER_PROFILE}) where role = 'numeric'")
def _(t):
    return rounded(order_profile(t).where("role = 'numeric'").select("name", "skew"), 6, "skew")


EVENT_VALUES = "select user_id, value * value * value as value, event_id from events"


@query(
    "c7_iqr_outliers",
    f"""select name, outlier_count from ({q.profile('events', f'({EVENT_VALUES})', [('user_id', 'numeric'), ('value', 'numeric'), ('event_id', 'numeric')])})""",
)
def _(t):
    t.events.createOrReplaceTempView("events")
    return prof.column_profile(t.spark.sql(EVENT_VALUES), "events").select("name", "outlier_count")


@query(
    "c8_top_values",
    f"""select "column", rank, value, n from (
          select "column", value, n, row_number() over (partition by "column" order by n desc, value) as rank from (
            select 'p_brand' as "column", p_brand as value, count(*) as n from part group by all union all
            select 'p_type', p_type, count(*) from part group by all)) where rank <= 10""",
)
def _(t):
    return longs(prof.top_values(t.part, ["p_brand", "p_type"]), "rank")


@query("c9_date_range", f"select name, min_date, max_date from ({ORDER_PROFILE}) where role = 'datetime'")
def _(t):
    return order_profile(t).where("role = 'datetime'").select("name", "min_date", "max_date")


LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "c10_top_correlations",
    f"""select a, b, round(r, 3) as correlation from ({q.pairs('''(select *, case when l_discount > 0.02 then l_quantity * l_discount end as saved from lineitem)''', [*LINE_COLUMNS, 'saved'], 2)})
        order by abs(round(r, 3)) desc, pair limit 5""",
)
def _(t):
    saved = F.when(F.col("l_discount") > 0.02, F.col("l_quantity") * F.col("l_discount"))
    df = t.lineitem.select(*LINE_COLUMNS, saved.alias("saved"))
    from assay.operators.correlation import top_correlations

    return top_correlations(df)


@query(
    "c11_target_columns",
    f"""select run_id, name, position, 'substring' as mode from ({RUN_PROFILES}) where {q.is_target('name', 'substring')}
        union all
        select run_id, name, position, 'token' as mode from ({RUN_PROFILES}) where {q.is_target('name', 'token')}""",
)
def _(t):
    p = run_profiles(t)
    modes = [prof.target_columns(p, m).withColumn("mode", F.lit(m)) for m in ("substring", "token")]
    return modes[0].unionByName(modes[1])


def _names(cond: str) -> str:
    return f"coalesce(string_agg(name, '|' order by position) filter (where {cond}), '')"


@query(
    "c12_dataset_profile",
    f"""select run_id, max(n_rows) as rows, count(*) as cols, count(*) filter (where role = 'datetime') > 0 as has_datetime,
          {_names("role = 'datetime'")} as datetime_columns, {_names("role = 'categorical'")} as categorical_columns,
          {_names("role = 'numeric'")} as numeric_columns, {_names("null_pct > 0.2")} as high_null_columns,
          {_names(q.is_target('name', 'token'))} as potential_target_columns
        from ({ORDER_PROFILE}) group by run_id""",
)
def _(t):
    d = prof.dataset_profile(order_profile(t))
    lists = [c for c in d.columns if c.endswith("_columns")]
    return d.select(*[joined(c).alias(c) if c in lists else F.col(c) for c in d.columns])


@query("c13_slim_profile", f"select run_id, name, position, role, null_pct, distinct_count from ({ORDER_PROFILE})")
def _(t):
    return prof.slim_profile(order_profile(t))


@query("c14_role_counts", f"select run_id, role, count(*) as n from ({RUN_PROFILES}) group by all")
def _(t):
    return prof.role_counts(run_profiles(t))


@query(
    "c15_missing_ranking",
    f"""select run_id, name, round(100.0 * null_count / n_rows, 6) as pct_missing from ({ORDER_PROFILE})
        where null_count > 0""",
)
def _(t):
    shares = missing_shares(gaps(t, ORDERS_GAPS)).withColumn("run_id", F.lit("orders"))
    return rounded(prof.missing_ranking(shares), 6, "pct_missing")


@query(
    "d21_pick_segment_column",
    f"""select run_id, arg_min(name, position) as name from ({RUN_PROFILES})
        where role = 'categorical' and distinct_count >= 2 and distinct_count < 10 group by run_id""",
)
def _(t):
    return pick_segment_column(run_profiles(t))


@query(
    "d22_pick_value_column",
    f"""select run_id, arg_min(name, position + case when name in ('id', 'order_id', 'order id') or name like '%\\_id' escape '\\' then 1000 else 0 end) as name
        from ({RUN_PROFILES}) where role = 'numeric' group by run_id""",
)
def _(t):
    return pick_value_column(run_profiles(t))
