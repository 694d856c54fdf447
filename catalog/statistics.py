"""Correlations, outliers, distributions, trend, segments, scalars, chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import text as fmt
from assay.operators import charts, correlation, distribution, outliers, segments, trend
from assay.plans import results as res
from assay.plans.planner import ANALYSES
from assay.plans.run import run_analyses
from assay.operators.profile import column_profile
from catalog import sqltext as q
from catalog.registry import CUSTOMER_GAPS, LINE_ALL, LINE_NUMBERS, gaps, longs, plain, query, rounded

GAPPED = f"({plain(LINE_ALL)})"
LINE_PAIRS = q.pairs(GAPPED, list(LINE_NUMBERS))


@query(
    "d1_correlation_analysis",
    f"""select a, b, n, round(r, 3) as correlation, round(p, 5) as p_value, {q.strength('r')} as strength, p < 0.05 as significant,
               row_number() over (order by abs(round(r, 3)) desc, pair) as rank
        from (select *, {q.correlation_p('r', 'n')} as p from ({LINE_PAIRS}))""",
)
def _(t):
    return longs(correlation.correlation_analysis(gaps(t, LINE_ALL), list(LINE_NUMBERS)), "rank")


@query(
    "d2_correlation_matrix",
    f"""select a, b, round(r, 3) as correlation from ({LINE_PAIRS}) union all
        select b, a, round(r, 3) from ({LINE_PAIRS}) union all
        select c, c, 1.0 from (select unnest([{', '.join(f"'{c}'" for c in LINE_NUMBERS)}]) as c)""",
)
def _(t):
    return correlation.correlation_matrix(gaps(t, LINE_ALL), list(LINE_NUMBERS))


# Outlier steps over a given score: the order price turned around.
SCORED = "select o_orderkey, -o_totalprice / 1000000.0 as score from {orders}"
FLAGGED_SQL = f"""select o_orderkey, score, score < (select quantile_cont(score, 0.05) from ({plain(SCORED)})) as is_outlier
                  from ({plain(SCORED)})"""


@query("d3_isolation_forest")
def _(t):
    return outliers.outlier_scores(t.orders, ["o_orderkey"], ["o_custkey", "o_totalprice"])


@query(
    "d4_flag_outliers",
    f"""select count(*) as n_rows, count(*) filter (where is_outlier) as n_outliers,
               round(count(*) filter (where is_outlier)::double / count(*), 4) as outlier_pct from ({FLAGGED_SQL})""",
)
def _(t):
    return outliers.outlier_share(outliers.flag_outliers(gaps(t, SCORED)))


@query("d5_most_anomalous", f"select o_orderkey, round(score, 6) as score from ({plain(SCORED)}) order by score, o_orderkey limit 5")
def _(t):
    return rounded(outliers.most_anomalous(gaps(t, SCORED), ["o_orderkey"]), 6, "score")


CUBED = "select l_quantity * l_quantity * l_quantity as cubed, case when l_discount > 0 then 1 / l_discount end as inverse, l_tax from {lineitem}"
CUBED_ROWS = f"(select * from ({plain(CUBED)}) where cubed is not null and inverse is not null and l_tax is not null)"


@query(
    "d6_iqr_context",
    " union all ".join(
        f"""select '{c}' as "column", {q.outliers(CUBED_ROWS, c)} as outliers where {q.outliers(CUBED_ROWS, c)} > 0"""
        for c in ("cubed", "inverse", "l_tax")
    ),
)
def _(t):
    return outliers.iqr_context(gaps(t, CUBED))


def _long(table: str, columns) -> str:
    return " union all ".join(f'select \'{c}\' as "column", {c}::double as v from {table} where {c} is not null' for c in columns)


LONG = _long(GAPPED, LINE_NUMBERS)


@query(
    "d7_moments",
    f"""select "column", count(*) as n, round(avg(v), 4) as mean, round(quantile_cont(v, 0.5), 4) as median, round(stddev_samp(v), 4) as std,
               round(skewness(v), 3) as skew, round(kurtosis(v), 3) as kurtosis from ({LONG}) group by 1""",
)
def _(t):
    d = distribution.distribution_analysis(gaps(t, LINE_ALL), list(LINE_NUMBERS))
    return rounded(d.select("column", "n", "mean", "median", "std", "skew", "kurtosis"), 4, "mean", "median", "std")


@query(
    "d8_normality_small",
    f"""with r as (select avg(c_acctbal) as mean_balance, max(c_acctbal) as top_balance, count(*) as n from customer group by c_nationkey, c_mktsegment),
        v as (select 'mean_balance' as "column", mean_balance::double as v from r union all select 'top_balance', top_balance::double from r union all select 'n', n::double from r),
        s as (select "column", count(v)::double as n, avg(v) as mu from v group by 1 having count(v) between 8 and 4999 and max(v) > min(v)),
        x as (select "column", n, v - mu as d, row_number() over (partition by "column" order by v) as i from v join s using ("column") where v is not null),
        m as (select *, {q.normal_quantile('((i - 0.375) / (n + 0.25))')} as m from x),
        t as (select "column", 1 / sqrt(any_value(n)) as u, sum(m * m) as ss, max(case when i = n then m end) as m1, max(case when i = n - 1 then m end) as m2 from m group by 1),
        a as (select *, m1 / sqrt(ss) + {q.poly(distribution._TAIL_LAST, 'u')} as a1, m2 / sqrt(ss) + {q.poly(distribution._TAIL_NEXT, 'u')} as a2 from t),
        f as (select *, (ss - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2) as phi from a),
        w as (select "column", any_value(n) as n, least(1.0, pow(sum(d * case when i = n then a1 when i = n - 1 then a2 when i = 1 then -a1 when i = 2 then -a2 else m / sqrt(phi) end), 2) / sum(d * d)) as w
              from m join f using ("column") group by 1),
        g as (select *, {q.poly(distribution._SMALL_GAMMA, 'n')} as gamma, case when w < 1 then ln(1 - w) end as deficit from w),
        z as (select *, case when n >= 12 then (deficit - {q.poly(distribution._LARGE_MEAN, 'ln(n)')}) / exp({q.poly(distribution._LARGE_SCALE, 'ln(n)')})
                             when deficit < gamma then (-ln(gamma - deficit) - {q.poly(distribution._SMALL_MEAN, 'n')}) / exp({q.poly(distribution._SMALL_SCALE, 'n')}) end as z from g)
        select "column", n::bigint as n, round(w, 6) as w, round(case when w >= 1 then 1.0 when z is null then 0.0 else {q.normal_upper('z')} end, 5) as normal_p from z""",
)
def _(t):
    rolled = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(
        F.avg("c_acctbal").alias("mean_balance"), F.max("c_acctbal").alias("top_balance"), F.count("*").alias("n")
    )
    return rounded(rounded(distribution.normality_small(rolled, ["mean_balance", "top_balance", "n"]), 6, "w"), 5, "normal_p")


@query(
    "d9_normality_large",
    f"""with m as (select "column", count(*)::double as n, avg(v) as mu from ({LONG}) group by 1),
        g as (select "column", any_value(n) as n, avg(pow(v - mu, 3)) / pow(avg(pow(v - mu, 2)), 1.5) as g1,
                     avg(pow(v - mu, 4)) / pow(avg(pow(v - mu, 2)), 2) as b from ({LONG}) join m using ("column") group by 1),
        s as (select *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) as y,
                3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) as beta,
                (b - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) as x,
                6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) as bb from g),
        w as (select *, sqrt(2 * (beta - 1)) - 1 as w2, 6 + 8 / bb * (2 / bb + sqrt(1 + 4 / (bb * bb))) as a from s),
        z as (select *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) as z1, 1 + x * sqrt(2 / (a - 4)) as d from w),
        k as (select *, pow(z1, 2) + pow((1 - 2 / (9 * a) - sign(d) * cbrt((1 - 2 / a) / abs(d))) / sqrt(2 / (9 * a)), 2) as k2 from z)
        select "column", n::bigint as n, round(k2, 3) as k2, round(exp(-k2 / 2), 5) as normal_p from k where n >= 5000""",
)
def _(t):
    d = distribution.normality_large(gaps(t, LINE_ALL), list(LINE_NUMBERS))
    return rounded(rounded(d, 3, "k2"), 5, "normal_p")


SHAPES = _long("(select event_id, pow(value, 3) as cubed, value, -pow(value, 2) as turned, user_id from events)", ("cubed", "value", "turned", "user_id"))


def _shapes(t):
    df = t.events.select("user_id", "value", F.pow("value", F.lit(3)).alias("cubed"), (-F.pow("value", F.lit(2))).alias("turned"))
    return distribution.moments(df, ["cubed", "value", "turned", "user_id"])


@query(
    "d10_shape_label",
    f"""select "column", case when s > 1 then 'strongly right-skewed' when s > 0.5 then 'right-skewed' when s < -1 then 'strongly left-skewed'
               when s < -0.5 then 'left-skewed' else 'roughly symmetric' end as shape
        from (select "column", skewness(v) as s from ({SHAPES}) group by 1)""",
)
def _(t):
    return _shapes(t).select("column", fmt.shape_label(F.col("skew")).alias("shape"))


@query(
    "d11_transform_advice",
    f"""select "column", case when s > 1 then 'log' when s > 0.5 then 'square-root' end as advice
        from (select "column", skewness(v) as s from ({SHAPES}) group by 1)""",
)
def _(t):
    return _shapes(t).select("column", fmt.transform_advice(F.col("skew")).alias("advice"))


def _histogram_sql(long: str, bins: int) -> str:
    return f"""with l as ({long}), e as (select "column", min(v) as lo, max(v) as hi from l group by 1),
        p as (select "column", least(floor((v - lo) * {bins} / (hi - lo)) + 1, {bins})::bigint as bin from l join e using ("column")),
        c as (select "column", bin, count(*) as n from p group by all),
        g as (select "column", lo, hi, unnest(range(1, {bins + 1})) as bin from e)
        select "column", bin, round(lo + (bin - 1) * (hi - lo) / {bins}, 4) as lower_edge,
               round(lo + bin * (hi - lo) / {bins}, 4) as upper_edge, coalesce(n, 0) as n from g left join c using ("column", bin)"""


@query("d12_histogram", _histogram_sql(_long(GAPPED, LINE_NUMBERS), 20))
def _(t):
    return distribution.histogram(gaps(t, LINE_ALL), list(LINE_NUMBERS))


SERIES = "select o_orderkey, o_orderdate, case when o_totalprice <= 450000 then sqrt(o_totalprice) end as price from {orders}"
SERIES_SQL = f"""select row_number() over (order by o_orderdate, o_orderkey) - 1 as idx, o_orderdate as ts, price as value, o_orderkey as key
                 from ({plain(SERIES)}) where price is not null and o_orderdate is not null"""
AVERAGE_SQL = f"""select *, (sum(value) over (order by idx rows between unbounded preceding and current row)) as cs from ({SERIES_SQL})"""
MOVING_SQL = f"""
with s as ({AVERAGE_SQL}), n as (select count(*) as n, greatest(3, count(*) // 10) as w from s),
b as (select s.*, n.n, greatest(idx - w // 2, 0) as first, least(idx + (w - 1) // 2, n.n - 1) as last from s, n)
select b.idx, b.ts, b.value, b.key, (u.cs - coalesce(p.cs, 0)) / (last - first + 1) as trend
from b join s u on u.idx = b.last left join s p on p.idx = b.first - 1
"""


def _moving(t):
    return trend.moving_average(gaps(t, SERIES), "o_orderdate", "price", "o_orderkey")


@query("d13_time_order", f"select idx, strftime(ts, '%Y-%m-%d') as day, round(value, 6) as value, key from ({SERIES_SQL})")
def _(t):
    s = trend.time_ordered(gaps(t, SERIES), "o_orderdate", "price", "o_orderkey")
    return rounded(s.select("idx", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value", "key"), 6, "value")


@query("d14_moving_average", f"select idx, round(trend, 6) as trend from ({MOVING_SQL})")
def _(t):
    return rounded(_moving(t).select("idx", "trend"), 6, "trend")


@query(
    "d15_linear_trend",
    f"""select n, round(slope, 6) as slope, round(p, 5) as p_value,
          case when slope > 0 then 'increasing' when slope < 0 then 'decreasing' else 'flat' end as direction, p < 0.05 as significant
        from (select *, {q.correlation_p('r', 'n')} as p from
          (select count(*) as n, regr_slope(value, idx) as slope, corr(value, idx) as r from ({SERIES_SQL})))""",
)
def _(t):
    return trend.trend_summary(_moving(t)).drop("structure_strength")


@query(
    "d16_structure_strength",
    f"""select round(greatest(0.0, 1 - var_samp(value - trend) / case when var_samp(value) = 0 then 1.0 else var_samp(value) end), 3)
          as structure_strength from ({MOVING_SQL})""",
)
def _(t):
    return trend.trend_summary(_moving(t)).select("structure_strength")


@query(
    "d17_trend_series",
    f"""select idx, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, round(value, 4) as value, round(trend, 4) as trend from ({MOVING_SQL})""",
)
def _(t):
    return trend.trend_series(_moving(t))


SEGMENTS_SQL = f"""select c_mktsegment as segment, count(*) as n, avg(c_acctbal) as mean, quantile_cont(c_acctbal, 0.5) as median,
   var_pop(c_acctbal) as spread from ({plain(CUSTOMER_GAPS)}) where c_mktsegment is not null and c_acctbal is not null group by 1 having count(*) >= 3"""


@query("d18_segment_statistics", f"select segment, n, round(mean, 4) as mean, round(median, 4) as median from ({SEGMENTS_SQL})")
def _(t):
    s = segments.segment_statistics(gaps(t, CUSTOMER_GAPS), "c_mktsegment", "c_acctbal")
    return rounded(s, 4, "mean", "median")


@query(
    "d19_anova",
    f"""with s as ({SEGMENTS_SQL}), g as (select count(*) as k, sum(n)::bigint as total, sum(n * mean) / sum(n) as grand from s),
        f as (select any_value(k) as segments, any_value(total) as rows, (sum(n * pow(mean - grand, 2)) / (any_value(k) - 1)) /
                (sum(n * spread) / (any_value(total) - any_value(k))) as f from s, g),
        p as (select *, {q.upper_tail("acos(sqrt((rows - segments) / ((rows - segments) + (segments - 1) * f)))", "(rows - segments)", "(segments - 1)")} as p from f)
        select segments, rows, round(f, 4) as f_statistic, round(p, 5) as p_value, p < 0.05 as significant from p""",
)
def _(t):
    return segments.anova(gaps(t, CUSTOMER_GAPS), "c_mktsegment", "c_acctbal")


@query(
    "d20_segment_ranking",
    f"""select arg_max(segment, mean) as highest, round(max(mean), 4) as highest_mean, arg_min(segment, mean) as lowest,
               round(min(mean), 4) as lowest_mean from ({SEGMENTS_SQL})""",
)
def _(t):
    r = segments.segment_ranking(gaps(t, CUSTOMER_GAPS), "c_mktsegment", "c_acctbal")
    return rounded(r, 4, "highest_mean", "lowest_mean")


def _run_sql() -> str:
    """All five analyses of orders; without ties the flagged rows are those below the 5 % place."""
    numbers = ["o_orderkey", "o_custkey", "o_totalprice"]
    outside = " + ".join(f"(({q.outliers('orders', c)}) > 0)::int" for c in numbers)
    return f"""
    with p as (select a, b, round(r, 3) as r from ({q.pairs('orders', numbers)}) order by abs(round(r, 3)) desc, pair limit 1),
    n as (select count(*) as n, ceil(0.05 * (count(*) - 1))::bigint as low from orders),
    t as (select regr_slope(o_totalprice, i) as slope from (select o_totalprice, row_number() over (order by o_orderdate, o_orderkey) as i from orders)),
    s as (select count(*) as segments from (select o_orderstatus from orders group by 1 having count(*) >= 3))
    select 'orders' as run_id, 0 as seq, 'correlation_analysis' as analysis_type,
           'Closest pair: ' || {q.title('a')} || ' vs ' || {q.title('b')} || ' (r=' || r || ').' as summary, 3 as findings from p
    union all select 'orders', 1, 'outlier_detection', 'The outlier trees set apart ' || low || ' rows (' || printf('%.1f', 100.0 * round(low / n, 4)) || '%).', 1 + {outside} from n
    union all select 'orders', 2, 'distribution_analysis', 'Shapes of 3 numeric column(s) were described.', 3
    union all select 'orders', 3, 'trend_decomposition', 'O Totalprice is ' || case when slope > 0 then 'increasing' when slope < 0 then 'decreasing' else 'flat' end || ' as time goes on.', 3 from t
    union all select 'orders', 4, 'segment_comparison', 'Set side by side: O Totalprice across ' || segments || ' groups by O Orderstatus.', 2 from s
    """


@query("d23_run_analyses", _run_sql())
def _(t):
    profile = column_profile(t.orders, "orders")
    plan = {"target_column": "o_totalprice", "analyses_to_run": list(ANALYSES)}
    found, _ = run_analyses(t.orders, ["o_orderkey"], plan, profile, "orders")
    return found.select("run_id", "seq", "analysis_type", "summary", F.size("key_findings").alias("findings"))


@query(
    "d24_result_rows",
    f"""select 'customer' as run_id, 0 as seq, 'segment_comparison' as analysis_type,
          'Set side by side: C Acctbal across ' || count(*) || ' groups by C Mktsegment.' as summary, 2 as findings, 0 as warnings
        from ({SEGMENTS_SQL})""",
)
def _(t):
    df = gaps(t, CUSTOMER_GAPS)
    stats = segments.segment_statistics(df, "c_mktsegment", "c_acctbal")
    row = res.segment_result(stats, segments.anova(df, "c_mktsegment", "c_acctbal"), "c_mktsegment", "c_acctbal")
    r = res.conform(row, "customer", 0, "segment_comparison")
    return r.select(
        "run_id", "seq", "analysis_type", "summary", F.size("key_findings").alias("findings"), F.size("warnings").alias("warnings")
    )


@query("i1_strength_label", f"select c_custkey, {q.strength('c_acctbal / 10000')} as strength from customer")
def _(t):
    return t.customer.select("c_custkey", fmt.strength_label(F.col("c_acctbal") / 10000).alias("strength"))


@query(
    "i2_titleize",
    f"""select p_partkey, {q.title("' ' || replace(p_name, ' ', '_') || '_' || p_type")} as title from part""",
)
def _(t):
    raw = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_type"))
    return t.part.select("p_partkey", fmt.titleize(raw).alias("title"))


SCALED = (
    "case o_orderpriority when '1-URGENT' then -o_totalprice when '2-HIGH' then o_totalprice * 1000 "
    "when '3-MEDIUM' then o_totalprice / 1000 when '5-LOW' then o_custkey else o_totalprice * 10000000 end"
)


@query(
    "i3_human_number",
    f"""select o_orderkey, case when abs(x) >= 1e12 then s || printf('%.2f', abs(x) / 1e12) || 'T' when abs(x) >= 1e9 then s || printf('%.2f', abs(x) / 1e9) || 'B'
          when abs(x) >= 1e6 then s || printf('%.2f', abs(x) / 1e6) || 'M' when abs(x) >= 1e3 then s || printf('%.2f', abs(x) / 1e3) || 'K'
          when abs(x) = floor(abs(x)) then s || abs(x)::bigint else s || printf('%.2f', abs(x)) end as shown
        from (select o_orderkey, ({SCALED})::double as x, case when ({SCALED}) < 0 then '-' else '' end as s from orders)""",
)
def _(t):
    return t.orders.select("o_orderkey", fmt.human_number(F.expr(SCALED).cast("double")).alias("shown"))


@query("i4_percent", "select c_custkey, printf('%.1f', c_acctbal / 10000 * 100) || '%' as shown from customer")
def _(t):
    return t.customer.select("c_custkey", fmt.percent(F.col("c_acctbal") / 10000).alias("shown"))


@query("j1_chart_histogram", _histogram_sql("select 'o_totalprice' as \"column\", o_totalprice as v from orders", 30))
def _(t):
    return charts.chart_histogram(t.orders, "o_totalprice")


BOXED = _long("(select value, pow(value, 3) as cubed from events)", ("value", "cubed"))


@query(
    "j1_box_table",
    f"""with l as ({BOXED}), b as (select "column", min(v) as min, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median,
          quantile_cont(v, 0.75) as q3, max(v) as max from l group by 1)
        select "column", round(min, 4) as min, round(q1, 4) as q1, round(median, 4) as median, round(q3, 4) as q3, round(max, 4) as max,
          round((select min(v) from l where l."column" = b."column" and v >= q1 - 1.5 * (q3 - q1)), 4) as lower_whisker,
          round((select max(v) from l where l."column" = b."column" and v <= q3 + 1.5 * (q3 - q1)), 4) as upper_whisker from b""",
)
def _(t):
    df = t.events.select("value", F.pow("value", F.lit(3)).alias("cubed"))
    b = charts.box_table(df, ["value", "cubed"])
    return rounded(b, 4, *[c for c in b.columns if c != "column"])


@query(
    "j2_outlier_scatter",
    f"""select o.o_orderkey, o_custkey::double as x, o_totalprice as y, case when is_outlier then 'Outlier' else 'Normal' end as status
        from orders o left join ({FLAGGED_SQL}) f on f.o_orderkey = o.o_orderkey""",
)
def _(t):
    flagged = outliers.flag_outliers(gaps(t, SCORED))
    return charts.outlier_scatter(t.orders, flagged, ["o_orderkey"], "o_custkey", "o_totalprice")


@query(
    "j3_importance_bars",
    "select p_brand as feature, round(avg(p_retailprice) / 1000, 5) as importance from part group by 1 order by importance desc, feature limit 12",
)
def _(t):
    scores = t.part.groupBy(F.col("p_brand").alias("feature")).agg(F.round(F.avg("p_retailprice") / 1000, 5).alias("importance"))
    return charts.importance_bars(scores)


FOLD_SCORES = "select c_mktsegment as model, c_nationkey as fold, avg(c_acctbal) / 10000 as score from {customer} group by c_mktsegment, c_nationkey"


@query(
    "j4_fold_score_boxes",
    f"""select model, round(min(score), 6) as min, round(quantile_cont(score, 0.25), 6) as q1, round(quantile_cont(score, 0.5), 6) as median,
               round(quantile_cont(score, 0.75), 6) as q3, round(max(score), 6) as max from ({plain(FOLD_SCORES)}) group by 1""",
)
def _(t):
    b = charts.fold_score_boxes(gaps(t, FOLD_SCORES))
    return rounded(b, 6, "min", "q1", "median", "q3", "max")


@query(
    "j5_trend_by_period",
    f"""select strftime(date_trunc('month', ts), '%Y-%m-%d') as period, round(avg(value), 4) as value, round(avg(trend), 4) as trend, count(*) as n
        from ({MOVING_SQL}) group by 1""",
)
def _(t):
    return rounded(trend.trend_by_period(_moving(t)), 4, "value", "trend")


@query(
    "j7_correlation_heatmap",
    f"""pivot (select a, b, round(r, 3) as correlation from ({LINE_PAIRS}) union all select b, a, round(r, 3) from ({LINE_PAIRS}) union all
        select c, c, 1.0 from (select unnest([{', '.join(f"'{c}'" for c in LINE_NUMBERS)}]) as c))
        on b in ({', '.join(f"'{c}'" for c in LINE_NUMBERS)}) using first(correlation) group by a""",
)
def _(t):
    return charts.correlation_heatmap(gaps(t, LINE_ALL), list(LINE_NUMBERS))


@query("j9_preview", "select o_orderkey, o_custkey, o_totalprice from orders order by o_orderkey limit 10")
def _(t):
    return charts.preview(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"])
