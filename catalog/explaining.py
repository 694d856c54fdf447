"""Explanations and confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions.hashing import poisson_cuts
from assay.operators import confidence as conf, explain, segments
from assay.operators.correlation import correlation_analysis
from assay.operators.supervised import permutation_importance
from assay.operators.validate import missing_shares
from catalog import sqltext as q
from catalog.models import searched_spend
from catalog.registry import LINE_GAPS, gaps, joined, longs, plain, query, rounded

DIRECTION = "case when {r} > 0 then 'increases' else 'decreases' end"


@query(
    "f1_feature_directions",
    f"""with o as (select *, dense_rank() over (order by o_orderstatus) - 1 as code from orders)
        select 'classification' as kind, feature, {DIRECTION.format(r='r')} as direction from (
          select 'o_custkey' as feature, corr(o_custkey, code) as r from o union all select 'o_totalprice', corr(o_totalprice, code) from o)
        union all select 'classification', 'o_orderpriority', 'varies by category'
        union all
        select 'regression', feature, {DIRECTION.format(r='r')} from (
          select 'l_quantity' as feature, corr(l_quantity, l_extendedprice) as r from lineitem union all
          select 'l_discount', corr(l_discount, l_extendedprice) from lineitem union all select 'l_tax', corr(l_tax, l_extendedprice) from lineitem)
        union all select 'regression', 'l_returnflag', 'varies by category'""",
)
def _(t):
    classes = explain.feature_directions(t.orders, "o_orderstatus", ["o_custkey", "o_totalprice", "o_orderpriority"], "classification")
    numbers = explain.feature_directions(
        t.lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_returnflag"], "regression"
    )
    return classes.withColumn("kind", F.lit("classification")).unionByName(numbers.withColumn("kind", F.lit("regression")))


# Importances that follow from the data: what the mean price owes to each brand.
IMPORTANCE = "select lower(replace(p_type, ' ', '_')) as feature, round(avg(p_retailprice) / 1000, 5) as importance from part group by 1"
DIRECTIONS = "select lower(replace(p_type, ' ', '_')) as feature, case when avg(p_size) > 25.5 then 'increases' else 'decreases' end as direction from part where p_type <> 'PROMO' group by 1"
RANKED_SQL = f"""select row_number() over (order by importance desc, feature) as rank, feature, importance, coalesce(direction, 'unclear') as direction
                 from ({IMPORTANCE}) left join ({DIRECTIONS}) using (feature)"""


def _ranked(t):
    t.part.createOrReplaceTempView("part")
    return explain.global_importance(t.spark.sql(IMPORTANCE), t.spark.sql(DIRECTIONS))


@query("f2_global_importance", RANKED_SQL)
def _(t):
    return longs(_ranked(t), "rank")


@query(
    "f3_feature_sentences",
    f"""select rank, feature, f || ' is ' || case when rank = 1 then 'the leading feature' else 'the #' || rank || ' feature' end || ' — ' ||
          case when direction in ('increases', 'decreases') then 'higher ' || f || ' goes with ' || case direction when 'increases' then 'a higher' else 'a lower' end
               || ' predicted value' else f || ' also matters' end || '.' as sentence
        from (select *, {q.title('feature')} as f from ({RANKED_SQL})) where rank <= 5""",
)
def _(t):
    return longs(explain.feature_sentences(_ranked(t), "regression", "retail_price"), "rank")


@query(
    "f4_row_contributions",
    """with m as (select avg(c_acctbal) as a, avg(c_nationkey) as b from customer)
       select c_custkey, 1 as rank, 'c_acctbal' as feature, round(c_acctbal, 3)::varchar as value,
              case when c_acctbal > a then 'above' else 'below' end as vs_average, 'increases' as direction from customer, m
       union all
       select c_custkey, 2, 'c_nationkey', c_nationkey::double::varchar, case when c_nationkey > b then 'above' else 'below' end, 'decreases' from customer, m
       union all
       select c_custkey, 3, 'c_mktsegment', c_mktsegment, 'n/a', 'varies by category' from customer""",
)
def _(t):
    ranked = t.spark.createDataFrame(
        [(1, "c_acctbal", "increases"), (2, "c_nationkey", "decreases"), (3, "c_mktsegment", "varies by category")],
        "rank int, feature string, direction string",
    )
    return explain.row_contributions(t.customer, ["c_custkey"], ranked)


@query("f4_explain_rows")
def _(t):
    m = searched_spend(t)
    directions = explain.feature_directions(m.rows, "_label", m.features, "regression")
    return explain.explain_rows(m, explain.global_importance(permutation_importance(m), directions))


@query(
    "f5_describe_clusters",
    """with p as (select c_mktsegment as cluster, count(*) as n, round(avg(c_acctbal), 3) as c_acctbal, round(avg(c_nationkey), 3) as c_nationkey from customer group by 1)
       select cluster, n, case when abs(c_acctbal) >= abs(c_nationkey) then 'c_acctbal' else 'c_nationkey' end as feature,
              greatest(abs(c_acctbal), abs(c_nationkey)) as value from p""",
)
def _(t):
    from assay.operators.clustering import cluster_profile, cluster_sizes

    cols = ["c_acctbal", "c_nationkey"]
    return explain.describe_clusters(
        cluster_profile(t.customer, "c_mktsegment", cols), cluster_sizes(t.customer, "c_mktsegment"), cols
    )


@query("f6_explain_model")
def _(t):
    m = searched_spend(t)
    m.feature_importance = permutation_importance(m)
    return explain.explain_model(m)["sentences"]


@query(
    "g1_data_quality",
    f"""with x as (select count(*) as n, (0 + 1 - count(l_extendedprice)::double / count(*) + 1 - count(l_discount)::double / count(*) + 0 + 0) / 5 as missing
             from ({plain(LINE_GAPS)})), s as (select count(*) as n, 0.0 as missing from supplier)
        select 'lineitem' as run_id, round(greatest(0.0, least(1.0, 1 - case when n < 100 then 0.3 when n < 500 then 0.1 else 0 end - least(0.3, missing) - 0.1 * 2)), 6) as data_quality from x
        union all
        select 'supplier', round(greatest(0.0, least(1.0, 1 - case when n < 100 then 0.3 when n < 500 then 0.1 else 0 end - least(0.3, missing))), 6) from s""",
)
def _(t):
    line = missing_shares(gaps(t, LINE_GAPS)).withColumn("run_id", F.lit("lineitem"))
    supplier = missing_shares(t.supplier).withColumn("run_id", F.lit("supplier"))
    warnings = t.spark.createDataFrame([("lineitem", 2)], "run_id string, warnings int")
    return rounded(conf.data_quality(line.unionByName(supplier), warnings), 6, "data_quality")


def _score(p: str) -> str:
    return f"case when {p} is null then 0.6 when {p} < 0.01 then 1.0 when {p} < 0.05 then 0.7 when {p} < 0.1 then 0.5 else 0.3 end"


@query(
    "g2_significance",
    f"""with p as (select *, round({q.correlation_p('r', 'n')}, 5) as p, row_number() over (order by abs(round(r, 3)) desc, pair) as rank
             from ({q.pairs(f'({plain(LINE_GAPS)})', ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'])}))
        select 'correlation_analysis' as analysis_type, min(p) as p_value, {_score('min(p)')} as significance from p where rank <= 5
        union all select 'distribution_analysis', null, 0.6""",
)
def _(t):
    pairs = correlation_analysis(gaps(t, LINE_GAPS), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    p = conf.headline_p(pairs).withColumn("analysis_type", F.lit("correlation_analysis"))
    none = t.spark.createDataFrame([(None, "distribution_analysis")], "p_value double, analysis_type string")
    return p.unionByName(none).withColumn("significance", conf.significance_score(F.col("p_value")))


REPS = "with r as (select unnest(range(0, 50)) as rep)"
# round(2^32 * CDF) of the Poisson(1) law; eight hex digits order like their number.
POISSON_CASES = " ".join(f"when h < '{cut:08x}' then {value}" for value, cut in enumerate(poisson_cuts()))
BOOT_SQL = f"""{REPS}, o as (select o_orderkey::varchar as k, o_custkey::double as x, o_totalprice - o_custkey * 100.0 as y from orders),
 d as (select rep, x, y, substr(md5(k || ':' || (rep // 4)), (rep % 4) * 8 + 1, 8) as h from o, r),
 w as (select rep, x, y, case {POISSON_CASES} else {len(poisson_cuts())} end as w from d),
 m as (select rep, sum(w) as n, sum(w * x) / sum(w) as mx, sum(w * y) / sum(w) as my from w group by 1),
 c as (select w.rep, sum(w * (x - mx) * (y - my)) / sqrt(sum(w * (x - mx) * (x - mx)) * sum(w * (y - my) * (y - my))) as r from w join m using (rep) group by 1)"""


def _boot(t):
    return t.orders.select("o_orderkey", "o_custkey", (F.col("o_totalprice") - F.col("o_custkey") * 100.0).alias("rest"))


@query("g3_bootstrap_correlations", f"{BOOT_SQL} select rep, round(r, 6) as r from c")
def _(t):
    return rounded(conf.bootstrap_correlations(_boot(t), ["o_orderkey"], "o_custkey", "rest"), 6, "r")


@query(
    "g3_bootstrap_stability",
    f"""{BOOT_SQL} select (select count(*) from orders) as rows, count(*) as usable,
        round(greatest(0.0, 1 - least(stddev_pop(r) / (abs(avg(r)) + 1e-9), 1.0)), 4) as stability from c""",
)
def _(t):
    return rounded(conf.bootstrap_stability(_boot(t), ["o_orderkey"], "o_custkey", "rest"), 4, "stability")


@query(
    "g4_composite",
    """select c_nationkey, round(greatest(0.0, least(1.0, 0.3 * qy + 0.4 * s + 0.3 * b)), 2) as confidence from (
         select c_nationkey, round(avg(c_acctbal) / 10001.7, 3) as qy, round(median(c_acctbal) / 10003.3, 3) as s, 0.61803 as b from customer group by 1)""",
)
def _(t):
    parts = t.customer.groupBy("c_nationkey").agg(
        F.round(F.avg("c_acctbal") / 10001.7, 3).alias("q"), F.round(F.median("c_acctbal") / 10003.3, 3).alias("s")
    )
    return parts.select("c_nationkey", conf.composite(F.col("q"), F.col("s"), F.lit(0.61803)).alias("confidence"))


@query(
    "g5_labels",
    """select c_custkey, c_acctbal / 10000 as confidence, case when c_acctbal / 10000 >= 0.8 then 'High confidence' when c_acctbal / 10000 >= 0.5 then 'Moderate confidence'
         else 'Low confidence — interpret with caution' end as label,
         case when c_acctbal / 10000 >= 0.8 then '#1a9850' when c_acctbal / 10000 >= 0.5 then '#fc8d59' else '#d73027' end as color from customer""",
)
def _(t):
    return conf.labelled(t.customer.select("c_custkey", (F.col("c_acctbal") / 10000).alias("confidence")))


@query(
    "g6_annotate",
    """select event_type as analysis_type, n, coalesce(confidence, 0.5) as confidence from (select event_type, count(*) as n from events group by 1)
       left join (select event_type as e, round(0.3 * 0.9 + 0.4 * 0.7 + 0.3 * round(avg(value) / 100.3, 3), 2) as confidence
                  from events where event_type <> 'error' group by 1) on e = event_type""",
)
def _(t):
    found = t.events.groupBy(F.col("event_type").alias("analysis_type")).agg(F.count(F.lit(1)).alias("n"))
    parts = (
        t.events.where(F.col("event_type") != "error")
        .groupBy(F.col("event_type").alias("analysis_type"))
        .agg(F.round(F.avg("value") / 100.3, 3).alias("stability"))
        .withColumn("data_quality", F.lit(0.9))
        .withColumn("significance", F.lit(0.7))
    )
    return conf.annotate(found.withColumn("confidence", F.lit(None).cast("double")), parts)
