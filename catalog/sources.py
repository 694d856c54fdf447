"""Sources, history, naming, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions.lineage import shared_path
from assay.functions.text import usable_question
from assay.operators import validate
from assay.sources import history, naming, tables as loading
from catalog.registry import CUSTOMER_GAPS, LINE_GAPS, gaps, joined, longs, plain, query, rounded

SUPPLIER_SQL = "select s_suppkey, s_name, s_nationkey::bigint as s_nationkey, s_acctbal from supplier"


@query("a1_load_csv", SUPPLIER_SQL)
def _(t):
    path = shared_path(t.spark, "supplier")
    raw = t.supplier.toDF("S SuppKey", "S Name", " S_NationKey ", "s acctbal")
    raw.write.option("header", True).option("sep", ";").csv(path)
    return longs(loading.load_csv(t.spark, path), "s_suppkey", "s_nationkey")


@query(
    "a2_load_sql",
    "select o_orderstatus as order_status, count(*) as n_orders, round(sum(o_totalprice), 2) as total_price "
    "from orders group by all",
)
def _(t):
    t.orders.createOrReplaceTempView("orders")
    return loading.load_sql(
        t.spark,
        "select o_orderstatus as `Order Status`, count(*) as `N Orders`, round(sum(o_totalprice), 2) as `Total!Price` "
        "from orders group by o_orderstatus",
    )


@query(
    "a3_load_any",
    "select 'parquet' as source_kind, 'orders.parquet' as filename, count(*) as rows, 6::bigint as cols, true as valid from orders",
)
def _(t):
    loaded = loading.load_any(t.spark, t.path("orders"), "orders.parquet")
    valid = loaded.validation.first()["valid"]
    return loaded.metadata.withColumn("valid", F.lit(valid))


@query(
    "a4_largest_table",
    """select position, name, n from (
         select 0 as position, 'customer' as name, count(*) as n from customer union all
         select 1, 'part', count(*) from part union all
         select 2, 'supplier', count(*) from supplier union all
         select 3, 'documents', count(*) from documents) order by n desc, position limit 1""",
)
def _(t):
    named = {n: getattr(t, n) for n in ("customer", "part", "supplier", "documents")}
    return loading.largest_table(named)


@query(
    "a5_normalise_columns",
    """select c_custkey as c_custkey, c_name as c_custkey_1, c_nationkey as weird_col, c_acctbal as column,
              c_mktsegment as c_custkey_1_1 from customer""",
)
def _(t):
    raw = t.customer.toDF(" C CustKey ", "c!!custkey", "__Weird!!Col__", "%%", "c_custkey_1")
    return naming.normalise_columns(raw)


RUNS = """
select md5(cast(user_id as {text})) as id, max(ts) as created_at, concat('user ', cast(user_id as {text})) as dataset_name,
       count(*) as row_count, 6 as col_count, 'What drives value?' as business_question,
       max(event_type) as kind, min(event_id) as first_event, max(event_id) as last_event
from events group by user_id
"""


def _saved(t):
    t.events.createOrReplaceTempView("events")
    runs = t.spark.sql(RUNS.format(text="string"))
    shaped = runs.select(
        "id", "created_at", "dataset_name", "row_count", "col_count", "business_question",
        F.concat(F.lit("report on "), "dataset_name").alias("report_text"),
        F.struct(F.col("kind").alias("problem_type"), F.col("first_event").alias("_x")).alias("plan"),
        F.struct("first_event", "last_event").alias("results"),
        F.struct(F.col("row_count").alias("n_samples")).alias("model_performance"),
    )
    path = shared_path(t.spark, "sessions")
    history.save_sessions(shaped, path)
    return history.read_sessions(t.spark, path)


STORED = f"""
select id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at, dataset_name, row_count, col_count::bigint as col_count,
       business_question, kind as problem_type, '{{"problem_type":"' || kind || '"}}' as plan_json,
       '{{"first_event":' || first_event || ',"last_event":' || last_event || '}}' as results_json,
       'report on ' || dataset_name as report_text, '{{"n_samples":' || row_count || '}}' as model_performance_json
from ({RUNS.format(text="varchar")})
"""


@query("a6_save_sessions", STORED)
def _(t):
    return _saved(t).drop("run_date")


@query(
    "a7_list_sessions",
    f"""select id, created_at, dataset_name, row_count, col_count, business_question, problem_type from ({STORED})
        order by created_at desc, id limit 5""",
)
def _(t):
    return history.list_sessions(_saved(t))


@query(
    "a8_load_session",
    f"""select id, created_at, dataset_name, row_count, col_count, business_question, problem_type, report_text,
               problem_type as plan_kind, split_part(split_part(results_json, ':', 2), ',', 1)::bigint as first_event, row_count as n_samples
        from ({STORED}) where id = (select min(id) from ({STORED}))""",
)
def _(t):
    sessions = _saved(t)
    wanted = sessions.agg(F.min("id")).first()[0]
    one = history.load_session(sessions, wanted)
    return one.select(
        *[c for c in one.columns if c not in ("plan", "results", "model_performance")],
        F.variant_get("plan", "$.problem_type", "string").alias("plan_kind"),
        F.variant_get("results", "$.first_event", "bigint").alias("first_event"),
        F.variant_get("model_performance", "$.n_samples", "bigint").alias("n_samples"),
    )


@query(
    "a9_strip_private",
    """select event_id, '{"value":' || user_id || ',"inner":{"kind":"' || event_type || '"}}' as details from events""",
)
def _(t):
    raw = t.events.select(
        "event_id", F.col("user_id").alias("_user"),
        F.struct(
            F.col("user_id").alias("value"), F.col("props").alias("_props"),
            F.struct(F.col("event_type").alias("kind"), F.lit(1).alias("_n")).alias("inner"),
        ).alias("details"),
    )
    return naming.strip_private(raw).withColumn("details", F.to_json("details"))


@query(
    "b1_shape_check",
    """select name, row_count, col_count, case when row_count < 10 then
         'The table has ' || row_count || ' rows, fewer than the 10 that an analysis takes.' else '' end as errors
       from (select 'region' as name, count(*) as row_count, 2::bigint as col_count from region
             union all select 'lineitem', count(*), 11 from lineitem)""",
)
def _(t):
    checks = [validate.shape_check(getattr(t, n)).withColumn("name", F.lit(n)) for n in ("region", "lineitem")]
    return checks[0].unionByName(checks[1]).withColumn("errors", joined("errors"))


BLANKED = "select *, nullif(c_name, c_name) as empty_a, case when c_acctbal > 7000 then c_acctbal end as sparse_b from {customer}"


@query(
    "b2_empty_columns",
    f"select 5 as position, 'empty_a' as name from ({plain(BLANKED)}) having count(empty_a) = 0 and count(*) > 0",
)
def _(t):
    return validate.empty_columns(gaps(t, BLANKED))


@query(
    "b3_high_missing_columns",
    f"""select 6 as position, 'sparse_b' as name, round(1 - count(sparse_b)::double / count(*), 6) as null_share
        from ({plain(BLANKED)}) having null_share > 0.5 and count(sparse_b) > 0""",
)
def _(t):
    return rounded(validate.high_missing_columns(gaps(t, BLANKED)), 6, "null_share")


@query(
    "b4_duplicate_rows",
    f"""select (select count(*) from ({plain(LINE_GAPS)})) -
              (select count(*) from (select distinct * from ({plain(LINE_GAPS)}))) as duplicate_rows""",
)
def _(t):
    return validate.duplicate_rows(gaps(t, LINE_GAPS))


ITEMS = "select l_linenumber, l_discount, nullif(l_returnflag, l_returnflag) as nothing from {lineitem}"


@query(
    "b5_validate",
    f"""select true as valid, 'Columns without any value, which are left out: [''nothing'']|' ||
          (count(*) - (select count(*) from (select distinct * from ({plain(ITEMS)})))) || ' row(s) repeat an earlier one in full.' as warnings,
          '' as errors, count(*) as row_count, 3::bigint as col_count from ({plain(ITEMS)})""",
)
def _(t):
    v = validate.validate(gaps(t, ITEMS))
    return v.withColumn("warnings", joined("warnings")).withColumn("errors", joined("errors"))


@query(
    "b6_usable_question",
    """select role, count(*) as n, count(*) filter (where length(trim(text, E' \\t\\n\\r\\f\\v')) >= 5) as usable
       from conversations group by role""",
)
def _(t):
    return t.conversations.groupBy("role").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(usable_question(F.col("text"))).alias("usable")
    )
