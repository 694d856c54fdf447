import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.functions import columns, hashing, pvalues, text


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_correlation_p_is_the_t_test(spark):
    t, nu = 2.1, 50
    r = t / math.sqrt(nu + t * t)
    assert one(spark, pvalues.correlation_p(F.lit(r), F.lit(nu + 2))) == pytest.approx(0.0407953347346, abs=1e-10)
    assert one(spark, pvalues.correlation_p(F.lit(1.0), F.lit(10))) == 0.0
    assert one(spark, pvalues.correlation_p(F.lit(0.3), F.lit(2))) == 1.0
    assert one(spark, pvalues.correlation_p(F.lit(None).cast("double"), F.lit(10))) is None


def test_f_tail_has_a_closed_form_for_two_numerator_degrees(spark):
    f, d2 = 3.7, 20.0
    want = (1 + 2 * f / d2) ** (-d2 / 2)
    assert one(spark, pvalues.f_test_p(F.lit(f), F.lit(2.0), F.lit(d2))) == pytest.approx(want, rel=1e-10)


def test_normal_quantile_and_tail(spark):
    assert one(spark, pvalues.normal_quantile(F.lit(0.975))) == pytest.approx(1.959963984540054, abs=1e-9)
    assert one(spark, pvalues.normal_upper(F.lit(1.959963984540054))) == pytest.approx(0.025, abs=1e-9)


@pytest.mark.parametrize(
    "name,want",
    [("order_value", "Order Value"), ("3d view_o", "3D View_O".replace("_", " ")), (" a1b_c ", "A1B C"), ("X", "X"), ("", "")],
)
def test_titleize_matches_python_title(spark, name, want):
    assert one(spark, text.titleize(F.lit(name))) == want == name.replace("_", " ").strip().title()


@pytest.mark.parametrize(
    "value,want",
    [(1234567.0, "1.23M"), (-1500.0, "-1.50K"), (999.0, "999"), (0.125, "0.12"), (3.5e12, "3.50T"), (float("nan"), "n/a"),
     (float("inf"), "n/a"), (2e9, "2.00B"), (112945.0, "112.94K")],
)
def test_human_number(spark, value, want):
    assert one(spark, text.human_number(F.lit(value))) == want


def test_human_number_passes_words_through(spark):
    assert one(spark, text.human_number(F.lit("many"))) == "many"


def test_percent(spark):
    assert one(spark, text.percent(F.lit(0.1234))) == "12.3%"
    assert one(spark, text.percent(F.lit("x"))) == "n/a"


@pytest.mark.parametrize("r,want", [(0.7, "strong"), (-0.69, "moderate"), (0.2, "weak"), (0.19, "negligible")])
def test_strength(spark, r, want):
    assert one(spark, text.strength_label(F.lit(r))) == want


@pytest.mark.parametrize(
    "s,want", [(1.0, "right-skewed"), (1.01, "strongly right-skewed"), (0.5, "roughly symmetric"), (-0.6, "left-skewed"), (-1.1, "strongly left-skewed")]
)
def test_shape(spark, s, want):
    assert one(spark, text.shape_label(F.lit(s))) == want


def test_usable_question_strips_all_blanks(spark):
    assert one(spark, text.usable_question(F.lit("\n\t why \n"))) is False
    assert one(spark, text.usable_question(F.lit(" why x "))) is True
    assert one(spark, text.usable_question(F.lit(None).cast("string"))) is False


def test_uniform_and_poisson_are_well_spread(spark):
    df = spark.range(20000).select(hashing.key_text("id").alias("k"))
    u = df.select(hashing.uniform(F.col("k"), 3).alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(u[0] - 0.5) < 0.01 and u[1] >= 0 and u[2] < 1
    drawn = [bytes(r["d"]) for r in df.select(hashing.digests(F.col("k"), 6).alias("d")).collect()]
    w = hashing.poisson_weights(drawn, 6)
    assert w.shape == (20000, 6) and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and w.max() > 6
    assert abs(np.corrcoef(w.T) - np.eye(6)).max() < 0.03


def test_poisson_cuts_reach_the_end_of_the_tail():
    cuts = hashing.poisson_cuts(32)
    assert cuts == sorted(set(cuts)) and len(cuts) >= 11
    shares = np.diff([0, *cuts, 2**32]) / 2**32
    assert np.allclose(shares[:-1], [math.exp(-1) / math.factorial(k) for k in range(len(cuts))], atol=2**-31)
    assert hashing.poisson_weights([b"\xff\xff\xff\xff" + bytes(12)], 2).tolist() == [[len(cuts), 0.0]]


@pytest.mark.parametrize("day_first", [False, True])
def test_signatures_try_the_layouts_that_could_read_a_text(spark, day_first):
    """The same readings as trying every layout in turn."""
    numbers = [f"{a}{s}{b}{s}{c}{t}" for s in "/-." for a, b, c in (("1", "2", "2024"), ("31", "12", "2023"), ("12", "31", "2023"), ("13", "13", "2020"), ("2024", "1", "2"), ("2024", "12", "31"), ("1", "2", "24"), ("01", "02", "99"))
               for t in ("", " 7:05", " 17:05:09", " 7:5", "T10:00")]
    words = ["5-Jan-2024", "05 Feb 2024", "5 March 2024", "Mar 5, 2024", "Mar 5 2024", "September 30, 2024", "May 1 2024", "1 May 2024", "Sept 1, 2024", "31 November 2024"]
    other = ["20240131", "20241301", "2024-01-31 10:11:12.5", "2024", "x", "", " 2024-01-02 ", "12:30", "1.5", "٣/٤/٢٠٢٤", None]
    df = spark.createDataFrame([(v,) for v in numbers + words + other], "t string")
    c, layouts = F.col("t"), columns.DAY_FIRST if day_first else columns.MONTH_FIRST
    every = F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) if p else c.try_cast("timestamp") for p in layouts])
    rows = df.select("t", columns.as_time(df, "t", day_first).alias("got"), every.alias("want")).collect()
    assert [(r["t"], r["got"]) for r in rows] == [(r["t"], r["want"]) for r in rows]
    assert sum(r["got"] is not None for r in rows) > 40
