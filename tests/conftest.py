import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def churn(spark):
    """A churn-like table: id, numbers, one category, a 0/1 target that depends on them."""
    rng = np.random.default_rng(7)
    n = 400
    tenure = rng.integers(1, 73, n)
    calls = rng.integers(0, 11, n)
    charges = rng.uniform(20, 120, n).round(2)
    contract = rng.choice(["month-to-month", "one-year", "two-year"], n)
    odds = 0.4 * calls - 0.08 * tenure + (contract == "month-to-month") * 1.5
    churned = (rng.uniform(size=n) < 1 / (1 + np.exp(-odds))).astype(int)
    pdf = pd.DataFrame(
        {
            "customer_id": np.arange(10000, 10000 + n), "tenure_months": tenure, "monthly_charges": charges,
            "contract_type": contract, "support_calls": calls, "churn": churned,
        }
    )
    return spark.createDataFrame(pdf).persist()


@pytest.fixture(scope="session")
def sales(spark):
    """A sales-like table: text dates, a rising revenue, regions, one id."""
    rng = np.random.default_rng(11)
    n = 240
    day = pd.date_range("2023-01-01", periods=n)
    spend = rng.uniform(50, 1200, n).round(2)
    pdf = pd.DataFrame(
        {
            "sale_id": np.arange(n), "date": day.strftime("%Y-%m-%d"), "region": rng.choice(["north", "south", "east"], n),
            "marketing_spend": spend, "revenue": (100 + 2.0 * np.arange(n) + 0.8 * spend + rng.normal(0, 20, n)).round(2),
        }
    )
    return spark.createDataFrame(pdf).persist()
