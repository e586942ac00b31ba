import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from recordlake.operators import resolve as rs

NOTICE = "date date, section string, number string"
SALE = "id_mutation string, sale_date date, section string, number string"


def frames(rows, n=120):
    rng = random.Random(2)
    day = lambda: rng.choice([None, *(date(2024, 1, 1) + timedelta(rng.randrange(200)) for _ in range(9))])
    parcel = lambda: (rng.choice(["AB", "C", None]), rng.choice(["0001", "0002", "0003"]))
    notices = [(day(), *parcel()) for _ in range(n)]
    sales = [(f"s{rng.randrange(30)}" if rng.random() > 0.05 else None, day(), *parcel()) for _ in range(n)]
    return rows(notices + notices[:9], NOTICE), rows(sales + sales[:9], SALE)


def test_counted_notices_are_the_pairs(rows):
    notices, sales = frames(rows)
    keys = ["section", "number", "id_mutation", "sale_date"]
    want = rs.match_notices(notices, sales).groupBy(*keys).agg(F.count("*").alias("notices"))
    got = rs.match_notices(notices, sales, counted=True).select(*keys, "notices")
    assert want.count() > 50 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_notices_and_sales_of_a_busy_parcel_do_not_meet_one_by_one(rows, spark):
    """3,000 days with a notice and 3,000 sales on each parcel: 9 million pairs, a row for each sale here."""
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int"))
    parcel = [F.lit("AB").alias("section"), F.lit("0001").alias("number")]
    notices = spark.range(3000).select(day.alias("date"), *parcel)
    sales = spark.range(3000).select(F.col("id").cast("string").alias("id_mutation"), day.alias("sale_date"), *parcel)
    found = rs.match_notices(notices, sales, counted=True)
    assert found.agg(F.count("*"), F.sum("notices")).first() == (3000, sum(min(i + 61, 3000) for i in range(3000)))
