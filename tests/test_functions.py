from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from recurra.functions import (
    add_years,
    average_months,
    band,
    band_order,
    level_label,
    level_order,
    parse_day,
    percent_label,
    with_automatic_labels,
)
from recurra.spec import DURATION_BANDS, EDUCATION_LEVELS, Bands
from tests.brute_force import plus


def evaluate(spark, values, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(v,) for v in values], schema).select(*columns).collect()]


def test_parse_day(spark):
    texts = {
        "29oct2008": date(2008, 10, 29),
        "29OCT2008": date(2008, 10, 29),
        "01jan2010": date(2010, 1, 1),
        "5jan2010": date(2010, 1, 5),
        "05-Jan-2010": date(2010, 1, 5),
        "5 January 2010": date(2010, 1, 5),
        "17/june/2011": date(2011, 6, 17),
        "17jul2051": date(2051, 7, 17),
        "30 sep 2012": date(2012, 9, 30),
        "29feb2012": date(2012, 2, 29),
        "29feb2011": None,
        "31feb2010": None,
        "00jan2010": None,
        "janu2010": None,
        "2010-01-05": None,
        "12xyz2010": None,
        "": None,
        None: None,
    }
    found = evaluate(spark, texts, "t string", parse_day(F.col("t")))
    assert dict(zip(texts, (r[0] for r in found))) == texts


def test_every_month_is_known(spark):
    days = [date(2011, m, 3) for m in range(1, 13)]
    for pattern in ("%d%b%Y", "%d %B %Y"):
        found = evaluate(spark, [d.strftime(pattern) for d in days], "t string", parse_day(F.col("t")))
        assert [r[0] for r in found] == days


def test_add_years_has_no_answer_for_leap_days(spark):
    days = [date(2012, 2, 29), date(2012, 2, 28), date(2011, 2, 28), date(2010, 12, 31), None]
    found = evaluate(spark, days, "d date", add_years(F.col("d"), 1), add_years(F.col("d"), 4))
    assert found == [
        (None, date(2016, 2, 29)),
        (date(2013, 2, 28), date(2016, 2, 28)),
        (date(2012, 2, 28), date(2015, 2, 28)),
        (date(2011, 12, 31), date(2014, 12, 31)),
        (None, None),
    ]


def test_duration_bands(spark):
    expected = {0: 1, 1: 1, 365: 1, 366: 2, 730: 2, 731: 3, 1095: 3, 1096: None}
    start = date(2009, 1, 1)
    months = average_months(F.lit(start), F.col("d"))
    columns = band(months, DURATION_BANDS), band_order(months, DURATION_BANDS)
    found = evaluate(spark, [start + timedelta(days=n) for n in expected], "d date", *columns)
    labels = [DURATION_BANDS.labels[i - 1] if i else None for i in expected.values()]
    assert found == list(zip(labels, expected.values()))
    assert evaluate(spark, [start - timedelta(days=1), None], "d date", *columns) == [(None, None)] * 2


def test_bands_are_checked():
    with pytest.raises(ValueError):
        Bands((0, 12), ("a", "b"))
    with pytest.raises(ValueError):
        Bands((12, 0), ("a",))


def test_percent_label_rounds_ties_to_even(spark):
    values = [0.1225, 0.1375, 0.12345, 0.0, 1.0, None]
    found = evaluate(spark, values, "x double", percent_label(F.col("x")))
    assert [r[0] for r in found] == ["12.2%", "13.8%", "12.3%", "0.0%", "100.0%", None]
    assert evaluate(spark, [0.126], "x double", percent_label(F.col("x"), 0)) == [("13%",)]


def test_levels(spark):
    last = "Bachelor's degree or higher'"
    found = evaluate(
        spark,
        ["Some college", last, "Bachelor's degree or higher", None],
        "v string",
        level_label(F.col("v"), EDUCATION_LEVELS),
        level_order(F.col("v"), EDUCATION_LEVELS),
    )
    assert found == [("Some college", 3), (last, 5), (None, None), (None, None)]


def test_many_random_days_agree_with_python(spark):
    rng = random.Random(5)
    days = [date(1990, 1, 1) + timedelta(days=rng.randrange(15000)) for _ in range(3000)] + [date(2000, 2, 29)] * 3
    text = F.date_format("d", "ddMMMyyyy")
    columns = [add_years(F.col("d"), n) for n in (1, 2, 3, 4)] + [parse_day(F.lower(text)), parse_day(F.upper(text))]
    found = evaluate(spark, days, "d date", *columns)
    assert found == [(*[plus(d, n) for n in (1, 2, 3, 4)], d, d) for d in days]


def test_many_random_shares_agree_with_python(spark):
    rng = random.Random(6)
    shares = [rng.randrange(m + 1) / m for m in (rng.randrange(1, 500) for _ in range(3000))]

    def label(x):
        return f"{Decimal(repr(x * 100)).quantize(Decimal('0.1'), ROUND_HALF_EVEN)}%"

    found = evaluate(spark, shares, "x double", percent_label(F.col("x")))
    assert [r[0] for r in found] == [label(x) for x in shares]


@pytest.mark.parametrize(
    "shares, labels",
    [
        ([0.25, 0.5], ["25%", "50%"]),
        ([0.255, 0.25, None], ["25.5%", "25.0%", None]),
        ([0.12345678, 0.123461], ["12.3457%", "12.3461%"]),
        ([1 / 3], ["33%"]),
        ([0.1, 0.1], ["10%", "10%"]),
        ([0.1, 0.1000001], ["10.0000%", "10.0000%"]),
        ([None], [None]),
    ],
)
def test_automatic_labels_have_the_fewest_decimals_that_tell_shares_apart(spark, shares, labels):
    df = spark.createDataFrame(list(enumerate(shares)), "k int, prop double")
    assert [r["label"] for r in with_automatic_labels(df, "prop").orderBy("k").collect()] == labels
