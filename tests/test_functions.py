import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tabforge.functions import mapping, numeric as num, text
from tabforge.plans.scale import probit


def column(spark, values, kind, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_titles(spark):
    names = ["Smith, Mr. John", "No title", "A, Dr. Mrs. B", "", None]
    assert column(spark, names, "string", text.extract_title) == ["Mr", "", "Dr", "", None]
    missing = column(spark, names, "string", lambda c: text.extract_title(c, True))
    assert missing == ["Mr", None, "Dr", None, None]


def test_cabins_never_raise(spark):
    cabins = ["B/0/P", None, "A/7", "A/x/S"]
    found = column(spark, cabins, "string", text.parse_cabin)
    assert [tuple(f) for f in found] == [
        ("B", 0.0, "P"), ("T", 0.0, "P"), ("A", 7.0, None), ("A", None, "S"),
    ]
    assert column(spark, cabins, "string", text.deck_letter) == ["B", "M", "A", "A"]


def test_group_and_surname(spark):
    found = column(spark, ["0013_02", "x"], "string", text.parse_group)
    assert [tuple(f) for f in found] == [("0013", 2), ("x", None)]
    assert column(spark, ["Ann B Lee", None], "string", text.surname) == ["Lee", "Unknown"]


def test_mapping_keeps_or_drops_unknown(spark):
    titles = ["Mlle", "Mr", None]
    replaced = column(spark, titles, "string",
                      lambda c: mapping.replace_values(c, mapping.TITLE_GROUPS))
    assert replaced == ["Miss", "Mr", None]
    mapped = column(spark, titles, "string",
                    lambda c: mapping.map_values(c, mapping.TITLE_CODES))
    assert mapped == [None, 1, None]
    assert column(spark, titles, "string",
                  lambda c: mapping.map_values(c, mapping.TITLE_CODES, 0)) == [0, 1, 0]


def test_clip_keeps_null(spark):
    assert column(spark, [None, 1.0, 3.0, 9.0], "double",
                  lambda c: num.clip_upper(c, 3.0)) == [None, 1.0, 3.0, 3.0]
    assert column(spark, [None, 1.0, 3.0], "double",
                  lambda c: num.clip_lower(c, 2.0)) == [None, 2.0, 3.0]


def test_bins_are_closed_on_the_right(spark):
    values = [300.0, 0.0, -1.0, 2600.0, None, 300.5, 2500.0]
    cut = column(spark, values, "double",
                 lambda c: num.bin_right(c, num.REGION_EDGES, open_ends=False, other=0))
    assert cut == [0, 0, 0, 0, 0, 1, 4]
    ages = column(spark, [16.0, 16.5, 62.0, 99.0, None], "double",
                  lambda c: num.bin_right(c, num.AGE_EDGES))
    assert ages == [0, 1, 3, 4, None]


def test_sums_skip_or_propagate_null(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, 2.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = df.select(num.row_sum([a, b]), num.lin_comb([a, b], [1, 0.5])).collect()
    assert [tuple(r) for r in got] == [(1.0, None), (0.0, None), (3.0, 2.0)]


def test_ratios_and_positions_survive_zero(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, None)], "n double, top double")
    position = num.relative_position(F.col("n"), F.col("top"))
    assert [r[0] for r in df.select(position).collect()] == [None, 5.0 / 2000]
    assert column(spark, [-1.0], "double", lambda c: num.safe_ratio(F.lit(1.0), c)) == [None]


def test_flags_and_answers(spark):
    assert column(spark, [0.0, None, 2.0], "double", lambda c: num.flag(c == 0)) == [1, 0, 0]
    answers = column(spark, ["12", "-3", "123456", "x", None], "string", num.clamp_answer)
    assert answers == [12, 0, 99999, 0, 0]
    assert column(spark, [0.0, -2.0, math.e], "double", num.log_pos) == [0.0, 0.0, 1.0]


@pytest.mark.parametrize("p", [1e-7, 1e-4, 0.02, 0.2, 0.5, 0.61, 0.93, 1 - 1e-6])
def test_probit(spark, p):
    found = spark.range(1).select(probit(F.lit(p) + F.col("id"))).first()[0]
    assert found == pytest.approx(NormalDist().inv_cdf(p), rel=1e-12, abs=1e-12)
