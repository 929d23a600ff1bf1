"""Mini-cases of the text, time and band functions, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from crowdloom.functions import scalars as S


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("올림픽공원(한국체대)", "올림픽공원"), ("총신대입구(이수)", "이수"), ("신내역", "신내"), ("서울역", "서울역"), (" 시 청 ", "시청")])
def test_canonical_name(spark, raw, want):
    assert one(spark, S.canonical_name(F.lit(raw), forced={"총신대입구(이수)": "이수"}, keep_suffix=("서울역",))) == want


@pytest.mark.parametrize(("raw", "want"), [("5시30분", 330), ("00시00분", 1440), ("05:30~06:00", 330), ("24:30~25:00", 1470), ("00시", 1440)])
def test_header_minutes(spark, raw, want):
    assert one(spark, S.header_minutes(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [("01:30", 1.5), ("10:00", 10.0), ("bad", None)])
def test_mmss(spark, raw, want):
    assert one(spark, S.mmss_minutes(F.lit(raw))) == want


def test_time_bins(spark):
    assert one(spark, S.bin_label(S.time_bin(F.lit(510)))) == "08:30~09:00"
    assert one(spark, S.time_bin(F.lit(100))) == 0 and one(spark, S.time_bin(F.lit(3000))) == 38
    assert [one(spark, S.hour_code(F.lit(m))) for m in (330, 480, 1440)] == ["before_06", "08", "after_24"]


def test_hour_list(spark):
    assert one(spark, S.hour_list(F.lit("20;21;22;23;00;01"))) == [20, 21, 22, 23, 24]
    assert one(spark, S.hour_list(F.lit("23;01"), add=True)) == [23, 25]


def test_multiplier_and_strength(spark):
    assert [one(spark, S.perceived_multiplier(F.lit(x))) for x in (80.0, 180.0)] == [1.0, 1.5]
    assert one(spark, S.perceived_multiplier(F.lit(None).cast("double"))) is None
    assert [one(spark, S.strength(F.lit(x))) for x in (1.19, 1.2, 1.5, 2.0, 3.0)] == ["not_significant", "weak", "medium", "strong", "very_strong"]


@pytest.mark.parametrize(("text", "want"), [("강동 방면", "강동"), ("서울역 방면", "서울"), ("역촌", "역촌"), ("동대문역사문화공원 방면", "동대문역사문화공원")])
def test_toward(spark, text, want):
    assert one(spark, S.toward(F.lit(text))) == want


def test_valid_toward(spark):
    cases = [("강동", "강동 방면", False), ("강동", "길동 방면", True), ("동대문", "동대문역사문화공원 방면", True), ("강동", "", False), ("강동", None, False)]
    for station, text, want in cases:
        assert one(spark, S.valid_toward(F.lit(station), F.lit(text).cast("string"))) is want


def test_titles_and_dates(spark):
    assert one(spark, S.title_year_first(F.lit("Fireworks  2024 night"))) == "2024 Fireworks night"
    a, b, n = S.range_parts(F.lit("2024-10-05~2024-10-07"))
    assert one(spark, n) == 3 and str(one(spark, b)) == "2024-10-07"
    assert one(spark, S.clean_date(F.lit("nan"))) is None
