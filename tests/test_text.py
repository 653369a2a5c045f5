"""Text functions on hand-checkable rows."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.pseudonym import pseudonym

KEYS = [
    ("Khách sạn Pullman Vũng Tàu", "Vũng Tàu", "pullman tau vung", "pullman", "hotel"),
    ("Pullman Vung Tau", "Vũng Tàu", "pullman tau vung", "pullman", "unspecified"),
    ("RAON Hotel - STAY 24H", "Quy Nhơn", "24h raon stay", "24h raon stay", "hotel"),
    ("Raon Villa - STAY 24H", "Đà Lạt", "24h raon stay", "24h raon stay", "villa"),
    ("Khu nghỉ dưỡng Pilgrimage Village Boutique", "Huế", "pilgrimage village", "pilgrimage village", "resort"),
    ("Pilgrimage Village Resort & Spa Huế", "Huế", "hue pilgrimage village", "pilgrimage village", "resort"),
    ("Đà Lạt Hotel", "Đà Lạt", "da lat", "da lat", "hotel"),
    ("Mira Hotel & Resort", "Quy Nhơn", "mira", "mira", "unspecified"),
    ("Khách sạn Sea Links Beach Phan Thiết", "Phan Thiết", "beach links phan sea thiet", "beach links sea", "hotel"),
    ("Sea Links Beach Villas Phan Thiết", "Phan Thiết", "beach links phan sea thiet", "beach links sea", "villa"),
]


def test_keys_and_types(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(KEYS)], "i int, name string, city string, k string, d string, t string")
    for r in df.select("*", T.canonical_key(F.col("name")).alias("k2"), T.discriminative_key(F.col("name"), F.col("city")).alias("d2"), T.property_type(F.col("name")).alias("t2")).collect():
        assert (r.k2, r.d2, r.t2) == (r.k, r.d, r.t), r.name


@pytest.mark.parametrize("text", ["Đặng Thị Ngọc", "école", "ÀÉÎõü", "", "plain"])
def test_strip_accents_equals_the_exact_form(spark, text):
    df = spark.createDataFrame([(text,), (None,)], "t string")
    r = df.select(T.strip_accents(F.col("t")).alias("a"), T.strip_accents_exact("t").alias("b")).collect()
    assert r[0].a == r[0].b and r[1].a == r[1].b == ""


def test_pseudonyms_are_hmac(spark):
    want = {"Nguyễn": "U58efad6b927f", "Thanh": "Uedd4f511cac9", "吴振成": "Ubd8bca2b262f"}
    df = spark.createDataFrame([(n,) for n in want], "n string")
    assert {r.n: r.p for r in df.select("n", pseudonym(F.col("n"), "test-salt").alias("p")).collect()} == want
    long = "s" * 100
    got = df.select("n", pseudonym(F.col("n"), long, "H", 20).alias("p")).collect()
    assert all(r.p == "H" + hmac.new(long.encode(), r.n.encode(), hashlib.sha256).hexdigest()[:20] for r in got)
    with pytest.raises(ValueError):
        pseudonym(F.col("n"), "")


def test_placeholders(spark):
    names = ["Không tên", "N/A", "--", "guest", "Anonymous", "李雷", "", None, "Nam", "???"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    r = df.select(T.is_placeholder(F.col("n")).alias("p"), T.is_placeholder(F.col("n"), True).alias("c")).collect()
    assert [x.p for x in r] == [True, True, True, True, True, False, True, True, False, True]
    assert [x.c for x in r] == [True, True, True, True, True, True, True, True, False, True]


def test_numbers_dates_labels(spark):
    df = spark.createDataFrame([("8..5", "2009-12-31", "Yes"), ("abc", "2023-13-01", "0.0"), (" 11", "03/02/2020", "2"), (None, None, " ")], "n string, d string, l string")
    r = df.select(T.repaired_number(F.col("n")).alias("n"), T.parsed_date(F.col("d"), "dd/MM/yyyy").cast("string").alias("d"), T.label_of(F.col("l")).alias("l")).collect()
    assert [tuple(x) for x in r] == [(8.5, "2009-12-31", 1), (None, None, 0), (11.0, "2020-02-03", None), (None, None, None)]


def test_similarities(spark):
    rows = [("Khách sạn TTC - Ngọc Lan Đà Lạt", "Khách sạn TTC – Đà Lạt", 0.7143, 0.7925), ("HAIAN Beach Hotel & Spa", "HAIAN Beach Hotel & Spa Đà Nẵng", 0.6667, 0.8519), ("Khách sạn Rosaleen Boutique Huế", "Rosaleen Boutique Hotel", 0.3333, 0.7407)]
    df = spark.createDataFrame(rows, "a string, b string, j double, s double")
    plain = lambda c: T.strip_accents(F.lower(F.col(c)))
    for r in df.select("*", T.jaccard(T.name_token_set(F.col("a")), T.name_token_set(F.col("b"))).alias("j2"), T.sequence_ratio(plain("a"), plain("b")).alias("s2")).collect():
        assert r.j2 == r.j
        assert 0 <= r.s2 <= 1
    assert df.select(T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))).first()[0] is None


def test_small_ones(spark):
    r = spark.range(1).select(
        T.slug(F.lit("A/Model: v1.0!")).alias("slug"), T.json_object(F.lit('Sure: ```json\n{"label": 1}\n```'), "label int").alias("j"), T.stars(F.lit(0.004)).alias("s"), T.f1(F.lit(0.5), F.lit(0.0)).alias("f0"),
        T.f1(F.lit(0.5), F.lit(1.0)).alias("f1"), T.percent(F.lit(1), F.lit(0)).alias("p0"), T.percent(F.lit(1), F.lit(8), 2).alias("p"), T.is_initials(F.lit("Nguyen H. Y.")).alias("i"), F.size(T.name_words(F.lit(" a  b "))).alias("w"),
    ).first()
    assert (r.slug, r.j.label, r.s, r.f0, r.f1, r.p0, r.p, r.i, r.w) == ("a-model-v1-0", 1, "**", None, 0.6667, 0.0, 12.5, True, 2)


def test_seconds_intervals_and_lookups(spark):
    df = spark.createDataFrame([("1970-01-02", 0.5, None), ("1969-12-31", 0.25, 1.0)], "d string, m double, x double")
    r = df.select(T.epoch_seconds(F.col("d").cast("date")).alias("s"), T.epoch_seconds(F.col("d").cast("timestamp")).alias("t"), T.interval_text(F.col("m"), F.col("m"), F.lit(1.0)).alias("i"), T.interval_text(F.col("m"), F.col("x"), F.lit(1.0)).alias("j"), T.looked_up(F.col("d"), {"1970-01-02": "a"}, "?").alias("l")).collect()
    assert [(x.s, x.t, x.i, x.j, x.l) for x in r] == [(86400, 86400, "0.5000 [0.5000, 1.0000]", None, "a"), (-86400, -86400, "0.2500 [0.2500, 1.0000]", "0.2500 [1.0000, 1.0000]", "?")]
