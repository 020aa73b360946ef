"""Cleaners on hand-made fields."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quipu.functions import clean

CASES = {
    "said": {"  a   b , c . ": "a b, c.", "n/a": None, " no  indica ": None, "0": None, "": None, None: None, "N/A x": "N/A x"}, "mail": {" A.B@X.com ": "a.b@x.com", "a b@x.com": "ab@x.com", "a@x": None, "S/I": None},
    "phone": {"(414) 123-4567": "0414-1234567", "0212 1234567": "0212-1234567", "0000-1234567": None, "04140000000": None, "123": None, "58414123456": None}, "web": {"WWW.X.com": "www.x.com", "a@x.com": None, "x com.": None, "nothing": None},
    "period": {"202612": "202612", "202613": None, "189901": None}, "iso_day": {"2026-02-27 10:00": dt.date(2026, 2, 27), "27/02/2026": None, "2026-02-30": None}, "long_day": {"Febrero 27, 2026, 12:00 a. m.": dt.date(2026, 2, 27), "foo 1, 2026": None, "febrero 30, 2026": None},
    "comparison_key": {"Región  Cápital, 2": "REGIONCAPITAL2"}, "search_words": {"Harina 1 KG 900g 128 GB x pan": "harina pan", "500": ""},
    "company": {"INVERSIONES  X C A": "Inversiones X C.A.", "la casa DE LOS panes s.r.l": "La Casa de los Panes S.R.L.", "ACME , S A": "Acme, S.A.", "el sol": "El Sol"},
}


@pytest.mark.parametrize("name", list(CASES))
def test_cleaner(spark, name):
    rows = spark.createDataFrame([(t,) for t in CASES[name]], "t string").select("t", getattr(clean, name)(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in rows} == CASES[name]


def test_money_and_images(spark):
    rows = spark.createDataFrame([("$184.930.383,23",), ("91.100",), ("x",), (None,)], "t string").select(clean.money(F.col("t")).cast("double").alias("v")).collect()
    assert [r.v for r in rows] == [184930383.23, 91100.0, None, None]
    base = "http://x.org/news/a.html?q=1"
    urls = {"/img/1.png": "https://x.org/img/1.png", "2.png": "https://x.org/news/2.png", "http://y.org/3.png?a=1&amp;b=2": "https://y.org/3.png?a=1&b=2", "//z.org/4.png": "https://z.org/4.png", "data:image/png;base64,x": None, "ftp://x/5": None, "": None, "https://x.org/" + "a" * 1000: None}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", clean.image_url(F.col("u"), F.lit(base)).alias("v")).collect()
    assert {r.u: r.v for r in rows} == urls
