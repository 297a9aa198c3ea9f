import datetime as dt

from pyspark.sql import functions as F

from cohortlens.functions.text import clean_text, sentence_split, word_count, word_count_clean
from cohortlens.functions.timex import floor_days


def test_floor_days_pandas_semantics(spark):
    rows = [(dt.datetime(2024, 1, 2, 1), dt.datetime(2024, 1, 1, 23)),   # +2 h over midnight
            (dt.datetime(2024, 1, 1, 22), dt.datetime(2024, 1, 2, 0)),   # -2 h
            (dt.datetime(2024, 1, 2, 5), dt.datetime(2024, 1, 1, 5))]    # exactly 24 h
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(floor_days("a", "b")).collect()] == [0, -1, 1]


def test_word_counts(spark):
    df = spark.createDataFrame([("",), (None,), ("a -- b () c",), ("a  b",)], "x string")
    clean = [r[0] for r in df.select(word_count_clean("x")).collect()]
    assert clean == [0, None, 4, 2]
    plain = [r[0] for r in df.select(word_count("x")).collect()]
    assert plain == [1, None, 5, 3]


def test_clean_text_chain(spark):
    rows = [("Seen at General Hospital AND clinics today",), ("xdr. smith, m.d. #1 ¿ok",),
            ("see http://a b and www.q c",)]
    df = spark.createDataFrame(rows, "x string")
    out = [r[0] for r in df.select(clean_text("x", ["general hospital and clinics"])).collect()]
    assert out == ["Seen at  today", "xdoctor smith, md 1 ok", "see  b and  c"]


def test_sentence_split(spark):
    df = spark.createDataFrame([("\tFirst one. x. Second   Third\nFourth. ",)], "x string")
    got = df.select(sentence_split("x")).collect()[0][0]
    # '. ' splits, 1-char sentence dropped, 3 blanks split, tabs stripped
    assert got == ["First one", "Second", "Third", "Fourth"]   # ". " at the end is a separator too
