from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()))
    return row.select(column).first()[0]


def test_scannos_are_whole_tokens(spark):
    assert one(spark, T.replace_scannos(F.col("t"), {"cnly": "only"}), t="The cnly arid land. Only one cnly, cnlyx.") == "The only arid land. Only one only, cnlyx."
    assert one(spark, T.replace_scannos(F.col("t"), {"a": "b"}), t=None) is None


def test_hyphens(spark):
    assert one(spark, T.join_hyphens(F.col("t"), ["to-"]), t="To-\nday and mid-\nway") == "Today and mid-\nway"
    found = one(spark, T.hyphen_candidates(F.col("t")), t="😀 über-\nmut, to-\nday")
    assert [(c["prefix"], c["suffix"], c["char_offset"]) for c in found] == [("über", "mut", 2), ("to", "day", "😀 über-\nmut, to-\nday".index("to-"))]
    again = one(spark, T.apply_joins(F.col("t"), F.array(F.lit(found[1]["candidate_id"]))), t="😀 über-\nmut, to-\nday")
    assert again == "😀 über-\nmut, today"


def test_typography(spark):
    assert one(spark, T.plain_dashes(T.straight_quotes(F.col("t"))), t="“a” ‘b’ — c") == "\"a\" 'b' -- c"


def test_numerals(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 4, 9, 14, 40, 1994, 27)], "n int").select("n", T.roman(F.col("n")), T.alphabetic(F.col("n"))).collect()
    assert [r[1] for r in rows] == ["0", "i", "iv", "ix", "xiv", "xl", "mcmxciv", "xxvii"]
    assert [r[2] for r in rows][:3] == ["0", "A", "D"]


def test_names(spark):
    assert one(spark, T.safe_slug(F.col("t"), F.lit("p")), t="../../evil") == "evil"
    assert one(spark, T.safe_slug(F.col("t"), F.lit("p")), t="???") == "p"
    assert one(spark, T.flat_stem(F.col("t")), t="vol1\\ch.2/page0001.jpg") == "vol1__ch.2__page0001"
    assert one(spark, T.file_stem(F.col("t")), t="a/b.c/page.tif") == "page"
    assert one(spark, T.name_errors(F.col("t"), F.lit(".PNG")), t="ad name too long") == ["basename_too_long", "invalid_chars", "uppercase_ext", "ad_substring"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abä-\n '.", max_size=30), min_size=1, max_size=8))
def test_rewriting_with_itself_changes_nothing(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(T.rewrite(F.col("t"), T.TOKEN, lambda m: m)).collect()] == texts
