from pyspark.sql import functions as F

from tessera.functions import text


def _one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("o")).first().o


def test_truncate(spark):
    cut = lambda v, n: tuple(_one(spark, v, lambda c: text.truncate_markdown(c, n)))
    assert cut("h\U0001f44b", 2) == ("h", True, 2)
    assert cut("aaaaaa\n\nbbb", 9) == ("aaaaaa", True, 5)
    assert cut("a\n\n" + "b" * 20, 9) == ("a\n\n" + "b" * 6, True, 14)
    assert cut("abc", 3) == ("abc", False, 0)
    assert cut("x  ", 0) == ("", True, 3)
    assert cut("abc", -5) == ("", True, 3)
    assert cut("", 0) == ("", False, 0)
    assert _one(spark, None, lambda c: text.truncate_markdown(c, 3)) is None


def test_strip_tags(spark):
    cases = {"<b>x</b> a < b Vec<T>": "x a < b Vec<T>", '<span class="a>b">hi</span> <sp': "hi", "<SPAN>u</SPAN>": "u", "spanish <spanish>": "spanish <spanish>", "3 < 5 and 7 > 2": "3 < 5 and 7 > 2", "": "", "a</": "a</"}
    for given, wanted in cases.items():
        assert _one(spark, given, text.strip_tags) == wanted


def test_cleaning(spark):
    nbsp, icon = chr(0xA0), chr(0xE001)
    assert _one(spark, f"a{nbsp}{nbsp}b {nbsp}c{icon}", text.clean_text) == "a b c"
    assert _one(spark, f" a \t{nbsp}b ", text.collapse_spaces) == " a b "
    assert _one(spark, "x" + chr(0xAD) + chr(0x200D) + "y", text.strip_invisible) == "x" + chr(0x200D) + "y"


def test_plain_text_length(spark):
    assert _one(spark, "# A\n\n- b [c](d) ![e](f) `g`\n```py\nh\n```\n\\*", text.plain_text) == "A b c g h"
    assert _one(spark, "a\n\n\n\nb  \nc\n", text.cleanup_markdown) == "a\n\nb\nc"


def test_redaction(spark):
    row = spark.sql("select '  [0-25] text: secret25 sec 25\n[1-2] x' t, map('pw', array('secret25', '25', 'sec')) m")
    assert row.select(text.redact_outline(F.col("t"), F.col("m")).alias("o")).first().o == "  [0-25] text: %pw% %pw% 25\n[1-2] x"
    assert row.select(text.redact(F.col("t"), F.lit(None).cast("map<string,array<string>>")).alias("o")).first().o.startswith("  [0-25] text: secret25")


def test_substitution_is_one_pass(spark):
    row = spark.sql("select '%a% %zz% %b%' t, map('a', '%b%', 'b', '2') m")
    assert row.select(text.substitute_variables(F.col("t"), F.col("m")).alias("o")).first().o == "%b% %zz% 2"
