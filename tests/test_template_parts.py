"""Template identities of a text and its outer lines come from one pass of the patterns."""

from pyspark.sql import functions as F

from chronowarn.functions import textkeys
from chronowarn.plans import q_text

PLAIN_NUMERALS = r"[零〇一二两三四五六七八九十百千万]+(?=小时|分钟|点|毫升|毫克|次|人|杯|口|千卡)"


def test_parts_equal_identities_of_the_lines(spark):
    texts = [None, "", "\n", "a\n", "\nb", "One 3.5\n4.5:6 two", "3\n.4", "12.\n3:4", "睡三\n小时", "睡三千卡，二十一\r\n六点 7点30", "ΟΔΟΣ\nΣΑΣ Σ\nΣ",
             "İstanbul\nẞ_#9", "x\r\ny\rz", "٣٤ ½\n\n Ⅷ", "tab\tq r\u0085s\n end", "single line, 1 234"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    lines = F.split("text", "\n")
    want = df.select("doc_id", *[textkeys.template_identity(c).alias(n) for n, c in (("whole", F.col("text")), ("head", F.get(lines, F.lit(0))), ("tail", F.element_at(lines, -1)))])
    got = textkeys.template_parts(df, "text")
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(map(tuple, want.collect()), key=lambda r: r[0])


def test_numerals_are_the_same_characters(spark):
    code = spark.createDataFrame([(chr(i),) for i in (*range(0x20, 0x80), *range(0x2F00, 0xA000), 0x20000)], "c string")
    text = F.concat("c", F.lit("三"), "c", F.lit("小时"))
    assert code.where(F.regexp_replace(text, textkeys.NUMERAL_SLOT, "#") != F.regexp_replace(text, F.lit(PLAIN_NUMERALS), F.lit("#"))).isEmpty()
    assert code.where(text.rlike(textkeys.NUMERAL_SLOT + "小时$") & (F.regexp_replace(text, textkeys.NUMERAL_SLOT, "") == F.lit("小时"))).count() == 16


def test_family_keys_run_each_pattern_once(spark):
    plan = q_text._family_keys(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 3      # 9 before: each part ran all patterns of its own
