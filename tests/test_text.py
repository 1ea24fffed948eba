import pytest
from pyspark.sql import functions as F

from lodestone.functions import salvage, text
from lodestone.functions.arrow import code_similarity, indel_ratio, rouge_l_score, split_long


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_hash_id(spark):
    assert one(spark, text.hash_id(F.lit("hello world"), "doc-")) == "doc-5eb63bbbe01eeed093cb22bb8f5acdc3"


@pytest.mark.parametrize("s,expected", [("9", True), (".5", True), ("5.", False), ('"9"', False), ("1e3", False), ("-2.50", True)])
def test_is_float(spark, s, expected):
    assert one(spark, text.is_float(F.lit(s))) is expected


def test_split_markers(spark):
    assert one(spark, text.split_markers(F.lit("a##b||c## 12 ##"), ["##", "||"])) == ["a", "b", "c", "12"]
    assert one(spark, text.split_markers(F.lit("a"), [])) == ["a"]


def test_strip_in_a_lambda_takes_no_index(spark):
    assert one(spark, text.split_markers(F.lit("x0##y1##z2"), ["##"])) == ["x0", "y1", "z2"]


def test_normalize(spark):
    assert one(spark, text.normalize_answer(F.lit("The quick, brown-fox's!"))) == "quick brownfoxs"
    assert one(spark, text.normalize_zh(F.lit("你好, 世界。 A!"))) == "你好世界a"


@pytest.mark.parametrize("p,g,f1", [("The answer is 42", "42", 0.5), ("the the cat cat", "cat cat dog", 0.8), ("The", "the", 0.0), ("", "a b", 0.0)])
def test_qa_f1(spark, p, g, f1):
    assert one(spark, text.qa_f1(F.lit(p), F.lit(g))) == pytest.approx(f1)
    assert one(spark, text.qa_f1(F.lit(g), F.lit(p))) == pytest.approx(f1)


def test_jaccard(spark):
    assert one(spark, text.jaccard(F.lit("apple inc"), F.lit("APPLE INC. CORP"))) == 0.25
    assert one(spark, text.jaccard(F.lit("apple inc"), F.lit("apple corp inc"))) == pytest.approx(2 / 3)
    assert one(spark, text.jaccard(F.lit(""), F.lit("a"))) == 0.0


def test_quotes(spark):
    assert one(spark, text.unquote_once(F.lit(' ""a"" '))) == '"a"'
    assert one(spark, text.unquote_once(F.lit('"'))) == '"'
    assert one(spark, text.match_key(F.lit(' ""straße"" '))) == "STRASSE"


def test_clean(spark):
    assert one(spark, text.clean_control(F.lit(" a&amp;b\x00\x85 &lt;c&gt; "))) == "a&b <c>"
    assert one(spark, text.clean_content(F.lit("a\nb ---- c ★ d-e"))) == "a b c d-e"


def test_salvage(spark):
    assert one(spark, salvage.json_strings(F.lit('so: ["a", 3, " b "] end'))) == ["A", "B"]
    assert one(spark, salvage.json_strings(F.lit("] nothing ["))) == []
    assert one(spark, salvage.json_strings(F.lit("[broken"))) == []
    fenced = '```json\n{"confusing_questions": ["x", "y", "z"]}\n```'
    assert one(spark, salvage.confusing_questions(F.lit(fenced), 2)) == ["x", "y"]
    assert one(spark, salvage.confusing_questions(F.lit("{oops"), 2)) == []
    v = one(spark, text.verdict(F.lit('x {"Winner":\n "Answer 1"} y'), "Winner string"))
    assert v.Winner == "Answer 1"


def test_lines(spark):
    assert one(spark, text.first_line(F.lit("\n\nab\ncd"))) == "ab"
    assert one(spark, text.first_code_line(F.lit("# no\n`x`\nx = 1\ny"))) == "x = 1"
    assert one(spark, text.first_code_line(F.lit("# no"))) == ""
    assert one(spark, text.truncate_words(F.lit(" a  b c"), 2)) == "a b"


def test_shares(spark):
    assert one(spark, text.hit_share(F.lit("Paragraph 3 or 4 or 3"), F.lit(3))) == pytest.approx(2 / 3)
    assert one(spark, text.hit_share(F.lit("none"), F.lit(3))) == 0.0
    classes = F.array(*[F.lit(x) for x in ("new york", "york", "paris")])
    assert one(spark, text.classification(F.lit("new york or paris"), F.lit("new york"), classes)) == 0.5
    assert one(spark, text.classification(F.lit("paris"), F.lit("new york"), classes)) == 0.0


def test_token_counts(spark):
    assert one(spark, text.token_count(F.lit("a b c d"))) == 5
    assert one(spark, text.message_tokens(F.array(F.lit("a b c"), F.lit("")))) == 4 + 4 + 4 + 2


def test_sequences(spark):
    assert rouge_l_score("the cat sat", "the cat ran") == pytest.approx(2 / 3)
    assert rouge_l_score("", "x") == 0.0
    assert indel_ratio("kitten", "sitting") == 0.62
    assert one(spark, code_similarity(F.lit("abc"), F.lit("abc"))) == 1.0


def test_split_long():
    text_ = "\n\n".join(" ".join(["w"] * n) for n in (200, 100, 10))
    parts = split_long(text_, 256, 30)
    assert "".join(parts) == text_
    assert [len(p.split()) for p in parts] == [200, 110]
    assert split_long("one " * 300, 256) == ["one " * 300]


def test_clean_html_decodes_complete_references_only(spark):
    from lodestone.functions.arrow import clean_html

    html = "\t a &amp; b &lt;&#65;&#x42;&euml; &amp;quot; ?x=1&copy=2 &nosuch; cut &amp"
    assert one(spark, clean_html(F.col("h")), h=html) == "a & b <ABë &quot; ?x=1&copy=2 &nosuch; cut &amp"
    assert one(spark, clean_html(F.col("h"), ("amp", "quot")), h=html) == "a & b &lt;&#65;&#x42;&euml; &quot; ?x=1&copy=2 &nosuch; cut &amp"
    assert one(spark, clean_html(F.col("h")), h="\u00a0kept\u0085\u00a0 \n") == "\u00a0kept\u00a0"
