import difflib
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.functions import text as t


def run(spark, column, *values):
    df = spark.createDataFrame([(i, *((v,) if not isinstance(v, tuple) else v)) for i, v in enumerate(values)], "i int, x string, y string" if isinstance(values[0], tuple) else "i int, x string")
    return [r[0] for r in df.select("i", column.alias("o")).orderBy("i").select("o").collect()]


def test_clean_text_versions(spark):
    x = "  a\r\tb\n\n\n\n\nc ﬁ  "
    assert run(spark, t.clean_text(F.col("x")), x, None, "") == ["a\tb\n\n\nc fi", "", ""]
    assert run(spark, t.clean_text(F.col("x"), "v0.6"), x) == ["a b\n\nc fi"]
    assert run(spark, t.one_line(F.col("x")), " a \n\t b c ") == ["a b c"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="aé漢🙂 b", max_size=30), min_size=1, max_size=20), st.integers(1, 40))
def test_utf8_prefix_keeps_whole_characters(spark, texts, n):
    want = [s.encode()[:n].decode("utf-8", "ignore") for s in texts]
    assert run(spark, t.utf8_prefix(F.col("x"), n), *texts) == want


def test_copy_similarity_is_the_block_ratio(spark):
    pairs = [("the old mill", "the new mill"), ("", "x"), ("abc", "abc")]
    want = [difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs]
    assert run(spark, t.copy_similarity("x", "y"), *pairs) == want


def test_shingles_and_overlap(spark):
    w = "a b c d e f g h i j"
    assert run(spark, F.size(t.shingles(F.col("x"), 9)), w, "a b", "", "a a a a a a a a a a a") == [2, 0, 0, 1]
    assert run(spark, t.has_verbatim_overlap(F.col("x"), F.col("y")), (w, "x " + w), (w, "a b c d e f g h x i j"), (None, w)) == [True, False, False]


def test_ratios_and_natural_text(spark):
    assert run(spark, t.letter_ratio(F.col("x")), "ab! ", "", "12") == [2 / 3, 0.0, 1.0]
    assert run(spark, t.punctuation_ratio(F.col("x")), "ab! ", "") == [1 - 2 / 3, 1.0]
    good = "Genç öğretmen her sabah eski haritaları dikkatle inceler."
    assert run(spark, t.natural_text(F.col("x")), good, "a " * 40, None, good + "\x01", good + "\rx", "ab cd ef 12 _x", "evet " * 12) == [True, False, False, False, False, False, False]


def test_small_helpers(spark):
    assert run(spark, t.strip_wrapped(F.col("x"), "<a>", "</a>"), "<a> x </a>", "<a> x", "<a></a>") == ["x", "<a> x", ""]
    assert run(spark, t.turkish_ablative(F.col("x")), "Ankara", "İzmir", "sokak", "ev", "3", "9", "kş") == ["Ankara'dan", "İzmir'den", "sokak'dan", "ev'den", "3'ten", "9'dan", "kş'den"]
    assert run(spark, t.symbol(F.col("x")), " kırmızı elma?", "3 kedi", "?!") == ["kırmızı_elma", "N_3_kedi", None]
    assert run(spark, t.casefold(F.col("x")), "STRASSE ß", None) == ["strasse ss", None]
    assert run(spark, t.nfkc(F.col("x")), "ﬁ½") == [unicodedata.normalize("NFKC", "ﬁ½")]
    assert run(spark, t.compact_json(("b", F.col("x")), ("a", F.lit(1))), None) == ['{"a":1,"b":null}']
    assert run(spark, t.alpaca_prompt(F.col("x"), F.lit(" bağ "), F.lit("yanıt")), "Sor", "") == ["Sor\n\nBağlam:\nbağ", None]
    assert run(spark, t.alpaca_prompt(F.col("x"), F.lit(None).cast("string"), F.lit(" ")), "Sor") == [None]
    assert run(spark, t.is_turkish(F.col("x")), "Nedir bu", "plain", "ISI", "Öz", None) == [True, False, False, True, None]
