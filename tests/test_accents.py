"""Stripped marks against the Unicode tables."""

import random
import sys
import unicodedata

from pyspark.sql import functions as F

from tidemark.functions.accents import unaccented
from tidemark.operators import vectorize


def stripped(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def test_letters_of_all_scripts_lose_their_marks(spark):
    rng = random.Random(4)
    codes = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    texts = ["", "plain", "São Ñandú", "Ελλάδα ἄνθρωπος", "Ѐй ё", "한국어 값 각", "ﬁne ½ Ⅷ ™ ㎏", "éä", "İstanbul", "ｶﾞｷﾞ Ａ", "𝐀𝟗", "ạ̈ ệ", "]-[^ \\ '"]
    texts += ["".join(chr(c) for c in rng.sample(codes, 40)) for _ in range(300)]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", unaccented(F.col("t")).alias("x"))
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    for i, x in found.collect():
        assert x == stripped(texts[i])
    assert spark.createDataFrame([(None,)], "t string").select(vectorize.folded(F.col("t"))).first()[0] == ""


def test_words_beyond_latin(spark):
    row = spark.createDataFrame([("Ελλάδα Ελλαδα ЁЖ ёж",)], "t string").select(vectorize.word_ngrams(F.col("t")).alias("w")).first()["w"]
    assert row == ["ελλαδα", "ελλαδα", "еж", "еж", "ελλαδα ελλαδα", "ελλαδα еж", "еж еж"]
