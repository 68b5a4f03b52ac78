"""Literal cases of the text, vector and measure rules."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lingospan.functions import measures, text as tx, vectors as vx


def one(spark, column, **values):
    """Value of ``column`` on a row with the given fields."""
    schema = ", ".join(f"{k} {v[1]}" for k, v in values.items())
    row = tuple(v[0] for v in values.values())
    return spark.createDataFrame([row], schema).select(column.alias("out")).first()["out"]


def test_sentences(spark):
    raw = "<p>甲；乙！</p>丙 1"
    assert one(spark, tx.segment_sentences(F.col("t"), keep_digits=False), t=(raw, "string")) == ["甲", "乙", "丙"]
    assert one(spark, tx.segment_sentences(F.col("t")), t=(raw, "string")) == ["甲", "乙", "丙1"]


def test_sentence_breaks(spark):
    split = tx.segment_sentences(F.col("t"))
    assert one(spark, split, t=("a\n\nb\nc", "string")) == ["a", "b，c"]
    dots = tx.segment_sentences(F.col("t"), period_regex=r"\.")
    assert one(spark, dots, t=("一.二。三？四;五", "string")) == ["一", "二", "三", "四", "五"]
    assert one(spark, split, t=("「甲」《乙》-[丙]^{丁}\\　戊", "string")) == ["甲乙丙^丁\\戊"]


def test_sentence_script(spark):
    split = tx.segment_sentences(F.col("t"), script_map=("審國", "审国"))
    assert one(spark, split, t=("審查。國家", "string")) == ["审查", "国家"]


def test_html_stays_on_one_line(spark):
    assert one(spark, tx.strip_html(F.col("t")), t=("a<b>c</b><d\n>e", "string")) == "ac<d\n>e"


def test_placeholder(spark):
    column = tx.empty_sentence_placeholder(F.col("t"))
    assert one(spark, column, t=([], "array<string>")) == ["there_is_no_word"]
    assert one(spark, column, t=(["a"], "array<string>")) == ["a"]


TOKEN = "array<struct<text:string,lemma:string,upos:string,shape:string,is_alpha:boolean,is_stop:boolean>>"


def test_token_rules(spark):
    tokens = [
        ("Cats", "cat", "NOUN", "Xxxx", True, False),
        ("the", "the", "NOUN", "xxx", True, True),
        ("x1", "x1", "NOUN", "xd", False, False),
        ("New_York", "new_york", "X", "Xx_x", False, True),
        ("ran", "run", "VERB", "xxx", True, False),
        ("red", "red", "ADJ", "xxx", True, False),
    ]
    narrow = tx.project_tokens(F.col("t"), accept_pos=["NOUN", "VERB"], use_entity=False)
    assert one(spark, narrow, t=(tokens, TOKEN)) == ["cat", "run"]
    wide = tx.project_tokens(F.col("t"))
    assert one(spark, wide, t=(tokens, TOKEN)) == ["cat", "new_york", "run", "red"]
    texts = tx.project_tokens(F.col("t"), want_lemma=False, want_stop=True, want_alpha=False)
    assert one(spark, texts, t=(tokens, TOKEN)) == ["Cats", "the", "x1", "New_York", "ran", "red"]


def test_tagged_words(spark):
    words = ["政府#NN", "的#DEG", "说#VV", "GDP#NN", "银行#NN", "甲#乙#NN"]
    assert one(spark, tx.pos_filter_tagged(F.col("t")), t=(words, "array<string>")) == ["政府", "银行", "甲#乙"]
    japanese = tx.pos_filter_tagged(F.col("t"), ("#名詞", "#動詞"))
    assert one(spark, japanese, t=(["会社#名詞", "は#助詞", "行く#動詞"], "array<string>")) == ["会社", "行く"]


def test_tagger_line(spark):
    word, tag = tx.parse_tagger_line(F.col("t"))
    line = ("会社\t名詞,一般,*,会社", "string")
    assert one(spark, word, t=line) == "会社" and one(spark, tag, t=line) == "会社#名詞"
    assert one(spark, word, t=("EOS", "string")) is None and one(spark, tag, t=("EOS", "string")) is None


@pytest.mark.parametrize(
    "word, script, binary",
    [("oil", "en", "source"), ("石油", "cn", "target"), ("café", None, "target"), ("カタ", None, "target"), ("x石", "cn", "target")],
)
def test_scripts(spark, word, script, binary):
    assert one(spark, tx.word_script(F.col("w")), w=(word, "string")) == script
    assert one(spark, tx.word_script_binary(F.col("w")), w=(word, "string")) == binary


def test_vectorizer_tokens(spark):
    got = one(spark, tx.count_vectorizer_tokens(F.col("t")), t=("A Été_1 x, 石油 b2", "string"))
    assert got == ["été_1", "石油", "b2"]


def test_norms(spark):
    assert one(spark, vx.l2_normalise(F.col("v")), v=([3.0, 4.0], "array<float>")) == pytest.approx([0.6, 0.8])
    assert one(spark, vx.l2_normalise(F.col("v")), v=([0.0, 0.0], "array<float>")) == [0.0, 0.0]
    assert one(spark, vx.l1_normalise(F.col("v")), v=([1.0, -3.0], "array<double>")) == [0.25, -0.75]
    assert one(spark, vx.l1_normalise(F.col("v")), v=([0.0], "array<double>")) == [0.0]


def test_divergence(spark):
    jsd = measures.jensen_shannon(F.col("p"), F.col("q"))
    same = ([1.0, 3.0], "array<double>")
    assert one(spark, jsd, p=same, q=([0.25, 0.75], "array<double>")) == pytest.approx(0)
    assert one(spark, jsd, p=([1.0, 0.0], "array<double>"), q=([0.0, 1.0], "array<double>")) == pytest.approx(1)


def test_npmi_epsilon(spark):
    values = dict(n=(0, "int"), a=(2, "int"), b=(5, "int"), d=(10, "int"))
    args = [F.col(c) for c in ("n", "a", "b", "d")]
    eps = 1e-12
    inside = math.log(eps / (0.2 * 0.5)) / -math.log(eps)
    assert one(spark, measures.npmi(*args), **values) == pytest.approx(inside)
    count = eps / 10
    assert one(spark, measures.npmi_reference(*args), **values) == pytest.approx(math.log(count / 0.1) / -math.log(count))
