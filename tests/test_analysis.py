import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import analysis
from tessera.operators import text
from tessera.operators.stem import stem, stem_word

# Vectors traced by hand through the step table.
STEMS = {
    "эпической": "эпическ", "года": "год", "стоило": "ст", "своих": "св", "разглядеть": "разгляд", "воинов": "воин", "кидаться": "кид",
    "драться": "др", "фракцию": "фракц", "гусей": "гус", "включая": "включ", "можете": "может", "встречаются": "встреч", "нет": "нет",
    "птср": "птср", "те": "те", "ейш": "", "nasa": "nasa", "x5": "x5",
}
EDGES = [(1, ""), (2, "!?., …"), (3, "a-b"), (4, "x5 3 z"), (5, "NASA Ёлка"), (6, "tab\tnew\nline"), (7, "réseau"), (8, None), (9, "foo,bar «баз»")]


def docs(spark, rows=EDGES):
    return spark.createDataFrame(rows, "doc_id long, text string")


def column(spark, expression, rows=EDGES):
    return {r[0]: r[1] for r in docs(spark, rows).select("doc_id", expression).collect()}


def test_tokens(spark):
    got = column(spark, analysis.tokens(F.col("text")))
    assert got == {1: [], 2: [], 3: ["a", "b"], 4: ["x5", "3", "z"], 5: ["nasa", "елка"], 6: ["tab", "new", "line"], 7: ["r", "seau"], 8: None, 9: ["foo", "bar", "баз"]}


def test_tokenise_alone_keeps_case(spark):
    got = column(spark, analysis.tokenize(F.col("text")))
    assert got[3] == ["a", "b"] and got[5] == ["NASA", "Ёлка"] and got[7] == ["réseau"]


def test_normalise_keeps_hyphens(spark):
    got = column(spark, analysis.normalize(F.col("text")))
    assert got[3] == "a-b" and got[5] == "nasa елка" and got[2] == "" and got[9] == "foo bar баз"


def test_single_letters(spark):
    got = column(spark, analysis.without_single_letters(analysis.tokens(F.col("text"))))
    assert got[4] == ["x5", "3"] and got[3] == [] and got[7] == ["seau"]


def test_stopwords(spark):
    assert len(analysis.STOPWORDS) == len(set(analysis.STOPWORDS)) == 149
    got = column(spark, analysis.without_stopwords(analysis.tokens(F.col("text"))), [(1, "Ещё нет, и я не тут")])
    assert got[1] == ["нет"]


def test_stem_vectors(spark):
    assert {w: stem_word(w) for w in STEMS} == STEMS
    rows = spark.createDataFrame([(w,) for w in STEMS], "word string").select("word", stem(F.col("word")))
    assert dict(map(tuple, rows.collect())) == STEMS


def test_stem_column_equals_python(spark):
    import random

    rng = random.Random(3)
    ends = "ивши ывши вши в ее ими ого ему ающий ющ нн ся сь ейте ила ешь нно иями ями ией ейш ейше ь ы ость".split()
    words = ["".join(rng.choice("абвгдеиклмнопрстуышщьэюя") for _ in range(rng.randint(1, 6))) + "".join(rng.choice(ends) for _ in range(rng.randint(0, 3))) for _ in range(1500)]
    rows = spark.createDataFrame([(w,) for w in words], "word string").select("word", stem(F.col("word"))).collect()
    assert all(stem_word(w) == s for w, s in rows)


def test_full_pipeline(spark):
    rows = [(1, "Ещё вчера игроки драться не хотели"), (2, "x5 z 3 the AND"), (3, ""), (4, None), (5, "ейш")]
    got = {r["doc_id"]: r["tokens"] for r in text.analyze(docs(spark, rows), "doc_id", "text").collect()}
    assert got[1] == [stem_word(w) for w in "вчера игроки драться хотели".split()]
    assert got[2] == ["x5", "3", "the", "and"] and got[3] == [] and got[5] == []


def test_stemming_moves_no_rows(spark):
    df = docs(spark, [(1, "кидаться года года"), (1, "plain"), (2, None)])
    out = text.analyze(df, "doc_id", "text")
    assert sorted((r["doc_id"], r["tokens"] or []) for r in out.collect()) == [(1, ["plain"]), (1, ["кид", "год", "год"]), (2, [])]
    assert "Exchange" not in out._jdf.queryExecution().toString()


def test_statistics_and_zipf(spark):
    d = docs(spark, [(1, "a a b"), (2, "b c a"), (3, "")])
    assert [tuple(r) for r in text.corpus_token_statistics(d, "doc_id", "text").collect()] == [(3, 6, 6, 10, 1.0)]
    assert [tuple(r) for r in text.zipf_table(text.term_frequency(d, "text")).orderBy("rank").collect()] == [(1, 3, 3.0), (2, 2, 1.5), (3, 1, 1.0)]
    assert [tuple(r) for r in text.zipf_summary(d, "text").collect()] == [(6, 3, 3, 3)]
    empty = docs(spark, [])
    assert text.zipf_table(text.term_frequency(empty, "text")).count() == 0
    assert text.corpus_token_statistics(empty, "doc_id", "text").first()["mean_token_length"] == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="abЯё1 -.,\n", max_size=20), min_size=1, max_size=8))
def test_tokens_equal_findall(spark, texts):
    got = column(spark, analysis.tokens(F.col("text")), list(enumerate(texts)))
    fold = str.maketrans(analysis.UPPER, analysis.LOWER)
    assert got == {i: re.findall("[а-яa-z0-9]+", t.translate(fold)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("most,n", [(1000, 1000), (None, 1200)])
def test_term_cap(spark, most, n):
    words = " ".join(f"w{i}" for i in range(1200)) + " w0 w1"
    got = column(spark, analysis.index_terms(analysis.tokens(F.col("text")), most), [(1, words)])[1]
    assert len(got) == n and got[0] == "w0"
