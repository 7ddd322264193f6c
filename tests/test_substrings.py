"""The substring join against a look at every pair."""

import random

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import deps, substrings


@pytest.mark.parametrize("few,hot", [(200_000, 100_000), (0, 3)])
def test_containing_equals_all_pairs(spark, monkeypatch, few, hot):
    monkeypatch.setattr(substrings, "FEW", few)
    monkeypatch.setattr(substrings, "HOT", hot)
    dice = random.Random(8)
    piece = lambda n: "".join(dice.choice("abAB é\U0001f600\n") for _ in range(n))
    texts = [(i, piece(dice.randint(0, 40))) for i in range(120)] + [(7, "same key abab"), (7, "same key abab"), (None, "null key ABBA"), (500, None), (501, ""), (502, "x" * 5000 + "abba")]
    values = [piece(dice.randint(1, 7)) for _ in range(60)] + ["", None, "a", "AB", "ab", "Abba", "Abba", "zzzz", "x" * 4999]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    found = substrings.containing(spark.createDataFrame([(v,) for v in values], "value string"), df, text=F.col("text"), key="id")
    want = [(i, t, v) for i, t in texts for v in {v for v in values if v is not None} if t is not None and v.lower() in t.lower()]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_without_values_or_texts(spark):
    texts = spark.createDataFrame([(1, "The RED ring"), (2, None)], "id int, name string")
    names = spark.createDataFrame([("Red",), (None,)], "name string")
    assert [tuple(r) for r in deps.symbol_mentions(names, texts, id_col="id", text=F.col("name")).collect()] == [("Red", 1)]
    assert deps.symbol_mentions(names.limit(0), texts, id_col="id", text=F.col("name")).count() == 0
    assert deps.symbol_mentions(names, texts.limit(0), id_col="id", text=F.col("name")).count() == 0


def test_texts_leave_no_pieces_behind(spark, tmp_path):
    """What is written while texts are searched follows the values, not the texts' pieces."""
    from pathlib import Path

    from cairnlake.session import scratch_folder

    dice = random.Random(3)
    docs = [(i, "".join(dice.choice("abcdefghijklmnop ") for _ in range(4000))) for i in range(60)]
    values = spark.createDataFrame([(t[k : k + 9],) for _, t in docs for k in range(0, 3900, 300)], "value string")
    place = Path(scratch_folder(spark, "probe")).parent
    before = {p for p in place.rglob("*.parquet") if p.is_file()}
    df = spark.createDataFrame(docs, "id long, text string").repartition(3)
    got = sorted(map(tuple, substrings.containing(values, df, text=F.col("text"), key="id", keep=["id"]).collect()))
    assert got == sorted((i, v) for i, t in docs for v in {r.value for r in values.collect()} if v in t)
    assert sum(p.stat().st_size for p in place.rglob("*.parquet") if p.is_file() and p not in before) < 300_000


def test_words_are_looked_into_once():
    """What a text costs doesn't follow the values that its pieces call into question: a word met before is known."""
    dice = random.Random(4)
    syllables = ["tion", "heit", "keit", "ung", "ein", "re", "th", "au"]
    word = lambda most: "".join(dice.choice(syllables) for _ in range(dice.randint(2, most)))
    values = sorted({word(5) for _ in range(800)} | {"a$_1", "stra\xdfe", "e"})
    words = [word(7) for _ in range(300)]
    find = substrings._in_words(list(enumerate(values)))
    look = find.__closure__[[*find.__code__.co_freevars].index("look")].cell_contents
    looked = []
    find.__closure__[[*find.__code__.co_freevars].index("look")].cell_contents = lambda w: looked.append(w) or look(w)
    for _ in range(40):
        low = " ".join(dice.choice(words) + dice.choice(["", ",", ".a$_1", "\nstra\xdfe"]) for _ in range(200))
        assert find(low) == {i for i, v in enumerate(values) if v in low}
    assert len(looked) == len(set(looked)) <= len(words) + 2


def test_values_of_signs_capitals_and_any_length(spark):
    """Values of word characters, with other signs and beyond the bound for words meet the same texts as a look at every pair."""
    dice = random.Random(6)
    piece = lambda n: "".join(dice.choice("abAB1_$ .\u00c9\u0130\U0001f600") for _ in range(n))
    values = {piece(dice.randint(1, 6)) for _ in range(80)} | {"ab" * 16, "ab" * 17, "AB\n", "ab"}
    texts = [piece(dice.randint(0, 60)) for _ in range(60)] + ["ab" * 40, "Ab\n", "x" + "ab" * 16]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    of_text = {r.id: r.l for r in df.select("id", F.lower("text").alias("l")).collect()}
    asked = spark.createDataFrame([(v,) for v in values], "value string")
    of_value = {r.value: r.l for r in asked.select("value", F.lower("value").alias("l")).collect()}
    got = sorted((r.id, r.value) for r in substrings.containing(asked, df, text=F.col("text"), key="id", keep=["id"]).collect())
    assert got == sorted((i, v) for i, t in of_text.items() for v, l in of_value.items() if l in t)
