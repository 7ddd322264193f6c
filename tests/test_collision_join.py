"""The join of similar names: all pairs, and how its work grows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cairnlake.functions import text
from cairnlake.operators import collision
from cairnlake.queries import graph


def names(n, dice, letters="abcdefghijklmnopqrstuvwxyz", sizes=(10, 24)):
    """Random names, every tenth with a variant of one letter."""
    out = ["".join(dice.choice(letters) for _ in range(dice.randint(*sizes))) for _ in range(n)]
    for k in range(0, n, 10):
        at = dice.randrange(len(out[k]))
        out[k + 1] = out[k][:at] + dice.choice(letters) + out[k][at + 1 :]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(s,) for s in rows], "s string").repartition(4)


def grams(s):
    return {s.lower()[i : i + 2] for i in range(len(s) - 1)}


def dice_of(a, b):
    x, y = grams(a), grams(b)
    return 1.0 if a == b else 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


@pytest.mark.parametrize("letters,sizes,least", [("abc", (1, 9), 0.5), ("abcdefghij", (2, 30), 0.3), ("abcdefghijklmnop", (4, 60), 0.8), ("abcdefghijklmnop", (4, 20), 1.0)])
def test_similar_strings_equal_all_pairs(spark, letters, sizes, least):
    dice = random.Random(len(letters))
    left, right = (names(120, dice, letters, sizes) + ["", "a", "Ab", "aB", "é\U0001f600é", None] for _ in "lr")
    right += left[:40]
    got = {(r.a, r.b): r.dice for r in collision.similar_strings(frame(spark, left), frame(spark, right), least).collect()}
    want = {(a, b): d for a in left for b in right if a is not None and b is not None and (d := dice_of(a, b)) >= least - 1e-12}
    assert got == pytest.approx(want)


def test_joined_rows_grow_with_the_names(spark):
    counts = {}
    for n in (1000, 4000):
        rows = frame(spark, names(n, random.Random(7)))
        counts[n] = collision.candidate_strings(rows, rows, 0.8).count()
    assert math.log(counts[4000] / counts[1000], 4) < 1.3, counts


def test_similar_words_equal_all_pairs(spark, tmp_path):
    dice = random.Random(9)
    words = names(60, dice, "abcdefgh", (8, 16))
    spark.createDataFrame([(i, " ".join(words[i : i + 7])) for i in range(54)] + [(99, None), (100, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.a, r.b) for r in graph.similar_words(spark, str(tmp_path)).collect()}
    long = sorted({w for w in words if len(w) >= 12})
    assert got == {(a, b) for a in long for b in long if a < b and dice_of(a, b) >= 0.8} and got


def test_candidates_are_names_without_and_paths_with_a_common_path(spark):
    """A pair below the name's bound is found by its path; one hot tag alone brings no pair into the join."""
    node = "id string, name string, sources array<struct<file_path:string,start_line:int,end_line:int>>, tags array<string>, aliases array<string>, map_pos int"
    rows = [("a", "completely different", [("f", 1, 9)], ["t"], [], 0), ("b", "completely diverging", [("f", 5, 12)], ["t"], [], 1), *[(f"n{i}", f"{i * 7919 % 10007} item", [], ["hot"], [], i + 2) for i in range(60)]]
    df = spark.createDataFrame(rows, node)
    found = {(r.id, r.candidate) for r in collision.find_collisions(df, df, threshold=0.65, top=99).collect()}
    assert ("a", "b") in found and ("b", "a") in found
    near = {(f"n{i}", f"n{j}") for i in range(60) for j in range(60) if i != j and 0.5 * dice_of(rows[i + 2][1], rows[j + 2][1]) + 0.25 >= 0.65}
    assert {p for p in found if p[0][0] == "n"} == near


def test_few_candidates_of_words_of_syllables_are_not_similar(spark):
    """Words made of the same syllables share combinations of bigrams without being similar."""
    dice = random.Random(5)
    syllables = ["heit", "keit", "ung", "ver", "ein", "lich", "sch", "der", "ber", "tion", "ment", "elle"]
    words = sorted({"".join(dice.choice(syllables) for _ in range(4)) for _ in range(700)})
    rows = frame(spark, words)
    found = collision.candidate_strings(rows, rows, 0.8, ordered=True).distinct().count()
    want = {(a, b): d for i, a in enumerate(words) for b in words[i + 1 :] if (d := dice_of(a, b)) >= 0.8 - 1e-12}
    got = collision.similar_strings(rows, rows, 0.8, ordered=True).collect()
    assert {(r.a, r.b): r.dice for r in got} == pytest.approx(want) and found < 2 * len(want), (found, len(want))


@pytest.mark.parametrize("ordered", [True, False])
@pytest.mark.parametrize("least", [0.3, 0.8])
def test_cut_groups_and_unranked_bigrams_equal_all_pairs(spark, monkeypatch, ordered, least):
    """Groups cut into blocks, bigrams without a rank, runs instead of one grid, long strings: each pair comes once, the same ones."""
    for name, value in {"BLOCK": 7, "RANKED": 3, "CELLS": 64, "AT_ONCE": 50}.items():
        monkeypatch.setattr(collision, name, value)
    dice = random.Random(11)
    rows = names(90, dice, "abcdefgh", (3, 18)) + ["\0\0", "\0\0a", "\0\0aA", "ab", "AB", "a", ""]
    long = ["".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(150)) for _ in range(4)]
    rows = sorted({*rows, *long, *[x[:70] + "q" + x[71:] for x in long]})
    right = rows if ordered else rows[::2] + ["other", "abcdefg"]
    left = frame(spark, rows)
    got = collision.similar_strings(left, left if ordered else frame(spark, right), least, ordered=ordered).collect()
    want = {(a, b): d for a in rows for b in right if (a < b or not ordered) and (d := dice_of(a, b)) >= least - 1e-12}
    assert {(r.a, r.b): r.dice for r in got} == pytest.approx(want) and len(got) == len(want)


def test_pairs_are_not_written(spark):
    """What the join writes follows the names, not the pairs."""
    from pathlib import Path

    from cairnlake.session import scratch_folder

    dice = random.Random(12)
    rows = sorted({"abcdefghijklmnop"[:at] + dice.choice("qrstuvwxyz") + dice.choice("qrstuvwxyz") + "abcdefghijklmnop"[at:] for at in range(17) for _ in range(25)})
    place = Path(scratch_folder(spark, "probe")).parent
    before = {p for p in place.rglob("*.parquet") if p.is_file()}
    df = frame(spark, rows)
    found = collision.similar_strings(df, df, 0.8, ordered=True).count()
    assert found == sum(dice_of(a, b) >= 0.8 - 1e-12 for i, a in enumerate(rows) for b in rows[i + 1 :]) and found > 50 * len(rows)
    assert sum(p.stat().st_size for p in place.rglob("*.parquet") if p.is_file() and p not in before) < 50_000


def test_long_tokens_are_those_of_all_tokens(spark):
    dice = random.Random(13)
    rows = ["".join(dice.choice("abcXYZ019_$ .\u0130\u212a\u00e9\U0001f600\n") for _ in range(dice.randint(0, 90))) for _ in range(300)]
    rows += [None, "", "abcdefghijkl", "abcdefghijk", "ABCDEFGHIJKL" * 2, "aB" * 20, "k\u212aabcdefghij", "abcdefghijk\u0130x"]
    df = spark.createDataFrame([(x,) for x in rows], "text string")
    for least in (2, 5, 12):
        want = df.select(F.explode(text.tokens("text")).alias("s")).where(F.length("s") >= least).distinct()
        got = [r.s for r in text.long_tokens(df, "text", least).collect()]
        assert sorted(got) == sorted(r.s for r in want.collect()) and got
