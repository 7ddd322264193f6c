"""Fits whose inputs pass their documented bounds: very long labelled texts, rare classes, many languages."""

import random

import numpy as np
import pytest

from cairnlake.llm import language_id, toxicity


@pytest.fixture
def labelled(docs, spark):
    rows = [(i, "some plain words here" + (" gronkish" if i % 2 else "")) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    return rows, labels


@pytest.mark.parametrize("which", ["each", "first"])
def test_a_long_labelled_text_is_left_out_and_the_others_fit(docs, labelled, which):
    rows, labels = labelled
    key = toxicity.F.col("doc_id")
    first = labels.where(~toxicity.held_out(key) & toxicity.in_fit(key)).selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").limit(1).first().doc_id
    long = {first} if which == "first" else {4, 5}
    made = docs([(i, t + " filler" * 1_000_000 if i in long else t) for i, t in rows])
    model, thresholds = toxicity.train(made, labels, sample_chars=1500)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs(rows), model, thresholds).collect()}
    assert all((score > 0.5) == bool(i % 2) for i, score in got.items())


def test_a_class_whose_few_labels_are_all_left_to_the_thresholds_still_gives_a_model(docs, spark):
    ids = spark.range(400).select("id", toxicity.held_out(toxicity.F.col("id")).alias("h"), toxicity.in_fit(toxicity.F.col("id")).alias("f")).collect()
    rare = next(r.id for r in ids if not r.h and not r.f)
    labels = spark.createDataFrame([(r.id, int(r.id == rare)) for r in ids], "doc_id long, toxic int")
    assert toxicity.train(docs([(r.id, "gronkish" if r.id == rare else "plain") for r in ids]), labels)[0] is not None


def test_no_text_of_a_class_within_the_bound_is_an_error(docs, labelled):
    rows, labels = labelled
    with pytest.raises(ValueError, match="sample_chars"):
        toxicity.train(docs([(i, t if i % 2 else t + " filler" * 1000) for i, t in rows]), labels, sample_chars=1500)


def many_languages(n, dice):
    letters = "abcdefghijklmnopqrstuvwxyzàéñößü"
    return {f"l{k:03d}": ["".join(dice.choice(letters) for _ in range(dice.randint(3, 8))) for _ in range(25)] for k in range(n)}


def test_three_hundred_languages_in_a_table_of_bounded_size(docs, monkeypatch):
    monkeypatch.setattr(language_id, "ENTRIES", 300 * 2000)
    dice = random.Random(2)
    words = many_languages(300, dice)
    rows = [(i * 300 + k, " ".join(dice.choices(w, k=40)), lang) for i in range(3) for k, (lang, w) in enumerate(words.items())]
    model = language_id.train(docs(rows[:600]))
    assert len(model.langs) == 300 and 300 * 1990 <= model.logs.size <= 300 * 2001
    likely = np.exp(model.logs.astype(np.float64))
    assert (likely[:-1].sum(axis=0) < 1).all() and (likely[-1] > 0).all()  # mass is left for the places outside
    found = {r.doc_id: r.lang_pred for r in language_id.language_id(docs(rows[600:]), docs(rows[:600]), words_at_once=1000).collect()}
    assert sum(found[i] == lang for i, _, lang in rows[600:]) >= 0.98 * 300


def test_the_table_is_whole_for_few_languages_and_pruning_keeps_all_mass(docs, monkeypatch):
    dice = random.Random(4)
    rows = [(i, " ".join(dice.choices(w, k=60)), lang) for i, (lang, w) in enumerate(many_languages(4, dice).items())]
    whole = language_id.train(docs(rows))
    used = len(whole.logs) - 1
    assert np.allclose(np.exp(whole.logs.astype(np.float64)).sum(axis=0), 1, atol=1e-4)
    monkeypatch.setattr(language_id, "ENTRIES", 4 * (used // 2))
    cut = language_id.train(docs(rows))
    assert len(cut.logs) == used // 2 + 1
    mass = np.exp(cut.logs.astype(np.float64))
    spread = mass[:-1].sum(axis=0) + mass[-1] * (used - used // 2)
    assert (spread < 1).all() and (spread > 0.99).all()  # the rest is for places that no training row has


def test_more_languages_than_the_bound_are_an_error(docs, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGS", 3)
    with pytest.raises(ValueError, match="languages"):
        language_id.train(docs([(i, "abc", f"l{i}") for i in range(5)]))
