import random

import numpy as np

from cairnlake.llm import jaccard_join
from cairnlake.llm.shingles import least_apart, parity_sketch


def test_sketches_never_tell_sets_further_apart_than_they_are():
    rng = np.random.default_rng(1)
    for n, gone, more in ((0, 0, 1), (1, 0, 0), (60, 5, 30), (500, 25, 20), (500, 500, 480), (3000, 2000, 0)):
        pool = np.unique(rng.integers(0, 2**64, 2 * n + more, np.uint64, endpoint=False))
        x, y = np.sort(pool[:n]), np.sort(np.concatenate([pool[gone:n], pool[n : n + more]]))
        apart = len(np.setxor1d(x, y))
        found = least_apart(parity_sketch(x), parity_sketch(y))
        assert found == least_apart(parity_sketch(y), parity_sketch(x)) and found <= apart and (apart - found) % 2 == 0
        assert 8 * apart > n or found >= 0.8 * apart


def test_texts_of_candidates_that_cannot_link_stay_where_they_are(docs, monkeypatch):
    """Near copies a little below the threshold share enough of their prefixes; few of their texts are shuffled."""
    rng = random.Random(4)
    rows = []
    for f in range(60):
        base = [f"f{f}w{i}" for i in range(400)]
        for _ in range(3):
            text = list(base)
            for at in rng.sample(range(400), 9):  # 0.88 or less for two of them
                text[at] = f"u{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(text)))
        rows.append((len(rows), " ".join(base[:-4] + ["x"])))
    rows.append((len(rows), rows[0][1] + " y"))
    met, looked = [], []
    real, other = jaccard_join.candidates, jaccard_join.wanted_texts
    monkeypatch.setattr(jaccard_join, "candidates", lambda *a: met.append((out := real(*a)).count()) or out)
    monkeypatch.setattr(jaccard_join, "wanted_texts", lambda *a: looked.append((out := other(*a)).count()) or out)
    got = {r.doc_id: (r.n_links, r.component_id) for r in jaccard_join.jaccard_components(docs(rows)).collect()}
    sets = [frozenset(zip(w, w[1:], w[2:])) for w in (t.split() for _, t in rows)]
    links = [[j for j, y in enumerate(sets) if j != i and 100 * len(x & y) >= 90 * len(x | y)] for i, x in enumerate(sets)]
    assert [got[i][0] for i in range(len(rows))] == [len(x) for x in links] and any(links)
    linking = sum(bool(x) for x in links)
    assert met[-1] > linking and looked[-1] <= 1.2 * linking + 4


def test_lists_of_shingles_that_no_slice_repeats_are_known_to_the_order(docs, monkeypatch):
    """A passage in 400 texts, dealt over so many slices that none holds it three times, is in few prefixes."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join([*(f"w{rng.randrange(10**9)}" for _ in range(200)), passage, *(f"w{rng.randrange(10**9)}" for _ in range(140))])) for i in range(400)]
    longest = []
    real = jaccard_join.shared_entries
    monkeypatch.setattr(jaccard_join, "LOCAL_REPEATS", 10**9)
    monkeypatch.setattr(jaccard_join, "shared_entries", lambda first, *a: longest.append(first.groupBy("token").count().agg({"count": "max"}).first()[0]) or real(first, *a))
    got = jaccard_join.jaccard_components(docs(rows))
    assert [(r.n_links, r.component_id) for r in got.orderBy("doc_id").collect()] == [(0, i) for i in range(400)]
    assert longest[0] <= jaccard_join.DENSE
