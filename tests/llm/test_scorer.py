import numpy as np

from cairnlake.llm import toxicity


def test_new_words_cost_rows_of_a_table_made_once():
    """No word goes back to the model's embeddings, and scores don't depend on what is kept."""
    rng = np.random.default_rng(5)
    model = toxicity.Model()
    model.embed[1:] = rng.normal(0, 0.5, model.embed[1:].shape)
    texts = ["", "One", "a é 日本語の \ud800x", " ".join(f"w{i} word{i % 7}" for i in range(9000)).translate(str.maketrans("0123456789", "abcdefghij"))]
    filters = model.slices.transpose(1, 0, 2).reshape(toxicity.DIM, -1)
    want = [model.score(model.pooled((model.embed[d].sum(axis=1) @ filters).reshape(len(d), -1, toxicity.FILTERS))[0]) for d in (toxicity.encoded(t, {}) for t in texts)]
    score, small = toxicity.Scorer(model), toxicity.Scorer(model, limit=2)
    model.embed = None
    got = [score(t) for t in texts]
    assert np.allclose(got, want, atol=1e-5) and got == [score(t) for t in texts] == [small(t) for t in texts]
