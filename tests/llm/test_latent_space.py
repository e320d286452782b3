"""The latent space of op4 holds every document."""

import numpy as np

from quaymark.llm import decontaminate


def test_the_fit_holds_all_documents(spark):
    words = [f"w{i}" for i in range(12)]
    rng = np.random.default_rng(1)
    texts = [[words[i] for i in rng.integers(0, len(words), 10)] for _ in range(3000)]
    benchmark = [{"item_id": i, "text": " ".join(words[i : i + 6])} for i in range(7)]
    (items,) = decontaminate.Items.parts(iter(benchmark))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    codes = decontaminate.encode(docs, items)
    idf = decontaminate.weights(codes, len(items.vocabulary))
    basis = decontaminate.latent_basis(codes, items, idf)
    passages = np.zeros((len(texts) + len(items.ids), len(idf)))
    for row, found in zip(passages, [[items.vocabulary[w.encode()] for w in t if w.encode() in items.vocabulary] for t in texts] + items.codes):
        np.add.at(row, found, 1)
    weighted = passages * idf
    weighted[len(texts) :] *= np.sqrt(len(texts) / decontaminate.BESIDE)
    # with as many axes as terms, the whitened basis is the inverse of what it was fitted on
    gram = weighted.T @ weighted
    assert np.allclose(np.linalg.inv(basis @ basis.T), gram, rtol=1e-3, atol=1e-3 * np.abs(gram).max())


def test_rows_are_added_up_in_runs():
    rng = np.random.default_rng(2)
    rows = rng.standard_normal((50, 3)).astype(np.float32)
    # one row gets thousands, as a very common term does, and some get none
    to = np.sort(np.concatenate([np.full(5000, 4), np.full(decontaminate.RUN, 6), rng.integers(0, 40, 300)]))
    of = rng.integers(0, len(rows), len(to))
    expected = np.ones((40, 3))
    np.add.at(expected, to, rows[of])
    out = np.ones((40, 3))
    decontaminate.add_rows(out, to, rows, of)
    assert np.allclose(out, expected, atol=1e-3)
    decontaminate.add_rows(out, to[:0], rows, of[:0])
    assert np.allclose(out, expected, atol=1e-3)


def test_a_term_counts_once_for_a_document(spark):
    (items,) = decontaminate.Items.parts(iter([{"item_id": 0, "text": "a b c"}]))
    docs = spark.createDataFrame([(0, "a x a b a"), (1, "x y"), (2, None), (3, "b b")], "doc_id long, text string")
    found = decontaminate.encode(docs, items).where("kind = 1").groupBy("term").sum("n").collect()
    assert {r[0]: r[1] for r in found} == {items.vocabulary[b"a"]: 1, items.vocabulary[b"b"]: 2}
