"""Forward-backward against plain sums, and texts that it passes once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cabflow.llm import hmm as H


@pytest.mark.parametrize("cells", [1 << 19, 8])
def test_forward_backward_against_plain_sums(monkeypatch, cells):
    """Whole sequences, also where one is longer than a segment holds."""
    monkeypatch.setattr(H, "CELLS", cells)
    rng = np.random.default_rng(3)
    z, v = 3, 7
    emit, move, start = rng.random((v, z)), rng.random((z, z)), rng.random(z)
    model = H.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    texts = [rng.integers(0, v, n) for n in (1, 5, 2, 30, 5)]
    sizes = np.array([len(x) for x in texts])
    flat, starts = np.concatenate(texts), np.cumsum(sizes) - sizes
    counts = [np.zeros(z), np.zeros((z, z)), np.zeros((v, z))]
    H.forward_backward(model, flat, starts, sizes, counts)
    want, total = [np.zeros(z), np.zeros((z, z)), np.zeros((v, z))], []
    for x in texts:
        a = [model.start * model.emit[x[0]]]
        for w in x[1:]:
            a.append(a[-1] @ model.move * model.emit[w])
        b = [np.ones(z)]
        for w in x[:0:-1]:
            b.append(model.move @ (model.emit[w] * b[-1]))
        b.reverse()
        p = a[-1].sum()
        total.append(np.log10(p))
        want[0] += a[0] * b[0] / p
        for t, w in enumerate(x):
            want[2][w] += a[t] * b[t] / p
            if t:
                want[1] += np.outer(a[t - 1], model.emit[w] * b[t]) * model.move / p
    for got, right in zip(counts, want):
        np.testing.assert_allclose(got, right, rtol=1e-9)
    np.testing.assert_allclose(H.log_likelihood(model, flat, starts, sizes), total, rtol=1e-9)


def test_texts_of_a_block_run_forward_once(monkeypatch):
    """Texts go through forward-backward in groups that one segment holds."""
    monkeypatch.setattr(H, "CELLS", 10)
    held = []
    monkeypatch.setattr(H, "forward_backward", lambda model, symbols, starts, sizes, counts: held.append(sizes.tolist()))
    known = H.Counts(20, 1, 6, 0, [], {})

    class Shared:
        value = H.Emissions.first(known, 2)

    symbols = [H.planes(np.zeros(n, np.uint32)) for n in (4, 4, 4, 12, 1, 1)]
    none = [None] * 5
    table = pa.table({"block": [0] * 6, "symbols": symbols, "_words": [H.packed_words(np.zeros(0, np.int64)), *none], "_seen": [H.planes(np.zeros(0, np.int64), "<i8"), *none]})
    H.expected_counts(Shared, 2, 1, to_arrow_schema(T.StructType.fromDDL(H._counts_schema(2))))(table)
    assert sorted(sum(held, [])) == [1, 1, 4, 4, 4, 12] and all(sum(s) <= 10 or len(s) == 1 for s in held)
