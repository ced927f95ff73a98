"""Every training word has its own emission, learned over whole texts: scores against a plain Baum-Welch."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from test_statistics import path_sums, toy_model

from cabflow.llm import hmm as H
from cabflow.llm.common import Words


def plain_scores(rows, states, rounds, own):
    """Baum-Welch with one emission row a word, over whole texts."""
    tokens = {i: t.split() for i, t in rows}
    training = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(w for i in training for w in tokens[i])
    key = {w: int(Words([w.encode()]).hash.view(np.int64)[0]) for ws in tokens.values() for w in ws}
    once = sum(n == 1 for n in count.values())
    n_tokens, distinct = sum(count.values()) + len(training), len(count) + 1
    frequent = sorted((w for w in count if count[w] > 1), key=lambda w: (-count[w], key[w]))[:own]
    classes = collections.Counter()
    for w, n in count.items():
        classes[key[w] % H.CLASSES] += n * (n > 1)
    known = H.Counts(n_tokens, distinct, len(training), once, [(key[w], count[w]) for w in frequent], classes)
    first = H.Model.first(known.symbol_total, states)
    start, move = first.start, first.move
    vocabulary = [None, *count]  # None is the end
    symbol, share = known.symbols(np.array([key[w] for w in count]), np.array(list(count.values())))
    emit = {w: first.emit[s] * 10**p for w, s, p in zip(count, symbol, share)}
    emit[None], unseen = first.emit[H.END], first.emit[H.RARE] * (0.5 if once else 1)
    total = n_tokens + 0.1 * (distinct + 1)
    seen = {**count, None: len(training)}

    def forward(words):
        a, alphas, scales = None, [], []
        for w in [*words, None]:
            a = (start if a is None else a @ move) * emit.get(w, unseen)
            scales.append(a.sum())
            a = a / scales[-1]
            alphas.append(a)
        return alphas, scales

    for _ in range(rounds):
        began, moved = np.zeros(states), np.zeros((states, states))
        expected = {w: np.zeros(states) for w in vocabulary}
        for i in training:
            words = [*tokens[i], None]
            alphas, scales = forward(tokens[i])
            beta = np.ones(states)
            for t in range(len(words) - 1, -1, -1):
                expected[words[t]] += alphas[t] * beta
                if t:
                    ahead = emit[words[t]] * beta / scales[t]
                    moved += np.outer(alphas[t - 1], ahead) * move
                    beta = move @ ahead
            began += alphas[0] * beta
        weight = {w: c + H.PRIOR * (seen[w] + 0.1) / total for w, c in expected.items()}
        norm = sum(weight.values()) + H.PRIOR * 0.1 / total
        unseen = (0.5 * sum((weight[w] for w in count if count[w] == 1), np.zeros(states)) + H.PRIOR * 0.1 / total) / norm
        emit = {w: x / norm * (0.5 if w is not None and count[w] == 1 else 1) for w, x in weight.items()}
        assert sum(emit.values()) + unseen == pytest.approx(np.ones(states))
        start, move = (began + 0.1) / (began + 0.1).sum(), (moved + 0.1) / (moved + 0.1).sum(axis=1, keepdims=True)
    return {i: sum(map(math.log10, forward(tokens[i])[1])) for i in tokens}


def test_scores_equal_plain_baum_welch(spark, monkeypatch):
    monkeypatch.setattr(H, "OWN", 5)
    monkeypatch.setattr(H, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(H, "RANGE_BYTES", 6000)
    rng = random.Random(9)
    words = [f"word{k}" for k in range(4000)]  # more words than classes
    rows = []
    for i in range(120):
        topic = i % 3 * 1300
        size = 700 if i == 50 else rng.randint(1, 60)
        rows.append((i, " ".join(words[topic + min(rng.randrange(1300), rng.randrange(1300))] for _ in range(size))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in H.hmm_scores(docs, states=3, rounds=3).collect()}
    want = plain_scores(rows, 3, 3, 5)
    assert got == {i: pytest.approx(s, rel=1e-5) for i, s in want.items()}


def test_segments_do_not_change_the_counts(monkeypatch):
    model = toy_model()
    sequences = [[0, 3, 2, 4, 1, 0], [2], [4, 4, 1], [1, 2, 3, 4, 0, 1, 2]]
    flat, sizes = np.concatenate(sequences), np.array([len(s) for s in sequences])
    want = [path_sums(model, s) for s in sequences]
    monkeypatch.setattr(H, "CELLS", 4)
    counts = [np.zeros(3), np.zeros((3, 3)), np.zeros((H.SYMBOLS, 3))]
    H.forward_backward(model, flat, np.cumsum(sizes) - sizes, sizes, counts)
    for k in range(3):
        assert counts[k] == pytest.approx(sum(w[k + 1] for w in want))


def test_counts_travel_in_few_bytes():
    """Rare words' counts and hashes: byte planes of small numbers, whatever the values come back."""
    rng = np.random.default_rng(4)
    words = np.sort(rng.integers(-(1 << 63), 1 << 63, 50_000))
    units = rng.integers(0, 1 << 18, (50_000, 6))
    assert (H.unpacked_words(H.packed_words(words)) == words).all() and (H.unpacked(H.packed(units), 6) == units).all()
    assert len(zlib.compress(H.packed_words(words), 1)) < 6.6 * len(words)
    assert len(zlib.compress(H.packed(units), 1)) < 2.6 * units.size
    for n in (0, 1):
        assert (H.unpacked_words(H.packed_words(words[:n])) == words[:n]).all() and H.unpacked(H.packed(units[:n]), 6).shape == (n, 6)
    units[7, 2] = 1 << 40
    assert (H.unpacked(H.packed(units), 6) == units).all()
