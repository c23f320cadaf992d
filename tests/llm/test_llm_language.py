"""Language identification against plain loops."""

import numpy as np

from tokenloom.llm import language_id
from tokenloom.llm.language_id import LANDMARKS_PER_LANGUAGE, RIDGE, distinct_codes, fit


def _grams(text: bytes) -> set[bytes]:
    return {text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}


def test_scores_are_the_ridge_on_nystroem_features():
    rng = np.random.default_rng(7)
    texts, labels = [], []
    for lang, letters in (("aa", "abcde "), ("bb", "cdefgh "), ("cc", "xyzab ")):
        for _ in range(LANDMARKS_PER_LANGUAGE + 9):
            texts.append("".join(rng.choice(list(letters), int(rng.integers(3, 60)))).encode())
            labels.append(lang)
    asked = [b"abc", b"fgh efg", b"zzz", b"q"]
    codes = [distinct_codes(np.frombuffer(t, np.uint8)) for t in texts]
    times = [language_id._times(np.frombuffer(t, np.uint8), c) for t, c in zip(texts, codes)]
    model = fit(labels, codes, times)
    assert model.languages == ["aa", "bb", "cc"]

    marks = []
    for lang in model.languages:
        marks += [t for t, own in zip(texts, labels) if own == lang][:LANDMARKS_PER_LANGUAGE]

    def kernel(a, b):
        x, y = _grams(a), _grams(b)
        return len(x & y) / np.sqrt(max(1, len(x)) * max(1, len(y)))

    table = lambda rows: np.array([[kernel(a, m) for m in marks] for a in rows])
    got = model.kernel([distinct_codes(np.frombuffer(t, np.uint8)) for t in asked])
    # Grams outside of the landmarks count in a text's size only.
    np.testing.assert_allclose(got, table(asked), atol=1e-5)

    values, vectors = np.linalg.eigh(table(marks))
    kept = values > 1e-6 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = np.hstack([table(texts) @ root, np.ones((len(texts), 1))])
    want = np.zeros((len(asked), 3))
    for j, lang in enumerate(model.languages):
        weight = np.array([1 / labels.count(own) for own in labels])
        target = np.array([float(own == lang) for own in labels])
        gram = np.zeros((features.shape[1], features.shape[1]))
        right = np.zeros(features.shape[1])
        for row, w, y in zip(features, weight, target):
            gram += w * np.outer(row, row)
            right += w * y * row
        penalty = RIDGE * np.eye(len(gram)) * np.trace(gram) / len(gram)
        penalty[-1, -1] = 0
        solved = np.linalg.solve(gram + penalty, right)
        for i, text in enumerate(asked):
            want[i, j] = np.append(table([text])[0] @ root, 1) @ solved
    found = model.scores([np.frombuffer(t, np.uint8) for t in asked])
    np.testing.assert_allclose(found, want, atol=2e-3)
    np.testing.assert_allclose(found.sum(axis=1), 1, atol=1e-3)
    assert not language_id._TABLES
