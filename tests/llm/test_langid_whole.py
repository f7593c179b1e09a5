"""Language machines learn from every labelled document that is not held out, however many there are."""

import numpy as np
import pytest

from pointloom.llm import langid

from .test_models import held, prose


def token(k):
    return "".join(chr(97 + (k * 7919 + 131) // 26**j % 26) for j in range(4))


@pytest.mark.parametrize("rare", [0, 2])
def test_all_documents_are_learned_from(make, rare):
    rows = [(k, f"{text} {token(k)}", lang) for k, text, lang in prose(500)]
    rows += [(1000 + k, "slova " * 9, lang) for k, lang in enumerate(["ru", "pl"] * 8 * rare)]  # meet in few blocks, if in any
    model = langid.train(make(rows), 50)
    seen = 0
    learned = [(k, lang) for k, _, lang in rows[:500] if not held(k, 5)]
    for k, _ in learned:
        four = langid._features([token(k)])[1][0]  # the whole word is one feature
        seen += bool(np.any(model.weights[:, four] != 0))
    assert seen >= 0.98 * len(learned)
    langs, _ = model.predict([t for k, t, _ in rows[:500] if held(k, 5)])
    assert np.mean([a == lang for a, lang in zip(langs, [lang for k, _, lang in rows[:500] if held(k, 5)], strict=True)]) >= 0.97
    assert all(np.any(w != 0) for w in model.weights)
