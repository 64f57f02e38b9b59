"""What Python workers keep from task to task."""

import numpy as np

from dayloom.llm import common, language_model, tokens


def test_a_worker_keeps_one_value():
    made = []
    for key in ("a", "a", "b", "a"):
        assert common.worker_memo(key, lambda: made.append(1) or len(made)) == len(made)
    assert len(made) == 3
    common.release()
    assert common.worker_memo("a", lambda: "new") == "new"


def test_ten_language_models_in_one_worker_hold_the_memory_of_one():
    import resource

    flat = np.random.default_rng(1).normal(0, 0.1, 3 * 2049 * 16 + 2049).astype(np.float32)
    build = lambda k: common.worker_memo(f"scorer {k}", lambda: language_model.Scorer(flat, 2049, 16))
    for k in range(2):
        build(k)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for k in range(10):
        build(10 + k)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 60_000  # KB; one is 48 MB


def test_remembered_words_are_bounded_by_bytes(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        encoder = tokens.WordEncoder(file.read())
    monkeypatch.setattr(tokens, "REMEMBERED", 200_000)
    for k in range(20):
        encoder.encode(pa.array([" ".join(f"word{j}" for j in range(k * 200, k * 200 + 200))]))
        held = sum(tokens.ENTRY_BYTES + len(w) + len(i) for d in (encoder.young, encoder.old) for w, i in d.items())
        assert held <= 300_000 and encoder.weight >= sum(tokens.ENTRY_BYTES + len(w) + len(i) for w, i in encoder.young.items())
