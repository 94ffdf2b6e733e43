"""What a Python worker keeps after a stage of the pipeline."""

import numpy as np
import pyarrow as pa
import pytest

from triagelake.llm import jaccard, language

MODEL = language.Model(("a", "b"), np.zeros((1 << 15, 2), np.float32), np.zeros(2), 1.0, language.Settings())
STEPS = {
    "score": lambda b: language.score_batches(b, MODEL),
    "features": lambda b: language.features(b, MODEL.settings),
    "signed": lambda b: jaccard._signed(b, 4, 2, 3),
}


@pytest.mark.parametrize("step", STEPS)
def test_arrow_gives_back_what_it_freed(step, monkeypatch):
    pool, calls = pa.default_memory_pool(), []

    class Noted:
        def release_unused(self):
            calls.append(1)
            pool.release_unused()

    n, texts = 3, ["one two three four", None, ""]
    rows = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text_key": [1, 2, 3], "pick": [1, 2, 3], "lang": ["a", "b", "a"], "text": texts})
    monkeypatch.setattr(pa, "default_memory_pool", Noted)
    got = [x for x in STEPS[step](iter([rows] * n)) if x.num_rows]
    assert len(got) == n and all(x.equals(got[0]) for x in got)
    assert len(calls) == n + 1  # before each batch is worked off, and at the end
