"""What a worker holds of texts that it has split."""

import pyarrow as pa

from panelcraft.llm import _words


def test_memory_goes_back_before_the_first_batch_and_after_each_part(monkeypatch):
    """A worker starts without what an earlier stage has left, also in one batch of many parts."""
    calls = []
    monkeypatch.setattr(_words, "_give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 100] * 10)], names=["text"])
    seen = [len(calls) for _ in _words.slices(iter([batch]), 0, 100)]
    assert seen[0] == 1 and seen == list(range(1, len(seen) + 1)) and len(seen) > 5
