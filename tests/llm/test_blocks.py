"""Blocks of texts on their way to the log-probabilities of their n-grams."""

import random

import pyarrow as pa

from panelcraft.llm import perplexity


def test_blocks_are_shuffled_compressed_and_whole():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(300)]
    texts = [None, "", *(" ".join(rng.choices(words, k=200)) for _ in range(300))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["row", "text"])
    parts = list(perplexity._with_block(100_000)(iter([batch.slice(0, 150), batch.slice(150)])))
    assert sum(p.nbytes for p in parts) < 0.7 * batch.nbytes

    nats = pa.table({"gram": pa.array([k for k in range(256)]), "nat": pa.array([float(k) for k in range(256)])})
    of = {}
    for block in {p.column("block")[0].as_py() for p in parts}:
        mine = pa.Table.from_batches([p for p in parts if p.column("block")[0].as_py() == block])
        found = perplexity._block_scores(1)(mine, nats)
        of |= {r["row"]: (r["nats"], r["n_bytes"]) for r in found.to_pylist()}
    assert of == {i: (float(sum((t or "").encode())), len((t or "").encode())) for i, t in enumerate(texts)}
