"""What a Python worker holds while it works, and after a task."""

import tracemalloc

import numpy as np
import pyarrow as pa

from twinline.llm import decontaminate, flat, suffix_dedup


def test_a_worker_keeps_one_table_of_powers():
    for length in (10, 1 << 18, (1 << 18) + 1, 1 << 20, 100):
        up, down = flat.powers(length)
        assert len(up) == len(down) >= length
        assert ((up[:100] * down[:100]) == 1).all()
    assert sum(u.nbytes + d.nbytes for u, d in flat._longest) <= 16 << 20


def test_chunks_are_hashed_in_little_memory():
    text = pa.array([np.random.default_rng(i).bytes(2000).hex() for i in range(400)])
    tracemalloc.start()
    sizes = []
    for _, data, offsets in flat.chunks(text):
        sizes.append(len(offsets) - 1)
        suffix_dedup.minimizers(data, offsets, 100, suffix_dedup.GRAM)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 400
    assert peak < 40 << 20


def test_items_forget_the_texts_of_a_task():
    items = decontaminate.Items([1], ["a question that is long enough to be found with edits"], 0.1, decontaminate.GRAM)
    text = "before a question that is long enough to be found with edlts after"
    batch = pa.RecordBatch.from_pydict({"doc_id": [7], "text": [text]})
    found = [row for part in decontaminate._scan_once(iter([batch]), items) for row in part.to_pylist()]
    assert [(r["doc_id"], r["item_id"], r["n_edits"]) for r in found] == [(7, 1, 1)]
    assert not items.verified
