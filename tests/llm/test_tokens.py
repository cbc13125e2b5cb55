import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from loomstone.llm import decontaminate, near_duplicates, packing, tokens

MB = 1 << 20


def batch(n, size, columns=2):
    rnd = random.Random(n)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(500)]
    texts = [" ".join(rnd.choices(vocabulary, k=size // 7)) for _ in range(n)]
    more = [pa.array(np.arange(n)) for _ in range(columns - 2)]
    names = ["doc_id", "text", *(f"c{i}" for i in range(columns - 2))]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(texts), *more], names=names)


def test_parts_are_the_batch():
    texts = ["a" * 10, None, "", "é" * 30, "b" * 500, "c", None]
    rows = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["k", "t"])
    got = list(tokens.parts(rows, 1, 64))
    assert pa.Table.from_batches(got).to_pydict() == rows.to_pydict()
    assert [p.num_rows for p in got] == [3, 1, 1, 2]  # bytes count, and a longer text is alone
    assert list(tokens.parts(rows.slice(0, 0), 1)) == []
    assert [p.column(1).to_pylist() for p in tokens.parts(rows.slice(3, 2), 1, 64)] == [["é" * 30], ["b" * 500]]


WORKERS = {
    "signatures": lambda: near_duplicates._signatures,
    "sets": lambda: near_duplicates._sets,
    "seeds": lambda: decontaminate._seeds(list(decontaminate.MASKS), np.zeros(1 << 10, "u8"), False),
    "pieces": lambda: packing._pieces(packing.tokenizer_file(), 2048, 0),
}


@pytest.mark.parametrize("name", WORKERS)
def test_workers_hold_a_part_of_a_batch(name):
    """Executors have their workers' memory too: at most part of a batch is Python's at a time, whatever its size."""
    run, small, large = WORKERS[name](), batch(100, 4000), batch(8000, 4000)
    for _ in run(iter([small])):  # loads what a worker loads once
        pass
    tracemalloc.start()
    try:
        for _ in run(iter([large])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert large.nbytes > 30 * MB and peak < 28 * MB, peak / MB
