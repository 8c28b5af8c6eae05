"""The lowest values of long texts are found without copies of whole batches."""

import pyarrow as pa

from sqltally.operators.catalog import _smallest


def test_a_batch_of_long_texts_is_not_copied():
    texts = [f"{(k * 7919) % 4001:05d}" + "x" * 10_000 for k in range(4000)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    plain, pool = pa.default_memory_pool(), pa.system_memory_pool()
    pa.set_memory_pool(pool)
    try:
        (got,) = _smallest(["t"], 3, True)(iter([batch]))
    finally:
        pa.set_memory_pool(plain)
    assert got["value"].to_pylist() == ["", *sorted(t for t in texts if t)[:2], None]
    assert pool.max_memory() < batch.nbytes / 2
