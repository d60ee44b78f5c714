"""What workers hold: rows to learn from aren't copied, freed memory goes back to the system."""

import tracemalloc

import numpy as np
import pyarrow as pa

from parlance.llm.shared import release
from parlance.llm.toxicity import Ftrl, learn, place_rows


def test_learning_holds_one_copy_of_its_rows():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 1 << 16, 20_000)).astype(np.int32) for _ in range(400)]
    column = pa.chunked_array([pa.array([r.tobytes() for r in part], pa.binary()) for part in (rows[:150], rows[150:], [])] + [pa.array([b""], pa.binary())])
    tracemalloc.start()
    views = place_rows(column)
    weights = learn(views, np.arange(401) % 5 == 0, Ftrl(bits=16, passes=1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(views, [*rows, np.zeros(0, np.int32)])) and len(views) == 401 and len(weights) == (1 << 16) + 1
    assert peak < column.nbytes / 3  # a copy of all rows would be as much as the column


def test_freed_memory_is_given_back():
    import re

    def held() -> int:
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) // 1024

    release()
    before = held()
    many = [bytes(2000) for _ in range(60_000)]
    last = many[-1]
    del many
    full = held()
    release()
    assert held() < before + 30 and len(last) == 2000 and full >= held()
