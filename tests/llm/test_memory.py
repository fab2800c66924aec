"""Room of arrays: ranges of anchors are equal, contexts are cut in pieces, and freed arrays are used again."""

import subprocess
import sys
import tracemalloc

import numpy as np

from pixelweft.llm import suffixdedup

FAULTS = """
import resource, numpy as np
from pixelweft.llm import ngram
import pyarrow as pa
ngram.reuse_freed()
def work():
    held = [np.ones(700_000) for _ in range(8)]
work()
before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
for _ in range(20):
    work()
print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
"""


def test_freed_arrays_are_used_again():
    out = subprocess.run([sys.executable, "-c", FAULTS], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 100


def test_contexts_take_little_more_room_than_their_bytes():
    rng = np.random.default_rng(5)
    data = rng.integers(32, 127, 400_000).astype(np.uint8)
    offsets = np.arange(0, 400_001, 1000)
    at = np.sort(rng.integers(0, 400_000, 100_000))
    row = at // 1000
    tracemalloc.start()
    keys = suffixdedup._contexts(data, offsets, row, at, 50, 32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * keys.nbytes
    for k in range(0, len(at), 997):
        a, lo, hi = at[k], offsets[row[k]], offsets[row[k] + 1]
        after, before = data[a : min(a + 50, hi)], data[max(a - 32, lo) : a][::-1]
        assert keys[k].tobytes() == after.tobytes().ljust(50, b"\xff") + before.tobytes().ljust(32, b"\xff")
    assert len(suffixdedup._contexts(data[:0], offsets[:1], row[:0], at[:0], 50, 32)) == 0


def test_ranges_of_anchors_hold_equal_shares():
    data = np.random.default_rng(6).integers(32, 127, 600_000).astype(np.uint8)
    _, h = suffixdedup.anchors(data, np.array([0, len(data)]), 50, 18)
    part = suffixdedup.anchor_part(np.sort(h >> np.uint64(16)), 32, 40)
    assert (np.diff(part) >= 0).all()
    assert np.bincount(part, minlength=40).max() < 1.3 * len(h) / 40
