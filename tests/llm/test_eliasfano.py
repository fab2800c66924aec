import numpy as np
import pytest

from pixelweft.llm.eliasfano import EliasFano, pack, unpack


def cases():
    rng = np.random.default_rng(0)
    for n, u in ((0, 5), (1, 1), (1000, 10**6), (5000, 2**63), (5000, 3000), (20000, 10**9)):
        yield np.sort(rng.integers(0, u, n, dtype=np.uint64))
    dense = [rng.integers(0, 2**40) + np.arange(k) for k in (63, 64, 65, 127, 128, 129, 400, 5000)]
    yield np.sort(np.concatenate(dense)).astype(np.uint64)
    yield np.sort(np.concatenate([np.arange(70, dtype=np.uint64) << np.uint64(30), np.arange(3000, dtype=np.uint64)]))


@pytest.mark.parametrize("values", list(cases()), ids=lambda v: str(len(v)))
def test_access_and_successor(values):
    ef = EliasFano.of(unpack(np.frombuffer(pack(EliasFano.encode(values)), np.uint8)))
    if len(values):
        assert (ef.access(np.arange(len(values))) == values).all()
    rng = np.random.default_rng(1)
    top = int(values[-1]) if len(values) else 9
    asked = np.concatenate([rng.integers(0, top + top // 9 + 2, 3000, dtype=np.uint64), values, values + np.uint64(1)])
    at, same = ef.successor(asked)
    assert (at == np.searchsorted(values, asked)).all()
    assert (same == np.isin(asked, values)).all()
