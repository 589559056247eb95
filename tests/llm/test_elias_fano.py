import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselq.llm.elias_fano import EliasFano, build, load, save


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, 2**63 - 1), max_size=60), st.sampled_from([1, 40, 1 << 20, 1 << 44]), st.integers(0, 2**63 - 1))
def test_find_and_read(values, divisor, other):
    have = sorted({v // divisor for v in values})
    universe = (have[-1] + 1 if have else 0) + other % 1000
    ef = EliasFano(build(np.array(have, np.uint64), universe, access=True))
    ask = sorted({*have, *(v + 1 for v in have), *(max(0, v - 1) for v in have), other})
    place = {v: i for i, v in enumerate(have)}
    assert ef.find(np.array(ask, np.uint64)).tolist() == [place.get(v, -1) for v in ask]
    if have:
        assert ef.read(np.arange(len(have))).tolist() == have


def test_clusters_and_repeats(tmp_path):
    dense = np.concatenate([np.arange(5000), [10**9], 10**12 + np.arange(3000) * 7]).astype(np.uint64)
    save(f"file://{tmp_path}/x.bin", build(dense, 10**13, access=True))
    ef = EliasFano(load(f"file://{tmp_path}/x.bin"))
    assert ef.find(dense).tolist() == list(range(len(dense)))
    assert (ef.find(dense[5001:] + np.uint64(3)) == -1).all()
    assert ef.read(np.arange(len(dense))).tolist() == dense.tolist()
    pointers = np.array([0, 0, 0, 4, 4, 900, 900, 70_000], np.uint64)
    assert EliasFano(build(pointers, 70_001, access=True)).read(np.arange(8)).tolist() == pointers.tolist()
