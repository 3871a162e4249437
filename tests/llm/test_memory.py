import ctypes
import os
import resource

import numpy as np
import pytest

from wavelot.llm.common import giving_back
from wavelot.llm.suffixes import _portions, anchors


def resident() -> float:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * resource.getpagesize() / 1e6


@pytest.mark.skipif(not os.path.exists("/proc/self/statm") or not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="needs /proc and glibc")
def test_a_task_gives_its_memory_back():
    pinned = []

    @giving_back
    def run(batches):
        for x in batches:
            held = [b"x" * 100_000 for _ in range(1500)]
            pinned.append(b"x" * 100_000)  # above them, so that the heap can't just become shorter
            yield x + len(held)
            del held

    before = resident()
    tasks = run(iter([1]))
    assert next(tasks) == 1501 and resident() > before + 120
    assert list(tasks) == [] and resident() < before + 40


def test_anchors_do_not_depend_on_the_portion():
    rnd = np.random.default_rng(3)
    data = [bytes(rnd.integers(97, 101, n).astype(np.uint8)) for n in (100, 5000, 70_000, 200)]

    def found(most):
        out = set()
        for held in _portions([1, 2, 3, 4], data, 200, most):
            text, at, h = anchors([x[2] for x in held], 200, 40)
            out |= {(held[t][0], held[t][1] + a, int(g)) for t, a, g in zip(text.tolist(), at.tolist(), h.tolist(), strict=True)}
        return out

    assert found(1 << 12) == found(1 << 18) == found(1 << 20)
