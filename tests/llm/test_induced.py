import random

import numpy as np
import pytest

from gradus.llm import induced
from gradus.llm.induced import Sorter, Store, Tape


def brute(raw, depth):
    order = sorted(range(len(raw)), key=lambda i: raw[i:], reverse=True)
    shared = [0]
    for a, b in zip(order, order[1:]):
        n = 0
        while n < depth and max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        shared.append(n)
    return order, shared


def induce(raw, depth, store, base, block):
    text, pos, shared = Tape(store, np.uint8, block), [], []
    text.append(np.frombuffer(raw, np.uint8))
    sorter = Sorter(store, depth, base)
    sorter.sort(text.finish(), lambda p, v: (pos.extend(p.tolist()), shared.extend(v.tolist())))
    return pos, shared, sorter.levels


@pytest.mark.parametrize("memory", [0, 300, 1 << 30])
def test_order_and_prefixes(tmp_path, monkeypatch, memory):
    monkeypatch.setattr(induced, "GROUP", 4)
    rng, deepest = random.Random(memory), 0
    for i in range(60):
        n, letters = rng.randint(1, 400), rng.choice([1, 2, 3, 26])
        raw = bytes(97 + rng.randrange(letters) for _ in range(n))
        raw = raw if i % 3 else (raw[:7] * 60)[:n] + raw[:50]
        store = Store(f"file://{tmp_path}", memory)
        pos, shared, levels = induce(raw, 50, store, rng.choice([0, 3, 1000]), rng.choice([16, 1 << 17]))
        order, want = brute(raw, 50)
        assert pos == order and shared[1:] == want[1:]
        assert store.spilled > 0 or memory
        store.close()
        deepest = max(deepest, levels)
    assert deepest >= 2 and not list(tmp_path.iterdir())
