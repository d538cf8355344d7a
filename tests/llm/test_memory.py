import pyarrow as pa
import pytest

from gradus.llm import _memory


def test_a_worker_holds_only_its_own_operators_objects(monkeypatch):
    monkeypatch.setattr(_memory, "HELD", {})
    made = []
    make = lambda name: _memory.held(name, lambda: made.append(name) or name)

    def run(name):
        def step(batches):
            for b in batches:
                make(name)
                yield b

        return _memory.tidy(step, name)

    batches = [pa.record_batch({"x": [1]}), pa.record_batch({"x": [2]})]
    assert list(run("a")(iter(batches))) == batches and list(run("a")(iter(batches))) == batches
    assert made == ["a"] and list(_memory.HELD) == ["a"]
    list(run("b")(iter(batches)))
    assert made == ["a", "b"] and list(_memory.HELD) == ["b"]
    assert list(_memory.tidy(lambda b: b)(iter([]))) == [] and not _memory.HELD


def test_errors_pass(monkeypatch):
    def step(batches):
        yield next(batches)
        raise ValueError("broken")

    with pytest.raises(ValueError, match="broken"):
        list(_memory.tidy(step)(iter([pa.record_batch({"x": [1]})])))
