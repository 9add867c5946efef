"""What a Python worker holds while stages of one session follow each other in it."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quillspark.llm import _common, _text, near_dup, piece_codec, toxicity

PATH = public_tokenizers.path("piece_bpe_32k.model")


class Shared:
    value = toxicity.NoisyOr(np.array([1, 2], np.uint64), np.ones(2), -1.5)


def batch(texts, **more):
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts} | more)


@pytest.mark.parametrize("stage", ["score", "occurrences", "features", "sketch"])
def test_a_stage_forgets_the_tokenizer_of_another(stage):
    rows = batch(["one two three", "four. five"], toxic=pa.array([0, 1], pa.int32()))
    run = {
        "score": lambda: toxicity._score(Shared, pa.schema([("doc_id", pa.int64())])),
        "occurrences": toxicity._occurrences,
        "features": lambda: toxicity._features(np.array([1, 2], np.uint64)),
        "sketch": lambda: near_dup._sketch(2),
    }[stage]()
    first = [b.to_pydict() for b in piece_codec._run(PATH, True)(iter([rows]))]
    assert piece_codec.cache.cache_info().currsize == 1
    list(run(iter([rows])))
    assert piece_codec.cache.cache_info().currsize == 0
    assert [b.to_pydict() for b in piece_codec._run(PATH, True)(iter([rows]))] == first
    _common.free()


def test_toxicity_holds_little_beside_its_texts():
    """Tens of bytes for each byte of a block: with blocks of one MB this fails."""
    rows = batch(["some words stand here. others follow them! " * 50] * 2000)
    run = toxicity._score(Shared, pa.schema([("doc_id", pa.int64())]))
    list(run(iter([rows])))
    tracemalloc.start()
    list(run(iter([rows])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20, peak


def test_tables_of_powers_are_small():
    assert sum(x.nbytes for x in _text.powers(1 << 19)) <= 16 << 20
    _text.exact_hashes(np.zeros(8, np.uint8), np.array([0]), np.array([8]))
    assert sum(x.nbytes for x in _text._prime_powers(1 << 20)) <= 24 << 20
    assert _text._prime_powers.cache_info().hits, "exact_hashes asked for another size"
