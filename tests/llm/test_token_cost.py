"""op5's work a byte and an id: blocks are coded side by side, short pieces are met as words. No result may change by it."""

import numpy as np
import public_tokenizers
import pytest

from quillspark.llm import _text, token_binary


def plain_coder(ids, freq, cum):
    """(states, words) by whole numbers, one id after another."""
    lanes, p = max(1, min(token_binary.LANES, len(ids))), token_binary.PRECISION
    state, out = [token_binary.LOW] * lanes, []
    for i in range(len(ids) - 1, -1, -1):
        f, c, x = int(freq[ids[i]]), int(cum[ids[i]]), state[i % lanes]
        if x >= f << 63 - p:
            out.append(x & 0xFFFFFFFF)
            x >>= 32
        state[i % lanes] = (x // f << p) + x % f + c
    return state, out[::-1]


@pytest.mark.parametrize("sizes", [[0], [1, 700, 512], [3, 0, 1025, 511, 1024, 4000], [4000, 4000, 2600], [33000, 5, 70000]])
def test_blocks_coded_side_by_side_are_those_coded_alone(sizes):
    rng = np.random.default_rng(len(sizes))
    blocks = [np.minimum(rng.zipf(1.3, n), 4999).astype(np.int64) for n in sizes]
    freq = token_binary.frequencies(np.bincount(np.concatenate([*blocks, [1]]), minlength=5000))
    cum = np.cumsum(freq) - freq
    coded = token_binary.encode_blocks(blocks, freq, cum)
    for b, (lanes, states, words) in zip(blocks, coded):
        assert lanes == max(1, min(token_binary.LANES, len(b)))
        if len(b) < 5000:
            assert (states.tolist(), words.tolist()) == plain_coder(b.tolist(), freq, cum)
    slot = np.repeat(np.arange(5000), freq)
    for b, got in zip(blocks, token_binary.decode_blocks([(len(b), *c) for b, c in zip(blocks, coded)], freq, cum, slot), strict=True):
        assert got.tolist() == b.tolist()
    if len(coded[-1][2]):
        coded[-1] = (*coded[-1][:2], coded[-1][2][:-1])
        with pytest.raises(ValueError, match="words"):
            token_binary.decode_blocks([(len(b), *c) for b, c in zip(blocks, coded)], freq, cum, slot)


def test_groups_of_blocks_are_bounded_as_padded():
    rows = [{"n_tokens": int(n)} for n in [5] * 3000 + [1 << 20] + [7] * 3000 + [1 << 23, 1, 1]]
    held = list(token_binary.groups(rows, 1 << 21))
    assert [r for g in held for r in g] == rows and len(held) < 40
    assert all(len(g) == 1 or len(g) * max(r["n_tokens"] for r in g) <= 1 << 21 for g in held)


def test_pieces_found_in_bytes_are_those_found_in_characters():
    rng = np.random.default_rng(4)
    letters = [*"'strlev  \n\tB1!", "٣", "é", "中", " ", "　", "😀", "́", "\x85", "\x1c", "\x00"]
    for _ in range(2000):
        parts = ["".join(rng.choice(letters, rng.integers(0, 9))).encode() for _ in range(rng.integers(1, 6))]
        raw = b"".join(parts) or b"a"
        off = np.minimum(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), len(raw))
        off[-1] = len(raw)
        buf = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero((buf & 0xC0) != 0x80)
        want = at[token_binary.pretokens(np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32), np.searchsorted(at, off))]
        assert token_binary.piece_starts(buf, raw, off).tolist() == want.tolist(), parts


def test_short_pieces_are_not_hashed_byte_by_byte(monkeypatch):
    """Sums over each byte of a block were a fifth of the work; only pieces longer than two words need them."""
    from tokenizers import Tokenizer

    path, summed = public_tokenizers.path("byte_bpe_50k.json"), []
    honest = _text.exact_hashes
    monkeypatch.setattr(_text, "exact_hashes", lambda buf, start, end: summed.append(len(buf)) or honest(buf, start, end))
    words = ["a", "eightlet", "ninelette", "sixteenlettersxx", "seventeenletters!", "x" * 40, "y" * 5000, "é" * 8, "\x00" * 3, "\x00" * 4]
    texts = [" ".join(words[(i * 7 + j) % len(words)] for j in range(9)) for i in range(60)] * 2 + ["plain words of common length " * 400]
    raw = [t.encode() for t in texts]
    code, library = token_binary.UnitEncoder(path, 0), Tokenizer.from_file(path)
    ids, n = code(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])]))
    assert np.split(ids, np.cumsum(n))[0].tolist() == [*library.encode(texts[0]).ids, 0]
    assert ids.tolist() == [i for t in texts for i in [*library.encode(t, add_special_tokens=False).ids, 0]]
    summed.clear()
    code(np.frombuffer(raw[-1], np.uint8), np.array([0, len(raw[-1])]))
    assert sum(summed) == 0


def test_the_shuffle_of_the_texts_goes_before_the_files_come(spark, small, tmp_path, monkeypatch):
    from pathlib import Path

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    held = lambda: {p: p.stat().st_size for d in dirs for p in Path(d.getPath()).rglob("shuffle_*.data")}
    before, setting, after, stage = held(), spark.conf.get(name), [], token_binary.C.stage
    monkeypatch.setattr(token_binary.C, "stage", lambda df: (stage(df), after.append((spark.conf.get(name), held())))[0])
    token_binary.write_tokens(small, str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"))
    [(inside, files)] = after
    assert sum(n for p, n in files.items() if p not in before) < 20_000 < sum(len(r["text"] or "") for r in small.select("text").collect())
    assert inside == "true" and spark.conf.get(name) == setting
