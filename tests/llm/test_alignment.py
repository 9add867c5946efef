"""op12 against a brute-force version on byte offsets."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from quillspark.llm import alignment

DATA = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    return a, sentencepiece.SentencePieceProcessor(model_file=B), byte


def tokens(libraries, text):
    """Both tokenizations as (id, begin, end); None where their bytes differ from the text's."""
    a, b, byte = libraries
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    of_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
    of_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
    if not text or b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
        return None
    out = []
    for ids, spell in ((ids_a, of_a), (ids_b, of_b)):
        ends = np.cumsum([len(s) for s in spell]).tolist()
        out.append(list(zip(ids, [0, *ends[:-1]], ends)))
    return out


def brute(libraries, docs):
    links, groups, per = {}, {}, Counter()
    for k, (_, text) in enumerate(docs):
        found = tokens(libraries, text or "")
        links[k], groups[k] = [], []
        if found is None:
            continue
        a, b = found
        j = 0
        for i, s, e in a:
            while b[j][2] <= s:
                j += 1
            at = j
            while at < len(b) and b[at][1] < e:
                links[k].append((i, b[at][0]))
                at += 1
        both = sorted({e for _, _, e in a} & {e for _, _, e in b})
        begin = 0
        for end in both:
            groups[k].append(([i for i, s, e in a if begin <= s and e <= end], [i for i, s, e in b if begin <= s and e <= end])) if len(text) < 4000 else None
            begin = end
        groups[k] = groups[k] if len(text) < 4000 else slow_free_groups(a, b, both)
        per.update(links[k])
        links[k] = (len(a), len(b), len(both), links[k])
    top = {}
    for (_, y), n in per.items():
        top[y] = max(top.get(y, 0), n)
    rows = []
    for k, (d, _) in enumerate(docs):
        if not links[k]:
            rows.append((str(d), 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_g, pairs = links[k]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups[k])
        rows.append((str(d), n_a, n_b, n_g, len(pairs), sum(per[p] == top[p[1]] for p in pairs), sum(per[p] for p in pairs), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(rows)


def slow_free_groups(a, b, both):
    out, i, j = [], 0, 0
    for end in both:
        x, y = [], []
        while i < len(a) and a[i][2] <= end:
            x.append(a[i][0])
            i += 1
        while j < len(b) and b[j][2] <= end:
            y.append(b[j][0])
            j += 1
        out.append((x, y))
    return out


def got(df):
    return sorted((str(r["doc_id"]), *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in df.collect())


def test_alignment_query(spark, small, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 100_000)
    docs = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    assert got(alignment.op12_alignment(spark, DATA)) == brute(libraries, docs)


def test_alignment_of_odd_texts(spark, libraries):
    rng = np.random.default_rng(5)
    bits = ["a", "the", " ", "  ", "\n", "\t", "'s", "don't", "1234", "é", "日本語", "😀", "\u0000", "<|endoftext|>", "</s>", "<0x41>", " ", "▁", " ", "...", "ß", "x́", "Internationalization", "\r\n", "--", "#", "\U000e0001"]
    docs = [(i, "".join(bits[k] for k in rng.integers(0, len(bits), rng.integers(1, 14)))) for i in range(600)]
    docs += [(1000, None), (1001, ""), (1002, " "), (1003, "   "), (None, "no number of its own"), (1004, docs[3][1]), (1004, docs[3][1]), (1005, "wordy" * 3000), (1006, "ab" * 2500 + " tail " * 300), (1007, "<|endoftext|>")]
    df = spark.createDataFrame([(d, t, 7, "x") for d, t in docs], "doc_id long, text string, chunk int, pair string")
    assert got(alignment.align(df, A, B, full=False)) == brute(libraries, docs)


def test_groups_are_told(spark, libraries):
    docs = [(1, "Internationalization matters"), (2, None)]
    rows = {r["doc_id"]: r for r in alignment.align(spark.createDataFrame(docs, "doc_id long, text string"), A, B).collect()}
    assert hashlib.sha256(rows[1]["groups"].encode()).hexdigest() == rows[1]["groups_sha256"] and rows[2]["groups"] == rows[2]["groups_sha256"] == ""
    assert [int(x) for g in rows[1]["groups"].split(";") for x in g.split("|")[0].split(",")] == libraries[0].encode(" " + docs[0][1]).ids


def test_no_documents(spark, no_docs):
    assert alignment.align(no_docs, A, B, full=False).count() == 0


def test_transducer():
    t = alignment.Transducer([b"ab", b"c", b"defg", b""], [b"a", b"bcd", b"efg", b"abc"])
    assert t.align([0, 1, 2], [0, 1, 2]) == ([(0, 3, 0, 3)], [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2)])
    assert t.align([0, 1], [3]) == ([(0, 2, 0, 1)], [(0, 0), (1, 0)])
    assert t.align([0], [0]) is None and t.align([0, 1], [1]) is None and t.align([3], []) is None and t.align([], [0]) is None
    assert t.align([], []) == ([], [])


def test_transitions_may_be_forgotten(monkeypatch):
    monkeypatch.setattr(alignment, "MEMO", 2)
    t = alignment.Transducer([b"a", b"aa", b"aaa"], [b"a", b"aa", b"aaaa"])
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = rng.integers(0, 3, 6).tolist()
        left, b = sum(len(t.bytes[0][i]) for i in a), []
        while left:
            b.append(int(rng.choice([i for i in range(3) if len(t.bytes[1][i]) <= left])))
            left -= len(t.bytes[1][b[-1]])
        groups, links = t.align(a, b)
        assert len(links) == len(a) + len(b) - len(groups)
