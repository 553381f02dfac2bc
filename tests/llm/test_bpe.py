import hashlib
import random
import string

import numpy as np
import pytest
from helpers import documents

from threadlens.llm.bpe import encode_documents, load

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(3)
    alphabets = [string.ascii_letters + " ", string.printable, "aé ñü\xa0\x85²¼'", "中文字 \U0001f600​ a1", "'sdtmlrev ", " \t\n"]
    out = ["", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "qzxjqz" * 100, "a" * 3000, "\t" * 500 + "x", "it's we'll I'd they've 'sa"]
    return out + ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (1, 2, 3, 7, 40, 300) for _ in range(8)]


def test_equals_the_library(library):
    bpe = load(PATH)
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == ids, t
        assert bpe.decode(bpe.encode(t)) == library.decode(ids, skip_special_tokens=False)
        assert bpe.decode(bpe.encode(t)) == t


def test_cuts_are_where_no_token_spans():
    bpe = load(PATH)
    tokens = [t for i, t in bpe.bytes_of.items() if i != 50256]
    raw = b"hello qzxj\xff\x00world"
    for k in range(1, len(raw)):
        inside = any(raw[k - 1 : k + 1] in t for t in tokens)
        assert (k in bpe.cuts(raw)) == (not inside)


def test_fragments_join_to_the_whole():
    bpe = load(PATH)
    for t in texts():
        raw = t.encode()
        at = [0, *bpe.cuts(raw), len(raw)]
        assert sum((bpe.merge(raw[a:b]) for a, b in zip(at, at[1:])), []) == bpe.merge(raw)


def test_documents(spark, edge_rows, library):
    got = encode_documents(documents(spark, edge_rows), PATH).collect()
    want = []
    for doc_id, text, *_ in edge_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        want.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert encode_documents(documents(spark, []), PATH).collect() == []
    ids = encode_documents(documents(spark, [(1, "hello world")]), PATH, with_ids=True).first()
    assert ids.decoded == "hello world" and len(ids.ids) == 4 * ids.n_tokens
