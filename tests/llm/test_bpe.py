"""The automaton against the library's own encoder."""

import hashlib
import os
import random

import pytest

from sievework.llm import bpe

PATH = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers") + "/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(1)
    some = ["", " ", "a" * 700, " " * 300 + "x", "<|endoftext|>a<|endoftext|>", "hello world " * 50, "aaaa bbbb aaa aa", "don't we'll I'M", "漢字かな🙂́", "\r\n\t \x00\x1f", "x" * 30_000]
    return some + ["".join(r.choice("aab ths e\n\t.é,漢🙂0123 =_'") for _ in range(r.randint(0, 90))) for _ in range(1500)]


def test_same_ids_and_texts(library):
    a = bpe.automaton(bpe._read(PATH))
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        got = a.encode(t)
        assert list(memoryview(got).cast("I")) == ids
        assert a.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_small_automata():
    """Every word over two letters against merging by rank, for merges that overlap themselves and each other."""
    import itertools
    import json

    for merges in (["a a"], ["a b", "b a", "ab a"], ["a a", "aa a"], ["b b", "a bb", "a b", "ab b"], ["a a", "aa aa", "a b", "aa b"]):
        vocab = {c: i for i, c in enumerate(["a", "b", *dict.fromkeys(m.replace(" ", "") for m in merges)])}
        a = bpe.Automaton(json.dumps({"model": {"vocab": vocab, "merges": merges}, "added_tokens": []}))
        for n in range(1, 9):
            for word in map("".join, itertools.product("ab", repeat=n)):
                parts = list(word)
                for u, v in (m.split() for m in merges):
                    i = 0
                    while i < len(parts) - 1:
                        if (parts[i], parts[i + 1]) == (u, v):
                            parts[i : i + 2] = [u + v]
                        i += 1
                assert list(memoryview(a[word]).cast("I")) == [vocab[p] for p in parts], (merges, word)


def test_rows(spark, library):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "Hé llo", "z"), (3, "Hé llo", "z")], "doc_id long, text string, token_ids string")
    got = bpe.token_digests(df, PATH).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, 0), (2, 0), (3, 4), (3, 4)]
    assert {r.decoded_sha256 for r in got if r.doc_id == 3} == {hashlib.sha256("Hé llo".encode()).hexdigest()}
    full = {r.doc_id: r for r in bpe.encode(df, PATH, decoded=True).collect()}
    assert full[3].token_ids == library.encode("Hé llo").ids and full[3].decoded == "Hé llo" and full[1].token_ids == []
    assert bpe.token_digests(df.limit(0), PATH).count() == 0


def test_a_task_leaves_no_tables_behind():
    """A worker goes on to other jobs: what it held for one must be gone with the task."""
    import gc
    from types import SimpleNamespace

    import pyarrow as pa

    list(bpe._encode(iter([pa.RecordBatch.from_pydict({"text": ["some words", None]})]), SimpleNamespace(value=bpe._read(PATH)), "text", True))
    gc.collect()
    assert not [x for x in gc.get_objects() if type(x) is bpe.Automaton]
