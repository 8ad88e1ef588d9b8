import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from gridcast.llm import token_counts as tc
from gridcast.llm.store import fresh_path

END = 65_000


def cut(rng, tokens, file):
    """A file's tokens as blocks of any size."""
    blocks, at = [], 0
    while at < len(tokens):
        n = rng.choice([0, 1, 2, 7, 40])
        blocks.append((file, len(blocks), np.array(tokens[at:at + n], dtype=tc.DTYPE).tobytes()))
        at += n
    return blocks


@pytest.mark.parametrize("group", [4096, 3])
def test_documents_over_any_blocks(spark, monkeypatch, group):
    monkeypatch.setattr(tc, "GROUP_BLOCKS", group)
    rng = random.Random(7)
    blocks, want = [], []
    for file in range(5):
        tokens = []
        for n in range(25):
            size = rng.choice([0, 0, 1, 5, 90])
            want.append((file, n, len(tokens), size, True))
            tokens += [rng.randrange(END) for _ in range(size)] + [END]
        if file % 2:
            want.append((file, 25, len(tokens), 30, False))
            tokens += [1] * 30
        blocks += cut(rng, tokens, file)
    blocks += [(9, 0, None), (9, 1, b"")]
    rng.shuffle(blocks)
    df = spark.createDataFrame(blocks, "file long, block long, content binary").repartition(4)
    assert sorted(map(tuple, tc.scan(df, END).collect())) == sorted(want)


def test_written_files_hold_what_the_tokenizer_gives(spark, documents, clashing):
    vocabulary = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
    texts = ["Hello world, hello again.", "", None, "é" * 50, "word " * 30_000, "<|endoftext|>"]
    docs = clashing(documents([(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (None, "x", "s")])).repartition(3)
    path = fresh_path(spark, "tokens")
    tc.write_token_files(docs, path, vocabulary, public_tokenizers.PATTERN, 50256, block_tokens=1000)
    blocks, order = tc.read_token_files(spark, path)
    got = sorted((str(r.doc_id), r.n_tokens) for r in tc.scan(blocks, 50256).join(order, ["file", "ordinal"]).collect())
    encoding = tc.load_encoding(vocabulary, public_tokenizers.PATTERN)
    own = [len(encoding.encode_ordinary(t or "")) for t in texts]
    assert got == sorted([(str(i), n) for i, n in enumerate(own)] + [("0", own[0]), ("None", 1)])


def test_empty(spark, documents):
    empty = spark.createDataFrame([], "file long, block long, content binary")
    assert tc.scan(empty, END).count() == 0


def test_large_ids_beside_a_null_id(spark, documents):
    vocabulary = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
    ids = [2 ** 53 + 1, None, 2 ** 53 + 3]
    path = fresh_path(spark, "tokens")
    tc.write_token_files(documents([(i, "word", "s") for i in ids]).coalesce(1), path, vocabulary, public_tokenizers.PATTERN, 50256)
    blocks, order = tc.read_token_files(spark, path)
    assert {r.doc_id for r in tc.scan(blocks, 50256).join(order, ["file", "ordinal"]).collect()} == set(ids)
