import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.llm import fill_middle as fm
from gridcast.llm.queries import QUERIES

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)
MARKS = ("<P>", "<S>", "<M>")


def plain_version(doc_id, text):
    """The contract, said the short way."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some_text(rng, size):
    alphabet = "aZbY  \n.,9<>PSMé中😀ß́"
    return "".join(rng.choice(alphabet) * rng.choice((1, 1, 1, 5)) for _ in range(size))


def test_located_equals_plain_counts():
    rng = random.Random(1)
    memo = fm.Memo()
    for _ in range(200):
        text = some_text(rng, rng.randrange(0, 400))
        units = UNIT.findall(text)
        # Tiny chunks, so that cuts fall inside words and between all kinds of neighbours.
        one = fm.Located(text.encode(), memo, mask_bits=2, least=rng.choice((1, 3, 16)))
        assert one.n == len(units) and one.n_chars == len(text)
        assert [one.chars_before(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_chunks_follow_content_and_never_split_a_code_point():
    rng = random.Random(2)
    shared = some_text(rng, 20_000).encode()

    def chunks(data):
        ends = fm.cuts(np.frombuffer(data, dtype=np.uint8))
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    one, two = chunks(b"x" * 777 + shared), chunks(some_text(rng, 500).encode() + shared + b"tail")
    for piece in one + two:
        piece.decode()
    assert b"".join(one) == b"x" * 777 + shared
    assert len(set(one) & set(two)) >= 0.8 * len(one) and len(one) > 10
    assert all(len(c) >= fm.MIN_CHUNK for c in one[:-1])


def test_the_hash_forgets_what_lies_far_back(monkeypatch):
    data = np.frombuffer(random.Random(3).randbytes(5000), dtype=np.uint8)
    assert (fm.rolling(data)[100:] == fm.rolling(data[50:])[50:]).all()
    whole = fm.cuts(data, 6, 16)
    monkeypatch.setattr(fm, "PIECE", 700)
    assert fm.cuts(data, 6, 16) == whole


def test_cache_verifies_by_content_and_stays_bounded():
    memo = fm.Memo(limit=4000)
    chunks = [(f"word{i} " * 40).encode() for i in range(50)]
    for _ in range(2):
        for chunk in chunks:
            assert memo(chunk) == fm.summarize(chunk)
            assert sum(len(c) + fm.ENTRY for held in (memo.young, memo.old) for c in held) <= 4000
    assert memo(chunks[-1]) == fm.summarize(chunks[-1]) and memo.hits >= 1
    giant = b"a" * 5000
    assert memo(giant) == (1, 5000, True, True) and giant not in memo.young


def test_transform_equals_plain_version(spark, documents, clashing):
    rng = random.Random(4)
    passage = some_text(rng, 3000)
    rows = [(i, some_text(rng, rng.randrange(1, 300)) + (passage if i % 3 == 0 else ""), "s") for i in range(120)]
    rows += [(200, None, "s"), (201, "", "s"), (None, "null id, twice", "s"), (None, "null id, twice", "s"), (202, "with <S> inside", "s"),
             (203, "a" * 300_000, "s"), (204, "1" * 300_000, "s"), (205, "中" * 50_000, "s"), (2 ** 53 + 1, "a large id", None), (2 ** 53 + 2, "another", None)]
    rows += rows[:3]
    df = clashing(documents(rows)).withColumn("n", F.lit("x")).withColumn("at.low", F.lit(1))
    found = fm.transform(df)
    got = found.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", fm.restored(F.col("output"), F.col("form")).alias("again")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_version(r.doc_id, r.text)
        assert r.again == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert found.select("size", "`at.low`").first() is not None


def test_empty_table(documents):
    assert fm.transform(documents([])).count() == 0


@pytest.mark.parametrize("text", ["<", "<<", "S>", "<P", "a<S", "<M", ">", "<P >", "P><S"])
def test_parts_that_look_like_marks(spark, documents, text):
    df = documents([(i, text * k, "s") for k in range(1, 4) for i in range(k * 40, k * 40 + 40)])
    found = fm.transform(df).select("text", fm.restored(F.col("output"), F.col("form")).alias("again")).collect()
    assert all(r.text == r.again for r in found)


def test_query_columns(spark, documents, tmp_path):
    documents([(i, f"Text number {i}, with words.", "s") for i in range(30)] + [(30, None, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_fill_middle"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    for r in got.collect():
        text = f"Text number {r.doc_id}, with words." if r.doc_id < 30 else ""
        n, form, prefix, middle, output = plain_version(r.doc_id, text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
