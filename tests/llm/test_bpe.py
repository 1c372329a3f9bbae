import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridproof.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n=400, seed=5):
    r = random.Random(seed)
    stock = "aAeé ßç  \t\n\r\x0b\x0c\x1c\x1f\x85  　'sstd'll,.;!?0123456789½²٣日本語のテキスト𝒳😀🇫🇷́‍=-_<|endoftext|>"
    return ["", " ", "<|endoftext|>", "x<|endoftext|> y", "a" * 3000, "ab" * 1500, "=" * 777, " " * 300 + "x", *("".join(r.choice(stock) for _ in range(r.randint(1, 60))) for _ in range(n))]


def test_as_the_library(library):
    v, texts = bpe.vocabulary(PATH), odd_texts()
    pool = bpe.WordPool(v.encode, keep=50)
    for part in (texts[:100], texts[100:]):
        ids, counts = pool.texts([v.split(x) for x in part])
        at = 0
        for text, n in zip(part, counts, strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert ids[at : at + n].tolist() == want, repr(text)
            at += n
        assert v.decode(ids.astype(np.int64), counts) == [library.decode(library.encode(x, add_special_tokens=False).ids, skip_special_tokens=False) for x in part]


def test_rows(spark, library):
    rows = [(1, "the cat"), (1, "the cat"), (None, "x"), (2, None), (3, ""), (4, "words " * 30000)]
    df = spark.createDataFrame([(i, t, "mine", [9]) for i, t in rows], "doc_id long, text string, decoded string, ids array<int>")
    out = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in out) == sorted((i or 0, t or "") for i, t in rows)
    assert all(r.ids == library.encode(r.text or "", add_special_tokens=False).ids for r in out)
    assert bpe.decode(bpe.encode(df.where("false"), PATH), PATH).count() == 0


def test_query(spark, sf_dir, library):
    from gridproof.llm.q_bpe import op2_bpe

    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in op2_bpe(spark, sf_dir).collect()} == want


def test_long_words(library):
    r, v = random.Random(9), bpe.vocabulary(PATH)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    texts = ["".join(r.choices(base64, k=80_000)), "".join(r.choices("etaoinshr", k=20_000)), "".join(r.choices("01234567", k=5000)), "ab" * 4000 + "a", "=" * 5001, "日本語" * 900, "x" * bpe.LONG, "the" * 1500]
    for text in texts:
        start = time.process_time()
        ids, counts = v.encode([text])
        took = time.process_time() - start
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert took < 3, took
    ids, counts = v.encode(["short", texts[0], "w", texts[4], "end"])
    assert ids.tolist() == [i for x in ("short", texts[0], "w", texts[4], "end") for i in library.encode(x, add_special_tokens=False).ids]
