import random
import re
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from gridproof.llm import training_order as O

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation(n):
    order = O.Order(n, 7)
    slots = order.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert order.number(slots).tolist() == list(range(n))
    if n >= 1000:
        assert (slots != O.Order(n, 8).slot(np.arange(n))).any()


def whole(rows, folder, length, shard):
    """The sequences by their numbers, as read back from the shards."""
    read = list(O.read(folder, 0, length, shard))
    assert len(read) == len(rows) and sorted(r.slot for r in rows) == list(range(len(rows)))
    for r in rows:
        assert (r.shard, r.byte_offset) == (r.slot // shard, r.slot % shard * 2 * length)
        assert zlib.crc32(read[r.slot].tobytes()) == r.ids_crc32
    if len(rows) > 3:
        assert (next(O.read(folder, 3, length, shard)) == read[3]).all()
    return [(r, read[r.slot]) for r in sorted(rows, key=lambda r: r.number)]


def test_cases(spark):
    texts = [(1, "one two"), (None, None), (2, ""), (3, "long text " * 5000), (4, "same"), (4, "same"), (5, None)]
    df = spark.createDataFrame([(*t, 1, "x") for t in texts], "doc_id long, text string, shard int, path string").coalesce(1)
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = O.materialise(df, PATH, folder, length=16, shard=100).collect()
    ids = np.concatenate([x[: r.n_tokens] for r, x in whole(rows, folder, 16, 100)])
    e = O.encoding(PATH)
    assert ids.tolist() == [i for _, t in texts for i in [*e.encode_ordinary(t or ""), O.END_ID]]
    assert {d for r in rows for d in r.doc_ids} == {1, None, 2, 3, 4, 5}
    assert O.materialise(df.where("false"), PATH).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = tempfile.mkdtemp(prefix="spark-")
    done = whole(O.materialise(docs, PATH, folder).collect(), folder, O.SEQUENCE, O.SHARD)
    got = b"".join(x[: r.n_tokens].tobytes() for r, x in done)
    e = O.encoding(PATH)
    want = [np.array([*e.encode_ordinary(r.text or ""), O.END_ID], O.DTYPE).tobytes() for r in docs.collect()]
    assert sorted(got.split(np.array([O.END_ID], O.DTYPE).tobytes())) == sorted(b"".join(want).split(np.array([O.END_ID], O.DTYPE).tobytes()))
    from gridproof.llm.q_training_order import op5_training_order

    assert op5_training_order(spark, sf_dir).count() == len(done)


def test_short_rule_is_the_whole_rule():
    r = random.Random(11)
    stock = "aAeé ßç \t\n\r\x0b\x0c\x1c\x1f\x85  　'sstd'll,.;!?0129½²٣日本\U0001d4b3\U0001f600́-_"
    texts = ["", " ", "a ", " a", "\n", "a\nb", "don't", *("".join(r.choice(stock) for _ in range(r.randint(1, 30))) for _ in range(20000))]
    e = O.encoding(PATH)
    assert list(O.encoded(PATH, pa.array([None, *texts], pa.string()))) == [[], *map(e.encode_ordinary, texts)]
    assert e.encode_ordinary("a\x85b") != [] and sum(bool(re.search(r"\s\s", x)) for x in texts) < len(texts)


@pytest.mark.parametrize("counted", [{0: (0, 1)}, {0: (0, 400)}, {}])
def test_counts_that_differ_are_an_error(spark, counted):
    df = spark.createDataFrame([(1, "long text " * 500)], "doc_id long, text string").coalesce(1)
    with pytest.raises(Exception, match="sequences counted"):
        O._sequences(df, PATH, "text", "doc_id", 16, counted, O.Order(400, 1), 100).collect()
