"""Token counts against the tokenizers library."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridproof.llm import bpe, tokencounts

from .test_bpe import odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def n_tokens(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


SPACED = [
    "a  b", "a \n b", "a\n\nb", "a\n \nb  ", "   a", "  \n", " a  1  !  ", "x\xa0\xa0y \xa0z", "\ta\t\tb", "it's  we'LL 'tis ''s", "12 34ab  56", "no\x00nul \x00", "é è  ÀÉ ñ½²", "日本  語 ，テ", "<| endoftext |>", "a<|endoftext|>  <|endoftext|>b",
]


@pytest.mark.parametrize("frequent", [1, 40, tokencounts.FREQUENT])
def test_cases(spark, library, frequent):
    texts = [*SPACED, *odd_texts(200), None, None, "", "same row", "same row", "word " * 30000, "z" * 5000, "=" * 70 + " " + "=" * 70, "q" * 64 + " " + "q" * 65]
    rows = [(None if k % 50 == 7 else k // 2, t, "mine", 9) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `n_bytes` string, `key` int").repartition(3)
    got = tokencounts.counts(docs, PATH, frequent=frequent).collect()
    some = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(some, got)) == sorted(some((i, len((t or "").encode()), n_tokens(library, t))) for i, t, _, _ in rows)
    assert tokencounts.counts(docs.where("false"), PATH).count() == 0


def test_kept_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x y", "the text"), (None, None, None, None)], "key long, `row` string, `odd.name` string, text string")
    got = tokencounts.counts(docs, PATH, keep=("odd.name", "key", "row"), frequent=1)
    assert got.columns == ["odd.name", "key", "row", "n_bytes", "n_tokens"]
    assert {tuple(r) for r in got.collect()} == {("x y", 1, "a b", 8, 2), (None, None, None, 0, 0)}
    with pytest.raises(ValueError):
        tokencounts.counts(docs.withColumn("N_bytes", docs.key), PATH, keep=("N_bytes",))


def test_pretokens_are_counted_once(spark, library):
    docs = spark.createDataFrame([(k, "the same words the same " + "long" * 40) for k in range(30)], "doc_id long, text string").repartition(5)
    found = tokencounts.dictionary(docs, PATH).collect()
    assert sorted(r.times for r in found) == [30, 30, 30, 30, 60]
    assert {r.key: r.pieces for r in found if not r.key.startswith("\x00")} == {w: n_tokens(library, w) for w in ("the", " same", " words", " the")}


def test_cut_is_the_published_one():
    import pyarrow as pa

    v = bpe.vocabulary(PATH)
    for text in [*SPACED, *odd_texts(400, seed=8)]:
        words, index, of = tokencounts.pretokens(v, pa.array([text, "and another"]))
        assert [words[int(k)].as_py() for k, o in zip(index, of, strict=True) if o == 0] == v.split(text), repr(text)


def test_query(spark, sf_dir, library):
    from gridproof.llm.q_tokencounts import op13_token_counts

    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n = n_tokens(library, r.text)
        want.add((r.doc_id, len((r.text or "").encode()), n, n > 1024))
    got = op13_token_counts(spark, sf_dir)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert {tuple(r) for r in got.collect()} == want
