"""The pipeline's stages against brute force, each on what the stage before it kept."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from gridproof.llm import toxicity
from gridproof.llm.common import written

from . import brute
from .test_packing import check


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def stages(spark, docs, sf_dir):
    """Each stage's input and output as rows."""
    for name, stage in P.STAGES:
        done = written(stage(spark, docs, sf_dir), name)
        yield name, docs, done
        docs = done


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(i, t, None, None, None) for i, t in brute.CASES if i != 11], docs.schema)
    docs = written(docs.unionByName(extra.withColumn("doc_id", extra.doc_id + 100_000)), "documents")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for name, before, after in stages(spark, docs, sf_dir):
        old = [r.asDict() for r in before.collect()]
        if name != "packing":
            assert after.columns == docs.columns, name
        new = [tuple(r[c] for c in docs.columns) for r in after.collect()] if name != "packing" else after.collect()
        if name == "toxicity":
            model = toxicity.fit(docs, labels, ~toxicity.held_out())
            p = model.scores([r["text"] or "" for r in old], toxicity.Features())
            want = [tuple(r.values()) for r, x in zip(old, p, strict=True) if x < 0.7]
            assert len(want) < len(old)
        elif name == "minhash":
            want, seen = [], set()
            told = brute.near([(r["doc_id"], r["text"]) for r in old])
            for (i, _, root), r in sorted(zip(told, old, strict=True), key=lambda x: (x[1]["text"] is None, x[1]["text"] or "")):
                if i is None or i == root and i not in seen:
                    seen.add(i)
                    want.append(tuple(r.values()))
            assert len(want) < len(old)
        elif name == "substrings":
            want = []
            for r, (w, gone) in zip(old, brute.cut([r["text"] for r in old]), strict=True):
                if gone:
                    r["text"] = " ".join(x for k, x in enumerate(w) if k not in gone)
                    r["n_chars"] = len(r["text"])
                want.append(tuple(r.values()))
            assert any(r["text"] == "" for r in old) or any(gone for _, gone in brute.cut([r["text"] for r in old]))
        elif name == "secrets":
            # marks take the place of spans and nothing else
            assert len(new) == len(old)
            texts = {r["doc_id"]: r["text"] for r in old}
            for i, t, _, _, n in new:
                parts = (t or "").split("[REDACTED]")
                if len(parts) > 1:
                    assert texts[i].startswith(parts[0]) and texts[i].endswith(parts[-1]) and n == len(t)
                elif i is not None:
                    assert t == texts[i]
            continue
        else:
            check(new, [(r["doc_id"], r["text"]) for r in old])
            continue
        assert sorted(new, key=str) == sorted(want, key=str), name
    assert Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, before, after in stages(spark, docs.where("false"), sf_dir):
        assert after.count() == 0, name


def test_clashing_columns(spark, sf_dir):
    """Further columns stay as they are, also where an operator uses such a name itself."""
    names = ["__one", "__row", "__spans", "__text", "__bad", "__n_words", "n_words", "n_removed", "row", "spans", "bad", "doc", "own", "repo", "changed", "task", "scanned", "id", "kept", "text_"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain, extra = docs, docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    plain, extra = written(plain, "documents"), written(extra, "documents")
    for name, stage in P.STAGES[:-1]:
        plain, extra = written(stage(spark, plain, sf_dir), name), written(stage(spark, extra, sf_dir), name)
        assert extra.columns == [*docs.columns, *names], name
        got = extra.collect()
        assert rows(plain) == sorted((tuple(r[c] for c in docs.columns) for r in got), key=str), name
        assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in names), name
    assert P.STAGES[-1][1](spark, extra, sf_dir).count() == P.STAGES[-1][1](spark, plain, sf_dir).count()


def test_run(spark, sf_dir):
    assert P.run(spark, sf_dir).count() > 0
