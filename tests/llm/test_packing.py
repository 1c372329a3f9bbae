import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gridproof.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, top=2048):
    lib = Tokenizer.from_file(PATH)
    want = sorted((i if i is not None else -1, np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t in docs)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id if r.doc_id is not None else -1].append(r)
        by_seq[r.sequence_id].append(r)
    for i, ids in want:
        mine = sorted(by_doc[i], key=lambda r: r.start)
        n = len(ids) // 4
        assert all(r.doc_tokens == n for r in mine if len([d for d in want if d[0] == i]) == 1)
        for r in mine:
            if len([d for d in want if d[0] == i]) == 1:
                assert zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        assert sum(r.length for r in mine) == sum(len(d[1]) // 4 for d in want if d[0] == i)
    padding = 0
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= top and own[0].sequence_tokens == at
        padding += 0 if at & (at - 1) == 0 else top - at
    assert padding == 0
    return by_seq


def test_cases(spark):
    docs = [(1, "Hello, World! naïve ΑΣ <|endoftext|> x"), (None, None), (2, ""), (3, "a b\x1c\x85c　d " * 4000), (4, "short"), (4, "short"), (5, None), (6, "é" * 5000)]
    df = spark.createDataFrame([(*d, 7, 7) for d in docs], "doc_id long, text string, start long, task long").repartition(3)
    by_seq = check(packing.pack(df, PATH).collect(), docs)
    assert len(by_seq) > 5
    assert packing.pack(df.where("false"), PATH).count() == 0


def test_query(spark, sf_dir):
    from gridproof.llm.q_packing import op1_packing

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = op1_packing(spark, sf_dir).collect()
    check(rows, docs)
    # step groups of a tier differ by one window at most
    steps = defaultdict(set)
    for r in rows:
        steps[r.sequence_tokens, r.step_group].add(r.sequence_id)
    for tier in {t for t, _ in steps}:
        sizes = [len(v) for (t, _), v in steps.items() if t == tier]
        assert max(sizes) - min(sizes) <= 1
