import random
import re
import unicodedata

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridproof.llm import wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def mine():
    return wordbpe.vocabulary(PATH)


def same(mine, library, texts):
    for text, ids in zip(texts, mine.encode(pa.array(texts, pa.string())), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_cased_letters_before_marks(mine, library):
    cased = [chr(c) for c in range(0x110000) if chr(c).lower() != chr(c) or chr(c).upper() != chr(c)]
    cased += list("İ̇ͅΣς")
    for mark in ".,!?":
        same(mine, library, [f"a{c}{mark} {c}{mark}{c} x{c}{mark}" for c in cased])
    same(mine, library, ["İ.", "TAŞDELENİ.", "Bİ, x", "ΟΣ. ΣΣ!"])


def test_plain_letters(mine, library):
    plain = [c for c in map(chr, range(0x10000)) if re.match(f"[{re.sub(r'.x.([0-9a-f]+).', lambda m: chr(92) + 'u' + m[1].rjust(4, '0'), wordbpe.PLAIN)}]", c)]
    assert len(plain) > 30000 and not {"\x00", "\x0b", "İ", "́"} & set(plain)
    assert all(unicodedata.normalize("NFC", c) == c for c in plain)
    same(mine, library, [" ".join(f"{c} a{c}1{c}{c}'s b{c}." for c in plain[k : k + 500]) for k in range(0, len(plain), 500)])


def test_every_token_is_the_encoding_of_its_bytes(mine):
    """By the list of merges alone; then ranks of bytes are the same as the list."""
    import json

    with open(PATH, encoding="utf-8") as f:
        pairs = [tuple(p) if isinstance(p, list) else tuple(p.split(" ")) for p in json.load(f)["model"]["merges"]]
    rank = {p: k for k, p in enumerate(pairs)}
    for a, b in pairs:
        token, end = (a + b).removesuffix("</w>"), (a + b).endswith("</w>")
        parts = list(token)
        if end:
            parts[-1] += "</w>"
        while len(parts) > 1:
            least = min(range(len(parts) - 1), key=lambda k: rank.get((parts[k], parts[k + 1]), len(rank)))
            assert (parts[least], parts[least + 1]) in rank, a + b
            parts[least : least + 2] = [parts[least] + parts[least + 1]]


def test_odd_texts(mine, library):
    r = random.Random(5)
    stock = "aAeEé ßç \t\n\r\x00\x0b\x0c\x1c\x85 　'sstd'll,.;!?0123456789½²٣日本キ\U0001d4b3\U0001f600́‍İİΣẞ각-_<|endoftext|>ΩÅ"
    texts = ["", " ", "<|endoftext|>", "x<|endoftext|> y", "a" * 3000, "=" * 777, "Ab1" * 900]
    same(mine, library, texts + ["".join(r.choice(stock) for _ in range(r.randint(1, 60))) for _ in range(6000)])
    letters = [t for t in mine.library.get_vocab() if t.isascii() and "|" not in t]
    same(mine, library, ["".join(r.choice(letters).replace("</w>", "") for _ in range(r.randint(1, 12))) for _ in range(20000)])
    assert [x.tolist() for x in mine.encode(pa.array([None, "a"], pa.string()))] == [[], library.encode("a", add_special_tokens=False).ids]
