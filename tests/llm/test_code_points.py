"""Every code point that is assigned or not, alone and between others, against the tokenizers library."""

import random
import unicodedata

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from kinfold.llm.bpe import Tokenizer


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path("word_bpe_49k.json")
    return Library.from_file(path), Tokenizer.from_file(path)


def test_all_code_points(both):
    library, own = both
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    for lot in range(0, len(points), 50_000):
        texts = ["".join(("a", x, "!", x, "B", x)) for x in points[lot : lot + 50_000]]
        for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert own.encode(text) == want.ids, hex(ord(text[1]))


def test_mixed_code_points(both):
    library, own = both
    rng = random.Random(8)
    odd = [chr(c) for c in range(0x558, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn"]
    for _ in range(2000):
        text = "".join(rng.choice([rng.choice(odd), rng.choice("aB'sé ßᲉꟋ1 !\U00010d50́")]) for _ in range(12))
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want, ascii(text)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)
