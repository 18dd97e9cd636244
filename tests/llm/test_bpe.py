"""The encoders against the library on strings made to trip them."""

import random

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from parcelgraph.llm import bpe

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["\x00", "(", ")", "..", "!!", "\x1c", "\x1f", "͸", "İ", "̖", "̀", "ΑΣ", "ς", "́", "e", "a", " ", "  ", "\n", "'s", "'", "1", "é", "ß", "﷐", "\U0010ffff", "", "K", "ǅ", "ﬁ", "‍", "<|endoftext|>", "<|", "᠎", "​", "\x85", "٣", "Ⅷ", "日本", "̈", "Å", "᷸", "ⷼ", "࣋"]


def strings(n, seed):
    draw = random.Random(seed)
    for _ in range(n):
        made = []
        for _ in range(draw.randrange(1, 9)):
            c = draw.choice([draw.randrange(0x300), draw.randrange(0x3000), draw.randrange(0x11000), draw.randrange(0x110000)])
            made.append(draw.choice(ODD) if draw.random() < 0.7 or 0xD800 <= c < 0xE000 else chr(c))
        yield "".join(made)


def test_words():
    library, encode = Tokenizer.from_file(WORD), bpe.WordEncoder(open(WORD, encoding="utf-8").read())
    wrong = [s for s in strings(40_000, 11) if np.frombuffer(encode(s), "<u4").tolist() != library.encode(s, add_special_tokens=False).ids]
    assert wrong == []


def test_bytes():
    library, spec = Tokenizer.from_file(BYTE), open(BYTE, encoding="utf-8").read()
    count, plain = bpe.ByteLevelCounter(spec, bpe.whole_tokens(spec)), Tokenizer.from_file(BYTE)
    plain.encode_special_tokens = True
    encode = bpe.ByteLevelEncoder(spec)
    for s in strings(40_000, 12):
        assert count(s) == len(library.encode(s, add_special_tokens=False).ids), repr(s)
        assert np.frombuffer(encode(s), "<u2").tolist() == plain.encode(s, add_special_tokens=False).ids, repr(s)


def test_pieces():
    model = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    library, encode = sentencepiece.SentencePieceProcessor(model_proto=model), bpe.PieceEncoder(model)
    texts = bpe.piece_bytes(library)
    draw = random.Random(13)
    words = [" ", "  ", "    ", "the", "\n", "\n\n", "a\tb", "<s>", "</s>", "<unk>", "<0x41>", "\u2581", ". The", "x" * 30, "hello world", "1 2", "\u00a0"]
    for s in [*strings(20_000, 14), *("".join(draw.choices(words, k=draw.randrange(1, 9))) for _ in range(20_000))]:
        ids = library.encode(s)
        want = np.array(ids, "<u2").tobytes() if b"".join(texts[k] for k in ids) == b" " + s.encode() else None
        assert encode(s) == want, repr(s)
