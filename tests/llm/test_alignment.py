"""Alignment of two tokenizers against the same written out pair by pair."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from parcelgraph.llm import alignment, bpe

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, a int, b string, key int, n_links string, groups int"


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(BYTE)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PIECE)


def brute(rows, libraries):
    first, second = libraries
    back = {c: b for b, c in bpe.byte_alphabet().items()}
    vocab = {v: bytes(back[c] for c in k) if all(c in back for c in k) else b"?" for k, v in json.load(open(BYTE, encoding="utf-8"))["model"]["vocab"].items()}

    def piece(k):
        p = second.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if second.is_byte(k) else p.replace("▁", " ").encode()

    made = []
    for i, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        raw = b" " + text.encode() if text else b""
        if b"".join(vocab[x] for x in a) != raw or b"".join(piece(x) for x in b) != raw:
            a, b = [], []
        ends = [np.cumsum([len(of(x)) for x in ids]).tolist() for of, ids in ((vocab.get, a), (piece, b))]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups = defaultdict(lambda: ([], []))
        for side, ids in enumerate((a, b)):
            for x, e in zip(ids, ends[side], strict=True):
                groups[next(c for c in both if c >= e)][side].append(x)
        made.append((i, a, b, [groups[c] for c in both]))
    count = Counter()
    for _, _, _, groups in made:
        count.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = Counter()
    for i, a, b, groups in made:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[(i, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), text)] += 1
    return out


def test_encoder_is_the_library(libraries):
    encode = bpe.ByteLevelEncoder(open(BYTE, encoding="utf-8").read())
    draw = random.Random(5)
    alphabet = ["a", "b", "The", " ", "  ", "\n", "\t", ".", "!?", "'s", "1", "é", "İ", "ß", "́", "\x00", "\x1c", "͸", "　", "\x85", "▁", "<|endoftext|>", "日本", "😀", "‍", "_"]
    for _ in range(5000):
        text = "".join(draw.choices(alphabet, k=draw.randrange(1, 12)))
        assert np.frombuffer(encode(text), "<u2").tolist() == libraries[0].encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("small", [False, True])
def test_aligned(spark, libraries, monkeypatch, small):
    draw = random.Random(7)
    words = ["alignment", "of", "tokenizers,", "ünïcödé", "日本語テキスト", "x" * 40, "<|endoftext|>", "</s>", "\n\n", "\t", "1234567", "don't", "😀😀", "  "]
    rows = [(k, " ".join(draw.choices(words, k=draw.randrange(1, 30)))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, " "), (103, "a▁b"), (104, "a\x00b"), (105, "same text"), (105, "same text"), (None, "same text"), (106, "a " * 3000), (107, "ﬁ½ Å \x85 　"), (108, "é́")]
    rows += [(109, "y" * 2000 + "é" * 500)]
    if small:  # many blocks, slices of links and kept partial counts
        for name, n in (("_LINKS", 50), ("_TOKENS", 40), ("_HELD", 30), ("_SHARD", 100)):
            monkeypatch.setattr(alignment, name, n)
    docs = spark.createDataFrame([(i, t, 1, "x", 2, "y", 3) for i, t in rows], DOCS).repartition(3)
    with alignment.aligned(docs, BYTE, PIECE) as found:
        got = Counter(tuple(r) for r in found.collect())
    assert got == brute(rows, libraries)
    with alignment.aligned(docs.where("false"), BYTE, PIECE) as found:
        assert found.collect() == []


def test_query_derives_the_digest(spark, libraries, tmp_path):
    from parcelgraph.llm import queries

    rows = [(1, "one text, two"), (2, ""), (3, None), (4, "one text")]
    spark.createDataFrame([(i, t, 1, "x", 2, "y", 3) for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op11_alignment"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = Counter((*k[:-1], hashlib.sha256(k[-1].encode()).hexdigest() if k[-1] else "") for k in brute(rows, libraries))
    assert Counter(tuple(r) for r in found.collect()) == want
