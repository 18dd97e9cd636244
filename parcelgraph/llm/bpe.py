"""Byte-pair encoding of single pre-tokens, with a memory of those already merged."""

from __future__ import annotations

import json
import re
import sys
import unicodedata

import numpy as np
import regex
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

#: White space as the tokenizer library's patterns read it (Unicode White_Space).
_SPACE = r"\p{White_Space}"
#: Fixed value: the split pattern of byte-level tokenizers, as published with their vocabularies.
BYTE_LEVEL = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?![^{_SPACE}])|{_SPACE}+"
#: The same characters for Python's own, faster pattern module, whose \s has four more.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Text between white space with at most one space before it, or white space: no pre-token of
#: BYTE_LEVEL spans two of these.
_CHUNKS = re.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
#: Marks that are a pre-token of their own after letters, whatever follows them.
_MARKS = frozenset(".,;:!?")
_ODD = re.compile("[\x1c-\x1f]")
_WORDS = re.compile(f"[^{_BLANK}]+")
#: What piece models have for a space.
_BLOCK = "\u2581"
#: Stands for the end of a word among the bytes of a pre-token.
_END = b"\xff"
#: Chunks or pre-tokens remembered (up to twice as many), and the longest that are; results don't
#: depend on it.
REMEMBERED, LONGEST = 300_000, 128


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in for each byte value in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others for the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _special(spec: dict) -> tuple[regex.Pattern | None, dict[str, int]]:
    ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that strip or normalise are not supported")
    found = regex.compile("(" + "|".join(map(regex.escape, sorted(ids, key=len, reverse=True))) + ")") if ids else None
    return found, ids


def whole_tokens(spec_json: str) -> list[str]:
    """The vocabulary strings that, standing alone as a pre-token, encode as exactly one token.

    Proved by merging each of them: a string that the vocabulary has, but that its own merges
    don't lead to, is left out, and so is one that is no valid UTF-8 by itself.
    """
    tok = Tokenizer.from_str(spec_json)
    back = {c: b for b, c in byte_alphabet().items()}
    out = []
    for s in json.loads(spec_json)["model"]["vocab"]:
        try:
            plain = bytes(back[c] for c in s).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if plain and len(tok.model.tokenize(s)) == 1:
            out.append(plain)
    return out


class _Memory(dict):
    """Values by piece. When REMEMBERED are held they become the older half, which is asked before
    a value is made anew, and the half before that is forgotten: frequent pieces stay."""

    def __init__(self, start: dict, make):
        super().__init__(start)
        self.start, self.make, self.older, self.most = start, make, {}, REMEMBERED + len(start)

    def __missing__(self, piece):
        if len(piece) > LONGEST:
            return self.make(piece)
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
            self.update(self.start)
        value = self.older.get(piece)
        if value is None:
            value = self.make(piece)
        self[piece] = value
        return value


def _merger(spec: dict):
    """(merge, ids): merge(bytes of a pre-token) gives ranks, ids[rank] the vocabulary's ids.

    The vocabulary's merges, in their order, become the ranks of tiktoken's merge loop, which does
    single pieces several times faster than a general encoder. Where the vocabulary marks word
    ends, the byte 255, which UTF-8 has nowhere, stands for the mark: joining it to the letter before
    it ranks first of all, which gives the marked letters that the merges start from.
    """
    model, mark = spec["model"], spec["model"]["end_of_word_suffix"] or ""
    back = {c: b for b, c in byte_alphabet().items()}

    def raw(token: str) -> bytes:
        ends = bool(mark) and token.endswith(mark)
        return bytes(back[c] for c in (token.removesuffix(mark) if ends else token)) + _END * ends

    first = 512
    ranks = {bytes([b]) + _END: b for b in range(256)} if mark else {}
    for k, (left, right) in enumerate(model["merges"]):
        ranks.setdefault(raw(left) + raw(right), first + k)
    single = first + len(model["merges"])
    ranks |= {bytes([b]): single + b for b in range(256)}
    ids = np.zeros(single + 256, "<u4")
    for token, i in model["vocab"].items():
        if (rank := ranks.get(raw(token))) is not None:
            ids[rank] = i
    merge = tiktoken.Encoding("merges", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return (lambda piece: merge(piece + _END)) if mark else merge, ids


def _plain_library(spec_json: str) -> Tokenizer:
    library = Tokenizer.from_str(spec_json)
    library.encode_special_tokens = True
    return library


class ByteLevelCounter:
    """Counts tokens of texts under a byte-level tokenizer without normalisation.

    Chunks with characters that are unassigned or in ``unsure`` (see :func:`unsure_characters`) are
    counted by the library itself.
    """

    def __init__(self, spec_json: str, whole: list[str], unsure: frozenset[str] | None = None):
        spec = json.loads(spec_json)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"]:
            raise ValueError("a byte-level tokenizer without normaliser and prefix space is needed")
        self.special, _ = _special(spec)
        pieces, whole = regex.compile(BYTE_LEVEL).findall, dict.fromkeys(whole, 1)
        merge, _ = _merger(spec)
        unsure, library = unsure_characters(spec_json) if unsure is None else unsure, _plain_library(spec_json)

        def count(chunk: str) -> int:
            if _odd(chunk, unsure):
                return len(library.encode(chunk, add_special_tokens=False).ids)
            if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):  # one pre-token
                return whole.get(chunk) or len(merge(chunk.encode()))
            if chunk[-1] in _MARKS and (head := chunk[:-1])[1:].isalpha() and (head[0] == " " or head[0].isalpha()):
                return self.known[head] + self.known[chunk[-1]]
            return sum(whole.get(p) or len(merge(p.encode())) for p in pieces(chunk))

        self.known = _Memory(whole, count)

    def __call__(self, text: str) -> int:
        parts = self.special.split(text) if self.special and "<" in text else [text]
        return len(parts) // 2 + sum(sum(map(self.known.__getitem__, _CHUNKS.findall(p))) for p in parts[::2])


class ByteLevelEncoder:
    """Encodes texts under a byte-level tokenizer without normalisation; the strings of special
    tokens are plain text. Ids are little-endian unsigned 16-bit integers. ``unsure``: see
    :class:`ByteLevelCounter`."""

    def __init__(self, spec_json: str, unsure: frozenset[str] | None = None):
        spec = json.loads(spec_json)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"]:
            raise ValueError("a byte-level tokenizer without normaliser and prefix space is needed")
        pieces = regex.compile(BYTE_LEVEL).findall
        merge, ids = _merger(spec)
        codes = [i.astype("<u2").tobytes() for i in ids].__getitem__
        unsure, library = unsure_characters(spec_json) if unsure is None else unsure, _plain_library(spec_json)

        def encode(chunk: str) -> bytes:
            if _odd(chunk, unsure):
                return np.array(library.encode(chunk, add_special_tokens=False).ids, "<u2").tobytes()
            if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):  # one pre-token
                return b"".join(map(codes, merge(chunk.encode())))
            if chunk[-1] in _MARKS and (head := chunk[:-1])[1:].isalpha() and (head[0] == " " or head[0].isalpha()):
                return self.known[head] + self.known[chunk[-1]]
            return b"".join(b"".join(map(codes, merge(p.encode()))) for p in pieces(chunk))

        self.known = _Memory({}, encode)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, _CHUNKS.findall(text)))


def unsure_characters(spec_json: str) -> frozenset[str]:
    """The assigned characters that Python and the library treat differently, as their tables are of
    different versions of Unicode: normalised, put in order after other marks, or split otherwise.

    Tried out one by one; a second or two.
    """
    spec, library = json.loads(spec_json), Tokenizer.from_str(spec_json)
    steps = spec["pre_tokenizer"].get("pretokenizers")
    pieces = regex.compile(steps[0]["pattern"]["Regex"].replace(r"\s", _SPACE) if steps else BYTE_LEVEL).findall
    split = library.pre_tokenizer.pre_tokenize_str
    normal, lower = str, str
    if spec["normalizer"]:
        normal, lower = library.normalizer.normalize_str, lambda text: "".join(map(str.lower, unicodedata.normalize("NFC", text)))
    found: set[str] = set()
    for c in map(chr, [*range(128, 0xD800), *range(0xE000, sys.maxunicode + 1)]):
        if unicodedata.category(c) in ("Cn", "Co") or c in _REGULAR:
            continue
        tried = [c, c + "\u0334", "\u0315" + c] if unicodedata.combining(c) else [c]
        low = lower(c)
        if any(normal(t) != lower(t) for t in tried) or (not c.isspace() and len(split("a" + low + "1")) != len(pieces("a" + low + "1"))):
            found.update((c, *low))
    return frozenset(found)


def _odd(text: str, unsure: frozenset[str]) -> bool:
    """Whether only the library can tell how ``text`` is read."""
    return not text.isascii() and (not unsure.isdisjoint(text) or "Cn" in map(unicodedata.category, text))


class _Regular:
    """Ideographs and syllables that all versions in question treat alike."""

    def __contains__(self, c: str) -> bool:
        return "\u4e00" <= c <= "\u9fd0" or "\uac00" <= c <= "\ud7a3" or "\u3400" <= c <= "\u4db5" or "\U00020000" <= c <= "\U0002a6d6"


_REGULAR = _Regular()


def piece_bytes(processor: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each piece: a byte piece's byte, or its text with spaces for U+2581."""
    out = []
    for k in range(processor.get_piece_size()):
        piece = processor.id_to_piece(k)
        if processor.is_byte(k):
            out.append(bytes([int(piece[3:5], 16)]))
        else:
            out.append(b"" if processor.is_control(k) else piece.replace(_BLOCK, " ").encode())
    return out


class PieceEncoder:
    """Encodes texts under a model of pieces that puts a space before them; ids are little-endian
    unsigned 16-bit integers. None where the tokens' bytes are not those of space + text.

    Where no piece has a space after another character (looked up once), spaces and what follows
    them encode by themselves; such chunks are remembered.
    """

    def __init__(self, model: bytes):
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        texts, blank = piece_bytes(library), np.array([library.piece_to_id(_BLOCK)], "<u2").tobytes()
        cuts = all(_BLOCK not in library.id_to_piece(k).lstrip(_BLOCK) for k in range(library.get_piece_size()))
        self.chunks = re.compile(" +[^ ]*" if cuts else "(?s:.+)").findall

        def encode(chunk: str) -> bytes | None:
            if chunk == " ":
                return blank
            ids = library.encode(chunk[1:])
            return np.array(ids, "<u2").tobytes() if b"".join(map(texts.__getitem__, ids)) == chunk.encode() else None

        self.known = _Memory({}, encode)

    def __call__(self, text: str) -> bytes | None:
        found = list(map(self.known.__getitem__, self.chunks(" " + text)))
        return None if None in found else b"".join(found)


class WordEncoder:
    """Encodes texts under a lower-casing tokenizer whose pieces end in a word-end mark.

    Texts with characters that are unassigned or in ``unsure`` (see :func:`unsure_characters`) are
    encoded by the library itself.
    """

    def __init__(self, spec_json: str, unsure: frozenset[str] | None = None):
        unsure = unsure_characters(spec_json) if unsure is None else unsure
        spec = json.loads(spec_json)
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"] or level["use_regex"]:
            raise ValueError("an NFC, white-space and lower-case normaliser before a split is needed")
        self.special, self.ids = _special(spec)
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", _SPACE)).findall
        merge, ids = _merger(spec)
        codes = [i.tobytes() for i in ids].__getitem__
        library = Tokenizer.from_str(spec_json)

        def encode(word: str) -> bytes | None:
            if _odd(word, unsure):
                return None
            if word.isalpha():  # one pre-token
                return b"".join(map(codes, merge(word.encode())))
            if word[-1] in _MARKS and word[:-1].isalpha():
                return self.known[word[:-1]] + self.known[word[-1]]  # no letter of it is unsure
            return b"".join(b"".join(map(codes, merge(p.encode()))) for p in self.pieces(word))

        self.known, self.library = _Memory({}, encode), library

    def _plain(self, text: str) -> bytes:
        low = text if text.isascii() else unicodedata.normalize("NFC", text)
        # a sigma ends words differently in str.lower(); the library lowers each character alone
        low = low.lower() if "Σ" not in low else "".join(map(str.lower, low))
        codes = list(map(self.known.__getitem__, low.split() if not _ODD.search(low) else _WORDS.findall(low)))
        if None in codes:  # the library's own tables decide
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(codes)

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not (self.special and "<|" in text):
            return self._plain(text)
        parts = self.special.split(text)
        return b"".join(self._plain(p) if k % 2 == 0 else np.array([self.ids[p]], "<u4").tobytes() for k, p in enumerate(parts))


_kept: dict = {}


def kept(key: tuple, make):
    """The encoder of this key that the worker process holds, made once for all of its tasks."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]
