"""Certain cuts in a text: places that no token of a vocabulary can span.

A byte pair that occurs inside no vocabulary token can never be joined by a merge, since every merge makes a token
that holds the pair. Texts are cut at such pairs, and each fragment is encoded by itself; fragments repeat, so a
bounded cache in each worker answers nearly all of them.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import pairwise

import numpy as np
import regex

from .common import TwoGenerations

#: What the pre-tokenizer's ``\\s`` takes: Unicode's white space. U+001C to U+001F, which Python strips, aren't.
_SPACES = [c.encode() for c in map(chr, range(0x3001)) if regex.match(r"\p{White_Space}", c)]
_ASCII_SPACE = [s[0] for s in _SPACES if len(s) == 1]
#: Last bytes of the UTF-8 forms of white space beyond ASCII.
_SPACE_ENDS = sorted({s[-1] for s in _SPACES if len(s) > 1})


def pairs_inside(tokens: list[bytes]) -> np.ndarray:
    """256 x 256 booleans: whether a byte pair occurs inside any token."""
    seen = np.zeros((256, 256), dtype=bool)
    for t in tokens:
        if len(t) > 1:
            b = np.frombuffer(t, dtype=np.uint8)
            seen[b[:-1], b[1:]] = True
    return seen


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def cut_positions(data: np.ndarray, offsets: np.ndarray, never: np.ndarray) -> np.ndarray:
    """Sorted starts of fragments, and the end: all forced cuts, and the starts of the texts."""
    if len(data) == 0:
        return np.zeros(1, dtype=np.int64)
    code = data[:-1].astype(np.int32)
    code <<= 8
    code |= data[1:]
    cut = np.empty(len(data) + 1, dtype=bool)
    cut[0] = cut[-1] = True
    np.take(never.reshape(-1), code, out=cut[1:-1])
    cut[offsets] = True
    return np.flatnonzero(cut)


class ByteBpe:
    """A byte-level BPE of the tokenizers library, run over fragments.

    ``encode(data, offsets)`` gives each text's ids as little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str, cache: int = 150_000):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        back = _byte_of_char()
        vocab = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in back for c in token) and token not in {a["content"] for a in spec["added_tokens"]}}
        self.specials = {a["content"].encode(): a["id"] for a in spec["added_tokens"]}
        self.whole = Tokenizer.from_file(path)
        size = 1 + max([*vocab.values(), *self.specials.values()])
        self.tokens: list[bytes] = [b""] * size
        for t, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = t
        never = ~pairs_inside(list(vocab))
        # The pre-tokenizer looks ahead only from a run of white space, and takes an apostrophe as the start of a
        # contraction only where no run of punctuation holds it: no cut there.
        for b in _ASCII_SPACE:
            never[b, [x for x in range(256) if x not in _ASCII_SPACE]] = False
        never[:, 0x27] = False
        never[:, 0x80:0xC0] = False  # inside a character
        self.never = never
        self._late = np.zeros(256, dtype=bool)
        self._late[_SPACE_ENDS] = True
        self._space = np.zeros(256, dtype=bool)
        self._space[_ASCII_SPACE] = True
        self._exact = self._same_as_ranks(tiktoken, spec, vocab)
        self.cache = TwoGenerations(self._one, cache)
        self._lens = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self._blob = np.frombuffer(b"".join(self.tokens) or b"\0", dtype=np.uint8)
        digits = [b"%d," % i for i in range(size)]
        self._digit_lens = np.array([len(t) for t in digits], dtype=np.int64)
        self._digit_blob = np.frombuffer(b"".join(digits), dtype=np.uint8)

    def _same_as_ranks(self, tiktoken, spec, vocab):
        """A rank-based encoder if merges are in the order of ids, which makes both the same; else None."""
        merges = spec["model"]["merges"]
        order = [vocab.get(bytes(_BACK[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))) for m in merges]
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(x is None for x in order) or any(a >= b for a, b in pairwise(order)):
            return None
        import public_tokenizers

        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={})

    def _one(self, fragment: bytes) -> bytes:
        text = fragment.decode("utf-8", "replace")
        ids = self._exact.encode_ordinary(text) if self._exact else self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        at = cut_positions(data, offsets, self.never)
        inner = at[1:-1]
        if len(inner):
            left, right = data[inner - 1], data[inner]
            doubt = self._late[left] & ~self._space[right] & (data[np.maximum(inner - 2, 0)] != 0xC3)
            if doubt.any():
                doubt &= ~np.isin(inner, offsets)
                at = np.concatenate([at[:1], inner[~doubt], at[-1:]])
        return at

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        body = data.tobytes()
        if any(s in body for s in self.specials):
            return [self._with_specials(body[a:b]) for a, b in pairwise(offsets.tolist())]
        return self._plain(body, data, offsets)

    def _plain(self, body: bytes, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        at = self.starts(data, offsets)
        places = at.tolist()
        get = self.cache.__getitem__
        first = np.searchsorted(at, offsets).tolist()
        return [b"".join([get(body[s:e]) for s, e in zip(places[a:b], places[a + 1 : b + 1])]) for a, b in pairwise(first)]

    def _with_specials(self, text: bytes) -> bytes:
        """A text that may hold special strings: cut there first, as the library does (leftmost, longest)."""
        import re

        out = []
        for part in re.split(b"(" + b"|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + b")", text):
            if part in self.specials:
                out.append(np.array([self.specials[part]], dtype="<u4").tobytes())
            elif part:
                out += self._plain(part, np.frombuffer(part, dtype=np.uint8), np.array([0, len(part)]))
        return b"".join(out)

    @staticmethod
    def _gather(ids: np.ndarray, lens: np.ndarray, ends: np.ndarray, blob: np.ndarray) -> np.ndarray:
        n = lens[ids]
        stop = np.cumsum(n)
        where = np.repeat(ends[ids] - stop, n)
        where += np.arange(len(where))
        return blob[where]

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become replacement characters, as in the library."""
        ids = np.frombuffer(packed, dtype="<u4")
        return self._gather(ids, self._lens, self._ends, self._blob).tobytes().decode("utf-8", "replace")

    def decimals(self, packed: bytes) -> bytes:
        """The ids in decimal, joined by commas."""
        ids = np.frombuffer(packed, dtype="<u4")
        return self._gather(ids, self._digit_lens, self._digit_ends, self._digit_blob).tobytes()[:-1]

    @property
    def _ends(self) -> np.ndarray:
        if not hasattr(self, "_e"):
            self._e = np.cumsum(self._lens)
        return self._e

    @property
    def _digit_ends(self) -> np.ndarray:
        if not hasattr(self, "_de"):
            self._de = np.cumsum(self._digit_lens)
        return self._de


_BACK = _byte_of_char()


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder a worker process; its cache lives as long as the worker."""
    return ByteBpe(path)


class PieceCounter:
    """Token counts of a sentencepiece BPE model, by fragments.

    The model joins pieces over the whole text, with white space as an ordinary character, so a character pair that
    occurs in no piece is a certain cut. The library's own prefix space is put before each text, and fragments are
    encoded without a prefix.
    """

    def __init__(self, path: str, cache: int = 150_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(open(path, "rb").read())
        spec = model.normalizer_spec
        self.prefix = b" " if spec.add_dummy_prefix else b""
        self.by_fragment = spec.name == "identity" and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and model.trainer_spec.model_type == model.trainer_spec.BPE and not model.trainer_spec.treat_whitespace_as_suffix and not any(p.type == p.USER_DEFINED for p in model.pieces)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        pieces = [p.piece.replace("▁", " ") for p in model.pieces if p.type == p.NORMAL]
        inside = np.zeros((256, 256), dtype=bool)
        for a, b in {(x, y) for p in pieces for x, y in pairwise(p)}:
            inside[a.encode()[-1], b.encode()[0]] = True
        self.never = ~inside
        self.never[:, 0x80:0xC0] = False
        self.cache = TwoGenerations(self._one, cache)

    def _one(self, fragment: bytes) -> int:
        return len(self.bare.encode(fragment.decode("utf-8", "replace"), num_threads=1))

    def fragments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """All fragments in order, and where each text's begin. Texts must have been prepared."""
        at = cut_positions(data, offsets, self.never)
        body, places = data.tobytes(), at.tolist()
        return [body[s:e] for s, e in pairwise(places)], np.searchsorted(at, offsets)

    def prepare(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with the prefix before each that isn't empty, and the visible space mark as a space."""
        body = data.tobytes()
        parts = [body[a:b] for a, b in pairwise(offsets.tolist())]
        if b"\xe2\x96\x81" in body:
            parts = [p.replace(b"\xe2\x96\x81", b" ") for p in parts]
        parts = [self.prefix + p if p else p for p in parts]
        return np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def counts(self, data: np.ndarray, offsets: np.ndarray, frequent: dict[bytes, int]) -> np.ndarray:
        """Tokens of each text: first the table of frequent fragments, then the cache, which encodes what it misses."""
        if not self.by_fragment:
            body = data.tobytes()
            return np.array([len(self.library.encode(body[a:b].decode("utf-8", "replace"), num_threads=1)) for a, b in pairwise(offsets.tolist())], dtype=np.int64)
        found, first = self.fragments(*self.prepare(data, offsets))
        known, miss = frequent.get, self.cache.__getitem__
        each = np.fromiter((known(f) or miss(f) for f in found), dtype=np.int64, count=len(found))
        total = np.concatenate([[0], np.cumsum(each)])
        return total[first[1:]] - total[first[:-1]]


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)
