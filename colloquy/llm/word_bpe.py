"""Encoding with a BPE of words that drops white space: texts are cut where no word of the tokenizer can go on.

The tokenizer composes characters, lowers case, drops white space, and takes contractions, runs of letters, single
digits and runs of anything else as words. Between two ASCII characters it is known whether a word ends; fragments
between such places are encoded by themselves, each once a batch, through a bounded cache in each worker. Of what it misses,
Latin words are split here and joined by ranks, or by the library's model beyond ASCII; all else goes through the library.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa

from .common import TwoGenerations
from .fragments import _byte_of_char, cut_positions


def word_ends() -> np.ndarray:
    """256 x 256 booleans: whether a word surely ends between two bytes.

    White space goes with what follows it, so a fragment is a word with the white space before. An apostrophe may start
    a contraction or stand in a run of signs: what follows it is cut off only if it is a digit or white space. Bytes
    beyond ASCII may be marks that compose with the character before, letters or signs: only white space cuts them off.
    """
    kind = np.full(256, ord("p"), np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = ord("s")
    kind[[*range(65, 91), *range(97, 123)]] = ord("l")
    kind[48:58] = ord("d")
    kind[39] = ord("q")
    kind[128:] = ord("h")
    ends = np.zeros((256, 256), dtype=bool)
    for pair in ("ls", "ds", "ps", "qs", "hs", "ld", "lp", "lq", "dl", "dd", "dp", "dq", "pl", "pd", "qd"):
        ends[np.ix_(kind == ord(pair[0]), kind == ord(pair[1]))] = True
    return ends


#: Letters of the Latin script that NFC leaves alone and that have one lower form.
_LETTERS = "".join(c for c in map(chr, range(0x180)) if c.isalpha() and c not in "\xaa\xb5\xba" and len(c.lower()) == 1 and unicodedata.normalize("NFC", c) == c)
_SIGNS = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
_SIGN = "".join(map(re.escape, _SIGNS))
#: Fragments of such letters, digits, signs and white space, and their words once they are lowered.
_PLAIN = re.compile(f"[{_LETTERS}0-9{_SIGN}\t-\r ]*")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[{_SIGN}]+")
_BYTES = {b: c for c, b in _byte_of_char().items()}
_AS_BYTES = {ord(c): "".join(_BYTES[b] for b in c.encode()) for c in _LETTERS if not c.isascii()}
#: Stand-ins for the last character of a word: capitals, as case is lowered; control characters for signs; a digit is always last.
_LAST = {chr(c): chr(c - 32) for c in range(97, 123)} | {str(d): str(d) for d in range(10)} | {c: chr(i) for i, c in enumerate(_SIGNS)}
#: The tokenizer's steps around its merges that ``_PLAIN`` and ``_LAST`` stand for.
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
LONGEST = 100


def plain_ranks(path: str):
    """An encoder of words of ASCII by ranks if the tokenizer splits words as here and merges are in the order of ids, which makes both the same; else None."""
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    model, end = spec["model"], spec["model"].get("end_of_word_suffix")
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if any(spec.get(k) != v for k, v in _STEPS.items()) or end != "</w>" or odd or None in merged or any(a >= b for a, b in pairwise(merged)):
        return None
    ranks = {}
    for token, i in model["vocab"].items():
        body = token.removesuffix(end)
        if body and all(c in _LAST for c in body):
            last = body[:-1] + _LAST[body[-1]] if body != token else body
            if body != token or not body.isdigit():
                ranks[last.encode()] = i
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}) if all(x.encode() in ranks for x in _LAST.values()) else None


class WordBpe:
    """A BPE of words of the tokenizers library, run over fragments.

    ``encode(data, offsets)`` gives each text's ids as little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str, cache: int = 150_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.specials = {t.content.encode(): i for i, t in self.whole.get_added_tokens_decoder().items()}
        self.special = re.compile(b"(" + b"|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + b")")
        self.ends = word_ends()
        self.ranks, self.model = plain_ranks(path), self.whole.model
        self.cache = TwoGenerations(self._one, cache)

    def _one(self, fragment: bytes) -> bytes:
        text = fragment.decode("utf-8", "replace")
        if self.ranks and len(text) <= LONGEST and _PLAIN.fullmatch(text):
            ids = [i for w in _WORDS.findall(text.lower()) for i in self._word(w)]
            return struct.pack(f"<{len(ids)}I", *ids)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> list[int]:
        if word.isascii():
            return self.ranks.encode_ordinary(word[:-1] + _LAST[word[-1]])
        return [t.id for t in self.model.tokenize(word.translate(_AS_BYTES))]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        body = data.tobytes()
        if any(s in body for s in self.specials):
            return [self._with_specials(body[a:b]) for a, b in pairwise(offsets.tolist())]
        return self._plain(body, data, offsets)

    def _plain(self, body: bytes, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        at = cut_positions(data, offsets, self.ends)
        if len(at) < 2:
            return [b""] * (len(offsets) - 1)
        found = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(body)]).dictionary_encode()
        ids = list(map(self.cache.__getitem__, found.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        starts, which = np.cumsum(sizes) - sizes, found.indices.to_numpy()
        each = sizes[which]
        ends = np.cumsum(each)
        where = np.repeat(starts[which] - ends + each, each)
        where += np.arange(len(where))
        out = np.frombuffer(b"".join(ids), dtype="<u4")[where].tobytes()
        first = 4 * np.concatenate([[0], ends])[np.searchsorted(at, offsets)]
        return [out[a:b] for a, b in pairwise(first.tolist())]

    def _with_specials(self, text: bytes) -> bytes:
        """A text that may hold special strings: the library takes those from the raw text first."""
        out = []
        for part in self.special.split(text):
            if part in self.specials:
                out.append(np.array([self.specials[part]], dtype="<u4").tobytes())
            elif part:
                out += self._plain(part, np.frombuffer(part, dtype=np.uint8), np.array([0, len(part)]))
        return b"".join(out)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One encoder a worker process; its cache lives as long as the worker."""
    return WordBpe(path)
