"""Token ids of whole texts, by a public tokenizer file."""

from __future__ import annotations

import codecs
import json
import os
from array import array
from itertools import compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes, as the tokenizer's pattern takes words apart: letters and digits (of other
# letters, those from U+00C0 to U+023F, which every version of Unicode has), marks but
# the apostrophe, the apostrophe, white space, and all others.
_WORD, _MARK, _QUOTE, _SPACE, _OTHER = range(5)
_KINDS = np.array(
    [
        _SPACE if c in "\t\n\r " else _WORD if c.isascii() and c.isalnum() or "\xc3" <= c <= "\xc8" else _QUOTE if c == "'" else _MARK if "!" <= c <= "~" else _OTHER
        for c in map(chr, range(256))
    ],
    np.uint8,
)
# First bytes of characters that are surely no white space, whichever bytes follow.
_VISIBLE = np.array([0x21 <= b <= 0x7E or 0xC3 <= b <= 0xE0 or 0xE4 <= b <= 0xF4 for b in range(256)])

# Parts that the pattern takes as one word.
_SINGLE = r"^ ?(?:[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{23F}]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)$"


def _alphabet() -> str:
    """The characters that stand for bytes in the vocabulary of a byte-level tokenizer."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


_ALPHABET = _alphabet()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids by the tokenizers library, with a bounded memory of words seen before.

    Text repeats its words: it is cut where the tokenizer's pattern is sure to end a
    word, and each part is encoded once and looked up after that. Texts that contain a
    special token go through the library as a whole, as do all texts where the file is
    not of the byte-level kind.
    """

    def __init__(self, path: str, max_parts: int = 650_000, max_chars: int = 32):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.max_parts, self.max_chars = max_parts, max_chars
        # Ids of a part, the space before it included.
        self.parts: dict[str, bytes] = {}
        state = json.loads(self.tokenizer.to_str())
        pattern = state["pre_tokenizer"] or {}
        # Whether words have ids of their own, wherever they stand.
        self.apart = pattern.get("type") == "ByteLevel" and pattern.get("use_regex") is True and not pattern.get("add_prefix_space") and not state["normalizer"]
        self.separators = {c: np.frombuffer(self.whole(c), "<u4") for c in "\n\t"}
        self.model = self.tokenizer.model

    def whole(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit numbers."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def rest(self) -> None:
        """Forget all but the most frequent words, as the process may wait long for its next task."""
        self.parts = dict(islice(self.parts.items(), self.max_parts // 8))

    def _together(self, parts: list[str]) -> list[bytes]:
        """Encode parts, some thousands at a time: the library needs far more memory than their text."""
        return [x for i in range(0, len(parts), 8192) for x in self._some(parts[i : i + 8192])]

    def _some(self, parts: list[str]) -> list[bytes]:
        single = pc.match_substring_regex(pa.array(parts, pa.string()), _SINGLE).to_numpy(zero_copy_only=False).tolist()
        words, rest = iter(self._words([*compress(parts, single)])), iter(self._joined([p for p, one in zip(parts, single) if not one]))
        return [next(words if one else rest) for one in single]

    def _words(self, words: list[str]) -> list[bytes]:
        """Encode words of the pattern's, which need not be searched for them again."""
        spelled = codecs.charmap_decode("\n".join(words).encode(), "strict", _ALPHABET)[0].split(_ALPHABET[10])
        ids, ends = array("I"), [0]
        for word in spelled:
            ids.extend([t.id for t in self.model.tokenize(word)])
            ends.append(4 * len(ids))
        data = np.array(ids, "<u4").tobytes()
        return [data[a:b] for a, b in zip(ends, ends[1 : len(words) + 1])]

    def _joined(self, parts: list[str]) -> list[bytes]:
        """Encode parts in one text, set apart by white space that they do not contain."""
        out: list[bytes | None] = [None] * len(parts)
        left = list(range(len(parts)))
        for separator, own in self.separators.items():
            at = [i for i in left if separator not in parts[i] and not parts[i][-1:].isspace()]
            data = self.whole(separator.join([parts[i] for i in at]))
            ends = np.flatnonzero(np.frombuffer(data, "<u4") == own[0]) * 4
            if len(own) == 1 and len(ends) == len(at) - 1:
                ends = ends.tolist()
                for i, a, b in zip(at, [0, *(e + 4 for e in ends)], [*ends, len(data)]):
                    out[i] = data[a:b]
                left = [i for i in left if out[i] is None]
        for i in left:
            out[i] = self.whole(parts[i])
        return out

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The texts, none of them empty, cut where a word of the pattern's is sure to end, and each text's first part.

        The pattern looks ahead only past white space: the last of several belongs to
        what follows, alone or, a space, with the word. So a cut stands before a space
        and around another one if what follows is visible, where white space begins,
        and between words and marks, but not after an apostrophe.
        """
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        firsts, lasts = offsets[:-1] - offsets[0], offsets[1:] - offsets[0] - 1
        kind = _KINDS[data]
        lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC8))
        kind[lead + 1] = _WORD
        sign = lead[(data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7))]
        kind[sign] = kind[sign + 1] = _OTHER
        space = kind == _SPACE
        final = np.zeros(len(data), bool)  # white space before something visible
        final[:-1] = space[:-1] & _VISIBLE[data[1:]]
        final[lasts] = False
        cut = final.copy()
        cut[1:] |= final[:-1] & (data[:-1] != 0x20)
        a, b = kind[:-1], kind[1:]
        cut[1:] |= (a < _SPACE) & space[1:] | (a == _WORD) & ((b == _MARK) | (b == _QUOTE)) | (a == _MARK) & (b == _WORD)
        cut[firsts] = True
        at = np.flatnonzero(cut).astype(np.int32)
        ends = np.append(at, np.int32(len(data)))
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(data)), np.searchsorted(at, firsts)

    def _looked_up(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts that can be cut."""
        if len(self.parts) > self.max_parts:  # the oldest are the most frequent
            self.parts = dict(islice(self.parts.items(), self.max_parts // 2))
        parts, firsts = self._cut(texts)
        coded = parts.dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.parts.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(missing, self._together([words[i] for i in missing])):
            found[i] = ids
            if len(words[i]) <= self.max_chars:
                self.parts[words[i]] = ids
        lengths = np.fromiter(map(len, found), np.int32, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<u4")
        n = lengths[at]
        before = np.zeros(len(n) + 1, np.int32)
        np.cumsum(n, out=before[1:])
        starts = (np.cumsum(lengths, dtype=np.int32) - lengths)[at] - before[:-1]
        ids = ids[np.repeat(starts, n) + np.arange(before[-1], dtype=np.int32)]
        ends = before[np.append(firsts, len(at))]
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; a missing text is empty."""
        texts = texts.cast(pa.string()).fill_null("")
        odd = pc.or_(pc.equal(texts, ""), not self.apart)
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        out = np.empty(len(texts), object)
        odd = odd.to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd):
            out[i] = self.whole(texts[int(i)].as_py())
        cut = texts.filter(pa.array(~odd))
        if len(cut):
            out[np.flatnonzero(~odd)] = np.array([*self._looked_up(cut), None], object)[:-1]
        return out.tolist()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python process, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
