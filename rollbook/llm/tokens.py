"""Exact tokenising with a memory of pieces.

A tokenizer that cuts texts at white space, between letters and other signs and at
each digit gives a piece the same ids wherever it stands, so a worker keeps the ids
of the pieces that it has met. The ids are those of the tokenizers library; only how
often it is asked differs. Words with signs outside plain Latin text go to the library
as they are, and a tokenizer without this property (checked on sample texts) gets
whole texts.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Pieces that a worker remembers at most (some 60 MB, kept as long as the worker is); later ones are encoded whenever they come.
MEMORY = 400_000
#: Characters of texts that are cut at a time, or one text.
GROUP = 1 << 20
#: Texts of which lower case, NFC and the tokenizer's cuts are simple: no quotes (contractions), no "<" (special tokens).
SIMPLE = re.compile(r"[\t\n\r !-&(-;=-~À-ÖØ-öø-ÿ¡¿«»–—“”…°€]*")
PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
SAMPLES = ("", " ", "a b", "Ab.  c\nDe\tf1 22", "été x\r\ny", "12 !? --", "a.b c,d_e", "(x) [y]:z;", "«à» É…", "ab12cd", "x=y*z#&&&")
#: Marks a word that goes to the library as it is.
AS_IS = b"\0"
#: Kinds of the bytes of a simple text in lower case. C3 begins a letter; what else is beyond ASCII is a sign.
SPACE, LETTER, SIGN, DIGIT = range(4)
KINDS = np.array([SPACE if c in b"\t\n\r " else LETTER if 97 <= c <= 122 or c == 0xC3 else DIGIT if 48 <= c <= 57 else SIGN for c in range(256)], np.uint8)

_made: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """``encode(texts)`` gives each text's ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.type = "<u2" if max(vocab.values()) < 1 << 16 else "<u4"
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.by_piece = False
        whole = self.encode(list(SAMPLES))
        self.by_piece = True
        self.by_piece = self.encode(list(SAMPLES)) == whole

    def _library(self, texts: list[str], kind: str) -> list[bytes]:
        return [np.array(e.ids, dtype=kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Pieces are encoded many at a time; each ends in one id of the end of a word."""
        out: dict[bytes, bytes] = {}
        plain = [x for x in pieces if x[:1] != AS_IS]
        rest = [x for x in pieces if x[:1] == AS_IS]
        parts = [plain[at : at + 500] for at in range(0, len(plain), 500)]
        for part, ids in zip(parts, self._library([b" ".join(x).decode() for x in parts], self.type), strict=True):
            held = np.frombuffer(ids, self.type)
            ends = ((np.flatnonzero(self.ends[held]) + 1) * held.itemsize).tolist()
            if len(ends) == len(part):
                out.update((w, ids[a:b]) for w, a, b in zip(part, [0, *ends[:-1]], ends, strict=True))
            else:
                out.update(zip(part, self._library([x.decode() for x in part], self.type), strict=True))
        out.update(zip(rest, self._library([x[1:].decode() for x in rest], self.type), strict=True))
        return out

    def _found(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of different pieces, remembered or encoded now."""
        out = list(map(self.known.get, pieces))
        new = [k for k, ids in enumerate(out) if ids is None]
        if new:
            made = self._ids_of([pieces[k] for k in new])
            for k in new:
                out[k] = made[pieces[k]]
            self.known.update(islice(made.items(), max(0, MEMORY - len(self.known))))
        return out

    @staticmethod
    def _pieces(text: str) -> list[bytes]:
        out: list[bytes] = []
        for word in re.split(r"[ \n]+", text):
            if SIMPLE.fullmatch(word):
                out += map(str.encode, PIECE.findall(word.lower()))
            else:
                out.append(AS_IS + word.encode())
        return out

    def _simple(self, texts: list[str]) -> list[bytes]:
        """Simple texts are cut as one run of bytes: a piece begins where the kind of byte changes, and at every digit."""
        raw = [t.lower().encode() for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        kind = KINDS[data]
        kind[np.flatnonzero(data == 0xC3) + 1] = LETTER
        begins = kind == DIGIT
        begins[0] |= kind[0] != SPACE
        begins[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] != SPACE)
        filled = kind != SPACE
        place = np.append(np.flatnonzero(begins[filled]), np.count_nonzero(filled))
        if len(place) == 1:
            return [b""] * len(texts)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(place) - 1, [None, pa.py_buffer(place.astype(np.int64)), pa.py_buffer(data[filled])]).dictionary_encode()
        which = pieces.indices.to_numpy()
        _, bounds, held = pieces.dictionary.buffers()
        bounds, held = np.frombuffer(bounds, np.int64)[: len(pieces.dictionary) + 1].tolist(), held.to_pybytes()
        found = self._found([held[a:b] for a, b in pairwise(bounds)])
        ids = np.frombuffer(b"".join(found), self.type)
        n = np.fromiter(map(len, found), np.int64, len(found)) // ids.itemsize
        first, count = (np.cumsum(n) - n)[which], n[which]
        after = np.concatenate([[0], np.cumsum(count)])
        ids = ids[np.repeat(first - after[:-1], count) + np.arange(after[-1])].astype("<u4")
        text_ends = np.cumsum([len(x) + 1 for x in raw])
        at = after[np.concatenate([[0], np.searchsorted(np.flatnonzero(begins), text_ends)])]
        return [ids[a:b].tobytes() for a, b in pairwise(at.tolist())]

    def _mixed(self, text: str) -> bytes:
        pieces = self._pieces(text)
        new = list(set(pieces))
        know = dict(zip(new, self._found(new), strict=True))
        return np.frombuffer(b"".join(map(know.__getitem__, pieces)), self.type).astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self._library(texts, "<u4")
        out: list[bytes] = [b""] * len(texts)
        group: list[int] = []
        size = 0
        for k, t in enumerate(texts):
            if SIMPLE.fullmatch(t):
                group.append(k)
                size += len(t)
            else:
                out[k] = self._mixed(t)
            if group and (size >= GROUP or k == len(texts) - 1):
                for at, ids in zip(group, self._simple([texts[i] for i in group]), strict=True):
                    out[at] = ids
                group, size = [], 0
        return out


def tokenizer(path: str) -> WordTokenizer:
    """This worker's tokenizer for the file."""
    if path not in _made:
        _made[path] = WordTokenizer(path)
    return _made[path]


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
