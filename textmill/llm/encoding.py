"""Token ids of texts by a public tokenizer, over the different words of a batch.

The vocabulary lower-cases, drops white space and never joins across it, nor
across a letter and the full stop or comma that ends a word. So the ids of a
text are those of its words in a row. A batch is cut into words by array
operations; each different word is encoded once, and its ids are laid out
wherever it stands. Words return from batch to batch, so each worker keeps
their ids in two bounded generations. Malformed UTF-8 is encoded as U+FFFD.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import xxhash

from textmill.llm.common import decoded

#: Words of a generation, and the longest remembered word in bytes.
GENERATION, REMEMBERED_BYTES = 200_000, 48
#: Bytes of text that one round of array operations works on.
ROUND = 1_500_000
_LONG = 255
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = [np.array([pow(p, i, 1 << 64) for i in range(_LONG + 1)], np.uint64) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]

_open: dict[str, Encoder] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_words(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a lower-cased buffer that ends in white
    space; a full stop or comma between a letter and white space is a word."""
    a = np.frombuffer(buf, np.uint8)
    space = _SPACE[a]
    before = np.concatenate([[True], space[:-1]])
    own = np.zeros(len(a), bool)
    if len(a) > 2:
        mid, left = a[1:-1], a[:-2]
        own[1:-1] = ((mid == 46) | (mid == 44)) & (left >= 97) & (left <= 122) & space[2:]
    return np.flatnonzero((~space & before) | own), np.flatnonzero((space & ~before) | own)


def number_words(buf: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each word's kind, and the kinds. Words are told apart by
    a 128-bit hash, of which one half groups and the other is checked."""
    n = ends - starts
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(first, n)
    byte = np.frombuffer(buf, np.uint8)[np.repeat(starts, n) + at].astype(np.uint64) + np.uint64(1)
    at = np.minimum(at, _LONG)
    h, check = (np.add.reduceat(byte * p[at], first) for p in _POWERS)
    h ^= h >> np.uint64(29)
    for i in np.flatnonzero(n > _LONG):
        h[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]])
        check[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]], 1)
    codes, kinds = pd.factorize(h)
    one = np.empty(len(kinds), np.int64)
    one[codes[::-1]] = np.arange(len(h))[::-1]
    if (check[one[codes]] != check).any():
        table: dict[bytes, int] = {}
        words = [buf[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        return np.array([table.setdefault(w, len(table)) for w in words]), list(table)
    return codes, [buf[s:e] for s, e in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = min(self.tokenizer.get_added_tokens_decoder(), default=None)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words that hold no special token's text."""
        if len(self.young) > GENERATION:
            self.young, self.old = {}, self.young
        young, old, new = self.young, self.old, []
        for w in words:
            if w not in young:
                if (ids := old.get(w)) is None:
                    new.append(w)
                else:
                    young[w] = ids
        extra: dict[bytes, bytes] = {}
        for at in range(0, len(new), 2048):
            part = new[at : at + 2048]
            made = self._joined(part) if self.cut is not None else self.plain([decoded(w) for w in part])
            for w, ids in zip(part, made, strict=True):
                (young if len(w) <= REMEMBERED_BYTES else extra)[w] = ids
        return [young[w] if w in young else extra[w] for w in words]

    def _joined(self, words: list[bytes]) -> list[bytes]:
        """One call for many words, with a special token between each two."""
        text = self.tokenizer.id_to_token(self.cut).join(decoded(w) for w in words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.append(np.flatnonzero(ids == self.cut), len(ids)).tolist()
        raw, out, start = ids.tobytes(), [], 0
        for e in ends:
            out.append(raw[4 * start : 4 * e])
            start = e + 1
        return out

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        out: list[bytes] = [b""] * len(texts)
        batch, size = [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if any(m in t for m in self.marks):  # special tokens are found before anything else
                out[i] = self.plain([decoded(t)])[0]
                continue
            batch.append(i)
            size += len(t)
            if size > ROUND:
                self._round(batch, texts, out)
                batch, size = [], 0
        if batch:
            self._round(batch, texts, out)
        return out

    def _round(self, batch: list[int], texts: list[bytes | None], out: list[bytes]) -> None:
        parts = [texts[i] for i in batch]
        buf = b"\n".join(parts).lower() + b"\n"
        if any(m in buf for m in self.marks):  # upper-case look-alikes are ordinary text
            for i in batch:
                out[i] = self.plain([decoded(texts[i])])[0]
            return
        starts, ends = cut_words(buf)
        if not len(starts):
            return
        codes, kinds = number_words(buf, starts, ends)
        made = self.words(kinds)
        n = np.fromiter(map(len, made), np.int64, len(made)) // 4
        flat, base = np.frombuffer(b"".join(made), "<u4"), np.cumsum(n) - n
        each = n[codes]
        end = np.cumsum(each)
        laid = flat[np.repeat(base[codes] - (end - each), each) + np.arange(int(end[-1]))].tobytes()
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        last = np.searchsorted(starts, np.cumsum(size + 1), "left")  # words up to the end of each text
        stops = np.where(last > 0, end[np.maximum(last, 1) - 1], 0) * 4
        at = 0
        for i, stop in zip(batch, stops.tolist(), strict=True):
            out[i] = laid[at:stop]
            at = stop


def encoder(path: str) -> Encoder:
    """One encoder for each path and worker process."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]
