"""Byte-level BPE over whole texts, cut at safe boundaries and memoised by piece.

A space that a non-space character follows always starts a new match of the byte-level
split pattern: every alternative takes a space only in front of its run, and a white-space
run leaves its last space to the word behind it. So a text can be cut in front of each
such space, each piece encoded by itself, and the ids joined. Words repeat, so a piece's
ids are kept in a bounded cache; new pieces of a chunk of texts are joined (their joints
are safe cuts as well) and encoded by one library call.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator

import numpy as np

UNSAFE = re.compile(r" (?!\S)")
SAFE_CUT = re.compile(r" (?=\S)")
#: Distinct pieces that a worker remembers, and characters of text that it treats at once.
CACHE_PIECES, CHUNK_CHARS = 1_500_000, 4_000_000
#: ASCII signs that the pattern parts from letters in front of them, and the end of the Latin letters.
SIGNS, LATIN = ".,;:!?|", "\u0250"
#: A word of Latin letters, not too long for a table of words, and the signs behind it.
WORD = re.compile(f"([{''.join(re.escape(chr(i)) for i in range(ord(LATIN)) if chr(i).isalpha())}]{{1,48}})([{re.escape(SIGNS)}]*)")


def pieces(text: str) -> list[str]:
    """The text cut in front of each safe space; that space is left out of all pieces but implied."""
    return SAFE_CUT.split(text) if UNSAFE.search(text) else text.split(" ")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if it is printable, else one behind U+0100, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordMerger:
    """Merges many words at once: words of one length are rows of a table, and each step merges in every row the pair of lowest rank.

    Rows that have no pair left are done; all others have lost one token, so the table stays without gaps. Ranks are found
    in a hash table of open addresses, for all rows together.
    """

    NONE, BITS, FACTOR = np.int64(1 << 40), 18, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pairs: list[tuple[int, int, int]], byte: list[int]):
        """``pairs``: (left id, right id, new id) in rank order; ``byte``: id of each byte."""
        self.bits = max(self.BITS, (4 * len(pairs)).bit_length())
        self.byte, self.made = np.array(byte, np.int64), np.array([m for _, _, m in pairs], np.int64)
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NONE)
        for rank, (a, b, _) in enumerate(pairs):
            key = a << 32 | b
            at = int(self._place(np.array([key]))[0])
            while self.keys[at] not in (-1, key):
                at = (at + 1) & (1 << self.bits) - 1
            if self.keys[at] == -1:  # the earlier of equal pairs stays
                self.keys[at], self.ranks[at] = key, rank

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * self.FACTOR >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = self._place(keys)
        out = np.where(self.keys[at] == keys, self.ranks[at], self.NONE)
        open_ = ((self.keys[at] != keys) & (self.keys[at] != -1)).nonzero()
        while len(open_[0]):
            at[open_] = (at[open_] + 1) & (1 << self.bits) - 1
            told = self.keys[at[open_]]
            out[open_] = np.where(told == keys[open_], self.ranks[at[open_]], out[open_])
            go_on = (told != keys[open_]) & (told != -1)
            open_ = tuple(x[go_on] for x in open_)
        return out

    def merge(self, words: list[bytes]) -> Iterator[tuple[list[int], bytes, int]]:
        """(places of words, their ids one behind the other, bytes of ids a word), all words once."""
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        for size, places in by_size.items():
            at = np.array(places)
            ids = self.byte[np.frombuffer(b"".join([words[i] for i in places]), np.uint8)].reshape(-1, size)
            ranks = self.rank(ids[:, :-1], ids[:, 1:])
            while len(at):
                width = ids.shape[1]
                best = ranks.argmin(axis=1) if width > 1 else np.zeros(len(at), np.int64)
                lowest = ranks[np.arange(len(at)), best] if width > 1 else np.full(len(at), self.NONE)
                done = lowest == self.NONE
                if done.any():
                    yield at[done].tolist(), ids[done].astype("<u4").tobytes(), 4 * width
                    go_on = ~done
                    at, ids, ranks, best, lowest = at[go_on], ids[go_on], ranks[go_on], best[go_on], lowest[go_on]
                    if not len(at):
                        break
                rows, column = np.arange(len(at)), np.arange(width - 1)
                ids = np.take_along_axis(ids, column + (column > best[:, None]), axis=1)
                ids[rows, best] = self.made[lowest]
                ranks = np.take_along_axis(ranks, column[:-1] + (column[:-1] >= best[:, None]), axis=1)
                for shift in (-1, 0):  # the pairs left and right of the new token
                    k = best + shift
                    on = (k >= 0) & (k < width - 2)
                    ranks[rows[on], k[on]] = self.rank(ids[rows[on], k[on]], ids[rows[on], k[on] + 1])


class PieceEncoder:
    """ids of whole texts as little-endian uint32 bytes, from an encoder of any text.

    ``encode`` maps a text to its ids; ``lengths[id]`` is the number of bytes of an id. About ``most``
    pieces are remembered, and ``chunk`` characters treated at once: they set memory and time, not ids.
    """

    def __init__(self, encode: Callable[[str], np.ndarray], lengths: np.ndarray, most: int = CACHE_PIECES, chunk: int = CHUNK_CHARS, words: WordMerger | None = None):
        self.encode, self.lengths, self.most, self.chunk, self.words, self.cache, self.first = encode, lengths, most, chunk, words, {}, {}

    def _learn(self, missing: list[str]) -> None:
        """Cache new pieces; a plain word with signs behind it is its word and its signs, as the pattern parts them."""
        cache, told = self.cache, WORD.fullmatch
        words, others, joined = {}, [], []
        for piece in missing:
            if not (m := told(piece)):
                others.append(piece)
            elif m[2]:
                joined.append((piece, m[1], m[2]))
                if m[1] not in cache:
                    words[m[1]] = None
            else:
                words[piece] = None
        if self.words:  # a plain word is one match of the pattern, with the space before it
            plain = list(words)
            for places, raw, size in self.words.merge([b" " + p.encode() for p in plain]):
                cache.update(zip([plain[i] for i in places], [raw[k : k + size] for k in range(0, len(raw), size)]))
        else:
            others += words
        self._encode_new(others)
        heads = {signs: self._head(signs) for signs in {s for _, _, s in joined}}
        cache.update([(piece, cache[word] + heads[signs]) for piece, word, signs in joined])

    def _encode_new(self, missing: list[str]) -> None:
        if not missing:
            return
        ids = np.asarray(self.encode(" " + " ".join(missing)), dtype="<u4")
        ends = np.cumsum(np.fromiter((len(p.encode()) + 1 for p in missing), np.int64, len(missing)))
        at = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
        raw, start = ids.tobytes(), 0
        for piece, end in zip(missing, (4 * at).tolist()):
            self.cache[piece] = raw[start:end]
            start = end

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        chunk, size = [], 0
        for text in texts:
            chunk.append(text)
            size += len(text)
            if size >= self.chunk:
                yield from self._chunk(chunk)
                chunk, size = [], 0
        yield from self._chunk(chunk)

    def _chunk(self, texts: list[str]) -> Iterator[bytes]:
        cut = [pieces(t) for t in texts]
        heads = [c[0] for c in cut]
        for c in cut:
            c[0] = ""
        need = set().union(*cut)
        need.discard("")
        if len(self.cache) > self.most:
            self.cache = {p: self.cache[p] for p in need if p in self.cache}
        self.cache[""] = b""
        self._learn([p for p in need if p not in self.cache])
        get = self.cache.__getitem__
        for head, c in zip(heads, cut):
            yield self._head(head) + b"".join(map(get, c))

    def _head(self, head: str) -> bytes:
        if not head:
            return b""
        if (ids := self.first.get(head)) is None:
            if len(self.first) > self.most // 8:
                self.first = {}
            ids = np.asarray(self.encode(head), dtype="<u4").tobytes()
            if len(head) < 64:
                self.first[head] = ids
        return ids


_KEPT: dict[tuple, object] = {}


def forget() -> None:
    """Drop the encoders of this worker with their caches."""
    _KEPT.clear()


def json_encoder(path: str, most: int = CACHE_PIECES, chunk: int = CHUNK_CHARS) -> PieceEncoder:
    """The tokenizers library's file; strings of special tokens are ordinary text. One per worker."""
    if ("json", path, most, chunk) not in _KEPT:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, rules = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        words = WordMerger([(vocab[a], vocab[b], vocab[a + b]) for a, b in rules], [vocab[c] for c, _ in sorted(byte_alphabet().items(), key=lambda x: x[1])])
        lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            lengths[i] = len(token)  # one character of the byte alphabet for each byte
        encode = lambda text: np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        _KEPT["json", path, most, chunk] = PieceEncoder(encode, lengths, most, chunk, words)
    return _KEPT["json", path, most, chunk]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_encoding(path: str, pattern: str):
    """The tiktoken encoding of a local rank file and its piece encoder. One per worker."""
    if (path, pattern) not in _KEPT:
        import tiktoken

        ranks = read_ranks(path)
        encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            lengths[i] = len(token)
        encode = lambda text: np.array(encoding.encode_ordinary(text), "<u4")
        _KEPT[path, pattern] = (encoding, PieceEncoder(encode, lengths))
    return _KEPT[path, pattern]
