"""Operator 13: byte-level BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

Merging is local: what follows a text can undo only tokens near its end. How near is a constant of
the merge list, :func:`sufficient_lookahead`. So a text is read in blocks; a token leaves once that many
bytes behind it have been read, or its match of the split pattern has ended, and the state that stays is
bounded whatever the text's length. Decoding runs ids through a UTF-8 state machine that holds back at
most the bytes of one unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from functools import cached_property

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, documents, map_batches, texts_of
from .tokens import LATIN, SIGNS, byte_alphabet, pieces

#: Characters read at once, and characters without a safe boundary from which a match is streamed by itself.
BLOCK, LONG = 1 << 16, 1 << 12
#: Segments whose ids a worker remembers.
REMEMBERED = 1_200_000
NONE = 1 << 40
#: Below this character the regex module and the tokenizers library have the same classes.
COMMON = "԰"


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes behind a token after which no continuation of the text can change it.

    Apply the merges in rank order to a text and to a longer one. Left of a frontier, first the end of the
    shorter text, both have the same tokens. Only a merge (u, v) across the frontier moves it, by u's bytes
    to the left. A later such merge (u', v') has a greater rank, and its v' starts where u stood, so u is v'
    itself, its left part, the left part of that, and so on. The longest such chain, summed over ranks in
    ascending order, bounds all moves together.

    ValueError if a token has two merges, or a merge's part is no byte and has no earlier merge: rank order and the
    order in which an encoder merges may then differ.
    """
    left: dict[bytes, bytes] = {}
    reach: dict[bytes, int] = {}  # the longest chain so far that ends in a merge with this left part
    most = 0
    for u, v in merges:
        if u + v in left or any(len(x) > 1 and x not in left for x in (u, v)):
            raise ValueError(f"not a proper merge list at {u!r}, {v!r}")
        left[u + v] = u
        far, x = 0, v
        while x is not None:
            far = max(far, reach.get(x, 0))
            x = left.get(x)
        reach[u] = max(reach.get(u, 0), far + len(u))
        most = max(most, reach[u])
    return most


class _Classes(dict):
    """For translate(): a character that the pattern treats like the given one, as the library tells letters, digits and spaces."""

    def __init__(self, split):
        self.split = split

    def __missing__(self, code: int) -> str:
        alone = lambda x: len(self.split(x + chr(code))) == 1
        self[code] = chr(code) if code < ord(COMMON) else "é" if alone("a") else "5" if alone("1") else "!" if alone("!") else " "
        return self[code]


class Bpe:
    """Merge list, vocabulary, split pattern and special strings of a byte-level tokenizer file."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab = found["model"]["vocab"]
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in found["model"]["merges"]]
        self.merges = [(raw(a), raw(b)) for a, b in rules]
        self.lookahead = sufficient_lookahead(self.merges)
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(rules)}
        self.made = [vocab[a + b] for a, b in rules]
        self.byte = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.special = {t["content"]: t["id"] for t in found["added_tokens"]}
        self.bytes_of = {i: raw(t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.longest = max(map(len, self.bytes_of.values()))
        self.path, self.pattern, self.remembered = path, regex.compile(pattern), remembered
        self.segments: dict[str, bytes] = {}

    @cached_property
    def classes(self) -> _Classes:
        from tokenizers import Tokenizer

        return _Classes(Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str)

    def plain(self, text: str) -> str:
        """A text of the same length with the same matches, in characters whose class is beyond doubt."""
        return text if text.isascii() or max(text) < COMMON else text.translate(self.classes)

    def split(self, text: str) -> list[str]:
        """Matches of the split pattern."""
        plain = self.plain(text)
        if plain is text:
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(plain)]

    def merge(self, raw: bytes) -> list[int]:
        """ids of bytes that no split parts: the lowest rank first, the leftmost of equal ones."""
        get, made = self.rank.get, self.made
        ids = [self.byte[b] for b in raw]
        ranks = [get(p, NONE) for p in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) < NONE:
            i = ranks.index(r)
            ids[i : i + 2] = [made[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NONE)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NONE)
        return ids

    def matches(self, text: str) -> bytes:
        """ids, as little-endian 32-bit values, of a text that ends at a boundary."""
        return np.array([i for m in self.split(text) for i in self.merge_all(m)], "<u4").tobytes()

    def merge_all(self, match: str) -> list[int]:
        """ids of one whole match; a long one goes through the window in blocks."""
        raw = match.encode()
        if len(raw) <= 2 * self.window:
            return self.merge(raw)
        held, ids = b"", []
        for at in range(0, len(raw), self.window):
            stable, held = self.stable(held + raw[at : at + self.window])
            ids += stable
        return ids + self.merge(held)

    @property
    def window(self) -> int:
        return 512 + self.lookahead + self.longest

    def stable(self, raw: bytes) -> tuple[list[int], bytes]:
        """Of an unfinished match: the tokens that end ``lookahead`` bytes before its end, and the bytes behind them."""
        ids, at = self.merge(raw), 0
        for n, i in enumerate(ids):
            if at + len(self.bytes_of[i]) > len(raw) - self.lookahead:
                return ids[:n], raw[at:]
            at += len(self.bytes_of[i])
        return ids, b""

    def segment(self, piece: str) -> bytes:
        """ids of a space and the segment behind it, which the next safe space ends."""
        if (ids := self.segments.get(piece)) is None:
            word = piece.rstrip(SIGNS)
            if word and word != piece and word.isalpha() and max(word) < LATIN:  # the pattern parts these signs from letters
                ids = self.segment(word) + self.matches(piece[len(word) :])
            else:
                ids = self.matches(" " + piece)
            if len(piece) < 64:
                if len(self.segments) >= self.remembered:
                    self.segments.clear()
                self.segments[piece] = ids
        return ids


class Encoder:
    """The state of one text: :meth:`feed` blocks of any size, then :meth:`close`; both give ids that are final."""

    RUNS = {"L": regex.compile(r"\p{L}*"), "N": regex.compile(r"\p{N}*"), "S": regex.compile(r"\s*"), "O": regex.compile(r"[^\s\p{L}\p{N}]*")}

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.rest = ""  # may be the start of a special string
        self.tail = ""  # whose matches are not certain yet
        self.held = b""  # bytes of an unfinished long match, of the class in ``run``
        self.run = ""

    def feed(self, more: str) -> bytes:
        text, out = self.rest + more, []
        for mark in self.bpe.special:
            if mark in text:
                break
        else:
            hold = max((n for mark in self.bpe.special for n in range(1, len(mark)) if text.endswith(mark[:n])), default=0)
            self.rest = text[len(text) - hold :]
            return self._part(text[: len(text) - hold], False)
        while found := min(((text.find(m), -len(m), m) for m in self.bpe.special if m in text), default=None):
            at, _, mark = found
            out += [self._part(text[:at], True), np.array([self.bpe.special[mark]], "<u4").tobytes()]
            text = text[at + len(mark) :]
        self.rest = ""
        return b"".join(out) + self.feed(text)

    def close(self) -> bytes:
        out, self.rest = self._part(self.rest, True), ""
        return out

    def _part(self, more: str, last: bool) -> bytes:
        """Stable ids after ``more``; ``last``: a special string or the end follows."""
        text, out = self.tail + more, []
        self.tail = ""
        if self.run:
            text = self._go_on(text, last, out)
            if self.run:
                self.tail = text
                return b"".join(out)
        cut = len(text) if last else self._last_safe(text)
        if cut:
            first, *others = pieces(text[:cut])
            out += [self.bpe.matches(first), *map(self.bpe.segment, others)]
        self.tail = text[cut:]
        if len(self.tail) > LONG:
            self._long(out)
        return b"".join(out)

    @staticmethod
    def _last_safe(text: str) -> int:
        """Place of the last space with a non-space behind it, or 0."""
        at = len(text)
        while (at := text.rfind(" ", 0, at)) > 0:
            if at + 1 < len(text) and not text[at + 1].isspace():
                return at
        return 0

    def _long(self, out: list[bytes]) -> None:
        """Split a long tail without safe space as far as its matches are certain, two characters before its end."""
        text, plain, at = self.tail, self.bpe.plain(self.tail), 0
        for m in self.bpe.pattern.finditer(plain):
            if m.end() > len(text) - 2:
                break
            at = m.end()
            out.append(np.array(self.bpe.merge_all(m[0] if plain is text else text[m.start() : at]), "<u4").tobytes())
        self.tail = text[at:]
        if len(self.tail) > LONG:  # one match reaches the end
            end = self.bpe.plain(self.tail[-1])
            self.run = next(k for k, r in self.RUNS.items() if r.match(end).end())
            self.tail = self._go_on(self.tail, False, out, entered=True)

    def _go_on(self, text: str, last: bool, out: list[bytes], entered: bool = False) -> str:
        """Read on in the long match; gives the text behind it. Of an open run of spaces the last one stays behind."""
        end = len(text) if entered else self.RUNS[self.run].match(self.bpe.plain(text)).end()
        open_ = end == len(text) and not last
        if self.run == "S" and not (last and end == len(text)):
            end = max(0, end - 1)
        raw = self.held + text[:end].encode()
        self.held = b""
        for at in range(0, len(raw), self.bpe.window):
            ids, self.held = self.bpe.stable(self.held + raw[at : at + self.bpe.window])
            out.append(np.array(ids, "<u4").tobytes())
        if not open_:
            out.append(np.array(self.bpe.merge(self.held), "<u4").tobytes())
            self.held, self.run = b"", ""
        return text[end:]


class Decoder:
    """ids to text, step by step: bytes of an unfinished character wait, bytes that are no UTF-8 become U+FFFD.

    Unknown ids raise KeyError.
    """

    def __init__(self, bpe: Bpe):
        self.bytes_of = bpe.bytes_of.__getitem__
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        return self.state.decode(b"".join(map(self.bytes_of, ids.tolist())))

    def close(self) -> str:
        return self.state.decode(b"", True)


_KEPT: dict[tuple, Bpe] = {}


def loaded(path: str, pattern: str) -> Bpe:
    """One per worker."""
    if (path, pattern) not in _KEPT:
        _KEPT[path, pattern] = Bpe(path, pattern)
    return _KEPT[path, pattern]


def encode(bpe: Bpe, text: str, block: int = BLOCK):
    """Final ids of ``text`` as arrays, a block of characters at a time."""
    encoder = Encoder(bpe)
    for at in range(0, len(text), block):
        yield np.frombuffer(encoder.feed(text[at : at + block]), "<u4")
    yield np.frombuffer(encoder.close(), "<u4")


def stream_round_trip(docs: DataFrame, tokenizer_file: str, pattern: str, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, exact`` of every whole text; ``exact``: decoding gave the text back.

    Neither the ids nor the decoded text of a document are ever held whole: both digests grow block by block.
    Special strings in a text are their tokens, as in the tokenizers library. Null and empty texts have no ids. Repeated
    rows, null ids and other columns do no harm; an empty table gives no rows.
    """

    def make():
        claim(__name__, _KEPT.clear)
        bpe = loaded(tokenizer_file, pattern)

        def digest(text: str) -> tuple:
            decoder, n, told, read = Decoder(bpe), 0, hashlib.sha256(), hashlib.sha256()
            for ids in encode(bpe, text, block):
                n += len(ids)
                told.update(ids)
                read.update(decoder.feed(ids).encode())
            read.update(decoder.close().encode())
            return n, told.hexdigest(), read.hexdigest(), read.digest() == hashlib.sha256(text.encode()).digest()

        def work(batch):
            rows = zip(*map(digest, texts_of(batch))) if batch.num_rows else ([],) * 4
            return dict(zip(("n_tokens", "ids_sha256", "decoded_sha256", "exact"), map(list, rows))) | {"doc_id": batch.column("doc_id")}

        return work

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean"
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), make, schema)


def op13_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return stream_round_trip(documents(spark, sf_dir), P.path("byte_bpe_50k.json"), P.PATTERN)
