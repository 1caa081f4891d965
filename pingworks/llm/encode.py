"""Token ids of whole texts through the public tokenizer libraries.

None of the three vocabularies used has a token that spans a single space between
two words, so a text's ids are those of its space-delimited chunks in order.  A task
therefore gives the library each distinct chunk once and lays the ids out by array
indexing.  A space only splits where both neighbours are plain visible characters.  The
libraries that part words from marks and line ends anyway (byte_bpe, word_bpe) also
split between a Latin-1 letter and a mark, and around a line end between visible
characters, so that a word is one chunk whatever follows it; where the library lowers
letters anyway, those of Latin-1 are lowered first.
Every other place (runs of blanks, other scripts, combining marks) stays inside one
chunk and is left to the library whole.  Chunks are looked up by a 64-bit hash, and every
chunk's bytes are compared with those of the entry found, so no two texts share ids by
accident or by design."""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa

from pingworks.llm.bytescan import LOWER, prefix_sums, ranges, span_hashes
from pingworks.llm.shared import slices, text_buffer

SLICE_BYTES = 4 << 20
#: Beyond so many chunks, or bytes of chunks, a task's cache starts afresh.
CACHE_CHUNKS = 800_000
CACHE_BYTES = 16 << 20


def file_digest(path: str) -> str:
    """Version digest of a tokenizer: of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


# Letters of ASCII and Latin-1 in UTF-8, behind a space or not.
_LETTERS = rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
_LOWERED = rb" ?(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+"
# Byte-level vocabularies spell bytes as characters: visible ones as they are, the others
# in ascending order as those from 256 on.  0 parts words here.
_BYTE_CHARS = np.arange(256, dtype="<u2")
_OTHER_BYTES = [b for b in range(256) if b not in {*range(33, 127), *range(161, 173), *range(174, 256)}]
_BYTE_CHARS[_OTHER_BYTES] = 256 + np.arange(len(_OTHER_BYTES))
_BYTE_CHARS[0] = 0


class _Library:
    """A tokenizer file behind one call: ids of many strings, one after another, and
    how many each has."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.keeps_space = path.endswith(".json")
        if self.keeps_space:
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_file(path)
            self.tok.no_truncation()
            self.tok.no_padding()
            # a special token's string parts a text before anything else happens
            self.mark_id, self.mark = max((i, t.content) for i, t in self.tok.get_added_tokens_decoder().items())
            self.splits = True
            self.lowers = self.tok.normalizer is not None and self.tok.normalizer.normalize_str("AZ") == "az"
            self.model = self.tok.model
            self.plain = self._plain()
        else:
            from sentencepiece import SentencePieceProcessor

            self.sp, self.lowers, self.plain = SentencePieceProcessor(model_file=path), False, None
            # a piece with a word mark after another character would span words
            pieces = [self.sp.id_to_piece(i).lstrip("▁") for i in range(self.sp.get_piece_size())]
            self.splits = not any("▁" in x for x in pieces) and self.sp.encode("a b") == self.sp.encode("a") + self.sp.encode("b")

    def _plain(self) -> re.Pattern | None:
        """Chunks that are one pre-token of Latin letters: these may go to the library's
        model at once, past normaliser and pre-tokeniser, which would leave them alone."""
        letters = re.compile(_LOWERED if self.lowers else _LETTERS)
        tries = ["the", " the", " zqxjk", "zqxjkvbn", " a", "w" * 40, "élan", " être", "straße", " àèìòùÿ", "çã"]
        ids, lengths = self._words([x.encode() for x in tries])
        want = [self.tok.encode(x, add_special_tokens=False).ids for x in tries]
        same = ids == list(chain.from_iterable(want)) and lengths == [len(x) for x in want]
        return letters if same else None

    def _words(self, chunks: list[bytes]) -> tuple[list[int], list[int]]:
        """Ids of chunks that are words, one after another, and how many each has."""
        raw = b"\0".join(chunks)
        if self.lowers:
            raw = raw.replace(b" ", b"")
        words = _BYTE_CHARS[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-16-le").split("\0")
        find, ids, lengths = self.model.tokenize, [], []
        for w in words:  # no list is kept a word, which would wake the garbage collector
            found = find(w)
            lengths.append(len(found))
            ids += [t.id for t in found]
        return ids, lengths

    def encode_each(self, texts: list[str]) -> list[list[int]]:
        if self.keeps_space:
            return [x.ids for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return self.sp.encode(texts, num_threads=1)

    def encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.plain is None:
            return self._encode([x.decode() for x in chunks])
        match = self.plain.fullmatch
        word = np.array([match(x) is not None for x in chunks], bool)
        ids, lengths = self._words([x for x, w in zip(chunks, word.tolist()) if w]) if word.any() else ([], [])
        ids, lengths = np.array(ids, np.uint16), np.array(lengths, np.int64)
        if word.all():
            return ids, lengths
        rest, many = self._encode([x.decode() for x, w in zip(chunks, word.tolist()) if not w])
        # each chunk's ids go to its place
        of = np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)])
        both, n = np.concatenate([ids, rest]), np.concatenate([lengths, many])
        starts, back = np.cumsum(n) - n, np.argsort(of)
        return both[ranges(starts[back], n[back])], n[back]

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.keeps_space or any("<|" in x for x in texts):
            found = self.encode_each(texts)
            lengths = np.array([len(x) for x in found], np.int64)
            return np.array(list(chain.from_iterable(found)), np.uint16), lengths
        # one call for all: the special token between the strings parts their ids
        ids = np.array(self.tok.encode_batch_fast([self.mark.join(texts)], add_special_tokens=False)[0].ids, np.int64)
        marks = np.flatnonzero(ids == self.mark_id)
        lengths = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
        return np.delete(ids, marks).astype(np.uint16), lengths


# Kinds of bytes: visible ASCII, its letters, first bytes of two-byte letters (no blanks,
# no marks), later bytes, space, line end, marks that end words.
_VISIBLE, _LETTER, _LEAD, _LATER, _SPACE, _LINE, _MARK = (1 << k for k in range(7))
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _VISIBLE
for _c in range(26):
    _KIND[[65 + _c, 97 + _c]] |= _LETTER
_KIND[0xC3:0xCC], _KIND[0x80:0xC0], _KIND[0x20], _KIND[0x0A] = _LEAD, _LATER, _SPACE, _LINE
_KIND[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] |= _MARK  # not those of contractions and special tokens


def _lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in lower case."""
    out = LOWER[buf]
    capital = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    out[1:] += capital.view(np.uint8) << 5
    return out


def _starts(buf: np.ndarray, offs: np.ndarray, fine: bool) -> np.ndarray:
    """Positions where a chunk begins: spaces that split and, if ``fine``, marks behind
    letters and what stands at and behind a line end."""
    kind = _KIND[buf]
    ends = (kind & _VISIBLE) != 0  # what may stand before a splitting blank
    ends[1:] |= ((kind[:-1] & _LEAD) != 0) & ((kind[1:] & _LATER) != 0)
    blank = (kind[1:-1] & (_SPACE | _LINE if fine else _SPACE)) != 0
    blank &= ends[:-2] & ((kind[2:] & (_VISIBLE | _LEAD)) != 0)
    split = np.zeros(len(buf), bool)
    split[1:-1] = blank
    rows = offs[:-1][offs[:-1] < offs[1:]]
    split[rows] = False  # a text's first and last byte are no blanks within it
    split[rows[1:] - 1] = False
    if fine:
        line = np.flatnonzero(split & (buf == 0x0A)) + 1
        letter = (kind & _LETTER) != 0
        letter[1:] |= (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        split[1:] |= letter[:-1] & ((kind[1:] & _MARK) != 0)
        split[line] = True
        split[rows] = False
    return np.flatnonzero(split)


class Encoder:
    """Ids of texts in a task; holds a bounded cache of chunks."""

    _by_path: dict[str, Encoder] = {}

    def __init__(self, path: str):
        self.library = _Library(path)
        self._clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def _clear(self) -> None:
        self.n = 0
        self.hashes = np.zeros(1024, np.uint64)
        self.lengths = np.zeros(1024, np.int64)
        self.starts = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint16)
        self.used = 0
        # the entries' own bytes
        self.sizes = np.zeros(1024, np.int64)
        self.places = np.zeros(1024, np.int64)
        self.bytes = np.zeros(4096, np.uint8)
        self.n_bytes = 0
        self.odd: dict[bytes, int] = {}  # entries of chunks whose hash another one has
        self.table = np.full(1 << 12, -1, np.int32)  # entries by their hash: the first free place from its bits on

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        """Where in the table the search for a hash begins."""
        return (hashes >> np.uint64(20)).astype(np.int64) & (len(self.table) - 1)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        at = self._place(hashes)
        out = self.table[at]
        # places taken by another hash: go on with the next
        left = np.flatnonzero((out >= 0) & (self.hashes[out] != hashes))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.table) - 1)
            out[left] = found = self.table[at[left]]
            left = left[(found >= 0) & (self.hashes[found] != hashes[left])]
        return out

    def _enter(self, first: int, last: int) -> None:
        """Entries ``first`` to ``last`` - 1, of hashes that the table lacks, go into it."""
        if 2 * last > len(self.table):
            while 2 * last > len(self.table):
                self.table = np.append(self.table, self.table)
            self.table[:] = -1
            first = 0
        entries = np.arange(first, last, dtype=np.int32)
        if first == 0 and self.odd:
            entries = np.delete(entries, list(self.odd.values()))  # found by their bytes
        at = self._place(self.hashes[entries])
        while len(entries):
            free = self.table[at] < 0
            self.table[at[free]] = entries[free]
            lost = self.table[at] != entries
            entries, at = entries[lost], (at[lost] + 1) & (len(self.table) - 1)

    def _learn(self, hashes: np.ndarray, strings: list[bytes]) -> None:
        first, last = self.n, self.n + len(hashes)
        while len(self.hashes) < last:
            self.hashes, self.lengths, self.starts, self.sizes, self.places = (np.append(x, x) for x in (self.hashes, self.lengths, self.starts, self.sizes, self.places))
        self.hashes[first:last] = hashes
        sizes = np.array([len(x) for x in strings], np.int64)
        raw = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes[first:last] = sizes
        self.places[first:last] = self.n_bytes + np.cumsum(sizes) - sizes
        while len(self.bytes) < self.n_bytes + len(raw):
            self.bytes = np.append(self.bytes, self.bytes)
        self.bytes[self.n_bytes : self.n_bytes + len(raw)] = raw
        self.n_bytes += len(raw)
        for i in range(0, len(strings), 512):
            ids, lengths = self.library.encode(strings[i : i + 512])
            n, at = self.n, self.used
            self.n, self.used = n + len(lengths), at + len(ids)
            while len(self.flat) < self.used:
                self.flat = np.append(self.flat, self.flat)
            self.lengths[n : self.n] = lengths
            self.starts[n : self.n] = at + np.cumsum(lengths) - lengths
            self.flat[at : self.used] = ids

    def _entries(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cache entry of each chunk, and for each row the chunks before it."""
        rows = offs[:-1][offs[:-1] < offs[1:]]
        begins = rows
        if self.library.lowers and b"<|" not in buf.tobytes():  # special tokens keep their case
            buf = _lowered(buf)
        if self.library.splits:
            cuts = _starts(buf, offs, self.library.keeps_space)
            begins = np.sort(np.concatenate([rows, cuts]), kind="stable")
        ends = np.append(begins[1:], len(buf))
        bounds = np.searchsorted(begins, offs)
        tiled = True  # the chunks are the whole buffer
        if self.library.splits and not self.library.keeps_space:  # the library puts the word mark there itself
            inner = np.ones(len(begins), bool)
            inner[bounds[:-1][offs[:-1] < offs[1:]]] = False
            begins, tiled = begins + inner, False
        hashes = span_hashes(prefix_sums(buf), begins, ends)
        if self.n > CACHE_CHUNKS or self.n_bytes > CACHE_BYTES:
            self._clear()
        codes = self._find(hashes).astype(np.int64)
        new = np.flatnonzero(codes < 0)
        if len(new):
            each, uniques = pd.factorize(hashes[new])
            firsts = np.zeros(len(uniques), np.int64)
            firsts[each[::-1]] = new[::-1]
            codes[new], known, raw = self.n + each, self.n, buf.tobytes()
            spans = zip(begins[firsts].tolist(), ends[firsts].tolist())
            self._learn(uniques, [raw[a:b] for a, b in spans])
            self._enter(known, self.n)
        return self._checked(codes, buf, begins, ends, tiled), bounds

    def _checked(self, codes: np.ndarray, buf: np.ndarray, begins: np.ndarray, ends: np.ndarray, tiled: bool) -> np.ndarray:
        """``codes``, with entries of their own for chunks that differ from what their
        hash found."""
        lengths = ends - begins
        wrong = self.sizes[codes] != lengths
        same = np.flatnonzero(~wrong)
        theirs = self.bytes[ranges(self.places[codes[same]], lengths[same])]
        mine = buf if tiled and len(same) == len(codes) else buf[ranges(begins[same], lengths[same])]
        if len(same) == len(codes) and np.array_equal(theirs, mine):
            return codes
        at = np.repeat(same, lengths[same])
        wrong[at[theirs != mine]] = True
        for i in np.flatnonzero(wrong):
            raw = buf[begins[i] : ends[i]].tobytes()
            if raw not in self.odd:
                self.odd[raw] = self.n
                self._learn(np.array([len(self.odd)], np.uint64), [raw])
            codes[i] = self.odd[raw]
        return codes

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each row."""
        buf, offs = text_buffer(column)
        out = np.zeros(len(offs) - 1, np.int64)
        for i, j in slices(offs, SLICE_BYTES):
            part = buf[offs[i] : offs[j]]
            if len(part):
                entries, bounds = self._entries(part, offs[i : j + 1] - offs[i])
                sums = np.append(0, np.cumsum(self.lengths[entries]))
                out[i:j] = sums[bounds[1:]] - sums[bounds[:-1]]
        return out

    def ids(self, column: pa.Array, end: int | None = None):
        """Yields (first row, last row + 1, ids of those rows one after another,
        row bounds in them); ``end`` is appended to each row's ids."""
        buf, offs = text_buffer(column)
        for i, j in slices(offs, SLICE_BYTES):
            part = buf[offs[i] : offs[j]]
            if len(part):
                entries, bounds = self._entries(part, offs[i : j + 1] - offs[i])
                lengths = self.lengths[entries]
                flat = self.flat[ranges(self.starts[entries], lengths)]
                at = np.append(0, np.cumsum(lengths))[bounds]
            else:
                flat, at = np.zeros(0, np.uint16), np.zeros(j - i + 1, np.int64)
            if end is not None:
                flat = np.insert(flat, at[1:], end)
                at = at + np.arange(len(at))
            yield i, j, flat, at
