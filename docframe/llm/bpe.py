"""Token ids of whole texts, by the tokenizers library with a bounded cache of text pieces.

A byte-level BPE never merges across its pre-tokens, and a space that is followed by anything but
white space always opens a pre-token.  Texts are therefore cut before such spaces and each distinct
piece is encoded once per worker; the joined ids equal those of the whole text.  A text with other
spaces (doubled, before a line feed, at its end) is encoded in one go, and so is one that holds the
content of an added token, which has the id of its own that the vocabulary file gives it.  A line feed
between a mark and a letter ends a pre-token, so texts are cut there as well.

Texts that come together are cut, and their different pieces told apart, by Arrow; Python sees each
different piece once, new words are merged in one call, and Arrow puts the ids in the pieces' places.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space that may not open a pre-token: it ends the text or white space follows.
_UNSURE = re.compile("  | [\\s\u180e\u200b\ufeff]| $")
#: Pieces kept per worker, about 200 MB; beyond it those not met lately go, so memory stays bounded.
CACHE_PIECES = 1_200_000
#: Pieces of more characters are encoded anew each time.
LONGEST = 256
#: Pieces of letter runs and marks whose parts are pre-tokens on their own, whatever follows (a piece of other parts goes to the whole encoder).
_PARTS = re.compile(r"[^\W\d_]+|[^\w\s']+\n?|\n(?=[^\W\d_])")
#: A line feed that ends a pre-token: what follows opens one without a space, which CUT notes.
_LINE = re.compile(r"\n(?<=[^\w\s']\n)(?=[^\W\d_])")
CUT = "\0"
#: Marks after a Latin letter or digit open a pre-token; cut off, they leave the word before them as it is elsewhere.
_COMMA, _STOP, _MARK = (re.compile(f"{mark}(?<=[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]{mark})") for mark in (",", "[.]", "[!-+/:-@{-~-]"))
#: Marks that end a word most often.
_MARKS = frozenset(".,;:!?")


def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()
_SPACE, _FEED = _BYTE_CHARS[32], _BYTE_CHARS[10]
#: Words that are merged in one call.
WORDS = 10_000
#: Bytes of texts that are encoded at a time, about, so a batch of long ones stays small.
TEXT_BYTES = 8 << 20
#: Words of more characters that come once among many texts hardly come again.
SHORT = 8

_loaded: dict[tuple[str, int], "PieceEncoder"] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file, looked up where the code runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Remembered(dict):
    """What a function gives for a text, kept for a bounded number of texts: half of them new, half those before."""

    def __init__(self, find, limit: int):
        super().__init__()
        self._find, self._limit, self._before = find, max(1, limit // 2), {}

    def __missing__(self, text: str) -> bytes:
        found = self._before.get(text)
        return self.keep(text, self._find(text) if found is None else found)

    def keep(self, text: str, found: bytes) -> bytes:
        # a word at the end of a line hardly comes again, and is put together from its parts
        if len(text) <= 2 or len(text) <= LONGEST and text[-1] != "\n":
            if len(self) >= self._limit:
                self._before = dict(self)
                self.clear()
            self[text] = found
        return found

    def all(self, texts: list[str], often: list[bool], find_many) -> list[bytes]:
        """What the function gives for each of different texts; find_many gives it for the words that are not kept, and of these the rare long ones are not kept now either."""
        found, new = list(map(self.get, texts)), []
        for k in [k for k, ids in enumerate(found) if ids is None]:
            t = texts[k]
            if t in self._before or not t[t[0] == CUT :].isalpha():
                found[k] = self[t]
            else:
                new.append(k)
        for k, ids in zip(new, find_many([texts[k] for k in new])):
            found[k] = ids
            if often[k] or len(texts[k]) <= SHORT:
                self.keep(texts[k], ids)
        return found


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tok = Tokenizer.from_file(path)
        # the merges alone, for text that is written in byte characters, in which no space occurs
        self._bare = Tokenizer(self._tok.model)
        self._bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self._feed = self._tok.token_to_id(_FEED)
        # only the whole text shows where an added token matches, and what it takes of the space around it
        added = sorted({t.content for t in self._tok.get_added_tokens_decoder().values() if t.content}, key=len, reverse=True)
        self._added = re.compile("|".join(map(re.escape, added))) if added else None
        self._merge = self._tok.model.tokenize
        self._pieces = _Remembered(self._piece, cache_pieces)
        self._parts = _Remembered(self._part, max(1, cache_pieces // 4))

    def _ids(self, text: str) -> bytes:
        return array("I", self._tok.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _letters(self, before: str, part: str) -> bytes:
        """Ids of one pre-token of letters, straight from the merges."""
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array("I", [t.id for t in self._merge(before + shown)]).tobytes()

    def _words(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of letters; a line feed between them, a token by itself, tells where each ends."""
        out = []
        for at in range(0, len(pieces), WORDS):
            some = pieces[at : at + WORDS]
            text = "\n".join([p[1:] if p[0] == CUT else " " + p for p in some] + [""])
            shown = text.encode().decode("latin-1").translate(_BYTE_CHARS).replace(_FEED, f" {_FEED} ")
            ids = np.array(self._bare.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self._feed)
            if len(ends) != len(some):  # a vocabulary without the line feed, or without some byte
                out += map(self._piece, some)
                continue
            data, starts = ids.tobytes(), [0, *(ends + 1).tolist()]
            out += [data[4 * a : 4 * b] for a, b in zip(starts, ends.tolist())]
        return out

    def _part(self, part: str) -> bytes:
        """Ids of a pre-token that no space opens, or of marks with the space before them."""
        return self._letters("", part) if part.isalpha() else self._ids(part)

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece as if a space stood before it, or nothing where CUT begins it."""
        cut = piece[0] == CUT
        word = piece[1:] if cut else piece
        if word.isalpha():
            return self._letters("" if cut else _SPACE, word)
        end = word[-2:] if word[-1] == "\n" else word[-1]
        if end[0] in _MARKS and word[: -len(end)].isalpha():
            return self._pieces[piece[: -len(end)]] + self._parts[end]
        found = _PARTS.findall(word)
        if not found or sum(map(len, found)) != len(word):
            return self._ids(word if cut else " " + word)
        if found[0].isalpha():
            head = self._pieces[CUT + found[0] if cut else found[0]]
        else:
            head = self._parts[found[0] if cut else " " + found[0]]
        return head + b"".join(map(self._parts.__getitem__, found[1:]))

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Ids of texts whose pieces lie between single spaces."""
        pieces = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        told = pieces.values.dictionary_encode()
        often = np.bincount(told.indices, minlength=len(told.dictionary)) > 1
        found = self._pieces.all(told.dictionary.to_numpy(zero_copy_only=False).tolist(), often.tolist(), self._words)
        ids = pa.array(found, pa.large_binary()).take(told.indices)
        _, places, data = ids.buffers()
        ends = np.frombuffer(places, np.int64)[ids.offset + pieces.offsets.to_numpy()].tolist()
        return [data[a:b].to_pybytes() for a, b in zip(ends, ends[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes; a null text counts as empty.  The more texts come together, the fewer of their pieces are looked up."""
        out, cut = [], []
        for text in texts:
            if not text:
                out.append(b"")
            elif _UNSURE.search(text) or CUT in text or self._added and self._added.search(text):
                out.append(self._ids(text))
            else:
                out.append(None)
                text = _LINE.sub("\n " + CUT, text[1:] if text[0] == " " else CUT + text)
                text = _STOP.sub(" " + CUT + ".", _COMMA.sub(" " + CUT + ",", text))
                cut.append(_MARK.sub(" " + CUT + r"\g<0>", text))
        joined = iter(self._joined(cut) if cut else ())
        return [next(joined) if ids is None else ids for ids in out]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about TEXT_BYTES in a column of texts, or of one longer row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def encoder(path: str, cache_pieces: int = CACHE_PIECES) -> PieceEncoder:
    """One encoder per worker, vocabulary and size of the cache."""
    if (path, cache_pieces) not in _loaded:
        _loaded[path, cache_pieces] = PieceEncoder(path, cache_pieces)
    return _loaded[path, cache_pieces]
