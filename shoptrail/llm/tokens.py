"""Token ids of whole texts by the tokenizers library, with a memory of the pieces between spaces.

The library splits a text into words before it merges, and no word goes over a space or a line end, or from a letter into a
mark, so the ids of a text are the ids of its pieces in a row. Each Python process keeps the pieces it has seen first, which
spares most of the work; texts in which white space meets white space, where a split could matter, are given to the
library whole. Many texts are taken at once: each different piece is looked up once, and one that is a word and marks is put together
from both.
"""
from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

HELD = 300_000  # pieces that a process keeps; others are encoded whenever they come
WORDS = 1 << 20  # the same for vocabularies without spaces, whose pieces have few ids
PORTION = 1 << 23  # bytes of texts that are taken at once, about

#: White space other than space and line end, white space that meets white space, marks that end many words, and
#: the letters whose lower case is one letter of the same kind.
ODD_SPACE = "\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ODD = f"[ \n][ \n]|[{ODD_SPACE}]"
RUN = ".,;:!?*&#$%"
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it can be seen, else the next free one."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + n) for n, b in enumerate(hidden)}


def portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(from, to) of texts in a row, of which those behind the first have PORTION bytes at most."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    edges = (np.flatnonzero(np.diff(ends // PORTION)) + 1).tolist()
    return zip([0, *edges], [*edges, len(texts)])


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that hold PORTION bytes of text, the second column, or a little more; the last one may hold less."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= PORTION:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all parts, one after the other, and how many each part has."""
    return np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4


def stretches(ids: np.ndarray, begin: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """The ids from each begin on, as many as wide says, one stretch after the other."""
    ends = np.cumsum(wide)
    return ids[np.repeat(begin - ends + wide, wide) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """ids(text): little-endian unsigned 32-bit ids of a text, without special tokens."""

    def __init__(self, path: str, spaces: bool):
        """path: a tokenizer file of the library; spaces: whether white space belongs to the ids and case counts, or the
        vocabulary is one of lower-case words without spaces."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives the cores out
        from tokenizers import Tokenizer
        self.tokenizer, self.spaces = Tokenizer.from_file(path), spaces
        # pieces at the start of a line, and marks behind a word; without spaces, the numbers of words in table
        self.first: dict[str, bytes] | dict[str, int] = {}
        self.later: dict[str, bytes] = {}
        self.table, self.width = np.empty(0, "<u4"), np.empty(0, np.int64)
        self.model = self.tokenizer.model
        if not spaces:
            self.model._resize_cache(0)  # the words it would hold do not come again
        self.line = self._whole("\n")
        self.letters = byte_letters()
        self.space = self.letters[32]

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _piece(self, piece: str, start: bool) -> bytes:
        """The ids of a piece without line ends; start: no space stands before it."""
        memory = self.first if start else self.later
        got = memory.get(piece)
        if got is not None:
            return got
        word = piece.rstrip(RUN)
        if not word.isalpha() or not word.isascii() and max(word) >= "\u0100":
            got = self._whole(piece if start else " " + piece)
        elif len(word) < len(piece):
            got = self._piece(word, start) + self._piece(piece[len(word):], True)
        else:  # one word of the vocabulary's own split
            got = self._word(word, "" if start else self.space)
        if len(memory) < HELD:
            memory[piece] = got
        return got

    def _word(self, word: str, before: str = "") -> bytes:
        word = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(before + word)]).tobytes()

    def _bare(self, word: str) -> bytes:
        """The ids of a lower-case word without marks, or of any other piece as it stands."""
        plain = word.isalpha() and (word.isascii() or max(word) < "\u0100")
        return self._word(word) if plain else self._whole(word)

    def _numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of different words in a table, its ids, and how many of them each word there has."""
        names = words.to_numpy(zero_copy_only=False).tolist()
        held = len(self.first)
        codes = np.fromiter(map(self.first.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(codes < 0)
        names = [names[i] for i in new.tolist()]
        codes[new] = np.arange(held, held + len(new))
        table, width = (np.concatenate(x) for x in zip((self.table, self.width), joined([self._bare(word) for word in names])))
        if held < WORDS:
            self.first.update(zip(names[:WORDS - held], range(held, held + len(names))))
            self.width = width[:len(self.first)]
            self.table = table[:self.width.sum()]
        return codes, table, width

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different pieces, one after the other, and how many each has, for a vocabulary of lower-case words without spaces.
        A word is looked up apart from its case and the marks behind it, and a piece that is no such word as it stands."""
        words, marks = pc.utf8_rtrim(pieces, characters=RUN), pc.utf8_ltrim(pieces, characters=LETTERS)
        plain = pc.equal(pc.add(pc.binary_length(words), pc.binary_length(marks)), pc.binary_length(pieces))
        words, marks = pc.if_else(plain, pc.utf8_lower(words), pieces), pc.if_else(plain, marks, "")
        coded = pc.dictionary_encode(pa.concat_arrays([words, marks]))
        codes, ids, width = self._numbers(coded.dictionary)
        codes = codes[coded.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T.ravel()]  # the word and the marks of each piece
        wide = width[codes]
        return stretches(ids, (np.cumsum(width) - width)[codes], wide), wide[::2] + wide[1::2]

    def _line(self, piece: str) -> bytes:
        """The ids of a piece that is not in memory; it stands behind a space or begins with a line end."""
        return self.line + self._piece(piece[1:], True) if piece[:1] == "\n" else self._piece(piece, False)

    def ids(self, text: str) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0].tobytes()

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after the other, and how many each text has; a null is an empty text."""
        texts = pc.fill_null(texts, "")
        if self.spaces:
            # each line begins with a line end, the first one too, so that its first piece differs from those behind a space
            odd = pc.match_substring_regex(texts, ODD)
            texts, wholes = pc.if_else(odd, "", texts), texts.filter(odd)
            lists = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        else:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pc.dictionary_encode(lists.flatten())
        codes = coded.indices.to_numpy(zero_copy_only=False)
        offsets = lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        if self.spaces:
            pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            found = list(map(self.later.get, pieces))
            for i in [i for i, x in enumerate(found) if x is None]:
                found[i] = self._line(pieces[i])
            if len(wholes):
                codes = codes.copy()
                codes[offsets[:-1][odd.to_numpy(zero_copy_only=False)]] = np.arange(len(wholes)) + len(found)
                found += [self.line + self._whole(text) for text in wholes.to_pylist()]
            ids, width = joined(found)
        else:
            ids, width = self._pieces(coded.dictionary)
        begin, wide = (np.cumsum(width) - width)[codes], width[codes]
        if self.spaces:  # without the line end before each text
            begin[offsets[:-1]] += 1
            wide[offsets[:-1]] -= 1
        ends = np.concatenate(([0], np.cumsum(wide)))
        return stretches(ids, begin, wide), np.diff(ends[offsets])


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaces: bool) -> Encoder:
    """The encoder of this Python process."""
    if (path, spaces) not in _ENCODERS:
        _ENCODERS[path, spaces] = Encoder(path, spaces)
    return _ENCODERS[path, spaces]
