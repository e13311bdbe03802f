"""Token ids of whole texts with a word cache, in bounded batches.

The pre-tokenizers used here never join characters across the place where
a single space follows a word, so a text is encoded as its words, each with
the space before it, and equal words are encoded once. A word goes through
the file's own normalizer, pre-tokenizer and model. Texts with runs of
white space are cut only where white space follows a word. The ids are
those of encoding the whole text (tested against it).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LATIN = re.compile("[\x00-\xff]*")
#: Two characters of white space (Python's), as Arrow writes it.
RUN = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
#: A word with the white space before it, or white space at the end. The
#: files' white space is Unicode's: without Python's U+001C to U+001F.
WORD = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: Words held before a worker's cache starts anew, and a quarter as many pieces
#: of words that stand after no space.
CACHE_WORDS = 400_000
#: Characters or bytes of text handled at once.
CHUNK = 4 << 20
#: Bytes of text encoded at once: fewer distinct words to look up, more memory.
ENCODE_BYTES = 4 << 20


class _Words:
    """Slots of encoded words: words after a space are kept without it, in
    ``spaced``; all others with the white space before them, in ``whole``."""

    def __init__(self):
        self.spaced: dict[str, int] = {}
        self.whole: dict[str, int] = {}
        self.ends: dict[int, int] = {}
        self.ids, self.first = array("I"), array("q", [0])

    def add(self, ids: Iterable[int]) -> int:
        self.ids.extend(ids)
        self.first.append(len(self.ids))
        return len(self.first) - 2

    def of(self, slot: int) -> array:
        return self.ids[self.first[slot] : self.first[slot + 1]]

    def __len__(self) -> int:
        return len(self.first) - 1


class WordEncoder:
    """Encodes texts with a tokenizers file; keeps what words encode to."""

    def __init__(self, path: str, limit: int | None = None):
        from tokenizers import Tokenizer

        self.limit = limit or CACHE_WORDS
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.normalizer, self.cutter, self.model = (getattr(self.tokenizer, k) for k in ("normalizer", "pre_tokenizer", "model"))
        # what the file makes of Latin-1 letters after a space, asked letter
        # by letter, and of a run of punctuation after them, as it comes up;
        # what it puts before the letters after a space and after a line end
        self.mark = self._cut(" Ab")[0][:-2]
        line = self._cut("\nAb")
        self.line, self.line_mark = line[:-1], line[-1][:-2]
        letters = [chr(c) for c in range(256) if chr(c).isalpha()]
        self.letters = {ord(c): self._cut(f" {c}")[0].removeprefix(self.mark) for c in letters}
        ascii_letters = [c for c in letters if c.isascii()]
        self.keeps = all(self.letters[ord(c)] == c for c in ascii_letters)
        self.lowers = all(self.letters[ord(c)] == c.lower() for c in ascii_letters)
        self.tails: dict[str, tuple[int, ...]] = {"": ()}
        self.words = _Words()
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _cut(self, text: str) -> list[str]:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return [p for p, _ in self.cutter.pre_tokenize_str(text)]

    def _ids(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece)]

    def _piece(self, piece: str) -> tuple[int, ...]:
        got = self.pieces.get(piece)
        if got is None:
            got = self.pieces[piece] = tuple(self._ids(piece))
        return got

    def _tail(self, run: str) -> tuple[int, ...]:
        got = self.tails.get(run)
        if got is None:
            if len(self.tails) > 10_000:
                self.tails = {"": ()}
            got = self.tails[run] = tuple([x for piece in self._cut(f" Ab{run}")[1:] for x in self._piece(piece)])
        return got

    def _letters(self, plain: str) -> str | None:
        """What the file makes of Latin-1 letters; None for other words."""
        if not plain.isalpha():
            return None
        if plain.isascii() and (self.keeps or self.lowers):
            return plain if self.keeps else plain.lower()
        return plain.translate(self.letters) if LATIN.fullmatch(plain) else None

    def _plain(self, word: str, mark: str) -> tuple[int, ...] | None:
        """Ids of letters and punctuation behind them; None for other words."""
        plain = word.rstrip(punctuation)
        letters = self._letters(plain)
        if letters is None:
            return None
        got = self._piece(mark + letters)
        return got if len(plain) == len(word) else got + self._tail(word[len(plain) :])

    def _spaced(self, word: str) -> int:
        """A new slot of a word after a space; letters with punctuation behind
        them take the ids of the letters, which are a word too."""
        letters = self._letters(word)
        if letters is not None:
            return self.words.add(self._ids(self.mark + letters))
        plain = word.rstrip(punctuation)
        if plain == word or self._letters(plain) is None:
            return self.words.add(self._whole(" " + word))
        return self.words.add(self.words.of(self._slot(plain)) + array("I", self._tail(word[len(plain) :])))

    def _whole(self, word: str) -> tuple[int, ...]:
        """Ids of a word with its leading white space, cut by the file's rules."""
        if word[0] == "\n":
            got = self._plain(word[1:], self.line_mark)
            if got is not None:
                return tuple([x for piece in self.line for x in self._piece(piece)]) + got
        return tuple([x for piece in self._cut(word) for x in self._piece(piece)])

    def _slot(self, word: str) -> int:
        """The slot of a word after a space, or after a line end that it begins with."""
        slot = self.words.spaced.get(word)
        if slot is None:
            if word[:1] == "\n":
                return self._whole_slot(word)
            slot = self.words.spaced[word] = self._spaced(word)
        return slot

    def _whole_slot(self, word: str) -> int:
        slot = self.words.whole.get(word)
        if slot is None:
            slot = self.words.whole[word] = self.words.add(self._whole(word))
        return slot

    def _slots(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all words, and how many each text has.

        Arrow cuts the texts and numbers their words; Python sees each
        distinct word of the column once.
        """
        # a line end becomes a word's beginning, so one cut at spaces does
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        at, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        offsets = offsets - offsets[0]
        slots = np.fromiter(map(self._slot, known), np.int64, len(known))[at]
        # the first word of a text stands after nothing; if empty, it is none
        counts, first = np.diff(offsets), offsets[:-1]
        keep = np.ones(len(slots), bool)
        for place in first[counts > 0].tolist():
            word = known[at[place]]
            if word:
                slots[place] = self._whole_slot(word)
            else:
                keep[place] = False
        counts = np.add.reduceat(np.append(keep, False).astype(np.int64), offsets[:-1]) * (counts > 0) if len(counts) else counts
        return slots[keep], counts

    def encode(self, texts: list[str] | pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the offset of each text's first id; ``end`` follows each text."""
        column = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        if len(self.words) > self.limit:
            self.words = _Words()
        if len(self.pieces) > self.limit // 4:
            self.pieces = {}
        odd = np.flatnonzero(pc.match_substring_regex(column, RUN).to_numpy(zero_copy_only=False))
        if len(odd):
            mask = np.zeros(len(column), bool)
            mask[odd] = True
            slots, counts = self._slots(pc.if_else(pa.array(mask), "", column))
            before = np.concatenate(([0], np.cumsum(counts)))
            parts, at = [], 0
            for i in odd.tolist():
                own = [self._whole_slot(w) for w in WORD.findall(column[i].as_py())]
                parts += [slots[at : before[i]], np.array(own, np.int64)]
                at, counts[i] = before[i], len(own)
            slots = np.concatenate([*parts, slots[at:]])
        else:
            slots, counts = self._slots(column)
        starts = np.concatenate(([0], np.cumsum(counts)))
        if end is not None:
            if end not in self.words.ends:
                self.words.ends[end] = self.words.add((end,))
            slots = np.insert(slots, starts[1:], self.words.ends[end])
            starts = starts + np.arange(len(starts))
        if not len(slots):
            return np.zeros(0, np.uint32), starts * 0
        flat = np.array(self.words.ids, np.uint32)
        first = np.array(self.words.first, np.int64)
        begin, lengths = first[slots], np.diff(first)[slots]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        number = np.int32 if max(ends[-1], len(flat)) < 1 << 31 else np.int64
        place = np.repeat((begin - ends[:-1]).astype(number), lengths)
        place += np.arange(ends[-1], dtype=number)
        return flat[place], ends[starts]


@lru_cache(maxsize=1)
def encoder(path: str, limit: int | None = None) -> WordEncoder:
    """The worker's encoder of a file: a reused worker keeps its cache of about ``limit`` words."""
    return WordEncoder(path, limit)


def column_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) in slices of about ``limit`` bytes, or a row."""
    pa.default_memory_pool().release_unused()
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        used = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, used + limit, side="right")))
        yield at, column.slice(at, stop - at)
        at = stop


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in pieces of about ``limit`` characters; null is empty."""
    first, size, held = 0, 0, []
    for at in range(0, len(column), 256):
        for i, text in enumerate(column.slice(at, 256).to_pylist(), at):
            text = text or ""
            if held and size + len(text) > limit:
                yield first, held
                first, size, held = i, 0, []
            held.append(text)
            size += len(text)
    if held:
        yield first, held
