"""Token ids of whole texts, inside a task.

Defined results: the ids are those that the library gives the whole text; a null text is to be made empty before, and the
empty text has no ids but the end id; equal texts have equal ids, whatever was encoded before them; no texts give no ids.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np

#: Pieces that are remembered; beyond either bound the memory starts anew.
MOST_PIECES = 700_000
MOST_PIECE_CHARS = 35_000_000

#: Blanks other than space and line end; texts that have one are encoded as a whole, too.
_BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
_ENCODERS: dict[str, "PieceEncoder"] = {}


def _has_run(text: str) -> bool:
    """Whether a space may have a blank on either side; these searches are much faster than a pattern's."""
    return "  " in text or "\n" in text and ("\n " in text or " \n" in text) or any(c in text for c in _BLANKS)


class _Numbered(dict):
    """Numbers its keys in order of first look-up."""

    def __missing__(self, key):
        self[key] = at = len(self)
        return at


class PieceEncoder:
    """Encodes texts with a tokenizer of the tokenizers library, a piece between spaces at a time.

    Both public pre-tokenizers always split before a single space, and between a Latin letter and a mark of
    ``MARKS`` (but for a dotted capital i, which lower case takes apart). So ids of a text are those of its pieces, each with its leading space, one after the other, and those of
    a word with a mark are the word's and the mark's. Each distinct piece is encoded once while it is remembered.
    Texts with two blanks in a row are encoded as a whole.
    """

    MARKS = ",.!?;:"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.mark = {m: self._ids(["a" + m])[0][-1] for m in self.MARKS}
        # A string between pieces that always becomes one id of its own, so that many pieces are encoded at once.
        self.between = next(((text, ids[0]) for text in ("\n", " \x01") if len(ids := self._ids([text])[0]) == 1), None)
        self._start([], np.empty(0, np.uint32), np.empty(0, np.int64))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _start(self, keys: list, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.numbers = _Numbered(zip(keys, range(len(keys))))
        self.known, self.chars, self.used = len(keys), sum(map(len, keys)), len(flat)
        self.flat, self.length = _room(flat, 1 << 16), _room(lengths, 1 << 14)
        self.start = _room(np.cumsum(lengths) - lengths, 1 << 14)
        self.uses = np.zeros(1 << 14, np.int64)

    def _forget(self) -> None:
        """Keep what was used again and again, half of the bounds at most."""
        uses = self.uses[: self.known]
        keep = np.flatnonzero(uses > 2)
        keep = np.sort(keep[np.argsort(-uses[keep], kind="stable")[: MOST_PIECES // 2]])
        keys = list(self.numbers)
        keys = [keys[i] for i in keep]  # a first piece of a text, a tuple, is seldom seen again
        if sum(map(len, keys)) > MOST_PIECE_CHARS // 2:
            keys, keep = [], keep[:0]
        self._start(keys, self._gather(keep), self.length[keep])

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """Ids of the pieces of these numbers, one after the other."""
        lengths = self.length[at]
        ends = np.cumsum(lengths)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - (ends - lengths), lengths)]

    def _learn(self) -> None:
        keys, plain, single, marked = _tail(self.numbers, len(self.numbers) - self.known), [], [], []
        for at, key in enumerate(keys, self.known):
            if isinstance(key, tuple) or not key or not key.isprintable() or not self.between:
                single.append((at, key))
            elif key[-1] in self.mark and (word := key[:-1]).isalpha() and max(word) < "\u0250" and "\u0130" not in word:
                marked.append((at, self.numbers[word], self.mark[key[-1]]))
            else:
                plain.append((at, key))
        first = self.known + len(keys)
        plain += enumerate(_tail(self.numbers, len(self.numbers) - first), first)  # words that only marked pieces have
        n = len(self.numbers)
        self.length, self.start, self.uses = _room(self.length, n), _room(self.start, n), _room(self.uses, n)
        self.uses[self.known : n] = 0
        if plain:
            joined = [self.between[0].join(" " + k for _, k in plain[i : i + 256]) for i in range(0, len(plain), 256)]
            end = np.array([self.between[1]], np.uint32)
            flat = np.concatenate([x for ids in self._ids(joined) for x in (np.array(ids, np.uint32), end)])
            ends = np.flatnonzero(flat == end[0])
            lengths = np.diff(ends, prepend=-1) - 1
            self._add(np.array([at for at, _ in plain]), lengths, np.delete(flat, ends))
        if single:
            ids = self._ids([k[0] if isinstance(k, tuple) else " " + k for _, k in single])
            self._add(np.array([at for at, _ in single]), np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter((i for x in ids for i in x), np.uint32))
        if marked:
            at, words, marks = (np.array(x) for x in zip(*marked))
            self._add(at, self.length[words] + 1, np.insert(self._gather(words), np.cumsum(self.length[words]), marks.astype(np.uint32)))
        self.chars += sum(map(len, keys)) + sum(len(k[0]) for _, k in single if isinstance(k, tuple))
        self.known = n

    def _add(self, at: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
        self.flat = _room(self.flat, self.used + len(flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.length[at] = lengths
        self.start[at] = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        if len(self.numbers) > MOST_PIECES or self.chars > MOST_PIECE_CHARS:
            self._forget()
        whole = [i for i, t in enumerate(texts) if _has_run(t)]
        direct = dict(zip(whole, self._ids([texts[i] for i in whole]))) if whole else {}
        number, found, pieces_of = self.numbers.__getitem__, [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text and i not in direct:
                first, *rest = text.split(" ")
                found.append(number((first,)))
                found.extend(map(number, rest))
                pieces_of[i] = 1 + len(rest)
        self._learn()
        at = np.array(found, np.int64)
        self.uses[: self.known] += np.bincount(at, minlength=self.known)
        flat = self._gather(at)
        bounds = np.concatenate([[0], np.cumsum(self.length[at])])[np.concatenate([[0], np.cumsum(pieces_of)])]
        counts = np.diff(bounds)
        if not direct:
            return flat, counts
        parts = [np.array(direct[i], np.uint32) if i in direct else flat[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def _tail(numbers: dict, n: int) -> list:
    out = []
    for key in reversed(numbers):
        if len(out) == n:
            break
        out.append(key)
    return out[::-1]


def _room(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    larger = np.zeros(max(n, 2 * len(array)), array.dtype)
    larger[: len(array)] = array
    return larger


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a vocabulary file; it outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def slices(texts: Iterable[str | None], most_chars: int = 4_000_000) -> Iterable[tuple[int, list[str]]]:
    """The texts in order, a bounded number of characters at a time (one text at least), with each part's first index."""
    first, part, chars = 0, [], 0
    for text in texts:
        text = text or ""
        if part and chars + len(text) > most_chars:
            yield first, part
            first, part, chars = first + len(part), [], 0
        part.append(text)
        chars += len(text)
    if part:
        yield first, part


def with_end(flat: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end`` after each text's."""
    return np.insert(flat, np.cumsum(counts), np.uint32(end)), counts + 1
