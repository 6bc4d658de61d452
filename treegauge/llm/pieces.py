"""Token ids of short pieces of text, each distinct piece encoded once per worker."""

from __future__ import annotations

import os
from itertools import islice, repeat
from unicodedata import is_normalized

import numpy as np

#: Distinct pieces that a worker remembers at most, and those it keeps then: the first it
#: met, among which the frequent ones are.
REMEMBERED, KEPT = 600_000, 300_000
#: Bytes of text in one call of the tokenizer.
CALL_BYTES = 1 << 18

_LOADED: dict[tuple[str, bool], "PieceTokens"] = {}


class PieceTokens:
    """Remembers length and ids of every piece it has met.

    Pieces must be cut where the tokenizer itself always cuts.  New pieces go
    to the tokenizer in calls of about CALL_BYTES.  Plain words, behind a space
    of their own for a byte-level vocabulary, are joined as they would stand
    in a text, and the tokenizer tells which word a token belongs to.  Other
    pieces have one of its own special strings between them, whose id marks
    their ends; a piece that holds such a string is encoded alone.
    """

    def __init__(self, path: str, keep_ids: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.keep_ids = keep_ids
        # A vocabulary that drops white space has a normalizer for it; the other kind keeps it.
        self.joint = " " if self.tokenizer.normalizer is not None else ""
        added = self.tokenizer.get_added_tokens_decoder()
        self.specials = [t.content for t in added.values()]
        between = [(i, t.content) for i, t in added.items()
                   if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark = between[0] if between else None
        self._empty()

    def _empty(self) -> None:
        self.index: dict[str, int] = {}
        self.lengths = np.zeros(1 << 16, np.int64)
        self.starts = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18 if self.keep_ids else 0, np.uint32)
        self.used = 0

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """Each piece's place in `lengths` and `starts`; good until the next call."""
        if len(self.index) > REMEMBERED:
            self.rest()
        found = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(found < 0)
        if len(new):
            self._learn(list(dict.fromkeys(pieces[i] for i in new)))
            found[new] = np.fromiter((self.index[pieces[i]] for i in new), np.int64, len(new))
        return found

    def rest(self) -> None:
        """Forget all but the first KEPT pieces, as at the end of a task."""
        if len(self.index) > KEPT:
            self.index = dict(islice(self.index.items(), KEPT))
            self.used = int(self.starts[KEPT])

    def lengths_of(self, pieces: list[str]) -> np.ndarray:
        numbers = self.numbers(pieces)  # first: it may replace the arrays
        return self.lengths[numbers]

    def flat(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of all pieces, one after the other."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[numbers] - (ends - lengths), lengths)
        return self.ids[shift + np.arange(len(shift))]

    def _learn(self, pieces: list[str]) -> None:
        alone = [p for p in pieces if self.mark is None or any(s in p for s in self.specials)]
        odd = set(alone)
        others = []
        words = []
        for piece in pieces:
            if piece not in odd:
                (words if self._is_word(piece) else others).append(piece)
        for own, encode in ((words, self._encode_words), (others, self._encode)):
            group: list[str] = []
            size = 0
            for piece in own:
                group.append(piece)
                size += len(piece)
                if size >= CALL_BYTES:
                    encode(group)
                    group, size = [], 0
            if group:
                encode(group)
        for piece in alone:
            ids = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, np.uint32)
            self._store([piece], ids, np.array([len(ids)]))

    def _is_word(self, piece: str) -> bool:
        """Letters alone, before and after normalisation: one word to the tokenizer."""
        if self.joint:
            return piece.isalpha() and (piece.isascii() or (
                piece.lower().isalpha() and is_normalized("NFC", piece)))
        return piece[:1] == " " and piece[1:].isalpha()

    def _encode_words(self, group: list[str]) -> None:
        made = self.tokenizer.encode(self.joint.join(group), add_special_tokens=False)
        of = np.array(made.word_ids, np.int64)
        lengths = np.bincount(of, minlength=len(group))
        if len(lengths) != len(group) or (lengths == 0).any() or (np.diff(of) < 0).any():
            self._encode(group)
        else:
            self._store(group, np.array(made.ids, np.uint32), lengths)

    def _encode(self, group: list[str]) -> None:
        number, mark = self.mark
        ids = np.array(self.tokenizer.encode(mark.join(group), add_special_tokens=False).ids,
                       np.uint32)
        marks = np.flatnonzero(ids == number)
        if len(marks) != len(group) - 1:
            raise ValueError("the special string does not separate pieces in this tokenizer")
        bounds = np.concatenate([[-1], marks, [len(ids)]])
        self._store(group, np.delete(ids, marks), np.diff(bounds) - 1)

    def _store(self, group: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.index)
        last = first + len(group)
        while last > len(self.lengths):
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.lengths[first:last] = lengths
        self.index.update(zip(group, range(first, last), strict=True))
        if self.keep_ids:
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.starts[first:last] = self.used + np.cumsum(lengths) - lengths
            self.ids[self.used:self.used + len(ids)] = ids
            self.used += len(ids)


def loaded(path: str, keep_ids: bool = False) -> PieceTokens:
    """The worker's own, kept from task to task."""
    if (path, keep_ids) not in _LOADED:
        _LOADED[path, keep_ids] = PieceTokens(path, keep_ids)
    return _LOADED[path, keep_ids]
