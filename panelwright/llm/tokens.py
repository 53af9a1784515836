"""Token ids of whole texts by a public tokenizer, with a memo of pieces that no context reaches into.

Pre-tokenisation cuts a text at white space, so the ids of a piece between two cuts depend on the piece alone, and
a word met before need not be encoded again. Texts in which that is not certain (rare white space, strings of added
tokens) go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .flat import LETTER, Rows, hashes, kinds, runs

#: White space and format characters on which libraries may disagree; the texts that hold them are encoded whole.
UNSURE_CLASS = "\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
UNSURE = re.compile("[" + UNSURE_CLASS + "]")
#: Letters beyond ASCII that stay letters when they are normalised and lower-cased: fixed values.
LETTERS = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0391-\u03a1\u03b1-\u03c1\u03c4-\u03c9\u0410-\u044f\u4e00-\u9fa5\uac00-\ud7a3"
#: A word with the one space before it, or white space as a byte-level pre-tokenizer cuts it.
SPACED = re.compile(r" ?[^ \t\n\r]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
LONG_PIECE = 200
_KINDS = kinds()
#: The characters that stand for bytes in a byte-level vocabulary: printable ones themselves, the others numbered from 256.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = dict(zip(sorted(set(range(256)) - set(_PLAIN)), range(256, 512)))  # noqa: B905


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Memo:
    """ids or counts of pieces; holds at most `limit` pieces and starts anew when full, which changes no result."""

    def __init__(self, path: str, spaced: bool, limit: int = 800_000):
        self.tokenizer, self.spaced, self.limit, self.known = load(path), spaced, limit, {}
        self.model, self.ends = self.tokenizer.model, {}
        self.ends = {c: self.one(c) for c in ".,"}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def pieces(self, text: str) -> list[str] | None:
        if UNSURE.search(text) or any(a in text for a in self.added):
            return None
        return SPACED.findall(text)

    def learn(self, new: list[str]) -> dict:
        """Encodes new pieces many at a time: joined so that none touches another, and told apart by offsets."""
        out, odd, led, rest = {}, [], [], []
        for p in new:
            core = p[1:] if p[0] == " " else p
            end = core[-1:] if core[-1:] in self.ends else ""
            core = core[: len(core) - len(end)]
            core = core if self.spaced else core.lower()
            if core.isascii() and core.isalpha():  # one pre-token, and one for the sign that follows
                out[p] = self.of_tokens(self.model.tokenize("\u0120" + core if p[0] == " " else core), end)
            elif not p.strip():
                odd.append(p)
            else:
                (led if p[0] == " " else rest).append(p)
        for some, gap in ((led, ""), (rest, "\n")):
            if some:
                encoding = self.tokenizer.encode(gap.join(some), add_special_tokens=False)
                sizes = np.fromiter(map(len, some), np.int64, len(some)) + len(gap)
                starts = np.cumsum(sizes) - sizes
                begins = np.fromiter((o[0] for o in encoding.offsets), np.int64, len(encoding))
                at = np.searchsorted(starts, begins, "right") - 1
                inside = begins < starts[at] + sizes[at] - len(gap)
                out |= self.values(np.array(encoding.ids, np.int64)[inside], np.bincount(at[inside], minlength=len(some)), some)
        return out | {p: self.one(p) for p in odd}

    def one(self, piece: str):
        ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return self.values(np.array(ids, np.int64), np.array([len(ids)]), [piece])[piece]

    def values(self, ids, sizes, new: list[str]) -> dict:
        raise NotImplementedError

    def of_tokens(self, tokens: list, end: str):
        raise NotImplementedError

    def look_up(self, pieces: list[str]) -> list:
        try:
            return [self.known[p] for p in pieces]
        except KeyError:
            pass
        if len(self.known) > self.limit:
            self.known = {}
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        here = self.learn(new)
        self.known.update((p, v) for p, v in here.items() if len(p) <= LONG_PIECE)
        known = self.known
        return [known[p] if p in known else here[p] for p in pieces]


class Counts(Memo):
    def __init__(self, path: str, limit: int = 800_000):
        super().__init__(path, True, limit)

    def values(self, ids, sizes, new):
        return dict(zip(new, sizes.tolist(), strict=True))

    def of_tokens(self, tokens, end):
        return len(tokens) + (self.ends[end] if end else 0)

    def count(self, text: str) -> int:
        if (pieces := self.pieces(text)) is None:
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        return sum(self.look_up(pieces))


def _with_endings(data: np.ndarray, kind: np.ndarray, new: np.ndarray) -> None:
    """An apostrophe and the letters after it are one run: an English ending, or a sign and letters that fare alike."""
    mark = np.flatnonzero(data[:-1] == 39)
    new[mark[new[mark] & (kind[mark + 1] == LETTER)] + 1] = False


class Ids(Memo):
    """ids of a lower-casing tokenizer that cuts texts into runs of letters, single digits, runs of other signs, and the
    English endings after an apostrophe. Runs are found and looked up by array operations, each encoded once.
    """

    def __init__(self, path: str, limit: int = 1_500_000):
        super().__init__(path, False, limit)
        self.odd = "[^\\x00-\\x08\t\n\r\\x0e-\\x1b -\\x7f" + LETTERS + "]|" + "|".join(map(re.escape, self.added))
        self._clear()

    def _clear(self) -> None:
        self.rows, self.flat = Rows(), np.zeros(0, np.uint32)
        self.sizes = np.zeros(0, np.int64)

    def values(self, ids, sizes, new):
        ends = np.cumsum(sizes).tolist()
        return {p: ids[e - s : e].tolist() for p, e, s in zip(new, ends, sizes.tolist(), strict=True)}

    def learn(self, new):
        """Runs of letters are one pre-token, so the model alone encodes them; others go through the whole tokenizer."""
        tokenize, out, signs = self.model.tokenize, {}, []
        for p in new:
            if p[0].isalpha():
                out[p] = [t.id for t in tokenize(p if p.isascii() else p.lower().encode().decode("latin-1").translate(_BYTES))]
            else:
                signs.append(p)
        return out | (super().learn(signs) if signs else {})

    def of_tokens(self, tokens, end):
        return [t.id for t in tokens] + (self.ends[end] if end else [])

    def batch(self, texts: pa.Array) -> list[memoryview]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        odd = pc.match_substring_regex(texts, self.odd)
        data, a, b, upto = runs(pc.ascii_lower(pc.if_else(odd, "", texts)), _KINDS, _with_endings)
        h = hashes(data, a, b)
        if len(self.rows) > self.limit:
            self._clear()
        row = self.rows.of(h)
        if (gone := np.flatnonzero(row < 0)).size:
            fresh, where = np.unique(h[gone], return_index=True)
            where = gone[where]
            strings = [data[i:j].tobytes().decode() for i, j in zip(a[where].tolist(), b[where].tolist(), strict=True)]
            got = self.learn(strings)
            lists = [got[s] for s in strings]
            self.rows.add(fresh)
            self.sizes = np.append(self.sizes, np.fromiter(map(len, lists), np.int64, len(lists)))
            self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(lists), np.uint32))
            row = self.rows.of(h)
        size, ends = self.sizes[row], np.cumsum(self.sizes)
        begin = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat((ends - self.sizes)[row] - begin[:-1], size) + np.arange(begin[-1])]
        view, places = memoryview(ids.astype("<u4")).cast("B"), (begin[upto] * 4).tolist()
        out = [view[i:j] for i, j in zip(places[:-1], places[1:], strict=True)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = memoryview(np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")).cast("B")
        return out


_memos: dict = {}


def memo(kind: type, path: str):
    """One memo for a worker process, so that tasks that follow each other share it."""
    key = (kind, path)
    if key not in _memos:
        _memos[key] = kind(path)
    return _memos[key]
