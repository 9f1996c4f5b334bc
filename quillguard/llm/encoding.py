"""Fast, exact encoding with the tokenizers library.

Texts are cut where the pre-tokenizer always cuts, and the ids of each short piece are kept; so a word is encoded once a
worker. Arrow cuts some megabytes of text at single spaces and tells which pieces are equal, each different one is looked up
once, and the ids of the texts are gathered from one array. Texts with a control character that libraries class differently
(28 to 31) go through the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import threading
import time
from array import array
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A byte-level BPE with the common pattern: a run of other characters with the space before it is cut off on both sides;
#: white space is cut as the pattern cuts it.
BYTE_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: A BPE that drops white space: runs of other characters are independent.
WORD_PIECES = re.compile(r"\S+")
_ODD = "\x1c\x1d\x1e\x1f"
#: A byte-level BPE takes white space that follows a space together with it.
_RUN = re.compile(r" (?=\s|\Z)")
#: A line's end in a run of other white space than a space after it.
_LINES = re.compile(r"\n(?:(?<=\s\n)|(?=[^\S ]))")
_MARKS = ".,!?"
#: Pieces kept in a worker, about 200 bytes each, and the length up to which a piece is kept.
KEPT = 1_200_000
KEPT_CHARS = 48
#: Characters of the texts cut at once, and new pieces in one string for the tokenizer.
TOGETHER = 4_000_000
JOINED = 2000
#: Seconds without a text after which a worker, which other steps use again, drops what it keeps.
IDLE = 4


class _Ids:
    """Ids of numbered pieces, one after the other; piece 0 has none."""

    def __init__(self) -> None:
        self.flat, self.start, self.n = np.empty(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), 1

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """The number of the first new piece."""
        first, at = self.n, int(self.start[self.n])
        if first + len(sizes) >= len(self.start):
            self.start = np.concatenate((self.start, np.zeros(len(self.start) + len(sizes), np.int64)))
        if at + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty(len(self.flat) + len(ids), "<u4")))
        self.flat[at : at + len(ids)] = ids
        self.n += len(sizes)
        self.start[first + 1 : self.n + 1] = at + np.cumsum(sizes)
        return first

    def gather(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a row of pieces, and where each piece ends in them."""
        start = self.start[pieces]
        sizes = self.start[pieces + 1] - start
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(start - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


class CachedEncoder:
    """encode(text) gives the ids as bytes of little-endian unsigned 32-bit integers."""

    _of: dict = {}

    def __init__(self, path: str, pieces: re.Pattern, part: float = 1):
        """part: of the pieces kept and the characters cut at once, for less memory."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        added = self.t.get_added_tokens_decoder().values()
        self.added = tuple(a.content.lower() for a in added)
        #: Such tokens match normalized texts, of which pieces tell nothing.
        self.whole = any(a.normalized for a in added)
        self.pieces, self.folds = pieces, pieces is WORD_PIECES
        #: Part of a text (_key) -> its number in ids.
        self.kept: dict[str, int] = {}
        self.ids = _Ids()
        self.refused, self.most, self.together = 0, int(KEPT * part), int(TOGETHER * part)
        self._lock, self._used, self._watched = threading.Lock(), 0.0, False
        #: By id: whether a word ends with it, or its number of bytes (a byte is one character of such a vocabulary).
        self.sizes = np.zeros(max(self.t.get_vocab().values()) + 1, np.int64)
        for token, i in self.t.get_vocab().items():
            self.sizes[i] = token.endswith("</w>") if self.folds else len(token)

    @classmethod
    def of(cls, path: str, pieces: re.Pattern, part: float = 1) -> "CachedEncoder":
        """One a worker process."""
        key = (path, pieces.pattern, part)
        if key not in cls._of:
            cls._of[key] = cls(path, pieces, part)
        return cls._of[key]

    def direct(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        with self._lock:
            try:
                return self._all(texts)
            finally:
                self._used = time.monotonic()
                if not self._watched:
                    self._watched = True
                    threading.Thread(target=self._drop_when_idle, daemon=True).start()

    def _drop_when_idle(self) -> None:
        while True:
            time.sleep(max(0.05, self._used + IDLE - time.monotonic()))
            with self._lock:
                if time.monotonic() >= self._used + IDLE:
                    self.kept, self.ids, self.refused, self._watched = {}, _Ids(), 0, False
                    pa.default_memory_pool().release_unused()
                    return

    def _all(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        group, size = [], 0
        for i, text in enumerate(texts):
            if self._apart(text):
                out[i] = self.direct([text])[0]
                continue
            group.append(i)
            size += len(text)
            if size > self.together:
                self._some(texts, group, out)
                group, size = [], 0
        if group:
            self._some(texts, group, out)
        return out

    def _some(self, texts: list[str], group: list[int], out: list[bytes]) -> None:
        """Puts the ids of the texts with those numbers into out."""
        runs = [] if self.folds else [i for i in group if _RUN.search(texts[i])]
        if runs:
            apart = set(runs)
            group = [i for i in group if i not in apart]
        lines = [self._lines(texts[i]) for i in group]
        parts = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        edges = parts.offsets.to_numpy().astype(np.int64)
        told = parts.flatten().dictionary_encode()
        codes, keys = told.indices.to_numpy(), told.dictionary.to_numpy(zero_copy_only=False).tolist()
        if not self.folds:
            own: dict[str, int] = {}
            # no space is before the first part of a text
            first = [len(keys) + own.setdefault(" " + x.partition(" ")[0], len(own)) for x in lines]
            rest = [[len(keys) + own.setdefault(_key(p), len(own)) for p in self.pieces.findall(texts[i])] for i in runs]
            codes = np.concatenate((codes, *[np.array(x, np.int32) for x in rest]))
            codes[edges[:-1]] = first
            edges = np.concatenate((edges, edges[-1] + np.cumsum([len(x) for x in rest], dtype=np.int64)))
            keys += own
        numbers, keep = self._numbers(keys)
        ids, ends = self.ids.gather(numbers[codes])
        ends = np.concatenate(([0], ends))[edges].tolist()
        for i, lo, hi in zip([*group, *runs], ends, ends[1:]):
            out[i] = ids[lo:hi].tobytes()
        self.ids.n = keep

    def _lines(self, text: str) -> str:
        """Cut at line ends too: a part that begins with one has no space before it."""
        if self.folds:
            return text.replace("\n", " ")
        return text if _LINES.search(text) else text.replace("\n", " \n")

    def _apart(self, text: str) -> bool:
        if self.whole or any(c in text for c in _ODD):
            return True
        low = text.lower()  # as pieces are looked up in lower case
        return any(a in low for a in self.added)

    def _numbers(self, keys: list[str]) -> tuple[np.ndarray, int]:
        """The number of each part of a text, and the first number that isn't kept for later texts."""
        kept, before = self.kept, self.ids.n
        out = np.fromiter(map(kept.get, keys, repeat(-1)), np.int64, len(keys))
        lack = np.flatnonzero(out < 0)
        if not len(lack):
            return out, before
        keys = [keys[i] for i in lack.tolist()]
        word = np.fromiter(map(str.isalpha, keys), bool, len(keys)) & (np.fromiter(map(len, keys), np.int64, len(keys)) <= KEPT_CHARS)
        words, others = [*compress(keys, word)], [*compress(keys, ~word)]
        bases = [w.lower() if w.isascii() else w for w in words] if self.folds else words
        flat, sizes, folds, space = [], [], self.folds, "" if self.folds else " "
        for k in others:
            q = k[:-1]
            if q.isalpha() and k[-1] in _MARKS and q[-1] < "\u0250" and q[-1] != "İ" and len(q) > 1:  # as in _plain
                flat += (q.lower() if folds and q.isascii() else q, space + k[-1])
                sizes.append(2)
            else:
                flat += (own := self._cut(k))
                sizes.append(len(own))
        sizes = np.array(sizes, np.int64)
        stay = (np.fromiter(map(len, others), np.int64, len(others)) <= KEPT_CHARS) & (sizes <= 2)
        new = [x for x in dict.fromkeys([*bases, *flat]) if x not in kept]
        short, long = [x for x in new if len(x) <= KEPT_CHARS], [x for x in new if len(x) > KEPT_CHARS]
        own = self._added(short)
        number = lambda x: np.array([kept[k] if i is None else i for k, i in zip(x, map(own.get, x))], np.int64)
        out[lack[word]] = of_words = number(bases)
        at, first = lack[~word], np.cumsum(sizes) - sizes

        def put(on: np.ndarray) -> None:
            """Joins the pieces of those others."""
            n = sizes[on]
            flat_at = np.repeat(first[on] - np.cumsum(n) + n, n) + np.arange(n.sum())
            ids, ends = self.ids.gather(number([flat[i] for i in flat_at.tolist()]))
            ends = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n)))]
            out[at[on]] = self.ids.add(ids, np.diff(ends)) + np.arange(len(on))

        one = np.flatnonzero(stay & (sizes == 1))
        out[at[one]] = number([flat[i] for i in first[one].tolist()])
        put(np.flatnonzero(stay & (sizes != 1)))
        end = self.ids.n
        if long:
            own |= self._added(long)
        put(np.flatnonzero(~stay))
        more = len(short) + int(stay.sum()) + len(words) * self.folds
        if len(kept) + more <= self.most:
            kept.update(zip(short, map(own.get, short)))
            if self.folds:
                kept.update(zip(words, of_words.tolist()))
            kept.update(zip(compress(others, stay), out[at[stay]].tolist()))
            return out, end
        if (refused := self.refused + more) < self.most:
            self.refused = refused  # what came first is what is common
            return out, before
        kept.clear()  # other texts by now
        self.refused = 0
        return out, 1

    def _cut(self, key: str) -> list[str]:
        """The keys of the pieces of a part of a text, without a mark at the end and in lower case where that makes no difference."""
        if key.isalpha() or self._single(key):
            return self._plain(key)
        if self.folds:
            return [x for p in key.split() for x in self._plain(p)]
        return [x for p in self.pieces.findall(_piece(key)) for x in self._plain(_key(p))]

    def _single(self, key: str) -> bool:
        words = key.split()
        return len(words) == 1 and len(words[0]) == len(key) - (not self.folds and key[0] == " ")

    def _plain(self, k: str) -> list[str]:
        # a letter or digit and the mark that ends a piece are always cut (but the lower case of İ ends with a mark); case is dropped by one of the two kinds
        if len(k) > 2 and k[-1] in _MARKS and k[-2] < "\u0250" and k[-2] != "İ" and k[-2].isalnum():
            q = k[:-1]
            return [q.lower() if self.folds and q.isascii() else q, k[-1] if self.folds else " " + k[-1]]
        return [k.lower() if self.folds and k.isascii() else k]

    def _added(self, keys: list[str]) -> dict[str, int]:
        """Encodes the pieces of new keys: their numbers."""
        if self.folds:  # letters alone are one word, and its last id has the word's end
            easy = [k for k in keys if k.isalpha() and (k.isascii() or max(k) < "\u0250" and len(k.lower()) == len(k))]
        else:  # a space and no other white space: its bytes are those of its ids
            easy = [k for k in keys if not k[0].isspace()]
        own: dict[str, int] = {}
        for lo in range(0, len(easy) if len(easy) >= 8 else 0, JOINED):
            part = easy[lo : lo + JOINED]
            text = " ".join(part) if self.folds else " " + " ".join(part)
            ids = np.array(self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            if self.folds:
                ends = np.flatnonzero(self.sizes[ids]) + 1
                right = len(ends) == len(part) and ends[-1] == len(ids)
            else:
                seen, want = np.cumsum(self.sizes[ids]), np.cumsum(pc.binary_length(pa.array(part, pa.string())).to_numpy() + 1)
                right = seen[-1] == want[-1]
                ends = np.searchsorted(seen, want) + 1
                right = right and np.array_equal(seen[ends - 1], want)
            if right:  # else one by one, as the others
                at = self.ids.add(ids, np.diff(ends, prepend=0))
                own.update(zip(part, range(at, at + len(part))))
        if len(own) < len(keys):
            rest = [k for k in keys if k not in own]
            ids = [np.frombuffer(x, "<u4") for x in self.direct(rest if self.folds else [_piece(k) for k in rest])]
            at = self.ids.add(np.concatenate(ids), np.array([len(x) for x in ids]))
            own.update(zip(rest, range(at, at + len(rest))))
        return own


def _key(piece: str) -> str:
    """Of a byte-level piece: words are kept without the space before them, other pieces with one more (parts that begin with a line's end as they are)."""
    return piece[1:] if len(piece) > 1 and piece[0] == " " and not piece[1].isspace() else " " + piece


def _piece(key: str) -> str:
    return key[1:] if key[:1] == " " else key if key[:1] == "\n" else " " + key
