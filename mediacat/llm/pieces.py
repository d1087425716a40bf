"""Byte-pair encoding of many texts at once, with the results of the tokenizers library.

A batch of texts becomes one array of UTF-8 bytes. Pre-tokens are found with array operations from the class of each
character; classes beyond ASCII are asked from the library, once a character. Every distinct pre-token is merged once
per worker and kept in a bounded table; a pre-token counts as known only after its bytes are compared. Texts are cut at
the tokenizer's special strings first.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
from tokenizers import Tokenizer

from mediacat.llm.common import text_groups
from mediacat.llm.words import LONG, CharClasses, Column, Table, bytes_of, distinct, gather, joined

LETTER, NUMBER, OTHER, SPACE, END = range(5)
#: Distinct pre-tokens that a worker remembers before it starts anew, and bytes of those longer than LONG.
TABLE_ROWS, LONG_BYTES = 400_000, 1 << 23
NONE = np.int32(2**31 - 1)


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible, else from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class LibraryClasses(CharClasses):
    """Classes of characters as the library's own pre-tokenizer treats them."""

    def __init__(self, library: Tokenizer) -> None:
        self.spans = lambda text: {span for _, span in library.pre_tokenizer.pre_tokenize_str(text)}
        super().__init__(END)

    def joins(self, before: str, c: str) -> bool:
        return (0, 2) in self.spans(before + c)

    def ask(self, c: str) -> int:
        for kind, before in ((LETTER, "a"), (OTHER, "!"), (NUMBER, "1")):
            if self.joins(before, c):
                return kind
        return NUMBER if self.spans(c) and not self.joins(c, c) else SPACE  # white space is dropped or goes in runs


def starts_of(chars: np.ndarray, kind: np.ndarray, spaced: bool) -> np.ndarray:
    """True where a pre-token starts. spaced: one blank belongs to the pre-token after it and digits go in runs;
    otherwise white space is dropped and every digit stands alone."""
    n = len(chars)
    start = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    solid = np.zeros(n + 1, bool)
    np.less(kind, SPACE, out=solid[:n])
    if spaced:
        last = np.flatnonzero((kind == SPACE) & solid[1:])  # of a run of white space
        for _ in range(3):
            last -= chars[last] & 0xC0 == 0x80  # back to its first byte
        start[last] = True
        start[last[chars[last] == 32] + 1] = False
    else:
        start |= (kind == NUMBER) & (chars & 0xC0 != 0x80)
    quote = np.flatnonzero((chars == 39) & start)
    quote = quote[quote + 1 < n]
    a = chars[quote + 1]
    b = chars[np.minimum(quote + 2, n - 1)]
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    for hit, k in ((one, 2), (two, 3)):
        at = quote[hit]
        start[at + 1] = False
        if k == 3:
            start[at + 2] = False
        start[at + k] = True  # in range: a text ends with the END character
    return start


class Encoder:
    """Token ids or counts of texts, equal to those of one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.spaced = not self.suffix
        self.lower = bool(spec.get("normalizer"))
        vocab: dict[str, int] = model["vocab"]
        self.vocab = vocab
        self.special_ids = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, self.special_ids))) if self.special_ids else None
        self.alphabet = _byte_alphabet()
        self.classes = LibraryClasses(self.library)
        self.first = np.array([vocab[x] for x in self.alphabet], np.int32)
        self.final = np.array([vocab[x + self.suffix] for x in self.alphabet], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.pair, self.pair_rank = keys[order], order.astype(np.int32)
        self.pair_to = np.array([vocab["".join(pairs[i])] for i in order], np.int32)
        self.proven = Table()
        self.forget()

    def forget(self) -> None:
        self.table, self.start, self.count_of, self.ids = Table(), Column(np.int32), Column(np.int32), Column(np.uint32)
        self.known_ids = 0  # ids that belong to the table; those after them are of one call only
        self.long: dict[bytes, np.ndarray] = {}
        self.long_bytes = 0

    # -- pre-tokens ---------------------------------------------------------------------------------------------

    def parts(self, text: str) -> list[str | int]:
        """The text cut at special strings, which are given as their ids."""
        if self.special is None or not self.special.search(text):
            return [text]
        out: list[str | int] = []
        at = 0
        for m in self.special.finditer(text):
            out += [text[at : m.start()], self.special_ids[m[0]]]
            at = m.end()
        return [x for x in [*out, text[at:]] if x != ""]

    def normal(self, text: str) -> bytes:
        """The text as the pre-tokenizer sees it."""
        if not self.lower:
            return text.encode()
        try:
            text.encode("latin-1")  # composed already, and lower case changes one character at a time
            return text.lower().encode()
        except UnicodeEncodeError:
            return self.library.normalizer.normalize_str(text).encode()

    def split(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all parts, place and size of each pre-token, and the first pre-token of each part (and the end)."""
        data, ends = joined(parts)
        chars = data[: ends[-1] + 1]
        kind = self.classes.of(chars, ends)
        start = starts_of(chars, kind, self.spaced)
        start[ends] = True
        begin = np.flatnonzero(start)
        size = np.append(begin[1:], len(chars)) - begin
        keep = kind[begin] != END if self.spaced else kind[begin] < SPACE
        begin, size = begin[keep], size[keep]
        return data, begin, size, np.searchsorted(begin, np.append(np.append(0, ends[:-1] + 1), len(chars)))

    def single(self, words: list[str]) -> list[bytes]:
        """Those of the strings that are one pre-token, as bytes."""
        parts = [w.encode() for w in words if w and self.normal(w) == w.encode()]
        if not parts:
            return []
        _, _, size, first = self.split(parts)
        alone = np.flatnonzero(np.diff(first) == 1)
        return [parts[i] for i in alone if size[first[i]] == len(parts[i])]

    def trust(self, words: list[bytes]) -> None:
        """Pre-tokens that are known to be one token each: `count` looks here first."""
        self.proven = Table()
        if words:
            words = [w for w in words if len(w) <= LONG]
            data, ends = joined(words)
            size = np.array([len(w) for w in words], np.int64)
            _, name, first, _ = distinct(data, ends - size, size)  # one that shares its name with an earlier one is merged instead
            self.proven.add(name, data, (ends - size)[first], size[first])

    # -- merges -------------------------------------------------------------------------------------------------

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        return np.where(hit, self.pair_rank[at], NONE), self.pair_to[at]

    def merge(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and ids of tokens of pre-tokens of at most LONG bytes: the adjacent pair of lowest rank, leftmost first,
        is merged until none is left."""
        counts = np.zeros(len(begin), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for high in (4, 8, 12, 16, 24, LONG):
            rows = np.flatnonzero((size > low) & (size <= high))
            low = high
            for block in np.array_split(rows, max(1, len(rows) // 20_000)) if len(rows) else ():
                ids, n = self._merge_grid(self._grid(data, begin[block], size[block], high), size[block].copy())
                counts[block] = n
                parts.append((block, ids))
        offset = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.uint32)
        for block, ids in parts:
            n = counts[block]
            mask = np.arange(ids.shape[1]) < n[:, None]
            flat[(offset[block][:, None] + np.arange(ids.shape[1]))[mask]] = ids[mask]
        return counts, flat

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of a pre-token of more than LONG bytes, from the library's model."""
        got = self.long.get(piece)
        if got is None:
            if self.long_bytes > LONG_BYTES:
                self.long, self.long_bytes = {}, 0
            got = np.array([t.id for t in self.library.model.tokenize("".join(self.alphabet[b] for b in piece))], np.uint32)
            self.long[piece] = got
            self.long_bytes += len(piece)
        return got

    def _grid(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """A row of first symbols for each pre-token."""
        row = np.repeat(np.arange(len(begin)), size)
        grid = np.zeros((len(begin), width), np.int32)
        raw = gather(data, begin, size)
        grid[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = self.first[raw]
        if self.suffix:
            grid[np.arange(len(begin)), size - 1] = self.final[data[begin + size - 1]]
        return grid

    def _merge_grid(self, grid: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = grid.shape[1]
        out = np.zeros(grid.shape, np.uint32)
        n_out = left.copy()
        rows = np.arange(len(grid))
        rank, to = self.rank_of(grid[:, :-1], grid[:, 1:])
        rank[np.arange(width - 1) >= left[:, None] - 1] = NONE
        while len(rows):
            at = rank.argmin(axis=1)
            here = np.arange(len(rows))
            more = rank[here, at] != NONE
            if not more.all():
                done = ~more
                out[rows[done]], n_out[rows[done]] = grid[done], left[done]
                rows, grid, rank, to, left, at = rows[more], grid[more], rank[more], to[more], left[more], at[more]
                if not len(rows):
                    break
                here = np.arange(len(rows))
            joined = to[here, at]
            tail = np.arange(width - 1) >= (at + 1)[:, None]
            grid[:, :-1] = np.where(tail, grid[:, 1:], grid[:, :-1])
            grid[here, at] = joined
            rank[:, :-1] = np.where(tail[:, :-1], rank[:, 1:], rank[:, :-1])
            to[:, :-1] = np.where(tail[:, :-1], to[:, 1:], to[:, :-1])
            left -= 1
            rank[:, -1] = NONE
            rank[here, np.minimum(left - 1, width - 2)] = NONE
            prev = np.flatnonzero(at > 0)
            rank[prev, at[prev] - 1], to[prev, at[prev] - 1] = self.rank_of(grid[prev, at[prev] - 1], joined[prev])
            nxt = np.flatnonzero(at < left - 1)
            rank[nxt, at[nxt]], to[nxt, at[nxt]] = self.rank_of(joined[nxt], grid[nxt, at[nxt] + 1])
        return out, n_out

    # -- texts --------------------------------------------------------------------------------------------------

    def places(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in `ids` the tokens of each string begin, and their number. The names are distinct.

        Unknown ones are merged and added to the table. Long ones, and ones whose name belongs to another string, are
        put behind the table's ids until the next call.
        """
        if len(self.table) + len(name) > TABLE_ROWS:
            self.forget()
        self.ids.n = self.known_ids
        start, count = np.zeros(len(name), np.int64), np.zeros(len(name), np.int64)
        row = np.full(len(name), -2, np.int64)
        short = np.flatnonzero(size <= LONG)
        row[short] = self.table.find(name[short], data, begin[short], size[short])
        new = np.flatnonzero(row == -1)
        if len(new):
            n, ids = self.merge(data, begin[new], size[new])
            row[new] = self.table.add(name[new], data, begin[new], size[new])
            self.start.add(self.ids.n + np.cumsum(n) - n)
            self.count_of.add(n)
            self.ids.add(ids)
            self.known_ids = self.ids.n
        known = row >= 0
        start[known], count[known] = self.start.data[row[known]], self.count_of.data[row[known]]
        self._append(data, begin, size, np.flatnonzero(~known), start, count)
        return start, count

    def _append(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, rows: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        for i in rows.tolist():
            ids = self.merge_long(bytes_of(data, begin[i], size[i])) if size[i] > LONG else self.merge(data, begin[i : i + 1], size[i : i + 1])[1]
            start[i], count[i] = self.ids.n, len(ids)
            self.ids.add(ids)

    def tokens(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `places`, for strings that repeat."""
        code, name, first, odd = distinct(data, begin, size)
        start, count = (x[code] for x in self.places(data, begin[first], size[first], name))
        self._append(data, begin, size, odd, start, count)
        return start, count

    def counts(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of tokens of strings; proven ones count one without being merged."""
        code, name, first, odd = distinct(data, begin, size)
        each = np.ones(len(name), np.int64)
        rest = np.flatnonzero(self.proven.find(name, data, begin[first], size[first]) < 0)
        each[rest] = self.places(data, begin[first[rest]], size[first[rest]], name[rest])[1]
        out = each[code]
        self._append(data, begin, size, odd, np.zeros(len(begin), np.int64), out)
        return out

    def _cut(self, texts: list[str | None]) -> tuple[list[list[str | int]], list[bytes]]:
        parts = [self.parts(t) if t else [] for t in texts]
        return parts, [self.normal(p) for own in parts for p in own if isinstance(p, str)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: empty) as unsigned 32-bit numbers."""
        out: list[np.ndarray] = []
        for a, b in text_groups(texts):
            parts, strings = self._cut(texts[a:b])
            if strings:
                data, begin, size, first = self.split(strings)
                start, count = self.tokens(data, begin, size)
                ids, bound = gather(self.ids.data, start, count), np.append(0, np.cumsum(count))[first]
            k = 0
            for own in parts:
                got = []
                for p in own:
                    if isinstance(p, str):
                        got.append(ids[bound[k] : bound[k + 1]])
                        k += 1
                    else:
                        got.append(np.array([p], np.uint32))
                out.append(got[0] if len(got) == 1 else np.concatenate([np.zeros(0, np.uint32), *got]))
        return out

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for a, b in text_groups(texts):
            parts, strings = self._cut(texts[a:b])
            out[a:b] = [sum(not isinstance(p, str) for p in own) for own in parts]
            if strings:
                data, begin, size, first = self.split(strings)
                each = np.diff(np.append(0, np.cumsum(self.counts(data, begin, size)))[first])
                np.add.at(out, np.repeat(np.arange(a, b), [sum(isinstance(p, str) for p in own) for own in parts]), each)
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path)
