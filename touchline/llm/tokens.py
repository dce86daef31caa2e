"""Token ids of whole texts by public tokenizers, each distinct word of a batch merged once.

Both kinds of file cut a text into words before they merge pieces, and no merge crosses such a cut. So ids of a text are those of its
words in turn, and equal words of a batch need not be merged twice: texts are cut at blanks and line ends where they lie in the batch's
bytes, distinct words are numbered, merged side by side in numpy (``Merger``), and their ids put where the words stand. Words of other
characters than letters are given to the library, many together. Where white space is not plain (runs of blanks, blank line ends, other
kinds at a word's edge) the whole text is encoded as it is. Nothing is kept from one batch to the next.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: bytes of text that are looked at together, and words that are merged side by side
TOGETHER, SIDE_BY_SIDE = 1 << 20, 20_000


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


_LETTERS = _byte_letters()


class Merger:
    """Merges of a byte-level file, of many words at once. A round merges the lowest-rank pair of every word, the leftmost where it occurs
    twice, so rounds are what the rule asks of one word."""

    PLACES = 64  # bytes of a word at most, so that a rank and a place fit into one number
    _NEVER, _SLOT_BITS = np.int32(2**31 - 1), 19

    def __init__(self, model: dict) -> None:
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        missing = any(_LETTERS[b] not in vocab or _LETTERS[b] + suffix not in vocab for b in range(256))
        #: whether ids can be told from merges alone
        self.plain = model["type"] == "BPE" and not odd and not missing and len(set(pairs)) == len(pairs) < (2**31 - 1) // self.PLACES
        if not self.plain:
            return
        self._inner, self._last = (np.array([vocab[_LETTERS[b] + end] for b in range(256)], np.int32) for end in ("", suffix))
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        self._made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # pairs by a hash; those that find their slot taken are searched for
        slots = self._slot(keys)
        self._keys, self._ranks, self._taken = np.full(1 << self._SLOT_BITS, -1, np.int64), np.zeros(1 << self._SLOT_BITS, np.int32), np.zeros(1 << self._SLOT_BITS, bool)
        self._keys[slots[::-1]], self._ranks[slots[::-1]] = keys[::-1], np.arange(len(keys), dtype=np.int32)[::-1]
        late = np.flatnonzero(self._keys[slots] != keys)
        self._taken[slots[late]] = True
        late = late[np.argsort(keys[late])]
        self._late_keys, self._late_ranks = np.append(keys[late], np.int64(2**63 - 1)), np.append(late, 0).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._SLOT_BITS)).astype(np.int64)

    def _order(self, left: np.ndarray, right: np.ndarray, place) -> np.ndarray:
        """Rank and place of pairs in one number."""
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        hit = self._keys[slot] == keys
        out = np.where(hit, self._ranks[slot] * np.int32(self.PLACES) + place, self._NEVER)
        late = np.flatnonzero(self._taken[slot] & ~hit)
        if len(late):
            at = np.searchsorted(self._late_keys, keys[late])
            found = self._late_keys[at] == keys[late]
            late, at = late[found], at[found]
            out[late] = self._late_ranks[at] * np.int32(self.PLACES) + (place if np.ndim(place) == 0 else place[late])
        return out.astype(np.int32)

    def __call__(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids in turn of the words that begin at places of ``data``, and how many each word has. Words have one byte at least and
        ``PLACES`` at most."""
        order, parts, counts = np.argsort(sizes, kind="stable"), [np.empty(0, np.int32)], np.zeros(len(sizes), np.int64)
        for at in range(0, len(order), SIDE_BY_SIDE):
            some = order[at : at + SIDE_BY_SIDE]
            symbols = self._merged(data, begins[some], sizes[some]).T
            parts.append(symbols[symbols >= 0])
            counts[some] = (symbols >= 0).sum(axis=1)
        out = np.empty(int(counts.sum()), np.uint32)
        out[_runs((np.cumsum(counts) - counts)[order], counts[order])] = np.concatenate(parts)
        return out, counts

    def _merged(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Symbols by place and word, -1 where a merge or the word's end left none."""
        longest, n = int(sizes[-1]), len(sizes)
        place = np.arange(longest, dtype=np.int32)[:, None]
        letters = data[np.minimum(begins + place, len(data) - 1)]
        symbols = np.where(place < sizes - 1, self._inner[letters], np.where(place == sizes - 1, self._last[letters], np.int32(-1)))
        orders = np.full((longest, n), self._NEVER)
        for k in range(longest - 1):
            first = int(np.searchsorted(sizes, k + 1, side="right"))  # words are in order of size
            orders[k, first:] = self._order(symbols[k, first:], symbols[k + 1, first:], np.int32(k))
        # neighbours that are left; the last place stands for none
        after, before = np.broadcast_to(place + 1, (longest, n)).copy(), np.broadcast_to(place - 1, (longest, n)).copy()
        after[np.maximum(sizes - 1, 0), np.arange(n)] = longest
        who = np.arange(n)
        best = orders.min(axis=0)
        while len(who := who[best < self._NEVER]):
            best = best[best < self._NEVER]
            at, rank = best & (self.PLACES - 1), best >> 6
            gone = after[at, who]
            behind = after[gone, who]
            made = self._made[rank]
            symbols[at, who], symbols[gone, who], orders[gone, who] = made, -1, self._NEVER
            after[at, who] = behind
            inside = behind < longest
            fresh = np.full(len(who), self._NEVER)
            fresh[inside] = self._order(made[inside], symbols[behind[inside], who[inside]], at[inside])
            orders[at, who] = fresh
            before[behind[inside], who[inside]] = at[inside]
            left = before[at, who]
            inside = left >= 0
            orders[left[inside], who[inside]] = self._order(symbols[left[inside], who[inside]], made[inside], left[inside])
            best = orders[:, who].min(axis=0) if len(who) < n else orders.min(axis=0)
        return symbols


class Encoder:
    """``json_text``: the tokenizer's file, so that executors need no path. ``each`` gives one uint32 array for each text. ``bound`` bytes
    of text are looked at together; a longer text is taken alone."""

    def __init__(self, json_text: str, bound: int = TOGETHER) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._encoder, self._bound = Tokenizer.from_str(json_text), bound
        spec = json.loads(json_text)
        self._merger = Merger(spec["model"])
        # a file that drops white space joins words of any place; the byte-level one keeps the blank before a word
        self._drops = spec["model"].get("end_of_word_suffix") is not None
        plain = spec["pre_tokenizer"]
        cuts = self._drops or (plain["type"] == "ByteLevel" and plain["use_regex"] and not plain["add_prefix_space"] and not spec["normalizer"])
        # many words are encoded in one go, with a mark between them that is one id and never part of a word
        self._between, self._mark = "", None
        for mark in ("\n",) if not self._drops else (" \u2764 ", " \u2605 ", " \u00b6 ", " \u00a7 ", " \u2026 "):
            if cuts and len(ids := self._ids(mark)) == 1:
                self._between, self._mark = mark, int(ids[0])
                break
        self._stops = {c: self._ids(c) for c in ".,"}
        self._line = self._ids("\n") if cuts and not self._drops else np.empty(0, np.uint32)
        self._cuts = cuts and self._merger.plain and self._mark is not None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _each(self, units: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for at in range(0, len(units), 2000):
            some = units[at : at + 2000]
            if any(self._between.strip(" ") in u for u in some):
                out += [self._ids(u) for u in some]
                continue
            ids = self._ids(self._between.join(some))
            ends = [*np.flatnonzero(ids == self._mark).tolist(), len(ids)]
            out += [ids[a:b] for a, b in zip([0, *[e + 1 for e in ends[:-1]]], ends, strict=True)]
        return out

    def _distinct(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces in turn, how many each has, and which are not plain. A piece is a word with the blank or line end before it."""
        bounds = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2], np.uint8)[: bounds[-1]]
        begins, ends = bounds[:-1], bounds[1:]
        blank, line = data[begins] == 32, data[begins] == 10
        own = begins + (blank | line)
        # letters of one byte, and those of two that the first block behind them has
        small = data | 32
        letter = (small >= 97) & (small <= 122)
        wide = np.flatnonzero(data[:-1] == 0xC3)
        wide = wide[(data[wide + 1] != 0x97) & (data[wide + 1] != 0xB7)]
        letter[wide] = letter[wide + 1] = True
        # a full stop or comma after a letter is a piece of its own
        last = data[ends - 1]
        stops = np.where(last == 46, 1, np.where(last == 44, 2, 0)) * ((ends - own > 1) & letter[ends - 2])
        core = ends - (stops > 0)
        others = np.append(0, np.cumsum(~letter))
        size = core - own
        # letters are one piece for the merges, so these go without the steps before them
        plain = (others[core] == others[own]) & (size > 0) & (size < Merger.PLACES)
        letters = np.flatnonzero(plain)
        if self._drops:
            data = np.where((data >= 65) & (data <= 90), small, data)
            upper = wide[data[wide + 1] <= 0x9E] + 1
            data[upper] += 32
            ahead, lead = np.zeros(len(pieces), np.int64), np.zeros(len(letters), np.int64)
        else:
            ahead, lead = np.where(line, len(self._line), 0), blank[letters].astype(np.int64)
        ids, found = self._merger(data, own[letters] - lead, size[letters] + lead)
        odd, rest, asked = np.zeros(len(pieces), bool), [], []
        slow = np.flatnonzero(~plain)
        for k, piece in zip(slow.tolist(), pieces.take(pa.array(slow)).to_pylist(), strict=True):
            w = piece.decode()
            w = w[1:] if w[0] in " \n" else w
            if not w or w != w.strip():
                odd[k] = bool(w) or not self._drops
                continue
            rest.append(k)
            asked.append(" " + w if blank[k] and not self._drops else w)
        stops[slow] = 0
        others = self._each(asked)
        counts = np.zeros(len(pieces), np.int64)
        counts[letters], counts[rest] = found, [len(o) for o in others]
        ahead[odd] = 0
        total = ahead + counts + np.array([0, len(self._stops["."]), len(self._stops[","])])[stops]
        at = np.cumsum(total) - total
        out = np.empty(int(total.sum()), np.uint32)
        out[_runs((at + ahead)[letters], counts[letters])] = ids
        out[_runs((at + ahead)[rest], counts[rest])] = np.concatenate([*others, np.empty(0, np.uint32)])
        for which, places, value in ((ahead > 0, at, self._line), (stops == 1, at + ahead + counts, self._stops["."]), (stops == 2, at + ahead + counts, self._stops[","])):
            for j, v in enumerate(value):
                out[places[which] + j] = v
        return out, total, odd

    def _together(self, texts: pa.LargeStringArray) -> list[np.ndarray]:
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        if not len(data):
            return [np.empty(0, np.uint32) for _ in texts]
        line, first = data == 10, np.zeros(len(data), bool)
        cut = (data == 32) | line
        first[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(cut | first)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        number = coded.indices.to_numpy()
        flat, sizes, odd = self._distinct(coded.dictionary)
        begins, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes[number])
        ids = flat[_runs(begins[number], sizes[number])]
        strange = odd[number]
        if not self._drops:
            strange |= (cut & first)[starts]
        of = np.searchsorted(starts, bounds)
        at = np.append(0, ends)[of]
        whole = {int(k) for k in np.unique(np.searchsorted(of, np.flatnonzero(strange), side="right") - 1)}
        return [self._ids(texts[k].as_py()) if k in whole else ids[at[k] : at[k + 1]] for k in range(len(texts))]

    def each(self, texts: Iterable[str] | pa.Array) -> Iterator[np.ndarray]:
        """One array for each text, in turn."""
        if not self._cuts:
            yield from (self._ids(t) for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts))
            return
        rows = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        ends, at = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1], 0
        while at < len(rows):
            behind = max(at + 1, int(np.searchsorted(ends, ends[at] + self._bound, side="right")) - 1)
            yield from self._together(rows.slice(at, behind - at))
            at = behind

    def __call__(self, texts: Iterable[str] | pa.Array) -> list[np.ndarray]:
        return list(self.each(texts))


def _runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs, one behind the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(begins - before, sizes) + np.arange(int(sizes.sum()))


_ENCODERS: dict[str, Encoder] = {}


def shared_encoder(json_text: str) -> Encoder:
    """The one encoder of a worker process, so that a file is read once."""
    if json_text not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[json_text] = Encoder(json_text)
    return _ENCODERS[json_text]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def public(name: str) -> str:
    """Where an installed public tokenizer lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
