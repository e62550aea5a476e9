"""Token ids and counts of whole texts, with caches of short units.

A byte-level BPE cuts a text before its merges. White space only ever stands at
the start of such a piece or fills it, so the text can be cut wherever white
space follows something else, and each unit (white space, then the rest up to
the next white space) encoded on its own and remembered. Texts that hold an
added token's string, and tokenizers of another build, are encoded whole.

Ids are found by smaller pieces, cut over the bytes of many texts at once: also
where an ASCII or Latin-1 letter, a digit and another ASCII character meet.
There are fewer different ones, and only these ever become Python objects.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quernel.llm.common import WORKER_CACHES, trim

#: The characters with Unicode's White_Space property (fixed values), as a class body.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WHITE = frozenset(chr(c) for c in range(0x3001) if re.match(f"[{WHITE}]", chr(c)))
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Units, and pieces, that a worker remembers before it starts over.
CACHE = 900_000
#: Longer units and pieces are encoded each time.
LONGEST = 64
#: Units that are encoded in one go.
_JOIN = 1 << 14

#: Classes of bytes. Of white space beyond ASCII the first byte is a lead, the others are trails; marks are other ASCII characters, the rest is never told apart.
_SPACE, _BREAK, _TRAIL, _LEAD, _LETTER, _DIGIT, _MARK, _QUOTE, _REST = range(9)
_CLASS = np.full(256, _REST, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[[*range(48, 58)]] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[9:14], _CLASS[32], _CLASS[39] = _BREAK, _SPACE, _QUOTE
#: Whether a piece may begin between two bytes. Never after a quote, which takes letters with it ('s, 'll), but before white space.
_CUT = np.zeros((9, 9), bool)
_CUT[_LETTER:, [_SPACE, _BREAK, _LEAD]] = True
_CUT[_BREAK, _LETTER:] = True
_CUT[_LETTER, [_DIGIT, _MARK, _QUOTE]] = _CUT[_DIGIT, [_LETTER, _MARK, _QUOTE]] = _CUT[_MARK, [_LETTER, _DIGIT]] = True
_CUT = _CUT.ravel()
_WIDE = np.array([ord(c) for c in sorted(_WHITE) if ord(c) > 127])


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin: ``data`` has their UTF-8, ``offsets`` where each one begins and the last one ends."""
    kinds = _CLASS[data]
    at = np.flatnonzero(data == 0xC3)
    at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]  # of U+00C0 to U+00FF all but two are letters
    kinds[at] = kinds[at + 1] = _LETTER
    at = np.flatnonzero(data == 0xC2)
    at = at[np.isin(data[at + 1], _WIDE[_WIDE < 256])]  # from U+0080 to U+00BF the second byte is the code point
    kinds[at], kinds[at + 1] = _LEAD, _TRAIL
    at = np.flatnonzero((data >= 0xE1) & (data <= 0xE3))
    at = at[np.isin((data[at] & 15).astype(np.int64) << 12 | (data[at + 1] & 63).astype(np.int64) << 6 | data[at + 2] & 63, _WIDE)]
    kinds[at], kinds[at + 1], kinds[at + 2] = _LEAD, _TRAIL, _TRAIL
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = _CUT[kinds[:-1] * np.uint8(9) + kinds[1:]]
    # The last of several white characters stands alone or with what follows, unless the text ends there.
    last = np.flatnonzero(kinds[1:-1] <= _BREAK) + 1
    last = last[(kinds[last - 1] <= _TRAIL) & (kinds[last + 1] >= _LETTER)]
    cut[last[~np.isin(last + 1, offsets)]] = True
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes with ``tokenizers`` (.json) or ``sentencepiece`` (.model)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.special: list[str] = []
        self.by_unit = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as f:
                made = json.load(f)
            pre = made.get("pre_tokenizer") or {}
            self.by_unit = made["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and made.get("normalizer") is None and not made["model"].get("ignore_merges")
            self.special = [x["content"] for x in made.get("added_tokens", ())]
            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
            self.encode = lambda texts: [x.ids for x in batch(texts, add_special_tokens=False)]
            if self.by_unit:
                vocab = tokenizer.get_vocab()
                self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
                for piece, i in vocab.items():
                    self.n_bytes[i] = len(piece)  # a byte-level piece has a character per byte
        self.lengths: dict[str, int] = {}
        self._forget_pieces()

    def _forget_pieces(self) -> None:
        #: Pieces by number; the ids of them all, and by number where a piece's begin and how many they are.
        self.ids: dict[bytes, int] = {}
        self.known = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def _encode_units(self, units: list[str]) -> tuple[bytes, list[int]]:
        """Ids of all units, and where each one ends. Joined units are told apart by the bytes of their pieces."""
        own = [u for u in units if u[0] in _WHITE and u[-1] not in _WHITE]
        rest = [u for u in units if not (u[0] in _WHITE and u[-1] not in _WHITE)]
        blocks, ends, at = [], [], 0
        for a in range(0, len(own), _JOIN):
            part = own[a : a + _JOIN]
            ids = np.array(self.encode(["".join(part)])[0], "<u4")
            cut = np.cumsum(np.fromiter(map(len, map(str.encode, part)), np.int64, len(part)))
            have = np.cumsum(self.n_bytes[ids])
            to = np.searchsorted(have, cut)
            if len(have) == 0 or not np.array_equal(have[np.minimum(to, len(have) - 1)], cut):
                raise ValueError("pieces don't add up to the units")
            blocks.append(ids.tobytes())
            ends += (to + 1 + at).tolist()
            at += len(ids)
        for ids in self.encode(rest) if rest else ():
            blocks.append(np.array(ids, "<u4").tobytes())
            at += len(ids)
            ends.append(at)
        units[:] = own + rest
        return b"".join(blocks), ends

    def _units(self, texts: list[str], cache: dict[str, int], first: dict[str, int]) -> tuple[list, set[str]]:
        """Units of each text (None: encode it whole), all of them in ``cache`` from now on; those that must leave it afterwards."""
        units = [UNIT.findall(t) if self.by_unit and not any(s in t for s in self.special) else None for t in texts]
        seen: set[str] = set()
        for u in units:
            if u:
                seen.update(u)
        missing = seen.difference(cache)
        if len(cache) + len(missing) > CACHE or not cache:
            cache.clear()
            cache.update(first)
            missing = seen.difference(cache)
        if missing:
            # A comma or full stop after a letter is a piece of its own, so the rest may be known.
            marked = {u for u in missing if u[-1] in ",." and u[-2:-1].isascii() and u[-2:-1].isalpha()}
            todo = list(({u[:-1] for u in marked} | {",", "."} | (missing - marked)).difference(cache))
            if todo:
                _, ends = self._encode_units(todo)
                cache.update(zip(todo, np.diff([0, *ends]).tolist(), strict=True))
            for u in marked:
                cache[u] = cache[u[:-1]] + cache[u[-1]]
        return units, {x for x in missing if len(x) > LONGEST}

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces, where each one's begin and how many they are."""
        texts = [p.decode() for p in pieces]
        # A line feed before what doesn't begin with white space is an id of its own, so nearly all are encoded joined.
        alone = np.array([t[-1] in _WHITE for t in texts], bool)
        fed = np.array([t[0] not in _WHITE for t in texts], bool) & ~alone
        order = np.argsort(alone, kind="stable")
        ids, ends = self._encode_units([f"\n{texts[i]}" if fed[i] else texts[i] for i in order.tolist()])
        first, count = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        first[order], count[order] = [0, *ends[:-1]], np.diff([0, *ends])
        return np.frombuffer(ids, "<u4"), first + fed, count - fed

    def _numbered(self, pieces: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids that are known, and for each of ``pieces`` (all different) where its ids begin and how many they are."""
        keys = pieces.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.ids.get, keys, repeat(-1)), np.int64, len(keys))
        missing = numbers < 0
        if self.ids and len(self.ids) + missing.sum() > most:
            self._forget_pieces()
            missing[:] = True
        known, long = self.known, pc.binary_length(pieces).to_numpy() > LONGEST
        for new, keep in ((missing & ~long, True), (missing & long, False)):
            at = np.flatnonzero(new)
            if not len(at):
                continue
            todo, n = [keys[i] for i in at.tolist()], len(known[1])
            ids, first, count = self._encode_pieces(todo)
            known = tuple(np.concatenate(x) for x in zip(known, (ids, first + len(known[0]), count), strict=True))
            numbers[at] = np.arange(n, n + len(at))
            if keep:
                self.ids.update(zip(todo, range(n, n + len(at)), strict=True))
                self.known = known
        if len(self.ids) > most:
            self._forget_pieces()
        return known[0], known[1][numbers], known[2][numbers]

    def token_ids(self, texts: list[str] | pa.Array, most: int = CACHE) -> list[np.ndarray]:
        """The ids of each text; null is empty. Remembers ``most`` pieces at most."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        texts = pc.fill_null(texts, "")
        whole = np.full(len(texts), not self.by_unit)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        alone = np.flatnonzero(whole).tolist()
        coded = iter(self.encode([texts[i].as_py() for i in alone]) if alone else ())
        if alone:
            texts = pc.if_else(pa.array(whole), "", texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        if offsets[-1] > offsets[0]:
            data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            starts = piece_starts(data, offsets)
            bounds = pa.py_buffer(np.append(starts, len(data)))
            pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
            known, first, count = self._numbered(pieces.dictionary, most)
            which = pieces.indices.to_numpy()
            count = count[which]
            ends = np.concatenate([[0], np.cumsum(count)])
            ids = known[np.repeat(first[which] - ends[:-1], count) + np.arange(ends[-1])]
            to = ends[np.searchsorted(starts, offsets)].tolist()
        else:
            ids, to = np.empty(0, "<u4"), [0] * (len(texts) + 1)
        out = [ids[a:b] for a, b in zip(to[:-1], to[1:], strict=True)]
        for i in alone:
            out[i] = np.array(next(coded), "<u4")
        return out

    def token_counts(self, texts: list[str], frequent: dict[str, int] | None = None) -> list[int]:
        """``frequent`` (unit to count) always stays in the worker's cache, which learns the rest."""
        units, leave = self._units(texts, self.lengths, frequent or {})
        whole = iter(self.encode([t for t, u in zip(texts, units, strict=True) if u is None]) if None in units else ())
        out = [len(next(whole)) if u is None else sum(map(self.lengths.__getitem__, u)) for u in units]
        for x in leave:
            del self.lengths[x]
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker and file; its caches outlive a task."""
    return Encoder(path)


def _forget() -> None:
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        trim()


WORKER_CACHES.append(_forget)
