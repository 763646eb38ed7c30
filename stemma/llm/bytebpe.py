"""Byte-level BPE by a segment tree over adjacent pair ranks.

A pre-token starts as its bytes.  Leaf ``j`` of the tree holds ``rank * width +
j`` for the pair that begins at symbol ``j`` (or a value beyond all ranks when
the pair can't be merged); inner nodes hold minima, so the root names the
leftmost pair of the lowest rank.  Merging touches three leaves, each renewed in
logarithmic time, until the root holds no pair.  Short pre-tokens run as many
trees side by side in numpy arrays; a long one has a tree of its own, so a
pre-token of n bytes costs O(n log n).

Texts are cut before each space that follows a character other than white
space.  No pre-token crosses such a place, so the ids of a piece do not depend
on its neighbours and are kept in a cache of bounded size.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex

# The white space and the pre-token pattern of the vocabulary's
# published tokenizer.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: A space after white space: there the text must not be cut at every space.
RISKY = re.compile(rf"[{SPACE}] ")
CUT = re.compile(rf"(?<=[^{SPACE}])(?= )")

#: Pieces kept in a worker's cache before it is emptied.
CACHE_PIECES = 300_000
#: Trees of up to so many leaves run side by side.
BATCH_LEAVES = 128
NEVER = np.iinfo(np.int64).max


def pieces(text: str) -> list[str]:
    """``text`` cut where no pre-token crosses; joined, the pieces give it back."""
    if RISKY.search(text):
        return CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


def pre_tokens(piece: str) -> list[str]:
    """Pre-tokens of a piece; most are a word, or a word and one mark, after a space at most."""
    word = piece[1:] if piece[0] == " " else piece
    if word.isalpha():
        return [piece]
    if word[-1:] in (",", ".") and word[:-1].isalpha():
        return [piece[:-1], piece[-1]]
    return PRETOKEN.findall(piece)


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in the vocabulary file."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class ByteBpe:
    """Ids as the tokenizers library gives them for a byte-level BPE file without added begin or end tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = np.array([vocab[c] for c in symbols], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self._keys, self._ranks = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._pair_rank = dict(zip(key.tolist(), range(len(pairs)), strict=True))
        self._special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._cache: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    # -- merging ----------------------------------------------------------

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], -1)

    def _merge_many(self, words: list[bytes], leaves: int) -> list[bytes]:
        """Ids of words of fewer than ``leaves`` bytes, one tree for each; the last leaf stands for "none"."""
        n, none = len(words), leaves - 1
        size = np.fromiter(map(len, words), np.int64, n)
        inside = np.arange(leaves) < size[:, None]
        ids = np.full((n, leaves), -1, np.int64)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after = np.minimum(np.arange(1, leaves + 1), none) * np.ones((n, 1), np.int64)
        after = np.where(after < size[:, None], after, none)
        before = np.arange(-1, leaves - 1) * np.ones((n, 1), np.int64)
        before[:, 0] = none
        tree = np.full((n, 2 * leaves), NEVER, np.int64)
        rank = self._rank_of(ids[:, :-1], ids[:, 1:])
        at = np.arange(leaves - 1)
        tree[:, leaves:-1] = np.where(rank < 0, NEVER, rank * leaves + at)
        half = leaves // 2
        while half:
            np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2], out=tree[:, half : 2 * half])
            half //= 2
        alive = inside
        row = np.flatnonzero(tree[:, 1] < NEVER)
        while len(row):
            rank, left = np.divmod(tree[row, 1], leaves)
            right = after[row, left]
            beyond, prior = after[row, right], before[row, left]
            new = self.merged[rank]
            ids[row, left] = new
            ids[row, right] = -1
            alive[row, right] = False
            after[row, left] = beyond
            before[row, beyond] = left
            ids[row, none] = -1
            r_next = self._rank_of(new, ids[row, beyond])
            r_prior = self._rank_of(ids[row, prior], new)
            leaf = tree[:, leaves:]
            leaf[row, right] = NEVER
            leaf[row, left] = np.where(r_next < 0, NEVER, r_next * leaves + left)
            leaf[row, prior] = np.where(r_prior < 0, NEVER, r_prior * leaves + prior)
            for node in (right, left, prior):
                node = (node + leaves) >> 1
                while node[0]:
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                    node = node >> 1
            row = row[tree[row, 1] < NEVER]
        flat, end = ids[alive].astype("<i4").tobytes(), (4 * np.cumsum(alive.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *end], end, strict=False)]

    def _merge_long(self, word: bytes) -> list[int]:
        """The same for one long word, in plain Python."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n, get, width = len(ids), self._pair_rank.get, self.size
        leaves = 1 << n.bit_length()
        never = len(self.merged) * leaves
        tree = [never] * (2 * leaves)
        for j in range(n - 1):
            rank = get(ids[j] * width + ids[j + 1])
            if rank is not None:
                tree[leaves + j] = rank * leaves + j
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(j: int, value: int) -> None:
            i = leaves + j
            tree[i] = value
            i >>= 1
            while i:
                value = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == value:
                    break
                tree[i] = value
                i >>= 1

        def pair(j: int, k: int) -> int:
            rank = get(ids[j] * width + ids[k])
            return never if rank is None else rank * leaves + j

        while tree[1] < never:
            rank, left = divmod(tree[1], leaves)
            right = after[left]
            beyond, prior = after[right], before[left]
            ids[left], ids[right] = int(self.merged[rank]), -1
            after[left] = beyond
            if beyond < n:
                before[beyond] = left
            put(right, never)
            put(left, pair(left, beyond) if beyond < n else never)
            if prior >= 0:
                put(prior, pair(prior, left))
        return [i for i in ids if i >= 0]

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, both as bytes."""
        out: list = [None] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(max(8, 1 << len(w).bit_length()), []).append(i)
        for leaves, at in groups.items():
            if leaves > BATCH_LEAVES:
                for i in at:
                    out[i] = np.array(self._merge_long(words[i]), "<i4").tobytes()
            else:
                for k in range(0, len(at), 4096):
                    part = at[k : k + 4096]
                    for i, ids in zip(part, self._merge_many([words[i] for i in part], leaves), strict=True):
                        out[i] = ids
        return out

    # -- texts ------------------------------------------------------------

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        split = [pre_tokens(p) for p in missing]
        known = self._words
        if len(known) > CACHE_PIECES:
            known.clear()
        distinct = list({w for s in split for w in s if w not in known})
        known.update(zip(distinct, self.words([w.encode() for w in distinct]), strict=True))
        return {p: known[s[0]] if len(s) == 1 else b"".join(map(known.__getitem__, s)) for p, s in zip(missing, split, strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        plan: list[list] = []
        for text in texts:
            if self._special_cut and any(s in text for s in self.special):
                plan.append([x if x in self.special else pieces(x) for x in self._special_cut.split(text) if x])
            else:
                plan.append([pieces(text)] if text else [])
        if len(self._cache) > CACHE_PIECES:
            self._cache.clear()
        cache = self._cache
        missing = list({p for parts in plan for part in parts if not isinstance(part, str) for p in part if p not in cache})
        for k in range(0, len(missing), 20_000):
            cache.update(self._learn(missing[k : k + 20_000]))
        get, special = cache.__getitem__, {s: np.array([i], "<i4").tobytes() for s, i in self.special.items()}
        return [b"".join(special[part] if isinstance(part, str) else b"".join(map(get, part)) for part in parts) for parts in plan]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """One instance, with its cache, for each file and worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]
