"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

In a byte-pair encoding every prefix of a word ends in exactly one last token.
That token is a suffix of the prefix for which the rest, another prefix, ends
in a token that may stand before it. So an automaton goes through the word
once; its suffix links give the tokens that end at each place, longest first.
They are tested against the stored last token of the prefix before them, and
the one that passes is stored. Following the back-pointers from the whole word
gives its ids.

A pair of tokens may stand side by side if undoing their merges, latest first,
never meets a merge across the border that would have come earlier.

All words of a batch take each step together, as numpy arrays; the few that are
far longer than the others go on alone.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Words of these characters need no Unicode tables: lower-casing is one to
#: one, composition changes nothing and the classes of the pattern are plain.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
#: The same pattern as the tokenizer files of this kind state it (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NONE = np.int64(1) << 40
#: Words that go on when fewer are left than this are taken one by one.
FEW_WORDS = 16
#: Pairs that a worker remembers for such words; they take some 20 MB.
MET_PAIRS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class IntMap:
    """A fixed map of non-negative int64 keys to int64, in open addressing; -1 for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while left.size:
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]
            self.values[slot[free]] = values[left[free]]
            lost = self.keys[slot] != keys[left]
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        on = np.flatnonzero((there != keys) & (there >= 0))
        while on.size:
            slot[on] = (slot[on] + 1) & self.mask
            there = self.keys[slot[on]]
            same = there == keys[on]
            out[on[same]] = self.values[slot[on[same]]]
            on = on[~same & (there >= 0)]
        return out


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class WordBpe:
    """A tokenizers file whose pre-tokenizer drops white space and whose merges stay within words.

    Inside, tokens are numbered by merge rank: symbols first, then merges.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        spec = json.loads(content)
        model, self.suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        stages = spec["pre_tokenizer"].get("pretokenizers", [])
        if not (spec["decoder"] is None and len(stages) == 2 and stages[0]["pattern"].get("Regex") == PATTERN and stages[0]["invert"] and stages[0]["behavior"] == "Removed" and stages[1]["type"] == "ByteLevel" and not stages[1]["use_regex"]):
            raise ValueError("this kind of tokenizer file is not supported")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError("added tokens that take white space are not supported")
        library = Tokenizer.from_str(content)
        self._normalize, self._pretokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

        alphabet = byte_alphabet()
        self._byte = {c: b for b, c in enumerate(alphabet)}
        vocab = model["vocab"]
        symbols = alphabet + ([c + self.suffix for c in alphabet] if self.suffix else [])
        self.base = len(symbols)
        text, number = list(symbols), {s: i for i, s in enumerate(symbols)}
        sequence = [(i,) for i in range(self.base)]
        split = [(i, i) for i in range(self.base)]
        for merge in model["merges"]:
            a, b = (number[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            if text[a] + text[b] in number:
                raise ValueError("two merges make the same token")
            number[text[a] + text[b]] = len(text)
            text.append(text[a] + text[b])
            sequence.append(sequence[a] + sequence[b])
            split.append((a, b))
        self.size = len(text)
        self.left, self.right = (np.array(x, np.int64) for x in zip(*split, strict=True))
        self.length = np.array([len(s) for s in sequence], np.int64)
        merges = np.arange(self.base, self.size, dtype=np.int64)
        self.pairs = IntMap(self.left[merges] * self.size + self.right[merges], merges)
        self._split, self._merge = split, dict(zip((self.left[merges] * self.size + self.right[merges]).tolist(), merges.tolist(), strict=True))
        self._met: dict[int, bool] = {}
        # a token that its own text does not encode to never occurs
        whole = np.ones(self.size, bool)
        whole[merges] = self._side_by_side(self.left[merges], self.right[merges], merges)
        for t in range(self.base, self.size):
            whole[t] &= whole[split[t][0]] and whole[split[t][1]]
        self._automaton(sequence, whole)
        self.external = np.array([vocab.get(s, -1) for s in text], np.int64)
        self.name = {vocab[s]: s for s in text if s in vocab} | {i: c for c, i in self.added.items()}
        self._seen = np.full(1 << 17, -1, np.int64)
        self._fits = np.zeros(1 << 17, bool)

    def _automaton(self, sequence: list[tuple], whole: np.ndarray) -> None:
        """Goes through a word once; its state is the longest suffix so far that begins a token.

        ``step`` has the moves to longer prefixes, ``link`` the longest proper
        suffix of a state that is a state too. ``ends`` is the longest token
        that a state ends in, ``shorter`` the next one that ends there as well.
        Every symbol is a token, so there is always one.
        """
        step: dict[int, int] = {}
        symbol, parent, token = [0], [0], [-1]
        state_of = np.zeros(self.size, np.int64)
        for t in np.flatnonzero(whole).tolist():
            node = 0
            for s in sequence[t]:
                key = node * self.base + s
                if key not in step:
                    step[key] = len(token)
                    symbol.append(s)
                    parent.append(node)
                    token.append(-1)
                node = step[key]
            token[node] = t
            state_of[t] = node
        link, ends = [0] * len(token), list(token)
        depth = [0] * len(token)
        for node in range(1, len(token)):  # parents come before their children
            depth[node] = depth[parent[node]] + 1
        for node in sorted(range(1, len(token)), key=depth.__getitem__):
            at = parent[node]
            while at:
                at = link[at]
                to = step.get(at * self.base + symbol[node])
                if to is not None:
                    link[node] = to
                    break
            if token[node] < 0:
                ends[node] = ends[link[node]]
        self.step = IntMap(np.fromiter(step, np.int64, len(step)), np.fromiter(step.values(), np.int64, len(step)))
        self.link, self.ends = np.array(link, np.int64), np.array(ends, np.int64)
        self.shorter = np.where(whole, self.ends[self.link[state_of]], -1)
        self._plain = step, link, ends, self.shorter.tolist(), self.length.tolist()

    def _moved(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """States after one more symbol each."""
        to = self.step.get(state * self.base + symbol)
        left = np.flatnonzero(to < 0)
        at = state[left]
        while left.size:
            at = self.link[at]
            found = self.step.get(at * self.base + symbol[left])
            to[left] = found
            on = found < 0
            left, at = left[on], at[on]
        return to

    def _side_by_side(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether each pair stays apart when merges up to ``limit`` are made in order."""
        good = np.ones(len(a), bool)
        on, a, b, limit = np.arange(len(a)), a.copy(), b.copy(), limit.copy()
        while on.size:
            m = self.pairs.get(a * self.size + b)
            joined = (m >= 0) & (m < limit)
            good[on[joined]] = False
            go = ~joined & (np.maximum(a, b) >= self.base)
            on, a, b = on[go], a[go], b[go]
            undo_left = a > b
            limit = np.where(undo_left, a, b + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return good

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_side_by_side`` without limit, through a table of pairs met before."""
        code = a * self.size + b
        slot = ((code.astype(np.uint64) * _MIX) >> np.uint64(47)).astype(np.int64)
        out, new = self._fits[slot], self._seen[slot] != code
        if new.any():
            fresh, back = np.unique(code[new], return_inverse=True)
            fits = self._side_by_side(fresh // self.size, fresh % self.size, np.full(len(fresh), NONE))
            out[new] = fits[back]
            self._seen[slot[new]] = code[new]
            self._fits[slot[new]] = out[new]
            # two codes of one batch may want the same place; the later one keeps it whole
            kept = self._seen[slot[new]]
            self._fits[slot[new]] = fits[np.searchsorted(fresh, kept)]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """External ids of all pieces, one after another, and how many each has. No piece is empty."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbol = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        if self.suffix:
            symbol[ends - 1] += 256
        # words by falling length, so that those that go on come first
        order = np.argsort(-sizes, kind="stable")
        begin = (ends - sizes)[order]
        going = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")
        state = np.zeros(len(pieces), np.int64)
        last = np.full(len(symbol), -1, np.int64)
        for n, k in enumerate(going.tolist()):
            if k < FEW_WORDS:
                for b, e, at in zip(begin[:k].tolist(), ends[order[:k]].tolist(), state[:k].tolist(), strict=True):
                    last[b:e] = self._rest(symbol[b:e].tolist(), last[b : b + n].tolist(), at)
                break
            at = begin[:k] + n
            state[:k] = self._moved(state[:k], symbol[at])
            token = self.ends[state[:k]]
            while at.size:  # the longest token that ends here first
                fits = self.length[token] == n + 1
                rest = np.flatnonzero(~fits)
                fits[rest] = self._compatible(last[at[rest] - self.length[token[rest]]], token[rest])
                last[at[fits]] = token[fits]
                at, token = at[~fits], self.shorter[token[~fits]]
        # back-pointers, all words at once
        p, word, first = ends - 1, np.arange(len(pieces)), ends - sizes
        words, tokens = [], []
        while p.size:
            t = last[p]
            words.append(word)
            tokens.append(t)
            p = p - self.length[t]
            on = p >= first
            p, word, first = p[on], word[on], first[on]
        words, tokens = np.concatenate(words[::-1]), np.concatenate(tokens[::-1])
        order = np.argsort(words, kind="stable")
        return self.external[tokens[order]], np.bincount(words, minlength=len(pieces))

    def _rest(self, symbols: list[int], last: list[int], state: int) -> list[int]:
        """Last tokens of all prefixes of one word, those of its first prefixes being known. For long words, a step at a time."""
        step, link, ends, shorter, length = self._plain
        for n in range(len(last), len(symbols)):
            while (to := step.get(state * self.base + symbols[n])) is None:
                state = link[state]
            state = to
            t = ends[state]
            while length[t] <= n and not self._fit(last[n - length[t]], t):
                t = shorter[t]
            last.append(t)
        return last

    def _fit(self, a: int, b: int) -> bool:
        """``_side_by_side`` of one pair without limit."""
        code = a * self.size + b
        known = self._met.get(code)
        if known is None:
            if len(self._met) >= MET_PAIRS:
                self._met.clear()
            limit, known = self.size, True
            while True:
                if self._merge.get(a * self.size + b, limit) < limit:
                    known = False
                    break
                if a < self.base and b < self.base:
                    break
                if a > b:
                    limit, a = a, self._split[a][1]
                else:
                    limit, b = b + 1, self._split[b][0]
            self._met[code] = known
        return known

    def pieces(self, word: str) -> list[bytes | int]:
        """Pre-tokens of a word without spaces or newlines, as bytes; an added token as its id."""
        if word.isascii() and word.isalpha():
            return [word.lower().encode()]
        if PLAIN.fullmatch(word) and not (self._added and "<" in word):
            return [p.encode() for p in PLAIN_PIECES.findall(word.lower())]
        out: list[bytes | int] = []
        for part in self._added.split(word) if self._added else [word]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                for piece, _ in self._pretokenize(self._normalize(part)):
                    out.append(bytes(self._byte[c] for c in piece))
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        split = [self.pieces(w) for w in words]
        place: dict[bytes, int] = {}
        for ps in split:
            for p in ps:
                if isinstance(p, bytes):
                    place.setdefault(p, len(place))
        made: dict[bytes | int, bytes] = {i: i.to_bytes(4, "little") for i in self.added.values()}
        if place:
            flat, counts = self.encode_pieces(list(place))
            raw = flat.astype("<i4").tobytes()
            end = 0
            for p, n in zip(place, (4 * counts).tolist(), strict=True):
                made[p] = raw[end : end + n]
                end += n
        return [made[ps[0]] if len(ps) == 1 else b"".join([made[p] for p in ps]) for ps in split]


_loaded: dict[int, WordBpe] = {}


def loaded(content: str) -> WordBpe:
    """The worker's encoder for this file, kept between tasks."""
    key = hash(content)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(content)
    return _loaded[key]
