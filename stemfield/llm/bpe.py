"""BPE encoding and decoding by a prefix-sharing trie.

A text is cut into words as the tokenizer's pre-tokenizer does. The distinct words of a batch are put, as sequences of
symbols, into a trie by sorting: words in order are a depth-first walk. At every node the *last token* of the node's prefix is
kept: the one vocabulary token that ends there and that BPE leaves apart from the last token of the prefix before it.
(Cutting the last token off an encoding leaves the encoding of the shorter prefix, so the chain of last tokens, read
backwards, is the encoding.) Prefixes that words share are computed once. The vocabulary tokens that end at a node are those of the
node's state: the longest end of its prefix that begins a vocabulary token. Encodings of words are joined to those of texts.

The vocabulary file is read from a path that is a parameter; it is never copied or trained.

Nulls and empties: a null text is the empty text, with no tokens. Texts of any length are taken whole. Rows are independent: repeated rows
give repeated results; further columns are not used. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import struct
from bisect import bisect_left
from codecs import charmap_decode
from functools import cached_property
from itertools import islice
from string import punctuation

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import batches, give_back, table

#: The 256 printable stand-ins of byte-level BPE, from the rule that printable Latin-1 stands for itself.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _SELF} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_SELF))}
_STAND_INS = "".join(BYTE_CHARS[b] for b in range(256))
#: The pre-tokenizer's pattern whose words hold no white space, so that texts may be cut there first.
_NO_SPACE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of characters below this one are normal already (NFC), and are lowered and split alike by all libraries.
_PLAIN = "ɐ"
_NOT_PLAIN = regex.compile("[^\\x09-\\x0d\\x20-\\x7e\\u00a0-\\u024f]")


class Trie:
    """Encodings of words, with the last token of every prefix on the current path."""

    def __init__(self, path: str, most_pairs: int = 150_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.ids.items()}
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.end = model.get("end_of_word_suffix") or ""
        self.ordered = sorted(self.ids)
        self.most_pairs = most_pairs
        self.edges: dict[str, tuple | None] = {}
        self.forget()

    def forget(self) -> None:
        """Start without known pairs and states. A state is (text, next states by symbol, tokens that end here with their numbers of
        symbols and the answers of ``fits``, the longest first)."""
        self.pairs = self.steps = 0
        self.apart: dict[str, dict[str, bool]] = {}
        self.states: dict[str, tuple] = {"": ("", {}, [])}
        self.word, self.last, self.path = "", [""], [self.states[""]]

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            core = token[: -len(self.end)]
            return [*core[:-1], core[-1] + self.end]
        return list(token)

    def edge_history(self, token: str) -> tuple | None:
        """How the ends of a token grow while BPE builds it: for the left and the right end a list of (piece, rank of the merge
        that takes the piece up; infinite for the whole token). None if BPE would not build it."""
        if token not in self.edges:
            out, left, right = self.symbols(token), [], []
            while len(out) > 1:
                rank, at = min((self.rank.get(pair, 1 << 60), i) for i, pair in enumerate(zip(out, out[1:], strict=False)))
                if rank == 1 << 60:
                    break
                if at == 0:
                    left.append((out[0], rank))
                if at == len(out) - 2:
                    right.append((out[-1], rank))
                out[at : at + 2] = [out[at] + out[at + 1]]
            whole = (token, 1 << 60)
            self.edges[token] = ([*left, whole], [*right, whole]) if out == [token] else None
        return self.edges[token]

    def fits(self, before: str, token: str) -> bool:
        """Whether BPE keeps the two tokens apart: at no time may their touching ends be joined sooner than one of them grows.
        With nothing before it, whether BPE builds the token."""
        a, b = self.edge_history(before) if before else ([("", 1 << 60)],) * 2, self.edge_history(token)
        found = a is not None and b is not None
        i = j = 0
        while found:
            (x, up_x), (y, up_y) = a[1][i], b[0][j]
            join = self.rank.get((x, y), 1 << 61)
            if join < up_x and join <= up_y:  # of equal ranks the left pair goes first
                found = False
            elif up_x == up_y == 1 << 60:
                break
            elif up_x <= up_y:
                i += 1
            else:
                j += 1
        return found

    def step(self, state: tuple, symbol: str) -> tuple:
        """The state after one more symbol; the last symbol of a word carries the word end."""
        text, more = state[0] + symbol, len(symbol) - 1
        while len(text) > more:
            at = bisect_left(self.ordered, text)
            if at < len(self.ordered) and self.ordered[at].startswith(text):
                break
            text = text[1:]
        else:
            text = ""
        if text not in self.states:
            ends = [text[at:] for at in range(len(text) - more) if text[at:] in self.ids]
            self.states[text] = (text, {}, [(t, len(t) - more, self.apart.setdefault(t, {})) for t in ends])
        self.steps += 1
        state[1][symbol] = self.states[text]
        return self.states[text]

    def encode(self, word: str) -> list[str]:
        """Tokens of one word of byte stand-ins; the prefix it shares with the word before is not computed again.

        ``last[i]`` is the last token of the first i symbols and ``path[i]`` their state. The last symbol carries the word end, so it is never shared.
        """
        if self.pairs > self.most_pairs or self.steps > self.most_pairs:
            self.forget()
        shared, n, before = 0, len(word), self.word
        most = min(n, len(before)) - 1
        while shared < most and word[shared] == before[shared]:
            shared += 1
        last, path = self.last, self.path
        del last[shared + 1 :], path[shared + 1 :]
        state = path[shared]
        for i, symbol in enumerate([*word[shared : n - 1], word[-1] + self.end], shared + 1):
            state = state[1].get(symbol) or self.step(state, symbol)
            for token, size, apart in state[2]:
                left = last[i - size]
                ok = apart.get(left)
                if ok is None:
                    ok = apart[left] = self.fits(left, token)
                    self.pairs += 1
                if ok:
                    last.append(token)
                    break
            else:
                raise ValueError(f"the vocabulary has no token for {symbol!r}")
            path.append(state)
        self.word = word
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at]) - (len(self.end) if at == n else 0)
        return out[::-1]


class Codec:
    """Encoder and decoder of texts for one tokenizer file, with a bounded memory of words."""

    def __init__(self, path: str, most_words: int = 120_000):
        self.path, self.trie, self.most = path, Trie(path), most_words
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pieces = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(pieces[0]["pattern"]["Regex"])
        self.by_space = self.pattern.pattern == _NO_SPACE
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_of: dict[str, bytes] = {}
        self.name = self.trie.token | {i: content for content, i in self.special.items()}

    @cached_property
    def library(self):
        """The tokenizer itself: its normalizer and pre-tokenizer serve texts beyond plain Latin letters."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text beyond plain Latin letters and without special tokens, by the library."""
        byte = {c: b for b, c in BYTE_CHARS.items()}
        return [bytes(byte[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def learn(self, words: set[str]) -> None:
        """Encode the words not known yet, in the order of a depth-first walk of their trie. Known words are held in the order of their
        last use, and the first of them make room; those of this batch stay."""
        known, mapped = self.bytes_of, {}
        for w in words:
            if w in known:
                known[w] = known.pop(w)
            else:
                mapped[w if w.isascii() and w.isalnum() else charmap_decode(w.encode("utf-8", "surrogateescape"), "strict", _STAND_INS)[0]] = w
        spare, more = len(known) + len(mapped) - len(words), len(known) + len(mapped) - self.most
        for w in list(islice(known, max(0, min(spare, more)))):
            del known[w]
        for m in sorted(mapped):
            tokens = self.trie.encode(m)
            known[mapped[m]] = struct.pack(f"<{len(tokens)}I", *map(self.trie.ids.__getitem__, tokens))

    def split(self, text: str) -> list[tuple[str, list[str]]]:
        """A text as parts: ``special`` tokens, ``words`` (pre-tokens), and ``runs`` of plain text between white space (one or more pre-tokens)."""
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        out = []
        for i, p in enumerate(parts):
            if p in self.special and i % 2:
                out.append(("special", [p]))
            elif p and _NOT_PLAIN.search(p) is None:
                out.append(("runs", p.lower().split()) if self.by_space else ("words", self.pattern.findall(p.lower())))
            elif p:
                out.append(("words", self.words(p)))
        return out

    def inner(self, run: str) -> list[str]:
        """Pre-tokens of a run that is not letters alone; letters with marks behind them, the most frequent kind, are seen without the pattern."""
        letters = run.rstrip(punctuation)
        return [letters, run[len(letters) :]] if letters.isalpha() else self.pattern.findall(run)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Of each text the ids as little-endian 32-bit integers."""
        cut = [self.split(t) for t in texts]
        held: dict[str, set[str]] = {"special": set(), "words": set(), "runs": set()}
        for kind, words in (part for parts in cut for part in parts):
            held[kind].update(words)
        inner = {run: self.inner(run) for run in held["runs"] if not run.isalpha()}  # letters alone are one pre-token
        single = held["runs"]
        single.difference_update(inner)
        self.learn(held["words"].union(single, *inner.values()))
        ids_of = self.bytes_of.__getitem__
        of = {"special": {w: struct.pack("<I", self.special[w]) for w in held["special"]}, "words": self.bytes_of, "runs": dict(zip(single, map(ids_of, single), strict=True))}
        of["runs"].update((run, b"".join(map(ids_of, words))) for run, words in inner.items())
        return [b"".join([b"".join(map(of[kind].__getitem__, words)) for kind, words in parts]) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """The tokenizer has no decoder: tokens are joined by spaces."""
        return " ".join(map(self.name.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


def encoded(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, the last of the text decoded from the ids, and ``ids`` (array<int>) if asked for."""

    def run(rows):
        fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * keep_ids
        coder = Codec(path)  # of the task: its words go with it
        for held in batches(rows, most=2 << 20):
            got = coder.encode_all([t.decode() if t else "" for t in held["text"]])
            cols = [held["doc_id"], [len(i) // 4 for i in got], [hashlib.sha256(i).hexdigest() for i in got], [hashlib.sha256(coder.decode(i).encode()).hexdigest() for i in got]]
            cols += [[np.frombuffer(i, np.int32) for i in got]] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])
        coder = held = got = cols = None  # states refer to each other, so only a collection frees them
        give_back()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), vocabulary())
