"""Operator 4: token counts by a linear longest-match automaton.

The vocabulary's byte strings form a trie. Each node v has a failure link f(v) and the number F(v) of tokens that greedy
longest match pops from the node's string before it stands at f(v); both are found once, breadth first. A word is then
walked byte by byte: where there is no edge, F is added and the link followed. The count of greedy word pieces comes out in
time linear in the word's length and no piece is ever built.

A word is a run of characters other than blanks (space and \\x09-\\x0D), with a space put before it if its vocabulary has
tokens that begin with one. A word that the vocabulary can't spell counts as one unknown token.

Defined results: null and empty texts have no words and no tokens; a word of any length is handled in linear time; an
empty vocabulary makes every word unknown; equal rows give equal results; other columns are ignored. The automaton is built
once in a Python worker from the file named by the parameter, which every executor must be able to read, or from a
vocabulary passed in; counts of words are kept in a memo of bounded size that only saves time.
"""

from __future__ import annotations

import base64
import json
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, text_pieces, utf8

MEMO = 200_000
CHUNK = 1 << 20


class Automaton:
    def __init__(self, tokens):
        tokens = {t for t in tokens if t}
        self.edges: list[dict[int, int]] = [{}]
        ends = [False]
        for t in tokens:
            v = 0
            for c in t:
                w = self.edges[v].get(c)
                if w is None:
                    w = len(self.edges)
                    self.edges[v][c] = w
                    self.edges.append({})
                    ends.append(False)
                v = w
            ends[v] = True
        n = len(self.edges)
        self.link, self.popped = [-1] * n, [0] * n
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.edges[u].items():
                queue.append(v)
                if ends[v]:
                    self.link[v], self.popped[v] = 0, 1
                    continue
                z, pops = self.link[u], self.popped[u]
                while z >= 0 and c not in self.edges[z]:
                    z, pops = self.link[z], pops + self.popped[z]
                if z >= 0:
                    self.link[v], self.popped[v] = self.edges[z][c], pops
        self.prefix = b" " if any(t[0] == 32 for t in tokens) else b""
        self.memo: dict[bytes, int] = {}

    def pieces(self, word: bytes) -> int:
        """Greedy longest-match pieces of the word, or -1 if it can't be spelled."""
        edges, link, popped = self.edges, self.link, self.popped
        u = pops = 0
        for c in self.prefix + word:
            while (v := edges[u].get(c)) is None:
                pops += popped[u]
                u = link[u]
                if u < 0:
                    return -1
            u = v
        while u:
            pops += popped[u]
            u = link[u]
            if u < 0:
                return -1
        return pops

    def count(self, text: bytes) -> tuple[int, int, int]:
        """(words, tokens, unknown words)"""
        words = text.split()
        memo, total, unknown = self.memo, 0, 0
        for w in words:
            n = memo.get(w)
            if n is None:
                n = self.pieces(w)
                if len(memo) >= MEMO:
                    memo.clear()
                if len(w) < 64:
                    memo[w] = n
            if n < 0:
                unknown += 1
                n = 1
            total += n
        return len(words), total, unknown


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible characters of Latin-1 for themselves, the
    other bytes, in order, for the characters from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(visible))
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_vocabulary(path: str) -> list[bytes]:
    """Tokens as bytes from a rank file (base64 and number a line) or a JSON file with model.vocab: in the byte-level alphabet
    if the file names that step anywhere, else plain. Added special tokens spell no text and are left out."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return [base64.b64decode(x.split()[0]) for x in f if x.strip()]
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    special = {t["content"] for t in whole.get("added_tokens") or [] if t.get("special")}
    tokens = [t for t in whole["model"]["vocab"] if t not in special]
    if "ByteLevel" not in json.dumps([whole.get(k) for k in ("pre_tokenizer", "decoder", "post_processor")]):
        return [t.encode() for t in tokens]
    byte = byte_alphabet()
    return [bytes(byte[c] for c in t) for t in tokens if all(c in byte for c in t)]


_AUTOMATA: dict[object, Automaton] = {}


def _automaton(path: str | None, tokens) -> Automaton:
    key = path or hash(tokens)
    if key not in _AUTOMATA:
        _AUTOMATA[key] = Automaton(load_vocabulary(path) if path else tokens)
    return _AUTOMATA[key]


def count_tokens(docs: DataFrame, vocabulary: str | list[bytes], doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown."""
    path, tokens = (vocabulary, None) if isinstance(vocabulary, str) else (None, tuple(sorted(vocabulary)))

    def run(batches):
        a = _automaton(path, tokens)
        for b in batches:
            for begin, end, texts in text_pieces(b, 1, CHUNK):
                found = [a.count(t) for t in utf8(texts)]
                counts = (pa.array([x[i] for x in found], pa.int64()) for i in range(3))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, end - begin), *counts], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    bounded_batches(d.sparkSession)
    return d.mapInArrow(lean(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")
