"""Token counts by greedy longest match, without building the pieces: a trie with failure links and popped counts."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.features import TEXTS
from tracewright.llm.packing import default_tokenizer

#: Words whose counts a Python worker keeps.
MOST_WORDS = 400_000
#: Added to the code point of a word's last symbol, as a vocabulary's word-end mark belongs to it.
LAST = 0x10000
#: Letter runs, single numbers and runs of other signs, the contractions first: the words within white space.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class Automaton:
    """Greedy longest-match pieces of a word, counted in one pass over its symbols.

    A node of the trie is a string that begins some piece. Its failure link goes to the node that is left when the
    longest pieces at its front are popped, and ``popped`` tells how many these are; so each symbol either extends the
    current node or pops pieces that are never looked at again. Every single symbol is a piece.
    """

    def __init__(self, pieces: list[str]):
        self.next: list[dict[str, int]] = [{}]
        piece = [False]
        for p in pieces:
            node = 0
            for c in p:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    piece.append(node == 0)
                node = self.next[node][c]
            piece[node] = True
        self.link, self.popped = [0] * len(self.next), [0] * len(self.next)
        wait = deque((0, c, child) for c, child in self.next[0].items())
        while wait:
            parent, c, node = wait.popleft()
            wait.extend((node, d, child) for d, child in self.next[node].items())
            if piece[node]:
                self.popped[node] = 1
                continue
            at, n = self.link[parent], self.popped[parent]
            while at and c not in self.next[at]:
                at, n = self.link[at], n + self.popped[at]
            self.link[node] = self.next[at].get(c, 0)
            self.popped[node] = n + (c not in self.next[at])

    def count(self, symbols: str) -> int:
        node = n = 0
        for c in symbols:
            while node and c not in self.next[node]:
                n, node = n + self.popped[node], self.link[node]
            to = self.next[node].get(c)
            if to is None:
                n += 1
            else:
                node = to
        while node:
            n, node = n + self.popped[node], self.link[node]
        return n


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def vocabulary(path: str, word_end: str = "</w>") -> list[str]:
    """Pieces of a tokenizer's file as strings of symbols; a last symbol with the word-end mark is one of its own."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    stems = ((p, p.removesuffix(word_end)) for p in vocab)
    return [p if s == p or not s else s[:-1] + chr(ord(s[-1]) + LAST) for p, s in stems]


class Counts(dict):
    """White-space separated word -> (words, pieces); new words are counted by the automaton."""

    def __init__(self, path: str):
        import regex

        super().__init__()
        self.automaton, self.symbols, self.split = Automaton(vocabulary(path)), byte_symbols(), regex.compile(WORD).findall

    def __missing__(self, chunk: str) -> complex:
        parts = self.split(chunk.lower())
        n = 0
        for part in parts:
            symbols = [self.symbols[b] for b in part.encode("utf-8", "surrogatepass")]
            symbols[-1] = chr(ord(symbols[-1]) + LAST)
            n += self.automaton.count("".join(symbols))
        if len(self) < MOST_WORDS:
            self[chunk] = complex(len(parts), n)
        return complex(len(parts), n)


_made: dict[str, Counts] = {}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, n_tokens``.

    A text is lower-cased and split at white space into letter runs, single numbers and runs of other signs; each is
    counted in the pieces of the vocabulary by greedy longest match over its UTF-8 bytes. (Greedy counts can exceed those
    of the vocabulary's own merges; no text is counted in part.) Null and empty texts have none. Ids may be null or
    repeat; other columns are ignored. No rows give no rows; nothing is shuffled.
    """
    path = path or default_tokenizer()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _made:
            _made[path] = Counts(path)
        get = _made[path].__getitem__
        for batch in batches:
            sums = [sum(map(get, (t or "").split())) for k in range(0, batch.num_rows, TEXTS) for t in batch.column(1).slice(k, TEXTS).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(x.real) for x in sums], pa.int64()), pa.array([int(x.imag) for x in sums], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(counted, "doc_id bigint, n_words bigint, n_tokens bigint")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
