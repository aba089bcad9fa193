"""Token counts by a linear longest-match automaton: a vocabulary trie with failure links and counts of popped tokens."""

from __future__ import annotations

import base64
import functools

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
MEMO_WORDS = 400_000


class LongestMatch:
    """Counts the pieces of greedy longest-match word-piece tokenization in one pass over a word's bytes.

    A word is matched as its bytes after a blank, so tokens that begin with a blank are the word-initial pieces and the
    others continue. Where the trie has no edge, the failure link leads to the state after popping the longest pieces
    that are certain by then, and ``popped`` tells how many they are; ``rest`` counts those left at a word's end. No
    piece is built. Every single byte must be a token, so every word has pieces.
    """

    def __init__(self, tokens: list[bytes]):
        self.edges: dict[int, int] = {}
        parent, last, is_token = [0], [0], [False]
        for token in tokens:
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.edges:
                    self.edges[key] = len(parent)
                    parent.append(node)
                    last.append(byte)
                    is_token.append(False)
                node = self.edges[key]
            is_token[node] = True
        if any((0 << 8 | b) not in self.edges or not is_token[self.edges[b]] for b in range(256)):
            raise ValueError("every single byte must be a token")
        n = len(parent)
        depth = [0] * n
        for v in range(1, n):
            depth[v] = depth[parent[v]] + 1
        self.fail, self.popped, self.rest = [0] * n, [0] * n, [0] * n
        for v in sorted(range(1, n), key=depth.__getitem__):
            if is_token[v]:
                self.popped[v] = 1
            else:
                z, pops = self.fail[parent[v]], self.popped[parent[v]]
                while (target := self.edges.get(z << 8 | last[v])) is None:
                    pops += self.popped[z]
                    z = self.fail[z]
                self.fail[v], self.popped[v] = target, pops
        for v in sorted(range(1, n), key=depth.__getitem__):
            self.rest[v] = self.popped[v] + self.rest[self.fail[v]]

    def count(self, word: bytes) -> int:
        edges, fail, popped, node, total = self.edges, self.fail, self.popped, 0, 0
        for byte in b" " + word:
            while (target := edges.get(node << 8 | byte)) is None:
                total += popped[node]
                node = fail[node]
            node = target
        return total + self.rest[node]


@functools.cache
def automaton(vocabulary: str = VOCABULARY) -> LongestMatch:
    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        return LongestMatch([base64.b64decode(line.split()[0]) for line in lines])


def piece_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Struct of n_words and n_pieces of each whole text, words being split at ASCII white space; 0 and 0 for null and empty."""

    @F.pandas_udf("n_words long, n_pieces long")
    def counted(texts: pd.Series) -> pd.DataFrame:
        match = automaton(vocabulary).count

        class Memo(dict):
            def __missing__(self, word):
                self[word] = n = match(word)
                return n

        memo, rows = Memo(), []
        for text in texts:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            words = (text or "").encode("utf-8", "surrogatepass").split()
            rows.append((len(words), sum(map(memo.__getitem__, words))))
        return pd.DataFrame(rows, columns=["n_words", "n_pieces"])

    return counted(text)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_pieces for every row of ``docs``. Null and empty texts count 0; repeated rows each get a row; an
    empty table gives an empty one; other columns are ignored."""
    out = docs.select("doc_id", piece_count(F.col("text"), vocabulary).alias("n"))
    return out.select("doc_id", "n.n_words", "n.n_pieces")
