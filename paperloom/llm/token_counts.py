"""Operator 9: token counts by dynamic programming shared along a trie.

A unigram model scores each piece of a public vocabulary (Zipf's law on the piece's rank, a
fixed rule: the file holds ranks, not probabilities).  A pre-token is a word with the word
mark before it.  Distinct pre-tokens of a batch form a trie, visited depth first in sorted
order: the forward score of a node (best score of any segmentation of the prefix, and the
number of pieces in it) is computed once, from its ancestors' scores, and shared by every
pre-token below.  A terminal node keeps its count; documents then add up their words'
counts.  A word of over ``LONG_WORD`` bytes takes the same steps alone, in constant memory.  Ties between segmentations go to fewer pieces.

Defined cases: a null or empty text has no words and no tokens; characters outside the
vocabulary cost one token a UTF-8 byte; repeated rows each get a row; an empty table gives
none; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, text_bytes, tidy, word_slices

MARK = "▁"
CACHE_WORDS = 400_000
LONG_WORD = 256  # bytes; longer words are counted alone and not kept
BYTE_COST = -25.0
_models: dict[str, "TrieCounter"] = kept.setdefault("pieces", {})


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> dict[str, float]:
    """piece -> log probability by Zipf's law on its rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    total = math.log(sum(1 / (r + 2.7) for r in range(len(plain))))
    return {sp.id_to_piece(i): -math.log(r + 2.7) - total for r, i in enumerate(plain)}


class TrieCounter:
    def __init__(self, pieces: dict[str, float]):
        # Every end of a piece, with the score (never over 0) of those that are pieces.
        self.tails: dict[str, float | None] = {x[k:]: None for x in pieces for k in range(len(x))} | pieces
        self.longest = max(map(len, pieces), default=1)
        self.counts: dict[bytes, int] = {}

    def insert(self, words: list[bytes]) -> dict[bytes, int]:
        """Terminal counts of distinct words: one depth-first walk of their trie."""
        tokens = sorted((MARK + w.decode("utf-8", "replace"), w) for w in words)
        tails = self.tails
        best, count, path, out = [0.0], [0], "", {}
        for token, word in tokens:
            depth, most = 0, min(len(path), len(token))
            while depth < most and path[depth] == token[depth]:
                depth += 1
            del best[depth + 1 :], count[depth + 1 :]
            for end in range(depth + 1, len(token) + 1):
                n = len(token[end - 1].encode("utf-8", "surrogatepass"))
                s, n = best[end - 1] + BYTE_COST * n, count[end - 1] + n
                for start in range(end - 1, -1, -1):
                    p = tails.get(token[start:end], 1.0)
                    if p == 1.0:  # no piece ends so: none longer does
                        break
                    if p is not None:
                        t, m = best[start] + p, count[start] + 1
                        if t > s or (t == s and m < n):
                            s, n = t, m
                best.append(s)
                count.append(n)
            path = token
            out[word] = count[-1]
        return out

    def long_word(self, word: bytes) -> int:
        """The same for one word of any length, with the scores of its last few characters only."""
        token = MARK + word.decode("utf-8", "replace")
        best, count = deque([0.0], self.longest), deque([0], self.longest)
        for end in range(1, len(token) + 1):
            n = len(token[end - 1].encode("utf-8", "surrogatepass"))
            s, n = best[-1] + BYTE_COST * n, count[-1] + n
            for k in range(1, min(end, self.longest) + 1):
                p = self.tails.get(token[end - k : end], 1.0)
                if p == 1.0:
                    break
                if p is not None:
                    t, m = best[-k] + p, count[-k] + 1
                    if t > s or (t == s and m < n):
                        s, n = t, m
            best.append(s)
            count.append(n)
        return count[-1]

    def tokens(self, words: list[bytes]):
        """The number of tokens of each of the distinct words."""
        import numpy as np

        new = [w for w in words if len(w) <= LONG_WORD and w not in self.counts]
        if len(self.counts) + len(new) > CACHE_WORDS:
            self.counts.clear()
            new = [w for w in words if len(w) <= LONG_WORD]
        self.counts.update(self.insert(new))
        return np.fromiter((self.counts[w] if len(w) <= LONG_WORD else self.long_word(w) for w in words), np.int64, len(words))


def count_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens.  The distinct words of a slice of texts enter the trie together."""
    model = model or default_path()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        if model not in _models:
            _models[model] = TrieCounter(load_pieces(model))
        counter = _models[model]
        for b in batches:
            n_words, n_tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, words, index, offsets in word_slices(b.column(1), lower=False):
                total = np.concatenate([[0], np.cumsum(counter.tokens(words)[index])])
                n_words.append(np.diff(offsets))
                n_tokens.append(np.diff(total[offsets]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_tokens))], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(tidy(run, "pieces"), "doc_id long, n_words long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
