"""Token counts of a unigram model by dynamic programming shared in a trie (operator 5)."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import caches, keep, python_ready, tidy

#: Nodes of a worker's trie; beyond, it starts anew.
NODES = 1_000_000
#: The mark that stands for the space before a word.
MARK = "▁"


def read_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece file by falling score; control, unknown and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [sp.id_to_piece(i) for i in sorted(plain, key=lambda i: (-sp.get_score(i), i))]


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Log probabilities by Zipf's law of the pieces' ranks. (The file's own scores are ranks of merges, not probabilities.)"""
    total = math.log(sum(1 / (k + 1) for k in range(len(pieces))))
    return {p: -math.log(k + 1) - total for k, p in enumerate(pieces)}


class Trie:
    """Prefixes of pre-tokens. A node has the best score of a segmentation of its prefix and that one's token count."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        #: Length of the longest piece that ends in a character.
        self.longest: dict[str, int] = {}
        for p in scores:
            self.longest[p[-1:]] = max(self.longest.get(p[-1:], 0), len(p))
        #: A character without a piece becomes its bytes, each a token, at a score below all others.
        self.fallback = min(scores.values(), default=0.0) - 10.0
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # by node and character
        self.best, self.tokens = [0.0], [0]
        #: Count of each word, which stands in the trie with the mark before it.
        self.terminal: dict[str, int] = {}

    def insert(self, token: str) -> int:
        """Adds a pre-token, scoring only the nodes that are new; returns the count at its end. Of equal scores the fewer tokens win."""
        child, best, tokens, scores, longest = self.child, self.best, self.tokens, self.scores, self.longest
        path = [0]
        node = 0
        for end, c in enumerate(token, 1):
            key = node << 21 | ord(c)
            nxt = child.get(key)
            if nxt is None:
                size = len(c.encode("utf-8", "surrogatepass"))
                top, n = best[node] + self.fallback * size, tokens[node] + size
                for start in range(max(0, end - longest.get(c, 0)), end):
                    s = scores.get(token[start:end])
                    if s is not None:
                        at = path[start]
                        v = best[at] + s
                        if v > top or v == top and tokens[at] + 1 < n:
                            top, n = v, tokens[at] + 1
                nxt = len(best)
                child[key] = nxt
                best.append(top)
                tokens.append(n)
            node = nxt
            path.append(node)
        return tokens[node]

    def counts(self, texts: Iterable[str]) -> Iterator[tuple[int, int]]:
        """(tokens, pre-tokens) of each text."""
        for text in texts:
            if len(self.best) > NODES:
                self.clear()
            words = (text if text.isascii() or unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)).split()
            known = self.terminal
            for w in [x for x in set(words) if x not in known]:
                known[w] = self.insert(MARK + w)
            yield sum(map(known.__getitem__, words)), len(words)


_tries: dict[int, Trie] = {}
caches["token_counts"] = _tries.clear


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens) for each row of ``docs`` (doc_id, text), over whole texts.

    Pre-tokens are the words of the NFKC text between white space, each with a mark before it; a pre-token's tokens are
    its best segmentation under the unigram scores of the vocabulary's pieces. Null, empty and blank texts have 0. Repeated
    rows each get their row. Nothing is shuffled; the scores, which don't grow with the data, are sent to the workers.
    """
    spark = docs.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(zipf_scores(read_pieces(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("token_counts")
        scores = shared.value
        trie = _tries.get(len(scores))
        if trie is None or trie.scores != scores:
            _tries.clear()
            trie = _tries[len(scores)] = Trie(scores)
        for b in batches:
            found = list(trie.counts(t or "" for t in b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["doc_id", "n_tokens", "n_pretokens"])
        tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_pretokens long")
