"""Token counts under a unigram model of a public vocabulary, by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a word with the vocabulary's word mark before it. Its best segmentation maximises the sum of its pieces'
scores, forward from the first character; the best score and count at a position depend on the characters before it alone.
So the distinct pre-tokens of a batch are inserted into a trie: each node holds the forward score and token count of its
prefix, computed once when the node is made, however many pre-tokens share it. A pre-token's count stands at its terminal
node. The vocabulary is read from a file by its path and never copied or trained.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm.text import utf8

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Scores are whole millionths of nats, so that sums are exact and ties are ties.
UNIT = 1_000_000
#: A trie is given up for a new one when it has so many nodes, which with MAX_LENGTH bounds a task's memory whatever the texts.
MAX_NODES = 400_000
#: So many pre-tokens keep their counts in a task.
MAX_KNOWN = 500_000
#: Pre-tokens of more bytes get no nodes and aren't kept: each is gone through once with the last few scores alone.
MAX_LENGTH = 200
Vocabulary = dict[str, int]


def vocabulary(path: str = VOCABULARY) -> tuple[Vocabulary, int]:
    """Pieces with their scores, and the score of one byte that no piece covers.

    A piece's probability follows its rank in the file's own order of scores, by Zipf's law; a byte is rarer than any piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    total = sum(1 / r for r in range(1, len(ids) + 2))
    score = lambda rank: round(-UNIT * math.log(rank * total))
    return {model.id_to_piece(i): score(r) for r, i in enumerate(ids, 1)}, score(len(ids) + 1)


def endings(pieces: Vocabulary) -> dict[str, tuple[int, ...]]:
    """By the last three characters of pieces (or all that they have) the lengths that end so."""
    lengths: dict[str, set[int]] = {}
    for p in pieces:
        lengths.setdefault(p[-3:], set()).add(len(p))
    return {k: tuple(sorted(v)) for k, v in lengths.items()}


class Trie:
    """Forward scores by node. Node 0 is the empty prefix; ``count`` is the token count of a node's own prefix."""

    def __init__(self, pieces: Vocabulary, byte_score: int):
        self.pieces, self.byte_score = pieces, byte_score
        self.lengths = endings(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.children: dict[tuple[int, str], int] = {}
        self.score, self.count = [0], [0]

    def insert(self, word: str) -> int:
        """The token count of ``word``. Of equally good segmentations, one of the fewest tokens."""
        children, score, count, lengths = self.children, self.score, self.count, self.lengths
        path = [0]
        for end, c in enumerate(word, 1):
            here = path[-1]
            node = children.get((here, c))
            if node is None:
                node = children[here, c] = len(score)
                size = len(c.encode("utf-8", "surrogatepass"))
                best, least = score[here] + size * self.byte_score, count[here] + size
                one, two, more = lengths.get(c, ()), lengths.get(word[end - 2 : end], ()) if end > 1 else (), lengths.get(word[end - 3 : end], ()) if end > 2 else ()
                for n in one + two + more:
                    if n > end:
                        break
                    of = self.pieces.get(word[end - n : end])
                    if of is not None:
                        before = path[end - n]
                        s, k = score[before] + of, count[before] + 1
                        if s > best or (s == best and k < least):
                            best, least = s, k
                score.append(best)
                count.append(least)
            path.append(node)
        return count[path[-1]]


    def passed(self, word: str) -> int:
        """The token count of ``word`` by the same forward pass, keeping only the scores that a piece can still reach back to."""
        keep = self.longest + 1
        score, count = [0] * keep, [0] * keep
        for end in range(1, len(word) + 1):
            size = len(word[end - 1].encode("utf-8", "surrogatepass"))
            best, least = score[(end - 1) % keep] + size * self.byte_score, count[(end - 1) % keep] + size
            for n in range(1, min(self.longest, end) + 1):
                of = self.pieces.get(word[end - n : end])
                if of is not None:
                    s, k = score[(end - n) % keep] + of, count[(end - n) % keep] + 1
                    if s > best or (s == best and k < least):
                        best, least = s, k
            score[end % keep], count[end % keep] = best, least
        return count[len(word) % keep]


class Counts(dict):
    """Token counts by pre-token, from a trie when they are first asked for."""

    def __init__(self, pieces: Vocabulary, byte_score: int):
        super().__init__()
        self.of = pieces, byte_score
        self.trie = Trie(*self.of)

    def __missing__(self, word: bytes) -> int:
        if len(word) > MAX_LENGTH:
            return self.trie.passed(MARK + word.decode("utf-8", "replace"))
        if len(self.trie.score) > MAX_NODES:
            self.trie = Trie(*self.of)
        if len(self) >= MAX_KNOWN:
            self.clear()
        n = self[word] = self.trie.insert(MARK + word.decode("utf-8", "replace"))
        return n


def token_counts(text: Column | str, path: str = VOCABULARY) -> Column:
    """``struct<n_words, n_tokens>`` of each whole text; null and empty texts have none.

    Words are runs of characters other than ASCII white space.
    """
    held = SparkSession.active().sparkContext.broadcast(vocabulary(path))
    kind = pa.struct([("n_words", pa.int64()), ("n_tokens", pa.int64())])

    @F.arrow_udf("struct<n_words:bigint,n_tokens:bigint>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = Counts(*held.value)
        for texts in batches:
            out = []
            for t in utf8(texts):
                words = t.split()
                out.append({"n_words": len(words), "n_tokens": sum(map(counts.__getitem__, words))})
            yield pa.array(out, kind)

    return counted.asNondeterministic()(text)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", token_counts("text").alias("t")).select("doc_id", "t.n_words", "t.n_tokens")
