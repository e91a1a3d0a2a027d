"""Token counts of a unigram segmentation, by dynamic programming shared over a trie of pre-tokens.

A pre-token's best segmentation maximises the sum of its pieces' scores (ties: fewer pieces). The forward scores of a
word depend on its prefix only: every prefix is a node of a trie, whose score is computed once, when the node is made,
and the piece count of a pre-token is stored where it ends. A worker keeps its trie over all batches and tasks; what
comes when it is full is walked in sorted order on branches that are cut off again. Every document is counted where it
is read; nothing is shuffled.

Scores are data: piece -> log probability. No unigram vocabulary is at hand and none may be trained, so the default
(zipf_scores) takes the pieces of a vocabulary file and the logarithm of their rank's Zipf weight.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

#: Nodes and terminals that a worker keeps; the first ones belong to the frequent words.
KEPT_NODES, KEPT_WORDS = 800_000, 400_000
START = "▁"


def zipf_scores(path: str) -> tuple[dict[str, float], float]:
    """(scores, score of an unknown byte) of the pieces of a vocabulary file: the logarithm of each rank's Zipf weight."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: -math.log(k + 2) for k, p in enumerate(pieces)}, -math.log(len(pieces) + 2) - 1


class UnigramTrie:
    """Counts of pre-tokens under piece scores; characters that no piece holds cost one piece for each of their bytes."""

    def __init__(self, scores: dict[str, float], unknown: float, kept_nodes: int = KEPT_NODES):
        self.scores, self.unknown, self.kept_nodes = scores, unknown, kept_nodes
        self.longest: dict[str, int] = {}  # length of the longest piece with these last three characters
        for piece in scores:
            self.longest[piece[-3:]] = max(len(piece), self.longest.get(piece[-3:], 2))
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.pieces = array("d", [0.0]), array("i", [0])  # best score of a node's prefix, and its pieces
        self.terminal: dict[bytes, int] = {}

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, int]]:
        """(word, pieces) for words in sorted order, which share the nodes of their prefixes."""
        scores, longest, unknown, child, score, pieces = self.scores, self.longest, self.unknown, self.child, self.score, self.pieces
        path, last = [0], ""
        kept = max(len(score), self.kept_nodes)
        for word in words:
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            if len(score) > kept:  # branches beyond the kept ones end where the path leaves them
                size = max(kept, path[-1] + 1)
                del score[size:], pieces[size:]
            for end in range(shared + 1, len(word) + 1):
                c = word[end - 1]
                node = child.get((path[-1], c))
                if node is None:
                    n = len(c.encode())
                    up = path[-1]
                    best, count = score[up] + n * unknown, pieces[up] + n
                    for start in range(max(0, end - longest.get(word[max(0, end - 3) : end], 2)), end):
                        s = scores.get(word[start:end])
                        if s is not None:
                            s += score[path[start]]
                            if s > best + 1e-9 or (s > best - 1e-9 and pieces[path[start]] + 1 < count):
                                best, count = s, pieces[path[start]] + 1
                    node = len(score)
                    score.append(best)
                    pieces.append(count)
                    if node < kept:
                        child[path[-1], c] = node
                path.append(node)
            last = word
            yield word, pieces[path[-1]]
        del score[kept:], pieces[kept:]

    def counts(self, words: set[bytes]) -> dict[bytes, int]:
        """Pieces of the words (UTF-8, without the start mark) that are no terminals yet; terminals are made of the first ones."""
        new = {START + w.decode("utf-8", "replace"): w for w in words - self.terminal.keys()}
        fresh = {new[w]: n for w, n in self.walk(sorted(new))}
        for w, n in fresh.items():
            if len(self.terminal) >= KEPT_WORDS:
                break
            self.terminal[w] = n
        return fresh


_tries: dict[str, UnigramTrie] = {}


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", scores=zipf_scores) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_tokens.

    ``scores`` makes (piece scores, score of an unknown byte) of the vocabulary file; a worker calls it once. Pre-tokens
    are runs of anything but ASCII white space, each with a start mark. Null and empty texts have none. Every row is
    counted by itself; null ids are kept; other columns are ignored; an empty table gives an empty result.
    """
    name = f"{scores.__module__}.{scores.__qualname__} {vocabulary}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _tries.get(name) or _tries.setdefault(name, UnigramTrie(*scores(vocabulary)))
        for batch in batches:
            words = [(t.as_buffer().to_pybytes() if t.is_valid else b"").split() for t in batch.column(1)]
            fresh = trie.counts({w for ws in words for w in ws})
            known = trie.terminal
            totals = [sum(known[w] if w in known else fresh[w] for w in ws) for ws in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(ws) for ws in words], pa.int64()), pa.array(totals, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return K.map_batches(slim, count, "doc_id long, n_words long, n_tokens long")


def brute_force(text: str | None, scores: dict[str, float], unknown: float) -> tuple[int, int]:
    """(n_words, n_tokens), every word on its own."""
    total, words = 0, (text or "").encode().split()
    for raw in words:
        word = START + raw.decode()
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(best[end - 1][0] + n * unknown, best[end - 1][1] + n)]
            options += [(best[k][0] + scores[word[k:end]], best[k][1] + 1) for k in range(end) if word[k:end] in scores]
            top = max(s for s, _ in options)
            best.append((top, min(c for s, c in options if s > top - 1e-9)))
        total += best[-1][1]
    return len(words), total
