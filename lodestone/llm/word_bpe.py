"""BPE with word ends: speculate, verify, and merge only what fails.

A word's symbols are its bytes, the last one marked as the word's end. Greedy longest match in a trie of the vocabulary
proposes the tokens of all words of a batch at once. The proposal is what merging would give exactly if no merge would
ever have crossed a boundary between two neighbours: going back in time, the token left of a boundary was its right half,
then that one's right half, and the token right of it its left half; a pair of these that lived at the same time and has
a merge of that time crosses the boundary. All neighbouring pairs are checked so in arrays. Words with a crossing are
merged exactly, by rank and then from the left.

Texts are cut at ASCII white space, which no token crosses; each distinct piece of a batch is encoded once, and workers
keep the pieces they have met. Normalisation and the cut into words are the vocabulary file's own.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .columns import text_or_empty

#: Pieces that a worker keeps, and the longest of them.
CACHE_PIECES, CACHE_LENGTH = 400_000, 64
#: Pieces that need no normalising but lower case and are cut in one way: Latin letters, then a mark of punctuation.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([,.;:?!]?)")
_FINAL = 256
_NEVER = np.iinfo(np.int64).max
#: Symbols up to which a word's least pair is looked for in a list.
_SHORT = 100


class Vocabulary:
    """The tokens and merges of a file of the tokenizers library: a byte-level BPE model with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        model = found["model"]
        suffix = model.get("end_of_word_suffix")
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not suffix or not plain or found.get("decoder") or found.get("post_processor"):
            raise ValueError("a byte-level BPE vocabulary with an end-of-word suffix and without decoder or post-processor is needed")
        self.added = {t["content"]: t["id"] for t in found["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in found["added_tokens"]):
            raise ValueError("added tokens must be taken from the text as it is")
        # The published byte alphabet: printable bytes stand for themselves, the others for the code points from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.to_bytes = {b: b for b in shown} | {256 + k: b for k, b in enumerate(hidden)}
        ids = model["vocab"]
        n = max([*ids.values(), *self.added.values()]) + 1
        self.strings = [b""] * n
        for s, i in [*ids.items(), *self.added.items()]:
            self.strings[i] = s.encode()
        self.size = n
        self.base = np.full(2 * _FINAL, -1, np.int64)
        symbols: dict[int, tuple[int, ...]] = {}
        for code, byte in self.to_bytes.items():
            for mark, end in ((0, ""), (_FINAL, suffix)):
                if (i := ids.get(chr(code) + end)) is not None:
                    self.base[byte + mark] = i
                    symbols[i] = (byte + mark,)
        if (self.base < 0).any():
            raise ValueError("every byte needs a token, inside a word and at its end")
        self.left, self.right, self.rank = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        #: The rank of a merge by left part times size plus right part, and the token that each rank makes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        #: Merged tokens that an earlier merge makes too, or with parts of a later rank: nothing is proposed for these.
        odd = set()
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y, made = ids[a], ids[b], ids[a + b]
            if x * n + y in self.ranks or made in symbols or x not in symbols or y not in symbols:
                odd.add(made)
            self.ranks[x * n + y] = rank
            self.made.append(made)
            if made not in symbols and x in symbols and y in symbols:
                symbols[made] = symbols[x] + symbols[y]
                self.left[made], self.right[made], self.rank[made] = x, y, rank
        keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.fromiter(self.ranks.values(), np.int64, len(keys))[order]
        merged = np.array([i for i in symbols if self.rank[i] >= 0], np.int64)
        # A token is proposed if merging its own symbols ends in it: nothing crosses between its halves before its own merge.
        sound = ~self.crossed(self.left[merged], self.right[merged], self.rank[merged])
        bad = odd | set(merged[~sound].tolist())
        self.proposed = {i: s for i, s in symbols.items() if i not in bad and not bad.intersection((int(self.left[i]), int(self.right[i])))}
        self._build_trie()

    def _build_trie(self) -> None:
        edges: dict[int, int] = {}
        token = [-1]
        for i, path in self.proposed.items():
            node = 0
            for s in path:
                key = node * 2 * _FINAL + s
                if (below := edges.get(key)) is None:
                    below = edges[key] = len(token)
                    token.append(-1)
                node = below
            token[node] = i
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.edge_keys, self.edge_nodes = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.node_token = np.array(token, np.int64)

    def crossed(self, left: np.ndarray, right: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether a merge (of a rank below ``until``) would cross the boundary of each pair of tokens."""
        n = len(left)
        out = np.zeros(n, bool)
        rows = np.arange(n)
        x, y = left.copy(), right.copy()
        end_x = np.full(n, _NEVER) if until is None else until.copy()  # the rank of the merge that takes x away
        end_y = end_x - 1 if until is not None else end_x.copy()  # of equal ranks the merge further left comes first
        while len(rows):
            keys = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NEVER)
            hit = (rank < end_x) & (rank <= end_y) & (rank != _NEVER)
            out[rows[hit]] = True
            go = ~hit & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            rows, x, y, end_x, end_y = rows[go], x[go], y[go], end_x[go], end_y[go]
            later = self.rank[x] >= self.rank[y]  # the one that was made later was in parts before
            end_x, end_y = np.where(later, self.rank[x], end_x), np.where(later, end_y, self.rank[y])
            x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
        return out

    def longest(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest proposed token from every symbol on, and its number of symbols."""
        n = len(symbols)
        token, length = self.base[symbols], np.ones(n, np.int64)
        at, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        while len(at):
            keys = node * 2 * _FINAL + symbols[at + depth]
            k = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
            on = self.edge_keys[k] == keys
            at, node = at[on], self.edge_nodes[k[on]]
            found = self.node_token[node]
            token[at[found >= 0]], length[at[found >= 0]] = found[found >= 0], depth + 1
            depth += 1
            inside = at + depth < n
            at, node = at[inside], node[inside]
        return token, length

    def merge(self, tokens: list[int]) -> list[int]:
        """Exact merging of a word's symbols, as tokens: always the pair of the least rank, of equal ones the leftmost."""
        return self._merge_short(tokens) if len(tokens) <= _SHORT else self._merge_long(tokens)

    def _merge_short(self, tokens: list[int]) -> list[int]:
        size, rank_of, made = self.size, self.ranks.get, self.made
        ranks = [rank_of(x * size + y, _NEVER) for x, y in zip(tokens, tokens[1:])]
        while ranks and (least := min(ranks)) != _NEVER:
            at = ranks.index(least)
            tokens[at : at + 2] = [made[least]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of(tokens[at - 1] * size + tokens[at], _NEVER)
            if at < len(ranks):
                ranks[at] = rank_of(tokens[at] * size + tokens[at + 1], _NEVER)
        return tokens

    def _merge_long(self, tokens: list[int]) -> list[int]:
        """With a queue of pairs, so that the time grows as n log n."""
        size = self.size
        after, before = [*range(1, len(tokens)), -1], list(range(-1, len(tokens) - 1))
        queue: list[tuple[int, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and (nxt := after[at]) >= 0:
                key = tokens[at] * size + tokens[nxt]
                if (rank := self.ranks.get(key)) is not None:
                    heapq.heappush(queue, (rank, at, key))

        for at in range(len(tokens) - 1):
            offer(at)
        while queue:
            rank, at, key = heapq.heappop(queue)
            nxt = after[at]
            if tokens[at] < 0 or nxt < 0 or tokens[at] * size + tokens[nxt] != key:
                continue  # one of the two has been merged since
            tokens[at], tokens[nxt] = self.made[rank], -1
            after[at] = after[nxt]
            if after[at] >= 0:
                before[after[at]] = at
            offer(before[at])
            offer(at)
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Token ids of all words in order, the index of each word's first id (with the end), and how many words failed."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64), 0
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        symbols[ends - 1] += _FINAL  # nothing in the trie goes on from a word's end
        token, length = self.longest(symbols)
        steps, starts, at = length.tolist(), [], 0
        while at < len(symbols):
            starts.append(at)
            at += steps[at]
        starts = np.array(starts, np.int64)
        ids = token[starts]
        word = np.searchsorted(ends, starts, "right")
        same = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(ids[same] * self.size + ids[same + 1], return_inverse=True)
        bad = np.unique(word[same[self.crossed(pairs // self.size, pairs % self.size)[back]]])
        first = np.searchsorted(word, np.arange(len(words) + 1))
        if not len(bad):
            return ids, first, 0
        single, known, edge, count = self.base[symbols].tolist(), ids.tolist(), first.tolist(), np.diff(first).tolist()
        out: list[int] = []
        done = 0
        for w, end in zip(bad.tolist(), ends[bad].tolist()):
            exact = self.merge(single[end - len(words[w]) : end])
            out += known[done : edge[w]]
            out += exact
            done, count[w] = edge[w + 1], len(exact)
        return np.array(out + known[done:], np.int64), np.r_[0, np.cumsum(count)], len(bad)


class Encoder:
    """Ids of whole texts and strings of ids, as the tokenizers library has them without special tokens being added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(path)
        own = Tokenizer.from_file(path)
        self.normalize, self.cut = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(self.vocabulary.added, key=len, reverse=True))) + ")") if self.vocabulary.added else None
        self.kept: dict[str, bytes] = {}

    def _words(self, piece: str) -> list[bytes | int]:
        """The words of a piece; of added tokens their ids."""
        if self.added is not None and "<" in piece and self.added.search(piece):
            return [w for x in self.added.split(piece) if x for w in ([self.vocabulary.added[x]] if x in self.vocabulary.added else self._cut(x))]
        return self._cut(piece)

    def _cut(self, piece: str) -> list[bytes]:
        if (plain := _PLAIN.fullmatch(piece)) is not None:
            return [x.lower().encode() for x in plain.groups() if x]
        return [w.translate(self.vocabulary.to_bytes).encode("latin-1") for w, _ in self.cut(self.normalize(piece)) if w]

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        parts = [self._words(p) for p in pieces]
        words = list(dict.fromkeys(w for part in parts for w in part if not isinstance(w, int)))
        ids, first, _ = self.vocabulary.encode_words(words)
        packed = ids.astype("<u4").tobytes()
        edges = (4 * first).tolist()
        of_word: dict[bytes | int, bytes] = {w: packed[edges[k] : edges[k + 1]] for k, w in enumerate(words)}
        of_word |= {i: i.to_bytes(4, "little") for i in self.vocabulary.added.values()}
        return {p: b"".join(map(of_word.__getitem__, part)) for p, part in zip(pieces, parts)}

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of every text; texts are not null."""
        cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        first = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        found = pc.fill_null(cut.flatten(), "").dictionary_encode()
        pieces = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        table = list(map(self.kept.get, pieces))
        missing = [k for k, b in enumerate(table) if b is None]
        new = self._encode_pieces([pieces[k] for k in missing])
        for k in missing:
            table[k] = new[pieces[k]]
        if len(self.kept) + len(new) > CACHE_PIECES:
            self.kept.clear()
        self.kept |= {p: b for p, b in new.items() if len(p) <= CACHE_LENGTH}
        code, of_code = found.indices.to_numpy(zero_copy_only=False).tolist(), table.__getitem__
        return [b"".join(map(of_code, code[lo:hi])) for lo, hi in zip(first.tolist(), first[1:].tolist())]

    def decode(self, packed: bytes) -> str:
        strings = self.vocabulary.strings
        return b" ".join([strings[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode()


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker's own; a vocabulary is read once a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of bounded size; a longer single text is a run of its own."""
    texts = column.cast(pa.large_string())
    for lo, hi, _, _ in K.text_slices(texts):
        yield texts.slice(lo, hi - lo)


def _mapped(df: DataFrame, column: str, out: str, f: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``df`` with the (binary or string) column replaced by what ``f`` makes of it."""
    rest = [c for c in df.columns if c != column]
    types = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in rest], out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], f(batch.column(column))], [*rest, out.split()[0].strip("`")])

    return K.map_batches(df, run, schema)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (binary: little-endian unsigned 32-bit), n_tokens. Null and empty texts have
    no ids; null ids of documents are kept; repeated rows are encoded alike; an empty table gives an empty result; other
    columns are ignored. Whole texts are encoded, however long; a text that holds an added token's string gets its id."""
    slim = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    encode = lambda texts: pa.array([b for part in _slices(texts) for b in _encoder(path).encode(part)], pa.binary())
    return _mapped(slim, "text", "ids binary", encode).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode_ids(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with its ids replaced by their text; the tokens' own strings with a space between, as a vocabulary without
    a decoder has it. Null ids are no text at all: null."""
    decode = lambda ids: pa.array([None if b is None else _encoder(path).decode(b) for b in ids.to_pylist()], pa.string())
    return _mapped(encoded, ids_col, f"`{text_col}` string", decode)
