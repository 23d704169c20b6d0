"""Byte-level BPE encoding of a corpus with a segment tree over adjacent pair ranks.

Every piece (a match of the tokenizer's split pattern) is encoded by a
segment tree whose leaves hold ``rank * width + position`` of each adjacent
pair.  The root is therefore the leftmost pair of lowest rank; a merge changes
three leaves, each of which is carried up in logarithmic time, until the root
shows that no pair can be merged.  The trees of many pieces are kept in one
numpy array and advance together, one merge a step, so the work inside a task
is vectorised.  Nothing is shuffled: each Arrow batch of texts is encoded where
it is read, and encoded pieces are remembered per Python worker.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.json"

# The public split pattern of this vocabulary, and the characters
# of the Unicode property White_Space.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: A chunk is a word with at most one blank before it, or a stretch of white
#: space; chunk borders are always piece borders.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A leaf without a mergeable pair; beyond every rank * width + position.
NONE = np.iinfo(np.int64).max
REMEMBERED = 200_000
#: With fewer pieces than this, trees are walked one by one: numpy's calls would cost more than the steps.
FEW = 8


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    spare = (b for b in range(256) if b not in letters)
    letters |= {b: chr(256 + k) for k, b in enumerate(spare)}
    return [letters[b] for b in range(256)]


class PairTable:
    """Ranks of the mergeable pairs and the ids they merge into."""

    def __init__(self, vocab_file: str):
        with open(vocab_file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = np.array([vocab[c] for c in _byte_letters()], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], dtype=np.int64)
        self.into = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        size = 1 << (4 * len(keys)).bit_length()
        taken: dict[int, int] = {}
        for rank, home in enumerate((self._home(keys) & (size - 1)).tolist()):
            while home in taken:
                home = (home + 1) & (size - 1)
            taken[home] = rank
        at = np.fromiter(taken, dtype=np.int64)
        order = np.fromiter(taken.values(), dtype=np.int64)
        self.keys = np.full(size, -1, dtype=np.int64)
        self.ranks = np.full(size, -1, dtype=np.int64)
        self.keys[at], self.ranks[at], self.mask = keys[order], order, size - 1
        self.known, self.merged = dict(zip(keys.tolist(), range(len(keys)), strict=True)), self.into.tolist()

    @staticmethod
    def _home(key):
        return ((key * 0x9E3779B1) & 0xFFFFFFFFFFFF) >> 20

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair can't be merged."""
        key = (left << 20) | right
        at = self._home(key) & self.mask
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], -1)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while open_.size:
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def _merge_block(table: PairTable, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges n pieces of at most ``width`` tokens (a power of two) each.

    tokens is (n, width), filled with the byte ids of each piece; sizes has
    their number.  Returns the tokens and a mask of those that remain.
    """
    n, width = tokens.shape
    ranks_at = np.arange(width, dtype=np.int64)
    alive = ranks_at < sizes[:, None]
    after = np.tile(np.arange(1, width + 1), (n, 1))
    before = np.tile(np.arange(-1, width - 1), (n, 1))
    tree = np.full((n, 2 * width), NONE, dtype=np.int64)
    if width > 1:
        pair = table.rank(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(n, width - 1)
        usable = (pair >= 0) & alive[:, 1:]
        tree[:, width:-1] = np.where(usable, pair * width + ranks_at[:-1], NONE)
    node = width
    while node > 1:
        half = node // 2
        tree[:, half:node] = np.minimum(tree[:, node : 2 * node : 2], tree[:, node + 1 : 2 * node : 2])
        node = half
    if n < FEW:
        for k in range(n):
            _merge_one(table, tree[k], tokens[k], alive[k], int(sizes[k]))
        return tokens, alive
    flat, toks = tree.ravel(), tokens.ravel()
    nxt, prv, live = after.ravel(), before.ravel(), alive.ravel()
    size = sizes.astype(np.int64)
    rows = np.flatnonzero(tree[:, 1] < NONE)
    while rows.size:
        root = flat[rows * (2 * width) + 1]
        place, rank = root % width, root // width
        base = rows * width
        gone = nxt[base + place]
        follow = nxt[base + gone]
        lead = prv[base + place]
        toks[base + place] = table.into[rank]
        live[base + gone] = False
        nxt[base + place] = follow
        has_follow, has_lead = follow < size[rows], lead >= 0
        inner = np.flatnonzero(has_follow)
        prv[base[inner] + follow[inner]] = place[inner]
        top = rows * (2 * width)
        flat[top + width + gone] = NONE
        flat[top + width + place] = NONE
        lead_in = np.flatnonzero(has_lead)
        left = np.concatenate([place[inner], lead[lead_in]])
        right = np.concatenate([follow[inner], place[lead_in]])
        owner = np.concatenate([inner, lead_in])
        r = table.rank(toks[base[owner] + left], toks[base[owner] + right])
        flat[top[owner] + width + left] = np.where(r >= 0, r * width + left, NONE)
        at = np.concatenate([width + gone, width + place, width + lead[lead_in]])
        tops = np.concatenate([top, top, top[lead_in]])
        while at[0] > 1:
            at = at >> 1
            down = tops + 2 * at
            flat[tops + at] = np.minimum(flat[down], flat[down + 1])
        rows = rows[flat[top + 1] < NONE]
    return tokens, alive


def _merge_one(table: PairTable, tree: np.ndarray, tokens: np.ndarray, alive: np.ndarray, size: int) -> None:
    """_merge_block for one piece and its filled tree; changes tokens and alive in place."""
    width = len(tokens)
    nodes, toks, live = tree.tolist(), tokens.tolist(), alive.tolist()
    after, before = list(range(1, width + 1)), list(range(-1, width - 1))
    into, known = table.merged, table.known
    while nodes[1] < NONE:
        rank, place = divmod(nodes[1], width)
        gone = after[place]
        follow, lead = after[gone], before[place]
        toks[place], live[gone], after[place] = into[rank], False, follow
        leaves = {gone: NONE, place: NONE}
        if follow < size:
            before[follow] = place
            r = known.get((toks[place] << 20) | toks[follow])
            if r is not None:
                leaves[place] = r * width + place
        if lead >= 0:
            r = known.get((toks[lead] << 20) | toks[place])
            leaves[lead] = NONE if r is None else r * width + lead
        for leaf, value in leaves.items():
            at = width + leaf
            nodes[at] = value
            while at > 1:
                other = nodes[at ^ 1]
                value = value if value < other else other
                at >>= 1
                if nodes[at] == value:
                    break
                nodes[at] = value
    tokens[:], alive[:] = toks, live


def encode_pieces(table: PairTable, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces one after the other, and each piece's number of tokens."""
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    counts = np.zeros(len(pieces), dtype=np.int64)
    found: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    width = 1
    longest = int(sizes.max(initial=0))
    lower = 0
    while lower < longest:
        pick = np.flatnonzero((sizes > lower) & (sizes <= width))
        step = max(1, (1 << 18) // width)
        for k in range(0, pick.size, step):
            rows = pick[k : k + step]
            raw = np.frombuffer(b"".join(pieces[i] for i in rows), dtype=np.uint8)
            own = sizes[rows]
            tokens = np.zeros((rows.size, width), dtype=np.int64)
            tokens[np.arange(width) < own[:, None]] = table.byte_ids[raw]
            tokens, alive = _merge_block(table, tokens, own)
            counts[rows] = alive.sum(axis=1)
            found.append(tokens[alive])
            owners.append(rows)
        lower, width = width, width * 2
    if not found:
        return np.empty(0, dtype=np.int64), counts
    order = np.concatenate(owners)
    ids = np.concatenate(found)
    return _gather(ids, _starts(counts[order])[np.argsort(order)], counts[np.sort(order)]), counts


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _gather(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """ids[start : start + count] of every stretch, one after the other."""
    total = int(counts.sum())
    return ids[np.repeat(starts - _starts(counts), counts) + np.arange(total)]


class _Numbered(dict):
    """Gives every new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Encoder:
    """Encodes texts and remembers the chunks and pieces that it has met."""

    def __init__(self, vocab_file: str, remembered: int = REMEMBERED):
        self.table = PairTable(vocab_file)
        self.split = regex.compile(SPLIT)
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.chunks = _Numbered()
        self.ids = np.empty(0, dtype=np.int32)
        self.starts = np.empty(0, dtype=np.int64)
        self.counts = np.empty(0, dtype=np.int64)

    def _learn(self) -> None:
        """Encodes the chunks numbered since the last call."""
        known = self.counts.size
        if len(self.chunks) == known:
            return
        new = list(self.chunks)[known:]
        numbered = _Numbered()
        split, number = self.split.findall, numbered.__getitem__
        flat: list[int] = []
        spans = np.empty(len(new), dtype=np.int64)
        for k, chunk in enumerate(new):
            codes = list(map(number, split(chunk)))
            flat += codes
            spans[k] = len(codes)
        ids, counts = encode_pieces(self.table, [p.encode("utf-8", "surrogatepass") for p in numbered])
        starts = _starts(counts)
        codes = np.array(flat, dtype=np.int64)
        new_ids = _gather(ids, starts[codes], counts[codes])
        new_counts = np.add.reduceat(counts[codes], _starts(spans)) if spans.size else spans
        self.starts = np.concatenate([self.starts, _starts(new_counts) + self.ids.size])
        self.ids = np.concatenate([self.ids, new_ids.astype(np.int32)])
        self.counts = np.concatenate([self.counts, new_counts])

    def _numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.chunks) > self.remembered:
            self._forget()
        find, number = CHUNK.findall, self.chunks.__getitem__
        flat: list[int] = []
        spans = np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            if text:
                codes = list(map(number, find(text)))
                flat += codes
                spans[k] = len(codes)
        self._learn()
        return np.array(flat, dtype=np.int64), spans

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each."""
        codes, spans = self._numbers(texts)
        counts = self.counts[codes]
        return _gather(self.ids, self.starts[codes], counts), _sums(counts, spans)

    def count(self, texts: list[str | None]) -> np.ndarray:
        codes, spans = self._numbers(texts)
        return _sums(self.counts[codes], spans)


def _sums(values: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Sum of each successive span of values; 0 for an empty one."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(spans)
    return total[ends] - total[ends - spans]


@lru_cache(maxsize=2)
def encoder(vocab_file: str) -> Encoder:
    """The encoder of this Python worker; it lives as long as the worker."""
    return Encoder(vocab_file)


def _slices(batch: pa.RecordBatch, column: str, most_bytes: int):
    """Parts of a batch whose texts have about most_bytes together; one long text is a part of its own."""
    texts = batch.column(column)
    sizes = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1] if pa.types.is_string(texts.type) and len(texts) else None
    if sizes is None:
        for k in range(0, batch.num_rows, 256):
            yield batch.slice(k, 256)
        return
    part = (sizes[1:].astype(np.int64) - sizes[0] - 1) // most_bytes
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def encode_corpus(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocab_file: str = DEFAULT_VOCAB, most_bytes: int = 4_000_000
) -> DataFrame:
    """Rows (id_col, ids ARRAY<INT>), one for each row of docs, without special tokens.

    NULL and empty texts give an empty list; blank texts are encoded like any
    other.  Repeated rows stay as they are, other columns are not read, and a
    NULL id is kept.  The vocabulary file must be readable by the executors.
    """
    schema = docs.select(F.col(id_col)).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        enc = encoder(vocab_file)
        for batch in batches:
            for part in _slices(batch, "_text", most_bytes):
                ids, counts = enc.encode(part.column("_text").to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("_id"), lists], names=[id_col, "ids"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def count_tokens(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocab_file: str = DEFAULT_VOCAB, most_bytes: int = 4_000_000
) -> DataFrame:
    """Rows (id_col, n_tokens BIGINT): the length of encode_corpus's list, which itself is not sent."""
    schema = docs.select(F.col(id_col)).schema.add("n_tokens", T.LongType())

    def run(batches):
        enc = encoder(vocab_file)
        for batch in batches:
            for part in _slices(batch, "_text", most_bytes):
                counts = enc.count(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(counts)], names=[id_col, "n_tokens"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)
