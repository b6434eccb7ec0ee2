"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

The vocabulary of a public SentencePiece model gives the pieces.  A segmentation's
weight is the product of its pieces' weights, ``(rank + 1) ** -alpha`` by the
piece's place in the merge order, so early merges weigh most.  For each unit of a
text (a word with the spaces before it; no piece crosses units) the forward pass
sums the weights of all segmentations up to each place; the backward pass then
draws pieces from the end, each in proportion to the weight of all segmentations
that end in it.  That is an exact draw from all segmentations of the text.  The
draws are hashes of seed, row key, unit and step, against shares of 32 bits: every run and
every partitioning gives the same pieces.

A character that no piece covers, U+2581 itself included, becomes its UTF-8 byte
pieces, so decoding always returns the text.

Defined results: null and empty texts have no pieces and decode to the empty text;
equal rows of one key get equal pieces; a null key counts as -1; other columns are
not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import MIX, mix64, salt, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, SEED = 1.0, 42
UNIT = re.compile(r" +[^ \n]*|[^ \n]+|\n")
SPACE = "▁"
SLICE = 1 << 19
#: Characters whose lattices a task keeps (about 100 bytes each), and bits of a share.
KEPT = 1 << 21
SHARE = np.uint64(32)


@dataclass
class Pieces:
    """Texts and log weights of the pieces; byte pieces are last resorts.  Sent to the executors (about 20 MB)."""

    text: list[bytes]
    weight: np.ndarray
    byte: list[int]
    hashes: np.ndarray = field(init=False)
    ids: np.ndarray = field(init=False)
    codes: np.ndarray = field(init=False)
    at: np.ndarray = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self):
        plain = [i for i, t in enumerate(self.text) if t and i not in set(self.byte)]
        codes = [np.frombuffer(self.text[i].decode().encode("utf-32-le"), np.uint32) for i in plain]
        self.longest = max(map(len, codes))
        self.at = np.zeros(len(self.text), np.int64)
        self.at[plain] = np.cumsum([0, *map(len, codes)])[:-1]
        self.codes = np.concatenate(codes)
        h = np.array([string_hash(c) for c in codes], np.uint64)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], np.array(plain)[order]
        # The first hash of each beginning of 22 bits, and how many have the same one at most.
        start = (self.hashes >> np.uint64(42)).astype(np.int64)
        self.first = np.full(1 << 22, -1, np.int32)
        self.first[start[::-1]] = np.arange(len(start), dtype=np.int32)[::-1]
        self.run = int(np.bincount(start).max())

    def find(self, h: np.ndarray, text: np.ndarray, here: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the strings of ``length`` characters of ``text`` from ``here`` on, with hashes ``h``, are pieces, and their ids."""
        at = self.first[h >> np.uint64(42)]
        maybe = np.flatnonzero(at >= 0)
        at, wanted = at[maybe], h[maybe]
        hit = self.hashes[at] == wanted
        for _ in range(self.run - 1):
            at = np.minimum(at + ~hit, len(self.hashes) - 1)
            hit = self.hashes[at] == wanted
        maybe, ids = maybe[hit], self.ids[at[hit]]
        same = np.ones(len(ids), bool)
        for k in range(length):  # equal hashes, equal characters
            same &= self.codes[np.minimum(self.at[ids] + k, len(self.codes) - 1)] == text[here[maybe] + k]
        return maybe[same], ids[same]


def string_hash(codes: np.ndarray) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in codes:
        h = mix64(h * MIX + np.uint64(int(c) + 1))
    return h[0]


def read_pieces(path: str) -> tuple[list[bytes], list[int], np.ndarray]:
    """Texts of all pieces, the pieces of single bytes, and scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    text, byte, score = [], [0] * 256, np.zeros(n)
    for i in range(n):
        piece = model.id_to_piece(i)
        score[i] = model.get_score(i)
        if model.is_byte(i):
            byte[int(piece[3:5], 16)] = i
            text.append(bytes([int(piece[3:5], 16)]))
        else:
            text.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(SPACE, " ").encode())
    return text, byte, score


def pieces_of(path: str = MODEL, alpha: float = ALPHA) -> Pieces:
    text, byte, score = read_pieces(path)
    rank, n = np.maximum(0.0, -score), len(text)
    return Pieces(text, -alpha * np.log1p(np.where(rank > n, n, rank)), byte)


class Lattice:
    """All segmentations of distinct units: for each end node the pieces that reach it, with running shares."""

    def __init__(self, units: list[str], pieces: Pieces):
        size = np.array([len(u) for u in units], np.int64)
        self.first = np.cumsum(size + 1) - size - 1  # node before the first character of a unit
        self.last = self.first + size
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        node = np.arange(len(codes)) + np.repeat(np.arange(len(units)), size)  # node before each character
        room = np.repeat(self.last, size) - node
        h = np.zeros(len(codes), np.uint64)
        begin, piece, end = [], [], []
        single = np.zeros(len(codes), bool)
        here = np.arange(len(codes))
        for k in range(pieces.longest):
            here = here[room[here] > k]
            if not len(here):
                break
            h[here] = mix64(h[here] * MIX + codes[here + k].astype(np.uint64) + np.uint64(1))
            at, ids = pieces.find(h[here], codes, here, k + 1)
            begin.append(node[here[at]])
            end.append(node[here[at]] + k + 1)
            piece.append(ids)
            if k == 0:
                single[here[at]] = True
        bare = np.flatnonzero(~single)  # these become byte pieces, marked by negative numbers
        begin.append(node[bare])
        end.append(node[bare] + 1)
        piece.append(-1 - codes[bare].astype(np.int64))
        begin, end, piece = map(np.concatenate, (begin, end, piece))
        weight = np.where(piece >= 0, pieces.weight[np.maximum(piece, 0)], 4 * pieces.weight.min())
        depth = end - np.repeat(self.first, size + 1)[end] if len(end) else end
        width = np.int64(pieces.longest + 1)  # by depth, end and length: no two pieces are equal in all
        order = np.argsort((depth * (len(codes) + len(units) + 1) + end) * width + (end - begin))
        begin, end, piece, weight, depth = (x[order] for x in (begin, end, piece, weight, depth))
        total = np.zeros(int(self.last[-1]) + 1 if len(units) else 0)
        share = np.zeros(len(end))
        cuts = np.flatnonzero(np.diff(depth, prepend=0, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # one depth of all units at a time: forward filtering
            value = total[begin[a:b]] + weight[a:b]
            heads = np.flatnonzero(np.diff(end[a:b], prepend=-1))
            many = np.diff(np.append(heads, b - a))
            top = np.maximum.reduceat(value, heads)
            # Whole numbers: sums over other units of the slice then leave no trace.
            part = np.floor(np.exp(value - np.repeat(top, many)) * 2.0 ** 40).astype(np.int64)
            sums = np.add.reduceat(part, heads)
            total[end[a:b][heads]] = top + np.log(sums * 2.0 ** -40)
            run = np.cumsum(part)
            share[a:b] = (run - np.repeat(run[heads] - part[heads], many)) / np.repeat(sums, many)
        order = np.argsort(end * width + (end - begin))
        self.begin, self.piece = begin[order], piece[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=len(total)))])
        #: Node, and the share of its segmentations that come before a piece: whole numbers, so that a draw
        #: doesn't depend on where in the store a unit is.
        self.keys = end[order].astype(np.uint64) << SHARE | np.minimum(share[order] * 2.0 ** 32, 2 ** 32 - 1).astype(np.uint64)


class Solved:
    """Lattices of all units that a worker has met, end to end, up to ``kept`` characters.

    Most units of a slice were in an earlier one; only new ones are solved.  What is kept
    speeds up the work and decides nothing.
    """

    def __init__(self, pieces: Pieces, kept: int = KEPT):
        self.pieces, self.kept = pieces, kept
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.nodes = self.edges = self.units = 0
        self.first, self.last = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.begin, self.piece = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.start, self.keys = np.zeros(1, np.int64), np.zeros(0, np.uint64)

    def put(self, name: str, at: int, values: np.ndarray) -> None:
        have = getattr(self, name)
        if at + len(values) > len(have):
            grown = np.zeros(max(2 * len(have), at + len(values)), have.dtype)
            grown[:at] = have[:at]
            setattr(self, name, grown)
            have = grown
        have[at:at + len(values)] = values

    def numbers(self, rows: list[list[str]]) -> np.ndarray:
        """The number of each unit of the rows; those not met before are solved."""
        if self.nodes > self.kept:
            self.clear()
        index = self.index
        known = len(index)
        which = np.array([index.setdefault(u, len(index)) for row in rows for u in row], np.int64)
        if len(index) > known:
            new = Lattice(list(itertools.islice(index, known, None)), self.pieces)
            self.put("first", known, new.first + self.nodes)
            self.put("last", known, new.last + self.nodes)
            self.put("begin", self.edges, new.begin + self.nodes)
            self.put("piece", self.edges, new.piece)
            self.put("keys", self.edges, new.keys + (np.uint64(self.nodes) << SHARE))
            self.put("start", self.nodes, new.start + self.edges)
            self.nodes += len(new.start) - 1
            self.edges += len(new.begin)
        return which

    def draw(self, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each unit occurrence end to end, and their number: backward sampling in step."""
        node, stop = self.last[unit], self.first[unit]
        count = np.zeros(len(unit), np.int64)
        active, steps = np.flatnonzero(node > stop), []
        while len(active):
            u = mix64(key[active] + salt(len(steps) + 1)) >> np.uint64(32)
            here = node[active]
            wanted = here.astype(np.uint64) << SHARE | u
            at, end = self.start[here], self.start[here + 1] - 1
            low = np.flatnonzero((at < end) & (self.keys[at] < wanted))
            while len(low):
                at[low] += 1
                low = low[(at[low] < end[low]) & (self.keys[at[low]] < wanted[low])]
            steps.append((active, self.piece[at]))
            count[active] += 1
            node[active] = self.begin[at]
            active = active[node[active] > stop[active]]
        out = np.zeros(int(count.sum()), np.int64)
        behind = np.cumsum(count) - 1
        for k, (who, piece) in enumerate(steps):
            out[behind[who] - k] = piece
        return out, count


def encode_texts(texts: list[str], keys: np.ndarray, solved: Solved, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts end to end, and the number of each text's."""
    pieces = solved.pieces
    units = [UNIT.findall(" " + t) if t else [] for t in texts]
    which = solved.numbers(units)
    per_row = np.array([len(row) for row in units], np.int64)
    if not len(which):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    row = np.repeat(np.arange(len(texts)), per_row)
    place = np.arange(len(which)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    key = mix64(mix64(keys.astype(np.int64).view(np.uint64) + salt(seed))[row] + place.astype(np.uint64) * MIX)
    ids, count = solved.draw(which, key)
    owner = np.repeat(row, count)
    bare = np.flatnonzero(ids < 0)
    if len(bare):
        raw = [chr(-1 - c).encode("utf-8", "surrogatepass") for c in ids[bare].tolist()]
        size = np.ones(len(ids), np.int64)
        size[bare] = [len(x) for x in raw]
        to = np.cumsum(size) - size
        ids, owner = np.repeat(ids, size), np.repeat(owner, size)
        for at, x in zip(to[bare].tolist(), raw, strict=True):
            ids[at:at + len(x)] = [pieces.byte[c] for c in x]
    return ids.astype(np.int32), np.bincount(owner, minlength=len(texts))


def decode_ids(ids: list[int], pieces: Pieces) -> str:
    return joined(ids, pieces.text)


def joined(ids: list[int], table: list[bytes]) -> str:
    """The text of the pieces, without the space that encoding put before it."""
    return b"".join([table[i] for i in ids])[1:].decode()


def sent(spark: SparkSession, model: str, alpha: float):
    return spark.sparkContext.broadcast(pieces_of(model, alpha))


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), key: str = "doc_id", text: str = "text",
           model: str = MODEL, alpha: float = ALPHA, seed: int = SEED, kept: int = KEPT) -> DataFrame:
    """``keep`` columns and ``pieces``, the sampled piece ids of the whole text.

    ``kept`` bounds the characters whose lattices a task keeps (about 100 bytes each);
    it trades memory for time and never changes a piece.
    """
    known = sent(docs.sparkSession, model, alpha)
    rows = docs.select(*keep, F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("_key"),
                       F.coalesce(text, F.lit("")).alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solved = Solved(known.value, kept)
        for part in slices(batches, "_text", SLICE):
            ids, count = encode_texts(part.column("_text").to_pylist(), part.column("_key").to_numpy(), solved, seed)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), lists], names=[*keep, "pieces"])

    fields = docs.select(*keep).schema.add("pieces", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(run, fields)


def decode(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id", "pieces"), name: str = "decoded",
           model: str = MODEL) -> DataFrame:
    """``keep`` columns and the text of ``pieces``."""
    known = encoded.sparkSession.sparkContext.broadcast(read_pieces(model)[0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [joined(x.values.to_numpy().tolist(), known.value) if x.is_valid and len(x) else ""
                         for x in part.column("pieces")]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(texts, pa.string())],
                                                 names=[*keep, name])

    fields = encoded.select(*keep).schema.add(name, "string")
    return encoded.select(*dict.fromkeys([*keep, "pieces"])).mapInArrow(run, fields)
