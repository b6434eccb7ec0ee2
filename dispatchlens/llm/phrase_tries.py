"""Collocations: phrases of two and three words that stand together oftener than their parts explain, per language.

A phrase's score is the least, over the places where it can be cut in two, of
a * a / (l * r), with a its occurrences and l and r those of its parts, in millionths.

Candidates grow by the Apriori rule: a phrase can only be frequent if all its parts
are.  Words are counted first.  Pairs of frequent words, then triples of frequent
pairs, add up in hash buckets (64 bits), and only what reaches the least count there
becomes a candidate.  What is frequent is known to the tasks as a bitmap over
hashes (``tables.FILTER`` bits): of fixed size, and wrong only by letting too much through.

Candidates are dealt by the hash of their first two words into blocks of about ``BLOCK``
phrases, each a double-array trie (``Trie``) that is broadcast: its size is bounded by
the block, not by the data, and ``TRIES`` of them at a time are.  Pairs with so many third
words that they would fill a block are dealt by these instead.  A pass takes the places
of a text slice whose pair belongs to a block, advances all of them through its trie at
once, level by level, and counts the accepting states they reach; the tasks' vectors of
counts are summed piece by piece.

Words are known by 64-bit hashes of language and bytes.  Scores are exact: products
are taken in decimals of 38 digits and divided without a fraction.

Defined results: null texts are empty; a null language is ``und``; repeated rows count
each time; an empty table has no phrases; ties in score and count go by phrase in
byte order; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import bitmap, has, stored
from .text import LOWER, MIX, _table, flat, hashes, mix64, slices, words

LEAST, TOP = 10, 2000
BLOCK, TRIES = 400_000, 8
#: Phrases whose counts travel together.
CHUNK = 4096
SLICE = 1 << 21
#: Rows sorted apart per language before the last ranking.
SALTS = 64

BREAKS = b".,;:!?\n\x0b\x0c\r"
INSIDE, BREAK = ~_table(b" \t" + BREAKS, False), _table(BREAKS, False)


class Places:
    """The words of a slice: hash of language and word, and whether the next word follows in the same piece."""

    def __init__(self, part: pa.RecordBatch):
        self.data, limits = flat(part.column("k_body"))
        self.starts, self.ends, at = words(self.data, limits, INSIDE)
        self.owner = np.repeat(np.arange(len(limits) - 1), np.diff(at))
        lang = part.column("k_lang").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        self.key = mix64(hashes(self.data, self.starts, self.ends) + lang[self.owner] * MIX)
        breaks = np.concatenate([[0], np.cumsum(BREAK[self.data])])
        self.next = np.zeros(len(self.key), bool)
        self.next[:-1] = (breaks[self.starts[1:]] == breaks[self.ends[:-1]]) & (self.owner[1:] == self.owner[:-1])

    def texts(self, at: np.ndarray) -> pa.Array:
        """The lower-cased words at these places."""
        size = self.ends[at] - self.starts[at]
        after = np.cumsum(size)
        place = np.arange(after[-1] if len(after) else 0) + np.repeat(self.starts[at] - (after - size), size)
        limits = np.concatenate([[0], after]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(limits), pa.py_buffer(LOWER[self.data[place]].tobytes())) \
            .cast(pa.string())


def pair_hash(key: np.ndarray) -> np.ndarray:
    return mix64(key[:-1] * MIX + key[1:])


def rows_of(docs: DataFrame, text: str, lang: str) -> DataFrame:
    named = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    rows = docs.select(named.alias("k_name"), F.xxhash64(named).alias("k_lang"), F.col(text).alias("k_body"))
    # The more text a task reads, the fewer words and phrases are counted in several tasks.
    least = docs.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(least, rows.rdd.getNumPartitions() // 2))


def sliced(rows: DataFrame, work, schema: str) -> DataFrame:
    """What ``work`` makes of the places of each slice, as a table of ``schema``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "k_body", SLICE):
            made = work(Places(part), part)
            if len(made[0]):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in made], names=names)

    names = [field.split()[0] for field in schema.split(", ")]
    return rows.mapInArrow(run, schema)


def vocabulary(rows: DataFrame) -> DataFrame:
    """lang, word, its key and its count."""
    def work(places: Places, part: pa.RecordBatch) -> list:
        key, first, count = np.unique(places.key, return_index=True, return_counts=True)
        return [part.column("k_name").take(pa.array(places.owner[first])), places.texts(first), key.view(np.int64), count]

    found = sliced(rows, work, "lang string, word string, key long, n long")
    return found.groupBy("lang", "word").agg(F.min("key").alias("key"), F.sum("n").alias("n"))


def pairs(places: Places, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a pair of frequent words begins, and the hash of the pair from each place on."""
    known = has(frequent, places.key)
    begins = places.next.copy()
    begins[:-1] &= known[:-1] & known[1:]
    return begins, np.append(pair_hash(places.key), np.uint64(0)) if len(places.key) else places.key


def candidates(rows: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """Word keys k1, k2 and, of triples, k3 of all phrases that may be frequent."""
    broadcast = rows.sparkSession.sparkContext.broadcast
    frequent = broadcast(bitmap(known.select("key")))

    def count_pairs(places: Places, part: pa.RecordBatch) -> list:
        begins, pair = pairs(places, frequent.value)
        return [x.view(np.int64) for x in np.unique(pair[begins], return_counts=True)]

    buckets = sliced(rows, count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    frequent_pairs = broadcast(bitmap(buckets.select("pair")))

    def count_phrases(places: Places, part: pa.RecordBatch) -> list:
        begins, pair = pairs(places, frequent.value)
        begins[begins] = has(frequent_pairs.value, pair[begins])
        triple = begins.copy()
        triple[:-1] &= begins[1:]
        triple[-1:] = False
        key, at2, at3 = places.key, np.flatnonzero(begins), np.flatnonzero(triple)
        _, first2, n2 = np.unique(pair[at2], return_index=True, return_counts=True)
        _, first3, n3 = np.unique(mix64(pair[at3] * MIX + key[np.minimum(at3 + 2, len(key) - 1)]) if len(at3) else pair[:0],
                                  return_index=True, return_counts=True)
        at2, at3 = at2[first2], at3[first3]
        third = pa.concat_arrays([pa.nulls(len(at2), pa.int64()), pa.array(key[at3 + 2].view(np.int64))])
        both = np.concatenate([at2, at3])
        return [key[both].view(np.int64), key[both + 1].view(np.int64), third, np.concatenate([n2, n3])]

    phrases = sliced(rows, count_phrases, "k1 long, k2 long, k3 long, n long").groupBy("k1", "k2", "k3")
    return phrases.agg(F.sum("n").alias("n")).where(F.col("n") >= least).drop("n")


class Trie:
    """A double-array trie of word sequences.

    A word is its rank in ``words``, written in ``digits`` digits of 8 bits.  The state
    t = base[s] ^ digit is a child of s if check[t] == s; final[t] is the number of
    the phrase that ends there, or -1.
    """

    def __init__(self, phrases: np.ndarray, length: np.ndarray):
        """``phrases``: n x 3 word keys; ``length``: how many of a row count."""
        used = np.arange(phrases.shape[1])[None, :] < length[:, None]
        self.words = np.unique(phrases[used])
        self.digits = max(1, (max(1, len(self.words) - 1).bit_length() + 7) // 8)
        rank = np.where(used, np.searchsorted(self.words, phrases), -1).astype(np.int32)
        order = np.lexsort(rank.T[::-1])
        rank, length = rank[order], length[order]
        # Nodes are distinct prefixes, numbered by depth and order, so that parents come in ascending order.
        parents, labels, node, count = [], [], np.zeros(len(rank), np.int32), 1
        last = np.zeros(len(rank), np.int32)
        new = np.zeros(len(rank), bool)
        new[:1] = True
        for word in range(rank.shape[1]):
            alive = length > word
            for shift in range(8 * self.digits - 8, -1, -8):
                prefix = rank[:, word] >> shift
                new[1:] |= prefix[1:] != prefix[:-1]
                first = new & alive
                parents.append(node[first])
                labels.append((prefix[first] & 255).astype(np.uint8))
                node = np.where(alive, (count - 1 + np.cumsum(first)).astype(np.int32), node)
                count += int(first.sum())
            last[length == word + 1] = node[length == word + 1]
        parent, label = np.concatenate(parents), np.concatenate(labels)
        base, size = _placed(parent, label, count)
        slot = np.zeros(count, np.int32)
        slot[1:] = base[parent] ^ label
        self.base, self.check, self.final = (np.full(size, -1, np.int32) for _ in range(3))
        self.base[slot] = base
        self.check[slot[1:]] = slot[parent]
        self.final[slot[last]] = order

    def counted(self, key: np.ndarray, following: np.ndarray, at: np.ndarray, most: int, n: int) -> np.ndarray:
        """How often each of the n phrases begins at the places ``at`` of ``key``."""
        total = np.zeros(n, np.int64)
        state = np.zeros(len(at), np.int32)
        for level in range(most):
            if level:
                on = following[at + level - 1] & (self.base[state] >= 0)
                at, state = at[on], state[on]
            rank = np.searchsorted(self.words, key[at + level])
            rank[rank == len(self.words)] = 0
            on = self.words[rank] == key[at + level]
            at, state, rank = at[on], state[on], rank[on]
            for shift in range(8 * self.digits - 8, -1, -8):
                down = self.base[state] ^ ((rank >> shift) & 255).astype(np.int32)
                on = (down >= 0) & (self.check[np.maximum(down, 0)] == state)
                at, state, rank = at[on], down[on], rank[on]
            phrase = self.final[state]
            total += np.bincount(phrase[phrase >= 0], minlength=n)
        return total


def _placed(parent: np.ndarray, label: np.ndarray, count: int) -> tuple[np.ndarray, int]:
    """A base for each node that has children, so that no two children share a slot; and the number of slots.

    Slots come in windows of 256.  Nodes of several children look for a window with
    all their slots free, the largest first; those of one child take what is left.
    ``parent`` is ascending.
    """
    first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])[:len(parent)])
    node, size = parent[first], np.diff(np.append(first, len(parent)))
    twist = (mix64(node.astype(np.uint64) * MIX) & np.uint64(255)).astype(np.uint8)
    moved = label ^ np.repeat(twist, size)
    several = np.flatnonzero(size > 1)
    masks = np.zeros((len(several), 4), np.uint64)
    for q in range(4):
        bit = np.where(moved >> 6 == q, np.uint64(1) << (moved & np.uint8(63)).astype(np.uint64), np.uint64(0))
        masks[:, q] = np.bitwise_or.reduceat(bit, first)[several] if len(first) else 0
    windows, open_windows = [1], [0]  # slot 0 is the root's
    base = np.full(count, -1, np.int32)
    for k in np.argsort(-size[several], kind="stable").tolist():
        mask = int.from_bytes(masks[k].tobytes(), "little")
        for w in open_windows:
            if not windows[w] & mask:
                break
        else:
            w = len(windows)
            windows.append(0)
            open_windows = [*open_windows[-15:], w]
        windows[w] |= mask
        base[node[several[k]]] = (w << 8) ^ int(twist[several[k]])
    taken = np.frombuffer(b"".join(w.to_bytes(32, "little") for w in windows), np.uint8)
    free = np.flatnonzero(np.unpackbits(taken, bitorder="little") == 0)
    single = np.flatnonzero(size == 1)
    more = max(0, len(single) - len(free))
    slots = 256 * (len(windows) + -(-more // 256))
    free = np.concatenate([free, np.arange(256 * len(windows), slots)])[:len(single)]
    base[node[single]] = free ^ label[first[single]]
    return base, slots


def pair_code(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """A number that deals pairs into blocks, as ``dealt`` has it in Spark."""
    return (k1 ^ (k2 >> np.uint64(7))).view(np.int64)


def dealt(wanted: DataFrame) -> tuple[DataFrame, int, np.ndarray]:
    """``wanted`` with a block number, how many blocks there are, and the codes of pairs that are in all of them."""
    blocks = -(-wanted.count() // BLOCK)
    coded = wanted.withColumn("code", F.col("k1").bitwiseXOR(F.shiftrightunsigned("k2", 7)))
    wide = coded.where("k3 is not null").groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK // 4)
    wide = np.sort(wide.toArrow()["code"].to_numpy())  # at most four a block
    own = F.pmod("code", F.lit(max(1, blocks)))
    if len(wide):
        own = F.when(F.col("code").isin([int(x) for x in wide]), F.pmod(F.coalesce("k3", "code"), F.lit(blocks))).otherwise(own)
    return coded.withColumn("block", own), blocks, wide


def counted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (a stored table of candidates) with their occurrences, counted by one trie a block."""
    send = rows.sparkSession.sparkContext.broadcast
    wanted, blocks, wide = dealt(wanted)
    out = None
    for start in range(0, blocks, TRIES):
        tries, names = {}, {}
        for block in range(start, min(blocks, start + TRIES)):
            here = wanted.where(F.col("block") == block).select("k1", "k2", "k3").toArrow()
            three = here["k3"].combine_chunks()
            keys = np.stack([here[c].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                             for c in ("k1", "k2", "k3")], axis=1)
            single = three.is_null().to_numpy(zero_copy_only=False)
            names[block], tries[block] = send((keys, single)), (len(keys), send(Trie(keys, np.where(single, 2, 3))))

        def run(batches: Iterable[pa.RecordBatch], tries=tries) -> Iterator[pa.RecordBatch]:
            totals = {block: np.zeros(size, np.int64) for block, (size, _) in tries.items()}
            for part in slices(batches, "k_body", SLICE):
                places = Places(part)
                begins = np.flatnonzero(places.next)
                code = pair_code(places.key[begins], places.key[begins + 1])
                everywhere = np.isin(code, wide) if len(wide) else False
                for block, (size, trie) in tries.items():
                    own = begins[(code % blocks == block) | everywhere]
                    totals[block] += trie.value.counted(places.key, places.next, own, 3, size)
            for block, total in totals.items():
                for at in range(0, len(total), CHUNK):
                    some = total[at:at + CHUNK]
                    if some.any():
                        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([at]), pa.array([some.tolist()], pa.list_(pa.int64()))],
                                                         names=["block", "first", "counts"])

        def add(batches: Iterable[pa.RecordBatch], names=names) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                counts = batch.column("counts")
                for k, piece in enumerate(zip(batch.column("block").to_pylist(), batch.column("first").to_pylist())):
                    new = counts[k].values.to_numpy()
                    sums[piece] = sums[piece] + new if piece in sums else new
            for (block, first), total in sums.items():
                keys, single = names[block].value
                some = first + np.flatnonzero(total)
                k1, k2, k3 = (pa.array(keys[some, c].view(np.int64), mask=single[some] if c == 2 else None) for c in range(3))
                yield pa.RecordBatch.from_arrays([k1, k2, k3, pa.array(total[some - first])], names=["k1", "k2", "k3", "a"])

        pieces = rows.mapInArrow(run, "block long, first long, counts array<long>").repartition("block", "first")
        counts = stored(pieces.mapInArrow(add, "k1 long, k2 long, k3 long, a long"))
        out = counts if out is None else out.unionByName(counts)
    return out if out is not None else wanted.select("k1", "k2", "k3", F.lit(0).cast("long").alias("a"))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) without rounding."""
    wide = lambda x: x.cast("decimal(19,0)")
    over = (wide(a) * wide(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", over.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n and score.

    l and r are the occurrences of the two parts at the cut of the least score, n the
    words of the language.  A phrase inside a longer candidate that has at least half
    its occurrences is left out.
    """
    rows = rows_of(docs, text, lang)
    every = stored(vocabulary(rows))
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    known = stored(every.where(F.col("n") >= least).withColumnRenamed("n", "f"))
    found = counted(rows, stored(candidates(rows, known, least))).where(F.col("a") >= least)
    word = lambda k: known.select(F.col("key").alias(k), F.col("lang").alias(f"lang_{k}"), F.col("word").alias(f"word_{k}"),
                                  F.col("f").alias(f"f_{k}"))
    two = found.where("k3 is null").drop("k3").join(word("k1"), "k1").join(word("k2"), "k2")
    two = stored(two.select("k1", "k2", "a", F.col("lang_k1").alias("lang"), "word_k1", "word_k2", "f_k1", "f_k2"))
    head = two.select("k1", "k2", "lang", F.concat_ws(" ", "word_k1", "word_k2").alias("words"), F.col("f_k1").alias("f1"),
                      F.col("a").alias("f12"))
    tail = two.select(F.col("k1").alias("k2"), F.col("k2").alias("k3"), F.col("word_k2").alias("word_k3"), F.col("f_k2").alias("f3"),
                      F.col("a").alias("f23"))
    three = stored(found.where("k3 is not null").join(head, ["k1", "k2"]).join(tail, ["k2", "k3"]))
    inner = three.select("k1", "k2", F.col("a").alias("outer")) \
        .unionByName(three.select(F.col("k2").alias("k1"), F.col("k3").alias("k2"), F.col("a").alias("outer")))
    inner = inner.groupBy("k1", "k2").agg(F.max("outer").alias("outer"))
    two = two.join(inner, ["k1", "k2"], "left").where(F.col("outer").isNull() | (100 * F.col("outer") < 50 * F.col("a"))) \
        .select("lang", F.concat_ws(" ", "word_k1", "word_k2").alias("phrase"), "a", F.col("f_k1").alias("l"), F.col("f_k2").alias("r"),
                score(F.col("a"), F.col("f_k1"), F.col("f_k2")).alias("score"))
    early, late = score(F.col("a"), F.col("f1"), F.col("f23")), score(F.col("a"), F.col("f12"), F.col("f3"))
    three = three.select("lang", F.concat_ws(" ", "words", "word_k3").alias("phrase"), "a", "f1", "f23", "f12", "f3",
                         early.alias("early"), late.alias("late"))
    first = F.col("early") <= F.col("late")
    three = three.select("lang", "phrase", "a", F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                         F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("early", "late").alias("score"))
    return ranked(two.unionByName(three), top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def ranked(phrases: DataFrame, top: int) -> DataFrame:
    """The best ``top`` of each language; first of each of ``SALTS`` parts of it, so that no task sorts a whole language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = phrases.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = part.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")) \
        .where(F.col("rank") <= top).drop("salt", "place")


#: The same over whole tables in DuckDB; products are 128-bit integers.
SQL = """
WITH pieces AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
lists AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
w AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS "at" FROM lists),
follow AS (SELECT *, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY piece ORDER BY "at")),
grams AS (
  SELECT lang, 1 AS k, w1 AS g FROM follow
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM follow WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM follow WHERE w3 IS NOT NULL),
f AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, g AS phrase, f AS a, string_split(g, ' ') AS p FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, 1 AS cut, x.f AS l, y.f AS r FROM cand c
    JOIN f x ON x.lang = c.lang AND x.k = 1 AND x.g = c.p[1]
    JOIN f y ON y.lang = c.lang AND y.k = c.k - 1 AND y.g = array_to_string(c.p[2:], ' ')
  UNION ALL
  SELECT c.lang, c.k, c.phrase, c.a, 2, x.f, y.f FROM cand c
    JOIN f x ON x.lang = c.lang AND x.k = 2 AND x.g = array_to_string(c.p[:2], ' ')
    JOIN f y ON y.lang = c.lang AND y.k = 1 AND y.g = c.p[3] WHERE c.k = 3),
scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, g, max(a) AS longest FROM (
  SELECT lang, array_to_string(p[:2], ' ') AS g, a FROM cand WHERE k = 3
  UNION ALL SELECT lang, array_to_string(p[2:], ' '), a FROM cand WHERE k = 3) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best b JOIN total t ON t.lang = b.lang LEFT JOIN inside i ON i.lang = b.lang AND i.g = b.phrase
WHERE longest IS NULL OR 100 * longest < 50 * a
QUALIFY rank <= 2000"""
