"""N-gram Jaccard join by parity sketches.

A document is its set of distinct word n-grams, hashed to 64 bits. Sets of sizes a and b with a Jaccard similarity of
num/den or more differ in at most (a + b)(den - num)/(den + num) elements. Sizes fall into bands such that partners are
in one band or in neighbouring ones. A band's sketch deals the elements over m blocks by hash and keeps the XOR of each
block: one difference changes one block, so the number of unequal blocks never exceeds the difference. A set whose
partners in the band differ from it in k elements at most keeps its first k + c blocks (c is the band's), so partners
share at least c of them (pigeonhole). Blocks are the join keys. An empty block says nothing: a set emits its empty blocks
only if it has c of them or more.

Texts are read once for digests and keys, and a task gives the keys of each set once. Keys are shuffled as they are made
and stored nowhere else; digests take the same way. Sets with the same digest are one node from the start. A key's nodes, sorted, pass by in one stream: each is a candidate partner of the first and of the one
before. Sizes, a 32-bit parity sketch and the number of keys in which a pair met drop candidates without loss. The others
make families, their components. Up to CELL nodes of a family meet in one task that multiplies their incidence matrix, so
links are told exactly, each text moves once, and what comes out is a spanning forest of the links; candidate pairs of
larger families that were dealt to different tasks and aren't joined by then meet after that, by stars. A key with more
than three nodes has pairs that were not candidates; where its nodes are not in one component by then, and only for nodes
that share enough such keys, the nodes of such keys with one first node are solved as well (`rest`): by blocks of nodes,
of which each two meet in a task unless both are of one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from folioscan.llm.common import materialise, table
from folioscan.llm.components import components

WORDS, NUM, DEN = 5, 80, 100
#: Slots of the filter that thins documents out before their texts are fetched, which bound what is broadcast, and how many of a slot's 64 bits an id sets.
SLOTS, SLOT_BITS, MEMO, GIVEN = 1 << 20, 4, 100_000, 50_000
#: A number of a key's row: the set's size, its parity sketch, how many keys partners share at least (no more than MOST_NEED), and whether the band is the next.
N_AT, PARITY_AT, NEED_AT, MOST_NEED = 39, 7, 1, 63
#: Bits of a key. Two blocks that share a key by chance cost a candidate; fewer bits take less of the shuffle.
KEY_BITS = 48
#: Nodes in a block, two of which meet in a task, and columns of the matrices that are multiplied at once.
CELL, COLUMNS = 256, 8192

_U = np.uint64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=_U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingles(dict):
    """Sets of n-grams; remembers hashes of words, MEMO of them."""

    def __init__(self, words: int):
        super().__init__()
        self.words = words

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            self[word] = value
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Sorted hashes of the distinct n-grams; of all the words as one where there are fewer."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and white space of ASCII
        if not words:
            return np.empty(0, dtype=_U)
        h = np.fromiter(map(self.__getitem__, words), dtype=_U, count=len(words))
        if len(self) > MEMO:
            self.clear()
        n = min(self.words, len(h))
        s = np.full(len(h) - n + 1, n, dtype=_U)
        for i in range(n):
            factor = _FACTORS[i % len(_FACTORS)] + _U(2 * (i // len(_FACTORS)))
            s = _mix(s + h[i : len(h) - n + 1 + i] * factor)
        return np.unique(s)


def digest(s: np.ndarray) -> tuple[int, int]:
    """(node, check): two 64-bit digests of a set."""
    total = int(np.sum(_mix(s * _FACTORS[3] + _FACTORS[5]), dtype=_U))
    folded = int(np.bitwise_xor.reduce(_mix(s + _FACTORS[1]))) if len(s) else 0
    node = _mix(np.array([folded ^ total * 3 & 0xFFFFFFFFFFFFFFFF], dtype=_U) + _U(len(s)))
    return int(node.view(np.int64)[0]), int(np.array([total], dtype=_U).view(np.int64)[0])


def _band_end(start: int, num: int, den: int) -> int:
    """Wider bands spare keys, as fewer sets have partners in a second one, but a band's smallest sets have fewer elements in a
    block then: 3.8 at least, if a band that is as wide as partners are apart has so many."""
    return max(start * den // num, start * 5 * (den + num) // (38 * (den - num)))


@lru_cache(maxsize=8)
def _bands(num: int, den: int) -> list[tuple[int, int]]:
    return [(1, _band_end(1, num, den))]


def band_of(n: int, num: int, den: int) -> int:
    """Bands are [s, floor(s w)], from 1 on without gaps; a partner is in a set's band or in one next to it."""
    bands = _bands(num, den)
    while bands[-1][1] < n:
        start = bands[-1][1] + 1
        bands.append((start, _band_end(start, num, den)))
    low, high = 0, len(bands) - 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if bands[mid][1] >= n else (mid + 1, high)
    return low


def blocks_of(band: int, num: int, den: int) -> tuple[int, int]:
    """(c, m) of a band: the blocks that partners share at least, and all blocks."""
    bands = _bands(num, den)
    while len(bands) <= band:
        band_of(bands[-1][1] + 1, num, den)
    k = 2 * bands[band][1] * (den - num) // (den + num)
    c = 1 + (2 + k // 16 if k else 0)
    return c, k + c


def signatures(s: np.ndarray, num: int, den: int) -> list[tuple[np.ndarray, int]]:
    """(keys, need) for the set's own band and, if it may have partners there, the next: need is how many of its keys a partner there shares at least."""
    n = len(s)
    own, most, out = band_of(n, num, den), n * den // num, []
    for band in (own, own + 1) if most > _bands(num, den)[own][1] else (own,):
        c, m = blocks_of(band, num, den)
        kept = (n + min(_bands(num, den)[band][1], most)) * (den - num) // (den + num) + c
        block = (_mix(s ^ _FACTORS[6]) % _U(m)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        full, at = np.unique(block[order], return_index=True)
        value = np.bitwise_xor.reduceat(s[order], at)
        full, value = full[full < kept], value[full < kept]
        need = c - (kept - len(full))
        if need < 1:
            gone = np.setdiff1d(np.arange(kept), full)
            full, value, need = np.append(full, gone), np.append(value, np.zeros(len(gone), dtype=_U)), 1
        keys = _mix(_mix(value + _FACTORS[2]) ^ (full.astype(_U) * _FACTORS[4] + _U(band * int(_FACTORS[7]) & 0xFFFFFFFFFFFFFFFF)))
        out.append(((keys >> _U(64 - KEY_BITS)).view(np.int64), need))
    return out


def parity(s: np.ndarray) -> int:
    """32 parities: of the elements by their last five bits. Two sketches differ in no more bits than their sets in elements."""
    return int(np.bitwise_xor.reduce(_U(1) << (s & _U(31)))) if len(s) else 0


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def sketches(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(_id, n, node, check, info, keys) of rows (_id, _text): for each a row of digests, whose info is null and whose one key
    deals it to any task, and rows of the keys of the own band and the next, whose _id is null.

    A task gives keys once for each set, as far as it remembers sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, given, read = Shingles(words), set(), 0
        for b in _batches(batches):
            rows, keys = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                s = shingles.of(t)
                name = digest(s)
                rows.append((i, len(s), *name, None))
                keys.append(_mix(np.array([read], dtype=_U)).view(np.int64))
                read += 1
                if len(s) and name not in given:
                    given.add(name)
                    for after, (k, need) in enumerate(signatures(s, num, den)):
                        rows.append((None, len(s), *name, len(s) << N_AT | parity(s) << PARITY_AT | min(need, MOST_NEED) << NEED_AT | after))
                        keys.append(k)
            if len(given) > GIVEN:
                given.clear()
            at, n, node, check, info = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), n, node, check, info, lists], names=["_id", "n", "node", "check", "info", "keys"])

    return docs.mapInArrow(run, f"_id {dict(docs.dtypes)['_id']}, n long, node long, check long, info long, keys array<long>")


def _apart(known: DataFrame) -> DataFrame:
    """known, where sets that share a node's digest but not the other one get nodes of their own."""
    clashes = known.where("n > 0").groupBy(F.col("node").alias("_node")).agg(F.min("check").alias("_first"), F.max("check").alias("_last")).where("_first <> _last").select("_node", "_first")
    clashes = materialise(clashes, "join-clashes")
    if not clashes.take(1):
        return known
    own = F.when(F.col("check") > F.col("_first"), F.col("node").bitwiseXOR(F.col("check"))).otherwise(F.col("node"))
    return known.join(clashes, (F.col("node") == F.col("_node")) & (F.col("n") > 0), "left").withColumn("node", own).drop("_node", "_first")


def key_rows(sketched: DataFrame) -> DataFrame:
    """(key, node, info, _id, n) for each key of each set, n being null, and for each row of digests, info being its check."""
    return sketched.select(F.explode("keys").alias("key"), "node", F.coalesce("info", "check").alias("info"), "_id", F.when(F.col("info").isNull(), F.col("n")).alias("n"))


def _plausible(na: np.ndarray, nb: np.ndarray, pa_: np.ndarray, pb: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sizes and parities allow the similarity."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    return (small * den >= large * num) & (np.bitwise_count(pa_ ^ pb).astype(np.int64) * (den + num) <= (na + nb) * (den - num))


def candidates(sketched: DataFrame, num: int, den: int) -> DataFrame:
    """(kind, a, b, info, n, _id) of key_rows: kind 0 for candidate pairs a < b that met in n keys of a task's batch, info being the keys that
    partners share at least and, in its last two bits, whether the band is a's next and b's next; kind 1 for a node b of a
    key a that has more than three nodes, with its info; kind 2 for a row of digests, a being its node and b its check."""
    names = ["kind", "a", "b", "info", "n", "_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ("key", "node", "info")
        carry = {x: np.empty(0, dtype=np.int64) for x in parts}  # the first of the last key's nodes, and its last two
        length = 0  # of that key so far
        for batch in batches:
            whole = batch.column(4).is_valid()
            if whole.true_count:
                of = batch.filter(whole)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(of.num_rows, 2, dtype=np.int32)), of.column(1), of.column(2), pa.nulls(of.num_rows, pa.int64()), of.column(4), of.column(3)], names=names)
            if whole.true_count == batch.num_rows:
                continue
            batch = batch.filter(pc.invert(whole))
            new = {x: batch.column(i).to_numpy(zero_copy_only=False) for i, x in enumerate(parts)}
            held = len(carry["key"])
            c = {x: np.concatenate([carry[x], new[x]]) for x in parts}
            again = np.zeros(len(c["key"]), dtype=bool)
            again[1:] = (c["key"][1:] == c["key"][:-1]) & (c["node"][1:] == c["node"][:-1])
            again[:held] = False
            c = {x: v[~again] for x, v in c.items()}
            key, node, total = c["key"], c["node"], len(c["key"])
            begins = np.ones(total, dtype=bool)
            begins[1:] = key[1:] != key[:-1]
            first = np.maximum.accumulate(np.where(begins, np.arange(total), 0))
            place = np.arange(total) - first
            if held:
                place[first == 0] += length - held  # those that were not carried
            fresh = np.arange(total) >= held
            here = np.flatnonzero(fresh & (place > 0))
            pairs = np.concatenate([np.stack([first[here], here]), np.stack([here - 1, here])[:, place[here] > 1]], axis=1)
            n, p = c["info"] >> N_AT, c["info"] >> PARITY_AT & 0xFFFFFFFF
            pairs = pairs[:, _plausible(n[pairs[0]], n[pairs[1]], p[pairs[0]], p[pairs[1]], num, den)]
            a, b = np.where(node[pairs[0]] < node[pairs[1]], pairs, pairs[::-1])
            need, after = c["info"] >> NEED_AT & MOST_NEED, c["info"] & 1
            ab, met = np.unique(np.stack([node[a], node[b], np.maximum(need[a], need[b]) << 2 | after[a] << 1 | after[b]]), axis=1, return_counts=True)
            # a fourth node makes a key large: it and the three before, which are all here, are told of
            late = np.flatnonzero(fresh & (place >= 3))
            fourth = late[place[late] == 3]
            told = np.concatenate([late, fourth - 1, fourth - 2, first[fourth]])
            if ab.shape[1] + len(told):
                kind = np.repeat(np.array([0, 1], dtype=np.int32), [ab.shape[1], len(told)])
                columns = (kind, np.append(ab[0], key[told]), np.append(ab[1], node[told]), np.append(ab[2], c["info"][told]), np.append(met, np.ones(len(told), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(kind), batch.column(3).type)], names=names)
            start = first[-1]
            keep = np.unique([start, *range(max(start, total - 2), total)])
            length = int(place[-1]) + 1
            carry = {x: v[keep] for x, v in c.items()}

    # a set's keys that go to one task are stored together and share their other columns: fewer tasks shuffle less
    tasks = max(1, int(sketched.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    return sketched.repartition(tasks, "key").sortWithinPartitions("key", "node").mapInArrow(run, f"kind int, a long, b long, info long, n long, _id {dict(sketched.dtypes)['_id']}")


def digests(found: DataFrame) -> DataFrame:
    """(_id, n, node, check) of every row, from what candidates gives."""
    return found.where("kind = 2").select("_id", "n", F.col("a").alias("node"), F.col("b").alias("check"))


def met_enough(found: DataFrame) -> DataFrame:
    """Pairs (a, b) of candidates that may share as many keys as partners do. Keys of three nodes or fewer count every pair;
    of larger ones a pair shares at most as many as either node has."""
    pairs = found.where("kind = 0").groupBy("a", "b", (F.col("info") % 4).alias("_f")).agg(F.sum("n").alias("_met"), F.max(F.shiftright("info", 2)).alias("_need"))
    large = found.where("kind = 1").groupBy(F.col("b").alias("_node"), (F.col("info") % 2).alias("_next")).agg(F.count(F.lit(1)).alias("_large"))
    sure, open_ = pairs.where("_met >= _need"), pairs.where("_met < _need")
    for end, flag in (("a", F.floor(F.col("_f") / 2)), ("b", F.col("_f") % 2)):
        side = large.select(F.col("_node").alias(f"_{end}"), F.col("_next").alias(f"_x{end}"), F.col("_large").alias(f"_l{end}"))
        open_ = open_.join(side, (F.col(end) == F.col(f"_{end}")) & (flag == F.col(f"_x{end}")))
    open_ = open_.where(F.col("_met") + F.least("_la", "_lb") >= F.col("_need"))
    return sure.select("a", "b").union(open_.select("a", "b")).distinct()


def _in_slots(docs: DataFrame, id_col: str, ids: DataFrame, how: str) -> DataFrame:
    """Rows of docs whose ids the filter of ids lets pass (left_semi), or doesn't (left_anti), without a shuffle.

    All of ids pass. An id has a slot and sets SLOT_BITS of its bits, so that few others pass when every slot is in use: one
    in a thousand with two ids to a slot, where the slot alone would let six of seven pass."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    bit = lambda c, i: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c, F.lit(i)), F.lit(64)).cast("int"))

    def bits(c: Column) -> Column:
        return reduce(Column.bitwiseOR, (bit(c, i) for i in range(SLOT_BITS)))

    own = ids[ids.columns[0]]
    slots = ids.select(slot(own).alias("slot"), bits(own).alias("bits")).groupBy("slot").agg(F.bit_or("bits").alias("bits"))  # at most SLOTS rows
    return docs.join(F.broadcast(slots), (slot(docs[id_col]) == slots["slot"]) & (slots["bits"].bitwiseAND(bits(docs[id_col])) == bits(docs[id_col])), how)


class _Sets:
    """Sets of nodes, by text; none for a text that isn't the node's, that of another row with the same id."""

    def __init__(self, words: int):
        self.shingles, self.last = Shingles(words), {}

    def of(self, node: int, text: str | None) -> np.ndarray | None:
        if node not in self.last or self.last[node][0] != text:
            s = self.shingles.of(text)
            name, check = digest(s)
            if node not in (name, name ^ check):
                return None
            if len(self.last) > 64:
                self.last.clear()
            self.last[node] = text, s
        return self.last[node][1]


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())], names=["u", "v"])


def linked(sets: list[np.ndarray], groups: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Positions of sets that link and, together with groups that are joined already, leave no link out: a spanning forest."""
    n, size = len(sets), np.array([len(s) for s in sets])
    row, item = np.repeat(np.arange(n), size), np.concatenate(sets)
    _, column, times = np.unique(item, return_inverse=True, return_counts=True)
    again = times[column] > 1
    row, column = row[again], (np.cumsum(times > 1) - 1)[column[again]]
    order = np.argsort(column, kind="stable")
    row, column, both = row[order], column[order], np.zeros((n, n), dtype=np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, (start, start + COLUMNS))
        part = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - start)), dtype=np.float32)
        part[row[low:high], column[low:high] - start] = 1
        both += part @ part.T
    common = both.astype(np.int64)
    near = np.argwhere(np.triu(den * common >= num * (size[:, None] + size[None, :] - common), 1))
    up = {g: g for g in groups}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for i, j in near.tolist():
        a, b = find(groups[i]), find(groups[j])
        if a != b:
            up[a] = b
            out.append((i, j))
    return out


def rest(large: DataFrame, roots: DataFrame) -> DataFrame:
    """(pivot, node, root): nodes of keys with more than three nodes, as far as links between them may have been passed over.

    `large` has (key, node, info). A key whose nodes are in one component needs nothing. Partners share at least `need`
    keys in a band, and any key of theirs with three nodes or fewer has made them candidates: so both have at least
    `need` keys that are left. Each node then drops its need - 1 most frequent ones: of the keys that partners share, the
    least frequent comes after need - 1 others with either, so they still share that. Keys go together by their pivot,
    the node of a key that is left with the most keys: keys that many nodes share mostly have the same one, so that these
    nodes meet there once and not once for each key."""
    rows = large.select("key", "node", (F.col("info") % 2).alias("next"), (F.shiftright("info", NEED_AT) % (MOST_NEED + 1)).alias("need"))
    rows = materialise(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "join-large")
    open_ = lambda df: df.groupBy(F.col("key").alias("_k")).agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count(F.lit(1)).alias("_often")).where("_lo <> _hi")
    rows = rows.join(open_(rows).select("_k"), F.col("key") == F.col("_k"), "left_semi")
    enough = rows.groupBy(F.col("node").alias("_n"), F.col("next").alias("_x")).agg(F.count(F.lit(1)).alias("_c"), F.max("need").alias("_m")).where("_c >= _m")
    rows = materialise(rows.join(enough, (F.col("node") == F.col("_n")) & (F.col("next") == F.col("_x")), "left_semi"), "join-open")
    most = Window.partitionBy("node", "next").orderBy(F.col("_often").desc(), "key")
    rows = rows.join(open_(rows).select("_k", "_often"), F.col("key") == F.col("_k")).withColumn("_place", F.row_number().over(most)).where(F.col("_place") >= F.col("need"))
    rows = materialise(rows.select("key", "node", "root", F.count(F.lit(1)).over(Window.partitionBy("node")).alias("_keys")), "join-rare")
    pivots = rows.groupBy(F.col("key").alias("_k")).agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.max(F.struct("_keys", "node"))["node"].alias("pivot")).where("_lo <> _hi").select("_k", "pivot")
    return rows.join(pivots, F.col("key") == F.col("_k")).select("pivot", "node", "root").distinct()


def blocks(members: DataFrame) -> DataFrame:
    """(p, i, j, node, root): the members (pivot, node, root) of each pivot in cells (p, i, j) in which any two of different roots meet.

    A root of CELL members or more has blocks of its own, the others share blocks. Each two blocks make a cell, unless
    both are of one such root: what is joined already doesn't meet again."""
    roots = members.groupBy(F.col("pivot").alias("_p"), F.col("root").alias("_r")).agg(F.count(F.lit(1)).alias("_members")).withColumn("_tag", F.when(F.col("_members") >= CELL, F.col("_r")))
    parts = roots.groupBy(F.col("_p").alias("_tp"), F.col("_tag").alias("_t")).agg(F.ceil(F.sum("_members") / CELL).alias("_blocks"), F.count(F.lit(1)).alias("_roots"))
    parts = materialise(parts, "join-parts")
    own = members.join(roots, (F.col("pivot") == F.col("_p")) & (F.col("root") == F.col("_r"))).join(parts.select("_tp", F.col("_t").alias("_ot"), F.col("_blocks").alias("_own")), (F.col("_tp") == F.col("_p")) & F.col("_ot").eqNullSafe(F.col("_tag")))
    own = own.select("pivot", "node", "root", "_tag", F.xxhash64("_tag", F.pmod(F.xxhash64("node"), F.col("_own"))).alias("_block"))
    meets = (F.col("pivot") == F.col("_tp")) & (~F.col("_tag").eqNullSafe(F.col("_t")) | (F.col("_t").isNull() & (F.col("_roots") > 1)))
    cells = own.join(parts, meets).withColumn("_sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).withColumn("_other", F.xxhash64("_t", "_sub"))
    return cells.select(F.col("pivot").alias("p"), F.least("_block", "_other").alias("i"), F.greatest("_block", "_other").alias("j"), "node", "root")


def solved(cells: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (u, v) among the nodes (node, root) of each cell (p, i, j). Texts are fetched by id and then meet by cell."""
    cells = materialise(cells.join(nodes.select("node", F.col("least").alias("_doc")), "node"), "join-cells")
    texts = _in_slots(docs, "_id", cells.select("_doc"), "left_semi")
    cells = texts.join(cells, F.col("_id").eqNullSafe(F.col("_doc"))).select("p", "i", "j", "node", "root", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, cell, held = _Sets(words), None, {}

        def solve() -> pa.RecordBatch:
            names = list(held)
            return _links([(names[i], names[j]) for i, j in linked([held[x][0] for x in names], [held[x][1] for x in names], num, den)] if len(names) > 1 else [])

        for b in _batches(batches, 256):
            c = b.to_pydict()
            for *at, node, root, text in zip(c["p"], c["i"], c["j"], c["node"], c["root"], c["_text"], strict=True):
                if cell != at:
                    yield solve()
                    cell, held = at, {}
                s = read.of(node, text)
                if s is not None:
                    held[node] = s, root
        yield solve()

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "p", "i", "j").sortWithinPartitions("p", "i", "j", "node").mapInArrow(run, "u long, v long")


def families(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, pairs): families of candidate pairs (a, b) in cells of about CELL nodes, and those pairs that meet in none of them."""
    named = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    sizes = named.groupBy(F.col("root").alias("_r")).agg(F.ceil(F.count(F.lit(1)) / CELL).alias("_blocks"))
    placed = materialise(named.join(sizes, F.col("root") == F.col("_r")).select("node", "root", F.pmod(F.xxhash64("node"), F.col("_blocks")).alias("i"), (F.col("_blocks") > 1).alias("large")), "join-families")
    end = lambda x: placed.where("large").select(F.col("node").alias(f"_{x}"), F.col("i").alias(f"_i{x}"))
    apart = pairs.join(end("a"), F.col("a") == F.col("_a")).join(end("b"), F.col("b") == F.col("_b")).where("_ia <> _ib").select("a", "b")
    return placed.select(F.col("root").alias("p"), "i", F.lit(0).cast("long").alias("j"), "node", F.col("node").alias("root")), materialise(apart, "join-apart")


def stars(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Cells of pairs (a, b) that aren't joined yet: a with up to about CELL of its partners."""
    for x in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(f"_{x}"), F.col("root").alias(f"_r{x}")), F.col(x) == F.col(f"_{x}"), "left").withColumn(f"_r{x}", F.coalesce(f"_r{x}", x))
    pairs = materialise(pairs.where("_ra <> _rb").select("a", "b", "_ra", "_rb"), "join-stars")
    many = pairs.groupBy(F.col("a").alias("_c")).agg(F.ceil(F.count(F.lit(1)) / CELL).alias("_cells"))
    cells = pairs.join(many, F.col("a") == F.col("_c")).select(F.col("a").alias("p"), F.pmod(F.xxhash64("b"), F.col("_cells")).alias("i"), F.lit(0).cast("long").alias("j"), F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("_ra").alias("root")), F.struct(F.col("b").alias("node"), F.col("_rb").alias("root")))).alias("x"))
    return cells.select("p", "i", "j", "x.node", "x.root").distinct()


def join_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Two rows link when den * intersection >= num * union of their sets; words are runs of non-white ASCII, A-Z lowered.
    Null and empty texts, and texts without words, have no shingles and no links; a text of fewer words than a shingle
    has one. Rows that share an id are rows of their own, and ids reach through each other's links no further. Null ids
    join as others do and are never the smallest. Other columns are ignored; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sketched = sketches(rows, words, num, den)
    found = materialise(candidates(key_rows(sketched), num, den), "join-candidates", compression="zstd")
    if _apart(known := digests(found)) is not known:
        found = materialise(candidates(key_rows(_apart(sketched)), num, den), "join-candidates", compression="zstd")
        known = digests(found)
    nodes = materialise(known.where("n > 0").groupBy("node").agg(F.min("_id").alias("least")), "join-nodes")
    pairs = materialise(met_enough(found), "join-pairs")
    cells, apart = families(pairs)
    links = materialise(solved(cells, nodes, rows, words, num, den), "join-links")
    roots = components(links)

    def more(cells: DataFrame, links: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = materialise(solved(cells, nodes, rows, words, num, den), "join-more-links")
        if not new.take(1):
            return links, roots
        links = links.union(new)
        return links, components(links)

    if apart.take(1):
        links, roots = more(stars(apart, roots), links, roots)
    left = materialise(rest(found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node"), "info"), roots), "join-rest")
    links, roots = more(blocks(left), links, roots)
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("_component"))
    named = materialise(named.select("node", "root").join(least, "root").select(F.col("node").alias("_node"), "_component"), "join-named")
    out = known.select("_id", "n", "node").join(named, (F.col("node") == F.col("_node")) & (F.col("n") > 0), "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("_component")).otherwise(F.col("_id")).alias("component_id"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the smallest id, and every row without words.

    An id of which one row stays keeps its rows. Columns may have any names. An empty table gives no rows."""
    own = F.col("component_id").eqNullSafe(F.col("id"))
    near = join_near(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", **how)
    gone = materialise(near.groupBy("id").agg(F.bool_or(own).alias("stays")).where("NOT stays").select("id"), "join-gone")
    # most documents share no slot with one that goes, and aren't shuffled
    kept, thin = _in_slots(docs, id_col, gone, "left_anti"), _in_slots(docs, id_col, gone, "left_semi")
    return kept.unionByName(thin.join(gone, thin[id_col].eqNullSafe(gone["id"]), "left_anti"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: four words, a similarity of 0.85."""
    return join_near(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w
), n AS (
  SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s
), e AS (
  SELECT doc_id, unnest(sh) AS g FROM s
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 85 * (x.n_shingles + y.n_shingles - i)
), both_ways AS (
  SELECT u, v FROM l UNION ALL SELECT v, u FROM l
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u
)
SELECT n.doc_id, n.n_shingles, min(r.v) AS component_id FROM n JOIN reach r ON r.u = n.doc_id GROUP BY ALL
"""
