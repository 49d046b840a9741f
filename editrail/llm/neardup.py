"""Near-duplicate records: all pairs whose sets of word sequences have at least a given Jaccard similarity.

Size-aware heavy-light join, exact at any size of the collection. Tokens (hashed word sequences) are
put in one order, rare ones first, by a fixed-size count of all of them. Two sets that are similar
enough share a token within a prefix of each (n - t + 1 of n tokens, t the least possible overlap), and
k of them within a prefix longer by k - 1. Large sets scan the inverted lists of their prefix tokens;
small sets, for which that would cost more, enumerate fixed-size subsets (pairs) of their prefix
instead. The size that divides them is the one of least total cost, counted over all sets.

Lists are scanned in vectorised blocks. A set goes to a task once, with a 192-bit parity map of its
tokens; the maps of two sets bound their overlap from above, which drops nearly all pairs that share a
token by chance before anything is sent on. What is left is verified on the sets themselves.

Texts travel as 32-bit hashes of their words in order. Equal texts travel once: copies are expanded at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editrail.runtime import cut, read_table, spread

#: Counters of the token count; tokens that share one are counted together, which affects cost alone.
COUNTERS = 1 << 18
_SLICES = 8
#: Bits of a set's parity map; more let fewer chance pairs through.
MAP_BITS = 192
#: What one entry of a list that a set scans costs, in entries sent: about 10 ns (half of the list comes
#: before the set, and half of that is ruled out by size and prefix unscanned) against 2 microseconds.
SCAN_COST = 1 / 200
#: Entries of lists that a task scans at a time, and pairs that it verifies at a time.
CHUNK_SCANS, CHUNK_PAIRS = 1_000_000, 8_000
#: List entries that a task of the join gets, about. A set goes to each task that it has an entry in: fewer tasks, fewer copies.
TASK_ENTRIES = 2_000_000
#: Entries of a list that one task scans against one another. A longer list is cut into blocks, and each pair of blocks is a task's.
LIST_BLOCK = 20_000
#: Words whose hashes a worker keeps; beyond it the memory starts anew.
MEMORY_WORDS = 500_000

_ASCII_RUNS = re.compile("[a-z0-9]+").findall
_word_hashes: dict[str, int] = {}
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S29, _S31, _S32 = np.uint64(29), np.uint64(31), np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S31)) * _M1
    x = (x ^ (x >> _S29)) * _M2
    return x ^ (x >> _S32)


def _hash_words(words: list[str]) -> list[int]:
    if len(_word_hashes) > MEMORY_WORDS:
        _word_hashes.clear()
    out = []
    for w in words:
        h = _word_hashes.get(w)
        if h is None:
            h = _word_hashes[w] = xxhash.xxh32_intdigest(w)
        out.append(h)
    return out


def _tokens(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(record, token) of every sequence of `width` words, in order, repeats included."""
    sizes = np.array([len(w) // 4 for w in words], dtype=np.int64)
    flat = np.frombuffer(b"".join(words), dtype=np.uint32).astype(np.uint64)
    grams = np.maximum(sizes - (width - 1), 0)
    record = np.repeat(np.arange(len(words)), grams)
    first = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(grams) - grams), grams) + np.arange(len(record))
    token = np.zeros(len(record), dtype=np.uint64)
    for k in range(width):
        token = _mix((token << _S32 | token >> _S32) + flat[first + k] * _M3 + np.uint64(k + 1))
    return record, token


class Sets:
    """Token sets of many records, flat: within a record by rising count, if counts are given, then by hash; repeats dropped."""

    def __init__(self, words: list[bytes], width: int, counts: np.ndarray | None = None):
        record, token = _tokens(words, width)
        count = np.zeros(len(token), dtype=np.int64) if counts is None else counts[(token & np.uint64(len(counts) - 1)).astype(np.int64)]
        if len(words) <= 1 << 14:
            # one machine word holds record, count (capped alike for all) and the upper half of the hash
            lead = record.astype(np.uint64) << np.uint64(50) | np.minimum(count, (1 << 18) - 1).astype(np.uint64) << _S32 | token >> _S32
            order = np.argsort(lead)
            lead, ranked = lead[order], token[order]
            tied = ((lead[1:] == lead[:-1]) & (ranked[1:] != ranked[:-1])).any()
        if len(words) > 1 << 14 or tied:
            order = np.lexsort((token & np.uint64((1 << 32) - 1), token >> _S32, np.minimum(count, (1 << 18) - 1), record))
        record, token, count = record[order], token[order], count[order]
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (record[1:] != record[:-1])
        self.record, self.token, self.count = record[new], token[new], count[new]
        self.n = np.bincount(self.record, minlength=len(words))
        self.start = np.cumsum(self.n) - self.n
        self.rank = np.arange(len(self.record)) - self.start[self.record]

    def parity(self) -> np.ndarray:
        """(records, 3): a 192-bit map of each set; a bit says whether an odd number of its tokens hash there."""
        cell = self.record * MAP_BITS + (_mix(self.token) % np.uint64(MAP_BITS)).astype(np.int64)
        odd = (np.bincount(cell, minlength=MAP_BITS * len(self.n)) & 1).astype(np.uint8)
        return np.packbits(odd).view(np.uint64).reshape(-1, MAP_BITS // 64)


class Plan:
    """The order of tokens, the threshold and the boundary between small and large sets."""

    def __init__(self, counts: np.ndarray, threshold: Fraction, width: int, small: int = 1):
        self.counts, self.threshold, self.width, self.small = counts, threshold, width, small
        # a counter holds its token's count and, on top, about what any counter holds
        self.noise = int(np.median(counts))

    def prefix(self, n: np.ndarray) -> np.ndarray:
        num, den = self.threshold.numerator, self.threshold.denominator
        return n - -(-num * n // den) + 1

    def sets(self, words: list[bytes]) -> Sets:
        return Sets(words, self.width, self.counts)

    def least_overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of sets of these sizes that are similar enough."""
        num, den = self.threshold.numerator, self.threshold.denominator
        return -(-num * (a + b) // (num + den))

    def kinds(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(listed, subset): whether sets of these sizes stand in lists, and in subsets.

        Small sets stand in subsets of two, if they share two tokens at least with any partner. A set that may have a partner
        which stands in lists alone, by its size or for sharing one token only, stands in lists too.
        """
        num, den = self.threshold.numerator, self.threshold.denominator
        least = -(-num * n // den)
        subset = (n <= self.small) & (least >= 2)
        lone = den // num  # sets of so few tokens may share one only
        return ~subset | (n * den >= (self.small + 1) * num) | (least <= lone), subset

    def blocks(self, count: np.ndarray) -> np.ndarray:
        """Into how many blocks the lists of these (counted) lengths are cut; what any counter holds besides isn't counted."""
        return np.maximum(1, -(-(count - self.noise) // LIST_BLOCK))

    def keys(self, sets: Sets) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(record, key, short, blocks): under which lists and subsets each set is found, and how finely those are cut.

        A set need only be sought among larger ones within a shorter prefix; short says whether an entry is in it.
        """
        record, token, rank = sets.record, sets.token, sets.rank
        n, p = sets.n, self.prefix(sets.n)
        brief = n - self.least_overlap(n, n) + 1
        listed, subsets = self.kinds(n)
        at = listed[record] & (rank < p[record])
        records, keys, short, blocks = [record[at]], [token[at]], [rank[at] < brief[record[at]]], [self.blocks(sets.count[at])]
        for q in np.unique(p[subsets] + 1) if subsets.any() else []:
            rows = np.flatnonzero(subsets & (p + 1 == q))
            i, j = np.triu_indices(q, 1)
            starts = sets.start[rows][:, None]
            # the two tokens of a pair in an order that doesn't depend on the record
            a, b = token[starts + i], token[starts + j]
            records.append(np.repeat(rows, len(i)))
            keys.append(_mix(np.minimum(a, b) * _M3 + np.maximum(a, b)).ravel())
            short.append(np.ones(a.size, dtype=bool))
            # a subset is no more frequent than the rarer of its tokens
            blocks.append(self.blocks(np.minimum(sets.count[starts + i], sets.count[starts + j]).ravel()))
        return np.concatenate(records), np.concatenate(keys), np.concatenate(short), np.concatenate(blocks)


def _parse(rows: DataFrame, width: int) -> DataFrame:
    """Two kinds of rows: (is_set false, at_key = id, id, at, k) of every row, (is_set true, at_key = k, k, words) of every set of a task."""
    schema = f"is_set boolean, at_key long, id long, at {rows.schema['at'].dataType.simpleString()}, k long, words binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            words = []
            for h, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                said = _hash_words(_ASCII_RUNS(h.lower()) if h else [])
                if t:
                    said += _hash_words(_ASCII_RUNS(t.lower()))
                words.append(np.array(said, dtype=np.uint32).tobytes())
            names = np.array([xxhash.xxh3_64_intdigest(w) >> 1 if len(w) >= 4 * width else -1 for w in words], dtype=np.int64)
            first = []
            for i, k in enumerate(names.tolist()):
                if k >= 0 and k not in seen:
                    seen.add(k)
                    first.append(i)
            n, m = len(names), len(first)
            some = names[first]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(n + m) >= n),
                    pa.concat_arrays([b.column(0), pa.array(some)]),
                    pa.concat_arrays([b.column(0), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([b.column(1), pa.nulls(m, b.column(1).type)]),
                    pa.array(np.concatenate([names, some])),
                    pa.array([None] * n + [words[i] for i in first], pa.binary()),
                ],
                names=["is_set", "at_key", "id", "at", "k", "words"],
            )

    return spread(rows).mapInArrow(run, schema)


def _words_of(b: pa.RecordBatch, column: str = "words") -> list[bytes]:
    return b.column(column).to_pylist()


def _count_tokens(sets: DataFrame, width: int) -> np.ndarray:
    """The counters, added up: a fixed megabyte, however large the collection."""
    size = COUNTERS // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for b in batches:
            total += np.bincount((_tokens(_words_of(b), width)[1] & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        if total.any():
            parts = [total[s * size : (s + 1) * size].tobytes() for s in range(_SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SLICES, dtype=np.int32)), pa.array(parts, pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                totals[s] = totals.get(s, 0) + np.frombuffer(c, dtype=np.int64)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    out = np.zeros(COUNTERS, dtype=np.int64)
    for r in sets.select("words").mapInArrow(count, schema).repartition(_SLICES, "slice").mapInArrow(add, schema).collect():
        out[r["slice"] * size : (r["slice"] + 1) * size] += np.frombuffer(r["counts"], dtype=np.int64)
    return out


def _boundary(sets: DataFrame, plan_of) -> tuple[int, int]:
    """(the largest size of a small set, entries of the join): where enumerating subsets stops to be cheaper than scanning lists, over all sets."""

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = plan_of()
        by_size: dict[int, np.ndarray] = {}
        for b in batches:
            s = plan.sets(_words_of(b))
            p = plan.prefix(s.n)
            listed = s.rank < p[s.record]
            length = np.maximum(s.count[listed] - plan.noise, 1)
            scans = np.bincount(s.record[listed], weights=length, minlength=len(s.n))
            for n in np.unique(s.n[s.n > 0]):
                of = s.n == n
                q = int(p[of][0])
                by_size[int(n)] = by_size.get(int(n), 0) + np.array([of.sum() * q, SCAN_COST * scans[of].sum(), of.sum() * q * (q + 1) / 2])
        if by_size:
            entries, scans, subsets = np.array(list(by_size.values())).T
            yield pa.RecordBatch.from_arrays([pa.array(list(by_size), pa.int64()), pa.array(entries), pa.array(scans), pa.array(subsets)], names=["n", "entries", "scans", "subsets"])

    rows = sets.select("words").mapInArrow(cost, "n long, entries double, scans double, subsets double").groupBy("n").agg(*[F.sum(c).alias(c) for c in ("entries", "scans", "subsets")]).orderBy("n").collect()
    if not rows:
        return 1, 0
    n = np.array([r["n"] for r in rows])
    entries, scans, subsets = (np.array([r[c] for r in rows]) for c in ("entries", "scans", "subsets"))
    plan = plan_of()

    def total(x: int) -> tuple[float, float]:
        plan.small = x
        listed, small = plan.kinds(n)
        sent = subsets[small].sum() + entries[listed].sum()
        return sent + scans[listed].sum(), sent

    best = min([1, *n.tolist()], key=lambda x: (total(x)[0], x))
    return best, int(total(best)[1])


#: Low bytes of a list's or subset's hash that are sent; more of it is in the task the entry is sent to.
_KEY_BYTES = 5


def _planes(values: np.ndarray, width: int) -> bytes:
    """Low bytes of each value, all first bytes first: what is constant or sorted in them compresses away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    full = np.zeros((len(data) // width, 8), dtype=np.uint8)
    full[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T
    return full.reshape(-1).view("<u8")


def _cut_lists(record: np.ndarray, key: np.ndarray, short: np.ndarray, blocks: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries with those of long lists copied to each pair of blocks that their own block is in, a list of its own.

    A set's block is chosen by its name, so any two sets of a list meet in the list of their two blocks.
    """
    long = np.flatnonzero(blocks > 1)
    if not len(long):
        return record, key, short
    n = blocks[long]
    of = np.repeat(long, n)
    other = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    own = (_mix(names[record[of]].astype(np.uint64)) % blocks[of].astype(np.uint64)).astype(np.int64)
    pair = np.minimum(own, other) * blocks[of] + np.maximum(own, other)
    once = np.flatnonzero(blocks <= 1)
    cut_key = _mix(key[of] + _M2 * (pair + 1).astype(np.uint64))
    return np.concatenate([record[once], record[of]]), np.concatenate([key[once], cut_key]), np.concatenate([short[once], short[of]])


_BUNDLE = "part int, names binary, sizes binary, maps binary, keys binary, entries binary"


def _bundles(sets: DataFrame, plan_of, parts: int) -> DataFrame:
    """For each task of the join, of each batch: the sets it gets (name, size, parity map), and its list entries (key, set and whether short)."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = plan_of()
        for b in batches:
            s = plan.sets(_words_of(b))
            names, maps = np.asarray(b.column("k")), s.parity()
            record, key, short, blocks = plan.keys(s)
            record, key, short = _cut_lists(record, key, short, blocks, names)
            part = ((key >> np.uint64(8 * _KEY_BYTES)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((key & np.uint64((1 << 8 * _KEY_BYTES) - 1), part))
            record, key, short, part = record[order], key[order], short[order], part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            rows = []
            for t in np.flatnonzero(cuts[1:] > cuts[:-1]):
                at = slice(cuts[t], cuts[t + 1])
                members, member = np.unique(record[at], return_inverse=True)
                entry = member.astype(np.uint64) * np.uint64(2) + short[at]
                rows.append((int(t), names[members].tobytes(), _planes(s.n[members], 4), maps[members].tobytes(), _planes(key[at], _KEY_BYTES), _planes(entry, 4)))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["part", "names", "sizes", "maps", "keys", "entries"])

    return sets.select("k", "words").mapInArrow(post, _BUNDLE)


def _scan(plan: Plan, names: np.ndarray, sizes: np.ndarray, maps: np.ndarray, key: np.ndarray, member: np.ndarray, short: np.ndarray) -> np.ndarray:
    """(2, pairs) of names: sets that share a list or subset and may be similar enough by size and parity."""
    size = sizes[member]
    order = np.lexsort((size, key))
    key, member, short, size = key[order], member[order].astype(np.int32), short[order], size[order]
    head = np.ones(len(key), dtype=bool)
    head[1:] = key[1:] != key[:-1]
    place = (np.cumsum(head) - 1) << 32 | size
    num, den = plan.threshold.numerator, plan.threshold.denominator
    # each entry meets those before it in its list: the smaller sets, as far as their size allows and their entry is short
    brief = np.append(0, np.cumsum(short))
    partners = member[short]
    least = np.searchsorted(place, (place >> 32 << 32) | -(-num * size // den))
    low, times = brief[least], brief[:-1] - brief[least]
    later = np.flatnonzero(times > 0)
    total = np.cumsum(times[later])
    both = np.arange(2 * int(sizes.max(initial=0)) + 1)
    far = (both - 2 * -(-num * both // (num + den))).astype(np.int16 if len(both) < 1 << 15 else np.int64)
    found, step, pending = np.zeros(0, dtype=np.int64), 0, []
    while step < len(later):
        stop = max(step + 1, int(np.searchsorted(total, (total[step - 1] if step else 0) + CHUNK_SCANS)))
        e = later[step:stop]
        n = times[e]
        x = np.repeat(member[e], n)
        y = partners[np.repeat(low[e] - (np.cumsum(n) - n), n) + np.arange(len(x))]
        apart = np.bitwise_count(maps[x] ^ maps[y])
        ok = apart[:, 0].astype(np.int16) + apart[:, 1] + apart[:, 2] <= far[sizes[x] + sizes[y]]
        x, y = x[ok].astype(np.int64), y[ok].astype(np.int64)
        pending.append(np.minimum(x, y) * len(names) + np.maximum(x, y))
        if sum(map(len, pending)) > CHUNK_SCANS or stop >= len(later):
            found = np.unique(np.concatenate([found, *pending]))
            pending = []
        step = stop
    a, b = names[found // len(names)], names[found % len(names)]
    differ = a != b
    return np.unique(np.stack([np.minimum(a, b)[differ], np.maximum(a, b)[differ]]), axis=1)


def _candidates(sets: DataFrame, plan_of, parts: int) -> DataFrame:
    """(k_a, k_b), k_a < k_b, each pair once: what the scans of lists and subsets leave."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for r in zip(*cols):
                held.setdefault(r[0], []).append(r[1:])
        plan = plan_of()
        while held:
            _, rows = held.popitem()
            names = np.concatenate([np.frombuffer(r[0], dtype=np.int64) for r in rows])
            sizes = np.concatenate([_from_planes(r[1], 4) for r in rows]).astype(np.int64)
            maps = np.concatenate([np.frombuffer(r[2], dtype=np.uint64).reshape(-1, MAP_BITS // 64) for r in rows])
            key = np.concatenate([_from_planes(r[3], _KEY_BYTES) for r in rows])
            entry = [_from_planes(r[4], 4) for r in rows]
            first = np.cumsum([0] + [len(r[0]) // 8 for r in rows])
            short = np.concatenate([e & np.uint64(1) for e in entry]).astype(bool)
            member = np.concatenate([(e >> np.uint64(1)).astype(np.int64) + f for e, f in zip(entry, first)])
            pairs = _scan(plan, names, sizes, maps, key, member, short)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["k_a", "k_b"])

    bundles = _bundles(sets, plan_of, parts)
    return bundles.repartitionById(parts, F.col("part")).mapInArrow(join, "k_a long, k_b long").distinct()


def _verified(candidates: DataFrame, sets: DataFrame, threshold: Fraction, width: int) -> DataFrame:
    """The candidates that are similar enough, by their sets."""
    once = sets.select(F.col("at_key").alias("k"), "words").dropDuplicates(["k"])
    rows = candidates.join(once.select(F.col("k").alias("k_a"), F.col("words").alias("words_a")), "k_a")
    rows = rows.join(once.select(F.col("k").alias("k_b"), F.col("words").alias("words_b")), "k_b").select("k_a", "k_b", "words_a", "words_b")
    num, den = threshold.numerator, threshold.denominator

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, CHUNK_PAIRS):
                b = whole.slice(s, CHUNK_PAIRS)
                x, y = Sets(_words_of(b, "words_a"), width), Sets(_words_of(b, "words_b"), width)
                # the two sets of a pair side by side: a token that both have comes twice
                record, token = np.concatenate([x.record, y.record]), np.concatenate([x.token, y.token])
                order = np.lexsort((token, record))
                record, token = record[order], token[order]
                twice = (record[1:] == record[:-1]) & (token[1:] == token[:-1])
                shared = np.bincount(record[1:][twice], minlength=b.num_rows)
                good = shared * den >= num * (x.n + y.n - shared)
                yield b.select(["k_a", "k_b"]).filter(pa.array(good))

    return rows.mapInArrow(verify, "k_a long, k_b long")


def similar_classes(records: DataFrame, threshold: float = 0.8, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, links): id, class_id of every record that has words enough; class_a, class_b of similar classes.

    A class holds the records of one list of words, named by its least id; links go between different lists, class_a <
    class_b. Together they say all that similar_pairs says, in a row to a record and a row to a link: copies aren't
    expanded into pairs.

    records: id, at (a later one replaces an earlier one of the same id), heading, text. Words are runs
    of ASCII letters and digits of the lower-cased heading, then text; a null one adds none. Similarity
    is Jaccard's over distinct sequences of `width` words; records shorter than that pair with nothing.
    Of rows of one id and time, the one with the greater hash counts; equal rows count once. Texts
    of any length are read whole. An empty table gives no rows; extra columns aren't read. Texts
    are known by 63-bit hashes and word sequences by 64-bit hashes of 32-bit word hashes.
    """
    spark = records.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = Fraction(str(threshold))
    parsed = _parse(records.select(F.col("id").cast("long"), "at", "heading", "text"), width).repartition(parts, "at_key").persist()
    sets = parsed.where("is_set")
    counts = spark.sparkContext.broadcast(_count_tokens(sets, width))
    small, entries = _boundary(sets, lambda: Plan(counts.value, limit, width))
    tasks = max(spark.sparkContext.defaultParallelism // 2, -(-entries // TASK_ENTRIES), 1)
    pairs = _candidates(sets, lambda: Plan(counts.value, limit, width, small), tasks)
    pairs = cut(_verified(pairs, sets, limit, width))
    ids = parsed.where("NOT is_set").groupBy("id").agg(F.max(F.struct("at", "k"))["k"].alias("k")).where("k >= 0")
    ids = cut(ids)
    parsed.unpersist()
    names = ids.groupBy("k").agg(F.min("id").alias("class_id"))
    members = spread_rows(ids, ["k"], names).select("id", "class_id")
    end = lambda s: names.select(F.col("k").alias(f"k_{s}"), F.col("class_id").alias(s))
    # a set of an earlier delivery may have been replaced; its links go with it
    links = pairs.join(end("a"), "k_a").join(end("b"), "k_b").select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"))
    return members, links


#: Rows of one key that a task joins with others; a key with more is spread over blocks.
BLOCK_ROWS = 5_000
SALTS = 8


def spread_rows(rows: DataFrame, key: list[str], names: DataFrame) -> DataFrame:
    """rows joined with names (one row to a key), the rows of a hot key spread over salts."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return salted.join(names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*key, "salt"]).drop("salt")


def similar_pairs(records: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """(id_a, id_b), id_a < id_b: similar_classes as pairs of records, copies with each other and with all their partners.

    As many rows as there are pairs. The rows of a large class are spread over blocks, each joined by tasks of its own.
    """
    members, links = similar_classes(records, threshold, width)
    members = cut(members)
    sizes = members.groupBy("class_id").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    placed = members.join(sizes, "class_id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    all_blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")

    def expanded(rows: DataFrame, key: str, out: str) -> DataFrame:
        """Each row with every member of its class."""
        wide = rows.join(sizes.select(F.col("class_id").alias(key), "blocks"), key).select(*rows.columns, all_blocks)
        return wide.join(placed.select(F.col("class_id").alias(key), F.col("id").alias(out), "block"), [key, "block"]).drop("block")

    near = expanded(expanded(links, "class_a", "x"), "class_b", "y").select("x", "y")
    copied = placed.where("n > 1").select(F.col("class_id").alias("of"), F.col("id").alias("x"))
    equal = expanded(copied, "of", "y").where("x < y").select("x", "y")
    return near.unionByName(equal).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "paragraphs").where("kind = 'directive'")
    return similar_pairs(p.select(F.col("para_id").alias("id"), F.col("loaded_at").alias("at"), "heading", "text"), threshold=0.6, width=3)


#: The definition, word for word: every sequence of every record joined with its equals.
P2_SQL = """
WITH p AS (SELECT * FROM paragraphs QUALIFY row_number() OVER (PARTITION BY para_id ORDER BY loaded_at DESC) = 1),
w AS (SELECT para_id, list_concat(regexp_extract_all(lower(coalesce(heading, '')), '[a-z0-9]+'), regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM p WHERE kind = 'directive'),
i AS (SELECT para_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
g AS (SELECT DISTINCT para_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM i),
n AS (SELECT para_id, count(*) AS n FROM g GROUP BY para_id),
j AS (SELECT a.para_id AS id_a, b.para_id AS id_b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.para_id < b.para_id GROUP BY ALL)
SELECT id_a, id_b FROM j JOIN n x ON x.para_id = id_a JOIN n y ON y.para_id = id_b WHERE 10 * c >= 6 * (x.n + y.n - c)
"""
