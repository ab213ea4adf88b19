"""N-gram Jaccard join by parity sketches: which texts share at least three quarters of their word shingles.

**Sketch.** A text's shingles are hashed; a band's sketch has a fixed number of segments, and a shingle flips (XORs) the
64 bits of its hash in the segment it falls into. The sketches of two sets differ in no more segments than the sets'
symmetric difference has shingles, so the Hamming distance over segments is a lower bound of it.

**Size bands.** Sizes fall into bands that grow eightfold. A pair at the threshold has sizes within 4/3 of each other, so a
text joins its own band and, when a partner may be there, the next one.

**Pigeonhole.** The symmetric difference of two sets of ``a`` and ``b`` shingles with a Jaccard similarity of at least 3/4
has at most ``d = (a + b) // 7``, and they touch at most ``d`` segments. So of the first ``d + 1`` occupied segments of
either text in one global order, at least one is the same in both; ``b`` is at most 4/3 of ``a`` and of the band. Exactly
these segments are joined. The order puts segments of only frequent shingles last, so that passages which many texts share
are not joined on unless a text consists of little else, and fuller segments first. A text whose shingles crowd into fewer
segments makes the pass run again with more segments.

**Candidates.** Pairs that share a segment are filtered by size and by parity sketches of 256 to 32,768 bits, by size
(bit-wise Hamming distance is again a lower bound of the symmetric difference). A segment that few sets share gives their
pairs. One that many share gives a star, and its members; members that are not connected yet are compared by sketches in
blocks of bounded size, and a block tells only which of its members are connected. A segment that is frequent within one
task's texts is dealt as a group right there, and only its first member goes on to the segment's own task. So a group of
any size makes rows in proportion to its members, and no candidate pair is left out of the connected groups.

**Verification.** The sets of a connected group of candidates are brought together once, in blocks where they are many, and
all pairs of them are compared by whole shingle sets within the tasks, which give the number of links of each set and the
connected members. Without the number of links, blocks of one group are compared with each other only where several
leading members have not connected them already.

Defined results. Texts without words have size 0, link with nothing and are components of their own. A null identifier
takes part by its text; a component's name is its smallest identifier, null if it has none. Rows that repeat an
identifier each get their row. Empty tables give empty tables. Extra columns are not returned. Sets are named by 96 bits of
a hash of their shingles, shingles by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from ledgerline.llm._common import bound_batches, give_back, release, remove_tree, stash, table
from ledgerline.llm.hashing import GOLD, byte_numbers, mix, piece_hashes, sub_batches

WIDTH = 5
#: Similarity of at least NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 3, 4
#: A shingle is frequent if it is in at least this share of the texts; there are at most (mean size / share) of them.
FREQUENT = 1 / 2000
#: Bits of a shingle's hash that tell in a table of fixed size whether it may be frequent.
FREQUENT_BITS = 22
#: A size band's upper bound as a multiple of its lower one, a power of two.
BAND_BITS = 3
#: Up to this band a sketch has so many segments that nearly every shingle has its own.
SMALL_BAND, SMALL_SEGMENTS = 64, 1 << 16
#: Segments that sets of SMALL_BAND and more must share.
SHARED = 4
#: Sets of one segment whose pairs are all candidates; beyond, a star and the search across connected groups.
FEW = 12
#: Sets, and their shingles, of one connected group that are compared with as many others at a time.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 20
#: Members of a large group that are compared with all of it first.
LEADS = 8
#: Columns of the matrix by which shared shingles are counted, at a time.
COLUMNS_AT_ONCE = 4096
#: Rows of a block whose sketches are compared at once, and words of pairs of them.
ROWS_AT_ONCE, PAIR_WORDS = 64, 1 << 20
#: Keys that go to one bucket of the segment join, and shingles to one task of the verification, about.
BUCKET_KEYS, TASK_SHINGLES = 250_000, 4_000_000
#: Keys that a task holds before it passes them on.
HELD_KEYS = 600_000
#: Shingles among which those of several texts are counted at a time.
COUNTED = 2_000_000
#: Sizes up to which a parity sketch has so many 64-bit words; larger sets have the last. Each divides the next, so that a
#: longer sketch folds (by XOR) into a shorter one of the same set.
SKETCHES = ((64, 4), (512, 16), (2048, 64), (8192, 256), (None, 512))
#: Bytes of a set's name.
NAME = 12

MASK = (1 << 64) - 1


# ---- shingles of many texts at once ----------------------------------------------------------------------------------

#: Which bytes belong to words: all but \x20 and \x09-\x0D.
IN_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: A number per byte, the same for a letter of A-Z and its lower case.
BYTE = byte_numbers(0)
BYTE[65:91] = BYTE[97:123]
#: A multiplier per word of a shingle, and a summand per number of words.
AT = mix(np.arange(1001, 1001 + WIDTH, dtype=np.uint64) * GOLD) | np.uint64(1)
COUNT = mix(np.arange(2001, 2002 + WIDTH, dtype=np.uint64) * GOLD)

def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the texts data[offsets[k]:offsets[k + 1]]: hashes, distinct and sorted within each text, and where
    each text's begin."""
    data = data[: offsets[-1]]
    inside = IN_WORD[data]
    filled = np.flatnonzero(np.diff(offsets) > 0)
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    for edge, at in ((begin, offsets[filled]), (last, offsets[filled + 1] - 1)):
        edge[at] = inside[at]  # texts lie side by side
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    h = piece_hashes(data, starts, ends, BYTE)
    n = len(h)
    padded = np.append(h, np.zeros(WIDTH, dtype=np.uint64))
    whole = np.full(n, COUNT[WIDTH], dtype=np.uint64)
    for k in range(WIDTH):
        whole += padded[k : k + n] * AT[k]
    keep = np.ones(n, dtype=bool)
    for k in range(1, WIDTH):
        keep[first[1:][n_words >= k] - k] = False
    for t in np.flatnonzero((n_words > 0) & (n_words < WIDTH)):
        a, m = first[t], n_words[t]
        keep[a] = True
        whole[a] = np.append(h[a : a + m] * AT[:m], COUNT[m]).sum(dtype=np.uint64)
    flat = mix(whole[keep])
    bounds = np.append(0, np.cumsum(keep))[first]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        flat[a:b].sort()
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    return flat[new], np.append(0, np.cumsum(new))[bounds]


def names_of(flat: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A name of NAME bytes for every set; empty for an empty one."""
    view = memoryview(flat.view(np.uint8))
    return [xxhash.xxh3_128_digest(view[8 * a : 8 * b])[:NAME] if b > a else b"" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def sketch_words(n: np.ndarray) -> np.ndarray:
    """Words of the parity sketches of sets of n shingles."""
    most = [m for m, _ in SKETCHES[:-1]]
    return np.array([w for _, w in SKETCHES])[np.searchsorted(most, n, "left")]


def sketches_of(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parity sketches of all sets behind each other, as signed numbers, and where each begins."""
    n = np.diff(bounds)
    words = np.where(n > 0, sketch_words(n), 0)
    begin = np.append(0, np.cumsum(words))
    bits = (flat >> np.uint64(20)) & np.repeat((64 * words - 1).astype(np.uint64), n)
    odd = np.bincount(bits.astype(np.int64) + np.repeat(64 * begin[:-1], n), minlength=64 * begin[-1]) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64), begin


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """The shorter sketch of the same set."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


# ---- segments --------------------------------------------------------------------------------------------------------


def segment_keys(flat: np.ndarray, bounds: np.ndarray, frequent: np.ndarray, spread: int = 1) -> tuple[np.ndarray, np.ndarray, bool]:
    """(number of the set, key) of the segments by which sets are joined, over all their bands; and whether any set has
    too few segments. ``frequent``: the table of shingles that come last."""
    n = np.diff(bounds)
    sets = np.flatnonzero(n > 0)
    own = 1 << ((np.frexp(n[sets])[1] - 1) // BAND_BITS * BAND_BITS)
    high = own << BAND_BITS
    both = n[sets] * DENOMINATOR >= high * NUMERATOR
    which, band = np.append(sets, sets[both]), np.append(own, high[both])
    apart = (n[which] + np.minimum(n[which] * DENOMINATOR // NUMERATOR, (band << BAND_BITS) - 1)) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
    some = apart > 0  # else only equal sets are linked
    which, band = which[some], band[some]
    need = apart[some] + np.where(band >= SMALL_BAND, SHARED, 1)
    if not len(which):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), False
    size = n[which]
    begin = np.append(0, np.cumsum(size))
    f = flat[np.arange(begin[-1]) + np.repeat(bounds[:-1][which] - begin[:-1], size)]
    # a segment is a range of hashes, so sorted shingles are grouped already
    segments = np.where(band >= SMALL_BAND, band << BAND_BITS, SMALL_SEGMENTS) * spread
    place = (f >> np.uint64(32)) * np.repeat(segments.astype(np.uint64), size) >> np.uint64(32)
    new = np.ones(len(f), dtype=bool)
    new[1:] = place[1:] != place[:-1]
    new[begin[:-1]] = True
    first = np.flatnonzero(new)
    count = np.minimum(np.diff(np.append(first, len(f))), 7).astype(np.uint64)
    common = np.bitwise_and.reduceat(frequent[(f >> np.uint64(64 - FREQUENT_BITS)).astype(np.int64)], first).astype(np.uint64)
    token = np.searchsorted(first, begin)
    n_tokens = np.diff(token)
    key = mix(np.bitwise_xor.reduceat(f, first) ^ mix(place[first] * GOLD + np.repeat(band.astype(np.uint64), n_tokens)))
    # the same content has the same rank in every text, so this order is global
    rank = common << np.uint64(63) | (np.uint64(7) - count) << np.uint64(60) | key >> np.uint64(4)
    last = np.full(len(which), MASK, dtype=np.uint64)
    for k, (a, b, m) in enumerate(zip(token[:-1].tolist(), token[1:].tolist(), need.tolist(), strict=True)):
        if m < b - a:
            last[k] = np.partition(rank[a:b], m - 1)[m - 1]
    keep = rank <= np.repeat(last, n_tokens)
    # the last bit tells the band's kind
    key = key >> np.uint64(1) << np.uint64(1) | np.repeat(band < SMALL_BAND, n_tokens).astype(np.uint64)
    return np.repeat(which, n_tokens)[keep], key[keep], bool((n_tokens < need).any())


# ---- passes over the texts -------------------------------------------------------------------------------------------


def binaries(data: bytes, n: int) -> pa.Array:
    """``data`` cut into binaries of NAME bytes."""
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * NAME).astype(np.int32)), pa.py_buffer(data)])


def lists(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values))


def named_rows(rows: DataFrame) -> DataFrame:
    """Rows (_key, _text, h1, h2) with the name, size and sketch of their sets in place of the text; and rows that only
    hold shingles which several texts have, with their numbers of texts (often, many)."""
    fields = [StructField(f.name, f.dataType) for f in rows.schema.fields if f.name != "_text"]
    schema = StructType([*fields, StructField("sid", BinaryType()), StructField("n_shingles", LongType()), *(StructField(c, ArrayType(LongType())) for c in ("sketch", "often", "many"))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()
            every.sort()
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
            n = np.diff(np.append(first, len(every)))
            often, many = every[first[n >= 3]].view(np.int64), n[n >= 3]
            ends = np.array([0, len(often)])
            none = [pa.nulls(1, batch.schema.field(f.name).type) for f in fields]
            return pa.RecordBatch.from_arrays([*none, pa.nulls(1, pa.binary()), pa.array([0]), pa.nulls(1, pa.list_(pa.int64())), lists(often, ends), lists(many, ends)], names=schema.names)

        batch = None
        for batch in parts:
            for a, b, data, offsets in sub_batches(batch.column("_text")):
                flat, bounds = shingle_sets(data, offsets)
                part = batch.slice(a, b - a)
                sketch, begin = sketches_of(flat, bounds)
                nothing = pa.nulls(b - a, pa.list_(pa.int64()))
                sid = pa.array([x or None for x in names_of(flat, bounds)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), sid, pa.array(np.diff(bounds)), lists(sketch, begin), nothing, nothing], names=schema.names)
                held.append(flat)
                if sum(map(len, held)) > COUNTED:
                    yield counted(batch)
        if batch is not None and held:
            yield counted(batch)
        give_back()

    return rows.mapInArrow(run, schema)


def frequent_table(named: DataFrame, n_texts: int) -> np.ndarray:
    """Which shingles, by the first bits of their hashes, at least a share FREQUENT of the texts have, by what the tasks
    told: all their texts are counted, but for shingles that fewer than three of some thousand texts share. Which they are
    only orders segments: results do not depend on it. The table's size is fixed."""
    told = named.where("often is not null").select(F.explode(F.arrays_zip("often", "many")).alias("o"))
    counts = told.groupBy(F.col("o.often").alias("h")).agg(F.sum("o.many").alias("n")).where(F.col("n") >= max(8, int(n_texts * FREQUENT)))
    # of the hash only the first bits, 64 of them a row
    place = F.shiftrightunsigned("h", 64 - FREQUENT_BITS)
    bits = counts.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - FREQUENT_BITS}) & 63 as int))")).alias("bits"))
    words = np.zeros(1 << FREQUENT_BITS - 6, dtype=np.int64)
    for r in bits.toLocalIterator():
        words[r.word] = r.bits
    return np.unpackbits(words.view(np.uint8), bitorder="little")


def candidate_rows(texts: DataFrame, frequent: np.ndarray, buckets: int, spread: int = 1) -> DataFrame:
    """Of each segment that several sets share: pairs of sets (a, b) and how often, or, where they are many, star pairs and
    the group's members (key, and the set in ``a``; ``key`` is null in pairs). A row without sets says that ``spread`` is too small."""
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(frequent))

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.unpackbits(shared.value)
        seen: set[bytes] = set()
        keys: list[np.ndarray] = []
        sids: list[np.ndarray] = []

        def dealt() -> Iterator[pa.RecordBatch]:
            key, sid = np.concatenate(keys), np.concatenate(sids)
            keys.clear()
            sids.clear()
            order = np.argsort(key)
            key, sid = key[order], sid[order]
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            short = key & np.uint64(0xFFFFFFFF)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            many = np.diff(np.append(first, len(key)))
            hot = many > FEW
            flag = np.zeros(len(key), dtype=np.uint8)
            flag[first[hot]] = 1
            member = np.repeat(hot, many)
            out = []
            if member.any():
                # such a group is dealt as it is; its first member stands for it
                own = (bucket << np.uint64(32) | short)[member].tobytes()
                at = buckets + int(key[member][0] % np.uint64(buckets))
                out.append((at, own, sid[member].tobytes(), b""))
            stay = ~member | (flag > 0)
            bucket, short, sid, flag = bucket[stay], short[stay].astype(np.uint32), sid[stay], flag[stay]
            which, begin = np.unique(bucket, return_index=True)
            for w, a, b in zip(which.tolist(), begin.tolist(), [*begin[1:].tolist(), len(bucket)], strict=True):
                out.append((w, short[a:b].tobytes(), sid[a:b].tobytes(), flag[a:b].tobytes()))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "keys", "sids", "hot"])

        for batch in parts:
            for _, _, data, offsets in sub_batches(batch.column("_text")):
                flat, bounds = shingle_sets(data, offsets)
                names = names_of(flat, bounds)
                new = np.zeros(len(names), dtype=bool)
                for k, x in enumerate(names):
                    if x and x not in seen:
                        seen.add(x)
                        new[k] = True
                size = np.where(new, np.diff(bounds), 0)
                which, found, crowded = segment_keys(flat[np.repeat(new, np.diff(bounds))], np.append(0, np.cumsum(size)), last, spread)
                if crowded:
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), *(pa.array([b""], pa.binary()) for _ in range(3))], names=["bucket", "keys", "sids", "hot"])
                keys.append(found)
                sids.append(np.array([x or bytes(NAME) for x in names], dtype=f"V{NAME}")[which])
                if sum(map(len, keys)) > HELD_KEYS:
                    yield from dealt()
        if sum(map(len, keys)):
            yield from dealt()
        seen.clear()
        give_back()

    def join(part: pa.Table) -> pa.Table:
        bucket = part.column("bucket")[0].as_py()
        made = [b"".join(part.column(c).to_pylist()) for c in ("keys", "sids", "hot")]
        sid = np.frombuffer(made[1], f"S{NAME}")
        if bucket < 0 or not len(sid):
            nothing = [pa.nulls(int(bucket < 0), t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.int32())]
            return pa.table(dict(zip(("key", "a", "b", "times"), nothing, strict=True)))
        if bucket >= buckets:
            key = np.frombuffer(made[0], np.int64)
            hot = np.zeros(len(key), dtype=bool)
            order = np.lexsort((sid, key))
        else:
            key = np.frombuffer(made[0], np.uint32).astype(np.int64) | bucket << 32
            hot = np.frombuffer(made[2], np.uint8) > 0
            order = np.argsort(key)
            again = np.append(key[order][1:] == key[order][:-1], False)
            order = order[again | np.append(False, again[:-1]) | hot[order]]
            order = order[np.lexsort((sid[order], key[order]))]
        key, sid, hot = key[order], sid[order], hot[order]
        name, sid = np.unique(sid, return_inverse=True)
        new = np.append(True, (key[1:] != key[:-1]) | (sid[1:] != sid[:-1]))[: len(key)]
        hot = np.bitwise_or.reduceat(hot, np.flatnonzero(new)) if len(key) else hot
        key, sid = key[new], sid[new]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        many = np.diff(np.append(first, len(key)))
        big = (many > FEW) | (np.bitwise_or.reduceat(hot, first) if len(key) else False) | (bucket >= buckets)
        out: list[tuple[np.ndarray, np.ndarray]] = [(first[:0], first[:0])]
        for m in range(2, FEW + 1):
            at = first[(many == m) & ~big]
            for i in range(m):
                out += [(at + i, at + j) for j in range(i + 1, m)]
        lead, member = np.repeat(first[big], many[big]), np.flatnonzero(np.repeat(big, many))
        out.append((lead[lead != member], member[lead != member]))
        a, b = (sid[np.concatenate(x)] for x in zip(*out, strict=True))
        # pairs of a star count as if all their segments were shared, as do those of the lowest bands
        full = np.concatenate([np.where(key[x] & 1, SHARED, 1) for x, _ in out[:-1]] + [np.full(len(out[-1][0]), SHARED)])
        pairs, at = np.unique(a.astype(np.int64) * len(name) + b, return_inverse=True)
        times = np.bincount(at, full, len(pairs)).astype(np.int32)
        sets = np.concatenate([pairs // max(1, len(name)), sid[member]])
        others = binaries(name[pairs % max(1, len(name))].tobytes(), len(pairs))
        return pa.table(
            {
                "key": pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(key[member])]),
                "a": binaries(name[sets].tobytes(), len(sets)),
                "b": pa.concat_arrays([others, pa.nulls(len(member), pa.binary())]),
                "times": pa.concat_arrays([pa.array(times), pa.nulls(len(member), pa.int32())]),
            }
        )

    dealt = texts.select("_text").mapInArrow(deal, "bucket long, keys binary, sids binary, hot binary")
    return dealt.groupBy("bucket").applyInArrow(join, "key long, a binary, b binary, times int")


def shingles_of(texts: DataFrame) -> DataFrame:
    """Rows with the whole set (shingles, as bytes) in place of _text; a set once a task."""
    fields = [f for f in texts.schema.fields if f.name != "_text"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in parts:
            new = []
            for k, x in enumerate(batch.column("cid").to_pylist()):
                if x not in seen:
                    seen.add(x)
                    new.append(k)
            batch = batch.take(pa.array(new, pa.int64()))
            for a, b, data, offsets in sub_batches(batch.column("_text")):
                flat, bounds = shingle_sets(data, offsets)
                view = memoryview(flat.view(np.uint8))
                sets = pa.array([bytes(view[8 * x : 8 * y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), sets], names=[*(f.name for f in fields), "shingles"])
        give_back()

    return texts.mapInArrow(run, StructType([*fields, StructField("shingles", BinaryType())]))


# ---- links and components --------------------------------------------------------------------------------------------


def near_by_sketch(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those pairs of sets (a, b), by name, whose sizes and parity sketches allow a link, by number."""
    left = classes.select(F.col("sid").alias("a"), F.col("cid").alias("c_a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a"))
    right = classes.select(F.col("sid").alias("b"), F.col("cid").alias("c_b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b"))
    words = F.least(F.size("s_a"), F.size("s_b"))
    slots = F.sequence(F.lit(0), words - 1)

    def folded(c: str) -> Column:
        parts = F.sequence(F.lit(0), (F.size(c) / words).cast("int") - 1)
        xor = lambda k: F.aggregate(parts, F.lit(0).cast("long"), lambda acc, j: acc.bitwiseXOR(F.get(F.col(c), k + j * words)))
        return F.when(F.size(c) == words, F.col(c)).otherwise(F.transform(slots, xor))

    apart = F.aggregate(F.zip_with(folded("s_a"), folded("s_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    sizes = F.least("n_a", "n_b") * DENOMINATOR >= F.greatest("n_a", "n_b") * NUMERATOR
    both = pairs.join(left, "a").join(right, "b").where(sizes)
    total = DENOMINATOR + NUMERATOR
    return both.where(apart * total <= (F.col("n_a") + F.col("n_b")) * (DENOMINATOR - NUMERATOR)).select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """(cid, root) of every set in ``links`` (a, b), where root is the least one it is connected to, and the path of that
    table: every set takes the least root around it, then its root's root, until nothing changes."""
    spark = links.sparkSession
    edges, edges_at = stash(links.union(links.select("b", "a")).distinct(), "edges")
    roots, roots_at = stash(edges.groupBy(F.col("a").alias("cid")).agg(F.least(F.col("cid"), F.min("b")).alias("root")), "roots")
    while True:
        around = edges.join(roots, edges.b == roots.cid).groupBy("a").agg(F.min("root").alias("seen"))
        lower = roots.join(around, roots.cid == around.a).select("cid", F.col("root").alias("old"), F.least("root", "seen").alias("root"))
        # a root's root; roots are sets themselves
        up = roots.select(F.col("cid").alias("r"), F.col("root").alias("up"))
        new, new_at = stash(lower.join(up, lower.root == up.r).select("cid", "old", F.least("root", "up").alias("root")), "roots")
        remove_tree(spark, roots_at)
        done = new.where("old != root").isEmpty()
        roots, roots_at = new.select("cid", "root"), new_at
        if done:
            remove_tree(spark, edges_at)
            return roots, roots_at


def reached(linked: np.ndarray) -> np.ndarray:
    """For every member the first one that it is connected with, by a symmetric matrix of links."""
    lead = np.full(len(linked), -1)
    for k in range(len(linked)):
        if lead[k] < 0:
            lead[k] = k
            now = np.array([k])
            while len(now):
                near = np.flatnonzero(linked[now].any(axis=0) & (lead < 0))
                lead[near] = k
                now = near
    return lead


def blocks_of(members: DataFrame, n_blocks: Column, own: Column, *group: str) -> DataFrame:
    """Members with the pairs of blocks (x, y) in which they are compared, x = y too."""
    placed = members.withColumn("_n", n_blocks).withColumn("own", own)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return placed.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other", "_n")


def across(groups: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """Of large groups' members (key, cid) that are not connected yet: pairs (a, b) that connect all those whose sketches
    allow a link. Blocks of each group are compared; a task gives at most one pair per member."""
    rooted = groups.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    spread = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).where("low != high")
    open_ = rooted.join(spread.select("key", "m"), "key").join(classes.select("cid", "n_shingles", "sketch"), "cid")
    open_ = blocks_of(open_, F.ceil(F.col("m") / BLOCK_SETS).cast("int"), F.pmod(F.xxhash64("cid"), F.ceil(F.col("m") / BLOCK_SETS)).cast("int"))

    def compare(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        n, root, cid, own = (part.column(c).to_numpy() for c in ("n_shingles", "root", "cid", "own"))
        column = part.column("sketch").combine_chunks()
        begin = column.offsets.to_numpy()
        values = column.values.to_numpy().view(np.uint64)
        words = np.diff(begin)
        # the sketches folded to each length that is compared
        folded = {w: np.zeros((len(n), w), dtype=np.uint64) for w in np.unique(words).tolist()}
        for k, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
            for w, held in folded.items():
                if w <= b - a:
                    held[k] = fold(values[a:b], w)
        near = lambda apart, x, y: apart * (DENOMINATOR + NUMERATOR) <= (n[x] + n[y]) * (DENOMINATOR - NUMERATOR)
        _, label = np.unique(root, return_inverse=True)  # connected members have one label
        two = part.column("x")[0].as_py() != part.column("y")[0].as_py()
        every = np.arange(len(n))
        out: list[tuple[int, int]] = []
        for start in range(0, len(n), ROWS_AT_ONCE):
            i = every[start : start + ROWS_AT_ONCE, None]
            fit = (every > i) & (label != label[i]) & (np.minimum(n, n[i]) * DENOMINATOR >= np.maximum(n, n[i]) * NUMERATOR)
            if two:
                fit &= own != own[i]
            a, b = np.nonzero(fit)
            a += start
            both = np.minimum(words[a], words[b])
            keep = np.zeros(len(a), dtype=bool)
            for w, held in folded.items():
                at = np.flatnonzero(both == w)
                for part in np.array_split(at, max(1, len(at) * w // PAIR_WORDS)):
                    x, y = a[part], b[part]
                    keep[part] = near(np.bitwise_count(held[x] ^ held[y]).sum(axis=1, dtype=np.int64), x, y)
            for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
                if label[x] != label[y]:
                    out.append((cid[x], cid[y]))
                    label[label == label[y]] = label[x]
        return pa.table(dict(zip(("a", "b"), np.array(out, dtype=np.int64).reshape(-1, 2).T.copy(), strict=True)))

    return open_.groupBy("key", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def compare_sets(part: pa.Table) -> pa.Table:
    """Of every group (root, x, y) in a task: each set with the first one that it is connected with by links, and its
    number of links. In groups of two blocks only pairs of different blocks count, and of those only sets that are not
    connected yet, where ``known`` says with what they are."""
    part = part.combine_chunks()
    root, x, y, cid, own, known = (part.column(c).to_numpy() for c in ("root", "x", "y", "cid", "own", "known"))
    data = part.column("shingles").combine_chunks()
    order = np.lexsort((cid, y, x, root))
    new = np.append(True, np.diff(root[order]) | np.diff(x[order]) | np.diff(y[order]))[: len(order)].astype(bool)
    starts = np.append(np.flatnonzero(new), len(order))
    found: list[list[np.ndarray]] = [[], [], []]
    for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        at = order[begin:end]
        at = at[np.append(True, cid[at][1:] != cid[at][:-1])]  # copies bring a set more than once
        if len(at) < 2:
            continue
        sets = [np.frombuffer(data[k].as_buffer(), np.uint64) for k in at.tolist()]
        linked = similar(sets)
        if x[at[0]] != y[at[0]]:
            linked &= (own[at][:, None] != own[at]) & ((known[at][:, None] != known[at]) | (known[at] < 0))
        if linked.any():
            for k, made in enumerate((cid[at], cid[at][reached(linked)], linked.sum(axis=1))):
                found[k].append(made)
    return pa.table({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in zip(("a", "b", "n"), found, strict=True)})


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """Which of the sets are linked with which, as a symmetric matrix: shared shingles are counted over all of them."""
    n = np.array([len(s) for s in sets])
    if len(sets) == 2:
        place = np.minimum(np.searchsorted(sets[1], sets[0]), n[1] - 1)
        both = np.array([[0, (sets[1][place] == sets[0]).sum()]] * 2)
        both[1] = both[0][::-1]
    else:
        _, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), n)
        keep = many[column] > 1  # others are in no intersection
        column, row = (np.cumsum(many > 1) - 1)[column[keep]], row[keep]
        by = np.argsort(column, kind="stable")
        column, row = column[by], row[by]
        both = np.zeros((len(sets), len(sets)), dtype=np.int64)
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS_AT_ONCE):
            a, b = np.searchsorted(column, (first, first + COLUMNS_AT_ONCE))
            held = np.zeros((len(sets), COLUMNS_AT_ONCE), dtype=np.float32)
            held[row[a:b], column[a:b] - first] = 1
            both += (held @ held.T).astype(np.int64)
    out = both * DENOMINATOR >= (n[:, None] + n - both) * NUMERATOR
    np.fill_diagonal(out, False)
    return out


def join(documents: DataFrame, text: str = "text", key: str = "doc_id", links: bool = False) -> DataFrame:
    """One row per row of ``documents``: its identifier, n_shingles, class (a number of its shingle set), and
    component_id, the smallest identifier that it is connected with by links, itself included; with ``links`` also n_links,
    the number of other classes that its own is linked with."""
    named, per_set = joined(documents, text, key, links)
    out = named.join(per_set, "sid", "left")
    own = F.when(F.col("sid").isNull(), F.col("_key")).otherwise(F.col("component_id"))
    more = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if links else []
    return out.select(F.col("_key").alias(key), "n_shingles", F.col("class_id").alias("class"), own.alias("component_id"), *more)


def one_of_each(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents without near copies, and of each group of linked ones the row with the smallest identifier; of
    several the one whose columns hash least. Columns are those of ``documents``."""
    columns = [F.col(f"`{c}`") for c in documents.columns]
    whole = documents.select(F.struct(*columns).alias("_row"), F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    named, per_set = joined(whole, "text", "doc_id")
    # a row's rank needs no text: identifier, then hashes of its text
    rank = F.struct(F.col("_key").isNull().alias("no_key"), F.col("_key").alias("key"), "h1", "h2")
    kept = named.where("sid is not null").groupBy("sid").agg(F.min(rank).alias("best")).join(per_set, "sid")
    kept = kept.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.key").alias("_k"), F.col("best.h1").alias("_h1"), F.col("best.h2").alias("_h2"))
    rows = whole.withColumns(text_hashes("text")).withColumn("_words", F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    stay = rows.where("_words").join(kept, rows.doc_id.eqNullSafe(kept._k) & (rows.h1 == kept._h1) & (rows.h2 == kept._h2))
    # rows that repeat identifier and text: the least of them, chosen by all columns
    again = stay.groupBy("_k", "_h1", "_h2").agg(F.min_by("_row", F.sha2(F.to_json("_row"), 256)).alias("_row"))
    return rows.where(~F.col("_words")).select("_row.*").unionByName(again.select("_row.*"))


def text_hashes(text: str) -> dict[str, Column]:
    """128 bits that tell texts apart."""
    return {"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(7), text)}


def joined(documents: DataFrame, text: str, key: str, every_link: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (_key, sid, n_shingles, h1, h2) of the documents, and (sid, class_id, root, component_id) of every set; with
    ``every_link`` also n_links, null where a set has none."""
    spark = documents.sparkSession
    bound_batches(spark)
    rows = documents.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text")).withColumns(text_hashes("_text"))
    made, _ = stash(named_rows(rows), "named")
    named = made.where("often is null").select("_key", "sid", "n_shingles", "h1", "h2")
    totals = made.where("often is null").agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    frequent = frequent_table(made, totals[0])
    # any row of a set has its text's shingles
    per_class = made.where("sid is not null").groupBy("sid").agg(F.min("_key").alias("least"), F.min("n_shingles").alias("n_shingles"), F.min(F.struct("h1", "h2")).alias("h"), F.any_value("sketch").alias("sketch"))
    classes, classes_at = stash(per_class.select(F.monotonically_increasing_id().alias("cid"), "sid", "least", "n_shingles", "h.*", "sketch"), "classes")
    buckets = max(8, -(-totals[1] * 3 // (8 * BUCKET_KEYS)))
    spread = 1
    while True:
        found, found_at = stash(candidate_rows(rows.where("_text is not null"), frequent, int(buckets), spread), "candidates")
        release(spark)
        if found.where("a is null").isEmpty():
            break
        remove_tree(spark, found_at)
        spread *= 16
    # a pair with too few common segments has others in large groups, if it is one
    often = found.where("key is null").groupBy("a", "b").agg(F.sum("times").alias("times")).where(F.col("times") >= SHARED)
    near = near_by_sketch(often.select("a", "b"), classes)
    pairs, pairs_at = stash(near, "near")
    groups, groups_at = stash(found.where("key is not null").select("key", F.col("a").alias("sid")).distinct().join(classes.select("sid", "cid"), "sid").select("key", "cid"), "groups")
    remove_tree(spark, found_at)
    roots, roots_at = components(pairs)
    if not groups.isEmpty():
        more, more_at = stash(across(groups, roots, classes), "across")
        release(spark)
        if not more.isEmpty():
            remove_tree(spark, roots_at)
            roots, roots_at = components(pairs.union(more))
        remove_tree(spark, more_at)
    remove_tree(spark, groups_at)
    # sets that may be linked, in groups that hold all of their candidates
    linked, linked_at = stash(links_within(rows, classes, roots, every_link), "linked")
    release(spark)
    final, _ = components(linked.where("a <> b").select("a", "b"))
    for path in (pairs_at, roots_at):
        remove_tree(spark, path)
    rooted = classes.select("sid", "cid", "least").join(final, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    per_set = rooted.join(names, "root").select("sid", F.col("cid").alias("class_id"), "root", "component_id")
    if every_link:
        per_set = per_set.join(linked.groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("n_links")), "class_id", "left")
    return named, per_set


def links_within(rows: DataFrame, classes: DataFrame, roots: DataFrame, every_link: bool) -> DataFrame:
    """Sets (a) with a set that they are connected with by links (b) and how many links a task has found for them (n); the
    candidates of a set are all of its root's sets. With ``every_link`` the sum of n is the number of its links."""
    members = roots.join(classes.select("cid", "n_shingles", "h1", "h2"), "cid")
    total = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("s"))
    n_blocks = F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("s") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    placed = members.join(total.withColumn("n_blocks", F.when(F.col("m") > 2, n_blocks).otherwise(1)), "root").drop("n_shingles")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("cid"), "n_blocks").cast("int"))
    shingles = classes.join(roots, "cid").agg(F.sum("n_shingles")).first()[0] or 0
    tasks = F.lit(max(8, shingles // TASK_SHINGLES + 1))

    def compared(wanted: DataFrame, x: Column, y: Column) -> DataFrame:
        """``wanted``: members with what they are known to be connected with, and the blocks (other) that they meet."""
        sets = shingles_of(rows.join(wanted, ["h1", "h2"]).select("cid", "root", "own", "known", "n_blocks", "others", "_text"))
        met = sets.withColumn("other", F.explode("others")).withColumns({"x": x, "y": y})
        task = F.when(F.col("n_blocks") == 1, F.pmod(F.xxhash64("root"), tasks)).otherwise(F.xxhash64("root", "x", "y"))
        return met.select("cid", "root", "own", "known", "x", "y", "shingles", task.alias("task")).groupBy("task").applyInArrow(compare_sets, "a long, b long, n long")

    every = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    placed = placed.withColumn("known", F.lit(-1).cast("long"))
    if every_link:
        return compared(placed.withColumn("others", every), low, high)
    # each block with itself and the leading members of all
    leading = F.pmod(F.xxhash64("cid", F.lit(1)), "m") < LEADS
    met = F.when(leading, every).otherwise(F.array("own"))
    first, _ = stash(compared(placed.withColumn("others", met), F.col("other"), F.col("other")), "linked")
    several = placed.where("n_blocks > 1").drop("known")
    if several.isEmpty():
        return first
    # then members of different blocks that this has not connected
    known, _ = components(first.where("a <> b").select("a", "b"))
    known = several.join(known.select("cid", F.col("root").alias("known")), "cid", "left").withColumn("known", F.coalesce("known", "cid"))
    apart = known.groupBy("root").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low <> high").select("root")
    rest = known.join(apart, "root").withColumn("others", F.array_except(every, F.array("own")))
    return first.union(compared(rest, low, high))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = join(table(spark, sf_dir, "documents").select("doc_id", "text"), links=True)
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END)) AS g FROM w
),
c AS (SELECT row_number() OVER () AS c, g, least, len(g) AS n FROM (SELECT g, min(doc_id) AS least FROM s WHERE len(g) > 0 GROUP BY g)),
x AS (SELECT c, n, unnest(g) AS t FROM c),
p AS (SELECT a.c AS a, b.c AS b, a.n + b.n AS n, count(*) AS k FROM x a JOIN x b ON a.t = b.t AND a.c < b.c GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * k >= 75 * (n - k) UNION ALL SELECT b, a FROM p WHERE 100 * k >= 75 * (n - k)),
reach AS (SELECT c AS a, c AS b FROM c UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
found AS (SELECT a, min(least) AS component_id FROM reach JOIN c ON c.c = reach.b GROUP BY a),
links AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CASE WHEN len(s.g) = 0 THEN doc_id ELSE component_id END AS component_id, coalesce(n_links, 0) AS n_links
FROM s LEFT JOIN c ON c.g = s.g LEFT JOIN found ON found.a = c.c LEFT JOIN links ON links.a = c.c
"""
