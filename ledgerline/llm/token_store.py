"""Token ids in sorted-string-table shards, keyed by document identifier.

A shard is a file of prefix-compressed blocks of (key, ids) entries in key order, a sparse index with the last key of
each block, a Bloom filter over the keys, a description, and a footer that says where these are. A lookup asks the
filter, searches the index by halves and reads one block; a scan reads the blocks in order.

Documents are dealt out by ranges of the identifier (and of the text's hash, so that rows of one identifier can be split
too), sorted, encoded and written by the tasks, a shard each. A task writes under a name of its own attempt and only
reports the name when the file is complete: what a lost or repeated attempt leaves behind is never read.

Defined results. A null or empty text is the end id alone. A null identifier sorts first; identifiers are whole numbers, or
texts of such (any other fails the job, as Spark's cast does). Rows that repeat an identifier
follow each other by the hash of the text, then the text. Empty tables give no shards. Extra columns are not stored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm._common import bound_batches, give_back, local_path, scratch, table
from ledgerline.llm.hashing import byte_numbers, piece_hashes, sub_batches

MAGIC = b"LLTOKSS1"
FOOTER = struct.Struct(">QQQQQQ8s")
BLOCK_BYTES = 1 << 16
BLOOM_BITS = 10
BLOOM_HASHES = 7
#: Pieces whose ids a worker remembers; it forgets them all beyond that.
CACHE_PIECES = 1_000_000
#: Pieces that are learnt at a time, so that the tables never fill.
LEARNT = 200_000
#: Pieces of more bytes are not remembered.
LONG_PIECE = 64


# ---- encoding ------------------------------------------------------------------------------------------------------


#: Fixed values, by code point: white space of texts but spaces and line ends.
ODD_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Last bytes of white space, by what stands before them.
ODD_ENDS: dict[bytes, bytes] = {}
for _c in ODD_SPACES:
    ODD_ENDS[_c.encode()[:-1]] = ODD_ENDS.get(_c.encode()[:-1], b"") + _c.encode()[-1:]
SPACE = np.isin(np.arange(256), (32, 10))
LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
#: Bytes after \xc3 that make a letter.
LATIN = np.isin(np.arange(256), [k for k in range(0x80, 0xC0) if k not in (0x97, 0xB7)])
NUMBERS = byte_numbers(1), byte_numbers(2)


def _among(values: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(values, np.uint8))


def odd_spaces(data: np.ndarray) -> np.ndarray:
    """Where the last bytes of white space but spaces and line ends are."""
    out = _among(ODD_ENDS[b""])[data]
    for before, last in ODD_ENDS.items():
        if before:
            at = np.flatnonzero(data[: -len(before)] == before[0]) if len(data) > len(before) else np.zeros(0, np.int64)
            for k in range(1, len(before)):
                at = at[data[at + k] == before[k]]
            out[at[_among(last)[data[at + len(before)]]] + len(before)] = True
    return out


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of the texts data[offsets[k]:offsets[k + 1]] begin that can be encoded by themselves. Byte-level
    pre-tokenizing never joins a character with white space that follows it, nor a letter with an ASCII character that is
    none. So white space begins a piece, unless other white space is before it, and letters that begin one, but for its
    white space, are one to where an ASCII character follows. Also, which pieces could stand behind each other so."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, dtype=bool)
    space = SPACE[data]
    plain = ~(space | odd_spaces(data))
    cut = space.copy()
    cut[1:] &= plain[:-1]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    first = np.flatnonzero(cut)
    ends = np.append(first[1:], n)
    letter = LETTER[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & LATIN[data[1:]])
    letter[latin] = letter[latin + 1] = True
    # the first character of a piece that is no space, then the first that is no letter
    dark, other = np.append(np.flatnonzero(~space), n), np.append(np.flatnonzero(~letter), n)
    begin = np.minimum(dark[np.searchsorted(dark, first)], ends)
    after = other[np.searchsorted(other, begin)]
    inner = after[(after > begin) & (after < ends)]
    cut[inner[data[inner] < 0x80]] = True
    starts = np.flatnonzero(cut)
    return starts, space[starts] & plain[np.append(starts[1:], n) - 1]


class Encoder:
    """Ids of whole texts by the tokenizers library. Texts are cut into pieces that can be encoded by themselves; pieces
    seen before are not encoded again but looked up by two 64-bit hashes, for all pieces of a batch at once."""

    BITS = 21

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        vocabulary = self.tokenizer.get_vocab()
        self.length = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, k in vocabulary.items():
            self.length[k] = len(token)  # a byte is written as one character
        self.forget()

    def forget(self) -> None:
        """Empty tables: slots of hashes (0: free) with the pieces' numbers, and the ids of every piece."""
        self.slot, self.check, self.number = (np.zeros(1 << self.BITS, t) for t in (np.uint64, np.uint64, np.int64))
        self.ids, self.n_ids = np.zeros(0, self.dtype), np.zeros(0, np.int64)

    def _ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind each other, and their numbers."""
        ids, many = array("I"), []
        for k in range(0, len(texts), 20_000):
            for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts[k : k + 20_000]], add_special_tokens=False):
                found = e.ids
                ids.extend(found)
                many.append(len(found))
        return np.frombuffer(ids, np.uintc).astype(self.dtype) if many else np.zeros(0, self.dtype), np.array(many, dtype=np.int64)

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces behind each other, and their numbers; pieces of ``chain`` are encoded as one text, in
        which the lengths of the tokens tell where each piece ends."""
        size, one = ends - starts, np.flatnonzero(chain)
        upto = np.cumsum(size[one])
        whole = data[np.arange(upto[-1] if len(one) else 0) + np.repeat(starts[one] - (upto - size[one]), size[one])]
        parts = np.flatnonzero(np.diff(np.append(-1, upto // (1 << 14))) > 0) if len(one) else one
        cuts = [0, *(upto[parts] - size[one][parts])[1:].tolist(), len(whole)]
        ids, _ = self._ids([whole[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] if len(one) else [])
        length = np.cumsum(self.length[ids])
        last = np.searchsorted(length, upto)
        if len(one) and (length[-1] != upto[-1] or (length[last] != upto).any()):
            chain, one, ids, last = np.zeros(len(chain), dtype=bool), one[:0], ids[:0], last[:0]  # not a byte-level vocabulary
        alone = np.flatnonzero(~chain)
        own, many = self._ids([data[a:b].tobytes() for a, b in zip(starts[alone], ends[alone], strict=True)])
        n = np.zeros(len(size), dtype=np.int64)
        n[alone], n[one] = many, np.diff(np.append(-1, last))
        # back to the order of the pieces
        begin = np.zeros(len(size), dtype=np.int64)
        begin[one], begin[alone] = np.cumsum(n[one]) - n[one], len(ids) + np.cumsum(many) - many
        return np.append(ids, own)[np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)], n

    def _known(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The numbers of the pieces, -1 where there is none."""
        out = np.full(len(h), -1)
        wait, at = np.arange(len(h)), (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        while len(wait):
            there = self.slot[at]
            same = (there == h[wait]) & (self.check[at] == check[wait])
            out[wait[same]] = self.number[at[same]]
            go = ~same & (there != 0)
            wait, at = wait[go], (at[go] + 1) & (1 << self.BITS) - 1
        return out

    def _learn(self, h: np.ndarray, check: np.ndarray, ids: np.ndarray, many: np.ndarray) -> None:
        wait, at = np.arange(len(h)), (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        while len(wait):
            # the first of those that want a free slot has it
            slot, first = np.unique(at, return_index=True)
            first = first[self.slot[slot] == 0]
            slot, got = at[first], wait[first]
            self.slot[slot], self.check[slot], self.number[slot] = h[got], check[got], len(self.n_ids) + got
            rest = np.ones(len(wait), dtype=bool)
            rest[first] = False
            wait, at = wait[rest], at[rest]
            at = np.where(self.slot[at] != 0, (at + 1) & (1 << self.BITS) - 1, at)
        self.ids, self.n_ids = np.append(self.ids, ids), np.append(self.n_ids, many)

    def ids_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts data[offsets[k]:offsets[k + 1]] behind each other, and where each text's begin."""
        starts, chain = pieces(data, offsets)
        ends = np.append(starts[1:], len(data))
        h, check = (piece_hashes(data, starts, ends, n) for n in NUMBERS)
        h[h == 0] = 1
        if len(self.n_ids) > CACHE_PIECES:
            self.forget()
        long = np.flatnonzero(ends - starts > LONG_PIECE)
        number = self._known(h, check)
        number[long] = 0
        while len(new := np.flatnonzero(number < 0)):
            # a piece of each hash at a time
            _, first = np.unique(h[new], return_index=True)
            first = new[first][:LEARNT]
            self._learn(h[first], check[first], *self._encode(data, starts[first], ends[first], chain[first]))
            number[new] = self._known(h[new], check[new])
        begin, many = np.cumsum(self.n_ids) - self.n_ids, self.n_ids
        ids = self.ids
        if len(long):
            # long pieces hardly come again
            own, n = self._encode(data, starts[long], ends[long], chain[long])
            number[long] = len(many) + np.arange(len(long))
            begin, many, ids = np.append(begin, len(ids) + np.cumsum(n) - n), np.append(many, n), np.append(ids, own)
        n = many[number]
        upto = np.append(0, np.cumsum(n))
        return ids[np.arange(upto[-1]) + np.repeat(begin[number] - upto[:-1], n)], upto[np.searchsorted(starts, offsets)]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, as little-endian numbers of ``dtype``."""
        for _, _, data, offsets in sub_batches(pa.array(texts, pa.large_string())):
            ids, begin = self.ids_of(data, offsets)
            for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                yield ids[a:b].tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---- the file format -----------------------------------------------------------------------------------------------


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as identifiers do, nulls first."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def key_hashes(key: bytes) -> tuple[int, int]:
    return zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1


def bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = key_hashes(key)
    return [(a + k * b) % bits for k in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes entries, which come in key order, to an open binary stream."""

    def __init__(self, stream, dtype: str) -> None:
        self.stream, self.dtype, self.at = stream, dtype, 0
        self.item = np.dtype(dtype).itemsize
        self.block, self.index = bytearray(), []
        self.hashes = array("I")  # two of each key
        self.first_key = self.last = b""
        self.n_tokens = 0

    def _put(self, data: bytes) -> tuple[int, int]:
        self.stream.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _close_block(self) -> None:
        if self.block:
            self.block += struct.pack(">I", zlib.crc32(self.block))
            self.index.append((self.last, *self._put(bytes(self.block))))
            self.block = bytearray()

    def add(self, key: bytes, *ids: bytes) -> None:
        """An entry, whose ids may be in parts."""
        shared, n = 0, sum(map(len, ids))
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(n) + key[shared:]
        for part in ids:
            self.block += part
        self.first_key, self.last = self.first_key or key, key
        self.hashes.extend(key_hashes(key))
        self.n_tokens += n // self.item
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()

    def finish(self) -> None:
        self._close_block()
        index = self._put(b"".join(varint(len(k)) + k + varint(a) + varint(n) for k, a, n in self.index))
        n = len(self.hashes) // 2
        bits = max(64, BLOOM_BITS * n)
        places = np.zeros(-(-bits // 8) * 8, dtype=np.uint8)
        a, b = np.frombuffer(self.hashes, np.uintc).astype(np.int64).reshape(-1, 2).T if n else np.zeros((2, 0), np.int64)
        for k in range(BLOOM_HASHES):
            places[(a + k * b) % bits] = 1
        bloom = self._put(struct.pack(">Q", bits) + np.packbits(places, bitorder="little").tobytes())
        about = self._put(json.dumps({"dtype": self.dtype, "n_docs": n, "n_tokens": self.n_tokens}).encode())
        self._put(FOOTER.pack(*index, *bloom, *about, MAGIC))


class Shard:
    """A shard in an open random-access file."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        parts = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if parts[-1] != MAGIC:
            raise ValueError("not a token shard")
        index, bloom = memoryview(self._read(*parts[0:2])), self._read(*parts[2:4])
        self.about = json.loads(bytes(self._read(*parts[4:6])))
        self.dtype = np.dtype(self.about["dtype"])
        (self.bits,) = struct.unpack_from(">Q", bloom)
        self.bloom = bloom[8:]
        self.blocks: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(index):
            n, at = read_varint(index, at)
            key = bytes(index[at : at + n])
            start, at = read_varint(index, at + n)
            length, at = read_varint(index, at)
            self.blocks.append((key, start, length))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, k: int) -> Iterator[tuple[bytes, memoryview]]:
        _, start, length = self.blocks[k]
        data = memoryview(self._read(start, length))
        if zlib.crc32(data[:-4]) != struct.unpack(">I", data[-4:])[0]:
            raise ValueError("a block is damaged")
        at, key = 0, b""
        while at < length - 4:
            shared, at = read_varint(data, at)
            own, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + bytes(data[at : at + own])
            at += own + n
            yield key, data[at - n : at]

    def __iter__(self) -> Iterator[tuple[bytes, memoryview]]:
        for k in range(len(self.blocks)):
            yield from self._block(k)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every entry of a key."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(key, self.bits)):
            return []
        found = []
        for k in range(bisect_left([b[0] for b in self.blocks], key), len(self.blocks)):
            found += [np.frombuffer(v, self.dtype) for x, v in self._block(k) if x == key]
            if self.blocks[k][0] > key:
                break
        return found


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Where the shards are: a local or mounted path, or any store that pyarrow opens by its URI."""
    path = local_path(uri)
    return (pafs.LocalFileSystem(), path) if path is not None else pafs.FileSystem.from_uri(uri)


def open_shard(uri: str) -> Shard:
    fs, path = filesystem(uri)
    return Shard(fs.open_input_file(path))


# ---- writing and reading on the cluster ------------------------------------------------------------------------------

MANIFEST = "part int, path string, n_docs long, n_tokens long, n_bytes long, first long, last long, nulls boolean"


def write(documents: DataFrame, folder: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Write ``documents`` as shards below ``folder``; gives the manifest, one row per shard in key order, with its first
    and last identifier, whether it has null ones, and the number of ids before it. Only that is brought to the driver."""
    spark = documents.sparkSession
    bound_batches(spark)

    def store(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        end = np.array([end_id], dtype=own.dtype).tobytes()
        fs, top = filesystem(folder)
        part = TaskContext.get().partitionId()
        path = f"{top}/part-{part:06d}-{uuid.uuid4().hex}.sst"
        writer = stream = None
        for rows in parts:
            keys = [key_of(k) for k in rows.column("key").to_pylist()]
            for a, b, data, offsets in sub_batches(rows.column("text")):
                if writer is None:
                    fs.create_dir(top, recursive=True)
                    stream = fs.open_output_stream(path)
                    writer = ShardWriter(stream, own.dtype.str)
                ids, begin = own.ids_of(data, offsets)
                view = memoryview(ids.view(np.uint8))
                for k, x, y in zip(keys[a:b], (begin[:-1] * own.dtype.itemsize).tolist(), (begin[1:] * own.dtype.itemsize).tolist(), strict=True):
                    writer.add(k, view[x:y], end)
        if writer is not None:
            writer.finish()
            stream.close()
            # nulls sort first
            ids = [id_of(writer.first_key), id_of(writer.last)]
            row = (part, path, len(writer.hashes) // 2, writer.n_tokens, writer.at, *ids, ids[0] is None)
            types = (pa.int32(), pa.string(), *[pa.int64()] * 5, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["part", "path", "n_docs", "n_tokens", "n_bytes", "first", "last", "nulls"])
        give_back()

    k = F.col(f"`{key}`").cast("long")
    rows = documents.select(k.alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    made = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.col("text")).mapInArrow(store, MANIFEST).collect()
    before, out = 0, []
    fs_scheme = folder.split("://")[0] + "://" if local_path(folder) is None else ""
    for r in sorted(made, key=lambda r: r.part):
        path = r.path if not fs_scheme or "://" in r.path else fs_scheme + r.path
        out.append((r.part, path, *r[2:], before))
        before += r.n_tokens
    return spark.createDataFrame(out, MANIFEST + ", before long")


ENTRIES = "doc_id long, start long, n_tokens long, ids binary"


def read(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """The documents in the shards: doc_id, start (ids before it), n_tokens and the ids as little-endian 32-bit numbers;
    or, with ``digest``, their crc32 in place of the ids."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            for path, start in zip(rows.column("path").to_pylist(), rows.column("before").to_pylist(), strict=True):
                shard, out, held = open_shard(path), [], 0
                for key, value in shard:
                    ids = np.frombuffer(value, shard.dtype).astype("<u4").tobytes()
                    out.append((id_of(key), start, len(ids) // 4, zlib.crc32(ids) if digest else ids))
                    start += len(ids) // 4
                    held += 100 if digest else len(ids)
                    if held > 8 << 20:
                        yield batch(out)
                        out, held = [], 0
                yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 4
        types = (*[pa.int64()] * 3, pa.int64() if digest else pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    n = max(1, manifest.count())
    return manifest.select("path", "before").repartition(n).mapInArrow(scan, ENTRIES.replace("ids binary", "ids_crc32 long") if digest else ENTRIES)


def lookup(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """The ids of one identifier: the manifest names the shards that may have it (one, if it is not repeated), their
    Bloom filters, indexes and blocks tell."""
    may = F.col("nulls") if doc_id is None else (F.col("last") >= doc_id) & (F.col("nulls") | (F.col("first") <= doc_id))
    return [ids for r in manifest.where(may).orderBy("part").toLocalIterator() for ids in open_shard(r.path).get(key_of(doc_id))]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read(write(docs, scratch(spark, "shards"), default_vocabulary()), digest=True)
