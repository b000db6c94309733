"""Media columns in a store of content-defined chunks.

A payload becomes a medium (8-bit PCM WAV: a header and one sample for each byte). Its samples are cut where a
rolling gear hash over 32 bytes says so, so equal stretches of different media give equal chunks. Chunk digests
are deduplicated by Spark; each distinct chunk is stored once, compressed, in a pack file. A manifest keeps, for
each distinct medium, its number of samples (which gives its header) and the ordered list of its chunks, from which it
is rebuilt and verified.

Bytes are hardly shuffled. A first pass lists digests only. Digests that occur more than once set bits in a
filter, `FILTER_RATE` bits for each of them (counted first) and at most `FILTER_BITS`. The second pass writes
chunks outside the filter, which are certainly unique, straight to packs; only the others are shuffled by
digest and stored once. A filter that fills up costs shuffling, never correctness.

Reading goes by the index (digest -> pack, offset): chunk lists are joined to places, never to bytes, and tasks
read ranges of packs, about `READ_BYTES` of samples each.

Defined cases: a null or empty text is 64 zero bytes; equal texts are one medium; an empty table has no packs;
very long texts are many chunks; rows with null or repeated ids each get their medium's values; other columns are left
out, so none clashes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, named, scratch, texts, written
from .files import Appender, Reader

ALIGN, RATE, LEAST, MOST, MASK = 64, 8_000, 512, 16 << 10, np.uint32(0xFFE0_0000)  # a cut each 2 KiB after LEAST
PACK, LEVEL, FILTER_RATE, FILTER_BITS, READ_BYTES = 64 << 20, 6, 16, 1 << 28, 16 << 20
#: A random 32-bit value for each byte, from a rule.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def payload_of(text: str) -> bytes:
    data = text.encode()
    return data + bytes(ALIGN - len(data) % ALIGN if len(data) % ALIGN or not data else 0)


def wav_header(n: int) -> bytes:
    """Of n samples: mono, 8 bits each."""
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n)


def samples_of(medium: bytes) -> bytes:
    """The samples of a medium, whose header must be as written."""
    header, samples = medium[:44], medium[44:]
    if header != wav_header(len(samples)):
        raise ValueError("not a medium of this store")
    return samples


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of GEAR[b] << age over the last 32 bytes, by doubling."""
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        if len(h) > width:
            older = h[:-width] << np.uint32(width)
            h = h.copy()
            h[width:] += older
    return h


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks of a payload."""
    n, out, start = len(data), [], 0
    if n > LEAST:
        marks = np.flatnonzero((gear_hashes(np.frombuffer(data, np.uint8)) & MASK) == 0) + 1
        while n - start > LEAST:
            k = np.searchsorted(marks, start + LEAST)
            end = min(int(marks[k]) if k < len(marks) else n, start + MOST, n)
            if end >= n:
                break
            out.append(end)
            start = end
    return [*out, n]


def chunked(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:20]


def features(samples: bytes) -> str:
    """Levels and zero crossings of 8-bit samples (128 is silence)."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};peak={int(np.abs(x).max())};crossings={crossings}"


MANIFEST = "n_bytes long, medium binary, samples long, chunks array<binary>"


def listed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """First pass: key, n_bytes, medium (the SHA-256 of the stored form), samples and chunk digests of each row."""
    kind = docs.select(named(key)).schema[0].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for t in texts(batch):
                data = payload_of(t)
                medium = hashlib.sha256(wav_header(len(data)))
                medium.update(data)
                rows.append((len(t.encode()), medium.digest(), len(data), [digest(c) for c in chunked(data)]))
            if rows:
                types = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.binary()))
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("__key")), *arrays], names=[key, "n_bytes", "medium", "samples", "chunks"])

    given = docs.select(named(key).alias("__key"), named(text).cast("string").alias("text"))
    return given.mapInArrow(run, f"`{key}` {kind}, {MANIFEST}")


def repeated_filter(rows: DataFrame) -> np.ndarray:
    """A bit for each digest that occurs more than once, OR-ed by Spark; as 64-bit words."""
    each = rows.select(F.explode("chunks").alias("d")).groupBy("d").agg(F.count("*").alias("n")).filter("n > 1")
    each = written(each.select(F.xxhash64("d").alias("h")), "media-repeated")
    n_bits = min(FILTER_BITS, max(1 << 12, 1 << (FILTER_RATE * each.count()).bit_length()))
    bit = F.pmod(F.col("h"), F.lit(n_bits))
    got = each.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("value")).toPandas()  # n_bits / 64 rows at most
    words = np.zeros(n_bits // 64, dtype=np.uint64)
    words[got["word"].to_numpy(dtype=np.int64)] = got["value"].to_numpy(dtype=np.int64).view(np.uint64)
    return words


INDEX = "digest binary, pack string, offset long, stored int, size int"


def stored(docs: DataFrame, rows: DataFrame, text: str = "text", folder: str | None = None) -> DataFrame:
    """Second pass: writes the packs. The index, as a written table. rows: from `listed`, written. folder: where packs are
    to stay; else they go with the application."""
    import xxhash

    spark = docs.sparkSession
    folder = folder or scratch(spark, "packs")
    words = spark.sparkContext.broadcast(repeated_filter(rows))  # FILTER_BITS / 8 bytes at most

    def may_repeat(d: bytes) -> bool:
        bit = xxhash.xxh64_intdigest(d, 42) % (64 * len(words.value))  # a power of two, so signs don't matter
        return bool(int(words.value[bit >> 6]) >> (bit & 63) & 1)

    def batch_of(rows):
        import pyarrow as pa

        types = (pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["digest", "pack", "offset", "stored", "size", "data"])

    def put(out, d, data, size):
        if out.full:
            out.close()
        name, at = out.add(data)
        return (d, name, at, len(data), size, None)

    def first(batches):
        import zstandard

        out, press, seen = Appender(folder, ".pack", PACK), zstandard.ZstdCompressor(level=LEVEL), set()
        for batch in batches:
            made = []
            for t in texts(batch):
                for c in chunked(payload_of(t)):
                    d = digest(c)
                    if not may_repeat(d):
                        made.append(put(out, d, press.compress(c), len(c)))
                    elif d not in seen:
                        if len(seen) < 1_000_000:  # a copy that is emitted again is dropped by digest
                            seen.add(d)
                        data = press.compress(c)
                        made.append((d, None, None, len(data), len(c), data))
            if made:
                yield batch_of(made)
        out.close()

    def second(batches):
        out = Appender(folder, ".pack", PACK)
        for batch in batches:
            made = [put(out, x["digest"], x["data"], x["size"]) for x in batch.to_pylist()]
            if made:
                yield batch_of(made)
        out.close()

    schema = f"{INDEX}, data binary"
    some = written(docs.select(named(text).cast("string").alias("text")).mapInArrow(first, schema), "packs-first")
    shared = some.filter("data is not null").groupBy("digest").agg(F.first("data").alias("data"), F.first("size").alias("size"))
    rest = written(shared.mapInArrow(second, schema), "packs-second")
    return some.filter("data is null").drop("data").unionByName(rest.drop("data"))


def rebuilt(rows: DataFrame, index: DataFrame) -> DataFrame:
    """medium, samples, n (how many rows have it) and parts (ordered places of its chunks) of each distinct medium."""
    media = written(rows.groupBy("medium").agg(F.first("samples").alias("samples"), F.first("chunks").alias("chunks"), F.count("*").alias("n")), "media-distinct")
    refs = media.select("medium", F.posexplode("chunks").alias("nth", "digest"))
    found = refs.join(index, "digest", "left").groupBy("medium").agg(F.array_sort(F.collect_list(F.struct("nth", "pack", "offset", "stored", "size", "digest"))).alias("parts"))
    n_parts = max(1, -(-(media.agg(F.sum("samples")).first()[0] or 0) // READ_BYTES))
    near = F.col("parts")[0]
    spread = found.join(media.select("medium", "samples", "n"), "medium").repartitionByRange(n_parts, near["pack"], near["offset"])
    return spread.sortWithinPartitions(near["pack"], near["offset"])


READ = "medium binary, n long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def verified(rows: DataFrame, index: DataFrame, work=None, schema: str = READ) -> DataFrame:
    """Reads every distinct medium back from the packs, checks each chunk's digest and the whole's, and applies
    `work` (bytes of the medium -> a tuple as in `schema`, behind `medium` and n, how many rows have it)."""
    work = work or measured

    def read(batches):
        import zstandard

        files, unpress = Reader(), zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                whole, name = [wav_header(x["samples"])], x["medium"].hex()
                for p in x["parts"]:
                    if p["pack"] is None:
                        raise ValueError(f"medium {name}: chunk {p['nth']} is not stored")
                    c = unpress.decompress(files.read(p["pack"], p["offset"], p["stored"]), max_output_size=p["size"])
                    if digest(c) != p["digest"]:
                        raise ValueError(f"medium {name}: chunk {p['nth']} is damaged")
                    whole.append(c)
                data = b"".join(whole)
                if hashlib.sha256(data).digest() != x["medium"]:
                    raise ValueError(f"medium {name} is damaged")
                out.append((x["medium"], x["n"], *work(data)))
            if out:
                import pyarrow as pa

                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[f.split()[0] for f in schema.split(", ")])
        files.close()

    return rebuilt(rows, index).mapInArrow(read, schema)


def measured(medium: bytes) -> tuple:
    samples = samples_of(medium)
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ALIGN:]), len(medium), hashlib.sha256(medium).hexdigest(), features(samples)
