"""Best-two-fit packing of tokenised documents into sequences of one size.

Documents are tokenised and cut into pieces where they are read; from there on a piece is a few numbers. Pieces of
full size are sequences of their own. The rest are dealt out evenly and packed part by part: a sequence is filled
greedily with the largest piece that fits; then its smallest piece gives way to the two unpacked pieces that fit its
expanded gap most tightly, if they fill it better. A part leaves at most a few sequences that are not full, so the
number of sequences stays within some hundredths of a percent of what one part over everything would need.

Edge cases: a null or empty text is the separator alone; equal rows are packed each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged
from .tokens import Ids, memo

PART = 20_000  # pieces packed together


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, separator: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32): the ids of each text and a separator, cut where longer than size."""
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches):
        known, end = memo(Ids, tokenizer), int(separator).to_bytes(4, "little")
        for b in batches:
            for first, some in slices(b.column("t")):
                rows, piece, start, length, crc = [], [], [], [], []
                for i, data in enumerate(known.batch(b.column("t").slice(first, some)), first):
                    n = len(data) // 4 + 1
                    for k, at in enumerate(range(0, n, size)):
                        rows.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(min(size, n - at))
                        own = zlib.crc32(data[4 * at : 4 * (at + size)])
                        crc.append(own if at + size < n else zlib.crc32(end, own))
                yield pa.record_batch([b.column("k").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["k", "piece", "start", "length", "ids_crc32"])

    base = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return base.mapInArrow(cut, f"k {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("k", key)


def fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece. Pieces of one length are alike, so only their numbers are searched."""
    order = np.argsort(lengths, kind="stable")
    ends = np.searchsorted(lengths[order], np.arange(size + 2))
    left = np.diff(ends).tolist()  # by length: unpacked pieces
    given = ends[:-1].tolist()  # by length: place in order of the next unpacked one
    have = sum(1 << n for n in range(1, size + 1) if left[n])  # a bit for each length that is left
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    number = 0

    def largest(most: int) -> int:
        return (have & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 else -1

    def take(n: int) -> None:
        nonlocal have
        left[n] -= 1
        if not left[n]:
            have &= ~(1 << n)

    def give(n: int) -> None:
        nonlocal have
        left[n] += 1
        have |= 1 << n

    while have:
        inside, gap = [], size
        while (n := largest(gap)) > 0:
            inside.append(n)
            take(n)
            gap -= n
        if gap and inside and have:
            smallest, room, best, pair = inside[-1], gap + inside[-1], inside[-1], None
            a = largest(room - 1)
            while a > 0 and 2 * a > best:
                take(a)
                b = largest(min(a, room - a))
                give(a)
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = largest(a - 1)
            if pair:
                inside.pop()
                give(smallest)
                for n in pair:
                    take(n)
                    inside.append(n)
        at = 0
        for n in inside:
            i = order[given[n]]
            given[n] += 1
            sequence[i], offset[i] = number, at
            at += n
        number += 1
    return sequence, offset


def pack(parts: DataFrame, size: int = 2048, key: str = "doc_id") -> DataFrame:
    """parts with sequence_id and offset; parts as pieces() gives them."""
    schema, parts = parts.schema, staged(parts, "pieces")
    count = parts.filter(F.col("length") < size).count()
    n = max(1, -(-count // PART))

    def place(batches):
        from pyspark import TaskContext

        got = list(batches)
        if not got:
            return
        whole = pa.Table.from_batches(got)
        sequence, offset = fit(whole.column("length").to_numpy(), size)
        base = TaskContext.get().partitionId() << 40
        yield from whole.append_column("sequence_id", pa.array(sequence + base, pa.int64())).append_column("offset", pa.array(offset, pa.int64())).to_batches()

    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, sequence_id long, offset long"
    packed = parts.filter(F.col("length") < size).repartition(n).mapInArrow(place, out)
    # Full pieces are numbered by row, on the negative side.
    full = parts.filter(F.col("length") >= size).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)
