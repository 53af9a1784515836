"""Token counts of whole documents, huge ones cut into overlapping chunks that are spliced again.

A long text is cut into chunks that overlap. Each is encoded with offsets by a task of its own. Two neighbours are
spliced where both have a pre-token boundary at one place of the overlap: pre-tokenisation runs from left to right
and looks one character ahead, so from a boundary that both share, the later chunk goes on as the whole text would.
A boundary of the earlier chunk counts only if it lies further from that chunk's end than the longest added token,
so that nothing cut off could have changed it. Where no such place exists, the overlap is widened and the
document encoded anew, at last as a whole.

Edge cases: a null or empty text has 0 bytes and 0 tokens; a repeated row gives a row each time; an empty table
gives an empty result; columns besides key and text are ignored; a null key is kept.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged
from .tokens import Counts, load, memo

MARGIN = 64  # characters; longer than any added token of the public tokenizers
TASKS = 10_000  # at most, for the chunks of one round


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", chunk: int = 65_536, overlap: int = 512) -> DataFrame:
    """(key, n_bytes, n_tokens) of every row; tokenizer is the path of a tokenizers .json file on every machine."""
    base = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    short = base.filter(F.length("t") <= chunk).select("k", F.octet_length("t").cast("long").alias("n_bytes"), "t")

    def count(batches):
        known = memo(Counts, tokenizer)
        for b in batches:
            yield pa.record_batch([b.column("k"), b.column("n_bytes"), pa.array([known.count(t.as_py()) for t in b.column("t")], pa.int64())], ["k", "n_bytes", "n_tokens"])

    counted = short.mapInArrow(count, f"k {kind}, n_bytes long, n_tokens long")
    out = counted.unionByName(_long(base.filter(F.length("t") > chunk), tokenizer, kind, chunk, overlap))
    return out.withColumnRenamed("k", key)


def _long(docs: DataFrame, tokenizer: str, kind: str, chunk: int, overlap: int) -> DataFrame:
    """Rows of long documents. A row is told from others by key and digest, so equal rows share their work."""
    if not 0 <= overlap < chunk:
        raise ValueError("an overlap is shorter than its chunk")
    keyed = staged(docs.select("k", "t", F.sha2("t", 256).alias("digest")), "long-texts")
    done = None
    while True:
        got = staged(_spliced(keyed, tokenizer, kind, chunk, overlap), "long-counts")
        good = got.filter("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        if got.filter("n_tokens is null").isEmpty():
            break
        failed = got.filter("n_tokens is null").select(F.col("k").alias("fk"), F.col("digest").alias("fd"))
        keyed = keyed.join(failed, keyed["k"].eqNullSafe(failed["fk"]) & (keyed["digest"] == failed["fd"]), "left_semi")
        chunk, overlap = chunk * 8, overlap * 8  # together, so that chunks always advance
    return done.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("k", "n_bytes", "n_tokens")


def _spliced(keyed: DataFrame, tokenizer: str, kind: str, chunk: int, overlap: int) -> DataFrame:
    def cut(batches):
        for b in batches:
            for k, t, d in zip(b.column("k"), b.column("t"), b.column("digest"), strict=True):
                text = t.as_py()
                n = max(1, -(-(len(text) - overlap) // (chunk - overlap)))
                for part in range(n):
                    at = part * (chunk - overlap)
                    piece = text[at : at + chunk]
                    yield pa.record_batch([pa.array([k.as_py()], b.column("k").type), pa.array([d.as_py()]), pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([at], pa.int64()), pa.array([piece], pa.string())], ["k", "digest", "part", "parts", "at", "piece"])

    def encode(batches):
        tok = load(tokenizer)
        for b in batches:
            cols = {c: [] for c in ("n_bytes", "n", "head", "head_n", "tail", "tail_n")}
            for part, parts, at, piece in zip(*(b.column(c).to_pylist() for c in ("part", "parts", "at", "piece")), strict=True):
                e = tok.encode(piece, add_special_tokens=False)
                ids, offsets = e.word_ids, e.offsets
                head, tail = [], []
                for i in range(1, len(ids)):
                    p = offsets[i][0]
                    if ids[i] != ids[i - 1] and offsets[i - 1][1] == p:
                        if part and p <= overlap:
                            head.append((at + p, i))
                        if part < parts - 1 and len(piece) - overlap <= p < len(piece) - MARGIN:
                            tail.append((at + p, i))
                own = piece if part == parts - 1 else piece[: chunk - overlap]
                for c, v in (("n_bytes", len(own.encode())), ("n", len(ids)), ("head", [p for p, _ in head]), ("head_n", [i for _, i in head]), ("tail", [p for p, _ in tail]), ("tail_n", [i for _, i in tail])):
                    cols[c].append(v)
            kept = [b.column(c) for c in ("k", "digest", "part", "parts")]
            ints = pa.list_(pa.int64())
            yield pa.record_batch([*kept, pa.array(cols["n_bytes"], pa.int64()), pa.array(cols["n"], pa.int64()), *(pa.array(cols[c], ints) for c in ("head", "head_n", "tail", "tail_n"))], ["k", "digest", "part", "parts", *cols])

    parts = keyed.agg(F.sum(F.ceil(F.length("t") / (chunk - overlap)))).first()[0] or 1
    chunks = keyed.mapInArrow(cut, f"k {kind}, digest string, part int, parts int, at long, piece string").repartition(max(1, min(int(parts), TASKS)), "digest", "k", "part")
    seen = chunks.mapInArrow(encode, f"k {kind}, digest string, part int, parts int, n_bytes long, n long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>")
    once = seen.groupBy("k", "digest", "part").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("parts", "n_bytes", "n", "head", "head_n", "tail", "tail_n")))
    w = Window.partitionBy("k", "digest").orderBy("part")
    met = once.withColumn("cut", F.array_max(F.array_intersect("tail", F.lead("head").over(w)))).withColumn("from", F.lag("cut").over(w))
    upto = F.when(F.col("part") == F.col("parts") - 1, F.col("n")).otherwise(F.get("tail_n", (F.array_position("tail", F.col("cut")) - 1).cast("int")))
    since = F.when(F.col("part") == 0, F.lit(0)).otherwise(F.get("head_n", (F.array_position("head", F.col("from")) - 1).cast("int")))
    own = met.withColumn("own", upto - since)
    whole = F.count("*") == F.count("own")  # a chunk without a common boundary has no count
    counted = own.groupBy("k", "digest").agg(F.sum("n_bytes").alias("n_bytes"), F.when(whole, F.sum("own")).alias("n_tokens"), F.first("copies").alias("copies"))
    sizes = keyed.select(F.col("k").alias("sk"), F.col("digest").alias("sd"), F.octet_length("t").alias("size")).distinct()
    told = counted.join(sizes, counted["k"].eqNullSafe(sizes["sk"]) & (counted["digest"] == sizes["sd"]))
    right = F.when(F.col("n_bytes") == F.col("size"), F.col("n_bytes")).otherwise(F.raise_error(F.lit("chunks do not make up their text")).cast("long"))
    return told.select("k", "digest", right.alias("n_bytes"), "n_tokens", "copies")
