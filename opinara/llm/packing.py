"""Packing by power-of-two decomposition: no padding, and no sequence crosses documents."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: Longest piece, and the id that ends a document.
LENGTH, END = 1024, 0
#: Names of the vocabulary files; the same vocabulary for either library.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Texts of these characters only, without a special token's mark, take the faster of the two libraries.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-ſก-๛‐-‧€]|<\|")
#: Documents for one part of each bucket of pieces of equal length.
PART = 10_000


@lru_cache(maxsize=4)
def _exact(vocabulary: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@lru_cache(maxsize=4)
def _fast(ranks: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)


def encode(text: str | None, vocabulary: str, ranks: str | None = None) -> list[int]:
    """Token ids without special tokens added; null gives none. Ids are those of ``vocabulary``; ``ranks`` only speeds up plain texts."""
    if not text:
        return []
    # either is loaded when a text needs it
    if not ranks or _PLAIN.search(text):
        return _exact(vocabulary).encode(text, add_special_tokens=False).ids
    return _fast(ranks).encode_ordinary(text)


def pieces(n: int, longest: int = LENGTH) -> Iterator[tuple[int, int]]:
    """(start, length): as many of the longest as fit, then the binary digits of the rest from high to low."""
    at = 0
    while n - at >= longest:
        yield at, longest
        at += longest
    size = longest >> 1
    while at < n:
        if n - at >= size:
            yield at, size
            at += size
        size >>= 1


def pack(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, longest: int = LENGTH, tokens: bool = True) -> DataFrame:
    """(doc_id, start, length, tokens, ids_crc32, doc_tokens, sequence_id, offset) of every piece of ``docs(doc_id, text)``.

    A document's ids, with END behind them, are cut into pieces whose lengths are powers of two, each a sequence of its own.
    Pieces of equal length are brought together in buckets, longest first: a bucket is dealt out by a hash of the document
    in parts of about PART documents, a part stands in one partition, sorted, and numbers its pieces, so sequence_id
    (bucket, part, number) rests on the documents alone, not on how the input is split, and rises within a document. offset is 0. ids_crc32 is the checksum of the ids as little-endian 32-bit
    numbers; without ``tokens`` the ids themselves are left out and only narrow rows are shuffled. A null or empty text is the
    single id END. Repeated rows are packed each; an empty table gives no rows; further columns are ignored. ``longest`` is a
    power of two.
    """
    own = paths()
    vocabulary, ranks = vocabulary or own[0], ranks if vocabulary else own[1]
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("_doc", pa.int64())] + [("tokens", pa.list_(pa.int32()))] * tokens)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held: list[np.ndarray] = []
            size = 0

            def flush() -> pa.RecordBatch:
                columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
                if tokens:
                    ends = np.cumsum([0] + [r[2] for r in rows], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held))))
                return pa.RecordBatch.from_arrays(columns, schema=kind)

            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py(), vocabulary, ranks), END], "<i4")
                whole = zlib.crc32(ids)
                rows += [(doc.as_py(), at, n, zlib.crc32(ids[at : at + n]), len(ids), whole) for at, n in pieces(len(ids), longest)]
                held.append(ids)
                size += len(ids)
                if size > 1 << 18:
                    yield flush()
                    rows, held, size = [], [], 0
            if rows:
                yield flush()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _doc long" + ", tokens array<int>" * tokens
    cut_rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)
    parts = max(1, docs.count() // PART)
    part = F.pmod(F.xxhash64("doc_id", "_doc"), F.lit(parts))
    number = F.row_number().over(W.partitionBy("length", "_part").orderBy("doc_id", "_doc", "start")) - 1
    bucket = (F.lit(longest.bit_length()) - F.length(F.bin("length"))).cast("long")
    numbered = cut_rows.withColumn("_part", part).withColumn("sequence_id", F.shiftleft(bucket, 58).bitwiseOR(F.shiftleft("_part", 32)).bitwiseOR(number))
    return numbered.withColumn("offset", F.lit(0).cast("long")).drop("_part", "_doc")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokens=False)
