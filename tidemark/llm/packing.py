"""Pack token sequences by power-of-two decomposition: a document is cut into pieces of binary lengths, each a sequence."""

from __future__ import annotations

import base64
import functools

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

MOST = 1_024
END = 0
TOKENIZER = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
DOCS_A_BATCH = 64
#: Tokens of a batch of pieces of one length.
BATCH_TOKENS = 65_536


@functools.cache
def encoder(name: str = TOKENIZER):
    """Text to ids (uint32). Ids are those of ``tokenizers`` for ``<name>.json``; texts without the special token's string go
    through the same vocabulary's ranks in ``tiktoken``, which gives equal ids in a fifth of the time."""
    slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if SPECIAL not in text:
            return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def piece_lengths(n: int, most: int = MOST) -> list[int]:
    """As many pieces of ``most`` (a power of two) as fit, then the rest's binary digits, longest first."""
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if n % most >> k & 1]


def pack(docs: DataFrame, most: int = MOST, tokenizer: str = TOKENIZER, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """A row for each piece of each row of ``docs``: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens,
    bucket (log2 of the length), batch, place, sequence_id, offset.

    A document is its ids and a final id 0. Every piece's length is a power of two and the piece is a sequence of its
    own, so no sequence crosses documents and none needs padding. Each task buckets its pieces by length: ``batch`` numbers
    a batch of one bucket, of ``batch_tokens`` tokens but for the task's last of each bucket, and ``place`` is the piece's
    row in it. So batches need no shuffle; their numbers, like sequence_id's, hang on how the input is cut into tasks.
    Null and empty texts are the one id 0. Repeated rows each get pieces; an empty table gives none; other columns are ignored.
    """
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "bucket", "batch", "place"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]

    def pieces(batches):
        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        filled = [0] * most.bit_length()  # pieces so far, by bucket
        for big in batches:
            for at in range(0, big.num_rows, DOCS_A_BATCH):
                some, out = big.slice(at, DOCS_A_BATCH), []
                for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    data = encode(text or "").tobytes() + END.to_bytes(4, "little")
                    start = 0
                    for length in piece_lengths(len(data) // 4, most):
                        bucket = length.bit_length() - 1
                        batch, place = divmod(filled[bucket], max(1, batch_tokens // length))
                        filled[bucket] += 1
                        out.append((doc_id, start, length, data[4 * start : 4 * (start + length)], len(data) // 4, bucket, (task * 64 + bucket) << 32 | batch, place))
                        start += length
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int, batch long, place int")
    return cut.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
