"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read

#: Between a letter or digit, one space, and a letter or digit a byte-level BPE always starts a new piece.
SAFE = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def split_safely(text: str, most: int) -> list[str]:
    """Pieces of about ``most`` characters whose token counts add up to the text's; one piece where no boundary is safe."""
    out, at = [], 0
    while len(text) - at > most:
        m = SAFE.search(text, at + most - 1)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, batch_bytes: int = 1 << 20, piece_chars: int = 1 << 16) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs`` (doc_id, text; other columns are ignored).

    Texts go to the tokenizer in batches of about ``batch_bytes``; a longer text than ``piece_chars`` is split at
    boundaries that don't change its tokens. A null or empty text has 0 bytes and 0 tokens; repeated rows give
    repeated results. No shuffle: the result keeps the partitions of the input.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n_bytes, n_tokens = [0] * len(ids), [0] * len(ids)
            pieces: list[str] = []
            owners: list[int] = []
            size = 0

            def flush() -> None:
                for i, e in zip(owners, t.encode_batch(pieces, add_special_tokens=False), strict=True):
                    n_tokens[i] += len(e)
                pieces.clear()
                owners.clear()

            for i, s in enumerate(texts):
                text = s.as_py() or ""
                n_bytes[i] = len(text.encode())
                for p in split_safely(text, piece_chars):
                    pieces.append(p)
                    owners.append(i)
                    size += len(p)
                    if size >= batch_bytes:
                        flush()
                        size = 0
            flush()
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lengths, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
