"""Encoding, decoding and counting of tokens for every document of a table.

All functions read the columns ``doc_id`` and ``text`` only, so further columns (whatever their names) do no
harm. Null and empty texts give no tokens; repeated rows give repeated results; an empty table gives an empty
result. Each task streams slices of bounded size; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meshlake.llm import bpe
from meshlake.llm.columns import only
from meshlake.llm.textarrays import slices


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (array<int>): the tokens of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(vocabulary)
        for part in slices(batches):
            ids, counts = model.encode_texts(bpe.strings(part.column("text")))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, ids.astype(np.int32))], ["doc_id", "ids"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text: what ids stand for; bytes that are no UTF-8 become replacement characters, null ids an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(vocabulary)
        for batch in batches:
            ids = [np.array(x if x is not None else [], np.uint32) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.decode(x).decode("utf-8", "replace") for x in ids], pa.string())], ["doc_id", "text"])

    return only(encoded, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode every document in one pass and keep digests only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(vocabulary)
        for part in slices(batches):
            ids, counts = model.encode_texts(bpe.strings(part.column("text")))
            at = np.concatenate([[0], np.cumsum(counts)]).tolist()
            decoded = model.decode(ids)
            sizes = model.piece_starts[ids + np.uint32(1)] - model.piece_starts[ids]
            ends = np.concatenate([[0], np.cumsum(sizes)])[at].tolist()
            raw = ids.astype("<u4").tobytes()
            of_ids = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            of_texts = [hashlib.sha256(replaced(decoded[a:b])).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def replaced(data: bytes) -> bytes:
    """UTF-8 with replacement characters for what is none."""
    return data.decode("utf-8", "replace").encode()


def count(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: token counts, merging only pre-tokens not proven to be one token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        model = bpe.load(vocabulary)
        for part in slices(batches):
            counts = model.count_texts(bpe.strings(part.column("text")))
            size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
