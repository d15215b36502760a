"""Best-fit packing by minimum bin slack.

Documents are tokenised into pieces of at most `capacity` tokens. Only the histogram of piece lengths
(at most `capacity` rows) comes to the driver. For each bin the largest length left is fixed and a
bitset subset-sum over the other lengths finds the fullest feasible combination; it is taken as often
as the counts allow, which is what repeating the search bin by bin would do. Pieces then find their
place by their number within their length, so no task gathers a whole length.

Nulls and odd inputs: a null text is empty and gives one piece with the end token alone; rows that
repeat an id give their pieces again; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import buckets_for, materialize, rank_in_group

#: The ranks' regex overflows its stack on a run of 1,000,000 white-space characters and takes one of 600,000.
LONG_RUN = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _encoder(vocabulary: str, ranks: str):
    """Encode texts to ids; the same ids as the tokenizers library gives with `vocabulary`.

    The merge ranks of the same vocabulary run several times faster; texts that spell a special token,
    which the vocabulary's own file treats as one id, texts with a run of LONG_RUN white-space characters
    and texts on which the faster encoder panics go to the tokenizers library, whole.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    with open(public_tokenizers.path(ranks), "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    long_run = re.compile(rf"\s{{{LONG_RUN}}}")

    def encode(text: str) -> list[int]:
        if not any(s in text for s in special) and (len(text) < LONG_RUN or not long_run.search(text)):
            try:
                return fast.encode_ordinary(text)
            except BaseException as e:
                if type(e).__name__ != "PanicException":  # pyo3's, which is no Exception and can't be imported
                    raise
        return exact.encode(text, add_special_tokens=False).ids

    return encode


def piece_starts(n: int, capacity: int) -> list[int]:
    """Where the pieces of n ids start: only the first may be shorter than capacity, if there are several."""
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and with_ids the ids themselves."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, ranks)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                starts = piece_starts(len(ids), capacity)
                for piece, start in enumerate(starts):
                    part = ids[start : starts[piece + 1] if piece + 1 < len(starts) else len(ids)]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), *([part.tolist()] if with_ids else ())))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds[: len(names)], strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, schema)


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The lengths and how often each, of the fullest bin that holds the largest length left."""
    largest = max(counts)
    room, full = capacity - largest, (1 << (capacity - largest + 1)) - 1
    layers, reach = [], 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        if reach >> room & 1:
            break
        left = min(counts[length] - (length == largest), room // length)
        step = 1
        while left > 0:  # binary splitting of the multiplicity
            n = min(step, left)
            layers.append((length, n, reach))
            reach |= reach << (length * n) & full
            left -= n
            step *= 2
    at, used = reach.bit_length() - 1, {largest: 1}
    for length, n, before in reversed(layers):
        if not before >> at & 1:
            at -= length * n
            used[length] = used.get(length, 0) + n
    return sorted(used.items(), reverse=True)


def bin_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, end, bin, offset, each): pieces numbered first..end-1 of a length lie `each` to a bin from `bin` on."""
    counts = {k: v for k, v in histogram.items() if v}
    given: dict[int, int] = dict.fromkeys(counts, 0)
    plan, bins = [], 0
    while counts:
        used = fullest(counts, capacity)
        times = min(counts[k] // n for k, n in used)
        offset = 0
        for k, n in used:
            plan.append((k, given[k], given[k] + n * times, bins, offset, n))
            given[k] += n * times
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
            offset += k * n
        bins += times
    return plan


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to a materialized frame of pieces."""
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = pieces.sparkSession.createDataFrame(bin_plan(histogram, capacity), "length long, first long, end long, bin long, offset0 long, each long")
    ranked = rank_in_group(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "__n", buckets_for(sum(histogram.values())))
    n, k = F.col("__n"), F.col("__n") - F.col("first")
    placed = ranked.join(F.broadcast(plan), "length").where((n >= F.col("first")) & (n < F.col("end")))
    sequence = (F.col("bin") + F.floor(k / F.col("each"))).cast("long")
    return placed.select(*pieces.columns, sequence.alias("sequence_id"), (F.col("offset0") + k % F.col("each") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = 2048, with_ids: bool = False, **options) -> DataFrame:
    """Tokenise, cut and pack `docs`: one row per piece with its sequence and place."""
    return pack_pieces(materialize(token_pieces(docs, capacity=capacity, with_ids=with_ids, **options), "pack-pieces"), capacity)
