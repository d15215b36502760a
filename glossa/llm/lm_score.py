"""Language-model scores from an Elias-Fano n-gram trie.

The model is a trigram model with Dirichlet smoothing towards bigrams, and those towards add-one unigrams:
P1(w) = (c(w) + 1) / (N + V + 1), P2(w | h) = (c(h, w) + MU * P1(w)) / (c(h) + MU),
P3(w | g, h) = (c(g, h, w) + m * P2(w | h)) / (c(g, h) + m), m = THIRD * (c(h) + MU).
As m is in proportion to the denominator of P2, the numerator of P3 is c(g, h, w) + THIRD * (c(h, w) + MU * P1(w)),
all of it counts of w's own shard, and its denominator c(g, h) + THIRD * (c(h) + MU) is one of h's own shard.
Without a third weight the model is P2.
The trie runs backwards: words, under each word the words before it, and under each of those the words
before that. Words and contexts are Elias-Fano sequences; the contexts of a word are numbers in a range that starts where the last word's
range ended, so one monotone sequence holds all of them and a lookup is a successor search relative to
the range. Ranges are monotone pointers, again Elias-Fano; smoothed values are 16-bit steps of
1 / STEPS in log10. Levels lie in one memory map.

The trie is cut into shards by word, and both the counts and the texts' own n-grams come to the shard
in packed blocks, so no task needs the whole model. A word with more occurrences than an eighth of a
full shard's is spread over the shards by its context, and a pair with as many by the word before it;
only these words and pairs, at most eight for each shard, are broadcast with their counts. A token of
them costs a shard three bytes, so a triple is not spread. From a shard come sums for the documents that
have a token there, so both shuffles are in proportion to the tokens at any number of shards.

Nulls and odd inputs: a null text is empty and has the end token alone; a null id counts as the empty
text in its crc32; rows that repeat an id are scored one by one; without training rows every word is
unknown; an empty table gives no rows.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import crc_mod, crc_mod_col, materialize, release
from glossa.llm.words import hash_words, mix, text_batches

MU = 1000.0
THIRD = 0.002  # of 0.0005 to 0.5 the weight with the highest held-out score at sf0.1
STEPS = 4096
SHARD_BYTES = 16 << 20
PARTS = 8  # of a shard, by hash; its task works on one at a time
HOT_BYTES = 48  # a word of six bytes, an eighth of a shard
BLOCK_TOKENS, BLOCK_DOCS = 500_000, 60_000
END, START, BEFORE = 1, 2, 3  # hashes of the end token, of the context before the first word and of the one before that; words have none below 4


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_POPCOUNT = _BITS.sum(axis=1, dtype=np.uint8)
_SELECT = np.argsort(1 - _BITS, axis=1, kind="stable")  # position of the k-th one of a byte


class EliasFano:
    """A non-decreasing sequence of integers below 2**63, read through arrays that may be memory-mapped."""

    def __init__(self, parts: dict[str, np.ndarray], n: int, low_bits: int) -> None:
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.rank = parts["low"], parts["high"], parts["rank"]

    @staticmethod
    def encode(values: np.ndarray) -> tuple[dict[str, np.ndarray], int, int]:
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        low_bits = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        high = (values >> low_bits) + np.arange(n)
        bits = np.zeros((int(high[-1]) + 2 if n else 2) + 64 & ~63, np.uint8)
        bits[high] = 1
        words = np.packbits(bits, bitorder="little")
        rank = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(axis=1, dtype=np.int64))])
        low = np.zeros((n, low_bits), np.uint8)
        for b in range(low_bits):
            low[:, b] = values >> b & 1
        return {"low": np.concatenate([np.packbits(low.ravel(), bitorder="little"), np.zeros(8, np.uint8)]), "high": words, "rank": rank}, n, low_bits

    def _select(self, i: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the i-th (from 0) one or zero of the high bits: its word by the ranks, its byte by popcounts, its bit by a table."""
        before = self.rank if ones else np.arange(len(self.rank)) * 64 - self.rank
        word = np.minimum(np.searchsorted(before, i, side="right") - 1, len(self.rank) - 2)
        octets = self.high.reshape(-1, 8)[word]
        if not ones:
            octets ^= 255
        left = (i - before[word]).astype(np.uint8)
        upto = np.cumsum(_POPCOUNT[octets], axis=1, dtype=np.uint8)
        octet = np.minimum((upto <= left[:, None]).sum(axis=1), 7)
        row = np.arange(len(i))
        own = octets[row, octet]
        return word * 64 + octet * 8 + _SELECT[own, (left - upto[row, octet] + _POPCOUNT[own]) & 7]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bit = i * self.low_bits
        byte, out = bit >> 3, np.zeros(len(i), np.uint64)
        for k in range(8):
            out |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        return (out >> (bit & 7).astype(np.uint64)).astype(np.int64) & ((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        return (self._select(i, True) - i << self.low_bits) | self._lows(i)

    def find(self, values: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Index of each value, between first and end where given; -1 where it isn't there."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        bucket = values >> self.low_bits
        buckets = len(self.rank) * 64 - 64 - self.n  # zeros of the high bits
        inside = bucket < buckets
        b = np.where(inside, bucket, 0)
        lo = np.where(b > 0, self._select(np.maximum(b - 1, 0), False) - b + 1, 0)
        hi = self._select(b, False) - b
        if first is not None:
            lo, hi = np.maximum(lo, first), np.minimum(hi, end)
        hi = np.minimum(np.where(inside, hi, lo), self.n)
        want, last = values & ((1 << self.low_bits) - 1), hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:  # the successor among the bucket's low bits
            mid = (lo[open_] + hi[open_]) // 2
            less = self._lows(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        hit = lo < last
        hit[hit] = self._lows(lo[hit]) == want[hit]
        return np.where(hit, lo, -1)


def _level(owner: np.ndarray, context: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges and bases of n owners, and the monotone sequence of their contexts' numbers, which are sorted by (owner, context)."""
    counts = np.bincount(owner, minlength=n)
    ends = np.cumsum(counts)
    highest = np.zeros(n, np.int64)
    some = counts > 0
    highest[some] = context[ends[some] - 1] + 1
    base = np.cumsum(highest) - highest
    return np.concatenate([[0], ends]), base, base[owner] + context if len(owner) else np.empty(0, np.int64)


class Trie:
    """The words of a shard and their contexts in training, in one memory map; use it in a with statement."""

    def __init__(self, words: np.ndarray, backoff: np.ndarray, owner: np.ndarray, contexts: np.ndarray, values: np.ndarray, third: tuple[np.ndarray, ...] | None = None) -> None:
        """words: sorted; backoff: by word; owner, contexts, values: of each pair, sorted by (owner, context).

        third: the pair, the word before it and the value of each triple, sorted by (pair, word before), and the backoff of each pair.
        """
        names, context = np.unique(contexts, return_inverse=True)
        ranges, bases, numbers = _level(owner, context, len(words))
        levels = {"words": words, "ranges": ranges, "bases": bases, "names": names, "contexts": numbers}
        flat = {"backoff": backoff, "values": values}
        if third:
            names, context = np.unique(third[1], return_inverse=True)
            ranges, bases, numbers = _level(third[0], context, len(owner))
            levels |= {"ranges3": ranges, "bases3": bases, "names3": names, "contexts3": numbers}
            flat |= {"values3": third[2], "backoff2": third[3]}
        parts, sizes = {}, {}
        for name, x in levels.items():
            arrays, n, low_bits = EliasFano.encode(np.asarray(x, np.int64))
            sizes[name] = n, low_bits
            parts |= {(name, k): v for k, v in arrays.items()}
        parts |= {("", k): v.astype(np.uint16) for k, v in flat.items()}
        self.map = mmap.mmap(-1, sum(v.nbytes + 8 for v in parts.values()) + 8)
        at, views = 0, {}
        for key, v in parts.items():
            views[key] = np.frombuffer(self.map, v.dtype, len(v), at)
            views[key][:] = v
            at += v.nbytes + 7 & ~7
        self.sequences = {name: EliasFano({k: views[name, k] for k in ("low", "high", "rank")}, *size) for name, size in sizes.items()}
        self.steps = {k: views["", k] for k in flat}

    def __enter__(self) -> Trie:
        return self

    def __exit__(self, *_) -> None:
        del self.sequences, self.steps, self.map  # the map closes with its last view

    def pairs(self, words: np.ndarray, owner: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Number of each pair (words[owner], context), -1 where it isn't there; every word and context is found once."""
        return self._find("", self.sequences["words"].find(words), owner, contexts)

    def triples(self, pairs: np.ndarray, owner: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Number of each triple (pair number pairs[owner], word before), -1 where it isn't there."""
        return self._find("3", pairs, owner, before)

    def _find(self, level: str, node: np.ndarray, owner: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        ranges, bases, names, numbers = (self.sequences[k + level] for k in ("ranges", "bases", "names", "contexts"))
        known = np.maximum(node, 0)
        base, first, end = (s.access(known + i) if bases.n else known for s, i in ((bases, 0), (ranges, 0), (ranges, 1)))
        distinct, at = np.unique(contexts, return_inverse=True)
        name = names.find(distinct)[at]
        out, there = np.full(len(owner), -1, np.int64), np.flatnonzero((node[owner] >= 0) & (name >= 0))
        o = owner[there]
        out[there] = numbers.find(base[o] + name[there], first[o], end[o])
        return out


def _steps(x: np.ndarray) -> np.ndarray:
    return np.rint(x * STEPS).astype(np.int64)


def token_arrays(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, context and text number of every token, the end tokens included, as integers below 2**63."""
    words, at = hash_words(texts)
    lengths = np.diff(at)
    n = len(words) + len(texts)
    last = np.cumsum(lengths + 1) - 1
    is_end = np.zeros(n, bool)
    is_end[last] = True
    w = np.empty(n, np.int64)
    w[is_end] = END
    w[~is_end] = np.maximum((words >> np.uint64(1)).astype(np.int64), 4)
    h = np.empty(n, np.int64)
    h[1:] = w[:-1]
    h[last - lengths] = START
    return w, h, np.repeat(np.arange(len(texts)), lengths + 1)


def _spread(w: np.ndarray, shards: int) -> np.ndarray:
    return (mix(w.astype(np.uint64)) % np.uint64(shards)).astype(np.int32)


def _bytes(counts: np.ndarray) -> np.ndarray:
    """Each count as bytes that add up to it, the last one below 255."""
    times = counts // 255 + 1
    out = np.full(times.sum(), 255, np.uint8)
    out[np.cumsum(times) - 1] = counts % 255
    return out


def _short(w: np.ndarray) -> np.ndarray:
    """40 bits of a context's hash, which have to differ among the contexts of one word only; of words before a pair the lower 32 are told."""
    return (mix(w.astype(np.uint64)) >> np.uint64(24)).astype(np.int64)


def _sorted_numbers(x: np.ndarray, top: int) -> np.ndarray:
    """The stable order of integers from 0 to top - 1."""
    n = len(x)
    return np.sort(x * n + np.arange(n)) % n if n and top * n < 1 << 62 else np.argsort(x, kind="stable")


def vocabulary(docs: DataFrame, shards: int, often: int, id_col: str, text_col: str, folds: int, held: int) -> tuple[int, int, int, dict[int, int]]:
    """(documents, tokens, distinct tokens) of the training rows, and the counts of the words that occur more than `often` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_parts, size = [], 0

        def flush() -> pa.RecordBatch:
            words, counts = np.unique(np.concatenate(held_parts), return_counts=True)
            words, counts = np.repeat(words, counts // 255 + 1), _bytes(counts)
            shard = _spread(words, shards)
            order = np.argsort(shard, kind="stable")
            words, counts, shard = words[order], counts[order], shard[order]
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            some = np.flatnonzero(np.diff(cuts))
            return pa.record_batch([pa.array(some, pa.int32()), pa.array([words[cuts[s] : cuts[s + 1]].tobytes() for s in some], pa.binary()), pa.array([counts[cuts[s] : cuts[s + 1]].tobytes() for s in some], pa.binary())], names=["shard", "words", "counts"])

        for _, texts in text_batches(batches, 0):
            held_parts.append(token_arrays(texts)[0])
            size += len(held_parts[-1])
            if size >= BLOCK_TOKENS:
                yield flush()
                held_parts, size = [], 0
        if size:
            yield flush()

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        words = np.frombuffer(b"".join(pdf.words), np.int64)
        counts = np.frombuffer(b"".join(pdf["counts"]), np.uint8)
        names, at = np.unique(words, return_inverse=True)
        sums = np.bincount(at, counts).astype(np.int64)
        told = (sums > often) | (names == END)
        return pd.DataFrame({"word": np.append(names[told], -1), "n": np.append(sums[told], sums.sum()), "distinct": np.append(np.zeros(told.sum(), np.int64), len(names))})

    training = docs.where(crc_mod_col(F.col(id_col), folds) != held)
    stats = training.select(text_col).mapInArrow(count, "shard int, words binary, counts binary").groupBy("shard").applyInPandas(total, "word long, n long, distinct long")
    stats = materialize(stats, "lm-words")
    tokens, distinct = stats.where("word < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    hot = {r.word: r.n for r in stats.where((F.col("word") >= 0) & (F.col("n") > often)).select("word", "n").collect()}
    ends = stats.where(F.col("word") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    release(stats)
    return ends, tokens, distinct, hot


def _hot_at(hot_words: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where word and context are both hot, and there the number of the pair among all pairs of hot words."""
    there = np.flatnonzero(np.isin(w, hot_words) & np.isin(h, hot_words))
    return there, np.searchsorted(hot_words, w[there]) * len(hot_words) + np.searchsorted(hot_words, h[there])


def hot_pairs(docs: DataFrame, hot: dict[int, int], often: int, id_col: str, text_col: str, folds: int, held: int) -> dict[tuple[int, int], int]:
    """Counts of the (word, context) pairs that occur more than `often` times in the training rows; both of their words do so too."""
    hot_words = np.array(sorted(hot), np.int64)
    if not len(hot_words):
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for _, texts in text_batches(batches, 0):
            w, h, _ = token_arrays(texts)
            for pair, n in zip(*(x.tolist() for x in np.unique(_hot_at(hot_words, w, h)[1], return_counts=True)), strict=True):
                sums[pair] = sums.get(pair, 0) + n
        yield pa.record_batch([pa.array(sums.keys(), pa.int64()), pa.array(sums.values(), pa.int64())], names=["pair", "n"])

    training = docs.where(crc_mod_col(F.col(id_col), folds) != held)
    counts = training.select(text_col).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") > often)
    return {(int(hot_words[r.pair // len(hot_words)]), int(hot_words[r.pair % len(hot_words)])): r.n for r in counts.collect()}


_PACKET = "shard int, block long, home binary, parts binary, levels binary, docs binary, words binary, contexts binary, contexts_high binary, before binary"


def packets(docs: DataFrame, shards: int, hot: list[int], pairs: list[tuple[int, int]], id_col: str, text_col: str, folds: int, held: int, third: bool) -> DataFrame:
    """Each block of documents as one row for each shard that some of its n-grams go to.

    The tokens of a row are sorted by (part of the shard, word, context, word before), and `parts` says where
    each part ends; `docs` has the document of each token, and `levels` whether the token is the first with its
    word (3), pair (2), triple (1) or none of them (0), plus 4 where its document teaches. One row of each
    block, not always of the same shard, holds the ids.
    """
    every = shards * PARTS
    hot_words = np.array(sorted(hot), np.int64)
    hot_pair = np.sort(np.array([np.searchsorted(hot_words, w) * len(hot_words) + np.searchsorted(hot_words, h) for w, h in pairs], np.int64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ids, size, number = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            block = (TaskContext.get().partitionId() << 24) + number
            w, h, d = (np.concatenate(x) for x in zip(*parts, strict=True))
            taught = np.array([crc_mod(i, folds) != held for i in ids], bool)
            names, word_at = np.unique(w, return_inverse=True)
            contexts, context_at = np.unique(h, return_inverse=True)
            before_at, befores = np.zeros(len(w), np.int64), np.append(_short(contexts), _short(np.array([BEFORE])))
            if third:
                before_at[1:] = context_at[:-1]
                before_at[h == START] = len(contexts)
            parts.clear()
            del w, h
            word_at *= len(contexts)
            word_at += context_at
            pair, pair_at = np.unique(word_at, return_inverse=True)
            del word_at, context_at
            pair_word, pair_context = pair // len(contexts), pair % len(contexts)
            part_of = _spread(names, every)[pair_word]
            spread = np.isin(names, hot_words)[pair_word]
            mixed = names[pair_word] ^ (contexts[pair_context] << 1)
            part_of[spread] = _spread(mixed[spread], every)
            part = part_of[pair_at]
            if len(hot_pair):
                there, k = _hot_at(hot_words, names[pair_word], contexts[pair_context])
                spread = np.zeros(len(pair), bool)
                spread[there[np.isin(k, hot_pair)]] = True
                at = np.flatnonzero(spread[pair_at])
                part[at] = _spread(mixed[pair_at[at]] ^ (befores[before_at[at]] << 2), every)
            key = pair_at * len(befores) + before_at
            order = _sorted_numbers(key, len(pair) * len(befores))
            by_part = part[order].astype(np.uint16 if every <= 1 << 16 else np.int64)
            order = order[np.argsort(by_part, kind="stable")].astype(np.int32)
            key, by_part, of_pair = key[order], part[order], pair_at[order].astype(np.int32)
            del part, pair_at
            of_word = pair_word[of_pair].astype(np.int32)
            other = lambda x: np.concatenate([[True], (x[1:] != x[:-1]) | (by_part[1:] != by_part[:-1])])
            new_triple, new_pair, new_word = other(key), other(of_pair), other(of_word)
            level = new_triple.astype(np.uint8) + new_pair + new_word + (taught[d[order]] * np.uint8(4))
            part_cuts = np.searchsorted(by_part, np.arange(every + 1))
            cuts = part_cuts[::PARTS]
            some = np.flatnonzero(np.diff(cuts))

            def column(values: np.ndarray, new: np.ndarray | None = None) -> pa.Array:
                at = cuts if new is None else np.concatenate([[0], np.cumsum(new)])[cuts]
                return pa.array([values[at[s] : at[s + 1]].tobytes() for s in some], pa.binary())

            before, context = befores[before_at[order[new_triple]]], befores[pair_context[of_pair[new_pair]]]
            home = [None] * len(some)
            home[block % len(some)] = _home(ids, taught, np.bincount(d, minlength=len(ids)))
            return pa.record_batch([
                pa.array(some, pa.int32()), pa.array(np.full(len(some), block), pa.int64()), pa.array(home, pa.binary()), pa.array([(part_cuts[s * PARTS + 1 : (s + 1) * PARTS + 1] - cuts[s]).astype(np.uint32).tobytes() for s in some], pa.binary()),
                column(level), column(d[order].astype(np.uint16)),
                column(names[of_word[new_word]], new_word), column(context.astype(np.uint32), new_pair), column((context >> 32).astype(np.uint8), new_pair),
                column(before.astype(np.uint32), new_triple),
            ], names=[c.split()[0] for c in _PACKET.split(", ")])

        for batch, texts in text_batches(batches, 1, 1 << 20):
            w, h, d = token_arrays(texts)
            if ids and (size + len(w) > BLOCK_TOKENS or len(ids) + len(texts) > BLOCK_DOCS):
                yield flush()
                parts, ids, size, number = [], [], 0, number + 1
            parts.append((w, h, d + len(ids)))
            ids += batch.column(0).to_pylist()
            size += len(w)
        if ids:
            yield flush()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, _PACKET)


def _home(ids: list[int | None], taught: np.ndarray, tokens: np.ndarray) -> bytes:
    """What a block knows of its documents by itself, as one Arrow message."""
    batch = pa.record_batch([pa.array(ids, pa.int64()), pa.array(taught), pa.array(tokens, pa.int64())], names=["id", "taught", "n"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Packet:
    """A row of `packets` over the shared memory of its record batch, and what its documents have gained in the parts so far."""

    def __init__(self, row: dict[str, pa.Scalar]) -> None:
        read = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)
        self.block, self.home = row["block"].as_py(), row["home"].as_py()
        self.levels, self.docs, self.words = read("levels", np.uint8), read("docs", np.uint16), read("words", np.int64)
        self.contexts, self.contexts_high, self.before = read("contexts", np.uint32), read("contexts_high", np.uint8), read("before", np.uint32)
        self.ends = np.concatenate([[0], read("parts", np.uint32).astype(np.int64)])
        first = np.array([np.bincount(self.levels[a:b] & 3, minlength=4) for a, b in zip(self.ends, self.ends[1:], strict=False)])
        at_least = np.cumsum(first[:, ::-1], axis=1)[:, ::-1]  # tokens of level 0, 1, 2, 3 and above
        self.at = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(at_least, axis=0)])
        self.sums: list[tuple[np.ndarray, ...]] = []

    def part(self, k: int) -> Part | None:
        """The k-th part of the row, None if it is empty."""
        (t, a, b, c), (t_end, a_end, b_end, c_end) = self.at[k], self.at[k + 1]
        if t == t_end:
            return None
        contexts = self.contexts_high[b:b_end].astype(np.int64) << 32 | self.contexts[b:b_end]
        return Part(self, self.levels[t:t_end], self.docs[t:t_end], self.words[c:c_end], contexts, self.before[a:a_end])


class Part:
    """The tokens of a packet in a part: `first` of each triple, the pair of each triple, the word of each pair, the training tokens of each triple."""

    def __init__(self, packet: Packet, levels: np.ndarray, docs: np.ndarray, words: np.ndarray, contexts: np.ndarray, before: np.ndarray) -> None:
        self.packet, self.docs, self.words, self.contexts, self.before = packet, docs, words, contexts, before
        level = levels & 3
        first = np.flatnonzero(level)
        of_triple = level[first]
        self.times = np.diff(first, append=len(levels)).astype(np.int32)
        self.triple_pair = (np.cumsum(of_triple >= 2) - 1).astype(np.int32)
        self.pair_word = (np.cumsum(of_triple[of_triple >= 2] == 3) - 1).astype(np.int32)
        self.taught = np.add.reduceat(levels >> 2, first, dtype=np.int32)


def _distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (high, low) in order, as two arrays, and the number of each input among them; high counts from 0."""
    names, at = np.unique(low, return_inverse=True)
    at += high * len(names)
    keys, number = np.unique(at, return_inverse=True)
    return keys // len(names), names[keys % len(names)].astype(np.int64), number


def shard_scorer(tokens: int, distinct: int, hot: dict[int, int], pairs: dict[tuple[int, int], int], mu: float, third: float | None):
    """A function from the packets of a shard to the shard's share of the sums, for those documents that have any of its tokens."""
    hot_words = np.array(sorted(hot), np.int64)
    contexts = _short(np.array([h for _, h in pairs], np.int64))
    hot_pair = {(w, int(c)): n for (w, _), c, n in zip(pairs, contexts, pairs.values(), strict=True)}

    def score(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packets = [Packet(r) for b in batches for r in _rows(b)]
        for k in range(PARTS):
            score_part([part for p in packets if (part := p.part(k))])
        for packet in packets:
            docs, gained, base, unknown = (np.concatenate(x) for x in zip(*packet.sums, strict=True))
            there, at = np.unique(docs, return_inverse=True)
            sums = np.bincount(at, gained).astype(np.int64)  # whole numbers below 2**53
            unknown = np.bincount(at, unknown).astype(np.uint32)
            some = np.flatnonzero(unknown)
            narrow = np.int32 if np.abs(sums).max() < 1 << 31 else np.int64
            values = [there, sums.astype(narrow), np.bincount(at, base), there[some], unknown[some]]
            yield pa.record_batch([pa.array([packet.block]), pa.array([key[0].as_py()], pa.int32()), pa.array([packet.home], pa.binary()), *(pa.array([v.tobytes()], pa.binary()) for v in values)], names=[c.split()[0] for c in _SUMS.split(", ")])

    def score_part(parts: list[Part]) -> None:
        if not parts:
            return
        starts = lambda name: np.cumsum([0] + [len(getattr(x, name)) for x in parts])[:-1]
        every = lambda name: np.concatenate([getattr(x, name) for x in parts])
        words, word_at = np.unique(every("words"), return_inverse=True)
        pair_of = np.concatenate([word_at[first + x.pair_word] for first, x in zip(starts("words"), parts, strict=True)])
        at, h, pair_number = _distinct(pair_of, every("contexts"))
        triple_of = np.concatenate([pair_number[first + x.triple_pair] for first, x in zip(starts("contexts"), parts, strict=True)])
        p, g, triple_number = _distinct(triple_of, every("before"))
        triple_count = np.bincount(triple_number, every("taught"), len(p)).astype(np.int64)
        pair_count = np.bincount(p, triple_count, len(at)).astype(np.int64)
        count = np.bincount(at, pair_count, len(words)).astype(np.int64)
        if hot:  # spread over all shards, so counted before
            i = np.flatnonzero(np.isin(words, hot_words))
            count[i] = [hot[x] for x in words[i].tolist()]
            for i in np.flatnonzero(np.isin(words, hot_words)[at] & np.isin(h, contexts)):
                pair_count[i] = hot_pair.get((int(words[at[i]]), int(h[i])), pair_count[i])
        unigram = np.log10((count + 1) / (tokens + distinct + 1))
        gained = _gains(words, at, h, p, g, count, pair_count, triple_count, unigram, mu, third)
        more, unknown = np.log10(count + 1.0), count == 0
        for first, x in zip(starts("before"), parts, strict=True):
            triple = triple_number[first : first + len(x.before)]
            word, gain = np.repeat(at[p[triple]], x.times), np.repeat(gained[triple], x.times)
            there, doc = np.unique(x.docs, return_inverse=True)
            x.packet.sums.append((there, np.bincount(doc, gain), np.bincount(doc, more[word]), np.bincount(doc, unknown[word])))

    return score


_SUMS = "block long, shard int, home binary, docs binary, score binary, base binary, unknown_docs binary, unknown binary"


def _rows(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Scalar]]:
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}


def _gains(words: np.ndarray, at: np.ndarray, h: np.ndarray, p: np.ndarray, g: np.ndarray, count: np.ndarray, pair_count: np.ndarray, triple_count: np.ndarray, unigram: np.ndarray, mu: float, third: float | None) -> np.ndarray:
    """For each triple (pair p, word before g) what a token of it adds to a score, in steps, by a trie of those seen in training."""
    low = _steps(unigram + np.log10(mu))
    seen = np.flatnonzero(pair_count)
    value = _steps(np.log10(pair_count[seen] + mu * 10.0 ** unigram[at[seen]]))
    known = np.flatnonzero(count)
    place = np.full(len(words), -1)
    place[known] = np.arange(len(known))
    more = None
    if third:
        seen3 = np.flatnonzero(triple_count)
        number_of_pair = np.cumsum(pair_count > 0) - 1
        value3 = _steps(np.log10(triple_count[seen3] + third * (pair_count[p[seen3]] + mu * 10.0 ** unigram[at[p[seen3]]])))
        more = number_of_pair[p[seen3]], g[seen3], value3, _steps(np.log10(pair_count[seen] + third * (count[at[seen]] + mu)))
    with Trie(words[known], _steps(np.log10(count[known] + mu)), place[at[seen]], h[seen], value, more) as trie:
        found = trie.pairs(words, at, h)
        there = found >= 0
        after = np.full(len(words), _steps(np.log10(mu)))
        after[known] = trie.steps["backoff"]
        numerator, after = low[at], after[at]
        numerator[there] = trie.steps["values"][found[there]]
        if third:
            less = _steps(np.log10(third))
            after += less
            after[there] = trie.steps["backoff2"][found[there]]
            found3 = trie.triples(found, p, g)
            there = found3 >= 0
            numerator = numerator[p] + less
            numerator[there] = trie.steps["values3"][found3[there]]
    after[words[at] == END] = 0  # nothing follows the end
    return numerator - after[p] if third else (numerator - after)[p]


def shard_sums(docs: DataFrame, shards: int, often: int, split: tuple[str, str, int, int], mu: float, third: float | None) -> tuple[DataFrame, int, int, int]:
    """The sums of each block from each shard, and the documents, tokens and distinct tokens of the training rows."""
    n_docs, tokens, distinct, hot = vocabulary(docs, shards, often, *split)
    pairs = hot_pairs(docs, hot, often, *split) if third else {}
    cut = packets(docs, shards, list(hot), list(pairs), *split, bool(third))
    return cut.groupBy("shard").applyInArrow(shard_scorer(tokens, distinct, hot, pairs, mu, third), _SUMS), n_docs, tokens, distinct


def score_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, mu: float = MU, third: float | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10); of trigrams with the weight `third`, else of bigrams.

    A shard has about `shard_bytes` of text; words and pairs with more occurrences than `shard_bytes` / HOT_BYTES are spread over the shards.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    shards, often = max(12, -(-size // shard_bytes)), max(1, shard_bytes // HOT_BYTES)
    sums, n_docs, tokens, distinct = shard_sums(docs, shards, often, (id_col, text_col, folds, held), mu, third)
    first = int(_steps(np.log10(np.array([n_docs + third * (n_docs + mu) if third else n_docs + mu])))[0])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        with pa.ipc.open_stream(pdf.home.dropna().iloc[0]) as stream:
            home = stream.read_all()
        read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in pdf[name]])
        n, docs = home.column("n").to_numpy(), read("docs", np.uint16)
        narrow = [np.int32 if len(s) == 2 * len(d) else np.int64 for s, d in zip(pdf.score, pdf.docs, strict=True)]
        gained = np.concatenate([np.frombuffer(s, kind) for s, kind in zip(pdf.score, narrow, strict=True)])
        add = lambda at, values: np.bincount(at, values, len(n))
        return pd.DataFrame({
            "doc_id": home.column("id").to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get), "held_out": ~home.column("taught").to_numpy(), "n_tokens": n,
            "n_known": n - add(read("unknown_docs", np.uint16), read("unknown", np.uint32)).astype(np.int64), "train_tokens": np.int64(tokens),
            "base_score": add(docs, read("base", np.float64)) - n * np.log10(tokens + distinct + 1.0), "score": (add(docs, gained) - first) / STEPS,
        })

    return sums.groupBy("block").applyInPandas(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
