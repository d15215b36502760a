"""Corpus operators on small tables with nulls, empty and long texts, ties, repeats, odd columns, against plain Python."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import ann, common, language, line_dedup, lm_score, media, mix_sources, near_dedup, pack, quality, shard, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside or return, present in the input as well
EXTRA = ["size", "key", "node", "label", "score", "hash", "shard", "n", "__id", "rank", "target"]


def rows(n=60, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(rng.randint(6, 80))) for _ in range(n)]
    shared = "A line that many documents have in common"
    out = []
    for i, t in enumerate(base):
        if i % 7 == 1:
            t = base[i - 1].replace(" ", "\n", 1)
        if i % 5 == 2:
            t = base[i - 2] + " " + word()
        if i % 4 == 0:
            t += f"\n  {shared.upper() if i % 8 else shared}\t\n{word()}"
        out.append((i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "ä", None]), len(t)))
    out += [(900, None, "en", "a", None), (901, "", None, None, 0), (902, " \n\t ", "fr", "b", 4), (903, "One", "en", "b", 3), (904, base[0], None, None, 1), (904, base[0], None, None, 1)]
    out += [(905, " ".join(word() for _ in range(30_000)), "fr", "a", 1), (906, "x" * 200_000, "fr", "a", 1), (907, "1234 5678 !!", "en", None, 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in EXTRA]).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def tokens(text):
    return (text or "").encode().translate(LOWER).split()


def shingles(text):
    w = tokens(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_hash_words_equals_split():
    texts = [(t or "").encode() for _, t, *_ in rows()]
    h, at = words.hash_words(texts)
    assert np.diff(at).tolist() == [len(t.split()) for t in texts]
    every = [w for t in texts for w in t.translate(LOWER).split()]
    assert len(set(zip(every, h.tolist(), strict=True))) == len(set(every)) == len(set(h.tolist()))
    assert [len(s) for s in words.shingle_sets(texts)] == [len(shingles(t.decode())) for t in texts]


def test_words_across_slices(monkeypatch):
    text = b"abc " * 1000 + b"y" * 5000 + b" end"
    whole = words.hash_words([text, b"", b"tail"])
    monkeypatch.setattr(words, "SLICE", 64)
    cut = words.hash_words([text, b"", b"tail"])
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def brute_components(data):
    ids = sorted({d for d, *_ in data})
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t)) for d, t, *_ in data]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {d: find(d) for d in ids}


def test_near_dedup_equals_brute_force(docs):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    want = brute_components(rows())
    assert {k: r.component_id for k, r in got.items()} == want
    assert {k: r.n_shingles for k, r in got.items()} == {d: len(shingles(t)) for d, t, *_ in rows()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, v in want.items() if k == v}


def test_near_dedup_chains_need_tiles(spark):
    """A group in which neighbours are linked but most pairs are not, with its smallest id in the middle."""
    base = [f"w{i}" for i in range(200)]
    data = [((i * 37) % 101 + 1, " ".join(base[i:] + [f"z{j}" for j in range(i)])) for i in range(0, 100, 2)]
    got = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == brute_components(data)


def test_exact_bridges_over_several_tiles(spark, monkeypatch):
    """Texts just under the threshold (1,200 of 1,602 shingles shared) in a cluster of many tiles, and two that are over it."""
    monkeypatch.setattr(near_dedup, "TEXTS", 4)
    shared = [f"s{j}" for j in range(1204)]
    data = [(i, " ".join(shared + [f"d{i}x{j}" for j in range(201)])) for i in range(1, 13)]
    data += [(20, data[2][1] + " more"), (21, data[7][1] + " and more")]
    frame = lambda x, schema: spark.createDataFrame(x, schema)
    nodes, texts = frame([(d,) for d, _ in data], "node long"), frame(data, "node long, text string")
    bridges = frame([(1, d) for d, _ in data[1:]], "a long, b long")
    links = near_dedup.exact_bridges(bridges, frame([], "node long, label long"), nodes, texts, 75)
    want = brute_components(data)
    assert sorted(map(tuple, links.collect())) == sorted((v, k) for k, v in want.items() if k != v) == [(3, 20), (8, 21)]


def test_bucket_linked_but_for_two_costs_rows_in_proportion(spark):
    n = 3 * near_dedup.TILE
    regs = bytes(2 * near_dedup.M)
    nodes = spark.createDataFrame([(i, 9, bytearray(regs)) for i in range(n)], "node long, n_shingles long, regs binary")
    shared = nodes.select(F.lit(7).cast("long").alias("key"), "node", F.lit(0).cast("long").alias("leader"))
    labels = nodes.where(f"node < {n - 2}").select("node", F.lit(0).cast("long").alias("label"))
    tiles = near_dedup.bridge_tiles(shared, labels, nodes)
    assert tiles.where("not is_row").count() == n - 1  # each member but the leader once
    assert tiles.where("is_row").count() == 2 * 3  # the two others against three columns
    assert near_dedup.bridge_labels(shared, labels, nodes, 75).distinct().count() >= 2  # equal registers: both may be linked


def test_near_dedup_empty(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_joint_estimate():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8):
        pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
        n = int(2000 / (2 - share) * share) if share < 1 else 1000
        a, b = np.unique(pool[:1000]), np.unique(pool[1000 - n : 2000 - n])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        est = near_dedup.joint_estimate(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))
        assert abs(est[0] - j) < 0.2
    merged = np.maximum(near_dedup.registers(a), near_dedup.registers(b))
    assert (merged == near_dedup.registers(np.union1d(a, b))).all()


def test_pack(docs, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = pack.pack_documents(docs).toPandas().sort_values(["sequence_id", "offset"])
    by = got.groupby("sequence_id")
    assert (by.length.cumsum() - got.length == got.offset).all() and by.length.sum().max() <= 2048
    assert by.ngroups <= -(-got.length.sum() // 2048) + 2
    once = got.drop_duplicates(["doc_id", "piece"])
    for d, text, *_ in rows():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = once[once.doc_id == d].sort_values("piece")
        assert own.start.tolist() == pack.piece_starts(len(ids), 2048) and own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length, strict=True)]
    assert pack.pack_documents(empty).count() == 0
    assert sorted(pack.pack_documents(docs, with_ids=True).select(F.size("ids").alias("k"), "length").where("k != length").collect()) == []


def test_pack_special_text(spark):
    text = "a <|endoftext|> bé \U0001f600 <|x|>"
    got = pack.token_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_ids=True).first()
    from tokenizers import Tokenizer

    import public_tokenizers

    assert got.ids == [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, 0]


def test_pack_long_white_space(spark, monkeypatch):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a" + x * 2_000_000 + "b c" for x in (" ", "\n")]
    want = {i: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, x in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert {r.doc_id: r.ids_crc32 for r in pack.token_pieces(df, capacity=4_000_000).collect()} == want
    monkeypatch.setattr(pack, "LONG_RUN", 1 << 30)  # what panics without the bound on runs goes the same way
    pack._encoder.cache_clear()
    assert pack._encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")(texts[0]) == t.encode(texts[0], add_special_tokens=False).ids
    pack._encoder.cache_clear()


def test_fullest_bin_is_exact():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        used = pack.fullest(counts, 40)
        items = [k for k, n in counts.items() for _ in range(n)]
        items.remove(max(counts))
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        assert sum(k * n for k, n in used) == max(counts) + max(s for s in sums if s <= 40 - max(counts))
        assert all(counts[k] >= n for k, n in used)


def test_mix(docs, empty):
    got = mix_sources.mix_table(docs).toPandas()
    size = Counter()
    for _, t, _, s, _ in rows():
        size[s] += len(tokens(t))
    names = sorted(k for k in size if k is not None) + [None] * (None in size)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size.values())
    while free:
        share = {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
        over = [k for k in free if share[k] > 2 * size[k]]
        if not over:
            target |= share
            break
        for k in over:
            target[k] = 2 * size[k]
            left -= target[k]
            free.remove(k)
    source = {d: s for d, _, _, s, _ in rows()}
    got["source"] = got.doc_id.map(source)
    for r in got.itertuples():
        assert abs(r.target - target[r.source if isinstance(r.source, str) else None]) < 1e-6
        assert r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
    again = mix_sources.mix_table(docs.repartition(7)).toPandas()
    assert sorted(map(tuple, again.itertuples(index=False))) == sorted(map(tuple, got.drop(columns="source").itertuples(index=False)))
    mixed = mix_sources.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] == got.taken.sum()
    assert mix_sources.mix_table(empty).count() == 0


def test_mix_comes_near_target(spark):
    data = [(i, "w " * (i % 9 + 1), f"s{i % 4}") for i in range(4000)]
    got = mix_sources.mix_table(spark.createDataFrame(data, "doc_id long, text string, source string")).toPandas()
    got["s"] = got.doc_id % 4
    for _, g in got.groupby("s"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 9


def test_media(docs, empty):
    got = {r.doc_id: r for r in media.media_digests(media.store_texts(docs)).collect()}
    for d, t, *_ in rows():
        raw = (t or "").encode()
        payload = media.pad(raw)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored, frames = media.write_media(payload), len(payload) // 64
        assert (r.media_bytes, r.media_sha256, r.error) == (len(stored), hashlib.sha256(stored).hexdigest(), None)
        at = stored.index(b"mdat") + 4  # the payload lies there as it is, a keyframe every 16 frames of 64 bytes
        assert stored[at:] == payload
        assert r.feature == f"raw ;8x8;{frames / 25:.2f};{frames};" + ",".join(f"{at + 64 * k}+64" for k in range(0, frames, 16))
    assert media.media_digests(media.store_texts(empty)).count() == 0
    index = media.index_media(media.store_texts(docs)).where("doc_id = 905").first().media_index
    stored = media.write_media(media.pad(next(t for d, t, *_ in rows() if d == 905).encode()))
    assert index.codec == "raw " and index.error is None and len(index.keyframes) == -(-index.samples // 16)
    payload = media.read_payload(stored)
    assert all(stored[k.start : k.start + k.size] == payload[i * 1024 : i * 1024 + 64] for i, k in enumerate(index.keyframes))


def test_media_other_layouts(spark):
    """Sizes by sample, 64-bit offsets and boxes, chunks out of order, no sync table, and broken files."""
    data = b"0123456789abcdef"
    stbl = media.box(
        b"stbl", media.full_box(b"stsd", struct.pack(">I", 1), media.box(b"mp4a", bytes(28))), media.full_box(b"stts", struct.pack(">III", 1, 4, 10)),
        media.full_box(b"stsc", struct.pack(">I", 2), media.table([(1, 1, 1), (2, 3, 1)])), media.full_box(b"stsz", struct.pack(">II", 0, 4), media.table([4, 2, 6, 4])),
        media.full_box(b"co64", struct.pack(">I", 2), media.table([28, 16], ">u8")),
    )
    mdhd = media.full_box(b"mdhd", struct.pack(">QQIQ", 0, 0, 20, 40), version=1)
    moov = media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.full_box(b"hdlr", bytes(4), b"soun", bytes(13)), media.box(b"minf", stbl))))
    file = struct.pack(">I4sQ", 1, b"mdat", 32) + data + moov
    t = media.read_tracks(file)[0]
    assert (t["codec"], t["timescale"], t["duration"], t["at"].tolist(), t["size"].tolist(), t["key"].tolist()) == ("mp4a", 20, 40, [28, 16, 18, 24], [4, 2, 6, 4], [0, 1, 2, 3])
    assert media.read_payload(file) == b"cdef0123456789ab"
    bad = spark.createDataFrame([(1, bytearray(file[:-3])), (2, None), (3, bytearray(b"junk"))], "id int, media binary")
    assert all(r.media_index.error for r in media.index_media(bad).collect())


def test_media_malformed(spark):
    """Deep nesting, counts far beyond the file, keyframes that are no samples, nulls: an error in the row, at once."""
    deep = b""
    for _ in range(3000):
        deep = media.box(b"moov", deep)
    good = media.write_media(media.pad(b"some text"))
    patched = lambda kind, at, value: (i := good.index(kind), good[: i + at] + struct.pack(">I", value) + good[i + at + 4 :])[1]
    files = {1: deep, 2: patched(b"stsz", 12, 4_000_000_000), 3: patched(b"stts", 8, 4_000_000_000), 4: patched(b"stss", 12, 99), 5: patched(b"stss", 12, 0), 6: patched(b"stsc", 16, 4_000_000_000), 7: patched(b"stco", 12, 1 << 31), 8: b"", 9: None, 10: good}
    df = spark.createDataFrame([(k, 9, None if v is None else bytearray(v)) for k, v in files.items()], "doc_id long, n_bytes long, media binary").withColumn("feature", F.lit(1))
    got = {r.doc_id: r for r in media.media_digests(df).collect()}
    assert [k for k, r in got.items() if r.error is None] == [10] and got[10].payload_bytes == 64
    assert all(r.payload_sha256 is None and r.feature is None for k, r in got.items() if k != 10)
    assert got[9].media_bytes is None and got[8].media_bytes == 0 and got[1].media_sha256 == hashlib.sha256(deep).hexdigest()
    assert {r.doc_id for r in media.index_media(df).where("media_index.error is null").collect()} == {10}


def test_language(docs, empty):
    texts = {"en": "the cat and the dog are in the house with that man", "fr": "le chat et le chien sont dans la maison avec cet homme"}
    rng = random.Random(2)
    data = [(i, " ".join(rng.choices(texts[k].split(), k=rng.randint(5, 40))), k, None, 0) for i in range(300) for k in [rng.choice(["en", "fr"])]]
    data += [(900, None, "en", None, 0), (901, "", "fr", None, 0), (902, "123 !?", "en", None, 0), (903, "the cat", None, None, 0), (904, "É", "fr", None, 0)]
    df = docs.sparkSession.createDataFrame(data, SCHEMA)
    got = {r.doc_id: r for r in language.language_table(df).collect()}
    assert len(got) == len(data)
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (900, 901, 902))
    held = [(d, k) for d, _, k, *_ in data[:300] if got[d].held_out]
    assert sum(got[d].lang_pred == k for d, k in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 for d, r in got.items())
    assert language.language_table(empty).count() == 0
    kept = language.keep_known_languages(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {d for d, *_ in data[:300]}


def test_language_equals_plain_profiles(spark):
    """Every trigram of every text bound and added one by one; a text with more distinct trigrams than a worker keeps, odd and clashing columns."""
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(2, 7)))
    letters = {"en": "abcdefgh", "fr": "aéèlmnop", "ja": "".join(map(chr, range(0x4E00, 0x4E00 + 40)))}
    data = [(i, " ".join(word(letters[k]) for _ in range(rng.randint(1, 30))), k) for i in range(90) for k in [rng.choice(list(letters))]]
    data += [(200, "".join(rng.choices([chr(0x4E00 + i) for i in range(300)], k=36_000)), "ja"), (201, None, "en"), (202, "12 ...", "fr"), (203, "ab cd", None), (204, data[0][1], data[0][2]), (None, data[1][1], "fr"), (205, "ÉA b", None)]
    table = spark.createDataFrame(data, "doc_id long, text string, lang string").select("*", F.lit(1).alias("lang_pred"), F.lit("x").alias("score"), F.lit(None).alias("size"))

    def bundle(text):
        kept = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        points = [0, *(0 if c == " " else ord(c) for c in " ".join(kept.split())), 0]
        total = np.zeros(language.DIM)
        if len(points) > 2:
            vector = {c: np.random.default_rng(c).integers(0, 2, language.DIM, dtype=np.int8) * 2.0 - 1 for c in set(points)}
            for a, b, c in zip(points, points[1:], points[2:], strict=False):
                total += np.roll(vector[a], 2) * np.roll(vector[b], 1) * vector[c]
        return total

    bundles = [bundle(t) for _, t, _ in data]
    taught = [zlib.crc32(b"" if d is None else str(d).encode()) % 5 != 0 and k is not None for d, _, k in data]
    langs = sorted({k for _, _, k in data if k})
    unit = np.stack([(v := sum(b for b, t, (_, _, k) in zip(bundles, taught, data, strict=True) if t and k == lang)) / np.linalg.norm(v) for lang in langs])
    mean = unit.mean(axis=0) / np.linalg.norm(unit.mean(axis=0))
    own = unit - np.outer(unit @ mean, mean)
    got = {(r.doc_id, r.held_out): r for r in language.language_table(table).collect()}
    assert len(got) == len(data)
    for (d, t, _), b in zip(data, bundles, strict=True):
        r = got[d, zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 0]
        if not b.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        b = b - (b @ mean) * mean
        cosine = own @ b / np.linalg.norm(own, axis=1) / np.linalg.norm(b)
        assert r.lang_pred == langs[int(cosine.argmax())] and r.score == pytest.approx(max(0, cosine.max()), abs=1e-4), d
    kept = language.keep_known_languages(table)
    assert kept.columns == table.columns and {(r.lang_pred, r["score"]) for r in kept.collect()} == {(1, "x")}


def test_language_stage_drops_noise_and_unlearned_languages(spark):
    texts = {"en": "the cat and the dog are in the house with that man", "fr": "le chat et le chien sont dans la maison avec cet homme"}
    other = "кот и собака живут в большом доме вместе с этим человеком и детьми"
    rng = random.Random(4)
    clean = [(i, " ".join(rng.choices(texts[k].split(), k=rng.randint(20, 60))), k, None, 0) for i in range(800) for k in [rng.choice(["en", "fr"])]]
    noise = [(1000 + i, " ".join(rng.choices(other.split(), k=60)), None, None, 0) for i in range(20)]
    noise += [(1100 + i, "今日は天気がいいですね明日は雨が降るでしょう" * (i + 4), None, None, 0) for i in range(5)]
    noise += [(1200 + i, " ".join("".join(rng.choices("bcdfgjklmpqrvwxz", k=6)) for _ in range(60)), None, None, 0) for i in range(20)]
    kept = language.keep_known_languages(spark.createDataFrame(clean + noise, SCHEMA).repartition(3))
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, *_ in clean]


def brute_lines(data):
    docs_of = {}
    for d, t in data:
        for line in (t or "").split("\n"):
            key = line.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
            docs_of.setdefault(key, set()).add(d)
    drop = {k: max(v) for k, v in docs_of.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for d, t in data:
        lines = (t or "").split("\n")
        kept = [x for x in lines if drop.get(x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)}), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_spread_join_equals_join(spark):
    """A key that holds most rows, keys without a partner, and null keys."""
    many = spark.range(900).selectExpr("id", "case when id % 9 < 7 then 1 when id % 9 = 7 then id end as k")
    one = spark.createDataFrame([(1, "a"), (7, "b"), (16, "c"), (10_000, "d")], "k long, v string")
    counts = many.groupBy("k").agg(F.count(F.lit(1)).alias("__n"))
    for how in ("inner", "left"):
        for most in (3, None):
            got = common.spread_join(many, one, ["k"], counts, "id", how, most)
            assert sorted(map(str, got.select("id", "k", "v").collect())) == sorted(map(str, many.join(one, "k", how).select("id", "k", "v").collect()))


def test_line_dedup(docs, empty):
    got = line_dedup.dedup_lines(docs)
    assert set(docs.columns) <= set(got.columns)
    want = brute_lines([(d, t) for d, t, *_ in rows()])
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()) == want
    assert sum(w[2] for w in want) > 0 and line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_of_a_very_long_text(spark):
    """A hundred thousand lines that all go, some repeated, against few; null ids are neither counted nor changed."""
    lines = [f"a line of many documents {i % 40_000}" for i in range(60_000)]
    data = [(1, "\n".join(lines)), (2, "\n".join(lines[:50_000])), (3, "\n".join([*lines, "own"])), (None, "\n".join(lines[:5])), (None, None), (4, lines[0].upper() + "\n x")]
    got = line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string"))
    by = {(r.doc_id, r.n_lines): (r.n_dropped, r.text) for r in got.collect()}
    assert by[1, 60_000] == (60_000, "") and by[2, 50_000] == (50_000, "") and by[None, 5] == (0, data[3][1]) and by[None, 1] == (0, None)
    assert by[3, 60_001] == (2, "\n".join([x for x in lines if x != lines[0]] + ["own"])) and by[4, 2][0] == 0


def test_shard(docs, empty):
    got = shard.shard_documents(docs).toPandas()
    assert len(got) == len(rows()) and set(got.law) == {"bytes"}
    texts = {d: (t or "").encode() for d, t, *_ in rows()}
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in got.itertuples())
    assert got.groupby("text_crc32").shard.nunique().max() == 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert shard.shard_documents(empty).count() == 0


def test_shards_are_near_equal_and_hold_a_hot_group(spark):
    """3,000 texts of 1 to 900 words, a third of the rows one text, null ids and a null text."""
    rng = random.Random(9)
    texts = [f"{i} " + "word " * int(900 ** rng.random()) for i in range(2000)]
    data = [(i, t) for i, t in enumerate(texts)] + [(5000 + i, "the same short text") for i in range(1000)] + [(None, "x"), (None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    got = shard.shard_documents(df).toPandas()
    loads = got.groupby("shard")["size"].sum()
    assert len(loads) == 8 and loads.max() - loads.min() <= 0.002 * loads.sum() and len(got) == len(data)
    again = shard.shard_documents(df.repartition(3)).toPandas()
    key = ["shard", "slot"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_schedule_equals_heap():
    rng = random.Random(4)
    classes = [(s, rng.randint(1, 200), float(s)) for s in rng.sample(range(1, 500), 40)]
    plan = shard.schedule(classes, 8)
    loads = [0.0] * 8
    for s, n, _ in sorted(classes, key=lambda c: -c[2]):
        for _ in range(n):
            loads[loads.index(min(loads))] += s
    ours = [0.0] * 8
    for s, a, b, i in plan:
        ours[i] += s * (b - a)
    assert sorted(ours) == sorted(loads)
    for s, n, _ in classes:
        assert sum(b - a for k, a, b, _ in plan if k == s) == n


def test_lm_score(docs, empty, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 500)
    mu = 50.0
    got = lm_score.score_table(docs, mu=mu).toPandas()
    data = [(d, tokens(t)) for d, t, *_ in rows()]
    train = [(d, w) for d, w in data if zlib.crc32(str(d).encode()) % 7 != 2]
    c, pair, context = Counter(), Counter(), Counter()
    for _, w in train:
        last = 0
        for x in [*w, None]:
            c[x] += 1
            pair[last, x] += 1
            context[last] += 1
            last = x
    total, distinct = sum(c.values()), len(c)
    assert len(got) == len(data) and (got.train_tokens == total).all()
    by = got.drop_duplicates("doc_id").set_index("doc_id")
    for d, w in data:
        r, last, score = by.loc[d], 0, 0.0
        for x in [*w, None]:
            score += np.log10((pair[last, x] + mu * (c[x] + 1) / (total + distinct + 1)) / (context[last] + mu))
            last = x
        assert r.n_tokens == len(w) + 1 and r.n_known == sum(c[x] > 0 for x in [*w, None])
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 1) / (total + distinct + 1)) for x in [*w, None]), rel=1e-9)
        assert abs(r.score - score) <= (len(w) + 1) / lm_score.STEPS + 1e-9
        assert r.held_out == (zlib.crc32(str(d).encode()) % 7 == 2)
    assert lm_score.score_table(empty).count() == 0


def test_lm_score_of_two_context_words(docs, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 500)
    mu, third = 50.0, 0.02
    got = lm_score.score_table(docs, mu=mu, third=third).toPandas().drop_duplicates("doc_id").set_index("doc_id")
    data = [(d, [-1, 0, *tokens(t), None]) for d, t, *_ in rows()]
    counts = Counter(tuple(w[i - n + 1 : i + 1]) for d, w in data if zlib.crc32(str(d).encode()) % 7 != 2 for n in (1, 2, 3) for i in range(2, len(w)))
    before = Counter(tuple(w[i - n : i]) for d, w in data if zlib.crc32(str(d).encode()) % 7 != 2 for n in (1, 2) for i in range(2, len(w)))
    total, distinct = sum(n for k, n in counts.items() if len(k) == 1), sum(len(k) == 1 for k in counts)
    for d, w in data:
        score = 0.0
        for g, h, x in zip(w, w[1:], w[2:], strict=False):
            p1 = (counts[(x,)] + 1) / (total + distinct + 1)
            p2 = (counts[h, x] + mu * p1) / (before[(h,)] + mu)
            m = third * (before[(h,)] + mu)
            score += np.log10((counts[g, h, x] + m * p2) / (before[g, h] + m))
        assert abs(got.loc[d].score - score) <= 2 * (len(w) - 1) / lm_score.STEPS


def test_lm_query_scores_by_trigrams(spark):
    from glossa.llm.queries import op9_lm_score

    args = spark, "/root/testdata/sf0.001"
    got, pairs = op9_lm_score(*args).toPandas(), lm_score.score_table(common.read_table(*args, "documents")).toPandas()
    assert got.score.sum() > pairs.score.sum() and (got.sort_values("doc_id").base_score.to_numpy() == pytest.approx(pairs.sort_values("doc_id").base_score.to_numpy()))


def test_lm_score_is_the_same_at_any_number_of_shards(docs, monkeypatch):
    """Hot words and pairs spread over many shards, null and repeated ids, long texts."""
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 5000)
    copies = docs.sparkSession.createDataFrame([(2000 + i, f"hot pair of words {i} " * 20) for i in range(30)], "doc_id long, text string")
    table = docs.select(F.when(F.col("doc_id") != 3, F.col("doc_id")).alias("doc_id"), "text").union(copies)
    order = ["doc_id", "n_tokens", "score"]
    few, many = (lm_score.score_table(table, third=0.002, shard_bytes=b).toPandas().sort_values(order).reset_index(drop=True) for b in (1 << 24, 5000))
    assert few.doc_id.isna().sum() == 1 and few.drop(columns="base_score").equals(many.drop(columns="base_score"))
    assert few.base_score.to_numpy() == pytest.approx(many.base_score.to_numpy(), rel=1e-12)
    split = "doc_id", "text", 7, 2
    hot = lm_score.vocabulary(table, 80, 5000 // lm_score.HOT_BYTES, *split)[3]
    assert hot and lm_score.hot_pairs(table, hot, 5000 // lm_score.HOT_BYTES, *split)


def test_lm_sums_do_not_grow_with_shards(spark):
    docs = common.read_table(spark, "/root/testdata/sf0.001", "documents")
    texts = [r.text or "" for r in docs.collect()]
    size = 6 * sum(len(tokens(t)) + 1 for t in texts)
    for shards in (12, 48, 192):
        sums = lm_score.shard_sums(docs, shards, 1 << 18, ("doc_id", "text", 7, 2), lm_score.MU, lm_score.THIRD)[0].toPandas()
        payload = sum(sums[c].map(len).sum() for c in ("docs", "score", "base", "unknown_docs", "unknown"))
        assert payload <= 2.5 * size
        assert sums.home.notna().sum() == sums.block.nunique()


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (10, 2**62), (1000, 3000), (5000, 2**61)):
        v = np.sort(rng.integers(0, top, n))
        e = lm_score.EliasFano(*lm_score.EliasFano.encode(v))
        probe = np.concatenate([v, rng.integers(0, top, 100)])
        found = e.find(probe)
        assert ((found >= 0) == np.isin(probe, v)).all() and (v[found[found >= 0]] == probe[found >= 0]).all()
        assert (e.access(np.arange(n)) == v).all() if n else True


def test_quality(docs, empty):
    spark = docs.sparkSession
    rng = random.Random(6)
    data = [(i, " ".join(rng.choice(["ab$$$", "cd###"] if i % 3 == 0 else ["good", "plain", "words"]) for _ in range(rng.randint(5, 60)))) for i in range(600)]
    table = spark.createDataFrame(data + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(600)] + [(5, None), (7, 3), (None, 1), (12345, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_table(table, labels).collect()}
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [i for i in range(600) if got[i].held_out]
    assert held == [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].predicted == (i % 3 != 0) for i in held) >= 0.98 * len(held)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_table(docs, none).collect()} == {0.5}
    assert quality.quality_table(empty, none).count() == 0


def plain_features(text):
    """The features of quality.measure by counting characters and words one by one."""
    b, w = text.encode(), tokens(text)
    if not b:
        return [0.0] * len(quality.FEATURES)
    n, k, share = len(b), max(len(w), 1), lambda test: sum(map(test, b)) / len(b)
    each = sorted(Counter(w).values()) or [0]
    same = sum(x == y for x, y in zip(w, w[1:], strict=False))
    word = lambda c: chr(c).isalnum() and c < 128 or c >= 128
    return [
        np.log1p(n), np.log1p(len(w)), n / k, share(lambda c: c >= 128 or chr(c).isalpha()), share(lambda c: c < 128 and chr(c).isdigit()), share(lambda c: 65 <= c <= 90),
        share(lambda c: 32 < c < 127 and not word(c) and c not in b".,;:!?"), sum(c in b".,;:!?" for c in b) / k, sum(c in b"|/\\" for c in b) / k, share(lambda c: c >= 128), b.count(10) / k,
        -sum(c / n * np.log2(c / n) for c in Counter(b).values()), len(each) / k, each[-1] / k, same / (len(w) - 1) if len(w) > 1 else 0, share(lambda c: c in b"<>[]{}()="), sum(each[-10:]) / k, same,
    ]


def test_quality_features_equal_plain_ones():
    texts = [t or "" for _, t, *_ in rows() if len(t or "") < 10_000] + ["a|b/c\\ <x> {y}=1; DONE!!\n\nüber über", "1", "  "]
    assert np.allclose(quality.measure([t.encode() for t in texts]), [plain_features(t) for t in texts], rtol=1e-4, atol=1e-6)


def test_quality_scores_equal_a_plain_fit(spark):
    """Cyclic boosting redone with loops over rows and all cuts; scores are sums of looked-up values; equal labels weigh their number."""
    rng = random.Random(12)
    data = [(i, " ".join(rng.choice(["good", "plain", "words,", "###", "ab|c"]) for _ in range(rng.randint(1, 25)))) for i in range(60)]
    labels = [(i, int("###" not in t.split()[:4])) for i, t in data[:50]] + [(3, 0), (3, 0), (4, None)]
    options = {"bins": 6, "coarse": 3, "rounds": 3, "pairs": 2, "pair_rounds": 2, "leaves": 3}
    got = {r.doc_id: r.score for r in quality.quality_table(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), **options).collect()}
    text, pairs = dict(data), [(d, y) for d, y in labels if y is not None and zlib.crc32(str(d).encode()) % 4 != 2]
    x = np.float32([plain_features(text[d]) for d, _ in sorted(set(pairs))])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 7)[1:-1])) for f in range(x.shape[1])]
    bins_of = lambda t: [sum(float(c) <= v for c in cuts[f]) for f, v in enumerate(np.float32(plain_features(t)))]
    taught = [(bins_of(text[d]), y) for d, y in pairs]
    share = sum(y for _, y in taught) / len(taught)
    tables, logit = [[0.0] * (len(c) + 1) for c in cuts], [float(np.log(share / (1 - share)))] * len(taught)
    base, sums = logit[0], lambda part: (sum(g for g, _ in part), sum(h for _, h in part))
    worth = lambda part: sums(part)[0] ** 2 / (sums(part)[1] + 1)
    newton = lambda part: sums(part)[0] / (sums(part)[1] + 1)
    slopes = lambda: [(y - (p := 1 / (1 + np.exp(-z))), p * (1 - p)) for z, (_, y) in zip(logit, taught, strict=True)]
    for _ in range(3):
        for f, table in enumerate(tables):
            gh = slopes()
            inside = lambda a, b: [s for s, (at, _) in zip(gh, taught, strict=True) if a <= at[f] < b]  # noqa: B023, E731
            edges = [0, len(table)]
            for _ in range(2):
                gains = [(worth(inside(a, c)) + worth(inside(c, b)) - worth(inside(a, b)), c) for a, b in zip(edges, edges[1:], strict=False) for c in range(a + 1, b)]
                best = max(gains, key=lambda g: (round(g[0], 12), -g[1]), default=(0, 0))
                if best[0] > 1e-9:
                    edges = sorted([*edges, best[1]])
            step = [0.1 * newton(inside(a, b)) for a, b in zip(edges, edges[1:], strict=False) for _ in range(a, b)]
            tables[f] = [t + s for t, s in zip(table, step, strict=True)]
            logit = [z + step[at[f]] for z, (at, _) in zip(logit, taught, strict=True)]
    coarse = lambda f, b: b * 3 // len(tables[f])

    def quarter_step(i, j):
        gh, options = slopes(), []
        for r in (1, 2):
            for c in (1, 2):
                parts = {(a, b): [s for s, (at, _) in zip(gh, taught, strict=True) if ((coarse(i, at[i]) >= r), (coarse(j, at[j]) >= c)) == (a, b)] for a in (False, True) for b in (False, True)}
                options.append((round(sum(map(worth, parts.values())), 12), -r, -c, {k: newton(v) for k, v in parts.items()}))
        gain, r, c, values = max(options, key=lambda o: o[:3])
        return gain, [[0.1 * values[a >= -r, b >= -c] for b in range(3)] for a in range(3)]

    ranked = sorted(((quarter_step(i, j)[0], i, j) for i in range(len(tables)) for j in range(i + 1, len(tables))), reverse=True)[:2]
    grids = {(i, j): np.zeros((3, 3)) for _, i, j in ranked}
    for _ in range(2):
        for (i, j), grid in grids.items():
            step = np.array(quarter_step(i, j)[1])
            grid += step
            logit = [z + step[coarse(i, at[i]), coarse(j, at[j])] for z, (at, _) in zip(logit, taught, strict=True)]
    for d, t in data:
        at = bins_of(t)
        z = base + sum(table[b] for table, b in zip(tables, at, strict=True)) + sum(g[coarse(i, at[i]), coarse(j, at[j])] for (i, j), g in grids.items())
        assert got[d] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6), d


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    score = quality.AdditiveModel(rounds=30).fit(x, y).score(x)
    assert ((score > 0.5) == (y > 0.5)).mean() > 0.9


def test_ann(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:160] = x[7]
    data = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    odd = [(3000, None, 1), (3100, [0.0] * 16, 1), (3200, [float("nan")] * 16, 1), (3300, [1.0] * 15 + [None], 1), (3400, [float("inf")] * 16, 1), (None, [1.0] * 16, 1), (3500, [], 1), data[5]]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit(1)).withColumn("score", F.lit(1))
    got = ann.search_table(df, shard_rows=1000).toPandas()
    assert set(got.query_id) == set(range(0, 3000, 100)) and (got.groupby("query_id").size() == 10).all()
    hits = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = sorted(zip(d.tolist(), range(3000), strict=True))[:10]
        g = g.sort_values("rank")
        assert np.allclose(g.score, d[g.vec_id]) and g["rank"].tolist() == list(range(1, 11))
        assert list(zip(g.score, g.vec_id, strict=True)) == sorted(zip(g.score, g.vec_id, strict=True))
        hits += len({i for _, i in best} & set(g.vec_id))
    assert hits >= 0.9 * 10 * got.query_id.nunique()
    few = ann.search_table(df.where("vec_id <= 4 and vec_id is not null"))
    assert few.count() == 4 and ann.search_table(df.where("vec_id < 0")).count() == 0
    index = ann.index_table(df.where("vec_id < 500"), shard_rows=1000).first()
    assert len(index.vectors) == 4 * 16 * (len(index.id_ends) // 8) and len(index.neighbours) == 4 * 2 * ann.LINKS * (len(index.id_ends) // 8)
    graph = ann.Graph.stored(index)
    assert graph.entry_level == len(index.upper_nodes) and all(((g >= -1) & (g < len(graph.x))).all() for g in graph.neighbours)
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [5.0, 0.0]), (1, [5.5, 0.0]), (1, [1.25, 0.0]), (2, [9.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in ann.search_table(twice).orderBy("rank").collect()] == [(1, 0.25), (2, 4.0)]


def test_ann_over_full_shards_in_clusters(spark, monkeypatch):
    """Recall over shards filled to their size, with dense clusters far apart and several blocks of queries."""
    monkeypatch.setattr(ann, "QUERIES", 16)
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(60, 24))[rng.integers(0, 60, 9000)] * 5 + rng.normal(size=(9000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = ann.search_table(df, shard_rows=2250).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & set(g.vec_id))
    assert len(got) == 900 and hits >= 0.95 * 900
