"""Operators 3, 5, 6, 7 and 10 against brute force, with nulls, ties, repeats, long texts and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kmerloom.llm import common, exact_dedup, mixing, packing, simhash, token_store
from kmerloom.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, fp string"
BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def rows():
    r = random.Random(3)
    vocabulary = ["the", "Über", "naïve", "x1", "don't", "a,b", "…", "日本語", "end."]
    texts = [None, "", " ", "\n\n", "a", "A b", "a  b", " a b ", "a\tb", "a b c", "x<|endoftext|>y", "it's\nfine\n", "a b c d e", "a b c d e", "ab cde"]
    texts += [" ".join(r.choices(vocabulary, k=r.randint(1, 60))) for _ in range(40)]
    texts += ["\n".join(r.choices(vocabulary, k=9000)), texts[20], texts[20] + " ", texts[21]]
    out = [(7 * i % 101, t, "en", [None, "s", "b", "ä"][i % 4] if i % 3 else "hot", None, "u", "f") for i, t in enumerate(texts)]
    return [*out, (None, "null id", None, None, None, None, None), out[5], out[5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encoder_matches_whole_texts():
    for path in (BYTE, WORD):
        encoder, whole = Encoder(path), Tokenizer.from_file(path)
        for text in {x[1] for x in rows()} - {None}:
            assert np.frombuffer(encoder.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_token_store_round_trip(spark, docs, tmp_path):
    token_store.write_tokens(docs, str(tmp_path / "t"), BYTE, shards=3, segment_ids=500)
    got = sorted(map(tuple, token_store.read_documents(spark, str(tmp_path / "t")).collect()), key=lambda x: x[1])
    whole = Tokenizer.from_file(BYTE)
    want = sorted(((x[0], np.array([*whole.encode(x[1] or "", add_special_tokens=False).ids, 0], "<u4")) for x in rows()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted(((a, n, c) for a, _, n, c in got), key=str) == sorted(((a, len(i), zlib.crc32(i.tobytes())) for a, i in want), key=str)
    assert [x[0] for x in got] == [a for a, _ in want]
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n


def test_token_store_random_access():
    r = np.random.default_rng(1)
    ids = r.choice([3, 250, 256, 300, 50256, 70000, 2**31], 5000).astype(np.uint32)
    s = token_store.Segment(token_store.encode(ids, [5, None], [4000, 1000]))
    assert s.ids().tolist() == ids.tolist() and s.doc_ids == [5, None] and s.ends.tolist() == [4000, 5000]
    assert [s.token(i) for i in range(0, 5000, 7)] == ids[::7].tolist()
    assert s.ids(777, 1555).tolist() == ids[777:1555].tolist() and s.ids(9, 9).tolist() == []
    small = token_store.Segment(token_store.encode(np.array([1, 2], np.uint32), [1], [2]))
    assert [small.token(0), small.token(1)] == [1, 2]
    with pytest.raises(IndexError):
        small.token(2)


def test_packing(docs, none):
    got = packing.pack(docs, WORD, width=64, open_bins=5).collect()
    whole = Tokenizer.from_file(WORD)
    want = []
    for x in rows():
        ids = np.array([*whole.encode(x[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(x[0], k, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
    assert sorted((tuple(x)[:5] for x in got), key=str) == sorted(want, key=str)
    used = {}
    for x in got:
        used.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(used) <= 1.1 * sum(x.length for x in got) / 64 + 3
    assert packing.pack(none, WORD).count() == 0


def test_best_fit_closes_the_fullest():
    b = packing.BestFit(10, 2)
    assert [b.place(n) for n in (6, 5, 7)] == [(0, 0), (1, 0), (2, 0)]  # three open: bin 2, with 3 free, closes
    assert b.place(3) == (0, 6) and b.place(5) == (1, 5) and b.place(1) == (0, 9) and b.place(10) == (3, 0) and b.place(1) == (4, 0)


def test_exact_dedup(docs, none):
    got = sorted(map(tuple, exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "digest").collect()), key=str)
    groups = {}
    for x in rows():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", x[1] or ""), []).append((-len(x[1] or ""), x[0] is None, x[0] or 0))
    want = []
    for text, g in groups.items():
        best = min(g)
        for i, x in enumerate(sorted(g)):
            name = lambda y: None if y[1] else y[2]
            want.append((name(x), name(best), len(g), i == 0, bytearray(hashlib.sha256(text.encode()).digest())))
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_against_a_history(spark, docs):
    old = spark.createDataFrame([(1000, "a b"), (1001, "A"), (1002, "a b c d e")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(docs, exact_dedup.winners(exact_dedup.digests(old))).collect()
    assert len(got) == len(rows())
    members = {x.doc_id: x.keep_id for x in got if x.keep_id and x.keep_id >= 1000}
    known = {"ab": 1000, "A": 1001, "abcde": 1002}
    assert members == {x[0]: known[t] for x in rows() if (t := re.sub(r"\s", "", x[1] or "")) in known}
    assert all(not x.kept for x in got if x.doc_id in members)


def test_small_input_against_a_large_history(spark, monkeypatch):
    """Shards follow the history, salts the rows that ask."""
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 64)
    monkeypatch.setattr(exact_dedup, "PROBE_ROWS", 16)
    old = exact_dedup.winners(exact_dedup.digests(spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text")))
    new = spark.createDataFrame([(9000 + i, f"text{i}" if i < 40 else "hot text" if i < 240 else "text7") for i in range(400)], "doc_id long, text string")
    got = exact_dedup.exact_dedup(new, old).collect()
    assert len(got) == 400
    for x in got:
        i = x.doc_id - 9000
        assert (x.keep_id, x.kept) == ((i, False) if i < 40 else (9040, i == 40) if i < 240 else (7, False))
    index = exact_dedup.build_index(old, 47).collect()
    assert len(index) == 47 and max(x.n for x in index) < 200


def test_perfect_hash():
    d = np.random.default_rng(0).integers(0, 256, (3000, 32), np.uint8)
    d[1] = d[0]
    d[1, 8] ^= 1  # the same keys, other bytes: found in the rest
    bitmaps, sizes, rest, slots = exact_dedup.build_mphf(d)
    assert sorted(slots.tolist()) == list(range(3000)) and len(rest) == 2
    shard = exact_dedup.Shard(b"".join(x.tobytes() for x in bitmaps), sizes, rest.tobytes(), d[np.argsort(slots)].tobytes())
    assert shard.lookup(d).tolist() == slots.tolist()
    other = np.random.default_rng(9).integers(0, 256, (3000, 32), np.uint8)
    assert (shard.lookup(other) == -1).all()


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def components(fps, radius=4):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_near_dedup(spark, docs, none):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen " * 3
    more = [(2000 + i, base + "tail " * (i % 5 == 0) + "z" * (i // 5), None, None, None, None, None) for i in range(30)]
    got = sorted(map(tuple, simhash.near_dedup(docs.unionByName(spark.createDataFrame(more, SCHEMA))).select("doc_id", "fp", "component_id", "kept").collect()), key=str)
    every = [*rows(), *more]
    fps = [plain_fingerprint(x[1]) for x in every]
    roots, best = components(fps), {}
    for x, r in zip(every, roots, strict=True):
        best[r] = min(best.get(r, (True, 0)), (x[0] is None, x[0] or 0))
    want = [(x[0], f - 2**64 if f >= 2**63 else f, None if best[r][0] else best[r][1]) for x, f, r in zip(every, fps, roots, strict=True)]
    assert sorted((x[:3] for x in got), key=str) == sorted(want, key=str)
    assert sum(x[3] for x in got) == len(best)
    assert simhash.near_dedup(none).count() == 0


def test_bands():
    """Two fingerprints within the radius agree in all bits of a band, however many blocks there are; more fingerprints make longer bands."""
    r = random.Random(5)
    for blocks in range(5, 10):
        masks = [x % 2**64 for x in simhash.bands(4, blocks)]
        for _ in range(200):
            far = sum(1 << b for b in r.sample(range(64), 4))
            assert any(far & m == 0 for m in masks)
    sizes = [simhash.blocks_for(n) for n in (0, 1, 10**6, 10**8, 10**9, 10**11)]
    assert sizes == sorted(sizes) and sizes[0] == sizes[2] == 5 and sizes[-1] > 5
    assert simhash.blocks_for(10, 0) == 1 and simhash.bands(0, 1) == [-1]


@pytest.mark.parametrize("tile,blocks", [(3, None), (3, 6), (50, None), (50, 7), (4096, None), (4096, 8)])
def test_links_of_crowded_bands(spark, tile, blocks):
    r = random.Random(tile)
    fps = {r.getrandbits(64) for _ in range(60)}
    near = r.getrandbits(64)
    fps |= {near ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(20)) for _ in range(120)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    got = {x.node: x.root for x in simhash.components(simhash.links(df, 4, tile, blocks)).collect()}
    sign = [f - 2**64 if f >= 2**63 else f for f in fps]
    classes = {}
    for f, c in zip(sign, components(fps), strict=True):
        classes.setdefault(c, set()).add(f)
    assert {f: got.get(f, f) for f in sign} == {f: min(c) for c in classes.values() for f in c}


def test_targets():
    assert mixing.targets([10, 10, 10]) == pytest.approx([18.75, 7.5, 3.75])
    assert mixing.targets([1, 100, 100]) == pytest.approx([3, 132, 66])
    assert mixing.targets([0, 0]) == [0, 0] and mixing.targets([]) == [] and mixing.targets([4]) == [4]


def test_mix(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    size = {}
    for x in rows():
        size[x[3]] = size.get(x[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.targets([size[s] for s in order]), strict=True))
    taken = {}
    for x in got:
        assert x.source_size == size[x.source] and x.target == pytest.approx(target[x.source]) and 0 <= x.taken <= 3 * x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
    assert {s: abs(taken[s] - target[s]) <= 1 for s in order} == dict.fromkeys(order, True)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((x.doc_id, x.size, x.taken) for x in got if x.doc_id is not None) == sorted((x.doc_id, x.size, x.taken) for x in again if x.doc_id is not None)
    assert mixing.mix(none).count() == 0
    assert all((x.first_slot is None) == (x.taken == 0) for x in got)


def test_mix_comes_through_its_schedule(docs, monkeypatch):
    """Slots that are missing are words that are not taken, and another order of sources gives other first slots."""
    before = {(x.doc_id, x.size): x for x in mixing.mix(docs, block=16).collect() if x.doc_id is not None}
    whole = mixing.complete_schedule
    monkeypatch.setattr(mixing, "complete_schedule", lambda *a: whole(*a).where("slot % 3 <> 0"))
    fewer = {(x.doc_id, x.size): x for x in mixing.mix(docs, block=16).collect() if x.doc_id is not None}
    assert sum(x.taken for x in fewer.values()) < 0.8 * sum(x.taken for x in before.values())
    monkeypatch.setattr(mixing, "complete_schedule", lambda *a: whole(*a).limit(0))
    assert {x.taken for x in mixing.mix(docs, block=16).collect()} == {0}


def test_schedule_is_complete(spark):
    for needed in ([5, 2, 1], [1000, 1, 0, 3], [0, 0], [1] * 40, [90_000, 1, 1]):
        got = mixing.complete_schedule(spark, needed, chunk=4096).collect()
        assert len({x.slot for x in got}) == len(got)
        for s, n in enumerate(needed):
            mine = sorted((x.slot, x.block) for x in got if x.src == s)
            assert len(mine) >= n and [b for _, b in mine] == list(range(len(mine)))


def test_mix_of_one_source_and_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STREAM_ROWS", 20)
    rows = [(None, "same words here", None, "hot", None, "u", "f")] * 500 + [(i, "w " * (i % 7), None, "hot", None, "u", "f") for i in range(490)] + [(1000 + i, "a b", None, "rare", None, "u", "f") for i in range(10)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(4), block=64).collect()
    assert len(got) == 1000 and all(0 <= x.taken <= 3 * x.size for x in got)
    for s in ("hot", "rare"):
        assert abs(sum(x.taken for x in got if x.source == s) - next(x.target for x in got if x.source == s)) <= 1


def test_schedule_follows_the_shares(spark):
    shares = [5.0, 2.0, 1.0, 0.0]
    got = mixing.schedule(spark, shares, 1000, chunk=64).collect()
    assert sorted(x.slot for x in got) == list(range(1000))
    for k in (100, 500, 1000):  # at every prefix each source is within a few slots of its share
        for s, w in enumerate(shares):
            assert abs(sum(x.src == s and x.slot < k for x in got) - k * w / 8) <= 4
    for s in range(4):
        mine = sorted((x.slot, x.block) for x in got if x.src == s)
        assert [b for _, b in mine] == list(range(len(mine)))


def test_rows_are_taken_by_their_places(spark, tmp_path):
    """Whatever the columns are called, from files or not, in one broadcast or in waves; each row as often as asked."""
    names = ["doc_id", "text", "at", "file", "run", "copies", "row", "uid", "place", "_metadata"]
    rows_ = [(i, f"t{i % 7}", *("x" * (i % 3) for _ in names[2:])) for i in range(300)] + [(None, None, *(None for _ in names[2:]))] * 2
    df = spark.createDataFrame(rows_, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names)).repartition(4)
    df.write.parquet(str(tmp_path / "d"))
    for source in (df, spark.read.parquet(str(tmp_path / "d"))):
        docs, located = common.placed(source, "doc_id")
        assert located.count() == 302 and located.select("at").distinct().count() == 302
        asked = located.select("at", F.when(F.col("doc_id").isNull(), 1).otherwise(F.col("doc_id") % 4).alias("n"))
        for at_once in (1 << 20, 1):
            got = common.taken(docs, asked, at_once)
            assert got.columns == names
            assert Counter(map(tuple, got.collect())) == Counter(x for x in rows_ for _ in range(1 if x[0] is None else x[0] % 4))


def test_encoder_goes_with_its_last_reference():
    """The caches' methods held their encoder, so each task's caches stayed until the collector ran."""
    import gc
    import weakref

    gc.disable()
    try:
        for path in (BYTE, WORD):
            encoder = Encoder(path)
            encoder.ids("Words, and more words...")
            held = [weakref.ref(encoder.spaced), weakref.ref(encoder.plain)]
            del encoder
            assert [x() for x in held] == [None, None]
    finally:
        gc.enable()


def test_encoder_searches_no_whole_text_for_white_space(monkeypatch):
    """Irregular white space shows in the pieces; ids are those of the whole text for any marks and spaces."""
    import random

    from kmerloom.llm import tokens

    searched = []
    monkeypatch.setattr(tokens, "_IRREGULAR", type("R", (), {"search": lambda _, x, r=tokens._IRREGULAR: searched.append(len(x)) or r.search(x)})())
    r = random.Random(4)
    pieces = ["word", "Word", "WORDS", "ñandú", "a", "I", "7", "x9", "don't", "é", "中文", "_", "fi", *"$%&#*@+=/|()[]{}<>~^-.,;:!?'\"", "$$$", "...", "?!", "\u2028"]
    cuts = [" "] * 30 + ["\n"] * 3 + ["\t", "  ", "\n\n", " \n", "\u00a0", " \t", "\x1f", ""]
    for path in (BYTE, WORD):
        encoder, whole = Encoder(path), Tokenizer.from_file(path)
        encoder.ids(" ".join(["plain words"] * 500))
        for n in [*[12] * 1500, *[2] * 500]:
            text = "".join(r.choice(pieces) + r.choice(["", "", r.choice(pieces)]) + r.choice(cuts) for _ in range(n)) + r.choice(["end", ""])
            assert np.frombuffer(encoder.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    assert max(searched, default=0) < 100
