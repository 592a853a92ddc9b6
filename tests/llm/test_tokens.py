import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from zephyrgrid.llm import bpe, packing, simple8b, tokens

POOLS = ["ab \n\t'sS.,1İΣς é<|endoftext|>", "".join(map(chr, range(32, 0x180))), " \n\r\x0b\x1c\x1d\x85\xa0　ab",
         "".join(map(chr, [*range(0x300, 0x340), *range(0x3a0, 0x3d0), *range(0x4e00, 0x4e20), 0x1F600])) + "  ab"]
ODD = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|startoftext|>", "", "aaaaaaaaa", "  ", "\n\n\nb", "a \n b", None]


def random_texts(n=150):
    r = random.Random(4)
    return ["".join(r.choice(p) for _ in range(r.randint(0, 60))) for p in POOLS for _ in range(n)] + ODD


def library(name, text):
    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("chunk", [tokens.CHUNK, 20])
def test_encoder_is_the_library(name, chunk, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", chunk)
    whole, some = Tokenizer.from_file(public_tokenizers.path(name)), random_texts(100)
    for t, made in zip(some, tokens.Encoder(public_tokenizers.path(name)).encode(some)):
        assert np.frombuffer(made, "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_merge_rounds_are_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    codec, whole, some = bpe.Codec(path), Tokenizer.from_file(path), random_texts() + ["ab" * 5000]
    made = codec.encode(some)
    for t, ids, back in zip(some, made, codec.decode(made)):
        ids = np.frombuffer(ids, "<u4").tolist()
        assert ids == whole.encode(t or "", add_special_tokens=False).ids
        assert back == whole.decode(ids, skip_special_tokens=False) == (t or "")
    # ids that cut a character in two, and ids that are none
    for ids in ([11737], [163, 104], [50256, 99999, 5]):
        known = [i for i in ids if i < 50257]
        assert codec.decode([np.array(ids, "<u4").tobytes()])[0] == whole.decode(known, skip_special_tokens=False)
    assert codec.decode([None]) == [""]


def test_bpe_query_shape(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = docs([(1, "some text"), (1, "some text"), (2, None), (None, "x")], extra=False)
    rows = bpe.decode(bpe.encode(df, path, ["doc_id", "lang"]), path).collect()
    assert sorted((r.doc_id or 0, r.decoded, len(r.ids) // 4) for r in rows) == [
        (0, "x", 1), (1, "some text", 2), (1, "some text", 2), (2, "", 0)]
    assert bpe.decode(bpe.encode(docs([]), path, ["doc_id"]), path).count() == 0


@pytest.mark.parametrize("kind", ["skewed", "flat", "large", "one", "none"])
def test_file_round_trip(kind):
    r = np.random.default_rng(3)
    n = {"one": 1, "none": 0}.get(kind, 5000)
    ids = {"skewed": r.geometric(0.01, n), "flat": r.integers(0, 60_000, n), "large": r.integers(0, 2 ** 32, n)}.get(
        kind, np.arange(n)).astype("<u4")
    cuts = np.sort(r.integers(0, n + 1, 30))
    parts = [p.astype("<u4").tobytes() for p in np.split(ids, cuts)]
    f = simple8b.File(simple8b.encode_file([None, *range(30)], parts))
    assert f.read().tobytes() == ids.tobytes() and f.doc_ids == [None, *range(30)]
    assert f.lengths.tolist() == [len(p) // 4 for p in parts]
    assert f.read(1, 3).tobytes() == ids[1024:3072].tobytes()
    with pytest.raises(ValueError):
        simple8b.File(b"x" * 100)


def test_files_in_order(spark, docs, monkeypatch):
    monkeypatch.setattr(simple8b, "FILE_IDS", 50)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i * 37 % 101, f"text number {i} " * (i % 7)) for i in range(101)] + [(500, None), (None, "no id"), (7, "again")]
    got = simple8b.read(simple8b.write(docs(rows), path)).withColumn("crc", F.crc32("ids")).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *sorted([i for i, _ in rows if i is not None])]
    whole, at = Tokenizer.from_file(path), 0
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes())
    for r in got:
        assert r.start == at and bytes(r.ids) in texts[r.doc_id] and r.crc == zlib.crc32(bytes(r.ids))
        at += r.n_tokens
    assert simple8b.read(simple8b.write(docs([]), path)).count() == 0


def packed_well(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for bins in places.values():
        at = 0
        for offset, length in sorted(bins):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("group", [10_000, 200])
def test_packing_is_tight(spark, group, monkeypatch):
    items = spark.range(3000).select(F.col("id").alias("item"), (1 + F.pmod(F.xxhash64("id"), F.lit(100))).alias("size"))
    found = packing.assign(items, 128, group, 4).join(items, "item").collect()
    assert len(found) == 3000
    least = -(-sum(r.size for r in found) // 128)
    used = packed_well([{**r.asDict(), "length": r.size} for r in found], 128)
    assert least <= used <= 1.05 * least + 1


def test_large_items_stay_apart(spark):
    items = spark.range(600).select(F.col("id").alias("item"), F.lit(70).cast("long").alias("size"))
    found = packing.assign(items, 128, 100, 4).collect()
    assert len({r.sequence_id for r in found}) == 600


def test_pieces_and_sequences(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, "word " * 50), (2, None), (3, ""), (3, ""), (None, "some words here"), (4, "a b c " * 300)]
    cut = packing.token_pieces(docs(rows), path, capacity=16)
    packed = packing.pack(cut, 16)
    found = packed.collect()
    packed_well([r.asDict() for r in found], 16)
    assert sum(r.length for r in found) == sum(len(library("word_bpe_49k.json", t)) + 1 for _, t in rows)
    long = sorted([r for r in found if r.doc_id == 4], key=lambda r: r.piece)
    ids = np.frombuffer(b"".join(bytes(r.ids) for r in long), "<u4").tolist()
    assert ids == library("word_bpe_49k.json", rows[-1][1]) + [0]
    assert [r.start for r in long] == list(range(0, len(ids), 16))
    assert all(r.length == len(r.ids) // 4 <= 16 for r in packing.sequences(packed).collect())
    assert packing.pack(packing.token_pieces(docs([]), path)).count() == 0

def test_units_and_merges_of_a_batch_are_the_library():
    """Different units of one batch are encoded together, words of all lengths too, whatever the memo keeps."""
    r = random.Random(9)
    letters = "abcdeè'ÀÉİŸſßñ×÷ªZ.,-<_09\x00\x7f"
    words = ["".join(r.choice(letters) for _ in range(n)) for n in [*range(1, 60)] * 8] + ["aaaa" * 30, "I'LL", "they're'", "'tis", "12345", "a\x1db"]
    texts = [(" " if i % 3 else "\n").join(r.sample(words, 25)) for i in range(60)] + words + ["", None, "x" * 300]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        whole = Tokenizer.from_file(public_tokenizers.path(name))
        want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        encoder = tokens.Encoder(public_tokenizers.path(name))
        for low in (0, 20, 0, 0):
            made = encoder.encode(texts[low:])
            assert [np.frombuffer(m, "<u4").tolist() for m in made] == want[low:]


def test_memo_stays_small(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_UNITS", 50)
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for i in range(30):
        text = " ".join(f"word{j}" for j in range(i * 7, i * 7 + 20))
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library("byte_bpe_50k.json", text)
        assert len(encoder.units) == len(encoder.ids) <= 50


def test_words_of_all_alphabets_use_merges(monkeypatch):
    """No word of Latin letters costs a call of the file's model."""
    encoder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(encoder, "_word", lambda word: pytest.fail(f"{word} went through the model"))
    text = "Größe, naïveté (Çok) it's 12.5% ÀÉÎ"
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library("word_bpe_49k.json", text)
