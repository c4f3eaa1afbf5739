"""Operators 6 and 9: exact round trips, the tokenizers library and brute force as references."""

import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clausewise.llm import bytesops, piece_sampling, queries, range_coder, token_store

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "\n\n", "a  b\n\n c ", "x  y  z　　 w", "naïve été, 中文字 😀 «да»", "it's we'll  don't", "a<|endoftext|> b <|endoftext|>", "▁ ▁▁x", "tab\t tab\r\n end ", "é" * 700, "0123456789" * 40, "q\x1c\x1d r\x85 s  t"]


def test_range_coder_round_trips():
    rng = np.random.default_rng(0)
    for ids in ([], [65535], np.zeros(5000), rng.integers(0, 65536, 9000), rng.zipf(1.3, 9000) % 50257, np.tile(rng.integers(0, 50257, 30), 300), [2**32 - 1, 0, 70_000], rng.integers(0, 1 << 32, 20_000)):
        ids = np.asarray(ids, np.int64)
        for block, lanes in ((4096, 1024), (100, 7)):
            assert np.array_equal(range_coder.decode(range_coder.encode(ids, block, lanes), lanes), ids)
    repetitive = range_coder.encode(np.tile(rng.integers(0, 50257, 30), 300))
    assert len(repetitive) < 9000


def test_range_coder_carries():
    """One id is all but certain, so that spans stay large and carries run far."""
    rng = np.random.default_rng(1)
    for share in (0.5, 0.01, 0.0005):
        ids = np.where(rng.random(200_000) < share, rng.integers(0, 3000, 200_000), 2999)
        assert np.array_equal(range_coder.decode(range_coder.encode(ids, 512)), ids)


def test_range_coder_blocks_are_independent():
    """A block is read with the header alone."""
    ids = np.random.default_rng(2).zipf(1.5, 5000) % 5000
    file = range_coder.encode(ids, 1000)
    size = struct.unpack_from("<I", file, 16)[0]
    at, blocks = 20 + size, []
    while at < len(file):
        length = struct.unpack_from("<III", file, at)[2]
        blocks.append(file[at : at + 12 + length])
        at += 12 + length
    alone = file[:8] + struct.pack("<Q", 1000) + file[16 : 20 + size] + blocks[3]
    assert len(blocks) == 5 and np.array_equal(range_coder.decode(alone), ids[3000:4000])


def test_range_coder_beats_static_order_0(spark):
    encoder = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toArrow().sort_by("doc_id")
    parts = [encoder(data, offsets)[0] for _, _, data, offsets in bytesops.pieces(docs.column("text"))]
    ids = np.concatenate(parts)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    file = range_coder.encode(ids)
    assert 8 * len(file) < 0.85 * len(ids) * -(share * np.log2(share)).sum()
    assert np.array_equal(range_coder.decode(file), ids)


def test_range_coder_notices_damage():
    file = bytearray(range_coder.encode(np.arange(3000)))
    file[-200] ^= 1
    with pytest.raises(ValueError):
        range_coder.decode(bytes(file))
    file[-200] ^= 1
    file[40] ^= 1
    with pytest.raises(ValueError):
        range_coder.decode(bytes(file))
    with pytest.raises(ValueError):
        range_coder.decode(range_coder.encode(np.arange(3000))[:-5])
    for bad in (-1, 1 << 32):
        with pytest.raises(ValueError):
            range_coder.encode(np.array([bad]))


def test_range_coder_passes_are_even():
    assert range_coder._at_once(4300, 4096) == 4300 and range_coder._at_once(9000, 4096) == 4500 and range_coder._at_once(1, 4096) == 1
    for blocks in (1, 2, 3, 10, 11, 14, 15):
        ids = np.random.default_rng(blocks).zipf(1.5, 64 * blocks - 5) % 5000
        assert np.array_equal(range_coder.decode(range_coder.encode(ids, 64, 7), 7), ids)
        assert range_coder.encode(ids, 64, 7) == range_coder.encode(ids, 64)


def by_library(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, out = 0, []
    for k, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_op6_equals_the_library(spark, tmp_path):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(None, "no id"), *[(-len(ODD) + i, t) for i, t in enumerate(ODD)], *sorted(docs), (10**6, None), (10**6 + 1, "twice"), (10**6 + 1, "twice")]
    shuffled = random.Random(1).sample(rows, len(rows))
    path = str(tmp_path / "tokens")
    token_store.write(spark.createDataFrame([(*r, 1) for r in shuffled], "doc_id long, text string, seq int"), path, public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((tuple(r) for r in token_store.read(spark, path).collect()), key=lambda r: r[1])
    assert got == by_library(rows)
    assert queries.op6_token_files(spark, SF).count() == len(docs)


def test_op6_files_are_no_small_remainders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FILE", 5000)
    monkeypatch.setattr(token_store, "PIECE", 1000)
    for n in (45, 52, 76, 101, 126):
        rows, path = [(k, " word" * 99) for k in range(n)], str(tmp_path / f"n{n}")
        token_store.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, public_tokenizers.path("byte_bpe_50k.json"))
        files = [r["n_tokens"] for r in spark.read.parquet(path).collect()]
        assert sum(files) == 100 * n and min(files) >= min(2500, 100 * n) and max(files) <= 7600
        assert sorted((tuple(r) for r in token_store.read(spark, path).collect()), key=lambda r: r[1]) == by_library(rows)


def thue_morse(n, a="a", b="b"):
    """Texts whose polynomial hashes modulo 2 ** 64 are those of their complements, for any base."""
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [8, 16, 64, 2048, 4096])
def test_op6_tells_crafted_texts_apart(n):
    encoder, texts = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json")), [thue_morse(n), thue_morse(n, "b", "a")]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(2):
        for text in texts:
            ids, before = encoder(np.frombuffer(text.encode(), np.uint8), np.array([0, n]))
            assert ids[: before[1]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_op6_equals_the_library_beyond_its_memory(spark):
    """Units that lose their place to others, and a memory that is cleared."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(ODD) + str(rng.randrange(10**rng.randrange(1, 25))) for _ in range(400)) for _ in range(60)]
    encoder, library = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.seen.limit, encoder.seen.place = 4000, encoder.seen.place
    for _ in range(2):
        for text in texts:
            data = text.encode()
            ids, _ = encoder(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


MARKS = [*"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~", "...", "'s", "'S", "'ll x", ").", "%%%", "<|endoftext|>", "|>", "<|endoftext|", "1", "×y", "é!", "\u2019s", "\n", "\t.", "\xa0.", "\u3000"]
WORDS = ["alpha", "BETA", "été", "ñandú", "straße", "Ÿŉ", "мир", "Ёж", "ѿ", "a×b", "c÷d", "x2", "δέ", "中文", "ç", "Ã", "s", "ll", "endoftext"]


def test_op6_equals_the_library_for_words_and_marks():
    encoder, library = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"{gap}{w}{m}{w}{gap}{w}{m}" for w in WORDS for m in MARKS for gap in (" ", "", "\n", "  ")] + [" ".join(w + m for w in WORDS for m in MARKS)]
    for _ in range(2):
        for text in texts:
            data = text.encode()
            assert encoder(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_op6_encodes_a_word_once_whatever_mark_follows():
    encoder = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    data = "".join(f" word{a}{b}{m}" for a in "abcdefgh" for b in "stuvwxyz" for m in ",.;:!?)").encode()
    encoder(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert encoder.seen.size == 64 + 7


@pytest.mark.parametrize("added", [{"content": "wor"}, {"content": " word"}, {"content": "d,e"}, {"content": "rd", "single_word": True}, {"content": "-", "lstrip": True, "rstrip": True}, {"content": "<é!>"}])
def test_op6_equals_the_library_with_added_tokens(tmp_path, added):
    from tokenizers import AddedToken

    library, file = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), str(tmp_path / "t.json")
    library.add_tokens([AddedToken(**added)])
    library.save(file)
    encoder = token_store.Encoder(file)
    for text in (" word, words; swords d,e word", "a word,end", "the rd, rd", "word-word", "<é!> x<é!>y, é!"):
        data = text.encode()
        assert encoder(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("pattern", ["Whitespace", "Digits", "ByteLevel"])
def test_op6_cuts_only_at_blanks_with_other_patterns(tmp_path, pattern):
    from tokenizers import pre_tokenizers

    library, file = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), str(tmp_path / "t.json")
    library.pre_tokenizer = getattr(pre_tokenizers, pattern)(**({"add_prefix_space": False, "use_regex": False} if pattern == "ByteLevel" else {}))
    library.save(file)
    _, _, words, marks = token_store._tokenizer(file)
    assert words is None and not marks.any()


def test_op6_empty_table(spark, tmp_path):
    token_store.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"))
    assert token_store.read(spark, str(tmp_path / "t")).collect() == []


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_op9_is_lossless_and_reproducible(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(500, None), (501, "word " * 9000), (501, "word " * 9000), (None, "no id")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_pieces int")
    got = piece_sampling.encode(df, MODEL).collect()
    again = piece_sampling.encode(df.repartition(3), MODEL).collect()
    assert all(r["lossless"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(map(str, piece_sampling.encode(df, MODEL, seed=1).collect())) != sorted(map(str, got))
    back = piece_sampling.decode(piece_sampling.encode(df, MODEL), MODEL).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in back) == sorted((k is None, k or 0, t or "") for k, t in rows)
    assert piece_sampling.encode(df.limit(0), MODEL).collect() == []


def all_paths(v, text):
    """Every segmentation of text with its weight."""
    if not text:
        return [((), 0.0)]
    out = []
    known = {b: i for i, b in enumerate(v.bytes) if b and i not in set(v.byte_id.tolist())}
    for k in range(1, len(text) + 1):
        if text[:k] in known:
            i = known[text[:k]]
            out += [((i, *p), v.weight[i] + w) for p, w in all_paths(v, text[k:])]
    return out


def test_op9_draws_with_exact_chances():
    v = piece_sampling.Vocabulary(MODEL, 0.3)
    paths = all_paths(v, b" there")
    total = math.log(sum(math.exp(w) for _, w in paths))
    chance = {p: math.exp(w - total) for p, w in paths}
    n = 40_000
    data, offsets = np.frombuffer(b"there" * n, np.uint8), np.arange(n + 1) * 5
    keys = np.random.default_rng(2).integers(0, 1 << 63, n).astype(np.uint64)
    pieces, before = piece_sampling.encode_piece(piece_sampling.Lattices(v), data, offsets, keys)
    seen = Counter(tuple(pieces[a:b].tolist()) for a, b in zip(before, before[1:], strict=False))
    assert set(seen) <= set(chance)
    assert max(abs(seen[p] / n - c) for p, c in chance.items()) < 0.012


@pytest.mark.parametrize("word", ["there" * 30, "неthereб" * 12 + "中文" * 9, "x" * 90])
def test_op9_long_units_have_exact_chances(word):
    """The chance of each piece at each place, by sums forward and backward over all paths, against draws."""
    v, unit = piece_sampling._vocabulary(MODEL, 0.3), (" " + word).encode()
    known = {b: i for i, b in enumerate(v.bytes) if b and i not in set(v.byte_id.tolist())}
    edges, n, heads = [], len(unit), [i for i, x in enumerate(unit) if x & 0xC0 != 0x80]
    edges += [(a, b, known[unit[a:b]]) for a in range(n) for b in range(a + 1, n + 1) if unit[a:b] in known]
    for a, b in zip(heads, [*heads[1:], n], strict=True):
        edges += [(k, k + 1, int(v.byte_id[unit[k]])) for k in range(a, b) if unit[a:b] not in known]
    ahead, back = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for a, b, i in sorted(edges, key=lambda e: e[1]):
        ahead[b] = np.logaddexp(ahead[b], ahead[a] + v.weight[i])
    for a, b, i in sorted(edges, key=lambda e: -e[0]):
        back[a] = np.logaddexp(back[a], back[b] + v.weight[i])
    want = {(a, i): math.exp(ahead[a] + v.weight[i] + back[b] - ahead[n]) for a, b, i in edges}
    draws = 6000
    data, offsets = np.frombuffer(word.encode() * draws, np.uint8), np.arange(draws + 1) * (n - 1)
    keys = np.random.default_rng(4).integers(0, 1 << 63, draws).astype(np.uint64)
    pieces, before = piece_sampling.encode_piece(piece_sampling.Lattices(v), data, offsets, keys)
    at = np.cumsum(v.length[pieces]) - v.length[pieces]
    seen = Counter(zip((at % n).tolist(), pieces.tolist(), strict=True))
    assert set(seen) <= {k for k, c in want.items() if c > 0}
    assert max(abs(seen[k] / draws - c) for k, c in want.items()) < 0.035


def test_op9_pieces_decode_with_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect() if r["text"]]
    rows += [(10**6 + i, t) for i, t in enumerate(ODD) if "▁" not in t and t]
    for r in piece_sampling.encode(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect():
        assert library.decode(r["pieces"]).lstrip(" ") == r["text"].lstrip(" ")


def test_op9_query(spark):
    got = queries.op9_sentencepiece(spark, SF)
    assert got.filter("lossless").count() == spark.read.parquet(f"{SF}/documents.parquet").count()
