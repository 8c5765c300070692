import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandwise.llm import packing, token_store, tokens


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_by_word_equals_whole_texts(corpus, plain):
    e = tokens.Encoder(tokens.default_vocabulary())
    for row in corpus[0]:
        assert e.encode(row[1], 2).tolist() == plain(row[1])


PIECES = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "İ", "i̇", "H\u0331", "ẞ", "'s", "'S", "ǅ", "Σ", "\u0345", "\u2028", "ᄀ\u1161", "\U0001f600"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aZHIé'st.,!<|> \t\n\x0b\x0c\x1c\x85\u0301\u0307\u0338\u00a09"), st.sampled_from(PIECES)), max_size=30))
def test_any_text(plain, parts):
    text = "".join(parts)
    assert tokens.encoder(tokens.default_vocabulary()).encode(text, 2).tolist() == plain(text)


@pytest.mark.parametrize("text", ["x<|endoftext|>y", "<|ENDOFTEXT|>", "İ.", "xİ-", "H\u0331.", "É,", "a\x0bb", "½.", "'S 's"])
def test_texts_that_rules_of_words_get_wrong(plain, text):
    assert tokens.Encoder(tokens.default_vocabulary()).encode(text, 2).tolist() == plain(text)


def test_a_vocabulary_with_other_rules_gets_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    e, t = tokens.Encoder(path), Tokenizer.from_file(path)
    assert tokens.Encoder(tokens.default_vocabulary()).by_word and not e.by_word
    for text in ("Hello  World, it's 12", " <|endoftext|> x", None, ""):
        assert e.encode(text, 7).tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 7]


def test_a_full_cache_is_emptied(monkeypatch, plain):
    monkeypatch.setattr(tokens, "_CACHE_WORDS", 3)
    e = tokens.Encoder(tokens.default_vocabulary())
    for text in ("a b c d e.", "f g h a b!", "a"):
        assert e.encode(text, 2).tolist() == plain(text)


def test_words_met_in_every_generation_are_learned_once(monkeypatch, plain):
    monkeypatch.setattr(tokens, "_CACHE_WORDS", 8)
    e, learned = tokens.Encoder(tokens.default_vocabulary()), []
    learn = e._learn
    monkeypatch.setattr(e, "_learn", lambda words: learned.extend(words) or learn(words))
    for k in range(12):
        text = f"often Often often, Stem. {'abcdefghijkl'[k]}x {'abcdefghijkl'[k]}y. {'abcdefghijkl'[k]}Stem stem"
        assert e.encode(text, 2).tolist() == plain(text)
    assert len(e.cache) + len(e.older) < 40
    assert learned.count(b"often") == learned.count(b"stem") == learned.count(b"often,") == 1


def test_words_of_one_piece_go_to_the_merges_alone(monkeypatch, plain):
    e, asked = tokens.Encoder(tokens.default_vocabulary()), []
    full = e._ids
    monkeypatch.setattr(e, "_ids", lambda texts: asked.extend(texts) or full(texts))
    one = "the Theration été. ûber àèß, ñandú \u0161\u0111 \u0434\u043e\u043c \u00aa \u00b5m \u00f0\u00ad"
    for text in (one, "H\u0331 \u0130x \u03a3 \u0149 \u0374 a\u0301", "x" * 5000, "".join(tokens._KEPT), " ".join(tokens._KEPT)):
        assert e.encode(text, 2).tolist() == plain(text)
    assert len(tokens._KEPT) > 500 and not {"the", "theration", "été", "\u0434\u043e\u043c"} & set(" ".join(asked).split())


def test_files(spark, corpus, empty, plain, tmp_path):
    rows, df = corpus
    path = f"file://{tmp_path}/t"
    token_store.write_tokens(df, path)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    back = token_store.with_starts(token_store.read_tokens(spark, path), token_store.read_tokens(spark, path, ["part", "n_tokens"])).collect()
    start, expected = 0, []
    for r in order:
        ids = plain(r[1])
        expected.append((-1 if r[0] is None else r[0], start, len(ids), ids))
        start += len(ids)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], r["ids"]) for r in back) == sorted(expected)
    one = token_store.read_tokens(spark, path, ["doc_id", "n_tokens"], 30, 32)
    assert sorted(r["doc_id"] for r in one.collect()) == [30, 31, 32]
    assert "ids" not in one._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    token_store.write_tokens(empty, f"file://{tmp_path}/e")
    assert token_store.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


def test_encodings_and_page_indexes(spark, corpus, tmp_path):
    import glob

    import pyarrow.parquet as pq

    token_store.write_tokens(corpus[1], f"file://{tmp_path}/t")
    group = pq.ParquetFile(glob.glob(f"{tmp_path}/t/*.parquet")[0]).metadata.row_group(0)
    by_name = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    ids = next(c for name, c in by_name.items() if name.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids.encodings)
    assert "DELTA_BINARY_PACKED" in by_name["n_tokens"].encodings
    assert by_name["doc_id"].has_column_index and by_name["doc_id"].has_offset_index


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80))
def test_best_fit_is_best_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    to, offset = packing.best_fit_decreasing(np.array(lengths, np.int64), 32)
    room = []
    for length, at, off in zip(lengths, to, offset):
        fits = [r for r in room if r >= length]
        if fits:
            assert room[at] == min(fits) and off == 32 - room[at]
            room[at] -= length
        else:
            assert at == len(room) and off == 0
            room.append(32 - length)


@pytest.mark.parametrize("group", [packing.GROUP_PIECES, 20])
def test_packing(spark, corpus, empty, plain, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP_PIECES", group)
    rows, df = corpus
    out = packing.pack(df, window=256).collect()
    wanted = []
    for r in rows:
        ids = plain(r[1])
        wanted += [(-1 if r[0] is None else r[0], at, len(ids[at : at + 256]), crc(ids[at : at + 256]), len(ids)) for at in range(0, len(ids), 256)]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == sorted(wanted)
    held = {}
    for r in out:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(held) == list(range(len(held)))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    if group > 1000:
        total = sum(r["length"] for r in out)
        assert len(held) * 256 <= total * 1.03 + 256
    assert packing.pack(empty).count() == 0


def test_packing_again_gives_the_same(spark, corpus):
    first, second = (sorted(map(tuple, packing.pack(df, 256).collect()), key=str) for df in (corpus[1], corpus[1].repartition(5)))
    assert first == second
    random.seed(0)


def test_extra_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, ids int, part int")
    assert packing.pack(df.withColumn("length", F.lit(1))).first()["length"] == 3
