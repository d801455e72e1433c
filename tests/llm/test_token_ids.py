import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillmere.llm import token_ids
from quillmere.shared import scratch, writing
from tests.llm.common import docs, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("kind", ["flat", "uniform", "skewed", "wide", "ends"])
def test_blocks_round_trip(kind):
    rng = np.random.default_rng(1)
    n = 9 * token_ids.BLOCK
    ids = {"flat": np.full(n, 7), "uniform": rng.integers(0, 50257, n), "skewed": np.where(rng.random(n) < 0.05, 2**32 - 1, rng.integers(0, 40, n)), "wide": rng.integers(0, 2**32, n), "ends": np.arange(n)}[kind].astype(np.uint32)
    blocks = token_ids.encode_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    assert (token_ids.decode_blocks(b"".join(blocks), starts) == ids).all()
    if kind == "skewed":
        assert sum(map(len, blocks)) < n * 1.5


def test_files_give_any_stretch(spark):
    uri = scratch(spark, "t") + "/a.tok"
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 50000, k).astype(np.uint32) for k in (1, 1000, 256, 3, 70000, 2)]
    with writing(uri) as out:
        w = token_ids.Writer(out, chunk_blocks=4)
        for i, p in enumerate(parts):
            w.add(i or None, p)
        n = w.close()["n_bytes"]
    r, whole = token_ids.Reader(uri, n), np.concatenate(parts)
    for a, b in ((0, 0), (0, 1), (255, 257), (1000, 1300), (0, len(whole)), (len(whole) - 1, len(whole))):
        assert (r.tokens(a, b) == whole[a:b]).all()
    for stretch in (1, 1500, 1 << 20):
        got = list(r.documents(stretch))
        assert [d for d, _, _ in got] == [None, 1, 2, 3, 4, 5] and all((g == p).all() for (_, _, g), p in zip(got, parts, strict=True))


def test_encoder_agrees_with_the_tokenizer(monkeypatch):
    t = Tokenizer.from_file(PATH)
    rng = random.Random(4)
    texts = ["", " ", "  ", "a  b", "a\n b", "a \n b", " \n ", "it's we'll", "日本語 テキスト", "é\xa0x   y", "<|endoftext|> x", "a <|endoftext|> b", "a\n <|endoftext|>\n b", "<|endoftext|><|endoftext|>", "1½ ²", "a\x1cb \x1c c"]
    texts += ["".join(rng.choice([" ", "  ", "\n", "\t", "ab", "é", "1", ".", "'s", "　", "字"]) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += [x.replace('字', '<|endoftext|>') for x in texts[-100:]]
    for most in (250_000, 5):
        monkeypatch.setattr(token_ids.Encoder, "MOST", most)
        e = token_ids.Encoder(PATH)
        for _ in range(2):
            assert [x.tolist() for x in e.encode(pa.array(texts), 2)] == [[*x.ids, 2] for x in t.encode_batch(texts, add_special_tokens=False)]


def test_a_word_is_learned_once_whatever_stands_after_it():
    words = [f"{a}{b}{c}" for a in "kmprt" for b in ("a", "é", "ou") for c in ("lu", "ß", "nd")]
    texts = [f"{w}{sign}\n{w} {w}{sign} ({w}) {w}" for w in words for sign in (",", ".", "...", "!", "###", ":", "'", "7", '"')]
    e = token_ids.Encoder(PATH)
    got = e.encode(pa.array(texts), 2)
    assert [x.tolist() for x in got] == [[*x.ids, 2] for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert len(e.known) <= 2 * len(words) + 40  # with and without a space in front, and the signs


def test_cuts_agree_with_the_tokenizer(monkeypatch):
    t = Tokenizer.from_file(PATH)
    rng = random.Random(9)
    some = [" ", " ", "\n", "\n", "  ", "\t", "\r", "\x1c", "\x85", "\xa0", "\u2028", "　", "\u200b", "\0", "a", "bc", "S", "'", "'", "s", "'ll", "7", "42", ".", ",", "-", "(", "###", "_", "<|"]
    some += ["À", "ÿ", "é", "ß", "×", "÷", "ª", "º", "µ", "²", "½", "¿", "«", "Ā", "я", "字", "̈", "١", "😀", "\u200d", "\ud7ff", "\ufeff"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(30))) for _ in range(6000)]
    texts += [f"{a}{b}{c}" for a in some for b in some for c in ("", "\n", " x", "a", "'s")]
    want = [[*x.ids, 2] for x in t.encode_batch(texts, add_special_tokens=False)]
    whole = pa.array(["none", *texts])
    for most, slots, group in ((500_000, 21, 500), (500_000, 3, 97), (40, 21, 1000), (0, 21, 5000)):
        monkeypatch.setattr(token_ids.Encoder, "MOST", most)
        monkeypatch.setattr(token_ids, "SLOTS", slots)
        e = token_ids.Encoder(PATH)
        for _ in range(2):
            assert [x.tolist() for at in range(1, len(whole), group) for x in e.encode(whole.slice(at, group), 2)] == want
        assert len(e.known) <= most


def test_other_tokenizers_get_whole_texts(tmp_path):
    from tokenizers import pre_tokenizers

    texts = ["a (b) don't\n12,x é", "", "x.y", "  a  b"]
    t = Tokenizer.from_file(PATH)
    for cutter in (pre_tokenizers.ByteLevel(add_prefix_space=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)):
        t.pre_tokenizer = cutter
        path = str(tmp_path / "other.json")
        t.save(path)
        assert [x.tolist() for x in token_ids.Encoder(path).encode(pa.array(texts), 2)] == [[*x.ids, 2] for x in t.encode_batch(texts, add_special_tokens=False)]


def test_documents_come_back_in_order(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, "", prose(rng, rng.randrange(1, 90))]), None) for i in range(300)] + [(None, "none", None), (5, "again", None), (1000, "long " * 40_000, None)]
    rng.shuffle(rows)
    files = token_ids.write_tokens(docs(spark, rows).repartition(5), PATH, 2)
    got = token_ids.read_tokens(files).orderBy("start").collect()
    t = Tokenizer.from_file(PATH)
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    want = sorted(((d, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for d, x, _ in rows), key=repr)
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=repr) == want
    small = token_ids.write_tokens(docs(spark, rows).repartition(5), PATH, 2, file_tokens=1, group=500)
    assert small.count() > files.count()
    assert [tuple(r) for r in token_ids.read_tokens(small).orderBy("start").collect()] == [tuple(r) for r in got]
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += len(r["ids"])
    assert token_ids.read_tokens(token_ids.write_tokens(docs(spark, []), PATH, 2)).collect() == []
