"""Operators 8, 5 and 4 against the library itself and exact round trips."""

import random
import unicodedata
import zlib

import numpy as np
import pytest
from bundlefold.llm import encoder, packing, tokencount, tokenfile
from bundlefold.llm.queries import tokenizer_path
from pyspark.sql import functions as F

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\nb", "a\n\nb c", "\ta b", "it's we'll  don't", "x<|endoftext|>y z", "<|endoftext|> a b", "a <|startoftext|>  b", "é è ñ ß ÉÀ", "é a ́b", "\x00a b", "\x00", "1234 5.6e7 #!!", "a\xa0b c", "a b  c", "日本 語 😀 x", "word " * 3000, "a\x1cb \x85 c", " \n", "\n a", "İ I ſ Σ ΣΑΣ s"]


def texts():
    rng = random.Random(5)
    alphabet = ["the", "ing", "é", " ", " ", " ", "\n", "!!", "9", "'s", "\t", "A", "<|endoftext|>"]
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name, monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(name))
    want = [e.ids for e in tok.encode_batch(texts(), add_special_tokens=False)]
    raw = [t.encode() for t in texts()]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    for span, entries in ((1 << 22, 1 << 20), (20, 1 << 20), (1 << 22, 50)):
        monkeypatch.setattr(encoder, "SPAN", span)
        monkeypatch.setattr(encoder, "ENTRIES", entries)
        e = encoder.Encoder(tokenizer_path(name))
        for lo, hi in ((0, len(raw)), (0, 40), (40, len(raw))):  # twice: from the table too
            ids, firsts = e.encode(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            assert [ids[a:b].tolist() for a, b in zip(firsts[:-1], firsts[1:], strict=True)] == want[lo:hi]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_letter_and_mark(name):
    """Every letter and combining mark but most of the large uniform blocks, before and after each punctuation mark."""
    from tokenizers import Tokenizer

    chars = [chr(c) for c in range(0x30000) if unicodedata.category(chr(c))[0] in "LM" and not (c > 0x33FF and c % 64 and not 0xA000 <= c < 0xAC00 and not 0xFB00 <= c < 0x12000)]
    fixed = ["\u0130. Y\u0131lmaz", "T\u00dcRK\u0130YE CUMHUR\u0130YET\u0130, 1923", "EVET AL\u0130!", "\u0958. \ufb2a, x\u09dc;"]
    ts = [f"{c}. a{c}, {c}a; " + " ".join(c + m + " x" + c + m + " " + m + c for m in encoder.MARKS) for c in chars] + fixed
    raw = [t.encode() for t in ts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    ids, firsts = encoder.Encoder(tokenizer_path(name)).encode(data, offs)
    want = [e.ids for e in Tokenizer.from_file(tokenizer_path(name)).encode_batch(ts, add_special_tokens=False)]
    assert not [t for t, a, b, w in zip(ts, firsts[:-1], firsts[1:], want, strict=True) if ids[a:b].tolist() != w]


def test_pieces_that_share_a_hash(monkeypatch):
    """Pieces whose hashes are equal are told apart by their checks, within a batch and in the table."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(encoder, "span_hashes", lambda low, s, e, *_: np.full(len(s), 77, np.uint64))
    tok, e = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), encoder.Encoder(tokenizer_path("word_bpe_49k.json"))
    for ts in (["the cat sat on a mat", "cats. dogs!"], ["a cat sat", "the dogs!"]):
        raw = [t.encode() for t in ts]
        data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        ids, firsts = e.encode(data, offs)
        assert [ids[a:b].tolist() for a, b in zip(firsts[:-1], firsts[1:], strict=True)] == [x.ids for x in tok.encode_batch(ts, add_special_tokens=False)]


def test_table_under_pressure():
    rng = np.random.default_rng(4)
    t = encoder.Table(3000)
    h = np.unique(rng.integers(0, 1 << 63, 2900, dtype=np.uint64) & ~np.uint64(0xFFF) | rng.integers(0, 8, 2900, dtype=np.uint64))
    check = rng.integers(0, 1 << 40, len(h), dtype=np.uint64)
    t.keep(h, t.add(check, [int(k).to_bytes(4, "little") * (k % 3) for k in range(len(h))]))
    found = t.find(h, check)
    assert found.tolist() == list(range(len(h)))
    assert (t.find(h + np.uint64(1), check)[~np.isin(h + np.uint64(1), h)] == -1).all() and (t.find(h, check + np.uint64(1)) == -1).all()


def frame(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(7, "same", "x"), (7, "same", "x"), (None, "no id", "y"), (900, None, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(spark, name):
    docs = frame(spark)
    got = sorted(map(str, (tuple(r) for r in tokencount.token_counts(docs, tokenizer_path(name), limit=100).collect())))
    if name.endswith("json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path(name))
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        count = lambda t: len(sp.encode(t))
    want = [(r.doc_id, len((r.text or "").encode()), count(r.text or ""), count(r.text or "") > 100) for r in docs.collect()]
    assert got == sorted(map(str, want))
    assert tokencount.token_counts(docs.limit(0), tokenizer_path(name)).count() == 0


def test_block_code_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.random(n) * 2.0 ** rng.integers(1, 32, n)).astype("<u4")
        control, data = tokenfile.code_block(x)
        assert len(control) == -(-n // 4)
        assert tokenfile.decode_block(control, data, n).tolist() == x.tolist()


def test_token_files(spark, tmp_path, monkeypatch):
    docs = frame(spark)
    manifest = tokenfile.write_token_files(docs, tokenizer_path("byte_bpe_50k.json"), 0, str(tmp_path / "t"), 3)
    got = [tuple(r) for r in tokenfile.read_token_files(manifest, with_ids=True).orderBy("start").collect()]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    start, want = 0, []
    for r in docs.orderBy("doc_id", F.xxhash64("text"), "text").collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert got == want
    empty = tokenfile.write_token_files(docs.limit(0), tokenizer_path("byte_bpe_50k.json"), 0, str(tmp_path / "e"), 2)
    assert tokenfile.read_token_files(empty).count() == 0


def test_damaged_token_file():
    raw = bytearray(b"".join(tokenfile.file_parts([1, None], [b"\1\0\0\0", b"\2\0\0\0\1\0\0\0"])))
    assert tokenfile.TokenFile(bytes(raw)).ids().tolist() == [1, 2, 1]
    raw[30] ^= 1
    with pytest.raises(ValueError):
        tokenfile.TokenFile(bytes(raw))


def test_histogram_packing():
    rng = random.Random(1)
    for _ in range(50):
        size = rng.choice([8, 64, 4096])
        counts = {rng.randint(1, size): rng.choice([1, 3, 1000, 10**7]) for _ in range(rng.randrange(60))}
        patterns = packing.pack_histogram(counts, size)
        got = {}
        for n, lengths in patterns:
            assert sum(lengths) <= size and list(lengths) == sorted(lengths, reverse=True)
            for x in lengths:
                got[x] = got.get(x, 0) + n
        assert got == counts
        assert len(patterns) <= 2 * len(counts) + 1


def test_pack(spark):
    docs = frame(spark)
    rows = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), 2, size=64, per_bucket=7).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in by_sequence.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = {}
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 64):
            k = (r.doc_id, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes()), len(ids))
            want[k] = want.get(k, 0) + 1
    got = {}
    for r in rows:
        k = (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
        got[k] = got.get(k, 0) + 1
    assert got == want
    assert packing.pack(docs.limit(0), tokenizer_path("word_bpe_49k.json"), 2).count() == 0
