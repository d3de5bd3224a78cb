"""Round trips of the range coder, and token files against the tokenizer."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from landloom.llm.range_coder import BLOCK, decode, encode
from landloom.llm.token_output import END_ID, ByteBpe, crc_join, read_digests, read_pieces, token_output, tokenizer_path, write_tokens


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, (1 << 17) - 1) | st.integers(0, 5), max_size=120), min_size=1, max_size=6))
def test_coder_round_trip(blocks):
    arrays = [np.array(b, np.int32) for b in blocks]
    for a, b in zip(arrays, decode(encode(arrays), [len(a) for a in arrays]), strict=True):
        assert a.tolist() == b.tolist()


def test_coder_long_blocks():
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 1 << 17, BLOCK).astype(np.int32), np.zeros(BLOCK, np.int32), (rng.zipf(1.3, BLOCK) % 50257).astype(np.int32), np.arange(7, dtype=np.int32)]
    payloads = encode(arrays)
    assert all((a == b).all() for a, b in zip(arrays, decode(payloads, [len(a) for a in arrays]), strict=True))
    assert len(payloads[1]) < 400 and len(payloads[0]) < 2.3 * BLOCK
    assert decode(payloads[2:3], [BLOCK])[0].tolist() == arrays[2].tolist()  # a block by itself


def test_pieces_equal_whole_texts():
    bpe = ByteBpe(tokenizer_path())
    odd = ["", "a", "  a  b ", "a\n\nb\n", "x\n\n\n y\tz \n", "q\x1cr \x1d s", "### a<|endoftext|> b\n<|endoftext|>", "'s don't I'll  ", "\r\n\r\nfoo  bar\n", "… z  k", "a" * 3000, "é ü\n ñ"]
    for text, ids in zip(odd, bpe.encode(odd), strict=True):
        assert ids.tolist() == bpe.own.encode(text, add_special_tokens=False).ids


def test_crc_join():
    assert crc_join(zlib.crc32(b"hello"), zlib.crc32(b"worlds!"), 7) == zlib.crc32(b"helloworlds!")


def test_files(spark, docs, rows, tmp_path):
    own = ByteBpe(tokenizer_path()).own
    path = str(tmp_path / "tokens")
    write_tokens(docs, path, shard_bytes=20_000)
    assert spark.read.parquet(path).select("shard").distinct().count() > 1
    got = sorted(read_digests(spark, path).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted((r[0] for r in rows), key=lambda k: (k is None, k))
    start, bag = 0, []
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        bag.append((r["doc_id"], r["n_tokens"], r["ids_crc32"]))
    want = []
    for k, text, *_ in rows:
        x = own.encode(text or "", add_special_tokens=False).ids + [END_ID]
        want.append((k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    assert sorted(bag, key=str) == sorted(want, key=str)
    pieces = read_pieces(spark, path).collect()
    one = next(r for r in rows if r[1] == "two words")
    assert [np.frombuffer(p["ids"], "<u4").tolist() for p in pieces if p["doc_id"] == one[0]] == [own.encode("two words").ids + [END_ID]]


def test_damage(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    write_tokens(docs, str(tmp_path / "a"))
    spark.read.parquet(str(tmp_path / "a")).withColumn("crc", F.col("crc") + 1).write.parquet(str(tmp_path / "b"))
    with pytest.raises(Exception, match="damaged"):
        read_digests(spark, str(tmp_path / "b")).collect()


def test_empty(empty):
    assert token_output(empty).count() == 0


def test_ratio_on_prose(spark):
    """Whole blocks of the corpus's ids take clearly less than 9 bits an id, and less than a general compressor's."""
    import zlib

    from landloom.llm.token_output import ByteBpe, tokenizer_path

    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()]
    ids = np.concatenate([np.append(x, 2) for x in ByteBpe(tokenizer_path()).encode(texts)]).astype(np.int32)
    blocks = [ids[k : k + BLOCK] for k in range(0, len(ids) // BLOCK * BLOCK, BLOCK)]
    payloads = encode(blocks)
    assert all((a == b).all() for a, b in zip(decode(payloads, [BLOCK] * len(blocks)), blocks, strict=True))
    bits = 8 * sum(map(len, payloads)) / (BLOCK * len(blocks))
    assert bits < 8.8 and bits < 8 * sum(len(zlib.compress(b.astype("<u2").tobytes(), 6)) for b in blocks) / (BLOCK * len(blocks))


def test_compiled_coder_equals_numpy(spark):
    """The executors' coder gives the payloads of range_coder byte for byte, and reads them back."""
    from landloom.llm.jvm import functions

    rng = np.random.default_rng(2)
    blocks = [rng.integers(0, 1 << 17, BLOCK), np.zeros(BLOCK), rng.zipf(1.3, BLOCK) % 50257, rng.zipf(1.1, 3000) % 257, np.repeat(np.arange(700), 9), np.arange(33), [5], []]
    blocks = [np.array(b, np.int32) for b in blocks]
    f = functions(spark)
    table = spark.createDataFrame([(k, bytearray(b.tobytes()), len(b), zlib.crc32(b.tobytes())) for k, b in enumerate(blocks)], "block long, ids binary, n int, crc long")
    coded = table.withColumn("payload", f["TokenEncode"]("ids")).withColumn("back", f["TokenDecode"]("payload", "n", "crc", "block", "block")).orderBy("block").collect()
    assert [bytes(r["payload"]) for r in coded] == encode(blocks)
    assert [bytes(r["back"]) for r in coded] == [b.tobytes() for b in blocks]


def test_blocks_are_decoded_once(spark, docs, tmp_path):
    write_tokens(docs, str(tmp_path / "once"))
    plan = read_digests(spark, str(tmp_path / "once"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TokenDecode") == 1


def test_damaged_payloads(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    write_tokens(docs, str(tmp_path / "a"))
    whole = spark.read.parquet(str(tmp_path / "a"))
    for k, payload in enumerate((F.expr("substring(payload, 1, 40)"), F.expr("concat(substring(payload, 1, 90), X'ffff', substring(payload, 93))"))):
        whole.withColumn("payload", payload).write.parquet(str(tmp_path / f"b{k}"))
        with pytest.raises(Exception, match="damaged"):
            read_digests(spark, str(tmp_path / f"b{k}")).collect()


def test_runs_equal_whole_texts():
    """Letters, digits, signs, contractions and white space in all neighbourhoods, with single spaces and without."""
    import random

    rng = random.Random(4)
    bpe = ByteBpe(tokenizer_path())
    parts = ["the", "Été", "ñ", "µ", "ª", "²", "½", "Ł", "中", "é", "7", "2026", "٣", ".", ",", "...", "'", "'s", "'ll", "n't", "<|", "|>", "<|endoftext|>", "_", "`", "~", "×", "\n", "\n\n", "\t", "\x1c", "\x85", "\xa0", "　", " ", "  ", " ", " ", " "]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(6000)]
    texts += [" ".join("".join(rng.choices(parts[:-5], k=rng.randint(1, 4))) for _ in range(8)) for _ in range(3000)]
    for text in texts:
        assert bpe.encode([text])[0].tolist() == bpe.own.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_tokenizers_get_whole_texts(tmp_path):
    """What is not a plain byte-level BPE is not encoded by pieces."""
    import json

    spec = json.loads(open(tokenizer_path()).read())
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "lower.json").write_text(json.dumps(spec))
    bpe = ByteBpe(str(tmp_path / "lower.json"))
    assert bpe.encode(["The CAT  sat."])[0].tolist() == bpe.own.encode("The CAT  sat.", add_special_tokens=False).ids
