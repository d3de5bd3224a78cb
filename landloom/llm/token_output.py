"""Token-id output: ids of documents in ascending id order, coded in independent, checksummed blocks.

The file format is a table of blocks (Parquet, so any store Spark can write will do and Spark's commit keeps it whole
when executors are lost). Documents are range-partitioned by id; each partition is a shard whose ids, end ids included,
are cut into blocks of ``BLOCK``. A block row holds its shard and number, its count of ids, the CRC-32 of those ids (as
little-endian unsigned 32-bit integers), the payload of the range coder, and which documents it has pieces of: the
number of its first document in the shard, and per piece the document's id and number of ids. Any block can be read
without the others.

Defined results for odd input: null and empty texts have the end id alone; null ids come last; rows of one id follow one
another by text hash and each keeps its own entry; documents of any length span as many blocks as they need; extra
columns are ignored; an empty table writes no blocks and reads back no rows. A damaged block raises an error.
"""

from __future__ import annotations

import functools
import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir
from .jvm import functions
from .range_coder import BLOCK

END_ID = 2
#: Blocks that leave a shard's task at a time, and bytes of text per shard.
FLUSH = 64
SHARD_BYTES = 40_000_000
_PIECE = re.compile(r"\s*\S+|\s+\Z")
#: White space to Python that the tokenizers' pattern takes for ordinary characters.
_ODD = re.compile("[\x1c-\x1f]")
#: Runs that the tokenizers' pattern takes for one each, among characters that every version of Unicode has in one class;
#: without the apostrophe, which can start a contraction.
_RUN = re.compile(r" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+|\n")
#: What most pieces are: one such run of letters, and perhaps one of other characters.
_WORD = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")
_MEMO = 1_000_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Memory(dict):
    """Values kept as they are made, at most ``_MEMO``."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= _MEMO:
            self.clear()
        value = self[key] = self.make(key)
        return value


class _Loose(Exception):
    """A text has white space next to a space, or at an end."""


class ByteBpe:
    """Ids of texts by the tokenizers library, with a memory of pieces.

    A byte-level BPE of this kind never joins across a change from other characters to white space, so a text's ids
    are those of its pieces (white space and the run after it) in turn. Each different piece is encoded once: by the
    library's model, run by run, where ``_RUN`` tells its runs, else by the library's tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.model = self.own.model
        spec = json.loads(self.own.to_str())
        before, model, added = spec["pre_tokenizer"] or {}, spec["model"], [t["content"] for t in spec["added_tokens"]]
        #: Whether pieces may be encoded by themselves, and whether runs may.
        self.by_piece = not spec["normalizer"] and not spec["post_processor"] and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not any(c.isspace() for t in added for c in t)
        self.by_run = self.by_piece and model["type"] == "BPE" and not model["dropout"] and all("<|" in t for t in added)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.coded = [k.to_bytes(4, "little") for k in range(self.own.get_vocab_size())]
        self.runs = _Memory(self._run)
        self.pieces = _Memory(self._piece)
        self.spaced = _Memory(self._spaced)

    def _whole(self, text: str) -> bytes:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<i4").tobytes()

    def _run(self, run: str) -> bytes:
        text = run.replace(" ", "\u0120") if run.isascii() and run != "\n" else run.encode().decode("latin-1").translate(self.letters)
        coded = self.coded
        return b"".join([coded[t.id] for t in self.model.tokenize(text)])

    def _piece(self, piece: str) -> bytes:
        if self.by_run and "<|" not in piece and "\n\n" not in piece and piece[-1] != "\n":
            runs = _RUN.findall(piece)
            if sum(map(len, runs)) == len(piece):
                return self.runs[piece] if len(runs) == 1 else b"".join(map(self.runs.__getitem__, runs))
        return self._whole(piece)

    def _spaced(self, rest: str) -> bytes:
        """Ids of a space and ``rest``, between single spaces."""
        if self.by_run and (m := _WORD.fullmatch(rest)):
            word, tail = m.groups()
            return self.spaced[word] + self.runs[tail] if tail else self._run(" " + word)
        if not rest or rest[0].isspace() or rest[-1].isspace():
            raise _Loose
        return self._piece(" " + rest)

    def raw(self, text: str) -> bytes:
        """Ids of one text, little-endian in 32 bits."""
        if not text or not self.by_piece:
            return self._whole(text)
        first, *rest = text.split(" ")
        try:
            if not first or first[0].isspace() or first[-1].isspace():
                raise _Loose
            return self.pieces[first] + b"".join(map(self.spaced.__getitem__, rest))
        except _Loose:
            return self._whole(text) if _ODD.search(text) else b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self.raw(t), "<i4") for t in texts]


@functools.lru_cache(1)
def _bpe(path: str) -> ByteBpe:
    """One for each Python worker, which Spark uses for many tasks."""
    return ByteBpe(path)


_BLOCKS = "shard int, block long, n int, crc long, ids binary, first_doc long, doc_ids array<bigint>, lens array<int>"


def _cut_shard(path: str, end_id: int):
    """Texts in order -> blocks with plain ids."""
    end = np.array([end_id], "<i4").tobytes()

    def run(batches):
        bpe = _bpe(path)
        shard = TaskContext.get().partitionId()
        parts: list[bytes] = []  # ids not yet cut into blocks
        docs: list[tuple[int, int | None, int]] = []  # their documents: (number, id, ids left)
        held, made, number = 0, 0, 0

        def cut(everything: bool):
            nonlocal parts, held, made
            ids = b"".join(parts)
            whole = held if everything else held // BLOCK * BLOCK
            parts, held = [ids[4 * whole :]], held - whole
            rows: dict[str, list] = {c.split()[0]: [] for c in _BLOCKS.split(", ")}
            at = 0
            for a in range(0, whole, BLOCK):
                piece = ids[4 * a : 4 * min(a + BLOCK, whole)]
                first, names, lens, room = docs[at][0], [], [], len(piece) // 4
                while room:
                    k, name, left = docs[at]
                    take = min(room, left)
                    names.append(name)
                    lens.append(take)
                    room -= take
                    if take == left:
                        at += 1
                    else:
                        docs[at] = (k, name, left - take)
                for c, v in zip(rows, (shard, made, len(piece) // 4, zlib.crc32(piece), piece, first, names, lens), strict=True):
                    rows[c].append(v)
                made += 1
            del docs[:at]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], list(rows))

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.raw(text.as_py() or "")
                parts += [ids, end]
                docs.append((number, name, len(ids) // 4 + 1))
                number += 1
                held += len(ids) // 4 + 1
                if held >= FLUSH * BLOCK:
                    yield cut(False)
        if held:
            yield cut(True)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> None:
    """Encode ``docs`` in ascending id order and write the block table at ``path``."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shards = max(1, -(-int(size) // shard_bytes))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    dealt = d.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    payload = functions(docs.sparkSession)["TokenEncode"]("ids").alias("payload")
    blocks = dealt.mapInArrow(_cut_shard(tokenizer or tokenizer_path(), end_id), _BLOCKS)
    blocks.select("shard", "block", "n", "crc", payload, "first_doc", "doc_ids", "lens").write.parquet(path)


@functools.cache
def _zeros(power: int) -> tuple[int, ...]:
    """What 2 ** power zero bytes do to each bit of a CRC-32 (without its inversions)."""
    if power == 0:
        out = []
        for bit in range(32):
            c = 1 << bit
            for _ in range(8):
                c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
            out.append(c)
        return tuple(out)
    half = _zeros(power - 1)
    return tuple(_apply(half, v) for v in half)


def _apply(matrix: tuple[int, ...], c: int) -> int:
    out, k = 0, 0
    while c:
        if c & 1:
            out ^= matrix[k]
        c >>= 1
        k += 1
    return out


def crc_join(a: int, b: int, length: int) -> int:
    """CRC-32 of two strings in turn, from theirs and the second's length."""
    power = 0
    while length:
        if length & 1:
            a = _apply(_zeros(power), a)
        length >>= 1
        power += 1
    return a ^ b


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of documents with their ids: (shard, number, at, doc_id, n, crc, ids as little-endian 32-bit)."""
    f = functions(spark)
    ids = f["TokenDecode"]("payload", "n", "crc", "block", "shard")
    whole = spark.read.parquet(path).select("shard", "block", "first_doc", F.arrays_zip("doc_ids", "lens", f["TokenPlaces"]("lens").alias("places"), f["TokenPieces"](ids, "lens").alias("ids")).alias("docs"))
    # Outer, though no block is without documents: else Spark infers a filter and decodes once more for each of its terms.
    each = whole.select("shard", "block", "first_doc", F.posexplode_outer("docs").alias("j", "d"))
    return each.select(
        "shard",
        (F.col("first_doc") + F.col("j")).alias("number"),
        (F.col("block") * BLOCK + F.col("d.places")).alias("at"),
        F.col("d.doc_ids").alias("doc_id"),
        F.col("d.lens").cast("bigint").alias("n"),
        F.crc32("d.ids").alias("crc"),
        "d.ids",
    )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, from the decoded blocks."""
    blocks = spark.read.parquet(path)
    pieces = read_pieces(spark, path).drop("ids")
    docs = pieces.groupBy("shard", "number").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces")
    )
    # Ids in the shards before; as many rows as shards.
    totals = blocks.groupBy("shard").agg(F.sum("n").alias("ids"))
    before = totals.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))

    def join(batches):
        for batch in batches:
            crcs = []
            for pieces in batch.column(3).to_pylist():
                crc = pieces[0]["crc"]
                for p in pieces[1:]:
                    crc = crc_join(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return docs.join(before, "shard").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "pieces").mapInArrow(join, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id") -> DataFrame:
    """Write ``docs`` as token blocks (in the shared folder, or at ``path``) and digest them from the files."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id, id_col)
    return read_digests(spark, path)
