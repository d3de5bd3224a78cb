"""Knowledge base: chunking, embeddings, retrieval and statistics."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

CHUNK = "source string, text string, heading string, breadcrumb string, chunk_index int, token_count int"
_CJK = re.compile("[一-鿿]")
_STOP = re.compile("(?<=[。！？])")
_HEADING = re.compile(r"^(#{1,6})\s+(.*)$")


def token_estimate(text: Column) -> Column:
    """One and a half tokens per CJK character and one per other word."""
    t = F.coalesce(text, F.lit(""))
    han = F.regexp_count(t, F.lit("[\\x{4E00}-\\x{9FFF}]"))
    rest = F.regexp_replace(t, "[\\x{4E00}-\\x{9FFF}]", " ")
    words = F.regexp_count(rest, F.lit(r"\S+"))
    return F.floor(1.5 * han + words).cast("int")


def _tokens(text: str) -> int:
    return int(1.5 * len(_CJK.findall(text)) + len(_CJK.sub(" ", text).split()))


def sections(text: str) -> list[tuple[str, str, str]]:
    """(heading, breadcrumb, body) by Markdown headings; text before the first has none."""
    out, trail, body, now = [], {}, [], ("", "")
    for line in text.split("\n"):
        m = _HEADING.match(line)
        if not m:
            body.append(line)
            continue
        if "\n".join(body).strip():
            out.append((*now, "\n".join(body).strip()))
        level = len(m.group(1))
        trail = {k: v for k, v in trail.items() if k < level} | {level: m.group(2).strip()}
        now, body = (m.group(2).strip(), " > ".join(trail[k] for k in sorted(trail))), []
    if "\n".join(body).strip():
        out.append((*now, "\n".join(body).strip()))
    return out


def _pieces(text: str, most: int, overlap: int, by_sentence: bool) -> list[str]:
    """Accumulate units up to the budget; the next piece starts with units worth the overlap."""
    units = [u for u in (_STOP.split(text) if by_sentence else re.split("(?<=[。！？])|\n+", text)) if u and u.strip()]
    small: list[str] = []
    for u in units:  # a unit beyond one and a half budgets is split by words
        words = u.split()
        if _tokens(u) > 1.5 * most and len(words) > 1:
            small += [" ".join(words[k : k + most]) for k in range(0, len(words), most)]
        else:
            small.append(u)
    out, now = [], []
    for u in small:
        if now and sum(map(_tokens, now)) + _tokens(u) > most:
            out.append("\n".join(now))
            tail: list[str] = []
            for v in reversed(now):
                if sum(map(_tokens, tail)) + _tokens(v) > overlap:
                    break
                tail.insert(0, v)
            now = tail
        now.append(u)
    if now:
        out.append("\n".join(now))
    return out


def chunk_text(text: str, strategy: str = "heading", most: int = 512, overlap: int = 50, least: int = 20) -> list[tuple[str, str, str, int]]:
    """(text, heading, breadcrumb, tokens): by heading, fixed budget or sentence; tiny chunks join the one before."""
    parts = sections(text) if strategy == "heading" else [("", "", text)]
    raw = [(p, h, b) for h, b, body in parts for p in _pieces(body, most, overlap if strategy != "heading" else 0, strategy == "sentence")]
    out: list[list] = []
    for p, h, b in raw:
        if out and _tokens(p) < least and out[-1][1] == h:
            out[-1][0] += "\n" + p
        else:
            out.append([p, h, b])
    return [(p, h, b, _tokens(p)) for p, h, b in out]


def chunk(docs: DataFrame, source: str = "source", text: str = "text", **options) -> DataFrame:
    """One row per chunk of every document."""

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for s, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, (p, h, b, n) in enumerate(chunk_text(t.as_py() or "", **options)):
                    for column, v in zip(rows, (s, p, h, b, k, n), strict=True):
                        column.append(v)
            kinds = [pa.string()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], [c.split()[0] for c in CHUNK.split(", ")])

    return docs.select(F.col(source).cast("string"), F.col(text).cast("string")).mapInArrow(run, CHUNK)


def hash_embedding(text: str, size: int = 384) -> np.ndarray:
    """A unit vector fixed by the text's MD5 (where no model is at hand)."""
    seed = int.from_bytes(hashlib.md5((text or "").encode()).digest()[:4], "big")
    v = np.random.RandomState(seed).randn(size).astype(np.float32)
    return v / np.linalg.norm(v)


def embed(chunks: DataFrame, size: int = 384, text: str = "text") -> DataFrame:
    schema = chunks.drop("embedding").schema.add("embedding", ArrayType(FloatType()))

    def run(batches):
        for batch in batches:
            vectors = [hash_embedding(t.as_py(), size).tolist() for t in batch.column(batch.schema.get_field_index(text))]
            yield batch.append_column("embedding", pa.array(vectors, pa.list_(pa.float32())))

    return chunks.drop("embedding").mapInArrow(run, schema)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def top_k(vectors: DataFrame, query: list[float], k: int = 5, least: float | None = None, prefix: str | None = None, key: str = "vec_id", column: str = "embedding", compat: bool = False) -> DataFrame:
    """The k nearest by cosine. ``compat`` filters after fetching 3 k, and so may return fewer."""
    scored = vectors.withColumn("score", cosine(F.col(column), F.array(*[F.lit(float(x)) for x in query])))
    keep = F.lit(True)
    if least is not None:
        keep = keep & (F.col("score") >= least)
    if prefix is not None:
        keep = keep & F.col("source").startswith(prefix)
    order = [F.col("score").desc(), F.col(key)]
    if compat:
        return scored.orderBy(*order).limit(3 * k).filter(keep).orderBy(*order).limit(k)
    return scored.filter(keep).orderBy(*order).limit(k)


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?U)[\\w\\x{4E00}-\\x{9FFF}]+"), F.lit(0)))


def keyword_score(text: Column, query: str) -> Column:
    """Share of the query's tokens that the text has."""
    q = token_set(F.lit(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, token_set(text))).cast("double"), F.size(q)), F.lit(0.0))


def search(docs: DataFrame, query: str, vectors: DataFrame | None = None, query_vector: list[float] | None = None, k: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keyword hits and, for rows they miss, vector hits: (key, score, via), best first."""
    words = docs.withColumn("score", keyword_score(F.col(text), query)).filter("score > 0").select(key, "score", F.lit("keyword").alias("via"))
    words = words.orderBy(F.col("score").desc(), key).limit(k)
    if vectors is None or query_vector is None:
        return words
    near = top_k(vectors, query_vector, 2 * k, key=key).select(key, "score", F.lit("vector").alias("via"))
    return words.unionByName(near.join(words, key, "left_anti")).orderBy(F.col("score").desc(), key).limit(k)


def stats(chunks: DataFrame) -> DataFrame:
    """Chunks and tokens per source."""
    return chunks.groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum("token_count").cast("bigint").alias("n_tokens"))


def context(hits: DataFrame) -> DataFrame:
    """All hits as one text, best first; hits are a top-k result."""
    line = F.format_string("[%s] (%.4f)\n%s", F.col("source"), F.col("score"), F.col("text"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("source"), line.alias("t"))))
    return hits.agg(F.array_join(F.transform(ranked, lambda x: x["t"]), "\n\n").alias("context"))


def add_document(chunks: DataFrame | None, docs: DataFrame, tags: list[str] = (), region: str | None = None, year: int | None = None, **options) -> DataFrame:
    """Chunks of new documents with their metadata, appended to those of other sources (a source is replaced)."""
    meta = [F.lit(x) for kv in (("tags", ",".join(tags)), ("region", region or ""), ("year", str(year or ""))) for x in kv]
    new = embed(chunk(docs, **options)).withColumn("metadata", F.create_map(*meta))
    return new if chunks is None else chunks.join(new.select("source").distinct(), "source", "left_anti").unionByName(new)


def save(chunks: DataFrame, path: str) -> None:
    """Rebuild: the table is replaced as a whole."""
    chunks.write.mode("overwrite").parquet(path)
