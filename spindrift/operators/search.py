"""Exact search: scores, top k, spread, explanation, hydration under a byte cap."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import cosine
from ..session import ship
from ..verdicts import Refused

K_MOST, POOL_MOST, DEFAULT_K, DEFAULT_POOL = 25, 80, 10, 20
WEAK_SPREAD, WEAK_POOL_SPREAD = 0.06, 0.05
RESPONSE_BYTES = 60_000


def check_range(name: str, value: int, most: int) -> int:
    if not 1 <= value <= most:
        raise Refused("invalid_request", f"{name} is {value}, outside 1..{most}", f"pass {name} in that range")
    return value


def check_size(chunks: DataFrame, query: list[float]) -> None:
    """Refuses a query whose size no vector of the index has; the first vector tells, as an index has one size."""
    found = chunks.where("vector IS NOT NULL").select(F.size("vector").alias("n")).limit(1).collect()
    if found and found[0].n != len(query):
        raise Refused("invalid_request", f"the query has {len(query)} numbers, the index's vectors have {found[0].n}", "embed the query with the model of the index")


def embed_query(header, query: str, embed) -> list[float]:
    """The query's vector by the index's own model and prefix; any other embedder is refused, never put in its place.

    header: the index's header row. embed: has `name`, the model that it is, and may have installed(), which asks its server.
    """
    if embed.name != header["model"]:
        raise Refused("model_not_found", f"the index was built with {header['model']!r}, and the embedder is {embed.name!r}", f"embed with {header['model']}")
    if hasattr(embed, "installed") and not embed.installed():
        raise Refused("model_not_found", f"the index's model {header['model']!r} is not installed", f"install {header['model']}")
    return embed([header["query_prefix"] + query])[0]


def scored(chunks: DataFrame, query: list[float]) -> DataFrame:
    """Adds cosine to every row of chunks(vector, ...); the query is a literal, so nothing is joined."""
    vector = F.array(*(F.lit(float(x)) for x in query))
    return chunks.withColumn("cosine", cosine(F.col("vector"), vector))


def top(rows: DataFrame, k: int) -> DataFrame:
    """The first k by cosine, ties by ordinal, with rank: each task keeps k rows. What has no cosine has no rank."""
    best = rows.where("cosine IS NOT NULL").orderBy(F.desc("cosine"), "ordinal").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("cosine"), "ordinal")).cast("bigint"))


def search(chunks: DataFrame, query: list[float], k: int = DEFAULT_K) -> DataFrame:
    """Citations of the k nearest chunks: rank, ordinal, cosine, spread and weak_ranking; text is left out."""
    check_range("k", k, K_MOST)
    check_size(chunks, query)
    best = top(scored(chunks, query), k)
    spread = F.max("cosine").over(W.partitionBy()) - F.min("cosine").over(W.partitionBy())
    best = best.withColumn("spread", spread).withColumn("weak_ranking", F.col("spread") < WEAK_SPREAD)
    return best.drop("vector", "norm", "text")


def pool_spread(chunks: DataFrame, query: list[float], pool: int = DEFAULT_POOL) -> DataFrame:
    check_range("pool", pool, POOL_MOST)
    check_size(chunks, query)
    best = top(scored(chunks, query), pool).agg(F.count("*").alias("pool"), (F.max("cosine") - F.min("cosine")).alias("spread"))
    return best.withColumn("flat", (F.col("pool") > 1) & (F.col("spread") < WEAK_POOL_SPREAD))


def explain(chunks: DataFrame, query: list[float], needle: str, hits: int = 10) -> DataFrame:
    """rank, of, ordinal, cosine, in_pool, diagnosis of the first chunks that hold a text; one row with null rank if none does.

    The first hits are few and known to the driver; their ranks are counts over all chunks in one pass, so no global
    sort is needed.
    """
    if not needle:
        raise Refused("invalid_request", "no text to look for", "pass a phrase you expect to find")
    spark = chunks.sparkSession
    check_size(chunks, query)
    rows = scored(chunks, query).where("cosine IS NOT NULL").select("ordinal", "cosine", "text")
    found = rows.where(F.contains(F.lower("text"), F.lit(needle.lower()))).orderBy(F.desc("cosine"), "ordinal").limit(hits).select("ordinal", "cosine").collect()
    schema = "rank bigint, of bigint, ordinal bigint, cosine double, in_pool boolean, diagnosis string"
    if not found:
        return spark.createDataFrame([(None, rows.count(), None, None, False, "recall_failure_or_not_indexed")], schema)
    ahead = [F.count_if((F.col("cosine") > h["cosine"]) | ((F.col("cosine") == h["cosine"]) & (F.col("ordinal") < h["ordinal"]))) for h in found]
    got = rows.agg(F.count("*"), *ahead).first()
    ranks = [n + 1 for n in got[1:]]
    diagnosis = "no_failure" if ranks[0] <= DEFAULT_K else "ranking_failure" if ranks[0] <= DEFAULT_POOL else "recall_failure"
    return spark.createDataFrame([(r, got[0], h["ordinal"], h["cosine"], r <= DEFAULT_POOL, diagnosis) for r, h in zip(ranks, found, strict=True)], schema)


def hydrate(chunks: DataFrame, generation: str, ids: list[str], cap: int = RESPONSE_BYTES) -> DataFrame:
    """ordinal, id, state (ok, not_in_index, omitted_for_size), file, heading, line_start, line_end, text of the chunks
    asked for, in order.

    chunks: (ordinal, text) and the other columns where it has them. The cap counts the bytes of the reply as JSON. Ids of another generation refuse the whole request, and so do malformed ones. A chunk that does not fit under the
    cap is left out and later ones may still fit. Equal ordinals are one; the last spelling names it.
    """
    if not ids:
        raise Refused("invalid_request", "no ids given", "search first")
    parts = [(i, *i.partition(":")[::2]) for i in ids]
    wrong = [i for i, _, o in parts if not (o.isascii() and o.isdigit())]
    stale = [i for i, g, o in parts if i not in wrong and g != generation]
    if stale:
        raise Refused("stale_id", f"{len(stale)} ids are of another generation: {', '.join(stale[:5])}", "search again")
    if wrong:
        raise Refused("invalid_request", f"not chunk ids: {', '.join(wrong[:5])}", "pass ids as search returns them")
    wanted = {int(o): i for i, _, o in parts}
    spark = chunks.sparkSession
    asked = spark.createDataFrame(sorted(wanted.items()), "ordinal bigint, id string")
    kinds = {"file": "string", "heading": "string", "line_start": "bigint", "line_end": "bigint"}
    known = chunks.select("ordinal", "text", *(F.col(c) if c in chunks.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()))
    rows = F.broadcast(asked).join(known.where(F.col("ordinal").isin(*wanted)), "ordinal", "left")
    state = fitted(rows, cap).select("ordinal", "state")
    ok = F.col("state") == "ok"
    return rows.join(F.broadcast(state), "ordinal").select("ordinal", "id", "state", *(F.when(ok, F.col(c)).alias(c) for c in (*kinds, "text")))


def reply_bytes(id="id", file="file", heading="heading", start="line_start", end="line_end", text="text"):
    """UTF-8 bytes of a chunk in a reply: JSON with a blank after each comma and colon, of id, path, heading, lines, text."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    item = F.struct(c(id).alias("id"), c(file).alias("path"), F.coalesce(c(heading), F.lit("")).alias("heading"), F.array(c(start), c(end)).alias("lines"), c(text).alias("text"))
    return F.octet_length(F.to_json(item, {"ignoreNullFields": "false"})).cast("bigint") + 10


def fitted(rows: DataFrame, cap: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, ordinal, id, state of rows(ordinal, id, file, heading, line_start, line_end, text): what fits in order, skipping what does not.

    A reply is a JSON object with a list: 14 bytes, and two between items. Sizes alone are sorted and read as a stream, a
    group in one task, which holds one number; texts stay where they are.
    """
    ship(rows.sparkSession)
    kinds = {"file": "string", "heading": "string", "line_start": "bigint", "line_end": "bigint"}
    rows = rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c not in rows.columns))
    sizes = rows.select(*by, "ordinal", "id", F.when(F.col("text").isNotNull(), reply_bytes()).alias("size"))
    sizes = (sizes.repartition(*by) if by else sizes.repartition(1)).sortWithinPartitions(*by, "ordinal")
    frame = 14

    def run(batches):
        key, used, held = None, frame, 0
        for batch in batches:
            states = []
            groups = zip(*(batch.column(c).to_pylist() for c in by), strict=True) if by else iter([()] * batch.num_rows)
            for group, size in zip(groups, batch.column("size").to_pylist(), strict=True):
                if group != key:
                    key, used, held = group, frame, 0
                if size is None:
                    states.append("not_in_index")
                elif used + size + 2 * (held > 0) <= cap:
                    used, held = used + size + 2 * (held > 0), held + 1
                    states.append("ok")
                else:
                    states.append("omitted_for_size")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(states, pa.string())], [*batch.schema.names[:-1], "state"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sizes.drop("size").schema) + ", state string"
    return sizes.mapInArrow(run, schema)


QUERY_BYTES = 64 << 20  # of query vectors that are sent to all workers; more are dealt out
PACK_BYTES, BATCH_BYTES = 1 << 21, 1 << 24  # of a pack's vectors, and of the pairs of packs that a worker is given at once
TOGETHER = 128  # queries of a block that meet a pack in one product


def _packed(rows: DataFrame, key: str, most: int) -> DataFrame:
    """keys, size, vectors: up to `most` rows(key, vector) of one size, of PACK_BYTES at most, in packed arrays; null, empty and partly null vectors are left out."""

    def run(batches):
        import numpy as np

        for batch in batches:
            batch = batch.filter(pa.compute.and_(batch.column("vector").is_valid(), batch.column(key).is_valid()))
            sizes = pa.compute.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
            for size in sorted(set(sizes.tolist()) - {0}):
                some = batch.filter(pa.array(sizes == size))
                flat = pa.compute.list_flatten(some.column("vector"))
                v = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
                whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, size).all(1)
                keys, v = some.column(key).to_numpy(zero_copy_only=False)[whole].astype("<i8"), v[whole]
                step = max(1, min(most, PACK_BYTES // (8 * size)))
                for at in range(0, len(keys), step):
                    yield pa.RecordBatch.from_arrays([pa.array([keys[at : at + step].tobytes()], pa.binary()), pa.array([size], pa.int32()), pa.array([v[at : at + step].tobytes()], pa.binary())], ["keys", "size", "vectors"])

    return rows.select(F.col(key).cast("long").alias(key), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "keys binary, size int, vectors binary")


def many(chunks: DataFrame, queries: DataFrame, k: int = DEFAULT_K, block: int = 1024) -> DataFrame:
    """qid, rank, ordinal, cosine: the k nearest chunks of each of queries(qid, vector).

    Queries are packed into blocks and chunks into packs where they are; a block meets a pack in one matrix product that
    keeps k a query, of equal cosines those with the least ordinals, and these few are ranked by query. Cosines are equal
    if they agree to twelve decimals. The chunks are scanned once. Blocks are sent to all workers where they take
    QUERY_BYTES at most, else both sides are dealt out. Null vectors, and pairs of different sizes, have no cosine and no
    rank.
    """
    check_range("k", k, K_MOST)
    ship(chunks.sparkSession)
    chunks.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))  # a pair of packs is a few MB
    blocks = _packed(queries, "qid", block).select(F.col("keys").alias("qids"), F.col("size").alias("qsize"), F.col("vectors").alias("asked"))
    bytes_ = queries.agg(F.sum(8 * F.size("vector"))).first()[0] or 0
    pairs = _packed(chunks, "ordinal", 4096).crossJoin(F.broadcast(blocks) if bytes_ <= QUERY_BYTES else blocks)

    def run(batches):
        import numpy as np

        for batch in batches:
            for i in range(batch.num_rows):
                size = batch.column("size")[i].as_py()
                if batch.column("qsize")[i].as_py() != size:
                    continue
                qids, asked, ordinals, vectors = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("qids", "<i8"), ("asked", float), ("keys", "<i8"), ("vectors", float)))
                order = np.argsort(ordinals, kind="stable")
                ordinals, v, every = ordinals[order], vectors.reshape(-1, size)[order], asked.reshape(-1, size)
                norms, n = np.sqrt((v * v).sum(1))[:, None], min(k, len(ordinals))
                for at in range(0, len(every), TOGETHER):
                    q = every[at : at + TOGETHER]
                    with np.errstate(all="ignore"):
                        c = np.round(np.nan_to_num((v @ q.T) / (norms * np.sqrt((q * q).sum(1))[None, :])), 12)
                    cut = np.partition(c, len(c) - n, 0)[len(c) - n]
                    above, tied = c > cut, c == cut
                    row, col = np.nonzero(above | tied & (np.cumsum(tied, 0, dtype=np.int32) <= n - above.sum(0)))  # rows are in order of their ordinals
                    yield pa.RecordBatch.from_arrays([pa.array(qids[at + col]), pa.array(ordinals[row]), pa.array(c[row, col])], ["qid", "ordinal", "cosine"])

    out = pairs.select("qids", "qsize", "asked", "keys", "size", "vectors").mapInArrow(run, "qid long, ordinal long, cosine double")
    best = out.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("cosine"), "ordinal")).cast("bigint"))
    return best.where(F.col("rank") <= k)


NOTE = "positions and text are as of built_at; files may have changed since"


def cited(rows: DataFrame, header: DataFrame) -> DataFrame:
    """Adds id, citation, model, built_at and a note on staleness to rows(ordinal, file, line_start, line_end, heading).

    header: the index's one row; a field that it lacks is "unknown", never guessed.
    """
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(c)
    one = F.broadcast(header.select("generation", known("model"), known("built_at")).limit(1))
    out = rows.join(one, F.lit(True)).withColumn("id", T.chunk_id("generation", "ordinal"))
    return out.withColumn("citation", T.citation("file", "line_start", "line_end", "heading")).withColumn("note", F.lit(NOTE)).drop("generation")


def with_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("snippet", T.snippet("text"))
