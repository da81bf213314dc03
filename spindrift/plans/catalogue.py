"""Every registered query of the engine's own operators, with the SQL that says the same.

Where the star schema has no counterpart, small tables are given as values; the same values stand in the SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import budget, calls, chunking, code, decisions, index, integrity, rerank, search
from ..session import scratch, ship
from ..sources import commit, index_json, markdown, ordered
from ..sources.models import HashEmbedder, OverlapDecider, OverlapScorer, decided

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
MODEL = "nomic-embed-text"
LIMIT = 2048


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(spark, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _sql_values(name: str, columns: str, rows: list[tuple]) -> str:
    def lit(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(lit, x)) + "]"
        if isinstance(x, dict):
            return "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in x.items()) + "}" if x else "MAP {}"
        return repr(x)

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


# --- search ---------------------------------------------------------------------------------------------------------


def _chunks(spark, sf_dir) -> DataFrame:
    return index.vectors_of(_table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("ordinal"), "vector", "norm", "label")


def _query_vector(spark, sf_dir, vec_id: int = 0) -> list[float]:
    row = _table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0])


def _texts(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), "text")
    return _chunks(spark, sf_dir).join(docs, "ordinal")


_SCORES = """
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id AS ordinal, label, list_dot_product(embedding::DOUBLE[], v) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v))) AS cosine FROM embeddings, q),
r AS (SELECT *, row_number() OVER (ORDER BY cosine DESC, ordinal) AS rank FROM s)"""


@query(f"""WITH {_SCORES}, t AS (SELECT * FROM r WHERE rank <= 10)
SELECT rank, ordinal, d.source || '/' || ordinal AS path, round(cosine, 6) AS cosine, round((SELECT max(cosine) - min(cosine) FROM t), 6) AS spread,
  (SELECT max(cosine) - min(cosine) FROM t) < 0.06 AS weak_ranking FROM t LEFT JOIN documents d ON d.doc_id = ordinal""")
def topk_citations(spark, sf_dir):
    best = search.search(_chunks(spark, sf_dir), _query_vector(spark, sf_dir), 10)
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), "source")
    rows = docs.join(F.broadcast(best), "ordinal", "right")  # best has ten rows
    return rows.select("rank", "ordinal", F.concat("source", F.lit("/"), F.col("ordinal").cast("string")).alias("path"), F.round("cosine", 6).alias("cosine"), F.round("spread", 6).alias("spread"), "weak_ranking")


@query(f"WITH {_SCORES} SELECT ordinal, round(cosine, 6) AS cosine FROM s")
def score_all(spark, sf_dir):
    return search.scored(_chunks(spark, sf_dir), _query_vector(spark, sf_dir)).select("ordinal", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {_SCORES}, t AS (SELECT * FROM r WHERE rank <= 5) SELECT count(*) AS k, round(max(cosine) - min(cosine), 6) AS spread, max(cosine) - min(cosine) < 0.06 AS weak_ranking FROM t")
def spread_flag(spark, sf_dir):
    best = search.top(search.scored(_chunks(spark, sf_dir), _query_vector(spark, sf_dir)), 5)
    spread = F.max("cosine") - F.min("cosine")
    return best.agg(F.count("*").alias("k"), F.round(spread, 6).alias("spread"), (spread < search.WEAK_SPREAD).alias("weak_ranking"))


@query(f"WITH {_SCORES}, t AS (SELECT * FROM r WHERE rank <= 20) SELECT count(*) AS pool, round(max(cosine) - min(cosine), 6) AS spread, count(*) > 1 AND max(cosine) - min(cosine) < 0.05 AS flat FROM t")
def pool_spread(spark, sf_dir):
    return search.pool_spread(_chunks(spark, sf_dir), _query_vector(spark, sf_dir)).withColumn("spread", F.round("spread", 6))


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size FROM embeddings),
s AS (SELECT q.vec_id AS qid, c.vec_id AS ordinal, list_dot_product(c.v, q.v) / (c.size * q.size) AS cosine FROM n q JOIN n c ON q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, ordinal) AS rank FROM s)
SELECT qid, rank, ordinal, round(cosine, 6) AS cosine FROM r WHERE rank <= 10""")
def multi_query_topk(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    asked = chunks.where(F.col("ordinal") % 100 == 0).select(F.col("ordinal").alias("qid"), "vector")
    return search.many(chunks, asked, 10).select("qid", "rank", "ordinal", F.round("cosine", 6).alias("cosine"))


_EXPLAIN = f"""WITH {_SCORES}, m AS (SELECT r.* FROM r JOIN documents d ON d.doc_id = r.ordinal),
o AS (SELECT *, row_number() OVER (ORDER BY cosine DESC, ordinal) AS k, count(*) OVER () AS n FROM m),
h AS (SELECT o.* FROM o JOIN documents d ON d.doc_id = o.ordinal WHERE contains(lower(d.text), 'license') ORDER BY k LIMIT 10)"""


@query(f"{_EXPLAIN} SELECT k AS rank, n AS of, ordinal, round(cosine, 6) AS cosine, k <= 20 AS in_pool FROM h")
def explain_rank(spark, sf_dir):
    return search.explain(_texts(spark, sf_dir), _query_vector(spark, sf_dir), "License").select("rank", "of", "ordinal", F.round("cosine", 6).alias("cosine"), "in_pool")


@query(f"""{_EXPLAIN}, b AS (SELECT min(k) AS k FROM h)
SELECT 'license' AS needle, CASE WHEN k IS NULL THEN 'recall_failure_or_not_indexed' WHEN k <= 10 THEN 'no_failure' WHEN k <= 20 THEN 'ranking_failure' ELSE 'recall_failure' END AS diagnosis FROM b
UNION ALL SELECT 'no such phrase anywhere', 'recall_failure_or_not_indexed'""")
def explain_diagnosis(spark, sf_dir):
    rows, q = _texts(spark, sf_dir), _query_vector(spark, sf_dir)
    out = [search.explain(rows, q, n).limit(1).select(F.lit(n).alias("needle"), "diagnosis") for n in ("license", "no such phrase anywhere")]
    return out[0].unionByName(out[1])


_IDS = ["abc123def456:0003", "abc123def456:0001", "abc123def456:7", "abc123def456:0007", "abc123def456:99999999"]


@query("""SELECT w.ordinal, w.id, CASE WHEN d.text IS NULL THEN 'not_in_index' ELSE 'ok' END AS state, length(d.text) AS chars
FROM (VALUES (1, 'abc123def456:0001'), (3, 'abc123def456:0003'), (7, 'abc123def456:0007'), (99999999, 'abc123def456:99999999')) w(ordinal, id) LEFT JOIN documents d ON d.doc_id = w.ordinal""")
def get_by_ids(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), "text")
    got = search.hydrate(docs, "abc123def456", _IDS, cap=10**9)
    return got.select(F.col("ordinal").cast("int").alias("ordinal"), "id", "state", F.length("text").cast("bigint").alias("chars"))


@query("SELECT 'stale_id' AS verdict, '1 ids are of another generation: 999999:0000' AS error UNION ALL SELECT 'invalid_request', 'not chunk ids: nonsense'")
def get_stale_ids(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), "text")
    out = []
    for ids in (["999999:0000", "nonsense"], ["nonsense"]):
        try:
            search.hydrate(docs, "abc123def456", ids)
        except search.Refused as e:
            out.append((e.verdict, e.error))
    return _values(spark, "verdict string, error string", out)


@query("""WITH RECURSIVE j AS (SELECT source, doc_id, 10 + strlen(to_json({'id': doc_id::VARCHAR, 'path': coalesce(source, 'none') || '/' || doc_id || '.md', 'heading': '', 'lines': [1, 1], 'text': text})::VARCHAR) AS n FROM documents WHERE text IS NOT NULL),
d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM j),
f AS (SELECT source, doc_id, k, CASE WHEN 14 + n <= 20000 THEN 14 + n ELSE 14 END AS used, (14 + n <= 20000)::INT AS held, 14 + n <= 20000 AS fits FROM d WHERE k = 1
  UNION ALL SELECT d.source, d.doc_id, d.k, CASE WHEN f.used + d.n + 2 * least(held, 1) <= 20000 THEN f.used + d.n + 2 * least(held, 1) ELSE f.used END, held + (f.used + d.n + 2 * least(held, 1) <= 20000)::INT, f.used + d.n + 2 * least(held, 1) <= 20000
  FROM f JOIN d ON d.source IS NOT DISTINCT FROM f.source AND d.k = f.k + 1)
SELECT source, doc_id, CASE WHEN fits THEN 'ok' ELSE 'omitted_for_size' END AS state FROM f UNION ALL SELECT source, doc_id, 'not_in_index' FROM documents WHERE text IS NULL""")
def get_byte_cap(spark, sf_dir):
    rows = _corpus(spark, sf_dir).select("source", F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("id"), "file", F.lit("").alias("heading"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), "text")
    return search.fitted(rows, 20_000, ("source",)).select("source", F.col("ordinal").alias("doc_id"), "state")


@query(f"""WITH {_SCORES} SELECT r.ordinal, 'abc123def456:' || lpad(r.ordinal::VARCHAR, greatest(4, length(r.ordinal::VARCHAR))::INT, '0') AS id, round(cosine, 6) AS cosine, CASE WHEN d.text IS NULL THEN 'not_in_index' ELSE 'ok' END AS state, d.text
FROM r LEFT JOIN documents d ON d.doc_id = r.ordinal WHERE rank <= 10""")
def search_then_get(spark, sf_dir):
    """A search's citations first, and then the texts of the ids it gave."""
    best = search.search(_chunks(spark, sf_dir), _query_vector(spark, sf_dir), 10).select("ordinal", "cosine", T.chunk_id(F.lit("abc123def456"), "ordinal").alias("id")).collect()  # ten rows
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), "text")
    got = search.hydrate(docs, "abc123def456", [r.id for r in best], cap=10**9)
    scores = _values(spark, "id string, cosine double", [(r.id, r.cosine) for r in best])
    return got.join(F.broadcast(scores), "id").select(F.col("ordinal").cast("long").alias("ordinal"), "id", F.round("cosine", 6).alias("cosine"), "state", "text")


_REFUSED = [("another model", "model_not_found"), ("model not installed", "model_not_found"), ("another size", "invalid_request"), ("k out of range", "invalid_request"), ("no text", "invalid_request")]


@query(f"""WITH {_sql_values('w', '"case", verdict', _REFUSED)}, n AS (SELECT count(*) AS n FROM embeddings WHERE len(embedding) <> 64)
SELECT "case", verdict FROM w, n WHERE n = 0""")
def search_refusals(spark, sf_dir):
    """What a search refuses instead of ranking it: vectors of another model or size never meet the index's own."""

    class Absent(HashEmbedder):
        def installed(self):
            return False

    chunks, header = _chunks(spark, sf_dir), {"model": "offline-hash", "query_prefix": ""}
    cases = {
        "another model": lambda: search.embed_query(header, "x", HashEmbedder(name="other")), "model not installed": lambda: search.embed_query(header, "x", Absent()),
        "another size": lambda: search.search(chunks, [1.0] * 63), "k out of range": lambda: search.search(chunks, [1.0] * 64, 26), "no text": lambda: search.explain(chunks, [1.0] * 64, ""),
    }
    out = []
    for name, call in cases.items():
        try:
            call()
            out.append((name, "ok"))
        except search.Refused as e:
            out.append((name, e.verdict))
    return _values(spark, "case string, verdict string", out)


@query(f"""WITH {_SCORES} SELECT rank, 'abc123def456:' || lpad(ordinal::VARCHAR, greatest(4, length(ordinal::VARCHAR))::INT, '0') AS id, 'd/' || ordinal || ':' || (label + 1) || '-' || (label + 3) || CASE WHEN label % 2 = 0 THEN '  (L' || label || ')' ELSE '' END AS citation,
'm' AS model, 'unknown' AS built_at, 'positions and text are as of built_at; files may have changed since' AS note FROM r WHERE rank <= 10""")
def cited_results(spark, sf_dir):
    """Citations with the header's fields, unknown where it has none, and the note on staleness."""
    best = search.top(search.scored(_chunks(spark, sf_dir), _query_vector(spark, sf_dir)), 10)
    rows = best.select("rank", "ordinal", F.concat(F.lit("d/"), F.col("ordinal").cast("string")).alias("file"), (F.col("label") + 1).alias("line_start"), (F.col("label") + 3).alias("line_end"), F.when(F.col("label") % 2 == 0, F.concat(F.lit("L"), F.col("label").cast("string"))).otherwise("").alias("heading"))
    header = _values(spark, "generation string, model string, built_at string", [("abc123def456", "m", None)])
    return search.cited(rows, header).select("rank", "id", "citation", "model", "built_at", "note")


# --- identity and chunks --------------------------------------------------------------------------------------------


def _corpus(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), "text", "source", "doc_id")


_FILES = "f AS (SELECT coalesce(source, 'none') || '/' || doc_id || '.md' AS file, text, source, doc_id, substr(sha256(text), 1, 16) AS digest FROM documents)"


@query(f"WITH {_FILES} SELECT file, digest FROM f")
def corpus_digest(spark, sf_dir):
    return index.digests(_corpus(spark, sf_dir)).select("file", "digest")


@query(f"""WITH {_FILES} SELECT source, substr(sha256('2' || chr(0) || 'nomic-embed-text' || chr(0) || 'search_document: ' || chr(0) || 'search_query: ' || chr(0) || '1500' || chr(0)
  || string_agg(file || chr(0) || digest || chr(0), '' ORDER BY string_split(file, '/'))), 1, 12) AS generation, count(*) AS file_count FROM f GROUP BY source""")
def index_generation(spark, sf_dir):
    doc, q = T.prefixes_for(MODEL)
    return index.generation(index.digests(_corpus(spark, sf_dir)), model=MODEL, doc_prefix=doc, query_prefix=q, by=("source",))


def _markdown(spark, sf_dir) -> DataFrame:
    part = F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), F.col("text"))
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("t")))).alias("x"))
    return turns.select("conv_id", F.array_join(F.transform("x", lambda r: r["t"]), "\n\n").alias("text"))


# Lines of the conversations' markdown; chr(10) alone ends a line there, and blocks carry text, lines and heading.
_BLOCKS = r"""
md AS (SELECT conv_id, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
ln AS (SELECT conv_id, n, string_split(text, chr(10))[n] AS line FROM (SELECT conv_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM md)),
fl AS (SELECT *, regexp_matches(line, '^\s*$') AS blank, sum(CASE WHEN regexp_matches(line, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY n) AS fences,
  sum(CASE WHEN regexp_matches(line, '^\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY n) AS island FROM ln),
b0 AS (SELECT conv_id, island, trim(string_agg(line, chr(10) ORDER BY n), chr(10) || chr(9) || ' ') AS text, min(n) AS line_start, max(n) AS line_end, max(fences) AS fences, first(line ORDER BY n) AS head FROM fl WHERE NOT blank GROUP BY conv_id, island),
b1 AS (SELECT *, CASE WHEN fences % 2 = 0 AND regexp_matches(trim(head), '^#{1,6}\s+\S') THEN regexp_extract(trim(head), '^#{1,6}\s+(\S.*?)\s*#*\s*$', 1) END AS h FROM b0),
b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY line_start) - 1 AS pos, text, line_start, line_end, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY line_start ROWS UNBOUNDED PRECEDING), '') AS heading FROM b1)"""


@query(f"WITH {_BLOCKS} SELECT conv_id, pos, text, line_start, line_end, heading FROM b")
def paragraph_blocks(spark, sf_dir):
    return chunking.paragraph_blocks(_markdown(spark, sf_dir), "conv_id")


_SLICES = """
d AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents),
a AS (SELECT doc_id, t, unnest(range(0, length(t), 1300)) AS o FROM d WHERE length(t) > 1500),
p AS (SELECT doc_id, t, o, o // 1300 AS pos, CASE WHEN o > 0 THEN instr(substr(t, o + 1, 1500), ' ') ELSE 0 END AS blank, least(o + 1500, length(t)) AS stop FROM a),
sl AS (SELECT doc_id, pos, substr(t, o + blank + 1, stop - o - blank) AS text, 1 + length(substr(t, 1, o + blank)) - length(replace(substr(t, 1, o + blank), chr(10), '')) AS line_start,
  1 + length(substr(t, 1, stop)) - length(replace(substr(t, 1, stop), chr(10), '')) AS line_end FROM p)"""


@query(f"WITH {_SLICES} SELECT doc_id, pos, text, line_start, line_end FROM sl")
def oversize_slices(spark, sf_dir):
    return chunking.long_slices(_table(spark, sf_dir, "documents"), key="doc_id")


# The fold over blocks: packs up to 400 characters, and opens the next chunk with the tail of the last.
_PACK = f"""{_BLOCKS},
st AS (SELECT conv_id, pos, text AS cur, NULL::VARCHAR AS done FROM b WHERE pos = 0 AND length(text) <= 400
  UNION ALL SELECT conv_id, pos, '' AS cur, NULL FROM b WHERE pos = 0 AND length(text) > 400
  UNION ALL SELECT b.conv_id, b.pos,
    CASE WHEN length(b.text) > 400 THEN '' WHEN st.cur = '' THEN b.text WHEN length(st.cur) + length(b.text) + 2 <= 400 THEN st.cur || chr(10) || chr(10) || b.text
      ELSE CASE WHEN length(st.cur) <= 200 THEN st.cur ELSE substr(right(st.cur, 200), instr(right(st.cur, 200), ' ') + 1) END || chr(10) || chr(10) || b.text END,
    CASE WHEN st.cur = '' THEN NULL WHEN length(b.text) > 400 THEN st.cur WHEN length(st.cur) + length(b.text) + 2 <= 400 THEN NULL ELSE st.cur END
  FROM st JOIN b ON b.conv_id = st.conv_id AND b.pos = st.pos + 1),
big AS (SELECT conv_id, pos AS bpos, text AS t, unnest(range(0, length(text), 200)) AS o FROM b WHERE length(text) > 400),
bs AS (SELECT conv_id, bpos, o, CASE WHEN o > 0 THEN instr(substr(t, o + 1, 400), ' ') ELSE 0 END AS blank, t FROM big),
ch AS (SELECT conv_id, done AS text FROM st WHERE done IS NOT NULL
  UNION ALL SELECT conv_id, substr(t, o + blank + 1, 400 - blank) FROM bs
  UNION ALL SELECT conv_id, cur FROM st WHERE cur <> '' AND pos = (SELECT max(pos) FROM b WHERE b.conv_id = st.conv_id))"""


@query(f"WITH RECURSIVE {_PACK} SELECT conv_id, text FROM ch")
def chunk_pack(spark, sf_dir):
    return chunking.chunked(_markdown(spark, sf_dir), 400, "conv_id").select("conv_id", "text")


@query(f"WITH RECURSIVE {_PACK} SELECT conv_id, count(*) AS chunks, sum(length(text))::BIGINT AS chars, max(length(text)) AS longest FROM ch GROUP BY conv_id")
def chunk_stats(spark, sf_dir):
    return chunking.chunked(_markdown(spark, sf_dir), 400, "conv_id").groupBy("conv_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).cast("bigint").alias("longest"))


# The same fold with lines and headings: what is held is a list of blocks, of which a tail cites the line where it starts.
_FOLD = f"""{_BLOCKS},
bb AS (SELECT conv_id, pos, struct_pack(t := text, a := line_start::BIGINT, z := line_end::BIGINT, h := heading) AS b FROM b),
st AS (SELECT conv_id, -1::BIGINT AS pos, []::STRUCT(t VARCHAR, a BIGINT, z BIGINT, h VARCHAR)[] AS held, NULL::STRUCT(t VARCHAR, a BIGINT, z BIGINT, h VARCHAR)[] AS done FROM bb WHERE pos = 0
  UNION ALL SELECT conv_id, pos, CASE WHEN long THEN [] WHEN fits THEN list_append(held, b)
      ELSE [struct_pack(t := tail, a := held[hit].a + length(substr(held[hit].t, 1, greatest(0, off - ats[hit])::INT)) - length(replace(substr(held[hit].t, 1, greatest(0, off - ats[hit])::INT), chr(10), '')),
        z := held[hit].a + length(substr(held[hit].t, 1, greatest(0, off - ats[hit])::INT)) - length(replace(substr(held[hit].t, 1, greatest(0, off - ats[hit])::INT), chr(10), '')), h := held[hit].h), b] END,
    CASE WHEN len(held) = 0 OR (fits AND NOT long) THEN NULL ELSE held END
  FROM (SELECT *, list_filter(range(1, len(held) + 1), lambda i: off <= ats[i] + length(held[i].t))[1] AS hit FROM (SELECT *, length(whole) - length(tail) AS off, list_transform(range(1, len(held) + 1), lambda i: coalesce(list_sum(list_transform(held[1:i - 1], lambda x: length(x.t) + 2)), 0)::BIGINT) AS ats
    FROM (SELECT *, CASE WHEN length(whole) <= 200 THEN whole ELSE substr(right(whole, 200), instr(right(whole, 200), ' ') + 1) END AS tail FROM (SELECT st.conv_id, bb.pos, st.held, bb.b, length(bb.b.t) > 400 AS long,
      len(st.held) = 0 OR coalesce(list_sum(list_transform(st.held, lambda x: length(x.t) + 2)), 0) + length(bb.b.t) <= 400 AS fits, array_to_string(list_transform(st.held, lambda x: x.t), chr(10) || chr(10)) AS whole
      FROM st JOIN bb ON bb.conv_id = st.conv_id AND bb.pos = st.pos + 1))))),
big AS (SELECT conv_id, pos, b.t AS t, b.a AS a, b.h AS h, unnest(range(0, length(b.t), 200)) AS o FROM bb WHERE length(b.t) > 400),
bs AS (SELECT *, o + CASE WHEN o > 0 THEN instr(substr(t, o + 1, 400), ' ') ELSE 0 END AS f, least(o + 400, length(t)) AS stop FROM big),
cl AS (SELECT conv_id, pos, 0 AS part, 0 AS o, done AS held FROM st WHERE done IS NOT NULL UNION ALL SELECT conv_id, pos + 1, 0, 0, held FROM st WHERE len(held) > 0 AND pos = (SELECT max(pos) FROM bb WHERE bb.conv_id = st.conv_id)),
ch AS (SELECT conv_id, pos, part, o, array_to_string(list_transform(held, lambda x: x.t), chr(10) || chr(10)) AS text, held[1].h AS heading, held[1].a AS line_start, held[-1].z AS line_end FROM cl
  UNION ALL SELECT conv_id, pos, 1, o, substr(t, f + 1, stop - f), h, a + length(substr(t, 1, f)) - length(replace(substr(t, 1, f), chr(10), '')), a + length(substr(t, 1, stop)) - length(replace(substr(t, 1, stop), chr(10), '')) FROM bs),
cc AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos, part, o) - 1 AS pos, text, heading, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end FROM ch)"""


@query(f"""WITH RECURSIVE {_FOLD} SELECT conv_id, pos, heading, line_start, line_end, conv_id || ':' || line_start || '-' || line_end || CASE WHEN heading <> '' THEN '  (' || heading || ')' ELSE '' END AS citation,
substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 150) AS snippet FROM cc""")
def chunk_citations(spark, sf_dir):
    """Chunks with their lines and heading, as they are cited."""
    got = chunking.chunked(_markdown(spark, sf_dir), 400, "conv_id")
    return got.select("conv_id", "pos", "heading", "line_start", "line_end", T.citation(F.col("conv_id").cast("string"), "line_start", "line_end", "heading").alias("citation"), T.snippet("text", 150).alias("snippet"))


# Documents that are one paragraph each: one chunk up to 1500 characters, else a slice every 1300; blank ones have none.
_CHUNKS = f"""{_FILES}, sz AS (SELECT file, digest, length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS c FROM f),
n AS (SELECT file, digest, CASE WHEN c = 0 THEN 0 WHEN c <= 1500 THEN 1 ELSE ceil(c / 1300.0)::BIGINT END AS n FROM sz)"""


@query(f"""WITH {_CHUNKS}, o AS (SELECT file, n, sum(n) OVER (ORDER BY string_split(file, '/') ROWS UNBOUNDED PRECEDING) - n AS first FROM n)
SELECT file, pos, (first + pos)::BIGINT AS ordinal, 'abc123def456:' || lpad((first + pos)::VARCHAR, greatest(4, length((first + pos)::VARCHAR))::INT, '0') AS id FROM (SELECT file, first, unnest(range(0, n)) AS pos FROM o)""")
def chunk_ids(spark, sf_dir):
    pieces = chunking.chunked(_corpus(spark, sf_dir)).select("file", "pos")
    return index.ordinals(pieces).select("file", "pos", "ordinal", T.chunk_id(F.lit("abc123def456"), "ordinal").alias("id"))


@query(f"""WITH {_BLOCKS}, s AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM b)
SELECT conv_id, pos, conv_id || ':' || line_start || '-' || line_end || CASE WHEN heading <> '' THEN '  (' || heading || ')' ELSE '' END AS citation, substr(flat, 1, 150) AS snippet FROM s""")
def block_citations(spark, sf_dir):
    got = chunking.paragraph_blocks(_markdown(spark, sf_dir), "conv_id")
    return got.select("conv_id", "pos", T.citation(F.col("conv_id").cast("string"), "line_start", "line_end", "heading").alias("citation"), T.snippet("text", 150).alias("snippet"))


# --- incremental builds ---------------------------------------------------------------------------------------------


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A prior index without every seventh document and with every eleventh in an older text; without every thirteenth now."""
    now = index.digests(_corpus(spark, sf_dir))
    prior = now.where("doc_id % 7 != 0").withColumn("digest", F.when(F.col("doc_id") % 11 == 0, T.digest(F.concat(F.lit("old "), F.col("text")))).otherwise(F.col("digest")))
    return prior.select("file", "digest"), now.where("doc_id % 13 != 0").select("file", "digest")


_SNAPSHOTS = f"""{_FILES}, prior AS (SELECT file, CASE WHEN doc_id % 11 = 0 THEN substr(sha256('old ' || text), 1, 16) ELSE digest END AS digest FROM f WHERE doc_id % 7 <> 0),
now AS (SELECT file, digest FROM f WHERE doc_id % 13 <> 0),
dr AS (SELECT coalesce(p.file, n.file) AS file, CASE WHEN p.file IS NULL THEN 'added' WHEN n.file IS NULL THEN 'removed' WHEN p.digest <> n.digest THEN 'changed' ELSE 'same' END AS status FROM prior p FULL JOIN now n ON p.file = n.file)"""


@query(f"WITH {_SNAPSHOTS} SELECT n.file, n.digest, CASE WHEN p.file IS NULL THEN 'embed' ELSE 'reuse' END AS action FROM now n LEFT JOIN prior p ON p.file = n.file AND p.digest = n.digest")
def incremental_reuse(spark, sf_dir):
    prior, now = _snapshots(spark, sf_dir)
    return index.reuse(now, prior)


@query(f"WITH {_SNAPSHOTS} SELECT file, status FROM dr")
def corpus_drift(spark, sf_dir):
    return index.drift(*_snapshots(spark, sf_dir))


@query(f"""WITH {_SNAPSHOTS}, k AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY string_split(file, '/')) AS k FROM dr)
SELECT status, count(*) AS files, coalesce(string_agg(file, ',' ORDER BY k) FILTER (k <= 20 AND status <> 'same'), '') AS names FROM k GROUP BY status""")
def drift_counts(spark, sf_dir):
    return index.drift_summary(index.drift(*_snapshots(spark, sf_dir)))


def _folder(rows: DataFrame, folder: str) -> str:
    """Rows (file, text) as files below a folder, written by the tasks."""
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            store, root = ordered.store_of(folder)
            store.create_dir(root, recursive=True)
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/{file}") as out:
                    out.write((text or "").encode())
            yield batch.select(["file"])

    rows.select("file", "text").mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()
    return folder


@query("""WITH c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id || '.md' AS file, CASE WHEN conv_id % 7 = 0 THEN 'removed' WHEN conv_id % 5 = 0 THEN 'changed' ELSE 'same' END AS status FROM c UNION ALL SELECT 'new-' || conv_id || '.md', 'added' FROM c WHERE conv_id % 11 = 0""")
def status_on_disk(spark, sf_dir):
    """An index of a folder of conversations, stored, and held against the folder as it is after files were edited, removed and added."""
    embed, folder = HashEmbedder(), f"{scratch(spark)}/{uuid.uuid4().hex[:12]}"
    chats = _markdown(spark, sf_dir).withColumn("file", F.concat(F.col("conv_id").cast("string"), F.lit(".md")))
    index.build(spark, markdown.scan(spark, _folder(chats, f"{folder}/before")), "chats", embed, model=embed.name, limit=LIMIT, path=f"{folder}/indexes")
    edited = chats.where("conv_id % 7 != 0").withColumn("text", F.when(F.col("conv_id") % 5 == 0, F.concat("text", F.lit("\n\nmore"))).otherwise(F.col("text"))).select("file", "text")
    new = chats.where("conv_id % 11 = 0").select(F.concat(F.lit("new-"), "file").alias("file"), "text")
    now = markdown.scan(spark, _folder(edited.unionByName(new), f"{folder}/after"))
    stored = index.read(spark, f"{folder}/indexes", "chats")
    return index.drift(stored["file"].select("file", "digest"), index.digests(now).select("file", "digest"))


_HEADERS = [("broken", True, None, None, None, None, None, None), ("legacy", False, None, "old notes", "", "m", 3, 9), ("future", False, 3, "", None, None, 1, 1)]


@query(f"""WITH {_sql_values('h', 'name, corrupt, format, description, built_at, model, file_count, chunk_count', _HEADERS)},
a AS (SELECT * FROM h UNION ALL SELECT source, false, 2, 'documents of ' || source, NULL, 'nomic-embed-text', count(*), sum(greatest(1, ceil(length(text) / 1300.0)))::BIGINT FROM documents GROUP BY source)
SELECT name, coalesce(nullif(description, ''), 'unknown') AS description, coalesce(nullif(built_at, ''), 'unknown') AS built_at, coalesce(nullif(model, ''), 'unknown') AS model, coalesce(file_count, 0)::BIGINT AS file_count,
  coalesce(chunk_count, 0)::BIGINT AS chunk_count, CASE WHEN corrupt THEN 'index_unreadable' WHEN format IS NULL OR format <> 2 THEN 'unsupported_index' ELSE 'ok' END AS verdict FROM a""")
def index_inventory(spark, sf_dir):
    odd = _values(spark, "name string, corrupt boolean, format int, description string, built_at string, model string, file_count bigint, chunk_count bigint", _HEADERS)
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 1300.0)).cast("bigint")
    good = _table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("file_count"), F.sum(n).alias("chunk_count"))
    good = good.select("name", F.lit(False).alias("corrupt"), F.lit(2).alias("format"), F.concat(F.lit("documents of "), "name").alias("description"), F.lit(None).cast("string").alias("built_at"), F.lit(MODEL).alias("model"), "file_count", "chunk_count")
    return index.inventory(odd.unionByName(good))


@query(f"WITH {_CHUNKS} SELECT file, pos, 64::BIGINT AS dimensions, 1.0::DOUBLE AS norm FROM (SELECT file, unnest(range(0, n)) AS pos FROM n)")
def embed_batches(spark, sf_dir):
    """Vectors of every chunk from the offline embedder, sixteen texts a call; its vectors have the norm 1."""
    chunks = chunking.chunked(_corpus(spark, sf_dir))
    got = index.embedded(chunks, HashEmbedder(), T.prefixes_for(MODEL)[0])
    return got.select("file", "pos", F.size("vector").cast("bigint").alias("dimensions"), F.round("norm", 6).alias("norm"))


@query("SELECT doc_id, text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) AS reused, 32 AS dimensions, NULL::VARCHAR AS error FROM documents")
def resumed_embeddings(spark, sf_dir):
    """A run over all documents after one that broke off: half of them were answered, and their copies are not asked for again."""
    docs, log = _table(spark, sf_dir, "documents").select("doc_id", "text"), f"{scratch(spark)}/{uuid.uuid4().hex[:12]}"
    embed, how = HashEmbedder(32), {"kind": "embed", "model": "offline-hash", "batch": 16, "every": 256, "vectors": True}
    calls.answered(docs.where("doc_id % 2 = 0"), F.col("text"), embed, log, **how)
    got = calls.answered(docs, F.col("text"), embed, log, **how)
    return got.select("doc_id", "reused", F.size("vector").alias("dimensions"), "error")


@query("""WITH t AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS h, string_agg(text, '|' ORDER BY turn) AS said FROM conversations GROUP BY conv_id)
SELECT conv_id, h IN (SELECT h FROM t WHERE conv_id % 3 = 0) AS reused, length(said) AS chars, 'ok' AS verdict FROM t""")
def resumed_histories(spark, sf_dir):
    """Whole histories sent once each over two runs, the first of which had reached a third; completions are judged as always."""
    turn = F.struct("role", F.col("text").alias("content"))
    chats = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("m")))).alias("x")).select("conv_id", F.transform("x", lambda r: r["m"]).alias("prompt"))
    log = f"{scratch(spark)}/{uuid.uuid4().hex[:12]}"

    def chat(messages):
        return {"text": "|".join(m["content"] for m in messages), "done_reason": "stop", "eval_count": len(messages)}

    calls.completed(chats.where("conv_id % 3 = 0"), chat, log, model="offline-echo", every=64)
    got = calls.completed(chats, chat, log, model="offline-echo", every=64)
    return got.select("conv_id", "reused", F.length("text").cast("bigint").alias("chars"), T.completion_verdict("text", "done_reason").alias("verdict"))


@query(f"""WITH {_FILES}, t AS (SELECT file, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM f),
o AS (SELECT file, t, unnest(CASE WHEN length(t) = 0 THEN [] WHEN length(t) <= 1500 THEN [0] ELSE range(0, length(t), 1300) END) AS o FROM t),
p AS (SELECT *, o + CASE WHEN o > 0 THEN instr(substr(t, o + 1, 1500), ' ') ELSE 0 END AS f, least(o + 1500, length(t)) AS stop FROM o)
SELECT file, o // 1300 AS pos, substr(t, f + 1, stop - f) AS text, 1 + length(substr(t, 1, f)) - length(replace(substr(t, 1, f), chr(10), '')) AS line_start, 1 + length(substr(t, 1, stop)) - length(replace(substr(t, 1, stop), chr(10), '')) AS line_end, 64 AS dimensions FROM p""")
def document_roundtrip(spark, sf_dir):
    """An index of all documents written as one JSON document, in order, and read back as a stream of chunks."""
    embed, folder = HashEmbedder(), f"{scratch(spark)}/{uuid.uuid4().hex[:12]}"
    tables = index.build(spark, _corpus(spark, sf_dir), "documents", embed, model=embed.name, limit=LIMIT)
    commit.files_of(spark, folder)[0].mkdirs(commit.files_of(spark, folder)[1])
    index_json.export(tables, f"{folder}/documents.json")
    got = index_json.chunks(index_json.read(spark, folder))
    return got.select("file", "pos", "text", "line_start", "line_end", F.size("vector").alias("dimensions"))


@query(f"""WITH RECURSIVE {_FOLD}, {_CHUNKS}
SELECT 'conversations' AS name, 'markdown of turns' AS description, 'offline-hash' AS model, (SELECT count(DISTINCT conv_id) FROM conversations) AS file_count, (SELECT count(*) FROM cc) AS chunk_count, 'ok' AS verdict
UNION ALL SELECT 'documents', 'unknown', 'offline-hash', count(*), sum(n)::BIGINT, 'ok' FROM n UNION ALL SELECT 'torn', 'unknown', 'unknown', 0, 0, 'index_unreadable'""")
def stored_inventory(spark, sf_dir):
    """The listing of indexes that are stored: one of all documents, built twice, one of all conversations, and a folder that holds none."""
    embed, folder = HashEmbedder(), f"{scratch(spark)}/{uuid.uuid4().hex[:12]}"
    chats = _markdown(spark, sf_dir).select(F.concat(F.col("conv_id").cast("string"), F.lit(".md")).alias("file"), "text")
    index.build(spark, _corpus(spark, sf_dir).where("doc_id % 2 = 0"), "documents", embed, model=embed.name, limit=LIMIT, path=folder)
    index.build(spark, _corpus(spark, sf_dir), "documents", embed, model=embed.name, limit=LIMIT, path=folder)
    index.build(spark, chats, "conversations", embed, model=embed.name, limit=LIMIT, target=400, path=folder, description="markdown of turns")
    commit.files_of(spark, folder)[0].mkdirs(commit.files_of(spark, f"{folder}/torn")[1])
    return index.listing(spark, folder).drop("built_at")


@query(f"""WITH {_CHUNKS} SELECT 'documents' AS name, 2::INT AS format, '' AS description, '' AS source_root, substr(sha256('2' || chr(0) || 'offline-hash' || chr(0) || chr(0) || chr(0) || '1500' || chr(0)
  || string_agg(file || chr(0) || digest || chr(0), '' ORDER BY string_split(file, '/'))), 1, 12) AS generation, 'offline-hash' AS model, '' AS doc_prefix, '' AS query_prefix, 1500::INT AS chunk_chars, 64::INT AS dimensions, count(*) AS file_count, sum(n)::BIGINT AS chunk_count FROM n""")
def index_build(spark, sf_dir):
    """A whole build with the offline embedder, documents without a source included: its header."""
    embed = HashEmbedder()
    return index.build(spark, _corpus(spark, sf_dir), "documents", embed, model=embed.name, limit=LIMIT)["header"].drop("built_at")


@query("""SELECT doc_id, floor(length(coalesce(text, '')) / 3.2)::BIGINT + 1 AS estimate, CASE WHEN length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) = 0 THEN 'invalid_request' WHEN floor(length(text) / 3.2) + 1 > 500 THEN 'context_exceeded' ELSE 'ok' END AS verdict,
  CASE WHEN length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) > 0 AND floor(length(text) / 3.2) + 1 <= 500 THEN 32 END AS dimensions FROM documents""")
def embed_refusals(spark, sf_dir):
    """An embedding call over all documents: inputs over the limit are refused one by one, the others get vectors."""
    got = index.embedded_checked(_table(spark, sf_dir, "documents"), HashEmbedder(32), 500, key="doc_id")
    return got.select("doc_id", "estimate", "verdict", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dimensions"))


@query("SELECT user_id, event_type, arg_min(event_id, event_id) AS event_id, arg_min(round(value, 6), event_id) AS value FROM events GROUP BY user_id, event_type")
def first_wins(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))
    return code.first_wins(rows, ("user_id", "event_type"), "event_id")


_BEGIN, _END = "<!-- BEGIN GENERATED: cli -->", "<!-- END GENERATED: cli -->"


@query(f"""SELECT doc_id, 'a ' || CASE WHEN doc_id % 3 = 0 THEN '{_BEGIN}' || coalesce(text, '') ELSE '{_BEGIN}' || chr(10) || chr(10) || 'now $1' || chr(10) || chr(10) || '{_END}' || ' b' END AS text, doc_id % 3 = 0 AS unpaired FROM documents""")
def generated_regions(spark, sf_dir):
    """What stands between the marks is replaced; a mark without its other half is left and reported."""
    body = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(f"a {_BEGIN}"), body, F.when(F.col("doc_id") % 3 == 0, "").otherwise(f"{_END} b")).alias("text"))
    odd = code.unpaired_regions(docs, "doc_id", "text").select("doc_id", F.lit(True).alias("unpaired"))
    return docs.join(odd, "doc_id", "left").select("doc_id", code.with_region(F.col("text"), "cli", "now $1").alias("text"), F.coalesce("unpaired", F.lit(False)).alias("unpaired"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN length(props)::BIGINT END AS thinking_chars, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'raise max_tokens or think less' ELSE 'check max_tokens or try another model' END END AS remedy FROM events""")
def thinking_reports(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, " ").otherwise("text").alias("text"), F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("thinking"))
    return rows.select("event_id", T.thinking_chars("thinking").alias("thinking_chars"), T.empty_remedy("text", "thinking").alias("remedy"))


# --- reranking from recorded replies --------------------------------------------------------------------------------


def _pool(spark, sf_dir, pool: int = 20) -> DataFrame:
    """The pool of candidates with their position, and a reply for each batch made from the labels."""
    best = search.top(search.scored(_chunks(spark, sf_dir), _query_vector(spark, sf_dir)), pool)
    return best.select((F.col("rank") - 1).alias("pos"), "ordinal", "cosine", "label")


def _replies(pool: DataFrame) -> DataFrame:
    rows = rerank.batches(pool)
    line = F.when(F.col("batch") % 2 == 0, F.concat(F.lit("["), F.col("local").cast("string"), F.lit("] = "), (F.col("label") % 3).cast("string"))).otherwise(F.concat(F.lit('"'), F.col("local").cast("string"), F.lit('": '), (F.col("label") % 3).cast("string")))
    rows = rows.withColumn("_line", line).groupBy("batch").agg(F.count("*").alias("size"), F.array_sort(F.collect_list(F.struct("local", "_line"))).alias("x"))
    body = F.transform("x", lambda r: r["_line"])
    reply = F.when(F.col("batch") % 2 == 0, F.concat(F.array_join(body, "\n"), F.lit("\n7=2\n0=1"))).when(F.col("batch") == 3, F.lit("no scores here")).otherwise(F.concat(F.lit("{"), F.array_join(body, ", "), F.lit("}")))
    return rows.select("batch", "size", reply.alias("reply"), F.lit(None).cast("string").alias("error"))


_RERANK = f"""{_SCORES}, p AS (SELECT rank - 1 AS pos, ordinal, cosine, label, (rank - 1) // 5 AS batch, (rank - 1) % 5 AS local FROM r WHERE rank <= 20),
sc AS (SELECT pos, CASE WHEN batch % 2 = 0 AND local = 0 THEN 1.0 ELSE (label % 3)::DOUBLE END AS score FROM p WHERE batch <> 3),
ord AS (SELECT p.*, sc.score, row_number() OVER (ORDER BY coalesce(score, -1) DESC, cosine DESC, p.pos) AS place FROM p LEFT JOIN sc USING (pos))"""


@query(f"WITH {_RERANK} SELECT pos, ordinal, batch::BIGINT AS batch, local::BIGINT AS local FROM p")
def rerank_batches(spark, sf_dir):
    return rerank.batches(_pool(spark, sf_dir)).select("pos", "ordinal", "batch", "local")


_TEXTS = """tx AS (SELECT p.pos, p.batch::BIGINT AS batch, p.local, d.source, trim(regexp_replace(coalesce(d.text, ''), '\\s+', ' ', 'g')) AS t FROM p JOIN documents d ON d.doc_id = p.ordinal)"""


@query(f"""WITH {_RERANK}, {_TEXTS} SELECT batch, count(*) AS size, 'You grade search results.' || chr(10) || 'A reader asks: why?' || chr(10) || '{rerank.SCALES["plain"]}' || chr(10) || 'Passages, each under its number and file:' || chr(10) || chr(10)
  || string_agg('[' || local || '] (' || source || ')' || chr(10) || t, chr(10) || chr(10) ORDER BY local) || chr(10) || chr(10) || 'Write ' || count(*) || ' grades, each on a line of its own as number=grade. Add no other text.' AS prompt FROM tx GROUP BY batch""")
def rerank_prompts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.col("source").alias("file"), "text")
    return rerank.prompts(docs.join(F.broadcast(_pool(spark, sf_dir)), "ordinal"), "why?")  # twenty rows


_SOUGHT = "license of the version and copies"


@query(f"""WITH {_SCORES}, w AS (SELECT string_split('{_SOUGHT}', ' ') AS w),
c AS (SELECT row_number() OVER (ORDER BY cosine DESC, ordinal) - 1 AS pos, ordinal, cosine, coalesce(d.text, '') AS text FROM s JOIN documents d ON d.doc_id = ordinal),
j AS (SELECT pos, ordinal, cosine, least(2, len(list_intersect(w.w, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))))::DOUBLE AS score FROM c, w WHERE pos < 20),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, cosine DESC, pos) AS place FROM j)
SELECT place, ordinal, round(cosine, 6) AS cosine, score, CASE score WHEN 2 THEN 'ANSWERS' WHEN 1 THEN 'partial' ELSE 'topic only' END AS label, (SELECT max(cosine) - min(cosine) FROM c WHERE pos < 10) < 0.06 AS weak_ranking FROM o WHERE place <= 10""")
def reranked_search(spark, sf_dir):
    """A search with its second stage in one call, judged offline by shared words."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.coalesce("source", F.lit("none")).alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = _chunks(spark, sf_dir).join(docs, "ordinal")
    got = rerank.reranked(chunks, _query_vector(spark, sf_dir), _SOUGHT, OverlapScorer(_SOUGHT))["rows"]
    return got.select("place", "ordinal", F.round("cosine", 6).alias("cosine"), "score", "label", "weak_ranking")


@query(f"WITH {_SCORES} SELECT rank AS place, rank - 1 AS pos, ordinal, NULL::DOUBLE AS score, 'not judged' AS label FROM r WHERE rank <= 10")
def unjudged_order(spark, sf_dir):
    """A pool of which no batch gave a score: the order of the embeddings, with null scores that are not zeros."""
    pool = _pool(spark, sf_dir)
    none = rerank.parsed(_replies(pool).withColumn("reply", F.lit("nothing")))
    rows = rerank.ordered(pool, none, 10).withColumn("high", F.lit(None).cast("double"))
    return rows.select("place", "pos", "ordinal", "score", rerank.label("score", "high").alias("label"))


@query(f"WITH {_RERANK} SELECT pos, CASE WHEN score IS NULL THEN 'not judged' WHEN score = 2 THEN 'ANSWERS' WHEN score = 1 THEN 'partial' ELSE 'topic only' END AS label, printf('%g', cosine * 1e6) AS large, printf('%g', cosine / 1e6) AS tiny FROM ord")
def rerank_labels(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    rows = rerank.ordered(pool, rerank.parsed(_replies(pool)), 20).withColumn("high", F.lit(2.0))
    return rows.select("pos", rerank.label("score", "high").alias("label"), T.general(F.col("cosine") * 1e6).alias("large"), T.general(F.col("cosine") / 1e6).alias("tiny"))


@query(f"WITH {_RERANK} SELECT pos, score FROM sc")
def rerank_parse(spark, sf_dir):
    return rerank.parsed(_replies(_pool(spark, sf_dir)))


@query("SELECT 3::BIGINT AS batch, 'unparseable (no scores here)' AS failure")
def rerank_failures(spark, sf_dir):
    replies = _replies(_pool(spark, sf_dir))
    return rerank.failures(replies, rerank.parsed(replies))


@query(f"WITH {_RERANK} SELECT place, pos, ordinal, score FROM ord WHERE place <= 10")
def rerank_order(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    return rerank.ordered(pool, rerank.parsed(_replies(pool)), 10).select("place", "pos", "ordinal", "score")


@query(f"WITH {_RERANK} SELECT score, printf('%g', score) AS label, count(*) AS n FROM sc GROUP BY score")
def rerank_distribution(spark, sf_dir):
    return rerank.distribution(rerank.parsed(_replies(_pool(spark, sf_dir))))


@query(f"""WITH {_RERANK}, best AS (SELECT max(score) AS best FROM ord WHERE place <= 10), a AS (SELECT count(*) AS judged, min(score) AS low, max(score) AS high FROM sc),
t AS (SELECT count(*) AS at_top FROM sc WHERE score = (SELECT high FROM a))
SELECT judged, 20::BIGINT AS of_pool, low, high, at_top > judged / 2 AS weak_discrimination, high > 2 OR low < 0 AS own_scale, high <= 2 AND best > 0 AND best < 2 AS pool_may_be_short, 40::BIGINT AS next_pool, best = 0 AS none_answers FROM a, best, t""")
def rerank_flags(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    scores = rerank.parsed(_replies(pool))
    return rerank.flags(scores, rerank.ordered(pool, scores, 10), 20)


# --- budgets and guards ---------------------------------------------------------------------------------------------


@query("SELECT doc_id, length(text) AS chars, floor(length(text) / 3.2)::BIGINT + 1 AS estimate FROM documents")
def token_estimate(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("chars"), T.tokens(F.length("text")).alias("estimate"))


@query("""WITH e AS (SELECT doc_id, floor(length(text) / 3.2)::BIGINT + 1 AS estimate, CASE doc_id % 3 WHEN 0 THEN 2048 WHEN 1 THEN 512 END AS lim FROM documents)
SELECT doc_id, estimate, floor(lim * 0.85::DOUBLE)::BIGINT AS usable, CASE WHEN lim IS NULL THEN 'context_unknown' WHEN estimate > floor(lim * 0.85::DOUBLE) THEN 'context_exceeded' ELSE 'ok' END AS verdict FROM e""")
def context_check(spark, sf_dir):
    limit = F.when(F.col("doc_id") % 3 == 0, 2048).when(F.col("doc_id") % 3 == 1, 512).cast("bigint")
    return budget.context_checks(_table(spark, sf_dir, "documents"), "text", limit).select("doc_id", "estimate", "usable", "verdict")


@query("SELECT doc_id, length(text) AS chars, floor(length(text) / 3.2)::BIGINT + 1 AS estimate FROM documents WHERE floor(length(text) / 3.2) + 1 > 2048")
def oversized_inputs(spark, sf_dir):
    return budget.oversized(_table(spark, sf_dir, "documents"), "text", LIMIT).select("doc_id", "chars", "estimate")


@query("""WITH c AS (SELECT conv_id, count(*) AS turns, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM conversations GROUP BY conv_id), e AS (SELECT *, floor(chars / 3.2)::BIGINT + 1 AS estimate FROM c)
SELECT conv_id, turns, chars, estimate, 870::BIGINT AS usable, CASE WHEN estimate > 870 THEN 'context_exceeded' ELSE 'ok' END AS verdict FROM e""")
def conversation_budget(spark, sf_dir):
    return budget.conversation_checks(_table(spark, sf_dir, "conversations"), 1024)


@query("""SELECT conv_id, min(turn) FILTER (role NOT IN ('system', 'user', 'assistant', 'tool') OR role IS NULL OR text IS NULL) AS bad_turn,
CASE WHEN count(*) FILTER (role NOT IN ('system', 'user', 'assistant', 'tool') OR role IS NULL OR text IS NULL) = 0 THEN 'ok' ELSE 'invalid_request' END AS verdict
FROM (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN 'narrator' ELSE role END AS role, text FROM conversations) GROUP BY conv_id""")
def role_validation(spark, sf_dir):
    odd = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), "narrator").otherwise(F.col("role"))
    return budget.role_checks(_table(spark, sf_dir, "conversations").withColumn("role", odd))


@query("""WITH m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 < 3 THEN p_size * 256 * (p_partkey % 3)::BIGINT END AS arch, CASE WHEN p_partkey % 5 < 3 THEN floor(p_retailprice)::BIGINT * 4 END AS num_ctx FROM part),
l AS (SELECT id, arch, num_ctx, least(nullif(arch, 0), nullif(num_ctx, 0)) AS lim FROM m)
SELECT 'm' || id AS name, arch, num_ctx, lim AS "limit", coalesce(arch <> num_ctx, false) AS disagree, least(1500, floor(lim * 3.2::DOUBLE))::BIGINT AS chunk_chars FROM l""")
def context_limits(spark, sf_dir):
    """Models as their server describes them, made from the parts: some without a context length, some without num_ctx, some that disagree."""
    i = F.col("p_partkey")
    length = F.when(i % 4 < 3, F.create_map(F.lit("general.name"), F.lit("x"), F.concat(F.lower("p_type"), F.lit(".context_length")), (F.col("p_size") * 256 * (i % 3)).cast("string"))).otherwise(F.create_map(F.lit("other"), F.lit("5")))
    parameters = F.when(i % 5 < 3, F.concat(F.lit("num_ctx 1\nstop x\nnum_ctx    "), (F.floor("p_retailprice") * 4).cast("string"))).when(i % 5 == 3, "temperature 1")
    got = budget.limits(_table(spark, sf_dir, "part").select(F.concat(F.lit("m"), i.cast("string")).alias("name"), length.alias("model_info"), parameters.alias("parameters")))
    return got.select("name", "arch", "num_ctx", "limit", "disagree", T.chunk_size(chunking.TARGET, "limit").alias("chunk_chars"))


@query("""WITH c AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'stop' WHEN 'click' THEN 'length' WHEN 'error' THEN NULL WHEN 'signup' THEN 'load' ELSE 'stop' END AS done_reason,
  CASE WHEN event_id % 17 = 0 THEN '  ' WHEN event_id % 5 = 0 THEN 'text  ' ELSE 'text' END AS text FROM events)
SELECT event_id, CASE WHEN trim(text) = '' THEN 'empty_generation' WHEN done_reason = 'length' THEN 'truncated' WHEN done_reason IS NULL OR done_reason <> 'stop' THEN 'completion_unverified' ELSE 'ok' END AS verdict,
  trim(text) <> '' AND done_reason IS NULL AND text <> rtrim(text) AS trailing_white FROM c""")
def completion_verdicts(spark, sf_dir):
    kind = F.col("event_type")
    reason = F.when(kind == "view", "stop").when(kind == "click", "length").when(kind == "signup", "load").when(kind != "error", "stop")
    text = F.when(F.col("event_id") % 17 == 0, "  ").when(F.col("event_id") % 5 == 0, "text  ").otherwise("text")
    rows = _table(spark, sf_dir, "events").select("event_id", reason.alias("done_reason"), text.alias("text"))
    return rows.select("event_id", T.completion_verdict("text", "done_reason").alias("verdict"), T.trailing_white("text", "done_reason").alias("trailing_white"))


@query("""WITH c AS (SELECT event_type, floor(value)::BIGINT AS n, (event_id % 1000) * 1000000 AS ns, user_id % 7 AS p, (event_id % 300) * 1000000 AS ld FROM events),
g AS (SELECT event_type, sum(n)::BIGINT AS tokens, sum(ns)::BIGINT AS ns, sum(p)::BIGINT AS prompt_tokens, max(ld)::BIGINT AS ld FROM c GROUP BY event_type)
SELECT event_type, tokens, prompt_tokens, CASE WHEN tokens <> 0 AND ns <> 0 THEN round(tokens / (ns / 1e9::DOUBLE), 1) END AS tokens_per_second, CASE WHEN ld > 100000000 THEN round(ld / 1e9::DOUBLE, 1) END AS cold_load_seconds FROM g""")
def throughput_rollup(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(
        "event_type", F.floor("value").cast("bigint").alias("eval_count"), ((F.col("event_id") % 1000) * 1_000_000).alias("eval_duration"),
        (F.col("user_id") % 7).alias("prompt_eval_count"), ((F.col("event_id") % 300) * 1_000_000).alias("load_duration"),
    )
    return rerank.throughput(rows, ("event_type",))


_STOCK = """m AS (SELECT p_partkey AS id, replace(p_name, ' ', '-') || '-' || p_partkey || CASE p_partkey % 6 WHEN 0 THEN ':latest' WHEN 1 THEN ':Cloud' WHEN 2 THEN ':cloud' WHEN 3 THEN ':7b' ELSE '' END AS name,
  CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 0 ELSE floor(p_retailprice)::BIGINT * [1, 1000, 1000000, 10000000][1 + p_size % 4] END AS size FROM part),
w AS (SELECT *, CASE WHEN lower(CASE WHEN instr(name, ':') > 0 THEN substr(name, instr(name, ':') + 1) ELSE '' END) = 'cloud' THEN 'cloud' WHEN size < 1048576 THEN 'cloud?' ELSE 'local' END AS location FROM m)"""


def _stock(spark, sf_dir) -> DataFrame:
    """Installed models with tags and sizes, made from the parts."""
    i = F.col("p_partkey")
    tag = F.when(i % 6 == 0, ":latest").when(i % 6 == 1, ":Cloud").when(i % 6 == 2, ":cloud").when(i % 6 == 3, ":7b").otherwise("")
    factor = F.element_at(F.array(*(F.lit(k).cast("long") for k in (1, 1000, 1_000_000, 10_000_000))), F.col("p_size") % 4 + 1)
    size = F.when(i % 13 == 0, None).when(i % 17 == 0, 0).otherwise(F.floor("p_retailprice") * factor)
    return _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.translate("p_name", " ", "-"), F.lit("-"), i.cast("string"), tag).alias("name"), size.cast("long").alias("size"))


@query(f"""WITH {_STOCK} SELECT name, CASE WHEN size IS NULL OR size = 0 THEN 'unknown' WHEN size < 1024 THEN printf('%.1f B', size::DOUBLE) WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0::DOUBLE) WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576.0::DOUBLE) ELSE printf('%.1f GB', size / 1073741824.0::DOUBLE) END AS size_label,
  location, CASE WHEN id % 19 = 0 THEN 'not fetched' WHEN id % 7 = 0 THEN 'HTTP 404' END AS details_error FROM w""")
def model_inventory(spark, sf_dir):
    """The listing of a server's models with what could not be fetched about them."""
    models = _stock(spark, sf_dir)
    details = models.where("p_partkey % 19 != 0").select("name", F.when(F.col("p_partkey") % 7 == 0, "HTTP 404").alias("error"))
    return budget.inventory(models.select("name", "size"), details)


@query(f"WITH {_STOCK} SELECT count(*) AS models, count(*) FILTER (location = 'local') AS local_models, string_agg(name, ',' ORDER BY name) FILTER (location <> 'local') AS hosted, 'ok' AS verdict FROM w UNION ALL SELECT 0, 0, '', 'no_models_installed'")
def inventory_summary(spark, sf_dir):
    models = _stock(spark, sf_dir).select("name", "size")
    return budget.inventory_summary(models).unionByName(budget.inventory_summary(models.where("size < 0")))


@query("""WITH c AS (SELECT event_id, CASE event_type WHEN 'view' THEN ['completion', 'tools'] WHEN 'click' THEN ['embedding'] WHEN 'purchase' THEN ['decision', 'vision'] WHEN 'signup' THEN [] WHEN 'error' THEN NULL ELSE ['vision'] END AS has, ['completion', 'embedding', 'decision'][1 + user_id % 3] AS needs FROM events)
SELECT event_id, CASE WHEN len(has) > 0 AND NOT list_contains(has, needs) AND len(list_intersect(has, ['completion', 'embedding', 'decision'])) > 0 THEN 'wrong_capability' ELSE 'ok' END AS verdict,
  CASE WHEN len(has) > 0 AND NOT list_contains(has, needs) THEN CASE WHEN list_contains(has, 'completion') THEN 'generate or chat' WHEN list_contains(has, 'embedding') THEN 'embed' WHEN list_contains(has, 'decision') THEN 'decide' END END AS use_tool FROM c""")
def capability_routing(spark, sf_dir):
    """Calls made from the events: each needs a capability, and its model has some, none, or a list that was not read."""
    kind, strings = F.col("event_type"), lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    has = F.when(kind == "view", strings("completion", "tools")).when(kind == "click", strings("embedding")).when(kind == "purchase", strings("decision", "vision")).when(kind == "signup", strings()).when(kind != "error", strings("vision"))
    needs = F.element_at(strings("completion", "embedding", "decision"), (F.col("user_id") % 3 + 1).cast("int"))
    return budget.routed(_table(spark, sf_dir, "events").select("event_id", has.alias("capabilities"), needs.alias("needs"))).select("event_id", "verdict", "use_tool")


@query("""WITH a AS (SELECT DISTINCT replace(n_name, 'NATION_', 'm') AS name FROM nation WHERE n_regionkey < 2),
c AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'delete' WHEN 'purchase' THEN 'pull' ELSE 'chat' END AS op, CASE WHEN event_id % 23 = 0 THEN ' ' WHEN event_id % 29 <> 0 THEN 'm' || user_id % 30 || CASE WHEN event_id % 2 = 0 THEN ':latest' ELSE '' END END AS model, 'm' || user_id % 30 AS base FROM events)
SELECT event_id, op, model, CASE WHEN op IN ('delete', 'pull') THEN 'not_permitted' WHEN model = ' ' THEN 'invalid_request' WHEN model IS NOT NULL AND base NOT IN (SELECT name FROM a) THEN 'not_permitted' ELSE 'ok' END AS verdict FROM c""")
def allowlist_semi(spark, sf_dir):
    """Calls made from the events, held against write gates and a list of allowed models made from the nations."""
    i, kind = F.col("event_id"), F.col("event_type")
    name = F.concat(F.lit("m"), (F.col("user_id") % 30).cast("string"), F.when(i % 2 == 0, ":latest").otherwise(""))
    model = F.when(i % 23 == 0, " ").when(i % 29 != 0, name)
    calls_ = _table(spark, sf_dir, "events").select("event_id", F.when(kind == "click", "delete").when(kind == "purchase", "pull").otherwise("chat").alias("op"), model.alias("model"))
    allowed = _table(spark, sf_dir, "nation").where("n_regionkey < 2").select(F.concat(F.regexp_replace("n_name", "NATION_", "m"), F.lit(":latest")).alias("model"))
    return budget.guarded(calls_, allowed)


_VERSIONS = """v AS (SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'dev' WHEN 2 THEN 'v' || (p_partkey % 3) || '.' || p_size || '.1-rc' WHEN 3 THEN '  0.' || p_size || '.' || (p_partkey % 100) WHEN 4 THEN '0.' || p_size ELSE (p_partkey % 2) || '.' || p_size || '.0' END AS version,
  CASE p_partkey % 8 WHEN 2 THEN (p_partkey % 3, p_size) WHEN 3 THEN (0, p_size) WHEN 5 THEN (p_partkey % 2, p_size) WHEN 6 THEN (p_partkey % 2, p_size) WHEN 7 THEN (p_partkey % 2, p_size) END AS x FROM part),
vs AS (SELECT id, version, CASE WHEN x IS NULL THEN 'unknown' WHEN x >= (0, 35) THEN 'yes' ELSE 'no' END AS supported FROM v)"""


def _versions(spark, sf_dir) -> DataFrame:
    """Version strings of servers, readable and not, made from the parts."""
    i, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in x))
    version = F.when(i % 8 == 1, "dev").when(i % 8 == 2, text("v", i % 3, ".", size, ".1-rc")).when(i % 8 == 3, text("  0.", size, ".", i % 100)).when(i % 8 == 4, text("0.", size)).when(i % 8 != 0, text(i % 2, ".", size, ".0"))
    return _table(spark, sf_dir, "part").select(i.alias("id"), version.alias("version"))


@query(f"WITH {_VERSIONS} SELECT id, version, supported FROM vs")
def version_gate(spark, sf_dir):
    return _versions(spark, sf_dir).select("id", "version", T.supports_decide("version").alias("supported"))


@query("""WITH n AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN lower(c_mktsegment) || '_' || c_custkey WHEN 2 THEN lower(c_mktsegment) || chr(10) WHEN 3 THEN '' WHEN 4 THEN 'notes-' || c_nationkey ELSE 'nötes' || c_custkey END AS name FROM customer)
SELECT id, name, id % 6 IN (1, 4) AS valid FROM n""")
def name_validation(spark, sf_dir):
    """Names for indexes made from the customers, with capitals, signs, line ends and letters that a name may not have."""
    i, segment = F.col("c_custkey"), F.lower("c_mktsegment")
    name = F.when(i % 6 == 0, F.col("c_name")).when(i % 6 == 1, F.concat(segment, F.lit("_"), i.cast("string"))).when(i % 6 == 2, F.concat(segment, F.lit("\n"))).when(i % 6 == 3, "").when(i % 6 == 4, F.concat(F.lit("notes-"), F.col("c_nationkey").cast("string"))).otherwise(F.concat(F.lit("nötes"), i.cast("string")))
    return _table(spark, sf_dir, "customer").select(i.alias("id"), name.alias("name")).select("id", "name", F.col("name").rlike(T.NAME).alias("valid"))


# --- decisions ------------------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT l_orderkey AS item, l_linenumber AS pos, l_partkey % 5 AS kind, l_quantity = 13 AS blank, l_suppkey % 3 AS n, l_partkey, l_suppkey, 'q' || l_linenumber AS qid FROM lineitem),
p AS (SELECT item, pos, CASE WHEN kind = 4 THEN qid || ': unknown type' WHEN blank THEN qid || ': no instructions' WHEN kind = 0 AND n < 2 THEN qid || ': fewer than two labels' WHEN kind = 1 AND n < 2 THEN qid || ': fewer than two levels' END AS problem FROM q)
SELECT item, arg_min(problem, (pos, problem)) FILTER (problem IS NOT NULL) AS problem FROM p GROUP BY item""")
def question_shape(spark, sf_dir):
    """Questions made from the order lines, a set for each order; what is wrong with a set is its first problem."""
    strings = F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (F.col("l_suppkey") % 3).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("choice", "score", "noul", "noul", "rank"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    rows = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item"), F.concat(F.lit("q"), F.col("l_linenumber").cast("string")).alias("qid"), F.col("l_linenumber").alias("pos"), kind.alias("type"),
        F.when(F.col("l_quantity") == 13, " ").otherwise("which").alias("instructions"), strings.alias("labels"), strings.alias("levels"),
    )
    return decisions.question_problems(rows)


def _decided(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """For each label row a choice and a probability; some answers are wrong in each way there is."""
    rows = _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("item"), "doc_id", "quality", "toxic")
    none = F.lit(None)
    asked = rows.select("item", F.explode(F.array(*(F.struct(F.lit(q).alias("qid"), F.lit(t).alias("type"), (F.array(*map(F.lit, ls)) if ls else none.cast("array<string>")).alias("labels"), none.cast("array<string>").alias("levels")) for q, t, ls in (("pick", "choice", ["high", "low"]), ("toxic", "noul", None))))).alias("q")).select("item", "q.*")
    i = F.col("doc_id")
    choice = F.when(i % 11 == 0, "other").when(F.col("quality") == 1, "high").otherwise("low")
    first = rows.where(i % 7 != 0).select("item", F.lit("pick").alias("qid"), F.when(i % 13 == 0, "noul").alias("type"), choice.alias("choice"), none.cast("double").alias("noul"), none.cast("double").alias("score"), F.create_map(F.lit("high"), F.when(i % 17 == 0, 0.9).otherwise(0.75), F.lit("low"), F.lit(0.25)).alias("probabilities"))
    second = rows.where(i % 5 != 0).select("item", F.lit("toxic").alias("qid"), none.cast("string").alias("type"), none.cast("string").alias("choice"), F.when(i % 19 == 0, 1.5).otherwise(F.col("toxic").cast("double")).alias("noul"), none.cast("double").alias("score"), none.cast("map<string,double>").alias("probabilities"))
    return asked, first.unionByName(second)


_DECIDED = """l AS (SELECT doc_id::VARCHAR AS item, doc_id AS i, quality, toxic FROM labels),
pr AS (SELECT item, 'pick' AS qid, CASE WHEN i % 7 = 0 THEN ['no answer for pick'] WHEN i % 13 = 0 THEN ['pick: answered as another type']
    ELSE list_filter([CASE WHEN i % 11 = 0 THEN 'pick: choice was not offered' END, CASE WHEN i % 17 = 0 THEN 'pick: probabilities do not sum to 1' END], lambda x: x IS NOT NULL) END AS p FROM l
  UNION ALL SELECT item, 'toxic', CASE WHEN i % 5 = 0 THEN ['no answer for toxic'] WHEN i % 19 = 0 THEN ['toxic: noul is not a probability'] ELSE [] END FROM l)"""


@query(f"WITH {_DECIDED} SELECT item, qid, array_to_string(p, '; ') AS problems FROM pr")
def answer_problems(spark, sf_dir):
    return decisions.answer_problems(*_decided(spark, sf_dir)).withColumn("problems", F.array_join("problems", "; "))


@query(f"""WITH {_DECIDED}, a AS (SELECT item, unnest(p) AS p FROM pr), g AS (SELECT item, count(*) AS n, bool_and(starts_with(p, 'no answer')) AS missing FROM a GROUP BY item)
SELECT l.item, coalesce(n, 0) AS n_problems, CASE WHEN n IS NULL THEN 'ok' WHEN missing THEN 'incomplete' ELSE 'bad_response' END AS verdict FROM (SELECT DISTINCT item FROM l) l LEFT JOIN g ON g.item = l.item""")
def answer_verdict(spark, sf_dir):
    return decisions.verdicts(decisions.answer_problems(*_decided(spark, sf_dir)))


_TYPED = {"topic": {"type": "choice", "instructions": "Which topic is it?", "labels": ["license", "story", "other"]}, "clean": {"type": "noul", "instructions": "Is it free of errors?"}, "length": {"type": "score", "instructions": "How long is it?", "levels": ["short", "middling", "long"]}}


@query("""SELECT doc_id::VARCHAR AS item, CASE WHEN length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) = 0 THEN 3 ELSE 0 END::BIGINT AS n_problems,
CASE WHEN length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) = 0 THEN 'incomplete' ELSE 'ok' END AS verdict FROM documents""")
def decisions_applied(spark, sf_dir):
    """Three typed questions about every document, answered offline and held against what was asked."""
    docs = _table(spark, sf_dir, "documents")
    answers = decided(docs, OverlapDecider(), _TYPED, "doc_id", "text").where("error IS NULL")
    asked = _values(spark, "qid string, type string, labels array<string>, levels array<string>", [(k, q["type"], q.get("labels"), q.get("levels")) for k, q in _TYPED.items()])
    questions = docs.select(F.col("doc_id").cast("string").alias("item")).crossJoin(F.broadcast(asked))  # three rows
    return decisions.verdicts(decisions.answer_problems(questions, answers))


@query("""WITH d AS (SELECT CASE WHEN doc_id % 10 = 0 THEN NULL ELSE quality END AS expected, CASE WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END AS got, (doc_id % 100) / 100.0::DOUBLE AS confidence FROM labels)
SELECT count(expected) AS labelled, count(*) - count(expected) AS unlabelled, count(*) FILTER (expected = got) AS correct, round(avg((expected = got)::INT::DOUBLE), 6) AS accuracy,
  round(avg(confidence) FILTER (expected = got), 6) AS confidence_right, round(avg(confidence) FILTER (expected <> got), 6) AS confidence_wrong, count(*) FILTER (expected IS NOT NULL AND confidence >= 0.5) AS kept,
  round(avg((expected = got)::INT::DOUBLE) FILTER (confidence >= 0.5), 6) AS kept_accuracy FROM d""")
def decision_eval(spark, sf_dir):
    i, q = F.col("doc_id"), F.col("quality")
    rows = _table(spark, sf_dir, "labels").select(F.when(i % 10 != 0, q).alias("expected"), F.when(i % 4 == 0, 1 - q).otherwise(q).alias("got"), ((i % 100) / 100.0).cast("double").alias("confidence"))
    return decisions.evaluation(rows)


@query(f"WITH {_VERSIONS} SELECT id, version, CASE WHEN supported = 'no' OR id % 3 = 0 THEN 'endpoint_unavailable' ELSE 'model_not_found' END AS verdict FROM vs")
def missing_endpoint(spark, sf_dir):
    """Calls that got a 404 from servers of many versions, with capabilities that were read for a third of them."""
    rows = _versions(spark, sf_dir).withColumn("capabilities", F.when(F.col("id") % 3 == 0, F.array(F.lit("decision"))))
    return decisions.missing_endpoint(rows).select("id", "version", "verdict")


# --- registers ------------------------------------------------------------------------------------------------------


_NEXT = """o AS (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders)"""


@query(f"WITH RECURSIVE {_NEXT}, r AS (SELECT src AS start, src AS node FROM o WHERE k % 8 = 1 UNION ALL SELECT r.start, o.dst FROM r JOIN o ON o.src = r.node WHERE o.dst IS NOT NULL) SELECT start, node FROM r")
def verdict_closure(spark, sf_dir):
    """What an order leads to: each order points to the customer's next one, and every eighth is asked about."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst"), F.row_number().over(w).alias("k"))
    return integrity.reachable(orders, orders.where("k % 8 = 1").select(F.col("src").alias("start")))


def _sources(spark, sf_dir) -> DataFrame:
    """A module for each customer with a function for each order, which calls that of the next one and says a verdict."""
    order = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", order.alias("k"))
    said = F.when(F.col("o_orderstatus") == "F", '"timeout"').when(F.col("o_orderstatus") == "O", '"truncated"').otherwise("None")
    k = lambda x: x.cast("string")
    text = F.concat(F.lit("def f"), k(F.col("k")), F.lit("():\n    f"), k(F.col("k") + 1), F.lit("()\n    return "), said, F.lit("\n"))
    files = rows.select("o_custkey", "k", text.alias("t")).groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda r: r["t"]), "").alias("text"))
    return files.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".py")).alias("file"), "text")


_CALLED = "k AS (SELECT 'c' || o_custkey || '.py' AS file, o_orderstatus AS st, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"


@query(f"WITH {_CALLED} SELECT file, 'f' || k AS src, 'f' || (k + 1) AS dst FROM k WHERE k < n")
def call_graph(spark, sf_dir):
    """Definitions and calls of every module, and the calls whose names resolve; the last function of each calls nobody that is there."""
    return code.call_edges(code.facts(_sources(spark, sf_dir)))


@query(f"WITH {_CALLED} SELECT DISTINCT file || ':f1' AS start, CASE st WHEN 'F' THEN 'timeout' ELSE 'truncated' END AS verdict FROM k WHERE st IN ('F', 'O')")
def verdict_sources(spark, sf_dir):
    """The verdicts that a module's first function can come to, over all it calls."""
    found = code.stored(code.facts(_sources(spark, sf_dir)))
    starts = found.where("kind = 'def' AND name = 'f1'").select(F.concat(F.col("file"), F.lit(":f1")).alias("start"))
    return code.possible_verdicts(found, starts)


def _manifest(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Registers made from the star schema: a test for each order line, a requirement for each order, a defect for each supplier."""
    line, order, supplier = (_table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier"))
    text = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in x))
    flag, status, quantity = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity")
    result = F.when(quantity == 1, "odd").when((flag == "R") & (status == "O"), "not_run").when(flag == "R", "fail").when(flag == "A", "pass").otherwise("deferred")
    tests = line.select(
        text(F.col("l_orderkey"), "-", F.col("l_linenumber")).alias("id"), result.alias("result"), F.array(text("O-", F.col("l_orderkey") * F.when(quantity == 2, -1).otherwise(1))).alias("discharges"),
        F.when(F.col("l_tax") == 0, " ").otherwise("f").alias("falsifier"), F.when(quantity != 3, "e").alias("expected"), F.when(F.col("l_discount") > 0, "o").alias("observed"),
        F.when(F.col("l_discount") < 0.08, text("S-", F.col("l_suppkey"))).alias("issue"), F.when(status == "F", "later").alias("release_decision"),
    )
    i = F.col("s_suppkey")
    defects = supplier.select(
        text("X-", i - i % 7 % 2).alias("id"), text("S-", F.when(i % 10 == 0, -i - 1).otherwise(i)).alias("tracked_as"), F.col("s_name").alias("title"), F.when(i % 4 == 0, "major").otherwise("minor").alias("severity"),
        F.when(F.col("s_acctbal") >= 0, "r").alias("rationale"), F.lit("n").alias("release_note"), F.when(F.col("s_nationkey") % 2 == 0, "fix before release").otherwise("ship").alias("release_decision"), F.when(i % 3 == 0, "resolved").otherwise("open").alias("status"),
    )
    mark = F.when(F.col("o_orderstatus") == "F", integrity.MARK_DONE).when(F.col("o_orderstatus") == "O", integrity.MARK_OPEN)
    return tests, defects, order.select(text("O-", F.col("o_orderkey")).alias("id"), mark.alias("mark"))


_MANIFEST = """t AS (SELECT l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_quantity = 1 THEN 'odd' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'not_run' WHEN l_returnflag = 'R' THEN 'fail' WHEN l_returnflag = 'A' THEN 'pass' ELSE 'deferred' END AS result,
  'O-' || (CASE WHEN l_quantity = 2 THEN -l_orderkey ELSE l_orderkey END) AS discharges, CASE WHEN l_tax = 0 THEN ' ' ELSE 'f' END AS falsifier, CASE WHEN l_quantity <> 3 THEN 'e' END AS expected, CASE WHEN l_discount > 0 THEN 'o' END AS observed,
  CASE WHEN l_discount < 0.08 THEN 'S-' || l_suppkey END AS issue, CASE WHEN l_linestatus = 'F' THEN 'later' END AS release_decision FROM lineitem),
df AS (SELECT 'X-' || (s_suppkey - s_suppkey % 7 % 2) AS id, 'S-' || (CASE WHEN s_suppkey % 10 = 0 THEN -s_suppkey - 1 ELSE s_suppkey END) AS tracked_as, CASE WHEN s_acctbal >= 0 THEN 'r' END AS rationale,
  CASE WHEN s_nationkey % 2 = 0 THEN 'fix before release' ELSE 'ship' END AS release_decision, CASE WHEN s_suppkey % 3 = 0 THEN 'resolved' ELSE 'open' END AS status FROM supplier),
rq AS (SELECT 'O-' || o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN '✅' WHEN 'O' THEN '❌' END AS mark FROM orders),
cv AS (SELECT discharges AS id, bool_or(result IN ('fail', 'not_run')) AS any_bad, bool_and(result = 'pass') AS all_pass FROM t GROUP BY discharges),
ct AS (SELECT rq.id, mark, CASE WHEN mark = '✅' AND any_bad THEN 'done but a test is not passing' WHEN mark = '❌' AND all_pass THEN 'open but every test passes' END AS finding FROM rq JOIN cv ON cv.id = rq.id)"""


@query(f"WITH {_MANIFEST} SELECT id FROM rq WHERE id NOT IN (SELECT discharges FROM t)")
def coverage_holes(spark, sf_dir):
    tests, _, requirements = _manifest(spark, sf_dir)
    return integrity.holes(requirements, tests)


@query(f"WITH {_MANIFEST} SELECT id, mark, finding FROM ct WHERE finding IS NOT NULL")
def state_contradictions(spark, sf_dir):
    tests, _, requirements = _manifest(spark, sf_dir)
    return integrity.contradictions(requirements, tests)


@query(f"WITH {_MANIFEST} SELECT id, count(*) AS n FROM t GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return integrity.duplicates(_manifest(spark, sf_dir)[0], "id")


@query(f"WITH {_MANIFEST} SELECT id, issue FROM t WHERE issue IS NOT NULL AND issue NOT IN (SELECT tracked_as FROM df)")
def referential_integrity(spark, sf_dir):
    tests, defects, _ = _manifest(spark, sf_dir)
    return integrity.unresolved(tests, "id", "issue", defects, "tracked_as").select("id", "issue")


@query(f"""WITH {_MANIFEST}
SELECT id, 'duplicate test id' AS finding FROM t GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'duplicate defect id' FROM df GROUP BY id HAVING count(*) > 1
UNION ALL SELECT id, 'result outside its domain' FROM t WHERE result NOT IN ('pass', 'fail', 'deferred', 'not_run')
UNION ALL SELECT id, 'no falsifier' FROM t WHERE coalesce(trim(falsifier), '') = '' UNION ALL SELECT id, 'no expected' FROM t WHERE coalesce(trim(expected), '') = ''
UNION ALL SELECT id, 'no observed' FROM t WHERE result IN ('pass', 'fail') AND coalesce(trim(observed), '') = ''
UNION ALL SELECT id, 'no release_decision' FROM t WHERE result = 'deferred' AND coalesce(trim(release_decision), '') = '' UNION ALL SELECT id, 'no issue' FROM t WHERE result IN ('deferred', 'fail') AND coalesce(trim(issue), '') = ''
UNION ALL SELECT id, 'issue not in the register' FROM t WHERE issue IS NOT NULL AND issue NOT IN (SELECT tracked_as FROM df)
UNION ALL SELECT id, 'requirement not in the register' FROM t WHERE discharges NOT IN (SELECT id FROM rq) UNION ALL SELECT id, 'no test and no deferral' FROM rq WHERE id NOT IN (SELECT discharges FROM t)
UNION ALL SELECT id, finding FROM ct WHERE finding IS NOT NULL UNION ALL SELECT id, 'no rationale' FROM df WHERE coalesce(trim(rationale), '') = ''""")
def manifest_findings(spark, sf_dir):
    return integrity.manifest_findings(*_manifest(spark, sf_dir))


@query(f"""WITH {_MANIFEST} SELECT id, 'to be fixed and still open' AS finding FROM df WHERE release_decision = 'fix before release' AND status <> 'resolved'
UNION ALL SELECT id, 'mark is not publishable' FROM rq WHERE mark <> '✅' UNION ALL SELECT id, 'neither passed nor deferred' FROM t WHERE result NOT IN ('pass', 'deferred')""")
def release_gate(spark, sf_dir):
    return integrity.release_gate(*_manifest(spark, sf_dir))


_AUDIT = {
    "orders": ("o_orderkey", {"status outside its domain": "o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O')", "no price": "o_totalprice IS NULL OR o_totalprice <= 1000", "no priority": "coalesce(trim(o_orderpriority), '') = ''", "no customer": "o_custkey IS NULL"}),
    "lineitem": ("l_orderkey", {"quantity out of range": "l_quantity IS NULL OR l_quantity < 1 OR l_quantity > 49", "discount out of range": "l_discount IS NULL OR l_discount < 0 OR l_discount > 0.1", "returned and open": "l_returnflag = 'R' AND l_linestatus = 'O'"}),
    "customer": ("c_custkey", {"in debt": "c_acctbal < 0", "no segment": "coalesce(trim(c_mktsegment), '') = ''"}),
    "labels": ("doc_id", {"quality outside its domain": "quality IS NULL OR quality NOT IN (0, 1)", "good and toxic": "quality = 1 AND toxic = 1"}),
}


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{f.replace(chr(39), chr(39) * 2)}' AS finding, count(*) FILTER ({c}) AS n, min({k}) FILTER ({c}) AS first_id, max({k}) FILTER ({c}) AS last_id FROM {t}" for t, (k, rules) in _AUDIT.items() for f, c in rules.items()))
def table_audit(spark, sf_dir):
    """Domain, range and null rules of four tables, each table's in one aggregate over one scan, with the first and last id of each finding."""
    out = None
    for name, (key, rules) in _AUDIT.items():
        got = integrity.audit(_table(spark, sf_dir, name), key, *((F.expr(c), f) for f, c in rules.items())).select(F.lit(name).alias("table"), "*")
        out = got if out is None else out.unionByName(got)
    return out


@query("SELECT c_custkey AS customer, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey + 1000000, 'unexpected' FROM orders WHERE o_orderkey % 997 = 0")
def tool_differences(spark, sf_dir):
    """Customers that are expected to have orders, against those of the orders, some of which name nobody."""
    orders = _table(spark, sf_dir, "orders")
    odd = orders.where("o_orderkey % 997 = 0").select((F.col("o_custkey") + 1_000_000).alias("customer"))
    actual = orders.select(F.col("o_custkey").alias("customer")).unionByName(odd).distinct()
    return integrity.differences(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer")), actual)


_SCAN = """SELECT '{k}' || {id} AS file, starts_with({c}, chr(65279)) AS bom, CASE WHEN contains({c}, chr(13)) THEN instr({c}, chr(13)) - 1 END AS cr_at, length({c}) - length(replace({c}, chr(13), '')) AS cr_count,
  CASE WHEN contains({c}, chr(160)) THEN instr({c}, chr(160)) - 1 END AS nbsp_at, length({c}) - length(replace({c}, chr(160), '')) AS nbsp_count, true AS valid,
  starts_with({c}, chr(65279))::BIGINT + (contains({c}, chr(13)))::BIGINT + (contains({c}, chr(160)))::BIGINT AS problems FROM {t}"""


@query(_SCAN.format(k="d", id="doc_id", c="text", t="(SELECT doc_id, CASE doc_id % 50 WHEN 1 THEN text || chr(13) || 'x' || chr(13) WHEN 2 THEN 'a' || chr(160) || text WHEN 3 THEN chr(65279) || text ELSE text END AS text FROM documents)") + " UNION ALL " + _SCAN.format(k="p", id="page_id", c="html", t="pages"))
def encoding_scan(spark, sf_dir):
    i, t = F.col("doc_id") % 50, F.col("text")
    text = F.when(i == 1, F.concat(t, F.lit("\rx\r"))).when(i == 2, F.concat(F.lit("a\u00a0"), t)).when(i == 3, F.concat(F.lit("\ufeff"), t)).otherwise(t)
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), text.alias("content"))
    pages = _table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("file"), F.col("html").alias("content"))
    return integrity.encoding_scan(docs.unionByName(pages), "file", "content")


@query("""WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)
SELECT conv_id, max(CASE WHEN role = 'assistant' AND k = 1 THEN trim(text, ' ' || chr(10) || chr(9)) END) AS body FROM r GROUP BY conv_id""")
def release_section(spark, sf_dir):
    """What stands under the first heading `assistant` of each conversation's markdown; null where there is none."""
    return _markdown(spark, sf_dir).select("conv_id", integrity.section(F.col("text"), "assistant").alias("body"))


@query("""SELECT 'UR-' || o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN '✅' WHEN 'O' THEN '❌' END AS mark FROM orders WHERE o_orderkey % 5 <> 0""")
def register_marks(spark, sf_dir):
    """Rows of a pipe table made from the orders, with marks in their text and in their last cell; every fifth is no row of the register."""
    i, status = F.col("o_orderkey"), F.col("o_orderstatus")
    last = F.when(status == "F", " ✅ |").when(status == "O", " ⏳ | ❌ |").otherwise(" none |")
    line = F.when(i % 10 == 0, "| Id | State |").when(i % 5 == 0, F.concat(F.lit("UR-"), i.cast("string"), F.lit(" ✅"))).otherwise(F.concat(F.lit("| UR-"), i.cast("string"), F.lit(" | of ✅ text |"), last))
    return integrity.table_marks(_table(spark, sf_dir, "orders").select(line.alias("line")))


@query(r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), p AS (SELECT r, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')) AS w, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), 1) AS k FROM d),
n AS (SELECT w AS name, reverse(w) AS public FROM p WHERE length(w) > 3 AND regexp_matches(w, '^[\p{L}\p{N}_]') GROUP BY w HAVING count(*) > 1)
SELECT doc_id, coalesce(t, text) AS text FROM d LEFT JOIN (SELECT r, string_agg(coalesce(public, w), '' ORDER BY k) AS t FROM p LEFT JOIN n ON name = w GROUP BY r) USING (r)""")
def published_ids(spark, sf_dir):
    """Every word of four letters or more that the documents hold twice is a name, and has its public name: itself backwards. All are replaced at once."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]{4,}"), F.lit(0))).alias("name"))
    names = words.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.reverse("name").alias("public"))
    return integrity.published(docs, names)


@query("""WITH r AS (SELECT orders.o_orderstatus AS status, lineitem.l_returnflag AS flag, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT status, flag, n FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY n DESC, flag) AS k FROM r) WHERE k <= 3""")
def star_rank(spark, sf_dir):
    """No counterpart of its own: a join, a group count and a rank over the star schema, as a check of scans and joins."""
    n = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderstatus").alias("status"), F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(W.partitionBy("status").orderBy(F.desc("n"), "flag"))).where("k <= 3").drop("k")
