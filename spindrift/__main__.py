"""Command line: build, search, explain and status of indexes of markdown folders.

    python -m spindrift build FOLDER --name NAME --dir DIR [--model M --limit N]
    python -m spindrift list --dir DIR
    python -m spindrift search NAME QUERY --dir DIR [-k 5] [--rerank MODEL --pool 20]
    python -m spindrift explain NAME QUERY TEXT --dir DIR
    python -m spindrift status NAME FOLDER --dir DIR
    python -m spindrift export NAME FILE --dir DIR

A build with --log LOG logs each vector as it arrives, and started again asks only for what is not logged.

Without --host the offline embedder is used, and only for indexes that it built: a query is always embedded by the model
of its index. Exit codes: 0 fine, 1 drifted or not found, 2 refused or not checked.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F

from .functions import text as T
from .operators import index, rerank, search
from .session import session
from .sources import index_json, markdown
from .sources.models import Config, HashEmbedder, HttpChat, HttpEmbedder, base_url, details_table, probe
from .verdicts import Refused


OFFLINE_LIMIT = 2048  # tokens of a chunk for the offline embedder, which has no context of its own


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spindrift", description=__doc__.split("\n")[0])
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in (("list", ()), ("probe", ()), ("build", ("folder",)), ("search", ("name", "query")), ("explain", ("name", "query", "text")), ("status", ("name", "folder")), ("export", ("name", "file"))):
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        s.add_argument("--dir", required=name != "probe")
        s.add_argument("--host")
        if name == "build":
            s.add_argument("--name", required=True)
            s.add_argument("--model", help="the embedding model; without a host the offline one")
            s.add_argument("--limit", type=int, help="the model's context in tokens; without it the server is asked")
            s.add_argument("--chunk-chars", type=int, default=1500)
            s.add_argument("--force", action="store_true")
            s.add_argument("--log", help="a folder in which answers are kept, so that a build that failed can go on")
        if name == "search":
            s.add_argument("-k", type=int, default=5)
            s.add_argument("--rerank", metavar="MODEL")
            s.add_argument("--pool", type=int, default=search.DEFAULT_POOL)
            s.add_argument("--rubric", choices=tuple(rerank.SCALES), default="plain")
    return p


def _embedder(args, model: str | None):
    """The embedder that was asked for; without a host there is one model only, and no other is put in its place."""
    offline = HashEmbedder()
    if args.host:
        if not model:
            raise Refused("invalid_request", "no model is named", "pass --model")
        return HttpEmbedder(Config(base_url(args.host)), model)
    if model not in (None, offline.name):
        raise Refused("model_not_found", f"{model!r} is not available without a server", "pass --host")
    return offline


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = session()
    try:
        if args.command == "probe":
            found = probe(Config(base_url(args.host or Config.url)))
            print(" ".join(f"{k}={v}" for k, v in found.items()))
            return int(found["verdict"] != "ok")
        if args.command == "list":
            rows = index.listing(spark, args.dir).collect()
            for r in rows:
                print(f"{r.name}: {r.verdict}, {r.model}, {r.file_count} files, {r.chunk_count} chunks, built {r.built_at}")
            return int(not rows)
        if args.command == "build":
            embed = _embedder(args, args.model)
            details = details_table(spark, embed.config, [embed.name]) if args.host else None
            limit = args.limit or (None if args.host else OFFLINE_LIMIT)
            made = index.build(spark, markdown.scan(spark, args.folder), args.name, embed, model=embed.name, limit=limit, details=details, target=args.chunk_chars, path=args.dir, force=args.force, root=args.folder, log=args.log)
            h = made["header"].first()
            print(f"{h.name}: {h.file_count} files, {h.chunk_count} chunks, generation {h.generation}")
            return 0
        tables = index.read(spark, args.dir, args.name)
        header = tables["header"].first()
        if args.command == "export":
            made = index_json.export(tables, args.file).first()
            print(f"{made.path}: {made.files} files, {made.chunks} chunks, {made.bytes} bytes")
            return 0
        if args.command == "status":
            if not os.path.isdir(args.folder):
                raise Refused("not_configured", f"cannot check: no folder {args.folder}", "pass the folder that was indexed")
            summary = index.drift_summary(index.drift(tables["file"], index.digests(markdown.scan(spark, args.folder)).select("file", "digest"))).collect()
            for r in sorted(summary):
                print(f"{r.status}: {r.files} {r.names}".rstrip())
            return int(any(r.status != "same" for r in summary))
        query = search.embed_query(header, args.query, _embedder(args, header.model))
        if args.command == "explain":
            rows = search.explain(tables["chunk"], query, args.text).collect()
            for r in rows:
                print(f"rank {r.rank} of {r.of}: {r.diagnosis}")
            return int(rows[0].rank is None)
        if args.rerank:
            if not args.host:
                raise Refused("not_configured", "reranking needs a model server", "pass --host")
            found = rerank.reranked(tables["chunk"], query, args.query, HttpChat(Config(base_url(args.host)), args.rerank, temperature=0), k=args.k, pool=args.pool, rubric=args.rubric)
            for r in found["rows"].collect():
                print(f"{r.place:2d}  {r.label}  {r.cosine:.3f}  {header.generation}:{r.ordinal:04d}  {r.file}:{r.line_start}-{r.line_end}")
            flags, failed = found["flags"].first(), found["failures"].collect()
            print("".join(f"{name}\n" for name in ("weak_discrimination", "own_scale", "pool_may_be_short", "none_answers") if flags[name]) + "".join(f"batch {f.batch}: {f.failure}\n" for f in failed), end="")
            return int(not flags.judged)
        cite = T.citation("file", "line_start", "line_end", "heading")
        got = search.search(tables["chunk"], query, args.k).withColumn("cite", cite).withColumn("id", T.chunk_id(F.lit(header.generation), "ordinal")).orderBy("rank").collect()
        for r in got:
            print(f"{r.rank:2d}  {r.cosine:.3f}  {r.id}  {r.cite}")
        if got and got[0].weak_ranking:
            print(f"weak ranking: spread {got[0].spread:.3f}")
        return int(not got)
    except Refused as e:
        print(f"{e.verdict}: {e.error}\n{e.remedy}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
