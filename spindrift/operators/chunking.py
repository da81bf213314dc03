"""Chunks with citations: paragraphs, packing with overlap, slicing of long paragraphs.

All of it are column functions and windows over the lines of a document. A document's lines meet in one exchange by a
key and a number given to each row, so that rows which repeat a key stay apart; every later step keeps to that
partitioning, and documents that already lie by their key are not exchanged at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..verdicts import Refused

OVERLAP = 200
TARGET = 1500
# Where lines end, what white space is, and what a heading and a code fence look like.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WHITE = r"[\s\x1c-\x1f]"
HEADING = r"(?Us)^(#{1,6})[\s\x1c-\x1f]+([^\s\x1c-\x1f].*?)[\s\x1c-\x1f]*#*[\s\x1c-\x1f]*\z"
FENCE = r"(?U)^[\s\x1c-\x1f]*(```|~~~)"
_BLOCK = "struct<text:string,start:bigint,end:bigint,heading:string>"


def check_size(most: int) -> int:
    if most <= OVERLAP:
        raise Refused("invalid_request", f"chunk size {most} is not above the overlap of {OVERLAP}", "use a larger chunk size")
    return most


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U)^{WHITE}+|{WHITE}+\z", "")


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_row, _key, _pos, _text, _start, _end, _heading of every paragraph, by _row.

    A paragraph is a stretch of lines that are not blank: these are numbered, and a gap between numbers begins the next.
    A paragraph's first line is a heading only if no fence is open after the paragraph's last line.
    """
    rows = docs.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), F.split(F.col(text).cast("string"), LINE_END).alias("_lines"))
    lines = rows.select("_row", "_key", F.posexplode("_lines").alias("_n", "_line")).where(~F.col("_line").rlike(rf"(?U)^{WHITE}*\z"))
    order = W.partitionBy("_key", "_row").orderBy("_n")
    lines = lines.withColumn("_new", F.coalesce(F.col("_n") - F.lag("_n").over(order) > 1, F.lit(True)).cast("long")).withColumn("_fence", F.col("_line").rlike(FENCE).cast("long"))
    lines = lines.withColumn("_island", F.sum("_new").over(order)).withColumn("_fences", F.sum("_fence").over(order))
    held = lines.groupBy("_key", "_row", "_island").agg(
        F.array_sort(F.collect_list(F.struct("_n", "_line"))).alias("_l"), (F.min("_n") + 1).cast("long").alias("_start"), (F.max("_n") + 1).cast("long").alias("_end"), F.max("_fences").alias("_fences"),
    )
    head = _stripped(F.col("_l")[0]["_line"])
    title = F.when((F.col("_fences") % 2 == 0) & head.rlike(HEADING), F.regexp_extract(head, HEADING, 2))
    held = held.select("_row", "_key", "_start", "_end", _stripped(F.array_join(F.transform("_l", lambda x: x["_line"]), "\n")).alias("_text"), title.alias("_title"))
    order = W.partitionBy("_key", "_row").orderBy("_start")
    heading = F.coalesce(F.last("_title", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(""))
    return held.select("_row", "_key", (F.row_number().over(order) - 1).cast("long").alias("_pos"), "_text", "_start", "_end", heading.alias("_heading"))


def paragraph_blocks(docs: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """key, pos, text, line_start, line_end, heading of every paragraph. Null and blank texts have none."""
    return _blocks(docs, key, text).select(F.col("_key").alias(key), F.col("_pos").alias("pos"), F.col("_text").alias("text"), F.col("_start").alias("line_start"), F.col("_end").alias("line_end"), F.col("_heading").alias("heading"))


def _sliced(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """Adds _cut to rows(_row, `by`, _text, _start, _end): long texts become rows of overlapping slices with their own lines.

    All slices but the first start after a blank. A text is cut once into steps; a slice is its step and the start of what
    follows, and its lines a running sum over the steps.
    """
    step = most - OVERLAP
    cuts = F.when(F.length("_text") > most, F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))).otherwise(F.array("_text"))
    rows = rows.withColumn("_long", F.length("_text") > most).select("*", F.posexplode(cuts).alias("_cut", "_c"))
    order = W.partitionBy("_key", "_row", *by).orderBy("_cut")
    after = F.substring(F.array_join(F.collect_list("_c").over(order.rowsBetween(1, -(-OVERLAP // step))), ""), 1, OVERLAP)
    before = F.coalesce(F.sum(T.newlines_in("_c")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_piece", F.concat("_c", after)).withColumn("_before", before)
    rows = rows.withColumn("_skip", F.when(F.col("_cut") > 0, F.instr("_piece", " ")).otherwise(0))
    start = F.col("_start") + F.col("_before") + T.newlines_in(F.substring("_piece", F.lit(1), F.col("_skip")))
    end = F.when(F.col("_long"), F.col("_start") + F.col("_before") + T.newlines_in("_piece")).otherwise(F.col("_end"))
    rows = rows.withColumn("_text", F.substring("_piece", F.col("_skip") + 1, F.length("_piece"))).withColumn("_end", end.cast("long")).withColumn("_start", start.cast("long"))
    return rows.drop("_c", "_piece", "_before", "_skip")


def _closed(held: Column) -> Column:
    """A chunk of what is held."""
    first, last = F.element_at(held, 1), F.element_at(held, -1)
    return F.struct(F.array_join(F.transform(held, lambda b: b["text"]), "\n\n").alias("text"), first["start"].alias("start"), last["end"].alias("end"), first["heading"].alias("heading"))


def _tail(held: Column) -> Column:
    """The end of what is held, from a word's start, as a block that cites the line where it starts."""

    def cited(whole: Column, tail: Column) -> Column:
        def step(a: Column, b: Column) -> Column:
            size, offset = F.length(b["text"]), F.length(whole) - F.length(tail)
            line = b["start"] + T.newlines_in(F.substring(b["text"], F.lit(1), F.greatest(F.lit(0), offset - a["at"])))
            hit = F.struct((a["at"] + size + 2).alias("at"), (offset <= a["at"] + size).alias("found"), line.cast("long").alias("line"), b["heading"].alias("heading"))
            return F.when(a["found"], a).otherwise(hit)

        zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("found"), F.lit(0).cast("long").alias("line"), F.lit("").alias("heading"))
        return F.aggregate(held, zero, step, lambda a: F.struct(tail.alias("text"), a["line"].alias("start"), a["line"].alias("end"), a["heading"].alias("heading")))

    def cut(whole: Column) -> Column:
        last = F.substring(whole, -OVERLAP, OVERLAP)
        tail = F.when(F.length(whole) > OVERLAP, F.substring(last, F.instr(last, " ") + 1, F.lit(OVERLAP))).otherwise(whole)
        return _let(tail, lambda t: cited(whole, t))

    return _let(F.array_join(F.transform(held, lambda b: b["text"]), "\n\n"), cut)


def _packed(blocks: Column, most: int) -> Column:
    """Blocks, none longer than `most`, packed into chunks: an ordered fold whose state is what is held, its size, and the chunks closed."""

    def step(s: Column, b: Column) -> Column:
        size = F.length(b["text"])
        more = F.struct(F.concat(s["held"], F.array(b)).alias("held"), (s["size"] + size + 2).alias("size"), s["out"].alias("out"))
        anew = _let(_tail(s["held"]), lambda t: F.struct(F.array(t, b).alias("held"), (F.length(t["text"]) + size + 4).alias("size"), F.concat(s["out"], F.array(_closed(s["held"]))).alias("out")))
        return F.when((F.size(s["held"]) == 0) | (s["size"] + size <= most), more).otherwise(anew)

    none = F.array().cast(f"array<{_BLOCK}>")
    zero = F.struct(none.alias("held"), F.lit(0).alias("size"), none.alias("out"))
    return F.aggregate(blocks, zero, step, lambda s: F.when(F.size(s["held"]) > 0, F.concat(s["out"], F.array(_closed(s["held"])))).otherwise(s["out"]))


def chunked(docs: DataFrame, most: int = TARGET, key: str = "file", text: str = "text") -> DataFrame:
    """key, pos, text, heading, line_start, line_end of every chunk.

    Paragraphs are packed into chunks of about `most` characters, each but the first of a run opened by the end of the
    last; such a chunk may be longer than `most` by the tail and two. A longer paragraph ends the run and is sliced.
    """
    check_size(most)
    rows = _sliced(_blocks(docs, key, text), most, "_pos")
    order = W.partitionBy("_key", "_row").orderBy("_pos", "_cut")
    turn = F.col("_long") != F.coalesce(F.lag("_long").over(order), F.col("_long"))
    rows = rows.withColumn("_turn", turn.cast("long")).withColumn("_run", F.sum("_turn").over(order))
    block = F.struct(F.col("_pos"), F.col("_cut"), F.struct(F.col("_text").alias("text"), F.col("_start").alias("start"), F.col("_end").alias("end"), F.col("_heading").alias("heading")).alias("b"))
    runs = rows.groupBy("_key", "_row", "_run").agg(F.first("_long").alias("_long"), F.array_sort(F.collect_list(block)).alias("_all"))
    runs = runs.withColumn("_b", F.transform("_all", lambda x: x["b"]))
    runs = runs.select("_row", "_key", "_run", F.posexplode(F.when(F.col("_long"), F.col("_b")).otherwise(_packed(F.col("_b"), most))).alias("_k", "_c"))
    pos = (F.row_number().over(W.partitionBy("_key", "_row").orderBy("_run", "_k")) - 1).cast("long")
    return runs.select(F.col("_key").alias(key), pos.alias("pos"), "_c.text", "_c.heading", F.col("_c.start").alias("line_start"), F.col("_c.end").alias("line_end"))


def long_slices(docs: DataFrame, most: int = TARGET, key: str = "file", text: str = "text") -> DataFrame:
    """The slices of texts that are one long paragraph: key, pos, text, line_start, line_end."""
    check_size(most)
    rows = docs.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), _stripped(F.col(text)).alias("_text"), F.lit(1).cast("long").alias("_start"), F.lit(1).cast("long").alias("_end"))
    rows = _sliced(rows.where(F.length("_text") > most), most)
    return rows.select(F.col("_key").alias(key), F.col("_cut").cast("long").alias("pos"), F.col("_text").alias("text"), F.col("_start").alias("line_start"), F.col("_end").alias("line_end"))
