"""Registers held against each other, reachability, and scans of text tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import scratch

# Domains of the verification register.
RESULTS = ("pass", "fail", "deferred", "not_run")
MARK_DONE, MARK_OPEN = "✅", "❌"
TERMINAL = ("pass", "deferred")


def closure(edges: DataFrame, starts: DataFrame, *, wide: int = 4) -> tuple[DataFrame, int]:
    """(start, node of everything that edges(src, dst) reach from starts(start), themselves included; and the rounds it took).

    Steps are squared: after k rounds a step is a walk of 2^k edges and all nodes nearer than that are found, so a path of
    n edges takes log n rounds. Before each squaring the pairs it would make are counted by node (in times out); beyond
    `wide` times the edges, as where many paths meet in hubs, the steps stay as long as they are and only the newest pairs
    go on with them. Every round starts at written tables; its joins are split by skew where a hub's rows are many.
    """
    spark = starts.sparkSession
    folder = f"{scratch(spark)}/{uuid.uuid4().hex[:12]}"

    def stored(rows, name):  # plans stay short and nothing is held in memory
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    steps = stored(edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).where("node IS NOT NULL AND to IS NOT NULL").distinct(), "steps0")
    bound, squared = wide * steps.count() + 1, 0
    found = new = stored(starts.select("start", F.col("start").alias("node")).distinct(), "pairs0")
    rounds = 0
    while True:
        rounds += 1
        reach = found if squared is not None else new
        step = reach.join(steps, "node").select("start", F.col("to").alias("node")).distinct()
        new = stored(step.join(found, ["start", "node"], "left_anti"), f"pairs{rounds}")
        if not new.limit(1).count():
            return found, rounds
        found = spark.read.schema(new.schema).parquet(*(f"{folder}/pairs{k}" for k in range(rounds + 1)))
        if squared is None:
            continue
        into = steps.groupBy(F.col("to").alias("node")).agg(F.count("*").alias("i"))
        out = steps.groupBy("node").agg(F.count("*").alias("o"))
        if (into.join(out, "node").agg(F.coalesce(F.sum(F.col("i") * F.col("o")), F.lit(0))).first()[0]) > bound:
            squared = None
            continue
        squared += 1
        steps = stored(steps.select("node", F.col("to").alias("_mid")).join(steps.select(F.col("node").alias("_mid"), "to"), "_mid").select("node", "to").distinct(), f"steps{squared}")


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node of everything that edges(src, dst) reach from starts(start), themselves included."""
    return closure(edges, starts)[0]


def violations(rows: DataFrame, key: str, *rules: tuple[Column, str]) -> DataFrame:
    """id, finding of each row and rule (condition, finding) whose condition holds: all rules in one scan, without a shuffle."""
    told = F.array(*(F.when(condition, F.lit(finding)) for condition, finding in rules))
    return rows.select(F.col(key).alias("id"), F.explode(F.filter(told, lambda x: x.isNotNull())).alias("finding"))


def audit(rows: DataFrame, key: str, *rules: tuple[Column, str]) -> DataFrame:
    """finding, n, first_id, last_id for each rule (condition, finding), those that nothing violates included: one aggregate over one scan."""
    told = [F.struct(F.count_if(c).alias("n"), F.min(F.when(c, F.col(key))).alias("first_id"), F.max(F.when(c, F.col(key))).alias("last_id"), F.lit(f).alias("finding")) for c, f in rules]
    return rows.agg(F.array(*told).alias("all")).select(F.explode("all").alias("r")).select("r.finding", "r.n", "r.first_id", "r.last_id")


def is_outside(column: str, domain: tuple) -> Column:
    return ~F.coalesce(F.col(column).isin(*domain), F.lit(False))


def is_blank(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit(""))) == ""


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def unresolved(rows: DataFrame, key: str, column: str, defined: DataFrame, name: str) -> DataFrame:
    """key, column of references that the register does not define."""
    cited = rows.where(F.col(column).isNotNull()).select(key, column)
    return cited.join(defined.select(F.col(name).alias(column)).distinct(), column, "left_anti")


def holes(requirements: DataFrame, tests: DataFrame) -> DataFrame:
    """ids of requirements(id) that no test(discharges array) names."""
    covered = tests.select(F.explode("discharges").alias("id")).distinct()
    return requirements.select("id").join(covered, "id", "left_anti")


def contradictions(requirements: DataFrame, tests: DataFrame) -> DataFrame:
    """id, mark, finding where the register's mark and the tests' results disagree."""
    seen = tests.select(F.explode("discharges").alias("id"), "result").groupBy("id").agg(F.bool_or(F.col("result").isin("fail", "not_run")).alias("any_bad"), F.bool_and(F.col("result") == "pass").alias("all_pass"))
    finding = F.when((F.col("mark") == MARK_DONE) & F.col("any_bad"), "done but a test is not passing").when((F.col("mark") == MARK_OPEN) & F.col("all_pass"), "open but every test passes")
    return requirements.join(seen, "id").select("id", "mark", finding.alias("finding")).where("finding IS NOT NULL")


def manifest_findings(tests: DataFrame, defects: DataFrame, requirements: DataFrame) -> DataFrame:
    """id, finding over the whole manifest: duplicates, domains, missing fields, evidence, references, coverage, contradictions.

    Each table's rules of one row are one scan; what takes two rows or tables is a grouping or a join of the columns it needs.
    """
    named = lambda df, what: df.select(F.col(df.columns[0]).alias("id"), F.lit(what).alias("finding"))
    result = F.col("result")
    of_tests = violations(
        tests, "id", (is_outside("result", RESULTS), "result outside its domain"), (is_blank("falsifier"), "no falsifier"), (is_blank("expected"), "no expected"),
        (result.isin("pass", "fail") & is_blank("observed"), "no observed"), ((result == "deferred") & is_blank("release_decision"), "no release_decision"),
        (result.isin("deferred", "fail") & is_blank("issue"), "no issue"),
    )
    of_defects = violations(defects, "id", *((is_blank(c), f"no {c}") for c in ("title", "severity", "rationale", "release_note")))
    parts = [
        of_defects, named(duplicates(tests, "id"), "duplicate test id"), named(duplicates(defects, "id"), "duplicate defect id"),
        named(unresolved(tests, "id", "issue", defects, "tracked_as").select("id"), "issue not in the register"),
        named(unresolved(tests.select("id", F.explode("discharges").alias("requirement")), "id", "requirement", requirements, "id").select("id"), "requirement not in the register"),
        named(holes(requirements, tests), "no test and no deferral"), contradictions(requirements, tests).select("id", "finding"),
    ]
    out = of_tests
    for p in parts:
        out = out.unionByName(p)
    return out


def release_gate(tests: DataFrame, defects: DataFrame, requirements: DataFrame, marks: tuple[str, ...] = (MARK_DONE,)) -> DataFrame:
    """id, finding of what forbids a release."""
    a = defects.where("release_decision = 'fix before release' AND status != 'resolved'").select("id", F.lit("to be fixed and still open").alias("finding"))
    b = requirements.where(F.col("mark").isNotNull() & ~F.col("mark").isin(*marks)).select("id", F.lit("mark is not publishable").alias("finding"))
    c = tests.where(~F.coalesce(F.col("result").isin(*TERMINAL), F.lit(False))).select("id", F.lit("neither passed nor deferred").alias("finding"))
    return a.unionByName(b).unionByName(c)


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows on one side only, with side: missing or unexpected."""
    return expected.exceptAll(actual).withColumn("side", F.lit("missing")).unionByName(actual.exceptAll(expected).withColumn("side", F.lit("unexpected")))


def encoding_scan(rows: DataFrame, key: str, content: str) -> DataFrame:
    """key, bom, cr and nbsp (first character, from 0, and how often), valid, problems of a text or binary column."""
    raw = F.col(content)
    binary = dict(rows.dtypes)[content] == "binary"
    text = F.make_valid_utf8(raw.cast("string")) if binary else raw
    valid = F.is_valid_utf8(raw.cast("string"))
    found = lambda needle: (F.instr(text, needle) - 1).cast("bigint")
    times = lambda needle: (F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))).cast("bigint")
    out = rows.select(key, F.startswith(text, F.lit("\ufeff")).alias("bom"), F.when(F.contains(text, F.lit("\r")), found("\r")).alias("cr_at"), times("\r").alias("cr_count"), F.when(F.contains(text, F.lit("\u00a0")), found("\u00a0")).alias("nbsp_at"), times("\u00a0").alias("nbsp_count"), valid.alias("valid"))
    return out.withColumn("problems", (F.col("bom").cast("bigint") + (F.col("cr_count") > 0).cast("bigint") + (F.col("nbsp_count") > 0).cast("bigint") + (~F.col("valid")).cast("bigint")))


def scan_verdict(scan: DataFrame) -> DataFrame:
    """One row: files, problems, verdict; a scan that inspected nothing has not passed."""
    got = scan.agg(F.count("*").alias("files"), F.coalesce(F.sum("problems"), F.lit(0)).cast("bigint").alias("problems"))
    return got.withColumn("verdict", F.when(F.col("files") == 0, "nothing inspected").when(F.col("problems") > 0, "failed").otherwise("ok"))


def section(text, heading: str):
    """The lines under the first heading with this title, up to the next of its level or above; null where there is none."""
    lines = F.split(text, "\n")
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line"), F.length(F.regexp_extract(x, r"^(#{1,6})\s", 1)).alias("level"), F.trim(F.regexp_extract(x, r"^#{1,6}\s+(.*?)\s*$", 1)).alias("title")))
    start = F.try_element_at(F.filter(numbered, lambda r: (r["level"] > 0) & (r["title"] == heading)), F.lit(1))
    end = F.coalesce(F.try_element_at(F.filter(numbered, lambda r: (r["level"] > 0) & (r["i"] > start["i"]) & (r["level"] <= start["level"])), F.lit(1))["i"], F.size(lines))
    body = F.filter(numbered, lambda r: (r["i"] > start["i"]) & (r["i"] < end))
    return F.when(start.isNotNull(), T.strip(F.array_join(F.transform(body, lambda r: r["line"]), "\n")))


def table_marks(lines: DataFrame, line: str = "line") -> DataFrame:
    """id, mark of the rows of pipe tables whose first cell is an id: the last cell that is a mark."""
    cells = F.transform(F.split(F.col(line), r"\|"), lambda c: F.trim(c))
    filled = F.filter(cells, lambda c: c != "")
    marks = F.filter(cells, lambda c: c.isin(MARK_DONE, MARK_OPEN, "⏳", "➖"))
    return lines.where(F.startswith(F.ltrim(F.col(line)), F.lit("|"))).select(F.try_element_at(filled, F.lit(1)).alias("id"), F.try_element_at(marks, F.lit(-1)).alias("mark")).where(F.col("id").rlike(r"^[A-Z]+-\d+$"))


# Names are matched whole: a piece is a stretch of word characters or of others, and a name is one or more pieces.
PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"


WORD = r"^[\p{L}\p{N}_]"


def stretches(kinds: dict[int, set[bool]]) -> Column:
    """(at, size, name) of each stretch of _pieces that has the size of a name and begins as names of that size do (kinds: in a word or not)."""

    def of(n, k):  # pieces are words and others in turn
        first = F.lit(0) if len(k) > 1 else F.when(F.col("_word") == F.lit(next(iter(k))), 0).otherwise(1)
        last = F.size("_pieces") - n
        begins = F.when(first <= last, F.sequence(first, last, F.lit(1 if len(k) > 1 else 2))).otherwise(F.array().cast("array<int>"))
        return F.transform(begins, lambda i: F.struct(i.alias("at"), F.lit(n).alias("size"), (F.get("_pieces", i) if n == 1 else F.array_join(F.slice("_pieces", i + 1, F.lit(n)), "")).alias("name")))

    return F.concat(*(of(n, k) for n, k in sorted(kinds.items())))


def tried(held: DataFrame, kinds: dict[int, set[bool]], *more: str) -> DataFrame:
    """`more`, _row, name, places (at, size), _all: for each of held(`more`, _row, _all, _pieces) itself, without a name, and
    its distinct stretches(). A text stands beside itself only: each row of an explode is a copy of what stands beside."""
    held = held.withColumn("_word", F.get("_pieces", F.lit(0)).rlike(WORD))
    held = held.select(*more, "_row", "_all", F.array_sort(F.transform(stretches(kinds), lambda t: F.struct(t["name"].alias("name"), t["at"].alias("at"), t["size"].alias("size")))).alias("_s"))
    first = F.filter(F.transform("_s", lambda x, i: F.when((i == 0) | (F.get("_s", i - 1)["name"] != x["name"]), i)), lambda i: i.isNotNull())
    held = held.withColumn("_first", first)
    places = lambda i, j: F.transform(F.slice("_s", i + 1, F.coalesce(F.get("_first", j + 1), F.size("_s")) - i), lambda x: F.struct(x["at"].alias("at"), x["size"].alias("size")))
    none = F.lit(None).cast(held.schema["_all"].dataType)
    names = F.transform("_first", lambda i, j: F.struct(F.get("_s", i)["name"].alias("name"), places(i, j).alias("places"), none.alias("all")))
    itself = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.array().cast("array<struct<at:int,size:int>>").alias("places"), F.col("_all").alias("all")))
    return held.select(*more, "_row", F.explode(F.concat(itself, names)).alias("t")).select(*more, "_row", "t.name", "t.places", F.col("t.all").alias("_all"))


def published(rows: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """rows with the names(name, public) in a text replaced, all at once: what was put in is not read again.

    From the left, where several names begin the first by code point is taken; a name stands for itself, whatever its
    characters, and begins and ends where words do. Rows are dealt to blocks once, by a hash of what they hold. The
    distinct pieces of each block meet the names in an equi join, which the optimizer broadcasts only if it has measured
    the names to be small; what met goes back to its block, where it is sorted among the stretches: of pieces, a block's distinct ones
    travel, and of texts each once. A null text stays null; a name listed twice has the least of its public names; null and empty names are nobody's.
    """
    spark, columns = rows.sparkSession, rows.columns
    path = f"{scratch(spark)}/{uuid.uuid4().hex[:12]}"
    names.where(F.length("name") > 0).groupBy("name").agg(F.min("public").alias("public")).write.parquet(path)  # read twice
    table = spark.read.schema("name string, public string").parquet(path)
    found = table.select(F.size(F.regexp_extract_all("name", F.lit(PIECE), F.lit(0))), F.col("name").rlike(WORD)).distinct().collect()  # as few as the longest name has pieces
    kinds = {n: {r[1] for r in found if r[0] == n} for n, _ in found}
    if not kinds:
        return rows
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    dealt = lambda df: df.repartition(number, "_block")
    keys = [r[0] for r in spark.range(32 * number).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(number))).agg(F.min("k")).select("min(k)").collect()]  # a block a partition
    block = F.get(F.array(*map(F.lit, sorted(keys))), F.pmod(F.xxhash64(*hashed), F.lit(len(keys))).cast("int"))
    blocks = dealt(rows.select(block.alias("_block"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_all")))
    pieces = lambda x: F.coalesce(F.regexp_extract_all(x[text], F.lit(PIECE), F.lit(0)), F.array().cast("array<string>"))
    held = blocks.select("_block", "_all", F.element_at(F.transform(F.array("_all"), pieces), 1).alias("_pieces"))  # of whole rows, so that both uses below have one exchange
    words = held.select("_block", "_pieces", F.get("_pieces", F.lit(0)).rlike(WORD).alias("_word"))
    seen = words.select("_block", F.explode(F.transform(stretches(kinds), lambda t: t["name"])).alias("name")).distinct()
    hits = dealt(seen.join(table, "name").select("_block", "name", "public"))
    each = tried(held.withColumn("_row", F.monotonically_increasing_id()), kinds, "_block").withColumn("public", F.lit(None).cast("string"))
    told = W.partitionBy("name", "_block").orderBy(F.col("_row").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)  # a hit stands before the stretches of its name
    met = each.unionByName(hits, allowMissingColumns=True).withColumn("public", F.max("public").over(told)).where("_all IS NOT NULL OR public IS NOT NULL AND _row IS NOT NULL")
    found = F.collect_list(F.when(F.col("_all").isNull(), F.struct("name", "places", "public")))
    held = met.groupBy("_row", "_block").agg(F.max_by("_all", F.col("_all").isNotNull()).alias("_all"), found.alias("_met"))
    spread = F.transform("_met", lambda m: F.transform(m["places"], lambda x: F.struct(x["at"].alias("at"), m["name"].alias("name"), x["size"].alias("size"), m["public"].alias("public"))))
    held = held.select("_all", F.array_sort(F.flatten(spread)).alias("_met"), F.regexp_extract_all(F.col("_all")[text], F.lit(PIECE), F.lit(0)).alias("_pieces"))
    if set(kinds) != {1}:  # names of several pieces may overlap: what begins first holds

        def step(s, m):
            return F.when(m["at"] >= s["next"], F.struct((m["at"] + m["size"]).alias("next"), F.concat(s["kept"], F.array(m)).alias("kept"))).otherwise(s)

        zero = F.struct(F.lit(0).alias("next"), F.array().cast(held.schema["_met"].dataType).alias("kept"))
        held = held.withColumn("_met", F.aggregate("_met", zero, step, lambda s: s["kept"]))
    end = lambda m: m["at"] + m["size"]
    join = lambda first, size: F.array_join(F.slice("_pieces", first + 1, size), "")
    before = lambda j: F.when(j == 0, 0).otherwise(end(F.get("_met", j - 1)))
    parts = F.transform("_met", lambda m, j: F.concat(join(before(j), m["at"] - before(j)), m["public"]))
    done = F.concat(F.array_join(parts, ""), join(end(F.element_at("_met", -1)), F.size("_pieces")))
    replaced = F.when(F.size("_met") == 0, F.col("_all")[text]).otherwise(done)
    return held.select(*(replaced.alias(c) if c == text else F.col("_all")[c].alias(c) for c in columns))
