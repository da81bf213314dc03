"""Fill-in-middle transformation, written in SQL that DuckDB runs over each Arrow batch inside the tasks.

A text is cut into units, each a word with the white space before it (white space at the end is a unit of its own).
Where the document is chosen, the text is cut at two of its units and written with the middle last: as prefix, suffix,
middle (psm) or suffix, prefix, middle (spm). The choice and the cuts come from a hash of the seed and the document's id,
so that a rerun, another partitioning and a lost executor all give the same rows. There is no shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, tune
from .flat import small

# The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
OUT = "doc_id long, n long, form string, output string, prefix_chars long, middle_chars long"

SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256($seed || ':' || coalesce(doc_id::VARCHAR, '')) AS hash FROM batch),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
  list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(hash, k, 8))::BIGINT) AS h FROM t),
c AS (SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= $chosen THEN 'plain' WHEN h[4] % 100 < $spm THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, n, form, text, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, 1, a), '') END AS prefix,
  CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, a + 1, b), '') END AS middle, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, b + 1, n), '') END AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output,
  length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars FROM p
"""


def transform(docs: DataFrame, *, seed: int = 42, chosen: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), output, prefix_chars, middle_chars (code points; null if plain) of each row of docs(doc_id, text).

    chosen: of a hundred documents so many are rewritten, and of a hundred of these so many as spm. A null text counts as
    empty and stays plain, as does a text that holds one of the marks. A null doc_id is hashed as the empty string and
    stays null; rows that repeat are transformed each; an empty table gives no rows; further columns are ignored. A text
    is cut whole; batches are cut to about 1 MB of text, and a longer text is a batch of its own.
    """
    tune(docs.sparkSession)

    def run(batches):
        import duckdb

        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as db:
            for rows in small(batches):
                db.register("batch", pa.Table.from_batches([rows]))
                got = db.sql(SQL, params={"seed": str(seed), "chosen": chosen, "spm": spm}).to_arrow_table()
                db.unregister("batch")
                yield from got.cast(pa.schema([(c.split()[0], pa.int64() if c.endswith(" long") else pa.string()) for c in OUT.split(", ")])).to_batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


def restored(output: Column, form: Column) -> Column:
    """The text from what was written of it. No mark can arise where parts meet, so the first of each is the one set."""
    after = lambda mark: F.substring_index(output, mark, -1)  # noqa: E731 - each mark stands once in a rewritten text
    before = lambda text, mark: F.substring_index(text, mark, 1)
    psm = F.concat(before(after(PREFIX), SUFFIX), after(MIDDLE), before(after(SUFFIX), MIDDLE))
    spm = F.concat(before(after(PREFIX), MIDDLE), after(MIDDLE), before(after(SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_infill(spark, sf_dir):
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text rebuilt from it, for every document.

    Nulls, empty texts and repeated rows as in `transform`.
    """
    got = transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


# Cut by character positions instead of lists: units end where a word ends, and the parts are substrings of the text.
ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS s FROM documents),
g AS (SELECT r, unnest(regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+')) AS u, generate_subscripts(regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), 1) AS k FROM t),
e AS (SELECT r, k, sum(length(u)) OVER (PARTITION BY r ORDER BY k) AS stop FROM g),
n AS (SELECT t.*, coalesce(c.n, 0) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM t LEFT JOIN (SELECT r, count(*) AS n FROM g GROUP BY r) c ON c.r = t.r),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN n = 0 OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
x AS (SELECT f.*, coalesce(ea.stop, 0)::BIGINT AS pa, coalesce(eb.stop, 0)::BIGINT AS pb FROM f LEFT JOIN e ea ON ea.r = f.r AND ea.k = f.a LEFT JOIN e eb ON eb.r = f.r AND eb.k = f.b),
o AS (SELECT *, substr(t, 1, pa) AS p, substr(t, pa + 1, pb - pa) AS m, substr(t, pb + 1) AS q FROM x)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN pa END AS prefix_chars, CASE WHEN form <> 'plain' THEN pb - pa END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || q || '<M>' || m ELSE '<S>' || q || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
