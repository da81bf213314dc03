"""Scalar functions over text, names, sizes and versions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..verdicts import first_of

CHARS_PER_TOKEN = 3.2
CLOUD_TAGS = ("cloud",)
STUB_BYTES = 1 << 20
DECIDE_SINCE = (0, 35, 0)
NAME = r"^[a-z0-9_-]+\z"
# Prefixes that an embedding model wants before documents and queries.
PREFIXES = {
    "nomic-embed-text": ("search_document: ", "search_query: "),
    "mxbai-embed-large": ("", "Represent this sentence for searching relevant passages: "),
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def collapsed(x) -> Column:
    return F.regexp_replace(strip(x), r"(?U)\s+", " ")


def snippet(x, most: int = 220) -> Column:
    return F.substring(collapsed(x), 1, most)


def blank(x) -> Column:
    return F.length(strip(F.coalesce(_c(x), F.lit("")))) == 0


def newlines(x) -> Column:
    """CRLF and CR as LF, as readers in text mode do."""
    return F.regexp_replace(_c(x), r"\r\n?", "\n")


def count_of(x, needle: str) -> Column:
    """Occurrences of a one-character needle."""
    return F.length(_c(x)) - F.length(F.replace(_c(x), F.lit(needle), F.lit("")))


def newlines_in(x) -> Column:
    return count_of(x, "\n")


def tokens(chars: Column) -> Column:
    """Estimated tokens of so many characters, on the safe side."""
    return F.floor(chars / F.lit(CHARS_PER_TOKEN)).cast("bigint") + 1


def digest(text) -> Column:
    return F.substring(F.sha2(_c(text).cast("binary"), 256), 1, 16)


def chunk_id(generation, ordinal) -> Column:
    return F.format_string("%s:%04d", _c(generation), _c(ordinal))


def citation(path, start, end, heading) -> Column:
    where = F.concat(_c(path), F.lit(":"), _c(start).cast("string"), F.lit("-"), _c(end).cast("string"))
    return F.when(F.length(F.coalesce(_c(heading), F.lit(""))) > 0, F.concat(where, F.lit("  ("), _c(heading), F.lit(")"))).otherwise(where)


def base_name(model) -> Column:
    return F.regexp_replace(F.trim(_c(model)), r":latest\z", "")


def location(model, size) -> Column:
    """local, cloud, or "cloud?" where the size says stub and the name does not; a null size has no say."""
    name = F.trim(_c(model))
    at = F.instr(name, ":")
    tag = F.when(at > 0, F.lower(F.substr(name, at + 1))).otherwise(F.lit(""))
    return F.when(tag.isin(*CLOUD_TAGS), "cloud").when(_c(size) < STUB_BYTES, "cloud?").otherwise("local")


def human_size(n) -> Column:
    """A size with one decimal, ties to the even one, as C and Python print it."""
    n = _c(n)

    def tenths(k: int) -> Column:
        unit, ten = F.lit(1024**k).cast("decimal(20,0)"), n.cast("decimal(20,0)") * 10
        low = F.floor(ten / unit).cast("bigint")
        rest = 2 * (ten % unit)
        return F.when((rest > unit) | ((rest == unit) & (low % 2 == 1)), low + 1).otherwise(low)

    def label(k: int, unit: str) -> Column:
        t = tenths(k)
        return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(f" {unit}"))

    out = label(5, "PB")
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(n < 1024 ** (k + 1), label(k, unit)).otherwise(out)
    return F.when(n.isNull() | (n == 0), "unknown").otherwise(out)


def version(raw) -> Column:
    """(major, minor, patch) as a comparable struct, null where it cannot be read."""
    parts = [F.try_element_at(F.regexp_extract_all(F.coalesce(_c(raw), F.lit("")), F.lit(r"^\s*v?(\d+)\.(\d+)\.(\d+)"), F.lit(k)), F.lit(1)).try_cast("int") for k in (1, 2, 3)]
    return F.when(parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull(), F.struct(*(p.alias(n) for p, n in zip(parts, "abc", strict=True))))


def supports_decide(raw) -> Column:
    least = F.struct(*(F.lit(v).alias(n) for v, n in zip(DECIDE_SINCE, "abc", strict=True)))
    v = version(raw)
    return F.when(v.isNull(), "unknown").when(v >= least, "yes").otherwise("no")


def completion_verdict(text, done_reason) -> Column:
    """Whether a generation finished; a reason that is absent or not known is no evidence that it did."""
    reason = _c(done_reason)
    return first_of((blank(text), "empty_generation"), (reason == "length", "truncated"), (reason.isNull() | (reason != "stop"), "completion_unverified"))


def trailing_white(text, done_reason) -> Column:
    t = _c(text)
    return ~blank(t) & _c(done_reason).isNull() & F.coalesce(t.rlike(r"(?U)\s\z"), F.lit(False))


def tokens_per_second(count, nanoseconds) -> Column:
    count, ns = _c(count), _c(nanoseconds)
    return F.when((count != 0) & (ns != 0), F.round(count / (ns / 1e9), 1))


def cold_load_seconds(nanoseconds) -> Column:
    return F.when(_c(nanoseconds) > 100_000_000, F.round(_c(nanoseconds) / 1e9, 1))


def thinking_chars(thinking) -> Column:
    """Length of a reasoning text; null where there is none. The text itself is not handed on."""
    return F.when(F.length(_c(thinking)) > 0, F.length(_c(thinking)).cast("bigint"))


def empty_remedy(text, thinking) -> Column:
    """What to do about an empty answer: a budget spent on reasoning has another remedy than silence."""
    return F.when(blank(text), F.when(thinking_chars(thinking).isNotNull(), "raise max_tokens or think less").otherwise("check max_tokens or try another model"))


def context_limit(arch, num_ctx) -> Column:
    """The lower of the limits that are known and not 0; null where neither is."""
    return F.least(F.nullif(_c(arch), F.lit(0)), F.nullif(_c(num_ctx), F.lit(0)))


def num_ctx(parameters) -> Column:
    """The last num_ctx line of a model's parameters."""
    found = F.regexp_extract_all(F.coalesce(_c(parameters), F.lit("")), F.lit(r"(?m)^[ \t]*num_ctx[ \t]+(-?\d+)[ \t]*$"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).try_cast("bigint")


def architecture_limit(model_info) -> Column:
    """The first entry of a map whose key ends in .context_length."""
    entries = F.filter(F.map_entries(_c(model_info)), lambda e: F.endswith(e["key"], F.lit(".context_length")))
    return F.try_element_at(entries, F.lit(1))["value"].try_cast("bigint")


def context_check(estimate, limit, allow_truncation: bool = False, headroom: float = 0.15) -> tuple[Column, Column]:
    """(verdict, usable tokens): unknown and exceeded are refusals unless truncation is allowed."""
    limit = _c(limit)
    usable = (limit * F.lit(1 - headroom)).cast("bigint")
    if allow_truncation:
        return F.lit("ok"), usable
    return first_of((limit.isNull(), "context_unknown"), (_c(estimate) > usable, "context_exceeded")), usable


def general(x) -> Column:
    """A number as C's %g writes it: six significant digits, trailing zeros cut, an exponent below 1e-4 and from 1e6 on."""
    x = _c(x).cast("double")
    science = F.format_string("%.5e", x)
    mantissa, power = F.regexp_extract(science, r"^(-?[\d.]+)e", 1), F.regexp_extract(science, r"e([+-]\d+)$", 1)
    trimmed = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    out = F.concat(trimmed(mantissa), F.lit("e"), power)
    for k in range(-4, 6):
        out = F.when(power.try_cast("int") == k, trimmed(F.format_string(f"%.{5 - k}f", x))).otherwise(out)
    return F.when(x == 0, "0").when(x.isNotNull(), out)


def chunk_size(target: int, limit) -> Column:
    return F.least(F.lit(target).cast("bigint"), (_c(limit) * F.lit(CHARS_PER_TOKEN)).cast("bigint"))


def prefixes_for(model: str) -> tuple[str, str]:
    return PREFIXES.get(model) or PREFIXES.get(model.split(":")[0]) or ("", "")
