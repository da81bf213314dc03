"""Exact Jaccard join over word shingles by pivots in the metric space of the Jaccard distance.

Two sets link at a similarity of at least `percent`; the radius is r = 1 - percent / 100. Pivots drawn from all sets are
of no use here, as most sets are at distance 1 of each other. So the space is first cut where distance 1 can be seen:

1. A set with more than r of its size in shingles that no other set has cannot link. Shingles whose hash lies under a
   fixed share of its range are compared across all sets, and sets above the bound leave. Of those that stay all
   shingles are counted, and what no second set has is done with: only shared shingles go on.
2. In the order of these counts, rarest first, linked sets share one of their first shingles: of the larger set among
   the first r * size + 1, of the smaller one (they may be of one size) among the first half as many. Each such shingle
   is a cell; a cell in which no set could be the smaller one of a pair is empty space.
3. A pivot is elected in each cell, by a hash, so that like sets elect the same one. A pivot's region is all sets of
   its cells; linked sets share a region. Distances to pivots are exact, and sets within r of a pivot are one
   component with it.
4. A region is cut into rings of width r around its pivot. By the triangle inequality linked sets lie in one ring or in
   neighbours, so a set is also replicated to the next ring outwards. Rings whose sets are one component are done,
   and where few sets are outside a ring's largest component, only these are held against the others.
5. A ring of more than FIT sets is split again: pivots are drawn in it, each set goes to the Voronoi cell of its nearest
   pivot and, as sets within r of each other differ by at most 2 r in how much farther any pivot is than the nearest,
   also to each cell whose pivot is at most 2 r farther. Sets that are far from all pivots share one more cell, with
   a window of its own. Cells are split in turn until they fit, and joined exactly.
6. Where the distances of a ring are all about the same, windows hold everything and splitting stops: such a ring is
   dealt into blocks of GRID sets, and pairs of blocks are joined.

So components come out as if all pairs had been compared, while a group of n near copies costs about n distances, and
families of texts that are near but not within r of each other leave in steps 1 and 2 where the differences are their
own. Equal 64-bit hashes are taken for equal shingles, and equal 128-bit fingerprints of sets for equal sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_garbage, groups_of, joined, materialise, mix, ragged, release, runs, table, trim, tune
from .flat import LOWER, flat, small, span_hashes, window_starts, windows, word_bounds, word_counts

SHINGLE, PERCENT = 5, 80
SHARE = 0.3  # of the hash range, in the first comparison
LAST = 2**63 - 1  # stands for a null id
MEMBERS = 32  # sets that meet a pivot in one group
OTHERS = 64  # sets outside a ring's largest component that are held against the whole ring
FIT, PIVOTS, DEEPEST = 256, 24, 4  # sets that are joined directly; pivots that split more; how often
FAR = 0.7  # sets farther than this from all pivots have a cell of their own
GRID, GRID_BYTES = 128, 1 << 23  # sets, and bytes of their shingles, in a block
MOST_TASKS = 20_000


def sets_of(buf: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, by text and then by hash, and the number of each text."""
    low = LOWER[buf]
    starts, ends = word_bounds(low, offsets)
    words = span_hashes(low, starts, ends)
    index, doc = window_starts(starts, offsets, size)
    h = windows(words, size)[index]
    counts = word_counts(starts, offsets)
    first = np.searchsorted(starts, offsets[:-1])
    for k in range(1, size):
        few = np.flatnonzero(counts == k)
        if len(few):
            h = np.append(h, mix(windows(words, k)[first[few]] + np.uint64(k)))
            doc = np.append(doc, few)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(counts))


def fingerprints(h: np.ndarray, counts: np.ndarray, salt: int = 0xA0761D6478BD642F) -> np.ndarray:
    """A signed 64-bit fingerprint of each set; 0 for an empty one."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))])
    ends = np.cumsum(counts)
    got = mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64))
    return np.where(counts > 0, got, 0).astype(np.uint64).view(np.int64)


def seconds(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The other half of the fingerprint."""
    return fingerprints(h, counts, 0xE7037ED1A0B428DB)


def _packed(dest: np.ndarray, arrays: dict[str, np.ndarray], kind: int, base: int = 0) -> pa.RecordBatch | None:
    if not len(dest):
        return None
    order = np.argsort(dest, kind="stable")
    head = runs(dest[order])
    edges = np.append(head, len(order)).tolist()
    cols = [pa.array((dest[order[head]] + base).astype(np.int64)), pa.array(np.full(len(head), kind, np.int32))]
    for name in "abcdef":
        a = arrays.get(name)
        a = a[order] if a is not None else None
        cols.append(pa.array([b"" if a is None else a[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, ["dest", "kind", *"abcdef"])


_PACKED = "dest long, kind int, a binary, b binary, c binary, d binary, e binary, f binary"
DOCS, SHARED = 0, 1


def _dealt(rows: DataFrame, key: str, groups: int) -> DataFrame:
    """The rows over so many tasks, up to a bound: each costs the driver's memory too, so a task may have several small groups."""
    return rows.repartition(max(min(groups, MOST_TASKS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def _described(docs: DataFrame, groups: int, percent: int, size: int, share: float) -> DataFrame:
    """id, text_key, n, c and c2 (the set's fingerprint), alive: whether the first comparison leaves the set in."""
    buckets = groups
    limit = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def emit(batches):
        held, records = [], 0

        def flush():
            h, c = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            h, c = h[new], c[new]
            head = runs(h)
            number = np.diff(np.append(head, len(h)))
            again = np.repeat(number > 1, number)
            # A hash that several sets of this task hold: all of them know; one record and a mark go on.
            keys, shared = np.unique(c[again], return_counts=True)
            yield _packed((keys.view(np.uint64) % np.uint64(groups)).astype(np.int64), {"a": keys, "b": shared.astype(np.int64)}, SHARED, buckets)
            yield _packed((h[head] % np.uint64(buckets)).astype(np.int64), {"a": h[head], "b": c[head], "c": (number > 1)}, SHARED)

        for batch in small(batches, most=1 << 22):
            h, counts = sets_of(*flat(batch.column("text")), size)
            c = fingerprints(h, counts)
            of = np.repeat(np.arange(len(counts)), counts)
            pick = h < limit
            sampled = np.bincount(of[pick], minlength=len(counts)).astype(np.int64)
            yield _packed((c.view(np.uint64) % np.uint64(groups)).astype(np.int64), {"a": c, "b": counts.astype(np.int64), "c": sampled, "d": batch.column("id").to_numpy(), "e": batch.column("text_key").to_numpy(), "f": seconds(h, counts)}, DOCS, buckets) if len(c) else None
            held.append((h[pick], c[of[pick]]))
            records += len(held[-1][0])
            if records > 1_500_000:
                yield from flush()
                held, records = [], 0
        if records:
            yield from flush()

    def meet(key, rows):
        if key[0].as_py() >= buckets:
            return rows
        h, c, several = joined(rows.column("a"), np.uint64), joined(rows.column("b"), np.int64), joined(rows.column("c"), bool)
        order = np.lexsort((c, h))
        h, c, several = h[order], c[order], several[order]
        head = runs(h)
        number = np.diff(np.append(head, len(h)))
        low, high = np.minimum.reduceat(c, head), np.maximum.reduceat(c, head)
        known = np.logical_or.reduceat(several, head) | (low != high)
        # Sets marked in their task have counted this hash there already; of one set, tasks may send it twice.
        tell = np.repeat(known, number) & ~several
        tell[1:] &= ~((h[1:] == h[:-1]) & (c[1:] == c[:-1]))
        keys, shared = np.unique(c[tell], return_counts=True)
        out = _packed((keys.view(np.uint64) % np.uint64(groups)).astype(np.int64), {"a": keys, "b": shared.astype(np.int64)}, SHARED, buckets)
        return pa.Table.from_batches([out]) if out else rows.slice(0, 0)

    def tally(_key, rows):
        kinds = rows.column("kind").to_numpy()
        docs_, shared_ = rows.filter(pa.array(kinds == DOCS)), rows.filter(pa.array(kinds == SHARED))
        c, n, s, ids, text_key, c2 = (joined(docs_.column(x), np.int64) for x in "abcdef")
        keys, counts = joined(shared_.column("a"), np.int64), joined(shared_.column("b"), np.int64)
        known, of = np.unique(keys, return_inverse=True)
        total = np.bincount(of, counts, len(known)).astype(np.int64) if len(known) else np.zeros(0, np.int64)
        met = np.zeros(len(c), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, c), len(known) - 1)
            met = np.where(known[at] == c, total[at], 0)
        alive = (n > 0) & (s - met <= n * (100 - percent) // 100)
        return pa.table({"id": ids, "text_key": text_key, "n": n, "c": c, "c2": c2, "alive": alive})

    sent = docs.select("id", "text", "text_key").mapInArrow(lambda b: filter(None, emit(b)), _PACKED)
    met = _dealt(sent, "dest", 2 * groups).groupBy("dest").applyInArrow(meet, _PACKED)
    return met.groupBy("dest").applyInArrow(tally, "id long, text_key long, n long, c long, c2 long, alive boolean")


def _shared_sets(texts: DataFrame, groups: int, percent: int, size: int) -> DataFrame:
    """c, n, shared, prefix, short of the sets of texts(c, text) that may link: packed hashes of the shingles that other
    sets have too, sorted; of these the ones in the set's prefix; and whether they are in the prefix of a smaller set."""

    def emit(batches):
        held, records = [], 0

        def flush():
            h, c = (np.concatenate([x[k] for x in held]) for k in range(2))
            return _packed((h % np.uint64(groups)).astype(np.int64), {"a": h, "b": c}, SHARED)

        for batch in small(batches, most=1 << 22):
            h, counts = sets_of(*flat(batch.column("text")), size)
            c = batch.column("c").to_numpy()
            yield _packed((c.view(np.uint64) % np.uint64(groups)).astype(np.int64), {"a": c, "b": counts.astype(np.int64)}, DOCS, groups)
            held.append((h, np.repeat(c, counts)))
            records += len(h)
            if records > 1_500_000:
                yield flush()
                held, records = [], 0
        if records:
            yield flush()

    def meet(key, rows):
        if key[0].as_py() >= groups:
            return rows
        h, c = joined(rows.column("a"), np.uint64), joined(rows.column("b"), np.int64)
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        head = runs(h)
        number = np.repeat(np.diff(np.append(head, len(h))), np.diff(np.append(head, len(h))))
        at = np.flatnonzero(number > 1)
        out = _packed((c[at].view(np.uint64) % np.uint64(groups)).astype(np.int64), {"a": c[at], "b": h[at], "c": number[at].astype(np.int32)}, SHARED, groups)
        return pa.Table.from_batches([out]) if out else rows.slice(0, 0)

    def tally(_key, rows):
        kinds = rows.column("kind").to_numpy()
        of_docs, of_shingles = rows.filter(pa.array(kinds == DOCS)), rows.filter(pa.array(kinds == SHARED))
        c, n = joined(of_docs.column("a"), np.int64), joined(of_docs.column("b"), np.int64)
        order = np.argsort(c)
        c, n = c[order], n[order]
        owner, h, often = joined(of_shingles.column("a"), np.int64), joined(of_shingles.column("b"), np.uint64), joined(of_shingles.column("c"), np.int32)
        place = np.searchsorted(c, owner)
        order = np.lexsort((h, often, place))
        h, place = h[order], place[order]
        shared = np.bincount(place, minlength=len(c))
        alone = n - shared  # these come first in the order
        first = np.cumsum(shared) - shared
        rank = np.arange(len(h)) - first[place] + alone[place]
        long = (n * (100 - percent) // 100 + 1)[place]
        brief = (n - -(-2 * percent * n // (100 + percent)) + 1)[place]
        entry = rank < np.minimum(long, n[place])
        entries = np.bincount(place[entry], minlength=len(c))
        ends = np.cumsum(entries)
        prefix, short = h[entry], (rank < brief)[entry]
        by_hash = np.lexsort((h, place))
        every = h[by_hash]
        cols = {"c": [], "n": [], "shared": [], "prefix": [], "short": []}
        for i in np.flatnonzero(entries).tolist():
            a, b = ends[i] - entries[i], ends[i]
            for name, value in zip(cols, (c[i], n[i], every[first[i] : first[i] + shared[i]].tobytes(), prefix[a:b].tobytes(), short[a:b].tobytes()), strict=True):
                cols[name].append(value)
        kinds_ = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(cols.items(), kinds_, strict=True)})

    sent = texts.select("c", "text").mapInArrow(lambda b: filter(None, emit(b)), _PACKED)
    met = _dealt(sent, "dest", 2 * groups).groupBy("dest").applyInArrow(meet, _PACKED)
    return _dealt(met, "dest", groups).groupBy("dest").applyInArrow(tally, "c long, n long, shared binary, prefix binary, short binary")


def _entries(sets: DataFrame) -> DataFrame:
    """h, c, short: the cells of each set."""

    def run(batches):
        for batch in batches:
            h, short = joined(batch.column("prefix"), np.int64), joined(batch.column("short"), bool)
            counts = np.array([len(x) // 8 for x in batch.column("prefix").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(batch.column("c").to_numpy(), counts)), pa.array(short)], ["h", "c", "short"])

    return sets.select("c", "prefix", "short").mapInArrow(run, "h long, c long, short boolean")


def _distances(members: DataFrame, pivots: DataFrame, sets: DataFrame, groups: int, percent: int, far: float | None = None, links_only: bool = False) -> DataFrame:
    """key, x, p, rest, link, d: members(key, c) against the pivots(key, p) of their key, within 2 r of the nearest.

    A key's members are dealt into blocks of about MEMBERS; each block has the key's pivots, which are few. With `far`,
    sets whose nearest pivot is farther than that are at home in one more cell, the rest, which has a row with p = 0 for
    each set that is farther than far - r from all pivots; and a set goes to other cells only up to far + r from it.
    """
    r = (100 - percent) / 100
    window, reach = 2 * r + 1e-9, -1.0 if links_only else far + r + 1e-9 if far is not None else 2.0
    crowd = members.groupBy("key").agg(F.ceil(F.count("*") / F.lit(float(MEMBERS))).cast("long").alias("salts"))
    rows = members.join(crowd, "key").select("key", "c", F.pmod(F.xxhash64("c", "key"), "salts").alias("salt"), F.lit(1).alias("role"))
    heads = pivots.join(crowd, "key").select("key", F.col("p").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    rows = rows.unionByName(heads).join(sets.select("c", "n", "shared"), "c")
    rows = rows.select(F.pmod(F.xxhash64("key", "salt"), F.lit(4 * groups)).alias("g"), "key", "salt", "role", "c", "n", "shared")

    def meet(_key, got):
        key, salt, role, c, n = (got.column(k).to_numpy() for k in ("key", "salt", "role", "c", "n"))
        block = mix(key.view(np.uint64) ^ mix(salt.astype(np.uint64)))
        order = np.lexsort((c, role, block))
        cols = {k: [] for k in ("key", "x", "p", "rest", "link", "d")}
        data = got.column("shared")
        head = np.append(runs(block[order]), len(order))
        for a, b in zip(head[:-1].tolist(), head[1:].tolist(), strict=True):
            part = order[a:b]
            ours, theirs = part[role[part] == 1], part[role[part] == 0]
            h = [np.frombuffer(data[int(i)].as_py(), np.uint64) for i in ours]
            size = np.array([len(x) for x in h], np.int64)
            of, h = np.repeat(np.arange(len(ours)), size), np.concatenate(h) if len(h) else np.zeros(0, np.uint64)
            d, link = np.ones((len(ours), len(theirs))), np.zeros((len(ours), len(theirs)), bool)
            for j, i in enumerate(theirs):
                own = np.frombuffer(data[int(i)].as_py(), np.uint64)
                if not len(own) or not len(h):
                    continue
                hit = own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h
                both = np.bincount(of[hit], minlength=len(ours))
                union = n[ours] + n[i] - both
                d[:, j], link[:, j] = 1 - both / union, 100 * both >= percent * union
            if not len(theirs):
                continue
            least = d.min(1)
            at, to = np.nonzero((d <= np.minimum(least[:, None] + window, reach)) | link)
            beyond = np.flatnonzero(least > far - r - 1e-9) if far is not None else at[:0]
            rest = np.repeat([False, True], [len(at), len(beyond)])
            values = (c[ours[at]], c[ours[beyond]]), (c[theirs[to]], 0 * beyond), (link[at, to], beyond < 0), (d[at, to], least[beyond])
            x, p, linked, away = (np.concatenate(v) for v in values)
            for name, value in zip(cols, (np.full(len(x), key[part[0]]), x, p, rest, linked, away), strict=True):
                cols[name].append(value)
        kinds = (np.int64, np.int64, np.int64, bool, bool, float)
        return pa.table({k: np.concatenate(v) if v else np.zeros(0, t) for (k, v), t in zip(cols.items(), kinds, strict=True)})

    return _dealt(rows, "g", groups).groupBy("g").applyInArrow(meet, "key long, x long, p long, rest boolean, link boolean, d double")


def _exact(members: DataFrame, sets: DataFrame, groups: int, percent: int) -> DataFrame:
    """x, p of links within each key of members(key, c): edges enough to connect what links connect."""
    rows = members.join(sets.select("c", "n", "shared"), "c")
    rows = rows.select(F.pmod(F.xxhash64("key"), F.lit(4 * groups)).alias("g"), "key", "c", "n", "shared")

    def meet(_key, got):
        key, c, n = (got.column(k).to_numpy() for k in ("key", "c", "n"))
        order = np.lexsort((c, key))
        head = np.append(runs(key[order]), len(order))
        links: list[tuple[int, int]] = []
        for a, b in zip(head[:-1].tolist(), head[1:].tolist(), strict=True):
            part = order[a:b]
            h = [np.frombuffer(got.column("shared")[int(i)].as_py(), np.uint64) for i in part]
            links += _linked(c[part], np.concatenate(h), np.array([len(x) for x in h], np.int64), n[part], percent)
        return pa.table({"x": pa.array([x for x, _ in links], pa.int64()), "p": pa.array([y for _, y in links], pa.int64())})

    return _dealt(rows, "g", groups).groupBy("g").applyInArrow(meet, "x long, p long")


def _blocks(members: DataFrame) -> DataFrame:
    """members(key, c, n) dealt into blocks of GRID sets; a key for each pair of blocks of a key."""
    crowd = members.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / F.lit(float(GRID))), F.ceil(F.sum(8 * F.col("n")) / F.lit(float(GRID_BYTES)))).cast("long").alias("blocks"))
    rows = members.join(crowd, "key").withColumn("i", F.pmod(F.xxhash64("c", F.lit(7)), "blocks"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select(F.xxhash64("key", F.greatest("i", "j") * F.col("blocks") + F.least("i", "j")).alias("key"), "c")


def _regions(member: DataFrame, links: list[DataFrame], sets: DataFrame, groups: int, percent: int) -> DataFrame:
    """key, c of groups that fit and are to be joined exactly, from member(key, c, label, n, short): rings and their cells."""
    done = []
    sizes = member.groupBy("key", "label").agg(F.count("*").alias("own"), F.max("short").alias("short"))
    sizes = sizes.groupBy("key").agg(F.sum("own").alias("m"), F.max("own").alias("top"), F.max_by("label", F.struct("own", "label")).alias("main"), F.max("short").alias("any_short"))
    stars = materialise(sizes.where((F.col("m") > OTHERS) & (F.col("m") > F.col("top")) & (F.col("m") - F.col("top") <= OTHERS) & F.col("any_short")).select("key", "main"))
    if stars.limit(1).count():  # one large component and few other sets: these are held against all, and nothing else is
        held = member.join(stars, "key")
        met = _distances(held.select("key", "c"), held.where("label != main").select("key", F.col("c").alias("p")), sets, groups, percent, links_only=True)
        links.append(materialise(met.select("x", "p")))
        member = member.join(stars.select("key"), "key", "left_anti")
    for depth in range(DEEPEST + 1):
        crowd = member.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("short").alias("any_short"))
        crowd = materialise(crowd.where("low != high AND any_short").withColumn("fits", (F.col("m") <= FIT) & (8 * F.col("shingles") <= 2 * GRID_BYTES)).select("key", "m", "fits"))
        done.append(member.join(crowd.where("fits").select("key"), "key").select("key", "c"))
        if not crowd.where("NOT fits").limit(1).count():
            break
        large = materialise(member.join(crowd.where("NOT fits").select("key", "m"), "key"))
        if depth == DEEPEST:
            done.append(_blocks(large))
            break
        pivots = large.where(F.pmod(F.xxhash64("c", "key", F.lit(depth)), F.ceil(F.col("m") / PIVOTS).cast("long")) == 0).select("key", F.col("c").alias("p"))
        met = materialise(_distances(large.select("key", "c"), pivots, sets, groups, percent, FAR))
        trim(sets.sparkSession)
        links.append(met.where("link").select("x", "p"))
        cells = met.groupBy("key", "p", "rest").agg(F.count("*").alias("held")).groupBy("key").agg(F.max("held").alias("most"), F.sum("held").alias("all"))
        split = cells.join(crowd, "key").where((F.col("most") <= 0.7 * F.col("m")) & (F.col("all") <= 4 * F.col("m"))).select("key")
        done.append(_blocks(large.join(split, "key", "left_anti")))
        inner = large.join(split, "key").join(met.select("key", F.col("x").alias("c"), "p", "rest"), ["key", "c"])
        member = materialise(inner.select(F.xxhash64("key", "p", "rest").alias("key"), "c", "label", "n", "short"))
        trim(sets.sparkSession)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.distinct()


def _linked(c: np.ndarray, h: np.ndarray, counts: np.ndarray, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a few sets of given sizes, of whose shingles h has counts each, by products of their shingle matrix, a stripe of shingles at a time."""
    n = len(c)
    of = np.repeat(np.arange(n), counts)
    order = np.argsort(h, kind="stable")
    h, of = h[order], of[order]
    head = runs(h)
    number = np.diff(np.append(head, len(h)))
    keep = np.repeat(number > 1, number)
    column = np.cumsum(np.concatenate([[True], h[keep][1:] != h[keep][:-1]])) - 1 if keep.any() else np.zeros(0, np.int64)
    of = of[keep]
    both = np.zeros((n, n), np.float32)  # whole numbers below 2**24 are exact
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((n, 4096), np.float32)
        m[of[lo:hi], column[lo:hi] - at] = 1
        both += m @ m.T
    union = sizes[:, None] + sizes[None, :] - both.astype(np.float64)
    a, b = np.nonzero(np.triu(100 * both >= percent * union, 1) & (c[:, None] != c[None, :]))
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            root[x] = y
            out.append((int(c[i]), int(c[j])))
    return out


def thinned(links: DataFrame) -> DataFrame:
    """x, p of fewer links(x, p) that connect the same: each x keeps its least p, and its other ps are linked with that.

    An x has as many ps as it has cells or pivots; those of many like sets are the same, so of a group of near copies one
    link a set and those among its pivots stay.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column("ps")
            counts = lists.value_lengths().to_numpy()
            x, p = batch.column("x").to_numpy(), lists.flatten().to_numpy()
            if not len(p):
                continue
            least = np.minimum.reduceat(p, np.cumsum(counts) - counts)
            pairs = np.unique(np.stack([np.concatenate([x, p]), np.concatenate([least, np.repeat(least, counts)])]), axis=1)
            pairs = pairs[:, pairs[0] != pairs[1]]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["x", "p"])

    return links.groupBy("x").agg(F.collect_set("p").alias("ps")).mapInArrow(run, "x long, p long").distinct()


def components(links: DataFrame) -> DataFrame:
    """c, label of all ends of links(x, p): the least c that links reach. Labels spread and jump until none changes."""
    links = materialise(thinned(links))
    edges = materialise(links.select(F.col("x").alias("a"), F.col("p").alias("b")).unionByName(links.select(F.col("p").alias("a"), F.col("x").alias("b"))).distinct())
    labels = materialise(edges.groupBy(F.col("a").alias("c")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("c").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, F.col("a") == F.col("c")).select("c", "label", F.least("label", "near").alias("new"))
        far = labels.select(F.col("c").alias("new"), F.col("label").alias("far"))
        moved = materialise(spread.join(far, "new").select("c", F.least("new", "far").alias("label"), (F.least("new", "far") != F.col("label")).alias("moved")))
        release(labels)
        trim(links.sparkSession)
        labels = moved
        if not moved.where("moved").limit(1).count():
            release(edges, links)
            return moved.select("c", "label")


def _told_apart(described: DataFrame) -> DataFrame:
    """The same rows, where fingerprints that agree in one half and not in the other are made different, and their sets stay in."""
    twins = described.where("n > 0").groupBy("c").agg(F.min("c2").alias("low"), F.max("c2").alias("high")).where("low != high").select(F.col("c").alias("twin"))
    if not twins.limit(1).count():
        return described
    rows = described.join(materialise(twins), F.col("c") == F.col("twin"), "left")
    both = F.when(F.col("twin").isNotNull(), F.col("c").bitwiseXOR(F.col("c2"))).otherwise(F.col("c"))
    return rows.select("id", "text_key", "n", both.alias("c"), "c2", (F.col("alive") | (F.col("twin").isNotNull() & (F.col("n") > 0))).alias("alive"))


def join(docs: DataFrame, *, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, text_key, label for each row of docs(doc_id, text), repeated rows included.

    text_key is a hash of the text, label names the component (null for an empty set).

    component_id is the smallest doc_id in the set's component. A set without words, or of a null text, is empty, links
    with nothing, and has its own doc_id. Rows with equal sets are one node. Null ids are no candidates for the
    smallest; a component of null ids only has null. Texts are read whole. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    tune(spark)
    groups = groups_of(docs)
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    described = _told_apart(materialise(_described(base, groups, percent, size, SHARE)))
    collect_garbage(spark)
    classes = described.where("n > 0").groupBy("c").agg(F.min(F.struct("id", "text_key")).alias("f"), F.first("alive").alias("alive")).select("c", "f.id", "f.text_key", "alive")

    def same_set(batches):  # a repeated id and text hash may stand for other sets too
        for batch in small(batches):
            h, counts = sets_of(*flat(batch.column("text")), size)
            one, c = fingerprints(h, counts), batch.column("c").to_numpy()
            yield batch.filter(pa.array((one == c) | ((one ^ seconds(h, counts)) == c)))

    texts = base.join(classes.where("alive").select("id", "text_key", "c"), ["id", "text_key"]).select("c", "text")
    texts = materialise(texts.mapInArrow(same_set, "c long, text string").dropDuplicates(["c"]))
    collect_garbage(spark)
    sets = materialise(_shared_sets(texts, groups, percent, size))
    release(texts)
    collect_garbage(spark)

    entries = _entries(sets)
    first = entries.groupBy("h").agg(F.min(F.struct(F.xxhash64("c").alias("rank"), "c")).alias("f"), F.count("*").alias("m"), F.max("short").alias("any_short")).where("m > 1 AND any_short")
    cells = entries.join(first.select("h", "f"), "h").select("c", F.col("f.c").alias("p"), "short")
    regions = materialise(cells.groupBy("c", "p").agg(F.max("short").alias("short")))
    pivots = regions.select(F.col("p").alias("key"), "p").distinct()
    met = materialise(_distances(regions.where("c != p").select(F.col("p").alias("key"), "c"), pivots, sets, groups, percent))
    collect_garbage(spark)
    links = [met.where("link").select("x", "p")]
    labels = components(links[0])

    width = (100 - percent) / 100 + 1e-9
    member = regions.join(met.select(F.col("x").alias("c"), "p", "d"), ["c", "p"], "left").join(labels, "c", "left")
    member = member.select("c", "p", "short", F.coalesce("label", "c").alias("label"), F.coalesce("d", F.lit(0.0)).alias("d"))
    open_ = member.groupBy("p").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("p")
    member = member.join(open_, "p")
    ring = F.floor(F.col("d") / width).cast("long")
    rings = F.sequence(ring, F.least(ring + 1, F.lit(int(1 / width)).cast("long")))
    member = member.withColumn("k", F.explode(rings)).join(sets.select("c", "n"), "c")
    member = materialise(member.select(F.xxhash64("p", "k").alias("key"), "c", "label", "n", "short"))
    trim(spark)
    fitting = materialise(_regions(member, links, sets, groups, percent))
    trim(spark)
    links.append(materialise(_exact(fitting, sets, groups, percent)))
    release(sets, fitting, member)
    trim(spark)
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    labels = components(every)

    named = classes.join(labels, "c", "left").select("c", "id", F.coalesce("label", "c").alias("label"))
    least = named.groupBy("label").agg(F.min("id").alias("least"))
    known = named.join(least, "label").select(F.col("c").alias("_c"), "least", "label")
    rows = described.join(known, F.col("c") == F.col("_c"), "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least"))
    real = lambda x: F.when(x != LAST, x)
    return rows.select(real(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(component).alias("component_id"), "text_key", "label")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row of the smallest (doc_id, text), and every empty set.

    Of rows equal in id and text one stays, the first by a hash of all columns, unless they are empty sets. A null id
    comes last. All columns of docs are kept, whatever their names. An empty table gives an empty result.
    """
    names = docs.columns
    found = join(docs, **options).where("n_shingles > 0")
    first = found.groupBy("label").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "text_key")).alias("f")).select(F.col("f.id").alias("_jac_id"), F.col("f.text_key").alias("_jac_text"))
    text = F.col("text").cast("string")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("_jac_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_jac_id"), F.xxhash64(text).alias("_jac_text"),
        F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("_jac_words"),
    )
    held = rows.where("_jac_words").join(first, ["_jac_id", "_jac_text"])
    one = held.groupBy("_jac_id", "_jac_text").agg(F.min_by("_jac_row", F.xxhash64(*(F.col(f"_jac_row.`{c}`") for c in names))).alias("_jac_row")).select("_jac_row")
    return one.unionByName(rows.where("NOT _jac_words").select("_jac_row")).select(*(F.col(f"_jac_row.`{c}`").alias(c) for c in names))


def op3_jaccard(spark, sf_dir):
    """doc_id, n_shingles, component_id of every document; see join for nulls, empty sets, repeats and long texts."""
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * inter >= 80 * (a.n + b.n - inter)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT r.x AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x
"""
