"""Near-duplicate postings by anchor-point covering.

Each distinct word set gets K minhash values. In each of TABLES tables one value routes a set
to a region, and one bit each of 23 others makes a fingerprint. The anchors are the 4,096 words
of the binary Golay code, a perfect covering code of radius 3. Every fingerprint is replicated
to every anchor within RADIUS + SLACK. Two fingerprints that differ in at most 2 * SLACK bits
always meet: some point lies within SLACK of both, and the anchor within 3 of that point is in
reach of both. Only fingerprints that meet are compared: by a sketch of 64 minhash
values, then exactly.

Replication happens inside a region's task, not in the shuffle. Regions above HOT entries are
divided by the first bits of the anchors, and an entry goes to the divisions that hold anchors of
it: at most the 5.3 anchors that it has on average, however large the region is. A division that a
hot family of texts still fills is cut into parts that are compared pair by pair, so no task grows
with a hot word or a hot family. Tables are taken some at a time, and the shuffle of one pass is
gone before the next. Of the entries at an anchor only those meet whose sizes allow the similarity.
Exact copies are one set from the start. Texts are read twice and never shuffled: for the
signatures of all, and for the words of the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.components import components
from tidemark.storage import bounded_broadcast, remove, scratch, shuffles_dropped, stash

K = 128
TABLES = 16
BITS = 23
RADIUS = 3
SLACK = 1
HOT = 20_000
#: Sketch: four bits each of SKETCH minhash values. At a similarity of 0.70 46 of 64 agree on average
#: with a deviation of 3.6, and 23 of the first 32 with one of 2.5; the bounds lie four deviations below.
SKETCH = 64
LEAST_AGREE = 31
LEAST_FIRST = 13
#: Entries, before they are spread, whose tables are one pass: its shuffle is what the disk must hold.
PASS = 4_000_000
#: Entries whose anchors are worked on at a time.
CHUNK = 40_000
PAIRS_AT_ONCE = 1 << 17  # arrays that stay in the cache
#: A class of exact copies above this many rows is cut into parts of it when its pairs are written out.
COPIES = 2000
#: Candidate ids up to this many are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
GENERATOR = 0b110001110101  # fixed value: generator polynomial of the [23, 12] Golay code

SIGNATURE = "id long, size int, symbols array<int>, blocks array<int>, s1 long, s2 long, s3 long, s4 long"
_SIGNATURE = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("symbols", pa.list_(pa.int32())), ("blocks", pa.list_(pa.int32())), *[(f"s{i}", pa.int64()) for i in (1, 2, 3, 4)]])
_ENTRY = ("id", "size", "block", "s1", "s2", "s3", "s4")
_SIZE_BITS = 20
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def words(text: Column) -> Column:
    """Maximal runs of Unicode letters and digits after lower-casing, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


@lru_cache(1)
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome tables (low 12 bits, high 11), and errors up to RADIUS + SLACK by syndrome."""
    syn = np.zeros(BITS, np.int32)
    for i in range(BITS):
        r = 1 << i
        for b in range(BITS - 1, 10, -1):
            if r >> b & 1:
                r ^= GENERATOR << (b - 11)
        syn[i] = r
    def table(bits: range) -> np.ndarray:
        out = np.zeros(1 << len(bits), np.int32)
        for j, i in enumerate(bits):
            out[1 << j : 2 << j] = out[: 1 << j] ^ syn[i]
        return out
    errors, syndromes = [], []
    for w in range(RADIUS + SLACK + 1):
        for c in combinations(range(BITS), w):
            e = s = 0
            for i in c:
                e |= 1 << i
                s ^= int(syn[i])
            errors.append(e), syndromes.append(s)
    e, s = np.array(errors, np.int32), np.array(syndromes)
    order = np.argsort(s, kind="stable")
    starts = np.searchsorted(s[order], np.arange(2049))
    return table(range(12)), table(range(12, BITS)), e[order], starts


def anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor) of every anchor within RADIUS + SLACK of each fingerprint."""
    low, high, errors, starts = _code()
    syndrome = low[x & 0xFFF] ^ high[x >> 12]
    counts = starts[syndrome + 1] - starts[syndrome]
    index = np.repeat(np.arange(len(x)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return index, x[index] ^ errors[starts[syndrome][index] + offset]


def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    a = rng.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, K, dtype=np.uint64)
    picks = np.array([rng.permutation([j for j in range(K) if j != t])[:BITS] for t in range(TABLES)])
    return a, b, picks


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, hashes`` to a signature: a routing symbol and a fingerprint per table, and the sketch."""
    a, b, picks = _functions()
    for batch in batches:
        column = batch.column(1)
        sizes = np.diff(column.offsets.to_numpy())
        if not len(sizes):
            continue
        values = column.flatten().to_numpy().view(np.uint64)
        begins = np.cumsum(sizes) - sizes
        n = len(sizes)
        low = np.empty((K, n), np.uint32)
        for k in range(K):
            low[k] = np.minimum.reduceat(((values * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), begins)
        mixed = low * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        nibble = ((mixed >> np.uint32(27)) & np.uint32(15)).astype(np.uint64)
        sketch = [sum(nibble[16 * i + j] << np.uint64(4 * j) for j in range(16)).view(np.int64) for i in range(SKETCH // 16)]
        blocks = np.empty((n, TABLES), np.int32)
        for t in range(TABLES):
            blocks[:, t] = sum(((mixed[p] >> np.uint32(t)) & np.uint32(1)) << np.uint32(j) for j, p in enumerate(picks[t]))
        ends = pa.array(np.arange(n + 1, dtype=np.int32) * TABLES)
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(v).reshape(-1).view(np.int32))) for v in (low[:TABLES].T, blocks)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), *lists, *map(pa.array, sketch)], schema=_SIGNATURE)


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the sixteen groups of four bits differ."""
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    return np.bitwise_count(d & np.uint64(0x1111111111111111)).astype(np.int16)


def _divisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``region, bits, id, ...`` to a row for each division, by the first ``bits`` bits, that holds anchors of the entry."""
    for batch in batches:
        if not batch.num_rows:
            continue
        index, anchor = anchors(batch.column("block").to_numpy())
        bits = batch.column("bits").to_numpy()[index]
        index, division = np.divmod(np.unique(index.astype(np.int64) << BITS | anchor >> (BITS - bits)), 1 << BITS)
        taken = batch.take(pa.array(index))
        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(division.astype(np.int32))], names=[*batch.schema.names, "division"])


def _division_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``region, bits, block`` to how many entries each division gets, summed over a batch."""
    for divided in _divisions(batches):
        counted = pa.Table.from_batches([divided]).group_by(["region", "division"]).aggregate([([], "count_all")])
        yield from counted.rename_columns(["region", "division", "n"]).to_batches()


def meet(key: np.ndarray, bits: np.ndarray, division: np.ndarray, side: np.ndarray, size: np.ndarray, block: np.ndarray, ids: np.ndarray, sketch: list[np.ndarray], share: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group ``key`` that meet at an anchor of its division, are of like size and whose sketches are near.

    ``side`` 2 compares with all of the group; 0 and 1 only with the other side. A pair may
    come out more than once.
    """
    index, anchor = anchors(block)
    ours = anchor >> (BITS - bits[index]) == division[index]
    index, anchor = index[ours], anchor[ours]
    starts = np.concatenate([[True], key[1:] != key[:-1]])  # entries come sorted by group
    sizes = np.minimum(size, (1 << _SIZE_BITS) - 1).astype(np.int64)
    at = ((np.cumsum(starts)[index] << BITS | anchor) << _SIZE_BITS) | sizes[index]
    order = np.argsort(at)
    at, index = at[order], index[order]
    # each entry meets those before it at its anchor that are large enough: a smaller set has too few words for the share
    least = np.ceil(share * sizes - 1e-6).astype(np.int64)[index]
    first = np.searchsorted(at, at - sizes[index] + least)
    counts = np.arange(len(at)) - first
    near_first = [s[index] for s in sketch[:2]]
    lows, highs = [], []
    total = np.cumsum(counts)
    begin = 0
    while begin < len(counts):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + PAIRS_AT_ONCE, "right")))
        n = counts[begin:end]
        y = np.repeat(np.arange(begin, end), n)
        x = np.repeat(first[begin:end] - np.cumsum(n) + n, n) + np.arange(n.sum())
        near = sum(_differ(s[x], s[y]) for s in near_first) <= SKETCH // 2 - LEAST_FIRST
        x, y = index[x[near]], index[y[near]]
        near = sum(_differ(s[x], s[y]) for s in sketch) <= SKETCH - LEAST_AGREE
        near &= (side[x] == 2) | (side[x] != side[y])
        x, y = ids[x[near]], ids[y[near]]
        lows.append(np.minimum(x, y)), highs.append(np.maximum(x, y))
        begin = end
    return (np.concatenate(lows), np.concatenate(highs)) if lows else (ids[:0], ids[:0])


def _compare(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Entries sorted by group, some groups at a time; a group never spans two of them."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            c = {n: table.column(n).to_numpy() for n in table.column_names}
            a, b = meet(*[c[n] for n in ("key", "bits", "division", "side", "size", "block", "id")], [c[f"s{i}"].view(np.uint64) for i in (1, 2, 3, 4)], share)
            if len(a):
                yield from pa.table({"a": a, "b": b}, schema=_PAIR).to_batches(max_chunksize=100_000)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            table = pa.Table.from_batches(held)
            keys = table.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                yield from work(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                rows -= cut
    if held:
        yield from work(pa.Table.from_batches(held))


def eligible(postings: DataFrame, least_words: int) -> DataFrame:
    """``(posting_no, hashes)`` of the rows with enough words of description.

    ``hashes`` are the distinct words of title, company and description as sorted 64-bit hashes.
    explode(array(x)) keeps the filter from splitting the description a second time.
    """
    rows = postings.where(F.col("posting_no").isNotNull() & F.col("description").isNotNull())
    rows = rows.select("posting_no", F.concat_ws(" ", "title", "company").alias("head"), F.explode(F.array(words(F.col("description")))).alias("body"))
    every = F.array_distinct(F.concat(words(F.col("head")), F.col("body")))
    return rows.where(F.size("body") >= least_words).select("posting_no", F.sort_array(F.transform(every, lambda w: F.xxhash64(w))).alias("hashes"))


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership ``(posting_no, rep)`` and one signature per class of exact copies.

    Equal word sets have equal signatures; the class is named by two independent hashes of the
    set. Copies are combined before the shuffle, so a text that a third of all rows share is
    one row per task.
    """
    hashed = rows.select("posting_no", F.xxhash64("hashes").alias("h1"), F.xxhash64(F.lit(7), "hashes").alias("h2"), "hashes")
    signatures: list[str] = []
    rest = ("size", "symbols", "blocks", "s1", "s2", "s3", "s4")
    with shuffles_dropped(rows.sparkSession):
        members = stash(hashed.select(F.col("posting_no").alias("id"), "h1", "h2", "hashes").mapInArrow(_sign_kept, f"{SIGNATURE}, h1 long, h2 long"), "signatures", signatures)
        reps = members.groupBy("h1", "h2").agg(F.min("id").alias("rep"), *[F.any_value(c).alias(c) for c in rest])
        reps = stash(reps, "classes")
        membership = members.select("id", "h1", "h2").join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("id").alias("posting_no"), "rep")
        membership = stash(membership, "members", outside=True)
    remove(rows.sparkSession, signatures[0])
    return membership, reps.select(F.col("rep").alias("id"), *rest)


def _sign_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_sign``, with the class hashes passed through."""
    for batch in batches:
        narrow = pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], names=["id", "hashes"])
        for signed in _sign(iter([narrow])):
            yield pa.RecordBatch.from_arrays([*signed.columns, batch.column(1), batch.column(2)], names=[*_SIGNATURE.names, "h1", "h2"])


def _entries(signatures: DataFrame, first: int, number: int) -> DataFrame:
    """One entry ``(region, block, id, ...)`` per set and table, of ``number`` tables from ``first``."""
    tables = F.arrays_zip(F.col("symbols"), F.col("blocks"), F.sequence(F.lit(0), F.lit(TABLES - 1)).alias("t"))
    return signatures.select("id", "size", "s1", "s2", "s3", "s4", F.explode(F.slice(tables, first + 1, number)).alias("e")).select(
        F.xxhash64("e.t", "e.symbols").alias("region"), F.col("e.blocks").alias("block"), "id", "size", "s1", "s2", "s3", "s4"
    )


def _placed(entries: DataFrame, hot: DataFrame, crowded: DataFrame) -> DataFrame:
    """Entries with the group ``key`` that they are compared in: their region, or divisions of a hot one, or parts of crowded divisions."""
    one = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    spread = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda q: F.struct(
            F.least(part, q).alias("i"), F.greatest(part, q).alias("j"), F.when(part == q, 2).when(part < q, 0).otherwise(1).alias("side")
        ),
    )
    few = bounded_broadcast(hot, BROADCAST_ROWS)
    cold = entries.join(few, "region", "left_anti").select(F.col("region").alias("key"), F.lit(0).alias("bits"), F.lit(0).alias("division"), F.lit(2).cast("tinyint").alias("side"), *_ENTRY)
    inside = entries.join(few, "region").select("region", "bits", *_ENTRY)
    divided = inside.mapInArrow(_divisions, f"{', '.join(f'{n} {t}' for n, t in inside.dtypes)}, division int")
    placed = divided.join(bounded_broadcast(crowded, BROADCAST_ROWS), ["region", "division"], "left")
    placed = placed.select("*", F.explode(F.when(F.col("parts").isNull(), F.array(one)).otherwise(spread)).alias("p"))
    key = F.xxhash64("region", "division", "p.i", "p.j").alias("key")
    return cold.unionByName(placed.select(key, "bits", "division", F.col("p.side").cast("tinyint").alias("side"), *_ENTRY))


def candidates(signatures: DataFrame, share: float) -> DataFrame:
    """``(a, b)``, a < b: sets that meet at an anchor of some table, could be similar by size and whose sketches are near."""
    n = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = _entries(signatures, 0, TABLES)
    with shuffles_dropped(signatures.sparkSession):
        # a division gets some two to five times its share of the entries
        bits = F.least(F.lit(12), F.ceil(F.log2(F.col("count") * 1.5 / HOT))).cast("int").alias("bits")
        hot = stash(every.groupBy("region").count().where(F.col("count") > HOT).select("region", bits), "hot")
        inside = every.join(bounded_broadcast(hot, BROADCAST_ROWS), "region").select("region", "bits", "block")
        sizes = inside.mapInArrow(_division_sizes, "region long, division int, n long").groupBy("region", "division").agg(F.sum("n").alias("n"))
        crowded = stash(sizes.where(F.col("n") > 2 * HOT).select("region", "division", F.ceil(F.col("n") / HOT).cast("int").alias("parts")), "crowded")
        number = max(1, min(TABLES, PASS // max(1, signatures.count())))
        passes = []
        for first in range(0, TABLES, number):
            placed = _placed(_entries(signatures, first, number), hot, crowded)
            grouped = placed.repartition(n, "key").sortWithinPartitions("key")
            passes.append(stash(grouped.mapInArrow(partial(_compare, share=share), "a long, b long").distinct(), "pass"))
    return reduce(DataFrame.unionByName, passes).distinct()


def similar_classes(postings: DataFrame, signatures: DataFrame, share: float, least_words: int) -> DataFrame:
    """``(a, b)``, a < b: classes whose words in both are at least ``share`` of the words in either."""
    with shuffles_dropped(postings.sparkSession):
        pairs = stash(candidates(signatures, share), "pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("posting_no")).distinct()
        hashed = stash(eligible(postings.join(bounded_broadcast(wanted, BROADCAST_ROWS), "posting_no", "left_semi"), least_words), "words")
        left, right = (hashed.select(F.col("posting_no").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
        both = F.size(F.array_intersect("ha", "hb"))
        either = F.size("ha") + F.size("hb") - both
        return stash(pairs.join(left, "a").join(right, "b").where(both >= F.lit(share) * either - 1e-9).select("a", "b"), "similar", outside=True)


def found_reposts(postings: DataFrame, share: float = 0.70, least_words: int = 40) -> DataFrame:
    """``(posting_no_a, posting_no_b)``, a < b: every pair of rows that agree but for small edits.

    Rows with a null description or one of fewer than ``least_words`` words are left out; null
    titles and companies count as empty; an empty table gives an empty result.
    """
    with scratch():
        members, signatures = classes(eligible(postings, least_words))
        pairs = similar_classes(postings, signatures, share, least_words)
    a = members.select(F.col("rep").alias("a"), F.col("posting_no").alias("x"))
    b = members.select(F.col("rep").alias("b"), F.col("posting_no").alias("y"))
    across = pairs.join(a, "a").join(b, "b").select("x", "y")
    # a class of copies is cut into parts: each part of it meets all of it in a task of its own
    sizes = members.groupBy("rep").count().where("count > 1").select("rep", F.ceil(F.col("count") / COPIES).cast("int").alias("parts"))
    copied = stash(members.join(sizes, "rep"), "copied")
    ours = copied.select("rep", F.col("posting_no").alias("x"), F.pmod(F.xxhash64("posting_no"), F.col("parts")).cast("int").alias("part"))
    theirs = copied.select("rep", F.col("posting_no").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    within = ours.join(theirs, ["rep", "part"]).where("x < y").select("x", "y")
    found = across.unionByName(within)
    return found.select(F.least("x", "y").alias("posting_no_a"), F.greatest("x", "y").alias("posting_no_b"))


def repost_groups(postings: DataFrame, share: float = 0.70, least_words: int = 40) -> DataFrame:
    """``(posting_no, class_id, group_id, links)``: exact-copy class, near-duplicate group and linked classes of each row."""
    with scratch():
        members, signatures = classes(eligible(postings, least_words))
        pairs = similar_classes(postings, signatures, share, least_words)
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    roots = components(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")), "reposts").withColumnsRenamed({"member": "rep", "root": "group_id"})
    return members.join(links, "rep", "left").join(roots, "rep", "left").select(
        "posting_no", F.col("rep").alias("class_id"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links")
    )
