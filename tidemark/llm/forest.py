"""New batches against all accepted history: a prefix-tree hash forest.

A forest is a set of trees. Each tree is a permutation of a 64-bit signature, kept as sorted runs of
entries ``(tree, perm, check, low)``: one run per accepted batch, so a new batch never rereads the
rows behind the history. A batch is located by range search: entries and queries that share the first
``bits`` bits of a permutation lie in one range of the run. The prefix starts long and is widened (made
shorter) until the shorter prefix finds no more than ``1 - target`` verified matches in addition: for
texts over all queries of every batch. Small batches push their ranges down to the sorted files, so only the
row groups that can hold a match are read; larger ones read the runs once, by a join that shuffles
nothing but itself. Runs of like size are merged. A manifest names the runs and is the only thing that
is changed, by creating its next version, which exactly one writer can.

Two kinds of entries:

* listings: one entry per identity key; its two hashes are signature and check. Equal keys have equal
  signatures, so one tree and the longest prefix have recall 1, and nothing needs to be widened.
* texts: minhash symbols of five-word shingles in as many orders as there are trees; near-duplicates
  share long prefixes in some tree, which is where widening acts. Matches are verified exactly.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.identity import ids_of, with_listing_key
from tidemark.llm.neardup import words
from tidemark.operators.components import SALTS, components
from tidemark.storage import bounded_broadcast, register, scratch, shared_dir, stash

TREES = 1
FIRST_BITS = 56
STEP = 8
TARGET = 0.999
#: One query in so many is used to measure recall; the search itself takes all of them.
SAMPLE = 64
#: Batches of up to so many entries push their ranges to the files (more would make the scan's filter dearer than the
#: rows it saves), up to so many are broadcast (some 50 bytes each).
MAX_RANGES = 16
BROADCAST_ROWS = 200_000
#: Row groups of a run, so that ranges skip most of it.
ROW_GROUP = 8 << 20
ENTRY = "tree int, perm long, check long, low long"

# --- entries of listings --------------------------------------------------------------------------


def keys_of(postings: DataFrame, platforms: DataFrame) -> DataFrame:
    """``(member, batch, point, check)``: two independent 64-bit hashes of each identity key of each row.

    Keys are the clean job_id and aliases and the listing that ``url`` opens. Rows without any
    key give no row here (they can match nothing); repeated keys of a row count once; a null batch is
    the history.
    """
    rows = with_listing_key(postings.select("posting_no", "batch_no", "job_id", "aliases", "url"), platforms)
    keys = F.array_distinct(F.array_compact(F.concat(ids_of(F.col("job_id"), F.col("aliases")), F.array("listing"))))
    long = rows.select(F.col("posting_no").alias("member"), F.coalesce("batch_no", F.lit(0)).alias("batch"), F.explode(keys).alias("k"))
    return long.select("member", "batch", F.xxhash64("k").alias("point"), F.xxhash64(F.lit("check"), "k").alias("check"))


def entries_of(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, links) of stashed keys: ``(batch, point, check, low)``, one per key and batch, and ``(u, v)``, u > v.

    Links tie the members of a batch to the entry of their key. Keys are reduced in salted buckets
    first, so one that a third of all rows carry costs a few rows per task.
    """
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)))
    local = stash(salted.groupBy("batch", "point", "check", "salt").agg(F.min("member").alias("low"), F.count(F.lit(1)).alias("n")), "local")
    entries = stash(local.groupBy("batch", "point", "check").agg(F.min("low").alias("low"), F.collect_list("low").alias("lows")), "entries")  # at most SALTS lows
    up = entries.where(F.size("lows") > 1).select(F.explode("lows").alias("u"), F.col("low").alias("v"))
    crowded = local.where("n > 1").select("batch", "point", "check", "salt", "low")
    down = salted.join(crowded, ["batch", "point", "check", "salt"]).select(F.col("member").alias("u"), F.col("low").alias("v"))
    return entries.drop("lows"), up.unionByName(down).where("u > v")


def _permuted(point: Column, tree: int, trees: int) -> Column:
    """The point with its bits rotated: another order of the same set."""
    turn = 64 * tree // trees
    return point if turn == 0 else F.shiftleft(point, turn).bitwiseOR(F.shiftrightunsigned(point, 64 - turn))


def spread(entries: DataFrame, trees: int = TREES) -> DataFrame:
    """Entries ``(tree, perm, check, low)`` of ``(point, check, low)`` in every tree."""
    each = F.array(*[F.struct(F.lit(t).alias("tree"), _permuted(F.col("point"), t, trees).alias("perm")) for t in range(trees)])
    return entries.select(F.explode(each).alias("t"), "check", "low").select("t.tree", "t.perm", "check", "low")


def build_run(entries: DataFrame, name: str, trees: int = TREES) -> DataFrame:
    """One sorted run of compact entries ``(point, check, low)``, stashed."""
    return stash(spread(entries, trees).repartitionByRange("tree", "perm").sortWithinPartitions("tree", "perm"), name)


# --- search ---------------------------------------------------------------------------------------


def ranges(queries: DataFrame, bits: int, size: int | None) -> Column | None:
    """What an entry's ``perm`` must lie between to share a prefix with a query; None if the queries are too many to list.

    The driver gets at most MAX_RANGES prefixes.
    """
    if size is None or size > MAX_RANGES:
        return None
    shift = 64 - bits
    starts = sorted({r[0] >> shift << shift for r in queries.select("perm").limit(MAX_RANGES + 1).collect()})
    out = F.lit(False)
    for low in starts:
        out = out | F.col("perm").between(low, low + (1 << shift) - 1)
    return out


def candidates(queries: DataFrame, run: DataFrame, bits: int, size: int | None = None) -> DataFrame:
    """Queries and entries whose permutations share the first ``bits`` bits; ``size`` is the number of queries, if known."""
    wanted = ranges(queries, bits, size)
    run = run if wanted is None else run.where(wanted)
    prefix = F.shiftrightunsigned("perm", 64 - bits).alias("prefix")
    q = queries.select("tree", prefix, F.col("perm").alias("q_perm"), F.col("check").alias("q_check"), F.col("low").alias("q_low"))
    q = F.broadcast(q) if size is not None and size <= BROADCAST_ROWS else q
    return run.select("tree", prefix, "perm", "check", "low").join(q, ["tree", "prefix"])


def same_key(found: DataFrame) -> DataFrame:
    """Verification of listings: both hashes of the key agree."""
    return found.where((F.col("q_perm") == F.col("perm")) & (F.col("q_check") == F.col("check")))


def widened(queries: DataFrame, run: DataFrame, verify: Callable[[DataFrame], DataFrame], target: float, bits: int = FIRST_BITS) -> tuple[int, float]:
    """(prefix length, recall measured): the longest prefix beyond which a shorter one adds too little."""
    recall = 1.0
    while bits > STEP:
        near = F.shiftrightunsigned("q_perm", 64 - bits) == F.shiftrightunsigned("perm", 64 - bits)
        pairs = verify(candidates(queries, run, bits - STEP)).groupBy("q_low", "low").agg(F.max(near).alias("near"))
        row = pairs.agg(F.count(F.lit(1)).alias("all"), F.count_if("near").alias("kept")).first()
        recall = row["kept"] / row["all"] if row["all"] else 1.0
        if recall >= target:
            break
        bits -= STEP
    return bits, recall


def search(queries: DataFrame, run: DataFrame, target: float = TARGET) -> tuple[DataFrame, int, float]:
    """``(q_low, low)`` of every match of listings, the prefix length used and the recall measured."""
    bits, recall = widened(queries.where((F.col("tree") == 0) & (F.pmod(F.col("check"), F.lit(SAMPLE)) == 0)), run, same_key, target)
    hits = same_key(candidates(queries, run, bits)).where(F.col("q_low") != F.col("low")).select("q_low", "low").distinct()
    return hits, bits, recall


# --- the forest on disk ---------------------------------------------------------------------------


class Conflict(RuntimeError):
    """Another writer changed the forest meanwhile; read it again and repeat."""


class Forest:
    """History kept as sorted runs under a folder of any Hadoop file system.

    ``manifest/<n>`` is version n of the list of runs and redirects; ``runs/<name>`` holds entries,
    ``redirects/<name>`` what a batch learned about roots: two accepted listings that turned out to
    be one. Merging runs applies the redirects to their entries and drops them, so look-ups stay short.
    """

    def __init__(self, spark: SparkSession, root: str, most_runs: int = 8) -> None:
        self.spark, self.root, self.most_runs = spark, root.rstrip("/"), most_runs
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.root).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def _manifest(self) -> tuple[int, dict]:
        """The newest version and what it lists."""
        folder = self._path("manifest")
        versions = [int(n) for s in self._fs.listStatus(folder) if (n := s.getPath().getName()).isdigit()] if self._fs.exists(folder) else []
        if not versions:
            return 0, {"runs": [], "redirects": [], "dead": []}
        stream = self._fs.open(self._path(f"manifest/{max(versions)}"))
        try:
            return max(versions), json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, listed: dict) -> None:
        """Publish version + 1: written aside, then given its name, which fails if another writer has taken it."""
        aside, name = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/{version + 1}")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(listed).encode()))
        finally:
            stream.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(aside, name, self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0))
        except Exception as error:
            self._fs.delete(aside, False)
            raise Conflict(f"{self.root}: version {version + 1} was published meanwhile") from error

    def runs(self) -> list[str]:
        """Paths of the runs, oldest first."""
        return [f"{self.root}/runs/{name}" for name, _ in self._manifest()[1]["runs"]]

    def entries(self) -> DataFrame | None:
        """All entries; None if there are none."""
        paths = self.runs()
        return self.spark.read.schema(ENTRY).parquet(*paths) if paths else None

    def search(self, queries: DataFrame, size: int | None = None) -> DataFrame:
        """``(q_low, low)`` of every match of listings among the entries so far."""
        run = self.entries()
        if run is None:
            return self.spark.createDataFrame([], "q_low long, low long")
        # equal keys share every prefix: the longest has recall 1
        return same_key(candidates(queries, run, FIRST_BITS, size)).where(F.col("q_low") != F.col("low")).select("q_low", "low").distinct()

    def _write(self, entries: DataFrame, size: int) -> str:
        name = uuid.uuid4().hex
        parts = max(1, size // (4 * BROADCAST_ROWS))
        placed = entries.repartitionByRange(parts, "tree", "perm") if parts > 1 else entries.coalesce(1)
        placed.sortWithinPartitions("tree", "perm").write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(f"{self.root}/runs/{name}")
        return name

    def add(self, entries: DataFrame, size: int, redirects: DataFrame | None = None) -> None:
        """Accept a batch of ``size`` entries ``(tree, perm, check, low)``."""
        version, listed = self._manifest()
        listed["runs"].append([self._write(entries, size), size])
        if redirects is not None:
            name = uuid.uuid4().hex
            redirects.select("u", "v").write.parquet(f"{self.root}/redirects/{name}")
            listed["redirects"].append(name)
        self._commit(version, listed)
        if len(listed["runs"]) > self.most_runs:
            self.merge()

    def adopt(self, name: str, size: int) -> None:
        """Accept a batch whose sorted run of ``size`` entries lies under ``runs/<name>`` already."""
        version, listed = self._manifest()
        listed["runs"].append([name, size])
        self._commit(version, listed)

    def merge(self) -> None:
        """Merge runs into one: the smallest row of each entry.

        The largest run is left alone while the others are less than half of it, so an entry is
        rewritten a logarithmic number of times. What is replaced is deleted by the next merge, when
        nobody reads it any more.
        """
        version, listed = self._manifest()
        largest = max(listed["runs"], key=lambda r: r[1])
        others = [r for r in listed["runs"] if r is not largest]
        whole = bool(listed["redirects"]) or 2 * sum(n for _, n in others) >= largest[1]
        chosen = listed["runs"] if whole else others
        both = self.spark.read.schema(ENTRY).parquet(*[f"{self.root}/runs/{name}" for name, _ in chosen])
        with scratch():
            if listed["redirects"]:
                now = self.resolved(both.select("low").distinct())
                both = both.join(now.where("now <> low"), "low", "left").withColumn("low", F.coalesce("now", "low")).drop("now")
            size = sum(n for _, n in chosen)
            name = self._write(both.groupBy("tree", "perm", "check").agg(F.min("low").alias("low")).select("tree", "perm", "check", "low"), size)
        dead, listed["dead"] = listed["dead"], [f"runs/{r[0]}" for r in chosen] + [f"redirects/{r}" for r in listed["redirects"]]
        listed["runs"] = ([] if whole else [largest]) + [[name, size]]
        listed["redirects"] = []
        self._commit(version, listed)
        for path in dead:
            self._fs.delete(self._path(path), True)

    def resolved(self, lows: DataFrame) -> DataFrame:
        """``(low, now)``: where redirects have moved each row; chains are as long as the batches since the last merge at most."""
        names = self._manifest()[1]["redirects"]
        current = lows.select("low", F.col("low").alias("now"))
        if not names:
            return current
        moved = self.spark.read.schema("u long, v long").parquet(*[f"{self.root}/redirects/{n}" for n in names])
        while True:
            step = current.join(moved, F.col("now") == F.col("u"), "left").select("low", F.coalesce("v", "now").alias("now"), F.col("u").isNotNull().alias("changed"))
            step = stash(step, "resolved")
            if not step.where("changed").limit(1).count():
                return step.select("low", "now")
            current = step.select("low", "now")

    def accept(self, postings: DataFrame, platforms: DataFrame) -> DataFrame:
        """Add a batch; ``(posting_no, accepted_no)`` of its rows that an earlier row, or one of the batch, already brought.

        Rows must carry larger numbers than those accepted before for ``accepted_no`` to be the
        smallest of the group. A batch that links two accepted listings records a redirect. An empty
        batch, or one without keys, changes nothing.
        """
        with scratch():
            keys = stash(keys_of(postings, platforms).where("member is not null").withColumn("batch", F.lit(0)), "batch-keys")
            entries, links = entries_of(keys)
            size = entries.count()
            batch = spread(entries)
            hits = stash(self.search(batch, size), "hits")
            now = self.resolved(hits.select("low").distinct())
            across = hits.join(now, "low").select(F.greatest("q_low", "now").alias("u"), F.least("q_low", "now").alias("v"))
            roots = stash(components(links.unionByName(across).where("u > v").distinct(), "accept"), "roots")
            mine = postings.select(F.col("posting_no").alias("member")).distinct()
            found = roots.join(mine, "member", "left_semi").select(F.col("member").alias("posting_no"), F.col("root").alias("accepted_no"))
            duplicates = stash(found, "accepted", outside=True)
            if size:
                fresh = stash(roots.join(mine, "member", "left_anti").select(F.col("member").alias("u"), F.col("root").alias("v")), "redirects")
                settled = batch.join(roots.withColumnRenamed("member", "low"), "low", "left").select("tree", "perm", "check", F.coalesce("root", "low").alias("low"))
                self.add(settled, size, fresh if fresh.limit(1).count() else None)
            return duplicates


# --- listings -------------------------------------------------------------------------------------


def listing_groups(postings: DataFrame, platforms: DataFrame) -> DataFrame:
    """``(member, root)`` of every row that shares a listing with another; root is the smallest member.

    Batches are taken in order: each is searched in the forest of those before it and then becomes a
    run of it. Rows of one batch are linked through the batch's entry of their key. What the searches
    find is closed over ("through further rows") at the end. Empty tables give an empty result.
    """
    spark = postings.sparkSession
    with scratch():
        keys = stash(keys_of(postings, platforms).where("member is not null"), "keys")
        entries, links = entries_of(keys)
        sizes = sorted(map(tuple, entries.groupBy("batch").count().collect()))  # one row per batch
        root = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
        register(spark, root)
        # the runs of all batches are sorted and written at once; a batch counts only when it is adopted
        run = entries.select("batch", F.lit(0).alias("tree"), F.col("point").alias("perm"), "check", "low")
        parts = max(1, sum(n for _, n in sizes) // (4 * BROADCAST_ROWS))
        run = run.repartitionByRange(parts, "batch", "perm").sortWithinPartitions("batch", "perm")
        run.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").partitionBy("batch").parquet(f"{root}/runs/all")
        forest = Forest(spark, root)
        found = False
        for number, size in sizes:
            name = f"all/batch={number}"
            if forest.runs():
                hits = forest.search(spark.read.schema(ENTRY).parquet(f"{root}/runs/{name}"), size)
                hits.select(F.greatest("q_low", "low").alias("u"), F.least("q_low", "low").alias("v")).write.mode("append").parquet(f"{root}/hits")
                found = True
            forest.adopt(name, size)
        if found:
            links = links.unionByName(spark.read.schema("u long, v long").parquet(f"{root}/hits"))
        return stash(components(links.distinct(), "listings"), "listings", outside=True)


def found_listings(postings: DataFrame, platforms: DataFrame) -> DataFrame:
    """``(accepted_no, posting_no)``: one row for each group member but the smallest."""
    groups = listing_groups(postings, platforms)
    return groups.select(F.col("root").alias("accepted_no"), F.col("member").alias("posting_no"))


# --- texts ----------------------------------------------------------------------------------------

#: Words of a shingle, share of common shingles, trees, and symbols (8 bits each) that a signature has.
SHINGLE = 5
SHARE = 0.8
TEXT_TREES = 16
SYMBOLS = 32
TEXT_TARGET = 0.99
_SIGNED = "low long, check long, perms array<long>"


def _shingles(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, begins): the shingles of each list of word hashes; a short text is one shingle. Lists aren't empty."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy().view(np.uint64)
    counts = np.maximum(1, sizes - SHINGLE + 1)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), counts)
    begins = np.cumsum(counts) - counts
    start = first[owner] + np.arange(counts.sum()) - begins[owner]
    end = (first + sizes)[owner]
    total = np.zeros(len(start), np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for k in range(SHINGLE):
        inside = start + k < end
        total[inside] = total[inside] * factor + values[start[inside] + k]
    return (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9), begins


def _orders() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    a = rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
    return a, b, np.array([rng.permutation(SYMBOLS)[:8] for _ in range(TEXT_TREES)])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``low, words`` to a check of the text and its signature in the order of every tree."""
    a, b, orders = _orders()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        hashes, begins = _shingles(batch.column(1))
        symbols = np.empty((SYMBOLS, n), np.uint64)
        for k in range(SYMBOLS):
            low = np.minimum.reduceat((hashes * a[k] + b[k]) >> np.uint64(32), begins)
            symbols[k] = (low * np.uint64(0x9E3779B1) >> np.uint64(13)) & np.uint64(0xFF)
        perms = np.empty((n, TEXT_TREES), np.int64)
        for t, order in enumerate(orders):
            perms[:, t] = sum(symbols[s] << np.uint64(56 - 8 * i) for i, s in enumerate(order)).view(np.int64)
        check = np.add.reduceat(hashes * (hashes | np.uint64(1)), begins).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * TEXT_TREES), pa.array(perms.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(check), lists], names=["low", "check", "perms"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``low, words`` to the distinct shingles of the text."""
    for batch in batches:
        if batch.num_rows:
            hashes, begins = _shingles(batch.column(1))
            parts = [np.unique(p).view(np.int64) for p in np.split(hashes, begins[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.int64()))], names=["low", "shingles"])


def _worded(rows: DataFrame) -> DataFrame:
    text = F.explode(F.array(words(F.concat_ws(" ", "title", "company", "description")))).alias("w")
    return rows.select(F.col("posting_no").alias("low"), text).where((F.size("w") > 0) & F.col("low").isNotNull()).select("low", F.transform("w", lambda w: F.xxhash64(w)).alias("w"))


def text_entries(rows: DataFrame) -> DataFrame:
    """Entries of the texts of ``rows``, one per distinct text and tree: exact copies are one entry from the start."""
    one = _worded(rows).mapInArrow(_sign, _SIGNED).groupBy("check").agg(F.min("low").alias("low"), F.any_value("perms").alias("perms"))
    return one.select("check", "low", F.posexplode("perms").alias("tree", "perm")).select("tree", "perm", "check", "low")


class Similar:
    """Verification of texts: the exact share of common shingles, read for the candidates only."""

    def __init__(self, postings: DataFrame, share: float = SHARE) -> None:
        self.postings, self.share = postings, share

    def __call__(self, found: DataFrame) -> DataFrame:
        pairs = stash(found.where("q_low <> low").select("q_low", "low", "q_perm", "perm"), "text-pairs")
        ids = pairs.select(F.explode(F.array("q_low", "low")).alias("posting_no")).distinct()
        sets = stash(_worded(self.postings.join(bounded_broadcast(ids, BROADCAST_ROWS), "posting_no", "left_semi")).mapInArrow(_sets, "low long, shingles array<long>"), "shingles")
        a, b = sets.select(F.col("low").alias("q_low"), F.col("shingles").alias("x")), sets.select("low", F.col("shingles").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        distinct = pairs.select("q_low", "low").distinct()
        true = distinct.join(a, "q_low").join(b, "low").where(both >= self.share * (F.size("x") + F.size("y") - both) - 1e-9).select("q_low", "low")
        return pairs.join(true, ["q_low", "low"])


def matches(queries: DataFrame, run: DataFrame, verify: Callable[[DataFrame], DataFrame], target: float, bits: int, size: int | None = None) -> tuple[DataFrame, int]:
    """``(q_low, low)`` of every match of other texts, and the prefix length: shortened from ``bits`` until a shorter one adds too little.

    Every query is measured, and what the shorter prefix adds is part of the answer.
    """
    while True:
        wide = max(bits - STEP, STEP)
        near = F.shiftrightunsigned("q_perm", 64 - bits) == F.shiftrightunsigned("perm", 64 - bits)
        pairs = verify(candidates(queries, run, wide, size).where("q_check <> check")).groupBy("q_low", "low").agg(F.max(near).alias("near"))
        pairs = stash(pairs, "matches")
        row = pairs.agg(F.count(F.lit(1)).alias("all"), F.count_if("near").alias("kept")).first()
        if wide == bits or row["kept"] >= target * row["all"]:
            return pairs.select("q_low", "low"), bits
        bits = wide


def near_listings(postings: DataFrame, target: float = TEXT_TARGET) -> DataFrame:
    """``(posting_no, accepted_no, links)`` of the rows of later batches whose text nearly repeats an accepted one.

    Texts are title, company and description; ``accepted_no`` is the smallest accepted row that shares
    SHARE of the five-word shingles, ``links`` the number of accepted texts that do. Texts that repeat
    an accepted one aren't accepted themselves, so a family of variants is kept by its first ones.
    Batches are taken in order; the history (batch 0 or null) is accepted as it is. The prefix is
    measured on all texts of every batch and only ever shortened. Rows without words give no row; exact copies are compared once and share the answer.
    """
    spark = postings.sparkSession
    batch = F.coalesce("batch_no", F.lit(0))
    with scratch():
        numbers = [r[0] for r in postings.select(batch.alias("b")).distinct().orderBy("b").collect()]  # one row per batch
        root = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
        register(spark, root)
        forest, verify, bits = Forest(spark, root), Similar(postings), FIRST_BITS
        out = stash(spark.createDataFrame([], "posting_no long, accepted_no long, links long"), "near")
        for number in numbers:
            rows = postings.where(batch == number)
            signed = stash(_worded(rows).mapInArrow(_sign, _SIGNED), "signed")
            one = signed.groupBy("check").agg(F.min("low").alias("low"), F.any_value("perms").alias("perms"))
            entries = stash(one.select("check", "low", F.posexplode("perms").alias("tree", "perm")).select("tree", "perm", "check", "low"), "entries")
            size = entries.count()
            run = forest.entries()
            if run is not None and size:
                copies = run.where("tree = 0").select("check", F.col("low").alias("held"))
                found, bits = matches(entries, run, verify, target, bits, size)
                hits = stash(found.groupBy("q_low").agg(F.min("low").alias("accepted_no"), F.count(F.lit(1)).alias("links")), "hits")
                texts = signed.select(F.col("low").alias("posting_no"), "check").join(entries.where("tree = 0").select("check", F.col("low").alias("q_low")), "check")
                mine = texts.join(hits, "q_low", "left").join(copies, "check", "left")
                near = mine.select("posting_no", F.least("accepted_no", "held").alias("accepted_no"), (F.coalesce("links", F.lit(0)) + F.when(F.col("held").isNotNull(), 1).otherwise(0)).alias("links"))
                out = out.unionByName(stash(near.where("accepted_no is not null"), "near"))
                entries = stash(entries.join(hits.select(F.col("q_low").alias("low")), "low", "left_anti").join(copies.select("check"), "check", "left_anti").select("tree", "perm", "check", "low"), "entries")
                size = entries.count()
            if size:
                forest.add(entries, size)
        return stash(out, "near-listings", outside=True)
