"""Duplicates across sources by exact keys: payload merge, ordered fold, and key look-ups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import clean_text, normalized
from tidemark.operators.components import components, hook


def merge_payload(rows: DataFrame, key: str, order: str, text: str, rank: Column, first: list[str] = (), union: list[str] = ()) -> DataFrame:
    """One row per ``key``: best text by (rank, length, earliest), first non-empty fields, united lists.

    Groups are reduced by partial aggregation; ``union`` columns are arrays and keep the first
    occurrence by ``order``.
    """
    best = F.max_by(text, F.struct(F.coalesce(rank, F.lit(0)).alias("r"), F.coalesce(F.length(text), F.lit(0)).alias("l"), (-F.col(order)).alias("o")))
    filled = [F.min_by(F.col(c), F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(order))).alias(c) for c in first]
    whole = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_row"), best.alias(text), *filled)
    if not union:
        return whole
    # only the first place of each distinct value is gathered, so a group takes as much room as its merged row
    none = F.array().cast("array<string>")
    placed = lambda c: F.transform(F.coalesce(F.col(c), none), lambda v, i: F.struct(F.lit(c).alias("column"), v.alias("value"), i.alias("i")))
    values = F.concat(*map(placed, union))
    long = rows.select(F.col(key).alias("__k"), F.col(order).alias("__o"), F.explode(values).alias("v")).groupBy("__k", "v.column", "v.value").agg(F.min(F.struct("__o", "v.i")).alias("at"))
    united = long.groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("at", "column", "value"))).alias("all"))
    gathered = lambda c: F.coalesce(F.transform(F.filter("all", lambda x: x["column"] == c), lambda x: x["value"]), none).alias(c)
    return whole.join(united, F.col(key).eqNullSafe(F.col("__k")), "left").select(*whole.columns, *map(gathered, union))


def blocks(rows: DataFrame, ordinal: str, keys: Column) -> DataFrame:
    """``(ordinal, block)``: rows that share a key, directly or through others, share a block."""
    long = rows.select(F.col(ordinal).alias("member"), F.explode(keys).alias("k")).where(F.col("k").isNotNull())
    roots = components(hook(long.select("member", F.xxhash64("k").alias("key"))), "blocks")
    return rows.select(ordinal).join(roots.withColumnRenamed("member", ordinal), ordinal, "left").select(ordinal, F.coalesce("root", ordinal).alias("block"))




def greedy_fold(rows: DataFrame, ordinal: str, keys: Column, veto: tuple[str, str]) -> DataFrame:
    """``(ordinal, survivor)``: each row joins the first survivor that one of its keys points to.

    Rows are taken in order; keys are probed in order; a survivor of the same ``veto[0]``
    (platform) with another ``veto[1]`` (native id) is passed over; a row that joins points all
    its keys to its survivor, else it survives itself. The fold never looks across blocks, so
    blocks run apart; inside one it is sequential by definition. Rows stream through the task
    sorted by block and order, so it holds the keys of one block and never its rows; only keys
    travel to Python. Null keys are passed over, rows without keys survive.
    """
    narrow = rows.select(F.col(ordinal).cast("long").alias("o"), keys.alias("keys"), F.col(veto[0]).alias("space"), F.col(veto[1]).alias("native"))
    placed = narrow.join(blocks(narrow, "o", F.col("keys")), "o").select("block", "o", "keys", "space", "native")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, owner, about = None, {}, {}
        for batch in batches:
            out = []
            for b, o, ks, space, native in zip(*[c.to_pylist() for c in batch.columns]):
                if b != block:
                    block, owner, about = b, {}, {}
                ks = [k for k in ks or [] if k is not None]
                hit = None
                for k in ks:
                    held = owner.get(k)
                    if held is not None:
                        other = about[held]
                        if not (native and other[1] and native != other[1] and space == other[0]):
                            hit = held
                            break
                if hit is None:
                    hit = o
                    about[o] = (space, native)
                owner.update(dict.fromkeys(ks, hit))
                out.append(hit)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.int64())], names=[ordinal, "survivor"])

    return placed.repartition("block").sortWithinPartitions("block", "o").mapInArrow(fold, f"{ordinal} long, survivor long")


def unseen(rows: DataFrame, ids: Column, key: str, ordinal: str, seen: DataFrame, seen_key: str) -> DataFrame:
    """Rows none of whose ids was seen before, the first of each ``key``."""
    probe = rows.select(F.col(ordinal).alias("__o"), F.explode(ids).alias(seen_key))
    known = probe.join(seen.select(seen_key).distinct(), seen_key, "left_semi").select("__o").distinct()
    fresh = rows.join(known, F.col(ordinal) == F.col("__o"), "left_anti")
    first = fresh.groupBy(key).agg(F.min(ordinal).alias("__first"))
    return fresh.join(first.select("__first"), F.col(ordinal) == F.col("__first"), "left_semi")


def upsert(current: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``current`` with the incoming values where keys match, and the new rows."""
    c, i = current.select(key, *columns).alias("c"), incoming.select(key, *columns).alias("i")
    joined = c.join(i, F.col(f"c.{key}") == F.col(f"i.{key}"), "full_outer")
    here = F.col(f"i.{key}").isNotNull()
    return joined.select(F.coalesce(f"i.{key}", f"c.{key}").alias(key), *[F.when(here, F.col(f"i.{x}")).otherwise(F.col(f"c.{x}")).alias(x) for x in columns])


def refresh(current: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``current`` with incoming non-null values where keys match; nothing is inserted."""
    c, i = current.alias("c"), incoming.select(key, *columns).alias("i")
    kept = [F.col(f"c.{x}") for x in current.columns if x not in columns]
    return c.join(i, F.col(f"c.{key}") == F.col(f"i.{key}"), "left").select(*kept, *[F.coalesce(f"i.{x}", f"c.{x}").alias(x) for x in columns])


def claims(current: DataFrame, incoming: DataFrame, key: str, aliases: str, ordinal: str, insert: bool) -> DataFrame:
    """``(held, key, ordinal)``: entries of ``current`` that incoming rows take, and new ones with ``held`` null.

    Rows are taken in order. Each looks for the first of its key and aliases that an entry has; the
    entry goes on under the row's key, so a later row may find it there and no longer under the old
    one. ``ordinal`` is the last row that took the entry. Without ``insert`` a row that finds none is
    passed over. As in ``greedy_fold``, blocks of shared ids run apart and only ids travel to Python.
    """
    none = F.array().cast("array<string>")
    ids = F.array_compact(F.array_distinct(F.concat(F.array(key), F.coalesce(F.col(aliases), none))))
    entries = current.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("m"), F.lit(-1).cast("long").alias("o"), F.array(key).alias("ids"))
    rows = incoming.where(F.col(key).isNotNull()).select(F.col(ordinal).cast("long").alias("m"), F.col(ordinal).cast("long").alias("o"), ids.alias("ids"))
    both = entries.unionByName(rows)
    # two members with one number only share a block
    placed = both.join(blocks(both, "m", F.col("ids")).groupBy("m").agg(F.min("block").alias("block")), "m").select("block", "o", "ids")

    def ended(entries: dict) -> pa.RecordBatch:
        taken = [(was, k, o) for k, (was, o) in entries.items() if o is not None]
        columns = list(zip(*taken)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["held", key, ordinal])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, entries, out = None, {}, {}
        for batch in batches:
            for b, o, own in zip(*[c.to_pylist() for c in batch.columns]):
                if b != block:
                    out |= {(block, k): v for k, v in entries.items() if v[1] is not None}
                    block, entries = b, {}
                if o < 0:
                    entries[own[0]] = (own[0], None)
                    continue
                found = next((k for k in own if k in entries), None)
                if found is not None:
                    entries[own[0]] = (entries.pop(found)[0], o)
                elif insert:
                    entries[own[0]] = (None, o)
            if len(out) >= 10_000:
                yield ended({k: v for (_, k), v in out.items()})
                out = {}
        out |= {(block, k): v for k, v in entries.items() if v[1] is not None}
        yield ended({k: v for (_, k), v in out.items()})

    return placed.repartition("block").sortWithinPartitions("block", "o").mapInArrow(fold, f"held string, `{key}` string, `{ordinal}` long")


def rekeyed(current: DataFrame, incoming: DataFrame, key: str, aliases: str, ordinal: str, columns: list[str], fresh: dict[str, Column] | None = None) -> DataFrame:
    """``current`` after incoming rows looked up their entries through aliases; ``held`` is the key before.

    An entry that was found gets the row's key and ``columns``, keeps its other columns, and its old
    key is gone. Rows that find none are inserted with the values of ``fresh``, or left out if it is
    None: upsert and refresh. ``columns`` that current lacks are null in entries that nobody took.
    """
    taken = claims(current, incoming, key, aliases, ordinal, fresh is not None)
    values = incoming.select(F.col(ordinal).alias("__o"), *[F.col(c).alias(f"__new_{c}") for c in columns])
    hits = taken.withColumnsRenamed({key: "__key", ordinal: "__by"}).join(values, F.col("__by") == F.col("__o")).drop("__o", "__by")
    new = [F.col(f"__new_{c}").alias(c) for c in columns]
    kept = [c for c in current.columns if c not in (key, *columns)]
    old = current.join(hits.where("held is not null"), F.col(key) == F.col("held"), "left")
    own = [F.col(c) if c in current.columns else F.lit(None) for c in columns]
    out = old.select(F.coalesce("__key", key).alias(key), F.col(key).alias("held"), *kept, *[F.when(F.col("held").isNotNull(), F.col(f"__new_{c}")).otherwise(o).alias(c) for c, o in zip(columns, own)])
    if fresh is None:
        return out
    added = hits.where("held is null").select(F.col("__key").alias(key), "held", *[v.alias(c) for c, v in fresh.items()], *new)
    return out.unionByName(added, allowMissingColumns=True)


def write_back(rows: DataFrame, enriched: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Every duplicate of an enriched key gets its values; each row keeps its own lineage columns."""
    return refresh(rows, enriched, key, columns)


def retained(receipts: DataFrame, seen: DataFrame, key: str, seen_key: str) -> DataFrame:
    """Receipts whose key is still remembered as seen."""
    return receipts.join(seen.select(F.col(seen_key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_semi")


def apply_details(cards: DataFrame, details: DataFrame, key: str, guard: str | None = None) -> DataFrame:
    """Cards without a full description take it from ``details (key, description)``; every other field stays the card's own.

    ``details`` has one row per key. ``guard`` is a column of both that must agree where the detail has
    one (an identity that changed in between); rows that took a description are warned ``cached_description``.
    """
    d = details.select(F.col(key).alias("__k"), F.col("description").alias("__text"), *([F.col(guard).alias("__guard")] if guard else []))
    joined = cards.join(d, F.col(key) == F.col("__k"), "left")
    same = F.col("__guard").isNull() | F.col("__guard").eqNullSafe(F.col(guard)) if guard else F.lit(True)
    takes = F.coalesce(~F.col("description_status").eqNullSafe(F.lit("full")) & (F.trim("__text") != "") & same, F.lit(False))
    warned = F.array_append(F.coalesce("evidence_warnings", F.array().cast("array<string>")), F.lit("cached_description"))
    changed = {"description": F.col("__text"), "description_status": F.lit("full"), "evidence_warnings": warned}
    out = joined.withColumn("__takes", takes)
    return out.select(*[F.when(F.col("__takes"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else c for c in cards.columns])


#: Fields of a merged posting that its first row with a value fills.
FILLED = ("location", "posted_at", "expires_at", "candidate_locations", "salary_currency", "salary_text", "salary_interval", "application_url", "job_level", "job_type")
#: What a description's status is worth in a merge.
WORTH = {"full": 3, "snippet": 2, "fetch_failed": 1}


def merge_rows(rows: DataFrame, ordinal: str, survivors: DataFrame) -> DataFrame:
    """One whole posting per survivor, with what the rows that joined it add, and their number ``merged``.

    ``survivors`` is what ``greedy_fold`` returns. The survivor keeps its own fields but for: the
    best description by (status, length, earliest) with its status; the first value of ``FILLED``
    fields, pay bounds and work mode; united aliases (with the ids that joined), URLs and warnings, in
    the order in which they come up; warnings where a location or work mode differs from the first.
    Lists are made of distinct values, so a group takes as much room as its merged row.
    """
    c, none = F.col, F.array().cast("array<string>")
    there = rows.columns
    placed = rows.join(survivors.select(c(ordinal).alias("__m"), c("survivor").alias("__s")), c(ordinal) == c("__m")).drop("__m")
    first = lambda value, when: F.min_by(value, F.when(when, c(ordinal)))
    empty = F.lit("")
    body = F.coalesce("description", empty)
    worth = F.lit(0)
    for status, points in WORTH.items():
        worth = F.when(c("description_status") == status, points).otherwise(worth)
    best = F.max_by(F.struct("description", "description_status"), F.struct(worth.alias("w"), F.length(body).alias("l"), (-c(ordinal)).alias("o")))
    aggregates = {"merged": F.count(F.lit(1)), "__best": best}
    for name in FILLED:
        if name in there:
            aggregates[name] = first(c(name), clean_text(c(name)) != "")
    for name in ("salary_min", "salary_max"):
        if name in there:
            aggregates[name] = first(c(name), c(name).isNotNull() & ~F.isnan(name) & (F.abs(name) != float("inf")))
    known = F.coalesce("work_mode", F.lit("unknown")) != "unknown"
    aggregates["__mode"] = first(F.struct("work_mode", "is_remote"), known)
    whole = placed.groupBy("__s").agg(*[v.alias(f"__new_{k}") for k, v in aggregates.items()])

    def values(kind: str, array: Column) -> Column:
        return F.transform(array, lambda x, i: F.struct(F.lit(kind).alias("kind"), x.alias("value"), i.alias("i")))

    place = F.when(clean_text(c("location")) != "", normalized(c("location")))
    joined = F.when(c(ordinal) != c("__s"), F.array("job_id")).otherwise(none)
    lists = F.concat(
        values("aliases", F.concat(F.coalesce("aliases", none), joined)), values("source_urls", F.concat(F.coalesce("source_urls", none), F.array("url"))),
        values("warnings", F.coalesce("evidence_warnings", none)), values("place", F.array("__place")), values("mode", F.array(F.when(known, c("work_mode")))),
    )
    long = placed.withColumn("__place", place).select("__s", c(ordinal).alias("__o"), F.explode(lists).alias("__v")).where("__v.value is not null")
    distinct = long.groupBy("__s", "__v.kind", "__v.value").agg(F.min(F.struct(c("__o").alias("o"), c("__v.i").alias("i"))).alias("at"))
    found = distinct.groupBy("__s").agg(F.array_sort(F.collect_list(F.struct("at.o", "at.i", "kind", "value"))).alias("all")).withColumnRenamed("__s", "__l")
    of = lambda kind: F.filter("all", lambda x: x["kind"] == kind)
    # the second value of a kind, in order, is the first that differs
    differs = lambda kind, code, i: F.transform(F.slice(of(kind), 2, 1), lambda x: F.struct(x["o"].alias("o"), F.lit(i).alias("i"), x["kind"].alias("kind"), F.lit(code).alias("value")))
    warned = F.array_sort(F.concat(of("warnings"), differs("place", "conflicting_locations", -2), differs("mode", "contradictory_work_mode", -1)))
    texts = lambda array: F.transform(array, lambda x: x["value"])
    united = found.select("__l", texts(of("aliases")).alias("__aliases"), texts(of("source_urls")).alias("__source_urls"), F.array_distinct(texts(warned)).alias("__warnings"))

    out = rows.join(whole, c(ordinal) == c("__s")).join(united, c("__s") == c("__l"), "left")
    changed = {n: F.coalesce(f"__new_{n}", n) for n in aggregates if n in there}
    changed |= {n: c(f"__new___best.{n}") for n in ("description", "description_status")}
    changed |= {n: F.when(c("__new___mode").isNull(), c(n)).otherwise(c(f"__new___mode.{n}")) for n in ("work_mode", "is_remote")}
    changed |= {"aliases": F.coalesce("__aliases", none), "source_urls": F.coalesce("__source_urls", none), "evidence_warnings": F.coalesce("__warnings", none)}
    return out.select(*[changed.get(n, c(n)).alias(n) for n in there], c("__new_merged").alias("merged"))
