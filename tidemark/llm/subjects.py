"""Subjects of documents by label propagation over a document-similarity graph.

Two documents are similar where they share phrases (words and word pairs of a sentence). The graph is
kept in factored form, document - phrase - document, so labels travel along it in two steps and no
pair of documents is ever emitted, however many share a phrase. An edge is verified before it
carries a label: the share of a phrase's labelled weight that agrees on one subject, taken at the lower
confidence bound, must exceed ``LEAST``. Labelled documents are seeds and stay clamped; phrases that
the seeds show to be common to many subjects are barred for good. Documents with at least ``SURE``
sentences for a subject pass it on in the next round, and may hold several subjects; rounds go on
until no label moves (``ROUNDS`` at most).

Passing mentions: phrases of the seeds' sentences whose subject is not among the document's own
("a sister company deals in ...") are learned as cues, and sentences with a cue say nothing. A subject
that one sentence alone speaks of is a passing mention too, unless the document is that sentence.

Texts are read twice: the seeds' to learn from, all of them for the table of their phrases without
barred ones. Rounds read that table. A verified model of up to ``BROADCAST_ROWS`` phrases is looked up
where the documents are, with nothing shuffled but sums by phrase; a larger one is joined by shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.canonical import PLAIN
from tidemark.storage import bounded_broadcast, scratch, stash

Z = 1.2
LEAST = 0.4
#: Labelled weight that a phrase needs before it can carry a subject.
SEEN = 1.5
#: Weight from which a barred phrase counts as seen often enough.
BARRED = 2.0
#: Phrases first learned from propagated labels need this strength.
NEW_STRENGTH = 0.6
SURE = 3
ROUNDS = 8
#: A subject is kept if it has this share of the strongest subject's sentences, and this many.
SHARE = 0.3
FEWEST = 2
#: Score that makes a sentence one of its subject: in a document, and among the seeds when cues are learned.
SPEAKS, TOPICAL = 0.02, 0.1
#: Model tables up to this many rows are broadcast (16 bytes a row); larger ones are joined by shuffle.
BROADCAST_ROWS = 400_000

_ODD = re.compile("[" + "".join(map(chr, PLAIN)) + "]")
_INVISIBLE = re.compile("[​‌‍⁠﻿­]")
_BROKEN = re.compile("[\u0080-ÿŒœŠšŸŽžƒˆ˜–-‧€™]{2,}")
_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
#: Words, and what ends a sentence: a line, a stop before a blank, a bullet, a tag.
_TOKEN = re.compile(r"[a-z0-9']+|[\n\r]|[.!?;]\s|\s[•·](?=\s)|<[^<>]{1,60}>")


def repair(text: str) -> str:
    """Undo UTF-8 that was read as a one-byte encoding, where that is what it was."""

    def one(m: re.Match) -> str:
        for encoding in ("cp1252", "latin-1"):
            try:
                return m[0].encode(encoding).decode("utf-8")
            except UnicodeError:
                pass
        return m[0]

    return _BROKEN.sub(one, text) if "Ã" in text or "â" in text or "Â" in text else text


def tokens(text: str) -> list[str]:
    """Folded words and sentence ends of a whole text, without a cap."""
    if not text.isascii():
        clean = _INVISIBLE.sub("", repair(text)).replace(" ", " ").lower().translate(PLAIN)
        text = _MARKS.sub("", unicodedata.normalize("NFKD", clean))
        return _TOKEN.findall(text)
    return _TOKEN.findall(text.lower())


def _is_word(token: str) -> bool:
    return token[0].isalnum() or token[0] == "'"


def sentences(text: str) -> Iterator[list[str]]:
    """Folded words of each sentence that has any."""
    words: list[str] = []
    for t in tokens(text):
        if _is_word(t):
            words.append(t)
        elif words:
            yield words
            words = []
    if words:
        yield words


class _Hashes(dict):
    """64-bit hashes of words, 0 for sentence ends; the most recent vocabulary is remembered."""

    def __missing__(self, token: str) -> int:
        h = xxhash.xxh3_64_intdigest(token) | 1 if _is_word(token) else 0
        if len(self) < 300_000:
            self[token] = h
        return h


#: Documents per output batch, so that a task's arrays stay small.
SLICE = 500
TABLE = "doc_id long, total int, sentences array<array<long>>"


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def phrases_of(texts: list[str | None], hashes: _Hashes, skip: np.ndarray, cues: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(phrases, sentence of each, document of each sentence, sentences of each document).

    Phrases are distinct in their sentence and sorted; those of ``skip`` are left out, and so are sentences
    with one of ``cues``. Sentences are numbered over all texts; some have no phrase left.
    """
    read = hashes.__getitem__
    parts = [np.fromiter(map(read, tokens(t)), np.uint64) if t else np.empty(0, np.uint64) for t in texts]
    sizes = np.array([len(p) for p in parts])
    ids = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    document = np.repeat(np.arange(len(parts)), sizes)
    word = ids != 0
    # a word begins a sentence if the token before it is no word or of another document
    begins = word.copy()
    begins[1:] &= ~word[:-1] | (document[1:] != document[:-1])
    number = np.cumsum(begins) - 1
    ids, number = ids[word], number[word]
    of = document[begins]
    pair = ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    inside = number[:-1] == number[1:]
    phrase = np.concatenate([ids, pair[inside]]).view(np.int64)
    number = np.concatenate([number, number[:-1][inside]])
    keep = ~_among(phrase, skip)
    if len(cues):
        passing = np.zeros(len(of), bool)
        passing[number[_among(phrase, cues)]] = True
        keep &= ~passing[number]
    phrase, number = phrase[keep], number[keep]
    order = np.lexsort((phrase, number))
    phrase, number = phrase[order], number[order]
    fresh = np.ones(len(phrase), bool)
    fresh[1:] = (phrase[1:] != phrase[:-1]) | (number[1:] != number[:-1])
    return phrase[fresh], number[fresh], of, np.bincount(of, minlength=len(parts))


def _reader(skip: np.ndarray, cues: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``doc_id, text`` to one row per document: its number of sentences and their phrases."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                phrase, number, of, total = phrases_of(part.column(1).to_pylist(), hashes, skip, cues)
                filled, lengths = np.unique(number, return_counts=True)
                inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(phrase))
                per_document = np.bincount(of[filled], minlength=part.num_rows) if len(filled) else np.zeros(part.num_rows, int)
                outer = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_document)]).astype(np.int32)), inner)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total.astype(np.int32)), outer], names=["doc_id", "total", "sentences"])

    return read


# --- what phrases say -----------------------------------------------------------------------------


def strengths(weights: DataFrame) -> DataFrame:
    """``(phrase, subject, weight)`` to ``(phrase, total, subject, strength)``; strength 0 carries nothing."""
    t = weights.groupBy("phrase").agg(F.sum("weight").alias("n"), F.max(F.struct("weight", "subject")).alias("top"))
    p, n = F.col("top.weight") / F.col("n"), F.col("n")
    bound = (p + Z * Z / 2 / n - Z * F.sqrt(p * (1 - p) / n + Z * Z / 4 / n / n)) / (1 + Z * Z / n)
    strength = F.when(n >= SEEN, F.greatest(F.lit(0.0), (bound - LEAST) / (1 - LEAST))).otherwise(0.0)
    return t.select("phrase", F.col("n").alias("total"), F.col("top.subject").alias("subject"), strength.alias("strength"))


def _weights(table: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled weight of each phrase by subject: each document counts a phrase once."""
    docs = table.join(labels, "doc_id").select("subject", "weight", F.explode(F.array_distinct(F.flatten("sentences"))).alias("phrase"))
    return docs.groupBy("phrase", "subject").agg(F.sum("weight").alias("weight"))


class Model:
    """Verified phrases in sorted arrays, for look-ups where the documents are."""

    def __init__(self, rows: pa.Table, subjects: list[str]) -> None:
        phrase = rows.column("phrase").to_numpy()
        order = np.argsort(phrase)
        place = {s: i for i, s in enumerate(subjects)}
        self.phrase = phrase[order]
        self.subject = np.array([place[s] for s in rows.column("subject").to_pylist()], np.int64)[order]
        self.points = (rows.column("strength").to_numpy() ** 2)[order]
        self.subjects = subjects

    def best(self, phrase: np.ndarray, number: np.ndarray, sentences: int) -> tuple[np.ndarray, np.ndarray]:
        """The strongest subject of each sentence and its score; ties go to the last subject by name."""
        k = len(self.subjects)
        score = np.zeros((sentences, k))
        if len(phrase) and len(self.phrase):
            at = np.searchsorted(self.phrase, phrase)
            at[at == len(self.phrase)] = 0
            hit = self.phrase[at] == phrase
            score = np.bincount(number[hit] * k + self.subject[at[hit]], self.points[at[hit]], sentences * k).reshape(-1, k)
        best = k - 1 - np.argmax(score[:, ::-1], axis=1) if sentences else np.empty(0, np.int64)
        return best, score[np.arange(sentences), best]


#: Sums that a task holds before it sends them on.
HELD = 1_000_000


class _Sums:
    """Weights by (phrase, column), added up over the batches of a task."""

    def __init__(self, width: int) -> None:
        self.width, self.parts, self.size = width, [], 0

    def add(self, phrase: np.ndarray, weight: np.ndarray) -> None:
        """Rows of weights for phrases in any order."""
        if len(phrase):
            names, place = np.unique(phrase, return_inverse=True)
            sums = np.stack([np.bincount(place, weight[:, c], len(names)) for c in range(self.width)], axis=1)
            self.parts.append((names, sums))
            self.size += len(names)
            if self.size > HELD and len(self.parts) > 1:
                parts, self.parts, self.size = self.parts, [], 0
                self.add(np.concatenate([p for p, _ in parts]), np.concatenate([w for _, w in parts]))

    def full(self) -> bool:
        return self.size > HELD

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """What is held, once per phrase."""
        parts, self.parts, self.size = self.parts, [], 0
        if len(parts) == 1:
            return parts[0]
        if not parts:
            return np.empty(0, np.int64), np.empty((0, self.width))
        self.add(np.concatenate([p for p, _ in parts]), np.concatenate([w for _, w in parts]))
        return self.parts.pop()


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrases, sentence of each, document of each sentence) of the column ``sentences``."""
    nested = batch.column("sentences")
    inner = nested.flatten()
    lengths = np.diff(inner.offsets.to_numpy())
    return inner.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lengths)), lengths), np.repeat(np.arange(batch.num_rows), np.diff(nested.offsets.to_numpy()))


def _distinct(phrase: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each phrase of each owner once."""
    order = np.lexsort((owner, phrase))
    phrase, owner = phrase[order], owner[order]
    first = np.ones(len(phrase), bool)
    first[1:] = (phrase[1:] != phrase[:-1]) | (owner[1:] != owner[:-1])
    return phrase[first], owner[first]


_WEIGHT = "phrase long, subject string, weight double"


def _weight_rows(sums: _Sums, subjects: list[str]) -> pa.RecordBatch:
    names, weight = sums.take()
    p, s = np.nonzero(weight)
    return pa.RecordBatch.from_arrays([pa.array(names[p]), pa.array([subjects[i] for i in s], pa.string()), pa.array(weight[p, s])], names=["phrase", "subject", "weight"])


def _seed_labels(batch: pa.RecordBatch, subjects: list[str]) -> np.ndarray:
    """Documents by subjects: whether the seed has it."""
    place = {s: i for i, s in enumerate(subjects)}
    out = np.zeros((batch.num_rows, len(subjects)), bool)
    for i, labels in enumerate(batch.column("labels").to_pylist()):
        out[i, [place[x] for x in labels]] = True
    return out


def _of_seeds(subjects: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The seeds' weight of each phrase by subject: each document counts a phrase once, and its subjects share it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(len(subjects))
        for batch in batches:
            phrase, number, of = _flat(batch)
            phrase, owner = _distinct(phrase, of[number])
            own = _seed_labels(batch, subjects)
            sums.add(phrase, (own / np.maximum(own.sum(axis=1, keepdims=True), 1))[owner])
            if sums.full():
                yield _weight_rows(sums, subjects)
        yield _weight_rows(sums, subjects)

    return run


def _passing(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(phrase, bad, all)``: the seeds' sentences of a subject with the phrase, and those whose subject isn't the document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(2)

        def rows() -> pa.RecordBatch:
            names, counts = sums.take()
            return pa.RecordBatch.from_arrays([pa.array(names), *[pa.array(counts[:, c].astype(np.int64)) for c in (0, 1)]], names=["phrase", "bad", "all"])

        for batch in batches:
            phrase, number, of = _flat(batch)
            best, score = model.best(phrase, number, len(of))
            topical = score > TOPICAL
            bad = ~_seed_labels(batch, model.subjects)[of, best]
            some = topical[number]
            sums.add(phrase[some], np.stack([bad[number[some]].astype(float), np.ones(some.sum())], axis=1))
            if sums.full():
                yield rows()
        yield rows()

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(phrase, documents)``."""
    sums = _Sums(1)

    def rows() -> pa.RecordBatch:
        names, counts = sums.take()
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts[:, 0].astype(np.int64))], names=["phrase", "documents"])

    for batch in batches:
        phrase, number, of = _flat(batch)
        phrase, _ = _distinct(phrase, of[number])
        sums.add(phrase, np.ones((len(phrase), 1)))
        if sums.full():
            yield rows()
    yield rows()


#: The table of rounds: phrases as places in the list of those that a model can hold.
CODED = "doc_id long, seed boolean, total int, lengths array<int>, codes array<int>, own array<int>"


def _coded(wanted: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The table with phrases of ``wanted`` (sorted) only: for each sentence left their number, all of them, and the document's distinct ones."""

    def lists(values: np.ndarray, owner: np.ndarray, owners: int) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=owners))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrase, number, of = _flat(batch)
            known = _among(phrase, wanted)
            code, number = np.searchsorted(wanted, phrase[known]), number[known]
            filled, lengths = np.unique(number, return_counts=True)
            owner = of[number]
            mine, whose = _distinct(code, owner)
            order = np.argsort(whose, kind="stable")
            columns = [lists(lengths, of[filled], batch.num_rows), lists(code, owner, batch.num_rows), lists(mine[order], whose[order], batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("seed"), batch.column("total"), *columns], names=["doc_id", "seed", "total", "lengths", "codes", "own"])

    return run


class Coded:
    """A model over the places of the list ``wanted``."""

    def __init__(self, model: Model, wanted: np.ndarray) -> None:
        self.subjects, self.wanted = model.subjects, wanted
        self.subject, self.points = np.zeros(len(wanted), np.int64), np.zeros(len(wanted))
        at = np.searchsorted(wanted, model.phrase)
        self.subject[at], self.points[at] = model.subject, model.points

    def counts(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(documents by subjects: sentences that speak of it, whether the document keeps it)."""
        lengths = batch.column("lengths")
        of = np.repeat(np.arange(batch.num_rows), np.diff(lengths.offsets.to_numpy()))
        number = np.repeat(np.arange(len(of)), lengths.flatten().to_numpy())
        code = batch.column("codes").flatten().to_numpy()
        k = len(self.subjects)
        score = np.bincount(number * k + self.subject[code], self.points[code], len(of) * k).reshape(-1, k)
        return _kept(score, of, batch)


def _kept(score: np.ndarray, of: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Counts of sentences by subject, and what a document keeps, from the sentences' scores; ties go to the last subject by name."""
    k = score.shape[1]
    best = k - 1 - np.argmax(score[:, ::-1], axis=1) if len(score) else np.empty(0, np.int64)
    speaks = score[np.arange(len(score)), best] > SPEAKS
    counts = np.bincount(of[speaks] * k + best[speaks], minlength=batch.num_rows * k).reshape(batch.num_rows, -1)
    total = batch.column("total").to_numpy()
    most = counts.max(axis=1, initial=0)[:, None]
    return counts, (counts > 0) & (counts >= SHARE * most) & ((counts >= FEWEST) | (total == 1)[:, None])


_SHARES = "phrase long, weights array<double>"


def _spread(model: Coded) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What the unlabelled documents pass on: weights by subject for each phrase, and a checksum of all labels under phrase null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.subjects)
        sums = np.zeros((k, len(model.wanted)))
        mark = np.uint64(0)
        for batch in batches:
            counts, kept = model.counts(batch)
            free = ~batch.column("seed").to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            d, s = np.nonzero(kept & free[:, None])
            with np.errstate(over="ignore"):
                mixed = (ids[d].astype(np.uint64) * np.uint64(64) + s.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                mark += ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(24)).sum()
            weight = np.where(kept, counts, 0).astype(float)
            weight[~(free & (counts.max(axis=1, initial=0) >= SURE))] = 0
            weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1)
            own = batch.column("own")
            code, owner = own.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(own.offsets.to_numpy()))
            for c in range(k):
                some = weight[owner, c] > 0
                sums[c] += np.bincount(code[some], weight[owner[some], c], len(model.wanted))
        there = np.flatnonzero(sums.any(axis=0))
        values = np.concatenate([sums[:, there].T.reshape(-1), [float(mark % np.uint64(1 << 40))]])
        ends = np.append(np.arange(len(there) + 1) * k, len(there) * k + 1).astype(np.int32)
        phrase = pa.array([*model.wanted[there].tolist(), None], pa.int64())
        yield pa.RecordBatch.from_arrays([phrase, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["phrase", "weights"])

    return run


def _labels(model: Coded) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(doc_id, subject)`` of the unlabelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, kept = model.counts(batch)
            d, s = np.nonzero(kept & ~batch.column("seed").to_numpy(zero_copy_only=False)[:, None])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), pa.array([model.subjects[i] for i in s], pa.string())], names=["doc_id", "subject"])

    return run


# --- the same by joins, for models of any size ------------------------------------------------------


def _sentence_subjects(table: DataFrame, model: DataFrame, keep: float, cues: DataFrame | None = None) -> DataFrame:
    """``(doc_id, n, subject)``: the strongest subject of each sentence that has one and no cue; cues join as entries without a subject."""
    entries = model.select("phrase", "subject", "strength")
    if cues is not None:
        entries = entries.unionByName(cues.select("phrase", F.lit(None).cast("string").alias("subject"), F.lit(0.0).alias("strength")))
    long = table.select("doc_id", F.posexplode("sentences").alias("n", "ps")).select("doc_id", "n", F.explode("ps").alias("phrase"))
    scores = long.join(entries, "phrase").groupBy("doc_id", "n", "subject").agg(F.sum(F.col("strength") * F.col("strength")).alias("score"))
    named = F.col("subject").isNotNull()
    best = scores.groupBy("doc_id", "n").agg(F.max(F.when(named, F.struct("score", "subject"))).alias("best"), F.bool_or(~named).alias("passing"))
    return best.where(~F.col("passing") & (F.col("best.score") > keep)).select("doc_id", "n", F.col("best.subject").alias("subject"))


def _document_subjects(table: DataFrame, model: DataFrame, cues: DataFrame | None) -> DataFrame:
    """``(doc_id, subject, count, most)`` of the subjects that unlabelled documents keep."""
    free = table.where(~F.col("seed"))
    counts = _sentence_subjects(free, model, SPEAKS, cues).groupBy("doc_id", "subject").agg(F.count(F.lit(1)).alias("count"))
    alone = free.where("total = 1").select(F.col("doc_id").alias("__d"))
    counted = counts.withColumn("most", F.max("count").over(Window.partitionBy("doc_id"))).join(alone, F.col("doc_id") == F.col("__d"), "left")
    return counted.where((F.col("count") >= SHARE * F.col("most")) & ((F.col("count") >= FEWEST) | F.col("__d").isNotNull())).drop("__d")


# --- propagation ----------------------------------------------------------------------------------


def _array(rows: DataFrame, order: Column | None = None) -> np.ndarray | None:
    """The phrases of a table of up to BROADCAST_ROWS rows, sorted; of a larger one the first by ``order``, or None without it."""
    if order is not None:
        rows = rows.orderBy(order).limit(BROADCAST_ROWS)
    got = rows.select("phrase").limit(BROADCAST_ROWS + 1).toArrow().column("phrase").to_numpy()
    return np.sort(got) if len(got) <= BROADCAST_ROWS else None


def found_subjects(documents: DataFrame, subject_labels: DataFrame) -> DataFrame:
    """``(doc_id, subject)``: the subjects of each document that isn't in ``subject_labels``.

    Null, empty and blank texts, and texts that are about none of the subjects, give no row;
    without labels nothing can be learned and the result is empty.
    """
    with scratch():
        labels = subject_labels.select("doc_id", "subject").dropna().groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("labels"))
        seeds = stash(labels, "seeds")
        subjects = [r[0] for r in seeds.select(F.explode("labels").alias("s")).distinct().orderBy("s").collect()]  # the names of the subjects
        if not subjects:
            return documents.sparkSession.createDataFrame([], "doc_id long, subject string")
        ids = bounded_broadcast(seeds.select("doc_id", F.lit(True).alias("seed")), BROADCAST_ROWS)
        texts = documents.select("doc_id", "text").where(F.col("text").isNotNull())
        none = np.empty(0, np.int64)
        seeded = texts.join(ids, "doc_id", "left_semi").mapInArrow(_reader(none, none), TABLE).join(seeds, "doc_id")
        seeded = stash(seeded.repartition("doc_id"), "seeded")

        seed_weights = stash(seeded.mapInArrow(_of_seeds(subjects), _WEIGHT).groupBy("phrase", "subject").agg(F.sum("weight").alias("weight")), "seed-weights")
        learned = stash(strengths(seed_weights), "learned")
        model = learned.where("strength > 0").select("phrase", "subject", "strength")
        barred = learned.where((F.col("strength") == 0) & (F.col("total") >= BARRED)).select("phrase", "total")
        cues = stash(_cues(seeded, model, subjects), "cues")

        # the commonest barred phrases aren't even written; the others are refused whenever a model is made
        skip, dropped = _array(barred, F.col("total").desc()), _array(cues)
        table = texts.mapInArrow(_reader(skip, none if dropped is None else dropped), TABLE)
        table = stash(table.join(ids, "doc_id", "left").withColumn("seed", F.coalesce("seed", F.lit(False))), "sentences")
        left = cues if dropped is None else None
        wanted = _array(_promising(table, model)) if left is None else None
        coded = stash(table.mapInArrow(_coded(wanted), CODED), "coded") if wanted is not None else None

        before = None
        for _ in range(ROUNDS):
            lookup = _lookup(model, subjects) if coded is not None else None
            spread, mark = _passed_on(table, model, left) if lookup is None else _looked_up(coded, Coded(lookup, wanted))
            if mark == before:
                break
            before = mark
            both = seed_weights.unionByName(spread).groupBy("phrase", "subject").agg(F.sum("weight").alias("weight"))
            grown = strengths(both).where("strength > 0").join(barred.select("phrase"), "phrase", "left_anti")
            known = model.select("phrase", F.lit(True).alias("known"))
            grown = grown.join(known, "phrase", "left").where(F.col("known").isNotNull() | (F.col("strength") > NEW_STRENGTH))
            model = stash(grown.select("phrase", "subject", "strength"), "model")
        lookup = _lookup(model, subjects) if coded is not None else None
        if lookup is None:
            found = _document_subjects(table, model, left).select("doc_id", "subject")
        else:
            found = coded.mapInArrow(_labels(Coded(lookup, wanted)), "doc_id long, subject string")
        return stash(found, "subjects", outside=True)


def _cues(seeded: DataFrame, model: DataFrame, subjects: list[str]) -> DataFrame:
    """Phrases that mark passing mentions: most of the seeds' sentences with them speak of a subject that isn't the document's."""
    lookup = _lookup(model, subjects)
    if lookup is not None:
        counted = seeded.mapInArrow(_passing(lookup), "phrase long, bad long, all long").groupBy("phrase").agg(F.sum("bad").alias("bad"), F.sum("all").alias("all"))
    else:
        topical = _sentence_subjects(seeded, model, TOPICAL)
        judged = topical.join(seeded.select("doc_id", "labels"), "doc_id").select("doc_id", "n", (~F.array_contains("labels", F.col("subject"))).alias("passing"))
        lines = seeded.select("doc_id", F.posexplode("sentences").alias("n", "ps"))
        said = lines.join(judged, ["doc_id", "n"]).select(F.explode("ps").alias("phrase"), "passing")
        counted = said.groupBy("phrase").agg(F.count_if("passing").alias("bad"), F.count(F.lit(1)).alias("all"))
    strong = model.where("strength >= 0.2").select("phrase")
    return counted.where((F.col("bad") >= 2) & (F.col("bad") >= 0.7 * F.col("all"))).join(strong, "phrase", "left_anti").select("phrase")


def _promising(table: DataFrame, model: DataFrame) -> DataFrame:
    """Phrases that a model can ever hold: those of the seeds' model, and those in enough documents for a new one's strength.

    A phrase of weight n that agrees on one subject throughout has the bound n / (n + Z * Z).
    """
    bound = LEAST + (1 - LEAST) * NEW_STRENGTH
    least = Z * Z * bound / (1 - bound)
    often = table.mapInArrow(_frequencies, "phrase long, documents long").groupBy("phrase").agg(F.sum("documents").alias("n")).where(F.col("n") > least)
    return often.select("phrase").unionByName(model.select("phrase")).distinct()


def _lookup(model: DataFrame, subjects: list[str]) -> Model | None:
    """The model in arrays; None if it has more than BROADCAST_ROWS phrases."""
    rows = model.limit(BROADCAST_ROWS + 1).toArrow()
    return Model(rows, subjects) if rows.num_rows <= BROADCAST_ROWS else None


def _looked_up(coded: DataFrame, model: Coded) -> tuple[DataFrame, object]:
    """(weight that unlabelled documents pass on to phrases, a mark that changes when a label does)."""
    each = coded.mapInArrow(_spread(model), _SHARES)
    summed = each.groupBy("phrase").agg(*[F.sum(F.get("weights", F.lit(i))).alias(f"w{i}") for i in range(len(model.subjects))])
    out = stash(summed, "spread")
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("subject"), F.col(f"w{i}").alias("weight")) for i, s in enumerate(model.subjects)]))
    mark = out.where("phrase is null").select("w0").first()
    return out.where("phrase is not null").select("phrase", rows.alias("x")).select("phrase", "x.subject", "x.weight").where("weight > 0"), mark


def _passed_on(table: DataFrame, model: DataFrame, cues: DataFrame | None) -> tuple[DataFrame, object]:
    """The same for a model of any size."""
    held = stash(_document_subjects(table, model, cues), "held")
    mark = held.agg(F.sum(F.xxhash64("doc_id", "subject").cast("decimal(38,0)")), F.count(F.lit(1))).first()
    sure = held.where(F.col("most") >= SURE)
    shares = sure.select("doc_id", "subject", (F.col("count") / F.sum("count").over(Window.partitionBy("doc_id"))).alias("weight"))
    return _weights(table, shares), mark
