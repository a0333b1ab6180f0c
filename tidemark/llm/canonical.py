"""Free-typed places and titles mapped to a reference list.

The reference entries, with all alias paths (alternative names, transliterations), form a
trie. A value is reduced to its core (decorations that don't change its meaning are removed)
and the trie is walked with a universal Levenshtein automaton with transpositions: a state is
the band of edit distances around the diagonal, the input is the match vector of one trie
character against the core, and transitions are memoised, so they are shared by all values.
All entries within a distance that depends on the core's length are returned (``p4_matches``); the
nearest wins (``p4_found``). Values are read whole; a core longer than the longest path and the edits
allowed can match nothing, so only shorter ones are searched. Work is done once per distinct value.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.identity import PLACEHOLDERS

#: Refuse reference lists that would not fit every worker's memory.
MAX_ENTRIES = 200_000

# Letters that compatibility decomposition leaves alone, and their plain spelling.
PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"})
# Short forms of words in titles.
SHORT = {
    "dev": "developer", "engr": "engineer", "eng": "engineer", "mgr": "manager", "offr": "officer", "off": "officer", "supv": "supervisor", "supvr": "supervisor",
    "tech": "technician", "asst": "assistant", "coord": "coordinator", "spec": "specialist", "admin": "administrator", "acct": "accountant",
    "rep": "representative", "instr": "instructor", "recep": "receptionist", "op": "operator", "cons": "consultant", "maths": "mathematics",
}
# Words of seniority and contract at the ends of a title.
RANK = r"sr|senior|jr|junior|lead|principal|staff|head|chief|trainee|intern|associate|mid|entry level|experienced"
NOISE = r"hiring|urgent|wanted|needed|now|apply|job|vacancy|we need|we are looking for|looking for|opening|position"


def fold(text: str) -> str:
    """Lower case without accents; every run of other characters is one blank."""
    t = unicodedata.normalize("NFKD", text.lower().translate(PLAIN))
    t = "".join(c for c in t if not unicodedata.combining(c)).translate(PLAIN)
    return re.sub(r"[^a-z0-9]+", " ", t).strip()


def limit(length: int) -> int:
    """Edits allowed in a core of this length."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 8 else 3


def near_enough(query: str, entry: str, distance: int) -> bool:
    """Whether a distance is small enough for the lengths at hand.

    Three edits in a core of less than eleven letters are too many, unless the letters are nearly
    the same: a swap across a lost letter counts three here but is two slips of the hand.
    """
    if distance <= 2 or len(query) >= 11:
        return distance <= limit(len(query))
    a, b = Counter(query), Counter(entry)
    return distance <= limit(len(query)) and sum(((a - b) + (b - a)).values()) <= 1


class Automaton:
    """Universal Levenshtein automaton with transpositions for one distance ``k``."""

    def __init__(self, k: int) -> None:
        self.k, self.cap = k, k + 1
        self.states: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.moves: dict[tuple[int, int], int] = {}
        far = (self.cap,) * (2 * k + 1)
        start = tuple(min(self.cap, i) if i >= 0 else self.cap for i in range(-k, k + 1))
        self.start = self._id((far, start, 0))

    def _id(self, state: tuple) -> int:
        if state not in self.index:
            self.index[state] = len(self.states)
            self.states.append(state)
        return self.index[state]

    def move(self, state: int, chi: int) -> int:
        """Next state for match vector ``chi``: bit b is query position (depth - k - 1 + b); -1 is dead."""
        key = (state, chi)
        found = self.moves.get(key)
        if found is None:
            older, old, last = self.states[state]
            k, cap = self.k, self.cap
            row: list[int] = []
            for o in range(2 * k + 1):
                best = old[o] + (0 if chi >> (o + 1) & 1 else 1)
                if o + 1 <= 2 * k:
                    best = min(best, old[o + 1] + 1)
                if o:
                    best = min(best, row[o - 1] + 1)
                if chi >> o & 1 and last >> (o + 2) & 1:
                    best = min(best, older[o] + 1)
                row.append(min(best, cap))
            found = -1 if min(row) >= cap and min(old) >= cap else self._id((old, tuple(row), chi))
            self.moves[key] = found
        return found

    def distance(self, state: int, depth: int, length: int) -> int:
        """Edits between the query and the path that led here; above ``k`` is k + 1."""
        o = length - depth + self.k
        return self.states[state][1][o] if 0 <= o <= 2 * self.k else self.cap


class Trie:
    """Reference entries by their spelled paths; a path may belong to several entries."""

    def __init__(self, paths: Iterable[tuple[str, int]]) -> None:
        self.root: dict = {}
        self.longest = 0
        for text, ref in paths:
            if text:
                self.longest = max(self.longest, len(text))
                node = self.root
                for c in text:
                    node = node.setdefault(c, {})
                node.setdefault("", (text, set()))[1].add(ref)
        self.automata: dict[int, Automaton] = {}
        self.seen: dict[str, dict[int, int]] = {}

    def exact(self, text: str) -> set[int]:
        node = self.root
        for c in text:
            node = node.get(c)
            if node is None:
                return set()
        return node.get("", ("", set()))[1]

    def search(self, text: str) -> dict[int, int]:
        """The entries that ``text`` spells, else all within the distance allowed for it, with their distance."""
        return {ref: 0 for ref in self.exact(text)} or self.within(text)

    def within(self, text: str) -> dict[int, int]:
        """All entries within the distance allowed for ``text``, with their distance."""
        if text in self.seen:
            return self.seen[text]
        out = {ref: 0 for ref in self.exact(text)}
        k, n = limit(len(text)), len(text)
        if n > self.longest + k:
            return out
        if k:
            auto = self.automata.setdefault(k, Automaton(k))
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << (i + k + 2)  # position 1 sits at bit k + 2
            window = (1 << (2 * k + 3)) - 1
            stack = [(self.root, auto.start, 0)]
            while stack:
                node, state, depth = stack.pop()
                for c, child in node.items():
                    if c == "":
                        d = auto.distance(state, depth, n)
                        if d <= k and near_enough(text, child[0], d):
                            for ref in child[1]:
                                out[ref] = min(d, out.get(ref, d))
                    else:
                        nxt = auto.move(state, masks.get(c, 0) >> (depth + 1) & window)
                        if nxt >= 0:
                            stack.append((child, nxt, depth + 1))
        if len(self.seen) < 200_000:
            self.seen[text] = out
        return out


def _nearest(hits: dict[int, int]) -> tuple[int, int]:
    """(distance, entry); ties go to the smallest id; (99, 0) without a hit."""
    return min(((d, ref) for ref, d in hits.items()), default=(99, 0))


def _merged(every: Iterable[dict[int, int]]) -> dict[int, int]:
    out: dict[int, int] = {}
    for hits in every:
        for ref, d in hits.items():
            out[ref] = min(d, out.get(ref, d))
    return out


class Places:
    """Cities by name and country."""

    def __init__(self, rows: list[tuple]) -> None:
        self.country: dict[int, str] = {}
        self.countries: dict[str, str] = {}
        paths = []
        for ref, city, country, iso2, alts in rows:
            self.country[ref] = iso2 or country or ""
            for name in (country, iso2):
                if name:
                    self.countries[fold(name)] = self.country[ref]
            for name in [city, *(alts or [])]:
                if name:
                    spelled = name.lower().replace("ä", "ae").replace("ö", "oe").replace("ü", "ue")
                    paths += [(fold(name), ref), (fold(spelled), ref)]
        for name, code in (("uk", "GB"), ("usa", "US"), ("u s a", "US"), ("uae", "AE"), ("england", "GB"), ("deutschland", "DE"), ("espana", "ES")):
            if code in self.country.values():
                self.countries.setdefault(name, code)
        self.trie = Trie(paths)

    def find(self, value: str) -> int:
        """The place a value names, or 0."""
        return min((_nearest(hits) for hits in self._hits(value, self.trie.search)), default=(99, 0))[1]

    def matches(self, value: str) -> dict[int, int]:
        """Every place within the distance of some reading of a value, with the least distance."""
        return _merged(self._hits(value, self.trie.within))

    def _hits(self, value: str, search: Callable[[str], dict[int, int]]) -> Iterator[dict[int, int]]:
        t = re.sub(r"\([^()]*\)|\[[^\[\]]*\]", " ", value)
        t = re.sub(r"\b\d{4,}\b", " ", t)
        parts = [fold(p) for p in re.split(r"[,/;|]| - | – ", t)]
        parts = [re.sub(r"^(?:remote(?: in)?|hybrid|onsite|on site|near|greater|around|central|downtown|city of) (?=.)", "", p) for p in parts if p]
        parts = [re.sub(r"(?<=.) (?:area|city centre|city center|metropolitan area|metro|region|suburbs|remote|hybrid|on site)$", "", p) for p in parts]
        where = {self.countries[p] for p in parts if p in self.countries}
        for p in dict.fromkeys(parts + [" ".join(parts)]):
            for q in (p, *([] if " " not in p else self._without_country(p))):
                if p in self.countries and not self.trie.exact(p) or q in ("remote", "various", "hybrid"):
                    continue
                hits = search(q)
                yield {r: d for r, d in hits.items() if self.country[r] in where} if where else hits

    def _without_country(self, part: str) -> list[str]:
        words = part.split(" ")
        out = []
        for n in (1, 2, 3):
            if n < len(words):
                if " ".join(words[-n:]) in self.countries:
                    out.append(" ".join(words[:-n]))
                if " ".join(words[:n]) in self.countries:
                    out.append(" ".join(words[n:]))
        return out


class Titles:
    """Roles by title; places are known so that an office's city can be taken off."""

    def __init__(self, rows: list[tuple], places: Places) -> None:
        self.places = places
        paths = [(self._words(name), ref) for ref, title, alts in rows for name in [title, *(alts or [])] if name]
        self.trie = Trie(paths + [(p.replace(" ", ""), ref) for p, ref in paths if " " in p])

    @staticmethod
    def _words(text: str) -> str:
        return " ".join(SHORT.get(w, w) for w in fold(text).split())

    def find(self, value: str) -> int:
        """The role a title names, or 0; the first reading that spells an entry decides."""
        best = (99, 0)
        for core in self._cores(value):
            best = min(best, _nearest(self.trie.search(core)))
            if best[0] == 0:
                break
        return best[1]

    def matches(self, value: str) -> dict[int, int]:
        """Every role within the distance of some reading of a title, with the least distance."""
        return _merged(map(self.trie.within, self._cores(value)))

    def _cores(self, value: str) -> list[str]:
        t = value.split("|")[0].split("@")[0]
        t = re.sub(r"#\s*\d+", " ", t)
        t = re.sub(r"\((?:[^)]*\d[^)]*|m/f/d|m/w/d|f/m/d|all genders|remote|hybrid|full[- ]?time|part[- ]?time|contract(?= )[^)]*)\)", " ", t, flags=re.I)
        pieces = [p for p in re.split(r"\s*[,;:()\[\]]\s*|\s+[-–—]\s+", t)]
        cores: list[str] = []
        # a rank may belong to the role's name: try it kept, then without the first, then without any
        for ends in (rf"(?:(?:{NOISE}) )+", rf"(?:(?:{NOISE}) )*(?:(?:{RANK}) )(?:(?:{NOISE}) )*", rf"(?:(?:{NOISE}|{RANK}) )+"):
            parts = []
            for p in pieces:
                w = re.sub(rf"^{ends}|(?: (?:{NOISE}|i{{1,3}}|iv|m f d))+$", "", self._words(p))
                if w and not re.fullmatch(rf"{RANK}|{NOISE}|remote|hybrid|on site|full time|part time", w) and not re.search(r" office$|^at ", w):
                    parts.append(w)
            while len(parts) > 1 and self._is_place(parts[-1]):
                parts.pop()
            if parts:
                cores.append(" ".join(parts))
            if len(parts) > 1:
                cores += [" ".join(parts[1:] + parts[:1]), parts[0]]
            if len(parts) > 2:
                cores += [" ".join(parts[:-1]), parts[1] + " " + parts[0]]
        return list(dict.fromkeys(cores))

    def _is_place(self, text: str) -> bool:
        return bool(self.places.trie.exact(text)) or text in self.places.countries


def _reference(df: DataFrame, *columns: str) -> list[tuple]:
    rows = [tuple(r) for r in df.select(*columns).where(F.col(columns[0]).isNotNull()).orderBy(columns[0]).limit(MAX_ENTRIES + 1).collect()]
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} reference entries")
    return rows


def _values(postings: DataFrame, places: DataFrame, role_titles: DataFrame) -> DataFrame:
    """``(posting_no, field, value)`` of every value that isn't written as the list has it; nulls, blanks and null-like tokens are left out."""
    pair = lambda f: F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))
    long = postings.select("posting_no", F.explode(F.array(pair("location"), pair("title"))).alias("p")).select("posting_no", "p.field", "p.value")
    bare = F.lower(F.regexp_replace("value", r"^[\s ]+|[\s ]+$", ""))
    long = long.where(F.col("value").isNotNull() & ~bare.isin(*PLACEHOLDERS))
    listed = places.select(F.lit("location").alias("field"), F.concat_ws(", ", "city", "country").alias("value")).unionByName(
        role_titles.select(F.lit("title").alias("field"), F.col("title").alias("value"))
    )
    return long.join(listed, ["field", "value"], "left_anti")


def _searched(values: DataFrame, places: DataFrame, role_titles: DataFrame, answer: Callable[[object, str], list[tuple[int, int]]]) -> DataFrame:
    """``(field, value, n, ref_id, distance)``: what ``answer`` says of each distinct value, once."""
    place_rows = _reference(places, "place_id", "city", "country", "iso2", "alt_names")
    title_rows = _reference(role_titles, "role_id", "title", "alt_titles")
    shared = values.sparkSession.sparkContext.broadcast((place_rows, title_rows))  # at most MAX_ENTRIES each

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_places = Places(shared.value[0])
        known_titles = Titles(shared.value[1], known_places)
        for batch in batches:
            fields, texts = batch.column("field").to_pylist(), batch.column("value").to_pylist()
            found = [(i, *hit) for i, (f, v) in enumerate(zip(fields, texts)) for hit in answer(known_places if f == "location" else known_titles, v)]
            at, refs, distances = zip(*found) if found else ((), (), ())
            rows = batch.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(refs, pa.int64()), pa.array(distances, pa.int32())], names=["field", "value", "n", "ref_id", "distance"])

    distinct = values.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return distinct.mapInArrow(search, "field string, value string, n long, ref_id long, distance int")


def found_canonical(postings: DataFrame, places: DataFrame, role_titles: DataFrame) -> DataFrame:
    """``(posting_no, field, ref_id)`` of every value that isn't written as the list has it.

    Nulls, blanks and null-like tokens give no row; 0 reports a value that names no entry. Values of any
    length are read whole. Each distinct value is searched once and joined back.
    """
    long = _values(postings, places, role_titles)
    answers = _searched(long, places, role_titles, lambda known, value: [(known.find(value), 0)]).select("field", "value", "ref_id")
    return long.join(answers, ["field", "value"]).select("posting_no", "field", "ref_id")


def all_matches(postings: DataFrame, places: DataFrame, role_titles: DataFrame) -> DataFrame:
    """``(field, value, n, ref_id, distance, ties)``: every entry within the distance of each distinct value, of which ``n`` rows have it.

    ``ties`` counts the entries at the same distance; a value without any is reported with ref_id 0 and null.
    """
    found = _searched(_values(postings, places, role_titles), places, role_titles, lambda known, value: sorted(known.matches(value).items()) or [(0, -1)])
    ties = F.count(F.lit(1)).over(Window.partitionBy("field", "value", "distance"))  # at most the reference list
    return found.select("field", "value", "n", "ref_id", F.when(F.col("distance") >= 0, F.col("distance")).alias("distance"), F.when(F.col("distance") >= 0, ties).alias("ties"))
