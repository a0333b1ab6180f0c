"""Personal data in free text, found by a skip-chain conditional random field.

The variables of the field are candidate mentions, not single tokens: every e-mail address
(plain or disguised), every run of digits that could be a phone or identity number, every
street address and every pair of capitalised words is a node; all other text is outside by
construction, which keeps exact spans and a small graph. A node's label is outside or one of
the types its form allows. Its potential adds up the weights of its features: form, the words
around it, name parts, the row's company. Neighbouring nodes of one line share a chain
potential (overlapping ones exclude each other) and distant nodes that repeat a token, or have a
similar one (accents and hyphens apart, the last digits of a number), share a skip potential; loopy sum-product message passing gives the marginals, so that the same name or
number gets one label throughout a document.

The weights are trained here by an averaged structured perceptron on a bounded sample of rows
(``SAMPLE`` rows, documented bound) whose labels come from the anchor contexts below.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows that the weights are trained on.
SAMPLE = 6000
EPOCHS = 8
SWEEPS = 4
#: A candidate whose own score is below minus this is outside whatever its neighbours are.
CERTAIN = 6.0
FIELDS = ("description", "source_description", "recruiter_email")
OUT = "o"



def _letters(category: str) -> str:
    """The letters of a Unicode category as ranges of a character class."""
    codes = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) == category]
    starts = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


#: Capital and small letters of every script that has them.
_UP, _LOW = _letters("Lu"), _letters("Ll")

# How the signs in an e-mail address are written or disguised.
_DOT = r"(?:\.|\s?[(\[{<]\s?(?:dot|DOT|\.)\s?[)\]}>]\s?|\sDOT\s|\sdot\s)"
#: The sign between local part and domain; an address is read from it in both directions.
AT = re.compile(r"\s?[@＠]\s?|\s?[(\[{<]\s?(?:at|AT|@)\s?[)\]}>]\s?|\sAT\s|\sat\s(?=[\w-]+(?:\sdot\s|\s?[(\[]dot[)\]]|\.\w))|&#64;|%40")
LOCAL = re.compile(r"[A-Za-z0-9](?:[\w.%+'-]*[\w+%-])?$")
DOMAIN = re.compile(rf"[A-Za-z0-9][\w-]*(?:{_DOT}[A-Za-z0-9][\w-]*)*{_DOT}[A-Za-z]{{2,24}}(?![\w@])")
NUMBER = re.compile(
    r"(?<![\w#@])(?:(?P<id>[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]|[A-Z]{5}\d{4}[A-Z]|\d{8}[A-Z]|[XYZ]\d{7}[A-Z])(?!\w)"
    r"|(?P<run>(?:\+|\()?\d(?:[\d\s().\-/–]{5,}\d|[\d\s().\-/–]{4,}\d)(?P<tail>[A-Za-z]?)(?![\w])))"
)
_ROAD = r"(?:Ave(?:nue)?|Road|Rd|Street|St|Lane|Ln|Close|Marg|Parade|Drive|Dr|Way|Court|Ct|Square|Sq|Terrace|Boulevard|Blvd|Place|Crescent|Row|Gardens|Mews|Nagar|Highway|Hwy)"
_WORD = rf"[{_UP}][\w'’-]*"
_NAMED = "House|Plot|Flat|Unit|Apt|Apt\\.|Apartment|Villa|Block|Office|Shop"
_BOX = "P\\.O\\. Box|P\\.O\\.Box|P\\. O\\. Box|PO Box|POB|Postfach|Apartado"
_SPANISH = "Calle|Avenida|Avda\\.|Plaza|Paseo|Rue|Via|Camino|Carrer|C/"
_both = lambda words: f"{words}|{words.upper()}"  # noqa: E731  as written and in capitals
_SAME_LINE = re.compile(rf"(?: (?:[{_UP}]\w*|\d+\w*))*")
#: What may follow the first line of an address.
_REST = re.compile(rf"(?:,\s(?:\d+\.º\s[A-Z]|[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s\d[A-Z]{{2}}|[{_UP}]\w+(?:\s(?:[{_UP}]\w*|\d+\w*)){{0,3}}|\d+\s[{_UP}]\w+))*")
ADDRESSES = (
    re.compile(
        rf"(?<![\w/])(?:(?:{_both(_NAMED)})\s(?:No\.?\s)?\d+[A-Za-z]?(?:/\d+)?,?\s(?:\d+(?:-[A-Z]|[a-z])?\s)?{_WORD}"
        rf"|(?:{_both(_BOX)})\s\d+|(?:{_both(_SPANISH)})\s(?:de\s|del\s|la\s|las\s|los\s)*{_WORD},?\s\d+)"
    ),
    re.compile(rf"(?<![\w/.,])\d{{1,5}}(?:-[A-Z]|/\d+|[A-Za-z])?,?\s(?:{_WORD}\s){{1,3}}?(?i:{_ROAD})(?![\w])"),
    re.compile(rf"(?<=[a-zß-ÿA-Z])(?:{_both('straße|strasse|str\\.|gasse|weg|platz|allee|ufer|damm')})\s\d+[A-Za-z]?(?![\w])"),
)
#: A text without any of these cannot match the pattern of the same place.
_GATES = (
    tuple(w.replace("\\", "") for w in _both(f"{_NAMED}|{_BOX}|{_SPANISH}").split("|")),
    (),
    ("straße ", "strasse ", "STRASSE ", "STRAßE ", "str. ", "STR. ", "gasse ", "GASSE ", "weg ", "WEG ", "platz ", "PLATZ ", "allee ", "ALLEE ", "ufer ", "UFER ", "damm ", "DAMM "),
)
_AT_SIGNS = ("@", "＠", "(at", "[at", "{at", "<at", "( at", "[ at", " dot ", "[dot", "(dot", "&#64;", "%40")
_STREET_NAME = re.compile(rf"{_WORD}$")


def _run_before(text: str, end: int, signs: str) -> int:
    """Where the run of letters, digits and ``signs`` that ends at ``end`` begins."""
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in signs or unicodedata.combining(text[start - 1])):
        start -= 1
    return start


def addresses(text: str) -> list[tuple[int, int]]:
    """(start, end) of each street address, in order; the first of overlapping ones is kept."""
    spans = []
    for kind, (pattern, gate) in enumerate(zip(ADDRESSES, _GATES)):
        if gate and not any(k in text for k in gate):
            continue
        for m in pattern.finditer(text):
            start, end = m.span()
            if kind == 2:
                name = _STREET_NAME.search(text, _run_before(text, start, "'’-_"), start)
                if not name:
                    continue
                start = name.start()
            if kind == 0:
                end = _SAME_LINE.match(text, end).end()
            spans.append((start, _REST.match(text, end).end()))
    spans.sort()
    return [s for i, s in enumerate(spans) if not any(s[0] < e for _, e in spans[:i])]


CAPITAL = re.compile(rf"(?<![\w@/#'’.+-])(?:[{_UP}][{_LOW}'’{_UP}]*[{_LOW}{_UP}]|[{_UP}]\.|al-[{_UP}]\w+)(?:-[{_UP}][\w'’]+)*(?![\w@])")
_GAP = re.compile(r"[ \xa0](?:(?:bin|ibn|de|da|del|di|van|von|der|den|la|el|al|dos|du)[ \xa0]|(?:bin|ibn|de|van|al)[ \xa0-])?")
_NEAR = re.compile(r"[\w@#'’]+[.:,(]?|--|[(<>/:,.\n]")

# Contexts that are sure enough to label the training sample.
_BEFORE_NAME = re.compile(
    r"(?:\b(?:mr|mrs|ms|dr|prof|herr|frau|sr|sra)\.?\s|\bask for\s|\bmanager:\s|\bregards,\s|--\s|\breference person\s|\bline manager\s|\bpapers to\s|\bsigned by\s|\bcontact is\s)$", re.I
)
_AFTER_NAME = re.compile(r"\s(?:will answer on|sits at|with id|<)|, tel\.", re.I)
_BEFORE_PHONE = re.compile(r"(?:\bdesk, |\bwhatsapp: ?|\bphone:? |\btel\.?:? |\bcall |\breach me: |\bcalls \(|\banswer on |\bmobile:? |\bfax:? )$", re.I)
_BEFORE_ID = re.compile(r"(?:\bidentity number[\w ]*: |\bwith id |\bcard no\. |\bpassport (?:no\. )?)$", re.I)
_BEFORE_ADDRESS = re.compile(r"(?:\bvisit us at |\bwalk in at |\bsits at |\baddress: |\bgo to: |, )$", re.I)


# Forms of address; they are no part of a name.
_TITLES = {"mr", "mrs", "ms", "dr", "prof", "herr", "frau", "sr", "sra", "señor", "señora", "mme", "monsieur", "madame", "miss"}


def _plain(name: str) -> str:
    """A name without accents and hyphens: similar spellings are one token."""
    return "~" + "".join(c for c in unicodedata.normalize("NFKD", name) if c.isalnum())


def _shape(text: str) -> str:
    """Groups of digits by length, with the signs between them."""
    t = re.sub(r"\d+", lambda m: str(len(m[0])), re.sub(r"\s", " ", text))
    return re.sub(r"[A-Za-z]+", "A", t)


class Node:
    """A candidate mention: span, labels it may take, features and keys that tie it to others."""

    __slots__ = ("start", "end", "labels", "features", "keys", "gold")

    def __init__(self, start: int, end: int, labels: tuple[str, ...], features: list[str], keys: tuple[str, ...]) -> None:
        self.start, self.end, self.labels, self.features, self.keys, self.gold = start, end, labels, features, keys, OUT


def _around(text: str, start: int, end: int, kind: str) -> list[str]:
    left = _NEAR.findall(text[max(0, start - 36) : start].lower())[-2:]
    right = _NEAR.findall(text[end : end + 24].lower())[:1]
    l1 = left[-1] if left else "^"
    return [f"{kind}l1={l1}", f"{kind}l2={' '.join(left)}", f"{kind}r1={right[0] if right else '$'}"]


def candidates(text: str, company: str | None, field: str) -> list[Node]:
    """Candidate mentions of one text in order of their start."""
    nodes: list[Node] = []
    taken: list[tuple[int, int]] = []
    low = text.lower()
    for at in AT.finditer(text) if " AT " in text or any(k in low for k in _AT_SIGNS) else ():
        local, domain = LOCAL.search(text, _run_before(text, at.start(), "_.%+'-"), at.start()), DOMAIN.match(text, at.end())
        if local and domain:
            start, end = local.start(), domain.end()
            features = ["e", f"e:sign={at[0].strip().lower()}", f"e:spelled={'dot' in domain[0].lower()}", f"e:in={field == 'recruiter_email'}"]
            nodes.append(Node(start, end, (OUT, "email"), features, (text[start:end].lower(),)))
            taken.append((start, end))
    for start, end in addresses(text):
        form = "word" if text[start].isalpha() else "number"
        nodes.append(Node(start, end, (OUT, "street_address"), ["a", f"a:form={form}", *_around(text, start, end, "a")], (text[start:end].lower(),)))
        taken.append((start, end))
    inside = lambda s, e: any(a < e and s < b for a, b in taken)
    for m in NUMBER.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        if digits < 6 or inside(*m.span()):
            continue  # nobody's number is shorter
        start, end = m.span()
        run = m[0]
        if run.startswith("(") and ")" not in run:
            start, run = start + 1, run[1:]
        shape = _shape(run)
        bare = re.sub(r"\D", "", run)
        features = ["n", f"n:shape={shape}", f"n:groups={re.sub(r'[^0-9A]+', '-', shape)}", f"n:head={run[:1] if run[0] in '+(' else bare[:2]}", f"n:len={digits}", f"n:tail={bool(m['tail'])}", f"n:letters={bool(m['id'])}"]
        labels = (OUT, "national_id") if m["id"] else (OUT, "phone", "national_id")
        nodes.append(Node(start, end, labels, features + _around(text, start, end, "n"), (bare, bare[-7:])))
        taken.append(m.span())
    words = list(CAPITAL.finditer(text))
    firm = {w.lower() for w in re.findall(r"\w+", company or "")}
    for a, b in zip(words, words[1:]):
        if b.start() - a.end() > 6:
            continue
        gap = text[a.end() : b.start()]
        if gap != " " and not _GAP.fullmatch(gap) or inside(a.start(), b.end()):
            continue
        first, last, stop = a[0], b[0], b.end()
        middle = len(last) == 2 and last[1] == "."
        if middle:  # an initial between the names: take the next word in
            c = CAPITAL.match(text, b.end() + 1)
            if not c:
                continue
            last, stop = c[0], c.end()
        before = re.search(r"([A-Z][a-z]+) $", text[max(0, a.start() - 12) : a.start()]) if first[1:] == "." else None
        if before and before[1].lower() not in _TITLES:
            continue  # the initial belongs to the name before it
        f, s = first.lower(), last.lower()
        if f in _TITLES or (f in firm and s in firm):
            continue  # a form of address, or the company itself
        upper = first.isupper() and last.isupper() and len(first) > 2
        shout = upper and not any(x.islower() for x in text[max(0, a.start() - 16) : a.start()] + text[stop : stop + 16])
        features = ["m", f"m:first={f}", f"m:last3={s[-3:]}", f"m:initial={first[1:] == '.'}", f"m:upper={upper}{shout}", f"m:mid={middle or len(gap) > 1}", f"m:firm={f in firm}{s in firm}", f"m:field={field == 'recruiter_email'}"]
        nodes.append(Node(a.start(), stop, (OUT, "person_name"), features + _around(text, a.start(), stop, "m"), (s, f"{f} {s}", _plain(s))))
    nodes.sort(key=lambda n: (n.start, -n.end))
    return nodes


def anchor(text: str, nodes: list[Node], names: set[str] | None, field: str) -> None:
    """Label candidates by the anchor contexts; ``names`` are given names seen in them."""
    for n in nodes:
        before = text[max(0, n.start - 60) : n.start]
        if "email" in n.labels:
            n.gold = "email" if "e:sign=at" not in n.features or "e:spelled=True" in n.features else OUT
        elif "person_name" in n.labels:
            first = text[n.start : n.end].split()[0].lower()
            sure = bool(_BEFORE_NAME.search(before)) or bool(_AFTER_NAME.match(text, n.end))
            n.gold = "person_name" if sure or (names and first in names) else OUT
        elif "street_address" in n.labels:
            n.gold = "street_address" if _BEFORE_ADDRESS.search(before) else OUT
        elif _BEFORE_ID.search(before):
            n.gold = "national_id"
        elif _BEFORE_PHONE.search(before) and "phone" in n.labels:
            n.gold = "phone"


class Field:
    """Weights and inference."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.w = weights

    def unary(self, node: Node) -> list[float]:
        w = self.w
        return [0.0 if y == OUT else sum(w.get(f"{f}>{y}", 0.0) for f in node.features) for y in node.labels]

    @staticmethod
    def edges(nodes: list[Node], text: str) -> list[tuple[int, int, str]]:
        """(i, j, kind): overlapping or adjacent nodes of one line, and nodes that repeat a token or have a similar one."""
        out = []
        last: dict[str, int] = {}
        for j, n in enumerate(nodes):
            tied = False
            if j:
                p = nodes[j - 1]
                if n.start < p.end:
                    out.append((j - 1, j, "over"))
                    tied = True
                elif n.start - p.end < 120 and "\n" not in text[p.end : n.start]:
                    out.append((j - 1, j, "chain"))
                    tied = True
            for i in sorted({last[k] for k in n.keys if k in last}):
                if i != j - 1 or not tied:
                    out.append((i, j, "skip"))
            last.update(dict.fromkeys(n.keys, j))
        return out

    def pair(self, kind: str, a: str, b: str) -> float:
        if kind == "over":
            return -30.0 if a != OUT and b != OUT else 0.0
        if kind == "skip":
            return self.w.get("skip:same", 0.5) if a == b else 0.0
        return self.w.get(f"chain:{a}>{b}", 0.0)

    def decode(self, nodes: list[Node], text: str) -> list[str]:
        """Labels of highest marginal after loopy sum-product passing.

        Nodes that are all but certainly outside on their own are clamped there first; no
        pairwise weight reaches ``CERTAIN``.
        """
        scores = [self.unary(n) for n in nodes]
        open_ones = [i for i, u in enumerate(scores) if max(u) > 0 or max(u[1:]) > -CERTAIN]
        labels = [OUT] * len(nodes)
        if open_ones:
            for i, y in zip(open_ones, self._marginal([nodes[i] for i in open_ones], [scores[i] for i in open_ones], text)):
                labels[i] = y
        return labels

    def _marginal(self, nodes: list[Node], unary: list[list[float]], text: str) -> list[str]:
        edges = self.edges(nodes, text)
        if edges:
            pots = [[[self.pair(k, a, b) for b in nodes[j].labels] for a in nodes[i].labels] for i, j, k in edges]
            messages: dict[tuple[int, int], list[float]] = {}
            touching: dict[int, list[int]] = defaultdict(list)
            for e, (i, j, _) in enumerate(edges):
                touching[i].append(e), touching[j].append(e)
                messages[e, i], messages[e, j] = [0.0] * len(nodes[i].labels), [0.0] * len(nodes[j].labels)
            for _ in range(SWEEPS):
                change = 0.0
                for order in (range(len(edges)), range(len(edges) - 1, -1, -1)):
                    for e in order:
                        i, j, _k = edges[e]
                        for s, t, flip in ((i, j, False), (j, i, True)):
                            base = unary[s][:]
                            for x in touching[s]:
                                if x != e:
                                    base = [u + v for u, v in zip(base, messages[x, s])]
                            new = []
                            for b in range(len(nodes[t].labels)):
                                terms = [base[a] + (pots[e][b][a] if flip else pots[e][a][b]) for a in range(len(base))]
                                top = max(terms)
                                new.append(top + math.log(sum(math.exp(v - top) for v in terms)))
                            shift = max(new)
                            new = [v - shift for v in new]
                            change = max(change, max(abs(u - v) for u, v in zip(new, messages[e, t])))
                            messages[e, t] = new
                if change < 1e-3:
                    break
            for i in range(len(nodes)):
                for e in touching[i]:
                    unary[i] = [u + v for u, v in zip(unary[i], messages[e, i])]
        return [n.labels[max(range(len(u)), key=u.__getitem__)] for n, u in zip(nodes, unary)]


def train(rows: list[tuple[str, str, str | None]]) -> dict[str, float]:
    """Averaged structured perceptron over (field, text, company) labelled by the anchors.

    Names of the sample's own anchors label the same given names elsewhere in the sample.
    """
    data = [(f, t, candidates(t, c, f)) for f, t, c in rows]
    counts: dict[str, int] = defaultdict(int)
    for f, t, nodes in data:
        anchor(t, nodes, None, f)
        for n in nodes:
            if n.gold == "person_name":
                counts[t[n.start : n.end].split()[0].lower()] += 1
    names = {n for n, c in counts.items() if c >= 3 and not n.endswith(".")}
    for f, t, nodes in data:
        anchor(t, nodes, names, f)
    weights: dict[str, float] = defaultdict(float)
    sums: dict[str, float] = defaultdict(float)
    step = 1

    def update(key: str, by: float) -> None:
        weights[key] += by
        sums[key] += by * step

    model = Field(weights)
    for _ in range(EPOCHS):
        for _f, t, nodes in data:
            if not nodes:
                continue
            guess = model.decode(nodes, t)
            gold = [n.gold for n in nodes]
            if guess != gold:
                for n, y, z in zip(nodes, gold, guess):
                    if y != z:
                        for feature in n.features:
                            if y != OUT:
                                update(f"{feature}>{y}", 1.0)
                            if z != OUT:
                                update(f"{feature}>{z}", -1.0)
                for i, j, kind in model.edges(nodes, t):
                    if kind == "chain" and (gold[i], gold[j]) != (guess[i], guess[j]):
                        update(f"chain:{gold[i]}>{gold[j]}", 0.2)
                        update(f"chain:{guess[i]}>{guess[j]}", -0.2)
                    elif kind == "skip":
                        by = 0.1 * ((gold[i] == gold[j]) - (guess[i] == guess[j]))
                        if by:
                            update("skip:same", by)
            step += 1
    return {k: v - sums[k] / step for k, v in weights.items() if v - sums[k] / step}


def mentions(text: str, company: str | None, field: str, model: Field) -> list[tuple[int, int, str]]:
    """(start, end, type) of each mention, in order."""
    nodes = candidates(text, company, field)
    return [(n.start, n.end, y) for n, y in zip(nodes, model.decode(nodes, text)) if y != OUT] if nodes else []


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each mention replaced by its typed placeholder, otherwise unchanged."""
    out, at = [], 0
    for start, end, kind in found:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
    return "".join([*out, text[at:]])


def fitted(postings: DataFrame) -> dict[str, float]:
    """Weights from a sample of at most ``SAMPLE`` rows, chosen by a hash of their number.

    The hash first thins the table to about twice the sample, so what the tasks send is bounded
    whatever the number of rows.
    """
    some = postings.where(F.col("posting_no").isNotNull())
    thin = max(1, some.count() // (2 * SAMPLE))
    chance = F.xxhash64(F.lit("sample"), "posting_no")
    picked = some.where(F.pmod(chance, F.lit(thin)) == 0).select("posting_no", "company", *FIELDS, chance.alias("chance"))
    rows = picked.orderBy("chance", "posting_no").limit(SAMPLE).collect()
    return train([(f, r[f], r["company"]) for r in rows for f in FIELDS if r[f]])


def found_mentions(postings: DataFrame) -> DataFrame:
    """``(posting_no, field, pii_type, span_start)``: one row per mention, whole texts.

    Null and empty texts give no row; an empty table gives an empty result. The start is in
    code points.
    """
    shared = postings.sparkSession.sparkContext.broadcast(fitted(postings))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(shared.value)
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            companies = batch.column(1).to_pylist()
            numbers = batch.column(0).to_pylist()
            for k, field in enumerate(FIELDS):
                for no, company, text in zip(numbers, companies, batch.column(2 + k).to_pylist()):
                    if text:
                        for start, _end, kind in mentions(text, company, field, model):
                            out[0].append(no), out[1].append(field), out[2].append(kind), out[3].append(start)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], names=["posting_no", "field", "pii_type", "span_start"])

    return postings.select("posting_no", "company", *FIELDS).mapInArrow(run, "posting_no long, field string, pii_type string, span_start long")


def redacted(postings: DataFrame) -> DataFrame:
    """``posting_no`` and the three texts with typed placeholders; nulls stay null."""
    shared = postings.sparkSession.sparkContext.broadcast(fitted(postings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(shared.value)
        for batch in batches:
            companies = batch.column(1).to_pylist()
            columns = [batch.column(0)]
            for k, field in enumerate(FIELDS):
                texts = batch.column(2 + k).to_pylist()
                columns.append(pa.array([t and redact(t, mentions(t, c, field, model)) for t, c in zip(texts, companies)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["posting_no", *FIELDS])

    return postings.select("posting_no", "company", *FIELDS).mapInArrow(run, "posting_no long, " + ", ".join(f"{f} string" for f in FIELDS))
