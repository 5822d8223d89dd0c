"""Personal information in free text: found by a conditional random field over word shapes, replaced by placeholders."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilespark.llm import crf
from profilespark.llm.common import spread
from profilespark.llm.pii_table import AROUND, FAMILY, GIVEN, GRAMMAR, KINDS, LANDMARKS, OTHERS, PLAIN, SIDES, STREETS, TOWARDS, labelled_rows

#: A longer text is decoded in windows of CORE tokens that see CONTEXT tokens on each side.
CORE, CONTEXT = 512, 64
#: Tokens decoded at once, and chunks whose types a worker keeps; both bound a worker's memory, not what is read.
BATCH_TOKENS, KEPT_CHUNKS = 400_000, 300_000
#: The name list is handed to every worker; a longer one is refused (its size is fixed at some hundreds).
MOST_NAMES = 100_000
#: Labelled rows the field is fitted on; they are made by pii_table, so the bound has nothing to do with the corpus.
TRAINING_ROWS = 16_000

OFFSETS = {"word": [-3, -2, -1, 0, 1, 2, 3], "round": [0], "ahead": [0], "figures": [0], "gap": [0], "chunk": [0], "before": [0], "after": [0], "after2": [0]}
_PART = re.compile(r"\s+|\S+")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_LEAD, _TRAIL = "([{<«\"'“‘", ".,;:!?)]}>»\"'”’…"
_STREET_END = ("str", "straße", "strasse", "weg", "gasse", "allee", "platz")
LABELS = 1 + 2 * len(KINDS)


def _literal_words() -> set[str]:
    """Words of the wording and the forms, which the field may know as such; all others are known by their shape."""
    said = [w for by in AROUND.values() for pair in by.values() for w in pair] + [re.sub(r"\{\w+\}", " ", s) for by in STREETS.values() for s in by]
    said += [*LANDMARKS, *SIDES, *(w for by in (TOWARDS, GRAMMAR) for ws in by.values() for w in ws)]
    said += [re.sub(r"\b[PNT]\b", " ", s) for by in PLAIN.values() for s in by] + [re.sub(r"\b[Pp]\b|[9Qq]", " ", s) for s in OTHERS]
    more = {"example", "invalid", "test", "org", "com", "net", "edu", "gov", "io", "co", "uk", "fr", "de", "es", "pt", "mail", "info", "ext", "extension", "x", "dot", "at", "b", "von", "da", "le"}
    return {w.lower() for w in re.findall(r"[^\W\d_]+", " ".join(said))} | more


def _numbers() -> set[str]:
    """Numbers known as such: those that begin phone numbers abroad."""
    return {"1", "33", "34", "39", "44", "46", "48", "49", "55", "91", "351", "353"}


@dataclass
class Names:
    """What is known of names: the list, its frequent beginnings and ends."""

    given: frozenset[str]
    family: frozenset[str]
    heads: dict[str, frozenset[str]]
    tails: dict[str, frozenset[str]]
    ends: frozenset[str]  # two letters that names of many countries end with, and two that stand side by side in them
    pairs: frozenset[str]

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]]) -> Names:
        by = {k: sorted({n.strip() for n, kind in rows if n and n.strip() and (kind or "").strip().lower().startswith(k)}) for k in ("given", "family")}
        heads, tails = {}, {}
        for k, cut in (("given", 3), ("family", 4)):
            low = [n.lower() for n in by[k]]
            count = lambda parts: frozenset(p for p in set(parts) if parts.count(p) >= 2)
            heads[k], tails[k] = count([n[:cut] for n in low]) | count([n[:3] for n in low]), frozenset(n[-3:] for n in low)
        pairs = Counter(p for n in (*GIVEN, *FAMILY) for p in {f"^{n}$".lower()[i : i + 2] for i in range(len(n) + 1)})
        ends = [n.lower()[-2:] for n in (*GIVEN, *FAMILY)]
        return cls(frozenset(n.lower() for n in by["given"]), frozenset(n.lower() for n in by["family"]), heads, tails, frozenset(e for e in ends if ends.count(e) >= 2), frozenset(p for p, n in pairs.items() if n >= 2))


def word_features(w: str, names: Names, literal: set[str], numbers: set[str]) -> tuple[str, ...]:
    if w.isdigit():
        out = ["digits", f"d{min(len(w), 9)}"]
        if w[0] == "0":
            out.append(f"d0{min(len(w), 5)}")
        if w in numbers:
            out.append(f"n={w}")
        return tuple(out)
    if not w[0].isalpha():
        return (f"p={w}", "punct")
    low = w.lower()
    shape = ("u" if w.isupper() else "l") if len(w) == 1 else "U" if w.isupper() else "x" if w.islower() else "Xx" if w[1:].islower() else "xX"
    out = [f"s={shape}"]
    if low in literal:
        out += [f"w={low}", f"w={low}|{shape}"]
    for k, known in (("given", names.given), ("family", names.family)):
        cut = 3 if k == "given" else 4
        if low in known:
            out += [f"{k}", f"{k}|{shape}"]
        head, tail = low[:cut] in names.heads[k] or low[:3] in names.heads[k], low[-3:] in names.tails[k]
        if len(low) > cut and low not in literal:
            if head:
                out.append(f"{k}head")
            if tail:
                out.append(f"{k}tail")
            if head and tail:
                out += [f"{k}like", f"{k}like|{shape}"]
    if len(low) > 5 and low.endswith(_STREET_END):
        out.append("streetend")
    if len(out) == 1 and shape in ("Xx", "U"):
        out += [f"unknown{shape}", f"e={low[-2:]}" if low[-2:] in names.ends else "e=other"]
        out.append(f"odd{min(3, sum(low[i : i + 2] not in names.pairs for i in range(len(low) - 1)))}")
    return tuple(out)


def word_class(features: tuple[str, ...]) -> int:
    """One of ten kinds of word, which stand side by side in the slots "round" and "ahead"; 0 is outside."""
    if not features:
        return 0
    if features[0] == "digits":
        return 8
    if features[-1] == "punct" or features[0] == "odd":
        return 9
    shape, known = features[0], any(f.startswith("w=") for f in features)
    if shape in ("s=x", "s=l", "s=xX"):
        return 1 if known else 2
    if shape == "s=u":
        return 6
    if known:
        return 3
    if any(f.startswith(("given", "family")) for f in features):
        return 4
    return 7 if shape == "s=U" else 5


def chunk_features(c: str) -> tuple[str, ...]:
    """The shape of what stands between white space, without punctuation around it."""
    core = c.lstrip(_LEAD).rstrip(_TRAIL)
    if not core:
        return ("c=none",)
    shape = re.sub(r"\d", "9", re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "a", core))
    out = [f"c={shape if len(shape) < 24 else 'long'}", "C=" + re.sub(r"9+", "9", shape)[:24]]
    digits = sum(x.isdigit() for x in core)
    out.append(f"cd={min(digits, 12)}")
    if "@" in core[1:] or "＠" in core or "[at]" in core.lower():
        out.append("c@")
    if core[0] == "@":
        out.append("c@first")
    if c[-1] in ",;.":
        out.append("ct=" + c[-1])
    return tuple(out)


class Types:
    """Ids of feature sets, of each slot; 0 is outside. Sets met first after training get table rows then."""

    def __init__(self) -> None:
        self.ids: dict[tuple[str, ...], int] = {(): 0}
        self.sets: list[tuple[str, ...]] = [()]
        self.classes = [0]
        self.figures = [0]

    def get(self, features: tuple[str, ...]) -> int:
        k = self.ids.get(features)
        if k is None:
            k = self.ids[features] = len(self.sets)
            self.sets.append(features)
            self.classes.append(word_class(features))
            self.figures.append(int(features[1][1:]) if features[0] == "digits" else 0)
        return k


class Reader:
    """Texts to slots of tokens; what is known of a chunk is kept, so a repeated chunk costs one lookup."""

    def __init__(self, names: Names):
        self.names, self.literal, self.numbers = names, _literal_words(), _numbers()
        self.word, self.chunk = Types(), Types()
        self.words: dict[str, int] = {}
        self.plain: dict[tuple[bool, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.parts: dict[str, int] = {}
        self.length: list[int] = []  # characters of a part
        self.tokens: list[list[int]] = []  # its tokens' types
        self.sizes: list[list[int]] = []  # and their characters
        self.shape: list[int] = []  # the chunk's type; of white space minus its gap kind

    def _word(self, w: str) -> int:
        t = self.words.get(w)
        if t is None:
            t = self.words[w] = self.word.get(word_features(w, self.names, self.literal, self.numbers))
        return t

    def _plain(self, p: str, trail: str) -> int:
        """The chunk type of letters alone, with a mark after them or none."""
        key = (p[0].isupper(), trail)
        t = self.plain.get(key)
        if t is None:
            t = self.plain[key] = self.chunk.get(chunk_features(p))
        return t

    def _part(self, p: str) -> int:
        k = self.parts[p] = len(self.length)
        self.length.append(len(p))
        if p.isspace():
            self.tokens.append([])
            self.sizes.append([])
            self.shape.append(-2 if "\n" in p else -1)
            return k
        if p.isalpha():
            self.tokens.append([self._word(p)])
            self.sizes.append([len(p)])
            self.shape.append(self._plain(p, ""))
            return k
        if p[-1] in ",.;" and p[:-1].isalpha():
            self.tokens.append([self._word(p[:-1]), self._word(p[-1])])
            self.sizes.append([len(p) - 1, 1])
            self.shape.append(self._plain(p, p[-1]))
            return k
        found = _TOKEN.findall(p)
        types = [self._word(w) for w in found]
        # A character that no token covers (a mark on its own, say) goes with the token before it.
        sizes = [len(w) for w in found]
        if sum(sizes) != len(p):
            starts = [m.start() for m in _TOKEN.finditer(p)]
            sizes = [b - a for a, b in zip(starts, [*starts[1:], len(p)])]
            if sizes:
                sizes[0] += starts[0]
            else:
                types, sizes = [self.word.get(("odd",))], [len(p)]
        self.tokens.append(types)
        self.sizes.append(sizes)
        self.shape.append(self.chunk.get(chunk_features(p)))
        return k

    def read(self, texts: list[str]) -> tuple[crf.Slots, np.ndarray, np.ndarray, np.ndarray]:
        """Slots, sequence number, first character and end of each token."""
        if len(self.parts) > KEPT_CHUNKS:
            self.clear()
            self.words.clear()
        flat: list[int] = []
        counts = []
        get, make = self.parts.get, self._part
        for t in texts:
            before = len(flat)
            for p in _PART.findall(t):
                k = get(p)
                flat.append(make(p) if k is None else k)
            counts.append(len(flat) - before)
        part = np.array(flat, np.int64)
        seq = np.repeat(np.arange(len(texts)), counts)
        length = np.array(self.length, np.int64)[part]
        shape = np.array(self.shape, np.int64)[part]
        ends = np.cumsum(length)
        begin = ends - length
        first_part = np.concatenate(([0], np.cumsum(counts)))[:-1]
        offset = np.repeat(np.append(begin, ends[-1] if len(ends) else 0)[np.minimum(first_part, len(begin))], counts) if len(flat) else np.zeros(0, np.int64)
        begin = begin - offset
        n_tok = np.array([len(x) for x in self.tokens], np.int64)
        base = np.concatenate(([0], np.cumsum(n_tok)))
        all_types = np.array([t for x in self.tokens for t in x], np.int64)
        all_sizes = np.array([t for x in self.sizes for t in x], np.int64)
        all_starts = np.cumsum(all_sizes) - all_sizes
        if len(all_starts):
            heads = np.repeat(base[:-1][n_tok > 0], n_tok[n_tok > 0])
            all_starts = all_starts - all_starts[heads]
        gap_before = np.full(len(part), 3, np.int64)
        if len(part) > 1:
            same = seq[1:] == seq[:-1]
            gap_before[1:] = np.where(same, np.where(shape[:-1] < 0, -shape[:-1], 3), 3)
        solid = shape >= 0
        part, seq, begin, gap_before, shape = part[solid], seq[solid], begin[solid], gap_before[solid], shape[solid]
        n = n_tok[part]
        owner = np.repeat(np.arange(len(part)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = base[part][owner] + inner
        tok_seq = seq[owner]
        gap = np.where(inner == 0, gap_before[owner], 4)
        gaps = gap
        for o in (-1, 1, 2):
            gaps = gaps * 5 + crf.shifted(gap, tok_seq, o)
        slots = {"word": all_types[at], "gap": gaps, "chunk": shape[owner]}
        kind = np.array(self.word.classes, np.int64)[slots["word"]]
        before, after, after2 = (crf.shifted(kind, tok_seq, o) for o in (-1, 1, 2))
        size = np.array(self.word.figures, np.int64)[slots["word"]]
        slots["figures"] = crf.shifted(size, tok_seq, -1) * 100 + size * 10 + crf.shifted(size, tok_seq, 1)
        slots["round"], slots["ahead"] = before * 100 + kind * 10 + after, kind * 100 + after * 10 + after2
        for name, o in (("before", -1), ("after", 1), ("after2", 2)):
            slots[name] = crf.shifted(shape, seq, o)[owner]
        start = begin[owner] + all_starts[at]
        return slots, tok_seq, start, start + all_sizes[at]


@dataclass
class Model:
    names: Names
    weights: dict[str, dict[int, np.ndarray]]
    vocab: dict[str, dict[str, int]]
    trans: np.ndarray
    first: np.ndarray


#: Gap kinds before the token, the one before it, and the two after it: none, space, newline, start, glued.
_GAPS = [(f"0{k // 125}", f"-{k // 25 % 5}", f"+{k // 5 % 5}", f"++{k % 5}", f"0{k // 125}+{k // 5 % 5}") for k in range(625)]
#: Three kinds of word, or three numbers of figures, side by side.
_KINDS = [(f"k{k}",) for k in range(1000)]


def _slot_sets(reader: Reader) -> dict[str, list[tuple[str, ...]]]:
    return {"word": reader.word.sets, "round": _KINDS, "ahead": _KINDS, "figures": _KINDS, "gap": _GAPS, "chunk": reader.chunk.sets, "before": reader.chunk.sets, "after": reader.chunk.sets, "after2": reader.chunk.sets}


@lru_cache(maxsize=4)
def train_model(name_rows: tuple[tuple[str | None, str | None], ...], rows: int = TRAINING_ROWS) -> Model:
    """Fitted on ``rows`` labelled rows (see pii_table), the same whatever the corpus; kept for further calls with these names."""
    names = Names.of(list(name_rows))
    given = sorted({n for n, k in name_rows if n and k == "given"}) or ["Ada", "Carl", "Nora"]
    family = sorted({n for n, k in name_rows if n and k == "family"}) or ["Bergmann", "Okafor", "Lindqvist"]
    data = labelled_rows(given, family, rows)
    reader = Reader(names)
    slots, seq, start, end = reader.read([t for t, _ in data])
    gold = np.zeros(len(seq), np.int64)
    bounds = np.searchsorted(seq, np.arange(len(data) + 1))
    for i, (_, spans) in enumerate(data):
        a, b = bounds[i], bounds[i + 1]
        for s, e, kind in spans:
            k = KINDS.index(kind)
            inside = a + np.flatnonzero((start[a:b] >= s) & (end[a:b] <= e))
            gold[inside] = 2 + 2 * k
            gold[inside[0]] = 1 + 2 * k
    vocab: dict[str, dict[str, int]] = {}
    features = {}
    for slot, sets in _slot_sets(reader).items():
        v: dict[str, int] = {}
        features[slot] = [[v.setdefault(f, len(v)) for f in s] or [-1] for s in sets]
        vocab[slot] = v
    forbidden = np.zeros((LABELS, LABELS))
    for k in range(len(KINDS)):
        forbidden[:, 2 + 2 * k] = -1e4
        forbidden[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    weights, trans, first = crf.train(slots, seq, gold, features, {s: max(1, len(v)) for s, v in vocab.items()}, OFFSETS, LABELS, forbidden)
    return Model(names, weights, vocab, trans, first)


class Finder:
    """Decodes texts with a model; score tables grow as new types are met."""

    def __init__(self, model: Model):
        self.model, self.reader = model, Reader(model.names)
        self.tables: dict[str, dict[int, np.ndarray]] = {}
        self.trans, self.first = model.trans.astype(np.float32), model.first.astype(np.float32)

    def _grow(self) -> None:
        for slot, sets in _slot_sets(self.reader).items():
            by = self.tables.setdefault(slot, {})
            for o, w in self.model.weights[slot].items():
                have = by.get(o)
                n = 0 if have is None else len(have)
                if n < len(sets):
                    v = self.model.vocab[slot]
                    new = np.array([sum((w[v[f]] for f in s if f in v), np.zeros(LABELS)) for s in sets[n:]], np.float32).reshape(-1, LABELS)
                    by[o] = new if have is None else np.concatenate((have, new))

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, kind) of each text, in order."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        slots, seq, start, end = self.reader.read(texts)
        if not len(seq):
            return out
        self._grow()
        scores = crf.emissions(self.tables, slots, seq)
        first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        n = np.diff(np.append(first, len(seq)))
        windows = -(-n // CORE)
        w_start = np.repeat(first, windows) + (np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)) * CORE
        stop = np.repeat(first + n, windows)
        lo = np.maximum(w_start - CONTEXT, np.repeat(first, windows))
        hi = np.minimum(w_start + CORE + CONTEXT, stop)
        size = hi - lo
        base = np.cumsum(size) - size
        idx = np.repeat(lo - base, size) + np.arange(size.sum())
        labels = crf.viterbi(scores[idx], base, size, self.trans, self.first)
        core = (idx >= np.repeat(w_start, size)) & (idx < np.repeat(np.minimum(w_start + CORE, stop), size))
        lab = np.zeros(len(seq), np.int8)
        lab[idx[core]] = labels[core]
        kind = (lab - 1) // 2
        begins = np.flatnonzero((lab > 0) & ((lab % 2 == 1) | np.append(True, (kind[1:] != kind[:-1]) | (seq[1:] != seq[:-1]))))
        if not len(begins):
            return out
        on = np.append(lab[1:], 0)
        nxt_same = (on > 0) & (on % 2 == 0) & (np.append(kind[1:], -1) == kind) & (np.append(seq[1:], -1) == seq)
        ends = np.flatnonzero((lab > 0) & ~nxt_same)
        for b, e in zip(begins.tolist(), ends[np.searchsorted(ends, begins)].tolist()):
            k = KINDS[int(kind[b])]
            span = checked(texts[seq[b]], int(start[b]), int(end[e]), k)
            if span:
                out[seq[b]].append((*span, k))
        return out


def checked(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The span without punctuation that no value of its kind ends with, or None where the kind can't be."""
    trail = {"street_address": ",;:!?)]>\"'", "person_name": ",;:!?)]>\"'"}.get(kind, ".,;:!?)]>\"'")
    while b > a and (text[b - 1].isspace() or text[b - 1] in trail):
        b -= 1
    lead = " \n\t([<,;:/-" if kind == "phone" and not re.match(r"\(\d", text[a:b]) else " \n\t" if kind == "phone" else " \n\t([<,;:/"
    while a < b and text[a] in lead:
        a += 1
    for open_, close in ("()", "[]"):  # a bracket around the value isn't of it, one within it is
        if text[a:b].count(open_) > text[a:b].count(close) and text[a] == open_:
            a += 1
    if kind == "email" and text[a:b].lower().startswith("mailto:"):
        a += len("mailto:")
    v = text[a:b]
    digits = sum(c.isdigit() for c in v)
    if kind == "email" and not re.search(r"@|＠|\bat\b", v, re.I) or kind == "phone" and digits < 7 or kind == "id_number" and digits < 6 or kind == "street_address" and (not digits or len(v) < 6):
        return None
    if kind == "person_name":
        low = re.match(r"(?:[^\W\d_A-ZÀ-Þ][^\W\d_]+[\s,]+)+", v)  # a name doesn't begin with a word in lower case
        a += low.end() if low else 0
        v = text[a:b]
        if digits or len(re.findall(r"(?<![^\W\d_])[A-ZÀ-ÞĀ-Ž]", v)) < 2 or re.search(r"[^\W\d_]{4,}\.\s", v):  # one word alone may be anything; no name goes on after a sentence
            return None
    return (a, b) if v else None


def placeholder(kind: str) -> str:
    return f"[{kind.upper()}]"


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], placeholder(kind)]
        at = b
    return "".join([*out, text[at:]])


def model_for(names: DataFrame) -> Model:
    rows = names.select("person_name", "name_kind").distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"the name list has more than {MOST_NAMES} rows")
    return train_model(tuple(sorted(((r.person_name, r.name_kind) for r in rows), key=str)))


def _mapped(docs: DataFrame, model: Model, with_text: bool):
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    source = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL"), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(shared.value)
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < BATCH_TOKENS * 4):
                    size += len(texts[to])
                    to += 1
                part = texts[at:to]
                spans = finder.find(part)
                if with_text:
                    yield pd.DataFrame({"doc_id": ids[at:to], "text_redacted": [redacted(t, s) for t, s in zip(part, spans)], "n_spans": [len(s) for s in spans]})
                else:
                    rows = [(i, k, a, b, t[a:b]) for i, t, s in zip(ids[at:to], part, spans) for a, b, k in s]
                    yield pd.DataFrame(rows, columns=["doc_id", "kind", "char_start", "char_end", "pii_text"])
                at = to

    schema = "doc_id long, text_redacted string, n_spans int" if with_text else "doc_id long, kind string, char_start int, char_end int, pii_text string"
    return source.mapInPandas(run, schema)


def find_pii(docs: DataFrame, names: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, kind, char_start, char_end, pii_text of every span in docs.text.

    Offsets count characters from 0. Null and empty texts give nothing; a row that is a copy of another gives its
    spans again. A map over the scanned rows: nothing is shuffled (but for a small input, see ``spread``).
    """
    return _mapped(docs, model or model_for(names), False)


def redact_pii(docs: DataFrame, names: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, text_redacted, n_spans: the text with [EMAIL], [PHONE], ... for each span, else unchanged."""
    return _mapped(docs, model or model_for(names), True)
