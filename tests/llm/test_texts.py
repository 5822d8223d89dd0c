"""Leaks, personal information, packing and mapping."""

import random
import re
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from profilespark.llm import canonical, leaks, packing, pii
from profilespark.llm.fmindex import FMIndex, suffix_array
from profilespark.llm.pii_table import AROUND, FAMILY, GIVEN, OTHERS, PLAIN, labelled_rows
from tests.llm.pii_heldout import rows as heldout_rows


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=0, max_size=120), st.integers(1, 9))
def test_fm_index(seq, step):
    s = np.array([*seq, 0])
    assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    f = FMIndex(s, step)
    pats = np.array([[a, b, c] for a in range(1, f.size) for b in range(1, f.size) for c in range(1, f.size)], np.int64).reshape(-1, 3)
    lo, hi = f.search(pats)
    for p, a, b in zip(pats, lo, hi):
        assert sorted(f.locate(np.arange(a, b)).tolist()) == [i for i in range(len(s) - 2) if s[i : i + 3].tolist() == p.tolist()]


@pytest.mark.parametrize("block", [20_000, 7])
def test_leaks(spark, monkeypatch, block):
    monkeypatch.setattr(leaks, "ITEM_BLOCK", block)
    r = random.Random(1)
    word = lambda: r.choice("Alpha bêta gamma Größe delta épsilon zeta eta theta iota kappa lambda mu nu xi omicron".split())
    items = [(i, " ".join(word() for _ in range(30))) for i in range(20)] + [(90, "too short"), (91, None), (92, "")]
    docs = []
    for d in range(60):
        text = " ".join(word() for _ in range(r.randrange(5, 80)))
        if d % 3 == 0:
            w = items[d % 20][1].split()
            a = r.randrange(0, 15)
            text += " - " + ", ".join(w[a : a + r.randrange(10, 15)]).upper() + "; " + word()
        docs.append((d, text))
    docs += [(100, None), (101, ""), (102, items[0][1].replace("Größe", "GROSSE").replace("ê", "e")), (103, "x " * 50_000 + items[1][1]), (0, docs[0][1])]
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    want = set()
    for d, t in docs:
        w = leaks.words(t or "")
        have = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        want |= {(d, i) for i, p in items for q in [leaks.words(p or "")] if any(tuple(q[k : k + 12]) in have for k in range(len(q) - 11))}
    got = leaks.find_leaks(ddf, idf).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and (102, 0) in want
    texts = dict(docs)
    for x in got:
        assert len(leaks.words(texts[x.doc_id][x.char_start : x.char_end])) == x.n_words >= 12
    assert leaks.find_leaks(ddf.limit(0), idf).count() == 0 and leaks.find_leaks(ddf, idf.limit(0)).count() == 0


NAMES = [(n, "given") for n in "Katrin Katlen Katmor Markus Marlen Marmor Selwen Selmor Sellen Tolmor Tolwen Tollen".split()] + [(n, "family") for n in "Bergholt Bergmark Berglin Corvholt Corvmark Corvlin Hardholt Hardmark Hardlin".split()]


@pytest.fixture(scope="module")
def model():
    return pii.train_model(tuple(NAMES))


def _scored(model, rows):
    got = pii.Finder(model).find([t for t, _ in rows])
    by: dict = {}
    for (_, g), h in zip(rows, got):
        for k, span in [("n", x) for x in g] + [("hit", x) for x in set(g) & set(h)] + [("said", x) for x in h]:
            by.setdefault(span[2], {"n": 0, "hit": 0, "said": 0})[k] += 1
    return by


def test_rows_of_the_same_maker(model):
    by = _scored(model, labelled_rows([n for n, k in NAMES if k == "given"], [n for n, k in NAMES if k == "family"], 300, seed=77)).values()
    tp = sum(x["hit"] for x in by)
    assert tp >= 0.85 * sum(x["n"] for x in by) and tp >= 0.85 * sum(x["said"] for x in by)


def test_rows_of_other_wording(model):
    """Rows written by hand; names outside any list, numbers of real plans, and things that look alike and are none."""
    by = _scored(model, heldout_rows())
    tp, n, said = (sum(x[k] for x in by.values()) for k in ("hit", "n", "said"))
    assert tp >= 0.85 * n and tp >= 0.85 * said, by
    for kind, least in {"email": 0.95, "phone": 0.85, "id_number": 0.8, "street_address": 0.8, "person_name": 0.65}.items():
        assert by[kind]["hit"] >= least * by[kind]["n"], (kind, by[kind])


def test_wording_is_not_that_of_the_documents():
    """No fixed part of ten characters or more of the training wording stands in the documents that are searched."""
    path = Path("/root/testdata/sf0.1/documents.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    texts = "\n".join(t for t in pq.read_table(path, columns=["text"]).column(0).to_pylist() if t).lower()
    parts = {p for by in AROUND.values() for pair in by.values() for w in pair for p in w.split("|")}
    parts |= {p for ss in PLAIN.values() for s in ss for p in re.split(r"\b[PNT]\b", s)} | {p for o in OTHERS for p in re.split(r"[9QPqp]+", o)}
    assert not [p for p in parts if len(p.strip()) >= 10 and p.strip().lower() in texts]
    held = {t[a:b] for t, spans in heldout_rows() for a, b, k in spans if k == "person_name"}
    assert not [h for h in held if h.split()[0] in GIVEN and h.split()[-1] in FAMILY]


def test_long_text_windows(model):
    f = pii.Finder(model)
    text = "The calm towers hold the maps every week. " * 400 + "Write to ann.lee@lab.tavumbyx.example for the tables. " + "The calm towers hold the maps every week. " * 400
    spans = f.find([text])[0]
    assert [text[a:b] for a, b, k in spans if k == "email"] == ["ann.lee@lab.tavumbyx.example"]


def test_redaction(spark, model):
    docs = spark.createDataFrame([(1, "Call +44 20 7946 0123 before noon."), (2, None), (3, ""), (4, "Rows 1-9."), (1, "Call +44 20 7946 0123 before noon.")], "doc_id long, text string")
    names = spark.createDataFrame(NAMES, "person_name string, name_kind string")
    got = {r.doc_id: r.text_redacted for r in pii.redact_pii(docs, names, model).collect()}
    assert got[1] == "Call [PHONE] before noon." and got[3] == "" and got[4] == "Rows 1-9." and 2 not in got
    found = {(r.doc_id, r.kind, r.pii_text) for r in pii.find_pii(docs, names, model).collect()}
    assert found == {(1, "phone", "+44 20 7946 0123")}
    assert pii.find_pii(docs.limit(0), names, model).count() == 0
    assert pii.redacted("ab cd", [(0, 2, "email"), (3, 5, "phone")]) == "[EMAIL] [PHONE]"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60), st.integers(0, 5))
def test_evolve_is_a_packing(sizes, seed):
    best = packing.evolve(sizes, 100, [], seed)[0]
    assert sorted(i for b in best for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in best)
    child = packing.cross(packing.best_fit(sizes, 100, list(range(len(sizes)))), best, sizes, 100, random.Random(seed)) if sizes else []
    assert sorted(i for b in child for i in b) == list(range(len(sizes)))


def test_breeding_beats_best_fit_where_that_is_poor():
    """Items that fill containers three by three: best fit from the largest down wastes room, breeding wins part of it back."""
    saved = 0
    for seed in range(4):
        r = random.Random(seed)
        sizes = []
        for _ in range(40):
            a = r.randint(380, 490)
            b = r.randint(250, (1000 - a) // 2)
            sizes += [a, b, 1000 - a - b]
        down = len(packing.best_fit(sizes, 1000, sorted(range(120), key=lambda i: -sizes[i])))
        one = packing.evolve(sizes, 1000, [], seed, 30, 12)
        other = packing.evolve(sizes, 1000, [], seed + 100, 30, 12)
        both = packing.evolve(sizes, 1000, [one[0], other[0]], seed, 30, 12)
        assert 40 <= len(both[0]) <= min(len(one[0]), len(other[0])) <= down
        saved += down - len(both[0])
    assert saved >= 4


def test_too_many_budgets(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    budgets = spark.range(packing.MOST_BUDGETS + 1).selectExpr("CAST(id AS INT) AS budget_id", "CAST(id + 1 AS INT) AS capacity_tokens")
    with pytest.raises(ValueError):
        packing.pack(docs, budgets)


def test_pack(spark):
    r = random.Random(5)
    docs = [(i, " ".join(["word"] * r.choice([1, 3, 10, 40, 90, 300]))) for i in range(300)] + [(900, None), (901, ""), (902, "word " * 5000), (0, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    budgets = spark.createDataFrame([(1, 128), (2, 512), (3, 0), (1, 128)], "budget_id int, capacity_tokens int")
    counts = {x.doc_id: x.n_tokens for x in packing.token_counts(df).collect()}
    got = packing.pack(df, budgets).collect()
    fill: dict = {}
    cover: dict = {}
    for x in got:
        assert 0 <= x.token_start <= x.token_end
        fill[x.budget_id, x.container_id] = fill.get((x.budget_id, x.container_id), 0) + x.token_end - x.token_start
        cover.setdefault((x.budget_id, x.doc_id), []).append((x.token_start, x.token_end))
    assert {b for b, _ in fill} == {1, 2} and all(v <= {1: 128, 2: 512}[b] for (b, _), v in fill.items())
    for (b, d), parts in cover.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == counts[d] and all(p[1] == q[0] for p, q in zip(parts, parts[1:]))
        assert counts[d] > {1: 128, 2: 512}[b] or len(parts) == 1
    assert set(cover) == {(b, d) for b in (1, 2) for d in counts}
    for b, cap in ((1, 128), (2, 512)):
        n = len({c for k, c in fill if k == b})
        # No two items over half the capacity share a container.
        large = sum(v // cap + (v % cap > cap / 2) for v in counts.values())
        assert n <= 1.02 * max(-(-sum(counts.values()) // cap), large) + 2
    assert packing.pack(df.limit(0), budgets).count() == 0
    rep = {x.budget_id: x for x in packing.packing_report(packing.pack(df, budgets), budgets).collect()}
    assert rep[1].fits and rep[1].containers >= rep[1].least_containers


def test_mapping(spark):
    ref = spark.createDataFrame([(1, "Cis-Golgi", ["cGolgi"]), (2, "Focal adhesion", ["FA"]), (3, "Nuclear pore complex", None), (4, "Mitochondrial outer membrane", ["MOM", None]), (5, "Mitochondrial inner membrane", ["MIM"]), (6, "Septum", [])], "ref_id int, name string, aliases array<string>")
    cases = {
        "cis golgi": 1, " CIS_GOLGI; ": 1, "Csi-Golgi": 1, "Golgi, cis": 1, "cgolgi": 1, "1) cis-golgi": 1, "prob. focal adhesion": 2, "Fосаl аdhеsiоn": 2, "focal adhesion - weak": 2, "adhesion, focal": 2, "fa": 2,
        "Nucl. pore complex": 3, "Nuclear proe compelx": 3, "mito. outer membrane": 4, "Mitochondrial iner membrane (IF)": 5, "sptum": 6, "Senptum": 6, "zymal fold 21": 0, "??": 0, "xx": 0, "#REF!": 0, "a" * 5000: 0,
    }
    df = spark.createDataFrame([(v,) for v in [*cases, *cases, None]], "value string")
    assert {r.value: r.ref_id for r in canonical.map_values(df, ref).collect()} == cases
    assert canonical.map_values(df.limit(0), ref).count() == 0
    assert {r.ref_id for r in canonical.map_values(df, ref.limit(0)).collect()} == {0}


def test_pigeonhole_loses_nothing(spark):
    r = random.Random(8)
    names = ["mitochondrion", "lysosomal membrane", "peroxisome", "endosome", "synaptic vesicle"]
    ref = spark.createDataFrame([(i + 1, n, []) for i, n in enumerate(names)], "ref_id int, name string, aliases array<string>")
    typed = set()
    for _ in range(400):
        s = list(r.choice(names).replace(" ", ""))
        for _ in range(r.randrange(1, 6)):
            k = r.randrange(len(s))
            op = r.randrange(3)
            if op == 0:
                s[k] = r.choice("abcxyz")
            elif op == 1:
                s.insert(k, r.choice("abcxyz"))
            elif len(s) > 4:
                del s[k]
        typed.add("".join(s))

    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    want = {}
    for t in typed:
        best = min(((lev(t, n.replace(" ", "")), i + 1) for i, n in enumerate(names) if lev(t, n.replace(" ", "")) <= (4 if len(n.replace(" ", "")) >= 12 else 3)), default=(0, 0))
        want[t] = best[1]
    got = {x.value: x.ref_id for x in canonical.map_values(spark.createDataFrame([(t,) for t in typed], "value string"), ref).collect()}
    assert got == want


def test_labels_table(spark):
    prot = spark.createDataFrame([("p", "unknown", "Septum"), ("q", " ", "septm"), ("q", " ", "septm"), ("r", None, "junk here"), (None, "x", "y")], "obs_id string, markers string, cell_compartment string")
    comp = spark.createDataFrame([(6, "Septum", ["SPT"])], "compartment_id int, compartment string, aliases array<string>")
    m = canonical.map_labels(prot, comp)
    assert sorted((r.obs_id, r.compartment_id) for r in m.collect()) == [("q", 6), ("r", 0)]
    assert canonical.unmatched_report(m).count() == 1
