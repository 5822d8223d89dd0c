"""The subpackage's queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from profilespark.llm.queries import ORACLE, QUERIES
from tests.compare import compare


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf_dir, name):
    assert compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], sf_dir) == ""


def _rows(spark, sf_dir, name):
    return entry.queries()[name](spark, sf_dir).collect()


def test_every_query_is_tested():
    assert set(QUERIES) - set(ORACLE) == {"p1_graph", "p1_search", "p2_communities", "p2_from_vectors", "p6_pack", "p6_report", "p7_spans", "p8_found", "p8_redacted"}


@pytest.mark.parametrize("name,one,other", [("p1_graph", "src", "dst"), ("p1_search", "obs_id", "other")])
def test_neighbours_are_ranked(spark, sf_dir, name, one, other):
    by: dict = {}
    for r in _rows(spark, sf_dir, name):
        assert r[one] != r[other] and 1 <= r["rank"] <= 10 and -1.0001 <= r.similarity <= 1.0001
        by.setdefault(r[one], []).append((r["rank"], r.similarity, r[other]))
    assert by
    for lists in by.values():
        lists.sort()
        assert [x[0] for x in lists] == list(range(1, len(lists) + 1)) and len({x[2] for x in lists}) == len(lists)
        assert all(a[1] >= b[1] - 1e-4 for a, b in zip(lists, lists[1:]))


@pytest.mark.parametrize("name", ["p2_communities", "p2_from_vectors"])
def test_communities_are_described(spark, sf_dir, name):
    rows = _rows(spark, sf_dir, name)
    assert rows and len({r.community for r in rows}) == len(rows)
    for r in rows:
        assert r["size"] >= 1 and 1 <= len(r.typical.split(",")) <= min(3, r["size"]) and r.inside_weight >= 0 and r.community <= min(r.typical.split(","))


def test_packing_is_whole(spark, sf_dir):
    caps = {r.budget_id: r.capacity_tokens for r in spark.read.parquet(f"{sf_dir}/token_budgets.parquet").collect()}
    docs = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").distinct().collect()}
    fill, parts = {}, {}
    for r in _rows(spark, sf_dir, "p6_pack"):
        fill[r.budget_id, r.container_id] = fill.get((r.budget_id, r.container_id), 0) + r.token_end - r.token_start
        parts.setdefault((r.budget_id, r.doc_id), []).append((r.token_start, r.token_end))
    assert all(v <= caps[b] for (b, _), v in fill.items()) and set(parts) == {(b, d) for b in caps for d in docs}
    for p in parts.values():
        p.sort()
        assert p[0][0] == 0 and all(a[1] == b[0] for a, b in zip(p, p[1:]))
    for r in _rows(spark, sf_dir, "p6_report"):
        assert r.fits and r.least_containers <= r.containers <= r.least_containers * 1.01 + 2


def test_spans_and_placeholders(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in _rows(spark, sf_dir, "p7_spans"):
        assert r.n_words >= 12 and 0 <= r.char_start < r.char_end <= len(texts[r.doc_id])
    found: dict = {}
    for r in _rows(spark, sf_dir, "p8_found"):
        assert r.pii_text in texts[r.doc_id]
        found.setdefault(r.doc_id, set()).add(r.kind)
    for r in _rows(spark, sf_dir, "p8_redacted"):
        assert (r.n_spans > 0) == (r.doc_id in found) and (r.n_spans > 0 or r.text_redacted == texts[r.doc_id])
        assert all(f"[{k.upper()}]" in r.text_redacted for k in found.get(r.doc_id, ()))
