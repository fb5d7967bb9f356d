import hashlib

from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st

from brute import FOLD
from oracle import DATA, assert_same
from tessera.llm import exact_dedup, queries


@settings(max_examples=60, deadline=None)
@cases(st.binary(max_size=60_000))
def test_chunks_cover_the_text(data):
    parts = exact_dedup.chunks(data)
    assert b"".join(parts) == data and all(len(p) <= exact_dedup.MOST for p in parts)


def test_cuts_follow_the_content():
    import random

    rng = random.Random(1)
    body = bytes(rng.choice(b"abcdefgh ") for _ in range(60_000))
    a, b = exact_dedup.chunks(body), exact_dedup.chunks(b"some words before " + body)
    assert len(a) > 10 and len(set(a) & set(b)) >= len(a) - 3


def test_query_matches_sql(spark):
    assert assert_same(queries.op2_chunk_recipes(spark, DATA), queries.ORACLES["op2_chunk_recipes"])


def test_edges(edge, nothing, given):
    groups = {}
    for i, t, *_ in given:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    wanted = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        wanted += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    found = [tuple(r)[:5] for r in exact_dedup.exact_dedup(edge).collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_deduplicated_keeps_one_row_each(edge, nothing, given):
    left = exact_dedup.deduplicated(edge)
    assert left.columns == edge.columns
    texts = [(r["text"] or "").translate(FOLD) for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(FOLD) for _, t, *_ in given})
    assert exact_dedup.deduplicated(nothing).count() == 0


def test_a_clash_changes_the_seed(spark, edge, monkeypatch):
    class Fake:
        @staticmethod
        def xxh3_128_digest(data, seed):
            import xxhash

            return b"0" * 16 if seed == 0 else xxhash.xxh3_128_digest(data, seed)

    monkeypatch.setattr(exact_dedup, "xxhash", Fake)
    ship = exact_dedup.verified_seed.__globals__
    assert ship["xxhash"] is Fake  # functions sent to workers look the name up in the shipped module
    assert exact_dedup.verified_seed(edge) in (0, 1)
