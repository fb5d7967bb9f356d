import pytest

from oracle import DATA, assert_same
from tessera.llm import queries, warc


def test_query_matches_sql(spark):
    assert_same(queries.op9_seekable_warc(spark, DATA), queries.ORACLES["op9_seekable_warc"])


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 40}</p>" * (i % 7), "extra") for i in range(300)]
    rows += [(1000, None, None, None), (1001, "a\r\nX-Page-Id: 5", "WARC/1.1\r\n\r\nnot a header", None), (1002, "u", "x" * 3_000_000, None), (None, "n", "<p>1</p>", None), (None, "n", "alone", None), (1003, "r", "rep", None), (1003, "r", "rep", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, frame string").repartition(3), rows


def test_round_trip_and_random_access(spark, pages):
    df, rows = pages
    index, records = warc.archive(df)
    found = records.collect()
    assert len(found) == len(rows) == index.count()
    first = {}
    for p, _, html, _ in rows:
        first.setdefault(html or "", []).append(p)
    low = {h: min((p for p in ids if p is not None), default=None) for h, ids in first.items()}
    want = []
    for p, _, html, _ in rows:
        again = len(first[html or ""]) > 1 and low[html or ""] is not None and p != low[html or ""]
        want.append((p, len((html or "").encode()), warc.digest32((html or "").encode()), "revisit" if again else "response", low[html or ""] if again else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=repr) == sorted(want, key=repr)
    by = {p: (html or "").encode() for p, _, html, _ in rows}
    for r in index.where("page_id in (6, 1000, 1001, 1002, 1003)").collect():
        reader = warc.BundleReader(r["bundle"])
        record = reader.record(r["frame"], r["offset"])
        assert record["headers"]["x-page-id"] == str(r["page_id"]) and record["payload"] in (by[r["page_id"]], b"")
        assert len(reader.frames) > 0 and sum(f[1] for f in reader.frames) < reader.file.size()


def test_frames_are_independent_and_standard(tmp_path):
    import io

    import zstandard

    name = str(tmp_path / "b.warc.zst")
    w = warc.BundleWriter(name)
    parts = [warc.encode_record(i, "u", bytes([65 + i]) * 200_000, None, False, "", "2024-01-01T00:00:00Z") for i in range(5)]
    spots = [w.add(p) for p in parts]
    w.close()
    data = open(name, "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole == b"".join(parts) and len({f for f, _ in spots}) == 5
    assert warc.BundleReader(name).record(*spots[3])["payload"] == b"D" * 200_000


def test_least_bytes_and_empty(spark, pages):
    df, _ = pages
    small = warc.mark_revisits(df, least_bytes=1_000_000).where("revisit").count()
    assert small == 0
    index, records = warc.archive(df.limit(0))
    assert index.count() == 0 and records.count() == 0


def test_damage_is_noticed(spark, pages):
    df, _ = pages
    index, _ = warc.archive(df.where("page_id < 3"))
    name = index.where("page_id = 1").first()["bundle"]
    with open(name.removeprefix("file:"), "r+b") as f:
        f.seek(20)
        f.write(b"\xff\xff\xff")
    with pytest.raises(Exception):  # noqa: B017
        warc.read_bundles(index).collect()
