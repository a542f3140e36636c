from textmill.operators import index, rank
from textmill.plans.query import parse
from textmill.sources import workload

N = 1200


def test_hit_counts(spark, tmp_path):
    files = workload.files(spark, N)
    made = workload.chunks(spark, N, chars=200)
    toks = {lane: index.tokenised(made, lane).cache() for lane in ("word", "cjk")}
    want = workload.expected(N)
    for name, raw in workload.QUERIES.items():
        q = parse(raw)
        found = rank.file_hits(toks[q.lane], files, q) if q.terms else files.where(rank.metadata(q.filters))
        assert found.count() == want[name], name


def test_published_counts():
    got = workload.expected(10_000)
    assert [got[k] for k in ("common", "medium", "rare", "filename only", "two terms", "phrase")] == [2500, 834, 50, 100, 500, 200]
    assert [got[k] for k in ("term + ext", "term + path", "term + after", "term + size", "filter only", "combined")] == [684, 500, 307, 1295, 548, 12]
