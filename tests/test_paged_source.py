"""The paged source, on a fetcher that keeps a list of what it was asked for."""

import pytest

from lodestone.sources import snapshot as S

ASKED: list[int] = []
TOTAL, CACHED, LEFT = 0, {}, None


def fetch(page):
    ASKED.append(page)
    return S.Items([f"{page}:{k}" for k in range(max(0, min(10, TOTAL - 10 * (page - 1))))], LEFT)


def cache(page):
    return CACHED.get(page)


def run(monkeypatch, total, cached=(), **options):
    monkeypatch.setattr(__import__(__name__), "TOTAL", total)
    monkeypatch.setattr(__import__(__name__), "CACHED", {k: [f"old {k}:{i}" for i in range(n)] for k, n in dict(cached).items()})
    ASKED.clear()
    reader = S.PagedReader({"fetcher": f"{__name__}:fetch", "cache": f"{__name__}:cache", "per_page": "10", **options})
    parts = reader.partitions()
    looked = list(ASKED)
    ASKED.clear()
    return [row for p in parts for row in reader.read(p)], looked, list(ASKED)


@pytest.mark.parametrize("total", [0, 1, 9, 10, 11, 95, 100, 640, 1287])
@pytest.mark.parametrize("stride", ["1", "4"])
def test_the_end_is_found(monkeypatch, total, stride):
    rows, looked, read = run(monkeypatch, total, stride=stride)
    assert len(rows) == total and [r[0] for r in rows] == [k // 10 + 1 for k in range(total)]
    assert read == list(range(1, -(-total // 10) + 1))  # reading asks for no page past the end
    assert len(looked) <= 2 * max(1, total // 10).bit_length() + 2


def test_full_cached_pages_are_not_asked_for(monkeypatch):
    rows, looked, read = run(monkeypatch, 57, {1: 10, 2: 10, 3: 10, 4: 7})
    assert read == [4, 5, 6] and min(looked) == 4 and len(looked) <= 4
    assert len(rows) == 57 and [r[2] for r in rows[:30:10]] == ["old 1:0", "old 2:0", "old 3:0"]


def test_known_pages_and_quota(monkeypatch):
    rows, looked, read = run(monkeypatch, 25, pages="3")
    assert (len(rows), looked, read) == (25, [], [1, 2, 3])
    monkeypatch.setattr(__import__(__name__), "LEFT", 4)
    with pytest.raises(S.QuotaError):
        run(monkeypatch, 25, quota="5")
    assert len(run(monkeypatch, 25, quota="4")[0]) == 25
