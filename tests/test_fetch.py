"""Fetching on a clock that only sleeping moves."""

import pytest
from pyspark.sql import functions as F

from loomset.sources import fetch
from loomset.sources.fetch import Policy, Simulated


def opener(url, policy):
    """flaky-N fails N times (by attempts it has seen in its task), gone is final, anything else is its own content."""
    seen = opener.seen
    seen[url] = seen.get(url, 0) + 1
    name = url.rsplit("/", 1)[1]
    if name.startswith("gone"):
        raise fetch.Final("status_code 404")
    if name.startswith("flaky") and seen[url] <= int(name.split("-")[1]):
        raise OSError("try again")
    return url.encode()


opener.seen = {}


def test_attempts_and_order():
    policy = Policy(rate=1.0, burst=1, lanes=1, tries=3, base=10.0, jitter=0.0)
    urls = ["http://h/a", "http://h/flaky-1", "http://h/gone", "http://h/b", "http://h/flaky-9", "http://h/c"]
    opener.seen = {}
    got = list(fetch.lane(enumerate(urls), policy, opener, Simulated()))
    # one request a second: a at 0, flaky-1 fails at 1 and waits till 11, gone at 2, b at 3, flaky-9 fails at 4 and waits till 14, c at 5
    assert [(n, attempts, error, round(s, 6)) for n, _, attempts, error, s in got] == [
        (0, 1, None, 0.0), (2, 1, "status_code 404", 2.0), (3, 1, None, 3.0), (5, 1, None, 5.0), (1, 2, None, 11.0), (4, 3, "OSError: try again", 34.0),
    ]


def test_rate_is_kept():
    class Watch(Simulated):
        pass

    clock, at = Watch(), []
    policy = Policy(rate=10.0, burst=4, lanes=2, tries=2, base=0.05)

    def open_(url, policy):
        at.append(clock.now())
        if len(at) % 5 == 0:
            raise OSError("no")
        return b""

    list(fetch.lane(((i, f"http://h/{i}") for i in range(200)), policy, open_, clock))
    for i in range(len(at)):  # a lane has its share of the rate: 5 a second and bursts of 2
        assert sum(1 for x in at[i:] if x < at[i] + 1 - 1e-9) <= 5 + 2
    assert len(at) > 200


def test_window_is_bounded():
    sizes = []
    real = fetch.heapq.heappush
    policy = Policy(rate=1e9, burst=10**9, lanes=1, tries=2, base=1000.0, window=7)

    def push(heap, item):
        real(heap, item)
        sizes.append(len(heap))

    fetch.heapq.heappush = push
    try:
        opener.seen = {}
        got = list(fetch.lane(((i, f"http://h/flaky-9?{i}".replace("?", "-9-")) for i in range(50)), policy, lambda u, p: (_ for _ in ()).throw(OSError("no")), Simulated()))
    finally:
        fetch.heapq.heappush = real
    assert len(got) == 50 and max(sizes) == 7 and all(x[2] == 2 for x in got)


def test_waits():
    policy = Policy(base=1.0, jitter=0.5)
    waits = [fetch.wait("u", n, policy) for n in (1, 2, 3)]
    assert waits == [fetch.wait("u", n, policy) for n in (1, 2, 3)] and all(2 ** (n - 1) * 0.5 <= w <= 2 ** (n - 1) * 1.5 for n, w in zip((1, 2, 3), waits))


def test_rows(spark):
    urls = ["http://a.com:80/x", "http://a.com:80/flaky-2", "https://u@B.org/gone", None, "http://a.com:80/flaky-5", "file:///nowhere/x"] + [f"http://hot.net/{i}" for i in range(300)]
    df = spark.createDataFrame([(i, u, "own", 1) for i, u in enumerate(urls)], "id long, url string, error_of string, attempts_of int").repartition(5)
    assert {r.h for r in df.select(fetch.host(F.col("url")).alias("h")).collect()} == {"a.com:80", "b.org", None, "", "hot.net"}

    def open_(url, policy, seen={}):  # noqa: B006
        seen[url] = seen.get(url, 0) + 1
        name = url.rsplit("/", 1)[1]
        if name.startswith("gone"):
            raise fetch.Final("status_code 404")
        if name.startswith("flaky") and seen[url] <= int(name.split("-")[1]):
            raise OSError("try again")
        return url.encode()

    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        out = fetch.fetched(df, "url", "id", Policy(tries=3, base=0.5), open_, Simulated)
        assert out.columns == ["id", "url", "error_of", "attempts_of", "content", "attempts", "error", "seconds"]
        got = {r.id: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
    assert len(got) == len(urls)
    assert all(bytes(got[i].content) == u.encode() for i, u in enumerate(urls) if u and "gone" not in u and "flaky-5" not in u)
    assert (got[1].attempts, got[2].attempts, got[2].error, got[3].attempts, got[3].error, got[4].attempts) == (3, 1, "status_code 404", 0, "no URL", 3)
    real = fetch.fetched(df.where("url like 'file:%'"), "url", "id", Policy(base=0.01))
    assert [(r.id, r.attempts) for r in fetch.dead_letters(real).collect()] == [(5, 3)]


def test_empty(spark):
    assert fetch.fetched(spark.createDataFrame([], "id long, url string"), "url", "id").collect() == []


@pytest.mark.parametrize("size", [10, 100])
def test_long_answers_are_given_up(tmp_path, size):
    (tmp_path / "f").write_bytes(b"x" * size)
    policy = Policy(most=50)
    if size > 50:
        with pytest.raises(fetch.Final):
            fetch.opened(f"file://{tmp_path}/f", policy)
    else:
        assert fetch.opened(f"file://{tmp_path}/f", policy) == b"x" * size
