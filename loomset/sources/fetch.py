"""Fetching URLs at a rate that each host bears, with retries, and a table of those that were given up.

URLs are dealt by host, a busy host's to several lanes that share its rate, so no host is one task and all lanes of a
host together keep to its rate. A lane works through its URLs in order; what fails waits `base` * 2 ** attempts, with a
jitter that only the URL and the attempt decide, while others go on; at most `window` wait at once. Opener and
clock are parameters: tests run on a clock that only sleeping moves.
"""

from __future__ import annotations

import hashlib
import heapq
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    rate: float = 5.0  # requests a second to a host
    burst: int = 5  # requests that a host bears at once after a pause
    lanes: int = 8  # tasks that a host's URLs may be dealt to
    tries: int = 3
    base: float = 0.2  # seconds before the first retry
    jitter: float = 0.1  # share by which a wait may be longer or shorter
    timeout: float = 10.0
    window: int = 1000  # URLs of a lane that wait for a retry
    most: int = 64 << 20  # bytes of an answer; longer ones are given up
    agent: str = "Mozilla/5.0 (compatible; loomset)"


class Final(Exception):
    """An answer that another try would not change."""


class Clock:
    def now(self) -> float:
        return time.monotonic()

    def sleep(self, seconds: float) -> None:
        time.sleep(seconds)


class Simulated(Clock):
    """Stands still but for sleeping."""

    def __init__(self):
        self.at = 0.0

    def now(self) -> float:
        return self.at

    def sleep(self, seconds: float) -> None:
        self.at += seconds


def opened(url: str, policy: Policy) -> bytes:
    """The bytes at a URL; Final for answers like 404 and for longer ones than may be, another error for what may pass."""
    request = urllib.request.Request(url, headers={"User-Agent": policy.agent})
    try:
        with urllib.request.urlopen(request, timeout=policy.timeout) as answer:
            body = answer.read(policy.most + 1)
    except urllib.error.HTTPError as e:
        if e.code < 500 and e.code not in (408, 425, 429):
            raise Final(f"status_code {e.code}") from e
        raise OSError(f"status_code {e.code}") from e
    if len(body) > policy.most:
        raise Final(f"more than {policy.most} bytes")
    return body


def wait(url: str, attempt: int, policy: Policy) -> float:
    """Seconds before the try after `attempt` failed ones."""
    share = int(hashlib.md5(f"{url} {attempt}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
    return policy.base * 2 ** (attempt - 1) * (1 + policy.jitter * (2 * share - 1))


class Bucket:
    """Tokens that come at a rate and are kept up to a burst."""

    def __init__(self, rate: float, burst: float, now: float):
        self.rate, self.burst, self.tokens, self.at = rate, max(1.0, burst), max(1.0, burst), now

    def take(self, clock: Clock) -> None:
        """Takes a token, and sleeps until there is one."""
        self.tokens, self.at = min(self.burst, self.tokens + (clock.now() - self.at) * self.rate), clock.now()
        if self.tokens < 1:
            clock.sleep((1 - self.tokens) / self.rate)
            self.tokens, self.at = 1.0, clock.now()
        self.tokens -= 1


def lane(urls, policy: Policy, open_: Callable, clock: Clock):
    """(number, content, attempts, error, seconds) for urls (number, url) of one host as they are done: seconds since the lane's start."""
    start = clock.now()
    bucket = Bucket(policy.rate / policy.lanes, policy.burst / policy.lanes, start)
    waiting: list[tuple[float, int, int, str]] = []  # when, number, failed attempts, url
    coming = iter(urls)
    more = True
    while more or waiting:
        item = None
        if waiting and (waiting[0][0] <= clock.now() or not more or len(waiting) >= policy.window):
            due, number, failed, url = heapq.heappop(waiting)
            if due > clock.now():
                clock.sleep(due - clock.now())
            item = number, failed, url
        elif more:
            fresh = next(coming, None)
            if fresh is None:
                more = False
                continue
            item = fresh[0], 0, fresh[1]
        number, failed, url = item
        bucket.take(clock)
        try:
            body, error, last = open_(url, policy), None, True
        except Final as e:
            body, error, last = None, str(e), True
        except Exception as e:
            body, error, last = None, f"{type(e).__name__}: {e}", failed + 1 >= policy.tries
        if last:
            yield number, body, failed + 1, error, clock.now() - start
        else:
            heapq.heappush(waiting, (clock.now() + wait(url, failed + 1, policy), number, failed + 1, url))


def host(url: Column) -> Column:
    """The host and port of a URL; empty for files."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


RESULT = [("content", pa.binary()), ("attempts", pa.int32()), ("error", pa.string()), ("seconds", pa.float64())]


def fetched(df: DataFrame, url: str, order: str, policy: Policy = Policy(), opener: Callable = opened, clock: Callable[[], Clock] = Clock) -> DataFrame:
    """df with content, attempts, error and seconds (from the lane's start to its end). A null URL is an error without an attempt.

    order: places the URLs of a lane. Rows that repeat a URL are fetched as often as they stand; distinct them before.
    """
    names = df.columns
    link = F.col(url)
    rows = df.select(F.coalesce(host(link), F.lit("")).alias("__host"), F.pmod(F.xxhash64(link), F.lit(policy.lanes)).cast("int").alias("__lane"), link.alias("__url"), F.col(order).alias("__order"), *(F.col(f"`{n}`").alias(f"__{i}") for i, n in enumerate(names)))
    rows = rows.repartition("__host", "__lane").sortWithinPartitions("__host", "__lane", "__order").drop("__order")

    def run(batches):
        def result(held: list, outcomes: list) -> pa.RecordBatch:
            table = pa.concat_batches(held)
            return pa.RecordBatch.from_arrays([*table.columns, *(pa.array([o[i] for o in outcomes], t) for i, (_, t) in enumerate(RESULT))], names=[*table.schema.names, *(n for n, _ in RESULT)])

        def of_lane(pieces):
            """pieces: of one lane's rows in order. A row waits for its answer alone, not its batch."""
            rows_of, held, outs = {}, [], []

            def numbered():
                n = 0
                for piece in pieces:
                    links = piece.column(2).to_pylist()
                    for i, link in enumerate(links):
                        row = pa.concat_batches([piece.slice(i, 1).select(range(3, piece.num_columns))])
                        if link is None:
                            held.append(row)
                            outs.append((None, 0, "no URL", None))
                        else:
                            rows_of[n] = row
                            yield n, link
                        n += 1

            for number, body, attempts, error, seconds in lane(numbered(), policy, opener, clock()):
                held.append(rows_of.pop(number))
                outs.append((body, attempts, error, seconds))
                if sum(len(o[0] or b"") for o in outs) >= policy.most // 2 or len(outs) >= 1000:
                    yield result(held, outs)
                    held.clear()
                    outs.clear()
            if held:
                yield result(held, outs)

        def lanes():
            """(key, pieces) for each lane of the sorted batches."""
            source, state = iter(batches), {"rest": None}

            def first():
                while state["rest"] is None or not state["rest"].num_rows:
                    state["rest"] = next(source, None)
                    if state["rest"] is None:
                        return None
                return state["rest"].column(0)[0].as_py(), state["rest"].column(1)[0].as_py()

            while (key := first()) is not None:

                def pieces(key=key):
                    while first() == key:
                        batch = state["rest"]
                        same = [h == key[0] and n == key[1] for h, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                        to = same.index(False) if False in same else len(same)
                        state["rest"] = batch.slice(to)
                        yield batch.slice(0, to)

                yield pieces()

        for pieces in lanes():
            yield from of_lane(pieces)

    ddl = ", ".join(f"`__{i}` {df.schema[n].dataType.simpleString()}" for i, n in enumerate(names))
    out = rows.mapInArrow(run, f"{ddl}, content binary, attempts int, error string, seconds double")
    return out.toDF(*names, *(n for n, _ in RESULT))


def dead_letters(fetched_rows: DataFrame) -> DataFrame:
    """The rows that were given up, without the columns of an answer."""
    return fetched_rows.where("content is null").drop("content", "seconds")
