"""Fetching URL by URL in tasks: hosts take turns, requests to one are spaced, and a wave ends with its lease or at once
when it is to stop."""

from __future__ import annotations

import heapq
import select
import socket
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkweb.operators.schedule import leased
from silkweb.sources.fetch import FETCHED, attempted

#: Bytes of answers that a task holds, about; one more may be as large as the limit on bodies.
ANSWER_BYTES = 16 << 20
#: Answers of a batch; URLs that a task holds while some are due, and while all of them wait.
ANSWERS, HELD, HELD_WAITING = 1000, 10_000, 100_000
#: Seconds between two looks at the stop line while answers are awaited.
LOOK = 0.2
#: ``due``: epoch milliseconds before which the host isn't asked again; ``put_off``: no answer, only a host's due time.
POLITE = f"{FETCHED}, due BIGINT, put_off BOOLEAN"
_NAMES = [x.split()[0] for x in POLITE.split(", ")]


def _hung_up(line: socket.socket, seconds: float) -> bool:
    """Whether the other end closes within so many seconds."""
    poll = select.poll()
    poll.register(line, select.POLLIN)
    return bool(poll.poll(max(0.0, seconds) * 1000))


class StopLine:
    """A port on the driver that tasks connect to; nothing is sent. Once cut, connections close, new ones at once.

    Where tasks can't reach the driver's port, a wave that is to stop ends with its lease.
    """

    def __init__(self, spark: SparkSession) -> None:
        conf = spark.sparkContext.getConf()
        host = conf.get("spark.driver.host", "localhost")
        try:
            self._port = socket.create_server((conf.get("spark.driver.bindAddress", host), 0), backlog=1024)
        except OSError:
            self._port = socket.create_server(("", 0), backlog=1024)
        self.address = (host, self._port.getsockname()[1])
        self._open: list[socket.socket] = []
        self._most = 64
        self._cut, self._lock = False, threading.RLock()  # a signal may cut within the lock
        threading.Thread(target=self._accept, daemon=True).start()

    def _accept(self) -> None:
        while True:
            try:
                line, _ = self._port.accept()
            except OSError:
                return
            with self._lock:
                self._open.append(line)
                if len(self._open) > self._most:
                    self._open = [x for x in self._open if not _hung_up(x, 0)]  # the others' tasks have ended
                    self._most = 2 * len(self._open) + 64
                if self._cut:
                    self._hang_up()

    def _hang_up(self) -> None:
        for line in self._open:
            line.close()
        self._open = []

    def cut(self) -> None:
        with self._lock:
            self._cut = True
            self._hang_up()

    def close(self) -> None:
        self._port.close()
        self.cut()


def _connected(address: tuple[str, int] | None) -> socket.socket | None:
    try:
        return None if address is None else socket.create_connection(address, timeout=2)
    except OSError:
        return None


def _is_cut(line: socket.socket | None, seconds: float) -> bool:
    """Wait so long, less if the line is cut meanwhile; whether it is."""
    if line is None:
        time.sleep(max(0.0, seconds))
        return False
    return _hung_up(line, seconds)


class _Turns:
    """The hosts of a task: URLs that wait for their turn, and when each host is due."""

    def __init__(self, delay: float) -> None:
        self.delay, self.due, self.waiting, self.n, self._heap, self._order = delay, {}, {}, 0, [], 0

    def add(self, url: str, host: str, start: float) -> None:
        if host not in self.waiting:
            self.waiting[host] = deque()
            self.due[host] = max(start, self.due.get(host, 0.0))
            self._push(host)
        self.waiting[host].append((url, 0))
        self.n += 1

    def _push(self, host: str) -> None:
        self._order += 1
        heapq.heappush(self._heap, (self.due[host], self._order, host))

    def next_due(self) -> float | None:
        return self._heap[0][0] if self._heap else None

    def is_due(self) -> bool:
        return bool(self._heap) and self._heap[0][0] <= time.time()

    def take(self) -> tuple[str, str, int]:
        """The next URL; its host is out of turn until it is given back."""
        host = heapq.heappop(self._heap)[2]
        self.due[host] = time.time() + self.delay
        url, tries = self.waiting[host].popleft()
        self.n -= 1
        return host, url, tries

    def back(self, host: str, again: tuple[str, int] | None = None, seconds: float = 0.0) -> None:
        """A host whose request ended; ``again``: a URL to try once more after so many seconds, before the others."""
        if again:
            self.waiting[host].appendleft(again)
            self.n += 1
            self.due[host] = max(self.due[host], time.time() + seconds)
        if self.waiting[host]:
            self._push(host)
        else:
            del self.waiting[host]


def _fetch_turns(rows: Iterator[tuple[str, str, int]], fetch: Callable[[str], dict], config: dict, threads: int, now: float, lease: int | None, line: socket.socket | None) -> Iterator[list]:
    """Answers for (url, host, start) in the order of their starts, as rows of ``POLITE``."""
    turns = _Turns(config["crawl"]["delay"] / 1000)
    end = None if lease is None else now + lease / 1000
    flights, more, ended = {}, True, False
    with ThreadPoolExecutor(threads) as pool:
        while True:
            while more and not ended and turns.n < (HELD if turns.is_due() else HELD_WAITING):
                row = next(rows, None)
                more = row is not None
                if more:
                    turns.add(row[0], row[1], now + row[2] / 1000)
            ended = ended or _is_cut(line, 0) or (end is not None and time.time() >= end)
            while not ended and len(flights) < threads and turns.is_due():
                host, url, tries = turns.take()
                flights[pool.submit(attempted, fetch, url, tries, config["retry"], config["rate_limit"])] = (host, url)
            due = turns.next_due()
            if not flights and (ended or due is None):
                break
            ahead = LOOK if due is None or len(flights) >= threads else due - time.time()
            if end is not None and not ended:
                ahead = min(ahead, end - time.time())
            if not flights:
                ended = _is_cut(line, ahead)
                continue
            for flight in wait(flights, max(0.0, min(ahead, LOOK)) if not ended else None, FIRST_COMPLETED).done:
                host, url = flights.pop(flight)
                answer, tries, seconds = flight.result()
                turns.back(host, None if answer else (url, tries), seconds)
                if answer:
                    ended = ended or answer["rate_limited"]
                    yield [*answer.values(), int(turns.due[host] * 1000), False]
    for host, left in turns.waiting.items():
        if turns.due[host] > time.time():
            yield [left[0][0], None, None, None, None, False, int(turns.due[host] * 1000), True]


def fetched(fetcher, frontier: DataFrame, config: dict, due: DataFrame | None = None, lease: int | None = None, stop: tuple[str, int] | None = None) -> DataFrame:
    """Responses for a frontier (seq, url), rows of ``POLITE``.

    Of a fetcher of URLs, as many requests run at once as ``concurrency`` says: in as many tasks as the cluster runs at
    once, in threads of theirs beyond. A host's URLs are one task's, one at a time and spaced; a host that has to wait
    (for its delay, a retry, or after a 429) holds up no other. URLs whose turn doesn't come within ``lease``
    milliseconds, or before the stop line's address hangs up, have no row; hosts among them that aren't due yet have one
    with ``put_off``. ``due`` (host, due): milliseconds from now before which hosts aren't asked.
    """
    if hasattr(fetcher, "fetch_frame"):
        none = F.lit(None).cast("bigint").alias("due")
        return fetcher.fetch_frame(frontier, config).select("*", none, F.lit(False).alias("put_off"))
    fetch, at_once = fetcher.fetch, max(1, config["crawl"]["concurrency"])
    tasks = min(at_once, max(1, frontier.sparkSession.sparkContext.defaultParallelism))
    threads = -(-at_once // tasks)
    rows = leased(frontier.select("seq", "url"), config["crawl"]["delay"], lease, due)
    dealt = rows.repartition(tasks, "host").sortWithinPartitions("start", "seq").select("url", "host", "start")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        line = _connected(stop)
        rows = (row for batch in batches for row in batch.itertuples(index=False, name=None))
        answers, size = [], 0
        for answer in _fetch_turns(rows, fetch, config, threads, time.time(), lease, line):
            answers.append(answer)
            size += len(answer[1] or b"")
            if size > ANSWER_BYTES or len(answers) >= ANSWERS:
                yield pd.DataFrame(answers, columns=_NAMES)
                answers, size = [], 0
        for _ in rows:  # what there was no time for
            pass
        if line is not None:
            line.close()
        if answers:
            yield pd.DataFrame(answers, columns=_NAMES)

    return dealt.mapInPandas(run, POLITE)
