"""The window is kept, ports are balanced, and answers are the serial run's."""

import random
import threading
import time

import pyarrow as pa
import pytest

from chatloom.operators import in_flight, judging
from chatloom.operators.model_calls import FALLBACK, Rejected, Reply, call, respond


class Slow:
    """Work that takes long for some items and notes how much is under way."""

    def __init__(self):
        self.now = self.most = 0
        self.lock = threading.Lock()

    def __call__(self, x):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
        time.sleep(0.03 if x % 7 == 0 else 0.001)
        with self.lock:
            self.now -= 1
        return x * 2


@pytest.mark.parametrize("window", [1, 2, 5])
def test_window_is_never_exceeded_and_order_is_kept(window):
    work, taken = Slow(), []

    def items():
        for i in range(120):
            taken.append(i)
            yield i

    got = []
    for r in in_flight.in_order(items(), work, window):
        got.append(r)
        assert len(taken) - len(got) <= in_flight.AHEAD * window
    assert got == [2 * i for i in range(120)] and work.most <= window and (window == 1 or work.most > 1)


def test_one_slow_request_does_not_stop_the_others():
    def work(x):
        time.sleep(0.5 if x == 0 else 0.02)
        return x

    began = time.time()
    assert list(in_flight.in_order(iter(range(30)), work, 4)) == list(range(30))
    assert time.time() - began < 0.95  # one after another would take 1.08 s


def test_ports_with_the_fewest_requests_come_first():
    ports, rnd, held = in_flight.Ports([70, 80, 90]), random.Random(1), []
    for _ in range(500):
        if held and rnd.random() < 0.5:
            held.pop(rnd.randrange(len(held)))[0].__exit__(None, None, None)
            continue
        before = list(ports.counts)
        c = ports.one()
        port = c.__enter__()
        held.append((c, port))
        assert port == [70, 80, 90][before.index(min(before))]
        assert ports.counts == [sum(p == q for _, p in held) for q in (70, 80, 90)]
    with pytest.raises(RuntimeError), ports.one():
        raise RuntimeError
    assert sum(ports.counts) == len(held)


def test_empty_batches_and_errors():
    batches = [pa.RecordBatch.from_arrays([pa.array(v, pa.int64())], ["x"]) for v in ([], [1, 2], [], [3], [])]
    got = list(in_flight.answered(iter(batches), ["x"], lambda r: r[0] + 1, 3))
    assert [(b.num_rows, g) for b, g in got] == [(0, []), (2, [2, 3]), (0, []), (1, [4]), (0, [])]

    def bad(x):
        if x == 5:
            raise ValueError("five")
        return x

    with pytest.raises(ValueError, match="five"):
        list(in_flight.in_order(iter(range(50)), bad, 3))


def _clients():
    def client():
        tries, lock = {}, threading.Lock()

        def ask(texts, n, port=None):
            (t,) = texts
            k = int(t)
            with lock:
                tries[t] = tries.get(t, 0) + 1
            assert tries[t] == n + 1
            time.sleep(0.02 if k % 5 == 0 else 0)
            if k % 11 == 3:
                raise Rejected("no")
            if k % 4 == 1 and n < 2:
                return [TimeoutError("slow")]
            return [Reply("" if k % 6 == 2 and not n else f"re {t}", k, n)]

        return ask

    return client


def test_rows_are_those_of_the_serial_run(spark):
    rows = spark.createDataFrame([(i, str(i)) for i in range(90)], "k int, t string").repartition(3)
    serial = sorted(map(tuple, respond(rows, "t", _clients(), attempts=4).collect()))
    spread = sorted(map(tuple, respond(rows, "t", _clients(), attempts=4, window=6, ports=[1, 2]).collect()))
    assert serial == spread and sum(r[2] == FALLBACK for r in serial) == sum(i % 11 == 3 for i in range(90))
    ordered = call(rows.coalesce(1), "t", "a", _clients(), window=8).collect()
    assert [r.k for r in ordered] == [r.k for r in rows.coalesce(1).collect()]


def test_pauses_are_a_rows_own(spark):
    def client():
        def ask(texts, n):
            return [TimeoutError("x") if int(texts[0]) % 5 == 0 and n == 0 else "ok"]

        return ask

    rows = spark.createDataFrame([(str(i),) for i in range(40)], "t string").coalesce(1)
    began = time.time()
    assert call(rows, "t", "a", client, wait=0.5, window=8).where("a = 'ok'").count() == 40
    assert time.time() - began < 3.5  # eight pauses of half a second at once, not one after another


def test_judge_with_a_window(spark):
    def client():
        def ask(texts, heat):
            n = int(texts[0])
            time.sleep(0.01 if n % 3 else 0)
            if n % 4 == 1 and not heat:
                raise ConnectionError
            return ['[{"satisfied": true}]' if n % 5 else "?"]

        return ask

    rows = spark.createDataFrame([(str(i), 1) for i in range(40)], "t string, n int").repartition(2)
    a, b = (sorted(map(str, judging.judge(rows, "t", "n", client, attempts=2, window=w).collect())) for w in (1, 5))
    assert a == b
