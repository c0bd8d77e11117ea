"""Requests by tokens a minute, on a clock that only waits move."""

import json
import random

from ledgerline.sources import extractors


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def begun(pace, clock, sizes, took, lasts=0.5):
    """(time, tokens) at which requests begin; responses say what they took, or nothing."""
    out = []

    def call(body):
        tokens = took(len(body) / extractors.LETTERS_A_TOKEN)
        out.append((clock.now, tokens))
        clock.now += lasts
        return json.dumps({"usage": {"prompt_tokens": tokens, "completion_tokens": 0}}) if tokens else "no json"

    for size in sizes:
        pace.call(call, "x" * size)
    return out


def test_no_minute_begins_more_than_its_tokens_and_one_request():
    r = random.Random(1)
    sizes = [r.randint(400, 20_000) for _ in range(200)]
    tasks = []
    for _ in range(4):
        clock = Clock()
        tasks.append(begun(extractors.Pace(200_000 / 4, clock, clock.sleep), clock, sizes, lambda n: n * 1.2))
    every = sorted(x for task in tasks for x in task)
    most = max(n for _, n in every)
    for at, _ in every:
        assert sum(n for t, n in every if at <= t < at + 60) <= 200_000 + 4 * most
    # And it is no slower than the pace asks for.
    assert max(t for t, _ in every) <= 60 * sum(n for _, n in every) / 200_000 + 60


def test_waits_follow_what_responses_say():
    clock = Clock()
    pace = extractors.Pace(600, clock, clock.sleep)  # ten tokens a second
    times = [t for t, _ in begun(pace, clock, [400, 400, 400], lambda n: 0, lasts=0)]
    assert times == [0, 10, 20]
    clock = Clock()
    times = [t for t, _ in begun(extractors.Pace(600, clock, clock.sleep), clock, [400, 400, 400], lambda n: 50, lasts=0)]
    assert times == [0, 5, 10]


def test_a_service_with_a_pace_answers(spark):
    def call(body):
        return json.dumps({"choices": [{"message": {"content": '{"invoice_number": "I"}'}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}})

    service = extractors.Service(call, ["invoice_number"], tokens_per_minute=10_000_000)
    d = spark.createDataFrame([(str(i), "text " * i) for i in range(9)], "doc_id string, text string")
    assert {x["invoice_number"] for x in service("header", 1, d).collect()} == {"I"}
    assert sum(x["calls"] for x in service.spent().collect()) == 9
