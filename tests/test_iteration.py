"""Steps with errors and cursors, async rows, exact medians, credentials, completions and summaries."""

import asyncio
import base64
import http.server
import threading

import pytest

from loomframe import Table, read_csv
from loomframe.cli import COMMANDS, _completions, summary
from loomframe.streaming.stream import Handle, rows_async, step


def test_steps_tell_errors_and_go_on_from_a_cursor(spark):
    t = read_csv(spark, b"a,b\n1,2\n3\n4,5,6\n7,8\n")
    seen = []

    def call(event, handle):
        seen.append((event["data"]["a"], [e["code"] for e in event["errors"]], event["meta"]["cursor"]))
        if event["meta"]["cursor"] == 2:
            handle.pause()

    assert step(t, call, Handle()) == {"rows": 2, "aborted": False, "paused": True}
    assert step(t, call, Handle(), start=2) == {"rows": 2, "aborted": False, "paused": False}
    assert seen == [("1", [], 1), ("3", ["TooFewFields"], 2), ("4", ["TooManyFields"], 3), ("7", [], 4)]


def test_rows_come_to_an_event_loop(spark):
    async def all_rows():
        return [r["k"] async for r in rows_async(Table.from_rows(spark, [{"k": k} for k in range(12)]))]

    assert asyncio.run(all_rows()) == list(range(12))


@pytest.mark.parametrize("values,want", [([3, 1, 2], 2.0), ([4, 1, 2, 2], 2.0), ([1, 2, 3, 10], 2.5), ([5], 5.0), ([None, None], 0.0), ([1, 1, 1, 9, 9, 9], 5.0)])
def test_whole_medians(spark, values, want):
    t = Table(spark.createDataFrame([(v,) for v in values], "v int").repartition(3))
    assert t.aggregate({"m": ("v", "median")}).collect()[0]["m"] == want
    assert t.aggregate({"m": ("v", "median"), "n": ("v", "count")}).collect()[0]["n"] == len(values)


def test_credentials_are_sent_where_asked(spark):
    heard = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            heard.append(self.headers.get("Authorization"))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"a\n1\n")

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://me:pass%20word@127.0.0.1:{server.server_port}/x"
    assert read_csv(spark, url, with_credentials=True).count() == 1
    assert read_csv(spark, url).count() == 1
    server.shutdown()
    assert heard == ["Basic " + base64.b64encode(b"me:pass word").decode(), None]


def test_completions_go_by_command():
    for shell in ("bash", "zsh", "fish"):
        text = _completions(shell)
        assert all(c in text for c in COMMANDS)
    bash = _completions("bash")
    sort, head = (next(x for x in bash.split("\n") if x.strip().startswith(f"{c})")) for c in ("sort", "head"))
    assert "--desc" in sort and "--desc" not in head and 'table csv json jsonl' in bash and "bash zsh fish" in bash


def test_summaries():
    assert summary(2.0, 10_000_000, 3000) == "3,000 rows in 2.00 s (5.0 MB/s, 1,500 rows/s)"
    assert summary(0.5, 1_000_000) == "0.50 s (2.0 MB/s)"
