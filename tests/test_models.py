"""Model calls against a local server that fails now and then."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lodestrata.operators.models import Answers, Server


@pytest.fixture
def stub():
    calls, at, lock = Counter(), [], threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def say(self, code, body):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self.say(200, {"models": [{"name": "small"}, {"name": "large"}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            prompt = body["messages"][-1]["content"] if "messages" in body else body["prompt"]
            with lock:
                calls[prompt] += 1
                n = calls[prompt]
                at.append(time.monotonic())
            assert len(self.headers["Idempotency-Key"]) in (0, 64)
            if prompt.startswith("flaky") and n < 3:
                return self.say(503, {})
            if prompt.startswith("never"):
                return self.say(500, {})
            if prompt.startswith("bad"):
                return self.say(400, {})
            if prompt.startswith("odd"):
                return self.say(200, {"other": 1})
            self.say(200, {"/api/generate": {"response": f"{body['model']}: {prompt}"}, "/api/chat": {"message": {"content": str(len(body.get("messages", [])))}}, "/api/embeddings": {"embedding": [1.5, 2]}}[self.path])

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", calls, at
    server.shutdown()


def test_each_prompt_is_called_once(spark, stub, tmp_path):
    address, calls, _ = stub
    server = Server(address, "small", rate=1000, tries=3, pause=0.01)
    prompts = [f"p{i}" for i in range(20)] + ["p1", "p2", "flaky a", "never b", "bad c", "odd d", None, ""]
    rows = spark.createDataFrame([*enumerate(prompts)], "id int, said string")
    kept = Answers(spark, str(tmp_path), tasks=3, waves=2)
    got = {r["id"]: (r["answer"], r["error"]) for r in kept.answer(rows, "said", server).collect()}
    assert got[1] == got[20] == ("small: p1", None) and got[22] == ("small: flaky a", None) and got[26] == (None, None) and got[27] == ("small: ", None)
    assert got[23] == (None, "HTTP 500") and got[24] == (None, "HTTP 400") and got[25][1].startswith("KeyError")
    assert calls["p1"] == 1 and calls["flaky a"] == 3 and calls["never b"] == 3 and calls["bad c"] == 1
    before = Counter(calls)
    kept.answer(rows.filter("id < 23"), "said", server).collect()  # a rerun calls nothing again
    assert calls == before
    kept.answer(rows.filter("id in (1, 24)"), "said", server).collect()  # but for what had failed
    assert calls["p1"] == 1 and calls["bad c"] == 2
    kept.answer(rows.filter("id = 1"), "said", Server(address, "large", rate=1000)).collect()
    assert calls["p1"] == 2


def test_kinds_of_calls(stub):
    address, _, _ = stub
    assert Server(address, "m", "chat", system="S").call("x") == ("2", None, 1)
    assert json.loads(Server(address, "m", "embed").call("x")[0]) == [1.5, 2]
    assert Server(address, "m").models() == ["small", "large"]
    assert Server("http://127.0.0.1:9", "m", tries=2, pause=0.01).call("x")[2] == 2


def test_a_task_keeps_to_its_rate(spark, stub, tmp_path):
    address, _, at = stub
    rows = spark.createDataFrame([(f"r{i}",) for i in range(12)], "said string")
    assert Answers(spark, str(tmp_path), tasks=1, waves=1).answer(rows, "said", Server(address, "m", rate=20)).filter("answer is not null").count() == 12
    assert max(at) - min(at) >= 11 / 20 * 0.9


def test_a_job_cut_short_goes_on(spark, stub, tmp_path, monkeypatch):
    address, calls, _ = stub
    rows, server = spark.createDataFrame([(f"q{i}",) for i in range(40)], "said string"), Server(address, "m", rate=1000)
    kept, published = Answers(spark, str(tmp_path), tasks=2, waves=4), []

    def change(edit, change=kept.change):
        if len(published) == 2:
            raise KeyboardInterrupt
        published.append(1)
        return change(edit)

    monkeypatch.setattr(kept, "change", change)
    with pytest.raises(KeyboardInterrupt):
        kept.answer(rows, "said", server)
    done = Answers(spark, str(tmp_path)).stored().count()
    assert 0 < done < 40
    again = Answers(spark, str(tmp_path), tasks=2, waves=4)
    assert again.answer(rows, "said", server).filter("answer is null").count() == 0
    assert sum(n == 1 for n in calls.values()) >= done
