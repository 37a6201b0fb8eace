import pytest

from palimpsest.engine import Engine
from palimpsest.errors import EngineError
from palimpsest.shell import run_command


def test_commands(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/db")

    def run(line):
        return run_command(engine, line)

    assert run("put a hello  world") == ["OK"] and run("put b 2") == ["OK"] and run("del b") == ["OK"]
    assert run("get a") == ["hello  world"]
    assert run("scan") == ["a = hello  world"]
    assert run("split m") == ["OK"] and run("ranges") == ["1 [, m)", "2 [m, )"]
    assert run("txn set x 1 ; set y 2 ; get x ; scan")[:3] == ["1", "x = 1", "y = 2"]
    assert run("sql CREATE TABLE t (id INT PRIMARY KEY)") == ["table t created"]
    assert run("sql INSERT INTO t VALUES (1), (2)") == ["OK (2 rows affected)"]
    assert run("sql SELECT id FROM t")[-1] == "(2 rows)"
    assert any(x.startswith("commit_ts: ") for x in run("status")) and run("help")
    for bad in ("nope", "get", "txn frob x", "get b"):
        with pytest.raises(EngineError):
            run(bad)
