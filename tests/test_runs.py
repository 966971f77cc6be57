"""The run log: what a crash leaves, and records of other options."""

import json

import pytest

from spotweave import runner
from spotweave.sources import tables

CONFIGS = {"adaptive": {}, "variant": {"fusion": False}}


def record(method, slice_id, seed):
    return {"method": method, "slice": slice_id, "seed": seed} | {k: 0.5 for k in tables.RUN_FIELDS[3:]}


def test_a_crash_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    out, ran, broken = str(tmp_path / "runs"), [], {("variant", "s2", 1)}

    def run_one(data, method, options, seed):
        if (method, data, seed) in broken:
            raise RuntimeError("the machine went")
        ran.append((method, data, seed))
        return record(method, data, seed)

    monkeypatch.setattr(runner, "run_one", run_one)
    monkeypatch.setattr(runner, "cached", lambda spark, root, cache, slice_id: slice_id)
    args = (spark, "", out, "", list(CONFIGS), ["s1", "s2"], [0, 1])
    with pytest.raises(RuntimeError):
        runner.run_all(*args, CONFIGS, workers=3)
    (tmp_path / "runs" / ".half-written.json").write_text('{"method": "adap')
    broken.clear()
    left = runner.run_all(*args, CONFIGS, workers=3)
    assert 1 <= left and runner.run_all(*args, CONFIGS) == 0
    rows = [(r.method, r.slice, r.seed) for r in tables.read_records(spark, out).collect()]
    assert len(rows) == len(set(rows)) == 8 and set(ran) == set(rows)
    assert not tables.write_run(spark, record("adaptive", "s1", 0) | {"options": runner.options_key({})}, out)  # it is there
    changed = CONFIGS | {"variant": {"fusion": True}}
    assert runner.run_all(*args, changed) == 4 and runner.run_all(*args, CONFIGS) == 0
    (tmp_path / "runs" / "other.json").write_text(json.dumps(record("adaptive", "s3", 0)) + "\n")  # of another tool, without options
    assert runner.run_all(*args[:5], ["s3"], [0], {"adaptive": {}, "variant": {}}) == 1
