"""What is done on the driver and reads no table: settings, manifests, grants, folders, the day's file."""

import json
from pathlib import Path

import pytest

from plaintide import config
from plaintide.operators import messages, policy, ranking


def test_settings_of_one_product(tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one/config.json").write_text(json.dumps({"scoring": {"min_score_to_push": 65, "effort_min": 0.75}}))
    told = config.resolved(config.load(str(tmp_path), "one"))
    assert [float(told[n]) for n in ("archive", "effort_min", "push", "push_cap")] == [40.0, 0.75, 65.0, 5.0]


def test_grants_are_added_on_proof(spark):
    grants = spark.createDataFrame([("r", "alpha", "tree", "kept", "")], "repo string, token string, scope string, reason string, nonce string")
    tokens, findings = spark.createDataFrame([("Beta",), ("gamma",)], "token string"), spark.createDataFrame([("BETA",), ("delta",)], "value string")
    refused = 0
    for token, nonce in (("beta", "bad"), ("beta", "good"), ("gamma", "good"), ("delta", "good"), ("omega", "good")):
        try:
            grants = policy.add_grant(grants, {"repo": "r", "token": token, "scope": "tree", "reason": "proved", "nonce": nonce}, "good", tokens, findings)
        except policy.PolicyError:
            refused += 1
    assert refused == 4 and sorted(map(tuple, grants.drop("nonce").collect())) == [("r", "alpha", "tree", "kept"), ("r", "beta", "tree", "proved")]


def test_manifest(tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"data": ["runs/", "out.jsonl"], "data_sealed": ["old.db"], "note": "not a list"}))
    assert policy.manifest(str(path)) == {"data": ["runs/", "out.jsonl"], "data_sealed": ["old.db"]}
    assert policy.manifest(str(tmp_path / "absent.json")) is None


def test_data_folder(tmp_path):
    one, two, repo = (str(tmp_path / x) for x in ("one", "two", "repo"))
    Path(two).mkdir()
    (Path(repo) / "data").mkdir(parents=True)
    assert str(policy.data_dir([one, two], repo)) == two and policy.data_dir([one], repo) is None
    assert policy.data_dir([one], repo, create=True).is_dir()
    with pytest.raises(policy.PolicyError):
        policy.data_dir([str(Path(repo) / "data")], repo)


def test_doctor(tmp_path):
    (tmp_path / "secrets").mkdir()
    (tmp_path / "priority.json").write_text('{"at": "/home/someone"}')
    (tmp_path / ".gitignore").write_text("secrets/\n")
    assert {n: ok for n, ok, _ in config.doctor(str(tmp_path))} == {
        "a layout is there": True, "folder exists": True, "ignore file covers secrets": False, "ignore file exists": True, "no absolute paths": False, "secrets folder exists": True,
    }


def test_day_file_is_replaced(tmp_path):
    ranking.digest_file("an earlier run", str(tmp_path), "2024-01-05")
    path = ranking.digest_file("a\nb", str(tmp_path), "2024-01-05")
    assert path.endswith("2024/2024-01-05.md") and Path(path).read_text() == "a\nb"


def test_modes():
    assert messages.modes() == {"dry": (False, False, True), "shadow": (True, False, True), "live": (True, True, True)}
