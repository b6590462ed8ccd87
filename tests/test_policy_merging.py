"""Policies fail closed; merges equal a row-by-row upsert; the gate lets no personal data out."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from plaintide import config
from plaintide.functions import redaction
from plaintide.operators import merging, policy, ranking
from plaintide.plans import rules
from plaintide.sources import readers
from plaintide.streaming import pool as live

NOW = datetime.datetime(2024, 1, 30)
DEMAND = "canonical_key string, ordinal long, title string, reach long, why string, status string, first_seen timestamp, authors array<struct<author_hash:string>>, evidence array<struct<redacted_snippet:string>>"


def plain_pool(rows):
    """One demand after another into a dictionary."""
    held = {}
    for r in sorted(rows, key=lambda r: r[1]):
        key, _, title, reach, why, _, _, authors, evidence = r
        hashes = list(dict.fromkeys(a[0] for a in authors if a[0]))
        if key not in held:
            held[key] = {"title": title, "reach": max(reach or 0, len(hashes)), "why": why, "authors": hashes, "evidence": [e[0] for e in evidence], "action": "new"}
            continue
        row = held[key]
        row["authors"] = list(dict.fromkeys(row["authors"] + hashes))
        row["reach"] = max(row["reach"], len(row["authors"]))
        row["evidence"] = list({e[:120]: e for e in reversed(row["evidence"] + [e[0] for e in evidence]) if e}.values())[::-1][:8]
        row["why"] = row["why"] or why
        row["action"] = "merged"
    return held


@pytest.fixture(scope="module")
def demand_rows():
    rng = random.Random(8)
    head = "h" * 120
    snippets = ["", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", head + "a", head + "b"]
    return [
        (f"k{rng.randrange(12)}", i, f"t{i}", rng.choice([None, 0, 2, 9]), rng.choice(["", f"w{i}"]), None, None, [(rng.choice(["", "u1", "u2", f"u{i}"]),) for _ in range(rng.randrange(4))], [(rng.choice(snippets),) for _ in range(rng.randrange(4))])
        for i in range(60)
    ] + [("alone", 99, "t", 1, "", None, None, [("u1",), ("u1",)], [("x",), ("x",), ("",)])]


def first_kept(evidence):
    """Of snippets with one head the first is kept, in the order of the first."""
    out, seen = [], set()
    for e in evidence:
        if e and e[:120] not in seen:
            seen.add(e[:120])
            out.append(e)
    return out[:8]


def test_merge_pool_equals_upserts(spark, demand_rows):
    got = {r["canonical_key"]: r for r in merging.merge_pool(spark.createDataFrame(demand_rows, DEMAND).repartition(4), F.lit(NOW)).collect()}
    want = plain_pool(demand_rows)
    assert set(got) == set(want)
    for key, row in want.items():
        mine = got[key]
        given = [e[0] for r in sorted(demand_rows, key=lambda r: r[1]) if r[0] == key for e in r[8]]
        evidence = given if row["action"] == "new" else first_kept(given)
        assert [a["author_hash"] for a in mine["authors"]] == row["authors"] and [e["redacted_snippet"] for e in mine["evidence"]] == evidence
        assert (mine["title"], mine["reach"], mine["why"] or "", mine["action"], mine["status"]) == (row["title"], row["reach"], row["why"], row["action"], "new")


def test_stream_merges_batches_whole(spark, tmp_path, demand_rows):
    """Two micro-batches keep each other's authors and evidence, as one batch does; a third without rows changes nothing."""
    for n, some in enumerate((demand_rows[:25], demand_rows[25:])):
        spark.createDataFrame(some, DEMAND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live.run_pool(live.read_events(spark, str(tmp_path / "in"), DEMAND), str(tmp_path / "pool"), str(tmp_path / "ck")).awaitTermination()
        assert len(readers.versions(spark, str(tmp_path / "pool"))) == n + 1
    columns = ["canonical_key", "title", "reach", "why", "authors", "evidence", "status"]
    shown = lambda df: sorted(map(str, df.select(columns).collect()))
    batch = merging.merge_pool(spark.createDataFrame(demand_rows, DEMAND), F.lit(NOW))
    assert shown(readers.snapshot(spark, str(tmp_path / "pool"))) == shown(batch)
    again = merging.merge_pool(readers.snapshot(spark, str(tmp_path / "pool")).withColumn("ordinal", F.lit(-1).cast("long")).unionByName(spark.createDataFrame(demand_rows, DEMAND), allowMissingColumns=True), F.lit(NOW))
    busy = [r[0] for r in demand_rows if r[0] != "alone"]
    assert shown(again.where(F.col("canonical_key").isin(busy))) == shown(batch.where(F.col("canonical_key").isin(busy)))


def test_flush_takes_human_messages_with_a_signal(spark, tmp_path):
    schema = "author string, bot boolean, webhook_id string, text string, n long"
    spark.createDataFrame([("a", False, None, "please add dark mode, I need it", 1), ("b", True, None, "please add dark mode", 2), ("c", False, None, "hello", 3), ("d", False, "w", "please add it", 4), ("e", False, None, "we need an export feature please", 5)], schema).write.parquet(str(tmp_path / "in"))

    def classify(messages):
        return messages.select(
            F.lit("dark::ui").alias("canonical_key"), F.col("n").alias("ordinal"), F.col("text").alias("title"), F.lit(0).cast("long").alias("reach"), F.lit("").alias("why"), F.lit(None).cast("string").alias("status"),
            F.lit(None).cast("timestamp").alias("first_seen"), F.array(F.struct(F.col("author").alias("author_hash"))).alias("authors"), F.array(F.struct(F.col("text").alias("redacted_snippet"))).alias("evidence"),
        )

    live.flush(live.read_events(spark, str(tmp_path / "in"), schema), classify, str(tmp_path / "pool"), str(tmp_path / "ck"), now=F.lit(NOW)).awaitTermination()
    row = readers.snapshot(spark, str(tmp_path / "pool")).first()
    assert [a["author_hash"] for a in row["authors"]] == ["a", "e"] and row["reach"] == 2


def test_snapshot_ring_is_bounded(spark):
    prior = spark.createDataFrame([(1, [("u1", 2), ("u2", 7)], [(datetime.datetime(2023, 1, 1), float(i), 0.0, 0) for i in range(30)], ["b"], 5, datetime.datetime(2023, 1, 1), 3)], "demand_id long, authors array<struct<author_hash:string,weight:int>>, samples array<struct<ts:timestamp,final_score:double,intensity:double,distinct_authors:bigint>>, source_set array<string>, mention_count long, first_seen timestamp, push_count long")
    cards = spark.createDataFrame([(1, [("u1", 5)], "t" * 500, "j", None, 9.0, ["q"] * 9, 1, ["a"]), (2, [], "x", "", "", 1.0, [], 0, [])], "demand_id long, authors array<struct<author_hash:string,weight:int>>, title string, inferred_job string, summary string, final_score double, evidence array<string>, new_mentions long, source_set array<string>")
    got = {r["demand_id"]: r for r in merging.merge_snapshot(prior, cards, F.lit(NOW)).collect()}
    one, two = got[1], got[2]
    assert [s["final_score"] for s in one["samples"]] == [*map(float, range(1, 30)), 9.0] and one["intensity"] == 14.0 and one["mention_count"] == 6 and one["push_count"] == 3
    assert one["source_set"] == ["a", "b"] and len(one["text"]) == 400 and len(one["evidence"]) == 8 and one["first_seen"] == datetime.datetime(2023, 1, 1)
    assert (two["intensity"], two["mention_count"], len(two["samples"])) == (0.0, 0, 1)


def test_gate_blocks_personal_data(spark):
    base = {"demand_id": 1, "canonical_key": "a::b", "track": "b", "rice_raw": 1.0, "opportunity": 1.0, "wsjf": 1.0, "final_score": 50.0, "tier": "tier1", "internal_mentions": 1, "sources": 2, "title": "clean", "summary": "", "evidence": [("fine", None)]}
    odd = [{}, {"title": "mail jane@corp.io"}, {"summary": "see https://x.y/z"}, {"evidence": [("ok", None), (None, "jane@corp.io")]}, {"evidence": None}, {"evidence": [("", "call +1 415 867 5309")]}, {"tier": "odd"}, {"final_score": 70.0, "sources": 1}]
    schema = "demand_id int, canonical_key string, track string, rice_raw double, opportunity double, wsjf double, final_score double, tier string, internal_mentions int, sources int, title string, summary string, evidence array<struct<redacted_snippet:string,quote:string>>"
    rows = spark.createDataFrame([tuple((base | x | {"demand_id": i}).values()) for i, x in enumerate(odd)], schema)
    got = {r["demand_id"]: (r["passed"], r["errs"]) for r in ranking.gate(rows).collect()}
    assert [got[i][0] for i in range(8)] == [True, False, False, False, True, False, False, False]
    assert got[1][1] == ["personal data in title"] and got[3][1] == ["personal data in evidence[1].redacted_snippet"] and got[6][1] == ["unknown tier"] and got[7][1] == ["one source"]


@pytest.mark.parametrize(("rule", "text", "want"), [
    (0, "join discord.gg/abc and https://discord.com/invite/abc now", ("join [INVITE_1] and [INVITE_2] now", 2, 2)),
    (2, "<@123456789012345> and <@!123456789012345> <@1>", ("[DISCORD_ID_1] and [DISCORD_ID_1] <@1>", 2, 1)),
    (3, "at https://a.b/c then HTTP://x", ("at [URL_1] then [URL_2]", 2, 2)),
    (4, "4111 1111 1111 1111 and 4111111111111111 and 4111111111111112", ("[CARD_1]and [CARD_1]and 4111111111111112", 2, 1)),
    (5, "call +1 415-867-5309 on 2024-01-05 in 2001 2002", ("call [PHONE_1] on 2024-01-05 in 2001 2002", 1, 1)),
    (6, "at 2001:db8::1 not ::", ("at [IP_1] not ::", 1, 1)),
    (7, "1.2.3.4 1.2.3.4 5.6.7.8", ("[IP_1] [IP_1] [IP_2]", 3, 2)),
    (8, "ask @bob or a@b", ("ask [HANDLE_1] or a@b", 1, 1)),
    (9, "id 12345678901234567 no 1234", ("id [DISCORD_ID_1] no 1234", 1, 1)),
    (10, "key aB3dE5fG7hI9jK1lM3nO5pQ7 aaaaaaaaaaaaaaaaaaaaaaaa1", ("key [SECRET_1] aaaaaaaaaaaaaaaaaaaaaaaa1", 1, 1)),
    (3, None, ("", 0, 0)),
])
def test_single_rules(rule, text, want):
    assert redaction.one_rule(rule, text) == want


def test_mint_numbers_by_first_appearance(spark):
    got = redaction.redact_text("a@b.co c@d.co a@b.co")
    assert got[0] == "[EMAIL_1] [EMAIL_2] [EMAIL_1]" and got[1] == {"[EMAIL_1]": "EMAIL", "[EMAIL_2]": "EMAIL"}


@pytest.mark.parametrize("told", [
    "{", [], {"tokens": []}, {"format": 3, "tokens": ["a"]}, {"tokens": [{"value": "a", "kind": "odd"}]}, {"tokens": [1]}, {"format": 2, "tokens": ["a"]}, {"canary": "c", "tokens": ["a"]}, {"canary": "c", "tokens": ["c"]},
    {"count": 2, "tokens": ["a"]}, {"name": "x"}, "latin",
])
def test_damaged_deny_lists_are_refused(tmp_path, told):
    path = tmp_path / "deny.json"
    path.write_bytes(told.encode() if told == "{" else '["é"]'.encode("latin-1") if told == "latin" else json.dumps(told).encode())
    with pytest.raises(policy.PolicyError):
        policy.deny_tokens(str(path))
    with pytest.raises(policy.PolicyError):
        policy.deny_tokens(str(tmp_path / "absent.json"))


def test_deny_lists(tmp_path):
    path = tmp_path / "deny.json"
    for told, want in ((["A ", ""], [("a", "secret")]), ({"tokens": ["x", {"value": "Y", "kind": "derived"}]}, [("x", "secret"), ("y", "derived")]), ({"format": 2, "canary": "C", "count": 2, "tokens": ["c", "d"]}, [("d", "secret")])):
        path.write_text(json.dumps(told))
        assert policy.deny_tokens(str(path)) == want
    path.write_text(json.dumps({"format": 2, "tokens": ["d", "k"]}))
    assert policy.deny_tokens(str(path), "k") == [("d", "secret")]


def test_visibility_age_is_the_stamps(tmp_path):
    path, now = tmp_path / "map.json", datetime.datetime(2024, 1, 2, tzinfo=datetime.UTC)
    assert policy.visibility(str(path), now) is None
    for stamp, age in (("2024-01-01T00:00:00", 86400), ("soon", None), (None, None)):
        path.write_text(json.dumps({"a/b": "public", "_refreshed": stamp}))
        assert policy.visibility(str(path), now).age == age
    path.write_text("[]")
    with pytest.raises(policy.PolicyError):
        policy.visibility(str(path), now)


def test_config_reaches_the_plans(spark, tmp_path):
    told = {"scoring": {"min_score_to_push": 90, "candidate_merge_band": [0.7, 0.8], "weight_regression": {"max_tau": 0.5}, "urgency_score": {"need": 9}, "effort_min": "odd", "other": 1}, "push": {"max_per_day": 2}}
    (tmp_path / "config.json").write_text(json.dumps(told))
    before, urgency = dict(config.SCORING), dict(config.URGENCY)
    try:
        config.use(config.load(str(tmp_path)))
        assert (config.SCORING["push"], config.SCORING["band"], config.SCORING["max_tau"], config.SCORING["push_cap"], config.SCORING["effort_min"]) == (90.0, (0.7, 0.8), 0.5, 2, 0.5)
        assert config.URGENCY["need"] == 9
        card = ("a::b", "b", 1.0, 1.0, 1.0, 80.0, "tier1", 1, 1)
        rows = spark.createDataFrame([(1, *card)], "demand_id int, canonical_key string, track string, rice_raw double, opportunity double, wsjf double, final_score double, tier string, internal_mentions int, sources int")
        assert ranking.gate(rows).first()["errs"] == []  # 80 is below the push floor now
    finally:
        config.SCORING.update(before)
        config.URGENCY.update(urgency)


def test_rules_sample_is_whole(spark):
    """The demands of the rule queries are every order."""
    sf = "/root/testdata/sf0.001"
    assert rules.demands(spark, sf).count() == spark.read.parquet(f"{sf}/orders.parquet").count()
