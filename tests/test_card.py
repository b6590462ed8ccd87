"""Cards are redacted whole: every field and snippet, beyond any display length."""

from plaintide.functions import redaction
from plaintide.operators import records
from plaintide.plans.records import prj_redact_card

SF = "/root/testdata/sf0.001"
TEXTS = ", ".join(f"{c} string" for c in records.CARD_TEXTS)


def test_every_field(spark):
    far = "word " * 60 + "me@corp.org and " + "more " * 20
    rows = [
        (1, far, far, "a@b.org", "c@d.org", "", None, [(None, far), ("x@y.org", "p@q.org"), ("", ""), (None, None)], [("u1", "n", None), (None, "name", None), (None, "kept", "h"), (None, None, None)]),
        (2, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"id int, {TEXTS}, evidence array<struct<redacted_snippet string, quote string>>, authors array<struct<user_id string, author string, author_hash string>>")
    one, two = (r.asDict(recursive=True) for r in records.redact_card(df, "salt").orderBy("id").collect())
    for c, given in zip(records.CARD_TEXTS, rows[0][1:7], strict=True):
        assert one[c] == (redaction.redact_text(given)[0] if given else given)
    assert "@" not in str(one) and one["title"].count("[EMAIL_1]") == 1
    assert [list(e) for e in one["evidence"]] == [["redacted_snippet"]] * 4
    assert [e["redacted_snippet"] for e in one["evidence"]] == [redaction.redact_text(far)[0], "[EMAIL_1]", "", None]
    a = one["authors"]
    assert a[0]["author_hash"].startswith("u_") and a[1]["author"] is None and a[1]["author_hash"].startswith("u_") and a[2] == {"author": "kept", "author_hash": "h"} and a[3]["author_hash"] is None
    assert all("user_id" not in x for x in a) and two["evidence"] == [] and two["authors"] == []


def test_query_sees_whole_texts(spark):
    got = {r["doc_id"]: r["title"] for r in prj_redact_card(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert got[r["doc_id"]] == (redaction.redact_text(r["text"])[0] if r["text"] else r["text"])
