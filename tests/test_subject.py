"""Subjects are compared over up to 64 content words, not over the eight of a key."""

from plaintide.functions import text
from plaintide.plans import records


def test_whole_sets(spark, tmp_path):
    w = [f"word{i}" for i in range(70)]
    rows = [(1, " ".join(w[:12])), (2, " ".join(["other", *w[:12]])), (3, " ".join(w[:8] + w[20:24])), (4, " ".join(["first", *w[:8], *w[30:34]]))]
    spark.createDataFrame([(i, t, "s", "en") for i, t in rows], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: t.split() for i, t in rows}
    got = {(r["left_id"], r["right_id"]): r["agree"] for r in records.join_subject_sets(spark, str(tmp_path)).collect()}
    for (a, b), agree in got.items():
        x, y = sets[a], sets[b]
        assert agree == (set(x) <= set(y) or set(y) <= set(x) or x[0] == y[0])
    old = {(r["left_id"], r["right_id"]): r["agree"] for r in records.join_subject(spark, str(tmp_path)).collect()}
    assert got[2, 1] and not old[2, 1] and text.TOKENS_OF_SETS == 64
