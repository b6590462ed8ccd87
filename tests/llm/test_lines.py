"""Lines judged alike on hosts of every size."""

from plaintide.llm import lines
from tests.llm.test_operators import docs_of


def test_small_hosts_and_copies(spark):
    rows = [(i, f"own {i}\nlegal notice", "small") for i in range(5)]
    rows += [(10 + i, "a copied text\nwith two lines", "copies") for i in range(6)] + [(20, "else", "copies"), (21, None, "copies")]
    got = {r["doc_id"]: r for r in lines.drop_boilerplate(docs_of(spark, rows)).collect()}
    assert got[3]["text"] == "own 3" and got[12]["text"] == "" and got[20]["text"] == "else"  # pages count, copies too
    got = {r["doc_id"]: r for r in lines.drop_boilerplate(docs_of(spark, rows), least=3, once=True).collect()}
    assert len(got) == len(rows)
    assert got[3]["text"] == "own 3" and got[3]["__pt_dropped"] == 1
    assert got[12]["text"] == "a copied text\nwith two lines" and got[21]["text"] is None
    clean = lines.clean_documents(docs_of(spark, rows))
    assert clean.columns == docs_of(spark, rows).columns and clean.where("n_chars <> length(text)").count() == 0


def test_share_of_large_hosts(spark):
    rows = [(100 + i, f"page {i}" + ("\nrare notice" if i < 8 else "") + ("\ntwice" if i < 2 else ""), None) for i in range(1000)]
    rows += [(2000 + i, f"page {i}" + ("\nrare notice" if i < 4 else ""), "wide") for i in range(1000)]
    got = {r["doc_id"]: r for r in lines.drop_boilerplate(docs_of(spark, rows)).collect()}
    assert got[100]["text"] == "page 0\ntwice" and got[2000]["text"] == "page 0\nrare notice"
    one = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(docs_of(spark, [(1, "a\nb", "x"), (2, "a\nc", "y"), (3, "a\nd", "y")])).collect()}
    assert one == {1: "a\nb", 2: "c", 3: "d"}  # what stands on one page only is not repeated
