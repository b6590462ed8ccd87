"""The fingerprints near each query document, equal ones included, against all pairs."""

import random

import pytest

from plaintide.llm import fingerprints
from tests.llm.test_operators import docs_of


@pytest.mark.parametrize(("radius", "blocks"), [(fingerprints.RADIUS, None), (7, 10)])
def test_neighbours(spark, radius, blocks):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(90)]
    texts = [" ".join(base)] * 30  # 0 to 29: copies
    for _ in range(60):
        some = list(base)
        some[rng.randrange(90)] = f"edit{rng.randint(0, 9)}"
        texts.append(" ".join(some))
    texts += [" ".join(f"x{rng.randint(0, 5000)}" for _ in range(50)) for _ in range(30)] + ["", None]
    coded = fingerprints.with_fingerprint(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]).repartition(3)).cache()
    codes = {r["doc_id"]: r["code"] for r in coded.collect()}
    classes = {}
    for i, c in sorted(codes.items()):
        classes.setdefault(c, []).append(i)
    want = set()
    for i in range(0, len(texts), 20):
        for c, ids in classes.items():
            d = ((codes[i] ^ c) & (2**64 - 1)).bit_count()
            if d <= radius:
                want.add((i, f"{c & (2**64 - 1):016x}", ids[0], len(ids), d))
    got = fingerprints.neighbours(coded, coded.where("doc_id % 20 = 0"), radius, blocks).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["near_fingerprint"], r["near_doc_id"], r["near_rows"], r["distance"]) for r in got} == want
    assert any(d and i == 0 for i, *_, d in want) and (0, f"{codes[0] & (2**64 - 1):016x}", 0, len(classes[codes[0]]), 0) in want
