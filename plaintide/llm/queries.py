"""The operators as registered queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaintide.llm import bpe, classifier, fingerprints, lines, merkle, mixing, neardup, periodic, pii, quality, tokens, vectors, warc

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_and_search(_table(spark, sf_dir, "documents"))


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.drop_boilerplate(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "source", "text", F.col("__pt_lines").alias("n_lines"), F.col("__pt_dropped").alias("n_dropped"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = neardup.link_documents(_table(spark, sf_dir, "documents"))
    return linked.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def op11_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link_vectors(_table(spark, sf_dir, "embeddings"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.check_tampered(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest_planted(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = [op1_fingerprints, op2_repetition, op3_token_files, op4_pii, op5_quality_classifier, op6_mixing, op7_warc, op8_bpe, op9_line_dedup, op10_near_duplicates, op11_embedding_links, op12_merkle, op13_periodic_runs]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": OP7, "op9_line_dedup": OP9, "op11_embedding_links": OP11, "op12_merkle": merkle_sql()}


OP7 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS hex FROM p),
f AS (SELECT hex, max(page_id) AS first_id FROM d GROUP BY hex),
bits AS (SELECT DISTINCT hex, list_aggregate(list_transform(range(1, 41), lambda i: bin(CAST('0x' || substr(hex, i, 1) AS INTEGER) + 16)[2:5]), 'string_agg', '') AS b FROM d),
b32 AS (SELECT hex, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + 16 * CAST(substr(b, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INTEGER) + 4 * CAST(substr(b, 5 * i + 3, 1) AS INTEGER)
  + 2 * CAST(substr(b, 5 * i + 4, 1) AS INTEGER) + CAST(substr(b, 5 * i + 5, 1) AS INTEGER), 1)), 'string_agg', '') AS digest FROM bits)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN f USING (hex) JOIN b32 USING (hex)
"""

OP9 = f"""
WITH l AS (SELECT d.doc_id, d.source, d.text AS whole, u.i, string_split(d.text, chr(10))[u.i] AS line
  FROM documents d, LATERAL (SELECT unnest(range(1, len(string_split(d.text, chr(10))) + 1)) AS i) u WHERE d.text IS NOT NULL),
t AS (SELECT source, count(text) AS site FROM documents GROUP BY source),
c AS (SELECT source, trim(line, ' ') AS mark, count(DISTINCT doc_id) AS held FROM l WHERE trim(line, ' ') <> '' GROUP BY 1, 2),
b AS (SELECT c.source, c.mark FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.held >= {lines.LEAST} AND c.held > {lines.RATIO}e0 * t.site),
k AS (SELECT l.*, b.mark IS NOT NULL AS gone FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line, ' ') = b.mark),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text FROM k GROUP BY doc_id)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE g.text END AS text,
  coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""

OP11 = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS MATERIALIZED (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.r, b.r AS o FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {vectors.LEAST}),
reach AS (SELECT r, r AS o FROM v UNION SELECT reach.r, link.o FROM reach JOIN link ON reach.o = link.r),
c AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.o = v.r GROUP BY 1),
n AS (SELECT r, count(*) AS n FROM link GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, coalesce(v.vec_id = c.component_id, false) AS kept
FROM v JOIN c USING (r) LEFT JOIN n USING (r)
"""


def merkle_sql(levels: int = 7) -> str:
    """Both trees level by level; a level over a single node is passed over. ``levels`` levels hold 16 ** levels nodes."""
    lists = "list(h ORDER BY i)"
    with_text = lambda text: " || ".join(f"coalesce(octet_length(encode({x})) || ':' || {x}, '-')" for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text))
    # crc32 of the decimal doc_id, a bit at a time
    crc = "list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_concat([-1 - ascii(c)::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[])))), lambda r, x: CASE WHEN x < 0 THEN xor(r, -1 - x) WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::BIGINT) ELSE r // 2 END)"
    parts = [
        f"""leaf AS (SELECT doc_id, source, sha256({with_text("text")}) AS leaf,
  CASE WHEN xor({crc}, 4294967295::BIGINT) % 5 = 0 THEN sha256({with_text("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS changed FROM documents)""",
        "d0 AS (SELECT doc_id, coalesce('s' || source, '') AS tree, leaf, coalesce(changed, leaf) AS cur, '' AS said, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaf)",
        "n0 AS (SELECT tree, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM d0)",
    ]

    def climb(n: str, d: str, step: int, keep: str) -> None:
        a, b = f"{n}{step}", f"{n}{step + 1}"
        parts.append(f"r{b} AS (SELECT tree, i // 16 AS run, any_value(n) AS n, {lists} AS l FROM {a} GROUP BY 1, 2)")
        parts.append(f"{b} AS (SELECT tree, run AS i, CASE WHEN n = 1 THEN l[1] ELSE sha256(array_to_string(l, '')) END AS h, (n + 15) // 16 AS n FROM r{b})")
        parts.append(
            f"{d}{step + 1} AS (SELECT {keep}, d.tree, CASE WHEN n = 1 THEN cur ELSE sha256(array_to_string(l[1:d.i % 16], '') || cur || array_to_string(l[d.i % 16 + 2:], '')) END AS cur, "
            f"said || array_to_string(l[1:d.i % 16], '') || array_to_string(l[d.i % 16 + 2:], '') AS said, d.i // 16 AS i FROM {d}{step} d JOIN r{b} r ON d.tree = r.tree AND d.i // 16 = r.run)"
        )

    for step in range(levels):
        climb("n", "d", step, "doc_id, leaf")
    parts.append(f"s0 AS (SELECT 'all' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, h, count(*) OVER () AS n, tree AS site FROM n{levels})")
    parts.append(f"e0 AS (SELECT d.doc_id, d.leaf, s.h AS subroot, 'all' AS tree, d.cur, d.said, s.i FROM d{levels} d JOIN s0 s ON d.tree = s.site)")
    for step in range(levels):
        climb("s", "e", step, "doc_id, leaf, subroot")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(said) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM e{levels} JOIN s{levels} USING (tree)
"""
