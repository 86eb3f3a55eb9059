"""Registered queries of the training-data operators and their DuckDB statements.

Each ``opN_<name>`` applies operator N to its whole table and derives the columns
the query returns from the operator's real output.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shipping import ship_package
from .staging import new_folder, read_documents


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, from the package the box provides."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return read_documents(spark, sf_dir)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op1_simhash import simhash_groups
    return simhash_groups(_documents(spark, sf_dir), shingle=3, max_bits=2).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op2_lines import delete_lines
    return delete_lines(_documents(spark, sf_dir), report=True).select(
        "doc_id", F.size("gone").alias("n_deleted"), F.array_join("gone", ",").alias("deleted_lines"),
        "partners", F.sha2("text", 256).alias("text_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op3_pii import FULL, KINDS, find_spans, spans_text
    found = find_spans(_documents(spark, sf_dir), **FULL)
    kinds = F.transform("base", lambda s: s["kind"])
    return found.select(
        "doc_id", *[(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}")
                    for k in KINDS],
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op4_classifier import fit, held_out, score_documents
    docs = _documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                               "predicted")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op5_exact import exact_groups
    return exact_groups(_documents(spark, sf_dir), hash_all=True).select(
        "doc_id", "keep_id", "group_size", "kept",
        F.lower(F.hex("full")).alias("text_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op6_rules import judge, quality_rules
    docs = _documents(spark, sf_dir)
    rules = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rule")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op7_token_store import store_documents, write_store
    path = new_folder(spark, "token-store")
    write_store(_documents(spark, sf_dir), path, vocabulary("byte_bpe_50k.json"))
    return store_documents(spark, path)


def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes with dropout and decodes again; decoded_sha256 must be the text's own."""
    from .op8_merge_dropout import decode_documents, encode_documents
    path = vocabulary("piece_bpe_32k.model")
    ids = encode_documents(_documents(spark, sf_dir), path, seed=8)
    return decode_documents(ids, path).select(
        "doc_id", "variant", "n_ids", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op9_packing import pack_documents
    return pack_documents(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"),
                          with_ids=False)


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op10_paragraphs import removals
    return removals(_documents(spark, sf_dir), passages=True)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third id (by crc32) presents a lower-cased text with its original proof."""
    from .op11_merkle import FIELDS, as_hex, build_manifest, fold, leaf_digest, proof_digest, proofs
    docs = read_documents(spark, sf_dir)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    forged = leaf_digest([F.when(hit, lowered).otherwise(F.col("text")) if f == "text" else F.col(f)
                          for f in FIELDS])
    made = proofs(build_manifest(docs.withColumn("forged", forged), carry=("forged",)))
    return made.withColumn("folded", fold(F.col("forged"), F.col("proof"))).select(
        F.col("id").alias("doc_id"), as_hex(F.col("leaf")).alias("leaf"),
        as_hex(F.col("subroot")).alias("subroot"), as_hex(F.col("root")).alias("root"),
        as_hex(proof_digest(F.col("proof"))).alias("proof_sha256"),
        as_hex(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op4_classifier import held_out
    from .op12_toxicity import fit, score_documents
    docs = _documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                               "predicted")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op13_negatives import hard_negatives
    ship_package(spark)
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=turned,
                          anchor="id % 50 = 0")


_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in
                                ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: crc32 of the decimal id, byte by byte and bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(
        string_split(doc_id::varchar, ''), lambda d: ord(d)::bigint)), lambda c, d:
        list_reduce([xor(c, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda e, z:
        CASE WHEN e & 1 = 1 THEN xor(e >> 1, 3988292384) ELSE e >> 1 END)), 4294967295)"""
#: Levels of a set of trees, and every node with its siblings; ``{of}`` has (tree, pos, n, digest).
_TREES = """
        {name}_up AS (
            SELECT tree, 0 AS lvl, pos, n, digest FROM {of}
            UNION ALL
            SELECT tree, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
            FROM {name}_up WHERE n > 1 GROUP BY tree, lvl, pos // 8, n),
        {name}_step AS (
            SELECT tree, lvl, pos,
                   coalesce(string_agg(digest, '') OVER lft, '') AS l,
                   coalesce(string_agg(digest, '') OVER rgt, '') AS r
            FROM {name}_up WHERE n > 1
            WINDOW lft AS (PARTITION BY tree, lvl, pos // 8 ORDER BY pos
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                   rgt AS (PARTITION BY tree, lvl, pos // 8 ORDER BY pos
                           ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
        {name}_root AS (SELECT tree, lvl, digest FROM {name}_up WHERE n = 1)"""

SQL = {
    "op11_merkle": f"""
        WITH RECURSIVE told AS (
            SELECT doc_id, lang, {_LEAF.format(text="text")} AS leaf,
                   CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.format(
                       text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
                        ELSE {_LEAF.format(text="text")} END AS forged
            FROM documents),
        placed AS (
            SELECT *, coalesce('=' || lang, '') AS tree, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
            FROM told),
        {_TREES.format(name="low", of="placed")},
        tops AS (SELECT '^' AS tree, tree AS low_tree, digest, count(*) OVER () AS n,
                        row_number() OVER (ORDER BY tree) - 1 AS pos FROM low_root),
        {_TREES.format(name="top", of="tops")},
        steps AS (
            SELECT tree, lvl, pos, tree AS up_tree, lvl + 1 AS up_lvl, pos // 8 AS up_pos, l, r FROM low_step
            UNION ALL SELECT '^', 1000 + lvl, pos, '^', 1001 + lvl, pos // 8, l, r FROM top_step
            UNION ALL SELECT b.tree, b.lvl, 0, '^', 1000, t.pos, NULL, NULL
            FROM low_root b JOIN tops t ON t.low_tree = b.tree),
        walk AS (
            SELECT doc_id, tree, 0 AS lvl, pos, forged AS acc, '' AS proof FROM placed
            UNION ALL
            SELECT doc_id, up_tree, up_lvl, up_pos, coalesce(sha256(l || acc || r), acc),
                   proof || coalesce(l || r, '')
            FROM walk JOIN steps USING (tree, lvl, pos))
        SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, sha256(w.proof) AS proof_sha256,
               w.acc AS folded_root, w.acc = r.digest AS verified
        FROM placed p JOIN low_root s USING (tree) JOIN top_root r ON true
        JOIN walk w ON w.doc_id = p.doc_id AND w.tree = '^' AND w.lvl = 1000 + r.lvl""",
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::double)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, a.label = o.label AS same, o.vec_id,
                   list_inner_product(a.v, o.v)::bigint AS score
            FROM v a JOIN v o ON a.vec_id % 50 = 0 AND a.vec_id <> o.vec_id),
        positives AS (
            SELECT * FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id,
               (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id))::int
               AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
             AND 100 * n.score BETWEEN 50 * p.score AND 95 * p.score
        QUALIFY rank <= 3""",
    "op5_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({_ASCII_LOWER}) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size
              FROM t GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM t JOIN g USING (text_sha256)""",
}

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_store": op7_token_store,
    "op8_merge_dropout": op8_merge_dropout,
    "op9_packing": op9_packing,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_merkle": op11_merkle,
    "op12_toxicity": op12_toxicity,
    "op13_hard_negatives": op13_hard_negatives,
}
