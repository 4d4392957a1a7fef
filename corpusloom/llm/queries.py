"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import materialize, spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import survivors as S

    rows = materialize(S.members(table(spark, sf_dir, "dup_groups"), table(spark, sf_dir, "file_catalog"), table(spark, sf_dir, "scan_trees")), "members")
    return S.best_rows(rows).select("group_id", "scan_row_id")


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import survivors as S

    return S.survivors(table(spark, sf_dir, "dup_groups"), table(spark, sf_dir, "file_catalog"), table(spark, sf_dir, "scan_trees"))[0]


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path of a group that the model judges true."""
    from corpusloom.llm import survivors as S

    return S.survivors(table(spark, sf_dir, "dup_groups"), table(spark, sf_dir, "file_catalog"), table(spark, sf_dir, "scan_trees"))[1]


def p1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sensitivity and specificity that the model learned of every source: each respect in each tree."""
    from corpusloom.llm import survivors as S

    rows = materialize(S.members(table(spark, sf_dir, "dup_groups"), table(spark, sf_dir, "file_catalog"), table(spark, sf_dir, "scan_trees")), "members")
    return S.survivor_model(S.respect_votes(rows))[1]


def _profile(spark: SparkSession, sf_dir: str, purpose: str):
    """The profile of a purpose; the table has two rows. Of several, the one with the smallest id."""
    return table(spark, sf_dir, "volume_profiles").where(F.lower(F.trim("purpose")) == purpose).orderBy("profile_id").first()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.splitting import split_texts

    profile = _profile(spark, sf_dir, "split")
    return split_texts(table(spark, sf_dir, "conversions"), "conv_id", "markdown", profile.max_bytes, profile.overlap_bytes)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_pieces(spark, sf_dir).where("piece_no = 0").select("conv_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.tokens import encode_corpus

    return encode_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text")


def _p3(spark: SparkSession, sf_dir: str):
    from corpusloom.llm import neardup as N

    setting = N.Settings(words=3, similarity=0.6, least_words=40)
    rows = table(spark, sf_dir, "conversions").where("status = 'success'").select("conv_id", "markdown")
    return *N.near_duplicates(spread(rows, "conv_id"), "conv_id", "markdown", setting), setting


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different texts, by the smallest ids that hold them, and every copy with the smallest id that holds its text."""
    from corpusloom.llm import neardup as N

    return N.written_out(*_p3(spark, sf_dir)).toDF("conv_a", "conv_b")


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per text: its class and the number of links of the class to other classes."""
    from corpusloom.llm import neardup as N

    pairs, balls, member, _ = _p3(spark, sf_dir)
    return N.links(pairs, balls, member).toDF("conv_id", "class_id", "copies", "links")


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.encoding import repair

    return repair(spread(table(spark, sf_dir, "conversions").select("conv_id", "markdown"), "conv_id"), "conv_id", "markdown")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_restored(spark, sf_dir).select("conv_id")


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.scans import repair_scans, scanned_records

    ocr, conversions = table(spark, sf_dir, "ocr_results"), table(spark, sf_dir, "conversions")
    records = scanned_records(ocr, conversions, table(spark, sf_dir, "file_catalog"))
    vocabulary = spread(conversions.select("conv_id", "markdown"), "conv_id").select("markdown").unionAll(ocr.select("text"))
    return repair_scans(records, vocabulary)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    defects = F.array(*(F.when(F.col(d) > 0, F.lit(d)) for d in ("hyphen", "misread", "furniture")))
    return p4_repaired(spark, sf_dir).select("src", "rec_id", F.explode(F.array_compact(defects)).alias("defect"))


def p10_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.residue import residue

    return residue(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_residue(spark, sf_dir).select("doc_id")


def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that remain, with all their columns."""
    return table(spark, sf_dir, "documents").join(p10_found(spark, sf_dir), "doc_id", "left_anti")


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.packing import pack, piece_sizes

    profile = _profile(spark, sf_dir, "pack")
    packed = pack(piece_sizes(table(spark, sf_dir, "pieces")), "item", "size", "queue", profile.max_bytes - profile.reserve_bytes)
    return packed.withColumnRenamed("item", "piece_id")


def p7_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.packing import pack

    profile = _profile(spark, sf_dir, "pack")
    packed = pack(table(spark, sf_dir, "file_catalog"), "scan_row_id", "size_bytes", "kind", profile.max_bytes - profile.reserve_bytes)
    return packed.withColumnRenamed("item", "scan_row_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes used and the number of parts of each container."""
    return p7_pack(spark, sf_dir).groupBy("container").agg(F.sum(F.col("byte_end") - F.col("byte_start")).alias("used_bytes"), F.count("*").alias("parts"))


def p7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each queue in each window of the packed pieces, against its target."""
    from corpusloom.llm.packing import window_shares

    return window_shares(p7_pack(spark, sf_dir))


def _p9(spark: SparkSession, sf_dir: str):
    from corpusloom.llm.mixing import mix
    from corpusloom.llm.tokens import encode_corpus

    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id").withColumn("h", F.md5("text"))
    counted = materialize(encode_corpus(documents, "doc_id", "text", count_only=True, keep=("source", "h")), "counted")
    return mix(counted, table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p9(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p9(spark, sf_dir)[1]


QUERIES = {"p1_found": p1_found, "p1_survivors": p1_survivors, "p1_quality": p1_quality, "p1_paths": p1_paths, "p6_found": p6_found, "p6_pieces": p6_pieces, "p8_ids": p8_ids, "p3_found": p3_found, "p3_classes": p3_classes, "p2_restored": p2_restored, "p2_found": p2_found, "p4_repaired": p4_repaired, "p4_found": p4_found, "p10_residue": p10_residue, "p10_found": p10_found, "p10_kept": p10_kept, "p7_pack": p7_pack, "p7_files": p7_files, "p7_fill": p7_fill, "p7_windows": p7_windows, "p9_mix": p9_mix, "p9_shares": p9_shares}
_MARKED = (
    r"(regexp_matches(regexp_extract(replace(rel_path, '\', '/'), '[^/]*$'), '(?i)^copy of | - (copy|kopie)(\.[a-z0-9]{1,5})?$| 副本(\.[a-z0-9]{1,5})?$| \(\d{1,3}\)(\.[a-z0-9]{1,5})?$|_old(\.[a-z0-9]{1,5})?$|\.bak$|~$')"
    r" OR regexp_matches(replace(rel_path, '\', '/'), '(^|/)(old|\.trash|tmp|backup)/'))"
)

SQL: dict[str, str] = {
    "p1_found": "WITH m AS (SELECT group_id, f.scan_row_id, rel_path, kind, content_hash_algo, coalesce(trust, -1) AS trust, "
    "CASE WHEN mtime >= TIMESTAMP '1981-01-01' AND mtime <= loaded_at + INTERVAL 1 DAY THEN mtime END AS m, CASE WHEN ctime >= TIMESTAMP '1981-01-01' AND ctime <= loaded_at + INTERVAL 1 DAY THEN ctime END AS c "
    "FROM (SELECT DISTINCT group_id, unnest(files) AS scan_row_id FROM dup_groups) g JOIN file_catalog f USING (scan_row_id) LEFT JOIN scan_trees t ON t.tree_id = f.tree_id), "
    "s AS (SELECT group_id, scan_row_id, CAST(m IS NULL AS INT) + CAST(c IS NULL AS INT) + CAST(coalesce(trim(kind), '') = '' AS INT) + CAST(coalesce(trim(content_hash_algo), '') = '' AS INT) AS gaps, "
    f"coalesce(m, TIMESTAMP '1000-01-01') AS m, trust, {_MARKED} AS marked FROM m) "
    "SELECT group_id, scan_row_id FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.group_id = a.group_id AND (b.gaps < a.gaps OR b.m > a.m OR b.trust > a.trust OR (a.marked AND NOT b.marked)))",
    "p3_found": r"WITH t AS (SELECT conv_id, list_filter(regexp_split_to_array(lower(markdown), '[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '') AS w FROM conversions WHERE status = 'success' AND markdown IS NOT NULL), "
    "g AS (SELECT DISTINCT conv_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2])) AS s FROM t WHERE len(w) >= 40), n AS (SELECT conv_id, count(*) AS k FROM g GROUP BY conv_id), "
    "p AS (SELECT a.conv_id AS conv_a, b.conv_id AS conv_b, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.conv_id < b.conv_id GROUP BY ALL) "
    "SELECT conv_a, conv_b FROM p JOIN n x ON x.conv_id = conv_a JOIN n y ON y.conv_id = conv_b WHERE common >= 0.6 * (x.k + y.k - common)",
    "p6_found": "SELECT conv_id FROM conversions WHERE strlen(markdown) > (SELECT max_bytes FROM volume_profiles WHERE purpose = 'split')",
}
