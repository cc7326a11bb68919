"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id and place of every verified overlap with the benchmark."""
    from strandline.llm.decontaminate import contaminated_spans

    return contaminated_spans(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    from strandline.llm.licenses import license_scan

    return license_scan(_read(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.85 or more."""
    from strandline.llm.near_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, percent=85)


def op4_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from strandline.llm.html_text import page_texts

    return page_texts(_read(spark, sf_dir, "pages"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate passages of all documents."""
    from strandline.llm.passages import repeated_passages

    return repeated_passages(_read(spark, sf_dir, "documents"))


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 400-byte strings that occur elsewhere."""
    from strandline.llm.repeated_bytes import repeated_bytes

    return repeated_bytes(_read(spark, sf_dir, "documents"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document for the target mix of sources."""
    from strandline.llm.mixing import mix

    return mix(_read(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of secrets in every document."""
    from strandline.llm.secrets import secret_spans

    rows = secret_spans(_read(spark, sf_dir, "documents"))
    joined = lambda kept: F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "model")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    from strandline.llm.quality_model import quality_scores

    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts, n-gram likelihood ratio and verdict of every document."""
    from strandline.llm.quality_rules import quality_rules

    return quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels").filter("quality = 1"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, one in ten of which gets a periodic end first."""
    from strandline.llm.periodic_runs import periodic_runs, planted

    rows = periodic_runs(planted(_read(spark, sf_dir, "documents")))
    said = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    top = F.col("strongest")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"), F.sha2(F.array_join(said, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the lines that three documents or more share."""
    from strandline.llm.line_dedup import dedup_lines

    return dedup_lines(_read(spark, sf_dir, "documents"), least_docs=3, least_chars=20).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw of 10 % towards the benchmark's words."""
    from strandline.llm.resampling import resample

    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), percent=10, least_words=20, longest=1, buckets=10_000, seed=2024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_licenses, op3_near_dedup, op4_page_texts, op5_passages,
        op6_repeated_bytes, op7_mix, op8_secrets, op9_quality, op10_quality_rules,
        op11_periodic_runs, op12_line_dedup, op13_resample,
    )
}
#: CRC-32 in SQL: the 256 steps of a byte from the reversed polynomial 0xEDB88320, then a fold over the bytes of each distinct word.
_CRC = """
    WITH steps AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS step FROM range(256) r(b)),
    words AS (SELECT source, doc_id, text_no, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')) AS word
        FROM (SELECT 's' AS source, doc_id, row_number() OVER () AS text_no, text FROM documents UNION ALL SELECT 't', NULL, NULL, text FROM benchmark)),
    spelt AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM words)),
    crcs AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, step[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket FROM spelt, steps)"""
SQL: dict[str, str] = {
    "op3_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM c WHERE 100 * common >= 85 * (nx + ny - common)), t AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT x, y FROM t UNION SELECT r.x, t.y FROM r JOIN t ON t.x = r.y),
        m AS (SELECT x, min(y) AS least FROM r GROUP BY x)
        SELECT doc_id, len(sh) AS n_shingles, least(doc_id, coalesce(m.least, doc_id)) AS component_id, doc_id <= coalesce(m.least, doc_id) AS kept FROM s LEFT JOIN m ON x = doc_id""",
    "op12_line_dedup": r"""
        WITH lines AS (SELECT rid, doc_id, n, l[i] AS line, i, trim(translate(l[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), E' \t\n\x0b\f\r') AS k
            FROM (SELECT rid, doc_id, l, len(l) AS n, unnest(range(1, len(l) + 1)) AS i FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), E'\n') AS l FROM documents))),
        shared AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        told AS (SELECT rid, lines.doc_id, n, line, i, coalesce(lines.doc_id <> keeper, false) AS gone FROM lines LEFT JOIN shared USING (k))
        SELECT any_value(doc_id) AS doc_id, any_value(n)::BIGINT AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, E'\n' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM told GROUP BY rid""",
    "op13_resample": _CRC + """,
    counts AS (SELECT bucket, count(*) FILTER (WHERE source = 's') AS s, count(*) FILTER (WHERE source = 't') AS t FROM words JOIN crcs USING (word) GROUP BY bucket),
    gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
    weighed AS (SELECT text_no, count(*) AS n, sum(gain)::BIGINT AS w FROM words JOIN crcs USING (word) JOIN gains USING (bucket) WHERE source = 's' GROUP BY text_no),
    scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight,
            coalesce(w, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
        FROM (SELECT doc_id, row_number() OVER () AS text_no FROM documents) d LEFT JOIN weighed USING (text_no)),
    placed AS (SELECT *, n_features >= 20 AND score IS NOT NULL AS able, row_number() OVER (PARTITION BY n_features >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id) AS place FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= (SELECT 10 * count(*) // 100 FROM placed WHERE able) THEN place END AS rank FROM placed""",
}
