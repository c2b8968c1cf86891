"""The registered queries of the operators, and SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from plaintide.llm import alignment, ann, bpe, exact_dedup, jaccard, lexical, line_dedup, packing, sharding, suffix_dedup, token_counts, toxicity, warc
from plaintide.llm.common import work_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded; the digests derive from the packed ids and the bytes."""
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return both.select(
        "doc_id",
        F.shiftright(F.octet_length("ids").cast("bigint"), 2).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, vec="embedding")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return cut.select(
        "doc_id", (F.octet_length("kept") + removed).alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents")).drop("row")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_folder(spark)}/warc-{uuid.uuid4().hex}"
    history = warc.capture_history(table(spark, sf_dir, "pages"), path)
    return history.select(
        F.col("page_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"), "key",
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line that isn't blank, with the first equal line as its class."""
    lines = line_dedup.judged_lines(table(spark, sf_dir, "documents"))
    return lines.select(
        F.col("place.id").alias("doc_id"), F.col("place.line_no").alias("line_no"), F.col("first.id").alias("class_doc_id"),
        F.col("first.line_no").alias("class_line_no"), "copies", "n_links", "kept",
    )


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of one weight in two regions of three racks; the grown tree has one shard more."""
    return sharding.shard_rows(table(spark, sf_dir, "documents"), sharding.Tree.even(24, regions=2, racks=3))


QUERIES = {
    "op1_bpe": op1_bpe, "op2_ann": op2_ann, "op3_suffix_dedup": op3_suffix_dedup, "op4_toxicity": op4_toxicity, "op5_exact_dedup": op5_exact_dedup,
    "op6_jaccard": op6_jaccard, "op7_token_counts": op7_token_counts, "op8_packing": op8_packing, "op9_warc": op9_warc, "op10_line_dedup": op10_line_dedup,
    "op11_lexical": op11_lexical, "op12_alignment": op12_alignment, "op13_sharding": op13_sharding,
}

def _draw(name: str, weight: int) -> str:
    return f"-ln((('0x' || substr(md5(key || '/' || {name}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / {weight}.0"


def _least(children: dict[int, str], weight: int) -> str:
    return "list_min([" + ", ".join(f"{{'draw': {_draw(name, weight)}, 'child': {c}}}" for c, name in children.items()) + "])"


ORACLE = {
    "op11_lexical": r"""
        WITH t AS (
          SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM documents
        ),
        q AS (
          SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM benchmark
        ),
        i AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
        s AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
        c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM s),
        f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, c GROUP BY term),
        x AS (
          SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
          FROM f JOIN w USING (term) JOIN i USING (term) JOIN s USING (doc_id), c GROUP BY ALL
        ),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM x WHERE score > 0)
        SELECT * FROM r WHERE rank <= 20
    """,
    "op13_sharding": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS digits, coalesce('=' || doc_id::VARCHAR, 'null') AS key FROM documents),
        a AS (SELECT *, {_least({0: "'region 0'", 1: "'region 1'"}, 12)} AS region, {_draw("'growth 0'", 1)} AS growth FROM d),
        b AS (SELECT *, {_least({k: f"'rack ' || region.child || '.{k}'" for k in range(3)}, 4)}.child + region.child * 3 AS rack FROM a),
        c AS (SELECT *, {_least({s: f"'shard ' || (rack * 4 + {s})" for s in range(4)}, 1)}.child + rack * 4 AS shard FROM b),
        tab AS (
          SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
        ),
        e AS (
          SELECT c.*, strlen(text) + 8 AS size,
                 xor(4294967295, list_reduce(
                   list_concat([4294967295], list_transform(range(strlen(text)), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT)),
                   lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1]))) AS text_crc32
          FROM c, tab
        )
        SELECT doc_id, size, text_crc32, 'key' AS law, region.child::INT AS region, (rack % 3)::INT AS rack, shard::INT AS shard,
               row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot,
               CASE WHEN growth < region.draw THEN 24 ELSE shard END::INT AS grown_shard
        FROM e
    """,
    "op9_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url FROM pages),
        k AS (SELECT *, regexp_replace(regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://|#.*$', '', 'g'), '^[^/?]*@|^www[0-9]*\.', '') AS bare FROM p),
        r AS (
          SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
                 CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first_id,
                 array_to_string(list_reverse(string_split(regexp_extract(bare, '^([^/?:]*)', 1), '.')), ',') || ')'
                   || CASE WHEN regexp_replace(bare, '^[^/?]*', '') = '' THEN '/' ELSE regexp_replace(bare, '^[^/?]*', '') END AS key
          FROM k
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to, key
        FROM r
    """,
    "op10_line_dedup": r"""
        WITH l AS (
          SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no,
                 trim(unnest(string_split(text, chr(10))), chr(9) || chr(11) || chr(12) || chr(13) || ' ') AS line
          FROM documents
        ),
        e AS (SELECT * FROM l WHERE line <> ''),
        d AS (SELECT line, length(line) AS n, min(row(doc_id, line_no)) AS first, count(*) AS copies FROM e GROUP BY line),
        own AS (
          SELECT line, n, i, substr(line, i * base + 1, CASE WHEN i = k THEN n - i * base ELSE base END) AS piece
          FROM (SELECT line, n, least(2, n // 10) AS k, n // (least(2, n // 10) + 1) AS base FROM d WHERE n >= 10), range(3) r(i) WHERE i <= k
        ),
        probe AS (
          SELECT line, m, i, substr(line, i * base + shift + 1, CASE WHEN i = k THEN m - i * base ELSE base END) AS piece
          FROM (SELECT line, n + more AS m, least(2, (n + more) // 10) AS k, (n + more) // (least(2, (n + more) // 10) + 1) AS base
                FROM d, range(-2, 3) a(more) WHERE n >= 10 AND n + more >= 10), range(3) r(i), range(-2, 3) s(shift)
          WHERE i <= k AND i * base + shift >= 0
        ),
        near AS (
          SELECT DISTINCT t.line AS x, p.line AS y FROM own t JOIN probe p ON t.n = p.m AND t.i = p.i AND t.piece = p.piece
          WHERE t.line <> p.line AND levenshtein(t.line, p.line) <= least(2, least(length(t.line), length(p.line)) // 10)
        ),
        links AS (SELECT x AS line, count(*) AS n_links, min(o.first) AS nearest FROM near JOIN d o ON o.line = y GROUP BY x)
        SELECT e.doc_id, e.line_no::INT AS line_no, d.first[1] AS class_doc_id, d.first[2]::INT AS class_line_no, d.copies,
               coalesce(n_links, 0) AS n_links,
               row(e.doc_id, e.line_no) = d.first AND coalesce(nearest > d.first, true) AS kept
        FROM e JOIN d USING (line) LEFT JOIN links USING (line)
    """,
    "op5_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, coalesce(text, '') AS text,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
          FROM documents
        ), r AS (
          SELECT doc_id, plain,
                 first_value(doc_id) OVER (PARTITION BY plain ORDER BY length(text) DESC, doc_id) AS keep_id,
                 count(*) OVER (PARTITION BY plain) AS group_size
          FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM r
    """,
}
