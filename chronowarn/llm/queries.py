"""The numbered queries of this package over the provided tables, with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"[^\x20\x09-\x0D]+"


def llm_query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def near_sql(source: str, shingle: int, percent: int) -> str:
    """Brute-force near-duplicate groups in DuckDB, as further WITH parts ending in relation ``near``."""
    run = " || ' ' || ".join(f"ws[i + {j}]" if j else "ws[i]" for j in range(shingle))
    return f"""nd_w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACED}') AS ws FROM {source}),
nd_s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < {shingle} THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - {shingle - 2}), lambda i: {run})) END AS sh FROM nd_w),
nd_x AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM nd_s),
nd_p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM nd_x a JOIN nd_x b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
nd_r AS (SELECT doc_id, doc_id AS c FROM nd_s UNION SELECT nd_p.b, nd_r.c FROM nd_r JOIN nd_p ON nd_p.a = nd_r.doc_id),
near AS MATERIALIZED (SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, g.c AS component_id, s.doc_id = g.c AS kept
  FROM nd_s s JOIN (SELECT doc_id, min(c) AS c FROM nd_r GROUP BY doc_id) g ON g.doc_id = s.doc_id)"""


@llm_query("WITH RECURSIVE " + near_sql("documents", 3, 85) + " SELECT * FROM near")
def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from chronowarn.llm.near_dedup import near_duplicates
    return near_duplicates(table(spark, folder, "documents"), shingle=3, percent=85)


def crc_table() -> str:
    """The 256 steps of the reflected CRC-32 polynomial, as a DuckDB list."""
    steps = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        steps.append(str(value))
    return "[" + ",".join(steps) + "]"


@llm_query(f"""WITH b AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(0, size - 16), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda x, y: xor(x >> 8, {crc_table()}[xor(x & 255, y) + 1]))) AS text_crc32 FROM b),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before,
  sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id, text_crc32, size) AS r FROM c),
s AS (SELECT *, CAST((2 * before + size) * 40 // (2 * total) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY r) - 1 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard FROM s""")
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from chronowarn.llm.sharding import byte_shards
    out = byte_shards(table(spark, folder, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))


@llm_query("""WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM p JOIN f USING (payload_digest)""")
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    import uuid
    from chronowarn.llm.warc import round_trip
    from chronowarn.session import checkpoint_root
    out = round_trip(table(spark, folder, "pages"), f"{checkpoint_root(spark)}/llm-archives-{uuid.uuid4().hex}")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@llm_query()
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from chronowarn.llm.quality_rules import quality_rules
    out = quality_rules(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 6).alias("distance"))


@llm_query()
def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    from chronowarn.llm.url_filters import url_verdicts
    return url_verdicts(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


@llm_query()
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    from chronowarn.llm.license_scan import license_scan
    out = license_scan(table(spark, folder, "documents")).withColumn("_base", F.filter("detections", lambda d: d["base"]))
    starts = F.transform("_base", lambda d: d["first_word"])
    return out.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_base", lambda d: d["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


@llm_query()
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from chronowarn.llm.line_dedup import dedup_lines
    out = dedup_lines(table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
                      F.md5("text").alias("text_md5"))


@llm_query()
def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from chronowarn.llm.decontaminate import contaminated
    out = contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return out.select("doc_id", "item_id", *[F.round(c, 4).alias(c) for c in ("cosine", "share", "answer_share")], "first_word")


@llm_query()
def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from chronowarn.llm.quality_classifier import quality
    out = quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("p_document", "host_posterior", "path_posterior", "posterior")], "kept")


@llm_query()
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from chronowarn.llm.mixing import DOMAINS, mix
    out = mix(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return out.select("doc_id", "tokens", *[F.round(c, 6).alias(c) for c in (*[f"p_{d}" for d in DOMAINS], "rate")], "copies")


def vector_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Exact product codes in DuckDB: every round as relations ``a<r>`` (nearest entries) and ``c<r>`` (codebooks)."""
    out = [f"""k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
           f"""p AS MATERIALIZED (SELECT rid, q.part, v[CAST(q.part * len(v) // {parts} AS BIGINT) + 1 : CAST((q.part + 1) * len(v) // {parts} AS BIGINT)] AS x
  FROM k, (SELECT unnest(range({parts})) AS part) q)""",
           f"""s AS (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS entry FROM k WHERE vec_id IS NOT NULL),
c0 AS MATERIALIZED (SELECT part, entry, x AS e FROM s JOIN p USING (rid) WHERE entry < {entries})"""]
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT rid, part, min(far * {entries} + entry) % {entries} AS entry, min(far) AS far, any_value(x) AS x
  FROM (SELECT rid, p.part, entry, x, CAST(list_sum(list_transform(list_zip(x, e), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT) AS far
        FROM p JOIN c{r} c ON c.part = p.part) GROUP BY rid, part)""")
        if r < rounds:
            out.append(f"""m{r} AS MATERIALIZED (SELECT part, entry, list(CAST(t - ((t % n) + n) % n AS BIGINT) // n ORDER BY place) AS e
  FROM (SELECT part, entry, place, sum(x[place]) AS t, count(*) AS n FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS place FROM a{r}) GROUP BY part, entry, place) GROUP BY part, entry),
c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m ON m.part = c.part AND m.entry = c.entry)""")
    out.append(f"""h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
w AS MATERIALIZED (SELECT rid, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)""")
    return "WITH " + ",\n".join(out) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256, label FROM k JOIN w USING (rid), h"""


@llm_query(vector_sql())
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    from chronowarn.llm.vector_codes import vector_codes
    return vector_codes(table(spark, folder, "embeddings"))


@llm_query()
def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from chronowarn.llm.toxicity import toxicity
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def repair_sql() -> str:
    """Damage, faults and the cheapest repair in DuckDB: a row of every conversation a step, from state to state (0 nothing, 1 s, 2 u, 3 a)."""
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(g, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda x, y: xor(x >> 8, {crc_table()}[xor(x & 255, y) + 1])))"
    blank = r"[^\x20\x09-\x0D]"
    inserts = [(0, 0, ""), (1, 1, ""), (2, 2, ""), (3, 3, ""), (0, 2, "u"), (1, 2, "u"), (3, 2, "u"), (2, 3, "a"), (0, 3, "ua"), (1, 3, "ua"), (2, 2, "au"), (3, 3, "ua")]
    said = {"u": "user:", "a": "assistant:"}
    closure = ", ".join(f"({x}, {y}, {5 * len(w)}, '{'I' * len(w)}', [{', '.join(repr(said[c]) for c in w)}]::VARCHAR[])" for x, y, w in inserts)
    edits = [("D", x, x, c, 2) for x in range(4) for c in "sua?"]
    edits += [("K", x, y, c, 0) for c, y, xs in (("s", 1, (0,)), ("u", 2, (0, 1, 3)), ("a", 3, (2,))) for x in xs]
    edits += [("R", x, y, c, 1) for y, xs in ((2, (0, 1, 3)), (3, (2,))) for x in xs for c in "sua?"]
    table = ", ".join(f"('{e}', {x}, {y}, '{c}', {n})" for e, x, y, c, n in edits)
    return f"""WITH RECURSIVE o AS MATERIALIZED (SELECT DISTINCT conv_id FROM conversations),
g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS g FROM conversations),
k AS MATERIALIZED (SELECT *, {crc} % 20 AS k FROM g),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM k, (SELECT unnest(range(2)) AS copy) c WHERE k <> 0 AND (copy = 0 OR k = 3)),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS MATERIALIZED (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '?' END AS c,
  CASE WHEN NOT regexp_matches(text, '{blank}') THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
    WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM n),
l AS (SELECT *, lead(c) OVER (PARTITION BY conv_id ORDER BY i) AS c2 FROM f),
t AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (c || c2 NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM l GROUP BY conv_id),
w(x, y, cost, letters, lines) AS (VALUES {closure}),
e(letter, x, y, c, cost) AS (VALUES {table}),
r AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS st, {{'c': CAST(0 AS BIGINT), 'a': '', 't': []::VARCHAR[]}} AS v FROM o
  UNION ALL SELECT r.conv_id, f.i, e.y, min({{'c': CAST(r.v.c + w.cost + e.cost + CASE WHEN e.letter <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END AS BIGINT), 'a': r.v.a || w.letters || e.letter,
    't': list_concat(list_concat(r.v.t, w.lines), CASE e.letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE e.y WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] END)}})
  FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1 JOIN w ON w.x = r.st JOIN e ON e.x = w.y AND e.c = f.c AND (e.letter = 'D' OR f.fault IS NULL OR f.fault = 'truncated')
  GROUP BY r.conv_id, f.i, e.y),
b AS (SELECT r.conv_id, min({{'c': r.v.c + w.cost, 'a': r.v.a || w.letters, 't': list_concat(r.v.t, w.lines)}}) AS v
  FROM r LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM r.conv_id JOIN w ON w.x = r.st AND w.y IN (0, 3) WHERE r.i = coalesce(t.n, 0) GROUP BY r.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(b.v.c AS BIGINT) AS cost, b.v.a AS audit, sha256(array_to_string(b.v.t, chr(10))) AS repaired_sha256
FROM o LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM o.conv_id JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id"""


@llm_query(repair_sql())
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    from chronowarn.llm.conversations import repaired_conversations
    return repaired_conversations(table(spark, folder, "conversations"))


@llm_query()
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, folder)
