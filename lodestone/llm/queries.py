"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import chat_format, clustering, decontaminate, fingerprints, html_extract, language_id, license_scan, lm_scoring, mixing, ngram_join, token_counts, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def chat_log(rows: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) as the events a chat server logs: a message is streamed in two deltas; an
    assistant's first draft stops half way and is generated anew; a user's half-typed one is edited. Rows that share a
    turn are messages of their own."""
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    size, mine = F.length("text"), F.col("role") == "assistant"
    part = lambda a, z: F.substr("text", (a + 1).cast("int"), (z - a).cast("int"))
    zero, third, half = F.lit(0), F.floor(size / 3), F.floor(size / 2)
    event = lambda seq, kind, text: F.struct(F.lit(seq).alias("seq"), kind.alias("kind"), text.alias("text"))
    log = F.array(
        event(0, F.lit("delta"), part(zero, half)),
        event(1, F.when(mine, "regenerate").otherwise("edit"), part(zero, third)),
        event(2, F.lit("delta"), part(third, size)))
    rows = rows.withColumn("nth", nth)  # before the events part
    e = rows.select("conv_id", F.struct("turn", "nth").alias("turn"), "role", F.explode(log).alias("e"))
    return e.select("conv_id", "turn", "e.seq", "e.kind", "role", "e.text")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's messages go through the event log; two rows of a probe are added."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    probe = spark.range(2).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_format.digest(chat_format.fold(chat_log(rows.unionByName(probe))))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.digest(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_fingerprints": op2_fingerprints,
    "op3_mixing": op3_mixing,
    "op4_jaccard": op4_jaccard,
    "op5_tokens": op5_tokens,
    "op6_decontamination": op6_decontamination,
    "op7_html": op7_html,
    "op8_chat": op8_chat,
    "op9_licenses": op9_licenses,
    "op10_toxicity": op10_toxicity,
    "op11_clustering": op11_clustering,
    "op12_whitening": op12_whitening,
    "op13_scoring": op13_scoring,
}

SQL: dict[str, str] = {
    "op3_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank
  FROM d GROUP BY source),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight FROM s),
-- deals out what is left by weight, stops each source at its cap, and again, until none is above
r(step, rank, source, source_size, weight, target, capped) AS (
  SELECT 0, rank, source, source_size, weight,
         (SELECT sum(source_size) FROM w)::DOUBLE * weight / (SELECT sum(weight) FROM w), false FROM w
  UNION ALL
  SELECT step + 1, rank, source, source_size, weight,
         CASE WHEN now THEN 3.0 * source_size
              ELSE (sum(source_size) OVER () - sum(CASE WHEN now THEN 3 * source_size ELSE 0 END) OVER ())::DOUBLE
                   / sum(CASE WHEN now THEN 0 ELSE weight END) OVER () * weight END,
         now
  FROM (SELECT *, target >= 3 * source_size AS now FROM r)
  WHERE step < (SELECT count(*) FROM w) + 1),
t AS (SELECT source, source_size, target, floor(target + 0.5)::BIGINT AS want FROM r
      WHERE step = (SELECT count(*) FROM w) + 1),
p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.want,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
-- the schedule: points in bit-reversed order on the line of all sources' slots; a source's slots take its blocks in turn
b AS (SELECT rank, want // source_size AS rounds, want % source_size AS rest, (source_size + 1023) // 1024 AS blocks
      FROM (SELECT rank, source_size, floor(target + 0.5)::BIGINT AS want FROM r WHERE step = (SELECT count(*) FROM w) + 1) WHERE source_size > 0),
a AS (SELECT *, sum(rounds * blocks + (rest + 1023) // 1024) OVER (ORDER BY rank) AS slot_end, rounds * blocks + (rest + 1023) // 1024 AS slots FROM b),
n AS (SELECT greatest(1, ceil(log2(max(slot_end))))::INTEGER AS bits FROM a),
v AS (SELECT slot, list_sum([((slot >> k) & 1) << (bits - 1 - k) for k in range(bits)])::BIGINT AS point
      FROM (SELECT unnest(range(1 << bits)) AS slot, bits FROM n)),
o AS (SELECT slot, rank, rounds, rest, blocks, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS nth
      FROM v JOIN a ON point >= slot_end - slots AND point < slot_end),
e AS (SELECT slot, rank, nth % blocks AS block, CASE WHEN nth // blocks = rounds THEN least(1024, rest - nth % blocks * 1024) ELSE 1024 END AS upto FROM o),
f AS (SELECT doc_id, start, p.rank, min(slot) AS first_slot FROM (SELECT p.*, s.rank FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source) p
      JOIN e ON e.rank = p.rank AND e.block BETWEEN start // 1024 AND (start + size - 1) // 1024
            AND size > 0 AND e.upto > greatest(0, start - e.block * 1024) GROUP BY ALL)
SELECT p.doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE (want // source_size) * size
            + greatest(0, least(p.start + size, want % source_size) - p.start) END::BIGINT AS taken,
       CASE WHEN size > 0 THEN first_slot END::BIGINT AS first_slot
FROM (SELECT p.*, s.rank FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source) p
LEFT JOIN f ON f.rank = p.rank AND f.start = p.start AND f.doc_id IS NOT DISTINCT FROM p.doc_id""",
    "op4_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, least(5, len(w)) || ':' || array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op6_decontamination": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS p FROM bi),
di AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, (SELECT DISTINCT size FROM win)),
occ AS (SELECT di.doc_id, di.i, win.size, win.item FROM di JOIN win
        ON win.size = di.size AND win.p = array_to_string(di.w[di.i:di.i + di.size - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op8_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, 3 * (length(text) + length(role)) - 2 * length(regexp_replace(text || role, '[\\<\[]', '', 'g'))
            + 2 * (length(role) - length(replace(role, chr(10), ''))) + 8 AS size
  FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op9_licenses": license_scan.oracle(),
    "op11_clustering": clustering.oracle(),
}
