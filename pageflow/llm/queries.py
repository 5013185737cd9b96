"""Registered queries of the ten operators: thin steps from the given tables and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageflow.llm import (
    archive, divergence, host_rules, line_quality, manifest, mixing, near_vectors, neighbours, packing, personal_data, repeated_lines,
    similar_files, token_counts,
)
from pageflow.llm.scratch import prepared, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(prepared(spark), sf_dir)
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_files(documents: DataFrame) -> DataFrame:
    """A document as a library file: its source is the folder it lies in."""
    return documents.select(F.col("doc_id").alias("file_id"), F.col("source").alias("folder"), "text")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


SIZE_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST({SIZE_SQL} AS BIGINT) AS size FROM documents),
f AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, sum(size * sqrt(size)) AS root_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, sum(source_size) OVER () AS total FROM f),
r AS (SELECT *, CAST(source_size * 3 AS DOUBLE) / weight AS room FROM w),
p AS (SELECT *, row_number() OVER o AS place,
        coalesce(sum(source_size * 3) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
        sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
      FROM r WINDOW o AS (ORDER BY room, source NULLS LAST)),
l AS (SELECT *, CAST(total - filled AS DOUBLE) / CAST(weight_left AS DOUBLE) AS level FROM p),
t AS (SELECT source, source_size, root_size,
        least((SELECT level FROM l WHERE level <= room ORDER BY place LIMIT 1) * weight, CAST(source_size * 3 AS DOUBLE)) AS target FROM l),
j AS (SELECT d.*, t.source_size, t.target, t.root_size,
        CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
        (CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, target - whole * source_size AS rest FROM j),
c AS (SELECT *, rest * sqrt(size) / root_size AS chance FROM k),
q AS (SELECT *, CASE WHEN size = 0 OR rest <= 0 THEN 1.0::DOUBLE WHEN chance >= 1 THEN 0.0::DOUBLE
        ELSE ((u / (1 - u)) / (chance / (1 - chance))) / (1 + (u / (1 - u)) / (chance / (1 - chance))) END AS key FROM c),
a AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM q)
SELECT doc_id, size, source_size, target,
  CAST((whole + CASE WHEN size > 0 AND ahead + size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM a
"""


@query("op3_mix_sources", OP3_SQL)
def op3_mix_sources(spark, sf_dir):
    mixed = mixing.mix_files(as_files(table(spark, sf_dir, "documents")))
    return mixed.select(F.col("file_id").alias("doc_id"), "size", F.col("folder_size").alias("source_size"), "target", "taken")


OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
starts AS (SELECT rid, i, array_to_string(list_slice(words, i, i + 7), ' ') AS gram
           FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM starts) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
ln AS (SELECT rid, line, count(*) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line),
dup AS (SELECT rid, sum(n - 1) AS n_dup, sum(n) AS n_lines FROM ln GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum([length(x) for x in words]), 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
      FROM w LEFT JOIN covered ON w.rid = covered.rid LEFT JOIN dup ON w.rid = dup.rid),
x AS (SELECT *, n_words < 20 AS r1, 100 * n_repeat_words > 30 * n_words AS r2, 10 * n_symbols > n_words AS r3,
        10 * n_dup_lines > 3 * n_lines AS r4, word_chars < 3 * n_words OR word_chars > 12 * n_words AS r5 FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (r1) AS f1, count(*) FILTER (r2) AS f2, count(*) FILTER (r3) AS f3,
        count(*) FILTER (r4) AS f4, count(*) FILTER (r5) AS f5 FROM x GROUP BY source),
g AS (SELECT source, n, unnest([1, 2, 3, 4, 5]) AS rule, unnest([f1, f2, f3, f4, f5]) AS failed FROM h),
b AS (SELECT rule, m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 0) END AS s
      FROM (SELECT rule, m, raw - m * (1 - m) * each AS v FROM (
        SELECT rule, sum(failed) / sum(n) AS m, var_pop(failed / n) AS raw, avg(1 / n) AS each FROM g GROUP BY rule))),
rate AS (SELECT source, max(coalesce((failed + m * s) / (n + s), m)) AS folder_rate FROM g JOIN b USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r1 OR r2 AS base_failed,
  NOT (r1 OR r2) AND folder_rate <= 0.5 AS kept
FROM x JOIN rate ON x.source IS NOT DISTINCT FROM rate.source
"""


@query("op5_host_rules", OP5_SQL)
def op5_host_rules(spark, sf_dir):
    judged = host_rules.judge_files(as_files(table(spark, sf_dir, "documents")))
    return judged.select(F.col("file_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept")


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    counted = token_counts.count_tokens(
        as_files(table(spark, sf_dir, "documents")), tokenizer_path("piece_bpe_32k.model"), scratch_path(spark, "counts"))
    return counted.select(F.col("file_id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
totals AS (SELECT source, count(*) AS total FROM d GROUP BY source),
ln AS (SELECT rid, source, i, parts[i] AS line, trim(parts[i], chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS k
       FROM (SELECT rid, source, parts, unnest(range(1, len(parts) + 1)) AS i
             FROM (SELECT rid, source, string_split(text, chr(10)) AS parts FROM d WHERE text IS NOT NULL))),
bad AS (SELECT c.source, c.k FROM (SELECT source, k, count(DISTINCT rid) AS n FROM ln WHERE k <> '' GROUP BY source, k) c
        JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE c.n >= 3 AND c.n > 0.1 * t.total),
mark AS (SELECT ln.*, bad.k IS NOT NULL AS dropped FROM ln LEFT JOIN bad
         ON ln.source IS NOT DISTINCT FROM bad.source AND ln.k = bad.k),
txt AS (SELECT rid, count(*) FILTER (dropped) AS n, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') AS text
        FROM mark GROUP BY rid)
SELECT doc_id, txt.text AS text, CAST(coalesce(n, 0) AS BIGINT) AS lines_dropped FROM d LEFT JOIN txt ON d.rid = txt.rid
"""


@query("op7_line_dedup", OP7_SQL)
def op7_line_dedup(spark, sf_dir):
    cleaned = repeated_lines.drop_site_lines(as_files(table(spark, sf_dir, "documents")))
    return cleaned.select(F.col("file_id").alias("doc_id"), "text", "lines_dropped")


def _base32_sql(hexed: str) -> str:
    alphabet = archive.BASE32
    return " || ".join(
        f"substr('{alphabet}', CAST((('0x' || substr({hexed}, {1 + 5 * i}, 5))::BIGINT >> {shift}) & 31 AS INTEGER) + 1, 1)"
        for i in range(8) for shift in (15, 10, 5, 0)
    )


OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT html, max(page_id) AS original FROM p GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, {_base32_sql('h')} AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM p JOIN o ON p.html = o.html
"""


@query("op10_warc", OP10_SQL)
def op10_warc(spark, sf_dir):
    path = scratch_path(spark, "warc")
    archive.write_archives(table(spark, sf_dir, "pages"), path)
    return archive.read_archives(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark, sf_dir):
    packed = packing.pack_files(as_files(table(spark, sf_dir, "documents")), tokenizer_path("word_bpe_49k.json"))
    return packed.withColumnRenamed("file_id", "doc_id")


def as_labels(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").alias("file_id"), "quality")


@query("op8_line_quality")
def op8_line_quality(spark, sf_dir):
    files = as_files(table(spark, sf_dir, "documents")).select("file_id", "text")
    judged = line_quality.judge_quality(files, as_labels(table(spark, sf_dir, "labels")))
    return judged.select(F.col("file_id").alias("doc_id"), "held_out", "score", "predicted")


@query("op4_nearest_neighbours")
def op4_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest_vectors(vectors, vectors.filter("vec_id % 100 = 0"))


@query("op1_personal_data")
def op1_personal_data(spark, sf_dir):
    found = personal_data.find_private_spans(as_files(table(spark, sf_dir, "documents")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        F.col("file_id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(list_slice(w, i, i + 4), ' ') for i in range(1, len(w) - 3)]) END AS s FROM d),
c AS (SELECT list_sort(s) AS s, min(rid) AS cid FROM g WHERE len(s) > 0 GROUP BY list_sort(s)),
e AS (SELECT cid, len(s) AS n, unnest(s) AS t FROM c),
f AS (SELECT a.cid AS x, b.cid AS y FROM e a JOIN e b ON a.t = b.t AND a.cid < b.cid
      GROUP BY a.cid, b.cid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM f UNION ALL SELECT y, x FROM f),
r(x, y) AS (SELECT cid, cid FROM c UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
k AS (SELECT r.x, min(doc_id) AS component_id FROM r JOIN c ON r.y = c.cid JOIN g ON list_sort(g.s) = c.s GROUP BY r.x)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, coalesce(k.component_id, g.doc_id) AS component_id
FROM g LEFT JOIN c ON list_sort(g.s) = c.s LEFT JOIN k ON k.x = c.cid
"""


@query("op2_similar_files", OP2_SQL)
def op2_similar_files(spark, sf_dir):
    grouped = similar_files.group_similar(as_files(table(spark, sf_dir, "documents")))
    return grouped.withColumnRenamed("file_id", "doc_id")


# The checksum runs over the bits of the decimal id, the tree over levels of whole runs.
OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS rid, *, list_reduce([4294967295::BIGINT] || flatten([[(ascii(c) >> b) & 1 for b in range(8)] for c in string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384::BIGINT) ELSE xor(a, x) >> 1 END) AS crc FROM documents),
v AS (SELECT *, CASE WHEN xor(crc, 4294967295::BIGINT) % 5 = 0
        THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now_text FROM t),
e AS (SELECT rid, doc_id, source, now_text, text,
        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM v),
l AS (SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(strlen(now_text) || ':' || now_text, '-')) AS now_leaf FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
        count(*) OVER (PARTITION BY source) AS n FROM l),
nodes(source, lv, i, m, h) AS (
  SELECT source, 0, i, n, leaf FROM r
  UNION ALL
  SELECT source, lv + 1, i // 16, (m + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE m > 1 GROUP BY source, lv, i // 16, m),
subs AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS f, count(*) OVER () AS folders FROM nodes WHERE m = 1),
tops(lv, i, m, h) AS (
  SELECT 0, f, folders, subroot FROM subs
  UNION ALL
  SELECT lv + 1, i // 16, (m + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE m > 1 GROUP BY lv, i // 16, m),
docs AS (SELECT r.*, s.subroot, s.f FROM r JOIN subs s ON r.source IS NOT DISTINCT FROM s.source),
steps AS (
  SELECT d.rid, x.lv AS step, x.i = d.i // CAST(power(16, x.lv) AS BIGINT) AS own, x.i, x.h
  FROM docs d JOIN nodes x ON d.source IS NOT DISTINCT FROM x.source AND x.m > 1 AND x.i // 16 = d.i // CAST(power(16, x.lv + 1) AS BIGINT)
  UNION ALL
  SELECT d.rid, 100 + x.lv, x.i = d.f // CAST(power(16, x.lv) AS BIGINT), x.i, x.h
  FROM docs d JOIN tops x ON x.m > 1 AND x.i // 16 = d.f // CAST(power(16, x.lv + 1) AS BIGINT)),
path AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY step) AS k, coalesce(string_agg(h, '' ORDER BY i) FILTER (NOT own), '') AS others,
           max(i) FILTER (own) - min(i) AS slot FROM steps GROUP BY rid, step),
fold(rid, k, h) AS (
  SELECT rid, 0, now_leaf FROM docs
  UNION ALL
  SELECT p.rid, f.k + 1, sha256(substr(p.others, 1, 64 * p.slot) || f.h || substr(p.others, 64 * p.slot + 1)) FROM fold f JOIN path p ON f.rid = p.rid AND p.k = f.k + 1),
done AS (SELECT rid, arg_max(h, k) AS folded_root FROM fold GROUP BY rid),
proof AS (SELECT rid, string_agg(others, '' ORDER BY k) AS others FROM path GROUP BY rid)
SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE m = 1) AS root, sha256(coalesce(others, '')) AS proof_sha256, folded_root,
  folded_root = (SELECT h FROM tops WHERE m = 1) AS verified
FROM docs JOIN done ON docs.rid = done.rid LEFT JOIN proof ON docs.rid = proof.rid
"""


@query("op11_merkle_manifest", OP11_SQL)
def op11_merkle_manifest(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").withColumnsRenamed({"doc_id": "file_id", "source": "folder_id"})
    touched = F.crc32(F.col("file_id").cast("string").cast("binary")) % 5 == 0
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.when(touched, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    proven = manifest.prove_files(documents, ("file_id", "folder_id", "lang", "n_chars", "text"), current={"text": text})
    siblings = F.flatten(F.transform("proof", lambda s: s["siblings"]))
    return proven.select(F.col("file_id").alias("doc_id"), "leaf", "subroot", "root",
                         F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), "folded_root", "verified")


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT l.lang, count(k.term) AS v, coalesce(sum(k.total), 0) AS words FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k ON l.lang = k.lang GROUP BY l.lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
f AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS own
      FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT f.*, 1 + CAST((1000000000::HUGEINT * (n + 5)) // (own + 5 * v) AS BIGINT) AS p,
        1 + CAST((1000000000::HUGEINT * (total + 5)) // (words + 5 * v) AS BIGINT) AS q FROM f JOIN v ON f.lang = v.lang),
s AS (SELECT a.lang, a.source, b.source AS peer, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.peer = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) x
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50
"""


@query("op13_source_divergence", OP13_SQL)
def op13_source_divergence(spark, sf_dir):
    given = {c: F.coalesce(c, F.lit("")) for c in ("text", "lang", "source")}
    files = table(spark, sf_dir, "documents").select(
        given["lang"].alias("user_id"), given["source"].alias("folder_id"), given["text"].alias("text"))
    return divergence.audit_folders(files).withColumnsRenamed({"user": "lang", "folder": "source"})


@query("op12_embedding_near_dedup")
def op12_embedding_near_dedup(spark, sf_dir):
    return near_vectors.link_near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
