"""One registered query per numbered operator: given tables to the operator's interface, its result back."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docuvet.llm import (
    bpe, face_links, face_search, fill_middle, manifest, near_text, packing, page_text, quality, sharding, storage, token_files,
    token_grammar, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("raw_text"), *extra)


@query
def op3_pack_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


#: The published jump hash, one recursion a jump, and the checksum byte by byte with a table built from its polynomial.
JUMP_SQL = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
),
checksum AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
keyed AS (
  SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, ''))) AS bytes, hex(encode(coalesce(text, ''))) AS h,
    CASE WHEN coalesce(doc_id, 0) < 0 THEN coalesce(doc_id, 0)::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END::UHUGEINT AS key
  FROM documents
),
jumps(r, key, place, shard, grown) AS (
  SELECT r, key, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM keyed
  UNION ALL
  SELECT r, key, CAST(floor((place + 1) * (2147483648::DOUBLE / ((key // 8589934592) + 1)::DOUBLE)) AS BIGINT),
    CASE WHEN place < 24 THEN place ELSE shard END, place
  FROM (SELECT r, (key * 2862933555777941757 + 1) % 18446744073709551616 AS key, place, shard FROM jumps WHERE place < 25)
),
ended AS (SELECT r, max(shard) AS shard, max(grown) AS grown FROM jumps GROUP BY r),
placed AS (
  SELECT k.doc_id, k.bytes + 8 AS size, xor(list_reduce(list_transform(range(k.bytes), lambda i: CAST('0x' || substr(k.h, 2 * i + 1, 2) AS BIGINT)),
      lambda a, b: xor(a >> 8, c.t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32,
    e.shard, e.grown, (k.key * 2862933555777941757 + 1) % 18446744073709551616 AS mix
  FROM keyed k JOIN ended e USING (r), checksum c
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY mix, doc_id, text_crc32, size) - 1 AS slot, CAST(grown AS INT) AS grown_shard
FROM placed"""
ORACLES["op4_jump_shards"] = JUMP_SQL


@query
def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir), 24)


@query
def op7_overlap_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


#: All pairs that share a run of four words, then everything reachable.
NEAR_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM worded
),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
low AS (SELECT a AS doc_id, min(b) AS low FROM reached GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept FROM sets LEFT JOIN low USING (doc_id)"""
ORACLES["op8_setsketch_near_text"] = NEAR_SQL


@query
def op8_setsketch_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.link_documents(_documents(spark, sf_dir))


def _held_out(modulus: int, remainder: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus == remainder


@query
def op1_bag_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~_held_out(5, 0)).select("doc_id", F.col("toxic").alias("abusive"))
    scored = toxicity.score_documents(_documents(spark, sf_dir), labels)
    return scored.select(
        "doc_id", _held_out(5, 0).alias("held_out"), "score", F.col("abusive").alias("predicted"), "n_sentences", "offending"
    )


@query
def op10_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~_held_out(4, 2)).select("doc_id", F.col("quality").alias("accepted"))
    scored = quality.score_documents(_documents(spark, sf_dir, "n_chars"), labels, ("n_chars",))
    return scored.select("doc_id", _held_out(4, 2).alias("held_out"), "score", F.col("accepted").alias("predicted"))


@query
def op2_style_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("case_id"), F.col("embedding").alias("selfie_embedding"))


#: Cosines of all pairs, then everything reachable.
FACES_SQL = """
WITH RECURSIVE given AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
sized AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM given WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sized a JOIN sized b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND len(a.e) = len(b.e)
    AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95::DOUBLE
),
counted AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
low AS (SELECT a AS vec_id, min(b) AS low FROM reached GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM given LEFT JOIN counted USING (vec_id) LEFT JOIN low USING (vec_id)"""
ORACLES["op5_projection_forest_faces"] = FACES_SQL


@query
def op5_projection_forest_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return face_links.link_faces(_faces(spark, sf_dir)).withColumnRenamed("case_id", "vec_id")


@query
def op6_prefix_forest_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _faces(spark, sf_dir)
    found = face_search.nearest_faces(faces, faces.filter("case_id % 50 = 0"))
    return found.select("query_id", "rank", F.col("case_id").alias("vec_id"), "score")


@query
def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, counted in flat token files that are written from all documents first."""
    path = storage.new_path(spark, "tokens")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    token_files.write_token_files(_documents(spark, sf_dir), path, ranks, public_tokenizers.PATTERN)
    return token_files.token_counts(spark, path).select("doc_id", "n_tokens")


#: The tree of each source and the tree over their subroots, level by level, with the siblings of every node; then each leaf folded.
MANIFEST_SQL = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
),
checksum AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
keyed AS (
  SELECT d.*, doc_id::VARCHAR AS number,
    'l' || coalesce('s' || source, '') AS tree FROM documents d
),
described AS (
  SELECT k.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(number)), lambda i: ascii(substr(number, (i + 1)::INT, 1))::BIGINT)),
      lambda a, b: xor(a >> 8, c.t[((xor(a, b) & 255) + 1)::INT])), 4294967295) % 5 = 0 AS changed,
    coalesce(octet_length(encode(number)) || ':' || number, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head
  FROM keyed k, checksum c
),
hashed AS (
  SELECT tree, doc_id, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN changed THEN sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS altered
  FROM described
),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
nodes(tree, level, place, digest) AS (
  SELECT tree, 0, place, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 16, sha256(string_agg(digest, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1 GROUP BY tree, level, place // 16
),
highest AS (SELECT * FROM nodes QUALIFY level = max(level) OVER (PARTITION BY tree)),
tops AS (SELECT tree, level, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM highest),
heads(level, place, digest) AS (
  SELECT 0, place, digest FROM tops
  UNION ALL
  SELECT level + 1, place // 16, sha256(string_agg(digest, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER () AS n FROM heads) WHERE n > 1 GROUP BY level, place // 16
),
runs AS (
  SELECT n.tree, n.level, n.place, n.digest FROM nodes n JOIN tops t ON n.tree = t.tree AND n.level < t.level
  UNION ALL SELECT '', h.level, h.place, h.digest FROM heads h WHERE h.level < (SELECT max(level) FROM heads)
),
beside AS (
  SELECT *, coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, place // 16 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS earlier,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, place // 16 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS later
  FROM runs
),
steps AS (
  SELECT l.tree, l.place AS leaf_place, b.level AS step, b.earlier, b.later FROM leaves l JOIN beside b ON b.tree = l.tree AND b.place = l.place // (16 ** b.level)::BIGINT
  UNION ALL
  SELECT l.tree, l.place, 100 + b.level, b.earlier, b.later FROM leaves l JOIN tops t ON t.tree = l.tree JOIN beside b ON b.tree = '' AND b.place = t.place // (16 ** b.level)::BIGINT
),
paths AS (SELECT tree, leaf_place, string_agg(earlier || later, '' ORDER BY step) AS proof, list({'a': earlier, 'b': later} ORDER BY step) AS steps FROM steps GROUP BY ALL),
folded(tree, place, digest, step) AS (
  SELECT tree, place, coalesce(altered, leaf), 0 FROM leaves
  UNION ALL
  SELECT f.tree, f.place, sha256(p.steps[f.step + 1].a || f.digest || p.steps[f.step + 1].b), f.step + 1
  FROM folded f JOIN paths p ON p.tree = f.tree AND p.leaf_place = f.place WHERE f.step < len(p.steps)
),
ended AS (SELECT tree, place, digest FROM folded QUALIFY step = max(step) OVER (PARTITION BY tree, place)),
top AS (SELECT digest AS root FROM heads ORDER BY level DESC LIMIT 1)
SELECT l.doc_id, l.leaf, t.digest AS subroot, top.root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.digest AS folded_root, e.digest = top.root AS verified
FROM leaves l JOIN tops t USING (tree) JOIN ended e ON e.tree = l.tree AND e.place = l.place LEFT JOIN paths p ON p.tree = l.tree AND p.leaf_place = l.place, top"""
ORACLES["op11_interval_manifest"] = MANIFEST_SQL


@query
def op11_interval_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a record of its source; where the checksum says so, its text is presented in lower case."""
    records = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("case_id"), F.col("source").alias("owner_id"), "lang", "n_chars", F.col("text").alias("raw_text")
    )
    fields = ("case_id", "owner_id", "lang", "n_chars", "raw_text")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = manifest.leaf_digest(*[F.translate(F.col(f), upper, upper.lower()) if f == "raw_text" else F.col(f) for f in fields])
    changed = F.crc32(F.col("case_id").cast("string")) % 5 == 0
    proven = manifest.manifest_records(records.withColumn("presented", F.when(changed, lowered)), fields, carried=("presented",))
    folded = manifest.folded_root(F.coalesce("presented", "leaf"), F.col("path"))
    return proven.select(
        F.col("case_id").alias("doc_id"), "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op12_repair_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of all documents' ids, read back from compressed shards that are written from them first."""
    path = storage.new_path(spark, "token-shards")
    token_grammar.write_token_shards(_documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_grammar.read_token_shards(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: Lines by splitting at line feeds; a text that ends with one has no empty last line.
FILL_SQL = """
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
b AS (
  SELECT *, CASE WHEN t = '' THEN []::VARCHAR[] WHEN suffix(t, chr(10)) THEN string_split(t, chr(10))[:-2] ELSE string_split(t, chr(10)) END AS lines,
    [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS r FROM a
),
c AS (SELECT *, len(lines) AS n, least(length(t), list_sum([length(x) + 1 FOR x IN lines])) AS total, least(r[1] % (len(lines) + 1), r[2] % (len(lines) + 1)) AS low,
  greatest(r[1] % (len(lines) + 1), r[2] % (len(lines) + 1)) AS high FROM b),
d AS (
  SELECT *, least(total, coalesce(list_sum([length(x) + 1 FOR x IN lines[1:low]]), 0))::BIGINT AS p, least(total, coalesce(list_sum([length(x) + 1 FOR x IN lines[1:high]]), 0))::BIGINT AS q,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, p) || '<S>' || substr(t, q + 1) || '<M>' || substr(t, p + 1, q - p)
    ELSE '<S>' || substr(t, q + 1) || '<P>' || substr(t, 1, p) || '<M>' || substr(t, p + 1, q - p) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM d"""
ORACLES["op13_captured_fill_middle"] = FILL_SQL


@query
def op13_captured_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(_documents(spark, sf_dir), seed=7, rate=100, spm_rate=50)
    restored = fill_middle.restored_text(F.col("form"), F.col("output"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256")
    )
