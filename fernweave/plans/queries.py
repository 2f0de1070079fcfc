"""The registered queries over the test tables, each beside the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernweave.functions import hashing, paths, symbols, text, vectors
from fernweave.operators import callgraph, catalog, chunking, embedding, graph, index_plan, jobs, positions, search, snapshot, trees
from fernweave.sources import files as scans
from fernweave.session import shared_folder
from fernweave.streaming import branches, incremental

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- search -----------------------------------------------------------------------------------------------------------

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _query_vector(vecs: DataFrame) -> list[float]:
    return vecs.where("vec_id = 0").select("embedding").first()[0]


@query(f"SELECT e.vec_id, e.label, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0 ORDER BY {_COS} DESC, e.vec_id LIMIT 5")
def knn_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return search.top_k(v, _query_vector(v), 5, F.col("vec_id") != 0).select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0 AND e.label = 3 ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def knn_filtered(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return search.top_k(v, _query_vector(v), 10, (F.col("vec_id") != 0) & (F.col("label") == 3)).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""SELECT query_id, rank::INT AS rank, vec_id, round(s, 6) AS score FROM (
  SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank
  FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 5""")
def knn_batch(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.top_k_batch(v, asked, 5).withColumn("score", F.round("score", 6))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def knn_l2_normalised(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    unit = vectors.normalised(F.col("embedding"))
    return v.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("length"), F.round(unit[0], 6).alias("first"))


@query("""SELECT vec_id, version, label FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY version DESC) AS n FROM (
  SELECT vec_id, 0 AS version, label FROM embeddings UNION ALL SELECT vec_id, 1, label + 100 FROM embeddings WHERE vec_id % 3 = 0)) WHERE n = 1""")
def vector_upsert(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"), F.lit(0).alias("version"), "label")
    new = v.where("point_id % 3 = 0").withColumn("version", F.lit(1)).withColumn("label", F.col("label") + 100)
    return search.upsert_points(v, new).select(F.col("point_id").alias("vec_id"), "version", "label")


@query("SELECT vec_id AS node_id, floor((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) / 50)::BIGINT AS batch, label FROM embeddings")
def embed_batches(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "label")
    return jobs.batches(v, "label", ["node_id"]).select("node_id", "batch", "label")


@query("SELECT p_partkey::VARCHAR AS node_id, coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_name END, 'unnamed') AS name, coalesce(CASE WHEN p_partkey % 4 > 0 THEN p_type END, 'unknown') AS kind, '' AS file_path, coalesce(p_brand, '') AS signature FROM part")
def payload_project(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = p.select(k.cast("string").alias("node_id"), F.lit(1.0).alias("score"), F.when(k % 3 > 0, F.col("p_name")).alias("name"), F.when(k % 4 > 0, F.col("p_type")).alias("kind"), F.lit(None).cast("string").alias("file_path"), F.col("p_brand").alias("signature"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("docstring"), F.lit(None).cast("array<string>").alias("identifiers"))
    return search.hits(rows).select("node_id", "name", "kind", "file_path", "signature")


# --- scans and hashes -------------------------------------------------------------------------------------------------

_EXT = "CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.TS' WHEN 'es' THEN '.jsx' ELSE '.md' END"


def _as_files(docs: DataFrame) -> DataFrame:
    ext = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".TS").when(F.col("lang") == "es", ".jsx").otherwise(".md")
    folder = F.when(F.col("doc_id") % 17 == 0, "node_modules").otherwise(F.col("source"))
    content = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit(b"\0"), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    return docs.select("doc_id", F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), ext).alias("relative_path"), F.octet_length("text").cast("bigint").alias("size_bytes"), content.alias("content"), F.col("text"))


_STATUS = f"""SELECT doc_id, text, CASE WHEN doc_id % 17 = 0 THEN 'pruned' WHEN source = 'src3' THEN 'ignored' WHEN {_EXT} = '.md' THEN 'unsupported'
  WHEN strlen(text) > 4000 THEN 'oversized' WHEN doc_id % 13 = 0 THEN 'binary' ELSE 'included' END AS status FROM documents"""
_SCAN = scans.ScanOptions(max_bytes=4_000, ignore=("src3/*", "!src3/nothing"))


@query(f"""SELECT count(*) FILTER (status <> 'pruned') AS discovered, count(DISTINCT CASE WHEN status = 'pruned' THEN 'node_modules' END) AS pruned_directory,
  {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in scans.STATUSES)} FROM ({_STATUS})""")
def scan_stats(spark, sf_dir):
    return scans.scan_statistics(scans.scan(_as_files(table(spark, sf_dir, "documents")), _SCAN))


@query(f"SELECT doc_id, sha256(text) AS content_hash FROM ({_STATUS}) WHERE status = 'included'")
def scan_included(spark, sf_dir):
    return scans.included(scans.scan(_as_files(table(spark, sf_dir, "documents")), _SCAN)).select("doc_id", "content_hash")


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript' END AS language FROM pages")
def language_detect(spark, sf_dir):
    name = F.concat(F.lit("a/b."), F.element_at(F.array(*map(F.lit, ("pyi", "MTS", "cjs", "java", "py/"))), (F.col("page_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", paths.language(name).alias("language"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark, sf_dir):
    return snapshot.duplicates(content_hash(spark, sf_dir), "content_hash")


@query("""SELECT c_custkey, lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '-', 'g')) AS slug, 'github__' || lower(c_name) || '__' || lower(c_mktsegment) AS github_id FROM customer""")
def repository_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    slug = F.split(hashing.local_repository_id(F.col("c_name"), F.lit("/x")), "__")[1]
    return c.select("c_custkey", slug.alias("slug"), hashing.github_repository_id(F.col("c_name"), F.col("c_mktsegment")).alias("github_id"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'src/' || page_id || '/m.py' WHEN 1 THEN NULL WHEN 2 THEN 'a/b/' || page_id ELSE NULL END AS path FROM pages""")
def path_normalise(spark, sf_dir):
    i = F.col("page_id").cast("string")
    raw = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit(" src\\.\\"), i, F.lit("//m.py"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("a/../"), i)).when(F.col("page_id") % 4 == 2, F.concat(F.lit("./a/b/"), i, F.lit("/"))).otherwise(F.concat(F.lit("/abs/"), i))
    return table(spark, sf_dir, "pages").select("page_id", paths.normalize(raw).alias("path"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'own-' || c_custkey || '/repo.x' END AS repository FROM customer""")
def github_urls(spark, sf_dir):
    k, i = F.col("c_custkey"), F.col("c_custkey").cast("string")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://GitHub.com/own-"), i, F.lit("/repo.x.git"))).when(k % 3 == 1, F.concat(F.lit("http://github.com/a/"), i)).otherwise(F.concat(F.lit("https://github.com:443/a/"), i))
    g = paths.github_url(url)
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(g["owner"], F.lit("/"), g["repository"]).alias("repository"))


# --- snapshots and index plans ----------------------------------------------------------------------------------------


def _snapshots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    old = docs.where("doc_id % 10 <> 0").select(path.alias("relative_path"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("content_hash"))
    new = docs.where("doc_id % 11 <> 0").select(path.alias("relative_path"), F.sha2("text", 256).alias("content_hash"))
    return old, new


_DIFF = """SELECT coalesce(o.relative_path, n.relative_path) AS relative_path, o.h AS previous_hash, n.h AS current_hash,
  CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'modified' END AS change
  FROM (SELECT source || '/' || doc_id AS relative_path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 0) o
  FULL JOIN (SELECT source || '/' || doc_id AS relative_path, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0) n ON o.relative_path = n.relative_path"""


@query(_DIFF)
def snapshot_diff(spark, sf_dir):
    return snapshot.diff(*_snapshots(table(spark, sf_dir, "documents")))


@query(f"SELECT relative_path FROM ({_DIFF}) WHERE change = 'deleted'")
def deleted_paths(spark, sf_dir):
    return snapshot_diff(spark, sf_dir).where("change = 'deleted'").select("relative_path")


@query("SELECT source || '/x' AS relative_path, count(DISTINCT sha256(text)) AS n_hashes FROM documents GROUP BY source HAVING count(DISTINCT sha256(text)) > 1")
def path_conflicts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return snapshot.conflicts(d.select(F.concat(F.when(F.col("doc_id") % 2 == 0, "./").otherwise(""), F.col("source"), F.lit("\\x")).alias("relative_path"), F.sha2("text", 256).alias("content_hash")))


@query(f"SELECT relative_path AS file_path, CASE WHEN change = 'deleted' THEN 'source_deleted' ELSE 'replace_file' END AS reason, 'r1' AS repository_id, 'abc' AS revision FROM ({_DIFF}) WHERE change <> 'unchanged'")
def index_plan_deletes(spark, sf_dir):
    return index_plan.deletes(snapshot_diff(spark, sf_dir), " r1 ", "abc")


def _line_chunks(docs: DataFrame) -> DataFrame:
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    lines = positions.line_table(docs.select(path.alias("file_path"), "text"))
    none = F.lit(None).cast("string")
    return lines.select("file_path", F.col("line").alias("chunk_index"), F.lit("python").alias("language"), F.lit("python").alias("parser_name"), "start_byte", (F.col("start_byte") + F.octet_length("line_text")).alias("end_byte"), F.octet_length("line_text").cast("bigint").alias("size"), F.col("line_text").alias("content"), none.alias("symbol_name"), none.alias("symbol_kind"))


_LINES = """SELECT doc_id, source || '/' || doc_id AS file_path, i - 1 AS line, l[i] AS line_text,
  coalesce(list_sum(list_transform(l[1:i-1], lambda x: strlen(x) + 1)), 0)::BIGINT AS start_byte FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents) d, unnest(generate_series(1, len(l))) t(i)"""


@query(f"""SELECT sha256(concat_ws(chr(0), 'index-document-v1', 'r1', file_path, current_hash, line, start_byte, start_byte + strlen(line_text))) AS document_id, file_path, line::INT AS chunk_index, change AS source_change
  FROM ({_LINES}) JOIN ({_DIFF}) ON file_path = relative_path WHERE change IN ('added', 'modified')""")
def index_plan_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return index_plan.documents(_line_chunks(d), snapshot_diff(spark, sf_dir), "r1", "abc").select("document_id", "file_path", "chunk_index", "source_change")


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::BIGINT AS words FROM documents")
def size_measure(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.byte_size(F.col("text")).cast("bigint").alias("bytes"), text.word_size(F.col("text")).cast("bigint").alias("words"))


@query(f"SELECT doc_id, line::INT AS line, start_byte, strlen(line_text)::INT AS bytes FROM ({_LINES})")
def line_table(spark, sf_dir):
    return positions.line_table(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "line", "start_byte", F.octet_length("line_text").alias("bytes"))


@query(f"SELECT doc_id, line::INT AS line, (start_byte + strlen(line_text[1:7]))::BIGINT AS byte FROM ({_LINES})")
def line_char_to_byte(spark, sf_dir):
    lines = positions.line_table(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return positions.to_bytes(lines.select("doc_id", "line", F.lit(7).alias("character")), lines, "doc_id").select("doc_id", "line", F.col("byte").cast("bigint").alias("byte"))


@query("""SELECT doc_id AS file_path, (i / 200)::INT AS chunk_index, i AS start_byte, least(i + 200, length(t)) AS end_byte FROM (SELECT doc_id, regexp_replace(text, '[^a-z]', '', 'g') AS t FROM documents), unnest(generate_series(0, length(t) - 1, 200)) s(i)""")
def chunk_fixed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.lit("python").alias("language"), F.lit("python").alias("parser_name"), F.regexp_replace("text", "[^a-z]", "").cast("binary").alias("content"))
    made = chunking.chunk_files(d, None, chunking.ChunkOptions(200))
    return made.select(F.col("file_path").cast("bigint").alias("file_path"), "chunk_index", "start_byte", "end_byte")


_BYTES = r"regexp_replace(regexp_replace(regexp_replace(text, '[\x{80}-\x{7FF}]', 'xx', 'g'), '[\x{800}-\x{FFFF}]', 'xxx', 'g'), '[\x{10000}-\x{10FFFF}]', 'xxxx', 'g')"
#: A letter stands for each byte of another one, so places of characters are places of bytes.
_FALLBACK = f"""WITH RECURSIVE d AS (SELECT doc_id, {_BYTES} AS t FROM documents WHERE text <> ''),
  c(doc_id, i, a, b) AS (SELECT doc_id, -1, 0::BIGINT, 0::BIGINT FROM d UNION ALL
    SELECT doc_id, i + 1, b, b + CASE WHEN length(t) - b <= 500 THEN length(t) - b WHEN contains(w, chr(10)) THEN 501 - strpos(reverse(w), chr(10)) WHEN regexp_matches(w, '[\\t\\r ]') THEN length(regexp_extract(w, '^(?s:.*)[\\t\\r ]')) ELSE 500 END
    FROM (SELECT c.doc_id, c.i, c.b, d.t, substr(d.t, c.b + 1, 500) AS w FROM c JOIN d USING (doc_id) WHERE c.b < length(d.t)))
  SELECT doc_id::VARCHAR AS file_path, i::INT AS chunk_index, a AS start_byte, b AS end_byte, b - a AS size FROM c WHERE i >= 0"""


@query(_FALLBACK)
def chunk_fallback(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.lit("python").alias("language"), F.lit("python").alias("parser_name"), F.col("text").cast("binary").alias("content"))
    return chunking.chunk_files(d).select("file_path", "chunk_index", "start_byte", "end_byte", "size")


@query("""SELECT doc_id::VARCHAR AS file_path, strlen(text)::BIGINT AS total_bytes, 0::BIGINT AS missing_bytes, 0::BIGINT AS overlap_bytes, true AS is_exact FROM documents""")
def chunk_coverage_exact(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.lit("python").alias("language"), F.lit("python").alias("parser_name"), F.col("text").cast("binary").alias("content"))
    return chunking.coverage(chunking.chunk_files(d), d, 500).select("file_path", "total_bytes", "missing_bytes", "overlap_bytes", "is_exact")


@query("""SELECT source || '/' || doc_id AS file_path, n - 1 AS missing_bytes FROM (SELECT doc_id, source, len(string_split(text, chr(10))) AS n FROM documents)""")
def chunk_coverage(spark, sf_dir):
    """Lines as chunks leave their line breaks out: one missing byte for each."""
    d = table(spark, sf_dir, "documents")
    sources = d.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").cast("binary").alias("content"))
    return chunking.coverage(_line_chunks(d), sources, 1 << 30).select("file_path", F.col("missing_bytes").cast("bigint").alias("missing_bytes"))


@query("""SELECT doc_id AS file_path, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, s AS start_byte, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), n) AS end_byte FROM (SELECT doc_id, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n FROM documents), unnest(CASE WHEN n <= 200 THEN [0] ELSE generate_series(0, n - 1, 180) END) t(s) WHERE n > 0 AND (s = 0 OR n - s > 20)""")
def chunk_merge(spark, sf_dir):
    """Nodes of 60 bytes under a limit of 200: three make a chunk, and a short rest joins the last."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.lit("python").alias("language"), F.lit("python").alias("parser_name"), F.regexp_replace("text", "[^a-z]", "").cast("binary").alias("content"))
    size = F.octet_length("content")
    at = d.where(size > 0).select("file_path", size.alias("n"), F.explode(F.sequence(F.lit(0), size - 1, F.lit(60))).alias("s"))
    none = F.lit(None).cast("string")
    root = d.select("file_path", F.lit("root").alias("id"), none.alias("parent_id"), F.lit(0).cast("bigint").alias("start_byte"), size.cast("bigint").alias("end_byte"), none.alias("name"), F.lit("file").alias("kind"), F.lit("container").alias("node_type"))
    parts = at.select("file_path", F.col("s").cast("string").alias("id"), F.lit("root").alias("parent_id"), F.col("s").cast("bigint").alias("start_byte"), F.least(F.col("s") + 60, "n").cast("bigint").alias("end_byte"), F.concat(F.lit("f"), F.col("s").cast("string")).alias("name"), F.lit("function").alias("kind"), F.lit("function").alias("node_type"))
    made = chunking.chunk_files(d, root.unionByName(parts), chunking.ChunkOptions(200))
    return made.select(F.col("file_path").cast("bigint").alias("file_path"), F.col("chunk_index").cast("bigint").alias("chunk_index"), "start_byte", "end_byte")


@query(f"""WITH c AS (SELECT file_path, line, greatest(start_byte - 2, 0) AS a, start_byte + strlen(line_text) AS b, n FROM ({_LINES}) JOIN (SELECT doc_id AS d, strlen(text) AS n FROM documents) ON d = doc_id),
  v AS (SELECT *, coalesce(max(b) OVER (PARTITION BY file_path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor FROM c)
  SELECT file_path, coalesce(sum(CASE WHEN b > a THEN greatest(least(cursor, b) - a, 0) END), 0)::BIGINT AS overlap_bytes, coalesce(sum(CASE WHEN b > a THEN greatest(a - cursor, 0) END), 0)::BIGINT + any_value(n) - max(b) AS missing_bytes, bool_or(b <= a) AS has_invalid FROM v GROUP BY file_path""")
def chunk_overlaps(spark, sf_dir):
    """Lines that reach two bytes back overlap the line before by one."""
    d = table(spark, sf_dir, "documents")
    sources = d.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").cast("binary").alias("content"))
    wide = _line_chunks(d).withColumn("start_byte", F.greatest(F.col("start_byte") - 2, F.lit(0)))
    got = chunking.coverage(wide, sources, 1 << 30)
    return got.select("file_path", F.col("overlap_bytes").cast("bigint").alias("overlap_bytes"), F.col("missing_bytes").cast("bigint").alias("missing_bytes"), F.array_contains("issues", "invalid range").alias("has_invalid"))


@query(f"""SELECT 'chunks' AS part, count(*) AS n FROM (SELECT unnest(generate_series(0, strlen(text) - 1, 1000000)) FROM documents JOIN ({_DIFF}) ON relative_path = source || '/' || doc_id WHERE change IN ('added', 'modified') AND text <> '')
  UNION ALL SELECT 'unchanged', count(*) FROM ({_DIFF}) WHERE change = 'unchanged' UNION ALL SELECT 'deleted', count(*) FROM ({_DIFF}) WHERE change = 'deleted' UNION ALL SELECT 'current', count(*) FROM ({_DIFF}) WHERE current_hash IS NOT NULL""")
def chunk_batch(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    files = d.select(path.alias("file_path"), F.lit("python").alias("language"), F.lit("python").alias("parser_name"), F.col("text").cast("binary").alias("content"))
    parts = chunking.chunk_batch(snapshot.diff(*_snapshots(d)), files, options=chunking.ChunkOptions(1_000_000))
    rows = [parts[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k in ("chunks", "unchanged", "deleted", "current")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


_ODD_CHUNKS = "SELECT p_partkey AS k, 'p' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '.md' ELSE '.py' END AS f FROM part"


@query(f"""SELECT f AS file_path, problem FROM ({_ODD_CHUNKS}), unnest(CASE WHEN k % 5 = 0 THEN ['unknown language'] ELSE [] END || CASE WHEN k % 7 = 0 THEN ['chunk over limit'] ELSE [] END || CASE WHEN k % 11 = 0 THEN ['chunk index'] ELSE [] END || CASE WHEN k % 13 = 0 AND k % 23 <> 0 THEN ['malformed hash'] ELSE [] END || CASE WHEN k % 17 = 0 THEN ['inexact coverage'] ELSE [] END || CASE WHEN k % 5 <> 0 AND k % 19 = 0 THEN ['language mismatch'] ELSE [] END || CASE WHEN k % 23 = 0 THEN ['unexpected chunks'] ELSE [] END) t(problem)""")
def index_problems(spark, sf_dir):
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(k, F.concat(F.lit("p"), k.cast("string"), F.when(k % 5 == 0, ".md").otherwise(".py")).alias("file_path"))
    lit = lambda x: F.lit(x).cast("bigint")
    chunks = parts.select("file_path", F.when(k % 11 == 0, 3).otherwise(0).alias("chunk_index"), F.when(k % 19 == 0, "javascript").otherwise("python").alias("language"), F.lit("python").alias("parser_name"), lit(0).alias("start_byte"), lit(5).alias("end_byte"), F.when(k % 7 == 0, lit(900)).otherwise(lit(5)).alias("size"), F.lit("x = 1").alias("content"))
    changes = parts.where(k % 23 != 0).select(F.col("file_path").alias("relative_path"), F.lit(None).cast("string").alias("previous_hash"), F.when(k % 13 == 0, "xyz").otherwise(F.sha2("file_path", 256)).alias("current_hash"), F.lit("added").alias("change"))
    covered = parts.select("file_path", (k % 17 != 0).alias("is_exact"))
    return index_plan.problems(chunks, changes, covered, 500)


@query("SELECT source || '/x' AS relative_path, 'more than one row' AS problem FROM documents GROUP BY source HAVING count(*) > 1 UNION ALL SELECT '../' || page_id, 'invalid path' FROM pages")
def snapshot_violations(spark, sf_dir):
    d, p = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    rows = d.select(F.concat(F.col("source"), F.lit("\\x")).alias("relative_path")).union(p.select(F.concat(F.lit("../"), F.col("page_id").cast("string"))))
    return snapshot.violations(rows)


@query(f"SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (change = 'deleted') AS deleted, bool_or(change <> 'unchanged') AS has_changes FROM ({_DIFF})")
def snapshot_summary(spark, sf_dir):
    return snapshot.summary(snapshot_diff(spark, sf_dir))


@query(f"""SELECT doc_id, line::INT AS line, (start_byte + strlen(line_text[1:3]))::BIGINT AS start_byte, CASE WHEN line % 2 = 0 THEN start_byte + strlen(line_text[1:9]) WHEN next IS NULL THEN start_byte + strlen(line_text) ELSE next + strlen(after[1:2]) END::BIGINT AS end_byte
  FROM (SELECT *, lead(start_byte) OVER w AS next, lead(line_text) OVER w AS after FROM ({_LINES}) WINDOW w AS (PARTITION BY doc_id ORDER BY line))""")
def scip_spans(spark, sf_dir):
    """Ranges of three numbers inside a line, and of four that reach into the next one or past the end of the file."""
    lines = positions.line_table(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    at = F.col("line")
    spans = lines.select("doc_id", "line", F.when(at % 2 == 0, F.array(at, F.lit(3), F.lit(9))).otherwise(F.array(at, F.lit(3), at + 1, F.lit(2))).alias("scip_range"))
    return positions.scip_spans(spans, lines, "doc_id").select("doc_id", "line", F.col("start_byte").cast("bigint").alias("start_byte"), F.col("end_byte").cast("bigint").alias("end_byte"))


# --- text functions ---------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


@query(rf"""WITH w AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(replace(regexp_replace(n, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_', ' ')), '\s+'), lambda x: length(x) >= 2 AND x NOT IN ({_STOP}) AND NOT regexp_full_match(x, '[0-9]+')) AS ws
  FROM (SELECT p_partkey, unnest([p_name, replace(p_type, ' ', '_'), 'getUserId' || p_size]) AS n FROM part))
SELECT p_partkey, array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN len(ws) > 1 THEN list_concat([array_to_string(ws, ' ')], ws) ELSE ws END)))), ',') AS terms FROM w GROUP BY p_partkey""")
def identifier_terms(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    names = F.array(F.col("p_name"), F.replace("p_type", F.lit(" "), F.lit("_")), F.concat(F.lit("getUserId"), F.col("p_size").cast("string")))
    return p.select("p_partkey", F.array_join(text.identifier_terms(names), ",").alias("terms"))


_NAMED = "CASE turn % 3 WHEN 0 THEN 'get_user' WHEN 1 THEN regexp_extract(text, '[A-Za-z]+') ELSE 'userName' END"


@query(rf"""SELECT conv_id, turn, length(trim(text, '"'' ')) >= 25 AND len(list_filter(list_distinct(regexp_extract_all(lower(text), '[\w\x{{80}}-\x{{10FFFF}}]+')), lambda x: x <> lower({_NAMED}) AND x NOT IN ({_STOP}))) >= 3 AS useful FROM conversations""")
def useful_docstring(spark, sf_dir):
    name = F.when(F.col("turn") % 3 == 0, "get_user").when(F.col("turn") % 3 == 1, F.regexp_extract("text", "[A-Za-z]+", 0)).otherwise("userName")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.useful_docstring(F.col("text"), name).alias("useful"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'async def ' || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'unnamed_function' END || '(a: Any)' WHEN 1 THEN 'class ' || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'unnamed_class' END || CASE WHEN p_partkey % 5 = 0 THEN '(' || p_type || ', B)' ELSE '' END ELSE 'construct ' || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'unnamed' END END AS signature FROM part""")
def node_signature(spark, sf_dir):
    k = F.col("p_partkey")
    kind = F.when(F.col("p_size") % 3 == 0, "function").when(F.col("p_size") % 3 == 1, "type-definition").otherwise("variable")
    name = F.when(k % 2 == 0, F.col("p_brand")).when(k % 4 == 1, "")
    params = F.array(F.struct(F.lit("a").alias("name"), F.when(k % 3 == 0, "").alias("type"), F.lit("").alias("value")))
    bases = F.when(k % 5 == 0, F.array(F.col("p_type"), F.lit("B"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", text.node_signature(kind, name, params, F.lit(""), F.lit(True), bases).alias("signature"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE p_brand END AS shown FROM part")
def embedding_input(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", text.embedding_input(F.when(k % 3 == 0, F.col("p_name")).when(k % 2 == 0, ""), F.when(k % 3 == 1, F.col("p_type")).when(k % 2 == 0, ""), F.col("p_brand")).alias("shown"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'async def ' ELSE 'def ' END || 'f' || o_orderkey || '(' || string_agg('p' || l_linenumber || ': ' || coalesce(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END, 'Any') || CASE WHEN l_linestatus = 'O' THEN ' = ' || l_suppkey ELSE '' END, ', ' ORDER BY l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END NULLS FIRST, CASE WHEN l_linestatus = 'O' THEN l_suppkey::VARCHAR END NULLS FIRST) || ') -> ' || o_orderstatus AS signature
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus""")
def signature_render(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("name"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("type"), F.when(F.col("l_linestatus") == "O", F.col("l_suppkey").cast("string")).alias("value"))
    params = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "name", "type", "value"))).alias("params"))
    o = table(spark, sf_dir, "orders").join(params, F.col("o_orderkey") == F.col("l_orderkey"))
    name = F.concat(F.lit("f"), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", text.function_signature(name, F.col("params"), F.col("o_orderstatus"), F.col("o_orderkey") % 2 == 0).alias("signature"))


@query("""SELECT s_suppkey, 'scip-python' AS scheme, n_name AS package, '1.0' AS version, 'S' || s_suppkey AS display_name, 'method' AS kind, true AS is_well_formed FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def symbol_parse(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    made = s.select("s_suppkey", F.concat(F.lit("scip-python . "), F.replace("n_name", F.lit(" "), F.lit("  ")), F.lit(" 1.0 `my pkg`/K#S"), F.col("s_suppkey").cast("string"), F.lit("().")).alias("symbol"))
    parsed = symbols.parse_symbols(made).select("symbol", "scheme", "package", "version", "display_name", "kind", "is_well_formed")
    return made.join(parsed, "symbol").drop("symbol")


_SYMBOL = "CASE WHEN user_id % 4 = 0 THEN 'local ' || (user_id % 50) ELSE 'sym ' || user_id END"


@query(f"SELECT event_id, CASE WHEN user_id % 4 = 0 THEN {_SYMBOL} || '@' || event_type ELSE {_SYMBOL} END AS symbol FROM events")
def qualify_symbols(spark, sf_dir):
    return _events_with_symbol(spark, sf_dir).select("event_id", symbols.qualify(F.col("symbol"), F.col("event_type")).alias("symbol"))


def _events_with_symbol(spark, sf_dir):
    u = F.col("user_id")
    return table(spark, sf_dir, "events").withColumn("symbol", F.when(u % 4 == 0, F.concat(F.lit("local "), (u % 50).cast("string"))).otherwise(F.concat(F.lit("sym "), u.cast("string"))))


@query(f"SELECT DISTINCT {_SYMBOL} AS symbol FROM events WHERE user_id % 4 <> 0 AND {_SYMBOL} NOT IN (SELECT {_SYMBOL} FROM events WHERE event_type = 'signup' AND user_id % 3 = 0)")
def external_symbols(spark, sf_dir):
    e = _events_with_symbol(spark, sf_dir)
    return callgraph.external_symbols(e, e.where("event_type = 'signup' AND user_id % 3 = 0"))


# --- call graph -------------------------------------------------------------------------------------------------------

#: Fifty files, so they grow with the tables.
_NODES = "SELECT l_suppkey % 50 AS file, 'n' || (l_partkey % 3) AS name, l_orderkey * 10 + l_linenumber AS id, l_partkey % 97 AS s, l_partkey % 97 + (l_quantity * 4)::BIGINT AS e, l_orderkey * 10 + l_linenumber AS ord, l_returnflag = 'A' AS defines FROM lineitem"
_OCCS = "SELECT o_custkey % 50 AS file, 'n' || (o_orderkey % 3) AS text, 'sym' || (o_orderkey % 211) AS symbol, o_orderkey AS ord, o_custkey % 150 AS s, o_custkey % 150 + 3 AS e, o_orderstatus = 'F' AS defines FROM orders"
_INNER = f"SELECT o.file, o.ord, o.symbol, o.text, arg_min(n.id, (NOT n.defines, n.e - n.s, n.ord)) AS node FROM ({_NODES}) n JOIN ({_OCCS}) o ON n.file = o.file AND n.name = o.text AND n.s <= o.s AND o.e <= n.e"
_DEFS = f"SELECT symbol, arg_min(node, (file, tord, ord)) AS node FROM (SELECT i.*, t.tord FROM ({_INNER} WHERE o.defines GROUP BY ALL) i JOIN (SELECT file, text, min(ord) AS tord FROM ({_OCCS}) WHERE defines GROUP BY ALL) t USING (file, text)) GROUP BY symbol"
_REFS = f"SELECT n.id AS node, arg_min(o.symbol, o.ord) AS symbol FROM ({_NODES}) n JOIN ({_OCCS}) o ON n.file = o.file AND n.name = o.text AND n.s <= o.s AND o.e <= n.e WHERE NOT n.defines AND NOT o.defines GROUP BY n.file, n.id"
_RESOLVED = f"SELECT r.node, r.symbol, d.node AS target FROM ({_REFS}) r LEFT JOIN ({_DEFS}) d USING (symbol) WHERE d.node IS NULL OR d.node <> r.node"


def _code(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    q = F.col
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    ident = q("l_orderkey") * 10 + q("l_linenumber")
    start = q("l_partkey") % 97
    nodes = li.select((q("l_suppkey") % 50).alias("file"), ident.alias("id"), F.concat(F.lit("n"), (q("l_partkey") % 3).cast("string")).alias("name"), start.alias("start_byte"), (start + (q("l_quantity") * 4).cast("bigint")).alias("end_byte"), ident.alias("node_ordinal"), (q("l_returnflag") == "A").alias("is_definition"), (q("l_returnflag") != "A").alias("is_reference"))
    occ = o.select((q("o_custkey") % 50).alias("file"), F.concat(F.lit("n"), (q("o_orderkey") % 3).cast("string")).alias("text"), F.concat(F.lit("sym"), (q("o_orderkey") % 211).cast("string")).alias("symbol"), q("o_orderkey").alias("ordinal"), (q("o_custkey") % 150).alias("start_byte"), (q("o_custkey") % 150 + 3).alias("end_byte"), (q("o_orderstatus") == "F").alias("is_definition"))
    return nodes, occ


@query(f"SELECT file, ord AS ordinal, symbol, node FROM ({_INNER} GROUP BY ALL)")
def innermost_container(spark, sf_dir):
    return callgraph.innermost(*_code(spark, sf_dir))


@query(_DEFS)
def symbol_definitions(spark, sf_dir):
    return callgraph.definitions(*_code(spark, sf_dir))


@query(_REFS)
def first_reference(spark, sf_dir):
    return callgraph.references(*_code(spark, sf_dir))


@query(_RESOLVED)
def resolve_references(spark, sf_dir):
    return callgraph.linked(*_code(spark, sf_dir))


@query(f"SELECT count(target) AS connected, count(*) - count(target) AS external FROM ({_RESOLVED})")
def reference_counts(spark, sf_dir):
    return callgraph.link_counts(resolve_references(spark, sf_dir))


@query(f"SELECT DISTINCT node AS src, target AS dst, 'REFERENCE_TO' AS type FROM ({_RESOLVED}) WHERE target IS NOT NULL")
def call_graph(spark, sf_dir):
    return callgraph.build(*_code(spark, sf_dir))


# --- graph ------------------------------------------------------------------------------------------------------------

_TREE = "SELECT 'r' || r_regionkey AS id, NULL AS parent_id, 'type-definition' AS node_type FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN 'variable' ELSE 'function' END FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'function' FROM customer"
_EDGES = "SELECT 'c' || c_custkey AS src, 's' || (c_custkey % 7) AS dst FROM customer UNION ALL SELECT 'n' || n_nationkey, 's' || (n_nationkey % 3) FROM nation"


def _tree(spark, sf_dir) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    return (
        r.select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("type-definition").alias("node_type"))
        .unionByName(n.select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent_id"), F.when(F.col("n_nationkey") % 3 == 0, "variable").otherwise("function").alias("node_type")))
        .unionByName(c.select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent_id"), F.lit("function").alias("node_type")))
    )


def _tree_edges(spark, sf_dir) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    edge = lambda p, k, m: [F.concat(F.lit(p), F.col(k).cast("string")).alias("src"), F.concat(F.lit("s"), (F.col(k) % m).cast("string")).alias("dst")]
    return c.select(*edge("c", "c_custkey", 7)).unionByName(n.select(*edge("n", "n_nationkey", 3)))


_BELOW = f"WITH RECURSIVE t AS ({_TREE}), b(root, id, depth) AS (SELECT id, id, 0 FROM t WHERE id IN ('r1', 'r2', 'n4') UNION ALL SELECT b.root, t.id, b.depth + 1 FROM b JOIN t ON t.parent_id = b.id)"


def _roots(spark):
    return spark.createDataFrame([("r1",), ("r2",), ("n4",)], "id string")


@query(f"{_BELOW} SELECT root, id, depth::INT AS depth FROM b")
def subtree_closure(spark, sf_dir):
    return graph.subtree(_tree(spark, sf_dir), _roots(spark))


@query(f"{_BELOW} SELECT root, src, dst FROM b JOIN ({_EDGES}) e ON e.src = b.id")
def callees(spark, sf_dir):
    return graph.callees(_tree_edges(spark, sf_dir), _tree(spark, sf_dir), _roots(spark))


#: Places in a walk with children by id: paths of ids sort as the walk goes; a node counts for each id of its path.
_WALK = f"""WITH RECURSIVE t AS ({_TREE}), b(id, tree, depth, path) AS (SELECT id, id, 0, [id] FROM t WHERE parent_id IS NULL UNION ALL SELECT t.id, tree, depth + 1, path || [t.id] FROM b JOIN t ON t.parent_id = b.id),
  w AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY path) - 1 AS first FROM b), z AS (SELECT a AS id, count(*) AS size FROM (SELECT unnest(path) AS a FROM b) GROUP BY a)"""


def _labels(spark, sf_dir) -> DataFrame:
    return trees.label(_tree(spark, sf_dir).select("*", F.col("id").alias("name"), F.col("node_type").alias("kind")))


@query(f"{_WALK} SELECT id, tree, depth::BIGINT AS depth, first, first + size AS last FROM w JOIN z USING (id)")
def tree_labels(spark, sf_dir):
    return _labels(spark, sf_dir).select("id", "tree", "depth", "first", "last")


@query(f"{_BELOW} SELECT root, id, depth::BIGINT AS level FROM b")
def subtree_by_interval(spark, sf_dir):
    return trees.below(_labels(spark, sf_dir), _roots(spark)).select("root", "id", "level")


@query(f"{_WALK} SELECT b.id AS leaf, a AS id FROM (SELECT id, unnest(path) AS a FROM b) b")
def ancestors_by_interval(spark, sf_dir):
    labels = _labels(spark, sf_dir)
    return trees.above(labels, labels).select("leaf", "id")


@query(f"{_WALK}, e AS (SELECT * FROM ({_EDGES}) UNION ALL SELECT * FROM ({_EDGES}) WHERE src LIKE 'n%') SELECT r.id AS root, row_number() OVER (PARTITION BY r.id ORDER BY w.first, dst) - 1 AS place, src, dst FROM w r JOIN z USING (id) JOIN w ON w.tree = r.tree AND w.first >= r.first AND w.first < r.first + z.size JOIN e ON e.src = w.id WHERE r.id NOT LIKE 'c%'")
def callees_in_order(spark, sf_dir):
    edges = _tree_edges(spark, sf_dir)
    labels = _labels(spark, sf_dir)
    return trees.callees(edges.unionByName(edges.where("src LIKE 'n%'")), labels, labels.where("id NOT LIKE 'c%'"))


@query("""WITH c AS (SELECT 'n' || c_nationkey AS n, string_agg('{"id":"c' || c_custkey || '","name":"c' || c_custkey || '","type":"function","children":[]}', ',' ORDER BY 'c' || c_custkey) AS j FROM customer GROUP BY 1),
  n AS (SELECT 'r' || n_regionkey AS r, string_agg('{"id":"n' || n_nationkey || '","name":"n' || n_nationkey || '","type":"function","children":[' || coalesce(j, '') || ']}', ',' ORDER BY 'n' || n_nationkey) AS j FROM nation LEFT JOIN c ON n = 'n' || n_nationkey WHERE n_nationkey % 3 <> 0 GROUP BY 1)
  SELECT 'r' || r_regionkey AS tree, '[' || coalesce(j, '') || ']' AS outline FROM region LEFT JOIN n ON r = 'r' || r_regionkey""")
def outline_nested(spark, sf_dir):
    return trees.outline_json(_labels(spark, sf_dir))


@query(f"SELECT dst, src, node_type FROM ({_EDGES}) JOIN ({_TREE}) ON id = src WHERE dst = 's1'")
def usages(spark, sf_dir):
    return graph.usages(_tree_edges(spark, sf_dir).where("dst = 's1'"), _tree(spark, sf_dir)).select("dst", "src", "node_type")


@query(f"WITH RECURSIVE t AS (SELECT * FROM ({_TREE}) WHERE node_type <> 'variable'), b(root, id, depth) AS (SELECT id, id, 0 FROM t WHERE id IN ('r1', 'r2', 'n4') UNION ALL SELECT b.root, t.id, b.depth + 1 FROM b JOIN t ON t.parent_id = b.id) SELECT root, id, depth::INT AS depth FROM b")
def file_outline(spark, sf_dir):
    return graph.outline(_tree(spark, sf_dir), _roots(spark)).select("root", "id", "depth")


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS k, (SELECT count(*) FROM customer) AS n FROM customer), e AS (SELECT k AS src, (k * 7 + 3) % n AS dst FROM c UNION SELECT k, (k * 3) % n FROM c WHERE k % 2 = 0),
  r(id) AS (SELECT 5::BIGINT UNION SELECT e.dst FROM r JOIN e ON e.src = r.id) SELECT id FROM r""")
def cascade_reach(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k, n = F.col("c_custkey"), F.lit(c.count())
    e = c.select(k.alias("src"), ((k * 7 + 3) % n).alias("dst")).union(c.where("c_custkey % 2 = 0").select(k, (k * 3) % n))
    return graph.reachable(e, spark.createDataFrame([(5,)], "id long"))


@query(f"SELECT src, node_type FROM ({_EDGES}) JOIN ({_TREE}) ON id = src WHERE dst IN (SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey = 2)")
def callers_of(spark, sf_dir):
    named = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("function").alias("node_type"), F.when(F.col("s_suppkey") == 2, "wanted").alias("name"))
    every = named.unionByName(_tree(spark, sf_dir).select("id", "node_type", F.lit(None).cast("string").alias("name")))
    return graph.callers_of(_tree_edges(spark, sf_dir), every, "wanted").select("src", "node_type")


@query("SELECT DISTINCT 'm' || c_mktsegment AS file_path, 'n' || n_regionkey AS depends_on FROM customer JOIN nation ON n_nationkey = c_nationkey")
def file_dependencies(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    ident = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    nodes = c.select(ident("c", "c_custkey").alias("id"), ident("m", "c_mktsegment").alias("file_path")).union(n.select(ident("n", "n_nationkey"), ident("n", "n_regionkey")))
    edges = c.select(ident("c", "c_custkey").alias("src"), ident("n", "c_nationkey").alias("dst")).union(n.select(ident("n", "n_nationkey").alias("src"), ident("n", "n_nationkey").alias("dst")))
    return graph.file_dependencies(edges, nodes)


@query("SELECT to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END})::VARCHAR AS json FROM nation")
def nodes_as_json(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("n_regionkey"), F.lit(b"x").alias("content"))
    return graph.as_json(n)


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 > 0 THEN substr(p_name, 2, 3) END AS source FROM part")
def node_source(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    nodes = p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("file_path"), F.lit(1).alias("start_byte"), F.lit(4).alias("end_byte"))
    return graph.node_source(nodes, p.where("p_partkey % 4 > 0").select(F.col("p_partkey").alias("file_path"), F.col("p_name").cast("binary").alias("content")))


@query("""SELECT file_path, place::INT AS place, id FROM (SELECT l_orderkey AS file_path, id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, id) - 1 AS place FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_linenumber * 10000000 + l_suppkey * 10 + (l_returnflag = 'A')::INT AS id FROM lineitem WHERE l_returnflag <> 'N'))""")
def embed_candidates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_path"), F.col("l_linenumber").alias("ordinal"), (F.col("l_linenumber") * 10_000_000 + F.col("l_suppkey") * 10 + (F.col("l_returnflag") == "A").cast("int")).alias("id"), F.when(F.col("l_returnflag") == "A", "function").when(F.col("l_returnflag") == "R", "type-definition").otherwise("call").alias("node_type"))
    return embedding.candidates(li.distinct()).select("file_path", "place", "id")


# --- catalog ----------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS owner_id FROM nation WHERE n_regionkey = 2 OR n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 40 = 2)")
def accessible_workspaces(spark, sf_dir):
    w = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("owner_id"))
    m = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("workspace_id"), (F.col("c_custkey") % 40).alias("user_id"))
    return catalog.accessible(w, m, 2)


@query("""SELECT r_regionkey, r_name, coalesce(string_agg(n_name || ':' || coalesce(s, ''), ';' ORDER BY n_name), '') AS tree FROM region LEFT JOIN (SELECT n_regionkey, n_name, s FROM nation LEFT JOIN (SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_name) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey) ON n_regionkey = r_regionkey GROUP BY ALL""")
def workspace_hierarchy(spark, sf_dir):
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    nations = catalog.nest(n, s, "n_nationkey", "s_nationkey", "suppliers", ["s_name"])
    tree = catalog.nest(r, nations, "r_regionkey", "n_regionkey", "nations", ["n_name", "suppliers"])
    shown = F.array_join(F.transform("nations", lambda x: F.concat(x["n_name"], F.lit(":"), F.array_join(F.transform(x["suppliers"], lambda y: y["s_name"]), ","))), ";")
    return tree.select("r_regionkey", "r_name", shown.alias("tree"))


@query("SELECT DISTINCT o_custkey % 300 AS customer, o_orderpriority AS priority FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey % 300 AND c_mktsegment = 'BUILDING')")
def get_or_create_links(spark, sf_dir):
    have = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("customer"))
    wanted = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("customer"), F.col("o_orderpriority").alias("priority")).distinct()
    return wanted.join(catalog.missing(wanted, have, "customer").select("customer"), "customer", "left_semi")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey END AS workspace_id FROM supplier WHERE s_nationkey = 5 OR s_suppkey % 3 = 0")
def null_shared_filter(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_nationkey")).alias("workspace_id"))
    return catalog.shared_or_own(s, 5)


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an')")
def name_contains(spark, sf_dir):
    return catalog.name_contains(table(spark, sf_dir, "part"), "p_name", "AN").select("p_partkey", "p_name")


@query("SELECT c_custkey, coalesce(u.seg, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT c_custkey AS k, 'NEW' AS seg FROM customer WHERE c_custkey % 5 = 0) u ON k = c_custkey UNION ALL SELECT -c_custkey, 'NEW' FROM customer WHERE c_custkey % 7 = 0 AND c_custkey > 0")
def catalog_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = c.where("c_custkey % 5 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment")).union(c.where("c_custkey % 7 = 0 AND c_custkey > 0").select(-F.col("c_custkey"), F.lit("NEW")))
    return catalog.upsert(c, new, ["c_custkey"])


@query("SELECT o_orderpriority, count(*) AS total, ceil(count(*) / 7)::BIGINT AS total_pages, CASE WHEN o_orderpriority < '3' THEN 1 ELSE 50 END < ceil(count(*) / 7) AS has_next, o_orderpriority >= '3' AS has_prev FROM orders GROUP BY 1")
def pagination(spark, sf_dir):
    t = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("total"))
    return t.select("o_orderpriority", "total", *catalog.page(F.col("total"), 7, F.when(F.col("o_orderpriority") < "3", 1).otherwise(50)))


#: The star tables as a catalogue: nations are workspaces, customers users and members, suppliers repositories, parts branches.
def _catalogue(spark, sf_dir) -> dict[str, DataFrame]:
    of = lambda name: table(spark, sf_dir, name)
    k = F.col("p_partkey")
    return {
        "workspaces": of("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("owner_id")),
        "users": of("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.concat(F.col("c_name"), F.lit("@x")).alias("email"), F.when(F.col("c_custkey") % 3 == 0, "active").when(F.col("c_custkey") % 3 == 1, "true").otherwise("no").alias("is_active")),
        "members": of("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("bigint").alias("workspace_id")),
        "repositories": of("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("https://h/"), F.col("s_name")).alias("git_url")),
        "repository_links": of("supplier").select(F.col("s_suppkey").alias("repository_id"), (F.col("s_nationkey") + F.when(F.col("s_suppkey") % 4 == 0, 100).otherwise(0)).cast("bigint").alias("workspace_id")),
        "branches": of("part").select(k.alias("id"), (k % 10 + 1).alias("repository_id"), F.concat(F.lit("b"), (k % 7).cast("string")).alias("name")),
        "branch_links": of("part").select(k.alias("branch_id"), (k % 25).alias("workspace_id")),
        "projects": of("part").select((k * 2).alias("id"), k.alias("branch_id"), F.when(k % 3 > 0, k % 25).alias("workspace_id"), F.col("p_brand").alias("root_dir"), F.col("p_type").alias("language")),
    }


@query("SELECT DISTINCT c_nationkey::BIGINT AS workspace_id, n_name AS workspace, c_custkey AS user_id, c_name AS username FROM customer JOIN nation ON n_nationkey = c_nationkey")
def workspace_members(spark, sf_dir):
    c = _catalogue(spark, sf_dir)
    return catalog.members_of(c["members"].union(c["members"]), c["users"], c["workspaces"])


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation WHERE n_regionkey = 3")
def owned_workspaces(spark, sf_dir):
    return catalog.owned(_catalogue(spark, sf_dir)["workspaces"], 3).select("id", "name")


@query("SELECT s_suppkey AS repository_id, s_nationkey::BIGINT AS workspace_id, s_name AS name, 'https://h/' || s_name AS git_url FROM supplier WHERE s_suppkey % 4 <> 0")
def workspace_repositories(spark, sf_dir):
    c = _catalogue(spark, sf_dir)
    return catalog.repositories_of(c["repositories"], c["repository_links"], c["workspaces"])


@query("SELECT p_partkey AS branch_id, p_partkey % 25 AS workspace_id, p_partkey % 10 + 1 AS repository_id, 'b' || (p_partkey % 7) AS name FROM part WHERE p_partkey % 10 + 1 = 4")
def workspace_branches(spark, sf_dir):
    c = _catalogue(spark, sf_dir)
    return catalog.branches_of(c["branches"], c["branch_links"], 4)


@query("SELECT p_partkey AS id, s_suppkey AS repository_id, 'b' || (p_partkey % 7) AS name, s_name AS repository, 'https://h/' || s_name AS git_url FROM part JOIN supplier ON s_suppkey = p_partkey % 10 + 1")
def branch_repositories(spark, sf_dir):
    c = _catalogue(spark, sf_dir)
    return catalog.branches_with_repository(c["branches"], c["repositories"])


@query("SELECT p_partkey AS id, p_partkey % 10 + 1 AS repository_id, 'b' || (p_partkey % 7) AS name FROM part WHERE p_partkey % 25 = 6")
def visible_branches(spark, sf_dir):
    c = _catalogue(spark, sf_dir)
    return catalog.visible_branches(c["branches"], c["branch_links"], 6)


@query("SELECT p_partkey * 2 AS id, p_brand AS root_dir FROM part WHERE p_partkey % 10 + 1 = 3 AND p_partkey % 7 = 2 AND (p_partkey % 3 = 0 OR p_partkey % 25 = 7)")
def branch_projects(spark, sf_dir):
    c = _catalogue(spark, sf_dir)
    return catalog.projects_of(c["projects"], c["branches"], 3, "b2", 7).select("id", "root_dir")


@query("SELECT p_partkey AS branch_id, p_partkey % 25 AS workspace_id FROM part WHERE p_partkey % 25 <> 6 OR p_partkey % 4 > 0")
def unlink_branches(spark, sf_dir):
    links = _catalogue(spark, sf_dir)["branch_links"]
    return catalog.unlink(links, links.where("workspace_id = 6 AND branch_id % 4 = 0"), "workspace_id", "branch_id").select("branch_id", "workspace_id")


@query("SELECT p_partkey AS branch_id, p_partkey % 25 AS workspace_id FROM part WHERE NOT (p_partkey % 25 = 7 AND p_partkey % 10 + 1 = 3)")
def remove_repository(spark, sf_dir):
    c = _catalogue(spark, sf_dir)
    return catalog.without_repository(c["branch_links"], c["branches"], 7, 3).select("branch_id", "workspace_id")


@query("""SELECT p_partkey AS branch_id, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 25 END AS workspace_id, p_brand AS root_dir, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 5 = 0 THEN 'second' ELSE p_type END AS language FROM part
  UNION ALL SELECT -p_partkey, 1, 'new', 'second' FROM part WHERE p_partkey % 9 = 0""")
def upsert_projects(spark, sf_dir):
    """Two changes of each key: the later stands. A change of a shared project is left out."""
    p = _catalogue(spark, sf_dir)["projects"].select("branch_id", "workspace_id", "root_dir", "language", F.lit(0).alias("at"))
    new = p.where("branch_id % 5 = 0").unionByName(p.where("branch_id % 9 = 0").select((-F.col("branch_id")).alias("branch_id"), F.lit(1).cast("bigint").alias("workspace_id"), F.lit("new").alias("root_dir"), "language", "at"))
    both = new.withColumns({"language": F.lit("first"), "at": F.lit(1)}).unionByName(new.withColumns({"language": F.lit("second"), "at": F.lit(2)}))
    return catalog.upsert_projects(p, both, ["at"]).drop("at")


@query("SELECT c_custkey AS id FROM customer WHERE c_name = 'Customer#000000007' OR c_name || '@x' = 'Customer#000000007'")
def user_by_login(spark, sf_dir):
    return catalog.users_by_login(_catalogue(spark, sf_dir)["users"], "Customer#000000007").select("id")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 5 > 0 AND c_custkey % 7 <> 1 AND sha256('t' || (c_custkey % 11)) = sha256('t4')")
def token_owner(spark, sf_dir):
    k = F.col("id")
    users = _catalogue(spark, sf_dir)["users"]
    now = F.timestamp_micros(F.lit(10**15))
    tokens = users.select(k.alias("user_id"), F.sha2(F.concat(F.lit("t"), (k % 11).cast("string")), 256).alias("token_hash"), (k % 5 == 0).alias("is_revoked"), F.when(k % 7 == 1, F.timestamp_micros(F.lit(10**14))).when(k % 2 == 0, F.timestamp_micros(F.lit(2 * 10**15))).alias("expired_at"))
    return catalog.token_owner(tokens, users, F.sha2(F.lit("t4"), 256), now).select("id")


# --- search as a service ------------------------------------------------------------------------------------------------

_POINTS = "SELECT vec_id, label, embedding, vec_id % 3 AS workspace_id, vec_id % 5 AS branch_id FROM embeddings"
_HITS = f"SELECT e.vec_id::VARCHAR AS node_id, round({_COS}, 6) AS score, 'unnamed' AS name, 'k' || e.label AS kind FROM ({_POINTS}) e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _points(spark, sf_dir) -> tuple[DataFrame, object]:
    v = table(spark, sf_dir, "embeddings")
    none = F.lit(None).cast("string")
    rows = v.select(F.col("vec_id").cast("string").alias("node_id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 3).alias("workspace_id"), (F.col("vec_id") % 5).alias("branch_id"), none.alias("name"), F.concat(F.lit("k"), F.col("label").cast("string")).alias("kind"), none.alias("file_path"), none.alias("signature"), none.alias("summary"), none.alias("docstring"), F.lit(None).cast("array<string>").alias("identifiers"))
    return rows, lambda query: _query_vector(v)


@query(f"{_HITS} WHERE workspace_id = 1 ORDER BY {_COS} DESC, e.vec_id::VARCHAR LIMIT 7")
def search_workspace(spark, sf_dir):
    points, embed = _points(spark, sf_dir)
    return search.search(points, "any", embed, 7, workspace_id=1).select("node_id", F.round("score", 6).alias("score"), "name", "kind")


@query(f"{_HITS} WHERE branch_id = 2 ORDER BY {_COS} DESC, e.vec_id::VARCHAR LIMIT 5")
def search_branch(spark, sf_dir):
    points, embed = _points(spark, sf_dir)
    branches = spark.createDataFrame([(2, 1, "main"), (3, 1, "dev"), (4, 2, "main")], "id long, repository_id long, name string")
    return search.search_branch(points, branches, "any", embed, 1, "main").select("node_id", F.round("score", 6).alias("score"), "name", "kind")


@query("SELECT 'blank' AS asked, 0::BIGINT AS n UNION ALL SELECT 'no such branch', 0 UNION ALL SELECT 'found', 5")
def search_counts(spark, sf_dir):
    points, embed = _points(spark, sf_dir)
    branches = spark.createDataFrame([(2, 1, "main")], "id long, repository_id long, name string")
    found = {"blank": search.search(points, " \n", embed), "no such branch": search.search_branch(points, branches, "x", embed, 1, "gone"), "found": search.search_branch(points, branches, "x", embed, 1, "main")}
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("asked"), "n") for name, df in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# --- jobs -------------------------------------------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_job(spark, sf_dir):
    return jobs.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT event_id, user_id, previous, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE previous IS NULL OR previous <> event_type")
def job_transitions(spark, sf_dir):
    return jobs.transitions(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "user_id", "previous", "event_type")


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'reject' WHEN 'click' THEN CASE WHEN user_id % 3 = 0 THEN 'reject' ELSE 'reindex' END WHEN 'error' THEN CASE WHEN value > 50 THEN 'reuse_job' ELSE 'new_job' END ELSE 'new_job' END AS decision FROM events""")
def job_decision(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", "INDEXING").when(F.col("event_type") == "click", "INDEXED").when(F.col("event_type") == "error", "FAILED").otherwise("UNINDEXED")
    return e.select("event_id", jobs.decision(status, F.lit("0"), (F.col("user_id") % 3).cast("string"), F.coalesce(F.col("value") > 50, F.lit(False))).alias("decision"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(max(l_linenumber * 10 + (l_quantity)::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cursor FROM lineitem")
def running_cursor(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, -1)
    end = (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).cast("bigint")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.max(end).over(w), F.lit(0)).alias("cursor"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_incremental(spark, sf_dir):
    """The table comes in three parts, one after the other, with a seventh of the rows sent again, and in the last part rows
    of the first one's time, which are too late by then. The stream starts again from its checkpoint for each part.
    """
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    parts = _parts_in_time(e)
    late = parts[0].select((-F.col("event_id") - 1).alias("event_id"), "ts", "event_type")
    sent = [p.unionByName(p.where("event_id % 7 = 0")) for p in parts]
    sent[2] = sent[2].unionByName(late)
    end = e.agg(F.lit(-1).cast("long").alias("event_id"), (F.max("ts") + F.expr("interval 2 days")).alias("ts"), F.lit("end").alias("event_type"))
    out = _streamed([*sent, end], e, incremental.counts_once)
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


def _parts_in_time(events: DataFrame) -> list[DataFrame]:
    """Three parts of equal spans of time."""
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return [events] * 3
    since = lambda c: F.unix_micros(c) - F.unix_micros(F.lit(first))
    place = F.least(F.lit(2), F.floor(3 * since("ts") / F.greatest(F.lit(1), since(F.lit(last)))))
    return [events.where(place == i) for i in range(3)]


def _streamed(parts: list[DataFrame], like: DataFrame, plan) -> DataFrame:
    """What plan makes of a stream that parts arrive in; after each the stream ends, and the next run goes on from its checkpoint."""
    spark = like.sparkSession
    home = f"{shared_folder(spark)}/fernweave/stream-{uuid.uuid4().hex}"
    for i, part in enumerate(parts):
        part.write.parquet(f"{home}/in/part{i}")
        stream = incremental.file_stream(spark, f"{home}/in/*", like.schema)
        incremental.run_once(plan(stream), lambda b, n: b.write.mode("overwrite").parquet(f"{home}/out/batch={n}"), f"{home}/check")
    return spark.read.parquet(f"{home}/out").drop("batch")


@query("""WITH RECURSIVE e AS (
    SELECT user_id AS b, event_id, ts, CASE event_type WHEN 'view' THEN 'request' WHEN 'click' THEN 'request' WHEN 'signup' THEN 'commit' WHEN 'purchase' THEN 'finish' ELSE 'fail' END AS kind,
           CASE WHEN event_type = 'signup' THEN 'c' || (event_id % 2) WHEN event_type IN ('view', 'click') AND event_id % 3 > 0 THEN 'c' || (event_id % 3 - 1) END AS commit,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
  ), m(b, i, event_id, decision, status, indexed, head, wanted, job) AS (
    SELECT DISTINCT b, 0::BIGINT, NULL::BIGINT, '', 'NEW', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, 0::BIGINT FROM e
    UNION ALL
    SELECT b, i, event_id, d, CASE d WHEN 'indexed' THEN 'INDEXED' WHEN 'failed' THEN 'FAILED' WHEN 'outdated' THEN 'OUTDATED' WHEN 'new_job' THEN 'INDEXING' WHEN 'reindex' THEN 'INDEXING' WHEN 'reuse_job' THEN 'INDEXING' ELSE status END,
           CASE d WHEN 'indexed' THEN wanted ELSE indexed END, CASE kind WHEN 'commit' THEN commit ELSE head END,
           CASE WHEN d IN ('new_job', 'reindex', 'reuse_job') THEN coalesce(commit, head) ELSE wanted END, job + (d IN ('new_job', 'reindex'))::BIGINT
    FROM (SELECT m.* EXCLUDE (i, event_id), e.i, e.event_id, kind, commit, CASE
            WHEN kind = 'request' AND (status = 'INDEXING' OR status = 'INDEXED' AND (commit IS NULL OR commit IS NOT DISTINCT FROM indexed)) THEN 'reject'
            WHEN kind = 'request' THEN CASE status WHEN 'INDEXED' THEN 'reindex' WHEN 'FAILED' THEN 'reuse_job' ELSE 'new_job' END
            WHEN kind = 'commit' THEN CASE WHEN status = 'INDEXED' AND commit IS DISTINCT FROM indexed THEN 'outdated' ELSE 'noted' END
            WHEN status = 'INDEXING' THEN CASE kind WHEN 'finish' THEN 'indexed' ELSE 'failed' END ELSE 'ignored' END AS d
          FROM m JOIN e ON e.b = m.b AND e.i = m.i + 1))
  SELECT b AS branch_id, event_id, decision, status, job, wanted AS commit FROM m WHERE i > 0""")
def branch_decisions(spark, sf_dir):
    """Each user's events as a branch's, in three runs of one stream; state and watermark carry over."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    named = F.when(kind.isin("view", "click"), "request").when(kind == "signup", "commit").when(kind == "purchase", "finish").otherwise("fail")
    commit = F.when(kind == "signup", F.concat(F.lit("c"), F.col("event_id") % 2)).when(kind.isin("view", "click") & (F.col("event_id") % 3 > 0), F.concat(F.lit("c"), F.col("event_id") % 3 - 1))
    e = e.select("event_id", F.col("user_id").alias("branch_id"), F.col("ts").cast("timestamp").alias("ts"), named.alias("kind"), commit.alias("commit"))
    sent = [p.unionByName(p.where("event_id % 5 = 0")) for p in _parts_in_time(e)]
    out = _streamed(sent, e, lambda s: branches.decisions(s, timeout="4000 days"))
    return out.select("branch_id", "event_id", "decision", "status", "job", "commit")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 20 WHEN 'click' THEN 100 END AS progress, CASE WHEN event_type = 'view' AND user_id % 2 = 0 THEN 'OUTDATED' WHEN event_type = 'view' THEN 'INDEXED' ELSE 'FAILED' END AS status FROM events")
def job_progress(spark, sf_dir):
    stage = F.when(F.col("event_type") == "view", "clone").when(F.col("event_type") == "click", "done").otherwise("other")
    status = F.when(F.col("event_type") == "view", "INDEXED").otherwise("FAILED")
    return table(spark, sf_dir, "events").select("event_id", jobs.milestone(stage).alias("progress"), jobs.outdated(status, F.lit("0"), (1 - F.col("user_id") % 2).cast("string")).alias("status"))


@query("SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS updated_at FROM events GROUP BY user_id")
def job_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.max_by("event_type", "event_id").alias("status")).select(F.col("user_id").alias("id"), "status", F.col("ts").alias("updated_at"))
    return jobs.with_status(e.where("id % 2 = 0"), e.where("id % 2 = 1")).unionByName(jobs.with_status(e.limit(0), e.limit(0))).select("id", "status", "updated_at")


@query("SELECT DISTINCT p_partkey AS branch_id, 'PENDING' AS status, 0 AS progress_pct FROM part WHERE p_partkey % 25 = 3")
def workspace_jobs(spark, sf_dir):
    return jobs.trigger_workspace(_catalogue(spark, sf_dir)["branch_links"], 3)


@query("SELECT user_id AS key, event_id FROM events WHERE value < 100 AND event_type <> 'error'")
def jobs_in_flight(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", F.col("value").alias("progress_pct"), F.when(F.col("event_type") == "error", "failed").alias("error_message"))
    return jobs.in_flight(e).select("key", "event_id")


@query("SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def jobs_newest(spark, sf_dir):
    """The first page of a list of jobs, newest first."""
    top = jobs.newest(table(spark, sf_dir, "events"), "ts", "event_id").limit(20).agg(F.collect_list("event_id").alias("ids"))
    return top.select(F.posexplode("ids").alias("place", "event_id")).select("event_id", (F.col("place") + 1).cast("bigint").alias("place"))


@query("SELECT p_name AS path, p_partkey AS id FROM part WHERE p_partkey % 4 > 0")
def file_listing(spark, sf_dir):
    return graph.file_listing(table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 4 > 0, F.col("p_name")).alias("path"), F.col("p_partkey").alias("id")))


@query("SELECT n_name AS name FROM nation WHERE n_nationkey = 7")
def node_by_id(spark, sf_dir):
    return graph.by_id(table(spark, sf_dir, "nation"), 7, "n_nationkey").select(F.col("n_name").alias("name"))


@query(f"SELECT (SELECT count(*) FROM ({_LINES}) JOIN ({_DIFF}) ON file_path = relative_path WHERE change IN ('added', 'modified')) AS documents, (SELECT count(*) FROM ({_DIFF}) WHERE change <> 'unchanged') AS deletes, true AS has_operations")
def plan_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    changes = snapshot_diff(spark, sf_dir)
    return index_plan.counts(index_plan.documents(_line_chunks(d), changes, "r1", "abc"), index_plan.deletes(changes, "r1", "abc"))


@query("SELECT count(*) AS files, false AS all_exact, sum(len(string_split(text, chr(10)))) FILTER (text IS NOT NULL)::BIGINT AS chunks FROM documents")
def chunk_totals(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    chunks = _line_chunks(d)
    sources = d.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").cast("binary").alias("content"))
    return chunking.totals(chunking.coverage(chunks, sources, 1 << 30), chunks)


@query("""SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
  FROM (SELECT c_custkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(c_name)) AS h FROM customer)""")
def point_ids(spark, sf_dir):
    return search.point_ids(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("node_id"))).select("c_custkey", "point_id")


@query("SELECT p_partkey, p_name || chr(10) || chr(10) || p_type AS shown FROM part")
def embed_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.embed_text(F.col("p_name"), F.concat(F.lit(" "), F.col("p_type"), F.lit("  "))).alias("shown"))


@query("SELECT doc_id, nullif(replace(replace(CASE WHEN doc_id % 2 = 0 THEN substr(t, 6, 120) ELSE substr(t, 1, 45) END, chr(13), '\\r'), chr(10), '\\n'), '') AS excerpt FROM (SELECT doc_id, regexp_replace(text, '[^\x01-\x7F]', '', 'g') AS t FROM documents)")
def excerpts(spark, sf_dir):
    """The first 120 bytes of a long span, and what is around an empty one."""
    content = F.regexp_replace("text", r"[^\x01-\x7F]", "").cast("binary")
    even = F.col("doc_id") % 2 == 0
    lit = lambda x: F.lit(x).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", text.excerpt(content, lit(5), F.when(even, lit(100_000)).otherwise(lit(5))).alias("excerpt"))


@query("SELECT n_regionkey AS file_path, string_agg(repeat('  ', n_nationkey % 3) || 'function' || CASE WHEN n_nationkey % 4 > 0 THEN ' ' || n_name ELSE '' END, chr(10) ORDER BY n_nationkey) AS tree FROM nation GROUP BY 1")
def tree_text(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return graph.tree_text(n.select(F.col("n_regionkey").alias("file_path"), F.col("n_nationkey").alias("ordinal"), (F.col("n_nationkey") % 3).alias("depth"), F.lit(None).cast("string").alias("kind"), F.lit("function").alias("node_type"), F.when(F.col("n_nationkey") % 4 > 0, F.col("n_name")).alias("name")))


@query("SELECT user_id % 4 = 0 AS is_local, count(*) AS n FROM events GROUP BY 1")
def local_symbols(spark, sf_dir):
    return _events_with_symbol(spark, sf_dir).groupBy(symbols.is_local(F.col("symbol")).alias("is_local")).agg(F.count("*").alias("n"))
