"""The registered queries of the table operators, each with the SQL that says the same.

The given tables stand in for the operators' own: documents for files, embeddings for chunks' vectors (their label for
the repository), events for jobs and events. ``BASE`` is that mapping in SQL; the functions below it are its twin.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import lines, links, vectors
from quarry.operators import chunk, discover, embed, evaluate, jobs, registry, search, tables, vector_index
from quarry.plans import index
from quarry.sources import bucketed, lookup
from quarry.sources import corpus as sources
from quarry.sources.shared import cut, shared_folder
from quarry.sources.store import Store
from quarry.streaming import jobs as streams
from quarry.streaming import scans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


DIRS = ["src", "src/vendor", "node_modules/dep", "docs", "a", "a-b", "target/debug", "lib/build"]
NAMES = [
    "solver.jl", "panel.vue", "kernel.c", "grid.hpp", "Ledger.SCALA", "notes.rst", "schema.proto", "deploy.tf", "query.sql", "Gemfile", "CMakeLists.txt", ".editorconfig", ".npmrc", "store.p12",
    "CERT.DER", "id_dsa.bak", "npm-shrinkwrap.json", "uv.lock", "theme.min.css", "vendor.js.map", "COPYING.txt", "Dockerfile.build", "picture.webp", "plainname", "credentials", "obj", ".gitignore", "x.lock.hcl",
]


# ---- files: documents as files of the repository named by their source

def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", pick(DIRS, F.col("doc_id")), F.col("doc_id").cast("string"), pick(NAMES, F.col("doc_id")))
    text = F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("\x00"), "text")).otherwise(F.col("text"))
    return d.select("doc_id", F.col("source").alias("repository_id"), path.alias("path"), F.octet_length(text).cast("long").alias("size_bytes"), text.cast("binary").alias("content"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows whose ids and times are the documents' numbers."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("f"), F.col("doc_id")).alias("id"), F.col("source").alias("repository_id"), F.concat(pick(DIRS, F.col("doc_id")), F.lit("/"), (F.col("doc_id") / 2).cast("long")).alias("path"),
        F.col("lang").alias("language"), F.octet_length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("checksum_sha256"), F.col("doc_id").alias("created_at"), "doc_id",
    )


CORPUS_SQL = f"""c AS (
  SELECT doc_id, source AS repository_id, {sql_list(DIRS)}[doc_id % {len(DIRS)} + 1] || '/' || doc_id || '/' || {sql_list(NAMES)}[doc_id % {len(NAMES)} + 1] AS path,
         {sql_list(NAMES)}[doc_id % {len(NAMES)} + 1] AS name, strlen(text) + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS size_bytes, text
  FROM documents)"""
#: What each of the file names is, written down by hand: its reason to be skipped, its language.
CLASS_SQL = f"""WITH {CORPUS_SQL},
known(name, why_not, lang) AS (VALUES
  ('solver.jl', NULL, 'julia'), ('panel.vue', NULL, 'vue'), ('kernel.c', NULL, 'c'), ('grid.hpp', NULL, 'cpp'), ('Ledger.SCALA', NULL, 'scala'), ('notes.rst', NULL, 'restructuredtext'),
  ('schema.proto', NULL, 'protobuf'), ('deploy.tf', NULL, 'terraform'), ('query.sql', NULL, 'sql'), ('Gemfile', NULL, 'ruby'), ('CMakeLists.txt', NULL, 'cmake'), ('.editorconfig', NULL, 'editorconfig'),
  ('.npmrc', 'secret', NULL), ('store.p12', 'secret', NULL), ('CERT.DER', 'secret', NULL), ('id_dsa.bak', 'secret', NULL), ('npm-shrinkwrap.json', 'lockfile', NULL), ('uv.lock', 'unsupported_type', NULL),
  ('theme.min.css', 'generated', NULL), ('vendor.js.map', 'generated', NULL), ('COPYING.txt', NULL, NULL), ('Dockerfile.build', NULL, NULL), ('picture.webp', 'unsupported_type', NULL),
  ('plainname', 'unsupported_type', NULL), ('credentials', 'secret', NULL), ('obj', 'unsupported_type', NULL), ('.gitignore', NULL, 'gitignore'), ('x.lock.hcl', 'generated', NULL)),
r AS (
  SELECT c.*, lang, CASE WHEN regexp_matches(path, '(^|/)(vendor|node_modules|target|build)/') THEN 'excluded_dir' ELSE why_not END AS reason
  FROM c JOIN known USING (name))"""
SIZED_SQL = CLASS_SQL + ", s AS (SELECT *, coalesce(reason, CASE WHEN size_bytes > 1048576 THEN 'too_large' END) AS why FROM r)"
#: Where the limit is the feature, it is one that the tables meet.
SMALL_SQL = SIZED_SQL.replace("1048576", "4000")
MAX = {"max_bytes": 4000}
LIMITS = {"max_files": 12, "max_bytes": 20000}


@query(CLASS_SQL + " SELECT doc_id, path, reason IS NULL AS keep, reason, CASE WHEN reason IS NULL THEN lang END AS language FROM r")
def classify_paths(spark, sf_dir):
    return discover.classified(corpus(spark, sf_dir).select("doc_id", "path"))


@query(SIZED_SQL + ", b AS (SELECT *, coalesce(why, CASE WHEN doc_id % 17 = 0 THEN 'binary' END) AS reason2 FROM s) SELECT repository_id, reason2 AS reason, count(*) AS files FROM b WHERE reason2 IS NOT NULL GROUP BY ALL")
def skip_report(spark, sf_dir):
    return discover.skip_report(discover.gated(corpus(spark, sf_dir)))


@query(SMALL_SQL + " SELECT repository_id, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, count(*) <= 12 AND sum(size_bytes) <= 20000 AS within FROM s WHERE why IS NULL GROUP BY 1")
def repo_limits(spark, sf_dir):
    return discover.repository_limits(discover.sized(discover.classified(corpus(spark, sf_dir).drop("content")), **MAX), **LIMITS)


@query(SMALL_SQL + """, w AS (
  SELECT repository_id, path, row_number() OVER o AS nth, (sum(size_bytes) OVER o)::BIGINT AS running_bytes FROM s WHERE why IS NULL
  WINDOW o AS (PARTITION BY repository_id ORDER BY string_split(path, '/') ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, CASE WHEN nth > 12 THEN 'files' WHEN running_bytes > 20000 THEN 'bytes' END AS broken FROM w)
SELECT repository_id, path, broken, nth::INT AS nth, running_bytes FROM b WHERE broken IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY nth) = 1""")
def limit_breaker(spark, sf_dir):
    return discover.limit_breakers(discover.sized(discover.classified(corpus(spark, sf_dir).drop("content")), **MAX), **LIMITS)


@query(SIZED_SQL + " SELECT sha256(repository_id || chr(10) || path) AS id, repository_id, path, lang AS language, size_bytes, sha256(text) AS checksum_sha256 FROM s WHERE why IS NULL AND doc_id % 17 <> 0")
def file_inventory(spark, sf_dir):
    return discover.inventory(discover.gated(corpus(spark, sf_dir)).filter("keep"))


# ---- chunks

def chunk_sql(window: int, overlap: int) -> str:
    step = window - overlap
    return f"""WITH l AS (
  SELECT doc_id, 'd/' || doc_id AS path, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents WHERE text <> ''),
n AS (SELECT *, len(ls) AS n, CASE WHEN len(ls) <= {window} THEN 1 ELSE ceil((len(ls) - {window}) / {step}.0)::BIGINT + 1 END AS cnt FROM l),
w AS (SELECT *, unnest(range(cnt)) AS i FROM n),
k AS (
  SELECT doc_id, path, i::INT AS chunk_index, (i * {step} + 1)::INT AS start_line, least(i * {step} + {window}, n)::INT AS end_line,
         array_to_string(ls[i * {step} + 1 : i * {step} + {window}], chr(10)) AS content FROM w)"""


def doc_chunks(spark, sf_dir, window, overlap):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d/"), "doc_id").alias("path"), "text")
    return chunk.chunked(d, window=window, overlap=overlap)


@query(chunk_sql(40, 10) + " SELECT doc_id, chunk_index, start_line, end_line, length(content)::INT AS n, sha256(path || chr(10) || start_line || chr(10) || end_line || chr(10) || content) AS content_sha256 FROM k")
def chunks_40_10(spark, sf_dir):
    return doc_chunks(spark, sf_dir, 40, 10).select("doc_id", "chunk_index", "start_line", "end_line", F.length("content").alias("n"), "content_sha256")


@query(chunk_sql(8, 2) + " SELECT doc_id, chunk_index, start_line, end_line, content FROM k")
def chunks_8_2(spark, sf_dir):
    return doc_chunks(spark, sf_dir, 8, 2).select("doc_id", "chunk_index", "start_line", "end_line", "content")


@query(chunk_sql(8, 2) + " SELECT doc_id, chunk_index, (start_line + unnest(range(len(string_split(content, chr(10))))))::INT AS line_number, unnest(string_split(content, chr(10))) AS line FROM k")
def line_numbers(spark, sf_dir):
    return chunk.numbered(doc_chunks(spark, sf_dir, 8, 2)).select("doc_id", "chunk_index", "line_number", "line")


# ---- vectors and search

_COMPONENTS = "[('0x' || substr(sha256('0:' || text) || sha256('1:' || text), (4 * j + 1)::BIGINT, 4))::INT / 65535.0::DOUBLE - 0.5::DOUBLE for j in range(24)]"


@query(f"""WITH v AS (SELECT doc_id, {_COMPONENTS} AS c FROM documents),
n AS (SELECT doc_id, c, sqrt(list_sum([x * x for x in c])) AS norm FROM v)
SELECT doc_id, unnest(range(24))::INT AS place, round(unnest([x / norm for x in c]), 6) AS x FROM n""")
def hash_embed(spark, sf_dir):
    made = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("c", embed.HashProvider(24).vector(F.col("text")))
    made = made.select("doc_id", F.posexplode(vectors.checked_width(vectors.normalised(F.col("c")), 24)).alias("place", "x"))
    return made.select("doc_id", "place", F.round("x", 6).alias("x"))


def chunk_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("repository_id"), "embedding")


def asked(spark, sf_dir):
    """Every vector whose id is divisible by 50 is a query in its own repository."""
    return chunk_vectors(spark, sf_dir).filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "repository_id", F.col("embedding").alias("vector"))


COSINE = lambda x, y: f"(list_dot_product({x}::DOUBLE[], {y}::DOUBLE[]) / (sqrt(list_dot_product({x}::DOUBLE[], {x}::DOUBLE[])) * sqrt(list_dot_product({y}::DOUBLE[], {y}::DOUBLE[]))))"
MANY_SQL = f"""m AS (
  SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, {COSINE('e.embedding', 'q.embedding')} AS score, q.label
  FROM embeddings q JOIN embeddings e ON e.label = q.label WHERE q.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM m)"""


@query(f"""SELECT e.vec_id AS chunk_id, round({COSINE('e.embedding', 'q.embedding')}, 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q
WHERE e.label = q.label ORDER BY {COSINE('e.embedding', 'q.embedding')} DESC, e.vec_id LIMIT 10""")
def topk_one(spark, sf_dir):
    q = chunk_vectors(spark, sf_dir).filter("chunk_id = 0").first()
    return search.search_one(chunk_vectors(spark, sf_dir), q["repository_id"], q["embedding"]).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {MANY_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM t WHERE rank <= 10")
def topk_many(spark, sf_dir):
    return search.search_many(chunk_vectors(spark, sf_dir), asked(spark, sf_dir)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(SQL["topk_many"])
def topk_blocks(spark, sf_dir):
    return search.search_blocks(chunk_vectors(spark, sf_dir), asked(spark, sf_dir)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query()
def ann_cells(spark, sf_dir):
    """Approximate search of all vectors; the tests measure its recall against the exact one."""
    rows = chunk_vectors(spark, sf_dir).select("chunk_id", "embedding")
    return search.search_cells(rows, asked(spark, sf_dir), search.cells(rows)).select("query_id", "chunk_id", "score", "rank")


@query("""SELECT count(*) AS queries, true AS recall_reached FROM embeddings WHERE vec_id % 50 = 0""")
def ann_recall(spark, sf_dir):
    """Of the exact best of each query, the share that the approximate search finds: 0.9 or more over all queries."""
    rows = chunk_vectors(spark, sf_dir).select("chunk_id", "embedding").withColumn("repository_id", F.lit("all"))
    asking = asked(spark, sf_dir).withColumn("repository_id", F.lit("all"))
    near = search.search_cells(rows, asking, search.cells(rows)).select("query_id", "chunk_id", F.lit(1).alias("found"))
    exact = search.search_blocks(rows, asking).select("query_id", "chunk_id")
    met = exact.join(near, ["query_id", "chunk_id"], "left")
    return met.agg(F.countDistinct("query_id").alias("queries"), (F.count("found") >= 0.9 * F.count("chunk_id")).alias("recall_reached"))


ALL_SQL = f"""m AS (
  SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, {COSINE('e.embedding', 'q.embedding')} AS score
  FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 50 = 0 AND e.vec_id % 10 <> 7),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM m)"""


def new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query()
def index_search(spark, sf_dir):
    """All vectors in a stored index, searched in as many cells as the build's own measure asks for."""
    path = new_folder(spark, "vector-index")
    vector_index.build(chunk_vectors(spark, sf_dir), path)
    return vector_index.search(spark, path, asked(spark, sf_dir)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT count(*) AS queries, true AS recall_reached, (SELECT count(*) FROM embeddings) AS vectors, true AS each_in_one_cell FROM embeddings WHERE vec_id % 50 = 0")
def index_recall(spark, sf_dir):
    """The share of the exact neighbours that the stored index finds, and that it holds every vector once."""
    path = new_folder(spark, "vector-index")
    rows, asking = chunk_vectors(spark, sf_dir).withColumn("repository_id", F.lit("all")), asked(spark, sf_dir).withColumn("repository_id", F.lit("all"))
    vector_index.build(rows, path)
    near = vector_index.search(spark, path, asking).select("query_id", "chunk_id", F.lit(1).alias("found"))
    met = search.search_blocks(rows, asking).select("query_id", "chunk_id").join(near, ["query_id", "chunk_id"], "left")
    out = met.agg(F.countDistinct("query_id").alias("queries"), (F.count("found") >= 0.9 * F.count("chunk_id")).alias("recall_reached"))
    held = vector_index.stored(spark, path).agg(F.count(F.lit(1)), F.countDistinct("chunk_id")).first()
    return out.withColumns({"vectors": F.lit(held[0]).cast("long"), "each_in_one_cell": F.lit(held[0] == held[1])})


@query(f"WITH {ALL_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM t WHERE rank <= 10")
def index_growth(spark, sf_dir):
    """An index of two thirds of the vectors, to which the others are appended, twice, and from which some are taken:
    with all cells probed it is the exact search."""
    path, rows = new_folder(spark, "vector-index"), chunk_vectors(spark, sf_dir)
    vector_index.build(rows.filter("chunk_id % 3 != 1"), path)
    for _ in range(2):
        vector_index.append(rows.filter("chunk_id % 3 = 1"), path, "second")
    vector_index.remove(spark, path, rows.filter("chunk_id % 10 = 7"))
    return vector_index.search(spark, path, asked(spark, sf_dir), probes=1 << 20).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(SQL["topk_many"])
def topk_query_blocks(spark, sf_dir):
    """More queries than one task may hold: blocks of queries meet blocks of vectors."""
    out = search.search_blocks(chunk_vectors(spark, sf_dir), asked(spark, sf_dir), max_query_bytes=4096, block_rows=1000)
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def requests(spark, sf_dir):
    q = asked(spark, sf_dir)
    n = F.col("query_id") / 50
    k = F.when(n % 7 == 1, 60).when(n % 7 == 2, 3).when(n % 7 == 3, 201).when(n % 7 == 4, 0)
    return q.select("query_id", F.concat(F.lit("o"), (F.col("repository_id").cast("int") % 3 + F.when(n % 5 == 4, 1).otherwise(0)).cast("string")).alias("owner_id"), F.when(n % 11 == 10, F.lit("none")).otherwise(F.col("repository_id")).alias("repository_id"), F.when(n % 13 == 12, F.lit("")).otherwise(F.lit("q")).alias("query"), k.cast("int").alias("top_k"), "vector")


def owned(spark, sf_dir):
    r = chunk_vectors(spark, sf_dir).select("repository_id").distinct()
    return r.select(F.col("repository_id").alias("id"), F.concat(F.lit("o"), (F.col("repository_id").cast("int") % 3).cast("string")).alias("owner_id"))


REQUEST_SQL = """r AS (
  SELECT vec_id AS query_id, 'o' || (label % 3 + CASE WHEN (vec_id / 50) % 5 = 4 THEN 1 ELSE 0 END)::INT AS owner_id, CASE WHEN (vec_id / 50) % 11 = 10 THEN 'none' ELSE label::VARCHAR END AS repository_id,
         CASE WHEN (vec_id / 50) % 13 = 12 THEN '' ELSE 'q' END AS query,
         CASE (vec_id / 50) % 7 WHEN 1 THEN 60 WHEN 2 THEN 3 WHEN 3 THEN 201 WHEN 4 THEN 0 END AS top_k, embedding AS vector
  FROM embeddings WHERE vec_id % 50 = 0),
j AS (
  SELECT r.*, CASE WHEN length(query) < 1 OR top_k < 1 OR top_k > 200 THEN 'invalid' WHEN o.id IS NULL THEN 'not_found' WHEN NOT o.indexed THEN 'not_indexed' ELSE 'ok' END AS status
  FROM r LEFT JOIN (SELECT label::VARCHAR AS id, 'o' || (label % 3)::INT AS owner_id, label <> 4 AS indexed FROM embeddings GROUP BY ALL) o USING (owner_id) WHERE o.id = r.repository_id OR o.id IS NULL)"""
STATUS_SQL = REQUEST_SQL.replace("USING (owner_id) WHERE o.id = r.repository_id OR o.id IS NULL", "ON o.owner_id = r.owner_id AND o.id = r.repository_id")


@query(f"WITH {STATUS_SQL} SELECT query_id, status, CASE WHEN status = 'ok' THEN least(coalesce(top_k, 10), 50)::INT ELSE -1 END AS k FROM j")
def search_statuses(spark, sf_dir):
    return search.statuses(requests(spark, sf_dir), owned(spark, sf_dir), chunk_vectors(spark, sf_dir).filter("repository_id != '4'")).select("query_id", "status", F.coalesce("k", F.lit(-1)).alias("k"))


@query(f"""WITH {STATUS_SQL},
m AS (SELECT query_id, e.vec_id AS chunk_id, {COSINE('e.embedding', 'j.vector')} AS score, least(coalesce(top_k, 10), 50) AS k FROM j JOIN embeddings e ON e.label::VARCHAR = j.repository_id WHERE status = 'ok'),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM m)
SELECT j.query_id, status, coalesce(chunk_id, -1) AS chunk_id, round(score, 6) AS score, coalesce(rank, -1) AS rank FROM j LEFT JOIN (SELECT * FROM t WHERE rank <= k) t USING (query_id)""")
def scoped_search(spark, sf_dir):
    out = search.scoped_search(requests(spark, sf_dir), owned(spark, sf_dir), chunk_vectors(spark, sf_dir).filter("repository_id != '4'"))
    return out.select("query_id", "status", F.coalesce("chunk_id", F.lit(-1)).alias("chunk_id"), F.round("score", 6).alias("score"), F.coalesce("rank", F.lit(-1)).alias("rank"))


def hit_tables(spark, sf_dir):
    v = chunk_vectors(spark, sf_dir)
    chunks = v.select(F.col("chunk_id").alias("id"), (F.col("chunk_id") % 100).alias("file_id"), (F.col("chunk_id") * 30 + 1).alias("start_line"), (F.col("chunk_id") * 30 + 40).alias("end_line"), F.concat(F.lit("text "), "chunk_id").alias("content"))
    return chunks, chunks.select(F.col("file_id").alias("id")).distinct().select("id", F.concat(F.lit("p/"), "id").alias("path"), F.when(F.col("id") % 2 == 0, "python").alias("language"))


@query(f"""WITH {MANY_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, rank, chunk_id * 30 + 1 AS start_line, chunk_id * 30 + 40 AS end_line, 'text ' || chunk_id AS content,
  'p/' || (chunk_id % 100) AS path, CASE WHEN (chunk_id % 100) % 2 = 0 THEN 'python' END AS language FROM t WHERE rank <= 10""")
def search_hits(spark, sf_dir):
    return search.hits(topk_many(spark, sf_dir), *hit_tables(spark, sf_dir))


@query(f"""WITH {MANY_SQL},
f AS (SELECT query_id, 'p/' || (chunk_id % 100) AS path, min(rank) AS r FROM t WHERE rank <= 10 GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS path_rank FROM f),
l AS (SELECT q.vec_id AS query_id, list_distinct(list('p/' || (e.vec_id % 100))) AS rel FROM embeddings q JOIN embeddings e ON e.label = q.label AND e.vec_id % 3 = 0 WHERE q.vec_id % 50 = 0 GROUP BY 1),
h AS (SELECT l.query_id, min(path_rank) AS first FROM l LEFT JOIN p ON p.query_id = l.query_id AND list_contains(rel, p.path) GROUP BY 1)
SELECT count(*) AS n_queries, avg(CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS recall_at_1, avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS recall_at_5, avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS recall_at_10,
       round(avg(coalesce(1.0::DOUBLE / first, 0)), 9) AS mrr FROM h""")
def eval_metrics(spark, sf_dir):
    ranked = topk_many(spark, sf_dir).withColumn("path", F.concat(F.lit("p/"), F.col("chunk_id") % 100))
    relevant = chunk_vectors(spark, sf_dir).filter("chunk_id % 3 = 0").select("repository_id", F.concat(F.lit("p/"), F.col("chunk_id") % 100).alias("p"))
    relevant = relevant.groupBy("repository_id").agg(F.collect_set("p").alias("relevant_paths"))  # at most 100 paths
    labelled = asked(spark, sf_dir).join(relevant, "repository_id").select("query_id", "relevant_paths")
    return evaluate.metrics(labelled, ranked).withColumn("mrr", F.round("mrr", 9))


# ---- maintenance: documents with even numbers are the old files, odd ones and multiples of 4 the new

FILE_SQL = f"""f AS (
  SELECT 'f' || doc_id AS id, source AS repository_id, {sql_list(DIRS)}[doc_id % {len(DIRS)} + 1] || '/' || (doc_id // 2) AS path, lang AS language, strlen(text) AS size_bytes, sha256(text) AS checksum_sha256, doc_id AS created_at, doc_id
  FROM documents),
o AS (SELECT * FROM f WHERE doc_id % 3 <> 0), n AS (SELECT * REPLACE ('n' || doc_id AS id, upper(language) AS language, CASE WHEN doc_id % 2 = 0 THEN checksum_sha256 ELSE sha256(checksum_sha256) END AS checksum_sha256) FROM f WHERE doc_id % 3 <> 1),
e AS (SELECT vec_id, label::VARCHAR AS repository_id FROM embeddings)"""
FILE_COLUMNS = ["id", "repository_id", "path", "language", "size_bytes", "checksum_sha256", "created_at"]


def old_files(spark, sf_dir):
    return files(spark, sf_dir).filter("doc_id % 3 != 0").select(*FILE_COLUMNS)


def new_files(spark, sf_dir):
    f = files(spark, sf_dir).filter("doc_id % 3 != 1")
    return f.withColumns({"id": F.concat(F.lit("n"), "doc_id"), "language": F.upper("language"), "checksum_sha256": F.when(F.col("doc_id") % 2 == 0, F.col("checksum_sha256")).otherwise(F.sha2("checksum_sha256", 256))}).select(*FILE_COLUMNS)


@query(f"""WITH {FILE_SQL} SELECT coalesce(o.id, n.id) AS id, coalesce(o.repository_id, n.repository_id) AS repository_id, coalesce(o.path, n.path) AS path, CASE WHEN n.id IS NULL THEN o.language ELSE n.language END AS language,
 CASE WHEN n.id IS NULL THEN o.size_bytes ELSE n.size_bytes END AS size_bytes, CASE WHEN n.id IS NULL THEN o.checksum_sha256 ELSE n.checksum_sha256 END AS checksum_sha256, coalesce(o.created_at, n.created_at) AS created_at
FROM o FULL JOIN n ON o.repository_id = n.repository_id AND o.path = n.path""")
def upsert_files(spark, sf_dir):
    return tables.upsert_files(old_files(spark, sf_dir), tables.unique_or_fail(new_files(spark, sf_dir), ["repository_id", "path"]))


@query(SQL["upsert_files"])
def bucketed_upsert(spark, sf_dir):
    """The same on a catalog table in buckets of the key: only the new rows are exchanged."""
    name = f"files_{uuid.uuid4().hex}"
    keys = ["repository_id", "path"]
    bucketed.save(old_files(spark, sf_dir), name, keys, buckets=16)
    return spark.table(bucketed.merge(spark, name, new_files(spark, sf_dir), keys, tables.upsert_files, buckets=16))


def scanned(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("repository_id")).distinct().filter("repository_id != 'src3'")


@query(f"WITH {FILE_SQL} SELECT id, repository_id, path FROM o WHERE repository_id = 'src3' OR (repository_id <> 'src5' AND EXISTS (SELECT 1 FROM n WHERE n.repository_id = o.repository_id AND n.path = o.path))")
def prune_files(spark, sf_dir):
    return tables.prune_files(old_files(spark, sf_dir), scanned(spark, sf_dir), new_files(spark, sf_dir).filter("repository_id != 'src5'")).select("id", "repository_id", "path")


@query(f"""WITH {FILE_SQL} SELECT coalesce(o.repository_id, n.repository_id) AS repository_id, coalesce(o.path, n.path) AS path,
 CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.checksum_sha256 = n.checksum_sha256 THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.repository_id = n.repository_id AND o.path = n.path""")
def file_changes(spark, sf_dir):
    return tables.file_changes(old_files(spark, sf_dir), new_files(spark, sf_dir))


def small_chunks(spark, sf_dir):
    """Chunks of every document, in windows of 8 lines, as rows of a chunk table."""
    return doc_chunks(spark, sf_dir, 8, 2).select(F.concat_ws(":", "doc_id", "chunk_index").alias("id"), F.concat(F.lit("f"), "doc_id").alias("file_id"), "chunk_index", "doc_id", F.md5("content").alias("content"))


CHUNK_TABLE = chunk_sql(8, 2) + ", h AS (SELECT doc_id || ':' || chunk_index AS id, 'f' || doc_id AS file_id, chunk_index, doc_id, md5(content) AS content FROM k)"


@query(CHUNK_TABLE + " SELECT id, file_id, chunk_index, content FROM h WHERE doc_id % 5 <> 0 UNION ALL SELECT id || 'n', file_id, chunk_index, md5(content) FROM h WHERE doc_id % 10 = 0")
def replace_chunks(spark, sf_dir):
    c = small_chunks(spark, sf_dir)
    old = c.select("id", "file_id", "chunk_index", "content")
    new = c.filter("doc_id % 10 = 0").select(F.concat("id", F.lit("n")).alias("id"), "file_id", "chunk_index", F.md5("content").alias("content"))
    return tables.replace_chunks(old, c.filter("doc_id % 5 = 0").select("file_id"), new).select("id", "file_id", "chunk_index", "content")


@query(CHUNK_TABLE + " SELECT h.id, h.file_id FROM h JOIN documents d USING (doc_id) WHERE d.source = 'src3' OR doc_id % 3 <> 0")
def prune_chunks(spark, sf_dir):
    f = files(spark, sf_dir)
    c = small_chunks(spark, sf_dir).join(f.select(F.col("id").alias("file_id"), "repository_id"), "file_id").select("id", "file_id", "repository_id")
    return tables.prune_chunks(c, scanned(spark, sf_dir), f.filter("doc_id % 3 != 0")).select("id", "file_id")


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 4 = 0 THEN 'new' ELSE 'old' END AS model, round(embedding[1]::DOUBLE * CASE WHEN vec_id % 4 = 0 THEN -1 ELSE 1 END, 6) AS first FROM embeddings")
def put_vectors(spark, sf_dir):
    v = chunk_vectors(spark, sf_dir).withColumn("model", F.lit("old"))
    new = v.filter("chunk_id % 4 = 0").withColumns({"model": F.lit("new"), "embedding": F.transform("embedding", lambda x: -x)})
    return tables.put_vectors(v, new).select("chunk_id", "model", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


def owned_tables(spark, sf_dir):
    f = files(spark, sf_dir).drop("doc_id")
    c = small_chunks(spark, sf_dir)
    repos = table(spark, sf_dir, "documents").select(F.col("source").alias("id")).distinct().withColumn("owner_id", F.concat(F.lit("u"), F.length("id")))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("src"), F.col("user_id") % 20).alias("repository_id"))
    return {"users": repos.select(F.col("owner_id").alias("id")).distinct(), "repositories": repos, "repository_files": f, "chunks": c, "chunk_embeddings": c.select(F.col("id").alias("chunk_id")), "index_jobs": events.filter("id % 2 = 0"), "repository_events": events.filter("id % 2 = 1")}


@query(chunk_sql(8, 2) + """, g AS (SELECT source AS id FROM documents GROUP BY 1),
gone AS (SELECT id FROM g WHERE length(id) = 4 OR id = 'src12'),
fs AS (SELECT doc_id FROM documents WHERE source NOT IN (SELECT id FROM gone) AND doc_id % 7 <> 0),
ev AS (SELECT event_id AS id FROM events WHERE 'src' || (user_id % 20) NOT IN (SELECT id FROM gone)),
ks AS (SELECT doc_id || ':' || chunk_index AS id FROM k WHERE doc_id IN (SELECT doc_id FROM fs)),
a AS (
  SELECT 'users' AS name, id FROM (SELECT DISTINCT 'u' || length(id) AS id FROM g) WHERE id <> 'u4'
  UNION ALL SELECT 'repositories', id FROM g WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'repository_files', 'f' || doc_id FROM fs
  UNION ALL SELECT 'chunks', id FROM ks UNION ALL SELECT 'chunk_embeddings', id FROM ks
  UNION ALL SELECT 'index_jobs', id::VARCHAR FROM ev WHERE id % 2 = 0 UNION ALL SELECT 'repository_events', id::VARCHAR FROM ev WHERE id % 2 = 1)
SELECT name, count(*) AS n, sum(('0x' || substr(md5(id), 1, 8))::BIGINT)::BIGINT AS keys FROM a GROUP BY name""")
def cascade_delete(spark, sf_dir):
    t = owned_tables(spark, sf_dir)
    left = tables.cascade(t, users=t["users"].filter("id = 'u4'"), repositories=t["repositories"].filter("id = 'src12'"), files=files(spark, sf_dir).filter("doc_id % 7 = 0").select("id"))
    keys = F.sum(F.conv(F.substring(F.md5(F.col("key").cast("string")), 1, 8), 16, 10).cast("long")).alias("keys")
    parts = [df.select(F.col("chunk_id" if name == "chunk_embeddings" else "id").alias("key")).agg(F.count(F.lit(1)).alias("n"), keys).select(F.lit(name).alias("name"), "n", "keys") for name, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def heads(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("repository_id")).agg(F.max("doc_id").alias("m"))
    repos = d.select(F.col("repository_id").alias("id"), F.when(F.length("repository_id") == 4, F.sha2(F.col("m").cast("string"), 256)).when(F.col("m") % 2 == 0, F.lit("old")).alias("last_indexed_sha"))
    return d.select("repository_id", F.sha2(F.col("m").cast("string"), 256).alias("head_sha")), repos


HEAD_SQL = """WITH d AS (SELECT source AS repository_id, max(doc_id) AS m FROM documents GROUP BY 1),
z AS (SELECT repository_id, sha256(m::VARCHAR) AS head_sha, CASE WHEN length(repository_id) = 4 THEN sha256(m::VARCHAR) WHEN m % 2 = 0 THEN 'old' END AS last_indexed_sha FROM d)"""


@query(HEAD_SQL + " SELECT repository_id, head_sha, last_indexed_sha FROM z WHERE head_sha IS DISTINCT FROM last_indexed_sha")
def plan_reindex(spark, sf_dir):
    return tables.changed_repositories(*heads(spark, sf_dir))


@query(HEAD_SQL + chunk_sql(8, 2).replace("WITH l AS", ", l AS") + """, x AS (SELECT source AS repository_id, count(*) AS files FROM documents GROUP BY 1), y AS (SELECT source AS repository_id, count(*) AS chunks FROM k JOIN documents USING (doc_id) GROUP BY 1)
SELECT repository_id, CASE WHEN head_sha IS DISTINCT FROM last_indexed_sha THEN files ELSE 0 END AS files_indexed, CASE WHEN head_sha IS DISTINCT FROM last_indexed_sha THEN coalesce(chunks, 0) ELSE 0 END AS chunks_indexed, head_sha IS NOT DISTINCT FROM last_indexed_sha AS skipped
FROM z JOIN x USING (repository_id) LEFT JOIN y USING (repository_id)""")
def index_outcome(spark, sf_dir):
    h, repos = heads(spark, sf_dir)
    f = files(spark, sf_dir)
    c = small_chunks(spark, sf_dir).join(f.select(F.col("id").alias("file_id"), "repository_id"), "file_id").select("repository_id")
    return tables.outcome(h, repos, f, c)


@query("""WITH f AS (SELECT source AS r, count(*) AS files FROM documents GROUP BY 1), c AS (SELECT 'src' || (user_id % 25) AS r, count(*) AS chunks FROM events GROUP BY 1), v AS (SELECT 'src' || label AS r, count(*) AS vectors FROM embeddings GROUP BY 1)
SELECT r AS repository_id, coalesce(files, 0) AS files, coalesce(chunks, 0) AS chunks, coalesce(vectors, 0) AS vectors, coalesce(vectors, 0) > 0 AS searchable FROM f FULL JOIN c USING (r) FULL JOIN v USING (r)""")
def repository_counts(spark, sf_dir):
    c = table(spark, sf_dir, "events").select(F.concat(F.lit("src"), F.col("user_id") % 25).alias("repository_id"))
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("src"), "label").alias("repository_id"))
    return tables.counts(files(spark, sf_dir), c, v)


@query(f"WITH {FILE_SQL} SELECT id, repository_id, path, row_number() OVER (ORDER BY repository_id, path, id) AS place FROM f")
def file_listing(spark, sf_dir):
    """Files by path within their repository, with the place in that order (from ranges of the sort, not one task)."""
    ordered = tables.listed(files(spark, sf_dir).select("id", "repository_id", "path"), ["path"], within=["repository_id"])
    numbered = ordered.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    numbered = cut(numbered, "listed")
    sizes = {r["part"]: r["n"] for r in numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    start = F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)]) if before else F.create_map(F.lit(0), F.lit(0))
    return numbered.select("id", "repository_id", "path", (F.col("at") + F.element_at(start, F.col("part")) + 1).cast("long").alias("place"))


@query(f"WITH {FILE_SQL} SELECT id, repository_id, path FROM f WHERE (repository_id, path) IN (SELECT repository_id, path FROM f WHERE doc_id % 10 = 0)")
def file_lookup(spark, sf_dir):
    f = files(spark, sf_dir)
    return tables.looked_up(f, f.filter("doc_id % 10 = 0"), ["repository_id", "path"]).select("id", "repository_id", "path")


@query(f"WITH {FILE_SQL} SELECT id, repository_id, path FROM f WHERE doc_id IN (SELECT 5 * item_id FROM benchmark)")
def sorted_lookup(spark, sf_dir):
    """Files looked up by ids, made from the benchmark's, in a table that is sorted by id and has Bloom filters."""
    path = new_folder(spark, "sorted-files")
    lookup.save(files(spark, sf_dir).select("id", "repository_id", "path"), path, "id")
    keys = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("f"), (5 * F.col("item_id")).cast("string")).alias("id"))
    return lookup.look_up(spark, path, keys, "id")


# ---- registry: pages' hosts and places rewritten to repository URLs, customers as users

#: Owner and number go where the braces are: four that may be registered, then one for each way not to be.
_FORMS = [
    "https://github.com/{}/tool-{}", " \thttps://GITHUB.COM/{}/tool-{}.git/\n", "https://github.com///{}//tool.{}/?tab=readme", "https://github.com/{}/tool_{}#install",
    "ssh://github.com/{}/tool-{}", "https://gist.github.com/{}/tool-{}", "https://github.com/{}/tool-{}/issues/4", "https://github.com/?owner={}&n={}", "https://me@github.com/{}/tool-{}",
    "https://github.com:8443/{}/tool-{}", "https://github.com/{}/.tool{}", "https://github.com/{}/to ol{}", "https://github.com/{}/to\aol{}", " \n ",
]


def urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "://([^/]*)", 1)
    forms = [F.concat(*[x for i, part in enumerate(f.split("{}")) for x in ([F.lit(part)] if i == 0 else [host if i == 1 else (F.col("page_id") % 40).cast("string"), F.lit(part)])]) for f in _FORMS]
    return p.select("page_id", F.concat(F.lit("o"), F.col("page_id") % 5).alias("owner_id"), F.element_at(F.array(*forms), (F.col("page_id") % len(_FORMS) + 1).cast("int")).alias("url"))


_URL_FORMS = "[" + ", ".join(" || ".join(x for i, part in enumerate(f.split("{}")) for x in ([f"'{part}'"] if i == 0 else ["host" if i == 1 else "(page_id % 40)", f"'{part}'"])) for f in _FORMS) + "]"
URL_SQL = f"""WITH h AS (SELECT page_id, 'o' || (page_id % 5) AS owner_id, regexp_extract(url, '://([^/]*)', 1) AS host FROM pages),
u AS (SELECT page_id, owner_id, {_URL_FORMS}[page_id % {len(_FORMS)} + 1] AS url FROM h),
p AS (SELECT *, trim(url, ' ' || chr(9) || chr(10)) AS t FROM u),
q AS (SELECT *, regexp_matches(t, '^(?i:https://@?github\\.com)(:0*)?(/[^?#]*)?([?#].*)?$') AS ok, list_filter(string_split(regexp_extract(t, '^(?i:https://@?github\\.com)(:0*)?(/[^?#]*)?([?#].*)?$', 2), '/'), lambda x: x <> '') AS s FROM p),
g AS (SELECT *, s[1] AS o, regexp_replace(s[2], '\\.git$', '') AS r FROM q),
v AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN contains(t, chr(7)) THEN 'control_character' WHEN NOT ok THEN 'not_github_https' WHEN len(s) <> 2 THEN 'not_owner_and_repository' WHEN NOT regexp_matches(o, '^[A-Za-z0-9][A-Za-z0-9._-]{{0,99}}$') OR NOT regexp_matches(r, '^[A-Za-z0-9][A-Za-z0-9._-]{{0,99}}$') THEN 'invalid_name' END AS reason FROM g)"""


@query(URL_SQL + " SELECT page_id, CASE WHEN reason IS NULL THEN o END AS owner_name, CASE WHEN reason IS NULL THEN r END AS repo_name, CASE WHEN reason IS NULL THEN 'https://github.com/' || o || '/' || r || '.git' END AS clone_url, reason FROM v")
def parse_urls(spark, sf_dir):
    return registry.parsed(urls(spark, sf_dir)).select("page_id", "owner_name", "repo_name", "clone_url", "reason")


@query(URL_SQL + """, w AS (SELECT *, row_number() OVER (PARTITION BY owner_id, o, r ORDER BY page_id) AS nth FROM v WHERE reason IS NULL)
SELECT page_id, CASE WHEN v.reason IS NOT NULL THEN 'invalid' WHEN v.o LIKE 'm.%' OR nth > 1 THEN 'conflict' ELSE 'created' END AS result FROM v LEFT JOIN (SELECT page_id, nth FROM w) USING (page_id)""")
def register_repositories(spark, sf_dir):
    u = urls(spark, sf_dir)
    there = registry.parsed(u).filter("owner_name LIKE 'm.%'").select(*registry.KEY)
    return registry.registered(u.withColumnRenamed("page_id", "request_id"), there).select(F.col("request_id").alias("page_id"), "result")


@query("""SELECT doc_id, 'https://github.com/' || url_encode('o ' || source) || '/r/blob/' || CASE doc_id % 3 WHEN 0 THEN 'sha' || doc_id WHEN 1 THEN 'dev' ELSE 'main' END || '/' || replace(replace(replace(url_encode('a b+c'), '+', '%20'), '%21', '!'), '%2A', '*') || '/' || doc_id || '.py#L' || (doc_id % 7 + 1) || '-L' || (doc_id % 7 + 40) AS link FROM documents""")
def citations(spark, sf_dir):
    n = F.col("doc_id")
    link = links.citation(F.concat(F.lit("o "), "source"), F.lit("r"), F.when(n % 3 == 0, F.concat(F.lit("sha"), n)).when(n % 3 == 1, F.lit("")), F.when(n % 3 == 1, F.lit("dev")), F.concat(F.lit("a b+c/"), n, F.lit(".py")), n % 7 + 1, n % 7 + 40)
    return table(spark, sf_dir, "documents").select("doc_id", link.alias("link"))


@query("""WITH u AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '  ' || upper(c_name) || '@Example.com ' ELSE c_name || '@example.com' END AS email FROM customer)
SELECT id, lower(trim(email)) AS email FROM u WHERE lower(trim(email)) IN (SELECT lower(c_name) || '@example.com' FROM customer WHERE c_custkey % 3 = 0)""")
def emails(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    users = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("  "), F.upper("c_name"), F.lit("@Example.com "))).otherwise(F.concat("c_name", F.lit("@example.com"))).alias("email"))
    asked_for = c.filter("c_custkey % 3 = 0").select(F.concat("c_name", F.lit("@EXAMPLE.COM\t")).alias("email"))
    return registry.same_email(users, asked_for).select("id", links.normal_email(F.col("email")).alias("email"))


# ---- jobs and events: an event is a job of its user's repository

def job_rows(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    running = n % 4 == 2
    return e.select(
        n.alias("id"), F.concat(F.lit("r"), "user_id").alias("repository_id"), pick(["failed", "queued", "running", "succeeded"], n).alias("status"), F.lit(None).cast("string").alias("commit_sha"),
        (n % 4 + n % 3).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), F.when(running, F.col("event_type")).alias("current_file"), F.when(n % 5 == 0, F.lit("old")).alias("error"),
        F.when(running, F.lit("w")).alias("locked_by"), F.when(running, ts).alias("locked_at"), F.when(running & (n % 11 != 0), ts).alias("heartbeat_at"), ts.alias("created_at"), F.when(n % 4 != 1, ts).alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"),
    )


NOW = "2024-01-15 00:00:00"
JOB_SQL = """j AS (
  SELECT event_id AS id, 'r' || user_id AS repository_id, ['failed', 'queued', 'running', 'succeeded'][event_id % 4 + 1] AS status, NULL::VARCHAR AS commit_sha, (event_id % 4 + event_id % 3)::INT AS attempts, 3 AS max_attempts,
         CASE WHEN event_id % 4 = 2 THEN event_type END AS current_file, CASE WHEN event_id % 5 = 0 THEN 'old' END AS error, CASE WHEN event_id % 4 = 2 THEN 'w' END AS locked_by, CASE WHEN event_id % 4 = 2 AND event_id % 11 <> 0 THEN ts END AS heartbeat_at, ts AS created_at, NULL::TIMESTAMP AS finished_at
  FROM events)"""


def shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("id", "status", "error", "current_file", "locked_by", F.coalesce(F.unix_timestamp("finished_at"), F.lit(-1)).alias("finished_at"), *columns)


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


_SHOWN = "id, CASE WHEN hit THEN {status} ELSE status END AS status, CASE WHEN hit THEN {error} ELSE error END AS error, CASE WHEN hit THEN NULL ELSE current_file END AS current_file, CASE WHEN hit THEN NULL ELSE locked_by END AS locked_by, CASE WHEN hit AND {ends} THEN epoch(TIMESTAMP '" + NOW + "')::BIGINT ELSE -1 END AS finished_at"
_SPENT = "CASE WHEN attempts >= max_attempts THEN 'failed' ELSE 'queued' END"


@query(f"WITH {JOB_SQL}, x AS (SELECT *, coalesce(status = 'running' AND heartbeat_at < TIMESTAMP '{NOW}' - INTERVAL 60 SECOND, false) AS hit FROM j) SELECT hit AS expired, " + _SHOWN.format(status=_SPENT, error="CASE WHEN attempts >= max_attempts THEN 'worker lease expired' ELSE error END", ends="attempts >= max_attempts") + " FROM x")
def expire_leases(spark, sf_dir):
    return shown(jobs.expire(job_rows(spark, sf_dir), now()), "expired")


@query(f"WITH {JOB_SQL}, x AS (SELECT *, id % 6 = 2 AS hit FROM j) SELECT coalesce(length(CASE WHEN hit THEN repeat('no space left; ', 200)[:2000] ELSE error END), -1)::INT AS n, " + _SHOWN.format(status=_SPENT, error="repeat('no space left; ', 200)[:2000]", ends="attempts >= max_attempts") + " FROM x")
def fail_or_requeue(spark, sf_dir):
    failures = job_rows(spark, sf_dir).filter("id % 6 = 2").select("id", F.repeat(F.lit("no space left; "), 200).alias("error"))
    return shown(jobs.fail_or_requeue(job_rows(spark, sf_dir), failures, now()).withColumn("n", F.coalesce(F.length("error"), F.lit(-1))), "n")


@query(f"WITH {JOB_SQL}, x AS (SELECT *, id % 6 = 2 AS hit FROM j) SELECT CASE WHEN hit THEN 'c' || id END AS commit_sha, " + _SHOWN.format(status="'succeeded'", error="error", ends="true") + " FROM x")
def mark_succeeded(spark, sf_dir):
    outcomes = job_rows(spark, sf_dir).filter("id % 6 = 2").select("id", F.concat(F.lit("c"), "id").alias("commit_sha"))
    return shown(jobs.mark_succeeded(job_rows(spark, sf_dir), outcomes, now()), "commit_sha")


@query(f"WITH {JOB_SQL} SELECT repository_id, id, status FROM j WHERE status IN ('queued', 'running') QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY created_at, id) = 1")
def active_jobs(spark, sf_dir):
    return jobs.active(job_rows(spark, sf_dir)).select("repository_id", "id", "status")


@query(f"""WITH {JOB_SQL}, a AS (SELECT repository_id, id FROM j WHERE status IN ('queued', 'running') AND repository_id < 'r2' QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY created_at, id) = 1),
q AS (SELECT 'r' || user_id AS repository_id, min(event_id) + 1000000 AS new_id FROM events GROUP BY 1)
SELECT repository_id, coalesce(id, new_id) AS job_id, id IS NULL AS created FROM q LEFT JOIN a USING (repository_id)""")
def enqueue(spark, sf_dir):
    j = job_rows(spark, sf_dir)
    return jobs.enqueue(j.filter("repository_id < 'r2'"), j.select("repository_id", (F.col("id") + 1000000).alias("new_id")))


def event_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("r"), "user_id").alias("repository_id"), "event_type", F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("created_at"))


@query("SELECT 'r' || user_id AS repository_id, arg_max(event_id, (ts, event_id)) AS id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(props, (ts, event_id)) AS payload FROM events GROUP BY user_id")
def latest_event(spark, sf_dir):
    return jobs.latest_event(event_rows(spark, sf_dir)).select("repository_id", "id", "event_type", "payload")


@query("SELECT event_id AS id, (props->>'k')::BIGINT AS k, '{\"job_id\":\"j' || event_id || '\",\"status\":\"' || event_type || '\",\"error\":\"' || repeat('ab', 250) || '\"}' AS payload FROM events")
def event_payload(spark, sf_dir):
    read = F.from_json("payload", "k long")["k"]
    made = jobs.payload("index_failed", job_id=F.concat(F.lit("j"), "id"), status=F.col("event_type"), error=F.repeat(F.lit("ab"), 400))
    return event_rows(spark, sf_dir).select("id", read.alias("k"), made.alias("payload"))


@query("SELECT event_id AS id, 'r' || user_id AS repository_id, event_type FROM events UNION ALL SELECT event_id + 10000000, 'r' || user_id, 'index_queued' FROM events WHERE event_id % 10 = 0")
def record_events(spark, sf_dir):
    e = event_rows(spark, sf_dir)
    new = e.filter("id % 10 = 0").withColumns({"id": F.col("id") + 10000000, "event_type": F.lit("index_queued")})
    return jobs.record(e, new).select("id", "repository_id", "event_type")


@query(f"WITH {JOB_SQL} SELECT id, repository_id, status, attempts, max_attempts, error FROM j")
def public_jobs(spark, sf_dir):
    rows = job_rows(spark, sf_dir).withColumns({"files_total": F.lit(None).cast("int"), "files_done": F.lit(None).cast("int")})
    return tables.public_job(rows).select("id", "repository_id", "status", "attempts", "max_attempts", "error")


@query("""WITH h AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap, event_type FROM events),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM h),
g AS (SELECT user_id, session, arg_max(event_type, (ts, event_type IN ('failed', 'succeeded'), event_type)) AS last_state, max(ts) AS last_seen, count(*) AS heartbeats FROM s GROUP BY ALL)
SELECT 'r' || user_id AS job_id, last_state, epoch_us(last_seen) // 1000000 AS last_seen, epoch_us(last_seen + INTERVAL 1 HOUR) // 1000000 AS expired_at, heartbeats FROM g WHERE last_state NOT IN ('failed', 'succeeded')""")
def stream_leases(spark, sf_dir):
    """The batch form of the stream; the tests run it as a stream as well."""
    beats = table(spark, sf_dir, "events").select(F.concat(F.lit("r"), "user_id").alias("job_id"), "ts", F.col("event_type").alias("state"))
    out = streams.silent_workers(beats, lease_seconds=3600)
    return out.select("job_id", "last_state", F.unix_timestamp("last_seen").alias("last_seen"), F.unix_timestamp("expired_at").alias("expired_at"), "heartbeats")


# ---- whole workloads

def indexed_sql(files_cte: str) -> str:
    chunks = chunk_sql(8, 2).removeprefix("WITH ").replace("FROM documents WHERE text <> ''", "FROM f WHERE text <> ''").replace("'d/' || doc_id AS path", "path")
    return f"""{SIZED_SQL}, {files_cte},
{chunks},
g AS (
  SELECT doc_id, ('0x' || substr(sha256(path || chr(10) || start_line || chr(10) || end_line || chr(10) || content), 1, 8))::BIGINT AS chunk,
         [('0x' || substr(sha256('0:' || content), (4 * j + 1)::BIGINT, 4))::INT for j in range(16)] AS c FROM k)
SELECT repository_id, count(DISTINCT f.doc_id) AS files, count(g.doc_id) AS chunks, count(g.doc_id) AS vectors, count(g.doc_id) > 0 AS searchable,
       coalesce(sum(chunk), 0)::BIGINT AS chunk_digest, coalesce(sum(list_position(c, list_max(c))), 0)::BIGINT AS vector_digest FROM f LEFT JOIN g USING (doc_id) GROUP BY 1"""


def digested(made: index.Index) -> DataFrame:
    """Counts of each repository, and sums over its chunks' checksums and over the place of each vector's largest
    component."""
    chunk_sum = F.sum(F.conv(F.substring("content_sha256", 1, 8), 16, 10).cast("long"))
    chunks = made.chunks.groupBy("repository_id").agg(chunk_sum.alias("chunk_digest"))
    found = made.embeddings.groupBy("repository_id").agg(F.sum(F.array_position("embedding", F.array_max("embedding"))).alias("vector_digest"))
    out = tables.counts(made.files, made.chunks, made.embeddings).join(chunks, "repository_id", "left").join(found, "repository_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("chunk_digest", "vector_digest")})


#: The size of a file is limited as by default; a repository may have any, as the sources of large tables do.
ANY_REPOSITORY = {"window": 8, "overlap": 2, "max_files": 1 << 40, "max_bytes": 1 << 60}


@query(indexed_sql("f AS (SELECT * FROM s WHERE why IS NULL AND doc_id % 17 <> 0)"))
def index_corpus(spark, sf_dir):
    """Discover, chunk and embed the corpus, and sum up what each repository has."""
    return digested(index.build(corpus(spark, sf_dir).drop("doc_id"), embed.HashProvider(16), **ANY_REPOSITORY))


@query(indexed_sql("f AS (SELECT * FROM s WHERE why IS NULL AND doc_id % 17 <> 0 AND doc_id % 7 <> 0)"))
def incremental_index(spark, sf_dir):
    """A second scan, in which some files are new and some are gone, merged into the tables of the first: the result
    is that of indexing the second scan alone."""
    rows = corpus(spark, sf_dir)
    first = index.build(rows.filter("doc_id % 5 != 0").drop("doc_id"), embed.HashProvider(16), **ANY_REPOSITORY)
    first = index.Index(*[cut(x, "index") for x in (first.files, first.chunks, first.embeddings)])
    second = rows.filter("doc_id % 7 != 0").drop("doc_id")
    return digested(index.update(first, second, rows.select("repository_id").distinct(), embed.HashProvider(16), **ANY_REPOSITORY))


@query(SQL["index_corpus"])
def stream_scans(spark, sf_dir):
    """The corpus as one scan that arrives in three batches, its end mark in the last, merged into bucketed tables."""
    folder = new_folder(spark, "scans")
    store = Store(spark, f"{folder}/tables", index.STORED)
    rows = corpus(spark, sf_dir).withColumns({"scan": F.lit("first"), "files": F.lit(None).cast("long")})
    names = ["repository_id", "scan", "path", "size_bytes", "content", "files"]
    marks = rows.groupBy("repository_id", "scan").agg(F.count(F.lit(1)).alias("files"))
    for part in range(3):
        arriving = rows.filter(F.col("doc_id") % 3 == part).select(*names)
        arriving = arriving.unionByName(marks, allowMissingColumns=True) if part == 2 else arriving
        arriving.write.mode("append").parquet(f"{folder}/source")
        scans.scan_stream(spark, f"{folder}/source", f"{folder}/check", store, embed.HashProvider(16), **ANY_REPOSITORY).awaitTermination()
    return digested(index.stored_index(store))


@query(SQL["incremental_index"])
def stored_update(spark, sf_dir):
    """Two scans merged into bucketed tables; the second reads and writes the buckets of changed files only, and embeds
    only texts that no file had."""
    store = Store(spark, f"{new_folder(spark, 'tables')}", index.STORED)
    rows = corpus(spark, sf_dir)
    everyone = rows.select("repository_id").distinct()
    for scan in (rows.filter("doc_id % 5 != 0"), rows.filter("doc_id % 7 != 0")):
        index.update_store(store, scan.drop("doc_id"), everyone, embed.HashProvider(16), **ANY_REPOSITORY)
    return digested(index.stored_index(store))


def search_a_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk and embed the documents and search for the text of one chunk: that chunk comes first, with score 1."""
    d = table(spark, sf_dir, "documents").select(F.lit("docs").alias("repository_id"), F.concat(F.lit("d/"), "doc_id", F.lit(".md")).alias("path"), F.octet_length("text").cast("long").alias("size_bytes"), F.col("text").cast("binary").alias("content"))
    made = index.build(d, embed.HashProvider(64), max_files=1 << 40, max_bytes=1 << 60)
    asked_for = made.chunks.orderBy("id").select("content").first()
    vector = spark.createDataFrame([(asked_for["content"],)], "text string").select(vectors.normalised(embed.HashProvider(64).vector(F.col("text"))).alias("v")).first()["v"]
    return search.hits(search.search_one(made.embeddings, "docs", vector), made.chunks, made.files)




@query("""SELECT source AS id, 'github' AS provider, 'o' || (length(source) % 3) AS owner_name, source AS repo_name, 'https://github.com/o' || (length(source) % 3) || '/' || source || '.git' AS clone_url,
 CASE WHEN length(source) = 4 THEN 'dev' END AS default_branch, max(doc_id)::VARCHAR AS last_indexed_sha, 'indexed' AS status, min(doc_id) AS created_at FROM documents GROUP BY source""")
def public_repositories(spark, sf_dir):
    owner = F.concat(F.lit("o"), (F.length("source") % 3).cast("string"))
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.max("doc_id").cast("string").alias("last_indexed_sha"), F.min("doc_id").alias("created_at"))
    rows = d.withColumns({"id": F.col("source"), "owner_id": F.lit("private"), "provider": F.lit("github"), "owner_name": owner, "repo_name": F.col("source"), "clone_url": F.concat(F.lit("https://github.com/"), owner, F.lit("/"), "source", F.lit(".git")), "default_branch": F.when(F.length("source") == 4, "dev"), "status": F.lit("indexed")})
    return tables.public_repository(rows)


# ---- sources, decoding and models

@query("""SELECT text AS query_id, text AS query, CASE WHEN doc_id < 2 THEN 'd/' || doc_id || ' e/' || doc_id ELSE 'd/' || doc_id || ' d/' || doc_id // 2 || ' e/' || doc_id END AS relevant_paths
FROM documents WHERE text IS NOT NULL""")
def labelled_queries(spark, sf_dir):
    """Labelled queries written as JSON lines, with repeated paths and blank lines, and read back."""
    n = F.col("doc_id")
    own, half = F.concat(F.lit("d/"), n), F.concat(F.lit("d/"), F.floor(n / 2))
    relevant = F.when(n < 2, F.array(own, own, F.concat(F.lit("e/"), n))).otherwise(F.array(own, half, own, F.concat(F.lit("e/"), n)))
    rows = table(spark, sf_dir, "documents").select(F.explode(F.array(F.lit(""), F.to_json(F.struct(F.col("text").alias("query"), relevant.alias("relevant_paths"))))).alias("value"))
    path = f"{shared_folder(spark)}/labelled-{uuid.uuid4().hex}"
    rows.write.text(path)
    return sources.read_labelled(spark, path).withColumn("relevant_paths", F.array_join("relevant_paths", " "))


@query("SELECT 'f' || doc_id AS id, source AS repository_id, lang AS language, strlen(text) AS size_bytes, sha256(text) AS checksum_sha256 FROM documents")
def snapshot_files(spark, sf_dir):
    """The inventory written as a snapshot in buckets and read back."""
    rows = files(spark, sf_dir).select("id", "repository_id", "language", "size_bytes", "checksum_sha256")
    path = sources.write_snapshot(rows, f"{shared_folder(spark)}/files-{uuid.uuid4().hex}")
    return sources.read_snapshot(spark, path, "id string, repository_id string, language string, size_bytes long, checksum_sha256 string")


@query(r"""SELECT doc_id, sha256(text || chr(65533) || chr(8232) || doc_id) AS sha256,
 len(regexp_split_to_array(text || 'x', '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]')) + 1 AS n_lines FROM documents WHERE text IS NOT NULL""")
def decoded_lines(spark, sf_dir):
    """Texts that a byte which is not UTF-8 follows, and a line separator of Unicode before the last line."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    content = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FFE280A8")), F.col("doc_id").cast("string").cast("binary"))
    text = d.select("doc_id", lines.decoded(content).alias("text"))
    return text.select("doc_id", F.sha2("text", 256).alias("sha256"), F.size(lines.lines(F.col("text"))).cast("long").alias("n_lines"))


def length_model():
    """A model that tells texts apart by their length modulo 8."""

    def vectors_of(texts: list[str]) -> list[list[float]]:
        return [[2.0 if len(t) % 8 == i else 1.0 for i in range(8)] for t in texts]

    return vectors_of


@query("SELECT doc_id AS chunk_id, source AS repository_id, 'lengths' AS model, 8 AS dim, length(text) % 8 + 1 AS place, 0.603::DOUBLE AS largest FROM documents WHERE text IS NOT NULL")
def model_embed(spark, sf_dir):
    """A user's model run over all texts in batches, its vectors checked and brought to length 1."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("source").alias("repository_id"), F.col("text").alias("content"))
    made = embed.embed(d, embed.provider("model", 8, model_name="lengths", load=length_model))
    top = F.array_max("embedding")
    return made.select("chunk_id", "repository_id", "model", "dim", F.array_position("embedding", top).alias("place"), F.round(top.cast("double"), 3).alias("largest"))


@query("""WITH c AS (SELECT doc_id, text, length(text) % 8 + 1 AS place, doc_id % 3 <> 0 AS new FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS chunk_id, 'lengths' AS model, place, (SELECT count(DISTINCT text) FROM c WHERE text NOT IN (SELECT text FROM c WHERE NOT new)) AS embedded FROM c WHERE new""")
def embed_contents(spark, sf_dir):
    """The texts of some documents embedded; of the others only those that no earlier document has, each once."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("source").alias("repository_id"), F.col("text").alias("content"))
    using = embed.provider("model", 8, model_name="lengths", load=length_model)
    none = spark.createDataFrame([], embed.CONTENTS)
    _, known = embed.embed_new(d.filter("id % 3 = 0"), using, none)
    made, new = embed.embed_new(d.filter("id % 3 != 0"), using, cut(known, "contents"))
    return made.select("chunk_id", "model", F.array_position("embedding", F.array_max("embedding")).alias("place"), F.lit(new.count()).cast("long").alias("embedded"))
