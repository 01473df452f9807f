"""Registered queries over the driver's tables, and DuckDB SQL for those that SQL can express.

``documents`` plays the ingested texts (source is the file name, lang the tenant, doc_id the order of arrival),
``embeddings`` the vector store, ``labels`` the sidecars, ``benchmark`` the gold passages. All
queries run over their whole tables. Floats are rounded on both sides.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import spans as P
from ..functions import text as X
from ..functions.embedding import HashProvider
from ..operators import chunking as C
from ..operators import evaluation as V
from ..operators import retrieval as R
from ..operators import store as K
from ..operators.embed import embed, embed_cached
from ..operators.indexing import duplicates, index, version_history
from ..operators.nearest import nearest
from ..session import remove, shared_dir, ship, spread, written
from ..sources import files as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return run(spark, sf_dir)

        QUERIES[run.__name__] = shipped
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the engine's terms."""
    rows = _table(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").cast("string").alias("document_id"), "doc_id", "text", F.col("source").alias("filename"), F.col("lang").alias("tenant_id"))


# --- texts and identities ----------------------------------------------------------------------

def _noisy() -> Column:
    """The text with what cleaning removes around it."""
    return F.concat(F.lit("\r\n  \u0007"), F.col("text"), F.lit("\t\t x\u000b \n\n\n\n\r\ry \u001f   "))


@query("SELECT doc_id, regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g'), '^[ \\n\\t]+|[ \\n\\t]+$', '', 'g') AS text FROM documents")
def clean_text_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", X.clean_text(F.col("text")).alias("text"))


@query(
    "WITH n AS (SELECT doc_id, chr(13) || chr(10) || chr(160) || ' ' || chr(57345) || chr(7) || text || chr(9) || chr(9) || ' x' || chr(11) || ' ' || repeat(chr(10), 4) || chr(13) || chr(13) || 'y ' || chr(31) || ' ' || chr(160) || ' ' AS t FROM documents), "
    "a AS (SELECT doc_id, replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' ') AS t FROM n), "
    "b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[\\x{E000}-\\x{F8FF}]', '', 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g') AS t FROM a), "
    "c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), ' +\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS t FROM b) "
    "SELECT doc_id, length(u) AS n, md5(u) AS digest FROM (SELECT doc_id, regexp_replace(t, '^[ \\n\\t]+|[ \\n\\t]+$', '', 'g') AS u FROM c)"
)
def clean_text_noisy(spark, sf_dir):
    cleaned = X.clean_text(_noisy())
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.length(cleaned).cast("long").alias("n"), F.md5(cleaned.cast("binary")).alias("digest"))


@query("SELECT doc_id, sha256(text)[1:16] || '-1' AS document_id, sha256(text)[1:16] AS file_key, sha256(text) AS file_hash FROM documents")
def document_ids(spark, sf_dir):
    digest = X.content_hash(F.col("text"))
    rows = _table(spark, sf_dir, "documents").withColumn("file_hash", digest)
    return rows.select("doc_id", X.document_id(F.col("file_hash"), F.lit(1)).alias("document_id"), X.file_key(X.document_id(F.col("file_hash"), F.lit(1))).alias("file_key"), "file_hash")


@query("SELECT sha256(text) AS file_hash, count(*) AS n, min(doc_id) AS first_id, count(DISTINCT source) AS files FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source", X.content_hash(F.col("text")).alias("file_hash"))
    per_file = rows.groupBy("file_hash", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return per_file.groupBy("file_hash").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.count("*").alias("files")).filter("n > 1")


@query(
    "WITH d AS (SELECT DISTINCT lang AS tenant_id, sha256(text)[1:16] || '-1' AS document_id, source AS filename FROM documents), "
    "m AS (SELECT tenant_id, document_id, min(filename) AS first FROM d GROUP BY ALL HAVING count(*) > 1) "
    "SELECT tenant_id, document_id, filename, CASE WHEN filename <> first THEN first END AS duplicate_of FROM d JOIN m USING (tenant_id, document_id)"
)
def duplicate_of(spark, sf_dir):
    rows = _docs(spark, sf_dir)
    return duplicates(rows.withColumn("document_id", X.document_id(X.content_hash(F.col("text")), F.lit(1))))


@query("SELECT doc_id, coalesce('page ' || CASE WHEN doc_id % 3 = 0 THEN doc_id // 3 END, source) AS label FROM documents")
def document_labels(spark, sf_dir):
    page = F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") / 3).cast("long"))
    return _table(spark, sf_dir, "documents").select("doc_id", X.document_label(F.col("source"), page).alias("label"))


# --- chunks ------------------------------------------------------------------------------------


def _fixed_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return (
        f"WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE trim(text) <> ''), s AS (SELECT *, unnest(range(0, CASE WHEN n <= {size} THEN 1 ELSE CAST(ceil((n - {size}) / {step}.0) AS INT) + 1 END)) AS i FROM d) "
        f"SELECT doc_id || '_chunk_' || i AS chunk_id, CAST(i * {step} AS INT) AS \"start\", CAST(least(i * {step} + {size}, n) AS INT) AS \"end\", md5(substring(text, CAST(i * {step} + 1 AS INT), {size})) AS digest FROM s"
    )


def _digest(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "start", "end", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(_fixed_sql(500, 50))
def chunk_fixed_500_50(spark, sf_dir):
    return _digest(C.chunk(_docs(spark, sf_dir), "fixed", {"chunk_size": 500, "overlap": 50}))


@query(_fixed_sql(1000, 100))
def chunk_fixed_1000_100(spark, sf_dir):
    return _digest(C.chunk(_docs(spark, sf_dir), "fixed", {"chunk_size": 1000, "overlap": 100}))


_WINDOWS = (
    "p AS (SELECT key, regexp_extract_all(text, '\\s*\\S+') AS r FROM d), q AS MATERIALIZED (SELECT key, list_transform(r, lambda x: length(x)) AS l, list_transform(r, lambda x: length(ltrim(x, chr(32) || chr(10) || chr(9)))) AS w, len(r) AS n FROM p), "
    "e AS MATERIALIZED (SELECT key, unnest(l) AS l1, unnest(w) AS w1, unnest(range(0, n)) AS i FROM q), f AS MATERIALIZED (SELECT key, i, sum(l1) OVER (PARTITION BY key ORDER BY i) AS hi, w1 FROM e), "
    "s AS (SELECT DISTINCT key, n, unnest(list_distinct(list_append(range(0, greatest(n - 100, 0) + 1, 75), greatest(n - 100, 0)))) AS b FROM q), k AS MATERIALIZED (SELECT key, n, b, row_number() OVER (PARTITION BY key ORDER BY b) - 1 AS c FROM s), "
    "o AS MATERIALIZED (SELECT k.key, c, CAST(x.hi - x.w1 AS BIGINT) AS a, CAST(y.hi AS BIGINT) AS z FROM k JOIN f x ON x.key = k.key AND x.i = k.b JOIN f y ON y.key = k.key AND y.i = least(k.b + 100, k.n) - 1) "
    "SELECT key || '_chunk_' || c AS chunk_id, CAST(a AS INT) AS \"start\", CAST(z AS INT) AS \"end\", md5(substring(text, a + 1, z - a)) AS digest FROM o JOIN d USING (key)"
)


@query("WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS key, text FROM documents WHERE trim(text) <> ''), " + _WINDOWS)
def chunk_sliding_window(spark, sf_dir):
    return _digest(C.chunk(_docs(spark, sf_dir), "sliding_window"))


@query("WITH d AS (SELECT CAST(conv_id AS VARCHAR) AS key, string_agg(text, chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id), " + _WINDOWS)
def transcript_windows(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return _digest(C.chunk(whole.select(F.col("conv_id").cast("string").alias("document_id"), "text"), "sliding_window"))


@query("WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 200)) AS a FROM documents) SELECT doc_id, count(*) AS n, CAST(sum(length(p)) AS BIGINT) AS chars, md5(string_agg(p, '|' ORDER BY a)) AS digest FROM (SELECT doc_id, a, trim(substring(text, CAST(a + 1 AS INT), 200), ' ' || chr(10)) AS p FROM s) WHERE p <> '' GROUP BY doc_id")
def hard_split_200(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    spans = C.spans_frame(docs, lambda text: P.slabs(text, 0, len(text), 200))
    found = spans.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"))
    pieces = F.transform("s", lambda x: F.substring("text", (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))
    return found.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "n", "chars", F.md5(F.array_join(pieces, "|").cast("binary")).alias("digest"))


@query(
    "WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(text, '\\s*\\S+') AS r FROM documents), e AS (SELECT doc_id, unnest(r) AS x, unnest(range(0, len(r))) AS i FROM d), "
    "f AS (SELECT doc_id, i, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS hi, length(ltrim(x, ' ' || chr(10) || chr(9))) AS w FROM e), g AS MATERIALIZED (SELECT doc_id, i, CAST(hi - w AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM f), "
    "p(doc_id, i, a, c) AS (SELECT doc_id, i, lo, 1 FROM g WHERE i = 0 UNION ALL SELECT g.doc_id, g.i, CASE WHEN g.hi - p.a <= 200 THEN p.a ELSE g.lo END, CASE WHEN g.hi - p.a <= 200 THEN p.c ELSE p.c + 1 END FROM p JOIN g ON g.doc_id = p.doc_id AND g.i = p.i + 1) "
    "SELECT p.doc_id, p.c AS n, CAST(min(p.a) AS BIGINT) AS \"start\", CAST(max(g.hi) AS BIGINT) AS \"end\" FROM p JOIN g USING (doc_id, i) GROUP BY p.doc_id, p.c"
)
def pack_words_200(spark, sf_dir):
    spans = C.spans_frame(_table(spark, sf_dir, "documents"), lambda text: P.pack(P.between(text, 0, len(text), P.SEPARATORS["word"]), 200))
    return spans.withColumn("n", (F.col("n") + 1).cast("int"))


def _kernel(strategy: str):
    def run(spark, sf_dir):
        provider = HashProvider(64) if strategy == "semantic" else None
        return _digest(C.chunk(_docs(spark, sf_dir), strategy, provider=provider))

    run.__name__ = f"chunk_{strategy}"
    return query()(run)


for _name in ("sentence", "recursive", "token", "structure", "parent_child", "hierarchical", "semantic"):
    _kernel(_name)


@query()
def chunk_metadata_aware(spark, sf_dir):
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("csv", "json", "markdown", "html", "docx", "txt", "pdf")]), (F.col("doc_id") % 7 + 1).cast("int"))
    chunks = C.chunk(_docs(spark, sf_dir).withColumn("source_type", kinds), "metadata_aware")
    return chunks.select("chunk_id", "strategy", "start", "end", F.md5(F.col("text").cast("binary")).alias("digest"))


_BLANK = "chr(32) || chr(9) || chr(10)"


@query(
    "WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE trim(text) <> ''), "
    "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE n > 500), "
    "m AS (SELECT doc_id, i, t, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(t) - 1 AS o FROM l), "
    f"k AS (SELECT doc_id, i, o + length(t) - length(ltrim(t, {_BLANK})) AS lo, trim(t, {_BLANK}) AS t FROM m WHERE trim(t, {_BLANK}) <> ''), "
    "r AS (SELECT doc_id, i, lo, CASE WHEN length(t) <= 500 THEN [t] ELSE regexp_extract_all(t, '\\s*\\S+') END AS xs FROM k), "
    "w AS (SELECT doc_id, i, lo, unnest(xs) AS x, generate_subscripts(xs, 1) AS j FROM r), "
    f"e AS (SELECT doc_id, lo + sum(length(x)) OVER (PARTITION BY doc_id, i ORDER BY j) AS hi, length(ltrim(x, {_BLANK})) AS n FROM w), "
    "h AS (SELECT doc_id, CAST(hi AS BIGINT) AS hi, n, unnest(range(0, n, 500)) AS s FROM e), "
    "g AS MATERIALIZED (SELECT doc_id, hi - n + s AS lo, least(hi - n + s + 500, hi) AS hi, row_number() OVER (PARTITION BY doc_id ORDER BY hi - n + s) AS i FROM h), "
    "p(doc_id, i, a, z, c) AS (SELECT doc_id, i, lo, hi, 0 FROM g WHERE i = 1 UNION ALL SELECT g.doc_id, g.i, CASE WHEN g.hi - p.a <= 500 THEN p.a ELSE g.lo END, g.hi, CASE WHEN g.hi - p.a <= 500 THEN p.c ELSE p.c + 1 END FROM p JOIN g ON g.doc_id = p.doc_id AND g.i = p.i + 1), "
    "q AS (SELECT doc_id, c, min(a) AS a, max(z) AS z FROM p GROUP BY doc_id, c UNION ALL SELECT doc_id, 0, 0, n FROM d WHERE n <= 500) "
    "SELECT doc_id || '_chunk_' || c AS chunk_id, CAST(a AS INT) AS \"start\", CAST(z AS INT) AS \"end\", md5(substring(text, a + 1, z - a)) AS digest FROM q JOIN d USING (doc_id)"
)
def chunk_recursive_line_word(spark, sf_dir):
    """The recursive strategy as the default rules route CSV and JSON: lines, then words."""
    return _digest(C.chunk(_docs(spark, sf_dir), "recursive", {"chunk_size": 500, "separators": ["line", "word"]}))


@query("SELECT doc_id, CASE WHEN doc_id % 7 IN (0, 1) THEN 'recursive' WHEN doc_id % 7 IN (2, 3, 4) THEN 'structure' ELSE 'recursive' END AS strategy, CASE WHEN doc_id % 7 IN (0, 1) THEN 0 WHEN doc_id % 7 IN (2, 3, 4) THEN 1 ELSE -1 END AS rule FROM documents")
def route_strategy(spark, sf_dir):
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("csv", "json", "markdown", "html", "docx", "txt", "pdf")]), (F.col("doc_id") % 7 + 1).cast("int"))
    rows = _table(spark, sf_dir, "documents").withColumn("source_type", kinds)
    names = F.create_map(*[F.lit(x) for n, r in enumerate([*C.DEFAULT_RULES, C.DEFAULT_FALLBACK]) for x in (n if n < len(C.DEFAULT_RULES) else -1, r["strategy"])])
    return rows.withColumn("rule", C.route(C.DEFAULT_RULES, rows.columns)).select("doc_id", names[F.col("rule")].alias("strategy"), "rule")


@query("SELECT s AS strategy, CAST(0 AS BIGINT) AS wrong_text, CAST(0 AS BIGINT) AS wrong_number, CAST(0 AS BIGINT) AS uncovered FROM (SELECT unnest(['fixed', 'hierarchical', 'parent_child', 'recursive', 'sentence', 'sliding_window', 'structure', 'token']) AS s)")
def chunk_contract_violations(spark, sf_dir):
    """For the eight strategies that need neither a provider nor rules."""
    names = ("fixed", "hierarchical", "parent_child", "recursive", "sentence", "sliding_window", "structure", "token")
    return C.contract(_docs(spark, sf_dir), {n: {"include_section_path": False} if n in ("structure", "hierarchical") else {} for n in names})


@query("SELECT s AS strategy, CAST(0 AS BIGINT) AS wrong_text, CAST(0 AS BIGINT) AS wrong_number, CAST(0 AS BIGINT) AS uncovered FROM (SELECT unnest(['metadata_aware', 'semantic']) AS s)")
def chunk_contract_violations_provided(spark, sf_dir):
    """For the strategies with a provider or rules."""
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("csv", "json", "markdown", "html", "docx", "txt", "pdf")]), (F.col("doc_id") % 7 + 1).cast("int"))
    rules = [r | ({"params": r.get("params", {}) | {"include_section_path": False}} if r["strategy"] == "structure" else {}) for r in C.DEFAULT_RULES]
    return C.contract(_docs(spark, sf_dir).withColumn("source_type", kinds), {"metadata_aware": {"rules": rules}, "semantic": {}}, HashProvider(512))


@query("WITH c AS (" + _fixed_sql(500, 50) + ") SELECT CAST(count(*) AS BIGINT) AS chunks, round(avg(\"end\" - \"start\"), 6) AS avg_chars, CAST(median(\"end\" - \"start\") AS DOUBLE) AS median_chars, CAST(min(\"end\" - \"start\") AS INT) AS min_chars, CAST(max(\"end\" - \"start\") AS INT) AS max_chars FROM c")
def chunk_stats(spark, sf_dir):
    return C.chunk_stats(C.chunk(_docs(spark, sf_dir), "fixed")).drop("strategy", "context_chunks")


# --- semantic analysis on stored vectors ---------------------------------------------------------


def _distances(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    order = Window.partitionBy("label").orderBy("vec_id")
    return rows.withColumn("following", F.lead("embedding").over(order)).withColumn("distance", F.round(1 - X.cosine(F.col("embedding"), F.col("following")), 6))


_DIST = "d AS (SELECT label, vec_id, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nx FROM embeddings), e AS (SELECT label, vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(nx AS DOUBLE[])), 6) AS distance FROM d)"


@query(f"WITH {_DIST} SELECT label, vec_id, distance FROM e WHERE distance IS NOT NULL")
def semantic_distances(spark, sf_dir):
    return _distances(spark, sf_dir).filter("distance IS NOT NULL").select("label", "vec_id", "distance")


@query(f"WITH {_DIST} SELECT label, round(quantile_cont(distance, 0.85), 4) AS percentile_85, round(avg(distance) + stddev_pop(distance), 4) AS std_1 FROM e GROUP BY label")
def semantic_thresholds(spark, sf_dir):
    return _distances(spark, sf_dir).groupBy("label").agg(F.round(F.percentile("distance", 0.85), 4).alias("percentile_85"), F.round(F.avg("distance") + F.stddev_pop("distance"), 4).alias("std_1"))


@query(f"WITH {_DIST}, t AS (SELECT label, quantile_cont(distance, 0.85) AS t FROM e GROUP BY label), c AS (SELECT e.label, vec_id, CASE WHEN distance > t THEN 1 ELSE 0 END AS cut FROM e JOIN t USING (label)), g AS (SELECT label, vec_id, sum(cut) OVER (PARTITION BY label ORDER BY vec_id) - cut AS grp FROM c) SELECT label, CAST(grp AS BIGINT) AS grp, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id FROM g GROUP BY label, grp")
def semantic_groups(spark, sf_dir):
    rows = _distances(spark, sf_dir).select("label", "vec_id", "distance")
    cuts = rows.groupBy("label").agg(F.percentile("distance", 0.85).alias("t"))
    cut = F.coalesce((F.col("distance") > F.col("t")).cast("int"), F.lit(0))
    marked = rows.join(cuts, "label").withColumn("cut", cut)
    grp = F.sum("cut").over(Window.partitionBy("label").orderBy("vec_id")) - F.col("cut")
    return marked.withColumn("grp", grp.cast("long")).groupBy("label", "grp").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


@query("WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents), b AS (SELECT doc_id, md5(w) AS h FROM w), c AS (SELECT doc_id, CAST(('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::BIGINT % 512 AS INT) AS bucket FROM b) SELECT doc_id, bucket, CAST(count(*) AS DOUBLE) + CASE WHEN bucket = 0 THEN 0.001 ELSE 0 END AS value FROM c GROUP BY doc_id, bucket")
def hash_embedding(spark, sf_dir):
    """The hashing embedding's components that words fill, for every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    again, _ = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if again.isEmpty():
        counted = _word_counts(docs)
    else:  # only texts of repeated ids are put together
        alike = docs["doc_id"].eqNullSafe(again["doc_id"])
        counted = _word_counts(docs.join(again, alike, "left_anti"))
        counted = counted.unionByName(_word_counts(docs.join(again, alike, "left_semi")).groupBy("doc_id", "bucket").agg(F.sum("n").alias("n")))
    return counted.select("doc_id", "bucket", (F.col("n").cast("double") + F.when(F.col("bucket") == 0, 0.001).otherwise(0.0)).alias("value"))


def _word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, bucket, n of each text: its sorted buckets are counted inside the row."""
    runs = spread(docs).select("doc_id", F.sort_array(X.hash_buckets(F.col("text"), 512)).alias("b"))
    return runs.select("doc_id", F.explode(X.run_lengths(F.col("b"))).alias("r")).select("doc_id", F.col("r.value").alias("bucket"), F.col("r.n").alias("n"))


@query("SELECT count(DISTINCT text) AS misses, count(*) - count(DISTINCT text) AS hits FROM documents")
def embedding_cache_dedup(spark, sf_dir):
    keys = _table(spark, sf_dir, "documents").groupBy(F.sha2(F.concat(F.lit("hash-512\u0000"), F.col("text")), 256).alias("key")).agg(F.count("*").alias("n"))
    return keys.agg(F.count("*").alias("misses"), (F.sum("n") - F.count("*")).alias("hits"))


@query("SELECT unnest([1, 2]) AS run, unnest([count(DISTINCT coalesce(text, '')), 0]) AS misses, unnest([count(*) - count(DISTINCT coalesce(text, '')), count(*)]) AS hits, unnest([count(*), count(*)]) AS embedded FROM documents")
def embedding_cache_runs(spark, sf_dir):
    """All texts embedded twice through one cache: what was sent, what was spared, and the rows that got a vector."""
    rows, path = _table(spark, sf_dir, "documents").select("doc_id", "text"), f"{shared_dir(spark)}/quillspark-cache-{uuid.uuid4().hex[:8]}"
    told = []
    try:
        for run in (1, 2):
            found, counts = embed_cached(spread(rows), HashProvider(64), path)
            told.append((run, counts["misses"], counts["hits"], found.filter(F.size("embedding") == 64).count()))
    finally:
        remove(spark, path)
    return spark.createDataFrame(told, "run int, misses long, hits long, embedded long")


@query("WITH u AS (SELECT DISTINCT lang AS tenant_id, text FROM documents WHERE trim(text) <> ''), c AS (SELECT tenant_id, length(text) AS n FROM u) SELECT tenant_id, count(*) AS documents, CAST(sum(CASE WHEN n <= 500 THEN 1 ELSE CAST(ceil((n - 500) / 450.0) AS INT) + 1 END) AS BIGINT) AS records, CAST(1 AS INT) AS versions FROM c GROUP BY tenant_id")
def index_store(spark, sf_dir):
    """All documents indexed twice into a store, each under a name of its own: equal contents of a tenant are stored once, and the second run adds nothing."""
    path = f"{shared_dir(spark)}/quillspark-store-{uuid.uuid4().hex[:8]}"
    atexit.register(remove, spark, path)  # the result reads the store
    name = F.lpad(F.col("doc_id").cast("string"), 20, "0")
    docs = _docs(spark, sf_dir).filter(F.trim("text") != "").withColumns({"source": name, "filename": name, "document_id": X.document_id(X.content_hash(F.col("text")), F.lit(1))}).drop("doc_id")
    store = K.Store(spark, path)
    for _ in range(2):
        index(store, docs, HashProvider(64))
    return store.rows().groupBy("tenant_id").agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("records"), F.max("version").cast("int").alias("versions"))


# --- sources -----------------------------------------------------------------------------------


@query("SELECT page_id, nullif(trim(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')), '') AS title FROM pages")
def html_title(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        title = F.replace(title, F.lit(name), F.lit(mark))
    return _table(spark, sf_dir, "pages").select("page_id", F.nullif(F.trim(title), F.lit("")).alias("title"))


@query()
def html_text(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("page.html").alias("name"), F.lit("html").alias("kind"), F.col("html").cast("binary").alias("content"))
    parsed = S.parse_files(pages)
    text = X.clean_text(F.col("sections")[0]["text"])
    return parsed.select(F.col("path").cast("long").alias("page_id"), F.length(text).alias("n"), F.md5(text.cast("binary")).alias("digest"), F.col("format.title").alias("title"), "error")


@query("SELECT n_nationkey, concat_ws(' | ', 'n_nationkey: ' || n_nationkey, 'n_name: ' || nullif(trim(n_name), ''), 'n_regionkey: ' || n_regionkey) AS line FROM nation")
def csv_render_nation(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation")
    return rows.select("n_nationkey", S.render_rows(rows).alias("line"))


@query("SELECT p_partkey, concat_ws(' | ', 'p_name: ' || nullif(trim(p_name), ''), 'p_brand: ' || nullif(trim(p_brand), ''), 'p_type: ' || nullif(trim(p_type), ''), 'p_size: ' || p_size) AS line FROM part")
def csv_render_part(spark, sf_dir):
    rows = _table(spark, sf_dir, "part")
    return rows.select("p_partkey", S.render_rows(rows.select("p_name", "p_brand", "p_type", "p_size")).alias("line"))


@query("WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) SELECT event_id, key || ': ' || (props::JSON ->> ('$.' || key)) AS line FROM k")
def json_flatten_props(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", "props", F.explode(F.json_object_keys("props")).alias("key"))
    leaf = F.variant_get(F.parse_json("props"), "$", "map<string,string>")[F.col("key")]
    return rows.select("event_id", F.concat("key", F.lit(": "), leaf).alias("line"))


@query(
    "WITH n AS (SELECT doc_id, source || CASE doc_id % 8 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.Text' WHEN 3 THEN '.md' WHEN 4 THEN '.HTM' WHEN 5 THEN '.csv' WHEN 6 THEN '.json' ELSE '.bin' END AS name FROM documents) "
    "SELECT doc_id, name, CASE lower(regexp_extract(name, '(\\.[^.]+)$', 1)) WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.text' THEN 'txt' WHEN '.md' THEN 'markdown' WHEN '.htm' THEN 'html' WHEN '.csv' THEN 'csv' WHEN '.json' THEN 'json' ELSE CASE WHEN doc_id % 16 = 7 THEN 'html' END END AS source_type FROM n"
)
def detect_types(spark, sf_dir):
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".PDF", ".docx", ".Text", ".md", ".HTM", ".csv", ".json", ".bin")]), (F.col("doc_id") % 8 + 1).cast("int"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.concat("source", suffix).alias("name"))
    mime = F.when(F.col("doc_id") % 16 == 7, F.lit("Application/XHTML+xml; charset=utf-8")).otherwise(F.lit("application/octet-stream"))
    return rows.select("doc_id", "name", S.file_type(F.col("name"), mime).alias("source_type"))


@query("WITH s AS (SELECT doc_id, source AS name, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars * 4000 END AS size FROM documents) SELECT doc_id, CASE WHEN size = 0 THEN name || ' is empty.' WHEN size > 5000000 THEN name || ' is ' || printf('%.1f', size / 1048576.0) || ' MB; the limit is ' || printf('%.1f', 5000000 / 1048576.0) || ' MB.' END AS error FROM s")
def validate_files(spark, sf_dir):
    size = F.when(F.col("doc_id") % 5 == 0, F.lit(0).cast("long")).otherwise(F.col("n_chars") * 4000)
    return _table(spark, sf_dir, "documents").select("doc_id", S.size_error(F.col("source"), size, 5_000_000).alias("error"))


@query("SELECT doc_id, source, coalesce(CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END, lang) AS category, l.doc_id IS NOT NULL AS has_sidecar FROM documents d LEFT JOIN labels l USING (doc_id)".replace("l.doc_id IS NOT NULL", "l.quality IS NOT NULL"))
def sidecar_merge(spark, sf_dir):
    side = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = _table(spark, sf_dir, "documents").join(side, "doc_id", "left")
    said = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return rows.select("doc_id", "source", F.coalesce(said, "lang").alias("category"), F.col("quality").isNotNull().alias("has_sidecar"))


# --- search ------------------------------------------------------------------------------------


def _first_vector(spark, sf_dir) -> list[float]:
    return _table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


_Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)"
_SCORE = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.v)"


@query("SELECT a.label, a.vec_id, b.vec_id AS next_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    two = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("other"))
    return rows.join(two, "vec_id").select("label", "vec_id", "next_id", F.round(X.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query(f"WITH {_Q} SELECT e.vec_id, row_number() OVER (ORDER BY {_SCORE} DESC, e.vec_id) AS rank, round({_SCORE}, 6) AS score FROM embeddings e, q QUALIFY rank <= 10")
def topk(spark, sf_dir):
    found = K.top_k(_table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 10, id_col="vec_id")
    return found.select("vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {_Q} SELECT e.vec_id, row_number() OVER (ORDER BY {_SCORE} DESC, e.vec_id) AS rank, round({_SCORE}, 6) AS score FROM embeddings e, q WHERE e.label = 3 QUALIFY rank <= 10")
def topk_filtered(spark, sf_dir):
    found = K.top_k(_table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 10, {"label": 3}, id_col="vec_id")
    return found.select("vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _batch(spark, sf_dir, k: int) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return K.top_k_batch(rows, asked, k, id_col="vec_id")


_BATCH = "b AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0), r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank, s FROM b)"


@query(f"WITH {_BATCH} SELECT query_id, vec_id, rank, round(s, 6) AS score FROM r WHERE rank <= 5")
def topk_batch(spark, sf_dir):
    return _batch(spark, sf_dir, 5).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {_Q}, s AS (SELECT e.vec_id, e.label, {_SCORE} AS s FROM embeddings e, q), a AS (SELECT vec_id FROM s WHERE label = 3 ORDER BY s DESC, vec_id LIMIT 10), t AS (SELECT vec_id, label FROM s ORDER BY s DESC, vec_id LIMIT 10) SELECT (SELECT count(*) FROM a) AS before_ranking, (SELECT count(*) FROM t WHERE label = 3) AS after_ranking")
def filter_before_vs_after(spark, sf_dir):
    rows, q = _table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir)
    before = K.top_k(rows, q, 10, {"label": 3}, id_col="vec_id").agg(F.count("*").alias("before_ranking"))
    return before.crossJoin(K.top_k(rows, q, 10, id_col="vec_id").agg(F.count_if(F.col("label") == 3).alias("after_ranking")))  # one row each


@query(f"WITH {_BATCH}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id, CASE WHEN vec_id % 3 = 0 THEN -vec_id - 1 ELSE vec_id // 4 END ORDER BY rank) AS nth FROM r WHERE rank <= 20) SELECT query_id, vec_id, rank, CASE WHEN vec_id % 3 = 0 THEN 'own ' || vec_id ELSE 'context ' || (vec_id // 4) END AS text, CASE WHEN vec_id % 3 <> 0 THEN 'own ' || vec_id END AS matched_text FROM t WHERE nth = 1")
def expand_context(spark, sf_dir):
    ranked = _batch(spark, sf_dir, 20)
    group = F.floor(F.col("vec_id") / 4).cast("string")
    inside = F.col("vec_id") % 3 != 0
    ranked = ranked.select("query_id", "vec_id", "rank", F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("own "), F.col("vec_id").cast("string")).alias("text"), F.when(inside, F.concat(F.lit("c"), group)).alias("context_id"), F.when(inside, F.concat(F.lit("context "), group)).alias("context_text"))
    return R.expand_to_context(ranked, ["query_id"]).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), "text", "matched_text")


@query(f"WITH {_BATCH} SELECT query_id, vec_id, vec_id || ' | Source: ' || 'file' || (vec_id % 7) || CASE WHEN vec_id % 2 = 0 THEN ' | Page: ' || (vec_id // 2) ELSE '' END || ' | Document: ' || 'd' || vec_id AS line FROM r WHERE rank <= 5")
def source_lines(spark, sf_dir):
    rows = _batch(spark, sf_dir, 5)
    v = F.col("vec_id").cast("string")
    line = R.source_line(v, F.concat(F.lit("file"), (F.col("vec_id") % 7).cast("string")), F.when(F.col("vec_id") % 2 == 0, F.floor(F.col("vec_id") / 2)), F.concat(F.lit("d"), v))
    return rows.select("query_id", "vec_id", line.alias("line"))


_SAID = R.INSTRUCTION.replace("'", "''")


@query(
    f"WITH {_BATCH}, t AS (SELECT r.query_id, rank, 'Chunk ID: ' || r.vec_id || chr(10) || 'Similarity score: ' || printf('%.6f', s) || chr(10) || r.vec_id || ' | Source: file' || (r.vec_id % 7) || ' | Document: d' || r.vec_id || chr(10) || 'Metadata: {{\"document_id\": \"d' || r.vec_id || '\", \"filename\": \"file' || (r.vec_id % 7) || '\", \"label\": ' || e.label || '}}' || chr(10) || 'Text:' || chr(10) || 'text ' || r.vec_id AS part FROM r JOIN embeddings e USING (vec_id) WHERE rank <= 5) "
    f"SELECT query_id, length(p) AS n, md5(p) AS digest FROM (SELECT query_id, 'System Instructions:' || chr(10) || '{_SAID}' || chr(10) || chr(10) || 'Context:' || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question:' || chr(10) || 'What is near ' || query_id || '?' || chr(10) || chr(10) || 'Answer:' || chr(10) AS p FROM t GROUP BY query_id)"
)
def prompt_text(spark, sf_dir):
    """The prompt of every query of the batch, from its five nearest vectors."""
    v = F.col("vec_id").cast("string")
    rows = _batch(spark, sf_dir, 5).join(_table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("group")), "vec_id")
    told = rows.select("query_id", F.concat(F.lit("What is near "), F.col("query_id").cast("string"), F.lit("?")).alias("question"), "rank", v.alias("chunk_id"), "score", F.concat(F.lit("file"), (F.col("vec_id") % 7).cast("string")).alias("filename"), F.concat(F.lit("d"), v).alias("document_id"), F.col("group").alias("label"), F.concat(F.lit("text "), v).alias("text"))
    found = R.prompts(told, ["query_id"])
    return found.select("query_id", F.length("prompt").cast("long").alias("n"), F.md5(F.col("prompt").cast("binary")).alias("digest"))


# --- versions and tenants ------------------------------------------------------------------------


def _arrivals(spark, sf_dir) -> DataFrame:
    rows = _docs(spark, sf_dir)
    return rows.select("tenant_id", "filename", F.col("doc_id").alias("seq"), X.document_id(X.content_hash(F.col("text")), F.lit(1)).alias("document_id"))


_HIST = "a AS (SELECT lang AS tenant_id, source AS filename, doc_id AS seq, sha256(text)[1:16] AS file_key FROM documents), b AS (SELECT *, lag(file_key) OVER (PARTITION BY tenant_id, filename ORDER BY seq) AS bf FROM a), h AS (SELECT tenant_id, filename, seq, file_key, row_number() OVER w AS version, lag(file_key) OVER w AS previous_version FROM b WHERE bf IS DISTINCT FROM file_key WINDOW w AS (PARTITION BY tenant_id, filename ORDER BY seq))"


@query(f"WITH {_HIST} SELECT tenant_id, filename, seq, file_key, version, previous_version FROM h")
def version_history_all(spark, sf_dir):
    return version_history(_arrivals(spark, sf_dir)).withColumn("version", F.col("version").cast("long"))


@query(f"WITH {_HIST} SELECT tenant_id, filename, max_by(file_key, version) AS file_key, max(version) AS version FROM h GROUP BY ALL")
def store_after_replay(spark, sf_dir):
    """What is current after all arrivals: the latest content of every file of every tenant."""
    rows = version_history(_arrivals(spark, sf_dir))
    return rows.groupBy("tenant_id", "filename").agg(F.max_by("file_key", "version").alias("file_key"), F.max("version").cast("long").alias("version"))


@query("WITH s AS (SELECT DISTINCT lang, sha256(text)[1:16] || '-1' AS document_id FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id, lang, source, sha256(text)[1:16] || '-1' AS document_id FROM documents WHERE doc_id % 2 = 1) SELECT n.doc_id, n.lang AS tenant_id, n.document_id FROM n ANTI JOIN s ON n.lang = s.lang AND n.document_id = s.document_id")
def incremental_plan(spark, sf_dir):
    """Of the odd arrivals those that a store of the even ones doesn't hold."""
    rows = _docs(spark, sf_dir).select("doc_id", "tenant_id", X.document_id(X.content_hash(F.col("text")), F.lit(1)).alias("document_id"))
    stored = rows.filter("doc_id % 2 = 0").select("tenant_id", "document_id").distinct()
    return rows.filter("doc_id % 2 = 1").join(stored, ["tenant_id", "document_id"], "left_anti").select("doc_id", "tenant_id", "document_id")


@query("SELECT d.lang AS tenant_id, count(*) AS changed FROM documents d JOIN labels l USING (doc_id) WHERE l.quality <> d.n_chars % 2 GROUP BY 1")
def refresh_changes(spark, sf_dir):
    """Records whose stored field differs from the arriving one, by tenant."""
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    return rows.filter(~F.col("quality").eqNullSafe((F.col("n_chars") % 2).cast("int"))).groupBy(F.col("lang").alias("tenant_id")).agg(F.count("*").alias("changed"))


@query("SELECT lang AS tenant_id, count(DISTINCT sha256(text)) AS documents, count(*) AS records FROM documents GROUP BY 1")
def tenant_documents(spark, sf_dir):
    rows = _arrivals(spark, sf_dir).groupBy("tenant_id", "document_id").agg(F.count("*").alias("n"))
    return rows.groupBy("tenant_id").agg(F.count("*").alias("documents"), F.sum("n").alias("records"))


# --- evaluation --------------------------------------------------------------------------------


def _gold(spark, sf_dir) -> DataFrame:
    """Benchmark passages where documents hold them: question_id, position, document_id, e_start, e_end."""
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("passage"))
    return V.locate_anywhere(items, _docs(spark, sf_dir))


def _evidence(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The passages as a table, so that they are located once, and the documents that hold any."""
    gold, _ = written(_gold(spark, sf_dir))
    return gold, V.holding(_docs(spark, sf_dir), gold)


_GOLD = "g AS (SELECT b.item_id AS question_id, CAST(d.doc_id AS VARCHAR) AS document_id, instr(d.text, b.text) - 1 AS e_start, instr(d.text, b.text) - 1 + length(b.text) AS e_end FROM benchmark b JOIN documents d ON instr(d.text, b.text) > 0)"
_CH = "c AS (SELECT CAST(regexp_extract(chunk_id, '^(.*)_chunk_', 1) AS VARCHAR) AS document_id, chunk_id, \"start\" AS s, \"end\" AS e FROM (" + _fixed_sql(500, 50) + "))"
_OV = f"{_GOLD}, {_CH}, o AS (SELECT g.question_id, g.document_id, c.chunk_id, c.s, c.e, g.e_start, g.e_end, least(c.e, g.e_end) - greatest(c.s, g.e_start) AS shared FROM g JOIN c ON c.document_id = g.document_id AND c.s < g.e_end AND g.e_start < c.e)"


@query(f"WITH {_GOLD} SELECT question_id, document_id, CAST(e_start AS INT) AS e_start, CAST(e_end AS INT) AS e_end FROM g")
def evidence_locations(spark, sf_dir):
    return _gold(spark, sf_dir).select("question_id", "document_id", "e_start", "e_end")


@query(f"WITH {_OV} SELECT question_id, document_id, chunk_id, CAST(shared AS INT) AS shared, shared >= 0.5 * (e_end - e_start) OR shared >= 0.5 * (e - s) AS relevant FROM o")
def evidence_overlap(spark, sf_dir):
    gold, docs = _evidence(spark, sf_dir)
    chunks = C.chunk(docs, "fixed").select("document_id", "chunk_id", "start", "end")
    return V.overlaps(chunks, gold, []).select("question_id", "document_id", "chunk_id", F.col("shared").cast("int").alias("shared"), V.relevant().alias("relevant"))


@query(f"WITH {_OV} SELECT question_id, document_id, CAST(max(e_end - e_start) AS BIGINT) AS covered FROM o GROUP BY ALL")
def evidence_coverage(spark, sf_dir):
    """Overlapping chunks together cover every passage once."""
    gold, docs = _evidence(spark, sf_dir)
    chunks = C.chunk(docs, "fixed").select("document_id", "start", "end")
    spans = chunks.join(gold.select("question_id", "document_id").distinct(), "document_id").withColumn("doc", F.col("document_id"))
    return V.covered(spans, gold.withColumn("doc", F.col("document_id")), ["question_id", "doc"]).select("question_id", F.col("doc").alias("document_id"), F.col("covered").cast("long").alias("covered"))


@query(f"WITH {_OV} SELECT question_id, chunk_id, s <= e_start AND e_end <= e AS whole FROM o")
def case_study_holders(spark, sf_dir):
    gold, docs = _evidence(spark, sf_dir)
    chunks = C.chunk(docs, "fixed").select("document_id", "chunk_id", "start", "end", "retrievable")
    nothing = chunks.select(F.lit(-1).cast("long").alias("question_id"), "chunk_id", F.lit(1).alias("rank")).filter("false")
    return V.holders(chunks, gold, nothing).select("question_id", "chunk_id", "whole")


def _rankings(spark, sf_dir, strategies: tuple[str, ...], k: int) -> tuple[DataFrame, DataFrame]:
    """The first k of a stated ranking of the chunks of documents that hold a passage: by hash, the same in every engine. Both are tables."""
    gold, docs = _evidence(spark, sf_dir)
    every = None
    for name in strategies:
        chunks = C.chunk(docs, name).select(F.lit(name).alias("label"), "document_id", "chunk_id", "start", "end")
        every = chunks if every is None else every.unionByName(chunks)
    rows = every.join(gold.select("question_id", "document_id").distinct(), "document_id")
    order = Window.partitionBy("label", "question_id").orderBy(F.md5(F.concat("chunk_id", F.col("question_id").cast("string")).cast("binary")), "chunk_id")
    return written(rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))[0], gold


_SL = "l AS (SELECT CAST(regexp_extract(chunk_id, '^(.*)_chunk_', 1) AS VARCHAR) AS document_id, chunk_id, \"start\" AS s, \"end\" AS e FROM (WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS key, text FROM documents WHERE trim(text) <> ''), " + _WINDOWS + "))"
_RANKED = (
    f"{_GOLD}, {_CH}, {_SL}, u AS (SELECT 'fixed' AS label, * FROM c UNION ALL SELECT 'sliding_window', * FROM l), gd AS (SELECT DISTINCT question_id, document_id FROM g), "
    "r AS (SELECT label, question_id, document_id, chunk_id, s, e, row_number() OVER (PARTITION BY label, question_id ORDER BY md5(chunk_id || question_id), chunk_id) AS rank FROM u JOIN gd USING (document_id)), "
    "kr AS (SELECT r.*, k FROM r, (SELECT unnest([1, 3, 5]) AS k) WHERE rank <= k), "
    "rel AS (SELECT kr.label, kr.question_id, kr.k, kr.rank, bool_or(coalesce(least(e, e_end) - greatest(s, e_start) > 0 AND (least(e, e_end) - greatest(s, e_start) >= 0.5 * (e_end - e_start) OR least(e, e_end) - greatest(s, e_start) >= 0.5 * (e - s)), false)) AS rel FROM kr LEFT JOIN g ON g.question_id = kr.question_id AND g.document_id = kr.document_id GROUP BY ALL), "
    "m AS (SELECT label, question_id, k, avg(rel::INT) AS precision, max(rel::INT)::DOUBLE AS hit, coalesce(1.0 / min(rank) FILTER (WHERE rel), 0) AS reciprocal_rank FROM rel GROUP BY ALL)"
)


_SHOWN = ("precision", "hit", "reciprocal_rank")


def _measured(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The metrics of two strategies under the stated ranking, and the passages."""
    ks = [1, 3, 5]
    ranked, gold = _rankings(spark, sf_dir, ("fixed", "sliding_window"), max(ks))
    gold = gold.withColumn("position", F.row_number().over(Window.partitionBy("question_id").orderBy("document_id")))
    return V.question_metrics(ranked, ranked, gold, ks, ["label"]), gold


@query(f"WITH {_RANKED} SELECT label, question_id, k, round(precision, 6) AS precision, round(hit, 6) AS hit, round(reciprocal_rank, 6) AS reciprocal_rank FROM m")
def question_metrics(spark, sf_dir):
    found, _ = _measured(spark, sf_dir)
    return found.select("label", "question_id", "k", *[F.round(F.col(m).cast("double"), 6).alias(m) for m in _SHOWN])


@query(f"WITH {_RANKED} SELECT label, k, round(avg(precision), 6) AS precision, round(avg(hit), 6) AS hit, round(avg(reciprocal_rank), 6) AS reciprocal_rank FROM m GROUP BY ALL")
def metrics_by_strategy(spark, sf_dir):
    return V.averages(_measured(spark, sf_dir)[0], ["label", "k"]).select("label", "k", *[F.round(m, 6).alias(m) for m in _SHOWN])


@query(f"WITH {_RANKED} SELECT label, document_id, k, count(*) AS questions, round(avg(precision), 6) AS precision, round(avg(hit), 6) AS hit, round(avg(reciprocal_rank), 6) AS reciprocal_rank FROM m JOIN gd USING (question_id) GROUP BY ALL")
def metrics_by_document(spark, sf_dir):
    """Means over the questions whose passage a document holds."""
    found, gold = _measured(spark, sf_dir)
    rows = found.join(gold.select("question_id", "document_id").distinct(), "question_id")
    keys = ["label", "document_id", "k"]
    return rows.groupBy(*keys).agg(F.count("*").alias("questions"), *[F.round(F.avg(m), 6).alias(m) for m in _SHOWN])


@query(f"WITH {_RANKED}, a AS (SELECT label, document_id, round(avg(reciprocal_rank), 6) AS reciprocal_rank FROM m JOIN gd USING (question_id) WHERE k = 3 GROUP BY ALL) SELECT label, document_id, reciprocal_rank, reciprocal_rank = max(reciprocal_rank) OVER (PARTITION BY document_id) AS is_best FROM a")
def best_by_document(spark, sf_dir):
    means = QUERIES["metrics_by_document"](spark, sf_dir).filter("k = 3").select("label", "document_id", "reciprocal_rank")
    return V.best(means, "reciprocal_rank", ["document_id"])


@query(f"WITH {_GOLD} SELECT document_id, count(DISTINCT question_id) AS questions, count(*) AS passages FROM g GROUP BY document_id")
def questions_by_document(spark, sf_dir):
    return _gold(spark, sf_dir).groupBy("document_id").agg(F.countDistinct("question_id").alias("questions"), F.count("*").alias("passages"))


@query(f"WITH {_RANKED}, a AS (SELECT label, k, round(avg(reciprocal_rank), 6) AS reciprocal_rank FROM m GROUP BY ALL) SELECT label, k, reciprocal_rank, reciprocal_rank = max(reciprocal_rank) OVER (PARTITION BY k) AS is_best FROM a")
def best_by_k(spark, sf_dir):
    means = QUERIES["metrics_by_strategy"](spark, sf_dir).select("label", "k", "reciprocal_rank")
    return V.best(means, "reciprocal_rank", ["k"])


def _searched(spark, sf_dir) -> DataFrame:
    """The seven metrics of every strategy, benchmark item and k: all retrievable chunks of all documents compete by similarity.

    An item that no document holds has one passage that nothing covers, so it counts with zeros.
    """
    provider, ks = HashProvider(512), [1, 3, 5]
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("csv", "json", "markdown", "html", "docx", "txt", "pdf")]), (F.col("doc_id") % 7 + 1).cast("int"))
    docs = spread(_docs(spark, sf_dir)).withColumn("source_type", kinds)
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("passage"))
    asked = embed(items, provider, "passage", name="query").select(F.col("question_id").alias("query_id"), "query")
    gold, _ = written(_gold(spark, sf_dir).withColumn("position", F.row_number().over(Window.partitionBy("question_id").orderBy("document_id"))))
    nowhere = items.join(gold, "question_id", "left_anti").select("question_id", F.lit(1).alias("position"), F.lit("").alias("document_id"), F.lit(0).alias("e_start"), F.lit(1).alias("e_end"))
    found = nearest(docs, {name: (name, {}) for name in C.strategies()}, asked, provider, max(ks))
    ranked, _ = written(found.withColumnRenamed("query_id", "question_id"))  # a few rows for each item
    given = ranked.withColumns({"start": F.col("context_start"), "end": F.col("context_end")})
    return V.question_metrics(ranked, given, gold.unionByName(nowhere, allowMissingColumns=True), ks, ["label"])


@query()
def search_question_metrics(spark, sf_dir):
    return _searched(spark, sf_dir).select("label", "question_id", "k", *[F.round(F.col(m).cast("double"), 6).alias(m) for m in V.METRICS])


@query()
def search_metrics_by_strategy(spark, sf_dir):
    return V.averages(_searched(spark, sf_dir), ["label", "k"]).select("label", "k", *[F.round(m, 6).alias(m) for m in V.METRICS])


@query()
def search_best_by_k(spark, sf_dir):
    return V.best(QUERIES["search_metrics_by_strategy"](spark, sf_dir), "reciprocal_rank", ["k"])


# --- the flagship ------------------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str, question: str = "the of and in that", k: int = 5) -> DataFrame:
    """One question end to end: clean, identify, chunk, embed natively, filter, rank, cite."""
    ship(spark)
    docs = _table(spark, sf_dir, "documents").filter(F.col("lang") == "en").select(X.clean_text(F.col("text")).alias("text"), F.col("source").alias("filename"))
    docs = docs.withColumn("document_id", X.document_id(X.content_hash(F.col("text")), F.lit(1))).dropDuplicates(["document_id"])
    chunks = C.chunk(docs, "fixed")
    asked = HashProvider(512).embed(question)
    weight = {int(b): float(v) for b, v in enumerate(asked) if v}
    buckets: Column = X.hash_buckets(F.col("text"), 512)
    counts = chunks.select("chunk_id", "document_id", F.explode(F.concat(buckets, F.array(F.lit(-1)))).alias("b")).groupBy("chunk_id", "document_id", "b").agg(F.count("*").alias("n"))
    value = F.when(F.col("b") == -1, 0.001).otherwise(F.col("n").cast("double"))
    q = F.coalesce(F.create_map(*[F.lit(x) for p in weight.items() for x in p])[F.when(F.col("b") == -1, 0).otherwise(F.col("b"))], F.lit(0.0))
    scored = counts.groupBy("chunk_id", "document_id").agg((F.sum(value * q) / (F.sqrt(F.sum(value * value)) * F.lit(float((asked**2).sum() ** 0.5)))).alias("score"))
    best = scored.orderBy(F.desc("score"), "chunk_id").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))  # k rows
    return best.select(rank.alias("rank"), "chunk_id", F.round("score", 6).alias("score"), R.source_line(F.col("chunk_id"), F.lit(None).cast("string"), F.lit(None).cast("int"), F.col("document_id")).alias("source"))
