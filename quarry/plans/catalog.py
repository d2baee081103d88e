"""The query catalogue: each operator over the driver's tables, with DuckDB SQL for the same rows.

Documents stand for files and chunks (`source` for their folder), `embeddings`
for chunk vectors, labelled documents and pages for what is stored or on the
other side, events for file changes, orders for registry mappings, conversations
for notes with a session. Doubles are rounded on both sides, limits have
tie-breakers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.config import merged_json
from quarry.functions import frontmatter as fm
from quarry.functions import paths
from quarry.functions import text as tx
from quarry.functions.chunking import chunked
from quarry.functions.columns import rounded
from quarry.functions.vector import cosine, nonzero, parsed_embedding
from quarry.operators import blocks, clusters, embed, index, inverted, search, segments, sync
from quarry.session import passing_path, spread
from quarry.streaming import changes as ch
from quarry.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return put


#: Tables whose rows are much work for their bytes.
TEXTS = frozenset({"documents", "pages", "conversations"})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


# --- vectors -----------------------------------------------------------------

_Q = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
_COS = f"list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[])"


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(v) for v in table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


@query("vector_topk", f"SELECT vec_id, label, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_topk(spark, sf):
    found = search.vector_topk(table(spark, sf, "embeddings"), _query_vector(spark, sf), 10, "vec_id")
    return found.select("vec_id", "label", rounded(F.col("vector_score")).alias("score"))


@query("vector_topk_filtered", f"SELECT vec_id, label, round({_COS}, 6) AS score FROM embeddings WHERE label IN (1, 2, 3) ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark, sf):
    rows = table(spark, sf, "embeddings").where(F.col("label").isin(1, 2, 3))
    return search.vector_topk(rows, _query_vector(spark, sf), 10, "vec_id").select("vec_id", "label", rounded(F.col("vector_score")).alias("score"))


@query("vector_min_score", f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings WHERE {_COS} >= 0.1 ORDER BY {_COS} DESC, vec_id LIMIT 50")
def vector_min_score(spark, sf):
    return search.vector_topk(table(spark, sf, "embeddings"), _query_vector(spark, sf), 50, "vec_id", min_score=0.1).select("vec_id", rounded(F.col("vector_score")).alias("score"))


@query(
    "vector_unequal_len",
    f"SELECT vec_id, round(list_cosine_similarity((embedding[1:16 + label])::DOUBLE[], ({_Q}[1:16 + label])::DOUBLE[]), 6) AS score FROM embeddings",
)
def vector_unequal_len(spark, sf):
    q = F.array(*[F.lit(v) for v in _query_vector(spark, sf)])
    short = F.slice("embedding", F.lit(1), F.lit(16) + F.col("label"))
    return table(spark, sf, "embeddings").select("vec_id", rounded(cosine(short, q)).alias("score"))


@query(
    "vector_topk_many",
    """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s
       FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s)
       SELECT query_id, id, round(s, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5""",
)
def vector_topk_many(spark, sf):
    """A stated query set, every id divisible by 20, against all rows, in blocks."""
    rows = table(spark, sf, "embeddings")
    asked = [(r[0], list(r[1])) for r in rows.where(F.col("vec_id") % 20 == 0).select("vec_id", "embedding").collect()]
    return search.vector_topk_many(rows, asked, 5, "vec_id").select("query_id", "id", rounded(F.col("vector_score")).alias("score"), F.col("rank").cast("int").alias("rank"))


@query("vector_topk_index", f"SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_topk_index(spark, sf):
    index_ = clusters.build(table(spark, sf, "embeddings"), passing_path(spark, "vectors"), "vec_id")
    return index_.topk(_query_vector(spark, sf), 10).select("id", rounded(F.col("vector_score")).alias("score"))


@query("vector_topk_index_many", ORACLE_SQL["vector_topk_many"])
def vector_topk_index_many(spark, sf):
    """The queries of `vector_topk_many`, which stay a table."""
    rows = table(spark, sf, "embeddings")
    index_ = clusters.build(rows, passing_path(spark, "vectors"), "vec_id")
    found = index_.topk_many(rows.where(F.col("vec_id") % 20 == 0), 5, "vec_id")
    return found.select("query_id", "id", rounded(F.col("vector_score")).alias("score"), F.col("rank").cast("int").alias("rank"))


@query("embedding_json", "SELECT vec_id, len(embedding)::INT AS dims, round(list_sum(embedding::DOUBLE[]), 4) AS total, true AS usable FROM embeddings")
def embedding_json(spark, sf):
    stored = table(spark, sf, "embeddings").select("vec_id", F.to_json(F.col("embedding").cast("array<double>")).alias("j"))
    v = stored.select("vec_id", parsed_embedding(F.col("j")).alias("e"))
    return v.select("vec_id", F.size("e").alias("dims"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), nonzero(F.col("e")).alias("usable"))


# --- full text ---------------------------------------------------------------

_TOK = r"regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}\p{Co}]+')"
KEYWORD_QUERY = "the and of"
RARE_QUERY = "eau"
PHRASE_QUERY = "of_the"


def _bm25_sql(query_text: str, source: str = "SELECT doc_id AS id, text FROM documents") -> str:
    """CTEs t (tokens), f (counts) and r (id, rank) for a query."""
    phrases = tx.query_phrases(query_text)

    def count(p: list[str]) -> str:
        if len(p) == 1:
            return f"len(list_filter(tokens, lambda w: w = '{p[0]}'))"
        more = " AND ".join(f"tokens[i + {k}] = '{w}'" for k, w in enumerate(p))
        return f"len(list_filter(range(1, len(tokens) + 1), lambda i: {more}))"

    counts = ", ".join(f"{count(p)} AS f{i}" for i, p in enumerate(phrases))
    with_rows = ", ".join(f"sum((f{i} > 0)::INT) AS n{i}" for i in range(len(phrases)))
    idf = lambda i: f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END"
    terms = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / a))" for i in range(len(phrases)))
    where = " AND ".join(f"f{i} > 0" for i in range(len(phrases)))
    return f"""t AS (SELECT id, {_TOK} AS tokens FROM ({source})), f AS (SELECT id, len(tokens) AS d, {counts} FROM t),
        s AS (SELECT count(*) AS n, avg(d) AS a, {with_rows} FROM f), r AS (SELECT id, -({terms}) AS rank FROM f, s WHERE {where})"""


def _tokenised(spark: SparkSession, sf: str) -> DataFrame:
    return search.with_tokens(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("fts_query_build", """SELECT item_id, CASE WHEN len(regexp_extract_all(text, '[A-Za-z0-9_]+')) > 0 THEN '"' || list_aggregate(regexp_extract_all(text, '[A-Za-z0-9_]+'), 'string_agg', '" AND "') || '"' END AS query FROM benchmark""")
def fts_query_build(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tx.full_text_query(F.col("text")).alias("query"))


@query("fts_and_match", f"WITH {_bm25_sql(KEYWORD_QUERY)} SELECT id FROM r")
def fts_and_match(spark, sf):
    return search.bm25(_tokenised(spark, sf), KEYWORD_QUERY).select("id")


@query("fts_phrase_underscore", f"WITH {_bm25_sql(PHRASE_QUERY)} SELECT id, round(rank, 6) AS rank FROM r")
def fts_phrase_underscore(spark, sf):
    return search.bm25(_tokenised(spark, sf), PHRASE_QUERY).select("id", rounded(F.col("rank")).alias("rank"))


@query("bm25_rank", f"WITH {_bm25_sql(RARE_QUERY)} SELECT id, round(rank, 6) AS rank FROM r")
def bm25_rank(spark, sf):
    return search.bm25(_tokenised(spark, sf), RARE_QUERY).select("id", rounded(F.col("rank")).alias("rank"))


@query("bm25_score", f"WITH {_bm25_sql(RARE_QUERY)} SELECT id, round(1 / (1 + abs(rank)), 6) AS score, round(abs(rank) / (1 + abs(rank)), 6) AS monotone FROM r")
def bm25_score(spark, sf):
    found = search.bm25(_tokenised(spark, sf), RARE_QUERY)
    return found.select("id", rounded(search.rank_to_score(F.col("rank"))).alias("score"), rounded(search.rank_to_score(F.col("rank"), "monotone")).alias("monotone"))


@query("bm25_corpus_stats", f"SELECT count(*) AS n_rows, round(avg(len(tok)), 6) AS mean_length, sum((len(list_filter(tok, lambda w: w = 'eau')) > 0)::INT)::BIGINT AS n_with FROM (SELECT {_TOK} AS tok FROM documents)")
def bm25_corpus_stats(spark, sf):
    s = search.corpus_stats(_tokenised(spark, sf), [[RARE_QUERY]])
    return spark.createDataFrame([(s.rows, round(s.mean_length, 6), s.rows_with[0])], "n_rows long, mean_length double, n_with long")


@query("keyword_topk", f"WITH {_bm25_sql(KEYWORD_QUERY)} SELECT id, round(rank, 6) AS rank, round(1 / (1 + abs(rank)), 6) AS score FROM r ORDER BY r.rank, id LIMIT 20")
def keyword_topk(spark, sf):
    return search.keyword_topk(_tokenised(spark, sf), KEYWORD_QUERY, 20).select("id", rounded(F.col("rank")).alias("rank"), rounded(F.col("text_score")).alias("score"))


@query("inverted_topk", f"WITH {_bm25_sql(KEYWORD_QUERY)} SELECT id, round(rank, 6) AS rank FROM r ORDER BY r.rank, id LIMIT 20")
def inverted_topk(spark, sf):
    index_ = inverted.build(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), passing_path(spark, "postings"))
    return index_.bm25(KEYWORD_QUERY).orderBy("rank", "id").limit(20).select("id", rounded(F.col("rank")).alias("rank"))


@query("inverted_phrase", f"WITH {_bm25_sql(PHRASE_QUERY)} SELECT id, round(rank, 6) AS rank FROM r")
def inverted_phrase(spark, sf):
    index_ = inverted.build(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), passing_path(spark, "postings"))
    return index_.bm25(PHRASE_QUERY).select("id", rounded(F.col("rank")).alias("rank"))


@query("keyword_topk_pruned", f"WITH {_bm25_sql(KEYWORD_QUERY)} SELECT id, round(rank, 6) AS rank, round(1 / (1 + abs(rank)), 6) AS score FROM r ORDER BY r.rank, id LIMIT 20")
def keyword_topk_pruned(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("docno"), "text")
    path = passing_path(spark, "blocks")
    made = blocks.posting_blocks(search.with_tokens(blocks.in_order(docs)))
    made.drop("bucket").write.parquet(path)
    made = spark.read.schema(blocks.BLOCKS).parquet(path)
    length = made.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    found = blocks.PrunedIndex(made.withColumn("seg", F.lit("")), docs.count(), length).topk(KEYWORD_QUERY, 20)
    best = found.orderBy("rank", "docno").limit(20)
    return best.select(F.col("docno").alias("id"), rounded(F.col("rank")).alias("rank"), rounded(search.rank_to_score(F.col("rank"))).alias("score"))


_SEGMENTS = "SELECT 'memory/' || doc_id || '.md' AS id, text FROM documents WHERE source IS DISTINCT FROM 'src2'"


@query("segments_search", f"WITH {_bm25_sql(KEYWORD_QUERY, _SEGMENTS)} SELECT id, round(rank, 6) AS rank FROM r ORDER BY r.rank, id LIMIT 20")
def segments_search(spark, sf):
    """Three states of one index: a first segment, another with edited and added documents, and a list of deleted ones."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("memory/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "source", "text", (F.col("doc_id") % 3).alias("third"))
    store = segments.SegmentStore(spark, passing_path(spark, "segments"))

    def rows(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        files = some.select("path", "source", tx.text_hash(F.col("text")).alias("hash"), F.lit(0).cast("long").alias("mtime"), F.length("text").cast("long").alias("size"))
        chunks = some.select(F.col("path").alias("id"), "path", "source", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("").alias("hash"), F.lit("").alias("model"), "text", F.lit(0).cast("long").alias("updated_at"), F.array().cast("array<double>").alias("embedding"))
        return files, chunks

    first = docs.where("third > 0").withColumn("text", F.when(F.col("third") == 1, F.concat("text", F.lit(" the and of"))).otherwise(F.col("text")))
    seg, figures = store.write_segment(*rows(first))
    store = store.publish(segments={seg: figures})
    changed = docs.where("third < 2")
    seg, figures = store.write_segment(*rows(changed))
    old = store.files().join(changed.select("path"), "path", "left_semi")
    at, sums = store.write_lists(old, store.chunks().join(old.select("path"), "path", "left_semi"))
    store = store.publish(segments=sums | {seg: figures}, lists=[at])
    gone = store.files().where(F.col("source") == "src2")
    at, sums = store.write_lists(gone, store.chunks().where(F.col("source") == "src2"))
    store = store.publish(segments=sums, lists=[*store.manifest["lists"], at])
    return store.with_chunks(store.index().topk(KEYWORD_QUERY, 20)).orderBy("rank", "id").limit(20).select("id", rounded(F.col("rank")).alias("rank"))


@query("sources_filter", "SELECT doc_id, source, lang FROM documents WHERE lang = 'en' AND source IN ('src1', 'src3')")
def sources_filter(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", "lang", F.col("lang").alias("model"))
    return search.filtered(rows, "en", ["src1", "src3"]).select("doc_id", "source", "lang")


# --- hybrid ------------------------------------------------------------------

_CHUNKS = "SELECT d.doc_id AS id, d.source AS source, d.text AS text, e.embedding AS embedding FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id"


def _chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    path = F.concat(F.lit("memory/"), F.col("id").cast("string"), F.lit(".md"))
    return docs.join(vectors, "id", "left").select("id", path.alias("path"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), "source", "text", "embedding")


def _sides(spark: SparkSession, sf: str, text_query: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """The candidates of both sides; snippets are cut from them only."""
    rows = _chunk_table(spark, sf)
    v = search.vector_topk(rows, _query_vector(spark, sf), limit).withColumn("snippet", tx.snippet(F.col("text")))
    k = search.keyword_topk(search.with_tokens(rows), text_query, limit).withColumn("snippet", tx.snippet(F.col("text")))
    return v, k


def _hybrid_sql(text_query: str, limit: int, vw: str, tw: str, tail: str) -> str:
    return f"""WITH c AS ({_CHUNKS}), {_bm25_sql(text_query, "SELECT id, text FROM c")},
        v AS (SELECT id, {_COS} AS vs FROM c WHERE embedding IS NOT NULL ORDER BY vs DESC, id LIMIT {limit}), k AS (SELECT id, 1 / (1 + abs(rank)) AS ts FROM r ORDER BY rank, id LIMIT {limit}),
        m AS (SELECT coalesce(v.id, k.id) AS id, {vw} * coalesce(vs, 0) + {tw} * coalesce(ts, 0) AS score, vs, ts FROM v FULL JOIN k ON v.id = k.id) {tail}"""


_LIMIT = search.candidate_count(10)
_TOP = "SELECT id, round(score, 6) AS score, round(vs, 6) AS vector_score, round(ts, 6) AS text_score FROM m WHERE score >= 0.05 ORDER BY m.score DESC, vs DESC NULLS LAST, ts DESC NULLS LAST, id LIMIT 10"


def _scores(rows: DataFrame) -> DataFrame:
    return rows.select("id", *[rounded(F.col(c)).alias(c) for c in ("score", "vector_score", "text_score")])


@query("hybrid_merge", _hybrid_sql(KEYWORD_QUERY, _LIMIT, "0.7", "0.3", "SELECT id, round(score, 6) AS score, round(vs, 6) AS vector_score, round(ts, 6) AS text_score FROM m"))
def hybrid_merge(spark, sf):
    return _scores(search.merge_hybrid(*_sides(spark, sf, KEYWORD_QUERY, _LIMIT)))


@query("hybrid_keyword_only", _hybrid_sql(KEYWORD_QUERY, _LIMIT, "0.0", "1.0", "SELECT id, round(ts, 6) AS score FROM m WHERE ts IS NOT NULL"))
def hybrid_keyword_only(spark, sf):
    v, k = _sides(spark, sf, KEYWORD_QUERY, _LIMIT)
    return search.merge_hybrid(v.where(F.lit(False)), k).select("id", rounded(F.col("score")).alias("score"))


@query("hybrid_vector_only", _hybrid_sql(KEYWORD_QUERY, _LIMIT, "1.0", "0.0", "SELECT id, round(vs, 6) AS score FROM m WHERE vs IS NOT NULL"))
def hybrid_vector_only(spark, sf):
    v, k = _sides(spark, sf, KEYWORD_QUERY, _LIMIT)
    return search.merge_hybrid(v, k.where(F.lit(False))).select("id", rounded(F.col("score")).alias("score"))


@query("hybrid_search_e2e", _hybrid_sql(KEYWORD_QUERY, _LIMIT, "0.7", "0.3", _TOP))
def hybrid_search_e2e(spark, sf):
    return _scores(search.best(search.merge_hybrid(*_sides(spark, sf, KEYWORD_QUERY, _LIMIT)), 10, 0.05))


_PER_DIR = f"""WITH s AS (SELECT vec_id AS id, 'dir' || label AS directory, {_COS} AS score FROM embeddings),
    n AS (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY score DESC, id) AS n FROM s)"""


@query("multi_dir_search", f"{_PER_DIR} SELECT id, directory, round(score, 6) AS score FROM n WHERE n <= 15 ORDER BY n.score DESC, directory, id LIMIT 10")
def multi_dir_search(spark, sf):
    q = F.array(*[F.lit(v) for v in _query_vector(spark, sf)])
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("dir"), F.col("label").cast("string")).alias("directory"), cosine(F.col("embedding"), q).alias("score"))
    return search.best_across(rows, "directory", 10).select("id", "directory", rounded(F.col("score")).alias("score"))


@query("dir_filter", "SELECT source, count(*) AS n FROM documents WHERE contains(lower(source), 'rc1') OR contains(lower(source), 'src4') GROUP BY source")
def dir_filter(spark, sf):
    return table(spark, sf, "documents").where(search.in_directories(F.col("source"), ["RC1", "src4"])).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "format_results",
    f"""{_PER_DIR}, b AS (SELECT id, directory, score FROM n WHERE n <= 15 ORDER BY score DESC, directory, id LIMIT 10)
    SELECT id, '[' || row_number() OVER (ORDER BY score DESC, directory, id) || '] memory/' || id || '.md:1-' || (id % 7 + 1) || ' [' || directory || '] (' || printf('%.1f', round(score, 6) * 100) || '% match)' || chr(10) || directory AS shown FROM b""",
)
def format_results(spark, sf):
    q = F.array(*[F.lit(v) for v in _query_vector(spark, sf)])
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("dir"), F.col("label").cast("string")).alias("directory"), cosine(F.col("embedding"), q).alias("score"))
    top = search.best_across(rows, "directory", 10)
    number = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "directory", "id"))  # ten rows
    path = F.concat(F.lit("memory/"), F.col("id").cast("string"), F.lit(".md"))
    return top.select("id", search.shown(number, path, F.lit(1), F.col("id") % 7 + 1, rounded(F.col("score")), F.col("directory"), F.col("directory")).alias("shown"))


# --- chunks and texts --------------------------------------------------------


def _chunk_sql(tokens: int, overlap: int, tail: str) -> str:
    most, over = max(32, tokens * 4), max(0, overlap * 4)
    back = "hi" if over == 0 else f"coalesce(list_max(list_filter(range(lo, hi), lambda j: p[hi + 1] - p[j + 1] >= {over})), lo)"
    return f"""WITH RECURSIVE lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL),
        pieces AS (SELECT doc_id, no, k, substring(line, k * {most} + 1, {most}) AS t FROM (SELECT *, unnest(range(0, greatest(1, ceil(length(line) / {most}.0)::BIGINT))) AS k FROM lines)),
        segs AS (SELECT doc_id, list(t ORDER BY no, k) AS ts, list(no ORDER BY no, k) AS nos FROM pieces GROUP BY doc_id),
        d AS (SELECT doc_id, ts, nos, len(ts) AS n, list_prepend(0::HUGEINT, list_transform(range(1, len(ts) + 1), lambda i: list_sum(list_transform(ts[1:i], lambda x: length(x) + 1)))) AS p FROM segs),
        c AS (SELECT doc_id, ts, nos, n, p, 0 AS ordinal, 0::BIGINT AS lo, 0::BIGINT AS nxt, coalesce(list_min(list_filter(range(1, n), lambda i: p[i + 2] - p[1] > {most})), n) AS hi FROM d
            UNION ALL
            SELECT doc_id, ts, nos, n, p, ordinal + 1, lo2, hi, coalesce(list_min(list_filter(range(hi + 1, n), lambda i: p[i + 2] - p[lo2 + 1] > {most})), n)
            FROM (SELECT *, {back} AS lo2 FROM c WHERE hi < n)),
        o AS (SELECT doc_id, ordinal::INT AS ordinal, nos[lo + 1]::INT AS start_line, nos[hi]::INT AS end_line, array_to_string(ts[lo + 1:hi], chr(10)) AS text FROM c) {tail}"""


_CHUNK_ROWS = "SELECT doc_id, ordinal, start_line, end_line, sha256(text) AS hash, length(text)::INT AS n_chars FROM o"


def _chunk_query(tokens: int, overlap: int) -> Query:
    def run(spark, sf):
        return chunked(table(spark, sf, "documents"), tokens=tokens, overlap=overlap).select("doc_id", "ordinal", "start_line", "end_line", "hash", F.length("text").alias("n_chars"))

    return run


query("chunk_default", _chunk_sql(256, 32, _CHUNK_ROWS))(_chunk_query(256, 32))
query("chunk_no_overlap", _chunk_sql(256, 0, _CHUNK_ROWS))(_chunk_query(256, 0))
query("chunk_small", _chunk_sql(20, 5, _CHUNK_ROWS))(_chunk_query(20, 5))


@query("chunk_hash", _chunk_sql(256, 32, "SELECT sha256(text) AS hash, count(*) AS n FROM o GROUP BY 1 HAVING count(*) > 1"))
def chunk_hash(spark, sf):
    return chunked(table(spark, sf, "documents")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("chunk_stats", _chunk_sql(256, 32, "SELECT count(*) AS n, sum(start_line)::BIGINT AS starts, sum(end_line)::BIGINT AS ends, sum(length(text))::BIGINT AS chars, max(length(text))::INT AS longest FROM o"))
def chunk_stats(spark, sf):
    c = chunked(table(spark, sf, "documents"))
    return c.agg(F.count(F.lit(1)).alias("n"), F.sum("start_line").alias("starts"), F.sum("end_line").alias("ends"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))


@query("read_lines", "SELECT doc_id, array_to_string((string_split(text, chr(10)))[2:4], chr(10)) AS content, 2 AS start_line, (1 + len((string_split(text, chr(10)))[2:4]))::INT AS end_line FROM documents")
def read_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.read_lines(F.col("text"), 2, 3).alias("r")).select("doc_id", "r.*")


@query("append_text", "SELECT doc_id, sha256(text || CASE WHEN length(text) > 0 AND NOT suffix(text, chr(10)) THEN chr(10) ELSE '' END || source) AS hash FROM documents")
def append_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.text_hash(tx.appended(F.col("text"), F.col("source"))).alias("hash"))


@query("snippet", "SELECT doc_id, left(text, 700) AS snippet FROM documents")
def snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query("session_marker", "SELECT conv_id, turn, '<!-- 2024-01-02T03:04:05.000Z session=' || conv_id || ' source=' || role || ' -->' || chr(10) || text AS marked FROM conversations")
def session_marker(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.session_marker(F.col("text"), F.lit("2024-01-02T03:04:05.000Z"), F.col("conv_id").cast("string"), F.col("role")).alias("marked"))


# --- files and paths ---------------------------------------------------------

_LOCAL = "SELECT 'memory/' || source || '/' || doc_id || '.md' AS path, text, n_chars * 1000 AS mtime FROM documents"
_STORED = """SELECT 'memory/' || d.source || '/' || d.doc_id || '.md' AS path, CASE WHEN l.quality = 1 THEN d.text ELSE d.text || chr(10) END AS text, d.n_chars * 1000 + l.toxic AS mtime
    FROM documents d JOIN labels l USING (doc_id) UNION ALL SELECT 'memory/pages/' || page_id || '.md', html, page_id FROM pages"""
_HASHES = f"cur AS (SELECT path, sha256(text) AS hash, mtime FROM ({_LOCAL})), old AS (SELECT path, sha256(text) AS hash, mtime FROM ({_STORED}))"


def _doc_path() -> F.Column:
    return F.concat(F.lit("memory/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))


def _local(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(_doc_path().alias("path"), "text", (F.col("n_chars") * 1000).alias("mtime"))


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    old = old.select(_doc_path().alias("path"), F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit("\n"))).alias("text"), (F.col("n_chars") * 1000 + F.col("toxic")).alias("mtime"))
    pages = table(spark, sf, "pages").select(F.concat(F.lit("memory/pages/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), F.col("html").alias("text"), F.col("page_id").alias("mtime"))
    return old.unionByName(pages)


def _entries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return index.file_entries(_local(spark, sf)), index.file_entries(_stored(spark, sf))


@query("file_entries", f"SELECT path, 'memory' AS source, sha256(text) AS hash, mtime, strlen(text) AS size FROM ({_LOCAL})")
def file_entries(spark, sf):
    return index.file_entries(_local(spark, sf))


_CANDIDATES = """SELECT CASE role WHEN 'user' THEN 'memory/' || conv_id || '/' || turn || '.md' WHEN 'assistant' THEN './MEMORY.md' ELSE '..\\notes\\' || turn || '.txt' END AS p, conv_id, turn FROM conversations"""


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    p = F.when(F.col("role") == "user", F.concat(F.lit("memory/"), conv, F.lit("/"), turn, F.lit(".md"))).when(F.col("role") == "assistant", "./MEMORY.md").otherwise(F.concat(F.lit("..\\notes\\"), turn, F.lit(".txt")))
    return table(spark, sf, "conversations").select(p.alias("p"), "conv_id", "turn")


@query(
    "memory_path_check",
    rf"""SELECT conv_id, turn, replace(regexp_replace(trim(p), '^[./]+', ''), '\', '/') AS path,
    replace(regexp_replace(trim(p), '^[./]+', ''), '\', '/') IN ('MEMORY.md', 'memory.md') OR prefix(replace(regexp_replace(trim(p), '^[./]+', ''), '\', '/'), 'memory/') AS is_memory,
    NOT contains(p, '..') AND (regexp_replace(replace(p, '\', '/'), '^\./', '') IN ('MEMORY.md', 'memory.md') OR (prefix(regexp_replace(replace(p, '\', '/'), '^\./', ''), 'memory/') AND suffix(p, '.md'))) AS may_write FROM ({_CANDIDATES})""",
)
def memory_path_check(spark, sf):
    p = F.col("p")
    return _candidates(spark, sf).select("conv_id", "turn", paths.relative(p).alias("path"), paths.is_memory_path(p).alias("is_memory"), paths.may_be_written(p).alias("may_write"))


@query("file_discovery", f"SELECT path FROM ({_STORED}) WHERE regexp_matches(path, '^memory/.*[.]md$') ORDER BY path")
def file_discovery(spark, sf):
    return _stored(spark, sf).where(paths.is_memory_path(F.col("path")) & F.col("path").endswith(".md")).select("path").orderBy("path")


@query("glob_filter", f"SELECT path FROM ({_STORED}) WHERE regexp_full_match(path, 'memory/([^/]+/)*[^/]*[.]md') AND NOT regexp_full_match(path, 'memory/src1[^/]*/.*')")
def glob_filter(spark, sf):
    return _stored(spark, sf).where(paths.matches_globs(F.col("path"), ["MEMORY.md", "memory/**/*.md"], ["memory/src1*/**"])).select("path")


@query(
    "path_normalize",
    r"""SELECT page_id, regexp_replace(url, '/+$', '') || '/' AS repository, CASE WHEN prefix(url, 'https://') THEN '~' || substring(url, 9) ELSE url END AS short,
    CASE WHEN list_last(string_split(regexp_replace(url, '/+$', ''), '/')) LIKE '.%' THEN '' ELSE list_last(string_split(regexp_replace(url, '/+$', ''), '/')) END AS name FROM pages""",
)
def path_normalize(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", paths.repository_path(u).alias("repository"), paths.shortened(u, "https://").alias("short"), paths.directory_name(u, "/root").alias("name"))


@query("provider_key", "SELECT DISTINCT sha256(lang || ':' || source || ':' || 'v1') AS provider_key, lang, source FROM documents")
def provider_key(spark, sf):
    return table(spark, sf, "documents").select("lang", "source").distinct().select(paths.provider_key(F.col("lang"), F.col("source"), F.lit("v1")).alias("provider_key"), "lang", "source")


@query("machine_ids", "SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9-]', '-', 'g') || '-00ff' AS machine FROM supplier")
def machine_ids(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", paths.machine_id(F.col("s_name"), F.lit("00ff")).alias("machine"))


# --- index life cycle --------------------------------------------------------

_DIFF = f"""WITH {_HASHES} SELECT coalesce(cur.path, old.path) AS path, CASE WHEN old.path IS NULL THEN 'new' WHEN cur.path IS NULL THEN 'deleted' WHEN cur.hash = old.hash THEN 'unchanged' ELSE 'changed' END AS status
    FROM cur FULL JOIN old ON cur.path = old.path"""


@query("index_diff", _DIFF)
def index_diff(spark, sf):
    return index.diff(*_entries(spark, sf))


@query("index_diff_summary", f"SELECT status, count(*) AS n FROM ({_DIFF}) GROUP BY status")
def index_diff_summary(spark, sf):
    return index.diff(*_entries(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("to_index", f"WITH {_HASHES} SELECT path FROM cur WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.path = cur.path AND old.hash = cur.hash)")
def to_index(spark, sf):
    return index.to_index(_local(spark, sf), index.file_entries(_stored(spark, sf))).select("path")


@query("stale_check", f"WITH {_HASHES}, j AS (SELECT (cur.path IS NULL OR old.path IS NULL OR cur.mtime IS DISTINCT FROM old.mtime) AS differs FROM cur FULL JOIN old ON cur.path = old.path) SELECT bool_or(differs) AS stale, sum(differs::INT)::BIGINT AS n_differing FROM j")
def stale_check(spark, sf):
    return index.is_stale(*_entries(spark, sf))


@query("stale_delete", f"WITH {_HASHES} SELECT path, hash FROM old WHERE path IN (SELECT path FROM cur)")
def stale_delete(spark, sf):
    current, stored = _entries(spark, sf)
    return index.without_stale(stored, current).select("path", "hash")


@query("files_upsert", f"WITH {_HASHES} SELECT path, hash FROM old WHERE path NOT IN (SELECT path FROM cur) UNION ALL SELECT path, hash FROM cur")
def files_upsert(spark, sf):
    current, stored = _entries(spark, sf)
    return index.replaced(stored, current).select("path", "hash")


@query("reindex_needed", "SELECT p_partkey, (p_size > 40 OR p_brand IS DISTINCT FROM 'Brand#11' OR p_type IS DISTINCT FROM p_name) AS needed FROM part")
def reindex_needed(spark, sf):
    stored = {"model": F.col("p_brand"), "provider": F.col("p_type")}
    wanted = {"model": F.lit("Brand#11"), "provider": F.col("p_name")}
    return table(spark, sf, "part").select("p_partkey", index.reindex_needed(F.col("p_size") > 40, stored, wanted).alias("needed"))


@query("index_status", _chunk_sql(256, 32, "SELECT 'files' AS what, (SELECT count(*) FROM documents) AS n UNION ALL SELECT 'chunks', (SELECT count(*) FROM o) UNION ALL SELECT 'cache', (SELECT count(*) FROM embeddings)"))
def index_status(spark, sf):
    docs = table(spark, sf, "documents")
    return index.status(docs, chunked(docs), table(spark, sf, "embeddings"))


_CACHE = """SELECT 'p' AS provider, 'm' || label AS model, 'k' AS provider_key, sha256(text) AS hash, vec_id AS updated_at, embedding FROM documents JOIN embeddings ON doc_id = vec_id"""


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text").join(table(spark, sf, "embeddings"), "vec_id")
    return rows.select(F.lit("p").alias("provider"), F.concat(F.lit("m"), F.col("label").cast("string")).alias("model"), F.lit("k").alias("provider_key"), tx.text_hash(F.col("text")).alias("hash"), F.col("vec_id").alias("updated_at"), "embedding")


def _hashed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(tx.text_hash(F.col("text")).alias("hash"), "text")


@query("cache_hits", f"SELECT hash, updated_at FROM ({_CACHE}) c WHERE model = 'm3' AND hash IN (SELECT sha256(text) FROM documents)")
def cache_hits(spark, sf):
    return index.cache_hits(_hashed(spark, sf), _cache(spark, sf).withColumn("embedding", F.col("updated_at")), "p", "m3", "k").select("hash", F.col("embedding").alias("updated_at"))


@query("cache_misses", f"SELECT sha256(text) AS hash, min(length(text))::INT AS n_chars FROM documents WHERE sha256(text) NOT IN (SELECT hash FROM ({_CACHE}) WHERE model = 'm3') GROUP BY 1")
def cache_misses(spark, sf):
    return index.cache_misses(_hashed(spark, sf), _cache(spark, sf), "p", "m3", "k").select("hash", F.length("text").alias("n_chars"))


@query("cache_upsert", f"""WITH b AS (SELECT * FROM ({_CACHE}) UNION ALL SELECT provider, 'm0', provider_key, hash, updated_at + 1, embedding FROM ({_CACHE}))
    SELECT provider, model, provider_key, hash, max(updated_at) AS updated_at FROM b GROUP BY ALL""")
def cache_upsert(spark, sf):
    cache = _cache(spark, sf)
    new = cache.withColumn("model", F.lit("m0")).withColumn("updated_at", F.col("updated_at") + 1)
    return index.cache_upserted(cache, new).drop("embedding")


@query("cache_touch", f"SELECT hash, model, CASE WHEN hash IN (SELECT sha256(d.text) FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1) THEN 999999 ELSE updated_at END AS updated_at FROM ({_CACHE})")
def cache_touch(spark, sf):
    good = table(spark, sf, "documents").join(table(spark, sf, "labels").where("quality = 1"), "doc_id").select(tx.text_hash(F.col("text")).alias("hash"))
    return index.cache_touched(_cache(spark, sf), good, 999_999).select("hash", "model", "updated_at")


@query("cache_prune", f"SELECT hash, updated_at FROM ({_CACHE}) ORDER BY updated_at DESC, provider, model, provider_key, hash LIMIT 100")
def cache_prune(spark, sf):
    return index.cache_pruned(_cache(spark, sf), 100).select("hash", "updated_at")


@query("embed_chunks", f"SELECT doc_id, c.updated_at AS vec FROM documents d LEFT JOIN (SELECT hash, min(updated_at) AS updated_at FROM ({_CACHE}) GROUP BY hash) c ON sha256(d.text) = c.hash")
def embed_chunks(spark, sf):
    chunks = table(spark, sf, "documents").select("doc_id", tx.text_hash(F.col("text")).alias("hash"))
    cached = _cache(spark, sf).groupBy("hash").agg(F.min("updated_at").alias("embedding"))
    return index.embedded(chunks, cached, cached.where(F.lit(False))).select("doc_id", F.col("embedding").alias("vec"))


@query(
    "embed_deterministic",
    "WITH v AS (SELECT doc_id, list_concat([" + ", ".join(f"(length(lower(text)) - length(replace(lower(text), '{k}', ''))) / {len(k)} * 0.5" for k in embed.KEYWORDS) + "], "
    "list_transform(range(32, 128), lambda i: CASE WHEN length(text) > 0 THEN unicode(substring(lower(text), (i % length(lower(text)) + 1)::INT, 1)) / 1000.0 ELSE 0 END)) AS v FROM documents) "
    "SELECT doc_id, round(v[1] / n, 5) AS first, round(v[33] / n, 5) AS middle, round(v[128] / n, 5) AS last, round(list_sum(list_transform(v, lambda x, i: x * i)) / n, 3) AS places, 128 AS dims FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)",
)
def embed_deterministic(spark, sf):
    v = table(spark, sf, "documents").select("doc_id", embed.keyword_vector(F.col("text")).alias("v"))
    places = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)  # all of the vector in one number
    return v.select("doc_id", *[F.round(F.get("v", F.lit(i)), 5).alias(n) for i, n in ((0, "first"), (32, "middle"), (127, "last"))], F.round(places, 3).alias("places"), F.size("v").alias("dims"))


@query("batch_groups", "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS position, ((row_number() OVER (ORDER BY source, doc_id) - 1) // 300)::BIGINT AS batch FROM documents")
def batch_groups(spark, sf):
    return index.segment_groups(table(spark, sf, "documents").select("source", "doc_id"), ["source", "doc_id"], 300).select("doc_id", "position", "batch")


_LINES = """SELECT doc_id, CASE WHEN quality = 0 THEN '{"custom_id":"' || doc_id || '","error":{"message":"bad"}}' WHEN toxic = 1 THEN '{"key":"' || doc_id || '","response":{"status_code":200,"body":{"data":[]}}}'
    ELSE '{"custom_id":"' || doc_id || '","response":{"status_code":200,"body":{"data":[{"embedding":[1.5,' || doc_id || ']}]}}}' END AS line FROM labels"""


@query("batch_output_validate", "SELECT doc_id::VARCHAR AS id, CASE WHEN quality = 0 THEN 'bad' WHEN toxic = 1 THEN 'empty embedding' END AS problem, CASE WHEN quality = 1 AND toxic = 0 THEN 1.5::DOUBLE + doc_id END AS total FROM labels")
def batch_output_validate(spark, sf):
    ident = F.col("doc_id").cast("string")
    good = F.concat(F.lit('{"custom_id":"'), ident, F.lit('","response":{"status_code":200,"body":{"data":[{"embedding":[1.5,'), ident, F.lit("]}]}}}"))
    line = (
        F.when(F.col("quality") == 0, F.concat(F.lit('{"custom_id":"'), ident, F.lit('","error":{"message":"bad"}}')))
        .when(F.col("toxic") == 1, F.concat(F.lit('{"key":"'), ident, F.lit('","response":{"status_code":200,"body":{"data":[]}}}')))
        .otherwise(good)
    )
    found = embed.batch_results(table(spark, sf, "labels").select(line.alias("line")))
    total = F.when(F.col("problem").isNull(), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x))
    return found.select("id", "problem", total.alias("total"))


@query("batch_problems", "SELECT doc_id::VARCHAR AS id, 'bad' AS problem FROM labels WHERE quality = 0 UNION ALL SELECT doc_id::VARCHAR, 'empty embedding' FROM labels WHERE quality = 1 AND toxic = 1 UNION ALL SELECT doc_id::VARCHAR, 'missing' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def batch_problems(spark, sf):
    results = batch_output_validate(spark, sf)
    return embed.batch_problems(results, table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id")))


# --- front matter ------------------------------------------------------------

_NOTE = """SELECT conv_id, turn, CASE role WHEN 'user' THEN '---' || chr(10) || 'session:' || chr(10) || '  id: s' || conv_id || chr(10) || '  source: "' || role || '"' || chr(10) || 'created: 2024-01-0' || (turn % 9 + 1) || chr(10)
    || 'tags: [a' || turn || ', ''b'']' || chr(10) || 'other: ' || turn || chr(10) || '---' || chr(10) || text ELSE text END AS note, role, text FROM conversations"""


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    head = F.concat(F.lit("---\nsession:\n  id: s"), conv, F.lit('\n  source: "'), F.col("role"), F.lit('"\ncreated: 2024-01-0'), (F.col("turn") % 9 + 1).cast("string"), F.lit("\ntags: [a"), turn, F.lit(", 'b']\nother: "), turn, F.lit("\n---\n"), F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", head).otherwise(F.col("text")).alias("note"), "role", "text")


_HEAD = r"regexp_extract(note, '(?s)\A---\n(.*?)\n---\n', 1)"


def _yaml_sql(key: str, indent: str = "") -> str:
    return f"nullif(trim(regexp_extract({_HEAD}, '(?m)^{indent}{key}:[ ]*(.*)$', 1), '\"'), '')"


@query("frontmatter_parse", f"SELECT conv_id, turn, {_yaml_sql('id', '  ')} AS session_id, {_yaml_sql('source', '  ')} AS session_source, {_yaml_sql('created')} AS created, CASE WHEN role = 'user' THEN ['a' || turn, 'b'] END AS tags FROM ({_NOTE})")
def frontmatter_parse(spark, sf):
    n = _notes(spark, sf).select("conv_id", "turn", fm.parsed(F.col("note")).alias("m"))
    return n.select("conv_id", "turn", F.col("m.session.id").alias("session_id"), F.col("m.session.source").alias("session_source"), "m.created", "m.tags")


@query("frontmatter_fields", f"SELECT conv_id, turn, {_yaml_sql('other')} AS other, 'number' AS kind FROM ({_NOTE}) WHERE role = 'user'")
def frontmatter_fields(spark, sf):
    m = _notes(spark, sf).select("conv_id", "turn", fm.fields(F.col("note")).alias("m")).where(F.col("m").isNotNull())
    return m.select("conv_id", "turn", F.element_at("m", "other").alias("other"), fm.value_kind(F.element_at("m", "other")).alias("kind"))


@query("frontmatter_body", "SELECT conv_id, turn, sha256(text) AS hash FROM conversations")
def frontmatter_body(spark, sf):
    return _notes(spark, sf).select("conv_id", "turn", tx.text_hash(fm.body(F.col("note"))).alias("hash"))


@query("frontmatter_serialize", "SELECT conv_id, turn, '---' || chr(10) || 'session:' || chr(10) || '  id: ' || conv_id || chr(10) || '  project: ~/p' || chr(10) || 'created: c' || chr(10) || 'tags: [' || role || ', t' || turn || ']' || chr(10) || '---' || chr(10) AS head FROM conversations")
def frontmatter_serialize(spark, sf):
    session = F.struct(F.col("conv_id").cast("string").alias("id"), F.lit("").alias("source"), F.lit("/root/p").alias("project"), F.lit(None).cast("string").alias("transcript"))
    head = fm.serialised(session, F.lit("c"), F.lit(None).cast("string"), F.array("role", F.concat(F.lit("t"), F.col("turn").cast("string"))))
    return table(spark, sf, "conversations").select("conv_id", "turn", head.alias("head"))


@query(
    "frontmatter_merge",
    f"""SELECT conv_id, turn, '---' || chr(10) || 'session:' || chr(10) || CASE WHEN role = 'user' THEN '  id: s' || conv_id || chr(10) ELSE '' END || '  source: new' || chr(10)
    || 'created: ' || CASE WHEN role = 'user' THEN '2024-01-0' || (turn % 9 + 1) ELSE 'NOW' END || chr(10) || 'updated: NOW' || chr(10) || CASE WHEN role = 'user' THEN 'tags: [a' || turn || ', b]' || chr(10) ELSE '' END || '---' || chr(10) || text AS merged FROM ({_NOTE})""",
)
def frontmatter_merge(spark, sf):
    null = F.lit(None).cast("string")
    session = F.struct(null.alias("id"), F.lit("new").alias("source"), null.alias("project"), null.alias("transcript"))
    return _notes(spark, sf).select("conv_id", "turn", fm.merged(F.col("note"), session, F.lit(None).cast("array<string>"), F.lit("NOW")).alias("merged"))


@query("session_extract", f"SELECT {_yaml_sql('id', '  ')} AS session_id, count(*) AS n FROM ({_NOTE}) WHERE role = 'user' GROUP BY 1")
def session_extract(spark, sf):
    s = _notes(spark, sf).select(fm.parsed(F.col("note")).alias("m")).where(F.col("m.session.id").isNotNull())
    return s.groupBy(F.col("m.session.id").alias("session_id")).agg(F.count(F.lit(1)).alias("n"))


# --- sync --------------------------------------------------------------------

_SYNC = f"""{_HASHES}, j AS (SELECT coalesce(cur.path, old.path) AS file, cur.hash AS local_hash, old.hash AS remote_hash,
    CASE WHEN cur.hash = old.hash THEN 'unchanged' WHEN old.hash IS NULL THEN 'local-only' WHEN cur.hash IS NULL THEN 'remote-only' ELSE 'local-modified' END AS status FROM cur FULL JOIN old ON cur.path = old.path)"""


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    current, stored = _entries(spark, sf)
    side = lambda d: d.select(F.col("path").alias("file"), "hash")
    return sync.changes(side(current), side(stored))


@query("sync_status", f"WITH {_SYNC} SELECT file, status, local_hash, remote_hash FROM j")
def sync_status(spark, sf):
    return _changes(spark, sf)


@query("sync_summary", f"""WITH {_SYNC} SELECT count_if(status = 'unchanged')::BIGINT AS unchanged, count_if(status = 'local-only')::BIGINT AS local_only, count_if(status = 'remote-only')::BIGINT AS remote_only, count_if(status = 'local-modified')::BIGINT AS local_modified FROM j""")
def sync_summary(spark, sf):
    return sync.summary(_changes(spark, sf))


@query("push_plan", f"WITH {_SYNC} SELECT file, status, CASE WHEN status IN ('local-only', 'local-modified') THEN 'push' WHEN status = 'remote-only' THEN 'skip' ELSE 'none' END AS action FROM j")
def push_plan(spark, sf):
    return sync.push_plan(_changes(spark, sf))


@query("pull_plan", f"WITH {_SYNC} SELECT file, status, CASE WHEN status = 'remote-only' THEN 'pull' WHEN status = 'unchanged' THEN 'none' ELSE 'skip' END AS action FROM j")
def pull_plan(spark, sf):
    return sync.pull_plan(_changes(spark, sf))


@query("pull_plan_force", f"WITH {_SYNC} SELECT file, status, CASE WHEN status IN ('remote-only', 'local-modified') THEN 'pull' WHEN status = 'unchanged' THEN 'none' ELSE 'skip' END AS action FROM j")
def pull_plan_force(spark, sf):
    return sync.pull_plan(_changes(spark, sf), force=True)


@query("bidirectional_plan", f"WITH {_SYNC} SELECT file, status, CASE WHEN status = 'remote-only' THEN 'pull' WHEN status = 'unchanged' THEN 'none' ELSE 'push' END AS action FROM j")
def bidirectional_plan(spark, sf):
    return sync.bidirectional_plan(_changes(spark, sf))


@query("after_push", f"WITH {_HASHES} SELECT path AS file, hash FROM old WHERE path NOT IN (SELECT path FROM cur) UNION ALL SELECT path, hash FROM cur")
def after_push(spark, sf):
    current, stored = _entries(spark, sf)
    side = lambda d: d.select(F.col("path").alias("file"), "hash")
    return sync.after_push(side(current), side(stored))


@query("sync_state_build", f"WITH {_HASHES} SELECT coalesce(cur.path, old.path) AS file, coalesce(cur.hash, '') AS local_hash, coalesce(old.hash, '') AS remote_hash, coalesce(cur.mtime::VARCHAR, old.mtime::VARCHAR, 'NOW') AS last_modified FROM cur FULL JOIN old ON cur.path = old.path")
def sync_state_build(spark, sf):
    current, stored = _entries(spark, sf)
    side = lambda d: d.select(F.col("path").alias("file"), "hash", F.col("mtime").cast("string").alias("mtime"))
    return sync.built_state(side(current), side(stored), "NOW")


_REGISTRY = "SELECT 'c' || o_custkey || '/' AS path, '~/w/' || o_orderstatus AS local_path, o_orderpriority AS machine_id, o_orderdate AS last_sync, o_orderkey AS position FROM orders"
_NOW = "1998-08-02 00:00:00"


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("/")).alias("path"), F.concat(F.lit("~/w/"), F.col("o_orderstatus")).alias("local_path"), F.col("o_orderpriority").alias("machine_id"), F.col("o_orderdate").cast("timestamp").alias("last_sync"), F.col("o_orderkey").alias("position"))


def _now() -> F.Column:
    return F.lit(_NOW).cast("timestamp")


@query("registry_collisions", f"SELECT path, count(*) AS n_mappings, list_sort(list(DISTINCT machine_id)) AS machines FROM ({_REGISTRY}) GROUP BY path HAVING count(*) >= 2 AND count(DISTINCT machine_id) > 1")
def registry_collisions(spark, sf):
    return sync.collisions(_registry(spark, sf))


@query("registry_stale", f"SELECT path, machine_id, position, floor(date_diff('second', last_sync, TIMESTAMP '{_NOW}') / 86400.0)::BIGINT AS days FROM ({_REGISTRY}) WHERE last_sync < TIMESTAMP '{_NOW}' - INTERVAL 30 DAY")
def registry_stale(spark, sf):
    return sync.stale_mappings(_registry(spark, sf), _now()).select("path", "machine_id", "position", "days")


@query(
    "registry_check",
    f"""WITH f AS (SELECT path, arg_min(machine_id, position) AS m FROM ({_REGISTRY}) GROUP BY path)
    SELECT 'c' || c_custkey AS path, c_mktsegment AS machine_id, CASE WHEN m IS NULL THEN 'none' WHEN m = c_mktsegment THEN 'same-machine' ELSE 'collision' END AS result FROM customer LEFT JOIN f ON f.path = 'c' || c_custkey || '/'""",
)
def registry_check(spark, sf):
    asked = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_mktsegment").alias("machine_id"))
    return sync.collision_checks(_registry(spark, sf), asked)


@query(
    "registry_add",
    f"""WITH n AS (SELECT 'c' || c_custkey || '/' AS path, '1-URGENT' AS machine_id FROM customer) SELECT path, machine_id, local_path FROM ({_REGISTRY}) r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.path = r.path AND n.machine_id = r.machine_id)
    UNION ALL SELECT path, machine_id, '~/new' FROM n""",
)
def registry_add(spark, sf):
    new = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("//")).alias("path"), F.lit("~/new").alias("local_path"), F.lit("1-URGENT").alias("machine_id"), _now().alias("last_sync"), F.lit(0).cast("long").alias("position"))
    return sync.with_mapping(_registry(spark, sf), new).select("path", "machine_id", "local_path")


@query("registry_machine", f"SELECT path, position FROM ({_REGISTRY}) WHERE machine_id = '2-HIGH'")
def registry_machine(spark, sf):
    return sync.machine_mappings(_registry(spark, sf), "2-HIGH").select("path", "position")


@query(
    "validation_stats",
    f"""SELECT count(*) AS total, count_if(last_sync >= TIMESTAMP '{_NOW}' - INTERVAL 30 DAY)::BIGINT AS active, count_if(last_sync < TIMESTAMP '{_NOW}' - INTERVAL 30 DAY)::BIGINT AS stale,
    (SELECT count(*) FROM (SELECT path FROM ({_REGISTRY}) GROUP BY path HAVING count(DISTINCT machine_id) > 1)) AS collisions FROM ({_REGISTRY})""",
)
def validation_stats(spark, sf):
    return sync.validation_stats(_registry(spark, sf), _now())


@query(
    "validation_issues",
    f"""SELECT type, severity, count(*) AS n FROM (SELECT 'collision' AS type, 'error' AS severity FROM ({_REGISTRY}) GROUP BY path HAVING count(DISTINCT machine_id) > 1
    UNION ALL SELECT 'stale', 'warning' FROM ({_REGISTRY}) WHERE last_sync < TIMESTAMP '{_NOW}' - INTERVAL 30 DAY UNION ALL SELECT 'missing', 'warning' FROM ({_REGISTRY}) WHERE local_path = '~/w/P') GROUP BY ALL""",
)
def validation_issues(spark, sf):
    r = _registry(spark, sf)
    return sync.validation_issues(r, _now(), r.where("local_path = '~/w/P'")).groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"))


# --- logs, quarantine, change streams ----------------------------------------


@query("sync_log_tail", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def sync_log_tail(spark, sf):
    return sync.tail(table(spark, sf, "events").select("ts", "event_id", "event_type"), ["ts", "event_id"], 20).select("event_id", "event_type")


@query("sync_log_append", "SELECT event_id FROM (SELECT ts, event_id FROM events UNION ALL SELECT o_orderdate, -o_orderkey FROM orders) ORDER BY ts DESC, event_id DESC LIMIT 1000")
def sync_log_append(spark, sf):
    log = table(spark, sf, "events").select("ts", "event_id")
    new = table(spark, sf, "orders").select(F.col("o_orderdate").alias("ts"), (-F.col("o_orderkey")).alias("event_id"))
    return sync.log_appended(log, new, ["ts", "event_id"]).select("event_id")


_FOLDER = "strftime(ts, '%Y-%m-%dT%H-%M-00-000Z')"
_COPIES = f"SELECT {_FOLDER} AS timestamp, 'memory_' || event_type || '_' || user_id || '.md.' || CASE WHEN value > 50 THEN 'local' ELSE 'remote' END AS file_name, value FROM events"


def _copies(spark: SparkSession, sf: str) -> DataFrame:
    when = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:00.000'Z'")
    file = F.concat(F.lit("memory/"), F.col("event_type"), F.lit("/"), F.col("user_id").cast("string"), F.lit(".md"))
    side = F.when(F.col("value") > 50, "local").otherwise("remote")
    return table(spark, sf, "events").select(paths.quarantine_folder(when).alias("timestamp"), paths.quarantine_name(file, side).alias("file_name"), F.col("value").alias("content"))


@query("quarantine_list", f"SELECT timestamp, list_sort(list(DISTINCT replace(regexp_replace(file_name, '[.](local|remote|base)$', ''), '_', '/'))) AS files FROM ({_COPIES}) GROUP BY timestamp")
def quarantine_list(spark, sf):
    return sync.quarantined(_copies(spark, sf))


@query("quarantine_cleanup", f"SELECT DISTINCT timestamp FROM ({_COPIES}) WHERE strptime(timestamp, '%Y-%m-%dT%H-%M-%S-000Z') < (SELECT max(date_trunc('day', ts)) FROM events) - INTERVAL 7 DAY")
def quarantine_cleanup(spark, sf):
    last = table(spark, sf, "events").agg(F.max(F.date_trunc("day", F.col("ts").cast("timestamp")))).first()[0]
    return sync.expired(_copies(spark, sf), F.lit(last), 7)


@query("quarantine_merge", f"""SELECT timestamp, replace(regexp_replace(file_name, '[.](local|remote|base)$', ''), '_', '/') AS file, max(value) FILTER (suffix(file_name, '.local')) AS local, max(value) FILTER (suffix(file_name, '.remote')) AS remote FROM ({_COPIES}) GROUP BY ALL""")
def quarantine_merge(spark, sf):
    return sync.merge_files(_copies(spark, sf)).drop("base")


_GAP = 6 * 3600
_BURSTS = f"""SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS burst FROM (SELECT *, 'f' || json_extract_string(props, '$.k') AS file,
    CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= {_GAP}::BIGINT * 1000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _file_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("directory"), F.concat(F.lit("f"), F.get_json_object("props", "$.k")).alias("file"), F.col("event_type").alias("event"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


@query("debounce_events", f"SELECT user_id AS directory, count(*) AS n, min(event_id) AS first_id, epoch_us(min(ts)) AS started FROM ({_BURSTS}) GROUP BY user_id, burst")
def debounce_events(spark, sf):
    e = ch.bursts(_file_events(spark, sf), _GAP, "directory", "ts", "event_id")
    return e.groupBy("directory", "burst").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.unix_micros(F.min("ts")).alias("started")).drop("burst")


@query("debounce_windows", f"SELECT user_id AS directory, count(*) AS n, epoch_us(min(ts)) AS started, epoch_us(max(ts)) + {_GAP}::BIGINT * 1000000 AS ended FROM ({_BURSTS}) GROUP BY user_id, burst")
def debounce_windows(spark, sf):
    d = ch.debounced(_file_events(spark, sf), _GAP)
    return d.select("directory", "n", F.unix_micros("start").alias("started"), F.unix_micros("end").alias("ended"))


@query("stream_last_event", f"SELECT user_id AS directory, burst, file, arg_max(event_type, (ts, event_id)) AS event FROM ({_BURSTS}) GROUP BY user_id, burst, file")
def stream_last_event(spark, sf):
    return ch.last_events(_file_events(spark, sf), _GAP)


@query("stream_live_debounce", ORACLE_SQL["stream_last_event"])
def stream_live_debounce(spark, sf):
    """The rows of `stream_last_event` from a running query with state by user; an event of each user far ahead closes the last bursts."""
    events = _file_events(spark, sf)
    path = passing_path(spark, "changes")
    ahead = events.agg(F.unix_micros(F.max("ts")).alias("t")).first()["t"] or 0
    last = events.select("directory").distinct().select("directory", F.lit("").alias("file"), F.lit("end").alias("event"), F.timestamp_micros(F.lit(ahead + 2_000_000 * _GAP)).alias("ts"), F.lit(0).cast("long").alias("event_id"))
    events.write.parquet(f"{path}/part=1")
    last.write.parquet(f"{path}/part=2")
    kind = events.schema["directory"].dataType.simpleString()
    out = f"{path}-closed"
    # the events of a directory must not be late for one another: first all of them, then what closes them
    for part in (1, 2):
        stream = spark.readStream.schema(f"directory {kind}, file string, event string, ts timestamp, event_id long").parquet(f"{path}/part=[1-{part}]")
        live.started(live.debounced(stream, _GAP, event_time=True), lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"), f"{path}-state", partitions=spark.sparkContext.defaultParallelism).awaitTermination()
    return spark.read.schema(f"directory {kind}, burst long, file string, event string").parquet(out).where("event <> 'end'").select("directory", "burst", "file", "event")


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream: the file source lists what the pattern matches."""
    return spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")


@query(
    "stream_incremental_index",
    """WITH f AS (SELECT 'f' || json_extract_string(props, '$.k') AS path, arg_max((event_type, user_id), (ts, event_id)) AS l FROM events GROUP BY 1)
    SELECT path, l[2]::VARCHAR AS text FROM f WHERE l[1] <> 'click'""",
)
def stream_incremental_index(spark, sf):
    """A streaming run over the change events; a click takes the file out of the index, other events put it in."""
    e = _event_stream(spark, sf)
    file = F.concat(F.lit("f"), F.get_json_object("props", "$.k"))
    event = F.when(F.col("event_type") == "click", "unlink").otherwise(F.col("event_type"))
    changes_ = e.select(file.alias("file"), event.alias("event"), F.col("user_id").cast("string").alias("text"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    follow = ch.FollowingIndex(passing_path(spark, "following"))
    ch.follow(changes_, follow, passing_path(spark, "stream")).awaitTermination()
    return follow.table(spark)


@query("stream_windowed_counts", "SELECT epoch_us(date_trunc('day', ts)) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windowed_counts(spark, sf):
    """Counts by day and type, kept by a streaming aggregation and written whole after each micro-batch."""
    e = _event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    days = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    rows = days.select(F.unix_micros("w.start").alias("started"), "event_type", "n", "total")
    path = passing_path(spark, "windowed")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    rows.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", passing_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


@query(
    "config_merge",
    """SELECT n_nationkey, coalesce(CASE WHEN length(n_name) > 6 THEN n_name END, r_name) AS value, CASE WHEN length(n_name) > 6 THEN n_name ELSE 'auto' END AS provider, r_regionkey::VARCHAR AS tokens, '32' AS overlap
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def config_merge(spark, sf):
    """Layers of settings as JSON, one pair a row, over the defaults."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = F.when(F.length("n_name") > 6, F.col("n_name"))  # a setting that is null leaves what is below it
    below = F.to_json(F.struct(F.col("r_name").alias("value"), F.struct(F.col("r_regionkey").alias("tokens")).alias("chunking")))
    above = F.to_json(F.struct(own.alias("value"), F.struct(own.alias("provider")).alias("embedding")), {"ignoreNullFields": "false"})
    out = n.select("n_nationkey", merged_json(below, above).alias("c"))
    at = {"value": "$.value", "provider": "$.embedding.provider", "tokens": "$.chunking.tokens", "overlap": "$.chunking.overlap"}
    return out.select("n_nationkey", *[F.get_json_object("c", path).alias(name) for name, path in at.items()])

