"""Queries of chunking, vectors and context packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import scalars
from corpuslens.operators import chunking, context, vectors
from corpuslens.sources import files as sources
from corpuslens.sources.durable import durable, shared_path

from .inputs import CHUNKS_SQL, LINES_SQL, MESSAGES_SQL, RANKED_SQL, RETRIEVED_SQL, files, files_sql, messages, ranked, retrieval, retrieved, table
from .registry import query

LINES = f"WITH {files_sql()}, l AS (SELECT *, list_transform({LINES_SQL}, lambda z: z.t) AS ls FROM files WHERE regexp_matches(content, '[^\\s\\x1c-\\x1f\\x{{85}}]'))"


@query(
    f"""{LINES} SELECT file_id, CAST(p + 1 AS INT) AS start_line, CAST(least(p + 50, len(ls)) AS INT) AS end_line, '# File: ' || path || chr(10) || chr(10) || array_to_string(ls[p + 1:p + 50], chr(10)) AS content
FROM (SELECT *, unnest(range(0, len(ls), 40)) AS p FROM l)"""
)
def e8_j1_line_windows(spark, sf_dir):
    return chunking.chunk_files(files(spark, sf_dir)).select("file_id", "start_line", "end_line", "content")


@query(
    f"""{LINES}, s AS (SELECT *, 1 + file_id % 3 AS a0, CASE WHEN file_id % 2 = 0 THEN 999999 ELSE 3 END AS b0 FROM l),
r AS (SELECT *, ls[a0:least(b0, len(ls))] AS sl, '# File: ' || path || chr(10) || '# Symbol: sym' || chr(10) || chr(10) AS h FROM s),
w AS (SELECT *, length(h) + length(array_to_string(sl, chr(10))) <= 8000 AS whole FROM r),
p AS (SELECT file_id, a0, h, sl, unnest(CASE WHEN whole THEN [{{'a': CAST(0 AS BIGINT), 'b': CAST(len(sl) AS BIGINT)}}] ELSE list_transform(range(0, len(sl), 100), lambda x: {{'a': x, 'b': least(x + 100, len(sl))}}) END) AS s, least(b0, len(ls)) AS e0, whole FROM w)
SELECT file_id, CAST(a0 + s.a AS INT) AS start_line, CAST(CASE WHEN whole THEN e0 ELSE a0 + s.b - 1 END AS INT) AS end_line, h || array_to_string(sl[s.a + 1:s.b], chr(10)) AS content FROM p"""
)
def c7_e9_j1_symbol_chunks(spark, sf_dir):
    """One symbol a file, of up to all its lines; texts hold no definitions, so large ones are cut every 100 lines."""
    f = files(spark, sf_dir)
    symbols = f.select("file_id", F.lit("s1").alias("symbol_id"), F.lit("sym").alias("name"), (1 + F.col("file_id") % 3).cast("int").alias("start_line"), F.when(F.col("file_id") % 2 == 0, 999_999).otherwise(3).alias("end_line"))
    return chunking.chunk_files(f, symbols).select("file_id", "start_line", "end_line", "content")


@query("SELECT doc_id, l.quality, l.toxic, CASE WHEN l.doc_id IS NOT NULL THEN lang END AS symbol_name FROM documents d LEFT JOIN labels l USING (doc_id)")
def c1_c2_with_symbol_name(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").withColumn("_l", F.lit(True))
    return d.join(labels, "doc_id", "left").select("doc_id", "quality", "toxic", F.when(F.col("_l"), F.col("lang")).alias("symbol_name"))


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' AND quality = 1")
def b26_c1_chunks_with_files(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("lang = 'en'").join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id").select("doc_id", "lang", "quality")


SIM = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))"
NEAR = f"""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(greatest(0.0, 1 - (1 - {SIM})), 4) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0)
SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10"""


def _search(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.lit("all").alias("repository_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    return v, v.filter("chunk_id % 50 = 0").select("repository_id", F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))


@query(NEAR)
def j4_search(spark, sf_dir):
    """Every 50th vector as a query against all: B19, B20, C11 and E3."""
    v, q = _search(spark, sf_dir)
    return vectors.nearest(q, v)


@query(f"SELECT q.vec_id AS a, c.vec_id AS b, round({SIM}, 6) AS similarity FROM embeddings q JOIN embeddings c ON c.vec_id = q.vec_id + 1")
def b19_cosine_similarity(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"), "embedding")
    n = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("e"))
    return v.join(n, "a").select("a", "b", F.round(scalars.cosine_similarity(F.col("embedding"), F.col("e")), 6).alias("similarity"))


@query()
def j5_ivf_recall(spark, sf_dir):
    """Recall of the approximate index against exact search."""
    v, q = _search(spark, sf_dir)
    indexed, centres = vectors.ivf_index(v, lists=32, rounds=5)
    return vectors.recall(vectors.nearest(q, v), vectors.ivf_search(q, indexed, centres, probes=22))


@query()
def j5_ivf_search(spark, sf_dir):
    v, q = _search(spark, sf_dir)
    indexed, centres = vectors.ivf_index(v, lists=32, rounds=5)
    return vectors.ivf_search(q, indexed, centres, probes=22)


@query(
    """SELECT count(*) AS queries, CAST(sum(least(n, 10)) AS BIGINT) AS pairs, true AS found_nine_of_ten, true AS read_a_fourth_at_most
FROM (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0), (SELECT count(*) AS n FROM embeddings)"""
)
def j5_pq_search(spark, sf_dir):
    """Search by product quantisation against exact search: of the exact pairs at least 0.9 are found, and vectors are read for a fourth of the pairs at most."""
    v, q = _search(spark, sf_dir)
    books = vectors.pq_books(v)
    indexed = durable(vectors.pq_index(v, books), "codes")
    near = durable(vectors.pq_candidates(q, indexed, books, vectors.pq_keep(q, v, indexed, books)), "candidates")
    exact, found, read = vectors.nearest(q, v), vectors.pq_rank(near, q, v), near.agg(F.count("*").alias("n_read"))
    pairs = q.join(v.groupBy("repository_id").agg(F.count("*").alias("n")), "repository_id").agg(F.count("*").alias("queries"), F.sum("n").alias("n_all"))
    out = vectors.recall(exact, found).crossJoin(read).crossJoin(pairs)  # one row each
    return out.select("queries", "pairs", (F.col("recall") >= 0.9).alias("found_nine_of_ten"), (F.col("n_read") <= 0.25 * F.col("n_all")).alias("read_a_fourth_at_most"))


@query()
def j2_j3_index(spark, sf_dir):
    """Chunks of all files with vectors of the offline provider."""
    return vectors.embed(chunking.chunk_files(files(spark, sf_dir))).select("file_id", "start_line", "embedding", "embed_failed")


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, {', '.join(f'v[{i + 1}] AS v{i}' for i in range(26))}, false AS embed_failed FROM chunks")
def j2_embed(spark, sf_dir):
    """Counts of letters as vectors of all chunks."""
    chunks = retrieval(spark, sf_dir)[1]
    return chunks.select("chunk_id", *(F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(26)), "embed_failed")


@query(f"WITH {RETRIEVED_SQL} SELECT question_id, rank, score, path, start_line, end_line, symbol_name FROM ranked")
def j6_retrieve_context(spark, sf_dir):
    return retrieved(spark, sf_dir).drop("content")


@query(f"WITH {files_sql()} SELECT repository_id, CAST(sum(len(range(0, n, 40))) AS BIGINT) AS chunks FROM (SELECT repository_id, len({LINES_SQL}) AS n FROM files) GROUP BY 1")
def d14_chunks_indexed(spark, sf_dir):
    return chunking.chunk_files(files(spark, sf_dir)).groupBy("repository_id").agg(F.count("*").alias("chunks"))


@query(f"WITH {files_sql()} SELECT repository_id, CAST(sum(len(range(0, n, 40))) AS BIGINT) AS chunks FROM (SELECT repository_id, len({LINES_SQL}) AS n FROM files) GROUP BY 1")
def a7_a8_replace_chunks(spark, sf_dir):
    """Chunks written twice by repository: the second time replaces the first."""
    path, chunks = shared_path(spark, "chunks"), chunking.chunk_files(files(spark, sf_dir))
    for _ in range(2):
        sources.replace_partitions(chunks, path)
    return spark.read.parquet(path).groupBy(F.col("repository_id").cast("string").alias("repository_id")).agg(F.count("*").alias("chunks"))


@query(f"WITH {files_sql()} SELECT repository_id, CAST(sum(len(range(0, n, 40))) AS BIGINT) AS chunks FROM (SELECT repository_id, len({LINES_SQL}) AS n FROM files) GROUP BY 1")
def j3_index_repositories(spark, sf_dir):
    """Chunks of all repositories, embedded and written by repository in one job."""
    return vectors.index_repositories(files(spark, sf_dir), shared_path(spark, "index"), provider=vectors.letter_counts, size=26)


PAST = f"""WITH {MESSAGES_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, message_id DESC) AS k FROM messages),
h AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, message_id DESC) AS r FROM m WHERE k > 1 AND role IN ('user', 'assistant'))"""


@query(f"{PAST} SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY r DESC) AS INT) AS position, role, content FROM h WHERE r <= 6")
def e5_recent_history(spark, sf_dir):
    return context.recent_history(messages(spark, sf_dir)).select("session_id", "position", "role", "content")


@query(f"WITH {RANKED_SQL} SELECT question_id, rank, path FROM (SELECT *, row_number() OVER (PARTITION BY question_id, path, start_line, end_line ORDER BY rank) AS k FROM ranked) WHERE k = 1")
def e7_cite_sources(spark, sf_dir):
    return context.cite_sources(ranked(spark, sf_dir)).select("question_id", "rank", "path")


BLOCK = r"""'---' || chr(10) || '[Context Item #' || rank || ']' || chr(10) || 'File: ' || path || ' (Lines ' || start_line || '-' || end_line || ')' || chr(10) || coalesce('Symbol: ' || nullif(symbol_name, '') || chr(10), '') || 'Content:' || chr(10) || '```' || chr(10) || regexp_replace(content, '^\s+|\s+$', '', 'g') || chr(10) || '```' || chr(10)"""


@query(f"WITH {RETRIEVED_SQL} SELECT question_id, rank, {BLOCK} AS block FROM ranked")
def b17_e12_context_blocks(spark, sf_dir):
    return context.context_blocks(retrieved(spark, sf_dir)).select("question_id", "rank", "block")


RULE = "repeat('=', 26)"
PROMPTS = f"""{PAST.replace("WITH ", f"WITH {RETRIEVED_SQL}, ", 1)}, q AS (SELECT session_id, arg_max(content, message_id) AS question FROM messages GROUP BY 1),
f AS (SELECT q.session_id, question, {len(context.SYSTEM) // 4} + coalesce((SELECT sum(length(content) // 4) FROM h WHERE h.session_id = q.session_id AND r <= 6), 0) AS fixed_tokens FROM q),
b AS (SELECT question_id, rank, {BLOCK} AS block FROM ranked),
c AS (SELECT b.*, f.fixed_tokens + (length('Retrieved Codebase Context:' || chr(10) || {RULE} || chr(10) || chr(10) || chr(10) || {RULE} || chr(10) || 'User Question: ' || question || chr(10) || chr(10) || 'Answer:')
  + sum(length(block)) OVER w + count(*) OVER w - 1) // 4 AS total FROM b JOIN f ON f.session_id = b.question_id WINDOW w AS (PARTITION BY question_id ORDER BY rank ROWS UNBOUNDED PRECEDING)),
k AS (SELECT * FROM c WHERE total <= 2800 OR rank = 1),
t AS (SELECT f.session_id, question, fixed_tokens, (SELECT count(*) FROM k WHERE question_id = f.session_id) AS n_blocks, (SELECT string_agg(block, chr(10) ORDER BY rank) FROM k WHERE question_id = f.session_id) AS ctx FROM f)
SELECT session_id, n_blocks, CAST(fixed_tokens + length(prompt) // 4 AS BIGINT) AS total_tokens, prompt FROM (SELECT *, 'Retrieved Codebase Context:' || chr(10) || {RULE} || chr(10) || coalesce(ctx, 'No relevant codebase context found.') || chr(10) || chr(10) || {RULE} || chr(10) || 'User Question: ' || question || chr(10) || chr(10) || 'Answer:' AS prompt FROM t)"""


@query(PROMPTS)
def b18_e6_j6_j7_prompts(spark, sf_dir):
    """A prompt for each conversation, within 70 % of a window of 4000 tokens; every 50th has context."""
    return context.assemble_prompts(messages(spark, sf_dir), retrieved(spark, sf_dir), max_context=4000).select("session_id", "n_blocks", "total_tokens", "prompt")


@query("SELECT conv_id AS session_id, replace(split_part(arg_max(text, turn), chr(10), 1), chr(0), '') AS answer FROM conversations GROUP BY conv_id")
def j8_m3_complete(spark, sf_dir):
    """The offline provider answers with the question's first line."""
    m = context.newest_question(messages(spark, sf_dir)).select("session_id", scalars.prompt(F.col("question"), F.lit(None).cast("string")).alias("prompt"))
    return context.complete(m).select("session_id", "answer")


@query(f"WITH {MESSAGES_SQL} SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY created_at, message_id) AS INT) AS position, role, content, 0 AS n_sources FROM messages")
def a13_j9_messages(spark, sf_dir):
    return context.list_messages(messages(spark, sf_dir)).select("session_id", "position", "role", "content", F.size("sources").alias("n_sources"))


@query("SELECT conv_id AS session_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS answer FROM conversations GROUP BY 1")
def l7_join_fragments(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("i"), F.col("text").alias("content"))
    return context.join_fragments(c)
