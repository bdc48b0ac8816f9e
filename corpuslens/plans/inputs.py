"""The driver's tables as inputs of operators, as DataFrames and as SQL of the same meaning."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators import chunking, context, vectors
from corpuslens.sources.durable import durable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ending(values: list[str]):
    """One of values by doc_id."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("doc_id") % len(values) + 1).cast("int"))


def ending_sql(values: list[str]) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST(doc_id % {len(values)} AS INT) + 1]"


EXT = [".py", ".ts", "/index.js", "/__init__.py"]


def files(spark: SparkSession, sf_dir: str, endings: list[str] = EXT) -> DataFrame:
    """documents as files: the source is the repository."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("file_id"), F.col("source").alias("repository_id"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), ending(endings)).alias("path"), F.col("text").alias("content"), "doc_id", "lang")


def files_sql(endings: list[str] = EXT) -> str:
    return f"files AS (SELECT doc_id AS file_id, source AS repository_id, lang || '/' || doc_id || {ending_sql(endings)} AS path, text AS content, doc_id, lang FROM documents)"


LANGUAGE_SQL = "CASE doc_id % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'TypeScript' WHEN 2 THEN 'JavaScript' ELSE 'Python' END"
LINES_SQL = r"""list_filter(list_transform(list_zip(regexp_split_to_array(content, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'), range(1, 1 + len(regexp_split_to_array(content, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')))),
  lambda z: {'i': z[2], 't': z[1]}), lambda z: NOT (z.t = '' AND z.i = len(regexp_split_to_array(content, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'))))"""


def part_graph(spark: SparkSession, sf_dir: str, most_lines: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """Parts of consecutive lines of an order as a graph; the customer's nation is the repository. Pairs and nodes are written once, as every query reads them several times.

    Many lines are dealt out by their number, as keys pack so well that a partition of few bytes would be sorted in more than a task's memory.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = -(-line.count() // most_lines)  # of about so many lines
    dealt = lambda df, key: df.repartition(parts, key) if parts > spark.sparkContext.defaultParallelism else df
    line = dealt(line, "l_orderkey")
    a, b = line.alias("a"), line.alias("b")
    home = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").cast("string").alias("repository_id"))
    home = dealt(home, "o_orderkey").hint("shuffle_hash")  # a row for each order
    gap = F.col("b.l_linenumber") - F.col("a.l_linenumber")  # the order alone is the key of all joins, so lines are shuffled once
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & gap.between(1, 1)).join(home, F.col("a.l_orderkey") == F.col("o_orderkey"))
    pairs = durable(pairs.select("repository_id", "a.l_orderkey", "a.l_linenumber", F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst")), "part-edges")
    edges = pairs.select("repository_id", "src", "dst", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("import_name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    nodes = durable(edges.select("repository_id", F.explode(F.array("src", "dst")).alias("node")).distinct(), "part-nodes")
    return nodes, edges


def part_graph_sql() -> str:
    return """edges AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS repository_id, a.l_partkey AS src, b.l_partkey AS dst, a.l_orderkey || '-' || a.l_linenumber AS import_name, a.l_orderkey * 10 + a.l_linenumber AS ordinal
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  JOIN orders ON o_orderkey = a.l_orderkey JOIN customer ON c_custkey = o_custkey),
nodes AS (SELECT repository_id, src AS node FROM edges UNION SELECT repository_id, dst FROM edges),
d AS (SELECT DISTINCT repository_id, src, dst FROM edges)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as progress of keys: errors and purchases end a key."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    status = F.when(kind == "error", "error").when(kind == "purchase", "ready").otherwise("running")
    return e.select(F.col("user_id").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), (F.col("event_id") % 100).cast("int").alias("progress"), kind.alias("phase"), "value", "props")


EVENTS_SQL = "ev AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'ready' ELSE 'running' END AS status, CAST(event_id % 100 AS INT) AS progress, event_type AS phase, value FROM events)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), F.col("turn").alias("message_id"), "role", F.col("text").alias("content"))


MESSAGES_SQL = "messages AS (SELECT conv_id AS session_id, turn AS created_at, turn AS message_id, role, text AS content FROM conversations)"


def retrieval(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, chunks, symbols): what every 50th conversation asks last, chunks of all documents with counts of letters as vectors, and a symbol for the first chunk of each document."""
    asked = context.newest_question(messages(spark, sf_dir).filter("session_id % 50 = 0"))
    questions = asked.select(F.lit("all").alias("repository_id"), F.col("session_id").alias("question_id"), "question")
    cut = chunking.chunk_files(files(spark, sf_dir)).withColumns({
        "repository_id": F.lit("all"),
        "chunk_id": F.concat_ws(":", F.col("file_id").cast("string"), F.col("start_line").cast("string")),
        "symbol_id": F.when(F.col("start_line") == 1, F.col("file_id")),
    })
    symbols = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("symbol_id"), F.col("lang").alias("name"))
    return questions, vectors.embed(cut, provider=vectors.letter_counts, size=26), symbols


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, chunks, symbols = retrieval(spark, sf_dir)
    return context.retrieve_context(questions, chunks, symbols, provider=vectors.letter_counts)


LETTERS_SQL = "[" + ", ".join(f"CAST(length({{0}}) - length(replace(replace({{0}}, '{c}', ''), '{c.upper()}', '')) AS DOUBLE)" for c in string.ascii_lowercase) + "]"
CHUNKS_SQL = f"""{files_sql()}, fl AS (SELECT *, list_transform({LINES_SQL}, lambda z: z.t) AS ls FROM files WHERE regexp_matches(content, '[^\\s\\x1c-\\x1f\\x{{85}}]')),
chunks AS MATERIALIZED (SELECT *, {LETTERS_SQL.format("content")} AS v FROM (SELECT file_id, file_id || ':' || (p + 1) AS chunk_id, path, lang, CAST(p + 1 AS INT) AS start_line, CAST(least(p + 50, len(ls)) AS INT) AS end_line,
  '# File: ' || path || chr(10) || chr(10) || array_to_string(ls[p + 1:p + 50], chr(10)) AS content FROM (SELECT *, unnest(range(0, len(ls), 40)) AS p FROM fl)))"""
RETRIEVED_SQL = f"""{CHUNKS_SQL}, asked AS MATERIALIZED (SELECT question_id, {LETTERS_SQL.format("question")} AS u FROM (SELECT conv_id AS question_id, coalesce(arg_max(text, turn), '') AS question FROM conversations WHERE conv_id % 50 = 0 GROUP BY 1)),
scored AS (SELECT question_id, chunk_id, round(CASE WHEN list_dot_product(u, u) > 0 AND list_dot_product(v, v) > 0 THEN greatest(0.0, 1 - (1 - list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))))) ELSE 0 END, 4) AS score FROM asked, chunks),
ranked AS MATERIALIZED (SELECT question_id, CAST(rank AS INT) AS rank, score, path, start_line, end_line, content, CASE WHEN start_line = 1 THEN lang END AS symbol_name
  FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM scored) JOIN chunks USING (chunk_id) WHERE rank <= 8)"""


def ranked(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    """k passages for each conversation, some of them twice, for citations: documents by their distance from the conversation's number, which every document can be."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    s = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    n = d.count()
    near = s.withColumn("doc_id", (F.col("conv_id") * 7 + F.floor((F.col("rank") * 2) / 3)) % n)
    return near.join(d, "doc_id").select(F.col("conv_id").alias("question_id"), F.col("rank").cast("int").alias("rank"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.col("text").alias("content"))


RANKED_SQL = """ranked AS (SELECT conv_id AS question_id, CAST(rank AS INT) AS rank, lang || '/' || doc_id AS path, 1 AS start_line, 9 AS end_line, text AS content
  FROM (SELECT conv_id, rank, (conv_id * 7 + rank * 2 // 3) % (SELECT count(*) FROM documents) AS doc_id FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest(range(1, 9)) AS rank)) JOIN documents USING (doc_id))"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("repository_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("state"))


def imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Four imports of each document, and all files, in one repository."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    n = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("_next"))
    own = files(spark, sf_dir).select(F.lit("all").alias("repository_id"), "path", "file_id", "doc_id")
    lang = F.when(F.col("doc_id") % 4 == 1, "TypeScript").when(F.col("doc_id") % 4 == 2, "JavaScript").otherwise("Python")
    to = F.concat(F.coalesce("_next", F.lit("xx")), F.lit("/"), (F.col("doc_id") + 1).cast("string"))
    four = F.array(*(F.struct(F.lit(i).alias("i"), p.alias("p")) for i, p in enumerate((to, F.concat(F.lit("../"), to), F.lit("os"), F.lit("axios")))))
    rows = own.join(n, "doc_id", "left").select("repository_id", F.col("path").alias("from_path"), lang.alias("from_language"), "doc_id", F.explode(four).alias("x"))
    out = rows.select((F.col("doc_id") * 4 + F.col("x.i")).alias("import_id"), "repository_id", "from_path", "from_language", F.col("x.p").alias("import_name"), F.col("x.p").alias("import_path"), F.lit(False).alias("is_relative"))
    return out, own.drop("doc_id")
