"""Queries of file inventory, scalar functions, frameworks, parsing and imports."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions import scalars
from corpuslens.operators import frameworks, inventory, parse, resolve
from corpuslens.sources import files as sources

from .inputs import LANGUAGE_SQL, LINES_SQL, ending_sql, files, files_sql, imports, table
from .registry import query

quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


@query()
def a1_scan_tree(spark, sf_dir):
    """The input folder as a file tree, without contents."""
    return sources.scan_tree(spark, sf_dir, "inputs").select("repository_id", "path", "size_bytes")


@query(
    """SELECT archive, code, CASE code WHEN 'TOO_MANY_FILES' THEN CAST(n AS VARCHAR) WHEN 'PAYLOAD_TOO_LARGE' THEN CAST(b AS VARCHAR) WHEN 'INVALID_FILE_TYPE' THEN archive ELSE detail END AS detail FROM (
  SELECT archive, count(*) AS n, max(archive_bytes) AS b, min(CASE WHEN path LIKE '%../%' THEN path END) AS detail FROM (
    SELECT source || CASE WHEN source LIKE '%7' THEN '.tar' ELSE '.zip' END AS archive, CASE WHEN doc_id % 97 = 0 THEN 'a/../../' || doc_id ELSE 'src/' || doc_id END AS path, sum(n_chars) OVER (PARTITION BY source) AS archive_bytes FROM documents) GROUP BY archive),
  (SELECT unnest(['PATH_TRAVERSAL_DETECTED', 'TOO_MANY_FILES', 'PAYLOAD_TOO_LARGE', 'INVALID_FILE_TYPE']) AS code)
WHERE (code = 'PATH_TRAVERSAL_DETECTED' AND detail IS NOT NULL) OR (code = 'TOO_MANY_FILES' AND n > 45) OR (code = 'PAYLOAD_TOO_LARGE' AND b > 120000) OR (code = 'INVALID_FILE_TYPE' AND archive NOT LIKE '%.zip')"""
)
def a3_archive_violations(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    size = d.groupBy("source").agg(F.sum("n_chars").alias("archive_bytes"))
    members = d.join(size, "source").select(
        F.concat("source", F.when(F.col("source").endswith("7"), ".tar").otherwise(".zip")).alias("archive"), F.concat(F.when(F.col("doc_id") % 97 == 0, "a/../../").otherwise("src/"), F.col("doc_id").cast("string")).alias("path"), "archive_bytes"
    )
    return sources.archive_violations(members, most_files=45, most_bytes=120_000)


@query("SELECT doc_id, replace(text, 'e', chr(65533)) AS text FROM documents")
def a4_decode_text(spark, sf_dir):
    """Texts with a malformed byte in place of each e."""
    content = F.unhex(F.regexp_replace(F.hex(F.encode("text", "utf-8")), "(?<=^|\\G)((?:(?!65)[0-9A-F]{2})*)65", "$1FF"))
    return table(spark, sf_dir, "documents").select("doc_id", scalars.decode_text(content).alias("text"))


@query(
    f"""WITH {files_sql()}, g AS (SELECT repository_id, sum(strlen(content)) AS size_bytes, count(*) AS file_count FROM files GROUP BY 1)
SELECT repository_id, CAST(size_bytes AS BIGINT) AS size_bytes, file_count, repository_id || '-' || substr(sha256(repository_id), 1, 8) AS slug, 'upload' AS source, 'pending' AS status FROM g"""
)
def a5_register_repositories(spark, sf_dir):
    return inventory.register_repositories(inventory.file_facts(files(spark, sf_dir)))


@query(
    """SELECT coalesce(a.repository_id, b.repository_id) AS repository_id, coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN a.size_bytes ELSE b.size_bytes END AS size_bytes,
  CASE WHEN a.path IS NULL THEN 'insert' WHEN b.path IS NULL THEN 'keep' ELSE 'update' END AS action
FROM (SELECT source AS repository_id, CAST(doc_id AS VARCHAR) AS path, n_chars AS size_bytes FROM documents WHERE doc_id % 3 <> 0) a
FULL JOIN (SELECT source AS repository_id, CAST(doc_id AS VARCHAR) AS path, n_chars + 1 AS size_bytes FROM documents WHERE doc_id % 3 <> 1) b ON a.repository_id = b.repository_id AND a.path = b.path"""
)
def a6_c12_upsert_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("repository_id"), F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size_bytes"), "doc_id")
    return inventory.upsert_files(d.filter("doc_id % 3 <> 0").drop("doc_id"), d.filter("doc_id % 3 <> 1").withColumn("size_bytes", F.col("size_bytes") + 1).drop("doc_id"))


@query("SELECT 'a' || (doc_id // 64) || '.zip' AS archive, lang || '/' || doc_id || '.txt' AS path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size_bytes, sha256(coalesce(text, '')) AS content_hash, CAST(NULL AS VARCHAR) AS error FROM documents")
def a2_expand_archives(spark, sf_dir):
    """Archives of 64 documents each, made in tasks, and their members read back."""

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for lang, key, text in zip(rows["lang"], rows["doc_id"], rows["text"], strict=True):
                z.writestr(f"{lang}/{key}.txt", (text or "").encode("utf-8", "surrogatepass"))
        return pd.DataFrame({"path": [f"a{rows['doc_id'].iloc[0] // 64}.zip"], "content": [held.getvalue()]})

    archives = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 64)).applyInPandas(packed, "path string, content binary")
    return sources.expand_archives(archives).select("archive", "path", "size_bytes", F.sha2("content", 256).alias("content_hash"), "error")


@query("SELECT source AS repository_id, doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 101 = 0)")
def a9_delete_repository(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("repository_id"), "doc_id")
    return inventory.delete_repository(d, d.filter("doc_id % 101 = 0"))


@query(
    """WITH gone AS (SELECT DISTINCT source AS id FROM documents WHERE doc_id % 101 = 0), d AS (SELECT doc_id, source FROM documents), l AS (SELECT DISTINCT doc_id FROM labels),
f AS (SELECT doc_id FROM d WHERE source NOT IN (SELECT id FROM gone)), lost AS (SELECT doc_id FROM d WHERE source IN (SELECT id FROM gone)), s AS (SELECT 'src' || CAST(conv_id % 20 AS VARCHAR) AS source, conv_id, turn FROM conversations)
SELECT 'repository' AS table_name, source AS id, NULL AS reference FROM d WHERE source NOT IN (SELECT id FROM gone) GROUP BY source
UNION ALL SELECT 'code_file', 'f' || doc_id, NULL FROM f UNION ALL SELECT 'symbol', 's' || doc_id, NULL FROM f WHERE doc_id IN (SELECT doc_id FROM l)
UNION ALL SELECT 'dependency', 'd' || doc_id, CASE WHEN doc_id + 7 NOT IN (SELECT doc_id FROM lost) THEN 'f' || (doc_id + 7) END FROM f
UNION ALL SELECT 'code_chunk', 'c' || doc_id, CASE WHEN doc_id + 7 NOT IN (SELECT doc_id FROM lost WHERE doc_id IN (SELECT doc_id FROM l)) THEN 's' || (doc_id + 7) END FROM f
UNION ALL SELECT 'chat_session', CAST(conv_id AS VARCHAR), NULL FROM s WHERE source NOT IN (SELECT id FROM gone) GROUP BY conv_id
UNION ALL SELECT 'chat_message', conv_id || '-' || turn, NULL FROM s WHERE source NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'not found', 'nowhere', 'REPOSITORY_NOT_FOUND'"""
)
def a9_delete_cascade(spark, sf_dir):
    """Repositories go with their files, symbols, imports, chunks and chats; references into them are cleared."""
    d, labels, chats = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repository_id")), table(spark, sf_dir, "labels").select("doc_id").distinct(), table(spark, sf_dir, "conversations")
    named = lambda letter, n: F.concat(F.lit(letter), F.col("doc_id") + n)
    files_ = d.select(named("f", 0).alias("id"), "repository_id")
    symbols = d.join(labels, "doc_id").select(named("s", 0).alias("id"), named("f", 0).alias("file_id"), "repository_id")
    dependencies = d.select(named("d", 0).alias("id"), "repository_id", named("f", 0).alias("from_file_id"), named("f", 7).alias("to_file_id"))
    chunks = d.select(named("c", 0).alias("id"), "repository_id", named("f", 0).alias("file_id"), named("s", 7).alias("symbol_id"))
    sessions = chats.select(F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("src"), F.col("conv_id") % 20).alias("repository_id")).distinct()
    messages = chats.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("session_id"))
    tables = {"chat_message": messages, "code_chunk": chunks, "dependency": dependencies, "symbol": symbols, "code_file": files_, "chat_session": sessions, "repository": d.select(F.col("repository_id").alias("id")).distinct()}
    ids = table(spark, sf_dir, "documents").filter("doc_id % 101 = 0").select(F.col("source").alias("id")).unionByName(spark.createDataFrame([("nowhere",)], "id string"))
    left, missing = inventory.delete_cascade(tables, "repository", ids)
    shown = {"dependency": "to_file_id", "code_chunk": "symbol_id"}
    out = missing.select(F.lit("not found").alias("table_name"), "id", F.col("error").alias("reference"))
    for name, df in left.items():
        out = out.unionByName(df.select(F.lit(name).alias("table_name"), "id", (F.col(shown[name]) if name in shown else F.lit(None).cast("string")).alias("reference")))
    return out


@query(
    """SELECT d.doc_id AS file_id, CASE WHEN d.doc_id % 5 <> 0 THEN text END AS content, CASE WHEN d.doc_id % 5 = 0 THEN 'Binary file — no content preview' END AS content_error, CAST(CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS INT) AS n_symbols
FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def a12_c6_file_detail(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("is_binary", F.col("doc_id") % 5 == 0)
    symbols = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id"), F.col("quality").alias("start_line"), F.lit("label").alias("name"), F.lit("label").alias("kind"), F.col("toxic").alias("end_line"))
    return sources.file_detail(f, symbols).select("file_id", "content", "content_error", F.size("symbols").alias("n_symbols"))


@query(
    f"""WITH {files_sql()} SELECT file_id, contains(content, chr(0)) AS is_binary, sha256(content) AS content_hash, CAST(length(content) - length(replace(content, chr(10), '')) AS BIGINT) AS line_count, CAST(strlen(content) AS BIGINT) AS size_bytes,
  CAST(len({LINES_SQL}) AS INT) AS n_lines, CAST(length(content) // 4 AS BIGINT) AS tokens, '# File: ' || path || chr(10) || chr(10) AS header FROM files"""
)
def b1_b4_b14_b15_file_facts(spark, sf_dir):
    f = inventory.file_facts(files(spark, sf_dir))
    return f.select("file_id", "is_binary", "content_hash", "line_count", "size_bytes", F.size(scalars.split_lines(F.col("content"))).alias("n_lines"), scalars.estimate_tokens(F.col("content")).alias("tokens"), scalars.chunk_header(F.col("path")).alias("header"))


IGNORED = ["/node_modules/x.js", "/app.min.js", "/a.lock", "/src/main.py", "/build", "/x.egg-info/PKG", "/ok/mapper.ts", "/lib.so.1", "/.DS_Store"]


@query(
    f"""WITH {files_sql(IGNORED)} SELECT file_id, list_has_any(string_split(path, '/'), [{quoted(rules.IGNORED_NAMES)}]) AS by_name,
  regexp_matches(path, '{"|".join(scalars.glob_regex(g) for g in rules.IGNORED_GLOBS)}') AS by_glob FROM files"""
)
def b5_b6_f3_ignored(spark, sf_dir):
    return files(spark, sf_dir, IGNORED).select("file_id", scalars.ignored_by_name(F.col("path")).alias("by_name"), scalars.ignored_by_glob(F.col("path")).alias("by_glob"))


@query(
    f"""WITH {files_sql(IGNORED)} SELECT file_id, (regexp_matches(path, '^en/.*') OR regexp_matches(path, '(^|/)[^/]*\\.js(/.*)?$')) AND NOT regexp_matches(path, '(^|/)main\\.py(/.*)?$') AND NOT regexp_matches(path, '^en/1[^/]*/') AS ignored FROM files"""
)
def b7_gitignore(spark, sf_dir):
    f = files(spark, sf_dir, IGNORED)
    lines = F.array(*(F.lit(x) for x in ("# comment", "/en/**", "*.js", "", "!main.py", "!/en/1*/")))
    patterns = f.select("repository_id").distinct().select("repository_id", F.posexplode(lines).alias("position", "line"))
    return inventory.ignored_by_gitignore(f, patterns).select("file_id", "ignored")


NAMES = [".py", ".TSX", "/index.js", "/Dockerfile", ".R", ".tar.gz", "/.gitignore", "/Makefile", ".scss", ".kt", "/plain", "/a.", ".d.ts", "/.eslintrc.json"]
LANGUAGES = ["Python", "TypeScript", "JavaScript", "Dockerfile", "R", None, None, "Makefile", "SCSS", "Kotlin", None, None, "TypeScript", "JSON"]


@query(f"SELECT doc_id AS file_id, ([{', '.join('NULL' if x is None else repr(x) for x in LANGUAGES)}])[CAST(doc_id % {len(NAMES)} AS INT) + 1] AS language FROM documents")
def b8_detect_language(spark, sf_dir):
    return inventory.detect_language(files(spark, sf_dir, NAMES)).select("file_id", "language")


@query()
def b8_lexer_fallback(spark, sf_dir):
    return inventory.detect_language(files(spark, sf_dir, [".tcl", ".zig", ".py", ".nope"]), fallback=True).select("file_id", "language")


@query(
    """SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'repository') || '-' || p_partkey AS slug,
  trim(regexp_replace(regexp_replace(p_name || '(x).zip', '\\.[^.]+$', ''), '[^\\w\\s-]', '', 'g')) AS name FROM part"""
)
def b9_b10_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key = F.concat(F.col("p_partkey").cast("string"), F.lit("-ab-cd"))
    return p.select("p_partkey", scalars.slugify_repo(F.concat_ws(" / ", "p_name", "p_type"), key).alias("slug"), scalars.clean_name(F.concat("p_name", F.lit("(x).zip"))).alias("name"))


@query("""WITH t AS (SELECT source, CASE doc_id % 5 WHEN 0 THEN 'README' WHEN 1 THEN '.github/' || doc_id WHEN 2 THEN 'src/' || lang || '/' || doc_id ELSE lang || '/' || doc_id END AS path FROM documents),
d AS (SELECT DISTINCT source, split_part(path, '/', 1) AS top FROM t WHERE contains(path, '/') AND path NOT LIKE '.%')
SELECT s.source AS repository_id, CASE WHEN count(d.top) = 1 THEN max(d.top) ELSE 'repository' END AS top_name FROM (SELECT DISTINCT source FROM t) s LEFT JOIN d ON d.source = s.source GROUP BY s.source""")
def b10_top_directory(spark, sf_dir):
    """Root files and hidden directories beside one or more others."""
    n, key = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    path = F.when(key == 0, "README").when(key == 1, F.concat(F.lit(".github/"), n)).when(key == 2, F.concat(F.lit("src/"), "lang", F.lit("/"), n)).otherwise(F.concat("lang", F.lit("/"), n))
    return inventory.top_directory_name(table(spark, sf_dir, "documents").select(F.col("source").alias("repository_id"), path.alias("path")))


@query("SELECT page_id, regexp_matches(trim(url), '^https://[^/?#]+') AS valid FROM pages")
def b11_valid_git_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.valid_git_url(F.col("url")).alias("valid"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || '/x' WHEN 1 THEN '../' || doc_id WHEN 2 THEN '/' || doc_id ELSE '.' END AS path FROM documents")
def b12_normalize_path(spark, sf_dir):
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    raw = F.when(k == 0, F.concat("lang", F.lit("/./a//../"), n, F.lit("/../x/"))).when(k == 1, F.concat("lang", F.lit("/../../"), n)).when(k == 2, F.concat(F.lit("/../../"), n)).otherwise(F.concat(n, F.lit("/.."), F.lit("/.")))
    return table(spark, sf_dir, "documents").select("doc_id", scalars.normalize_path(raw).alias("path"))


MODELS = ["gpt-4o-mini", "gpt-4", "gpt-3.5-turbo", "claude-x", "llama-3.3-70b", "mixtral-8x7b", "other"]


@query(f"SELECT doc_id, ([128000, 8192, 16385, 200000, 128000, 32768, 128000])[CAST(doc_id % 7 AS INT) + 1] AS tokens, starts_with(s, '_') AND NOT (starts_with(s, '__') AND ends_with(s, '__')) AS private FROM (SELECT doc_id, {ending_sql(['a', '_a', '__a__', '__a'])} AS s FROM documents)")
def b13_b16_names_and_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    from .inputs import ending

    return d.select("doc_id", scalars.context_window(ending(MODELS)).alias("tokens"), scalars.is_private_name(ending(["a", "_a", "__a__", "__a"])).alias("private"))


@query(
    """SELECT doc_id, CASE WHEN n = 0 THEN '0 B' WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN regexp_replace(printf('%.1f', round(n / 1024.0, 1)), '\\.0$', '') || ' KB'
  WHEN n < 1073741824 THEN regexp_replace(printf('%.1f', round(n / 1048576.0, 1)), '\\.0$', '') || ' MB' ELSE regexp_replace(printf('%.1f', round(n / 1073741824.0, 1)), '\\.0$', '') || ' GB' END AS size
FROM (SELECT doc_id, CAST(n_chars * ([0, 1, 100, 1000, 1000000])[CAST(doc_id % 5 AS INT) + 1] AS BIGINT) AS n FROM documents)"""
)
def b21_human_bytes(spark, sf_dir):
    n = F.col("n_chars") * F.element_at(F.array(*(F.lit(x) for x in (0, 1, 100, 1000, 1_000_000))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", scalars.human_bytes(n).alias("size"))


@query("SELECT doc_id, text FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(lang), 'idiot') OR NOT EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(lang), 'idiot'))")
def b27_keyword_filter(spark, sf_dir):
    from corpuslens.operators import vectors

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("lang").alias("path"))
    return vectors.keyword_filter(d, "Idiot").select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text"))


STATS = f"""WITH {files_sql()}, f AS (SELECT *, {LANGUAGE_SQL} AS language, length(content) - length(replace(content, chr(10), '')) AS n FROM files),
s AS (SELECT repository_id, language, CAST(sum(n) AS BIGINT) AS lines, min(string_split(path, '/')) AS first_path FROM f GROUP BY 1, 2)"""


def _inventory(spark, sf_dir):
    return inventory.file_facts(inventory.detect_language(files(spark, sf_dir)))


@query(f"{STATS} SELECT repository_id, language, lines FROM s")
def d1_language_stats(spark, sf_dir):
    return inventory.language_stats(_inventory(spark, sf_dir)).drop("first_path")


@query(f"{STATS} SELECT repository_id, language AS primary_language FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY lines DESC, first_path, language) AS k FROM s) WHERE k = 1")
def d2_primary_language(spark, sf_dir):
    return inventory.primary_language(_inventory(spark, sf_dir))


@query("SELECT source AS repository_id, array_to_string(list_sort(list_distinct(list(lang))), ',') AS languages FROM documents WHERE lang IS NOT NULL GROUP BY source")
def d15_available_languages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("lang is not null")
    return d.groupBy(F.col("source").alias("repository_id")).agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"))


TREE = f"WITH {files_sql()}, p AS (SELECT repository_id, string_split(path, '/') AS p, length(content) - length(replace(content, chr(10), '')) AS n FROM files), x AS (SELECT repository_id, p, n, unnest(range(1, len(p) + 1)) AS depth FROM p)"


@query(
    f"""{TREE}, y AS (SELECT repository_id, array_to_string(p[1:depth], '/') AS path, depth, depth = len(p) AS is_file, n FROM x)
SELECT repository_id, path, CAST(depth AS INT) AS depth, is_file, count(*) AS file_count, CAST(sum(n) AS BIGINT) AS lines, regexp_extract(path, '[^/]*$') AS name, CASE WHEN depth > 1 THEN regexp_replace(path, '/[^/]*$', '') END AS parent FROM y GROUP BY repository_id, path, depth, is_file"""
)
def g8_directory_tree(spark, sf_dir):
    return inventory.directory_tree(inventory.file_facts(files(spark, sf_dir)))


# manifests that name one package by doc_id; a repository for each document
KINDS = ["package.json", "requirements.txt", "pyproject.toml", "Cargo.toml", "go.mod", "pom.xml"]
MAPS = [rules.NPM, rules.PYTHON, rules.PYTHON, rules.RUST, rules.GO, rules.JAVA]


def _pick(keys):
    return F.element_at(F.array(*(F.lit(k) for k in keys)), (F.floor(F.col("doc_id") / 6) % len(keys) + 1).cast("int"))


def _manifests(spark, sf_dir):
    k = F.col("doc_id") % 6
    json = F.concat(F.lit('{"devDependencies": {"'), _pick(rules.NPM), F.lit('": "1.0", "left-pad": "2"}}'))
    content = F.when(k == 0, json).when(k == 1, F.concat(F.lit("# all\n"), F.upper(_pick(rules.PYTHON)), F.lit(">=1.0 ; extra\n")))
    for i in range(2, 6):
        content = content.when(k == i, F.concat(F.lit('uses "'), F.upper(_pick(MAPS[i])), F.lit('"')))
    names = F.element_at(F.array(*(F.lit(x) for x in KINDS)), (k + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("repository_id"), F.concat(F.when(F.col("doc_id") % 7 < 5, F.lit("")).otherwise(F.lit("top/")), names).alias("path"), content.alias("content"))


def _sql_map(m):
    return f"MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in m.items())}}}"


def _sql_labels(i):
    keys = list(MAPS[i])
    key = f"([{quoted(keys)}])[CAST((doc_id // 6) % {len(keys)} AS INT) + 1]"
    if i < 2:
        return f"[({_sql_map(MAPS[i])})[{key}]]"
    return f"list_transform(list_filter(map_entries({_sql_map(MAPS[i])}), lambda e: contains({key}, e.key)), lambda e: e.value)"


@query(f"SELECT 'r' || doc_id AS repository_id, array_to_string(list_sort(list_distinct(CASE doc_id % 6 {' '.join(f'WHEN {i} THEN {_sql_labels(i)}' for i in range(6))} END)), ',') AS frameworks FROM documents")
def k1_k5_c9_d8_f1_f2_frameworks(spark, sf_dir):
    out = frameworks.frameworks(_manifests(spark, sf_dir))
    return out.select("repository_id", F.array_join("frameworks", ",").alias("frameworks"))


@query("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def c8_match_contains(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "item_text")
    return frameworks.match_contains(table(spark, sf_dir, "documents").select("doc_id", "text"), b, "text", "item_text").select("doc_id", "item_id")


@query(
    """WITH w AS (SELECT DISTINCT regexp_extract(text, '([^ ]+ ){' || k || '}[^ ]+') AS item FROM documents, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE doc_id % 50 = 0),
i AS (SELECT item FROM w WHERE trim(item) <> '')
SELECT item, count(*) AS n FROM documents d, i WHERE contains(d.text, i.item) GROUP BY item"""
)
def c8_many_short_items(spark, sf_dir):
    """In how many documents the first one to four words of every fiftieth document are found: one pass over the texts for all items."""
    d = table(spark, sf_dir, "documents")
    item = F.explode(F.array(*(F.regexp_extract("text", f"([^ ]+ ){{{k}}}[^ ]+", 0) for k in range(4))))
    items = d.filter("doc_id % 50 = 0").select(item.alias("item")).distinct()
    return frameworks.count_contained(d.select("text"), items, "text", "item")


EXT4 = ".py .ts /index.js /__init__.py".split()
RESOLVED = f"""WITH f AS (SELECT doc_id AS file_id, doc_id, lang, lang || '/' || doc_id || {ending_sql(EXT4)} AS path, {LANGUAGE_SQL} AS from_language FROM documents),
x AS (SELECT a.doc_id, a.from_language, b.file_id AS next FROM f a LEFT JOIN f b ON b.doc_id = a.doc_id + 1),
i AS (SELECT doc_id, from_language, next, unnest([0, 1, 2, 3]) AS i FROM x)
SELECT doc_id * 4 + i AS import_id, CASE WHEN i = 0 THEN next WHEN i = 1 AND doc_id % 4 < 2 THEN next END AS to_file_id,
  CASE WHEN i = 1 THEN 'internal' WHEN i = 0 AND next IS NOT NULL THEN 'internal' WHEN i = 2 AND from_language = 'Python' THEN 'stdlib' ELSE 'external' END AS dependency_type FROM i"""


@query(RESOLVED)
def c5_c10_resolve_imports(spark, sf_dir):
    rows, own = imports(spark, sf_dir)
    return resolve.resolve_imports(rows, own).select("import_id", "to_file_id", "dependency_type")


@query("SELECT doc_id, split_part(n, '.', 1) AS module, i IN (0, 1, 3) AS stdlib FROM (SELECT doc_id, doc_id % 5 AS i, (['os.path', 'json', 'numpy', 'sys', 'axios'])[CAST(doc_id % 5 AS INT) + 1] AS n FROM documents)")
def c10_is_stdlib(spark, sf_dir):
    from .inputs import ending

    n = ending(["os.path", "json", "numpy", "sys", "axios"])
    return table(spark, sf_dir, "documents").select("doc_id", F.split(n, r"\.")[0].alias("module"), resolve.is_stdlib(n).alias("stdlib"))


PY = 'import os as o\nfrom pkg.m{0} import thing\nclass K{0}(Base):\n    """Doc {0}."""\n    def run(self, n: int, *a) -> int:\n        return n\ndef _f{0}(x):\n    pass\n'
TS = "import {{ a as b{0}, c }} from './m{0}';\n// about I{0}\nexport interface I{0} {{\n  x: number;\n}}\nexport class K{0} {{\n  run(n: number): void {{\n    if (n) {{ }}\n  }}\n}}\nconst f{0} = (x) => x;\n"
JS = "import d{0} from 'lib{0}';\nconst {{ p, q: r }} = require('./n{0}');\nfunction* g{0}() {{\n}}\nvar h{0} = function () {{\n}};\n"


def _sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    fill = lambda t: F.replace(F.lit(t.replace("{{", "{").replace("}}", "}").replace("{0}", "@0@")), F.lit("@0@"), F.col("doc_id").cast("string"))
    k = F.col("doc_id") % 4
    lang = F.when(k == 0, "Python").when(k == 1, "TypeScript").when(k == 2, "JavaScript").otherwise("Go")
    text = F.when(k == 0, fill(PY)).when(k == 1, fill(TS)).when(k == 2, fill(JS)).otherwise(F.lit("package main"))
    return d.select(F.col("doc_id").cast("string").alias("file_id"), F.lit("all").alias("repository_id"), F.col("doc_id").cast("string").alias("path"), lang.alias("language"), text.alias("content"))


SYMBOLS_SQL = """SELECT CAST(doc_id AS VARCHAR) AS file_id, replace(s.name, '@', CAST(doc_id AS VARCHAR)) AS name, s.kind AS kind, s.a AS start_line, s.b AS end_line, replace(s.sig, '@', CAST(doc_id AS VARCHAR)) AS signature, s.x AS is_exported
FROM documents, (SELECT unnest([
  {'k': 0, 'name': 'K@', 'kind': 'class', 'a': 3, 'b': 6, 'sig': 'class K@(Base)', 'x': true}, {'k': 0, 'name': 'K@.run', 'kind': 'method', 'a': 5, 'b': 6, 'sig': 'def run(self, n: int, *a) -> int', 'x': true},
  {'k': 0, 'name': '_f@', 'kind': 'function', 'a': 7, 'b': 8, 'sig': 'def _f@(x)', 'x': false}, {'k': 1, 'name': 'I@', 'kind': 'interface', 'a': 3, 'b': 5, 'sig': 'interface I@', 'x': true},
  {'k': 1, 'name': 'K@', 'kind': 'class', 'a': 6, 'b': 10, 'sig': 'class K@', 'x': true}, {'k': 1, 'name': 'K@.run', 'kind': 'method', 'a': 7, 'b': 9, 'sig': 'run()', 'x': false},
  {'k': 1, 'name': 'f@', 'kind': 'function', 'a': 11, 'b': 11, 'sig': 'const f@ = () => ...', 'x': false}, {'k': 2, 'name': 'g@', 'kind': 'function', 'a': 3, 'b': 4, 'sig': 'function g@()', 'x': false},
  {'k': 2, 'name': 'h@', 'kind': 'function', 'a': 5, 'b': 6, 'sig': 'const h@ = () => ...', 'x': false}]) AS s) WHERE s.k = doc_id % 4"""


@query(SYMBOLS_SQL)
def h1_h3_h4_h7_h8_symbols(spark, sf_dir):
    return parse.parse_repository(_sources(spark, sf_dir))[0].drop("docstring")


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS file_id, s.name || CAST(doc_id AS VARCHAR) || s.more AS name, s.kind AS kind, CAST(s.a + s.na * n AS INT) AS start_line, CAST(s.b + s.nb * n AS INT) AS end_line, s.kind = 'class' AS is_exported
FROM (SELECT doc_id, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS n FROM documents), (SELECT unnest([
  {'name': 'K', 'more': '', 'kind': 'class', 'a': 2, 'na': 1, 'b': 6, 'nb': 3}, {'name': 'K', 'more': '.m', 'kind': 'method', 'a': 3, 'na': 1, 'b': 5, 'nb': 3}, {'name': 'f', 'more': '', 'kind': 'function', 'a': 7, 'na': 3, 'b': 9, 'nb': 3}]) AS s)"""
)
def h3_h4_scripts_with_texts(spark, sf_dir):
    """Scripts that hold each whole text in a comment, in nested templates and in a string: none of its brackets, quotes and lines may mislead the scan."""
    text = F.coalesce("text", F.lit(""))
    escaped = F.regexp_replace(text, r"([\\`$])", r"\\$1")
    line = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    k = F.col("doc_id").cast("string")
    content = F.concat(
        F.lit("/* "), F.replace(text, F.lit("*/"), F.lit("* /")), F.lit(" */\nexport class K"), k, F.lit(" {\n  m(a = `"), escaped, F.lit("`) {\n    return `${ { a: `"), escaped, F.lit("` }.a }`;\n  }\n}\nconst f"), k,
        F.lit(' = () => {\n  return "'), line, F.lit('";\n};\n'),
    )
    language = F.when(F.col("doc_id") % 2 == 0, "TypeScript").otherwise("JavaScript")
    made = table(spark, sf_dir, "documents").select(k.alias("file_id"), F.lit("all").alias("repository_id"), k.alias("path"), language.alias("language"), content.alias("content"))
    return parse.parse_repository(made)[0].select("file_id", "name", "kind", "start_line", "end_line", "is_exported")


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS file_id, replace(s.n, '@', CAST(doc_id AS VARCHAR)) AS import_name, replace(s.p, '@', CAST(doc_id AS VARCHAR)) AS import_path, s.r AS is_relative
FROM documents, (SELECT unnest([{'k': 0, 'n': 'o', 'p': 'os', 'r': false}, {'k': 0, 'n': 'thing', 'p': 'pkg.m@.thing', 'r': false}, {'k': 1, 'n': 'b@', 'p': './m@', 'r': true}, {'k': 1, 'n': 'c', 'p': './m@', 'r': true},
  {'k': 2, 'n': 'd@', 'p': 'lib@', 'r': false}, {'k': 2, 'n': 'p', 'p': './n@', 'r': true}, {'k': 2, 'n': 'r', 'p': './n@', 'r': true}]) AS s) WHERE s.k = doc_id % 4"""
)
def h2_h5_h6_imports(spark, sf_dir):
    return parse.parse_repository(_sources(spark, sf_dir))[1]


@query("SELECT source AS repository_id, count(*) AS file_count, CAST(sum(strlen(text)) AS BIGINT) AS size_bytes FROM documents GROUP BY source")
def d10_repo_size(spark, sf_dir):
    return inventory.file_facts(files(spark, sf_dir)).groupBy("repository_id").agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("size_bytes"))


