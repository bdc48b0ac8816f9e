"""Registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chatformat, decontaminate, filteraudit, htmltext, linededup, packing, pii, prefixtrie, quality, simhash, substringdedup, tokencount, toxicity
from .common import table


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file. It is the same on driver and executors, where the package is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, t, ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM l WHERE len(ws) >= 3),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY 1),
top AS (SELECT doc_id, max(c) AS c FROM (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS w FROM l) GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT l.doc_id, ls, ws, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(top.c, 0) AS top
  FROM l LEFT JOIN rep ON rep.doc_id = l.doc_id LEFT JOIN top ON top.doc_id = l.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_symbols > 0.1 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR n_dup_lines > 0.5 * len(ls) OR top > 0.3 * n_words
    OR len(list_filter(ws, lambda x: strlen(x) > 3 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) > 0.5 * n_words
    OR len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) < 0.7 * n_words) AS kept
FROM f
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chatformat.read_back(chatformat.format_chats(chats))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), chats AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS turns, list(role ORDER BY turn, role, text) AS roles FROM rows GROUP BY conv_id
)
SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns,
  sha256(array_to_string(list_transform(turns, lambda x: x.role || chr(10) || x.text || chr(10)), '')) AS turns_sha256,
  CAST(length(array_to_string(list_transform(list_filter(turns, lambda x: x.role = 'assistant'), lambda x: x.text), '')) AS BIGINT) AS loss_chars,
  sha256(array_to_string(list_transform(list_filter(turns, lambda x: x.role = 'assistant'), lambda x: x.text), '')) AS loss_sha256,
  CAST(list_sum(list_transform(turns, lambda x: 14 + length(x.role) + length(x.text)
    + length(regexp_replace(x.role || x.text, '[^\\#:<]', '', 'g')))) AS BIGINT) AS formatted_chars,
  regexp_full_match(array_to_string(roles, ','), '(system,)?user,assistant(,user,assistant)*') AS valid
FROM chats
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("_n_gone").alias("n_removed"))


OP6_SQL = r"""
WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
runs AS (
  SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS run
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM lines WHERE len(ls) >= 3)
),
later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS k FROM runs WHERE regexp_matches(run, '[^\x20\x09-\x0D]')
  ) WHERE k > 1
),
gone AS (SELECT doc_id, list_distinct(flatten(list([pos, pos + 1, pos + 2]))) AS g FROM later GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN g IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(0, len(ls)), lambda i: NOT list_contains(g, i)), lambda i: ls[i + 1]), chr(10)) END AS text,
  CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed
FROM lines d LEFT JOIN gone USING (doc_id)
"""


#: What op7 edits: addresses, card numbers and secrets give way to a mask.
MASKED = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\b[0-9]{13,19}\b|\b[0-9a-fA-F]{32,}\b|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"
MASK = "<masked>"


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, and of its form with masks, counted again from the edits alone."""
    path = vocabulary("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", tokencount.masks(F.col("text"), MASKED, MASK).alias("edits"))
    out = tokencount.recount(tokencount.count(docs, path, further=("edits",)), path)
    return out.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_edited"), "n_chars_encoded")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = htmltext.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(docs.filter(~out), labels.filter(~out))
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"), secret="corpuslens").select("doc_id", "text", F.col("_n_entities").alias("n_entities"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substringdedup.digests(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, pos, md5(array_to_string(ws[pos + 1:pos + 50], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS pos FROM w WHERE len(ws) >= 50)),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY h) AS first FROM k) WHERE first < doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(pos, pos + 50)))) AS g FROM later GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN g IS NULL THEN ws ELSE list_transform(list_filter(range(0, len(ws)), lambda i: NOT list_contains(g, i)), lambda i: ws[i + 1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(filteraudit.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
  coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
f AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
  count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS failing, before <> '' AND translate(fails, before, '') <> fails AS gone, fails = own AS alone FROM f, s),
g AS (SELECT part, filter_order, CAST(step AS INT) AS step, own, CAST(coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (failing AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (failing AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (failing AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (failing AND NOT gone), 0) AS BIGINT) AS toxic_lost FROM r GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(prefixtrie.with_shared_beginnings(prefixtrie.turns(table(spark, sf_dir, "conversations"))))


#: The remainders of CRC-32 come from its rule: a table of 256 numbers, made by eight shifts each.
OP13_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'m': md5(CAST(length(role) AS VARCHAR) || ':' || role || text), 'w': CAST(len(regexp_extract_all(text, '[^ 	-
]+')) AS BIGINT)}
    ORDER BY turn NULLS FIRST, role, md5(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS ts FROM raw GROUP BY 1
),
h AS (SELECT conv_id, ts, conv_id - conv_id % 20 AS base,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: xor(tab[CAST((xor(a, b) & 255) + 1 AS BIGINT)], a >> 8)), 4294967295) % 4 AS h FROM own, crc),
built AS (SELECT h.conv_id, list_concat(coalesce(b.ts, [])[1:h.h], h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN own b ON b.conv_id = h.base),
k AS (SELECT conv_id, ts, len(ts) AS n, list_transform(range(0, len(ts) + 1), lambda d: array_to_string(list_transform(ts[1:d], lambda x: x.m), '')) AS ks FROM built),
e AS (SELECT conv_id, n, unnest(ks) AS key, unnest(range(0, n + 1)) AS depth, unnest(list_concat([0], list_transform(ts, lambda x: x.w))) AS words FROM k),
nodes AS (
  SELECT key, CAST(any_value(depth) AS BIGINT) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM e GROUP BY key
),
kids AS (SELECT substr(key, 1, length(key) - 32) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (key)),
up AS (SELECT unnest(list_transform(range(0, depth + 1), lambda d: substr(key, 1, 32 * d))) AS key, (n_children = 0)::INT AS leaf, (n_convs - 1) * words AS saved FROM full_nodes),
sums AS (SELECT key, sum(leaf) AS leaves, sum(saved) AS saved FROM up GROUP BY 1)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums USING (key) LEFT JOIN nodes p ON f.depth > 0 AND p.key = substr(f.key, 1, length(f.key) - 32)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_best_fit_packing, op3_simhash, op4_chat_format, op5_decontaminate, op6_line_dedup, op7_token_counts, op8_html_text, op9_toxicity, op10_pii, op11_substring_dedup, op12_filter_audit, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op4_chat_format": OP4_SQL, "op6_line_dedup": OP6_SQL, "op11_substring_dedup": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_prefix_trie": OP13_SQL}
