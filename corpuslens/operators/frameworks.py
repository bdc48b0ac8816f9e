"""Frameworks that a repository's manifests name. files: repository_id, path, content."""

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions import scalars

MANIFESTS = {"package.json": "npm", "requirements.txt": "requirements", "pyproject.toml": "pyproject", "Cargo.toml": "cargo", "go.mod": "go", "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "java"}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def manifests(files: DataFrame) -> DataFrame:
    """Manifests at the root, and in the one top directory where there is just one: with kind."""
    parts = F.split("path", "/")
    only = files.filter(F.size(parts) > 1).groupBy("repository_id").agg(F.min(parts[0]).alias("_a"), F.max(parts[0]).alias("_b")).filter("_a = _b").select("repository_id", F.col("_a").alias("_top"))
    near = files.filter(scalars.basename(F.col("path")).isin(*MANIFESTS)).filter(F.size(parts) <= 2)
    return near.join(only, "repository_id", "left").filter((F.size(parts) == 1) | (parts[0] == F.col("_top"))).select("repository_id", "path", F.element_at(_map(MANIFESTS), scalars.basename(F.col("path"))).alias("kind"), "content")


def npm_keys(content: Column) -> Column:
    """Keys of the three sections of a package file; none where it is no JSON."""
    section = lambda s: F.coalesce(F.json_object_keys(F.get_json_object(content, f"$.{s}")), F.array().cast("array<string>"))
    return F.array_union(F.array_union(section("dependencies"), section("devDependencies")), section("peerDependencies"))


def requirement_names(content: Column) -> Column:
    names = F.transform(scalars.split_lines(content), lambda x: F.lower(F.regexp_extract(F.trim(x), r"^([^>=<!;#\[\s]*)", 1)))
    return F.filter(names, lambda x: x != "")


def contained(content: Column, pairs: dict[str, str]) -> Column:
    """Labels of the keys that the lower-cased text contains. The rules are literals, so this is a projection and no join."""
    low = F.lower(content)
    return F.filter(F.array(*(F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in pairs.items())), lambda x: x.isNotNull())


def labels_of(keys: Column, pairs: dict[str, str]) -> Column:
    named = _map(pairs)
    return F.filter(F.transform(keys, lambda k: F.element_at(named, k)), lambda x: x.isNotNull())


def frameworks(files: DataFrame) -> DataFrame:
    """repository_id and the sorted distinct labels of all its manifests."""
    found = {
        "npm": labels_of(npm_keys(F.col("content")), rules.NPM), "requirements": labels_of(requirement_names(F.col("content")), rules.PYTHON), "pyproject": contained(F.col("content"), rules.PYTHON),
        "cargo": contained(F.col("content"), rules.RUST), "go": contained(F.col("content"), rules.GO), "java": contained(F.col("content"), rules.JAVA),
    }
    labels = reduce(lambda c, kv: c.when(F.col("kind") == kv[0], kv[1]), list(found.items())[1:], F.when(F.col("kind") == "npm", found["npm"]))
    each = manifests(files).select("repository_id", F.explode(labels).alias("label")).distinct()
    sets = each.groupBy("repository_id").agg(F.array_sort(F.collect_set("label")).alias("frameworks"))
    none = F.array().cast("array<string>")
    return files.select("repository_id").distinct().join(sets, "repository_id", "left").withColumn("frameworks", F.coalesce("frameworks", none))


def match_contains(texts: DataFrame, items: DataFrame, text: str, item_text: str, most_chars: int = 1 << 20) -> DataFrame:
    """Rows of texts and items where the text contains the item's text. Blank items are in none.

    Distinct items become an automaton that finds all of them in one pass over a text. It is built by each worker from items that are
    broadcast once they are counted: where they have more than most_chars characters they are cut into blocks below that, and each
    block costs a pass over the texts. Items of seven words and more that exceed one block in all meet texts on their second to sixth word instead, which stand whole
    in any text that contains them: an equi-join, for any number of items.
    """
    words, keyed, names = lambda c: F.split(c, r"\s+"), items.filter(F.trim(F.col(item_text)) != ""), [*texts.columns, *items.columns]
    blocks, large = _blocks(keyed, item_text, most_chars)
    out = None
    for held in blocks:
        found = texts.withColumn("_s", F.explode(_finder(held)(F.col(text)))).join(keyed.withColumn("_s", F.col(item_text)), "_s").select(*names)
        out = found if out is None else out.unionByName(found)
    if large is not None:
        keys, rows = large.withColumns({"_w": words(F.trim(F.col(item_text))), "_i": F.xxhash64(item_text)}), texts.withColumn("_h", F.xxhash64(text))
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_t") - 5, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice("_t", i + 1, F.lit(5)), " ")))
        met = rows.withColumn("_t", words(F.col(text))).select("_h", F.explode(F.array_distinct(runs)).alias("_key")).join(keys.select("_i", F.xxhash64(F.array_join(F.slice("_w", 2, 5), " ")).alias("_key")), "_key")
        found = met.select("_h", "_i").distinct().join(keys, "_i").join(rows, "_h").filter(F.contains(F.col(text), F.col(item_text))).select(*names)  # texts travel only to what may be inside them
        out = found if out is None else out.unionByName(found)
    return texts.crossJoin(keyed).limit(0).select(*names) if out is None else out


def count_contained(texts: DataFrame, items: DataFrame, text: str, item_text: str, most_chars: int = 1 << 20) -> DataFrame:
    """Each distinct text of items that some text contains, and n, the number of rows of texts that contain it. As match_contains, but a task counts what it finds, so no pair leaves it."""
    keyed = items.filter(F.trim(F.col(item_text)) != "")
    blocks, large = _blocks(keyed, item_text, most_chars)
    out = None if large is None else match_contains(texts.select(text), large.select(F.col(item_text).alias("_s")).distinct(), text, "_s", most_chars).select("_s", F.lit(1).cast("long").alias("n"))
    for held in blocks:
        found = texts.select(text).mapInPandas(_counter(held), "_s string, n long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return keyed.limit(0).select(item_text, F.lit(0).cast("long").alias("n"))
    return out.groupBy(F.col("_s").alias(item_text)).agg(F.sum("n").alias("n"))


def _blocks(keyed: DataFrame, item_text: str, most_chars: int) -> tuple[list, DataFrame | None]:
    """Broadcast lists of distinct item texts of about most_chars characters each, and the items of seven words and more where these are too many for one."""
    distinct = keyed.select(F.col(item_text).alias("_s")).distinct()
    is_large = F.size(F.split(F.trim(F.col("_s")), r"\s+")) >= 7
    chars = distinct.agg(F.sum(F.char_length("_s")).alias("n"), F.sum(F.when(is_large, F.char_length("_s"))).alias("large")).first()
    joined = (chars["large"] or 0) > most_chars
    distinct, n = distinct.filter(~is_large) if joined else distinct, (chars["n"] or 0) - joined * (chars["large"] or 0)
    count, sc = -(-n // most_chars), keyed.sparkSession.sparkContext
    parts = (distinct.filter(F.pmod(F.xxhash64("_s"), F.lit(count)) == k) for k in range(count))
    return [sc.broadcast([r["_s"] for r in part.collect()]) for part in parts], keyed.filter(F.size(F.split(F.trim(F.col(item_text)), r"\s+")) >= 7) if joined else None


def _automaton(held):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for s in held.value:
        automaton.add_word(s, s)
    automaton.make_automaton()
    return automaton if len(automaton) else None


def _finder(held):
    """A column function: the broadcast texts that a text contains, each once."""

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(held)
        for texts in batches:
            yield pd.Series([sorted({s for _, s in automaton.iter(t)}) if automaton and t else [] for t in texts], dtype="object")

    return found


def _counter(held):
    """A function over a partition's texts: the broadcast texts and the number of texts that contain each."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, n = _automaton(held), Counter()
        for texts in batches:
            for t in texts.iloc[:, 0] if automaton else ():
                if t:
                    n.update({s for _, s in automaton.iter(t)})
        yield pd.DataFrame({"_s": pd.Series(list(n), dtype="object"), "n": pd.Series(list(n.values()), dtype="int64")})

    return counts
