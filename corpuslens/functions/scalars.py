"""Column functions: text, paths, hashes, scores. All are built-in expressions, so plans stay on the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens import rules

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def is_binary(content: Column) -> Column:
    """A NUL byte among the first 8192 bytes."""
    return F.coalesce(F.contains(F.substring(content.cast("binary"), 1, 8192), F.unhex(F.lit("00"))), F.lit(False))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def line_count(text: Column) -> Column:
    """Newlines; a last line without one isn't counted."""
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def split_lines(text: Column) -> Column:
    """Lines at any Unicode line end, without an empty one after the last end."""
    lines = F.split(text, LINE_END, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def decode_text(content: Column) -> Column:
    """UTF-8; malformed bytes give U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last suffix in lower case; names that only begin with a dot, and those that end in one, have none."""
    return F.lower(F.regexp_extract(basename(path), r"^.*[^/.].*?(\.[^./]+)$|^[^.]+?(\.[^./]+)$", 1))


def ignored_by_name(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(x) for x in rules.IGNORED_NAMES)))


def glob_regex(glob: str) -> str:
    """A gitignore glob, without its ! and trailing /, as a regular expression for whole relative paths.

    A glob without a slash before its end matches at any depth; whatever lies below a match is matched too.
    """
    anchored = "/" in glob.rstrip("/")[1:] or glob.startswith("/")
    glob = glob.removeprefix("/").rstrip("/")
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.*", i + 3
        elif c == "*":
            out += "[^/]*"
            i += 2 if glob.startswith("**", i) else 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[:1] in ("!", "^") else body) + "]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}(?:/.*)?$"


def ignored_by_glob(path: Column) -> Column:
    return path.rlike("|".join(glob_regex(g) for g in rules.IGNORED_GLOBS))


def slugify(name: Column) -> Column:
    """ASCII words of a name in lower case, joined by hyphens."""
    plain = F.translate(F.lower(name), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def slugify_repo(name: Column, key: Column) -> Column:
    slug = slugify(name)
    return F.concat_ws("-", F.when(slug == "", F.lit("repository")).otherwise(slug), F.element_at(F.split(key, "-"), 1))


def clean_name(raw: Column) -> Column:
    """The stem of a file name without marks; `repository` if nothing is left."""
    stem = F.regexp_replace(basename(raw), r"(?<=.)\.[^.]+$", "")
    out = F.trim(F.regexp_replace(stem, r"[^\w\s-]", ""))
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit("repository")).otherwise(out)


def valid_git_url(url: Column) -> Column:
    u = F.trim(url)
    return F.coalesce((F.try_parse_url(u, F.lit("PROTOCOL")) == "https") & (F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit("")) != ""), F.lit(False))


def normalize_path(path: Column) -> Column:
    """POSIX normal form: empty and `.` parts go, `..` takes back the part before it where there is one."""
    rooted = path.startswith("/")

    def fold(done: Column, part: Column) -> Column:
        last = F.when(F.size(done) > 0, F.element_at(done, -1))
        back = (part == "..") & last.isNotNull() & (last != "..")
        return (
            F.when((part == "") | (part == "."), done)
            .when(back, F.slice(done, F.lit(1), F.size(done) - 1))
            .when((part == "..") & rooted & last.isNull(), done)
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), fold)
    text = F.array_join(parts, "/")
    lead = F.when(path.startswith("//") & ~path.startswith("///"), F.lit("//")).otherwise(F.lit("/"))
    return F.when(rooted, F.concat(lead, text)).when(text == "", F.lit(".")).otherwise(text)


def parent_path(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def is_private_name(name: Column) -> Column:
    return name.startswith("_") & ~(name.startswith("__") & name.endswith("__"))


def filled(template: str, **values: Column) -> Column:
    """A text with a column in place of each {name}; null if one of them is."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[x].cast("string") if k % 2 else F.lit(x) for k, x in enumerate(parts)))


def _of_symbol(template: str, symbol: Column | None) -> Column:
    return F.lit("") if symbol is None else F.when(F.coalesce(symbol, F.lit("")) == "", F.lit("")).otherwise(filled(template, symbol=symbol))


def chunk_header(path: Column, symbol: Column | None = None) -> Column:
    return filled(rules.CHUNK_HEADER, path=path, symbol=_of_symbol(rules.CHUNK_SYMBOL, symbol))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.coalesce(F.char_length(text), F.lit(0)) / 4)


def context_window(model: Column) -> Column:
    """Tokens that a model takes, by parts of its name."""
    (part, tokens), *others = rules.CONTEXT_WINDOWS
    return reduce(lambda c, x: c.when(model.contains(x[0]), x[1]), others, F.when(model.contains(part), tokens)).otherwise(rules.CONTEXT_WINDOW)


def context_block(index: Column, path: Column, start: Column, stop: Column, content: Column, symbol: Column | None = None) -> Column:
    body = F.regexp_replace(content, r"^\s+|\s+$", "")
    return filled(rules.CONTEXT_BLOCK, index=index, path=path, start=start, stop=stop, symbol=_of_symbol(rules.BLOCK_SYMBOL, symbol), content=body)


NO_CONTEXT = rules.NO_CONTEXT


def prompt(question: Column, context: Column) -> Column:
    return filled(rules.PROMPT, context=F.coalesce(context, F.lit(NO_CONTEXT)), question=question)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for null, empty, unequal lengths and zero vectors."""
    size = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (size > 0), _dot(a, b) / size).otherwise(F.lit(0.0))


def score(distance: Column) -> Column:
    """1 - distance, not below 0, with 4 decimals; 0 for null and NaN."""
    return F.when(distance.isNull() | F.isnan(distance), F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), 1 - distance), 4))


def human_bytes(n: Column) -> Column:
    k = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    value = F.round(n / F.pow(F.lit(1024.0), k), 1)
    text = F.regexp_replace(F.format_string("%.1f", value), r"\.0$", "")
    return F.when(n == 0, F.lit("0 B")).otherwise(F.concat_ws(" ", text, F.element_at(F.array(*(F.lit(x) for x in ("B", "KB", "MB", "GB"))), k + 1)))


def stage_state(stage: Column, phase: Column, status: Column) -> Column:
    """What a stage shows: pending, active, done or error."""
    place = lambda c: F.array_position(F.array(*(F.lit(x) for x in rules.PHASES)), c)  # noqa: E731  0: unknown
    s, p = place(stage), F.coalesce(place(phase), F.lit(0))
    now = F.when(status == "error", F.lit("error")).otherwise(F.when(p == 0, F.lit("pending")).otherwise(F.lit("active")))
    return F.when(status == "ready", F.lit("done")).when(s < p, F.lit("done")).when(s == p, now).otherwise(F.lit("pending"))


def client_key(api_key: Column, host: Column) -> Column:
    return F.when(F.coalesce(api_key, F.lit("")) != "", F.concat(F.lit("key:"), F.sha2(api_key, 256))).otherwise(F.concat(F.lit("ip:"), F.coalesce(host, F.lit("unknown"))))
