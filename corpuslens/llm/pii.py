"""Personal data replaced by surrogates, with DataFrame functions alone.

Entities are e-mail addresses, IPv4 and IPv6 addresses, phone numbers (with a country code, a bracketed area code, groups of 3-3-4 digits or a zero
in front; other bare digits are no phone number), card numbers, hexadecimal secrets, names behind a form of address, and later or earlier
mentions of such names in the same text without one. An entity's canonical form leaves case and separators out. Its surrogate comes
from a keyed hash of type, canonical form and attempt, so one entity has one surrogate in every document and every way of writing it, and
keeps its format: separators, case, lengths, country code, top-level domain and the Luhn check of card numbers. Names are replaced word by
word: a given name by one of the same gender and script (Latin, Cyrillic or Greek), a family name by one that keeps the
gendered ending that Cyrillic and Greek ones have. So `Mr. John Stone`, `Mr Stone`, `Dr. Stone`, `John Stone` and `Stone` stay one person.

Two entities never share a surrogate and none becomes another's original: over the distinct entities of the table, those
whose surrogate is taken get further attempts until none is left. From some attempt on, names and addresses grow
longer, so surrogates never run out. Attempts above the first are few; only they are joined back, by a hash of the text.

Null texts stay null; texts without entities and empty ones stay as they are; texts of any length are read whole. Repeated rows get
equal results; rows without a key and rows that share one are treated like others. An empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

# Forms of address by gender, and endings and syllables of made-up names by script.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Madam", "Lady", "Госпожа", "Κυρία")
MALE = ("Mr", "Herr", "Señor", "Monsieur", "Sir", "Господин", "Κύριος")
EITHER = ("Dr", "Prof", "Professor", "Doctor", "Доктор", "Профессор")
TITLES = "|".join(sorted(FEMALE + MALE + EITHER, key=len, reverse=True))
SYLLABLES = {
    "Latin": "ba be bo da de do fa fi ga go ka ke ki la le lo ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te to va ve vi vo".split(),
    "Cyrillic": "ба бе бо да де до фа фи га го ка ке ки ла ле ло ма ме ми мо на не ни но па пе ра ре ри ро са се со та те то ва ве ви во".split(),
    "Greek": "βα βε βο δα δε δο φα φι γα γο κα κε κι λα λε λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σο τα τε το θα θε θι θο".split(),
}
ENDINGS = {"Latin": ("na", "rin"), "Cyrillic": ("на", "рин"), "Greek": ("να", "ρις")}  # female, male

#: Country codes behind a plus: one digit, two digits, and three for all others.
CODES = "[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"

PARTS = {
    # from the first of its letters on, with up to 127 labels, as host names have: Java's engine takes stack for each repeat of a group, so no group repeats without bound
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,126}\.[A-Za-z]{2,}",
    "secret": r"(?:(?<![0-9A-Za-z])|(?<=(?<![0-9A-Za-z])0[xX]))[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])",
    # with a bracketed area code; 3-3-4 digits; a zero and an area code; eight to fifteen digits behind a plus
    "phone": r"(?<![0-9A-Za-z])(?:(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,5}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|(?:\+?[0-9]{1,3}[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}"
    r"|0[0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,4}|\+[0-9](?:(?:[ .-]?\(|\)[ .-]?|[ .-])?[0-9]){7,14})(?![0-9A-Za-z])",
    # all eight groups, or fewer about a double colon and a digit among them, so that scopes of program text stay
    "ip6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{13,19})(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}})(?:{TITLES})\.? (?!(?:{TITLES})\b)\p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?",
}
#: No entity begins behind a Latin letter, but for those that its own pattern lets: this is seen first, as it rules most places out.
_BEGIN = r"(?:(?<![A-Za-z])|\G|(?<=0[xX]))"
ANY = _BEGIN + "(?:" + "|".join(f"(?:{x})" for x in PARTS.values()) + ")"


def kind_of(shown: Column) -> Column:
    out = F.lit("name")
    for k in ("card", "ip", "ip6", "phone", "secret", "email"):
        out = F.when(shown.rlike(rf"^(?:{PARTS[k]})$"), F.lit(k)).otherwise(out)
    return out


def _bind(value: Column, fn) -> Column:
    """fn(value), where value is computed once however often fn reads it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _only(shown: Column) -> Column:
    return F.regexp_replace(shown, "[^0-9]", "")


def _prefix(shown: Column) -> Column:
    """The digits of a phone number that stay: its country code, or the zero before an area code. A canonical form has the same as its number."""
    code = F.regexp_extract(_only(shown), f"^(?:{CODES})", 0)
    led = F.regexp_extract(shown, r"^([0-9]{1,3})(?=[ .-]?\(|[ .-][0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$| [0-9]+$)", 1)
    return F.when(shown.startswith("+"), code).when(led != "", led).otherwise(F.regexp_extract(shown, "^0", 0))


def _groups(shown: Column) -> Column:
    """The eight groups of an IPv6 address, of four digits each."""
    split = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    left, right = split(F.substring_index(F.lower(shown), "::", 1)), F.when(shown.contains("::"), split(F.substring_index(F.lower(shown), "::", -1))).otherwise(F.array().cast("array<string>"))
    full = lambda s: F.concat(s["l"], F.array_repeat(F.lit("0"), F.lit(8) - F.size(s["l"]) - F.size(s["r"])), s["r"])
    return F.transform(_bind(F.struct(left.alias("l"), right.alias("r")), full), lambda g: F.lpad(g, 4, "0"))


def canonical(kind: Column, shown: Column) -> Column:
    """What all ways of writing an entity share. It is a way of writing it too, so its surrogate is the canonical form of what is written.

    Of names, this is for one word, without the gender that `units` puts behind it.
    """

    def of(x: Column) -> Column:
        phone = _bind(_prefix(x), lambda p: F.concat(p, F.lit(" "), F.substring(_only(x), F.char_length(p) + 1, F.char_length(x))))
        return F.when(kind == "card", _only(x)).when(kind == "phone", phone).when(kind == "ip6", F.array_join(_groups(x), ":")).otherwise(F.lower(x))

    return _bind(shown, of)


def _chars(shown: Column, each) -> Column:
    """each(character, its place from 1) for every character, joined."""
    return F.array_join(F.transform(F.filter(F.split(shown, ""), lambda c: c != ""), lambda c, i: each(c, i + 1)), "")


def _hex(stream: Column, at: Column) -> Column:
    return F.substring(stream, F.pmod(at, F.lit(128)).cast("int") + 1, F.lit(1))


def _number(stream: Column, at: Column) -> Column:
    """A number below 65536 from the stream, for place `at`."""
    return F.conv(F.substring(stream, F.pmod(at, F.lit(32)).cast("int") * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _letter(stream: Column, at: Column, code: int = 97) -> Column:
    return F.char(F.lit(code) + F.pmod(_number(stream, at), F.lit(26)))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    n = F.char_length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.pmod(n - i, F.lit(2)) == 1
        return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.pmod(F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x), F.lit(10))


def _digits(shown: Column, stream: Column, kept: Column) -> Column:
    """shown with its digits from the stream, but for the first `kept`."""

    def each(c: Column, i: Column) -> Column:
        before = F.char_length(F.regexp_replace(F.substring(shown, F.lit(1), i), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]") & (before > kept), F.pmod(_number(stream, before), F.lit(10)).cast("string")).otherwise(c)

    return _chars(shown, each)


def _card(shown: Column, stream: Column) -> Column:
    new = _digits(shown, stream, F.lit(0))
    last = F.pmod(F.lit(10) - _luhn(F.concat(F.regexp_replace(_only(new), "[0-9]$", ""), F.lit("0"))), F.lit(10))
    odd = F.pmod(last + 1 + F.pmod(_number(stream, F.lit(29)), F.lit(9)), F.lit(10))  # any but the check digit
    return F.concat(F.regexp_replace(new, "[0-9]$", ""), F.when(_luhn(_only(shown)) == 0, last).otherwise(odd).cast("string"))


def _phone(shown: Column, stream: Column) -> Column:
    return _digits(shown, stream, F.char_length(_prefix(shown)))


def _ip(stream: Column) -> Column:
    return F.concat_ws(".", *((F.pmod(_number(stream, F.lit(k)), F.lit(254)) + 1).cast("string") for k in range(4)))


def _ip6(shown: Column, stream: Column) -> Column:
    """Groups keep their leading zeros and their number of digits, so all forms of an address become forms of one other."""

    def new(group: Column, at: Column) -> Column:
        zeros = F.char_length(F.regexp_extract(group, "^0*", 0))

        def digit(i: Column) -> Column:
            n = at * 4 + i
            first = F.lower(F.hex(F.pmod(_number(stream, n), F.lit(15)) + 1))
            return F.when(i <= zeros, F.lit("0")).when(i == zeros + 1, first).otherwise(_hex(stream, n))

        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), digit), "")

    def written(made: Column) -> Column:
        def side(part: Column, right: bool) -> Column:
            own = F.filter(F.split(part, ":"), lambda g: g != "")
            return F.array_join(_bind(own, lambda gs: F.transform(gs, lambda g, k: F.right(F.get(made, k + 8 - F.size(gs) if right else k), F.char_length(g)))), ":")

        short = F.concat(side(F.substring_index(shown, "::", 1), False), F.lit("::"), side(F.substring_index(shown, "::", -1), True))
        return F.when(shown.contains("::"), short).otherwise(side(shown, False))

    out = _bind(F.transform(_groups(shown), new), written)
    return _bind(out, lambda x: F.when(F.lower(shown) == shown, x).otherwise(F.upper(x)))


def _email(shown: Column, stream: Column, attempt: Column) -> Column:
    """Letters and digits in place; from the fourth further attempt on, with more letters in front each time."""
    top = F.regexp_extract(shown, r"\.[A-Za-z]{2,}$", 0)
    rest = F.substring(shown, F.lit(1), F.char_length(shown) - F.char_length(top))

    def each(c: Column, i: Column) -> Column:
        return (
            F.when(c.between("a", "z"), _letter(stream, i)).when(c.between("A", "Z"), _letter(stream, i, 65)).when(c.between("0", "9"), F.pmod(_number(stream, i), F.lit(10)).cast("string")).otherwise(c)
        )

    more = F.when(attempt > 3, F.array_join(F.transform(F.sequence(F.lit(1), attempt), lambda i: _letter(stream, i + 7)), "")).otherwise("")
    return F.concat(F.when(F.upper(shown) == shown, F.upper(more)).otherwise(more), _chars(rest, each), top)


def _secret(shown: Column, stream: Column) -> Column:
    some_low = F.upper(shown) != shown
    return _bind(some_low, lambda low: _chars(shown, lambda c, i: F.when(c.between("a", "f") | (c.between("0", "9") & low), _hex(stream, i)).otherwise(F.upper(_hex(stream, i)))))


def _word(shown: Column, gender: Column, stream: Column, attempt: Column) -> Column:
    """A word of a name, of three syllables and one more for each further attempt, so there are always enough of them."""

    def by_script(script: str) -> Column:
        syllables = F.split(F.lit(" ".join(SYLLABLES[script])), " ")
        pick = lambda j: F.get(syllables, F.pmod(_number(stream, j), F.lit(len(SYLLABLES[script]))))
        female, male = ENDINGS[script]
        own = {"Latin": F.lit(""), "Cyrillic": F.when(F.lower(shown).rlike("[ая]$"), female).otherwise(male), "Greek": F.when(F.lower(shown).rlike("[ςσ]$"), male).otherwise(female)}[script]
        last = F.when(gender == "f", F.lit(female)).when(gender == "m", F.lit(male)).otherwise(own)
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), pick), ""), last)

    made = F.when(shown.rlike(r"\p{IsCyrillic}"), by_script("Cyrillic")).when(shown.rlike(r"\p{IsGreek}"), by_script("Greek")).otherwise(by_script("Latin"))
    return F.when(F.upper(shown) == shown, F.upper(made)).when(F.lower(shown) == shown, made).otherwise(F.initcap(made))


def plain(kind: Column, canon: Column) -> Column:
    """A canonical form as it would be written: without the gender of a name."""
    return F.when(kind == "name", F.substring_index(canon, "|", 1)).otherwise(canon)


def surrogate(kind: Column, shown: Column, canon: Column, attempt: Column, key: str) -> Column:
    """shown as it is to be replaced, in shown's own format."""
    stream = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 512)

    def made(st: Column) -> Column:
        out = F.when(kind == "ip", _ip(st)).when(kind == "name", _word(shown, F.substring_index(canon, "|", -1), st, attempt)).when(kind == "email", _email(shown, st, attempt))
        for k, f in {"secret": _secret, "phone": _phone, "card": _card, "ip6": _ip6}.items():
            out = out.when(kind == k, f(shown, st))
        return out

    return _bind(stream, made)


_TITLED = rf"^(?:{TITLES})\.? "


def _names(found: Column) -> Column:
    """The words of names with a form of address: structs of word, its gender and whether it is a given name."""

    def of(x: Column) -> Column:
        title = F.regexp_extract(x, rf"^({TITLES})", 1)
        gender = F.when(title.isin(*FEMALE), "f").when(title.isin(*MALE), "m").otherwise("")
        words = F.split(F.regexp_replace(x, _TITLED, ""), " ")
        return F.transform(words, lambda w, i: F.struct(w.alias("word"), F.lower(w).alias("low"), gender.alias("gender"), ((F.size(words) == 2) & (i == 0)).alias("given")))

    return F.flatten(F.transform(F.filter(found, lambda x: x.rlike(_TITLED)), of))


def pattern_of(text: Column) -> Column:
    """The regular expression of a text's entities: the general one, and the words of its titled names. Null where there can't be any.

    Texts without a digit, an @, a form of address and 32 letters of hexadecimal digits can't hold any, which is quicker to see.
    """
    may = text.rlike(r"[0-9@]|[A-Fa-f]{32}")
    titles = FEMALE + MALE + EITHER
    titled = functools.reduce(Column.__or__, (text.contains(x) for x in titles if not any(x != y and x.startswith(y) for y in titles)))
    words = F.array_distinct(F.transform(_names(F.regexp_extract_all(text, F.lit(PARTS["name"]), F.lit(0))), lambda n: n["word"]))
    forms = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, F.initcap(w), F.upper(w)))))
    bare = F.concat(F.lit(f"{ANY}|(?:(?<!\\p{{L}})(?=\\p{{Lu}})(?:"), F.array_join(forms, "|"), F.lit(r")(?!\p{L}))"))
    return F.when(titled, _bind(bare, lambda b: F.when(b.endswith("(?:)(?!\\p{L}))"), F.lit(ANY)).otherwise(b))).when(may, F.lit(ANY))


def entities_in(text: Column, pattern: Column) -> Column:
    """All entities of a text, in order."""
    return F.when(pattern.isNotNull(), F.regexp_extract_all(text, pattern, F.lit(0))).when(text.isNotNull(), F.array().cast("array<string>"))


def units(shown: Column, names: Column) -> Column:
    """What of an entity is replaced for itself: structs of kind, canon and shown. Names have one for each word.

    names: of the same text. A word that it has as a given name is that name wherever it stands alone.
    """

    def words(x: Column) -> Column:
        low = F.lower(x)
        given = F.get(F.filter(names, lambda n: n["given"] & (n["low"] == low)), F.lit(0))
        return F.struct(F.lit("name").alias("kind"), F.concat(low, F.lit("|"), F.when(given.isNotNull(), given["gender"]).otherwise("")).alias("canon"), x.alias("shown"))

    def other(kind: Column) -> Column:
        whole = F.array(F.struct(kind.alias("kind"), canonical(kind, shown).alias("canon"), shown.alias("shown")))
        return F.when(kind == "name", F.transform(F.split(F.regexp_replace(shown, _TITLED, ""), " "), words)).otherwise(whole)

    return _bind(kind_of(shown), other)


def attempts(entities: DataFrame, key: str, at_once: int = 8) -> DataFrame:
    """kind, canon and attempt of distinct entities (kind, canon), such that no surrogate is shared or is an entity itself.

    The first round makes one attempt for each entity. Later rounds, for the few whose surrogate is taken, make several: of the
    entities that want a surrogate the least gets it, and an entity takes the first that it gets.
    """
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entities = durable(entities.distinct(), "pii-entities").repartition(tasks, "kind", "canon")  # few bytes, but much work for each
    kind, canon = F.col("kind"), F.col("canon")
    originals = entities.select("kind", plain(kind, canon).alias("made"))
    settled, waiting, tried = None, entities, F.array(F.lit(0))
    begin = 0
    while True:
        each = waiting.withColumn("attempt", F.explode(tried))
        each = each.withColumn("made", canonical(kind, surrogate(kind, plain(kind, canon), canon, F.col("attempt"), key)))
        each = each.withColumn("made", F.when(kind == "name", F.lower("made")).otherwise(F.col("made")))
        free = each.join(originals, ["kind", "made"], "left_anti")
        if settled is not None:
            free = free.join(settled, ["kind", "made"], "left_anti")
        won = free.groupBy("kind", "made").agg(F.min(F.struct("canon", "attempt")).alias("_w")).select("kind", "made", "_w.*")
        won = durable(won.groupBy("kind", "canon").agg(F.min(F.struct("attempt", "made")).alias("_w")).select("kind", "canon", "_w.*"), "pii-settled")
        settled = won if settled is None else settled.unionByName(won)
        left = durable(waiting.join(won, ["kind", "canon"], "left_anti"), "pii-waiting")
        if left.isEmpty():
            return settled.select("kind", "canon", "attempt")
        begin = 1 if begin == 0 else begin + at_once
        waiting, tried = left, F.sequence(F.lit(begin), F.lit(begin + at_once - 1))


def replace(df: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with surrogates in text, and _n_entities (in place of a column of that name). secret: the key of the hash."""
    hashes = lambda c: (F.xxhash64(c).alias("_h"), F.xxhash64(F.lit("second"), c).alias("_g"))  # noqa: E731  equal texts share their entities

    def scanned(rows: DataFrame) -> DataFrame:
        out = rows.withColumn("_pattern", pattern_of(F.col("_text")))
        return out.withColumn("_found", entities_in(F.col("_text"), F.col("_pattern")))

    names = F.when(F.exists("_found", lambda x: x.rlike(_TITLED)), _names(F.col("_found"))).otherwise(_names(F.array().cast("array<string>")))
    texts = scanned(df.select(df[text].alias("_text")))
    each = F.flatten(F.transform("_found", lambda s: units(s, F.col("_names"))))
    rows = texts.withColumn("_names", names).select(*hashes(F.col("_text")), F.explode(F.transform(each, lambda u: F.struct(u["kind"].alias("kind"), u["canon"].alias("canon")))).alias("_u"))
    rows = durable(rows.select("_h", "_g", "_u.*"), "pii-found")
    further = durable(attempts(rows.select("kind", "canon"), secret).filter("attempt > 0"), "pii-further")
    # a row travels as one struct, so its columns can have any names
    out = scanned(df.select(F.struct(*(df[c] for c in df.columns)).alias("_row"), df[text].alias("_text"))).withColumn("_names", names)
    none = F.array().cast("array<struct<kind:string,canon:string,attempt:int>>")
    if further.isEmpty():
        out = out.withColumn("_tries", none)
    else:
        # few texts hold such an entity; of repeated texts one set is made
        tries = rows.join(further, ["kind", "canon"]).groupBy(F.col("_h").alias("_h2"), F.col("_g").alias("_g2")).agg(F.collect_set(F.struct("kind", "canon", F.col("attempt").cast("int").alias("attempt"))).alias("_tries"))
        out = out.withColumns(dict(zip(("_h", "_g"), hashes(F.col("_text")), strict=True))).join(tries, (F.col("_h") == F.col("_h2")) & (F.col("_g") == F.col("_g2")), "left").withColumn("_tries", F.coalesce("_tries", none))

    def written(shown: Column) -> Column:
        def one(u: Column) -> Column:
            again = F.get(F.filter("_tries", lambda t: (t["kind"] == u["kind"]) & (t["canon"] == u["canon"])), F.lit(0))
            return surrogate(u["kind"], u["shown"], u["canon"], F.coalesce(again["attempt"], F.lit(0)), secret)

        return F.concat(F.regexp_extract(shown, _TITLED, 0), F.array_join(F.transform(units(shown, F.col("_names")), one), " "))

    made = F.transform("_found", written)
    between = F.split("_text", F.col("_pattern"), -1)
    new = F.when(F.size("_found") > 0, F.array_join(F.zip_with(between, F.concat(made, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")).otherwise(F.col("_text"))
    row = F.col("_row")
    return out.select(*(new.alias(c) if c == text else row[c].alias(c) for c in df.columns if c != "_n_entities"), F.greatest(F.size("_found"), F.lit(0)).cast("long").alias("_n_entities"))
