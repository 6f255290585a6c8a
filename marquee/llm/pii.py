"""Personal data replaced by surrogates, in DataFrame operations only.

Mentions are found by one expression over the whole text of documents that a cheap
expression lets through.  A titled name is two entities, a given name of a gender and a
family name, so "Mrs. Anna Schmidt" and "Mrs. Schmidt" keep one family; where a text has a
titled name, its family name alone, or with its given name, is a mention too.

Mentions of one entity (letter case, spaces and punctuation aside) share a canonical
value, whose surrogate is made of a keyed SHA-256 stream and has its type, format, script
and, for given names, gender.  A round of candidates is checked for collisions with each other, with accepted
surrogates and with real values; losers try again, so distinct entities stay distinct.
Only the table of distinct mentions meets the surrogates; documents with mentions are joined with their
own replacements by a digest of the text, and the others are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquee.llm.common import free_name, materialise

#: Rounds of candidates before the rest get a digest for a suffix, which cannot collide.
ROUNDS = 6

_TITLE = r"(?:Mrs?|Ms|Miss|Herrn?|Frau|Monsieur|Madame|Mme|Señora?|Sra?|M(?=\.))\.?"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Types in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}0-9._%+\-])[\p{L}0-9._%+\-]{1,64}+@[\p{L}0-9\-]{1,63}+(?:\.[\p{L}0-9\-]{1,63}+)+",
    "secret": r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_\-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?[^\s\"',;]{6,}+",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "ipv6": rf"(?<![\p{{L}}\d:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}:(?:{_HEX}(?::{_HEX}){{0,4}})?|{_HEX}::{_HEX}(?::{_HEX}){{0,5}})(?![\p{{L}}\d:])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\p{L}\d+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)|(?<![\p{L}\d+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)",
    "card": r"(?<![\p{L}\d])\d(?:[ \-]?\d){12,18}(?!\d)",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])",
    "name": rf"(?<!\p{{L}}){_TITLE} \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?",
}
MENTION = "|".join(PATTERNS.values())
#: Every mention has a match of this.
HINT = r"[0-9@=:]|AKIA|gh[pousr]_|Mr|M[sm.]|Miss|Herr|Frau|Monsieur|Madame|Se.or|Sra?[. ]"
_SECRET = r"^([A-Za-z_\-]+[\"']?\s{0,2}[=:]\s{0,2}[\"']?)(.+)$"
_NAMED = rf"^({_TITLE} )(?:(\p{{L}}+) )?(\p{{L}}+)$"
_MALE = ("mr", "herr", "herrn", "monsieur", "m", "señor", "sr")

#: Given names by gender, and the syllables of family names: fixed values.
GIVEN = {
    "male": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Nils", "Oscar", "Paul"),
    "female": ("Anna", "Berta", "Clara", "Diana", "Elena", "Frida", "Greta", "Helena", "Ida", "Julia", "Karla", "Laura", "Maria", "Nina", "Olga", "Paula"),
}
SYLLABLES = ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "ra", "re", "ro", "sa", "se", "so", "ta", "te", "to", "va")


def kind(mention: Column) -> Column:
    """The first type whose pattern is the whole mention, and a name for what no pattern is: a family name without its title."""
    out = F.lit("name")
    for name, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def canonical(type_: Column, mention: Column) -> Column:
    """The value of a mention that is no name."""
    digits = F.regexp_replace(mention, r"\D", "")
    return (
        F.when(type_.isin("email", "ipv6"), F.lower(mention))
        .when(type_ == "secret", F.regexp_extract(mention, _SECRET, 2))
        .when(type_ == "phone", F.when(F.length(digits) >= 10, F.substring(digits, -10, 10)).otherwise(digits))
        .when(type_.isin("card", "ssn"), digits)
        .when(type_ == "iban", F.regexp_replace(mention, " ", ""))
        .otherwise(mention)
    )


def gender(title: Column) -> Column:
    return F.when(F.lower(F.regexp_replace(title, r"[. ]", "")).isin(*_MALE), "male").otherwise("female")


def stream(key: str, seed: Column, n: Column) -> Column:
    """n keyed numbers below 65,536."""
    blocks = F.transform(F.sequence(F.lit(0), (n / 16).cast("int")), lambda i: F.sha2(F.concat_ws("|", F.lit(key), seed, i.cast("string")), 256))
    # Each digest is cut by itself, as finding a place in one long text would start from its front each time.
    sixteen = F.sequence(F.lit(0), F.lit(15))
    numbers = F.flatten(F.transform(blocks, lambda h: F.transform(sixteen, lambda j: F.conv(h.substr(j * 4 + 1, F.lit(4)), 16, 10).cast("int"))))
    return F.slice(numbers, F.lit(1), F.greatest(n, F.lit(1)))


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def mask(value: Column, numbers: Column) -> Column:
    """Each letter or digit becomes one of its own kind: case, script and punctuation stay."""

    def one(c: Column, x: Column) -> Column:
        of = lambda first, size: _char(F.lit(first) + x % size)
        return (
            F.when(c.rlike("^[0-9]$"), of(48, 10))
            .when(c.rlike("^[A-Z]$"), of(65, 26))
            .when(c.rlike("^[a-z]$"), of(97, 26))
            .when(c.rlike(r"^[\p{IsCyrillic}&&\p{Lu}]$"), of(0x410, 32))
            .when(c.rlike(r"^\p{IsCyrillic}$"), of(0x430, 32))
            .when(c.rlike(r"^[\p{IsGreek}&&\p{Lu}]$"), of(0x391, 17))
            .when(c.rlike(r"^\p{IsGreek}$"), of(0x3B1, 17))
            .when(c.rlike(r"^[\p{IsHan}]$"), of(0x4E00, 2048))
            .when(c.rlike(r"^\p{IsHangul}$"), of(0xAC00, 2048))
            .when(c.rlike(r"^\p{IsHiragana}$"), of(0x3042, 80))
            .when(c.rlike(r"^\p{IsKatakana}$"), of(0x30A2, 80))
            .when(c.rlike(r"^[\p{IsHebrew}&&\p{L}]$"), of(0x5D0, 27))
            .when(c.rlike(r"^[\p{IsArabic}&&\p{L}]$"), of(0x628, 18))
            .when(c.rlike(r"^[\p{IsThai}&&\p{L}]$"), of(0xE01, 46))
            .when(c.rlike(r"^[\p{IsDevanagari}&&\p{L}]$"), of(0x915, 37))
            .when(c.rlike(r"^\p{Lu}$"), of(65, 26))
            .when(c.rlike(r"^\p{L}$"), of(97, 26))
            .otherwise(c)
        )

    return F.array_join(F.zip_with(F.split(value, ""), numbers, one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits as the check digit needs it; a valid number's is a multiple of 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def _check(digits: Column) -> Column:
    """Remainder by 97 of letters and digits, a letter standing for 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def surrogate(type_: Column, value: Column, attempt: int, key: str) -> Column:
    """A candidate for a canonical value; given names are "gender|name", names in small letters."""
    numbers = stream(key, F.concat_ws("|", type_, value, F.lit(str(attempt))), F.length(value) + 16)
    at = lambda i: F.element_at(numbers, i)
    masked = mask(value, numbers)
    domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.substring_index(value, "@", -1)), 256)
    email = F.concat(mask(F.substring_index(value, "@", 1), numbers), F.lit("@"), F.translate(F.substring(domain, 1, 10), "0123456789", "ghijklmnop"), F.lit(".example"))
    ip = F.concat_ws(".", (at(1) % 223 + 1).cast("string"), (at(2) % 256).cast("string"), (at(3) % 256).cast("string"), (at(4) % 254 + 1).cast("string"))
    ipv6 = F.array_join(F.zip_with(F.split(value, ""), numbers, lambda c, x: F.when(c.rlike("[0-9a-f]"), F.lower(F.hex(x % 15 + 1))).otherwise(c)), "")
    open_ = F.concat(F.substring(value, 1, 1), masked.substr(F.lit(2), F.length(value) - 2))
    check = ((10 - _luhn(F.concat(open_, F.lit("0"))) % 10) % 10).cast("string")
    card = F.when(_luhn(value) % 10 == 0, F.concat(open_, check)).otherwise(F.concat(F.substring(value, 1, 1), masked.substr(F.lit(2), F.length(value) - 1)))
    key_ = F.concat(F.substring(value, 1, 4), masked.substr(F.lit(5), F.length(value) - 4))
    account = masked.substr(F.lit(5), F.length(value) - 4)
    two = F.lpad((F.lit(98) - _check(F.concat(account, F.substring(value, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    iban = F.concat(F.substring(value, 1, 2), two, account)
    sex, plain = F.substring_index(value, "|", 1), F.substring_index(value, "|", -1)
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), at(i) % len(names) + 1)
    family = F.concat(*(pick(SYLLABLES, i) for i in range(2, 5 + attempt)))
    first = F.when(sex == "male", pick([n.lower() for n in GIVEN["male"]], 1)).otherwise(pick([n.lower() for n in GIVEN["female"]], 1))
    given = F.concat(first, *(pick(SYLLABLES, i) for i in range(2, 2 + attempt)))
    foreign = plain.rlike(r"[\p{IsCyrillic}\p{IsGreek}\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}\p{IsHebrew}\p{IsArabic}\p{IsThai}\p{IsDevanagari}]")
    family, given = F.when(foreign, masked).otherwise(family), F.concat(sex, F.lit("|"), F.when(foreign, mask(plain, numbers)).otherwise(given))
    own = {"email": email, "ip": ip, "ipv6": ipv6, "card": card, "key": key_, "iban": iban, "family": family, "given": given}
    out = masked
    for name, made in own.items():
        out = F.when(type_ == name, made).otherwise(out)
    hexes = F.array_join(F.transform(F.sequence(F.lit(0), (F.length(value) / 64).cast("int")), lambda i: F.sha2(F.concat_ws("|", F.lit(key), type_, value, F.lit(f"x{attempt}"), i.cast("string")), 256)), "")
    out = F.when((type_ == "secret") & value.rlike("^[0-9a-f]+$"), hexes.substr(F.lit(1), F.length(value))).otherwise(out)
    return out if attempt < ROUNDS else F.concat(out, F.lit("-"), F.sha2(F.concat_ws("|", F.lit(key), type_, value), 256))


def entity_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Distinct (type, value) -> surrogate, distinct within a type and never a real value."""
    entities = materialise(entities)
    pending, accepted = entities, None
    for attempt in range(ROUNDS + 1):
        tried = pending.withColumn("surrogate", surrogate(F.col("type"), F.col("value"), attempt, key))
        first = tried.groupBy("type", "surrogate").agg(F.min("value").alias("value"))
        taken = entities.select("type", F.col("value").alias("surrogate"))
        if accepted is not None:
            taken = taken.unionByName(accepted.select("type", "surrogate"))
        good = materialise(first if attempt == ROUNDS else first.join(taken, ["type", "surrogate"], "left_anti"))
        accepted = good if accepted is None else accepted.unionByName(good)
        pending = materialise(pending.join(good, ["type", "value"], "left_anti"))
        if pending.isEmpty():
            break
    return accepted


def render(type_: Column, mention: Column, new: Column) -> Column:
    """The surrogate in the format of a mention that is no name."""
    chars = F.split(mention, "")
    wanted = F.when(type_.isin("phone", "card", "ssn"), r"[0-9]").otherwise(r"[A-Z0-9]")
    skip = F.greatest(F.length(F.regexp_replace(mention, r"\D", "")) - F.length(new), F.lit(0))
    start = F.struct(F.lit("").alias("out"), F.when(type_ == "phone", -skip).otherwise(F.lit(0)).alias("at"))

    def step(a: Column, c: Column) -> Column:
        hit = F.regexp_like(c, wanted)
        fresh = F.when(hit & (a["at"] >= 0), new.substr(a["at"] + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(a["out"], fresh).alias("out"), F.when(hit, a["at"] + 1).otherwise(a["at"]).alias("at"))

    spaced = F.aggregate(chars, start, step, lambda a: a["out"])
    return (
        F.when(type_.isin("phone", "card", "ssn", "iban"), spaced)
        .when(type_ == "secret", F.concat(F.regexp_extract(mention, _SECRET, 1), new))
        .when((type_ == "ipv6") & (mention == F.upper(mention)), F.upper(new))
        .otherwise(new)
    )


def _cased(word: Column, new: Column) -> Column:
    """A new name as its mention has it: all in capitals or with one."""
    return F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(new)).otherwise(F.initcap(new))


def _bare(names: Column) -> Column:
    """What follows MENTION in the pattern of a text with titled names: the names (given, family) without their titles."""
    bare = F.transform(names, lambda n: F.concat(F.when(n["given"] != "", F.concat(F.lit("(?:"), n["given"], F.lit(" )?"))).otherwise(""), n["family"]))
    return F.concat(F.lit(r"|(?<!\p{L})(?:"), F.array_join(F.array_distinct(bare), "|"), F.lit(r")(?!\p{L})"))


def _part(mention: Column, group: int) -> Column:
    """Title, given or family name of a titled name, or '' where it has none."""
    return F.regexp_extract(mention, _NAMED, group)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The documents with ``text_col`` rewritten, and n_entities (long): the mentions replaced in it.

    ``key`` makes the surrogates: who has it can make them again from guessed values, so it is a secret.
    One row per input row, with all input columns; a column n_entities of the input is
    overwritten.  A null text stays null with 0 entities; an empty or clean text is unchanged.
    The same entity gets the same surrogate in every document and row, whatever the
    partitioning; an empty table gives an empty result.  Texts are read whole.
    """
    column = F.col(f"`{text_col}`")
    text = F.coalesce(column, F.lit(""))
    hinted = text.rlike(HINT)
    found = docs.filter(hinted).select(F.md5(text).alias("digest"), text.alias("text"))
    found = found.withColumn("mentions", F.regexp_extract_all("text", F.lit(MENTION), F.lit(0))).filter(F.size("mentions") > 0)
    titled = F.filter("mentions", lambda m: m.rlike(_NAMED))
    named = F.array_distinct(F.transform(titled, lambda m: F.struct(_part(m, 2).alias("given"), _part(m, 3).alias("family"), gender(_part(m, 1)).alias("gender"))))
    found = found.withColumn("names", named)
    found = found.withColumn("bare", F.when(F.size("names") > 0, _bare(F.col("names"))))
    again = F.regexp_extract_all("text", F.concat(F.lit(MENTION), "bare"), F.lit(0))
    found = found.withColumn("mentions", F.when(F.col("bare").isNull(), F.col("mentions")).otherwise(again))
    found = materialise(found.groupBy("digest").agg(F.first(F.struct("mentions", "names", "bare")).alias("x")).select("digest", "x.*"))

    each = found.select("digest", "names", F.posexplode("mentions").alias("pos", "mention"))
    has_title = F.col("mention").rlike(_NAMED)
    words = F.split("mention", " ")
    own = F.get(F.filter("names", lambda n: (n["family"] == F.get(words, 1)) & (n["given"] == F.get(words, 0))), 0)["gender"]
    sex = F.when(has_title, gender(_part(F.col("mention"), 1))).otherwise(F.when(F.size("names") > 0, own))
    each = materialise(each.select("digest", "pos", "mention", F.coalesce(sex, F.lit("")).alias("sex")))

    mentions = each.select("mention", "sex").distinct().withColumn("type", kind(F.col("mention")))
    is_name = F.col("type") == "name"
    title, family = F.when(is_name, _part(F.col("mention"), 1)), F.when(is_name, F.substring_index("mention", " ", -1))
    middle = F.rtrim(F.when(is_name, F.expr("substr(mention, length(title) + 1, length(mention) - length(title) - length(family))")))
    mentions = mentions.withColumn("title", title).withColumn("family", family).withColumn("given", middle)
    person = F.when(F.col("given") != "", F.concat_ws("|", "sex", F.lower("given")))
    mentions = materialise(mentions.withColumn("person", person).withColumn("value", F.when(is_name, F.lower("family")).otherwise(canonical(F.col("type"), F.col("mention")))))

    values = mentions.select(F.when(is_name, "family").otherwise(F.col("type")).alias("type"), "value")
    values = values.unionByName(mentions.filter("person IS NOT NULL").select(F.lit("given").alias("type"), F.col("person").alias("value")))
    known = materialise(entity_surrogates(values.distinct(), key))
    drawn = mentions.withColumn("of", F.when(is_name, "family").otherwise(F.col("type")))
    drawn = drawn.join(known.select(F.col("type").alias("of"), "value", "surrogate"), ["of", "value"])
    people = known.filter("type = 'given'").select(F.col("value").alias("person"), F.substring_index("surrogate", "|", -1).alias("called"))
    drawn = drawn.join(people, "person", "left")
    called = F.when(F.col("called").isNotNull(), F.concat(_cased(F.col("given"), F.col("called")), F.lit(" "))).otherwise("")
    name = F.concat("title", called, _cased(F.col("family"), F.col("surrogate")))
    drawn = drawn.select("mention", "sex", F.when(is_name, name).otherwise(render(F.col("type"), F.col("mention"), F.col("surrogate"))).alias("new"))

    replaced = each.join(drawn, ["mention", "sex"]).groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("x"))
    replaced = replaced.join(found.select("digest", "bare"), "digest")
    digest, new, bare = free_name(docs, "_digest"), free_name(docs, "_new"), free_name(docs, "_bare")
    replaced = replaced.select(F.col("digest").alias(digest), F.transform("x", lambda x: x["new"]).alias(new), F.col("bare").alias(bare))
    replaced = materialise(replaced)  # so that Spark can split the join's tasks of texts with very many copies

    joined = docs.filter(hinted).withColumn(digest, F.md5(text)).join(replaced, digest, "left")
    pieces = F.when(F.col(bare).isNull(), F.split(column, MENTION, -1)).otherwise(F.split(column, F.concat(F.lit(MENTION), bare), F.lit(-1)))
    rewritten = F.array_join(F.zip_with(pieces, F.col(new), lambda piece, x: F.concat(piece, F.coalesce(x, F.lit("")))), "")
    joined = joined.withColumns({text_col: F.when(F.col(new).isNull(), column).otherwise(rewritten), "n_entities": F.coalesce(F.size(new), F.lit(0)).cast("long")}).drop(digest, new, bare)
    return joined.unionByName(docs.filter(~hinted).withColumn("n_entities", F.lit(0).cast("long")))
