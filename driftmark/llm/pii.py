"""Personal data and secrets replaced by surrogates, in DataFrame functions alone.

Entities are found by patterns; card numbers must pass the Luhn test and IBANs their checksum.  Each entity has a kind
and a canonical form (an address in lower case, a number's digits), so one entity written in different ways is one
entity.  A telephone number without country code is the same as the one with a country code that ends in it, where the
corpus has exactly one.  A name given with a title somewhere in a document is found there without it too, in any case.
Surrogates are drawn from a keyed hash of kind and canonical form and keep the format: letters stay letters, digits
digits, hexadecimal stays so; card numbers pass the Luhn test; addresses of the internet fall in the reserved block
240.0.0.0/4; mail stays in reserved domains; telephone numbers keep their country code and the exchange 555; names keep
script, case and gender, which a title gives.

Collision checks: over the whole corpus no two entities of a kind share a surrogate (telephone numbers not even their
national part), and no surrogate is an entity that occurs.  Losers draw again; after ATTEMPTS draws a surrogate gets a
suffix that makes it unique.  So distinct entities stay distinct and equal ones equal, in all documents.

Null and empty texts and texts without entities are returned as they are.  Rows without doc_id and rows that repeat one
are texts like others.  Extra columns stay, whatever their names.  Texts may be of any length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import Workspace

ATTEMPTS = 8
#: Titles by the gender they give.
TITLES = {"f": ("Mrs.", "Mrs", "Ms.", "Ms", "Frau", "Madame", "Mme", "Señora", "Sra.", "госпожа", "г-жа"), "m": ("Mr.", "Mr", "Herr", "Monsieur", "Señor", "Sr.", "господин", "г-н"), "n": ("Dr.", "Prof.")}
#: Syllables and the endings of given names by script and gender.
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ha ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa se so ta te to va ve".split(), "cyrillic": "ба бе бо да де до га го ка ке ко ла ле ло ма ме мо на не но па пе по ра ре ро са се со та те то ва ве".split()}
ENDINGS = {"latin": {"f": "na", "m": "rk", "n": "n", "s": "son"}, "cyrillic": {"f": "на", "m": "рк", "n": "н", "s": "ов"}}

_TITLE = "|".join(t.replace(".", r"\.") for ts in TITLES.values() for t in ts)
# a look at the first letter spares most positions the alternatives
_TITLE_START = "[" + "".join(sorted({t[0] for ts in TITLES.values() for t in ts})) + "]"
_SECRET_CUE = r"(?=[AaPpSsTt])(?i:password|passwd|secret|token|api_key|apikey|access_key)\s{0,3}[=:]\s{0,3}[\"']?"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Patterns in order of precedence.
PATTERNS = (
    ("secret", rf"{_SECRET_CUE}[^\s\"']{{6,}}"),
    ("access", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("phone", r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])"),
    ("ip", rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"),
    ("card", r"(?<![0-9])(?<![0-9]-)(?:[3-6][0-9]{12,18}|[3-6][0-9]{3}(?:[ -][0-9]{4}){3}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})(?!-?[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("name", rf"(?={_TITLE_START})(?<![\p{{L}}\p{{N}}])(?:{_TITLE}) \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: Every entity has one of these characters, the start of an access key or a title, which is much quicker to look for than ANY.
HINT, TITLE_HINT = "[0-9@=:]|AKIA", rf"(?={_TITLE_START})(?:{_TITLE}) \p{{Lu}}"
DIGIT_KINDS = ("phone", "card", "ssn")
_PART = "array<struct<kind:string,canon:string>>"
_NAME_HEAD = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE}) (?=\p{{Lu}})"


def has_entity(text: str) -> Column:
    """Whether a text holds an entity; false for null."""
    hint = F.regexp_like(F.col(text), F.lit(HINT)) | F.regexp_like(F.col(text), F.lit(TITLE_HINT))
    return F.coalesce(hint & F.regexp_like(F.col(text), F.lit(ANY)), F.lit(False))


def _kind(entity: Column) -> Column:
    """The first kind whose pattern the whole entity has; ``bare`` is a name without its title."""
    bare = F.when(F.regexp_like(entity, F.lit(r"\A\p{L}+\z")), "bare").otherwise("ssn")
    return reduce(lambda rest, kp: F.when(F.regexp_like(entity, F.lit(rf"\A(?:{kp[1]})\z")), F.lit(kp[0])).otherwise(rest), reversed(PATTERNS), bare)


def _valid_card(digits: Column) -> Column:
    return _luhn(digits) == digits


def _valid_iban(iban: Column) -> Column:
    """Whether its letters as two-digit numbers, its first four characters last, make a number that is 1 modulo 97."""
    chars = F.filter(F.split(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4)), ""), lambda c: c != "")
    values = F.transform(chars, lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _prefix(entity: Column) -> Column:
    """What of an entity stays: a secret's cue, a name's title."""
    return F.get(F.regexp_extract_all(entity, F.lit(rf"\A(?:{_SECRET_CUE}|(?:{_TITLE}) )"), F.lit(0)), F.lit(0))


def _parts(entity: Column, named: Column) -> Column:
    """The entity as (kind, canonical form), none where its check fails.

    A full name is two of them, so that a family name alone stays the same; ``named`` are the names that the text gives
    with a title, by which a bare one is known.
    """
    kind, digits = _kind(entity), F.regexp_replace(entity, "[^0-9]", "")
    one = lambda k, c: F.array(F.struct(k.alias("kind"), c.alias("canon")))
    none = F.array().cast(_PART)
    iban = F.regexp_replace(entity, " ", "")
    secret = F.regexp_replace(entity, rf"\A{_SECRET_CUE}", "")
    return (
        F.when(kind == "name", _name_parts(entity))
        .when(kind == "bare", F.slice(F.filter(named, lambda n: n["canon"] == F.lower(entity)), 1, 1))
        .when(kind == "phone", one(kind, F.concat(F.when(entity.startswith("+"), "+").otherwise(""), digits)))
        .when(kind == "card", F.when(_valid_card(digits), one(kind, digits)).otherwise(none))
        .when(kind == "iban", F.when(_valid_iban(iban), one(kind, iban)).otherwise(none))
        .when(kind == "ssn", one(kind, digits))
        .when(kind == "email", one(kind, F.lower(entity)))
        .when(kind == "secret", one(kind, secret))
        .otherwise(one(kind, entity))
    )


def _name_parts(entity: Column) -> Column:
    """A titled name as its given name, if it has one, by gender, and its family name."""
    names = F.split(F.lower(F.regexp_replace(entity, rf"\A(?:{_TITLE}) ", "")), " ")
    title = F.regexp_extract(entity, rf"\A({_TITLE}) ", 1)
    gender = F.when(title.isin(*TITLES["f"]), "f").when(title.isin(*TITLES["m"]), "m").otherwise("n")
    family = F.struct(F.lit("name-s").alias("kind"), F.element_at(names, -1).alias("canon"))
    given = F.struct(F.concat(F.lit("name-"), gender).alias("kind"), F.get(names, F.lit(0)).alias("canon"))
    return F.when(F.size(names) > 1, F.array(given, family)).otherwise(F.array(family))


def _byte(stream: Column, k: Column) -> Column:
    """Byte k (from 0) of a stream of hexadecimal digits."""
    return F.conv(F.substring(stream, k * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letters(value: Column, stream: Column, keep: Column) -> Column:
    """Each character drawn anew within its class, but for the first ``keep``; hexadecimal values stay so."""
    hexadecimal = F.regexp_like(value, F.lit(r"\A(?=.*[a-f])[0-9a-f]{8,}\z"))
    chars = F.filter(F.split(value, ""), lambda c: c != "")

    def drawn(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        pick = lambda alphabet: F.substring(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1))
        return F.when(i < keep, c).when(hexadecimal, pick("0123456789abcdef")).when(c.between("0", "9"), pick("0123456789")).when(c.between("a", "z"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.between("A", "Z"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(F.regexp_like(c, F.lit(r"\p{L}")), pick("abcdefghijklmnopqrstuvwxyz")).otherwise(c)

    return F.concat_ws("", F.transform(chars, drawn))


def _luhn(digits: Column) -> Column:
    """The digits with their last one set so that the Luhn sum is a multiple of ten."""
    n = F.length(digits)
    body = F.substring(digits, F.lit(1), n - 1)
    values = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c, i: F.when((n - 1 - i) % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    total = F.aggregate(values, F.lit(0), lambda a, x: a + x)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def _name(kind: Column, canon: Column, stream: Column) -> Column:
    def script(s: str) -> Column:
        own = F.array(*[F.lit(x) for x in SYLLABLES[s]])
        ending = reduce(lambda rest, g: F.when(kind == f"name-{g[0]}", F.lit(g[1])).otherwise(rest), ENDINGS[s].items(), F.lit(""))
        return F.concat(*[F.element_at(own, _byte(stream, F.lit(k)) % len(SYLLABLES[s]) + 1) for k in range(3)], ending)

    return F.when(F.regexp_like(canon, F.lit(r"\p{IsCyrillic}")), script("cyrillic")).otherwise(script("latin"))


def _national(kind: Column, canon: Column) -> Column:
    """A telephone number's last ten digits; another entity as it is."""
    return F.when(kind == "phone", F.right(F.regexp_replace(canon, r"\+", ""), F.lit(10))).otherwise(canon)


def surrogate(kind: Column, canon: Column, attempt: int, key: str) -> Column:
    """A canonical surrogate of the same kind and format; of a telephone number its national part."""
    seed = F.concat_ws("|", F.lit(key), kind, canon, F.lit(str(attempt)))
    canon = _national(kind, canon)
    stream = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.floor(F.length(canon) / 64).cast("int")), lambda k: F.sha2(F.concat_ws("|", seed, k.cast("string")), 512)))
    drawn = _letters(canon, stream, F.lit(0))
    n = F.length(canon)
    area = F.concat(((_byte(stream, F.lit(60)) % 8) + 2).cast("string"), F.substring(drawn, 2, 2))
    exchange = F.when((F.substring(canon, 4, 3) == "555") & (attempt < ATTEMPTS // 2), F.lit("555")).otherwise(F.substring(drawn, 4, 3))
    phone = F.when(n == 10, F.concat(area, exchange, F.substring(drawn, 7, 4))).otherwise(drawn)
    ip = F.concat_ws(".", (_byte(stream, F.lit(0)) % 16 + 240).cast("string"), _byte(stream, F.lit(1)).cast("string"), _byte(stream, F.lit(2)).cast("string"), (_byte(stream, F.lit(3)) % 254 + 1).cast("string"))
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    email = F.concat(_letters(local, stream, F.lit(0)), F.lit("@"), F.when(F.regexp_like(domain, F.lit(r"(?:\A|\.)example\.(?:com|net|org)\z")), domain).otherwise(F.lit("example.org")))
    value = F.when(kind == "card", _luhn(F.concat(F.substring(canon, 1, 1), F.substring(drawn, F.lit(2), n)))).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "email", email).when(kind == "access", _letters(canon, stream, F.lit(4))).when(kind == "iban", _letters(canon, stream, F.lit(2))).when(kind.startswith("name-"), _name(kind, canon, stream)).otherwise(drawn)
    if attempt < ATTEMPTS:
        return value
    mark = F.sha2(seed, 256)
    digits = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: (_byte(mark, k) % 10).cast("string")))
    return F.when(kind.isin(*DIGIT_KINDS), F.concat(value, digits)).when(kind == "email", F.concat(F.substring(mark, 1, 16), value)).otherwise(F.concat(value, F.substring(mark, 1, 16)))


def aliases(entities: DataFrame) -> DataFrame:
    """(kind, canon, whole): for national telephone numbers the one with a country code that ends in them, where there is just one."""
    phones = entities.filter("kind = 'phone'").withColumn("last", _national(F.col("kind"), F.col("canon")))
    whole = phones.filter("canon like '+%'").groupBy("last").agg(F.count("*").alias("n"), F.min("canon").alias("whole")).filter("n = 1")
    return phones.filter("canon not like '+%'").join(whole, "last").select("kind", "canon", "whole")


def surrogates(ws: Workspace, entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) for distinct entities (kind, canon), without collisions."""
    parts = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    same = ws.keep(aliases(entities), "aliases")
    own = ws.keep(entities.join(same.select("kind", "canon"), ["kind", "canon"], "left_anti"), "own")
    occurs = own.select("kind", _national(F.col("kind"), F.col("canon")).alias("surrogate"))
    rest, done = own, []
    for attempt in range(ATTEMPTS + 1):
        dealt = rest.repartition(parts, "kind", "canon")  # few bytes an entity, but long expressions
        drawn = dealt.select("kind", "canon", surrogate(F.col("kind"), F.col("canon"), attempt, key).alias("surrogate"))
        taken = reduce(DataFrame.union, [occurs, *[d.select("kind", "surrogate") for d in done]])
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti") if attempt < ATTEMPTS else drawn
        won = ws.keep(free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).select("kind", "canon", "surrogate"), f"won-{attempt}")
        done.append(won)
        rest = ws.keep(rest.join(won, ["kind", "canon"], "left_anti"), f"lost-{attempt}")
        if rest.isEmpty():
            break
    made = reduce(DataFrame.union, done)
    more = same.join(made.withColumnRenamed("canon", "whole"), ["kind", "whole"]).select("kind", "canon", "surrogate")
    return ws.keep(made.union(more), "surrogates")


def _placed(surface: Column, digits: Column) -> Column:
    """The surface with its digits replaced in order; digits beyond the surface's are appended."""
    walked = F.aggregate(F.filter(F.split(surface, ""), lambda c: c != ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), lambda a, c: F.struct(F.concat(a["s"], F.when(c.between("0", "9"), F.substring(digits, a["k"], F.lit(1))).otherwise(c)).alias("s"), (a["k"] + c.between("0", "9").cast("int")).alias("k")))
    return F.concat(walked["s"], F.substring(digits, walked["k"], F.length(digits)))


def _cased(name: Column, surface: Column) -> Column:
    """A name in the case of what it replaces."""
    return F.when(F.upper(surface) == surface, F.upper(name)).when(F.lower(surface) == surface, name).otherwise(F.initcap(name))


def _written(entity: Column, parts: Column, made: Column) -> Column:
    """The surrogate in the entity's format; the entity itself where it has no parts."""
    kind, head = F.get(parts, F.lit(0))["kind"], F.coalesce(_prefix(entity), F.lit(""))
    digits = F.regexp_replace(entity, "[^0-9]", "")
    country = F.when(kind == "phone", F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 10, F.lit(0)))).otherwise(F.lit(""))
    words = F.split(F.substring(entity, F.length(head) + 1, F.length(entity)), " ")
    name = F.concat(head, F.concat_ws(" ", F.transform(made, lambda m, i: _cased(m, F.get(words, i)))))
    return (
        F.when(F.size(parts) == 0, entity)
        .when(kind.isin(*DIGIT_KINDS), _placed(entity, F.concat(country, F.get(made, F.lit(0)))))
        .when(kind.startswith("name-"), name)
        .when(kind == "secret", F.concat(head, F.get(made, F.lit(0))))
        .otherwise(F.get(made, F.lit(0)))
    )


def replace(documents: DataFrame, key: str, text: str = "text", chars: str | None = None, marked: str | None = None) -> DataFrame:
    """documents with the same columns and each entity in ``text`` replaced; ``key`` is the owner's secret.

    ``chars`` names a column of text lengths to renew, ``marked`` a new column that says whether a text was changed.
    """
    spark = documents.sparkSession
    ws = Workspace(spark, "pii")
    own = "__pii"
    while any(c.startswith(own) for c in documents.columns):
        own += "_"
    row, between, found, named, parts, made = (f"{own}_{n}" for n in ("row", "between", "found", "named", "parts", "made"))
    has = has_entity(text)
    # names that the text gives with a title, and a pattern that finds them without it too
    titled = F.when(F.regexp_like(F.col(text), F.lit(TITLE_HINT)), F.regexp_extract_all(F.col(text), F.lit(PATTERNS[-1][1]), F.lit(0)))
    names = F.array_distinct(F.flatten(F.transform(F.coalesce(titled, F.array().cast("array<string>")), _name_parts)))
    bare = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?iu:"), F.concat_ws("|", F.transform(F.col(named), lambda n: n["canon"])), F.lit(r")(?![\p{L}\p{N}])"))
    pattern = F.when(F.size(named) > 0, bare).otherwise(F.lit(ANY))
    split = documents.filter(has).select("*", F.monotonically_increasing_id().alias(row), names.alias(named))
    split = split.select("*", F.split(F.col(text), pattern, -1).alias(between), F.regexp_extract_all(F.col(text), pattern, F.lit(0)).alias(found))
    held = ws.keep(split.drop(text).withColumn(parts, F.transform(found, lambda e: _parts(e, F.col(named)))), "held")
    flat = held.select(row, F.posexplode(parts).alias("e", "parts")).select(row, "e", F.posexplode("parts").alias("p", "part"))
    flat = flat.select(row, "e", "p", "part.kind", "part.canon")
    entities = ws.keep(flat.select("kind", "canon").distinct(), "entities")
    each = flat.join(surrogates(ws, entities, key), ["kind", "canon"])
    drawn = each.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("e", "p", "surrogate"))).alias(made))
    joined = held.join(drawn, row, "left").withColumn(made, F.coalesce(made, F.array().cast("array<struct<e:int,p:int,surrogate:string>>")))
    of = lambda i: F.transform(F.filter(made, lambda m: m["e"] == i), lambda m: m["surrogate"])
    pieces = F.transform(found, lambda x, i: F.concat(_written(x, F.get(parts, i), of(i)), F.get(between, i + 1)))
    done = joined.withColumn(text, F.concat_ws("", F.get(between, F.lit(0)), F.concat_ws("", pieces)))
    if chars:
        done = done.withColumn(chars, F.length(text).cast(documents.schema[chars].dataType))
    if marked:
        done = done.withColumn(marked, F.exists(parts, lambda p: F.size(p) > 0))
    rest = documents.filter(~has)
    rest = rest.withColumn(marked, F.lit(False)) if marked else rest
    return rest.unionByName(done.select(*rest.columns))


def anonymise(documents: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, replaced) for every row of documents (doc_id, text): the text with surrogates, and whether it changed."""
    return replace(documents.select("doc_id", "text"), key, marked="replaced")
