"""Operator 10 [native]: PII replaced by keyed, type-consistent surrogates.

* Detection: one pattern per kind, all in one alternation over the whole text
  (e-mail, IPv4 and IPv6, IBAN, social security and phone numbers, card-like numbers, cloud
  and service keys, hex secrets, password assignments, names after a title). A quoted
  secret goes to its own quote.
* A canonical form per kind (digits of a number, lower-cased e-mail, name or hex; of a name
  the gender of its title, too) keeps
  coreference: every spelling of an entity gets the same surrogate, written in the
  spelling's own format (separators, case, title).
* The surrogate is derived from a keyed SHA-512 of kind, canonical form and attempt:
  digits stay digits, letters stay letters, hex stays hex (of any length and case), card numbers stay
  Luhn-valid if they were, IPv4 parts stay in range, names follow the title's gender
  and the script of the name (Latin, Greek or Cyrillic).
* Collision checks: a surrogate that another entity of its kind has, or that is
  itself an entity of the corpus, is derived anew with the next attempt until
  all are distinct.

Only DataFrame functions. Texts without entities pass in the scan; the others are
written once and joined by row to their replacements.

Defined cases: null and empty texts pass unchanged; repeated rows are replaced
alike; other columns are carried through; an empty table gives an empty result. An
exhausted surrogate space stops the run instead of giving two entities one name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

NAME = r"\p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)*+"
MALE = r"(?:Mr|Mister|Sir|Herr|Monsieur|Señor|Signor|Κύριος|Господин)"
FEMALE = r"(?:Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mademoiselle|Señora|Señorita|Signora|Κυρία|Госпожа)"
NEUTRAL = r"(?:Dr|Prof|Professor)"
TITLE = rf"(?:{MALE}|{FEMALE}|{NEUTRAL})\.?"
KEYWORD = r"(?i:\b(?:password|passwd|pwd|secret|api_?key))[\"']?\s?[=:]\s?"
KEY_PREFIX = "^(?:AKIA|ASIA|[spr]k_(?:live|test)_|gh[pousr]_|xox[abprs]-)"
HEX4 = "[0-9A-Fa-f]{1,4}"
#: kind -> pattern; the first that matches at a place wins.
KINDS = {
    "email": r"(?<![\p{L}\p{N}_.%+\-])[\p{L}\p{N}_.%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)++(?<=[.\-]\p{L}{2,24})",
    "password": KEYWORD + r"(?:\"[^\"\r\n]{4,}\"|'[^'\r\n]{4,}'|[^\s\"',;]{4,})",
    "cloud_key": r"\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}|[spr]k_(?:live|test)_[0-9A-Za-z]{16,}+|gh[pousr]_[0-9A-Za-z]{30,}+|xox[abprs]-[0-9A-Za-z\-]{10,}+)\b",
    "hex_secret": r"\b[0-9a-fA-F]{32,}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ipv6": rf"(?<![\w:.])(?=[0-9A-Fa-f:]*+(?<=[0-9A-Fa-f:]))(?=[A-Fa-f:]*+\d)(?:(?:{HEX4}:){{7}}{HEX4}|(?:{HEX4}:){{1,6}}(?::{HEX4}){{1,6}}|::(?:{HEX4}:){{0,6}}{HEX4}|(?:{HEX4}:){{1,7}}:)(?![\w:])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\d\-])\d(?:[ \-]?\d){12,}+(?![\d\-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .\-]?\d{3,4}[ .\-]\d{3,4}(?:[ .\-]\d{2,4})?(?!\w)|(?<!\w)\+\d{8,15}(?!\d)|(?<=(?i:phone|tel|call|mobile|cell|fax|dial)[:.=# ]{1,3})\d{10,11}(?![\w.])",
    "name": rf"(?<!\p{{L}}){TITLE} {NAME}(?: {NAME})*+",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: What any entity has; a cheap first look.
HINT = rf"[@\d]|(?i:password|passwd|pwd|secret|api_?key)|AKIA|ASIA|[spr]k_(?:live|test)_|gh[pousr]_|xox[abprs]-|[0-9a-fA-F]{{32}}|{TITLE} \p{{Lu}}"
NUMBERS = ("ssn", "card", "phone")
ATTEMPTS = 60
#: Given names by script and gender; surnames are made of syllables.
GIVEN = {
    "latin": {"m": "Adam Bruno Carl David Emil Felix Gustav Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul".split(),
              "f": "Anna Berta Clara Dora Emma Frida Greta Helena Ida Julia Karin Laura Maria Nora Olga Paula".split()},
    "greek": {"m": "Αλέξης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σπύρος Τάσος".split(),
              "f": "Άννα Βασιλική Ελένη Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα".split()},
    "cyrillic": {"m": "Андрей Борис Виктор Денис Егор Захар Игорь Кирилл".split(),
                 "f": "Анна Вера Дарья Елена Жанна Зоя Ирина Ксения".split()},
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fo ga ge go ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te".split(),
    "greek": "βα βε βο γα γε δα δε δο κα κε κο λα λε λο μα με".split(),
    "cyrillic": "ба бе бо ва ве во да де до ка ке ко ла ле ло ма".split(),
}


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D+", "")


def byte(blob: Column, i: Column) -> Column:
    """Byte ``i`` (of 192) of the hex text ``blob`` as a number."""
    return F.conv(F.substring(blob, (i % 192) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def blob(key: str, *parts: Column) -> Column:
    """192 keyed bytes as hex."""
    return F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(str(b)), *parts), 512) for b in range(3)])


def typed(entities: DataFrame) -> DataFrame:
    """Adds kind, title (of a name) and canon to the distinct matches."""
    kind = F.coalesce(*[F.when(F.col("match").rlike(rf"^(?:{p})$"), k) for k, p in KINDS.items()], F.lit("phone"))
    df = entities.withColumn("kind", kind)
    parts = F.regexp_extract("match", r"^(\S+ )(.*)$", 1), F.regexp_extract("match", r"^(\S+ )(.*)$", 2)
    lead = F.regexp_extract("match", f"^{KEYWORD}[\"']?", 0)
    df = df.withColumn("title", F.when(F.col("kind") == "name", parts[0]).when(F.col("kind") == "password", lead).otherwise(""))
    # A quoted secret ends at its own quote, which stays.
    df = df.withColumn("tail", F.when((F.col("kind") == "password") & F.col("title").rlike("[\"']$"), F.substring("match", -1, 1)).otherwise(""))
    rest = F.substring("match", F.length("title") + 1, F.length("match") - F.length("title") - F.length("tail"))
    canon = (F.when(F.col("kind").isin(*NUMBERS), F.when((F.col("kind") == "phone") & (F.length(digits(rest)) > 10),
                                                         F.expr("right(regexp_replace(match, '\\\\D+', ''), 10)")).otherwise(digits(rest)))
             .when(F.col("kind").isin("email", "name", "hex_secret", "ipv6"), F.lower(rest))
             .when(F.col("kind") == "iban", F.replace(rest, F.lit(" "), F.lit(""))).otherwise(rest))
    gender = (F.when(F.col("title").rlike(rf"^{MALE}\b"), "m").when(F.col("title").rlike(rf"^{FEMALE}\b"), "f").otherwise(""))
    script = F.when(rest.rlike(r"\p{IsGreek}"), "greek").when(rest.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    is_name = F.col("kind") == "name"
    df = (df.withColumn("rest", rest).withColumn("canon", canon).withColumn("gender", F.when(is_name, gender).otherwise(""))
          .withColumn("script", F.when(is_name, script)))
    # Two genders of a name are two persons; a neutral title joins the only gender there is.
    known = df.filter("gender <> ''").groupBy("canon").agg(F.min("gender").alias("g1"), F.max("gender").alias("g2"))
    only = is_name & (F.col("gender") == "") & (F.col("g1") == F.col("g2"))
    return df.join(known, "canon", "left").withColumn("gender", F.when(only, F.col("g1")).otherwise(F.col("gender"))).drop("g1", "g2")


def luhn(number: Column) -> Column:
    """Luhn sum of a digit text modulo 10."""
    ds = F.transform(F.reverse(F.split(number, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(ds, F.lit(0), lambda s, x: s + x) % 10


def pick(words: list[str], n: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), n % len(words))


def derive(df: DataFrame, key: str) -> DataFrame:
    """Sets ``surrogate`` (canonical form) from kind, canon and attempt."""
    df = df.withColumn("__b", blob(key, F.col("kind"), F.col("canon"), F.col("gender"), F.col("attempt").cast("string")))
    b, canon, kind = F.col("__b"), F.col("canon"), F.col("kind")

    def letters(keep_from: Column | int = 0) -> Column:
        def one(c, i):
            n = byte(b, i)
            put = lambda alphabet: F.substring(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))
            fixed = (i < keep_from) | ((kind == "email") & (i > F.length(canon) - 1 - F.length(F.regexp_extract(canon, r"\.\p{L}+$", 0))))
            return (F.when(fixed, c).when(kind.isin("hex_secret", "ipv6") & c.rlike("[0-9a-f]"), put("0123456789abcdef"))
                    .when(c.rlike("[0-9]"), put("0123456789")).when(c.rlike("[A-Z]"), put("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                    .when(c.rlike(r"\p{L}"), put("abcdefghijklmnopqrstuvwxyz")).otherwise(c))
        return F.array_join(F.transform(F.split(canon, ""), one), "")

    numbers = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(
        i == 0, (byte(b, i) % 8 + 2).cast("string")).otherwise((byte(b, i) % 10).cast("string"))), "")
    stem = F.substring(numbers, F.lit(1), F.length(numbers) - 1)
    card = F.when(luhn(canon) == 0, F.concat(stem, ((10 - luhn(F.concat(stem, F.lit("0")))) % 10).cast("string"))).otherwise(numbers)
    ip = F.concat_ws(".", *[(byte(b, F.lit(i)) % 254 + 1).cast("string") for i in range(4)])

    def person(script: str) -> Column:
        given = GIVEN[script]
        sex = F.when(F.col("gender") == "", F.when(byte(b, F.lit(0)) % 2 == 0, "m").otherwise("f")).otherwise(F.col("gender"))
        first = F.when(sex == "m", pick(given["m"], byte(b, F.lit(1)))).otherwise(pick(given["f"], byte(b, F.lit(1))))
        last = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2) + F.floor(F.col("attempt") / 4).cast("int")),
                                        lambda i: pick(SYLLABLES[script], byte(b, i + 2))), "")
        return F.lower(F.when(canon.contains(" "), F.concat(first, F.lit(" "), last)).otherwise(last))

    name = F.when(F.col("script") == "greek", person("greek")).when(F.col("script") == "cyrillic", person("cyrillic")).otherwise(person("latin"))
    made = (F.when(kind == "card", card).when(kind.isin(*NUMBERS), numbers).when(kind == "ip", ip).when(kind == "name", name)
            .when(kind == "cloud_key", letters(F.length(F.regexp_extract(canon, KEY_PREFIX, 0)))).when(kind == "iban", letters(2)).otherwise(letters()))
    return df.withColumn("surrogate", made).drop("__b")


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, gender, script, surrogate): one row per entity, all distinct within a kind."""
    todo = entities.groupBy("kind", "canon", "gender").agg(F.min("script").alias("script"))
    todo = keep(todo, "pii-entities")
    real = todo.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real")).distinct()
    done = None
    for attempt in range(ATTEMPTS):
        tried = derive(todo.withColumn("attempt", F.lit(attempt)), key).drop("attempt").withColumn("new", F.lit(1))
        both = tried if done is None else tried.unionByName(done.withColumn("new", F.lit(0)))
        first = both.groupBy("kind", "surrogate").agg(F.min(F.struct("new", "canon", "gender")).alias("first"))
        both = (keep(both, "pii-tried").join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
                .withColumn("ok", (F.col("first.canon") == F.col("canon")) & (F.col("first.gender") == F.col("gender")) & F.col("real").isNull()))
        both = keep(both.select("kind", "canon", "gender", "script", "surrogate", "ok"), "pii-checked")
        done = both.filter("ok").drop("ok")
        todo = both.filter("not ok").drop("ok", "surrogate")
        if todo.isEmpty():
            return done
    raise RuntimeError("no distinct surrogates left for some kind of entity")


def written(mapping: DataFrame) -> DataFrame:
    """(match, put): each surrogate in the format of the spelling it replaces."""
    s, rest, kind = F.col("surrogate"), F.col("rest"), F.col("kind")
    chars = F.split(rest, "")
    # The k-th digit (of a phone number's last ten) takes the surrogate's k-th digit.
    skip = F.length(digits(rest)) - F.length(s)
    place = lambda i: F.length(digits(F.substring(rest, F.lit(1), i + 1))) - skip
    number = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]") & (place(i) > 0), F.substring(s, place(i), F.lit(1)))
                                      .otherwise(c)), "")
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(
        s, F.length(F.replace(F.substring(rest, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    cased = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"\p{Lu}"), F.upper(F.substring(s, i + 1, F.lit(1))))
                                     .otherwise(F.substring(s, i + 1, F.lit(1)))), "")
    name = F.when(rest == F.upper(rest), F.upper(s)).otherwise(F.initcap(s))
    # Hex of one case stays of that case; in mixed hex capitals stand where they stood.
    hexed = F.when(rest == F.lower(rest), s).when(rest == F.upper(rest), F.upper(s)).otherwise(F.array_join(
        F.zip_with(chars, F.split(s, ""), lambda c, x: F.when(c.rlike("[A-F]"), F.upper(x)).otherwise(x)), ""))
    put = (F.when(kind.isin(*NUMBERS), number).when(kind.isin("hex_secret", "ipv6"), hexed).when(kind == "iban", spaced).when(kind == "email", cased)
           .when(kind == "name", name).otherwise(s))
    return mapping.select("match", "kind", F.concat("title", put, "tail").alias("put"))


def replace_pii(docs: DataFrame, key: str = "surrogate-key") -> DataFrame:
    """``docs`` with replaced ``text`` and a column ``__pii``: the kinds found, in order."""
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    found = F.coalesce(found, F.array().cast("array<string>"))
    marked = docs.withColumn("__found", found)
    clean = (marked.filter(F.size("__found") == 0).withColumn("__pii", F.array().cast("array<string>")).drop("__found"))
    hit = keep(marked.filter(F.size("__found") > 0).withColumn("__uid", F.monotonically_increasing_id()), "pii-texts")
    places = hit.select("__uid", F.posexplode("__found").alias("pos", "match"))
    entities = typed(places.select("match").distinct())
    entities = keep(entities, "pii-matches")
    mapping = keep(written(entities.drop("script").join(
        distinct_surrogates(entities, key).select("kind", "canon", "gender", "surrogate"), ["kind", "canon", "gender"])), "pii-map")
    lists = (places.join(mapping, "match").groupBy("__uid")
             .agg(F.sort_array(F.collect_list(F.struct("pos", "put", "kind"))).alias("__puts")))
    joined = hit.join(lists, "__uid")
    between = F.split("text", PATTERN, -1)
    text = F.array_join(F.zip_with(between, F.col("__puts.put"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    done = joined.withColumn("__new", text).withColumn("__pii", F.col("__puts.kind"))
    done = done.drop("text", "__found", "__uid", "__puts").withColumnRenamed("__new", "text")
    return clean.unionByName(done.select(*[F.col(c) for c in clean.columns]))


def pii_report(docs: DataFrame, key: str = "surrogate-key") -> DataFrame:
    """doc_id, text (replaced), n_entities, kinds."""
    out = replace_pii(docs.select("doc_id", "text"), key)
    return out.select("doc_id", "text", F.size("__pii").cast("long").alias("n_entities"), F.col("__pii").alias("kinds"))
