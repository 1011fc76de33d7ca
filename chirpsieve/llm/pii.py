"""Surrogates for personal data and secrets (DataFrame functions only).

An entity has a normal form (an address in lower case, the digits of a number, a
name's words), and its surrogate is drawn from a keyed SHA-512 of that, then put
into the format at hand: digits for digits, letters of the same case and script,
valid check digits, given names of the title's gender. So a value has one
surrogate wherever and however it is written. A check over all distinct normal
forms finds surrogates that two of them share, or that are normal forms
themselves; those draw again until all are distinct.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, materialize

# Titles that a name of up to six words follows.
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Господин|Госпожа|Κύριος|Κυρία"
# Words that end a name in front of them, capitals or not.
STOPS = "And|The|Of|At|In|On|For|From|To|With|By|But|Or|Is|Was|Has|He|She|They|It|We|You|His|Her|Our|Who|Und|Der|Die|Das|Mit|Von|Aus|Ist|Et|Le|La|Les|Des|Du|Avec|Est|Y|El|Los|Las|Con|Es"
# A word of a name, to its end: inner capitals, hyphens and apostrophes belong to it, a final 's doesn't.
NAME_WORD = r"\p{Lu}(?:['’]\p{L}++|[\p{L}\p{M}]++)(?:-\p{L}++|['’]\p{Lu}[\p{L}\p{M}]*+)*+"
# Words that end the name of a street.
STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Square"
# The patterns of entities, most specific first (Java regular expressions). Repeated groups are
# possessive: Java runs those as loops, all others by recursion, which long texts overflow.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|token|secret|api_?key)[ ]{0,2}[=:][ ]{0,2}[\"']?[A-Za-z0-9_+/.\-]{8,}+[\"']?",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<!\d)\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "street": rf"(?<![\p{{L}}\d])\d{{1,5}}[a-z]?+ {NAME_WORD} (?:{STREETS})\b",
    "strasse": r"(?<!\p{L})\p{Lu}\p{Ll}++(?<=straße|strasse|weg|platz) \d{1,4}[a-z]?+(?!\d)",
    "name": rf"(?<!\p{{L}})(?:(?:{TITLES})\.? ){{1,3}}+(?!(?:{TITLES}|{STOPS})\b){NAME_WORD}(?: (?!(?:{TITLES}|{STOPS})\b){NAME_WORD}){{0,5}}+",
}
# Titles of women and of either, and country codes of one and two digits (the others have three).
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Госпожа|Κυρία)\b"
EITHER = r"^(?:Dr|Prof)\b"
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
# Parts that surrogate names are made of, by script: beginnings, middles, and endings of
# surnames and of given names of women and men.
NAMES = {
    "latin": {
        "start": "Ab Ad Al Ar Ba Be Bo Bra Bri Ca Co Cra Da De Do Dra Du Ed El Er Fa Fe Fo Fra Ga Ge Go Gra Ha He Ho Hu Ja Jo Ka Ke Ko Kra La Le Li Lo Lu Ma Me Mo Na Ne No Os Pa Pe Po Ra Re Ro Sa Se Si So Sta Ta Te To Tra Va Ve Vi Vo Wa We Wi Za Ze",
        "middle": "b d f g k l m n r s t v bb dd ff gg kk ll mm nn rr ss tt lb ld lm ln lt mb nd ng nk nt rb rd rg rk rl rm rn rt sk st",
        "surname": "alder ander anger arez ari asky aux eau elius eller ello elman emann enberg enburg ender enfeld ensen enson ento erford erham ero eston eti ez ier iera iero ietti igan illo ini inski isch ison iton ivale ival oni orno ossa otti ovic owell owick owood oworth uela ulin unez usso",
        "given_f": "a ia ina ella ette isa ika anne ine elle inda ora",
        "given_m": "o us an in er on en el ian ert ard old",
    },
    "cyrillic": {
        "start": "Ба Бо Ва Ве Во Га Го Да До За Зу Ка Ко Ла Ле Лу Ма Ми Мо На Но Па По Ра Ро Са Се Со Та То Фа Хо Ша Ше Щу",
        "middle": "в г д ж з к л м н р с т вл др зн ль мн нд рк рт ск ст",
        "surname": "авко айко алюк анчук аренко евич евко енко ерко ейко ивко илюк имчук инчук ирко исюк ищук ович овко ойко олюк ончук орко ушко ущенко",
        "given_f": "а ия ина ена ица ана она ея",
        "given_m": "ан ей ий ор им он ян ен",
    },
    "greek": {
        "start": "Αν Βα Γα Γι Δε Δη Ελ Ευ Ζα Ηλ Θε Κα Κο Λα Λε Μα Με Μι Να Νι Πα Πε Ρα Σα Τα Τρι Φα Χα Χρι",
        "middle": "β γ δ κ λ μ ν π ρ σ τ φ νδ ρδ ρτ στ",
        "surname": "ίδη άκη ίου έα άτου άντη ώνη ούλη ίτη αίου άρη ιάδη",
        "given_f": "α ία ίνα ένη ώ ούλα",
        "given_m": "ος ης ίας ων ίνος άνος",
    },
}
# Alphabets that a character's surrogate comes from; of hexadecimal words, the first are other ones.
ALPHABETS = "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ αβγδεζηθικλμνξοπρστυφχψωάέήίόύώς абвгдежзиклмнопрстуфхцчшщъыьэюяйё"
HEXADECIMAL = "0123456789 abcdef"

# Spark's setting with the secret key of registered queries; without it they draw from a key that anybody can read here.
KEY_SETTING, DEMONSTRATION_KEY = "spark.chirpsieve.surrogate.key", "surrogate-key-1"

# Within a word every position fails at the first look: only word starts try the
# kinds that begin with a letter, and only signs and digits the others.
# The backreference counts groups of the whole alternation: card's is the only capturing one.
LETTERED = ["email", "access_key", "secret", "iban", "strasse", "name"]
PATTERN = (
    "(?<![A-Za-z0-9])(?:" + "|".join(PATTERNS[k] for k in LETTERED) + ")"
    + r"|(?=[+(\d])(?:" + "|".join(p for k, p in PATTERNS.items() if k not in LETTERED) + ")"
)
# In a text with a name: any other word that begins with a capital may be a part of it, standing alone.
WIDE = PATTERN + r"|(?<![\p{L}\p{M}])" + NAME_WORD
# Every pattern needs one of these signs or words.
SIGNS = "[0-9@=:]"
NEEDED = ["AKIA", "ASIA", *TITLES.split("|")]  # all others have a digit or a sign


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def luhn_sum(v: Column) -> Column:
    """Luhn's sum of the digits of v; other characters don't count."""
    digits = F.reverse(F.regexp_replace(v, r"\D", ""))
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(digits)))
    d = lambda i: F.coalesce(F.substring(digits, i, F.lit(1)).try_cast("int"), F.lit(0))
    twice = lambda i: d(i) * 2 - F.when(d(i) > 4, 9).otherwise(0)
    return F.aggregate(at, F.lit(0), lambda s, i: s + F.when(i % 2 == 0, twice(i)).otherwise(d(i)))


def mod97(v: Column) -> Column:
    """An account number's remainder: letters count 10 to 35, the first four characters come last; 1 where its check digits are right."""
    turned = F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, F.lit(1), F.lit(4)))
    value = lambda c: F.coalesce(c.try_cast("int"), F.ascii(c) - 55)
    return F.aggregate(chars(turned), F.lit(0), lambda s, c: (s * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def kind_of(v: Column) -> Column:
    """The kind of a match of PATTERN; null for numbers that only look like one (check digits of cards and accounts, a card's issuer, an address's bytes)."""
    out = None
    for kind, p in PATTERNS.items():
        hit = v.rlike(f"^(?:{p})$")
        if kind == "card":
            hit &= v.rlike("^[2-6]") & (luhn_sum(v) % 10 == 0)
        if kind == "iban":
            hit = F.when(hit, mod97(F.replace(v, F.lit(" "), F.lit(""))) == 1).otherwise(False)
        if kind == "ip":
            hit &= F.forall(F.split(v, r"\."), lambda x: x.try_cast("int") < 256)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def name_words(v: Column) -> Column:
    """The words behind a name's titles."""
    return F.split(F.regexp_replace(v, rf"^(?:(?:{TITLES})\.? )+", ""), " ")


def parts_of(v: Column, kind: Column) -> Column:
    """[(kind, normal form)] of an entity: one, or one for each word of a name (the last is the surname)."""
    digits = F.regexp_replace(v, r"\D", "")
    national = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, COUNTRY, ""), r"\D", ""), "^0+(?=.)", "")
    normal = (
        F.when(kind == "email", F.lower(v)).when(kind == "phone", national).when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.replace(v, F.lit(" "), F.lit(""))).when(kind == "secret", F.regexp_extract(v, SECRET, 2))
        .otherwise(v)
    )
    # a title of either tells nothing: there the given name's ending does
    given = lambda w: F.when(v.rlike(FEMALE) | v.rlike(EITHER) & w.rlike("[aаαά]$"), "given_f").otherwise("given_m")
    of_name = let(name_words(v), lambda words: F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, "surname").otherwise(given(w)).alias("kind"), F.lower(w).alias("normal"))))
    return F.when(kind == "name", of_name).otherwise(F.array(F.struct(kind.alias("kind"), normal.alias("normal"))))


def _draw(key: str, *what: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *what), 512)


def _byte(digest: Column, i: Column) -> Column:
    """Byte i of a hex digest (64 of them, repeated)."""
    return F.conv(F.substring(digest, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _one_of(texts: str, n: Column) -> Column:
    return F.element_at(F.split(F.lit(texts), " "), F.pmod(n, F.lit(len(texts.split()))) + 1)


def chars(v: Column) -> Column:
    return F.filter(F.split(v, ""), lambda c: c != "")


def alike(v: Column, digest: Column) -> Column:
    """v with each character replaced by one of its own alphabet; all others stay. Words of hex digits stay hex."""

    def put(c, n, alphabets):
        own = F.filter(alphabets, lambda a: F.contains(a, c))
        return F.coalesce(F.try_element_at(F.transform(own, lambda a: F.substring(a, F.pmod(n, F.length(a)) + 1, F.lit(1))), F.lit(1)), c)

    alphabets = F.split(F.when(v.rlike("^[0-9a-f]+$"), HEXADECIMAL).otherwise(ALPHABETS), " ")
    return let(F.struct(v.alias("v"), digest.alias("d"), alphabets.alias("a")), lambda s: F.array_join(F.transform(chars(s["v"]), lambda c, i: put(c, _byte(s["d"], i), s["a"])), ""))


def luhn(v: Column) -> Column:
    """v, digits, with the last set so that Luhn's sum is right."""
    return let(F.concat(F.substring(v, F.lit(1), F.length(v) - 1), F.lit("0")), lambda x: F.concat(F.substring(x, F.lit(1), F.length(x) - 1), F.pmod(-luhn_sum(x), F.lit(10)).cast("string")))


def invented(kind: str, script: Column, digest: Column) -> Column:
    """A name made of parts, each picked by two bytes of the digest."""
    two = lambda i: _byte(digest, F.lit(2 * i)) * 256 + _byte(digest, F.lit(2 * i + 1))
    out = None
    for s, of in NAMES.items():
        name = F.concat(*[_one_of(of[p], two(i)) for i, p in enumerate(("start", "middle", kind))])
        out = F.when(script == s, name) if out is None else out.when(script == s, name)
    return out


def surrogate(kind: Column, normal: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a normal form, a normal form itself, at its attempt (0, 1, ...)."""
    drawn = F.struct(normal.alias("v"), attempt.alias("a"), kind.alias("k"), _draw(key, kind, normal, attempt.cast("string")).alias("d"), _draw(key, F.lit("more"), kind, normal, attempt.cast("string")).alias("e"))
    return let(drawn, lambda s: _surrogate(s["v"], s["a"], s["k"], s["d"], s["e"], key))


def _surrogate(v: Column, attempt: Column, kind: Column, d: Column, e: Column, key: str) -> Column:
    part = lambda p: F.regexp_extract(v, p, 1)
    host = F.substring(alike(F.lit("aaaaaa"), _draw(key, part("@(.*)$"))), 1, 6)
    top = F.when(v.rlike(r"\.(com|net|org)$"), part(r"\.(\w+)$")).otherwise("com")
    # a short local part has few surrogates: later attempts lengthen it
    more = F.when(attempt > 2, F.substring(alike(F.lit("aaaaaaaa"), e), F.lit(1), F.least(attempt, F.lit(8)).cast("int"))).otherwise("")
    email = F.concat(alike(part("^([^@]*)@"), d), more, F.lit("@"), host, F.lit(".example."), top)
    octet = lambda i, n, low: (F.pmod(_byte(d, F.lit(i)), F.lit(n)) + low).cast("string")
    ip = F.concat_ws(".", octet(0, 223, 1), octet(1, 256, 0), octet(2, 256, 0), octet(3, 254, 1))
    script = F.when(v.rlike(r"\p{IsCyrillic}"), "cyrillic").when(v.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", luhn(F.concat(F.substring(v, 1, 1), alike(part("^.(.*)$"), d))))
    for k in ("surname", "given_f", "given_m"):
        # attempts behind the first are two names in one
        out = out.when(kind == k, F.concat(invented(k, script, d), F.when(attempt > 0, F.concat(F.lit("-"), invented(k, script, e))).otherwise("")))
    street = F.concat(alike(part(r"^(\S+ )"), d), invented("surname", F.lit("latin"), e), part(r"( \p{L}+)$"))
    strasse = F.concat(invented("surname", F.lit("latin"), e), part(r"(straße|strasse|weg|platz) "), F.lit(" "), alike(part(r" (\S+)$"), d))
    out = out.when(kind == "street", street).when(kind == "strasse", strasse)
    out = out.when(kind == "access_key", F.concat(F.substring(v, 1, 4), alike(part("^.{4}(.*)$"), d))).when(kind == "ssn", F.concat(F.lit("9"), alike(part("^.(.*)$"), d)))
    return out.when(kind == "iban", account(F.substring(v, 1, 2), alike(part("^....(.*)$"), d))).otherwise(alike(v, d))


def account(country: Column, body: Column) -> Column:
    """An account number with the check digits that its country and body ask for."""
    return let(F.concat(country, F.lit("00"), body), lambda x: F.concat(F.substring(x, F.lit(1), F.lit(2)), F.lpad((98 - mod97(x)).cast("string"), 2, "0"), F.substring(x, F.lit(5), F.length(x))))


# Pieces of a word, and the signs between them.
JOINTS = "(?<=[-'’])|(?=[-'’])"
SECRET = r"^(\w+ *[=:] *[\"']?)(.*?)([\"']?)$"


def refill(v: Column, s: Column, signs: str) -> Column:
    """v with its characters of a class (as in [...]) replaced by those of s in turn."""
    so_far = lambda i: F.length(F.regexp_replace(F.substring(v, F.lit(1), i + 1), f"[^{signs}]", ""))
    return F.array_join(F.transform(chars(v), lambda c, i: F.when(c.rlike(f"[{signs}]"), F.substring(s, so_far(i), F.lit(1))).otherwise(c)), "")


def formatted(v: Column, kind: Column, drawn: Column) -> Column:
    """The surrogate of an entity in its own format. drawn: the surrogates of its parts, in order.

    Of a `word` these are its own and those of its pieces (JOINTS), null where there is none.
    """
    s = F.get(drawn, F.lit(0))
    # code, brackets and leading zeros of a phone number stay
    lead = F.regexp_extract(v, "(" + COUNTRY + r"[ .(-]*0*|^[ .(-]*0*)", 1)
    loud = lambda p, w: F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(p)).otherwise(p)
    names = F.array_join(F.zip_with(drawn, name_words(v), loud), " ")
    out = F.when(kind == "phone", F.concat(lead, refill(F.substring(v, F.length(lead) + 1, F.length(v)), s, "0-9"))).when(kind.isin("card", "ssn"), refill(v, s, "0-9"))
    out = out.when(kind == "iban", refill(v, s, "A-Z0-9")).when(kind == "secret", F.concat(F.regexp_extract(v, SECRET, 1), s, F.regexp_extract(v, SECRET, 3)))
    pieces = F.array_join(F.zip_with(F.slice(drawn, F.lit(2), F.size(drawn)), F.split(v, JOINTS), lambda p, w: F.coalesce(loud(p, w), w)), "")
    word = F.when(s.isNotNull(), loud(s, v)).when(F.size(drawn) > 1, pieces).otherwise(v)
    return out.when(kind == "name", F.concat(F.regexp_extract(v, rf"^((?:(?:{TITLES})\.? )+)", 1), names)).when(kind == "word", word).otherwise(s)


def resolve(values: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """kind, normal, s: the surrogates of distinct (kind, normal), all distinct within a kind and none of them a normal form of it."""
    spark = values.sparkSession
    # drawing is work, not bytes: one partition a core rather than one for all small values
    values = values.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "kind", "normal")
    drawn = materialize(values.select("kind", "normal", F.lit(0).alias("attempt"), surrogate(F.col("kind"), F.col("normal"), F.lit(0), key).alias("s")))
    for _ in range(rounds):
        # of the values that share a surrogate, the one with the fewest attempts (then the smallest) keeps it
        first = drawn.groupBy("kind", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "normal")).alias("owner"))
        shared = first.where("n > 1").select(F.col("kind").alias("k1"), F.col("s").alias("s1"), F.col("owner.normal").alias("owner"))
        taken = drawn.select(F.col("kind").alias("k1"), F.col("normal").alias("v1"))
        kind = F.col("kind") == F.col("k1")
        # normal forms of names are in lower case
        as_normal = F.when(F.col("kind").isin("surname", "given_f", "given_m"), F.lower("s")).otherwise(F.col("s"))
        bad = drawn.join(shared, kind & (F.col("s") == F.col("s1")) & (F.col("normal") != F.col("owner")), "left_semi").union(drawn.join(taken, kind & (as_normal == F.col("v1")), "left_semi"))
        bad = materialize(bad.select("kind", "normal", "attempt").distinct())
        if bad.isEmpty():
            return drawn.select("kind", "normal", "s")
        again = bad.select("kind", "normal", (F.col("attempt") + 1).alias("attempt"))
        again = again.withColumn("s", surrogate(F.col("kind"), F.col("normal"), F.col("attempt"), key))
        drawn = materialize(drawn.join(bad.select("kind", "normal"), ["kind", "normal"], "left_anti").unionByName(again))
    raise ValueError(f"surrogates still collide after {rounds} rounds")


def found(text: Column) -> Column:
    """All matches in a text in order; the long pattern runs only where one of the signs or words that it needs is there."""
    may = text.rlike(SIGNS)
    for word in NEEDED:
        may = may | text.contains(word)
    return F.when(may, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))


def entities(matches: Column) -> Column:
    """[(v, kind, parts)] of matches in order; kind is null for what isn't an entity."""
    typed = F.transform(matches, lambda v: F.struct(v.alias("v"), kind_of(v).alias("kind")))
    return F.transform(typed, lambda e: F.struct(e["v"].alias("v"), e["kind"].alias("kind"), parts_of(e["v"], e["kind"]).alias("parts")))


def parts_in_place(some: DataFrame) -> DataFrame:
    """number, pos, idx, v (or null), kind, part: every part of the matches of texts (number, ents), in place; part is null where there is no entity.

    A match without a kind may be the word of a name that the same text has
    behind a title, as a whole (idx 0) or by its pieces (1, 2, ...): an equi-join on the text's number and the word finds it. Where words of
    given names and surnames are the same, the surname counts, then the first.
    """
    e = materialize(some.select("number", F.posexplode("ents").alias("pos", "e")).select("number", "pos", "e.*"))
    typed = e.where("kind is not null").select("number", "pos", F.posexplode("parts").alias("idx", "part"), "v", "kind").select("number", "pos", "idx", "v", "kind", "part")
    first = F.min(F.struct((F.col("part.kind") != "surname").alias("given"), "pos", "idx", "part")).alias("m")
    named = typed.where("kind = 'name'").groupBy(F.col("number").alias("n_"), F.get(name_words(F.col("v")), F.col("idx")).alias("w_")).agg(first).select("n_", "w_", "m.part")
    bare = e.where("kind is null").select("number", "pos", "v")
    # rows of pieces are without v, which may be as long as a text
    pieces = bare.where(F.col("v").rlike("[-'’]")).select("number", "pos", F.posexplode(F.split("v", JOINTS)).alias("idx", "w")).withColumn("idx", F.col("idx") + 1)
    bare = bare.select("number", "pos", F.lit(0).alias("idx"), F.col("v").alias("w"), "v").unionByName(pieces.withColumn("v", F.lit(None).cast("string")))
    bare = bare.join(named, (F.col("number") == F.col("n_")) & (F.col("w") == F.col("w_")), "left")
    return typed.unionByName(bare.select("number", "pos", "idx", "v", F.lit("word").alias("kind"), "part"))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str = "n_entities") -> DataFrame:
    """docs with entities of `text` replaced, and their number as `count` behind its columns.

    Null and empty texts stay as they are, with 0 entities. Each text is
    searched once, and once more by a wider pattern if it has a name; rows
    without an entity pass by without a shuffle. Rows have a number of their
    own, so repeated rows and null keys are no matter, and columns may have any
    names (but `count`, which raises). A text of any length, with any number of
    names, is searched without recursion and in time linear in both: what is
    drawn comes back to its place by joins.
    """
    if count in docs.columns:
        raise ValueError(f"docs have a column {count}: name another for the number of entities")
    d = boxed(docs, text=F.col(f"`{text}`")).withColumn("matches", found(F.col("text")))
    d = d.select("row", F.when(F.size("matches") > 0, F.col("text")).alias("text"), F.when(F.size("matches") > 0, entities(F.col("matches"))).alias("ents"))
    d = materialize(d.withColumn("some", F.coalesce(F.exists("ents", lambda e: e["kind"].isNotNull()), F.lit(False))))
    clean = d.where("not some").select("row.*", F.lit(0).alias(count))
    named = F.exists("ents", lambda e: e["kind"] == "name")
    some = d.where("some").select("row", "text", named.alias("named"), F.when(named, entities(F.regexp_extract_all("text", F.lit(WIDE), F.lit(0)))).otherwise(F.col("ents")).alias("ents"))
    some = materialize(some.withColumn("number", F.monotonically_increasing_id()))
    parts = materialize(parts_in_place(some))
    drawn = resolve(parts.where("part is not null").select("part.kind", "part.normal").distinct(), key).withColumnsRenamed({"kind": "k_", "normal": "v_"})
    placed = parts.join(drawn, (F.col("part.kind") == F.col("k_")) & (F.col("part.normal") == F.col("v_")), "left").select("number", "pos", "idx", "v", "kind", "s")
    # a text's parts, then its matches, come together in one shuffle
    each = placed.repartition("number").groupBy("number", "pos").agg(F.first("v", True).alias("v"), F.first("kind").alias("kind"), F.sort_array(F.collect_list(F.struct("idx", "s")))["s"].alias("s"))
    each = each.select("number", "pos", F.exists("s", lambda x: x.isNotNull()).alias("hit"), formatted(F.col("v"), F.col("kind"), F.col("s")).alias("put"))
    per = each.groupBy(F.col("number").alias("n_")).agg(F.sort_array(F.collect_list(F.struct("pos", "put")))["put"].alias("put"), F.count_if("hit").cast("int").alias("hits_"))
    some = some.join(per, F.col("number") == F.col("n_"))
    gaps = F.when(F.col("named"), F.split("text", F.lit(WIDE), -1)).otherwise(F.split("text", F.lit(PATTERN), -1))
    joined = F.array_join(F.zip_with(gaps, F.concat("put", F.array(F.lit(""))), lambda g, s: F.concat(g, s)), "")
    columns = [joined.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns]
    return clean.unionByName(some.select(*columns, F.col("hits_").alias(count)))


def session_key(spark: SparkSession) -> str:
    """The session's secret key; without one a key that is no secret, with a warning."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        logging.getLogger(__name__).warning("%s is not set: surrogates are drawn from a key that anybody can read", KEY_SETTING)
    return key or DEMONSTRATION_KEY


def op10(spark, sf_dir):
    """doc_id, text, n_entities of all documents, as pseudonymise() does them with the session's key."""
    from .common import documents

    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), session_key(spark))
