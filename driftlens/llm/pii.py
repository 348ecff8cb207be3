"""Surrogates for personal data, with DataFrame functions only.

Entities are found by one pattern. Each distinct entity gets a surrogate from a keyed digest:
of the same type and format (digits for digits, letters for letters, same separators and case,
valid octets, the same Luhn remainder), and for names of the same gender and script. Equal
entities have equal surrogates everywhere (coreference); a collision check over all distinct
entities sees to it that different ones differ and that no surrogate is an entity of the
corpus: those that collide are drawn again.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.workspace import Workspace

# Titles before a name, by gender.
MALE = ["Mr", "Herr", "Monsieur", "Sr", "Señor", "господин", "κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Sra", "Señora", "госпожа", "κυρία"]
NEUTRAL = ["Dr", "Prof"]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# A word of a name, without a possessive 's; an initial; a name of any number of both.
_WORD = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-](?!s\b)\p{L}[\p{L}\p{M}]*+)*+"
_INITIAL = r"\p{Lu}(?:\.|(?![\p{L}\p{M}'’-]))"
_PARTICLE = r"(?:(?:von|van|vom|zu|der|den|de|del|della|di|da|dos|du|la|le|al|bin|ibn)[ ])*+"
_NAME = rf"(?:{_INITIAL}[ ]?(?=\p{{Lu}}))*+{_PARTICLE}{_WORD}(?:[ ]{_PARTICLE}(?:{_INITIAL}(?=[ ]?\p{{Lu}})|{_WORD})|(?<=\.){_WORD})*+"
WORDS = rf"(?<![\p{{L}}\p{{M}}\p{{N}}]){_WORD}"
_TITLES = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
# What else stands before a name, in the languages of the titles.
_SAYS = ["my name is", "mein name ist", "ich heiße", "je m'appelle", "je m’appelle", "mon nom est", "me llamo", "mi nombre es", "меня зовут", "με λένε"]
_FIELDS = ["full name", "name", "nom", "nombre", "имя", "όνομα"]
_CLOSINGS = ["regards", "sincerely", "yours truly", "cheers", "mit freundlichen grüßen", "viele grüße", "cordialement", "saludos", "atentamente", "с уважением", "με εκτίμηση"]
_TITLE = rf"\b(?:{_TITLES})\.? "
_LEAD = rf"(?:(?:\b(?iu:{'|'.join(_SAYS)})[ ]|\b(?iu:{'|'.join(_FIELDS)})[ ]?:[ ]*+|\b(?iu:{'|'.join(_CLOSINGS)})[ ]?[,.!]?[ ]*+\r?\n\s*+)(?:{_TITLE})*+|(?<!{_TITLE})(?:{_TITLE})++)"
# A secret runs to its closing quote in the line, else to white space or a double quote; it has no greatest length.
_KEY = r"(?i:password|passwd|secret|token|api[_-]?key)\\?[\"']?\s*+[=:]\s*+"
_VALUE = r"(?:\"(?!\")[^\n]*?(?<!\\)\"|'(?!')[^'\n]*+'|(?!'')\\?[\"']?[^\s\"]++)"
# Shapes of card numbers: plain, in groups of four (up to 19 digits), 4-6-5 and 4-6-4.
_FOURS = r"\d{4}(?:[ -]\d{4}){3}"
_CARD = rf"(?:\d{{13,19}}|{_FOURS}(?:[ -]\d{{1,3}})?|\d{{4}}[ -]\d{{6}}[ -]\d{{4,5}})(?!\d)"
# Groups of four that are more than one card but less than two: a year before or after is left out, other groups go with the card.
_STRAY = rf"(?:(?:[ -](?!(?:19|20)\d\d(?!\d))\d{{4}}){{1,3}}(?!\d|[ -]\d{{4}}(?!\d)))?+"
_YEAR_FIRST = rf"(?!(?:19|20)\d\d[ -]{_FOURS}(?!\d))"
# Grouped cards straight ahead: a telephone number does not run on into them.
_NEXT = r"(?:(?:[ -]\d{4}){4})++(?:[ -](?:(?:19|20)\d\d|\d{1,3}))?(?![ -]?\d)|[ -]\d{4}[ -]\d{6}[ -]\d{4,5}(?!\d)"
#: Patterns in the order in which they are tried; an entity has the first type that matches it. Each reads a run of its characters
#: once: an address begins where its run does (punctuation before it goes with the match, and is shown as it was), titles where no title is before them.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])[._%+-]*+|\G)[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.(?:xn--[A-Za-z0-9-]{1,59}|[A-Za-z]{2,63})",
    "secret": rf"{_KEY}{_VALUE}|\bAKIA[0-9A-Z]{{16}}\b|\b[0-9a-f]{{32,}}+\b",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "phone": rf"\+\d{{1,3}}[ .-]?\(?\d{{2,4}}\)?(?:(?!{_NEXT})[ .-]?\d{{2,4}}){{2,4}}(?!\d)|(?<!\d)\(\d{{3}}\) ?\d{{3}}-\d{{4}}(?!\d)|(?<!\d)\d{{3}}-\d{{3}}-\d{{4}}(?!\d)",
    "number": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "card": rf"(?<!\d)(?:{_YEAR_FIRST}{_FOURS}(?!\d){_STRAY}(?:[ -]\d{{1,3}}(?!\d))?|{_YEAR_FIRST}{_CARD}|(?<!\d[ -]){_YEAR_FIRST}\d(?:(?:[ -](?!{_CARD}))?\d){{12,18}}(?!\d))",
    "person": rf"{_LEAD}{_NAME}",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Letters that initials are drawn from, by script.
CAPITALS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
DIGITS_ONLY = ("phone", "number", "card")
#: Attempts before surrogates get longer than what they stand for.
FULL = 3

# Syllables and gendered endings of invented names, by script.
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ka", "le", "mi", "no", "pa", "re", "si", "to", "va", "we", "ri", "lu"],
    "cyrillic": ["ба", "де", "фи", "го", "ка", "ле", "ми", "но", "па", "ре", "си", "то", "ва", "ве", "ри", "лу"],
    "greek": ["βα", "δε", "φι", "γο", "κα", "λε", "μι", "νο", "πα", "ρε", "σι", "το", "θα", "ζε", "ρι", "λυ"],
}
ENDINGS = {"latin": ("na", "rt", "l"), "cyrillic": ("на", "рт", "л"), "greek": ("να", "ς", "λι")}


def entities(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), 0)


def may_hold(text: Column) -> Column:
    """A cheap test that every text with an entity passes: a digit, @, a key word, a title or other word before a name, or a long run of a-f.

    Words are looked for one by one, which is several times as fast as a pattern of them all.
    """
    out = text.rlike("[0-9@]")
    for title in [*MALE, *FEMALE, *NEUTRAL, "AKIA"]:
        out = out | text.contains(title)
    words = ["password", "passwd", "secret", "token", "api", *_SAYS, *_FIELDS, *_CLOSINGS]
    holds = lambda low: functools.reduce(operator.or_, [low.contains(w) for w in words])
    once = F.exists(F.array(F.lower(text)), holds)  # the text is lower-cased once, not for each word
    return out | once | text.rlike("[a-f]{32}")


def type_of(raw: Column) -> Column:
    out = F.lit("person")
    for name, pattern in reversed(PATTERNS.items()):
        if name != "person":
            out = F.when(raw.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def gender_of(raw: Column) -> Column:
    lead = F.regexp_extract(raw, rf"^({_LEAD})", 1)
    starts = lambda titles: lead.rlike(rf"(?:^|\W)(?:{'|'.join(titles)})\.? ")
    return F.when(starts(FEMALE), "f").when(starts(MALE), "m").otherwise("x")


def parts_of(raw: Column, kind: Column) -> Column:
    """The (type, canonical form) pairs of an entity: one, or each word of a person's name, the last the surname.

    Canonical forms ignore what does not tell entities apart: case in emails and names,
    separators in numbers. A secret is its value, without the word before it.
    """
    one = lambda k, c: F.struct(k.cast("string").alias("kind"), c.alias("canon"))
    names = words_of(F.regexp_replace(raw, rf"^{_LEAD}", ""))
    given = F.zip_with(F.slice(names, F.lit(1), F.size(names) - 1), F.array_repeat(gender_of(raw), F.size(names) - 1), lambda w, g: one(F.when(is_initial(w), F.lit("initial")).otherwise(F.concat(F.lit("given_"), g)), F.lower(w)))
    person = F.concat(given, F.array(one(F.lit("surname"), F.lower(F.element_at(names, -1)))))
    return (F.when(kind == "email", F.array(one(kind, F.lower(F.regexp_replace(raw, _BEFORE_MAIL, "")))))
            .when(kind == "secret", F.array(one(kind, secret_value(raw))))
            .when(kind.isin(*DIGITS_ONLY), F.array(one(F.concat(kind, F.when(raw.startswith("+"), F.lit("+")).otherwise(F.lit(""))), F.regexp_replace(raw, r"\D", ""))))
            .when(kind == "ip", F.array(one(kind, raw)))
            .otherwise(person))


def words_of(name: Column) -> Column:
    """The words and initials of a name or text, in order; an initial is without its point."""
    return F.regexp_extract_all(name, F.lit(WORDS), 0)


def is_initial(word: Column) -> Column:
    return F.char_length(word) == 1


def secret_parts(raw: Column) -> tuple[Column, Column, Column]:
    """What stands before a secret's value (key word, opening quote), the value, and its closing quote."""
    lead = F.regexp_extract(raw, rf"^((?:{_KEY})?\\?[\"']?)", 1)
    body = F.substring(raw, F.char_length(lead) + 1, F.char_length(raw))
    quote = F.when(lead.endswith('"') & body.endswith('"'), F.lit('"')).when(lead.endswith("'") & body.endswith("'"), F.lit("'")).otherwise(F.lit(""))
    return lead, F.substring(body, F.lit(1), F.char_length(body) - F.char_length(quote)), quote


def secret_value(raw: Column) -> Column:
    return secret_parts(raw)[1]


#: Punctuation that the pattern of addresses takes along.
_BEFORE_MAIL = r"^[._%+-]+"


def _byte(digest: Column, i: Column) -> Column:
    """Byte i of a hex digest of 96 bytes, around again after its end."""
    return F.conv(F.substring(digest, F.pmod(i, F.lit(96)) * 2 + F.lit(1), F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + F.lit(1), F.lit(1))


def _luhn(digits: Column) -> Column:
    """Luhn sum of an array of digits, the check digit last, modulo 10."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when(F.pmod(n - i, F.lit(2)) == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.pmod(F.aggregate(doubled, F.lit(0), lambda a, b: a + b), F.lit(10))


def digest_of(kind: Column, canon: Column, key: str, attempt: int) -> Column:
    return F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, F.lit(str(attempt)), F.lit(str(k))), 256) for k in range(3)])


def surrogate(kind: Column, canon: Column, digest: Column, attempt: int) -> Column:
    """The canonical surrogate of a canonical entity; other attempts, with their digests, give others."""
    chars = F.split(canon, "")
    low, up, dec = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa = canon.rlike("^[0-9a-f]+$")

    def same_class(c: Column, i: Column, small: str) -> Column:
        b = _byte(digest, i)
        return F.when(c.between("0", "9"), _pick(dec, b)).when(c.between("a", "z"), _pick(small, b)).when(c.between("A", "Z"), _pick(up, b)).otherwise(c)

    mapped = F.when(hexa, F.transform(chars, lambda c, i: same_class(c, i, "abcdef"))).otherwise(F.transform(chars, lambda c, i: same_class(c, i, low)))
    text = F.array_join(mapped, "")
    # Formats with few values are left after FULL attempts: later surrogates are longer from attempt to attempt.
    extra = max(0, attempt - FULL)
    email = F.concat(F.substring(digest, F.lit(150), F.lit(extra)), F.substring(text, F.lit(1), F.char_length(canon) - F.char_length(F.substring_index(canon, ".", -1))), F.substring_index(canon, ".", -1))
    # Of a secret every letter and digit changes, or every character if it has none; later attempts are longer, as short ones are few.
    plain = ~canon.rlike(r"[0-9A-Za-z]|[^\x00-\x7f]")
    letter = lambda c, i: _pick(low, _byte(digest, i))
    hidden = F.array_join(F.when(plain, F.transform(chars, letter)).otherwise(F.transform(mapped, lambda c, i: F.when(c > "\x7f", letter(c, i)).otherwise(c))), "")
    hidden = F.concat(hidden, F.substring(digest, F.lit(150), F.lit(max(0, attempt - 3))))
    kept = F.when(canon.rlike("^AKIA[0-9A-Z]{16}$"), F.concat(F.lit("AKIA"), F.substring(text, 5, 16))).otherwise(hidden)
    width = lambda o: F.least(F.lit(3), F.char_length(o) + extra)
    octets = F.transform(F.split(canon, r"\."), lambda o, i: F.when(width(o) == 3, 100 + F.pmod(_byte(digest, i), F.lit(156))).when(width(o) == 2, 10 + F.pmod(_byte(digest, i), F.lit(90))).otherwise(F.pmod(_byte(digest, i), F.lit(10))).cast("string"))
    first_kept = F.concat(F.substring(canon, 1, 1), F.substring(text, 2, 1000))
    digits = F.transform(F.split(first_kept, ""), lambda c, i: c.cast("int"))
    head = F.slice(digits, F.lit(1), F.size(digits) - 1)
    luhn = F.pmod(_luhn(F.transform(F.split(canon, ""), lambda c, i: c.cast("int"))) - _luhn(F.concat(head, F.array(F.lit(0)))), F.lit(10))
    card = F.concat(F.array_join(F.transform(head, lambda d: d.cast("string")), ""), luhn.cast("string"))

    def name(script: str) -> Column:
        female, male, neutral = ENDINGS[script]
        syllable = lambda i: F.element_at(F.array(*[F.lit(s) for s in SYLLABLES[script]]), F.pmod(_byte(digest, i), F.lit(16)) + 1)
        stem = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2 + attempt)), syllable), "")
        return F.concat(stem, F.when(kind == "given_f", female).when(kind == "given_m", male).otherwise(neutral))

    more = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(extra)), lambda i: _pick(dec, _byte(digest, i + 40))), "").substr(2, 100) if extra else F.lit("")
    ip = F.array_join(octets, ".") if extra < 9 else F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(digest, i * 4 + F.lit(1), F.lit(4))), ":")
    person = F.when(canon.rlike(r"\p{IsCyrillic}"), name("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), name("greek")).otherwise(name("latin"))
    return (F.when(kind == "email", email).when(kind == "secret", kept).when(kind == "ip", ip).when(kind == "card", F.concat(card, more))
            .when(kind == "phone+", F.concat(first_kept, more)).when(kind.isin("phone", "number"), F.concat(text, more)).otherwise(person))


def render(raw: Column, kind: Column, found: Column) -> Column:
    """The surrogate in the entity's own format: its separators, its case, its quotes; of a person's name in lower case."""
    chars = F.split(raw, "")
    numbered = F.array_join(F.transform(chars, lambda c, i: F.when(c.between("0", "9"), F.substring(found, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x.between("0", "9"))), F.lit(1))).otherwise(c)), "")
    mail = F.split(F.regexp_replace(raw, _BEFORE_MAIL, ""), "")
    cased = F.array_join(F.transform(mail, lambda c, i: F.when(c.between("A", "Z"), F.upper(F.substring(found, i + 1, F.lit(1)))).otherwise(F.substring(found, i + 1, F.lit(1)))), "")
    cased = F.concat(F.regexp_extract(raw, _BEFORE_MAIL, 0), cased)
    lead, _, quote = secret_parts(raw)
    secret = F.concat(lead, found, quote)
    digits = F.size(F.filter(chars, lambda x: x.between("0", "9")))
    rest = lambda n: F.substring(found, n + F.lit(1), F.char_length(found))
    return F.when(kind.isin(*DIGITS_ONLY), F.concat(numbered, rest(digits))).when(kind == "email", F.concat(cased, rest(F.size(mail)))).when(kind == "secret", secret).otherwise(found)


def initial(letter: Column, key: str) -> Column:
    """Another letter of its script for an initial, the same everywhere; initials are too few to differ among themselves."""
    out = F.lit(None).cast("string")
    for letters in CAPITALS:
        step = 1 + F.pmod(F.xxhash64(F.lit(key), letter), F.lit(len(letters) - 1))
        out = F.coalesce(out, F.when(F.instr(F.lit(letters), letter) > 0, F.substring(F.lit(letters), F.pmod(F.instr(F.lit(letters), letter) - 1 + step, F.lit(len(letters))).cast("int") + 1, F.lit(1))))
    return F.coalesce(out, _pick(CAPITALS[0], F.xxhash64(F.lit(key), letter).cast("int")))


def renamed(text: Column, names: Column, key: str, initials: bool) -> Column:
    """The text with its capitalised words that are in ``names`` (lower case to lower case) replaced in their own case, and initials if asked for."""
    def shown(w: Column) -> Column:
        fake = F.element_at(names, F.lower(w))
        cased = F.when((w == F.upper(w)) & ~is_initial(w), F.upper(fake)).otherwise(F.initcap(fake))
        return F.coalesce(cased, F.when(is_initial(w), initial(w, key)).otherwise(w) if initials else w)

    return F.array_join(F.zip_with(F.split(text, WORDS, -1), words_of(text), lambda g, w: F.concat(g, F.coalesce(shown(w), F.lit("")))), "")


def with_known_gender(parts: DataFrame) -> DataFrame:
    """Given names without a title that tells a gender take that of their other occurrences, if there is one only: 'Dr. Peter' is the person of 'Mr Peter'."""
    known = parts.where(F.col("kind").isin("given_m", "given_f")).groupBy("canon").agg(F.min("kind").alias("lo"), F.max("kind").alias("hi")).where("lo = hi").select("canon", F.lit("given_x").alias("kind"), F.col("lo").alias("gendered"))
    return parts.join(known, ["kind", "canon"], "left").withColumn("kind", F.coalesce("gendered", "kind")).drop("gendered")


def assign(found: DataFrame, key: str, space: Workspace) -> DataFrame:
    """(kind, canon, fake) for every distinct (kind, canon): different entities have different
    surrogates, none of which is an entity itself.

    Each attempt draws for the entities that are still without; the smallest that drew a free
    surrogate keeps it. From attempt to attempt there are more values to draw from, also where
    the corpus fills a format, so the attempts end.
    """
    ents = space.keep(found.groupBy("kind", "canon").agg(F.count("*").alias("n")).select("kind", "canon"), "entities")
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pending, taken, k = ents.repartition(tasks, "kind", "canon"), None, 0  # few bytes, but much work for each
    while True:
        drawn = pending.withColumn("digest", digest_of(F.col("kind"), F.col("canon"), key, k)).withColumn("fake", surrogate(F.col("kind"), F.col("canon"), F.col("digest"), k))
        drawn = space.keep(drawn.select("kind", "canon", "fake"), f"drawn{k}")
        won = drawn.groupBy("kind", "fake").agg(F.min("canon").alias("canon")).select("kind", "canon", "fake")
        won = won.join(ents.withColumnRenamed("canon", "fake"), ["kind", "fake"], "left_anti")
        if taken is not None:
            won = won.join(taken, ["kind", "fake"], "left_anti")
        won = space.keep(won.select("kind", "canon", "fake"), f"won{k}")
        taken = won if taken is None else taken.unionByName(won)
        pending = space.keep(drawn.select("kind", "canon").join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"), f"pending{k}")
        if pending.isEmpty():
            return taken
        k += 1


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``text`` with surrogates for entities, and ``n_entities`` (bigint).

    Who knows ``key`` can tell whether a guessed entity has a surrogate, so it is to be kept secret; runs with one key
    agree, runs with two have nothing in common.
    A null text stays null, and an empty one empty, with 0 entities. Rows that repeat are
    replaced alike; a null id stays null. Other columns are not looked at. Texts without
    entities are not dealt out; the others meet their surrogates by a digest of the row. The
    words of the names that a document's entities hold are replaced wherever they stand
    capitalised in that document; such mentions are not counted in ``n_entities``.
    """
    space = Workspace(docs.sparkSession, "pii")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    k1, k2 = F.xxhash64("id", "text").alias("k1"), F.xxhash64(F.lit("second"), "text", "id").alias("k2")
    holds = F.coalesce(may_hold(F.col("text")) & F.col("text").rlike(PATTERN), F.lit(False))
    some = space.keep(docs.where(holds).select("id", "text", k1, k2, entities(F.col("text")).alias("raws")), "some")
    raw = F.col("raw")
    occurrences = (some.select("k1", "k2", F.explode(F.array_distinct("raws")).alias("raw")).withColumn("type", type_of(raw))
                   .select("k1", "k2", "raw", "type", F.explode(parts_of(raw, F.col("type"))).alias("part")).select("k1", "k2", "raw", "type", "part.kind", "part.canon").where("kind != 'initial'"))
    occurrences = space.keep(with_known_gender(space.keep(occurrences, "parts")), "occurrences")
    fakes = assign(occurrences, key, space)
    shown = occurrences.join(fakes, ["kind", "canon"]).select("k1", "k2", "type", "kind", F.when(F.col("type") == "person", F.col("canon")).otherwise(raw).alias("at"), render(raw, F.col("type"), F.col("fake")).alias("shown"))
    # A word of a document is one name there: a surname if it is one anywhere, else a given name, of known gender if it has one.
    rank = F.when(F.col("kind") == "surname", F.lit("")).otherwise(F.col("kind"))
    shown = shown.groupBy("k1", "k2", (F.col("type") == "person").alias("name"), "at").agg(F.min_by("shown", rank).alias("shown"))
    table = lambda which: F.map_from_entries(F.collect_list(F.when(which, F.struct("at", "shown"))))
    by_row = shown.groupBy("k1", "k2").agg(table(~F.col("name")).alias("shown"), table(F.col("name")).alias("names"))

    def replaced(r: Column) -> Column:
        lead = F.regexp_extract(r, rf"^({_LEAD})", 1)
        return F.coalesce(F.element_at("shown", r), F.concat(lead, renamed(F.substring(r, F.char_length(lead) + 1, F.char_length(r)), F.col("names"), key, True)))

    gaps = F.split("text", PATTERN, -1)
    gap = lambda g: F.when(F.size("names") > 0, renamed(g, F.col("names"), key, False)).otherwise(g)
    pieces = F.transform(gaps, lambda g, i: F.concat(gap(g), F.when(i < F.size("raws"), replaced(F.get("raws", i))).otherwise(F.lit(""))))
    done = some.join(by_row, ["k1", "k2"]).select("id", F.array_join(pieces, "").alias("text"), F.size("raws").cast("long").alias("n_entities"))
    rest = docs.where(~holds).select("id", "text", F.lit(0).cast("long").alias("n_entities"))
    return done.unionByName(rest).withColumnRenamed("id", id_col)
