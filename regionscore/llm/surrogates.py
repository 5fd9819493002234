"""Operator 5: surrogates for personal data, in DataFrame functions only.

Entities are found by one pattern, brought to a normal form (so that mentions of one entity agree,
whatever their format) and given a surrogate from a keyed hash of type and normal form: digits for
digits, letters for letters of the same script and case, hexadecimal for hexadecimal, a valid check
digit where there was one, names of the same gender and script. The dictionary of distinct entities
is checked: two entities of a type with one surrogate, or a surrogate that is itself an entity,
are drawn again until there are none, so distinct entities stay distinct everywhere. Each mention
is then written in its own format, at its own place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionscore.llm.common import materialize, once

#: Up to so many rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 300_000

# Forms of address by the gender they tell.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Signor", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Signora", "Госпожа", "Κυρία")
OPEN = ("Dr", "Prof")

_ADDRESS = "|".join(sorted(MALE + FEMALE + OPEN, key=len, reverse=True))
# a capital and more; the 's of a possessive is not part of a name
_NAME = r"\p{Lu}(?=[\p{L}'’\-])\p{L}*+(?:['’\-](?![sS](?!\p{L}))\p{L}++)*+"
_TOKEN = r"[0-9A-Za-z+/_\-]"
#: A word that may be a name that the text gives elsewhere after a form of address.
UNTITLED = rf"(?<![\p{{L}}]){_NAME}(?!\p{{L}})"

#: type -> pattern, in the order in which they are tried
PATTERNS: dict[str, str] = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}@[\p{L}\p{N}\-]{1,63}(?:\.[\p{L}\p{N}\-]{1,63}){1,6}",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
    rf"|(?<=(?i:token|secret|password|passwd|api_key|apikey)[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?)(?={_TOKEN}[0-9A-Za-z+/_.\-]{{10}}{_TOKEN}){_TOKEN}++(?:\.{_TOKEN}++)*+",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "ipv6": r"(?<![\p{L}\d:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\d:])"
    r"|(?<![\p{L}\d:.])(?=[0-9A-Fa-f:]{0,39}\d)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![\p{L}\d:])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?<![\d+])(?:\+?\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3}[ .\-]?\d{3,4}(?!\d)"
    r"|(?<![\d+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?!\d)"
    r"|(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])"
    r"|(?<!\d)(?<!\d[ .\-])\d{3} \d{3} \d{4}(?! ?\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])|(?<!\d)(?<!\d[ .\-])\d{3} \d{2} \d{4}(?! ?\d)",
    "card": r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)",
    "person": rf"(?<![\p{{L}}])(?iu:{_ADDRESS})\.? {_NAME}(?: {_NAME})?",
}
ANY = "|".join(PATTERNS.values())

# First and last code points (small, capital) of the scripts that surrogates keep.
SCRIPTS = {"Cyrillic": (0x430, 0x44F, 0x410, 0x42F), "Greek": (0x3B1, 0x3C1, 0x391, 0x3A1)}
#: Name syllables and endings by script: consonants, vowels, then endings for men, women and either.
SYLLABLES = {
    "Latin": ("bcdfghjklmnprstvwz", "aeiou", ("n", "rd", "s"), ("na", "la", "tta"), ("ng", "sk", "ll")),
    "Cyrillic": ("бвгдзклмнпрстфхш", "аеиоу", ("н", "р", "в"), ("на", "ла", "ва"), ("нко", "ль", "рг")),
    "Greek": ("βγδζθκλμνπρστφχ", "αειου", ("ς", "νος", "ρος"), ("να", "λα", "ρα"), ("κη", "δη", "τη")),
}


def _kind(mention: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        hit = mention.rlike(f"^(?:{pattern})$") if kind != "secret" else mention.rlike(r"^[0-9A-Za-z+/_.\-]{12,}+$") & mention.rlike(r"[A-Za-z+/_]") & ~mention.rlike(f"^(?:{PATTERNS['iban']})$")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("secret")


def may_hold_entities(text: Column) -> Column:
    """Cheap test that no text with an entity fails: two digits running, an at sign, an assignment, two or seven colons, or a form of address."""
    out = text.contains("@") | text.rlike(r"\d\d|\d\.\d|[0-9A-Fa-f]{32}|::|(?:[0-9A-Fa-f]{1,4}:){7}")
    out = out | text.rlike(rf"(?<![\p{{L}}])(?iu:{_ADDRESS})\.? \p{{Lu}}")
    for word in ("token", "secret", "passw", "api_key", "apikey"):
        out = out | F.contains(F.lower(text), F.lit(word))
    return out


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _normal(kind: Column, part: Column) -> Column:
    """What mentions of one entity have in common."""
    digits = _digits(part)
    return (
        F.when(kind == "phone", F.substring(F.concat(F.lit(""), digits), F.greatest(F.lit(1), F.length(digits) - 9), F.lit(10)))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(part, " ", ""))
        .when(kind == "ip", part)
        .otherwise(F.lower(part))
    )


def _byte(noise: Column, i: Column) -> Column:
    """Number 0-255 at place ``i`` of a hexadecimal noise text, repeated as needed."""
    at = F.pmod(i * 2, F.length(noise)) + 1
    return F.conv(F.substring(noise, at, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


def _like(char: Column, noise: Column, i: Column, hexadecimal: Column | None = None) -> Column:
    """Another character of the same class and script."""
    n = _byte(noise, i) + 256 * _byte(noise, i + 1)
    out = F.when(char.rlike(r"^\d$"), _pick("0123456789", n))
    if hexadecimal is not None:
        out = out.when(hexadecimal, _pick("abcdef", n))
    for low, high, first, last in SCRIPTS.values():
        small, capital = "".join(map(chr, range(low, high + 1))), "".join(map(chr, range(first, last + 1)))
        out = out.when(char.between(chr(low), chr(high)), _pick(small, n)).when(char.between(chr(first), chr(last)), _pick(capital.replace("΢", "Σ"), n))
    out = out.when(char.rlike(r"^[\p{IsHiragana}]$"), _pick("".join(map(chr, range(0x3042, 0x3094))), n))
    out = out.when(char.rlike(r"^[\p{IsKatakana}]$"), _pick("".join(map(chr, range(0x30A2, 0x30F4))), n))
    out = out.when(char.rlike(r"^[\p{IsHan}]$"), F.decode(F.unhex(F.conv((F.lit(0x4E00) + F.pmod(n, F.lit(0x4000))).cast("string"), 10, 16)), "UTF-16BE"))
    out = out.when(char.rlike(r"^\p{Lu}$"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
    return out.when(char.rlike(r"^\p{L}$"), _pick("abcdefghijklmnopqrstuvwxyz", n)).otherwise(char)


def _check_digit(body: Column) -> Column:
    """The last digit that makes the sum by the card rule a multiple of ten."""
    rev = F.split(F.reverse(body), "")
    total = F.aggregate(
        F.transform(rev, lambda d, i: F.when(i % 2 == 0, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int"))),
        F.lit(0),
        lambda a, d: a + F.coalesce(d, F.lit(0)),
    )
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _name(script: str, group: Column, noise: Column, turn: Column) -> Column:
    """Syllables and an ending by gender; later draws are longer."""
    consonants, vowels, male, female, either = SYLLABLES[script]
    body = F.array_join(
        F.transform(F.sequence(F.lit(0), F.least(turn, F.lit(20)) + 1), lambda i: F.concat(_pick(consonants, _byte(noise, i * 3)), _pick(vowels, _byte(noise, i * 3 + 1)))), ""
    )
    n = _byte(noise, F.lit(30))

    def ending(choices: tuple[str, ...]) -> Column:
        return F.element_at(F.array(*[F.lit(e) for e in choices]), F.pmod(n, F.lit(len(choices))).cast("int") + 1)

    return F.concat(body, F.when(group == "m", ending(male)).when(group == "f", ending(female)).otherwise(ending(either)))


def _draw(key: str, kind: Column, group: Column, normal: Column, turn: Column) -> Column:
    """The surrogate, in the normal form, of an entity at its ``turn``-th draw."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, group, normal, turn.cast("string"))
    noise = F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(4)])
    return once(noise, lambda n: _longer(_drawn(n, kind, group, normal, turn), n, kind, turn))


def _longer(drawn: Column, noise: Column, kind: Column, turn: Column) -> Column:
    """After a few draws a surrogate gets further characters of its kind, so that drawing ends when a format is used up."""
    more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(turn - 3, F.lit(30)))), lambda i: _pick("0123456789", _byte(noise, i * 5))), "")
    letters = F.translate(more, "0123456789", "bcdfghjklm")
    return F.when((turn < 4) | kind.isin("person", "ip"), drawn).when(kind == "email", F.concat(letters, drawn)).otherwise(F.concat(drawn, more))


def _drawn(noise: Column, kind: Column, group: Column, normal: Column, turn: Column) -> Column:
    """What the noise makes of an entity, by its kind."""
    chars = F.split(normal, "")
    plain = F.array_join(F.transform(chars, lambda c, i: _like(c, noise, i)), "")
    address = F.concat(
        F.array_join(F.transform(F.split(F.regexp_extract(normal, r"^(.*)\.[^.]*$", 1), ""), lambda c, i: _like(c, noise, i)), ""),
        F.regexp_extract(normal, r"(\.[^.]*)$", 1),
    )
    is_hex = normal.rlike("^[0-9a-f]+$")
    secret = F.array_join(F.transform(chars, lambda c, i: _like(c, noise, i, is_hex)), "")
    groups = F.array_join(F.transform(chars, lambda c, i: _like(c, noise, i, c != ":")), "")
    quad = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (1 + F.pmod(_byte(noise, i) + 256 * _byte(noise, i + 4), F.lit(254))).cast("string")), ".")
    body = F.substring(normal, F.lit(1), F.length(normal) - 1)
    valid = _check_digit(body) == F.substring(normal, -1, 1)
    other = F.concat(F.substring(normal, 1, 1), F.substring(plain, F.lit(2), F.length(normal) - 2))
    card = F.concat(other, F.when(valid, _check_digit(other)).otherwise(F.substring(plain, -1, 1)))
    named = F.when(normal.rlike(r"\p{IsCyrillic}"), _name("Cyrillic", group, noise, turn)).when(normal.rlike(r"\p{IsGreek}"), _name("Greek", group, noise, turn)).otherwise(_name("Latin", group, noise, turn))
    return (
        F.when(kind == "email", address)
        .when(kind == "secret", secret)
        .when(kind == "ip", quad)
        .when(kind == "ipv6", groups)
        .when(kind == "iban", F.concat(F.substring(normal, 1, 2), F.substring(plain, F.lit(3), F.length(normal))))
        .when(kind == "card", card)
        .when(kind == "person", named)
        .otherwise(plain)
    )


def dictionary(entities: DataFrame, key: str) -> DataFrame:
    """``kind``, ``group``, ``normal`` and a ``surrogate`` that no other entity of the kind has or is.

    Of the entities that draw one surrogate the least keeps it and the others draw again; so does
    an entity whose surrogate is itself in the table.
    """
    table = entities.select("kind", "group", "normal").distinct().withColumn("turn", F.lit(0))
    table = materialize(table.withColumn("surrogate", _draw(key, F.col("kind"), F.col("group"), F.col("normal"), F.col("turn"))), "surrogates")
    while True:
        taken = table.select("kind", F.col("normal").alias("surrogate")).distinct().withColumn("real", F.lit(True))
        order = Window.partitionBy("kind", "surrogate").orderBy("turn", "group", "normal")
        checked = table.withColumn("place", F.row_number().over(order)).join(taken, ["kind", "surrogate"], "left")
        again = (F.col("place") > 1) | F.col("real").isNotNull()
        checked = materialize(checked.select("kind", "group", "normal", "turn", "surrogate", again.alias("again")), "surrogates")
        if checked.where("again").isEmpty():
            return checked.drop("again", "turn")
        kept = checked.where("not again").drop("again")
        redrawn = checked.where("again").select("kind", "group", "normal", (F.col("turn") + 1).alias("turn"))
        redrawn = redrawn.withColumn("surrogate", _draw(key, F.col("kind"), F.col("group"), F.col("normal"), F.col("turn")))
        table = materialize(kept.unionByName(redrawn), "surrogates")


def _named_like(part: Column, surrogate: Column) -> Column:
    """A name in capitals where the mention is, else with a capital first."""
    return F.when((F.upper(part) == part) & (F.length(part) > 1), F.upper(surrogate)).otherwise(F.initcap(surrogate))


def _render(kind: Column, part: Column, surrogate: Column) -> Column:
    """The surrogate in the format of the mention: its separators, capitals and leading country code."""
    digits = F.length(_digits(part))
    extra = F.greatest(F.lit(0), digits - F.length(surrogate))
    chars = F.split(part, "")

    def rest(held: Column) -> Column:
        return F.substring(surrogate, held + 1, F.greatest(F.lit(0), F.length(surrogate) - held))

    def digit_at(c: Column, i: Column) -> Column:
        nth = F.length(_digits(F.substring(part, F.lit(1), i + 1))) - extra
        return F.when(c.rlike(r"^\d$") & (nth > 0), F.substring(surrogate, nth, F.lit(1))).otherwise(c)

    numbers = F.concat(F.array_join(F.transform(chars, digit_at), ""), rest(digits - extra))
    iban = F.array_join(
        F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(surrogate, F.length(F.regexp_replace(F.substring(part, F.lit(1), i + 1), " ", "")), F.lit(1)))), ""
    )
    iban = F.concat(iban, rest(F.length(F.regexp_replace(part, " ", ""))))
    cased = F.array_join(
        F.zip_with(chars, F.split(surrogate, ""), lambda c, s: F.when(s.isNull(), "").when(c != F.lower(c), F.upper(s)).otherwise(s)), ""
    )
    return F.when(kind.isin("phone", "card", "ssn"), numbers).when(kind == "iban", iban).when(kind == "person", _named_like(part, surrogate)).when(kind == "ip", surrogate).otherwise(cased)


def replace_entities(docs: DataFrame, key: str, doc: str = "doc_id", text: str = "text", counted: str | None = "n_entities") -> DataFrame:
    """``docs`` with surrogates in ``text``, and the number of mentions in ``counted`` (None: left out).

    Other columns stay as they are. No text stays none, with 0 mentions; texts without entities
    are returned as they came. Rows are followed by a hash of key and text, so equal rows get
    equal results and rows without a key are treated like any other.
    """
    kept = docs.drop(counted) if counted else docs
    row = F.xxhash64(F.col(doc), F.col(text))
    marked = kept.where(may_hold_entities(F.col(text))).select(row.alias("row"), F.col(text).alias("text"))
    mentions = marked.select("row", F.expr(f"regexp_extract_all(text, {_sql(ANY)}, 0)").alias("mentions")).where(F.size("mentions") > 0).dropDuplicates(["row"])
    found = mentions.select("row", F.posexplode("mentions").alias("place", "mention")).withColumn("kind", _kind(F.col("mention")))
    person = F.col("kind") == "person"
    address = F.lower(F.regexp_extract("mention", f"^((?iu:{_ADDRESS}))", 1))
    gender = F.when(address.isin(*map(str.lower, MALE)), "m").when(address.isin(*map(str.lower, FEMALE)), "f").otherwise("o")
    pieces = F.when(person, F.split("mention", " ")).otherwise(F.array("mention"))
    parts = found.withColumn("gender", gender).select("row", "place", "kind", "gender", F.size(pieces).alias("n"), F.posexplode(pieces).alias("nth", "part"))
    named = F.col("kind") == "person"
    title = named & (F.col("nth") == 0)
    family = named & (F.col("nth") == F.col("n") - 1)
    parts = parts.select(
        "row",
        "place",
        "nth",
        "part",
        F.when(title, "title").otherwise(F.col("kind")).alias("kind"),
        # a family name is one entity whoever bears it; a given name goes with its gender
        F.when(family, "s").when(named, F.col("gender")).otherwise("").alias("group"),
        _normal(F.col("kind"), F.col("part")).alias("normal"),
    )
    parts = materialize(parts, "mentions")
    known = dictionary(parts.where(F.col("kind") != "title"), key)
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    drawn = parts.join(known, ["kind", "group", "normal"], "left")
    shown = F.when(F.col("surrogate").isNull(), F.col("part")).otherwise(_render(F.col("kind"), F.col("part"), F.col("surrogate")))
    by_mention = drawn.select("row", "place", "nth", shown.alias("shown")).groupBy("row", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "shown"))), lambda s: s["shown"]), " ").alias("shown"))
    by_row = by_mention.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "shown"))), lambda s: s["shown"]).alias("_shown"))
    # a name that a text gives after a form of address is replaced without one as well; a family name goes first
    names = drawn.where((F.col("kind") == "person") & F.col("surrogate").isNotNull()).groupBy("row", "normal")
    names = names.agg(F.min_by("surrogate", F.struct(F.col("group") != "s", F.col("group"))).alias("surrogate"))
    names = names.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("normal", "surrogate"))).alias("_names"))
    by_row = materialize(by_row.join(names, "row", "left").withColumnRenamed("row", "_row"), "replacements")
    by_row = F.broadcast(by_row) if by_row.count() <= BROADCAST_ROWS else by_row
    joined = kept.join(by_row, row == F.col("_row"), "left")
    gaps = F.split(F.col(text), ANY, -1)
    words = F.transform(gaps, lambda g: F.regexp_extract_all(g, F.lit(UNTITLED), F.lit(0)))
    opened = joined.withColumn("_gaps", F.when(F.col("_shown").isNotNull(), gaps)).withColumn("_words", F.when(F.col("_names").isNotNull(), words))

    def shown_gap(g: Column, found: Column) -> Column:
        new = F.transform(found, lambda w: F.coalesce(_named_like(w, F.try_element_at("_names", F.lower(w))), w))
        return F.array_join(F.zip_with(F.split(g, UNTITLED, -1), new, lambda between, w: F.concat(between, F.coalesce(w, F.lit("")))), "")

    opened = opened.withColumn("_gaps", F.when(F.col("_names").isNotNull(), F.zip_with("_gaps", "_words", shown_gap)).otherwise(F.col("_gaps")))
    known_words = F.size(F.filter(F.flatten("_words"), lambda w: F.try_element_at("_names", F.lower(w)).isNotNull()))
    untitled = F.when(F.col("_names").isNotNull(), known_words).otherwise(0)
    whole = F.concat(F.array_join(F.zip_with(F.slice("_gaps", F.lit(1), F.size("_shown")), F.col("_shown"), lambda g, s: F.concat(g, s)), ""), F.element_at("_gaps", -1))
    changed = F.when(F.col("_shown").isNotNull(), whole).otherwise(F.col(text))
    out = [changed.alias(text) if c == text else F.col(c) for c in kept.columns]
    number = [F.greatest(F.lit(0), F.coalesce(F.size("_shown") + untitled, F.lit(0))).cast("long").alias(counted)] if counted else []
    return opened.select(*out, *number)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
