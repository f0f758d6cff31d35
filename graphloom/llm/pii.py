"""Operator 1: surrogates for personal data.

Entities are e-mail addresses, telephone, card, account and social-security
numbers, IPv4 and IPv6 addresses, access keys and secrets, names after a form of
address, and what bears such a name elsewhere in the same text: the full name or
its last word. An entity's surrogate is a keyed function of its canonical form,
so that an entity is replaced alike wherever and however it is written.

All kinds but names go through a keyed permutation of the strings of their
shape (an alternating Feistel network over letters and digits, each staying
within its own alphabet): equal shapes have distinct surrogates, separators
and format stay, a card's check digit is made right again. A name is replaced
word by word, each by its own key, in the script of its letters; the gender
chooses only which list a first name comes from. It is that of the form of
address, after a neutral one that of the same first name elsewhere in the text,
else that which the first name's ending suggests. A Slavic surname's ending
stays masculine or feminine, with one stem for both. A check
over all distinct entities of the corpus finds surrogates that two entities
share or that are themselves an entity of the corpus; the later entity takes
its next surrogate until there are none, from a space of names that grows with
the attempts. (A full name that had to move and its last word alone may then
differ in that word.)

DataFrame operations only: texts are cut at their entities and joined again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.columns import numbered, place
from graphloom.llm.store import staged

KEY = "change-me"
#: Forms of address by gender; the neutral ones keep an even mix.
MALE, FEMALE, NEUTRAL = ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Don", "г-н"], ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Doña", "г-жа"], ["Dr", "Prof"]
FIRST = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Kaspar", "Leon", "Martin", "Nils", "Oscar", "Paul", "Quentin", "Robert", "Simon", "Tomas", "Urban", "Victor", "Walter", "Xavier"],
    ("f", "latin"): ["Anna", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Katia", "Laura", "Maria", "Nora", "Olga", "Paula", "Quinta", "Rosa", "Sofia", "Teresa", "Ursula", "Vera", "Wanda", "Xenia"],
    ("m", "cyrillic"): ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Сергей"],
    ("f", "cyrillic"): ["Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса"],
}
SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ha", "he", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "pa", "pe", "ra", "re", "ro", "sa", "se", "so", "ta", "te", "to", "va", "ve", "vo", "wa", "we"],
    "cyrillic": ["ба", "бе", "бо", "ва", "ве", "во", "га", "го", "да", "де", "до", "жа", "за", "зо", "ка", "ке", "ко", "ла", "ле", "ло", "ма", "ме", "мо", "на", "не", "но", "па", "по", "ра", "ре", "ро", "са", "се", "со", "та", "те", "то", "фа", "ша", "шо"],
}
_ADDRESS = f"(?=[{''.join(sorted({x[0] for x in [*MALE, *FEMALE, *NEUTRAL]}))}])(?:{'|'.join([*MALE, *FEMALE, *NEUTRAL])})"
#: A word of a name: Smith, McDonald, O'Brien, D’Angelo.
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:['’]?\p{Lu}\p{Ll}+)*(?![\p{L}])"
#: Marks that stand in a text's list of entities, not in texts: a name without a form of address, and a gender found elsewhere.
_BARE, _TOLD = "\u0002", "\u0001"
_SECRET = r"(?:token|api[_-]?key|secret|password|passwd|pwd)\s{0,3}[=:]\s{0,3}[\"']?"
#: A secret's value runs over letters, digits and these; a stop at its end is the sentence's. Four letters or digits at least, so that it can change.
_MARKS = r"[_\-+/=.~!#$%*@^]"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\p{L}\p{N}])",
    "secret": rf"(?<![\p{{L}}\p{{N}}])(?i:{_SECRET})(?=(?:{_MARKS}*[A-Za-z0-9]){{4}})[A-Za-z0-9{_MARKS[1:]}{{8,}}(?<!\.)",
    "access_key": r"(?<![\p{L}\p{N}])(?:AKIA|ASIA)[A-Z0-9]{16}(?![\p{L}\p{N}])",
    "account": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}.+-])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])",
    "social": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    # Three groups between spaces are a telephone number only with a country code, brackets or a word that says so: tables have them too.
    "phone": r"(?<![\p{L}\p{N}.+-])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}.+-])[0-9]{3}(?:-[0-9]{3,4}-|\.[0-9]{3,4}\.)[0-9]{4}(?![\p{L}\p{N}]|[.-][0-9])|(?<=(?i:tel|phone|call|fax|mobile|cell)[.:]{0,2} )[0-9]{3,4}(?: [0-9]{3,4}){2}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![\p{L}\p{N}])",
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_ADDRESS})\.? {_WORD}(?:[ -]{_WORD}){{0,2}}",
}
_GROUPLESS = {**PATTERNS, "card": r"(?<![\p{L}\p{N}.+-])[0-9]{4}(?:[0-9]{12}|(?: [0-9]{4}){3}|(?:-[0-9]{4}){3})(?![\p{L}\p{N}])"}
ENTITY = "|".join(f"(?:{p})" for p in _GROUPLESS.values())
#: What every text with an entity has: cheaper to look for than the entities.
_NAMED = rf"^(?:(?:{_ADDRESS})\.? |{_BARE})"
HINT, ADDRESSED = r"[0-9@=:]", rf"(?<![\p{{L}}\p{{N}}])(?:{_ADDRESS})\.? \p{{Lu}}"
#: Turns of the permutation; attempts at a surrogate that is free, each from a permutation of its own.
ROUNDS, ATTEMPTS = 4, 256


def _kind(entity: Column) -> Column:
    """The kind of a string that matched ``ENTITY``."""
    return (
        F.when(entity.rlike(r"^[^\s=:]+@"), "email").when(entity.rlike(rf"^(?i:{_SECRET})"), "secret").when(entity.rlike(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$"), "access_key")
        .when(entity.rlike(_NAMED), "name").when(entity.rlike(r"^[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]*$"), "ip6").when(entity.rlike(r"^[A-Z]{2}[0-9]{2}"), "account").when(entity.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
        .when(entity.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "social").when(entity.rlike(r"^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), "card").otherwise("phone")
    )


def _fixed(entity: Column, kind: Column) -> Column:
    """The head of an entity that stays: a secret's label, a key's prefix, a country code, a form of address, a card's issuer."""
    return (
        F.when(kind == "secret", F.regexp_extract(entity, rf"^(?i:{_SECRET})", 0)).when(kind == "access_key", F.substring(entity, 1, 4)).when(kind == "account", F.substring(entity, 1, 2))
        .when(kind == "phone", F.regexp_extract(entity, r"^\+[0-9]{1,3}(?=[ .(-])[ .-]?|^\+[0-9]{2}|^", 0)).when(kind == "name", F.regexp_extract(entity, _NAMED, 0)).when(kind == "card", F.substring(entity, 1, 1)).otherwise("")
    )


def _canonical(entity: Column, kind: Column) -> Column:
    """What tells entities of a kind apart: their letters and digits, in lower case where case says nothing."""
    head, plain = _fixed(entity, kind), F.substring(entity, F.length(_fixed(entity, kind)) + 1, F.length(entity))
    name = F.concat_ws(" ", F.transform(F.split(_bare_name(entity), "[ -]"), _stem))
    return F.when(kind == "name", F.concat(F.when(name.contains(" "), _gender(entity)).otherwise(""), F.lit(":"), name)).when(kind.isin("email", "ip6"), F.lower(entity)).when(kind.isin("ip", "secret", "access_key"), plain).otherwise(F.concat(F.regexp_replace(head, r"[ .(-]", ""), F.lit(":"), F.regexp_replace(plain, r"[ ().-]", "")))


def _bare_name(entity: Column) -> Column:
    """A name without its form of address and marks."""
    return F.regexp_replace(entity, rf"{_NAMED}|{_TOLD}.*$", "")


def _stem(word: Column) -> Column:
    """One form for both of a Slavic surname's, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(word), "(?<=\\p{IsCyrillic}(?:ов|ев|ин|ын))а$", ""), "ская$", "ский")


def _gender(entity: Column) -> Column:
    """m, f or n: as told by its mark, else by its form of address."""
    told, bare = F.regexp_extract(entity, rf"{_TOLD}(.)$", 1), F.regexp_replace(F.regexp_extract(entity, _NAMED, 0), r"[. ]", "")
    return F.when(told != "", told).when(bare.isin(MALE), "m").when(bare.isin(FEMALE), "f").otherwise("n")


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def _number(digest: Column, place: Column | int) -> Column:
    """0 to 65535, from one of the digest's 16 places."""
    return F.conv(F.substring(digest, (F.lit(place) if isinstance(place, int) else place) % 16 * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _permute(text: Column, key: Column, hexadecimal: Column | None = None) -> Column:
    """A keyed permutation of the strings of a shape: letters and digits change within their alphabets, the rest stays.

    In turn, the characters at even and at odd places stay and say, through a digest, how far the others move.
    """
    letters = F.lit(26) if hexadecimal is None else F.when(hexadecimal, 6).otherwise(26)

    def moved(c: Column, step: Column) -> Column:
        code = F.ascii(c)
        return F.when(c.rlike("^[0-9]$"), F.char(48 + (code - 48 + step) % 10)).when(c.rlike("^[a-z]$"), F.char(97 + (code - 97 + step) % letters)).when(c.rlike("^[A-Z]$"), F.char(65 + (code - 65 + step) % letters)).otherwise(c)

    def one_turn(chars: Column, turn: Column) -> Column:
        stay = F.array_join(F.filter(chars, lambda c, i: i % 2 == turn % 2), "")
        digest = _digest(key, turn.cast("string"), F.size(chars).cast("string"), stay)
        return _let(digest, lambda d: F.transform(chars, lambda c, i: F.when(i % 2 == turn % 2, c).otherwise(moved(c, _number(d, i)))))

    return F.array_join(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.split(text, ""), one_turn), "")


def _permute_address(plain: Column, key: Column) -> Column:
    """The same for an IPv4 address, as two halves of 16 bits."""
    octets = F.transform(F.split(plain, r"\."), lambda o: o.cast("int"))

    def one_turn(h: Column, turn: Column) -> Column:
        moved = (h["a"] + _number(_digest(key, turn.cast("string"), h["b"].cast("string")), 0)) % 65536
        return F.struct(h["b"].alias("a"), moved.alias("b"))

    halves = _let(octets, lambda o: F.struct((F.get(o, 0) * 256 + F.get(o, 1)).alias("a"), (F.get(o, 2) * 256 + F.get(o, 3)).alias("b")))
    made = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, one_turn)
    return _let(made, lambda h: F.concat_ws(".", *[x.cast("string") for x in (F.floor(h["a"] / 256), h["a"] % 256, F.floor(h["b"] / 256), h["b"] % 256)]))


def _luhn_digit(digits: Column) -> Column:
    """The check digit of the 15 digits before it."""
    doubled = F.transform(F.split(digits, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return ((10 - F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")


def _is_luhn(digits: Column) -> Column:
    return _luhn_digit(F.substring(digits, 1, 15)) == F.substring(digits, 16, 1)


def _reshape(digits: Column, form: Column) -> Column:
    """``form`` with its letters and digits taken, in order, from ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    taken = F.aggregate(F.split(form, ""), start, lambda a, c: F.when(c.rlike("^[A-Za-z0-9]$"), F.struct(F.concat(a["out"], F.substring(digits, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))))
    return taken["out"]


def _pick(words: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), number % len(words) + 1)


def _name(plain: Column, gender: Column, key: Column, attempt: Column) -> Column:
    """A name of as many words in the script of the given one, the first of the gender; each word is replaced by its own key."""
    script = F.when(plain.rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    whole, between = F.split(plain, "[ -]"), F.regexp_extract_all(plain, F.lit("[ -]"), F.lit(0))

    def first(word: Column, digest: Column) -> Column:
        side = F.when(gender != "n", gender).when(F.lower(word).rlike("[aeаяé]$"), "f").otherwise("m")
        return reduce(lambda a, k: F.when((side == k[0]) & (script == k[1]), _pick(FIRST[k], _number(digest, 0))).otherwise(a), FIRST, F.lit("").cast("string"))

    def last(word: Column, digest: Column) -> Column:
        made = [F.array_join(F.transform(F.sequence(F.lit(0), 3 + F.floor(attempt / 8).cast("int")), lambda i: _pick(SYLLABLES[s], _number(digest, i % 16))), "") for s in ("latin", "cyrillic")]  # noqa: B023
        low = F.lower(word)
        end = F.when(script == "latin", "n").when(low.rlike("(?:ов|ев|ин|ын)а$|ская$"), "нова").when(low.rlike("(?:ов|ев|ин|ын|ский)$"), "нов").otherwise("нко")
        return F.initcap(F.concat(F.when(script == "latin", made[0]).otherwise(made[1]), end))

    def word_for(word: Column, i: Column) -> Column:
        is_first = (i == 0) & plain.contains(" ")
        part = F.when(is_first, "first").otherwise("last")
        return _let(_digest(key, part, _stem(word)), lambda d: F.when(is_first, first(word, d)).otherwise(last(word, d)))

    return F.array_join(F.zip_with(F.transform(whole, word_for), between, lambda w, b: F.concat(w, F.coalesce(b, F.lit("")))), "")


def surrogate(entity: Column, key: Column, attempt: Column | None = None) -> Column:
    """The surrogate of one of ``entities``."""
    attempt = F.lit(0) if attempt is None else attempt
    split = _let(_kind(entity), lambda k: F.struct(k.alias("kind"), _fixed(entity, k).alias("head")))

    def by_kind(s: Column) -> Column:
        kind, head = s["kind"], s["head"]
        plain = F.substring(entity, F.length(head) + 1, F.length(entity))
        compact = F.regexp_replace(plain, r"[^A-Za-z0-9]", "")
        keyed = F.concat_ws("|", key, kind)

        def card(c: Column) -> Column:
            checked = _let(_permute(F.substring(c, 1, 14), keyed), lambda p: F.concat(p, _luhn_digit(F.concat(head, p))))
            return F.when(_is_luhn(F.concat(head, c)), checked).otherwise(_permute(c, keyed))

        low = F.lower(entity)
        local, host = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
        last = F.substring_index(host, ".", -1)
        email = F.concat(_permute(local, F.concat(keyed, F.lit("|local"))), F.lit("@"), _permute(F.substring(host, F.lit(1), F.length(host) - F.length(last) - 1), F.concat(keyed, F.lit("|host"))), F.lit("."), last)
        return (
            F.when(kind == "email", email).when(kind == "ip", _permute_address(plain, keyed)).when(kind == "ip6", _permute(low, keyed, F.lit(True))).when(kind == "name", F.concat(F.regexp_replace(head, _BARE, ""), _name(_bare_name(entity), _gender(entity), keyed, attempt)))
            .when(kind == "card", F.concat(head, _reshape(card(compact), plain))).when(kind.isin("secret", "access_key"), F.concat(head, _permute(plain, keyed, plain.rlike("^[0-9a-f]+$"))))
            .otherwise(F.concat(head, _reshape(_permute(compact, keyed), plain)))
        )

    return _let(split, by_kind)


def _learned(text: Column) -> Column:
    """The names after forms of address in a text, as written there; none for most texts."""
    return F.filter(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), lambda e: e.rlike(_NAMED))


def _pattern(names: Column) -> Column:
    """``ENTITY``, and the full names and last words of ``names`` wherever they stand by themselves."""
    full = F.transform(names, _bare_name)
    last = F.filter(F.transform(full, lambda n: F.regexp_extract(n, r"[^ ]+$", 0)), lambda w: F.length(w) >= 3)
    listed = F.array_sort(F.array_distinct(F.concat(full, last)), lambda a, b: F.length(b) - F.length(a))
    return F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}@.'’-])(?:"), F.array_join(listed, "|"), F.lit(r")(?![\p{L}\p{N}@'’])"))


def entities(text: Column, between: bool = False) -> Column:
    """The entities of a text in order, with marks on names; with ``between`` a struct (found, between) of them and of what stands before, between and after them.

    Both are empty for null and for texts without entities.
    """
    none = F.array().cast("array<string>")

    def parts(found: Column, pattern: Column | str) -> Column:
        return F.struct(found.alias("found"), F.split(text, pattern, -1).alias("between")) if between else found

    def marked(names: Column, entity: Column) -> Column:
        """A name with what the text's other names say of its gender."""
        plain = _bare_name(entity)
        head = F.substring_index(plain, " ", 1)
        known = F.filter(names, lambda n: (_gender(n) != "n") & (F.substring_index(_bare_name(n), " ", 1) == head))
        side = F.when(plain.contains(" "), F.coalesce(_gender(F.get(known, 0)), F.lit("n"))).otherwise("n")
        return F.when(_gender(entity) != "n", entity).otherwise(F.concat(entity, F.lit(_TOLD), side))

    def with_names(names: Column) -> Column:
        pattern = _pattern(names)
        full = F.transform(names, _bare_name)
        known = F.concat(full, F.transform(full, lambda n: F.regexp_extract(n, r"[^ ]+$", 0)))
        bare = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda e: F.when(F.array_contains(known, e), F.concat(F.lit(_BARE), e)).otherwise(e))
        found = F.transform(bare, lambda e: F.when(e.rlike(_NAMED), marked(names, e)).otherwise(e))
        return parts(found, pattern)

    plain = parts(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), ENTITY)
    named = _let(_learned(text), lambda names: F.when(F.size(names) > 0, with_names(names)).otherwise(plain))
    return F.when(text.rlike(ADDRESSED), named).when(text.rlike(HINT), plain).otherwise(F.struct(none.alias("found"), none.alias("between")) if between else none)


def clashes(found: DataFrame, key: str) -> DataFrame:
    """(entity, replacement): the written forms whose first surrogate another entity shares, or which is an entity itself.

    ``found`` has distinct entities as written (``entity``). Canonical forms take the next attempt, the smallest
    keeping its first, until all surrogates differ from one another and from all entities.
    """
    kind = _kind(F.col("entity"))
    known = staged(found.select("entity", kind.alias("kind"), _canonical(F.col("entity"), kind).alias("canonical")), "entities")
    forms = known.groupBy("kind", "canonical").agg(F.min("entity").alias("entity"))
    originals = forms.select("kind", "canonical")

    def attempt(rows: DataFrame, number: int) -> DataFrame:
        dealt = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "canonical")  # few bytes, but work for all cores
        made = staged(dealt.withColumn("written", surrogate(F.col("entity"), F.lit(f"{key}|{number}" if number else key), F.lit(number))), "made")
        # a name's surrogate is compared as what it is written as, with the entity's own gender
        written = F.when((F.col("kind") == "name") & ~F.col("written").rlike(_NAMED), F.concat(F.lit(_BARE), "written")).otherwise(F.col("written"))
        written = F.when(F.col("kind") == "name", F.concat(written, F.lit(_TOLD), _gender(F.col("entity")))).otherwise(written)
        return made.withColumn("made", _canonical(written, F.col("kind"))).drop("written")

    def settle(rows: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows whose surrogates stand, and rows that need another."""
        lowest = rows.groupBy("kind", "made").agg(F.min("canonical").alias("lowest"))
        marked = rows.join(lowest, ["kind", "made"]).join(taken.select("kind", F.col("canonical").alias("made"), F.lit(True).alias("used")).distinct(), ["kind", "made"], "left")
        good = (F.col("canonical") == F.col("lowest")) & F.col("used").isNull()
        marked = staged(marked, "surrogates")
        return marked.where(good).select("kind", "canonical", "entity", "made"), marked.where(~good).select("kind", "canonical", "entity")

    stand, rest = settle(attempt(forms, 0), originals)
    moved, number = None, 0
    while rest.limit(1).count():
        number += 1
        if number > ATTEMPTS:
            raise RuntimeError(f"entities are left without a surrogate of their shape after {ATTEMPTS} attempts")
        taken = originals.union(stand.select("kind", F.col("made").alias("canonical")))
        if moved is not None:
            taken = taken.union(moved.select("kind", F.col("made").alias("canonical")))
        good, rest = settle(attempt(rest, number), taken)
        good = good.withColumn("attempt", F.lit(number))
        moved = good if moved is None else moved.union(good)
    if moved is None:
        return known.select("entity", F.col("entity").alias("replacement")).limit(0)
    keyed = F.concat(F.lit(f"{key}|"), F.col("attempt").cast("string"))
    return known.join(moved.select("kind", "canonical", "attempt"), ["kind", "canonical"]).select("entity", surrogate(F.col("entity"), keyed, F.col("attempt")).alias("replacement"))


def replace_entities(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY, count_col: str | None = None) -> DataFrame:
    """``documents`` with each entity in ``text_col`` replaced by its surrogate, and their number in ``count_col`` on request.

    Every row stays; null texts stay null, and texts without entities stay as they are. Equal rows are changed alike.
    Other columns are kept, whatever their names.
    """
    changed = _replaced(numbered(documents), place(documents, id_col), place(documents, text_col), key, count_col is not None)
    return changed.toDF(*documents.columns, *([count_col] if count_col else []))


def _replaced(documents: DataFrame, id_col: str, text_col: str, key: str, counted: bool) -> DataFrame:
    """``replace_entities`` of numbered columns, whose names are none of those added here."""
    listed = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.explode(entities(F.col(text_col))).alias("entity"))
    listed = staged(listed.distinct(), "found")
    changed = staged(clashes(listed.select("entity").distinct(), key), "clashes")
    joined, own = documents, F.lit(None).cast("map<string,string>")
    if changed.limit(1).count():
        other = listed.join(changed, "entity").groupBy("id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("entity", "replacement"))).alias("_pii_own"))
        other = other.select(F.col("id").alias("_pii_id"), F.col("text_hash").alias("_pii_hash"), "_pii_own")
        joined, own = documents.join(other, F.col(id_col).eqNullSafe(F.col("_pii_id")) & (F.xxhash64(text_col) == F.col("_pii_hash")), "left"), F.col("_pii_own")
    found, between = F.col("_pii")["found"], F.col("_pii")["between"]
    made = F.transform(found, lambda e: F.coalesce(F.element_at(own, e), surrogate(e, F.lit(key))))
    woven = F.array_join(F.zip_with(between, made, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    joined = joined.withColumn("_pii", entities(F.col(text_col), between=True))
    columns = [F.when(F.size(found) > 0, woven).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in documents.columns]
    if counted:
        columns.append(F.size(found).cast("long").alias("n_entities"))
    return joined.select(*columns)
