r"""Surrogates for personal data.

Detected entities (e-mail addresses, phone, card and social security numbers,
IPv4 addresses, access keys and passwords, names behind a title) are replaced
by keyed, type-consistent ones. A surrogate is a function of the key, the kind
and the entity's canonical form, so an entity gets the same one in all
documents and in all its spellings: separators and capitals are those of the
place, letters and digits those of the surrogate. Octets stay octets, a card
number that passes the Luhn check still does, a name keeps its script and the
gender that its titles in the corpus agree on, a surname its feminine ending,
and a surname alone gets the surname of the full name. In a text where a name
stands behind a title, the words of that name are replaced where they stand
without one, too.

Distinct entities are gathered once over the corpus (counts of them combine
map-side). An entity whose surrogate is another's, or is itself an entity of
the corpus, draws again, with the next attempt number; after WIDER attempts with
letters or digits added for each further one (octets of any width), so that a
kind with few values of its form ends as well. After LAST attempts the mapping
gives up with an error rather than with equal surrogates. The
mapping joins the places where entities stand; a very frequent entity is one
key that adaptive execution can split. Texts without entities never move.

Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, keyed_rows, packed, saved, text_of

#: Titles that a name follows, by gender.
MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Г-н", "господин", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Señora", "Г-жа", "госпожа", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof")
_TITLES = "|".join((*MALE, *FEMALE, *NEUTRAL))
_TITLE = rf"^(?:{_TITLES})\.? "
#: What stands before a password or key: a key word in any case, then = or : with blanks and quotes around it.
_KEY = r"(?i:password|passwd|api[_-]?key|secret|token)[\"']?[ \t]{0,8}+(?::=|=>|==|[=:])[ \t]{0,8}+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: A word of a name: capital, with apostrophes, or an initial with its point, which only another word can follow.
_WORD = r"(?:\p{Lu}(?:['’]?\p{L}++)+(?![\p{L}\p{N}])|\p{Lu}\.(?= \p{Lu}))"
#: One pattern per kind; lookarounds and bounded, possessive runs keep the scan linear in long words.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d|\w)",
    "card": r"(?<![\w.+-])\d{4}(?:[ -]?\d{4}){3}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[.-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "secret": rf"(?<![A-Za-z0-9])AKIA[0-9A-Z]{{16}}(?![A-Za-z0-9])|{_KEY}(?:\"[^\"\r\n]{{4,}}+(?=\")|'[^'\r\n]{{4,}}+(?=')|[\"']?(?![=:])[^\s\"']{{4,}}+)",
    "name": rf"(?<![\p{{L}}-])(?:{_TITLES})\.? {_WORD}(?:[ -]{_WORD}){{0,7}}+",
}
_BEFORE = rf"^{_KEY}[\"']?"
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Syllables and endings that surrogate names are built of, by script. A surname's second ending is feminine.
SCRIPTS = {
    "Latin": (("ba", "ca", "da", "el", "fa", "ga", "ha", "jo", "ka", "lu", "ma", "ni", "or", "pe", "ro", "sa", "ti", "ve", "wi", "za"), ("us", "o", "an"), ("ia", "a", "ine"), ("son", "mann", "ez", "ard"), ("son", "mann", "ez", "ard")),
    "Cyrillic": (("ба", "ва", "га", "да", "жи", "за", "ко", "ла", "ми", "но", "пе", "ро", "са", "ти", "фе", "чу"), ("ир", "ан", "ей"), ("ия", "ина", "а"), ("ов", "ин", "ев"), ("ова", "ина", "ева")),
    "Greek": (("βα", "γα", "δα", "ζη", "θε", "κα", "λα", "μι", "νι", "πε", "ρο", "σα", "τι", "φι"), ("ος", "ης", "ας"), ("α", "η", "ια"), ("ίδης", "ακης", "ας"), ("ίδη", "ακη", "α")),
}
_SLOT = "array<struct<kind:string,canon:string,prefix:string,shown:string,gender:string>>"
#: Endings of feminine surnames, by script, and what the canonical form has for them; and of surrogates for them.
_FEMALE = {"Cyrillic": ((r"(ов|ев|ёв|ин)а$", "$1"), (r"ская$", "ский")), "Greek": ((r"ς$", ""),)}
#: Attempts after which surrogates grow, and the last one.
WIDER, LAST = 6, 60


def _any(values: tuple[str, ...]) -> str:
    return "^(?:" + "|".join(values) + r")\.? "


def _kind(e: Column) -> Column:
    found = F.when(e.rlike(_TITLE + r"\p{Lu}"), "name").when(e.rlike(f"^(?:{PATTERNS['email']})$"), "email").when(e.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip")
    found = found.when(e.rlike(r"^\d{4}(?:[ -]?\d{4}){3}$"), "card").when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
    found = found.when(e.rlike(r"^[+(\d][\d ().+-]+$") & ~e.rlike(r"^\d+$"), "phone").otherwise("secret")
    # behind a key word, a value that is another kind as a whole keeps that kind
    value, behind = F.regexp_replace(e, _BEFORE, ""), F.lit("secret")
    for kind in ("phone", "ssn", "card", "ip", "email"):
        behind = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(behind)
    return F.when(e.rlike(_BEFORE), behind).otherwise(found)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^[Ѐ-ӿ]"), "Cyrillic").when(word.rlike(r"^[Ͱ-Ͽἀ-῿]"), "Greek").otherwise("Latin")


def slots_of(e: Column) -> Column:
    """What is replaced in an entity, each with the text before it: all of it, what stands behind a key word, or the words of a name."""
    kind = _kind(e)
    value = F.regexp_replace(e, _BEFORE, "")
    canon = F.when(kind.isin("card", "ssn", "phone"), F.regexp_replace(value, r"\D", "")).when((kind == "email") | value.rlike("^[0-9A-F]+$"), F.lower(value)).otherwise(value)
    # a number of ten digits is the same with and without the country code of North America before it
    code = F.when(kind == "phone", F.regexp_extract(value, r"^\+1[ .-]?(?=\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}$)", 0)).otherwise("")
    value, canon = F.substr(value, F.length(code) + 1), F.when(code != "", F.substr(canon, F.lit(2))).otherwise(canon)
    whole = F.array(F.struct(kind.alias("kind"), canon.alias("canon"), F.concat(F.regexp_extract(e, _BEFORE, 0), code).alias("prefix"), value.alias("shown"), F.lit("u").alias("gender")))
    gender = F.when(e.rlike(_any(MALE)), "m").when(e.rlike(_any(FEMALE)), "f").otherwise("u")
    names = _name_slots(F.regexp_replace(e, _TITLE, ""), F.regexp_extract(e, _TITLE, 0), gender, F.lit(None).cast("array<string>"))
    return F.when(kind == "name", names).otherwise(whole.cast(_SLOT))


def _canon_name(word: Column, surname: Column) -> Column:
    """A name's word in lower case, without an initial's point; a surname in its masculine form."""
    out = F.rtrim(F.lower(word), F.lit("."))
    for script, endings in _FEMALE.items():
        for pattern, male in endings:
            out = F.when(surname & (_script(word) == script), F.regexp_replace(out, pattern, male)).otherwise(out)
    return out


def _name_slots(name: Column, title: Column, gender: Column, surnames: Column) -> Column:
    """The slots of a name's words; the last is a surname, but in a mention without a title only if it is among the text's surnames."""
    words, between = F.split(name, "[ -]"), F.regexp_extract_all(name, F.lit("([ -])"), 1)

    def slot(w: Column, i: Column) -> Column:
        last = (i == F.size(words) - 1) & (surnames.isNull() | F.array_contains(surnames, F.lower(w)))
        kind = F.concat(F.when(last, "surname:").otherwise("given:"), _script(F.get(words, F.lit(0))))
        return F.struct(kind.alias("kind"), _canon_name(w, last).alias("canon"), F.when(i == 0, title).otherwise(F.get(between, i - 1)).alias("prefix"), w.alias("shown"), gender.alias("gender"))

    return F.transform(words, slot).cast(_SLOT)


def _byte(h: Column, i: Column) -> Column:
    return F.conv(F.substr(h, 2 * F.pmod(i, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a number's digits, modulo ten."""
    n = F.size(digits)
    worth = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda s, x: s + x) % 10


def surrogate(kind: Column, canon: Column, attempt: Column, key: str, gender: Column | None = None) -> Column:
    """The attempt-th surrogate of a canonical entity of that kind (a given name's with its gender: m, f or u), of the same form."""
    gender = F.lit("u") if gender is None else gender
    seed = lambda what: F.sha2(F.concat_ws("\0", F.lit(key), kind, attempt.cast("string"), what), 512)
    h, dom = seed(canon), F.sha2(F.concat_ws("\0", F.lit(key), F.substring_index(canon, "@", -1)), 512)
    at, dot = F.instr(canon, "@"), F.length(canon) - F.length(F.substring_index(canon, ".", -1))
    hexes = (kind == "secret") & canon.rlike("^[0-9a-f]+$")

    def drawn(c: Column, i: Column) -> Column:
        b = F.when((kind == "email") & (i + 1 > at), _byte(dom, i - at)).otherwise(_byte(h, i))
        keep = ((kind == "email") & (i + 1 > dot)) | ((kind == "secret") & canon.startswith("AKIA") & (i < 4)) | (kind.isin("card", "phone") & (i == 0))
        digit = F.when((kind == "ssn") & (i == 0), 1 + b % 8).when((kind == "phone") & (i == 1), 2 + b % 8).otherwise(b % 10).cast("string")
        new = F.when(keep, c).when(hexes, F.substr(F.lit("0123456789abcdef"), b % 16 + 1, F.lit(1)))
        new = new.when((kind == "secret") & c.rlike(r"[^\x00-\x7F]"), F.char(97 + b % 26))
        return new.when(c.rlike(r"^\d$"), digit).when(c.rlike("^[a-z]$"), F.char(97 + b % 26)).when(c.rlike("^[A-Z]$"), F.char(65 + b % 26)).otherwise(c)

    same = F.array_join(F.transform(_chars(canon), drawn), "")
    octet = lambda o, i: F.when(attempt >= WIDER, 1 + _byte(h, i) % 254).when(F.length(o) == 3, 100 + _byte(h, i) % 100).when(F.length(o) == 2, 10 + _byte(h, i) % 90).otherwise(1 + _byte(h, i) % 9).cast("string")
    ip = F.array_join(F.transform(F.split(canon, r"\."), octet), ".")
    body = F.substr(same, F.lit(1), F.length(same) - 1)
    check = (10 - _luhn(_chars(F.concat(body, F.lit("0"))))) % 10
    card = F.when(_luhn(_chars(canon)) == 0, F.concat(body, check.cast("string"))).otherwise(same)
    # a form with few letters and digits has few surrogates: later attempts are longer
    more = F.greatest(attempt - F.when(kind == "secret", 2).otherwise(WIDER - 1), F.lit(0))
    digits = F.translate(h, "abcdef", "012345")
    longer = F.when(kind == "secret", F.concat(same, F.substr(h, F.lit(1), more))).when(kind == "email", F.concat(F.substr(F.translate(h, "0123456789", "ghijklmnop"), F.lit(1), more), same))
    longer = longer.otherwise(F.concat(same, F.substr(digits, F.lit(1), more)))
    out = F.when(kind == "ip", ip).when((kind == "card") & (attempt < WIDER), card)
    for script, (syllables, male, female, sons, _) in SCRIPTS.items():
        pick = lambda words, i: F.get(F.array(*map(F.lit, words)), _byte(h, F.lit(i) if isinstance(i, int) else i) % len(words))  # noqa: E731, B023
        stem = F.array_join(F.transform(F.sequence(F.lit(1), 2 + attempt), lambda i: pick(syllables, i)), "")  # noqa: B023
        given = F.when(gender == "m", pick(male, 0)).when(gender == "f", pick(female, 0)).otherwise(pick((*male, *female), 0))
        out = out.when(kind == f"given:{script}", F.concat(stem, given)).when(kind == f"surname:{script}", F.concat(stem, pick(sons, 0)))
    return out.otherwise(longer)


def mapping(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate for distinct entities (kind, canon and, for given names, gender): no two of a kind share a surrogate, and none is an entity of that kind itself."""
    if "gender" not in entities.columns:
        entities = entities.withColumn("gender", F.lit("u"))
    left, done = entities.withColumn("attempt", F.lit(0)), []
    for attempt in range(LAST + 1):
        drawn = saved(left.withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key, F.col("gender"))), "pii-drawn")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        taken = [entities.select("kind", F.col("canon").alias("surrogate")), *(d.select("kind", "surrogate") for d in done)]
        won = first.join(reduce(DataFrame.union, taken), ["kind", "surrogate"], "left_anti")
        won = saved(won.select("kind", "canon", "surrogate"), "pii-map")
        done.append(won)
        last, left = left if attempt else None, saved(drawn.join(won, ["kind", "canon"], "left_anti").select("kind", "canon", "gender", F.lit(attempt + 1).alias("attempt")), "pii-left")
        dropped(drawn)
        if last is not None:
            dropped(last)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
    raise RuntimeError(f"no free surrogates for some entities after {LAST} attempts")


def _shown(shown: Column, canon: Column, new: Column) -> Column:
    """new in the spelling of the place: its separators where they aren't part of the canonical form, and its capitals."""
    letters, drawn = _chars(shown), _chars(new)
    spaced = F.aggregate(
        letters,
        F.struct(F.lit("").alias("s"), F.lit(0).alias("i")),
        lambda acc, c: F.when(c.rlike(r"^\d$"), F.struct(F.concat(acc["s"], F.get(drawn, acc["i"])).alias("s"), (acc["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i"))),
        lambda acc: acc["s"],
    )
    cased = F.array_join(F.transform(drawn, lambda c, i: F.when(F.upper(F.get(letters, i)) != F.lower(F.get(letters, i)), F.when(F.get(letters, i) == F.upper(F.get(letters, i)), F.upper(c)).otherwise(F.lower(c))).otherwise(c)), "")
    return F.when(shown == canon, new).when(shown.rlike("^[0-9A-F]+$"), F.upper(new)).when(F.length(shown) != F.length(canon), spaced).when(shown.rlike(r"^[\d+]"), spaced).otherwise(cased)


def _female(kind: Column, shown: Column, new: Column) -> Column:
    """A surname's surrogate, in the feminine form where the name of the place has one."""
    out = new
    for script, endings in _FEMALE.items():
        sons, daughters = SCRIPTS[script][3:]
        form = new
        for male, female in zip(sons, daughters, strict=True):
            form = F.when(new.endswith(male), F.concat(F.substr(new, F.lit(1), F.length(new) - len(male)), F.lit(female))).otherwise(form)
        feminine = ~F.lower(shown).endswith("ς") if script == "Greek" else reduce(Column.__or__, (F.lower(shown).rlike(p) for p, _ in endings))
        out = F.when((kind == f"surname:{script}") & feminine, form).otherwise(out)
    return out


def _name_shown(shown: Column, new: Column) -> Column:
    """With the capitals of the place; an initial stays one."""
    first = F.concat(F.upper(F.substr(new, F.lit(1), F.lit(1))), F.lit("."))
    return F.when(shown.endswith("."), first).when((F.length(shown) > 1) & (shown == F.upper(shown)), F.upper(new)).otherwise(F.concat(F.upper(F.substr(new, F.lit(1), F.lit(1))), F.substr(new, F.lit(2))))


def _last(e: Column) -> Column:
    return F.element_at(F.split(e, "[ -]"), -1)


def _mentions(titled: Column) -> Column:
    """A pattern of the names' own words and runs of them, the longest first, where no other letters adjoin."""
    names = F.transform(titled, lambda e: F.regexp_replace(e, _TITLE, ""))
    words = F.filter(F.flatten(F.transform(names, lambda n: F.split(n, "[ -]"))), lambda w: (F.length(w) > 2) & ~w.endswith("."))
    all_ = F.array_sort(F.array_distinct(F.concat(names, words)), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.concat(F.lit(r"(?<![\p{L}\p{N}'’-])(?:"), F.array_join(F.transform(all_, lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))), "|"), F.lit(r")(?![\p{L}\p{N}'’-])"))


def with_surrogates(docs: DataFrame, key: str = "ledgerline") -> DataFrame:
    """docs with its columns, text with surrogates for its entities, and n_entities (places replaced).

    Null texts stay null and empty ones empty, with 0 places. Rows that repeat
    get equal texts. A column named n_entities is replaced, all others come
    back as they are.
    """
    rows = keyed_rows(docs, packed(docs))
    found = keyed_rows(docs, F.regexp_extract_all(text_of(docs), F.lit(f"({ENTITY})"), 1).alias("found"), text_of(docs).alias("text"))
    titled = F.filter("found", lambda e: e.rlike(_TITLE + r"\p{Lu}") & (_kind(e) == "name"))
    found = found.where(F.size("found") > 0).withColumn("titled", titled).withColumn("text", F.when(F.size("titled") > 0, F.col("text")))
    bare = _mentions(F.col("titled"))
    found = found.dropDuplicates(["r1", "r2"]).withColumn("also", F.when(F.size("titled") > 0, bare))
    # a text with names is read again, with its own names among what is looked for
    found = found.withColumn("found", F.when(F.col("also").isNotNull(), F.regexp_extract_all("text", F.concat(F.lit(f"({ENTITY}|"), "also", F.lit(")")), 1)).otherwise(F.col("found")))
    found = saved(found.select("r1", "r2", "found", "also", F.transform("titled", lambda e: F.lower(_last(e))).alias("surnames")), "pii-found")
    places = found.select("r1", "r2", "also", "surnames", F.posexplode("found").alias("place", "entity"))
    e = F.col("entity")
    slots = F.when(F.col("also").isNotNull() & F.rlike(e, F.concat(F.lit("^(?:"), F.col("also"), F.lit(r")\z"))) & ~e.rlike(_TITLE), _name_slots(e, F.lit(""), F.lit("u"), F.col("surnames"))).otherwise(slots_of(e))
    slots = places.select("r1", "r2", "place", F.posexplode(slots).alias("slot", "s")).select("r1", "r2", "place", "slot", "s.*")
    slots = saved(slots, "pii-slots")
    men, women = (F.max(F.col("gender") == g) for g in "mf")
    gender = F.when(men & ~women, "m").when(women & ~men, "f").otherwise("u")
    known = mapping(saved(slots.groupBy("kind", "canon").agg(gender.alias("gender")), "pii-entities"), key)
    name = F.col("kind").contains(":")
    as_name = _name_shown(F.col("shown"), _female(F.col("kind"), F.col("shown"), F.col("surrogate")))
    put = slots.join(known, ["kind", "canon"]).select(
        "r1", "r2", F.struct("place", "slot", F.concat("prefix", F.when(name, as_name).otherwise(_shown(F.col("shown"), F.col("canon"), F.col("surrogate")))).alias("new")).alias("p")
    )
    put = put.groupBy("r1", "r2").agg(F.sort_array(F.collect_list("p")).alias("put")).join(found.select("r1", "r2", "also"), ["r1", "r2"])
    out = rows.join(put, ["r1", "r2"], "left")
    text = F.col("own.text").cast("string")
    here = lambda i: F.array_join(F.transform(F.filter("put", lambda p: p["place"] == i), lambda p: p["new"]), "")
    between = F.when(F.col("also").isNull(), F.split(text, ENTITY)).otherwise(F.split(text, F.concat(F.lit(f"{ENTITY}|"), "also")))
    written = F.array_join(F.transform(between, lambda c, i: F.concat(c, here(i))), "")
    n = F.coalesce(F.size(F.array_distinct(F.transform("put", lambda p: p["place"]))), F.lit(0)).cast("long")
    new = F.when(F.col("put").isNull(), text).otherwise(written)
    return out.select(*(new.alias("text") if c == "text" else F.col("own")[c].alias(c) for c in docs.columns if c != "n_entities"), n.alias("n_entities"))


def surrogate_report(docs: DataFrame, key: str = "ledgerline") -> DataFrame:
    """doc_id, n_entities, text_sha256 of the text with surrogates for every row."""
    out = with_surrogates(docs.select("doc_id", "text"), key)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_entities", F.sha2(text, 256).alias("text_sha256"))
