"""Personal data and secrets are detected and replaced by surrogates of the same kind, shape, script and gender.

A surrogate is a keyed function of the entity's kind and normal form, so mentions of one entity agree in all documents and
spellings. The distinct entities of the corpus are checked: where two have the same surrogate, or one has a real entity as
its surrogate, the later is drawn anew until all differ. All is DataFrame functions; texts are rewritten in one narrow pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialise
from .given_names import GIVEN

#: Titles by gender (n: of either), and patterns of the kinds, tried in this order at each place.
TITLES = {
    "m": ("Mr", "Mister", "Herr", "Señor", "Sr", "Don", "Monsieur", "Signor", "Sir", "Lord", "г-н", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Lady", "Dame", "Frau", "Fräulein", "Señora", "Señorita", "Sra", "Srta", "Doña", "Dra", "Doctora", "Madame", "Mademoiselle", "Mme", "Mlle", "Signora", "г-жа", "госпожа"),
    "n": ("Mx", "Dr", "Doctor", "Doktor", "Docteur", "Prof", "Professor", "Professeur", "Rev", "Reverend", "доктор", "профессор"),
}
_TITLE = "|".join(t for g in TITLES.values() for t in g)
#: Open-ended parts are possessive or start at a token's start, so that matching takes linear time and no stack on any text.
_TITLED = rf"(?:(?:{_TITLE})\.? ){{1,4}}"
_GIVEN = "|".join(n for g in GIVEN.values() for n in g)
#: A capitalised word of a name, such as Smith or McDonald; a name's words stand alone or after O', with hyphens or spaces between.
_PART = r"\p{Lu}\p{Ll}++(?:\p{Lu}\p{Ll}++)*+"
_WORD = rf"(?:\p{{Lu}}['’])?{_PART}(?:-{_PART})*+"
_LAST = rf"(?: \p{{Lu}}\.)*+(?: (?:von|van|der|den|de|la|las|los|del|di|da|du|le|bin|al)(?= ))*+ {_WORD}"
_GAP = r"[^\p{L}\p{N}+]"
#: Country codes. Phones are (a) of the old table's shape, (b) with a country code in any grouping, up to a card, (c) North American without a country code, (d) with a trunk zero.
_COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_AMERICAN = r"(?<![\p{L}\p{N}+])(?<![0-9][-. ])(?:1[ .-])?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[-. ])[0-9]{3}[-.][0-9]{4}(?![0-9]|[-.][0-9])"
PHONES = (
    rf"\+[0-9]{{1,3}}{_GAP}{{1,6}}[0-9]{{3}}{_GAP}{{1,6}}[0-9]{{3}}{_GAP}{{1,4}}[0-9]{{4}}(?![0-9])",
    r"(?:\+|(?<![\p{L}\p{N}.,+-])00)[1-9](?:(?! [0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9]))[ ()./-]{0,3}[0-9]){7,14}(?![0-9])",
    _AMERICAN,
    r"(?<![\p{L}\p{N}.,:/+-])(?<![0-9] )(?=\(?0(?:[ ()/-]{0,2}[0-9]){8,11}(?![ -]?[0-9]))(?![0-9]{2}[-/][0-9]{2}[-/])\(?0[1-9][0-9]{0,4}\)?(?:[ /-][0-9]{2,9}){1,4}(?![0-9])",
)
#: Beginnings that tell whose key it is; they stay.
KEY_START = r"AKIA|ASIA|sk-(?:proj-|ant-|svcacct-|admin-)?|[sr]k_(?:live|test)_|gh[pousr]_|github_pat_|glpat-|xox[a-z]-|AIza|hf_|npm_|eyJ"
_KEYS = (
    r"(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    r"(?:(?<![A-Za-z0-9_-])|\G)sk-(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{19,}[A-Za-z0-9]",
    r"sk-(?:proj-|ant-|svcacct-|admin-)?[A-Za-z0-9]{20,}",
    r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"github_pat_[A-Za-z0-9_]{20,}",
    r"glpat-[A-Za-z0-9_-]{20,}",
    r"xox[a-z]-[A-Za-z0-9-]{10,}",
    r"AIza[A-Za-z0-9_-]{35}",
    r"(?:hf|npm)_[A-Za-z0-9]{30,}",
    r"(?:(?<![A-Za-z0-9_-])|\G)eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+",
)
PATTERNS = (
    ("email", r"(?:(?<![\p{L}\p{N}._%+-])|\G)[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"),
    ("key", rf"\b(?:{'|'.join(_KEYS)})"),
    ("secret", r"(?<![\p{L}\p{N}])[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])"),
    ("iban", r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("phone", "|".join(PHONES)),
    ("ssn", r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])"),
    ("name", rf"(?<![\p{{L}}\p{{N}}-])(?:{_TITLED}{_WORD}(?:{_LAST})?|(?=\p{{Lu}}\p{{Ll}}+[ -]\p{{L}})(?:{_GIVEN})(?:[ -](?:{_GIVEN}))?{_LAST})"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: A text that no pattern can match has none of this: the other kinds have a digit or an @.
HINT = "[@0-9]|" + "|".join(f"(?:{p})" for k, p in PATTERNS if k in ("key", "secret", "name"))
CAPITAL = rf"(?<![\p{{L}}\p{{N}}]){_PART}(?![\p{{L}}\p{{N}}])"
HEX = "0123456789abcdef"
#: Sixteen letters of each script.
LETTERS = (("[a-zA-Z]", "bcdfghjklmnprstv"), (r"\p{IsCyrillic}", "абвгдежиклмнопрс"), (r"\p{IsGreek}", "αβγδεζηθικλμνπρσ"), (r"\p{IsHan}", "天地人山水火木金土日月星云雨风雷"), (r"\p{L}", "bcdfghjklmnprstv"))
SYLLABLES = ((r"^\p{IsCyrillic}", "бвгдзклмнпрстфхж", "аеиоу", "н", "а"), (r"^\p{IsGreek}", "βγδζθκλμνπρστφχξ", "αεηοι", "ν", "α"), ("", "bcdfghklmnprstvz", "aeiou", "n", "a"))


def _let(x: Column, use) -> Column:
    """use(x), with x computed once, inside lambdas too."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _weave(parts: Column, more: Column) -> Column:
    """The strings of both arrays in turn; `more` is one shorter."""
    return F.array_join(F.flatten(F.zip_with(parts, more, lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), "")


def kind_of(m: Column) -> Column:
    """Kind of a match, by the first pattern that fits all of it."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS):
        out = F.when(m.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def normal(kind: Column, m: Column) -> Column:
    """What the mentions of one entity have in common. Of a name: gender mark and the name without its title."""
    plain = F.regexp_replace(m, f"^{_TITLED}", "")
    titled = lambda g: m.rlike(rf"^(?:(?:{'|'.join(TITLES['n'])})\.? )*(?:{'|'.join(TITLES[g])})\.? ")
    given = lambda g: plain.rlike(rf"^(?:{'|'.join(GIVEN[g])})(?!\p{{L}})")
    mark = F.when(titled("f"), F.lit("f ")).when(titled("m"), F.lit("m ")).when(given("f"), F.lit("f ")).when(given("m"), F.lit("m ")).otherwise(F.lit("n "))
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    coded = F.concat(F.lit("+"), F.regexp_extract(m, rf"^(?:\+|00)({_COUNTRY})", 1), F.lit(" "), digits(F.regexp_replace(m, rf"^(?:\+|00){_COUNTRY}", "")))
    phone = F.when(m.rlike(r"^(?:\+|00)"), coded).when(m.rlike(f"^(?:{_AMERICAN})$"), F.concat(F.lit("+1 "), F.substr(digits(m), F.lit(-10)))).otherwise(digits(m))
    return (
        F.when(kind.isin("email", "secret"), F.lower(m))
        .when(kind == "phone", phone)
        .when(kind == "card", F.regexp_replace(m, "[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .when(kind == "name", F.concat(mark, plain))
        .otherwise(m)
    )


def _stream(seed: Column, length: Column) -> Column:
    """Hexadecimal digits, at least `length`, drawn from the seed."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(length / 64).cast("int")), lambda j: F.sha2(F.concat(seed, F.lit("#"), j.cast("string")), 256)), "")


def _letter(c: Column, h: Column) -> Column:
    out = c
    for pattern, letters in reversed(LETTERS):
        out = F.when(c.rlike(pattern), F.when(c != F.lower(c), F.upper(F.translate(h, HEX, letters))).otherwise(F.translate(h, HEX, letters))).otherwise(out)
    return F.when(c.rlike("[0-9]"), F.translate(h, "abcdef", "012345")).otherwise(out)


def shaped(value: Column, stream: Column) -> Column:
    """value with each letter or digit replaced by one of its script and case, everything else kept; the stream is as long."""
    taken = r"[\p{L}0-9]"
    drawn = F.zip_with(F.regexp_extract_all(value, F.lit(taken), 0), F.split(stream, ""), lambda c, h: F.when(c.isNotNull(), _letter(c, h)))
    return _weave(F.split(value, taken, -1), F.filter(drawn, lambda c: c.isNotNull()))


def _luhn(digits: Column) -> Column:
    """Checksum of a digit string by the rule of payment cards; 0 if valid."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10


def _card(value: Column, stream: Column) -> Column:
    """Digits drawn anew; a valid number stays valid, an invalid one invalid."""

    def drawn(digits: Column) -> Column:
        body = F.translate(F.substr(stream, F.lit(1), F.length(digits) - 1), "abcdef", "012345")
        check = (F.lit(10) - _luhn(F.concat(body, F.lit("0")))) % 10
        shift = F.when(_luhn(digits) == 0, 0).otherwise(1 + F.translate(F.substr(stream, F.lit(64), F.lit(1)), HEX, "0123456780123456").cast("int"))
        return F.concat(body, ((check + shift) % 10).cast("string"))

    return _weave(F.split(value, "[0-9]", -1), F.split(_let(F.regexp_replace(value, "[^0-9]", ""), drawn), ""))


def _octets(stream: Column) -> Column:
    return F.concat_ws(".", *((F.conv(F.substr(stream, F.lit(1 + 4 * i), F.lit(4)), 16, 10).cast("int") % 254 + 1).cast("string") for i in range(4)))


def _given(word: Column, gender: Column, stream: Column) -> Column:
    """A name of four syllables in the word's script with the gender's ending."""
    out = F.lit("")
    for pattern, consonants, vowels, male, female in reversed(SYLLABLES):
        made = F.concat(*(x for i in range(4) for x in (F.translate(F.substr(stream, F.lit(2 * i + 1), F.lit(1)), HEX, consonants), F.translate(F.substr(stream, F.lit(2 * i + 2), F.lit(1)), HEX, (vowels * 4)[:16]))))
        made = F.concat(made, F.when(gender == "f", female).when(gender == "m", male).otherwise(""))
        out = F.when(word.rlike(pattern), made).otherwise(out) if pattern else made
    return F.concat(F.upper(F.substr(out, F.lit(1), F.lit(1))), F.substr(out, F.lit(2)))


def surrogate(kind: Column, norm: Column, value: Column, attempt: Column, key: str) -> Column:
    """The replacement of a mention `value` of the entity (kind, norm); of a name a single word."""
    gender = F.substr(norm, F.lit(1), F.lit(1))
    own = F.when(kind == "name", F.concat(gender, F.lit(" "), value)).otherwise(norm)
    seed = F.sha2(F.concat(F.lit(key + "|"), kind, F.lit("|"), own, F.lit("|"), attempt.cast("string")), 256)
    head = F.when(kind == "phone", F.regexp_extract(value, rf"^(?:(?:\+|00){_COUNTRY}|1(?=[ .-]))", 0)).when(kind == "iban", F.substr(value, F.lit(1), F.lit(2))).when(kind == "key", F.regexp_extract(value, f"^(?:{KEY_START})", 0)).otherwise(F.lit(""))
    tail = F.when(kind == "email", F.regexp_extract(value, r"\.[^.]*$", 0)).otherwise(F.lit(""))

    def framed(ends: Column, stream: Column) -> Column:
        body = F.substr(value, F.length(ends["head"]) + 1, F.length(value) - F.length(ends["head"]) - F.length(ends["tail"]))
        return F.concat(ends["head"], shaped(body, stream), ends["tail"])

    def made(stream: Column) -> Column:
        return (
            F.when(kind == "secret", F.when(value == F.upper(value), F.upper(F.substr(stream, F.lit(1), F.length(value)))).otherwise(F.substr(stream, F.lit(1), F.length(value))))
            .when(kind == "card", _card(value, stream))
            .when(kind == "ip", _octets(stream))
            .when(kind == "name", _given(value, gender, stream))
            .otherwise(_let(F.struct(head.alias("head"), tail.alias("tail")), lambda ends: framed(ends, stream)))
        )

    return _let(_let(seed, lambda x: _stream(x, F.length(value))), made)


def mentions(text: Column) -> Column:
    """array<struct<kind,norm,value>> of a text's matches in order; empty for null."""
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))

    def entity(m: Column) -> Column:
        return _let(kind_of(m), lambda kind: F.struct(kind.alias("kind"), normal(kind, m).alias("norm"), m.alias("value")))

    return F.coalesce(F.transform(found, entity), F.array().cast("array<struct<kind:string,norm:string,value:string>>"))


def name_words(found: Column) -> Column:
    """kind, norm and value of each single word of the names among the mentions, so that later bare mentions agree."""
    return F.array_distinct(F.flatten(F.transform(F.filter(found, lambda e: e["kind"] == "name"), _words_of)))


def entities(found: DataFrame) -> DataFrame:
    """Distinct (kind, norm) of a frame with `found`; names go word by word."""
    each = F.concat(F.filter("found", lambda e: e["kind"] != "name"), name_words(F.col("found")))
    return found.select(F.explode(F.array_distinct(F.transform(each, lambda e: F.struct(e["kind"], e["norm"])))).alias("e")).select("e.kind", "e.norm").distinct()


def redraws(known: DataFrame, key: str) -> DataFrame | None:
    """(kind, norm, attempt) of the entities whose first surrogates are taken or real; None if all differ."""
    plain = F.when(F.col("kind") == "name", F.substr("norm", F.lit(3))).otherwise(F.col("norm"))
    spread = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work a row
    known = materialise(known.select("kind", "norm", plain.alias("plain")).repartition(spread, "norm"), "entities")
    drawn = known.withColumn("attempt", F.lit(0))
    moved = False
    while True:
        drawn = materialise(drawn.withColumn("s", surrogate(F.col("kind"), F.col("norm"), F.col("plain"), F.col("attempt"), key)), "surrogates")
        # Of those with one surrogate the first (fewest draws, then norm) keeps it; nobody keeps what is some entity's own text.
        keeps = drawn.groupBy("kind", "s").agg(F.min(F.struct("attempt", "norm")).alias("first"))
        real = known.select("kind", F.col("plain").alias("s"), F.lit(True).alias("real")).distinct()
        judged = drawn.join(keeps, ["kind", "s"]).join(real, ["kind", "s"], "left")
        again = F.coalesce("real", F.lit(False)) | (F.col("first.norm") != F.col("norm"))
        judged = materialise(judged.select("kind", "norm", "plain", (F.col("attempt") + again.cast("int")).alias("attempt"), again.alias("again")), "judged")
        if judged.where("again").isEmpty():
            return drawn.where("attempt > 0").select("kind", "norm", "attempt") if moved else None
        drawn, moved = judged.drop("again"), True


def _words_of(e: Column) -> Column:
    """The single words of a mention of a name, as mentions."""
    mark = F.substr(e["norm"], F.lit(1), F.lit(2))
    return F.transform(F.regexp_extract_all(F.substr(e["norm"], F.lit(3)), F.lit(CAPITAL), 0), lambda w: F.struct(F.lit("name").alias("kind"), F.concat(mark, w).alias("norm"), w.alias("value")))


def _rewrite(text: Column, found: Column, attempt, key: str) -> Column:
    """text with its mentions, and the bare later mentions of its names, replaced."""

    def word(e: Column) -> Column:
        return surrogate(e["kind"], e["norm"], e["value"], attempt(e), key)

    def one(e: Column) -> Column:
        named = e["kind"] == "name"
        title = F.when(named, F.regexp_extract(e["value"], f"^{_TITLED}", 0)).otherwise(F.lit(""))
        between = F.when(named, F.split(F.substr(e["norm"], F.lit(3)), CAPITAL, -1)).otherwise(F.array(F.lit(""), F.lit("")))
        return F.concat(title, _weave(between, F.transform(F.when(named, _words_of(e)).otherwise(F.array(e)), word)))

    out = F.when(F.size(found) > 0, _weave(F.split(text, ANY, -1), F.transform(found, one))).otherwise(text)

    def bare(names: Column, c: Column) -> Column:
        return _let(F.filter(names, lambda e: e["value"] == c), lambda own: F.when(F.size(own) > 0, word(F.element_at(own, 1))).otherwise(c))

    def later(names: Column, t: Column) -> Column:
        return _weave(F.split(t, CAPITAL, -1), F.transform(F.regexp_extract_all(t, F.lit(CAPITAL), 0), lambda c: bare(names, c)))

    # Computed once a text: what a lambda takes from outside it is computed anew for every element.
    both = F.struct(out.alias("out"), name_words(found).alias("names"))
    return _let(both, lambda x: F.when(F.size(x["names"]) > 0, later(x["names"], x["out"])).otherwise(x["out"]))


def _free(name: str, taken: list[str]) -> str:
    """A column name that no column of `taken` has, in any case of letters."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


#: Copies of a text with redrawn entities are dealt over so many keys.
SPREAD = 16


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """docs with the text rewritten, and count_col (int: mentions replaced; 0 for null texts, which stay null).

    Every other column is kept, whatever its name; one that has the name count_col in any case of letters gives way to the
    count. Empty texts stay empty, an empty table gives no rows, repeated rows and equal mentions are rewritten alike. Texts
    without entities come out unchanged, and no text is cut: patterns and rewriting take time in proportion to its length.
    Only the distinct entities are shuffled, and of documents only those with an entity that had to be drawn anew.
    """
    kept = [c for c in docs.columns if c.lower() != count_col.lower()]
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in kept}
    found, copy, again_at, redrawn = (_free(c, docs.columns) for c in ("found", "copy", "attempts", "redrawn"))
    text, seen = quoted[text_col], F.col(found)
    marked = docs.select(*quoted.values(), mentions(text).alias(found))
    some = marked.where(F.size(found) > 0)
    again = redraws(entities(some.select(seen.alias("found"))), key)

    def rewritten(df: DataFrame, attempt) -> DataFrame:
        return df.select(*(_rewrite(text, seen, attempt, key).alias(c) if c == text_col else quoted[c] for c in kept), F.size(found).alias(count_col))

    if again is None:
        return rewritten(marked, lambda e: F.lit(0))
    none = marked.where(F.size(found) == 0).select(*quoted.values(), F.lit(0).alias(count_col))
    some = some.withColumns({redrawn: F.md5(text), copy: F.floor(F.rand(1) * SPREAD).cast("int")})
    each = F.concat(F.filter("found", lambda e: e["kind"] != "name"), name_words(F.col("found")))
    own = some.select(F.col(redrawn).alias("redrawn"), seen.alias("found")).select("redrawn", F.explode(F.array_distinct(F.transform(each, lambda e: F.struct(e["kind"], e["norm"])))).alias("e")).select("redrawn", "e.kind", "e.norm").distinct()
    table = own.join(again, ["kind", "norm"]).groupBy("redrawn").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "norm"), "attempt"))).alias(again_at))
    table = table.select(F.col("redrawn").alias(redrawn), again_at, F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias(copy))
    some = some.join(table, [redrawn, copy], "left")
    later = lambda e: F.coalesce(F.element_at(F.col(again_at), F.concat_ws("|", e["kind"], e["norm"])), F.lit(0))
    return none.unionByName(rewritten(some, later))
