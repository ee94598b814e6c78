"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Detected entities get replacements of their own kind and shape: an e-mail stays
an e-mail with vowels, consonants and digits where they were, a card keeps its
scheme digit and whether its check digit is right, an address keeps its range, a
name its gender, script and case.  Replacements are a keyed hash of the
normalised entity, so an entity has one surrogate over the whole corpus.

Distinctness is checked over all entities of the corpus: a surrogate that is
some real entity, or that another entity already has, is drawn again with the
next attempt number until none collides.  Where a shape has too few values for
its entities, later attempts are longer or leave the address range for a larger
one, so every entity gets a surrogate whatever the corpus holds.  Tables of
entities and surrogates stay distributed; each text with entities is rebuilt
from a map of its own.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verseline.llm.tables import fresh, materialize

#: the first attempt that may be longer than the entity, that of kinds which have room enough for most corpora,
#: those at which private addresses leave their range, and that from which IPv4 addresses get IPv6 surrogates
WIDER, WIDER_ROOMY, WIDER_IP4, ANY_IP4, NO_IP4 = 4, 24, 16, 32, 64

_EDGE, _END = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _names(script: str) -> str:
    """One or two names of a script, in title case (also O'Neil, McNeil, Smith-Jones) or in capitals."""
    up, low = f"[\\p{{Lu}}&&\\p{{Is{script}}}]", f"[\\p{{Ll}}&&\\p{{Is{script}}}]"
    title = f"(?:{up}['’])?{up}{low}+(?:{up}{low}+)?(?:[-'’]{up}?{low}+)*(?!\\p{{L}})"
    capitals = f"{up}{{2,}}(?:[-'’]{up}{{2,}})*(?!\\p{{L}})"
    return f"(?:{title}(?: {title})?|{capitals}(?: {capitals})?)"


MALE = "Mr|Herr|Monsieur|Señor|Sr|Don|Sir|г-н|господин"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Doña|Lady|г-жа|госпожа"
#: titles that say nothing of gender: a given name takes that of the same name elsewhere in the corpus
NEUTRAL = "Dr|Prof|Professor"

#: fixed values: how long each country's IBAN is
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ XK LT LU", 21: "HR LV LI CH", 22: "BH BG CR GE DE IE ME RS GB VA", 23: "GI IQ IL TL AE",
    24: "AD CZ MD PK RO SA SK ES SE TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MR MC SM", 28: "AL AZ BY CY DO SV GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}


def _iban(length: int, countries: str) -> str:
    fours, rest = divmod(length - 4, 4)
    spaced = f"(?: [A-Z0-9]{{4}}){{{fours}}}" + (f" [A-Z0-9]{{{rest}}}" if rest else "")
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{length - 4}}}|{spaced})"


_HEX = "[0-9A-Fa-f]{1,4}"
EMAIL = "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++[.])+[A-Za-z]{2,}"
IP4 = f"(?<![A-Za-z0-9.]){_OCTET}(?:[.]{_OCTET}){{3}}(?![A-Za-z0-9]|[.][0-9])"
IP6 = f"(?<![A-Za-z0-9:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![A-Za-z0-9:]|[.][0-9])"
#: groups of digits behind a bank's letters are an IBAN even if the check digits are wrong
IBAN_DIGITS = "[A-Z]{2}[0-9]{2}(?: ?[A-Z]{4})?(?: ?[0-9]{4}){3,7}(?: ?[0-9]{1,3})?"
IBAN = f"{_EDGE}(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(_iban(*x) for x in IBAN_LENGTHS.items())}|{IBAN_DIGITS}){_END}"
CARD = f"{_EDGE}(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}|3[47][0-9]{{2}}[ -][0-9]{{6}}[ -][0-9]{{5}}){_END}"
SSN = f"{_EDGE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}"
PHONE = f"(?<![A-Za-z0-9+])(?:[+][0-9]{{1,3}}(?:[ .-]?[(][0-9]{{1,4}}[)])?(?:[ .-]?[0-9]{{2,4}}){{2,5}}|[(][0-9]{{3}}[)] ?[0-9]{{3}}[ .-][0-9]{{4}}|[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}){_END}"
#: calling codes are prefix-free, so a number has one code however it is spaced
COUNTRY_CODE = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
PERSON = f"(?<![\\p{{L}}-])(?:{MALE}|{FEMALE}|{NEUTRAL})[.]? (?:{_names('Latin')}|{_names('Cyrillic')})"
ANY = "|".join((EMAIL, IP4, IP6, IBAN, CARD, SSN, PHONE, PERSON))
#: what every match holds: it is far cheaper to look for a pair of digits, a sign or a title as plain text
SIGN = "[0-9]{2}|@|[0-9][.][0-9]|::"
TITLES = ("Mr", "Ms", "Miss", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Mlle", "Señor", "Sr", "Don ", "Don. ", "Doña", "Sir ", "Sir. ", "Lady", "Dr ", "Dr. ", "Prof", "г-", "господин", "госпожа")

_SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ha he ja jo ka ke la le li lo ma me mi mo na ne ni no pa pe ra re".split(), "cyrillic": "ба бо ва ве га го да де жа зе ка ко ла ле ли ло ма ме ми мо на не ни но па по ра ре са се та то".split()}
#: how given names of men, of women and of either end, and surnames
_ENDS = {
    "m": {"latin": "ron lan nus rik ton din mar vid".split(), "cyrillic": "рон лан нис рик тон дин мар вид".split()},
    "f": {"latin": "rina lia nessa mira tia dora vela sana".split(), "cyrillic": "рина лия неса мира тия дора вела сана".split()},
    "n": {"latin": "len ris vel sel kin tar tor wyn".split(), "cyrillic": "лен рис вел сел кин тар тор вин".split()},
    "s": {"latin": "sen mann ler nard well rick dorf stone".split(), "cyrillic": "нов мин лев ков дис рин бин сон".split()},
}


def chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def kind_of(match: Column) -> Column:
    """The kind of a match; null if it is no entity after all: an address of too many groups, or of one or two without
    a digit; an account number whose check digits are wrong; 13 to 19 digits, 16 aside, whose check digit is wrong."""
    groups = F.size(F.filter(F.split(match, ":"), lambda g: g != ""))
    ip6 = (groups == 8) & ~F.contains(match, F.lit("::")) | F.contains(match, F.lit("::")) & groups.between(1, 7) & ((groups > 2) | match.rlike("[0-9]"))
    account = F.replace(match, F.lit(" "), F.lit(""))
    iban = match.rlike(f"^(?:{IBAN_DIGITS})$") | (_iban_check(account) == F.substr(account, F.lit(3), F.lit(2)))
    card = (match != digits(match)) | (F.length(match) == 16) | (_luhn(match).cast("string") == F.substr(match, F.length(match)))
    return (
        F.when(F.contains(match, F.lit("@")), F.lit("email"))
        .when(match.rlike("^[\\p{L}-]{2,}[.]? [\\p{L}]"), F.lit("person"))
        .when(match.rlike(f"^(?:{IP4})$"), F.lit("ip4"))
        .when(F.contains(match, F.lit(":")), F.when(ip6, F.lit("ip6")))
        .when(match.rlike("^[A-Z]{2}"), F.when(iban, F.lit("iban")))
        .when(match.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.lit("ssn"))
        .when(match.rlike("^[+(]|^[0-9]{3}[.-][0-9]{3}[.-]"), F.lit("phone"))
        .otherwise(F.when(card, F.lit("card")))
    )


def _unit(kind: Column, norm: Column) -> Column:
    return F.struct(kind.alias("kind"), norm.alias("norm"))


def _script(text: Column) -> Column:
    return F.when(text.rlike("[А-Яа-яЁё]"), F.lit("cyrillic")).otherwise(F.lit("latin"))


def units(match: Column) -> Column:
    """What of an entity is replaced as one: (kind, normalised text); a name's parts are units of their own,
    so that a full name and the surname alone agree.  What is no entity has none."""
    kind = kind_of(match)
    words = F.split(match, " ")
    gender = F.when(match.rlike(f"^(?:{FEMALE})[.]? "), F.lit("f")).when(match.rlike(f"^(?:{NEUTRAL})[.]? "), F.lit("n")).otherwise(F.lit("m"))
    surname = F.element_at(words, -1)
    person = F.array(_unit(F.concat(F.lit("s:"), _script(surname)), F.lower(surname)))
    given = F.array(_unit(F.concat(gender, F.lit(":"), _script(surname)), F.lower(F.get(words, F.lit(1)))))
    code = F.when(match.startswith("+"), F.regexp_extract(digits(match), COUNTRY_CODE, 0)).otherwise("")
    phone = F.when(code != "", F.concat(F.lit("+"), code, F.lit("."), F.substr(digits(match), F.length(code) + 1))).otherwise(digits(match))
    norm = (
        F.when(kind.isin("email", "ip6"), F.lower(match))
        .when(kind == "ip4", match)
        .when(kind == "iban", F.replace(match, F.lit(" "), F.lit("")))
        .when(kind == "phone", phone)
        .otherwise(digits(match))
    )
    one = F.when(kind == "person", F.when(F.size(words) > 2, F.concat(given, person)).otherwise(person)).otherwise(F.array(_unit(kind, norm)))
    return F.when(kind.isNull(), F.slice(one, 1, 0)).otherwise(one)


def _nibble(stream: Column, i: Column) -> Column:
    """The i-th (from 1) 4-bit number of a hexadecimal stream, which repeats."""
    # '0' to '9' are 48 to 57, 'a' to 'f' 97 to 102: both are 0 to 15 after this
    code = F.ascii(F.substr(stream, (i - 1) % F.length(stream) + 1, F.lit(1)))
    return code - F.when(code < 97, 48).otherwise(87)


def _pick(choices: str, n: Column, size: int) -> Column:
    return F.element_at(choices, (n % size + 1).cast("int"))


def _digit_stream(stream: Column) -> Column:
    return F.translate(stream, "abcdef", "357046")


def _letter_stream(stream: Column) -> Column:
    """Consonants and vowels by turns are not kept; every letter is one of sixteen that spell well."""
    return F.translate(stream, "0123456789abcdef", "bdfgklmnprstaeio")


def _reshaped(text: Column, stream: Column) -> Column:
    """Runs of letters by letters and runs of digits by digits, as long as before; the rest stays."""
    runs = F.regexp_extract_all(text, F.lit("[a-z]+|[0-9]+|[^a-z0-9]+"), 0)

    def one(run: Column, i: Column) -> Column:
        at = i * 11 % 64 + 1
        long = F.length(run)
        letters = F.substr(F.repeat(_letter_stream(F.substr(stream, at)), (long / 64 + 1).cast("int")), F.lit(1), long)
        return F.when(run.rlike("^[a-z]"), letters).when(run.rlike("^[0-9]"), F.translate(letters, "bdfgklmnprstaeio", "0123456789357046")).otherwise(run)

    return F.array_join(F.transform(runs, one), "")


def _luhn(number: Column) -> Column:
    """The check digit for the number without its last digit."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, F.length(number) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(1), F.length(number) - 1), F.lit(0), add)
    return (10 - total % 10) % 10


def _iban_check(iban: Column) -> Column:
    """The two check digits of an IBAN."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(2)), F.lit("00"))

    def add(total: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (total * 10 + c.cast("long")) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)

    return F.lpad((98 - F.aggregate(chars(turned), F.lit(0).cast("long"), add)).cast("string"), 2, "0")


def surrogates(entities: DataFrame, key: str, attempt: int) -> DataFrame:
    """(kind, norm, value): a keyed replacement of the same kind and shape for each normalised entity.

    What lambdas use - hash streams, drafts without check digits - are columns
    of their own steps, so they are computed once per entity and not once per
    character.  From attempt WIDER on the space of values grows with the attempt
    (WIDER_ROOMY for cards, account and social security numbers), so no number of
    entities of one shape uses it up.
    """
    extra, roomy = max(0, attempt - WIDER + 1), max(0, attempt - WIDER_ROOMY + 1)
    kind, norm, stream = F.col("kind"), F.col("norm"), F.col("stream")

    def hashed(*what: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(key), *what), 256)

    at = F.substring_index(norm, "@", -1)
    top = F.substring_index(at, ".", -1)
    step = entities.select("kind", "norm").withColumns({"half": hashed(kind, norm, F.lit(str(attempt))), "host": F.when(kind == "email", F.substr(at, F.lit(1), F.length(at) - F.length(top)))})
    step = step.withColumns({"stream": F.concat("half", F.sha2(F.concat("half", F.lit(key)), 256)), "host_stream": F.when(kind == "email", hashed(F.lit("domain"), F.col("host")))})

    # bytes of the stream that addresses and names are made of
    step = step.withColumns({f"byte{i}": _nibble(stream, F.lit(2 * i + 1)) * 16 + _nibble(stream, F.lit(2 * i + 2)) for i in (0, 1, 2, 3, 20, 21, *range(30, 30 + attempt // 2))})

    def number(i: int) -> Column:
        return F.col(f"byte{i}")

    # digits to fill in; the first of a number is 2 to 9
    step = step.withColumn("numerals", F.concat(F.translate(F.substr(_digit_stream(stream), F.lit(1), F.lit(1)), "01", "23"), F.substr(_digit_stream(stream), F.lit(2))))
    numerals = F.col("numerals")
    bank = F.concat(F.substr(norm, F.lit(1), F.lit(4)), F.array_join(F.transform(F.regexp_extract_all(F.substr(norm, F.lit(5)), F.lit("[0-9]+|[A-Z]+"), 0), lambda run, i: F.when(run.rlike("^[0-9]"), F.substr(numerals, i * 3 + 1, F.length(run))).otherwise(F.upper(F.substr(_letter_stream(stream), i + 1, F.length(run))))), ""))
    draft = F.when(kind == "card", F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.substr(numerals, F.lit(1), F.length(norm) - 1 + roomy))).when(kind == "iban", F.concat(bank, F.substr(numerals, F.lit(40), F.lit(min(roomy, 60)))))
    step = step.withColumns({"draft": draft, "valid": F.when(kind == "card", _luhn(norm) == F.substr(norm, F.length(norm)).cast("int"))})
    body = F.col("draft")
    step = step.withColumn("check", F.when(kind == "card", _luhn(body).cast("string")).when(kind == "iban", _iban_check(body)))

    # in front, so that the rest stays in line with the entity's end
    more = F.substr(_letter_stream(F.sha2(F.concat("half", F.lit("more")), 512)), F.lit(1), F.lit(min(extra, 60)))
    email = F.concat(more, _reshaped(F.substring_index(norm, "@", 1), stream), F.lit("@"), _reshaped(F.col("host"), F.col("host_stream")), top)
    octets = F.split(norm, "[.]")
    tail = [number(i).cast("string") for i in (1, 2)] + [(number(3) % 254 + 1).cast("string")]
    small = norm.rlike("^(?:192[.]168|172[.](?:1[6-9]|2[0-9]|3[01]))[.]")
    public = F.concat_ws(".", (number(0) % 112 + 11).cast("string"), *tail)
    if attempt < WIDER_IP4:
        ip4 = F.when(octets[0].isin("10", "127"), F.concat_ws(".", octets[0], *tail)).when(small, F.concat_ws(".", octets[0], octets[1], *tail[1:])).otherwise(public)
    elif attempt < ANY_IP4:
        ip4 = F.when(octets[0].isin("10", "127") | small, F.concat_ws(".", F.lit("10"), *tail)).otherwise(public)
    elif attempt < NO_IP4:
        ip4 = F.concat_ws(".", (number(0) % 223 + 1).cast("string"), *tail)
    else:
        ip4 = F.concat(F.lit("2001:db8:"), F.regexp_replace(F.substr(stream, F.lit(70), F.lit(24)), "(....)(?=.)", "$1:"))
    whole = lambda at: F.concat(F.translate(F.substr(stream, at, F.lit(1)), "0", "1"), F.substr(stream, at + 1, F.lit(3)))
    groups = F.transform(F.split(norm, ":"), lambda g, i: F.when(g == "", "").otherwise(whole(i * 5 + 1)) if extra else F.substr(stream, i * 5 + 1, F.length(g)))
    ip6 = F.array_join(groups, ":")
    if extra > 1:
        # '::' stands for any number of groups, so some of them can be written out: seven groups at most
        room = F.greatest(F.lit(0), F.least(F.lit(extra - 1), 7 - F.size(F.filter(groups, lambda g: g != ""))))
        added = F.concat_ws(":", F.slice(F.array(*(whole(F.lit(61 + 5 * i)) for i in range(6))), F.lit(1), room))
        ip6 = F.when(~norm.contains("::") | (room == 0), ip6).when(norm.endswith("::"), F.concat(ip6, added)).otherwise(F.concat_ws(":", ip6, added))
    code = F.when(norm.startswith("+"), F.instr(norm, ".")).otherwise(0)
    phone = F.concat(F.substr(norm, F.lit(1), code), F.substr(numerals, F.lit(1), F.length(norm) - code + extra))
    check = F.col("check").cast("int")
    last = F.when(F.col("valid"), check).otherwise((check + 1 + _nibble(stream, F.lit(60)) % 9) % 10)
    card = F.concat(F.substr(body, F.lit(1), F.length(body) - 1), last.cast("string"))
    iban = F.concat(F.substr(body, F.lit(1), F.lit(2)), F.col("check"), F.substr(body, F.lit(5)))

    # every second attempt is a syllable longer, so there are always unused names
    script, part = F.substr(kind, F.lit(3)), F.substr(kind, F.lit(1), F.lit(1))
    syllables = F.when(script == "cyrillic", F.array(*map(F.lit, _SYLLABLES["cyrillic"]))).otherwise(F.array(*map(F.lit, _SYLLABLES["latin"])))
    ends = [F.when((part == p) & (script == s), F.array(*map(F.lit, _ENDS[p][s]))) for p in _ENDS for s in _SYLLABLES]
    step = step.withColumns({"syllables": F.when(kind.contains(":"), syllables), "ends": F.coalesce(*ends)})
    picked = [_pick("syllables", number(i), 32) for i in (0, *range(30, 30 + attempt // 2), 20)]
    name = F.concat(*picked, _pick("ends", number(21), 8))

    out = F.when(kind == "email", email).when(kind == "ip4", ip4).when(kind == "ip6", ip6).when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", iban)
    out = out.when(kind.contains(":"), name)
    return step.withColumn("value", out.otherwise(F.substr(numerals, F.lit(1), F.length(norm) + roomy))).select("kind", "norm", "value")


#: entities that a task makes surrogates for
EACH = 20_000


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, value) for distinct (kind, norm): values differ from each other and from all entities.

    Those that collide are drawn again; as their shapes grow with the attempt, all are placed in the end.
    """
    base = materialize(entities.select("kind", "norm").where("kind is not null and norm is not null").distinct(), "entities")
    taken = base.select("kind", F.col("norm").alias("value"))
    waiting, accepted = base, None
    left = waiting.count()
    for attempt in count():
        drawn = surrogates(waiting.repartition(1 + left // EACH), key, attempt)
        won = materialize(drawn.join(taken, ["kind", "value"], "left_anti").groupBy("kind", "value").agg(F.min("norm").alias("norm")), "surrogates")
        accepted = won if accepted is None else accepted.unionByName(won)
        waiting = materialize(waiting.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti"), "colliding")
        left = waiting.count()
        if not left:
            return accepted
        taken = taken.union(won.select("kind", "value"))


def gendered(parts: DataFrame) -> DataFrame:
    """parts (text_key, kind, norm) with a column known_as: the kind whose surrogate a unit gets.

    A given name behind a neutral title is known as the gender that the same
    name has in more texts of the corpus, so that a person keeps one surrogate;
    a name without such mentions stays neutral.
    """
    own = parts.withColumn("known_as", F.col("kind"))
    neutral = F.substr("kind", F.lit(1), F.lit(2)) == "n:"
    asked = parts.where(neutral).select(F.substr("kind", F.lit(3)).alias("script"), "norm").distinct()
    told = parts.where("kind like 'm:%' or kind like 'f:%'").select(F.substr("kind", F.lit(3)).alias("script"), "norm", F.substr("kind", F.lit(1), F.lit(1)).alias("g"))
    told = told.groupBy("script", "norm").agg(F.count_if(F.col("g") == "m").alias("m"), F.count_if(F.col("g") == "f").alias("f")).join(asked, ["script", "norm"], "left_semi")
    told = told.select(F.concat(F.lit("n:"), "script").alias("kind"), "norm", F.concat(F.when(F.col("f") > F.col("m"), "f:").otherwise("m:"), "script").alias("by_title"))
    resolved = own.where(neutral).join(told, ["kind", "norm"], "left").withColumn("known_as", F.coalesce("by_title", "known_as"))
    return own.where(~neutral).unionByName(resolved.select(*own.columns))


def _in_shape(found: Column) -> Column:
    """An entity's surrogate in the shape the entity is written in; found: struct of match, kind, values, one, digits."""
    match, kind, one = found["match"], found["kind"], found["one"]
    # a longer surrogate is in line with the match's end
    ahead = F.greatest(F.lit(0), F.length(one) - F.length(match))
    mixed = F.array_join(F.transform(chars(match), lambda c, i: F.when(c != F.lower(c), F.upper(F.substr(one, ahead + i + 1, F.lit(1)))).otherwise(F.substr(one, ahead + i + 1, F.lit(1)))), "")
    mixed = F.concat(F.substr(one, F.lit(1), ahead), mixed)
    cased = F.when(match == F.lower(match), one).when(match == F.upper(match), F.upper(one)).otherwise(mixed)

    def laid(source: Column, kept: str) -> Column:
        """The match with all runs but the kept ones replaced, in order, from the source; what is left of it follows."""
        runs = F.regexp_extract_all(match, F.lit(f"{kept}+|(?:(?!{kept}).)+"), 0)
        move = lambda s, run: F.when(run.rlike(f"^{kept}"), F.struct(F.concat(s["out"], run).alias("out"), s["i"].alias("i"))).otherwise(F.struct(F.concat(s["out"], F.substr(source, s["i"], F.length(run))).alias("out"), (s["i"] + F.length(run)).alias("i")))
        return F.aggregate(runs, F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), move, lambda s: F.concat(s["out"], F.substr(source, s["i"])))

    words = F.split(match, " ")
    named = F.zip_with(F.slice(words, F.lit(2), F.size(words)), found["values"], lambda word, v: F.when(word == F.upper(word), F.upper(v)).otherwise(F.initcap(v)))
    person = F.concat_ws(" ", F.array(words[0]), named)
    shaped = F.when(kind.isin("email", "ip6"), cased).when(kind == "ip4", one).when(kind == "iban", laid(one, "[ ]")).when(kind == "card", F.when(match == digits(match), found["digits"]).otherwise(laid(found["digits"], "[ -]")))
    return F.when(kind.isNull(), match).otherwise(shaped.when(kind == "person", person).otherwise(laid(found["digits"], "[^0-9]")))


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with personal data in ``text_col`` replaced, and a column pii_kinds: the kinds found, in text order.

    Rows without personal data, null and empty texts stay as they are, with an
    empty pii_kinds.  Equal texts get equal replacements; ids play no part and
    rows that repeat stay.  A column of docs named pii_kinds is replaced; an
    empty table gives an empty table.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() != "pii_kinds"])
    matches, text_key, values = fresh(docs, "matches", "text_key", "values")
    text = F.col(f"`{text_col}`")
    sign = text.rlike(SIGN)
    for title in TITLES:
        sign |= F.contains(text, F.lit(title))
    found = F.coalesce(sign & text.rlike(ANY), F.lit(False))
    hits = docs.where(found).withColumns({matches: F.regexp_extract_all(text, F.lit(ANY), 0), text_key: F.sha2(text, 256)})
    hits = materialize(hits, "hits")
    parts = hits.select(text_key, F.explode(F.flatten(F.transform(matches, units))).alias("u")).select(text_key, "u.*").distinct()
    parts = materialize(gendered(materialize(parts, "parts")), "parts")
    chosen = materialize(assign(parts.select(F.col("known_as").alias("kind"), "norm"), key), "chosen").withColumnRenamed("kind", "known_as")
    entry = F.struct(F.concat("kind", F.lit("|"), "norm").alias("k"), F.col("value").alias("v"))
    maps = materialize(parts.join(chosen, ["known_as", "norm"]).groupBy(text_key).agg(F.map_from_entries(F.collect_list(entry)).alias(values)), "maps")
    # texts whose matches were no entities after all have no map
    changed = hits.join(maps, text_key, "left")
    each = F.transform(matches, lambda m: F.struct(m.alias("match"), kind_of(m).alias("kind"), F.transform(units(m), lambda u: F.element_at(F.col(values), F.concat(u["kind"], F.lit("|"), u["norm"]))).alias("values")))
    changed = changed.withColumn(matches, each)
    full = F.transform(matches, lambda m: F.struct(m["match"].alias("match"), m["kind"].alias("kind"), m["values"].alias("values"), F.get(m["values"], F.lit(0)).alias("one"), digits(F.get(m["values"], F.lit(0))).alias("digits")))
    changed = changed.withColumn(matches, full).withColumn(values, F.transform(matches, _in_shape))
    rebuilt = F.array_join(F.zip_with(F.split(text, ANY, -1), F.concat(values, F.array(F.lit(""))), lambda g, s: F.concat(g, s)), "")
    changed = changed.withColumns({text_col: rebuilt, "pii_kinds": F.array_compact(F.transform(matches, lambda m: m["kind"]))}).select(*docs.columns, "pii_kinds")
    same = docs.where(~found).withColumn("pii_kinds", F.array().cast("array<string>"))
    return same.unionByName(changed)
