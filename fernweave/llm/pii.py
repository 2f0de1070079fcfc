"""PII surrogates: keyed replacements of the same type, script, gender and format, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.llm.common import discard, salted_join, stash

#: Honorifics by the gender that they tell, matched before capitalised names.
HONORIFICS = {
    "m": ("Mr", "Herr", "Herrn", "Señor", "Sr", "Don", "Monsieur", "господин", "г-н", "Κύριος", "κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Doña", "Madame", "Mme", "Mademoiselle", "госпожа", "г-жа", "Κυρία", "κυρία"),
    "n": ("Dr", "Prof", "Mx"),
}
#: Syllables of surrogate names and the endings of given names, by script.
SYLLABLES = {
    "latin": ("ba", "bel", "cor", "da", "del", "fa", "fen", "ga", "gor", "hal", "jo", "ka", "kel", "la", "lin", "mar", "mo", "nel", "no", "per", "ra", "ren", "sa", "sol", "ta", "tor", "va", "vel", "wen", "zo", "zan", "bri"),
    "cyrillic": ("ба", "вел", "гор", "да", "дел", "жа", "зор", "ка", "кел", "ла", "лин", "мар", "мо", "нел", "но", "пер", "ра", "рен", "са", "сол", "та", "тор", "фа", "хал", "ца", "чел", "ша", "юр", "яр", "бри", "ван", "зан"),
    "greek": ("βα", "γορ", "δα", "δελ", "ζαν", "θα", "κα", "κελ", "λα", "λιν", "μαρ", "μο", "νελ", "νο", "ξα", "περ", "πο", "ρα", "ρεν", "σα", "σολ", "τα", "τορ", "φα", "φεν", "χαλ", "χο", "ψα", "βελ", "γα", "ζο", "μπρι"),
}
ENDINGS = {
    "latin": {"m": ("us", "an", "ert", "ik"), "f": ("a", "ia", "ine", "elle"), "n": ("en", "is", "or", "el")},
    "cyrillic": {"m": ("ан", "ор", "ий", "ислав"), "f": ("а", "ия", "ина", "ена"), "n": ("ен", "ко", "их", "ук")},
    "greek": {"m": ("ος", "ης", "ας", "ων"), "f": ("α", "η", "ια", "ω"), "n": ("ι", "ιδι", "ακι", "ου")},
}

#: Words before a name that tell no gender, in any case; the last two before two capitalised words at least.
CUES = ("my name is", "mein Name ist", "ich heiße", "je m'appelle", "je m’appelle", "me llamo", "mi nombre es")
LABELS = ("full name:", "name:")
#: Beginnings of tokens of well-known providers, and of JSON web tokens; they stay in surrogates.
TOKEN_STARTS = (r"gh[pousr]_", r"github_pat_", r"glpat-", r"xox[abprs]-", r"[rs]k_(?:live|test)_", r"sk-", r"AIza", r"npm_", r"hf_", r"eyJ", r"A(?:KIA|SIA)")

#: How card numbers of the networks start, and how many digits they have.
CARDS = (
    "4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})",
    "5[1-5][0-9]{14}",
    "2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}",
    "3[47][0-9]{13}",
    "3(?:0[0-5]|[689][0-9])[0-9]{11}",
    "35(?:2[89]|[3-8][0-9])[0-9]{12}",
    "6(?:011|4[4-9][0-9]|5[0-9]{2})[0-9]{12}",
    "62[0-9]{14,17}",
    "(?:5018|5020|5038|5893|6304|6759|676[1-3])[0-9]{8,15}",
)

_TITLES = "|".join(sorted((h for g in HONORIFICS.values() for h in g), key=len, reverse=True))
_CUES, _LABELS = f"(?iu:{'|'.join(CUES)})", f"(?i:{'|'.join(LABELS)})"
_STARTS = "|".join(TOKEN_STARTS)
_SECRET = r"""(?i:(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}["']?)"""
_BEARER = "(?i:bearer) {1,3}"
#: A secret's value: up to the closing quote if one opened it, else all that is not blank but marks at its end.
_VALUE = r"""(?:(?<=")(?=[^"\r\n]{6})[^"\\\r\n]*+(?:\\.[^"\\\r\n]*+)*+(?=")|(?<=')(?=[^'\r\n]{6})[^'\\\r\n]*+(?:\\.[^'\\\r\n]*+)*+(?=')|(?!["'])\S{5,}[^\s.,;:!?)\]}>"'])"""
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_H = "[0-9A-Fa-f]{1,4}"
_ONE = r"\p{Lu}[\p{L}'’-]+"
#: What each kind looks like, after a character that is no letter or digit. The earlier wins where two start at one place.
_AFTER_WORD = {
    "email": r"(?<![._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "secret": _SECRET + _VALUE,
    "bearer": rf"{_BEARER}(?=[A-Za-z._~+/=-]*[0-9])[A-Za-z0-9._~+/=-]{{15,}}[A-Za-z0-9~+/=-]",
    "token": r"(?:A(?:KIA|SIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|github_pat_[A-Za-z0-9_]{20,}+|glpat-[A-Za-z0-9_-]{16,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}+|sk-[A-Za-z0-9_-]{20,}+|AIza[A-Za-z0-9_-]{30,}+|(?:npm|hf)_[A-Za-z0-9]{30,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++)?)(?![A-Za-z0-9])",
    "hex": r"(?=[0-9a-f]{32})(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,}+(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": rf"(?<![:.])(?=[0-9A-Fa-f]{{1,4}}:)(?:(?:{_H}:){{7}}{_H}|(?=[0-9A-Fa-f]{{3,4}}:)(?=[A-Fa-f:]*[0-9])(?:{_H}:){{1,6}}(?::{_H}){{1,6}})(?![0-9A-Za-z:])",
}
#: The same after a character that is no digit.
_AFTER_DIGIT = {
    "ip": rf"(?<![0-9]\.){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9])(?!\.[0-9])",
    "phone": r"(?:(?<!\+)\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|(?<![-.])[0-9]{3}-[0-9]{3}-[0-9]{4}|(?<![-.])[2-9][0-9]{2}\.[2-9][0-9]{2}\.[0-9]{4}(?!\.[0-9]))(?![0-9])",
    "ssn": r"(?:(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|(?<![0-9] )(?!000|666|9)[0-9]{3} [0-9]{2} [0-9]{4}(?![0-9])(?! [0-9]))",
    "card": r"(?:[0-9][ -]?){12,18}[0-9](?![0-9])",
}
ALL = "|".join(
    (
        r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[^-]*+-----END (?:[A-Z]+ )*PRIVATE KEY-----",
        rf"(?<![A-Za-z0-9])(?=[A-Za-z0-9])(?:{'|'.join(_AFTER_WORD.values())})",
        rf"(?<![0-9])(?=[0-9(+])(?:{'|'.join(_AFTER_DIGIT.values())})",
        rf"(?<![\p{{L}}])(?=[MHSDPгΚκmIiJjFfNn])(?:(?:(?:{_TITLES})\.?|{_CUES}) {_ONE}(?: {_ONE}){{0,2}}|{_LABELS} {_ONE}(?: {_ONE}){{1,2}})",
    )
)
#: What every match of a kind holds. Texts without any of it hold no entity; one cheap look spares the rest.
NEEDS = {
    **dict.fromkeys(("bearer", "hex", "iban", "ip", "phone", "ssn", "card"), "[0-9]"),
    "email": "@",
    "secret": "[=:]",
    "token": _STARTS,
    "ipv6": ":",
    "pem": "-----BEGIN",
    "name": rf"(?<![\p{{L}}])(?:(?:{_TITLES})[. ]|{_CUES}|{_LABELS})",
}
MAYBE = "|".join(dict.fromkeys(NEEDS.values()))
_NAME = rf"^({_TITLES}|{_CUES}|{_LABELS})(\.? )(.*)$"


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def kind_of(m: Column) -> Column:
    """The kind of a match of ALL; null for a number that is no network's or fails its check digit."""
    tests = {
        "pem": F.startswith(m, F.lit("-----BEGIN")),
        "secret": F.rlike(m, F.lit(f"^{_SECRET}")),
        "bearer": F.rlike(m, F.lit(f"^{_BEARER}")),
        "email": F.contains(m, F.lit("@")),
        "token": F.rlike(m, F.lit(f"^(?:{_STARTS})")),
        "ip": F.rlike(m, F.lit(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")),
        "ipv6": F.rlike(m, F.lit("^[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]+$")),
        "phone": F.rlike(m, F.lit(r"^(?:\+|\(|[0-9]{3}([-.])[0-9]{3}\1[0-9]{4}$)")),
        "ssn": F.rlike(m, F.lit("^[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}$")),
        "hex": F.rlike(m, F.lit("^[0-9a-f]{32,}$")) & F.rlike(m, F.lit("[a-f]")),
        "iban": F.rlike(m, F.lit("^[A-Z]{2}[0-9]{2}")),
        "card": F.rlike(m, F.lit("^[0-9 -]+$")) & F.rlike(_digits(m), F.lit(f"^(?:{'|'.join(CARDS)})$")) & _luhn(_digits(m)),
        "name": F.rlike(m, F.lit(_NAME)),
    }
    out = F.lit(None).cast("string")
    for kind, test in reversed(tests.items()):
        out = F.when(test, F.lit(kind)).otherwise(out)
    return out


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _name_tokens(m: Column) -> Column:
    return F.split(F.regexp_extract(m, _NAME, 3), " ")


def _gender(m: Column) -> Column:
    title = F.regexp_extract(m, _NAME, 1)
    return F.when(title.isin(*HONORIFICS["m"]), "m").when(title.isin(*HONORIFICS["f"]), "f")


def entities(hits: DataFrame) -> DataFrame:
    """hits (row, m, kind) with at, token and entity: "kind:canonical form". Mentions of one entity in other formats give the same.

    Names give a row for each token: the last is a surname, those before are given names. A given name is of its
    honorific's gender; where that tells none, of the one gender that other mentions in the same text give it.
    """
    m, k = F.col("m"), F.col("kind")
    value = (
        F.when(k == "secret", F.regexp_replace(m, f"^{_SECRET}", ""))
        .when(k == "bearer", F.regexp_replace(m, f"^{_BEARER}", ""))
        .when(k.isin("phone", "card", "ssn"), _digits(m))
        .when(k.isin("email", "ipv6"), F.lower(m))
        .when(k == "iban", F.replace(m, F.lit(" "), F.lit("")))
        .otherwise(m)
    )
    # A credential is one entity whatever stands before it.
    of = F.when(k.isin("secret", "bearer", "token", "hex"), "secret").otherwise(k)
    plain = hits.where(k != "name").select("row", "m", "kind", F.lit(0).alias("at"), F.lit(None).cast("string").alias("token"), F.concat(of, F.lit(":"), value).alias("entity"))
    names = hits.where(k == "name").select("row", "m", "kind", _gender(m).alias("gender"), F.size(_name_tokens(m)).alias("n"), F.posexplode(_name_tokens(m)).alias("at", "token"))
    names = names.withColumn("lower", F.lower("token"))
    told = names.where((F.col("at") < F.col("n") - 1) & F.col("gender").isNotNull()).groupBy("row", "lower").agg(F.min("gender").alias("one"), F.max("gender").alias("other"))
    names = names.join(told, ["row", "lower"], "left")
    gender = F.coalesce("gender", F.when(F.col("one") == F.col("other"), F.col("one")), F.lit("n"))
    role = F.when(F.col("at") == F.col("n") - 1, F.lit("surname:")).otherwise(F.concat(F.lit("given_"), gender, F.lit(":")))
    return plain.unionByName(names.select("row", "m", "kind", "at", "token", F.concat(role, "lower").alias("entity")))


def _pick(choices: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), F.pmod(number, F.lit(len(choices))).cast("int") + 1)


def _draw(digest: Column, i: Column | int) -> Column:
    """A number below 65536 from a hex digest of 128 digits, another for each i."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substr(digest, (F.pmod(i * 3, F.lit(125)) + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


_LOWER, _UPPER, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def _letter(alphabet: str, number: Column) -> Column:
    return F.substr(F.lit(alphabet), F.pmod(number, F.lit(len(alphabet))).cast("int") + 1, F.lit(1))


def _scramble(text: Column, digest: Column, hexadecimal: bool = False) -> Column:
    """Each letter and digit becomes another of its class."""

    def swap(c: Column, i: Column) -> Column:
        n = _draw(digest, i)
        if hexadecimal:
            return F.when(F.rlike(c, F.lit("[0-9a-f]")), _letter(_HEX, n)).otherwise(c)
        return F.when(F.rlike(c, F.lit("[0-9]")), _letter("0123456789", n)).when(F.rlike(c, F.lit("[a-z]")), _letter(_LOWER, n)).when(F.rlike(c, F.lit(r"\p{Lu}")), _letter(_UPPER, n)).when(F.rlike(c, F.lit(r"\p{L}")), _letter(_LOWER, n)).when(F.rlike(c, F.lit(r"\p{N}")), _letter("0123456789", n)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), swap), "")


#: Names are cut at these; a piece of one letter stays, as in O'Neil.
_NAME_PARTS = "[^'’-]+|['’-]"


def _new_name(token: Column, digest: Column, gender: str | None, attempt: Column) -> Column:
    """Each part of a name as syllables of its script, one more for each attempt; a name of single letters grows one too."""

    def of(script: str, d: Column) -> Column:
        more = F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda i: _pick(SYLLABLES[script], _draw(d, i + 7))), "")).otherwise("")
        parts = [*(_pick(SYLLABLES[script], _draw(d, i)) for i in range(3)), more]
        last = _pick(ENDINGS[script][gender], _draw(d, 5)) if gender else _pick(SYLLABLES[script], _draw(d, 5))
        return F.concat(*parts, last)

    def part(p: Column, i: Column) -> Column:
        d = F.sha2(F.concat(digest, i.cast("string")), 512)
        made = F.when(F.rlike(p, F.lit(r"\p{IsCyrillic}")), of("cyrillic", d)).when(F.rlike(p, F.lit(r"\p{IsGreek}")), of("greek", d)).otherwise(of("latin", d))
        return F.when((F.length(p) < 2) & ((attempt == 0) | ~F.rlike(p, F.lit(r"\p{L}"))), p).otherwise(made)

    return F.array_join(F.transform(F.regexp_extract_all(token, F.lit(_NAME_PARTS), F.lit(0)), part), "")


def _more(alphabet: str, digest: Column, n: Column) -> Column:
    """n characters drawn from a digest, none for n below 1."""
    drawn = lambda i: _letter(alphabet, _draw(F.sha2(F.concat(digest, F.lit("more"), F.floor(i / 40).cast("string")), 512), i))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), drawn), "")).otherwise("")


def surrogates(known: DataFrame, key: str) -> DataFrame:
    """known (entity, attempt) with s, the canonical surrogate as "kind:form". Another attempt draws another one.

    Forms grow with the attempt, so that their number can't run out: addresses and credentials get two more characters for
    each, names a syllable, numbers digits from the second; private IP addresses leave their network, then become IPv6.
    Addresses of fewer than six letters and digits grow at once.
    """
    rows = known.select(
        "entity",
        "attempt",
        F.substring_index("entity", ":", 1).alias("kind"),
        F.regexp_replace("entity", "^[^:]*:", "").alias("value"),
        F.sha2(F.concat_ws("|", F.lit(key), F.col("entity"), F.col("attempt").cast("string")), 512).alias("d"),
    )
    kind, value, d = F.col("kind"), F.col("value"), F.col("d")
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    kept = F.regexp_extract(domain, r"(?:^|\.)(example\.(?:com|org|net)|[^.]*)$", 1)
    free = F.substr(domain, F.lit(1), F.length(domain) - F.length(kept))
    attempt = F.col("attempt")
    short = F.greatest(F.lit(0), F.lit(6) - F.length(F.regexp_replace(F.concat(local, free), "[^a-z0-9]", "")))
    email = F.concat(_scramble(local, d), _more(_LOWER, d, short + attempt * 2), F.lit("@"), _scramble(free, F.sha2(F.concat(d, F.lit("@")), 512)), kept)
    octets = [(F.pmod(_draw(d, i), F.lit(254)) + 1).cast("string") for i in (1, 2, 3)]
    private = F.when(F.rlike(value, F.lit(r"^192\.168\.")) & (attempt < 1), 2).when(F.rlike(value, F.lit(r"^(?:10|192\.168)\.")) & (attempt < 3), 1).otherwise(0)
    first = F.when(private == 2, "192").when(private == 1, "10").otherwise((F.pmod(_draw(d, 0), F.lit(100)) + 11).cast("string"))
    ipv4 = F.concat_ws(".", first, F.when(private == 2, "168").otherwise(octets[0]), *octets[1:])
    ip = F.when(attempt < 6, ipv4).otherwise(F.concat_ws(":", F.lit("2001:db8"), *(F.substr(d, F.lit(1 + 4 * i), F.lit(4)) for i in range(6))))
    # A digit of 2 to 9 stays one, for area codes and exchanges don't start with 0 or 1.
    phone = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when((i == 0) | ~F.rlike(c, F.lit("[0-9]")), c).when(F.rlike(c, F.lit("[2-9]")), _letter("23456789", _draw(d, i))).otherwise(_letter("0123456789", _draw(d, i)))), "")
    body = F.concat(F.substr(value, F.lit(1), F.lit(1)), _scramble(F.substr(value, F.lit(2), F.length(value) - 2), d))
    rows = rows.withColumn("body", F.when(kind == "card", body))
    card = F.concat("body", F.get(F.filter(F.array(*(F.lit(str(i)) for i in range(10))), lambda x: _luhn(F.concat(F.col("body"), x))), F.lit(0)))
    keep = lambda n: F.concat(F.substr(value, F.lit(1), F.lit(n)), _scramble(F.substr(value, F.lit(n + 1)), d))
    start = F.regexp_extract(value, f"^(?:{_STARTS})", 0)
    token = F.concat(start, _scramble(F.substr(value, F.length(start) + 1), d))
    secret = F.when(F.rlike(value, F.lit("^[0-9a-f]+$")), _scramble(value, d, hexadecimal=True)).otherwise(token)
    lines = F.regexp_extract_all(value, F.lit("-----[A-Z ]+-----|(?s:(?!-----).)+"), F.lit(0))
    pem = F.array_join(F.transform(lines, lambda x: F.when(F.startswith(x, F.lit("-----")), x).otherwise(_scramble(x, d))), "")
    group = F.length(F.substring_index(value, ":", 1))
    ipv6 = F.concat(F.substr(value, F.lit(1), group), _scramble(F.substr(value, group + 1), d, hexadecimal=True))
    made = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", _scramble(value, d))
    made = made.when(kind == "iban", keep(2)).when(kind == "pem", pem).when(kind == "ipv6", ipv6)
    for gender in HONORIFICS:
        made = made.when(kind == f"given_{gender}", _new_name(value, d, gender, attempt))
    made = made.when(kind == "surname", _new_name(value, d, None, attempt)).otherwise(secret)
    later = F.greatest(F.lit(0), attempt - 1) * 2
    grown = F.when(kind.isin("phone", "card", "ssn", "iban"), _more("0123456789", d, later)).when(kind == "ipv6", F.when(attempt > 1, F.concat(F.lit("%"), _more(_LOWER, d, later))))
    grown = grown.when(kind.isin("secret", "pem"), _more(_HEX, d, attempt * 2))
    made = F.concat(made, F.coalesce(grown, F.lit("")))
    return rows.select("entity", "attempt", F.concat(kind, F.lit(":"), made).alias("s"))


def _into_digits(m: Column, s: Column) -> Column:
    """The characters of s in the places of m's letters and digits; what s has more of follows an x."""
    places = F.length(F.regexp_replace(m, "[^A-Za-z0-9]", ""))
    rest = F.when(F.length(s) > places, F.concat(F.lit(" x"), F.substr(s, places + 1))).otherwise("")
    return F.concat(_placed(m, s), rest)


def _placed(m: Column, s: Column) -> Column:
    return F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(F.rlike(c, F.lit("[A-Za-z0-9]")), F.substr(s, F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), "[^A-Za-z0-9]", "")), F.lit(1))).otherwise(c)), "")


def _like_case(m: Column, s: Column) -> Column:
    """s, all upper-case as m is, or each part capitalised as m's is."""
    first = lambda x: F.substr(x, F.lit(1), F.lit(1))
    part = lambda a, b: F.when(F.upper(first(a)) == first(a), F.concat(F.upper(first(b)), F.substr(b, F.lit(2)))).otherwise(b)
    parts = lambda x: F.regexp_extract_all(x, F.lit(_NAME_PARTS), F.lit(0))
    return F.when((F.upper(m) == m) & (F.length(m) > 1), F.upper(s)).otherwise(F.array_join(F.zip_with(parts(m), parts(s), part), ""))


def replacements(found: DataFrame, drawn: DataFrame) -> DataFrame:
    """(row, m, new, names): what stands in a text for each of its mentions, in its own format; for names also (token,
    rank, s) of each token, in lower case. Rank 0 is a surname. found: as entities() gives.
    """
    m, k = F.col("m"), F.col("kind")
    s = F.regexp_replace("s", "^[^:]*:", "")
    rank = F.when(F.startswith("entity", F.lit("surname:")), F.lit("0")).otherwise(F.substring_index("entity", ":", 1))
    rows = salted_join(found, drawn.select("entity", "s"), "entity").withColumn("plain", s).withColumn("form", F.when(k == "name", _like_case(F.col("token"), F.col("plain"))).otherwise(F.col("plain")))
    rows = rows.groupBy("row", "m", "kind").agg(F.array_sort(F.collect_list(F.struct("at", "form"))).alias("forms"), F.collect_list(F.when(k == "name", F.struct(F.lower("token").alias("token"), rank.alias("rank"), F.col("plain").alias("s")))).alias("names"))
    rows = rows.select("row", "m", "kind", F.transform("forms", lambda x: x["form"]).alias("forms"), "names")
    form = F.get("forms", F.lit(0))
    new = (
        F.when(k == "name", F.concat(F.regexp_extract(m, _NAME, 1), F.regexp_extract(m, _NAME, 2), F.array_join("forms", " ")))
        .when(k == "secret", F.concat(F.regexp_extract(m, f"^{_SECRET}", 0), form))
        .when(k == "bearer", F.concat(F.regexp_extract(m, f"^{_BEARER}", 0), form))
        .when(k.isin("phone", "card", "ssn", "iban"), _into_digits(m, form))
        .when(k.isin("email", "ipv6"), F.array_join(F.zip_with(F.split(m, ""), F.split(form, ""), lambda a, b: F.when(F.rlike(a, F.lit("[A-Z]")), F.upper(b)).otherwise(b)), ""))
        .otherwise(form)
    )
    return rows.select("row", "m", new.alias("new"), "names")


def find(text: Column) -> Column:
    """All matches in a text, in order."""
    return F.when(F.rlike(text, F.lit(MAYBE)), F.regexp_extract_all(text, F.lit(ALL), F.lit(0))).otherwise(F.array().cast("array<string>"))


def settle(found: DataFrame, key: str) -> DataFrame:
    """entity, attempt, s for distinct entities: no two of a kind share a surrogate, and none is an entity itself.

    In each round all but the smallest entity behind a shared surrogate, and those whose surrogate is an entity, draw
    again from a larger space, so each round leaves a small share of the last one's. There is no limit of rounds.
    """
    known = stash(found.select("entity", F.lit(0).alias("attempt")), "entities")
    while True:
        drawn = stash(surrogates(known, key), "drawn")
        first = drawn.groupBy("s").agg(F.min("entity").alias("first"), F.count("*").alias("c"))
        clash = drawn.join(first.where(F.col("c") > 1), "s").where(F.col("entity") != F.col("first")).select("entity")
        taken = drawn.join(known.select(F.col("entity").alias("s")), "s", "left_semi").select("entity")
        again = stash(clash.union(taken).distinct(), "again")
        if again.isEmpty():
            discard(known, again)
            return drawn
        moved = known.join(again.withColumn("hit", F.lit(1)), "entity", "left").select("entity", (F.col("attempt") + F.coalesce("hit", F.lit(0))).alias("attempt"))
        moved = stash(moved, "entities")
        discard(known, drawn, again)
        known = moved


def protect(documents: DataFrame, key: str, text_column: str = "text", count: str | None = None) -> DataFrame:
    """documents with every detected entity replaced; with `count`, a column of that name tells how many per row.

    Emails, credentials (after a label or `Bearer`, or of a well-known form), private keys, IP addresses, phone, card
    (of a network's form and Luhn-valid) and social-security numbers, IBANs, long hex tokens, and names after honorifics and phrases that
    introduce one. A surrogate is drawn from a keyed digest of the entity's canonical form, so one entity has one
    surrogate in all documents and formats; distinct entities have distinct ones, which is checked over all documents
    and drawn again where it fails. Names keep gender, script, apostrophes and hyphens, and their given names and
    surnames are replaced wherever the same text has them as capitalised words; cards keep issuer digit and check
    digit; all keep case and separators, and length but where a form is too small for its entities.

    A null text stays null, an empty one empty; texts without entities come out unchanged, byte for byte. Repeated rows
    and clashing names of other columns don't matter; an empty table gives an empty result. Texts are searched once;
    only those that hold an entity are shuffled, by a 256-bit hash of the text, to meet their replacements; an entity or a
    text that very many rows hold is dealt to several tasks.
    """
    names = documents.columns
    at = names.index(text_column)
    plain = documents.toDF(*(f"c{i}" for i in range(len(names))))
    packed = stash(plain.select(F.struct(*plain.columns).alias("all"), find(F.col(f"c{at}")).alias("m")), "searched")
    text = F.col("all").getField(f"c{at}")
    some = packed.where(F.size("m") > 0).select("all", "m", text.alias("text"), F.sha2(text, 256).alias("row"))
    hits = some.select("row", F.explode("m").alias("m")).distinct()
    found = stash(entities(hits.select("row", "m", kind_of(F.col("m")).alias("kind")).where(F.col("kind").isNotNull())), "mentions")
    drawn = settle(found.select("entity").distinct(), key)
    per_row = replacements(found, drawn).groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct("m", "new"))).alias("new"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"),
    )
    # A token that is a surname and a given name in one text is taken for the surname.
    first = F.filter("names", lambda x, i: (i == 0) | (F.get("names", i - 1)["token"] != x["token"]))
    per_row = per_row.select("row", "new", F.map_from_entries(F.transform(first, lambda x: F.struct(x["token"], x["s"]))).alias("names"))
    some = salted_join(some, per_row, "row", "left")
    pieces = F.split("text", ALL, -1)
    made = F.transform("m", lambda m: F.coalesce(F.try_element_at("new", m), m))
    some = some.select("all", "m", "new", "names", F.array_join(F.zip_with(pieces, made, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "").alias("text"))
    again = lambda t: F.when(F.rlike(t, F.lit(r"^\p{Lu}")), F.try_element_at("names", F.lower(t)))
    named = F.array_join(F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}'’-]+|[^\p{L}'’-]+"), F.lit(0)), lambda t: F.coalesce(_like_case(t, again(t)), t)), "")
    n = F.size(F.filter("m", lambda m: F.coalesce(F.map_contains_key("new", m), F.lit(False))))
    some = some.select("all", F.when(F.coalesce(F.size("names"), F.lit(0)) > 0, named).otherwise(F.col("text")).alias("text"), n.alias("n"))
    both = some.unionByName(packed.where(F.coalesce(F.size("m"), F.lit(0)) <= 0).select("all", text.alias("text"), F.lit(0).alias("n")))
    kept = [i for i, c in enumerate(names) if c != count]
    out = both.select(*(F.col("text").alias(f"c{i}") if i == at else F.col("all").getField(f"c{i}").alias(f"c{i}") for i in kept), *([F.col("n")] if count else []))
    return out.toDF(*(names[i] for i in kept), *([count] if count else []))
