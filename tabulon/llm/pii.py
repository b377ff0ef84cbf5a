"""Personal data replaced by format-preserving Feistel pseudonyms.

One regular expression finds candidates; each is validated (Luhn, mod 97, octet
ranges, calendar, assigned ranges) and permuted within its own format by a keyed
Feistel network, so that a card number stays a card number with a right check
digit, a date stays a date, and equal values get equal pseudonyms in every
document.  The permutation is a bijection of each format, so different values
never meet.  The two halves of a value may have different radices; the domain is
exactly their product and no cycle walking is needed.

Everything is string and higher-order functions inside the row: no shuffle.
Documents without a digit pair, digits around a point, an at sign or the mark of a
secret are passed through.

Defined results: a null text stays null and has no findings; of candidates that do
not validate whole the longest runs of their groups that do are replaced, the rest
stays as it is; a value named as a password, token, secret or key (in any case, with
what may stand before such a name, in quotes or not, from four characters on) is
replaced whether or not it validates, its letters and digits that is, but for a plain
lower-case word after a colon and a blank, which is prose; a date that can be read
day first is read so, month first where that is no date; dates before the year 101,
and 29 February month first outside 1900-2099, stay; repeated rows give repeated results; texts of any length are
read whole, in memory that follows the text; an empty table gives an empty result;
``pseudonymise`` keeps all columns of its input, ``find_and_replace`` reads two.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

ROUNDS = 8
#: Dates are permuted among so many days: 250 x 292 from 1900-01-01, as many before
#: and after in blocks of their own.
DAYS = (250, 292)
#: Blocks before 1900 that lie after the year 100.
BLOCKS_BEFORE = 9
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card", "secret")

_EMAIL = r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
#: Countries by the length of their IBAN.
_LANDS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SD SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "IR IS TR", 27: "BF BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _of_length(n: int, lands: str) -> str:
    rest = (n - 4) % 4
    return rf"(?:{lands.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


# The length of the country first; what has another length or country, as far as it goes.
_IBAN = "|".join([*(_of_length(*x) for x in sorted(_LANDS.items(), reverse=True)), r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"])
#: The same in lower case, of a known country and length only.
_IBAN_LOWER = "|".join(_of_length(*x).replace(x[1].replace(" ", "|"), x[1].replace(" ", "|").lower()).replace("[A-Z0-9]", "[a-z0-9]") for x in sorted(_LANDS.items(), reverse=True))
_IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Eight groups, or fewer around two colons, with a digit.
_IP6 = rf"(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]{{0,30}}[0-9])(?:{_HEX}(?::{_HEX}){{0,5}})?::(?:{_HEX}(?::{_HEX}){{0,5}})?"
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4}"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
_PHONE = r"\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|0[1-9][0-9]{1,3}[ /-][0-9]{6,8}"
_CARD = r"[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}(?: [0-9]{1,3})?|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5}"
#: Marks that vendors put before their keys; they stay.
_VENDOR = r"AKIA|ASIA|AIza|gh[pousr]_|xox[abprs]-|sk-"
_SECRET = r"(?:AKIA|ASIA)[0-9A-Z]{16}|AIza[A-Za-z0-9_-]{35}|gh[pousr]_[A-Za-z0-9]{36,251}|xox[abprs]-[A-Za-z0-9-]{10,200}|sk-[A-Za-z0-9_-]{20,200}"
#: Names of secrets, whatever stands before them; then a quote, a sign, a quote.
_WORDS = r"(?i:password|passwd|passphrase|pwd|token|secret|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key)"
_NAMES = rf"{_WORDS}[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?"
# a value begins after a sign, blank or quote, which is cheap to see; a plain word after ": " is prose
_NAMED = (
    rf"(?<=[=:\s\"'])(?<={_NAMES})(?![\"'])(?!(?<=:\s{{1,3}})[a-z]{{1,11}}(?![^\s.,;!?)]))[^\s\"'&<>]{{4,512}}"
    r"|(?<=\bBearer )[A-Za-z0-9._~+/-]{16,512}"
)
_PEM = r"(?<=-----BEGIN (?:[A-Z]{2,12} )?PRIVATE KEY-----)[A-Za-z0-9+/=\s]{32,8192}"
_EDGE = r"(?<![A-Za-z0-9])(?:{})(?![A-Za-z0-9])"
CANDIDATE = "|".join(
    [_PEM, _EMAIL, _NAMED, _EDGE.format(_IBAN), _EDGE.format(_IBAN_LOWER), rf"(?<![A-Za-z0-9:])(?:{_IP6})(?![A-Za-z0-9:])", r"(?<![0-9.])" + _IP + r"(?![0-9]|\.[0-9])", _EDGE.format("|".join((_DATE, _SSN, _CARD)))]
    + [r"(?<![A-Za-z0-9])(?:" + _PHONE + r")(?![A-Za-z0-9])", _EDGE.format(_SECRET)]
)
#: What a text without any candidate does not hold.
GATE = r"[0-9]{2}|[0-9]\.[0-9]|@|::|\b(?:" + _VENDOR + r")|Bearer |PRIVATE KEY-----|" + _WORDS + r"[\"']?\s{0,3}[=:]"


def _full(pattern: str) -> str:
    return rf"^(?:{pattern})$"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _chars(s: Column) -> Column:
    return F.array_remove(F.split(s, ""), "")


def feistel(a: Column, b: Column, ra: Column, rb: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of [0, ra) x [0, rb): struct(a, b)."""

    def mix(r: Column, x: Column) -> Column:
        h = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), x.cast("string")), 256)
        return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")

    def step(s: Column, r: Column) -> Column:
        left = F.struct(((s["a"] + mix(r, s["b"])) % ra).alias("a"), s["b"].alias("b"))
        right = F.struct(s["a"].alias("a"), ((s["b"] + mix(r, s["a"])) % rb).alias("b"))
        return F.when(r % 2 == 0, left).otherwise(right)

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _number(s: Column, base: int) -> Column:
    at = "0123456789" if base == 10 else "abcdefghijklmnopqrstuvwxyz"
    return F.aggregate(_chars(s), F.lit(0).cast("bigint"), lambda acc, c: acc * base + F.instr(F.lit(at), c) - 1)


def _exact(base: int, n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(base**k).cast("bigint") for k in range(13))), n + 1)


def permute(s: Column, base: int, key: str, tweak: Column) -> Column:
    """A permutation of all strings of the length of ``s`` over the digits or
    letters, in blocks of 24 symbols."""

    def block(x: Column, k: Column) -> Column:
        n = F.char_length(x)
        u = F.floor(n / 2).cast("int")
        left, right = F.substr(x, F.lit(1), u), F.substr(x, u + 1, n - u)
        mixed = feistel(
            _number(left, base), _number(right, base), _exact(base, u), _exact(base, n - u), key, F.concat_ws("/", tweak, k.cast("string"), n.cast("string"))
        )
        return let(mixed, lambda m: F.concat(_symbols(m["a"], u, base), _symbols(m["b"], n - u, base)))

    n = F.char_length(s)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / 24).cast("int")), lambda k: let(F.substr(s, k * 24 + 1, F.lit(24)), lambda x: block(x, k))
    )
    return F.when(n > 0, F.array_join(blocks, "")).otherwise("")


def _symbols(x: Column, n: Column, base: int) -> Column:
    at = "0123456789" if base == 10 else "abcdefghijklmnopqrstuvwxyz"

    def digit(k: Column) -> Column:
        whole = F.call_function("div", x, _exact(base, n - 1 - k))
        return F.substr(F.lit(at), (whole % base + 1).cast("int"), F.lit(1))

    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), digit), "")).otherwise("")


def _refill(shape: Column, digits: Column, letters: Column | None = None) -> Column:
    """``shape`` with its digits, and letters in their case, replaced in order."""

    def of(pool: Column, c: Column, i: Column, other: str) -> Column:
        k = F.char_length(F.regexp_replace(F.substr(shape, F.lit(1), i + 1), other, ""))
        return F.substr(pool, k, F.lit(1))

    def char(c: Column, i: Column) -> Column:
        out = F.when(c.rlike("^[0-9]$"), of(digits, c, i, "[^0-9]"))
        if letters is not None:
            new = of(letters, c, i, "[^A-Za-z]")
            out = out.when(c.rlike("^[a-z]$"), new).when(c.rlike("^[A-Z]$"), F.upper(new))
        return out.otherwise(c)

    return F.array_join(F.transform(_chars(shape), char), "")


def _luhn(d: Column) -> Column:
    """The sum that a valid number makes divisible by ten."""

    def value(c: Column, i: Column) -> Column:
        x = c.cast("int")
        twice = x * 2 - F.when(x > 4, 9).otherwise(0)
        return F.when((F.char_length(d) - i) % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.transform(_chars(d), value), F.lit(0), lambda a, x: a + x)


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        n = F.char_length(d)
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute(F.substr(d, F.lit(2), n - 2), 10, key, F.lit("card")))
        return let(body, lambda b: F.concat(b, ((F.lit(10) - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

    return let(_digits(m), lambda d: F.when((_luhn(d) % 10 == 0) & ~d.rlike("^0+$"), _refill(m, new(d))))


def _mod97(s: Column) -> Column:
    def step(acc: Column, c: Column) -> Column:
        x = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(x < 10, (acc * 10 + x) % 97).otherwise((acc * 100 + x) % 97)

    return F.aggregate(_chars(s), F.lit(0), step)


def _iban(m: Column, key: str) -> Column:
    def new(s: Column) -> Column:
        land, body = F.substr(s, F.lit(1), F.lit(2)), F.substr(s, F.lit(5), F.char_length(s))
        moved = _refill(body, permute(_digits(body), 10, key, F.concat(F.lit("iban"), F.upper(land))))
        check = lambda b: F.lpad((F.lit(98) - _mod97(F.upper(F.concat(b, land, F.lit("00"))))).cast("string"), 2, "0")
        return let(moved, lambda b: F.concat(land, check(b), b))

    def spaced(s: Column, done: Column) -> Column:
        k = lambda i: F.char_length(F.replace(F.substr(m, F.lit(1), i + 1), F.lit(" "), F.lit("")))
        return F.array_join(F.transform(_chars(m), lambda c, i: F.when(c == " ", c).otherwise(F.substr(done, k(i), F.lit(1)))), "")

    def valid(s: Column) -> Column:
        return _mod97(F.upper(F.concat(F.substr(s, F.lit(5), F.char_length(s)), F.substr(s, F.lit(1), F.lit(4))))) == 1

    return let(F.replace(m, F.lit(" "), F.lit("")), lambda s: F.when(valid(s), let(new(s), lambda done: spaced(s, done))))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))

    def new(o: Column) -> Column:
        mixed = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
        halves = lambda x: [F.floor(x / 256).cast("string"), (x % 256).cast("string")]
        return let(mixed, lambda s: F.concat_ws(".", *halves(s["a"]), *halves(s["b"])))

    return let(octets, lambda o: F.when(F.forall(o, lambda x: x <= 255), new(o)))


def _ip6(m: Column, key: str) -> Column:
    """All spellings of an address get one, of eight groups."""
    half = F.lit(1 << 32)

    def groups(side: Column) -> Column:
        return F.filter(F.split(side, ":"), lambda x: x != "")

    def new(left: Column, right: Column) -> Column:
        zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right))
        whole = F.transform(F.concat(left, zeros, right), lambda x: F.conv(x, 16, 10).cast("bigint"))
        word = lambda o, i: o[i] * 65536 + o[i + 1]
        text = lambda x: F.concat_ws(":", F.lower(F.hex(F.floor(x / 65536))), F.lower(F.hex(x % 65536)))

        def mixed(o: Column) -> Column:
            high = feistel(word(o, 0), word(o, 2), half, half, key, F.lit("ip6"))
            tweak = F.concat_ws("/", F.lit("ip6"), word(o, 0).cast("string"), word(o, 2).cast("string"))
            low = feistel(word(o, 4), word(o, 6), half, half, key, tweak)
            return let(F.struct(high.alias("h"), low.alias("l")), lambda s: F.concat_ws(":", text(s["h"]["a"]), text(s["h"]["b"]), text(s["l"]["a"]), text(s["l"]["b"])))

        return let(whole, mixed)

    short = F.instr(m, "::") > 0
    left = groups(F.substring_index(m, "::", 1))
    right = F.when(short, groups(F.substring_index(m, "::", -1))).otherwise(F.array().cast("array<string>"))
    sides = F.struct(left.alias("l"), right.alias("r"))
    fits = lambda s: F.when(short, F.size(s["l"]) + F.size(s["r"]) < 8).otherwise(F.size(s["l"]) == 8)
    return let(sides, lambda s: F.when(fits(s), new(s["l"], s["r"])))


def _date(m: Column, key: str) -> Column:
    year_first = m.rlike(r"^[0-9]{4}")
    mark = F.when(year_first, F.substr(m, F.lit(5), F.lit(1))).otherwise(F.substr(m, F.lit(3), F.lit(1)))
    plain = F.translate(m, "/.", "--")
    day = F.when(year_first, F.try_to_date(plain, "yyyy-MM-dd")).otherwise(F.try_to_date(plain, "dd-MM-yyyy"))
    first = F.lit("1900-01-01").cast("date")
    a, b = DAYS

    def new(k: Column) -> Column:
        block, rest = F.floor(k / (a * b)), F.pmod(k, F.lit(a * b))
        mixed = feistel(F.floor(rest / b), rest % b, F.lit(a), F.lit(b), key, F.concat(F.lit("date"), F.when(block != 0, block.cast("string")).otherwise("")))
        moved = let(mixed, lambda s: F.date_add(first, (block * (a * b) + s["a"] * b + s["b"]).cast("int")))

        def text(d: Column) -> Column:
            y, mon, dd = (F.date_format(d, f) for f in ("yyyy", "MM", "dd"))
            return F.when(year_first, F.concat(y, mark, mon, mark, dd)).otherwise(F.concat(dd, mark, mon, mark, y))

        return let(moved, text)

    # the last block that ends before the year 10000
    last = (2_958_465 - 2) // (a * b) * (a * b)
    ordinary = let(F.date_diff(day, first), lambda k: F.when((k >= -BLOCKS_BEFORE * a * b) & (k < last - a * b), new(k)))
    return F.coalesce(ordinary, F.when(~year_first, _month_first(m, mark, key)))


#: Days from the 13th on, of which no date can be read day first, in months of common years.
_LATE = (19, 16, 19, 18, 19, 18, 19, 19, 18, 19, 18, 19)


def _month_first(m: Column, mark: Column, key: str) -> Column:
    """A date with a day from the 13th on, among such dates of its 200 years; 29
    February among those of 1900-2099."""
    before = F.array(*(F.lit(sum(_LATE[:k])) for k in range(12)))
    part = lambda i, n: F.substr(m, F.lit(i), F.lit(n)).cast("int")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")

    def common(x: Column) -> Column:
        block = F.floor((x["y"] - 1900) / 200) * 200 + 1900
        at = (x["y"] - block) * sum(_LATE) + F.get(before, x["m"] - 1) + x["d"] - 13
        tweak = F.concat_ws("/", F.lit("month first"), block.cast("string"))
        mixed = feistel(F.floor(at / sum(_LATE)), at % sum(_LATE), F.lit(200), F.lit(sum(_LATE)), key, tweak)

        def text(s: Column) -> Column:
            month = F.size(F.filter(before, lambda n: n <= s["b"]))
            return F.concat(two(month), mark, two(s["b"] - F.get(before, month - 1) + 13), mark, F.lpad((block + s["a"]).cast("string"), 4, "0"))

        return let(mixed, text)

    def leap(x: Column) -> Column:
        j = F.floor((x["y"] - 1904) / 4)
        mixed = feistel(F.floor(j / 7), j % 7, F.lit(7), F.lit(7), key, F.lit("29 February"))
        return let(mixed, lambda s: F.concat(F.lit("02"), mark, F.lit("29"), mark, (F.lit(1904) + 4 * (s["a"] * 7 + s["b"])).cast("string")))

    late = F.array(*(F.lit(n + 12) for n in _LATE))
    parts = F.struct(part(1, 2).alias("m"), part(4, 2).alias("d"), part(7, 4).alias("y"))
    is_common = lambda x: x["m"].between(1, 12) & (x["d"] >= 13) & (x["d"] <= F.get(late, x["m"] - 1)) & x["y"].between(101, 9899)
    is_leap = lambda x: (x["m"] == 2) & (x["d"] == 29) & (x["y"] % 4 == 0) & x["y"].between(1904, 2096)
    return let(parts, lambda x: F.when(is_common(x), common(x)).when(is_leap(x), leap(x)))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999."""
    p = F.transform(F.split(m, "-"), lambda x: x.cast("int"))

    def new(x: Column) -> Column:
        area = x[0] - F.when(x[0] > 666, 2).otherwise(1)
        mixed = feistel(area * 99 + x[1] - 1, x[2] - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("ssn"))

        def text(s: Column) -> Column:
            k = F.floor(s["a"] / 99)
            parts = ((k + F.when(k >= 665, 2).otherwise(1), 3), (s["a"] % 99 + 1, 2), (s["b"] + 1, 4))
            return F.concat_ws("-", *(F.lpad(v.cast("string"), n, "0") for v, n in parts))

        return let(mixed, text)

    valid = lambda x: x[0].between(1, 899) & (x[0] != 666) & (x[1] > 0) & (x[2] > 0)
    return let(p, lambda x: F.when(valid(x), new(x)))


def _phone(m: Column, key: str) -> Column:
    """The country code, or the 0 before an area, stays; all other digits are permuted."""
    code = F.regexp_extract(m, r"^\+([0-9]{1,3})(?=[^0-9])", 1)

    def new(d: Column) -> Column:
        keep = F.when(code != "", F.char_length(code)).when(m.startswith("+"), 2).when(m.startswith("0"), 1).otherwise(0)
        rest = F.substr(d, keep + 1, F.char_length(d))
        return _refill(m, F.concat(F.substr(d, F.lit(1), keep), permute(rest, 10, key, F.concat(F.lit("phone"), F.substr(d, F.lit(1), keep)))))

    return let(_digits(m), lambda d: F.when(F.char_length(d).between(8, 15), new(d)))


def _mixed(m: Column, key: str, tweak: Column) -> Column:
    letters = F.lower(F.regexp_replace(m, "[^A-Za-z]", ""))
    return _refill(m, permute(_digits(m), 10, key, tweak), permute(letters, 26, key, tweak))


def _email(m: Column, key: str) -> Column:
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.concat(_mixed(name, key, F.concat(F.lit("email"), F.lower(host))), F.lit("@"), host)


def _secret(m: Column, key: str) -> Column:
    head = F.when(m.rlike(_full(_SECRET)), F.regexp_extract(m, f"^(?:{_VENDOR})", 0)).otherwise("")
    return let(F.substr(m, F.char_length(head) + 1, F.char_length(m)), lambda x: F.concat(head, _mixed(x, key, F.lit("secret"))))


def _form(m: Column, key: str) -> Column:
    """struct(kind, new) of a value with a format of its own; null where none validates."""
    forms = (("email", _EMAIL, _email), ("ip", _IP, _ip), ("ip", _IP6, _ip6), ("date", _DATE, _date), ("ssn", _SSN, _ssn))
    forms += (("iban", f"{_IBAN}|{_IBAN_LOWER}", _iban), ("card", _CARD, _card), ("phone", _PHONE, _phone))
    out = None
    for kind, pattern, make in forms:
        body = F.struct(F.lit(kind).alias("kind"), make(m, key).alias("new"))
        out = F.when(m.rlike(_full(pattern)), body) if out is None else out.when(m.rlike(_full(pattern)), body)
    return out


def _parts(m: Column, key: str) -> Column:
    """struct(kinds, text) of a candidate that does not validate whole: from each
    group of it on, the longest run of groups that does."""
    end = r"[ .-]+$"

    def runs(t: Column, i: Column) -> Column:
        def run(j: Column) -> Column:
            piece = lambda raw: let(F.regexp_replace(raw, end, ""), lambda p: F.struct(j.alias("j"), _form(p, key).alias("x"), F.substr(raw, F.char_length(p) + 1, F.char_length(raw)).alias("tail")))
            return let(F.array_join(F.slice(t, i, j - i + 1), ""), piece)

        return F.get(F.filter(F.transform(F.sequence(F.size(t), i, F.lit(-1)), run), lambda r: r["x"]["new"].isNotNull()), F.lit(0))

    def state(free: Column, text: Column, kinds: Column) -> Column:
        return F.struct(free.cast("int").alias("free"), text.alias("text"), kinds.alias("kinds"))

    def step(t: Column):
        def of(s: Column, i: Column) -> Column:
            some = lambda r: state(r["j"] + 1, F.concat(s["text"], r["x"]["new"], r["tail"]), F.concat(s["kinds"], F.array(r["x"]["kind"])))
            none = state(i + 1, F.concat(s["text"], F.get(t, i - 1)), s["kinds"])
            return F.when(i < s["free"], s).otherwise(let(runs(t, i), lambda r: F.when(r.isNotNull(), some(r)).otherwise(none)))

        return of

    start = state(F.lit(1), F.lit(""), F.array().cast("array<string>"))
    groups = F.regexp_extract_all(m, F.lit("[^ .-]+[ .-]*|[ .-]+"), F.lit(0))
    return let(let(groups, lambda t: F.aggregate(F.sequence(F.lit(1), F.size(t)), start, step(t))), lambda s: F.struct(s["kinds"].alias("kinds"), s["text"].alias("text")))


def _replacement(m: Column, named: Column, key: str) -> Column:
    """struct(kinds, text) of a candidate; no kinds where nothing in it validates.

    A value with the shape of a number that does not validate is a secret where a
    name for one stands before it (``named``)."""
    shaped = m.rlike(_full("|".join((_EMAIL, _IP, _IP6, _DATE, _SSN, _IBAN, _IBAN_LOWER, _CARD, _PHONE))))
    secret = F.struct(F.lit("secret").alias("kind"), _secret(m, key).alias("new"))
    whole = lambda x: F.struct(F.array(x["kind"]).alias("kinds"), x["new"].alias("text"))
    same = F.struct(F.array().cast("array<string>").alias("kinds"), m.alias("text"))
    return let(
        F.when(shaped, _form(m, key)).otherwise(secret),
        lambda x: F.when(x["new"].isNotNull(), whole(x)).when(named, whole(secret)).when(m.rlike("[ .-]"), _parts(m, key)).otherwise(same),
    )


def replaced(text: Column, key: str) -> Column:
    """struct(text, kinds): the pseudonymised text and the kinds found, in order.

    Plans and event logs show what ``round_key`` derives from ``key``, not ``key``.
    """
    derived = round_key(key)

    def rebuild(pieces: Column) -> Column:
        matches = F.regexp_extract_all(text, F.lit(CANDIDATE), 0)
        found = F.transform(matches, lambda m, i: _replacement(m, F.get(pieces, i).rlike(_NAMES + "$"), derived))

        def joined(found: Column) -> Column:
            parts = F.transform(found, lambda x, i: F.concat(x["text"], F.get(pieces, i + 1)))
            kinds = F.flatten(F.transform(found, lambda x: x["kinds"]))
            return F.struct(F.concat(F.get(pieces, F.lit(0)), F.array_join(parts, "")).alias("text"), kinds.alias("kinds"))

        return let(found, joined)

    none = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    some = let(F.split(text, CANDIDATE, -1), lambda p: F.when(F.size(p) > 1, rebuild(p)).otherwise(none))
    return F.when(text.rlike(GATE), some).otherwise(none)


def round_key(key: str) -> str:
    """The key of the networks: one-way, so that who reads a plan does not learn
    ``key``.  It still undoes these pseudonyms, so plans are to be kept as private
    as the mapping itself."""
    return hashlib.sha256(b"feistel round key/" + key.encode()).hexdigest()


def find_and_replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_found, n_<kind>…) with the pseudonymised text."""
    found = docs.select(F.col(f"`{id_col}`"), replaced(F.col(f"`{text_col}`"), key).alias("_r"))
    count = lambda kind: F.size(F.filter("_r.kinds", lambda k: k == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        F.col(f"`{id_col}`"),
        F.col("_r.text").alias(text_col),
        F.size("_r.kinds").cast("bigint").alias("n_found"),
        *(count(k) for k in KINDS),
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text replaced and all other columns kept."""
    return docs.withColumn(text_col, replaced(F.col(f"`{text_col}`"), key)["text"])
