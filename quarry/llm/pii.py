"""Format-preserving pseudonyms for personal numbers, dates and mail addresses, in DataFrame operations only.

One pattern finds candidates; each is validated by its kind: card numbers by their check digit, IBANs modulo 97, IP
addresses by their octets, social security numbers by their ranges, dates by the calendar, phone numbers by their count
of digits. A valid value is replaced by a keyed permutation of its own format: an alternating Feistel network over two
parts, whose round function is SHA-256 of the key, the kind, the round and the other part. The parts' sizes multiply to
exactly the number of values of the format, so no value is hit twice and none leaves the format: cards keep a right check
digit, dates stay in their century, IBANs keep country and check. Equal values get equal pseudonyms in every document,
and ``reverse=True`` with the same key gives the values back. Candidates that fail validation are left as they are; of a
card candidate that fails, the longest start that ends with a group of digits and passes is replaced (its pseudonym may
depend on the digits behind it), and what follows is not searched again.

Defined cases: a null text stays null; an empty one stays empty; a text without digits or @ is never searched; very long
texts take time in proportion to their length; repeated rows get equal answers; an empty table gives an empty result;
other columns are passed through by ``pseudonymise``, which adds or replaces only the text and ``found``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Lengths of IBANs by country.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "HR LV LI CH", 22: "BH BG CR GE DE IE ME RS GB VA",
    23: "TL GI IQ IL OM SO AE", 24: "AD CZ MD PK RO SA SK ES SE TN VG", 25: "PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO SV GT HU LB NI PL",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LY", 33: "RU",
}


def _iban_form() -> str:
    """The countries' own lengths come first, so that no token behind the value is taken for a part of it."""
    rest = lambda n: r"(?: ?[A-Z0-9]{4}){%d}" % (n // 4) + (r" ?[A-Z0-9]{%d}" % (n % 4) if n % 4 else "")
    known = "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}{rest(n - 4)}" for n, c in IBAN_COUNTRIES.items())
    return rf"(?<![A-Za-z0-9])(?:(?:{known})(?![A-Za-z0-9])|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,4}})?(?![A-Za-z0-9]))"


#: The written forms, in the order in which they are tried.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9][A-Za-z0-9.-]{2,252}",
    "iban": _iban_form(),
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9A-Za-z])",
    "iso_date": r"(?<![0-9A-Za-z/.-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z])(?!-[0-9])",
    "date": r"(?<![0-9A-Za-z/.-])[0-9]{2}[/.][0-9]{2}[/.](?:19|20)[0-9]{2}(?![0-9A-Za-z])(?![/.][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z])(?!-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?![0-9A-Za-z])|(?<![0-9A-Za-z-])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.+-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
#: Fixed value: the start of a matched domain that is one. It only sees the at most 253 characters of a match, as
#: repeated groups take Java's stack.
DOMAIN = r"^(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}"
#: Fixed value: calling codes of one and two digits; all others have three.
CALLING_CODE = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
KINDS = tuple(FORMS)
PATTERN = "|".join(f"(?:{x})" for x in FORMS.values())
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body or a lambda in it reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _int(x: Column) -> Column:
    return x.cast("long")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _at(x: Column, i: Column) -> Column:
    return F.substr(x, i, F.lit(1))


def _rounds(reverse: bool) -> Column:
    return F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if reverse else range(ROUNDS))])


class Cipher:
    """The keyed permutations. Everything is a column expression."""

    def __init__(self, key: str, reverse: bool = False):
        self.key, self.reverse = key, reverse

    def _hash(self, kind: str | Column, r: Column, other: Column) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.sha2(F.concat_ws("|", F.lit(self.key), kind, r.cast("string"), other.cast("string")), 256)

    def numbers(self, kind: str | Column, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
        """A permutation of pairs below the two sizes, as a struct (l, r)."""

        def step(s: Column, r: Column) -> Column:
            def moved(mine: Column, other: Column, size: Column) -> Column:
                h = F.conv(F.substring(self._hash(kind, r, other), 1, 12), 16, 10).cast("long") % size
                return F.pmod(mine - h if self.reverse else mine + h, size)

            even = F.struct(moved(s["l"], s["r"], left_size).alias("l"), s["r"].alias("r"))
            odd = F.struct(s["l"].alias("l"), moved(s["r"], s["l"], right_size).alias("r"))
            return F.when(r % 2 == 0, even).otherwise(odd)

        return F.aggregate(_rounds(self.reverse), F.struct(_int(left).alias("l"), _int(right).alias("r")), step)

    def digits(self, kind: str | Column, d: Column) -> Column:
        """A permutation of digit strings of this length, from 2 to 20 digits."""
        n = F.length(d)
        half = F.floor(n / 2).cast("int")
        size = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
        moved = self.numbers(kind, F.substr(d, F.lit(1), half), F.substr(d, half + 1, n - half), size(half), size(n - half))
        return let(moved, lambda out: F.concat(F.lpad(out["l"].cast("string"), half, F.lit("0")), F.lpad(out["r"].cast("string"), n - half, F.lit("0"))))

    def letter(self, kind: str | Column, c: Column) -> Column:
        """A permutation of the small letters, the capitals and the digits; other characters stay."""

        def turned(alphabet: str) -> Column:
            place, half = F.instr(F.lit(alphabet), c) - 1, len(alphabet) // 2
            moved = self.numbers(kind, F.floor(place / 2), place % 2, F.lit(half), F.lit(2))
            return let(moved, lambda out: _at(F.lit(alphabet), (out["l"] * 2 + out["r"] + 1).cast("int")))

        return F.when(c.rlike("[a-z]"), turned(LOWER)).when(c.rlike("[A-Z]"), turned(UPPER)).when(c.rlike("[0-9]"), turned(DIGITS)).otherwise(c)

    def letters(self, kind: str | Column, text: Column) -> Column:
        """A permutation of strings that keeps each character's class: small letter, capital, digit; others stay."""

        def shifted(mine: Column, h: Column) -> Column:
            def one(i: Column) -> Column:
                c = _at(mine, i)
                k = F.conv(F.substr(h, 2 * ((i - 1) % 32) + 1, F.lit(2)), 16, 10).cast("int")

                def turned(alphabet: str) -> Column:
                    place = F.instr(F.lit(alphabet), c) - 1
                    return _at(F.lit(alphabet), F.pmod(place - k if self.reverse else place + k, F.lit(len(alphabet))) + 1)

                return F.when(c.rlike("[a-z]"), turned(LOWER)).when(c.rlike("[A-Z]"), turned(UPPER)).when(c.rlike("[0-9]"), turned(DIGITS)).otherwise(c)

            places = F.when(F.length(mine) > 0, F.sequence(F.lit(1), F.length(mine))).otherwise(F.array().cast("array<int>"))
            return F.array_join(F.transform(places, one), "")

        def step(s: Column, r: Column) -> Column:
            even = let(self._hash(kind, r, s["r"]), lambda h: F.struct(shifted(s["l"], h).alias("l"), s["r"].alias("r")))
            odd = let(self._hash(kind, r, s["l"]), lambda h: F.struct(s["l"].alias("l"), shifted(s["r"], h).alias("r")))
            return F.when(r % 2 == 0, even).otherwise(odd)

        half = F.floor(F.length(text) / 2).cast("int")
        start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text) - half).alias("r"))
        longer = F.aggregate(_rounds(self.reverse), start, step, lambda out: F.concat(out["l"], out["r"]))
        return F.when(F.length(text) == 1, self.letter(kind, text)).otherwise(longer)  # one character has no halves

    def date(self, kind: str, year: Column, month: Column, day: Column) -> Column:
        """Another day of the same century: 1900 to 1999 has 92 x 397 days, 2000 to 2099 has 75 x 487."""
        first = F.when(year < 2000, F.lit("1900-01-01")).otherwise(F.lit("2000-01-01")).cast("date")
        a, b = F.when(year < 2000, F.lit(92)).otherwise(F.lit(75)), F.when(year < 2000, F.lit(397)).otherwise(F.lit(487))
        n = F.datediff(F.make_date(year, month, day), first)
        moved = let(n, lambda n: self.numbers(kind, F.floor(n / b), n % b, a, b))
        return let(moved, lambda out: F.date_add(first, (out["l"] * b + out["r"]).cast("int")))


def refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in turn by ``digits``."""

    def filled(digits: Column) -> Column:
        one = lambda i: F.when(_at(form, i).rlike("[0-9]"), _at(digits, F.length(_digits(F.substr(form, F.lit(1), i))))).otherwise(_at(form, i))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), one), "")

    return let(digits, filled)


def check_digit(payload: Column) -> Column:
    """The digit that makes ``payload`` followed by it pass the card check."""

    def of(payload: Column) -> Column:
        n = F.length(payload)

        def add(total: Column, i: Column) -> Column:  # i counts from the right
            v = _at(payload, n - i + 1).cast("int") * (1 + i % 2)
            return total + v - F.when(v > 9, 9).otherwise(0)

        return F.pmod(10 - F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10)).cast("string")

    return let(payload, of)


def mod97(text: Column) -> Column:
    def add(r: Column, c: Column) -> Column:
        letter = F.instr(F.lit(UPPER), c)
        return F.when(letter > 0, (r * 100 + letter + 9) % 97).otherwise((r * 10 + c.cast("int")) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def found(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def _email(m: Column, cipher: Cipher) -> Column:
    """The local part is moved in small letters, with the domain as a tweak, and gets its capitals back, so that equal
    addresses stay linked whatever their case. What was matched behind the domain stays."""
    local = F.substring_index(m, "@", 1)

    def cased(new: Column) -> Column:
        one = lambda i: F.when(_at(local, i).rlike("[A-Z]"), F.upper(_at(new, i))).otherwise(_at(new, i))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(local)), one), "")

    def moved(rest: Column) -> Column:
        domain = F.regexp_extract(rest, DOMAIN, 0)
        kind = F.concat(F.lit("email|"), F.lower(domain))
        return F.when(domain != "", found("email", F.concat(let(let(F.lower(local), lambda x: let(kind, lambda k: cipher.letters(k, x))), cased), F.lit("@"), rest)))

    return let(F.substr(m, F.length(local) + 2, F.length(m)), moved)


def _iban(m: Column, cipher: Cipher) -> Column:
    """The new IBAN with the spaces of the old one."""

    def spaced(new: Column) -> Column:
        one = lambda i: F.when(_at(m, i) == " ", F.lit(" ")).otherwise(_at(new, F.length(F.replace(F.substr(m, F.lit(1), i), F.lit(" "), F.lit("")))))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), one), "")

    def moved(plain: Column) -> Column:
        country, account = F.substring(plain, 1, 2), F.substr(plain, F.lit(5), F.length(plain))
        check = lambda new: F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
        whole = let(let(account, lambda a: cipher.letters("iban", a)), lambda new: F.concat(country, check(new), new))
        valid = mod97(F.concat(account, F.substring(plain, 1, 4))) == 1
        return F.when(valid, found("iban", let(whole, spaced)))

    return let(F.replace(m, F.lit(" "), F.lit("")), moved)


def _ip(m: Column, cipher: Cipher) -> Column:
    def moved(o: Column) -> Column:
        at = lambda i: F.get(o, F.lit(i))
        pair = cipher.numbers("ip", at(0) * 256 + at(1), at(2) * 256 + at(3), F.lit(65536), F.lit(65536))
        new = let(pair, lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)]))
        return F.when(F.forall(o, lambda x: x <= 255), found("ip", new))

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), moved)


def _date(kind: str, m: Column, cipher: Cipher, year: Column, month: Column, day: Column, form: str) -> Column:
    valid = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd").isNotNull()
    moved = cipher.date("date", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.when(valid, found(kind, refill(m, F.date_format(moved, form))))


def _ssn(m: Column, d: Column, cipher: Cipher) -> Column:
    area, group, serial = F.substring(d, 1, 3).cast("int"), F.substring(d, 4, 2).cast("int"), F.substring(d, 6, 4).cast("int")
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)  # 898 areas, 99 groups, 9999 serials
    pair = cipher.numbers("ssn", place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))

    def written(p: Column) -> Column:
        new_area = F.floor(p["l"] / 99) + F.when(F.floor(p["l"] / 99) >= 665, 2).otherwise(1)
        return F.concat(*[F.lpad(x.cast("string"), n, "0") for x, n in ((new_area, 3), (p["l"] % 99 + 1, 2), (p["r"] + 1, 4))])

    return F.when(valid, found("ssn", refill(m, let(pair, written))))


def _phone(m: Column, d: Column, cipher: Cipher) -> Column:
    """The country's code stays, the digits of the national number are moved: as one number, however they are grouped. A
    number that is written without a code is one of the country with code 1, and is moved as with it."""
    code = F.when(m.startswith("+"), F.regexp_extract(d, CALLING_CODE, 0)).otherwise("")

    def moved(code: Column) -> Column:
        own = F.substr(d, F.length(code) + 1, F.length(d))
        kind = F.concat(F.lit("phone|"), F.when(code == "", "1").otherwise(code))
        new = F.concat(code, let(own, lambda x: let(kind, lambda k: cipher.digits(k, x))))
        return F.when((F.length(d) >= 8) & (F.length(d) <= 15) & (F.length(own) >= 5), found("phone", refill(m, new)))

    return let(code, moved)


def _card_ends(m: Column) -> Column:
    """Lengths of the starts of ``m`` that end with a group of digits and pass the check."""

    def valid(i: Column) -> Column:
        d = _digits(F.substr(m, F.lit(1), i))
        right = let(d, lambda d: (F.length(d) >= 13) & (F.substr(d, F.length(d), F.lit(1)) == check_digit(F.substr(d, F.lit(1), F.length(d) - 1))))
        return F.when(_at(m, i + 1).rlike("[0-9]") | _at(m, i).rlike("[ -]"), False).otherwise(right)

    return F.filter(F.sequence(F.lit(13), F.length(m)), valid)


def _card(m: Column, d: Column, cipher: Cipher) -> Column:
    """The longest start that is a card number gets another one; what follows it (a CVV, an expiry) stays."""

    def once(m: Column) -> Column:
        payload = let(_digits(m), lambda d: F.substr(d, F.lit(1), F.length(d) - 1))
        new = let(let(payload, lambda x: cipher.digits("card", x)), lambda x: F.concat(x, check_digit(x)))
        return refill(m, new)

    def walked(end: Column) -> Column:
        """Again until what follows makes no longer number valid, or ``reverse`` would take that one."""
        rest = F.substr(m, end + 1, F.length(m))

        def step(s: Column, _: Column) -> Column:
            new = let(once(s["v"]), lambda v: F.struct(v.alias("v"), (F.array_max(_card_ends(F.concat(v, rest))) == end).alias("done")))
            return F.when(s["done"], s).otherwise(new)

        start = F.struct(F.substr(m, F.lit(1), end).alias("v"), F.lit(False).alias("done"))
        return F.concat(F.aggregate(F.sequence(F.lit(1), F.lit(24)), start, step)["v"], rest)

    payload = F.substr(d, F.lit(1), F.length(d) - 1)
    whole = F.substr(d, F.length(d), F.lit(1)) == check_digit(payload)
    part = let(F.array_max(_card_ends(m)), lambda end: F.when(end.isNotNull(), found("card", walked(end))))
    return F.when(whole, found("card", once(m))).otherwise(part)


def pseudonym(m: Column, cipher: Cipher) -> Column:
    """A struct (kind, value) for a candidate; null where no kind's validation holds."""
    shaped = lambda kind: m.rlike(f"^(?:{FORMS[kind]})\\z")

    def of(d: Column) -> Column:
        part = lambda at, n: F.substring(d, at, n)
        return (
            F.when(F.instr(m, "@") > 0, _email(m, cipher))
            .when(shaped("iban"), _iban(m, cipher))
            .when(shaped("ip"), _ip(m, cipher))
            .when(shaped("iso_date"), _date("iso_date", m, cipher, part(1, 4), part(5, 2), part(7, 2), "yyyyMMdd"))
            .when(shaped("date"), _date("date", m, cipher, part(5, 4), part(3, 2), part(1, 2), "ddMMyyyy"))
            .when(shaped("ssn"), _ssn(m, d, cipher))
            .when(shaped("phone"), _phone(m, d, cipher))
            .when(shaped("card"), _card(m, d, cipher))
        )

    return let(_digits(m), of)


def pseudonymise(df: DataFrame, text_col: str = "text", *, key: str, reverse: bool = False, found_col: str = "found") -> DataFrame:
    """Under a secret ``key``, ``df`` with the text rewritten and ``found_col``, the kinds that were replaced, in order of their places."""
    cipher = Cipher(key, reverse)
    text = F.col(text_col)
    some = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    out = df.withColumn("_pi_hits", F.when(some, F.regexp_extract_all(text, F.lit(PATTERN), 0)))
    out = out.withColumn("_pi_new", F.transform("_pi_hits", lambda m: F.coalesce(pseudonym(m, cipher), F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value")))))
    gaps = F.split(text, PATTERN, -1)
    spliced = F.array_join(F.zip_with(gaps, F.col("_pi_new.value"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    kinds = F.coalesce(F.filter(F.col("_pi_new.kind"), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return out.withColumns({text_col: F.when(F.size("_pi_new") > 0, spliced).otherwise(text), found_col: kinds}).drop("_pi_hits", "_pi_new")
