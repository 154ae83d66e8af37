"""Format-preserving pseudonyms for personal numbers, dates and addresses; Spark expressions only.

Method. Candidates are found by one pattern, then validated (Luhn check, mod-97 check, octets, calendar,
number plan; phones by their shape alone). A valid value is permuted within its format by a keyed Feistel
network over its digits (or letters, or date), tweaked by kind and length; where the format has holes, such
as days that a month lacks, it walks along its cycle until the value is valid. Equal values get equal
pseudonyms in every document and different ones of one format stay different, so with the key the map
can be undone (reidentify).

A run of digit groups that isn't a card as a whole (cards beside a CVV, an expiry or other numbers), however
long, is searched for cards at its groups' borders; only those parts are replaced (cards_inside). Their place in
the run may be read otherwise after the permutation, so this kind alone may not be undone.

Kinds: e-mail (letters and digits of the local part are permuted, the domain stays), IPv4, IBAN (country
stays, the check digits are set anew), card numbers (the check digit is set anew), national ids
ddd-dd-dddd by their number plan, phone numbers (the country code stays), dates yyyy-mm-dd, dd/mm/yyyy and
mm/dd/yyyy of 1700-2099. A slashed date keeps the number of digits of each part, and its reading: day
first if that is a date, else month first, which only days above 12 are. A run of 20 digits or more without a
separator is no number of these kinds.

Nulls and edges: null text stays null, texts without a candidate are not touched, an empty table gives an
empty one. Whole texts are searched, however long; repeated rows are treated alike; extra columns stay,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, unused

ROUNDS = 8
_L, _R = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"
IPV4 = rf"(?<![0-9.A-Za-z])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?!\.?[0-9A-Za-z])"
ISO = rf"{_L}(?:1[7-9]|20)[0-9][0-9]-[01][0-9]-[0-3][0-9]{_R}"
SLASHED = rf"{_L}[0-3]?[0-9]/[0-3]?[0-9]/(?:1[7-9]|20)[0-9][0-9]{_R}"
NATIONAL = rf"{_L}(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}{_R}"
PHONE = rf"(?<![A-Za-z0-9+])(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}{_R}"
INTERNATIONAL = rf"(?<![A-Za-z0-9+])\+[1-9][0-9]{{0,2}}(?:[ -]?(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}})){{2,5}}{_R}"
IBAN = rf"{_L}[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?){_R}"
CARD = rf"{_L}[0-9](?:[ -]?[0-9]){{12,18}}{_R}"
#: A run of groups of 20 digits or more up to where a date, national id or phone begins.
RUN = rf"{_L}[0-9](?:[0-9]|[ -](?!{ISO}|{NATIONAL}|{PHONE})[0-9]){{19,}}+{_R}"
ANY = "|".join((EMAIL, IBAN, IPV4, ISO, SLASHED, NATIONAL, PHONE, INTERNATIONAL, RUN, CARD))
#: Years of dates, and steps of a walk over dates: one in 30 or fewer of a form's days is none, so 24 steps are never used up.
_YEAR_0, _YEARS, _WALK = 1700, 400, 24


def _feistel(left: Column, right: Column, mod_l: Column, mod_r: Column, key: str, tweak: Column, inverse: bool = False) -> Column:
    """struct(l, r): a keyed permutation of the pairs (left < mod_l, right < mod_r), or its inverse."""
    sign = -1 if inverse else 1

    def mask(half: Column, i: Column, mod: Column) -> Column:
        text = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string")), 256)
        return F.pmod(F.conv(F.substring(text, 1, 15), 16, 10).cast("long"), mod) * sign

    def step(s: Column, i: Column) -> Column:
        even = F.struct(F.pmod(s["l"] + mask(s["r"], i, mod_l), mod_l).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), F.pmod(s["r"] + mask(s["l"], i, mod_r), mod_r).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    rounds = F.array(*[F.lit(i) for i in (range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS))])
    return F.aggregate(rounds, start, step)


def _power(base: int, n: Column) -> Column:
    return F.round(F.pow(F.lit(float(base)), n.cast("double"))).cast("long")


def _digits(s: Column, key: str, tweak: Column, inverse: bool = False) -> Column:
    """A string of 1 to 36 digits permuted among the strings of its length."""
    n = F.length(s)
    a = F.floor(n / 2).cast("int")
    head, tail = F.substring(s, F.lit(1), a), F.substring(s, a + 1, n - a)
    left = F.when(a == 0, F.lit("0")).otherwise(head).cast("long")
    both = _feistel(left, F.when(n == 0, F.lit("0")).otherwise(tail).cast("long"), _power(10, a), _power(10, n - a), key, F.concat(tweak, F.lit(":"), n.cast("string")), inverse)
    return bind(both, lambda x: F.concat(F.when(a == 0, "").otherwise(F.lpad(x["l"].cast("string"), a, "0")), F.when(n == 0, "").otherwise(F.lpad(x["r"].cast("string"), n - a, "0"))))


def permute_digits(s: Column, key: str, tweak: Column, inverse: bool = False) -> Column:
    """A string of digits permuted among the strings of its length, 36 digits at a time."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)), F.lit(36))
    return F.array_join(F.transform(starts, lambda i, j: bind(F.substring(s, i, F.lit(36)), lambda c: _digits(c, key, F.concat_ws(":", tweak, F.length(s).cast("string"), j.cast("string")), inverse))), "")


_ALPHABET, _BASE26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"


def permute_letters(s: Column, key: str, tweak: Column, inverse: bool = False) -> Column:
    """A string of small letters permuted among the strings of its length, 20 letters at a time."""

    def chunk(c: Column, i: Column) -> Column:
        n = F.length(c)
        a = F.floor(n / 2).cast("int")
        number = lambda x: F.conv(F.translate(x, _ALPHABET, _BASE26), 26, 10).cast("long")
        letters = lambda x, w: F.translate(F.lpad(F.lower(F.conv(x.cast("string"), 10, 26)), w, "0"), _BASE26, _ALPHABET)
        left = F.when(a == 0, F.lit(0).cast("long")).otherwise(number(F.substring(c, F.lit(1), a)))
        both = _feistel(left, number(F.substring(c, a + 1, n - a)), _power(26, a), _power(26, n - a), key, F.concat_ws(":", tweak, F.length(s).cast("string"), i.cast("string")), inverse)
        return bind(both, lambda x: F.concat(F.when(a == 0, "").otherwise(letters(x["l"], a)), letters(x["r"], n - a)))

    starts = F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)), F.lit(20))
    return F.when(F.length(s) == 0, "").otherwise(F.array_join(F.transform(F.transform(starts, lambda i: F.substring(s, i, F.lit(20))), chunk), ""))


def _refill(shape: Column, new: Column, chars: str) -> Column:
    """shape, with its characters of the class chars replaced by those of new, in order."""
    upto = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), f"[^{chars}]", ""))
    pick = lambda c, i: F.when(c.rlike(f"[{chars}]"), F.substring(new, upto(i), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(shape, ""), pick), "")


def _only(s: Column, chars: str) -> Column:
    return F.regexp_replace(s, f"[^{chars}]", "")


def luhn_digit(body: Column) -> Column:
    """Check digit for a string of digits."""
    n = F.length(body)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(body, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return total + twice - F.when(twice > 9, 9).otherwise(0)

    return F.pmod(F.lit(10) - F.pmod(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add), F.lit(10)), F.lit(10))


def mod_97(text: Column) -> Column:
    """Remainder by 97 of a string of digits and capitals, A being 10."""
    add = lambda r, c: F.pmod(F.when(F.ascii(c) >= 65, r * 100 + F.ascii(c) - 55).otherwise(r * 10 + F.ascii(c) - 48), F.lit(97))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _days_in(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def date_pseudonym(year: Column, month: Column, day: Column, month_digits: Column, day_digits: Column, above_12: Column, key: str, inverse: bool = False) -> Column:
    """struct(year, month, day): a date among those whose month and day have as many digits (and whose
    day is above 12 or not, if above_12); null if it is none of 1700 to 2099."""
    months = F.when(month_digits == 1, 9).otherwise(12)
    first = F.when(above_12, 13).otherwise(1)
    days = F.when(above_12, 19).when(day_digits == 1, 9).otherwise(31)
    tweak = F.concat_ws(":", F.lit("day"), month_digits.cast("string"), day_digits.cast("string"), first.cast("string"))
    date = lambda x: (F.lit(_YEAR_0) + F.call_function("div", x["l"], months), F.pmod(x["l"], months) + 1, x["r"] + first)
    once = lambda x: _feistel(x["l"], x["r"], (_YEARS * months).cast("long"), days.cast("long"), key, tweak, inverse)

    def valid(x: Column) -> Column:
        y, m, d = date(x)
        return d <= _days_in(y, m)

    start = F.struct(((year - _YEAR_0) * months + month - 1).cast("long").alias("l"), (day - first).cast("long").alias("r"))
    walk = bind(start, lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), once(s), lambda x, _: F.when(valid(x), x).otherwise(once(x))))
    fits = year.between(_YEAR_0, _YEAR_0 + _YEARS - 1) & month.between(1, months) & day.between(first, first + days - 1) & (day <= _days_in(year, month))
    return F.when(fits, bind(walk, lambda x: F.struct(*[c.alias(n) for c, n in zip(date(x), ("year", "month", "day"), strict=True)])))


def _slashed(m: Column, key: str, inverse: bool) -> Column:
    parts = F.split(m, "/")
    a, b, y = (F.get(parts, F.lit(i)) for i in range(3))
    number = lambda c: c.try_cast("int")
    pad = lambda n, like: F.lpad(n.cast("string"), F.length(like), "0")
    month_first = number(b) > 12
    month, day = F.when(month_first, a).otherwise(b), F.when(month_first, b).otherwise(a)
    new = date_pseudonym(number(y), number(month), number(day), F.length(month), F.length(day), month_first, key, inverse)
    return bind(new, lambda d: F.when(d.isNotNull(), F.concat(F.when(month_first, pad(d["month"], a)).otherwise(pad(d["day"], a)), F.lit("/"), F.when(month_first, pad(d["day"], b)).otherwise(pad(d["month"], b)), F.lit("/"), d["year"].cast("string"))))


def _iso(m: Column, key: str, inverse: bool) -> Column:
    part = lambda at, n: F.substring(m, at, n).try_cast("int")
    new = date_pseudonym(part(1, 4), part(6, 2), part(9, 2), F.lit(2), F.lit(2), F.lit(False), key, inverse)
    return bind(new, lambda d: F.when(d.isNotNull(), F.concat(d["year"].cast("string"), F.lit("-"), F.lpad(d["month"].cast("string"), 2, "0"), F.lit("-"), F.lpad(d["day"].cast("string"), 2, "0"))))


def _national(m: Column, key: str, inverse: bool) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999: the plan has no other holes."""
    area, group, serial = F.substring(m, 1, 3).try_cast("long"), F.substring(m, 5, 2).try_cast("long"), F.substring(m, 8, 4).try_cast("long")
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    both = _feistel(place * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, F.lit("national"), inverse)

    def put(x: Column) -> Column:
        place = F.call_function("div", x["l"], F.lit(99)) + 1
        area = place + F.when(place >= 666, 1).otherwise(0)
        pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
        return F.concat(pad(area, 3), F.lit("-"), pad(F.pmod(x["l"], F.lit(99)) + 1, 2), F.lit("-"), pad(x["r"] + 1, 4))

    return bind(both, put)


def _iban(m: Column, key: str, inverse: bool) -> Column:
    plain = F.regexp_replace(m, " ", "")
    check = lambda country, rest: F.lpad((F.lit(98) - mod_97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0")

    def put(p: Column) -> Column:
        country, rest = F.substring(p, 1, 2), F.substring(p, F.lit(5), F.length(p))
        digits = permute_digits(_only(rest, "0-9"), key, F.lit("iban"), inverse)
        letters = F.upper(permute_letters(F.lower(_only(rest, "A-Z")), key, F.lit("iban"), inverse))
        new = bind(_refill(rest, digits, "0-9"), lambda d: bind(letters, lambda w: _refill(d, w, "A-Z")))
        whole = bind(new, lambda r: F.concat(country, check(country, r), r))
        return F.when(check(country, rest) == F.substring(p, 3, 2), bind(whole, lambda w: _refill(m, w, "A-Z0-9")))

    return bind(plain, put)


def _international(m: Column, digits: Column, key: str, inverse: bool) -> Column:
    """The digits after the country code, which ends at a separator or else is taken as two digits."""
    code = F.when(m.rlike(r"^\+[0-9]{1,3}[ (-]"), F.length(F.regexp_extract(m, r"^\+([0-9]{1,3})", 1))).otherwise(2)
    new = F.concat(F.substring(digits, F.lit(1), code), permute_digits(F.substring(digits, code + 1, F.lit(15)), key, F.lit("phone"), inverse))
    return F.when(F.length(digits).between(8, 15), bind(new, lambda d: _refill(m, d, "0-9")))


#: How cards are written, the likeliest first: 4-4-4-4, then one run, 4-6-5, 4-6-4 and 4-4-4-4-3.
_CARD_FORMS = (r"^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}\z", r"^(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{3})\z")


def _luhn(digits: Column) -> Column:
    return luhn_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)).cast("string") == F.substring(digits, F.length(digits), F.lit(1))


def cards_inside(m: Column, key: str, inverse: bool = False) -> Column:
    """m with the cards inside a run of digit groups replaced, null if there are none.

    Tried are runs of whole groups, 13 to 19 digits that pass Luhn: those of a likelier written form first, then
    others of groups of three digits or more, from the left, the longest first; none overlaps one taken before.
    The work grows with the number of groups times 19.
    """

    def found(groups: Column) -> Column:
        def rate(s: Column, i: Column, n: Column) -> Column:
            d = _only(s, "0-9")
            form = F.when(s.rlike(_CARD_FORMS[0]), 0).when(s.rlike(_CARD_FORMS[1]), 1).when(~s.rlike(r"(?<![0-9])[0-9]{1,2}(?![0-9])"), 2)
            good = F.when(F.length(d).between(13, 19), F.when(form.isNotNull(), F.when(_luhn(d), form)))
            return F.struct(good.alias("form"), i.alias("at"), (-n).alias("size"), s.alias("s"))

        at = lambda i, n: F.regexp_replace(F.array_join(F.slice(groups, i + 1, n), ""), "[ -]$", "")
        counts = lambda i: F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - i))
        rated = F.flatten(F.transform(groups, lambda _, i: F.filter(F.transform(counts(i), lambda n: bind(at(i, n), lambda s: rate(s, i, n))), lambda x: x["form"].isNotNull())))
        end = lambda x: x["at"] - x["size"]

        def free(taken: Column, x: Column) -> Column:
            return ~F.exists(taken, lambda y: (y["at"] < end(x)) & (end(y) > x["at"]))

        def take(taken: Column, x: Column) -> Column:
            return F.when(free(taken, x), F.concat(taken, F.array(x))).otherwise(taken)

        none = F.filter(rated, lambda x: F.lit(False))
        return F.array_sort(F.transform(F.aggregate(F.array_sort(rated), none, take), lambda x: F.struct(x["at"].alias("at"), end(x).alias("end"), x["s"].alias("s"))))

    def replaced(s: Column) -> Column:
        d = _only(s, "0-9")
        return bind(_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, F.lit("card"), inverse), lambda b: _refill(s, F.concat(b, luhn_digit(b).cast("string")), "0-9"))

    def put(groups: Column, taken: Column) -> Column:
        between = lambda i, j: F.array_join(F.slice(groups, i + 1, F.greatest(j - i, F.lit(0))), "")
        gap = lambda x: F.regexp_extract(F.get(groups, x["end"] - 1), "[ -]?$", 0)
        parts = F.transform(taken, lambda x, i: F.concat(between(F.coalesce(F.get(taken, i - 1)["end"], F.lit(0)), x["at"]), replaced(x["s"]), gap(x)))
        return F.when(F.size(taken) > 0, F.concat(F.array_join(parts, ""), between(F.element_at(taken, -1)["end"], F.size(groups))))

    return bind(F.regexp_extract_all(m, F.lit("[0-9]+[ -]?"), 0), lambda groups: bind(found(groups), lambda taken: put(groups, taken)))


def pseudonym(m: Column, key: str, inverse: bool = False) -> Column:
    """Pseudonym of a candidate (inverse: the value of a pseudonym), null if it isn't valid."""
    digits = _only(m, "0-9")
    full = lambda p: rf"^(?:{p})\z"
    # lambdas are evaluated for candidates of their kind only
    local = F.substring_index(m, "@", 1)
    low = F.lower(local)
    with_digits = _refill(local, permute_digits(_only(local, "0-9"), key, F.lit("mail"), inverse), "0-9")
    letters = permute_letters(_only(low, "a-z"), key, F.lit("mail"), inverse)
    mail = bind(with_digits, lambda d: bind(letters, lambda w: F.array_join(F.transform(F.split(_refill(F.lower(d), w, "a-z"), ""), lambda c, i: F.when(F.substring(d, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")))
    mail = F.concat(mail, F.substring(m, F.length(local) + 1, F.length(m)))

    octets = F.transform(F.split(m, r"\."), lambda x: x.try_cast("int"))
    part = lambda i: F.coalesce(F.get(octets, F.lit(i)), F.lit(0))
    ip = _feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, F.lit("ip"), inverse)
    ip = bind(ip, lambda x: F.concat_ws(".", F.floor(x["l"] / 256).cast("string"), (x["l"] % 256).cast("string"), F.floor(x["r"] / 256).cast("string"), (x["r"] % 256).cast("string")))
    # only octets without leading zeros: the others would be lost in the number
    plain = F.forall(F.split(m, r"\."), lambda x: ~x.rlike("^0[0-9]"))

    code = F.greatest(F.length(digits) - 10, F.lit(0))
    phone = _refill(m, F.concat(F.substring(digits, F.lit(1), code), _digits(F.substring(digits, code + 1, F.lit(10)), key, F.lit("phone"), inverse)), "0-9")
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    card = bind(_digits(body, key, F.lit("card"), inverse), lambda b: _refill(m, F.concat(b, luhn_digit(b).cast("string")), "0-9"))

    return (
        F.when(m.contains("@"), mail)
        .when(m.rlike(full(IBAN)), _iban(m, key, inverse))
        .when(m.rlike(full(IPV4)), F.when(F.forall(octets, lambda x: x < 256) & plain, ip))
        .when(m.rlike(full(ISO)), _iso(m, key, inverse))
        .when(m.rlike(full(SLASHED)), _slashed(m, key, inverse))
        .when(m.rlike(full(NATIONAL)), _national(m, key, inverse))
        .when(m.rlike(full(PHONE)), phone)
        .when(m.rlike(full(INTERNATIONAL)), _international(m, digits, key, inverse))
        .when(m.rlike(full(CARD)) & _luhn(digits), card)
        .when(m.rlike(full(CARD)) | m.rlike(full(RUN)), cards_inside(m, key, inverse))
    )


def pseudonymize(docs: DataFrame, key: str, text: str = "text", count: str = "n_replaced", inverse: bool = False) -> DataFrame:
    """docs with the valid values in `text` replaced, and their number in the column `count`."""
    found, new = unused(docs, "found", "new")
    work = docs.withColumn(found, F.when(F.col(text).rlike(ANY), F.regexp_extract_all(F.col(text), F.lit(ANY), 0)))
    work = work.withColumn(new, F.when(F.col(found).isNotNull(), F.transform(found, lambda m: pseudonym(m, key, inverse))))
    whole = F.zip_with(F.split(F.col(text), ANY, -1), F.arrays_zip(F.col(found).alias("a"), F.col(new).alias("b")), lambda s, m: F.concat(s, F.coalesce(m["b"], m["a"], F.lit(""))))
    out = F.when(F.col(found).isNull(), F.col(text)).otherwise(F.array_join(whole, ""))
    n = F.when(F.col(found).isNull(), 0).otherwise(F.size(F.array_compact(new))).cast("long")
    return work.withColumns({text: out, count: n}).drop(found, new)


def reidentify(docs: DataFrame, key: str, text: str = "text", count: str = "n_restored") -> DataFrame:
    """docs of pseudonymize() with the first values again; key is the same."""
    return pseudonymize(docs, key, text, count, inverse=True)
