"""Format-preserving pseudonyms for validated numbers and dates, by DataFrame functions only.

A value's domain is a product A x B, split into a pair (a, b), and ten keyed rounds
add hashes of one half to the other, modulo A or B in turn. That is a permutation
of exactly the domain (no cycle walking), so formats and check digits stay valid,
equal values stay equal in all documents, and the key undoes it.

    kind   validated by                            domain
    card   13-19 digits, Luhn                      all but the check digit, which is set anew
    phone  10 digits, optional +1                  10**5 x 10**5
    ssn    area, group and serial rules            (898 * 99) x 9999
    ip     four octets                             2**16 x 2**16
    date   a calendar day of 1800 to 2199          189 x 773 = the 146,097 days of 400 years
    email  shape of the address                    the local part's letters and digits, each within its class

Separators stay where they are; values of one kind with other separators are the
same value. What fails its check is left alone. Edge cases: null texts stay
null, empty and long texts are handled whole, an empty table gives an empty
result, other columns pass through. No pattern repeats a group without a bound, so
texts of any length need a bounded stack. An IPv4 octet with a leading zero is no
octet; a phone number may become one of an area that is not in use; a domain has
126 labels at most. A card in groups of four is taken before longer runs of digits,
so numbers beside it do not hide it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
_DAY_ZERO = "1800-01-01"
_EDGE = r"(?<![\p{L}\p{N}.+-])", r"(?![\p{L}\p{N}]|[.-][0-9])"
#: Candidates of all kinds, in order of preference.
_SHAPES = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,}",
    "date": r"[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "card": r"[0-9]{4}(?:[ -][0-9]{4}){3}|(?![0-9]{1,3}(?:[ -][0-9]{4}){4}(?![0-9]))[0-9](?:[ -]?[0-9]){12,18}",
}
CANDIDATE = _EDGE[0] + "(?:" + "|".join(_SHAPES.values()) + ")" + _EDGE[1]


def _number(digits: Column) -> Column:
    return digits.cast("long")


def _padded(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width if isinstance(width, Column) else F.lit(width), F.lit("0"))


def feistel(a: Column, b: Column, big_a: Column, big_b: Column, key: str, tweak: Column, inverse: bool = False) -> Column:
    """struct(a, b) after all rounds; the rounds run as a fold, so no expression is repeated."""

    def keyed(i: Column, half: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string")).cast("binary"), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        x, y = s["a"], s["b"]
        move = lambda v, h, m: (v + (m - h % m if inverse else h % m)) % m
        odd = i % 2 == 1
        return F.struct(F.when(odd, move(x, keyed(i, y), big_a)).otherwise(x).alias("a"), F.when(odd, y).otherwise(move(y, keyed(i, x), big_b)).alias("b"))

    order = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(order, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum, the rightmost digit counted once."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _refilled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by the given ones in order."""
    step = lambda i: F.when(
        F.substring(shape, i, F.lit(1)).rlike("[0-9]"),
        F.substring(digits, F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), "[^0-9]", "")), F.lit(1)),
    ).otherwise(F.substring(shape, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), step), "")


def _card(m: Column, key: str, inverse: bool) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits) - 1
    u = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    pair = feistel(_number(F.substring(digits, F.lit(1), u)), _number(F.substring(digits, u + 1, n - u)), power(u), power(n - u), key, F.concat(F.lit("card"), n.cast("string")), inverse)
    payload = F.transform(F.array(pair), lambda p: F.concat(_padded(p["a"], u), _padded(p["b"], n - u)))
    whole = F.transform(payload, lambda p: F.concat(p, ((10 - _luhn_sum(F.concat(p, F.lit("0"))) % 10) % 10).cast("string")))
    return F.when(_luhn_sum(digits) % 10 == 0, _refilled(m, whole[0]))


def _phone(m: Column, key: str, inverse: bool) -> Column:
    prefix = F.regexp_extract(m, r"^(\+1[ .-]?)?", 1)
    local = F.substring(m, F.length(prefix) + 1, F.length(m))
    digits = F.regexp_replace(local, "[^0-9]", "")
    pair = feistel(_number(F.substring(digits, 1, 5)), _number(F.substring(digits, 6, 5)), F.lit(100_000), F.lit(100_000), key, F.lit("phone"), inverse)
    new = F.transform(F.array(pair), lambda p: F.concat(_padded(p["a"], 5), _padded(p["b"], 5)))
    return F.concat(prefix, _refilled(local, new[0]))


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999."""
    area, group, serial = (F.split(m, "-")[i].cast("int") for i in range(3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    a = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1
    pair = feistel(a, serial - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("ssn"), inverse)

    def shown(p: Column) -> Column:
        x = F.floor(p["a"] / 99)
        return F.concat_ws("-", _padded(x + 1 + F.when(x >= 665, 1).otherwise(0), 3), _padded(p["a"] % 99 + 1, 2), _padded(p["b"] + 1, 4))

    return F.when(valid, F.transform(F.array(pair), shown)[0])


def _ip(m: Column, key: str, inverse: bool) -> Column:
    octets = [F.split(m, r"\.")[i].cast("int") for i in range(4)]
    valid = (F.greatest(*octets) < 256) & ~m.rlike(r"(?:^|\.)0[0-9]")
    pair = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(1 << 16), F.lit(1 << 16), key, F.lit("ip"), inverse)
    shown = lambda p: F.concat_ws(".", *(x.cast("string") for h in ("a", "b") for x in (F.shiftright(p[h], 8), p[h] % 256)))
    return F.when(valid, F.transform(F.array(pair), shown)[0])


def _date(m: Column, key: str, inverse: bool) -> Column:
    dotted = m.contains(".")
    iso = F.when(dotted, F.concat(F.substring(m, 7, 4), F.lit("-"), F.substring(m, 4, 2), F.lit("-"), F.substring(m, 1, 2))).otherwise(F.translate(m, "/", "-"))
    day = F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit(_DAY_ZERO).cast("date"))
    valid = (day >= 0) & (day < 189 * 773)
    pair = feistel(F.floor(day / 773), day % 773, F.lit(189), F.lit(773), key, F.lit("date"), inverse)

    def shown(p: Column) -> Column:
        d = F.date_add(F.lit(_DAY_ZERO).cast("date"), (p["a"] * 773 + p["b"]).cast("int"))
        slashed = F.when(m.contains("/"), F.date_format(d, "yyyy/MM/dd")).otherwise(F.date_format(d, "yyyy-MM-dd"))
        return F.when(dotted, F.date_format(d, "dd.MM.yyyy")).otherwise(slashed)

    return F.when(valid, F.transform(F.array(pair), shown)[0])


def _shifted(half: Column, digest: Column, inverse: bool) -> Column:
    """Each letter and digit moved within its class by the digest's byte at its place."""

    def moved(i: Column) -> Column:
        c = F.ascii(F.substring(half, i, F.lit(1)))
        by = F.conv(F.substring(digest, (i - 1) % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = F
        for first, size in ((97, 26), (65, 26), (48, 10)):
            step = size - by % size if inverse else by % size
            out = out.when(c.between(first, first + size - 1), F.char((c - first + step) % size + first))
        return out.otherwise(F.substring(half, i, F.lit(1)))

    return F.when(F.length(half) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), moved), "")).otherwise(F.lit(""))


def _email(m: Column, key: str, inverse: bool) -> Column:
    """The same kind of network over the halves of the local part, letter by letter; the domain stays."""
    local = F.substring_index(m, "@", 1)
    n = F.length(local)
    u = F.floor(n / 2).cast("int")

    def turn(s: Column, i: Column) -> Column:
        x, y = s["a"], s["b"]
        digest = lambda half: F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), n.cast("string"), i.cast("string"), half).cast("binary"), 256)
        odd = i % 2 == 1
        return F.struct(F.when(odd, _shifted(x, digest(y), inverse)).otherwise(x).alias("a"), F.when(odd, y).otherwise(_shifted(y, digest(x), inverse)).alias("b"))

    order = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    pair = F.aggregate(order, F.struct(F.substring(local, F.lit(1), u).alias("a"), F.substring(local, u + 1, n - u).alias("b")), turn)
    joined = F.transform(F.array(pair), lambda p: F.concat(p["a"], p["b"]))[0]
    return F.concat(joined, F.lit("@"), F.substring_index(m, "@", -1))


_KINDS = {"email": _email, "date": _date, "ssn": _ssn, "phone": _phone, "ip": _ip, "card": _card}


def pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of a candidate, or null if it fails its kind's check."""
    out = F
    for kind, shape in _SHAPES.items():
        out = out.when(value.rlike(f"^(?:{shape})$"), _KINDS[kind](value, key, inverse))
    return out


def pseudonymise(docs: DataFrame, key: str, inverse: bool = False, count: str = "n_replaced") -> DataFrame:
    """docs with text rewritten and a count of the values replaced (a column of that name goes); inverse restores the values a key has replaced."""
    columns = [c for c in docs.columns if c != count]
    df = docs.withColumn("text", F.col("text").cast("string")).withColumn("__found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    df = df.withColumn("__new", F.transform("__found", lambda m: pseudonym(m, key, inverse)))
    between = F.split("text", CANDIDATE, -1)
    swapped = F.zip_with("__new", "__found", lambda n, m: F.coalesce(n, m))
    text = F.when(F.size("__found") > 0, F.array_join(F.zip_with(between, swapped, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")).otherwise(F.col("text"))
    n = F.coalesce(F.size(F.filter("__new", lambda x: x.isNotNull())), F.lit(0)).cast("long")
    return df.withColumns({"__text": text, "__n": n}).select(*(F.col("__text").alias("text") if c == "text" else c for c in columns), F.col("__n").alias(count))
