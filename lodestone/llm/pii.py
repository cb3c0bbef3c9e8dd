"""Personal data pseudonyms: keyed Feistel permutations within each value's own format.

Found values are e-mail addresses, IPv4 addresses with octets up to 255, payment-card numbers (13 to 19 digits, Luhn),
IBANs (mod 97), US social-security numbers in assignable ranges, telephone numbers in international or North American
form, and dates from 1900 to mid-2099.  Numbers that fail validation are left as they are.  A value's pseudonym depends
on the key, its kind and its characters only, so equal values stay equal in all documents and different ones different:
each permutation is a bijection of its format.  Card numbers, IBANs and dates stay valid.

Everything is DataFrame functions: texts are cut at matches by split() and regexp_extract_all(), which scan alike, and
joined again.  Rounds are an aggregate() over round numbers, keyed by SHA-256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import columns

#: Possessive groups and single classes alone, which Java matches without recursion.  A label and its stop are taken if a label follows.
EMAIL = r"(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.(?=[A-Za-z]{2}|[A-Za-z0-9-]+\.[A-Za-z0-9]))++[A-Za-z]{2,}"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DAY_DATE = r"(?<![0-9./])[0-9]{1,2}([./])[0-9]{1,2}[./][0-9]{4}(?![0-9/]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])(?<![0-9]-)(?:[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])"
PHONE = r"(?<![0-9+(])(?:(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4})(?![0-9])"
#: One scan for all kinds; at a place the first that fits takes it.  The look-ahead spares most places the alternatives.
ANY = f"(?:{EMAIL})|(?=[0-9A-Z+(])(?:" + "|".join(f"(?:{p})" for p in (ISO_DATE, SSN, IP, DAY_DATE, IBAN, CARD, PHONE)).replace("([./])", "[./]") + ")"
#: Cheap to test, and true of every text with a match.
HINT = "@|[0-9]{2}|[0-9][.][0-9]"
ROUNDS = 8
#: The dates' domain: 270 * 270 days from 1900-01-01 on.
DATE_SIDE = 270


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: The column that holds the key; it comes from a one-row table, so that no plan shows its value.
KEY = "secret"


def _numbers(key: str, tweak: str, x: str, a: int, b: int) -> str:
    """A permutation of 0 .. a * b - 1: x as (x div b, x mod b), each half in turn moved by a keyed hash of the other."""
    moved = f"cast(conv(substr(sha2(concat({key}, '|', {tweak}, '|', r, '|', {{}}), 256), 1, 14), 16, 10) as bigint)"
    step = f"if(r % 2 = 1, struct((h.l + {moved.format('h.r')}) % {a}L as l, h.r as r), struct(h.l as l, (h.r + {moved.format('h.l')}) % {b}L as r))"
    return f"aggregate(sequence(1, {ROUNDS}), struct(cast(({x}) div {b} as bigint) as l, cast(({x}) % {b} as bigint) as r), (h, r) -> {step}, h -> h.l * {b}L + h.r)"


def _letters(key: str, tweak: str, s: str) -> str:
    """A permutation of the strings of one pattern of digits, lower-case and upper-case letters; others stay in place.

    Each round moves every character of one half within its class by a keyed hash of the other half.
    """
    stream = f"sha2(concat({key}, '|', {tweak}, '|', r, '|', length({{other}}), '|', {{other}}, '|', i div 20), 256)"
    by = f"cast(conv(substr({stream}, 3 * (i % 20) + 1, 3), 16, 10) as int)"
    one = "substr({half}, i + 1, 1)"
    shift = f"case when {one} between '0' and '9' then substr('0123456789', (ascii({one}) - 48 + {by}) % 10 + 1, 1) when {one} between 'a' and 'z' then chr((ascii({one}) - 97 + {by}) % 26 + 97) when {one} between 'A' and 'Z' then chr((ascii({one}) - 65 + {by}) % 26 + 65) else {one} end"
    half = f"if(length({{half}}) = 0, '', array_join(transform(sequence(0, length({{half}}) - 1), i -> {shift}), ''))"
    step = f"if(r % 2 = 1, struct({half.format(half='h.a', other='h.b')} as a, h.b as b), struct(h.a as a, {half.format(half='h.b', other='h.a')} as b))"
    return f"aggregate(sequence(1, {ROUNDS}), struct(substr({s}, 1, length({s}) div 2) as a, substr({s}, length({s}) div 2 + 1) as b), (h, r) -> {step}, h -> concat(h.a, h.b))"


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def _luhn(d: str, shift: int) -> str:
    """The Luhn sum of digits d, the last of which counts once (shift 0) or twice (shift 1)."""
    x = f"cast(substr({d}, length({d}) - i, 1) as int)"
    return f"aggregate(transform(sequence(0, length({d}) - 1), i -> if((i + {shift}) % 2 = 0, {x}, {x} * 2 - if({x} > 4, 9, 0))), 0, (t, v) -> t + v)"


def _mod97(s: str) -> str:
    """An IBAN's remainder, its first four characters moved to the end and letters as 10 to 35."""
    c = f"substr(concat(substr({s}, 5), substr({s}, 1, 4)), i + 1, 1)"
    v = f"if({c} between '0' and '9', cast(ascii({c}) - 48 as int), ascii({c}) - 55)"
    return f"aggregate(sequence(0, length({s}) - 1), 0, (t, i) -> (t * if({c} between '0' and '9', 10, 100) + {v}) % 97)"


def _refill(s: str, d: str, kept: str) -> str:
    """The characters of s, those of class `kept` replaced in order by those of d."""
    n = f"length(regexp_replace(substr({s}, 1, i + 1), '[^{kept}]', ''))"
    return f"array_join(transform(sequence(0, length({s}) - 1), i -> if(substr({s}, i + 1, 1) rlike '[{kept}]', substr({d}, {n}, 1), substr({s}, i + 1, 1))), '')"


def _date(key: str, y: str, m: str, d: str) -> tuple[str, str]:
    """(is a date of the domain, its pseudonym) for expressions of year, month and day."""
    last = DATE_SIDE * DATE_SIDE
    real = f"case when {y} between 1900 and 2099 and {m} between 1 and 12 and {d} between 1 and 31 then {d} <= day(last_day(make_date({y}, {m}, 1))) and datediff(make_date({y}, {m}, least({d}, 28)), date'1900-01-01') < {last - 3} else false end"
    return real, f"date_add(date'1900-01-01', cast({_numbers(key, _sql('date'), f'datediff(make_date({y}, {m}, {d}), date' + chr(39) + '1900-01-01' + chr(39) + ')', DATE_SIDE, DATE_SIDE)} as int))"


def _kinds(key: str) -> list[tuple[str, str, str]]:
    """(kind, condition on the match m, pseudonym of m) in the order in which they are tried."""
    full = lambda p: f"m rlike {_sql('^(?:' + p + ')$')}"
    at, marks = "instr(m, '@')", "regexp_extract(m, '^[._%+-]*', 0)"
    octet = lambda i: f"cast(split(m, '[.]')[{i}] as bigint)"
    ip = _numbers(key, "'ip'", f"(({octet(0)} * 256 + {octet(1)}) * 256 + {octet(2)}) * 256 + {octet(3)}", 65536, 65536)
    part = lambda a, n: f"cast(substr(m, {a}, {n}) as int)"
    iso, iso_new = _date(key, part(1, 4), part(6, 2), part(9, 2))
    bit = lambda i: f"cast(split(m, '[./]')[{i}] as int)"
    american = f"(m rlike '/' and {bit(0)} <= 12)"
    month, day = f"if({american}, {bit(0)}, {bit(1)})", f"if({american}, {bit(1)}, {bit(0)})"
    dmy, dmy_new = _date(key, bit(2), month, day)
    form = f"if(m rlike '^[0-9]{{2}}.[0-9]{{2}}.', if({american}, 'MM/dd/yyyy', if(m rlike '/', 'dd/MM/yyyy', 'dd.MM.yyyy')), if({american}, 'M/d/yyyy', if(m rlike '/', 'd/M/yyyy', 'd.M.yyyy')))"
    # Areas 001 to 899 but for 666, groups 01 to 99, serials 0001 to 9999.
    area = part(1, 3)
    ssn = _numbers(key, "'ssn'", f"(({area} - if({area} > 666, 2, 1)) * 99L + {part(5, 2)} - 1) * 9999L + {part(8, 4)} - 1", 898 * 99, 9999)
    ssn_text = f"transform(array({ssn}), v -> concat(lpad(cast(v div 989901 + if(v div 989901 >= 665, 2, 1) as string), 3, '0'), '-', lpad(cast(v div 9999 % 99 + 1 as string), 2, '0'), '-', lpad(cast(v % 9999 + 1 as string), 4, '0')))[0]"
    d = _digits("m")
    body = f"substr({d}, 1, length({d}) - 1)"
    card = f"transform(transform(array({body}), b -> {_letters(key, _sql('card'), 'b')}), b -> concat(b, cast((10 - {_luhn('b', 1)} % 10) % 10 as string)))[0]"
    bare = "replace(m, ' ', '')"
    iban = f"transform(transform(array({bare}), b -> concat(substr(b, 1, 2), '00', {_letters(key, 'concat(' + _sql('iban') + ', substr(b, 1, 2))', 'substr(b, 5)')})), b -> concat(substr(b, 1, 2), lpad(cast(98 - {_mod97('b')} as string), 2, '0'), substr(b, 5)))[0]"
    phone_keep = f"if(length({d}) > 10, length({d}) - 10, if(m like '+%', 1, 0))"
    phone = f"concat(substr({d}, 1, {phone_keep}), {_letters(key, _sql('phone'), f'substr({d}, {phone_keep} + 1)')})"
    return [
        ("email", f"m like '%@%' and {full(EMAIL)}", f"concat({marks}, {_letters(key, _sql('email'), f'substr(m, length({marks}) + 1, {at} - 1 - length({marks}))')}, substr(m, {at}))"),
        ("date", f"{full(ISO_DATE)} and {iso}", f"date_format({iso_new}, 'yyyy-MM-dd')"),
        ("ssn", f"{full(SSN)} and {area} between 1 and 899 and {area} <> 666 and {part(5, 2)} > 0 and {part(8, 4)} > 0", ssn_text),
        ("ip", f"{full(IP)} and {' and '.join(octet(i) + ' < 256' for i in range(4))}", f"transform(array({ip}), v -> concat_ws('.', cast(v div 16777216 as string), cast(v div 65536 % 256 as string), cast(v div 256 % 256 as string), cast(v % 256 as string)))[0]"),
        ("date", f"{full(DAY_DATE)} and {dmy}", f"date_format({dmy_new}, {form})"),
        ("iban", f"{full(IBAN)} and {_mod97(bare)} = 1", _refill("m", iban, "A-Z0-9")),
        ("card", f"{full(CARD)} and length({d}) between 13 and 19 and {_luhn(d, 0)} % 10 = 0 and {d} not rlike '^0+$'", _refill("m", card, "0-9")),
        ("phone", f"{full(PHONE)} and length({d}) between 8 and 15", _refill("m", phone, "0-9")),
    ]


NAMES = ("email", "date", "ssn", "ip", "iban", "card", "phone")


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Every row of `docs` (text, any others) with the found values in text replaced, and n_email, n_date, n_ssn, n_ip,
    n_iban, n_card and n_phone after the columns, the numbers of values replaced.

    A null text stays null, with zeros; columns of these names are replaced, all others stay, whatever their names.  Rows
    are independent: no shuffle.  `key` is kept in a one-row table that is broadcast, out of the plan's text.
    """
    docs = docs.drop(*(f"n_{k}" for k in NAMES))
    secret = docs.sparkSession.sql("SELECT * FROM VALUES (:key) AS t(secret)", args={"key": key})
    what = "case " + " ".join(f"when {test} then '{kind}'" for kind, test, _ in _kinds(KEY)) + " else '' end"
    new = "case " + " ".join(f"when k = '{kind}' and {test} then {value}" if kind == "date" else f"when k = '{kind}' then {value}" for kind, test, value in _kinds(KEY)) + " else m end"
    some = docs.select(F.struct(*columns(docs)).alias("row"), F.col("text").cast("string").alias("whole")).crossJoin(F.broadcast(secret))
    some = some.withColumn("found", F.when(F.col("whole").rlike(HINT) & F.col("whole").rlike(ANY), F.regexp_extract_all("whole", F.lit(ANY), F.lit(0))))
    some = some.withColumn("kinds", F.expr(f"transform(found, m -> {what})"))
    some = some.withColumn("put", F.expr(f"zip_with(found, kinds, (m, k) -> if(k = '', m, {new}))"))
    joined = F.expr(f"if(found is null, whole, array_join(zip_with(split(whole, {_sql(ANY)}, -1), put, (g, v) -> concat(g, coalesce(v, ''))), ''))")
    counts = [F.expr(f"greatest(cast(coalesce(size(filter(kinds, k -> k = '{k}')), 0) as bigint), 0L)").alias(f"n_{k}") for k in NAMES]
    own = [joined.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return some.select(*own, *counts)
