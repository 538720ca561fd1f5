"""Format-preserving Feistel pseudonyms for personal data, in DataFrame operations only.

Numbers and dates that pass their validity rules are permuted, under a key, among the valid
values of their own format: a card number stays a card number with a right check digit and
its first digit and separators, a social security number avoids the unassigned areas, a date
stays a date between 1900 and 2099. Equal values get equal pseudonyms in every document, and
different ones different pseudonyms, because each format is a bijection. With a pair (a, b) of
Z_ma x Z_mb as state, a round replaces (a, b) by (b, a + F(b) mod ma); any product of two moduli
is thus permuted without walking cycles. Mail names go through the same network letter by letter.

Kinds, first to last where matches could overlap: ``email``, ``ip`` (four octets), ``ssn``
(ddd-dd-dddd of assigned ranges), ``phone`` (ten-digit North American numbers with separators or
+1, area 200 and up, or any area written as +1 (ddd)), ``date`` (yyyy-mm-dd or yyyy/mm/dd, dd.mm.yyyy, mm/dd/yyyy) and ``card`` (13 to 19 digits with
single spaces or hyphens, first 2 to 6, Luhn). Only valid values consume text: the patterns hold the
rules, and a run of digit groups, which ends where another kind begins, is searched for every
span of whole groups that passes Luhn. Where such spans overlap, fewer groups win, then the first.

A round's function is a digest of the value under two keys derived from the given one, nested as
HMAC nests them. Whoever holds the key can invert the pseudonyms, so ``pseudonymise`` has none of
its own; the query takes it from the setting ``KEY_CONF``, or a published one for trials.

Edge cases: null text stays null and counts nothing; empty text stays empty; rows are rewritten
one by one, whole whatever their length, so repeated rows repeat; an empty table gives an empty result; other columns are
carried, unless named like a count, which replaces them.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.runtime import sheltered

ROUNDS = 10
#: The setting that names the query's key, and the published key it takes without one.
KEY_CONF, TRIAL_KEY = "spark.tidemark.pseudonym.key", "tidemark"

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP = rf"(?<![A-Za-z0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![A-Za-z0-9]|\.[0-9])"
SSN = r"(?<![A-Za-z0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![A-Za-z0-9-])"
PHONE = r"(?<![A-Za-z0-9])(?:\+1[\x20.-]?\([0-9]{3}\)\x20?|\([2-9][0-9]{2}\)\x20?|\+1[\x20.-]?[2-9][0-9]{2}[\x20.-]?|[2-9][0-9]{2}[\x20.-])[2-9][0-9]{2}[\x20.-]?[0-9]{4}(?![A-Za-z0-9])"


def _dates(form: str) -> str:
    """Pattern of the days from 1900 to 2099 written as ``form``, of %Y, %m and %d."""
    year, leap = "(?:19|20)[0-9]{2}", "(?:19(?:0[48]|[2468][048]|[13579][26])|20(?:[02468][048]|[13579][26]))"
    days = ((year, "(?:0[13578]|1[02])", "(?:0[1-9]|[12][0-9]|3[01])"), (year, "(?:0[469]|11)", "(?:0[1-9]|[12][0-9]|30)"), (year, "02", "(?:0[1-9]|1[0-9]|2[0-8])"), (leap, "02", "29"))
    return "|".join(form.replace("%Y", y).replace("%m", m).replace("%d", d) for y, m, d in days)


DATE = r"(?<![A-Za-z0-9./-])(?:" + "|".join(map(_dates, ("%Y-%m-%d", "%Y/%m/%d", r"%d\.%m\.%Y", "%m/%d/%Y"))) + r")(?![A-Za-z0-9/-])"
SHAPED = "|".join((EMAIL, IP, SSN, PHONE, DATE))
#: Thirteen digits or more in groups; cards are spans of these groups. Possessive, so that a run of any length is matched in a loop.
RUN = rf"(?<![A-Za-z0-9])(?=[0-9](?:[\x20-]?[0-9]){{12}})[0-9]++(?![A-Za-z])(?:[\x20-](?!{SHAPED})[0-9]++(?![A-Za-z]))*+"
KINDS = ("email", "card", "ip", "ssn", "phone", "date")
ANY = f"{SHAPED}|{RUN}"

#: Days from 1900-01-01 to 2099-12-31 are 17 * 4297.
DAYS = (17, 4297)
DATE_FORMS = {"yyyy-MM-dd": r"^\d{4}-", "yyyy/MM/dd": r"^\d{4}/", "dd.MM.yyyy": r"^\d{2}\.", "MM/dd/yyyy": r"^\d{2}/"}


def _digest(key: str, *parts: str) -> str:
    """SQL: the keyed digest, in hex, of parts joined by |."""
    inner, outer = (sha256(f"{use}|{key}".encode()).hexdigest() for use in ("inner", "outer"))
    return f"sha2(concat('{outer}', sha2(concat_ws('|', '{inner}', {', '.join(parts)}), 256)), 256)"


def _pair(a: str, b: str, ma: str, mb: str, kind: str, key: str) -> str:
    """SQL for the permuted pair, struct(a, b), of two bigints below their moduli."""
    f = f"cast(conv(substr({_digest(key, f"'{kind}'", 'r', 's.b')}, 1, 15), 16, 10) as bigint)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), struct(cast({a} as bigint) as a, cast({b} as bigint) as b, cast({ma} as bigint) as ma, cast({mb} as bigint) as mb), "
        f"(s, r) -> struct(s.b as a, cast(pmod(s.a + {f}, s.ma) as bigint) as b, s.mb as ma, s.ma as mb))"
    )


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _fill(shape: str, digits: str) -> str:
    """SQL: the digits of ``shape`` replaced in order by those of ``digits``; the rest stays."""
    return (
        f"aggregate(split({shape}, ''), struct(0 as k, '' as out), (f, c) -> if(c rlike '[0-9]', "
        f"struct(f.k + 1 as k, concat(f.out, substr({digits}, f.k + 1, 1)) as out), struct(f.k as k, concat(f.out, c) as out)), f -> f.out)"
    )


def _luhn(digits: str, check: bool) -> str:
    """SQL: Luhn sum of ``digits``; with ``check``, as if a check digit were still to follow."""
    turn = 1 if check else 0
    return (
        f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> (int(c) * (1 + (i + {turn}) % 2))), 0, "
        "(t, v) -> t + v - if(v > 9, 9, 0))"
    )


def _card(m: str, key: str) -> str:
    inner = "substr(d, 2, length(d) - 2)"
    h = "int((length(d) - 2) / 2)"
    rest = f"(length(d) - 2 - {h})"
    mixed = _pair(f"substr({inner}, 1, {h})", f"substr({inner}, {h} + 1)", f"pow(10, {h})", f"pow(10, {rest})", "card", key)
    body = _let(mixed, "p", f"concat(substr(d, 1, 1), lpad(string(p.a), {h}, '0'), lpad(string(p.b), {rest}, '0'))")
    body = _let(body, "q", f"concat(q, string((10 - {_luhn('q', True)} % 10) % 10))")
    return _let(f"regexp_replace({m}, '[^0-9]', '')", "d", f"if({_luhn('d', False)} % 10 = 0, {_fill(m, body)}, {m})")


def _cards(m: str, key: str) -> str:
    """SQL: the run ``m`` in parts, struct(old, new), with its valid cards replaced."""
    spans = (
        "flatten(transform(sequence(0, size(gs) - 1), i -> filter(transform(sequence(1, least(19, size(gs) - i)), n -> "
        "struct(n, i, regexp_replace(array_join(slice(gs, i + 1, n), ''), '[^0-9]', '') as digits)), "
        f"c -> c.digits rlike '^[2-6][0-9]{{12,18}}$' and {_luhn('c.digits', False)} % 10 = 0)))"
    )
    chosen = (
        f"aggregate(array_sort({spans}), cast(array() as array<struct<n: int, i: int, digits: string>>), "
        "(a, c) -> if(exists(a, o -> c.i < o.i + o.n and o.i < c.i + c.n), a, concat(a, array(c))))"
    )
    card = _let("array_join(slice(gs, k + 1, o[0].n), '')", "old", f"struct(old, {_card('old', key)} as new)")
    part = _let("filter(cs, c -> c.i <= k and k < c.i + c.n)", "o", f"case when size(o) = 0 then struct(gs[k] as old, gs[k] as new) when o[0].i = k then {card} end")
    parts = _let(chosen, "cs", f"filter(transform(sequence(0, size(gs) - 1), k -> {part}), x -> x is not null)")
    return _let(f"split({m}, r'(?<=[\x20-])')", "gs", parts)


def _ip(m: str, key: str) -> str:
    mixed = _pair("int(o[0]) * 256 + int(o[1])", "int(o[2]) * 256 + int(o[3])", "65536", "65536", "ip", key)
    out = _let(mixed, "p", "concat_ws('.', int(p.a / 256), p.a % 256, int(p.b / 256), p.b % 256)")
    return _let(f"split({m}, r'\\.')", "o", f"if(forall(o, x -> int(x) <= 255 and (length(x) = 1 or x not like '0%')), {out}, {m})")


def _ssn(m: str, key: str) -> str:
    area, group, serial = (f"int(substr({m}, {i}, {n}))" for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
    mixed = _pair(f"{area} - 1 - if({area} > 666, 1, 0)", f"({group} - 1) * 9999 + {serial} - 1", "898", "99 * 9999", "ssn", key)
    out = _let(mixed, "p", "concat_ws('-', lpad(string(p.a + 1 + if(p.a >= 665, 1, 0)), 3, '0'), lpad(string(int(p.b / 9999) + 1), 2, '0'), lpad(string(p.b % 9999 + 1), 4, '0'))")
    return f"if({valid}, {out}, {m})"


def _phone(m: str, key: str) -> str:
    # Areas below 200, which only +1 (ddd) admits, are permuted among themselves: the others keep one pseudonym in every form.
    areas = ((0, 200, "phone-low"), (200, 800, "phone"))
    low, high = (_let(_pair(f"int(substr(d, 1, 3)) - {a}", "int(substr(d, 4)) - 2000000", str(n), "8000000", kind, key), "p", f"concat(lpad(string(p.a + {a}), 3, '0'), string(p.b + 2000000))") for a, n, kind in areas)
    out = f"if(d < '2', {low}, {high})"
    ten = "right(regexp_replace(%s, '[^0-9]', ''), 10)" % m
    return _let(ten, "d", _fill(m, f"concat(if(length(regexp_replace({m}, '[^0-9]', '')) = 11, '1', ''), {out})"))


def _date(m: str, key: str) -> str:
    cases = []
    for form, shape in DATE_FORMS.items():
        days = f"datediff(to_date(try_to_timestamp({m}, '{form}')), date'1900-01-01')"
        mixed = _pair(f"int(n / {DAYS[1]})", f"n % {DAYS[1]}", str(DAYS[0]), str(DAYS[1]), "date", key)
        out = _let(mixed, "p", f"date_format(date_add(date'1900-01-01', int(p.a * {DAYS[1]} + p.b)), '{form}')")
        cases.append(f"when {m} rlike r'{shape}' then " + _let(days, "n", f"if(n between 0 and {DAYS[0] * DAYS[1] - 1}, {out}, {m})"))
    return "case " + " ".join(cases) + f" else {m} end"


def _email(m: str, key: str) -> str:
    """Letters stay letters of their case, digits digits; halves of the name take turns."""
    draw = f"conv(substr({_digest(key, "'email'", 'r', 'int(i / 16)', 's.b')}, 4 * (i % 16) + 1, 4), 16, 10)"
    shift = f"transform(split(s.a, ''), (c, i) -> {_let(draw, 'n', _moved('c', 'n'))})"
    name = f"substring_index({m}, '@', 1)"
    half = f"int(length({name}) / 2)"
    mixed = (
        f"aggregate(sequence(1, {ROUNDS}), struct(substr({name}, 1, {half}) as a, substr({name}, {half} + 1) as b), "
        f"(s, r) -> struct(s.b as a, if(s.a = '', '', array_join({shift}, '')) as b), s -> concat(s.a, s.b))"
    )
    return f"concat({mixed}, '@', substring_index({m}, '@', -1))"


def _moved(c: str, n: str) -> str:
    case = lambda first, size: f"char({first} + (ascii({c}) - {first} + {n}) % {size})"
    return f"case when {c} rlike '[a-z]' then {case(97, 26)} when {c} rlike '[A-Z]' then {case(65, 26)} when {c} rlike '[0-9]' then {case(48, 10)} else {c} end"


def _kind(m: str) -> str:
    return (
        f"case when {m} like '%@%' then 'email' when {m} rlike r'^(?:{SSN})$' then 'ssn' when {m} rlike r'^(?:{DATE})$' then 'date' "
        f"when {m} rlike r'^(?:{IP})$' then 'ip' when {m} rlike r'^(?:{PHONE})$' then 'phone' else 'card' end"
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten and, for each kind, ``n_<kind>``, the values replaced."""
    rules = {"email": _email, "ip": _ip, "ssn": _ssn, "phone": _phone, "date": _date}
    new = "case x.kind " + " ".join(f"when '{k}' then array(struct(x.m as old, {rule('x.m', key)} as new))" for k, rule in rules.items()) + f" else {_cards('x.m', key)} end"
    any_of = f"r'{ANY}'"
    docs, back = sheltered(docs, but=(text,))
    df = (
        docs.withColumn("_hit", F.expr(f"coalesce(`{text}` rlike '[0-9@]' and `{text}` rlike {any_of}, false)"))
        .withColumn("_gaps", F.expr(f"if(_hit, split(`{text}`, {any_of}, -1), array())"))
        .withColumn("_found", F.expr(f"transform(if(_hit, regexp_extract_all(`{text}`, {any_of}, 0), array()), m -> struct(m, {_kind('m')} as kind))"))
        .withColumn("_new", F.expr(f"transform(_found, x -> struct(x.kind, {new} as parts))"))
    )
    counts = [F.expr(f"bigint(size(filter(flatten(transform(filter(_new, x -> x.kind = '{k}'), x -> x.parts)), p -> p.new <> p.old)))").alias(f"n_{k}") for k in KINDS]
    body = F.expr(f"if(_hit, concat(_gaps[0], array_join(transform(_new, (x, i) -> concat(array_join(transform(x.parts, p -> p.new), ''), _gaps[i + 1])), '')), `{text}`)").alias(text)
    names = [f"n_{k}" for k in KINDS]
    return back(df.select(*[body if c == text else F.col(c) for c in docs.columns if c not in names], *counts))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_CONF, None) or TRIAL_KEY
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key)
