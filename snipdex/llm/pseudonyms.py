"""Format-preserving pseudonyms for personal data, in SQL functions only.

One pattern finds candidates; each is validated by its kind and, if valid, replaced by a keyed permutation within its
format, so equal values get equal pseudonyms in all documents and different values stay different:

* card numbers (Luhn): the digits before the check digit are permuted, the check digit is computed anew;
* IBANs (remainder 97): the digits of the account are permuted, the check digits are computed anew;
* social security numbers: permuted among the valid ones; phone numbers: the last ten digits (all but two of longer
  national forms) are permuted; IPv4 addresses: permuted among all addresses;
* dates (valid days of 1900 to 2099, three notations): permuted among these days, whatever the notation;
* mail addresses: every letter and digit of the name and of the domain before its last dot is permuted within its kind.

The permutations are Feistel networks over a product a * b: the left part is moved by a keyed hash of the right part
modulo a, then the right part by one of the left part modulo b, ten times. A product can have any size, so no value
falls out of its range. Round functions are SHA-256 over key, kind, round and the other part.

Candidates that fail their validation stay as they are. The length of an IBAN follows from its country. IBANs are
looked for first, from every place where one may start, and valid ones are set in marks; all else is found in the rest,
so a failed IBAN takes nothing from what overlaps it. International phone numbers in groups end at the length of
their country where it is fixed, otherwise at the last group within 15 digits that begins no date, address or number of
another kind. Results: null texts stay null; empty and clean texts stay
unchanged, with no kinds. Every pattern reads a long text in linear time. All other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
DAYS = (17, 4297)  # 17 * 4297 = 73,049 days from 1900-01-01 to 2099-12-31

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_END = "(?![0-9A-Za-z])"
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "IR IS TR", 27: "BF BI CF CG CM DJ FR GA GR IT KM MC MG MR SM TD GQ", 28: "AL AZ BJ BY CI CY DO GT HN HU LB ML NE NI PL SN SV TG MA",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Digits after the country code of a phone number, where all have as many.
PHONE_DIGITS = {7: "354", 8: "45 47 65", 9: "27 31 33 34 40 41 48 61 351 380 420 421", 10: "1 7 30 44 52 90 91"}
#: Around an IBAN in the text, and what stands for the first mark where a text has it itself.
_MARK, _OPEN, _CLOSE, _MARK_ITSELF = "\ue000", "\ue000\ue001", "\ue000\ue002", "\ue000\ue003"
_ibans = "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items())
# Not where a mail address has it as its name or as the first part of its domain.
IBAN = rf"(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?![A-Za-z0-9._%+-]{{1,64}}+@[A-Za-z0-9-]{{1,63}}\.)(?!(?<=[A-Za-z0-9._%+-]@)[A-Za-z0-9-]{{1,63}}\.[A-Za-z])(?:{_ibans}){_END}"
# A group of a phone number begins no date, card, social security number or address.
_OTHER = rf"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}[./][0-9]{{1,2}}[./][0-9]{{4}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}(?![0-9])|[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9])|(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9])"
_GAP = r"(?:\)?[ .-]?\(?|\) )"
_STEP = rf"(?:{_GAP}(?!(?<=[ ])(?:{_OTHER}))[0-9])"
_groups = "|".join(rf"\+(?:{codes.replace(' ', '|')})(?: ?\(0\))?(?:{_GAP}[0-9]){{{n}}}" for n, codes in PHONE_DIGITS.items())
CANDIDATES = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,10}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": f"{_OPEN}[^{_MARK}]*+{_CLOSE}",
    "ip": rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}{_END}(?!\.[0-9])",
    "date": rf"(?<![0-9A-Za-z./-])(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?:(?=T[0-9])|{_END})|[0-9]{{1,2}}([./])[0-9]{{1,2}}\1[0-9]{{4}}{_END})(?![./-][0-9])",
    "ssn": rf"(?<![0-9A-Za-z-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}(?!-[0-9])",
    "card": rf"(?<![0-9A-Za-z.])(?:[0-9]{{4}}([ -]?)[0-9]{{4}}\2[0-9]{{4}}\2[0-9]{{4}}|[0-9]{{4}}([ -]?)[0-9]{{6}}\3[0-9]{{5}}|[0-9]{{13,19}}){_END}",
    "phone": rf"(?<![0-9A-Za-z+(])(?:(?:\+?[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{3}}\)[ .-]?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}|\+[1-9][0-9]{{7,14}}|{_groups}|\+[1-9]{_STEP}{{7,14}}){_END}",
}
PATTERN = "|".join(CANDIDATES.values())


def _hash(key: str, kind: str, step: str, value: str) -> str:
    """A number of 60 bits."""
    return f"cast(conv(substring(sha2(concat('{key}|{kind}|', {step}, '|', {value}), 256), 1, 15), 16, 10) as bigint)"


def _feistel(key: str, kind: str, left: str, right: str, a: str, b: str) -> str:
    """The struct (l, r) with l below a and r below b, permuted."""
    moved_l = f"named_struct('l', pmod(s.l + {_hash(key, kind, 'i', 's.r')} % {a}, {a}), 'r', s.r)"
    moved_r = f"named_struct('l', s.l, 'r', pmod(s.r + {_hash(key, kind, 'i', 's.l')} % {b}, {b}))"
    start = f"named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> IF(i % 2 = 1, {moved_l}, {moved_r}))"


def _let(name: str, value: str, body: str) -> str:
    """The body with a name for a value that it uses several times."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(key: str, kind: str, digits: str) -> str:
    """A string of 2 to 36 digits, permuted among those of its length."""
    size = f"shiftright(length({digits}), 1)"
    rest = f"(length({digits}) - {size})"
    network = _feistel(key, kind, f"substring({digits}, 1, {size})", f"substring({digits}, {size} + 1)", f"cast(rpad('1', {size} + 1, '0') as bigint)", f"cast(rpad('1', {rest} + 1, '0') as bigint)")
    return _let("w", network, f"concat(lpad(cast(w.l as string), {size}, '0'), lpad(cast(w.r as string), {rest}, '0'))")


def _poured(form: str, digits: str) -> str:
    """The form with its digits replaced one after another."""
    step = f"IF(c >= '0' AND c <= '9', named_struct('t', concat(p.t, substring({digits}, p.n + 1, 1)), 'n', p.n + 1), named_struct('t', concat(p.t, c), 'n', p.n))"
    return f"aggregate(filter(split({form}, ''), c -> c <> ''), named_struct('t', '', 'n', 0), (p, c) -> {step}, p -> p.t)"


def _only_digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def _luhn(digits: str, odd: int) -> str:
    """The Luhn sum; from the right, the first digit is doubled if odd is 0."""
    step = f"IF((e.i + {odd}) % 2 = 0, e.d * 2 - IF(e.d > 4, 9, 0), e.d)"
    numbered = f"transform(filter(split(reverse({digits}), ''), c -> c <> ''), (c, i) -> named_struct('d', cast(c as int), 'i', i))"
    return f"aggregate({numbered}, 0, (sum, e) -> sum + {step})"


def _modulo_97(text: str) -> str:
    """The number that a string of digits and capital letters (A is 10) spells, modulo 97."""
    number = "cast(conv(c, 36, 10) as bigint)"
    return f"aggregate(filter(split({text}, ''), c -> c <> ''), 0L, (m, c) -> pmod(m * IF(c >= 'A', 100, 10) + {number}, 97))"


def _letters(key: str, kind: str, text: str) -> str:
    """A text whose letters and digits are permuted within their kind, by a Feistel network on its halves."""

    def shifted(half: str, other: str) -> str:
        amount = "cast(conv(substring(h, pmod(k, 32) * 2 + 1, 2), 16, 10) as int)"
        kinds = ((97, 26, "'a'", "'z'"), (65, 26, "'A'", "'Z'"), (48, 10, "'0'", "'9'"))
        cases = " ".join(f"WHEN c BETWEEN {lo} AND {hi} THEN chr({first} + pmod(ascii(c) - {first} + {amount}, {size}))" for first, size, lo, hi in kinds)
        digest = f"sha2(concat('{key}|{kind}|', i, '|', {other}), 256)"
        return _let("h", digest, f"array_join(transform(filter(split({half}, ''), c -> c <> ''), (c, k) -> CASE {cases} ELSE c END), '')")

    size = f"shiftright(length({text}), 1)"
    start = f"named_struct('l', substring({text}, 1, {size}), 'r', substring({text}, {size} + 1))"
    step = f"IF(i % 2 = 1, named_struct('l', {shifted('s.l', 's.r')}, 'r', s.r), named_struct('l', s.l, 'r', {shifted('s.r', 's.l')}))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> {step}, s -> concat(s.l, s.r))"


def _date(key: str, m: str) -> str:
    """Year, month and day by notation: year first; with dots the day first; with slashes the month first if that is a date."""
    part = lambda i, sign: f"split({m}, '{sign}')[{i}]"
    day = lambda y, mo, d: f"try_to_date(concat({y}, '-', lpad({mo}, 2, '0'), '-', lpad({d}, 2, '0')), 'yyyy-MM-dd')"
    iso, dots = day(part(0, "-"), part(1, "-"), part(2, "-")), day(part(2, "[.]"), part(1, "[.]"), part(0, "[.]"))
    us, eu = day(part(2, "/"), part(0, "/"), part(1, "/")), day(part(2, "/"), part(1, "/"), part(0, "/"))
    read = f"CASE WHEN {m} LIKE '%-%' THEN named_struct('f', 'iso', 'd', {iso}) WHEN {m} LIKE '%.%' THEN named_struct('f', 'dots', 'd', {dots}) ELSE IF({us} IS NOT NULL, named_struct('f', 'us', 'd', {us}), named_struct('f', 'eu', 'd', {eu})) END"
    number = "datediff(q.d, DATE'1900-01-01')"
    network = _feistel(key, "date", f"shiftright({number}, 0) div {DAYS[1]}", f"{number} % {DAYS[1]}", f"{DAYS[0]}", f"{DAYS[1]}")
    # Written with leading zeros if the first two fields had them or had two digits anyway.
    plain = f"{m} rlike '^[0-9][./]' OR {m} rlike '[./][0-9][./]'"
    pattern = lambda a, b, sign: f"IF({plain}, concat({a}(n.n), '{sign}', {b}(n.n), '{sign}', year(n.n)), concat(lpad({a}(n.n), 2, '0'), '{sign}', lpad({b}(n.n), 2, '0'), '{sign}', year(n.n)))"
    written = f"CASE q.f WHEN 'iso' THEN cast(n.n as string) WHEN 'us' THEN {pattern('month', 'day', '/')} WHEN 'eu' THEN {pattern('day', 'month', '/')} ELSE {pattern('day', 'month', '.')} END"
    moved = _let("w", network, f"named_struct('n', date_add(DATE'1900-01-01', cast(w.l * {DAYS[1]} + w.r as int)))")
    valid = "q.d BETWEEN DATE'1900-01-01' AND DATE'2099-12-31'"
    return _let("q", read, f"CASE WHEN {valid} THEN {_let('n', moved, written)} END")


def _pseudonym(key: str, m: str) -> str:
    """A struct (kind, value) for a candidate; null if it is not valid."""
    card = _let("g", _only_digits(m), f"CASE WHEN {_luhn('g', 1)} % 10 = 0 THEN " + _let("v", _digits(key, "card", "substring(g, 1, length(g) - 1)"), _poured(m, f"concat(v, cast(pmod(10 - {_luhn('v', 0)} % 10, 10) as string))")) + " END")
    # IBAN: country, two check digits, account; the check is made on account, country, check digits.
    account = _let("v", _digits(key, "iban", _only_digits("substring(g, 5)")), _poured("substring(g, 5)", "v"))
    checked = _let("z", account, f"concat(substring(g, 1, 2), lpad(cast(98 - {_modulo_97('concat(z, substring(g, 1, 2), ' + chr(39) + '00' + chr(39) + ')')} as string), 2, '0'), z)")
    spaced = "aggregate(filter(split(m, ''), c -> c <> ''), named_struct('t', '', 'n', 0), (p, c) -> IF(c = ' ', named_struct('t', concat(p.t, c), 'n', p.n), named_struct('t', concat(p.t, substring(b, p.n + 1, 1)), 'n', p.n + 1)), p -> p.t)"
    iban = _let("m", f"regexp_replace({m}, '{_OPEN}|{_CLOSE}', '')", _let("g", "replace(m, ' ', '')", _let("b", checked, spaced)))
    octet = lambda i: f"cast(split({m}, '[.]')[{i}] as bigint)"
    ip_network = _feistel(key, "ip", f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", "65536", "65536")
    ip = _let("w", ip_network, "concat_ws('.', w.l div 256, w.l % 256, w.r div 256, w.r % 256)")
    # Areas 001-899 but 666, groups 01-99, serials 0001-9999: 898 * 99 times 9999 numbers.
    area, group, serial = (f"cast(split({m}, '-')[{i}] as bigint)" for i in range(3))
    ssn_network = _feistel(key, "ssn", f"({area} - IF({area} > 666, 2, 1)) * 99 + {group} - 1", f"{serial} - 1", "88902", "9999")
    area_out = "(w.l div 99 + IF(w.l div 99 >= 665, 2, 1))"
    ssn_out = _let("w", ssn_network, f"concat(lpad(cast({area_out} as string), 3, '0'), '-', lpad(cast(w.l % 99 + 1 as string), 2, '0'), '-', lpad(cast(w.r + 1 as string), 4, '0'))")
    ssn = f"CASE WHEN {area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0 THEN {ssn_out} END"
    keep = "IF(length(g) > 10 AND length(g) < 14, length(g) - 10, IF(length(g) >= 14, 3, IF(length(g) = 10, 0, 2)))"
    phone = _let("g", _only_digits(m), _let("v", _digits(key, "phone", f"substring(g, {keep} + 1)"), _poured(m, f"concat(substring(g, 1, {keep}), v)")))
    name, domain, tld = f"substring_index({m}, '@', 1)", f"regexp_extract({m}, '@(.*)[.]', 1)", f"substring_index({m}, '.', -1)"
    mail = f"concat({_letters(key, 'mail', name)}, '@', {_letters(key, 'domain', domain)}, '.', {tld})"
    kinds = [
        ("mail", f"{m} LIKE '%@%'", mail),
        ("iban", f"startswith({m}, '{_MARK}')", iban),
        ("ip", f"{m} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$'", ip),
        ("date", f"{m} rlike '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}[./][0-9]{{1,2}}[./][0-9]{{4}})$'", _date(key, m)),
        ("ssn", f"{m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$'", ssn),
        ("card", f"{m} rlike '^[0-9 -]+$' AND length({_only_digits(m)}) >= 13", card),
        ("phone", "true", phone),
    ]
    return "CASE " + " ".join(f"WHEN {test} THEN named_struct('kind', '{kind}', 'value', {value})" for kind, test, value in kinds) + " END"


def _valid_iban(m: str) -> str:
    return _let("g", f"replace({m}, ' ', '')", f"{_modulo_97('concat(substring(g, 5), substring(g, 1, 4))')} = 1 AND length({_only_digits('substring(g, 5)')}) >= 2")


def _marked(at: str) -> str:
    """The text with marks around its valid IBANs; of two that overlap, the first.

    Pieces begin where an IBAN may start. Piece i has its characters, less those that an IBAN of one of the 16 pieces
    before it (an IBAN has up to 67 characters, five at least between two starts) reaches into it.
    """
    text = f"replace({at}, '{_MARK}', '{_MARK_ITSELF}')"
    ibans = f"concat(array(''), transform(regexp_extract_all(x, r'(?=({IBAN}))', 1), m -> IF({_valid_iban('m')}, m, '')))"
    # What the IBANs before piece i still have of it, at most.
    reach = "aggregate(sequence(greatest(i - 16, 0), i), 0, (left, j) -> IF(j = i, left, greatest(IF(left > 0, left, length(v[j])) - length(s[j]), 0)))"
    cut = _let("r", reach, f"IF(r > 0 OR v[i] = '', concat(IF(r > 0 AND r <= length(p), concat(substring(p, 1, r), '{_CLOSE}', substring(p, r + 1)), p)), IF(length(v[i]) <= length(p), concat('{_OPEN}', v[i], '{_CLOSE}', substring(p, length(v[i]) + 1)), concat('{_OPEN}', p)))")
    joined = _let("s", f"split(x, r'(?={IBAN})', -1)", _let("v", ibans, f"array_join(transform(s, (p, i) -> {cut}), '')"))
    # The blank in front keeps a first piece before an IBAN at the start.
    whole = _let("x", f"concat(' ', {text})", f"substring({joined}, 2)")
    return f"CASE WHEN {at} rlike r'{IBAN}' THEN {whole} ELSE {text} END"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "pii") -> DataFrame:
    """The documents with pseudonyms in their text, and the kinds replaced, in order, as the struct array `found_col`.

    `found_col` (kind, value: the pseudonym) replaces a column of that name.
    """
    if not key.isalnum():
        raise ValueError("the key consists of letters and digits")
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = f"c{names.index(text_col)}"
    found = plain.withColumn("marked", F.expr(_marked(at)))
    found = found.withColumn("candidates", F.expr(f"regexp_extract_all(marked, r'{PATTERN}', 0)"))
    found = found.withColumn("replaced", F.expr(f"transform(candidates, m -> {_pseudonym(key, 'm')})"))
    pieces = f"transform(split(marked, r'{PATTERN}', -1), p -> replace(p, '{_MARK_ITSELF}', '{_MARK}'))"
    values = "concat(transform(candidates, (m, i) -> coalesce(replaced[i].value, m)), array(''))"
    text = f"CASE WHEN size(filter(replaced, r -> r.value IS NOT NULL)) > 0 THEN array_join(zip_with({pieces}, {values}, (p, v) -> concat(p, v)), '') ELSE {at} END"
    found = found.withColumn("text_out", F.expr(text))
    kept = [(F.col("text_out") if n == text_col else F.col(f"c{i}")).alias(n) for i, n in enumerate(names) if n != found_col]
    return found.select(*kept, F.expr("coalesce(filter(replaced, r -> r.value IS NOT NULL), array())").alias(found_col))
