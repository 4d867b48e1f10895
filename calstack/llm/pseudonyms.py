"""Format-preserving pseudonyms of personal data, in DataFrame expressions only.

Candidates are found with one regular expression and validated: card numbers by
their check digit, addresses by their octets, social security numbers by their
areas, dates by the calendar. A valid value is mapped by a keyed Feistel network,
a permutation of its own format's values, so equal values stay linked across
documents and different ones stay apart. Cards keep their first digit and get a
right check digit, phone numbers keep the country code and class of area code,
addresses stay addresses, dates stay dates of 1900 to 2099 in their own notation.
E-mail names and access keys are permuted as numbers in their own alphabet; secrets
in hex digits are the same value in either case, and keep the case that they have.
What is not valid stays as it is.

Null text: null, no findings. Empty text: empty. Texts without findings: unchanged.
Other columns of the input are kept as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calstack.llm.common import fresh

ROUNDS = 12
#: Days from 1900-01-01 to 2099-12-31, as a product.
DAYS_LEFT, DAYS_RIGHT = 17, 4297

#: What every text with a value of a format holds; other texts are not searched.
HINT = "[0-9@=:]|AKIA"
#: Formats: name, pattern, and what may not stand before or after it.
FORMATS = [
    ("email", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"(?<![A-Za-z0-9._%+-])", ""),
    ("card", r"\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5}|\d{13,19}", r"(?<![\w+.-])", r"(?![\w-])"),
    ("phone", r"(?:\+1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|(?:\+1[ .-]?)?\d{3}[ .-]\d{3}[ .-]\d{4}|\+1\d{10}", r"(?<![\w+.-])", r"(?![\w-])"),
    ("ssn", r"\d{3}-\d{2}-\d{4}", r"(?<![\w+.-])", r"(?![\w-])"),
    ("ip", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", r"(?<![\w.+-])", r"(?![\w-]|\.\d)"),
    ("date", r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}", r"(?<![\w/.+-])", r"(?![\w/-]|\.\d)"),
    ("secret", r"AKIA[0-9A-Z]{16}|(?i:password|passwd|token|secret|api_?key) ?[=:] ?[\"']?[0-9a-fA-F]{8,64}", r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"),
]


def pattern() -> str:
    """All formats in one expression; references count groups from its start."""
    parts, groups = [], 0
    for _, body, before, after in FORMATS:
        own = re.sub(r"\\([1-9])", lambda m, at=groups: rf"\{at + int(m[1])}", body)
        groups += re.compile(body).groups
        parts.append(f"{before}(?:{own}){after}")
    return "|".join(parts)


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, then: str) -> str:
    """`then` with `name` standing for `value`, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def feistel(left: str, right: str, a: str, b: str, tweak: str, key: str, finish: str) -> str:
    """A permutation of pairs below (a, b): in turns, each half gets a keyed hash of
    the other added. `finish` is over the struct s (l, r)."""

    def hashed(half: str) -> str:
        return f"CAST(conv(substr(sha2(concat_ws('|', {text(key)}, {text(tweak)}, i, {half}), 256), 1, 14), 16, 10) AS BIGINT)"

    odd, even = (f"(s.r + {hashed('s.l')}) % ({b})", f"(s.l + {hashed('s.r')}) % ({a})")
    step = f"if(i % 2 = 0, named_struct('l', {even}, 'r', s.r), named_struct('l', s.l, 'r', {odd}))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', CAST({left} AS BIGINT), 'r', CAST({right} AS BIGINT)), (s, i) -> {step}, s -> {finish})"


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def luhn(number: str, odd_from_right: int) -> str:
    """Sum of the digits, every second one doubled (the last one too if 1)."""
    at = f"CAST(substr({number}, length({number}) - i, 1) AS INT)"
    return f"aggregate(sequence(0, length({number}) - 1), 0, (t, i) -> t + if(i % 2 = {1 - odd_from_right}, {at} * 2 - if({at} > 4, 9, 0), {at}))"


def filled(form: str, which: str, characters: str) -> str:
    """`form` with its characters of class `which` replaced, in order."""
    one = f"substr({form}, j, 1)"
    step = f"if({one} RLIKE '{which}', named_struct('o', concat(q.o, substr({characters}, q.k, 1)), 'k', q.k + 1), named_struct('o', concat(q.o, {one}), 'k', q.k))"
    return f"aggregate(sequence(1, length({form})), named_struct('o', '', 'k', 1), (q, j) -> {step}, q -> q.o)"


def card(key: str) -> str:
    half = "CAST((length(d) - 2) div 2 AS INT)"
    halves = (f"substr(d, 2, {half})", f"substr(d, 2 + {half}, length(d) - 2 - {half})")
    size = [f"CAST(pow(10, length({h})) AS BIGINT)" for h in halves]
    body = "concat(substr(d, 1, 1), " + ", ".join(f"lpad(CAST(s.{x} AS STRING), length({h}), '0')" for x, h in zip("lr", halves, strict=True)) + ")"
    number = feistel(*halves, *size, "card", key, body)
    checked = let(number, "p", f"concat(p, CAST((10 - {luhn('p', 1)} % 10) % 10 AS STRING))")
    return let(digits("m"), "d", let(checked, "c", filled("m", "[0-9]", "c")))


def phone(key: str) -> str:
    area = "CAST(substr(d, length(d) - 9, 3) AS BIGINT)"
    low, size = f"if({area} >= 200, 200, 0)", f"if({area} >= 200, 800, 200)"
    left = f"({area} - {low}) * 100 + CAST(substr(d, length(d) - 6, 2) AS BIGINT)"
    body = f"concat(substr(d, 1, length(d) - 10), lpad(CAST(s.l + {low} * 100 AS STRING), 5, '0'), lpad(CAST(s.r AS STRING), 5, '0'))"
    return let(digits("m"), "d", let(feistel(left, "substr(d, length(d) - 4)", f"{size} * 100", "100000", "phone", key, body), "c", filled("m", "[0-9]", "c")))


def ssn(key: str) -> str:
    """Areas 001 to 899 but 666, groups 01 to 99, serial numbers 0001 to 9999."""
    area = "CAST(substr(m, 1, 3) AS BIGINT)"
    right = "(CAST(substr(m, 5, 2) AS BIGINT) - 1) * 9999 + CAST(substr(m, 8) AS BIGINT) - 1"
    body = "concat(lpad(CAST(s.l + if(s.l >= 665, 2, 1) AS STRING), 3, '0'), '-', lpad(CAST(s.r div 9999 + 1 AS STRING), 2, '0'), '-', lpad(CAST(s.r % 9999 + 1 AS STRING), 4, '0'))"
    return feistel(f"{area} - if({area} > 666, 2, 1)", right, "898", "989901", "ssn", key, body)


def ip(key: str) -> str:
    octet = [f"CAST(element_at(d, {i}) AS BIGINT)" for i in (1, 2, 3, 4)]
    body = "concat_ws('.', s.l div 256, s.l % 256, s.r div 256, s.r % 256)"
    return let("split(m, '[.]')", "d", feistel(f"{octet[0]} * 256 + {octet[1]}", f"{octet[2]} * 256 + {octet[3]}", "65536", "65536", "ip", key, body))


def day(value: str = "m") -> str:
    """The date that is written, or null: year first, or with slashes month first if
    that is a date, or with dots day first."""
    part = [f"lpad(element_at(split({value}, '[/.]'), {i}), 2, '0')" for i in (1, 2)]
    year = f"right({value}, 4)"
    first, second = (f"try_cast(concat_ws('-', {year}, {x}, {y}) AS DATE)" for x, y in (part, part[::-1]))
    found = f"CASE WHEN {value} LIKE '____-__-__' THEN try_cast({value} AS DATE) WHEN {value} LIKE '%/%' THEN coalesce({first}, {second}) ELSE {second} END"
    return let(found, "dd", "if(dd BETWEEN DATE'1900-01-01' AND DATE'2099-12-31', dd, NULL)")


def date(key: str) -> str:
    part = [f"lpad(element_at(split(m, '[/.]'), {i}), 2, '0')" for i in (1, 2)]
    month_first = f"m LIKE '%/%' AND try_cast(concat_ws('-', right(m, 4), {part[0]}, {part[1]}) AS DATE) IS NOT NULL"
    short = "length(m) < 10"
    out = f"CASE WHEN m LIKE '____-__-__' THEN date_format(nd, 'yyyy-MM-dd') WHEN m NOT LIKE '%/%' THEN date_format(nd, if({short}, 'd.M.yyyy', 'dd.MM.yyyy')) WHEN {month_first} THEN date_format(nd, if({short}, 'M/d/yyyy', 'MM/dd/yyyy')) ELSE date_format(nd, if({short}, 'd/M/yyyy', 'dd/MM/yyyy')) END"
    number = f"datediff({day()}, DATE'1900-01-01')"
    moved = let(number, "n", feistel(f"n div {DAYS_RIGHT}", f"n % {DAYS_RIGHT}", str(DAYS_LEFT), str(DAYS_RIGHT), "date", key, f"date_add(DATE'1900-01-01', CAST(s.l * {DAYS_RIGHT} + s.r AS INT))"))
    return let(moved, "nd", out)


def spelled(value: str, base: int, tweak: str, key: str) -> str:
    """Letters and digits permuted as numbers of a base, in blocks of up to 20."""
    half = "CAST(length(z) div 2 AS INT)"
    halves = (f"substr(z, 1, {half})", f"substr(z, {half} + 1)")
    number = [f"coalesce(CAST(conv({h}, {base}, 10) AS BIGINT), 0)" for h in halves]
    size = [f"CAST(pow({base}, length({h})) AS BIGINT)" for h in halves]
    left, right = (f"lpad(lower(conv(CAST(s.{x} AS STRING), 10, {base})), length({h}), '0')" for x, h in zip("lr", halves, strict=True))
    block = feistel(*number, *size, tweak, key, f"concat(if({half} = 0, '', {left}), {right})")
    return f"array_join(transform(sequence(0, CAST((length({value}) - 1) div 20 AS INT)), k -> {let(f'substr({value}, k * 20 + 1, 20)', 'z', block)}), '')"


def email(key: str) -> str:
    """The name before the @, by blocks of 64 characters, which no valid one exceeds."""
    name = let(spelled("e", 36, "email", key), "c", filled("b", "[0-9A-Za-z]", "c"))
    block = let("regexp_replace(lower(b), '[^0-9a-z]', '')", "e", f"if(e = '', b, {name})")
    local = "substring_index(m, '@', 1)"
    blocks = f"transform(sequence(0, CAST((length({local}) - 1) div 64 AS INT)), y -> {let(f'substr({local}, y * 64 + 1, 64)', 'b', block)})"
    return f"concat(array_join({blocks}, ''), substr(m, instr(m, '@')))"


def secret(key: str) -> str:
    access = let("lower(substr(m, 5))", "e", f"concat('AKIA', upper({spelled('e', 36, 'key', key)}))")
    parts = [f"regexp_extract(m, '^(.*?)([0-9a-fA-F]{{8,64}})$', {k})" for k in (1, 2)]
    each = "if(substr(v, j, 1) RLIKE '[A-F]', upper(substr(c, j, 1)), substr(c, j, 1))"
    cased = f"CASE WHEN NOT v RLIKE '[A-F]' THEN c WHEN NOT v RLIKE '[a-f]' THEN upper(c) ELSE array_join(transform(sequence(1, length(v)), j -> {each}), '') END"
    made = let("lower(v)", "e", let(spelled("e", 16, "password", key), "c", cased))
    assigned = let(parts[1], "v", f"concat({parts[0]}, {made})")
    return f"if(m LIKE 'AKIA%', {access}, {assigned})"


def kind() -> str:
    """The format of a candidate m whose value is valid, or null."""
    whole = {name: text(f"^(?:{body})$") for name, body, _, _ in FORMATS}
    valid = {
        "card": f"length({digits('m')}) BETWEEN 13 AND 19 AND {let(digits('m'), 'd', luhn('d', 0) + ' % 10 = 0')}",
        "ssn": "NOT (m LIKE '000%' OR m LIKE '666%' OR m LIKE '9%' OR m LIKE '____00%' OR m LIKE '%0000')",
        "ip": "forall(split(m, '[.]'), x -> CAST(x AS INT) < 256 AND CAST(CAST(x AS INT) AS STRING) = x)",
        "date": f"{day()} IS NOT NULL",
    }
    cases = [f"WHEN m RLIKE {whole[name]} THEN if({valid.get(name, 'true')}, '{name}', NULL)" for name, _, _, _ in FORMATS]
    return "CASE " + " ".join(cases) + " END"


def pseudonym(key: str) -> str:
    made = {"email": email, "card": card, "phone": phone, "ssn": ssn, "ip": ip, "date": date, "secret": secret}
    cases = " ".join(f"WHEN '{name}' THEN {f(key)}" for name, f in made.items())
    return f"CASE kind {cases} ELSE m END"


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", into: str = "__text", kinds: str = "__kinds") -> DataFrame:
    """`docs` with two columns more at its end: the text with its pseudonyms, and the
    formats found, one for each value replaced; their names get underscores until no
    column of `docs` has them. The key stands as a literal in the plan."""
    into, kinds = fresh(docs, into), fresh(docs, kinds)
    own = F.col(text_col).cast("string")
    found, values = fresh(docs, "__found"), fresh(docs, "__values")
    candidates = F.regexp_extract_all(own, F.lit(pattern()), F.lit(0))
    some = docs.withColumn(found, F.when(own.rlike(HINT), candidates).otherwise(F.array().cast("array<string>")))
    valued = some.withColumn(values, F.expr(f"transform({found}, m -> named_struct('m', m, 'kind', {kind()}))"))
    new = F.expr(f"transform({values}, v -> {let('v.m', 'm', let('v.kind', 'kind', pseudonym(key)))})")
    parts = F.split(own, pattern(), -1)
    joined = F.array_join(F.flatten(F.zip_with(parts, F.concat(new, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    changed = F.expr(f"exists({values}, v -> v.kind IS NOT NULL)")
    out = valued.withColumn(into, F.when(changed, joined).otherwise(own))
    return out.withColumn(kinds, F.expr(f"transform(filter({values}, v -> v.kind IS NOT NULL), v -> v.kind)")).drop(found, values)


def count(name: str, kinds: str = "__kinds") -> Column:
    return F.size(F.filter(F.col(kinds), lambda k: k == F.lit(name))).cast("long")
