"""PII (operator 9): format-preserving Feistel pseudonyms, DataFrame functions only.

Candidates are found by one pattern, validated, and replaced by a keyed permutation of
their own format; every other character of the text stays. The permutation depends on
the key, the kind and the value only, so equal values get equal pseudonyms in every
document, and different values different ones.

================  =============================  ==================================
kind              validated by                   permuted domain (left x right half)
================  =============================  ==================================
card              13-19 digits (whole groups of  all digits but the check digit, which is
                  a longer run), Luhn            computed anew
phone             +1 / national grouping         the 10 national digits
ssn               3-2-4 digits, no 000/666/9xx   9 digits
ip                four octets up to 255          2**16 x 2**16
date              real day in 1900-2099          229 x 319 = 73,049 days
email             local part @ domain            letters and digits of the local part
secret            key, token, password forms     letters and digits after the label
================  =============================  ==================================

A numeric value is split into two halves (l, r) with moduli (a, b); eight rounds add a
keyed hash of one half to the other, modulo its size, in turn. Any a x b domain works
without cycle walking. Text values use the same network with per-character addition
within a-z, A-Z and 0-9. Invertible by running the rounds backwards with the same key.

The whole operator is a projection: no shuffle, no Python.

Defined cases: null text stays null with 0 findings; empty text stays empty. A candidate
that fails validation stays as it is. Separators inside a value stay in place. Repeated
rows give repeated results; a null or repeated doc_id does not matter. Extra columns are
ignored by :func:`pseudonymise` and kept by :func:`with_pseudonyms`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# Fixed patterns of the candidate forms (Java regular expressions).
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<=password=)[^\s\"']{6,}|(?<=token = \")[^\s\"']{8,}"
PHONE = r"(?<![\w+.-])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-])"
IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/-]|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
# 13 to 19 digits and the short digit groups that follow: a card can begin or end at any border of the groups
CARD = r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)(?:[ -]\d{1,12}(?![\w]|\.\d))*+"
CANDIDATE = "|".join([SECRET, EMAIL, PHONE, IP, DATE, SSN, CARD])
# the same with the secrets as group 1, and what a text with a candidate holds
_MARKED = f"({SECRET})" + CANDIDATE[len(SECRET) :]
_LABEL = r"password=|token = \"|AKIA"


def _lit(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(left: str, right: str, a: str, b: str, kind: str, key: str) -> str:
    """SQL of the permuted pair, a struct (l, r)."""
    prf = lambda half: f"cast(conv(substr(sha2(concat_ws('|', {_lit(key)}, {_lit(kind)}, i, {a}, {b}, {half}), 256), 1, 15), 16, 10) as bigint)"
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> "
        f"if(i % 2 = 0, named_struct('l', cast(pmod(s.l + pmod({prf('s.r')}, {a}), {a}) as bigint), 'r', s.r), "
        f"named_struct('l', s.l, 'r', cast(pmod(s.r + pmod({prf('s.l')}, {b}), {b}) as bigint))))"
    )


def _digits(d: str, kind: str, key: str) -> str:
    """SQL of the permuted digit string ``d`` (2 to 19 digits)."""
    u = f"cast(length({d}) div 2 as int)"
    ten = lambda n: f"cast(rpad('1', {n} + 1, '0') as bigint)"
    pair = _feistel(f"substr({d}, 1, {u})", f"substr({d}, {u} + 1)", ten(u), ten(f"(length({d}) - {u})"), kind, key)
    # the struct is named once through a one-element array
    return f"transform(array({pair}), p -> concat(lpad(p.l, {u}, '0'), lpad(p.r, length({d}) - {u}, '0')))[0]"


def _letters(text: str, kind: str, key: str) -> str:
    """SQL of the permuted letters and digits of ``text`` (any length)."""
    # halves as strings; a round shifts each character of one half by keyed bytes of the other
    byte = "cast(conv(substr(sha2(concat_ws('|', {key}, {kind}, i, j div 32, {other}), 256), 2 * (j % 32) + 1, 2), 16, 10) as int)"

    def shifted(half: str, other: str) -> str:
        by = byte.format(key=_lit(key), kind=_lit(kind), other=other)
        cls = lambda lo, n: f"char({lo} + (ascii(c) - {lo} + {by}) % {n})"
        return (
            f"array_join(transform(split({half}, ''), (c, j) -> case when c rlike '^[a-z]$' then {cls(97, 26)} "
            f"when c rlike '^[A-Z]$' then {cls(65, 26)} when c rlike '^[0-9]$' then {cls(48, 10)} else c end), '')"
        )

    u = f"cast(length({text}) div 2 as int)"
    fold = (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', substr({text}, 1, {u}), 'r', substr({text}, {u} + 1)), (s, i) -> "
        f"if(i % 2 = 0, named_struct('l', {shifted('s.l', 's.r')}, 'r', s.r), named_struct('l', s.l, 'r', {shifted('s.r', 's.l')})))"
    )
    return f"transform(array({fold}), p -> concat(p.l, p.r))[0]"


def _refill(shape: str, digits: str) -> str:
    """SQL of ``shape`` with its digits replaced, in order, by those of ``digits``."""
    at = f"length(regexp_replace(substr({shape}, 1, k), '[^0-9]', ''))"
    return f"array_join(transform(sequence(1, length({shape})), k -> if(substr({shape}, k, 1) rlike '[0-9]', substr({digits}, {at}, 1), substr({shape}, k, 1))), '')"


def _luhn(d: str) -> str:
    """SQL of the Luhn sum of the digit string ``d`` (check digit last)."""
    return (
        f"aggregate(sequence(1, length({d})), 0, (t, k) -> t + transform(array(cast(substr({d}, -k, 1) as int) * (2 - k % 2)), "
        "v -> if(v > 9, v - 9, v))[0])"
    )


# kind of a candidate x that is no secret, by its form (checks that need arithmetic follow in _valid)
_KIND = f"""case
 when x like '%@%' and x rlike {_lit('^' + EMAIL + '$')} then 'email'
 when x rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then 'ip'
 when x rlike '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}|[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}})$' then 'date'
 when x rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then 'ssn'
 when x rlike '^([+]1[ .-]?)?([(][0-9]{{3}}[)] ?|[0-9]{{3}}[.-])[0-9]{{3}}[.-][0-9]{{4}}$' then 'phone'
 else 'card' end"""

_DAY = """case when x like '%-%' then try_to_date(x, 'yyyy-MM-dd') when x like '%/%' then try_to_date(x, 'dd/MM/yyyy')
 else try_to_date(x, 'dd.MM.yyyy') end"""


#: pieces of a card candidate: digit groups with the separator before each
_GROUPS = "split(x, '(?=[ -])')"


def _runs(g: str, i: str) -> str:
    """SQL of the numbers of groups, largest first, that from the i-th of ``g`` on make a card."""
    d = f"regexp_replace(array_join(slice({g}, {i}, n), ''), '[^0-9]', '')"
    ok = f"length(d) between 13 and 19 and d rlike '[1-9]' and {_luhn('d')} % 10 = 0"
    return f"filter(sequence(least(size({g}) - {i} + 1, 19), 1, -1), n -> transform(array({d}), d -> if(length(d) between 13 and 19, {ok}, false))[0])"


def _cards(card: str) -> str:
    """SQL of the candidate x with every card in it, from the left, replaced by ``card`` of x."""
    first = f"""if(size(h) = 0, named_struct('t', concat(s.t, g[i - 1]), 'skip', 0), named_struct('t', concat(s.t, regexp_extract(g[i - 1], '^[ -]?', 0),
 transform(array(regexp_replace(array_join(slice(g, i, h[0]), ''), '^[ -]', '')), x -> {card})[0]), 'skip', h[0] - 1))"""
    step = f"if(s.skip > 0, named_struct('t', s.t, 'skip', s.skip - 1), transform(array({_runs('g', 'i')}), h -> {first})[0])"
    return f"transform(array({_GROUPS}), g -> aggregate(sequence(1, size(g)), named_struct('t', '', 'skip', 0), (s, i) -> {step}).t)[0]"


def _valid() -> str:
    return f"""case v.kind
 when 'card' then transform(array({_GROUPS}), g -> exists(sequence(1, size(g)), i -> size({_runs('g', 'i')}) > 0))[0]
 when 'ip' then forall(split(x, '[.]'), o -> cast(o as int) <= 255)
 when 'date' then coalesce(year({_DAY}) between 1900 and 2099, false)
 when 'ssn' then not x rlike '^(000|666|9)' and not x like '%-00-%' and not x like '%-0000'
 else true end"""


def _pseudonym(key: str) -> str:
    d = "regexp_replace(x, '[^0-9]', '')"
    payload = f"substr({d}, 1, length({d}) - 1)"
    card = f"transform(array({_digits(payload, 'card', key)}), y -> concat(y, cast((10 - {_luhn('concat(y, 0)')} % 10) % 10 as string)))[0]"
    octet = lambda k: f"cast(split(x, '[.]')[{k}] as bigint)"
    ip = _feistel(f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", "65536", "65536", "ip", key)
    ip = f"transform(array({ip}), p -> concat_ws('.', p.l div 256, p.l % 256, p.r div 256, p.r % 256))[0]"
    day = f"datediff({_DAY}, date'1900-01-01')"
    date = _feistel(f"{day} div 319", f"{day} % 319", "229", "319", "date", key)
    date = (
        f"transform(array({date}), p -> date_format(date_add(date'1900-01-01', cast(p.l * 319 + p.r as int)), "
        "case when x like '%-%' then 'yyyy-MM-dd' when x like '%/%' then 'dd/MM/yyyy' else 'dd.MM.yyyy' end))[0]"
    )
    national = f"substr({d}, -10)"
    phone = f"concat(substr({d}, 1, length({d}) - 10), {_digits(national, 'phone', key)})"
    local = "substring_index(x, '@', 1)"
    named = lambda digits: f"transform(array({digits}), y -> {_refill('x', 'y')})[0]"
    return f"""case v.kind
 when 'card' then {_cards(named(card))}
 when 'phone' then {named(phone)}
 when 'ssn' then {named(_digits(d, 'ssn', key))}
 when 'ip' then {ip}
 when 'date' then {date}
 when 'email' then concat({_letters(local, 'email', key)}, substr(x, length({local}) + 1))
 else if(x like 'AKIA%', concat('AKIA', {_letters('substr(x, 5)', 'secret', key)}), {_letters('x', 'secret', key)}) end"""


def with_pseudonyms(docs: DataFrame, key: str, column: str = "text", out: str = "text", found: str = "found") -> DataFrame:
    """``docs`` with ``column`` pseudonymised into ``out`` and the findings in ``found``:
    array<struct<kind, valid, pseudonym>> in text order."""
    text = f"`{column}`"
    pattern = _lit(CANDIDATE)
    step = docs.withColumn("__pii_m", F.expr(f"if({text} rlike {_lit('[0-9@]|' + _LABEL)}, regexp_extract_all({text}, {pattern}, 0), array())"))
    step = step.withColumn("__pii_s", F.expr(f"if({text} rlike {_lit(_LABEL)}, regexp_extract_all({text}, {_lit(_MARKED)}, 1), array())"))
    kinds = f"transform(__pii_m, (x, i) -> named_struct('x', x, 'kind', if(coalesce(get(__pii_s, i), '') <> '', 'secret', {_KIND})))"
    step = step.withColumn("__pii_v", F.expr(kinds))
    judged = f"transform(__pii_v, v -> transform(array(v.x), x -> named_struct('x', x, 'kind', v.kind, 'valid', {_valid()}))[0])"
    step = step.withColumn("__pii_j", F.expr(judged))
    swapped = f"transform(__pii_j, v -> transform(array(v.x), x -> named_struct('kind', v.kind, 'valid', v.valid, 'pseudonym', if(v.valid, {_pseudonym(key)}, x)))[0])"
    step = step.withColumn("__pii_f", F.expr(swapped))
    pieces = f"split({text}, {pattern}, -1)"
    joined = (
        f"if(size(__pii_f) > 0, transform(array({pieces}), p -> concat(p[0], array_join(transform(__pii_f, (f, i) -> concat(f.pseudonym, p[i + 1])), '')))[0], {text})"
    )
    step = step.withColumn("__pii_t", F.expr(joined))
    base = [F.col(f"`{c}`") for c in docs.columns if c not in (out, found)]
    return step.select(*base, F.col("__pii_t").alias(out), F.col("__pii_f").alias(found))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, found) for each row of ``docs(doc_id, text)``."""
    return with_pseudonyms(docs.select("doc_id", F.col("text").cast("string").alias("text")), key).select("doc_id", "text", "found")
